"""Hard-negative mining by Fagin's threshold algorithm.

A vector's components become the integers floor(scale * x); a row's score for an
anchor is their inner product, higher first, ties by smaller id. An anchor's
positives are its first ``n_positive`` other rows of its label. For each anchor
and positive the first ``n_negative`` rows of another label are returned whose
score lies between ``low`` and ``high`` per cent of the positive's.

Rows are dealt to blocks of about BLOCK by a hash of their id, anchors to blocks
of about ANCHORS, and each pair of blocks is one bounded group: a stated query
set against all rows, in blocks. A task sorts every dimension of its rows once.
For an anchor it reads these lists downwards where the anchor's component is
positive and upwards where it is negative (signed sorted access), scores each row
that appears for the first time in whole (random access, integers), and stops
when the threshold, the best score a row not yet seen can have, is strictly below
the last score of every open window, or below the window's lower end. Strictly,
because rows of equal score compete by id. The best of all blocks meet in a
ranking per anchor (Spark limits the rows of each task before the exchange).

Edge cases: rows with a null id, a null label, a null or empty vector, or a null
or non-finite component take no part; rows with the anchor's id are never its
partners; rows equal in id, label and vector count as one, and
anchors that share only the id are ranked together; vectors of different
length never meet; scores must fit 62 bits, larger components are an error; an
empty table, or no anchors, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import discard, materialise, prepare, table

BLOCK = 8192
ANCHORS = 1024
START = 16        # depth of the first reading of the lists; each further one is twice as deep
N_POSITIVE = 5
N_NEGATIVE = 10
LOW, HIGH = 30, 90
SCALE = 256
EVERY = 100


class Block:
    """Rows of one block: scores are found by reading sorted lists per dimension."""

    def __init__(self, ids, labels, q):
        by_id = np.lexsort((*q.T[::-1], labels, ids))
        ids, labels, q = ids[by_id], labels[by_id], q[by_id]
        new = np.ones(len(ids), bool)
        if len(ids) > 1:
            new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (q[1:] != q[:-1]).any(axis=1)
        self.ids, self.labels, self.q = ids[new], labels[new], q[new]     # rows in the order of ids
        self.order = np.argsort(self.q, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.q.T, self.order, axis=1)

    def search(self, anchor, allowed, windows):
        """For each window (lowest, highest, k) the rows of the k best scores among the
        ``allowed`` rows: [(row numbers, scores)], best first."""
        n = len(self.ids)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        still = list(range(len(windows)))
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        seen = np.zeros(n, bool)
        depth, step, unread = 0, START, n
        while still and unread:
            to = min(depth + step, n) if len(up) + len(down) else n
            fresh = np.zeros(n, bool)
            fresh[self.order[up, depth:to]] = True
            fresh[self.order[down, n - to:n - depth]] = True
            if to == n:                       # the lists have ended (or the anchor is zero)
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            unread -= len(rows)
            threshold = int((anchor[up] * self.values[up, to - 1]).sum() + (anchor[down] * self.values[down, n - to]).sum())
            rows = rows[allowed[rows]]
            scores = self.q[rows] @ anchor
            for w in list(still):
                lowest, highest, k = windows[w]
                r, s = best[w]
                last = int(s[-1]) if len(s) == k else lowest
                ok = (scores >= last) & (scores <= highest)
                if ok.any():
                    r, s = np.append(r, rows[ok]), np.append(s, scores[ok])
                    first = np.lexsort((r, -s))[:k]         # rows ascend by id
                    best[w] = r, s = r[first], s[first]
                last = int(s[-1]) if len(s) == k else lowest
                if threshold < last:
                    still.remove(w)
            depth, step = to, 2 * step
        return best


def _columns(t: pa.Table, dim: int):
    t = t.combine_chunks()
    q = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["q"].chunks] or [np.zeros(0, np.int64)])
    return t["id"].to_numpy(), t["label"].to_numpy(), q.reshape(-1, dim).astype(np.int64)


def _search(positives: bool, n_positive: int, n_negative: int, low: int, high: int):
    least = -(1 << 62)

    def run(key, rows, anchors):
        dim = key[0].as_py()
        out = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            block = Block(*_columns(rows, dim))
            ids, labels, q = _columns(anchors, dim)
            targets = [None] * len(ids) if positives else anchors["targets"].to_pylist()
            for i, label, a, scores in zip(ids.tolist(), labels.tolist(), q, targets):
                if positives:
                    allowed, scores, windows = (block.labels == label) & (block.ids != i), [0], [(least, -least, n_positive)]
                else:     # low * p <= 100 * s <= high * p
                    allowed = (block.labels != label) & (block.ids != i)
                    windows = [(-(-low * p // 100), high * p // 100, n_negative) for p in scores]
                for p, (r, s) in zip(scores, block.search(a, allowed, windows)):
                    out[0] += [i] * len(r)
                    out[1] += [p] * len(r)
                    out[2] += block.ids[r].tolist()
                    out[3] += s.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["anchor", "target", "id", "score"])
    return run


def _ready(rows: DataFrame, id_col, label_col, vec_col, scale) -> DataFrame:
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    whole = F.size(vec_col) > 0
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
            .filter(whole & fine)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q")))


def mine(rows: DataFrame, anchors: Column, id_col="vec_id", label_col="label", vec_col="embedding", n_positive=N_POSITIVE,
         n_negative=N_NEGATIVE, low=LOW, high=HIGH, scale=SCALE, block=BLOCK, anchor_block=ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchors``
    is a condition over ``id``, ``label`` and ``q``, the prepared rows."""
    prepare(rows.sparkSession)
    r = materialise(_ready(rows, id_col, label_col, vec_col, scale), "negatives-rows")
    n, m, top, dim = r.agg(F.count("*"), F.count(F.when(anchors, 1)), F.max(F.array_max(F.transform("q", F.abs))), F.max(F.size("q"))).first()
    if n and int(top) ** 2 * dim >= 1 << 62:
        raise ValueError(f"components up to {top} give scores of more than 62 bits")
    blocks, anchor_blocks = max(1, -(-n // block)), max(1, -(-m // anchor_block))
    a = r.filter(anchors).distinct()

    def dealt(df, own, count, other, others):
        return (df.withColumn("dim", F.size("q")).withColumn(own, F.pmod(F.xxhash64("id", F.lit(own)), F.lit(count)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    keys = ["dim", "rb", "ab"]
    left = dealt(r, "rb", blocks, "ab", anchor_blocks).groupBy(keys)

    def search(df, positives):
        right = dealt(df, "ab", anchor_blocks, "rb", blocks).groupBy(keys)
        return left.cogroup(right).applyInArrow(_search(positives, n_positive, n_negative, low, high), "anchor long, target long, id long, score long")

    def ranked(df, of, k):
        w = Window.partitionBy(*of).orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    positives = materialise(ranked(search(a, True), ["anchor"], n_positive), "negatives-positives")
    targets = positives.groupBy("anchor").agg(F.collect_set("score").alias("targets"))
    asked = materialise(a.join(targets, F.col("id") == F.col("anchor")).drop("anchor"), "negatives-anchors")
    negatives = materialise(ranked(search(asked, False), ["anchor", "target"], n_negative), "negatives-found")
    p, g = positives.alias("p"), negatives.alias("g")
    out = p.join(g, (F.col("p.anchor") == F.col("g.anchor")) & (F.col("p.score") == F.col("g.target"))).select(
        F.col("p.anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("g.rank").cast("int").alias("rank"),
        F.col("g.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("g.score").alias("negative_score"))
    out = materialise(out, "negatives")
    for x in (r, positives, asked, negatives):
        discard(x)
    return out


def op12_hard_negatives(spark, sf_dir):
    """Anchors are the rows whose id is divisible by EVERY; where it is divisible by 7, the
    label first becomes (label + 1) % 10."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mine(rows, F.col("id") % EVERY == 0)
