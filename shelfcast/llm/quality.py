"""Quality classifier by co-training of two views.

View ``text``: which word beginnings (4 and 5 bytes) and punctuation runs occur
in the whole text. View ``page``: source, language, length and layout figures
(shares of capitals, digits, symbols, blanks and non-ASCII bytes, lines, word
length, share of different words), each in quantile bins. For each target (low
quality, toxic) both views have a logistic model. In each round every model is
fitted on its labels, and unlabelled documents on which the *other* view is
confident (beyond the cut at which held-out labelled documents are
``PRECISION`` pure) join its labels. At the end both views are calibrated on
the held-out labels, combined, and every document is scored.

Bounded: at most ``MOST_LABELLED`` labelled documents (smallest hashes of the
id) are held by the driver, with at most ``MOST_FEATURES`` text features counted
over them. All other documents are the unlabelled ones: each step of a fit is a
Spark job that sums the gradients over them, and the quantiles of the figures
come from all documents. Sources and languages are hashed into a fixed width.
Scoring covers all documents; models are a few hundred KB at most.

Edge cases: null text counts as empty, null source or language as a value of
its own; labels that are null are ignored, and of several labels of an id the
worse one holds; a target without labelled documents of both kinds is not
judged (probability null, nothing is rejected for it); an empty table gives an
empty result; equal documents get equal scores; further columns pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import discard, materialise, prepare, table

MOST_LABELLED = 16_000
MOST_FEATURES = 3_000
LEAST_DOCUMENTS = 3      # of the sample with a text feature
LEAST_Z = 4.0            # deviation of a text feature's share in a target, in standard errors
ROUNDS = 3
PRECISION = 0.98
HOLD_OUT = 5             # every fifth labelled document
BINS = 12
REJECT = 0.5
SOURCES, LANGS = 4096, 512   # columns that names are hashed into
DIRECT = 256             # so many tasks send their sums to the driver themselves; those of more are added up first
TARGETS = ("low", "toxic")

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKS = bytes(32 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b < 33 else b for b in range(256))
_FIGURES = 9


def text_features(text: str | None) -> set[bytes]:
    """Word beginnings and punctuation runs of a whole text."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    words = set(raw.translate(_LETTERS).split())
    return ({w[:4] for w in words if len(w) > 3} | {w[:5] for w in words if len(w) > 4}
            | {b"\0" + m[:8] for m in set(raw.translate(_MARKS).split())})


def page_figures(text: str | None, n_chars) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    symbols = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    return [float(np.log1p(n_chars if n_chars is not None else len(raw))), c[65:91].sum() / n, c[48:58].sum() / n,
            symbols / n, c[32] / n, c[128:].sum() / n, c[10] / n, len(raw) / k, len(set(words)) / k]


# ---- logistic models over sparse 0/1 features ----

class Sparse:
    """Rows of feature indices; every row also has the last column, the intercept."""

    def __init__(self, rows: list, width: int):
        self._set(np.array([len(r) for r in rows], np.int64),
                  np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32), width)

    @classmethod
    def of_column(cls, c: pa.Array, width: int) -> Sparse:
        """From lists of feature numbers, or from the same packed into bytes."""
        if not pa.types.is_list(c.type):
            return cls.of_packed(c, width)
        out = cls([], width)
        out._set(np.diff(c.offsets.to_numpy()), c.flatten().to_numpy(), width)
        return out

    @classmethod
    def of_packed(cls, packed: pa.BinaryArray, width: int) -> Sparse:
        """From rows of little-endian 32-bit feature numbers."""
        out = cls([], width)
        at = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4).astype(np.int64) if len(packed) else np.zeros(1, np.int64)
        data = packed.buffers()[2]
        cols = np.frombuffer(data, np.uint8)[at[0]:at[-1]].view("<i4") if data is not None and at[-1] > at[0] else np.zeros(0, np.int32)
        out._set(np.diff(at) // 4, cols, width)
        return out

    def _set(self, size: np.ndarray, cols: np.ndarray, width: int) -> None:
        self.width, self.n = width + 1, len(size)
        self.start = np.cumsum(size + 1) - (size + 1)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), size + 1)
        self.col = np.insert(cols.astype(np.int32), np.cumsum(size), np.int32(width))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.col], self.start) if self.n else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def packed(row) -> bytes:
    return np.asarray(row, "<i4").tobytes()


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps=100, rate=0.15,
                 ridge=2e-5) -> np.ndarray:
    """Weights and, last, the intercept; from ``start`` a third of the steps does."""
    total = max(weight.sum(), 1e-9)
    if start is None:
        w = np.zeros(x.width)
        w[-1] = np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5))
    else:
        w, steps = start.copy(), steps // 3
    penalty = np.full(x.width, ridge)
    penalty[-1] = 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.back((sigmoid(x.dot(w)) - y) * weight / total) + penalty * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def calibrate(score: np.ndarray, y: np.ndarray, steps=60) -> tuple[float, float]:
    """Slope (not negative) and intercept of the log-odds, by damped Newton steps."""
    x = np.stack([score, np.ones_like(score)], 1)
    c = np.array([0.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    for _ in range(steps):
        p = sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        c = c - np.clip(np.linalg.solve(h, x.T @ (p - y) + np.array([0.05 * c[0], 0])), -2, 2)
    return max(0.0, float(c[0])), float(c[1])


def combine(a: np.ndarray, b: np.ndarray, y: np.ndarray, steps=60) -> list[float]:
    """Weights of two calibrated log-odds and an intercept; a view without merit gets none."""
    x = np.stack([a, b, np.ones_like(a)], 1)
    c = np.array([1.0, 0.0, 0.0])
    prior = np.array([0.5, 0.5, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.2 * np.eye(3)
        c = c - np.clip(np.linalg.solve(h, x.T @ (p - y) + 0.2 * (c - prior)), -2, 2)
    c[:2] = np.maximum(c[:2], 0)
    return [float(v) for v in c]


def pure_cuts(held: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The scores below and above which the held-out labels are pure enough."""
    order = np.argsort(held)
    s, t = held[order], y[order]
    n = np.arange(1, len(s) + 1)
    low = np.flatnonzero((np.cumsum(1 - t) / n >= PRECISION) & (n >= 5))
    high = np.flatnonzero((np.cumsum(t[::-1]) / n >= PRECISION) & (n >= 5))
    return float(s[low[-1]]) if len(low) else -np.inf, float(s[::-1][high[-1]]) if len(high) else np.inf


def beyond(score: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    up, down = score > high, score < low
    return up & ~down, down & ~up


def confident(score: np.ndarray, held: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool scores beyond the cuts at which the held-out labels are pure enough."""
    return beyond(score, *pure_cuts(held, y))


def co_train(views: list[Sparse], labelled: np.ndarray, y: np.ndarray, held: np.ndarray, pool: np.ndarray, rounds=ROUNDS) -> dict | None:
    """Models of both views for one target. ``labelled``, ``held``, ``pool``: row
    masks; ``y``: labels of all rows (only those of labelled rows are read)."""
    train = labelled & ~held
    if min(y[train].sum(), (1 - y[train]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        return None
    target = [y.astype(float).copy() for _ in views]
    weight = [train.astype(float) for _ in views]
    models: list = [None] * len(views)
    for r in range(rounds + 1):
        models = [fit_logistic(x, t, w, m) for x, t, w, m in zip(views, target, weight, models)]
        scores = [x.dot(m) for x, m in zip(views, models)]
        if r == rounds:
            break
        for other in (0, 1):
            up, down = confident(scores[1 - other][pool], scores[1 - other][held], y[held])
            at = np.flatnonzero(pool)
            weight[other][at] = 0.5 * (up | down)
            weight[other][at] *= balance(train.sum(), weight[other][at].sum())
            target[other][at] = up
    cal = [calibrate(s[held], y[held].astype(float)) for s in scores]
    odds = [c[0] * s + c[1] for c, s in zip(cal, scores)]
    mix = combine(odds[0][held], odds[1][held], y[held].astype(float))
    return {"models": models, "calibration": cal, "mix": mix}


def balance(labels: float, pool: float) -> float:
    """Factor of the weight of all confident rows, so that together they don't
    outweigh the labels: the corpus may be any number of times as large."""
    return min(1.0, labels / max(pool, 1e-9))


def verdicts(views: list[Sparse], judges: list, cuts: list) -> list:
    """For each view the rows on which the other view is confident: (up, down)."""
    scores = [x.dot(m) for x, m in zip(views, judges)]
    return [beyond(scores[1 - k], *cuts[k]) for k in (0, 1)]


def pool_sums(views: list[Sparse], state: dict, marks: np.ndarray | None = None) -> np.ndarray:
    """For each target and view, end to end: the gradient sum over the rows on
    which the other view is confident, and their weight. ``state``: target to
    (models that judge, cuts of the judging view, weights being fitted); ``marks``:
    the verdicts of ``judged``, if they are there."""
    out = []
    for t, (judges, cuts, now) in enumerate(state[name] for name in sorted(state)):
        if marks is None:
            found = verdicts(views, judges, cuts)
        else:
            found = [((marks >> (4 * t + 2 * k) & 1).astype(bool), (marks >> (4 * t + 2 * k + 1) & 1).astype(bool)) for k in (0, 1)]
        for k in (0, 1):
            up, down = found[k]
            weight = 0.5 * (up | down)
            out += [views[k].back((sigmoid(views[k].dot(now[k])) - up) * weight), [weight.sum()]]
    return np.concatenate(out)


def co_train_over(views: list[Sparse], y: dict, labelled: dict, held: dict, sums, rounds=ROUNDS, steps=100, rate=0.15, ridge=2e-5,
                  judge=None) -> dict:
    """``co_train`` for all targets at once, over an unlabelled pool of any size:
    ``sums`` gives the pool's ``pool_sums`` for a state. The labelled rows are here.
    ``judge(models, cuts)``, if given, is called once a round, before its sums."""
    names = [n for n in sorted(y) if min(y[n][labelled[n] & ~held[n]].sum(), (1 - y[n])[labelled[n] & ~held[n]].sum(),
                                         y[n][held[n]].sum(), (1 - y[n])[held[n]].sum()) >= 1]
    train = {n: (labelled[n] & ~held[n]).astype(float) for n in names}
    models = {n: [fit_logistic(x, y[n].astype(float), train[n], steps=steps, rate=rate, ridge=ridge) for x in views] for n in names}
    for _ in range(rounds if names else 0):
        scores = {n: [x.dot(m) for x, m in zip(views, models[n])] for n in names}
        cuts = {n: [pure_cuts(scores[n][1 - k][held[n]], y[n][held[n]]) for k in (0, 1)] for n in names}
        if judge:
            judge(models, cuts)
        now = {n: [m.copy() for m in models[n]] for n in names}
        moments = {n: [(np.zeros(x.width), np.zeros(x.width)) for x in views] for n in names}
        for t in range(1, steps // 3 + 1):
            got = sums({n: (models[n], cuts[n], now[n]) for n in names})
            at, after = 0, {n: [None, None] for n in names}
            for n in names:
                for k, x in enumerate(views):
                    share = balance(train[n].sum(), got[at + x.width])
                    total = max(train[n].sum() + share * got[at + x.width], 1e-9)
                    w = now[n][k]
                    penalty = np.full(x.width, ridge)
                    penalty[-1] = 0
                    g = (x.back((sigmoid(x.dot(w)) - y[n]) * train[n]) + share * got[at:at + x.width]) / total + penalty * w
                    m, v = moments[n][k]
                    m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                    moments[n][k] = (m, v)
                    after[n][k] = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
                    at += x.width + 1
            now = after
        models = now
    out = {}
    for n in names:
        scores = [x.dot(m) for x, m in zip(views, models[n])]
        of = y[n][held[n]].astype(float)
        cal = [calibrate(s[held[n]], of) for s in scores]
        odds = [c[0] * s + c[1] for c, s in zip(cal, scores)]
        out[n] = {"models": models[n], "calibration": cal, "mix": combine(odds[0][held[n]], odds[1][held[n]], of)}
    return out


def name_column(name: str | None, width: int) -> int:
    """The column of a source or language; the last one, ``width``, is for null."""
    return width if name is None else zlib.crc32(name.encode("utf-8", "surrogatepass")) % width


class Classifier:
    """Both targets' models with the vocabulary and bins of the views."""

    def __init__(self, vocab: list[bytes], cuts: list, targets: dict):
        self.vocab = {v: i for i, v in enumerate(vocab)}
        self.words = frozenset(vocab)
        self.cuts, self.targets = cuts, targets
        self.width = (len(vocab), _FIGURES * BINS + SOURCES + LANGS + 2)

    def text_row(self, found: set) -> list[int]:
        return sorted(self.vocab[f] for f in found & self.words)

    def page_row(self, figures, source, lang) -> list[int]:
        row = [i * BINS + int(np.searchsorted(c, f, "right")) for i, (c, f) in enumerate(zip(self.cuts, figures))]
        base = _FIGURES * BINS
        row.append(base + name_column(source, SOURCES))
        row.append(base + SOURCES + 1 + name_column(lang, LANGS))
        return row

    def score(self, texts, sources, langs, n_chars) -> dict[str, np.ndarray]:
        """Probability of each target; None for a target that isn't judged."""
        return self.score_views([
            Sparse([self.text_row(text_features(t)) for t in texts], self.width[0]),
            Sparse([self.page_row(page_figures(t, n), s, g) for t, s, g, n in zip(texts, sources, langs, n_chars)], self.width[1])])

    def score_views(self, views: list[Sparse]) -> dict[str, np.ndarray]:
        out = {}
        for name in TARGETS:
            m = self.targets.get(name)
            if m is None:
                out[name] = None
                continue
            odds = [c[0] * x.dot(w) + c[1] for x, w, c in zip(views, m["models"], m["calibration"])]
            out[name] = sigmoid(m["mix"][0] * odds[0] + m["mix"][1] * odds[1] + m["mix"][2])
        return out


def fit(docs: DataFrame, labels: DataFrame, most_labelled=MOST_LABELLED, most_features=MOST_FEATURES, rounds=ROUNDS) -> Classifier:
    """Co-train on a bounded number of labelled and all other documents; columns
    doc_id, text, lang, source, n_chars and doc_id, quality, toxic."""
    model, rows = fit_rows(docs, labels, most_labelled, most_features, rounds)
    discard(rows)
    return model


def fit_rows(docs: DataFrame, labels: DataFrame, most_labelled=MOST_LABELLED, most_features=MOST_FEATURES,
             rounds=ROUNDS) -> tuple[Classifier, DataFrame]:
    """The model, and the table of the features of all documents that it was fitted from."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        (1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    chosen = (known.filter("low is not null or toxic is not null").withColumn("o", F.xxhash64("doc_id", F.lit(7)))
              .orderBy("o", "doc_id").limit(most_labelled).drop("o").withColumn("own", F.lit(True)))
    ids = materialise(chosen, "quality-sample")
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def features(batches):
        from shelfcast.llm import quality as Q
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(
                [sorted(Q.text_features(t)) for t in b.column(0).to_pylist()], pa.list_(pa.binary()))], names=["low", "toxic", "found"])

    # at most most_labelled ids
    sample = wide.join(F.broadcast(ids), "doc_id").select("text", "low", "toxic")
    sample = materialise(sample.mapInArrow(features, "low int, toxic int, found array<binary>"), "quality-features")
    # text features that tell the targets apart, counted by Spark over the labelled sample
    e = sample.select(F.explode("found").alias("f"), F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    n, n_low, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    g = e.groupBy("f").agg(F.count("*").alias("c"), F.sum("low").alias("a"), F.sum("toxic").alias("b")).filter(F.col("c") >= LEAST_DOCUMENTS)

    def z(hits, total):
        share = total / max(n, 1)
        return F.abs(F.col(hits) - F.col("c") * share) / F.sqrt(F.col("c") * (share * (1 - share) + 1e-9) + 1e-9)

    top = lambda h, t: (g.withColumn("z", z(h, t)).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f")
                        .limit(most_features // 2).select("f"))
    vocab = sorted({bytes(r.f) for r in top("a", n_low).union(top("b", n_toxic)).collect()})
    discard(sample)
    words = spark.sparkContext.broadcast({v: i for i, v in enumerate(vocab)})
    schema = "doc_id string, low int, toxic int, own boolean, lang string, source string, found binary, figures array<double>"

    def numbered(batches):
        from shelfcast.llm import quality as Q
        place = words.value
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            yield pa.RecordBatch.from_arrays([
                pa.array([None if i is None else str(i) for i in c["doc_id"]], pa.string()), pa.array(c["low"], pa.int32()),
                pa.array(c["toxic"], pa.int32()), pa.array(c["own"], pa.bool_()), pa.array(c["lang"], pa.string()), pa.array(c["source"], pa.string()),
                pa.array([Q.packed(sorted(place[f] for f in Q.text_features(t) if f in place)) for t in c["text"]], pa.binary()),
                pa.array([Q.page_figures(t, n) for t, n in zip(c["text"], c["n_chars"])], pa.list_(pa.float64()))],
                names=["doc_id", "low", "toxic", "own", "lang", "source", "found", "figures"])

    rows = wide.join(F.broadcast(ids), "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    rows = materialise(rows.select("doc_id", "low", "toxic", "own", "lang", "source", "text", "n_chars").mapInArrow(numbered, schema), "quality-rows")
    each = rows.select(*[F.element_at("figures", i + 1).alias(f"f{i}") for i in range(_FIGURES)])
    cuts = [np.array(q or [0.0] * (BINS - 1)) for q in each.approxQuantile(each.columns, np.linspace(0, 1, BINS + 1)[1:-1].tolist(), 0.002)]
    model = Classifier(vocab, cuts, {})

    def paged(batches):
        for b in batches:
            figures, source, lang = (b.column(i).to_pylist() for i in (2, 1, 0))
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array([packed(model.page_row(f, x, g)) for f, x, g in zip(figures, source, lang)],
                                                                    pa.binary())], names=["found", "page"])

    pool = materialise(rows.filter("not own").select("lang", "source", "figures", "found").mapInArrow(paged, "found binary, page binary"),
                       "quality-pool")
    # on the driver: the labelled documents' feature numbers and figures, column by column
    got = rows.filter("own").toArrow().sort_by("doc_id").combine_chunks()
    column = lambda c: got.column(c).combine_chunks()
    figures = np.asarray(column("figures").flatten().to_numpy()).reshape(-1, _FIGURES)
    views = [Sparse.of_packed(column("found"), model.width[0]),
             Sparse([model.page_row(f, x, g) for f, x, g in zip(figures, column("source").to_pylist(), column("lang").to_pylist())], model.width[1])]
    y, labelled, held = {}, {}, {}
    for name in TARGETS:
        label = column(name).to_pylist()
        labelled[name] = np.array([v is not None for v in label], bool)
        y[name] = np.array([v or 0 for v in label], np.int64)
        held[name] = np.zeros(len(label), bool)
        held[name][np.flatnonzero(labelled[name])[::HOLD_OUT]] = True
    now = [pool]

    def judge(models, cuts):
        before = now[0]
        now[0] = materialise(judged(pool, model.width, models, cuts), "quality-judged")
        if before is not pool:
            discard(before)

    model.targets = co_train_over(views, y, labelled, held, lambda state: over_pool(now[0], model.width, state), rounds, judge=judge)
    for t in {id(t): t for t in (pool, now[0])}.values():
        discard(t)
    return model, rows


def judged(pool: DataFrame, width: tuple, models: dict, cuts: dict) -> DataFrame:
    """Every row of the pool with the ``verdicts`` of a round as bits: four a target in
    sorted order, for each view up and down. Features of a view for which no target
    has a verdict are left empty: they carry no weight."""

    def run(batches):
        import pyarrow.compute as pc
        from shelfcast.llm import quality as Q
        none = pa.scalar(b"", pa.binary())
        for b in batches:
            views = [Q.Sparse.of_column(b.column(i), w) for i, w in enumerate(width)]
            marks, used = np.zeros(b.num_rows, np.int32), np.zeros((2, b.num_rows), bool)
            for t, name in enumerate(sorted(models)):
                for k, (up, down) in enumerate(Q.verdicts(views, models[name], cuts[name])):
                    marks |= (up | down.astype(np.int32) << 1).astype(np.int32) << (4 * t + 2 * k)
                    used[k] |= up | down
            yield pa.RecordBatch.from_arrays([*[pc.if_else(pa.array(used[k]), b.column(k), none) for k in (0, 1)], pa.array(marks)],
                                             names=["found", "page", "marks"])

    return pool.mapInArrow(run, "found binary, page binary, marks int")


def over_pool(pool: DataFrame, width: tuple, state: dict) -> np.ndarray:
    """``pool_sums`` over the rows (found, page and, once judged, marks) of a table."""
    size = len(state) * (sum(width) + 4)

    def run(batches):
        from shelfcast.llm import quality as Q
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                marks = b.column(2).to_numpy() if b.num_columns > 2 else None
                out += Q.pool_sums([Q.Sparse.of_column(b.column(i), w) for i, w in enumerate(width)], state, marks)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "v"])

    parts = pool.mapInArrow(run, "at bigint, v double")
    if pool.rdd.getNumPartitions() > DIRECT:
        parts = parts.groupBy("at").agg(F.sum("v").alias("v"))
    got = parts.toArrow()
    return np.bincount(got.column("at").to_numpy(), got.column("v").to_numpy(), size)


def _verdict(s: dict, n: int) -> pa.StructArray:
    p = [s[t] if s[t] is not None else np.full(n, np.nan) for t in ("low", "toxic")]
    rejected = (np.nan_to_num(p[0]) >= REJECT) | (np.nan_to_num(p[1]) >= REJECT)
    return pa.StructArray.from_arrays([pa.array(p[0], pa.float64(), from_pandas=True), pa.array(p[1], pa.float64(), from_pandas=True),
                                       pa.array(rejected, pa.bool_())], ["p_low", "p_toxic", "rejected"])


_STRUCT = T.StructType().add("p_low", T.DoubleType()).add("p_toxic", T.DoubleType()).add("rejected", T.BooleanType())


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with a struct ``quality_class``: p_low, p_toxic, rejected."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]
    schema = T.StructType(docs.schema.fields + [T.StructField("quality_class", _STRUCT)])

    def run(batches):
        from shelfcast.llm import quality as Q
        for b in batches:
            made = Q._verdict(sent.value.score(*(b.column(i).to_pylist() for i in at)), b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "quality_class"])

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and ``quality_class`` of every document, as ``classify`` gives them, but
    scored from the features that the fit has written: the texts are read once less."""
    model, rows = fit_rows(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("quality_class", _STRUCT)])

    def run(batches):
        from shelfcast.llm import quality as Q
        for b in batches:
            m = sent.value
            figures, source, lang = (b.column(i).to_pylist() for i in (2, 3, 4))
            views = [Q.Sparse.of_packed(b.column(1), m.width[0]),
                     Q.Sparse([m.page_row(f, x, g) for f, x, g in zip(figures, source, lang)], m.width[1])]
            yield pa.RecordBatch.from_arrays([b.column(0), Q._verdict(m.score_views(views), b.num_rows)], names=["doc_id", "quality_class"])

    out = rows.select("doc_id", "found", "figures", "source", "lang").mapInArrow(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def op5_quality(spark, sf_dir):
    r = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    q = F.col("quality_class")
    return r.select("doc_id", F.round(q["p_low"], 6).alias("p_low_quality"), F.round(q["p_toxic"], 6).alias("p_toxic"),
                    q["rejected"].alias("rejected"))
