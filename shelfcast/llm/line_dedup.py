"""Line dedup by overlapping windows of consecutive lines.

Every document is cut at line feeds; each run of ``window`` consecutive lines
is hashed. A window that occurs more than once anywhere is repeated: its first
occurrence, in the order of (id, text hash, line), stays and the lines covered
by any later occurrence are removed. Overlapping windows merge into covered
positions, so a long repeated passage goes as a whole. Windows of blank lines
only are not counted. Hashes are 128 bits over the exact lines.

The first occurrence is an aggregate with map-side partial results, so a window
that a third of the documents share costs one row per task; the windows are
joined back on the hash with a join that Spark may split where it is skewed.

Edge cases: null text has no lines and stays null; a document of fewer lines
than the window is left as it is; null ids sort first; rows equal in id and
text count as one document (all of them keep or lose the same lines); an empty
table gives an empty result; further columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import materialise, table

WINDOW = 3


def _windows(lines: Column, n: int) -> Column:
    """Array of (line, 128-bit hash) of the windows that hold more than blanks."""
    def one(i):
        piece = F.concat_ws("\n", *[F.element_at(lines, (i + k + 1).cast("int")) for k in range(n)])
        return F.struct(i.cast("int").alias("line"), F.when(F.trim(F.translate(piece, "\n\r\t", "   ")) != "",
                                                            F.md5(piece)).alias("h"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - n), one), lambda x: x["h"].isNotNull())


def covered_lines(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW) -> DataFrame:
    """(id, text hash) of the documents that lose lines, with the sorted line
    numbers that later occurrences cover."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                    F.split(text_col, "\n", -1).alias("lines"))
    d = d.filter(F.size("lines") >= window)
    w = (d.select("id", "th", F.explode(_windows(F.col("lines"), window)).alias("w"))
          .select("id", "th", F.col("w.line").alias("line"), F.unhex("w.h").alias("h")))
    at = F.struct("id", "th", "line")
    first = w.groupBy("h").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = materialise(first, "line-windows")
    later = w.join(first, "h").filter(at != F.col("first"))
    return later.groupBy("id", "th").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("line", F.col("line") + window - 1))))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW) -> DataFrame:
    """``docs`` with a struct column ``line_dedup``: n_lines, n_removed, text
    (what is left). All other columns stay."""
    gone = covered_lines(docs, id_col, text_col, window)
    d = docs.alias("d")
    g = gone.alias("g")
    lines = F.split(F.col(f"d.{text_col}"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g.gone"))
    kept = F.transform(left, lambda i: F.element_at(lines, i + 1))
    out = F.struct(F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                   F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias("n_removed"),
                   F.when(F.col("g.gone").isNull(), F.col(f"d.{text_col}"))
                   .otherwise(F.array_join(kept, "\n")).alias("text"))
    j = d.join(g, F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("g.th")), "left")
    return j.select("d.*", out.alias("line_dedup"))


def op8_line_dedup(spark, sf_dir):
    r = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("line_dedup")
    return r.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(x["n_lines"]).cast("long").alias("n_lines"),
                    x["n_removed"].alias("n_removed"),
                    F.sha2(F.coalesce(x["text"], F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, concat_ws(chr(10), lines[i], lines[i + 1], lines[i + 2]) AS piece
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)),
v AS (SELECT doc_id, i, piece FROM w WHERE trim(replace(replace(replace(piece, chr(10), ' '), chr(13), ' '), chr(9), ' ')) <> ''),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY piece ORDER BY doc_id, i) AS k FROM v),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE k > 1) GROUP BY doc_id),
k AS (SELECT doc_id, lines, text, coalesce(g.gone, []) AS gone FROM l LEFT JOIN g USING (doc_id))
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN len(gone) = 0 THEN text ELSE array_to_string(
           [lines[j] FOR j IN range(1, len(lines) + 1) IF NOT list_contains(gone, j)], chr(10)) END, '')) AS kept_sha256
FROM k
"""
