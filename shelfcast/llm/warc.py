"""WARC archives: writing page captures and reading archives back.

Writing. Equal payloads are found by an aggregate on their digest; the capture
with the largest page id becomes the response record, the others revisit
records that refer to it. Records go out through Spark's text writer with the
record trailer as line separator, so the files are plain uncompressed WARC 1.0
on any file system that Spark can write, committed task by task.

Reading, boundary-chain verification. Spark's text reader cuts the archives at
every occurrence of the record magic, in parallel over byte ranges of each file.
Each occurrence is a candidate record: its offset, and through Content-Length
the offset of its successor. Only candidates that can be reached from the start
of the file are records; a magic inside a payload is not. Within a byte range
the pointers are followed by pointer jumping in numpy (one bounded range a
group); each candidate then points out of its range, and the chain over ranges
is resolved by pointer jumping between tables, in a number of rounds that is
the logarithm of the ranges of a file.

Payloads never move for that: lengths and digests of a record that lies in one
piece are computed where it is read. Only records whose payload holds a magic
are put together from their pieces afterwards.

Edge cases: null html is an empty payload (at least 0 bytes: equal ones are
revisited as well); with ``least_bytes`` smaller payloads are all responses;
pages equal in id and payload that share the largest id are all responses; a
null page id counts as smaller than any other and is named by a digest in the
record id; line feeds in a url are percent-encoded; an empty table writes an
archive without records; a truncated archive yields the records before the
break; other columns of the pages are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import materialise, prepare, shared_path, table

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
TRAILER = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 4 groups of 40 bits, 8 letters each."""
    hexed = F.sha1(payload)
    letters = F.array(*[F.lit(c) for c in BASE32])
    groups = [F.conv(F.substring(hexed, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    return F.concat(*[F.element_at(letters, (F.shiftright(n, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"))
                      for n in groups for k in range(7, -1, -1)])


def _record(kind: str, r: dict) -> Column:
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), r["name"], F.lit(">")),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), r["url"]),
             F.lit("Content-Type: application/http; msgtype=response"),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), r["digest"])]
    if kind == "revisit":
        lines += [F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                  F.concat(F.lit("WARC-Refers-To: <"), r["refers"], F.lit(">"))]
    block = F.concat(F.lit(http), r["payload"]) if kind == "response" else F.lit(http)
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html",
                   least_bytes: int = 0) -> None:
    """Write one record a page below ``path``."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("id"),
                     F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
                     payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    groups = (p.select("same", "id", F.octet_length("payload").alias("n")).filter(F.col("n") >= least_bytes)
              .groupBy("same").agg(F.max("id").alias("winner"), F.count("*").alias("copies"))
              .filter("copies > 1 and winner is not null").drop("copies"))
    groups = materialise(groups, "warc-groups")
    g = p.join(groups, "same", "left")
    name = lambda c: F.when(c.isNull(), F.concat(F.lit("urn:page:null:"), F.sha1("payload"))).otherwise(
        F.concat(F.lit("urn:page:"), c.cast("string")))
    r = {"name": name(F.col("id")), "url": F.col("url"), "digest": base32_sha1(F.col("payload")),
         "payload": F.col("payload"), "refers": name(F.col("winner"))}
    again = F.col("winner").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("winner")))
    g.select(F.when(again, _record("revisit", r)).otherwise(_record("response", r)).alias("value")) \
        .write.option("lineSep", TRAILER).text(path)


# ---- reading ----

def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the archives between occurrences of the magic, with the byte
    range (split) that read them and their order in it."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.col("_metadata.file_size").alias("file_size"),
                    F.monotonically_increasing_id().alias("nr"), F.col("value").alias("piece"),
                    F.octet_length("value").cast("long").alias("n")))


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields of each piece as if it were a record, and of the payload if
    the record ends with the piece."""
    head = F.substring_index("piece", "\r\n\r\n", 1)

    def field(name):
        return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))

    length = F.when(field("Content-Length").rlike("^[0-9]{1,18}$"), field("Content-Length").cast("long"))
    has_head = F.contains("piece", F.lit("\r\n\r\n"))
    d = pieces.select("*", F.when(has_head, F.octet_length(head) + 4).cast("long").alias("head_n"), length.alias("block_n"),
                      field("WARC-Type").alias("warc_type"), field("WARC-Record-ID").alias("record_id"),
                      field("WARC-Refers-To").alias("refers"), field("WARC-Payload-Digest").alias("stated_digest"),
                      field("WARC-Target-URI").alias("url"))
    whole = F.col("n") == F.col("head_n") + F.col("block_n") + 4
    return d.withColumn("whole", F.coalesce(whole, F.lit(False)))


def _payload(record: Column, head_n: Column, block_n: Column) -> Column:
    """Payload of a record's text after the magic: its block behind the HTTP head."""
    raw = F.substring(record.cast("binary"), (head_n + 1).cast("int"), block_n.cast("int")).cast("string")
    return F.when(F.startswith(raw, F.lit("HTTP/")) & F.contains(raw, F.lit("\r\n\r\n")), _after_head(raw)).otherwise(raw)


def _after_head(raw: Column) -> Column:
    skip = F.octet_length(F.substring_index(raw, "\r\n\r\n", 1)) + 5
    return F.substring(raw.cast("binary"), skip, F.octet_length(raw)).cast("string")


_LINK = "file string, split long, at long, next long"


def _leave(batch: pa.Table) -> pa.Table:
    """Candidates of one byte range: the offset at which each one's chain leaves
    the range, by pointer jumping."""
    import numpy as np
    at, nxt = (batch.column(c).to_numpy() for c in ("at", "next"))
    order = np.argsort(at)
    a = at[order]
    to = nxt[order]
    pos = np.minimum(np.searchsorted(a, to), len(a) - 1)
    inside = a[pos] == to
    jump = np.where(inside, pos, np.arange(len(a)))
    while True:
        far = jump[jump]
        if np.array_equal(far, jump):
            break
        jump = far
    return pa.table({"file": batch.column("file").take(order), "split": batch.column("split").take(order),
                     "at": a, "next": to[jump]}, schema=pa.schema(
                         [("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("next", pa.int64())]))


def _reached(batch: pa.Table) -> pa.Table:
    """Candidates of one byte range that its entries reach: marks spread over
    pointers of doubled length."""
    import numpy as np
    at, nxt, entry = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "next", "entry"))
    order = np.argsort(at)
    a, to, mark = at[order], nxt[order], entry[order].astype(bool)
    pos = np.minimum(np.searchsorted(a, to), len(a) - 1)
    jump = np.append(np.where(a[pos] == to, pos, len(a)), len(a))
    mark = np.append(mark, False)
    while (jump[:-1] < len(a)).any():
        mark[jump[:-1][mark[:-1]]] = True
        mark[-1] = False
        jump = jump[jump]
    keep = order[mark[:-1]]
    return pa.table({"file": batch.column("file").take(keep), "split": batch.column("split").take(keep),
                     "at": at[keep], "next": nxt[keep]}, schema=pa.schema(
                         [("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("next", pa.int64())]))


def chain(candidates: DataFrame) -> DataFrame:
    """(file, split, at, next) of the candidates that the chain from offset 0
    reaches, of all files. ``candidates``: (file, split, at, next), next null if
    the header states no length."""
    prepare(candidates.sparkSession)
    c = candidates.withColumn("next", F.coalesce("next", F.lit(-1)))
    out = materialise(c.groupBy("file", "split").applyInArrow(_leave, _LINK), "warc-exits")
    # entries of ranges: pointer jumping over the ranges of a file
    ranges = out.select("file", "split").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 1
    jump = out.select("file", "at", F.col("next").alias("to"))
    reach = out.filter("at = 0").select("file", "at")
    for _ in range(max(0, ranges - 1).bit_length()):
        hop = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(jump.select("file", "at"), ["file", "at"])
        reach = materialise(reach.union(hop).distinct(), "warc-reach")
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = materialise(jump.join(far, ["file", "to"], "left")
                           .select("file", "at", F.coalesce("far", "to").alias("to")), "warc-jump")
    marked = c.join(reach.withColumn("entry", F.lit(True)), ["file", "at"], "left").select(
        "file", "split", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "split").applyInArrow(_reached, _LINK)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives below ``path``: file, at (byte offset), next,
    warc_type, record_id, refers, url, stated_digest, payload_bytes,
    payload_digest and, if asked for, payload."""
    pieces = _parsed(_pieces(spark, path))
    body = F.when(F.col("whole"), _payload(F.col("piece"), F.col("head_n"), F.col("block_n")))
    small = materialise(pieces.select(
        "file", "split", "nr", "n", "head_n", "block_n", "whole", "warc_type", "record_id", "refers", "url", "stated_digest",
        "file_size", *_facts(body), *([body.alias("payload")] if with_payload else [])), "warc-pieces")

    # offset of each piece: bytes of the earlier ranges of its file and of the earlier pieces of its range
    size = F.col("n") + len(MAGIC)
    ranges = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "split").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    before = small.groupBy("file", "split").agg(F.sum(size).alias("bytes")).select(
        "file", "split", F.coalesce(F.sum("bytes").over(ranges), F.lit(0)).alias("before"))
    at = (small.select("file", "split", "nr", "n", "head_n", "block_n", F.coalesce(F.sum(size).over(within), F.lit(0)).alias("inner"))
          .join(before, ["file", "split"])
          .select("file", "split", "nr", (F.col("before") + F.col("inner") - len(MAGIC)).alias("at"), "head_n", "block_n")
          .withColumn("next", F.col("at") + len(MAGIC) + F.col("head_n") + F.col("block_n") + 4)
          .select("file", "split", "nr", "at", "next"))
    at = materialise(at.filter("at >= 0"), "warc-candidates")
    real = materialise(chain(at.select("file", "split", "at", "next")).select("file", "at"), "warc-records")

    key = ["file", "split", "nr"]
    facts = ["payload_bytes", "payload_digest"] + (["payload"] if with_payload else [])
    cols = ["file", "at", "next", "warc_type", "record_id", "refers", "url", "stated_digest", *facts]
    placed = at.join(real.withColumn("real", F.lit(True)), ["file", "at"], "left")
    records = placed.filter("real").join(small, key).filter("next <= file_size")
    whole = records.filter("whole").select(cols)

    # records with a magic inside: their pieces are those up to the next record
    own = F.when(F.col("real"), F.col("at"))
    upto = Window.partitionBy("file", "split").orderBy("nr")
    earlier = placed.groupBy("file", "split").agg(F.max(own).alias("m")).select(
        "file", "split", F.last("m", True).over(ranges).alias("carried"))
    loose = placed.withColumn("owner", F.last(own, True).over(upto)).join(earlier, ["file", "split"]).select(
        *key, "at", F.coalesce("owner", "carried").alias("owner"))
    torn = records.filter(~F.col("whole")).select("file", F.col("at").alias("owner"), "next", "warc_type", "record_id", "refers",
                                                  "url", "stated_digest", F.col("head_n").alias("hn"), F.col("block_n").alias("bn"))
    text = _pieces(spark, path).select("file", "split", "nr", "piece")
    parts = materialise(loose.join(torn.select("file", "owner"), ["file", "owner"]), "warc-torn").join(text, key)
    joined = parts.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))),
                                                                         lambda x: x["piece"]), MAGIC).alias("record"))
    body = _payload(F.col("record"), F.col("hn"), F.col("bn"))
    mended = torn.join(joined, ["file", "owner"]).withColumnRenamed("owner", "at").select(
        *cols[:8], *_facts(body), *([body.alias("payload")] if with_payload else []))
    return whole.union(mended)


def _facts(payload: Column) -> list[Column]:
    return [F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest")]


def op4_warc(spark, sf_dir):
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    r = read_archives(spark, path, with_payload=False)
    r = materialise(r.select("warc_type", "record_id", "refers", "payload_bytes", "payload_digest"), "warc-read")
    full = r.filter("warc_type = 'response'").select(F.col("record_id").alias("name"), F.col("payload_bytes").alias("b"),
                                                     F.col("payload_digest").alias("d")).dropDuplicates(["name"])
    j = r.join(full, r["refers"] == full["name"], "left")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    again = F.col("warc_type") == "revisit"
    return j.select(F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("page_id"),
                    F.when(again, F.col("b")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                    F.when(again, F.col("d")).otherwise(F.col("payload_digest")).alias("payload_digest"),
                    F.col("warc_type").alias("record_type"),
                    F.when(again, number(F.col("refers")).cast("long")).alias("refers_to"))
