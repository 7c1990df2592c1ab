"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import copied, hash60, numbered, row_of, table, written

BITS = 60
LIMIT = 1 << 20
#: Bits looked at beyond those that an even spread would need, and bits added for buckets that still are too large.
SPARE, STEP = 3, 12


def shards(rows: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Assign rows (``h``: 60-bit hash, ``n_bytes``, and ``count`` of equal rows) to shards of at most ``limit`` bytes.

    Returns (rows with depth, prefix, part; directory with depth, prefix, part, shard_bytes). A bucket that holds more
    than ``limit`` bytes splits on the next bit of the hash, others stay; so a row's depth is the least at which its
    prefix fits. Sums are made for all depths at once from a histogram of ``depth`` + SPARE bits, whose rows grow with
    the number of shards. Only rows of buckets too large even at that depth are looked at again, by more bits. Rows
    that agree in all 60 bits (copies of one row) are numbered and cut into parts; a single row above the limit has a
    part of its own.
    """
    rows = written(rows, "rows")
    total = rows.agg(F.sum(F.col("n_bytes") * F.col("count"))).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(2, total / limit))) + SPARE))
    low, left, done = 0, rows, []
    while True:
        cell = F.shiftright("h", BITS - depth).alias("cell")
        fine = left.groupBy(cell).agg(F.sum(F.col("n_bytes") * F.col("count")).alias("b"))
        up = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(depth))))
        up = up.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        fits = up.groupBy("depth", "prefix").agg(F.sum("b").alias("b")).filter(F.col("b") <= limit).select("depth", "prefix")
        at = up.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        found = written(left.withColumn("cell", F.shiftright("h", BITS - depth)).join(at, "cell", "left").drop("cell"), "sharded")
        done.append(found.filter("depth is not null"))
        left = found.filter("depth is null").drop("depth")
        if depth == BITS or left.limit(1).count() == 0:
            break
        low, depth = depth + 1, min(BITS, depth + STEP)
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))).cast("long")
    parts = left.withColumn("depth", F.lit(BITS)).withColumn("each", each)
    parts = parts.withColumn("part", F.explode(F.expr("sequence(0L, cast((count - 1) div each as long))")))
    parts = parts.withColumn("count", F.expr("least(each, count - part * each)")).drop("each")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    whole = whole.withColumn("part", F.lit(0).cast("long")).unionByName(parts)
    whole = written(whole.withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)")), "placed")
    directory = whole.groupBy("depth", "prefix", "part").agg(F.sum(F.col("n_bytes") * F.col("count")).alias("shard_bytes"))
    return whole, directory


def shard_label(depth: Column, prefix: Column) -> Column:
    """The prefix's bits, as many as its depth."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, part, shard_bytes) for each document.

    The hash is of the document's id and text, so rows without an id spread too and no source or group of copies
    with ids of their own meets in one shard. Null texts have 0 bytes. Rows equal in id and text are interchangeable:
    they are counted before they move, placed as a group and dealt out again. A text of any length is one row, in a
    part of its own above the limit; other columns are not looked at. No rows: no shards.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", hash60(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("h"), size.alias("n_bytes"))
    rows = rows.groupBy("doc_id", "h", "n_bytes").agg(F.count("*").alias("count"))
    placed, directory = shards(rows, limit)
    placed = placed.join(directory, ["depth", "prefix", "part"])
    label = shard_label(F.col("depth"), F.col("prefix")).alias("shard")
    return copied(placed.select("doc_id", "n_bytes", label, "depth", "part", "shard_bytes", "count"), "count")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write whole documents, with all their columns, into one folder per shard (shard=b<bits>/part=<n>).

    Where copies of one row are cut into parts, they are numbered in an order that is written down first, and each
    part takes as many as fit, so a task run again neither loses nor doubles rows.
    """
    h = hash60(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("h")
    rows = docs.select(h, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    placed, _ = shards(rows.groupBy("h", "n_bytes").agg(F.count("*").alias("count")), limit)
    shard = F.concat(F.lit("b"), shard_label(F.col("depth"), F.col("prefix"))).alias("shard")
    placed = written(placed.groupBy("h", shard).agg(F.max("part").alias("last"), F.max("count").alias("each")), "parts")
    keyed = docs.select(h, row_of(docs))
    out = keyed.join(placed.filter("last = 0"), "h").withColumn("part", F.lit(0).cast("long"))
    if placed.filter("last > 0").limit(1).count():
        cut = numbered(keyed.join(placed.filter("last > 0"), "h"), "h", "n")
        out = out.unionByName(cut.withColumn("part", F.expr("n div each")).drop("n"))
    out = out.repartition("shard", "part")
    inner = [c for c in docs.columns if c not in ("shard", "part")]
    out.select(*[F.col(f"row.`{c}`").alias(c) for c in inner], "shard", "part").write.mode("overwrite").partitionBy("shard", "part").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard of at most 1 MiB of text."""
    return shard_documents(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
f AS (SELECT d::INT AS depth, h >> (60 - d) AS prefix, sum(n_bytes)::BIGINT AS b FROM r, range(0, 61) t(d) GROUP BY ALL),
a AS (
  SELECT r.doc_id, r.n_bytes, f.depth, f.prefix, f.b, row_number() OVER (PARTITION BY r.doc_id, r.h ORDER BY f.depth) AS k
  FROM r JOIN f ON r.h >> (60 - f.depth) = f.prefix WHERE f.b <= 1048576)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
       0::BIGINT AS part, b AS shard_bytes
FROM a WHERE k = 1
"""
