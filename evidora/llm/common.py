"""Shared pieces: shared-folder tables, running sums that survive hot keys, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4096
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, gets a
    temporary one where that is unset; on a cluster it must be set, since machines don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Send Python 8 MB at a time, where the session doesn't say otherwise: texts may be long, and an executor's
    workers share what its heap leaves."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8m")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs no rework."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete the tables that ``written`` has made, once what was read from them is done with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(*parts: Column) -> Column:
    """60 uniform bits of the parts (nulls count as empty); the same digits come from md5 in any SQL engine."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def row_of(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that a helper column's name can't clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def source_key(source: Column) -> Column:
    """A never-null form of a source, so that null sources join and group like any other."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys``, in the order of ``bucket`` and then ``order``.

    ``bucket`` must be monotone in the order. Rows are summed inside a bucket and buckets are then summed among
    themselves, so a key with a third of all rows is spread over as many tasks as it has buckets.
    """
    before = W.unboundedPreceding
    zero = F.lit(0).cast("long")
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(before, -1)), zero))
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_b", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(before, -1)), zero)).drop("_s")
    return inner.join(sums, [*keys, bucket]).withColumn(out, F.col("_in") + F.col("_b")).drop("_in", "_b")


def running_total(df: DataFrame, key: str, order: list, value: str, out: str, span: int = 2048) -> DataFrame:
    """Exclusive running sum over the whole table in the order of the integer ``key`` and then ``order``.

    Three levels: rows within a key, keys within a span of keys, spans. Only the last meets in one task, and has
    one row for ``span`` keys.
    """
    before = W.unboundedPreceding
    zero = F.lit(0).cast("long")
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(before, -1)), zero))
    keys = df.groupBy(key).agg(F.sum(value).alias("_s")).withColumn("_span", F.floor(F.col(key) / span))
    spans = keys.groupBy("_span").agg(F.sum("_s").alias("_t"))
    spans = spans.withColumn("_c", F.coalesce(F.sum("_t").over(W.orderBy("_span").rowsBetween(before, -1)), zero)).drop("_t")
    keys = keys.withColumn("_b", F.coalesce(F.sum("_s").over(W.partitionBy("_span").orderBy(key).rowsBetween(before, -1)), zero))
    keys = keys.join(spans, "_span").select(key, (F.col("_b") + F.col("_c")).alias("_b"))
    return inner.join(keys, key).withColumn(out, F.col("_in") + F.col("_b")).drop("_in", "_b")


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Number rows from 0 within ``key`` in some order that is fixed by writing it down: a task run again gives the
    same. A key's rows are numbered in spans, so that a hot one is no single task."""
    rows = written(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"_span": F.shiftright("_place", 12), "_one": F.lit(1).cast("long")})
    return running_sum(rows, [key], "_span", ["_place"], "_one", out).drop("_place", "_span", "_one")


def copied(df: DataFrame, count: str) -> DataFrame:
    """Each row ``count`` times; many copies of one row are made in several tasks."""
    few, many = df.filter(F.col(count) <= ROWS_PER_BUCKET), df.filter(F.col(count) > ROWS_PER_BUCKET)
    spans = many.withColumn("_at", F.explode(F.expr(f"sequence(0L, cast(({count} - 1) div {ROWS_PER_BUCKET} as long))")))
    spans = spans.withColumn(count, F.expr(f"least({ROWS_PER_BUCKET}L, {count} - _at * {ROWS_PER_BUCKET})")).repartition(shuffle_parts(df.sparkSession), "_at").drop("_at")
    both = few.unionByName(spans)
    return both.withColumn("_copy", F.explode(F.expr(f"sequence(1L, cast({count} as long))"))).drop("_copy", count)


def whole_groups(batches, key: str):
    """Regroup sorted batches so that none ends inside a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut == 0 and held and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        if cut or held:
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if whole.num_rows:
                yield whole.combine_chunks().to_batches()[0]
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and, for each, the smallest node it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _local_forest(batches):
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(a):
            nodes, low = roots(a, b)
            at = nodes != low
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(low[at])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b) as (node, component): the smallest node reachable.

    Links are first contracted batch by batch into stars. Then each round every node takes the smallest label
    beside it and jumps to its label's label; no node's neighbours are ever gathered in one place. Rounds grow with
    the logarithm of the longest chain of stars.
    """
    spark = edges.sparkSession
    links = written(edges.filter("a <> b").mapInArrow(_local_forest, "a long, b long").distinct(), "links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node")
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
