"""Scores within a query: ranks, fusions, normal forms and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ranked(rows: DataFrame, score: str, ident: str = "id", by: tuple = ("query_id",), out: str = "rank") -> DataFrame:
    """Number rows from 1 by score, ties by id."""
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.asc(ident))))


def top(rows: DataFrame, k: int | Column, score: str, ident: str = "id", by: tuple = ("query_id",)) -> DataFrame:
    return ranked(rows, score, ident, by, "_rank").filter(F.col("_rank") <= k).drop("_rank")


def rrf(lists: DataFrame, k: int = 60, ident: str = "id") -> DataFrame:
    """Fuse ranked lists (query_id, id, rank): sums of 1 / (k + rank)."""
    return lists.groupBy("query_id", ident).agg(F.sum(1.0 / (F.lit(float(max(0, k))) + F.col("rank"))).alias("score"))


def linear_normalized(rows: DataFrame, score: str, out: str, by: tuple = ("query_id",)) -> DataFrame:
    """Shares of the positive finite scores; equal shares where there are none."""
    w = W.partitionBy(*by)
    clean = F.when(finite(F.col(score)) & (F.col(score) > 0), F.col(score)).otherwise(F.lit(0.0))
    total, n = F.sum(clean).over(w), F.count("*").over(w)
    return rows.withColumn(out, F.when(total > 0, clean / total).otherwise(1.0 / n))


def softmax(rows: DataFrame, score: str, out: str, temperature: float, by: tuple = ("query_id",)) -> DataFrame:
    if temperature <= 0:
        return linear_normalized(rows, score, out, by)
    w = W.partitionBy(*by)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return rows.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def minmax(rows: DataFrame, column: str, out: str, by: tuple = ("query_id",)) -> DataFrame:
    """0 to 1 within a query; 0.5 where all are alike."""
    w = W.partitionBy(*by)
    low, span = F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w)
    return rows.withColumn(out, F.when(span <= 1e-12, F.lit(0.5)).otherwise((F.col(column) - low) / span))


def normalized_entropy(rows: DataFrame, p: str = "p", by: tuple = ("query_id",)) -> DataFrame:
    """(query_id, globality): entropy of the positive finite shares over that of an even spread."""
    good = rows.filter(finite(F.col(p)) & (F.col(p) > 0))
    total = F.sum(p).over(W.partitionBy(*by))
    good = good.withColumn("_q", F.col(p) / total).groupBy(*by).agg((-F.sum(F.col("_q") * F.ln("_q"))).alias("h"), F.count("*").alias("k"))
    return good.select(*by, F.when(F.col("k") <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h") / F.ln("k")))).alias("globality"))


def routing(g: Column, local: float = 0.35, global_: float = 0.65, depth_max: int = 3, beam_min: int = 4, beam_max: int = 16) -> tuple[Column, Column, Column]:
    """Regime, depth and beam of a globality; what isn't finite counts as 0, both limits are mixed."""
    g = F.when(finite(g), F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))).otherwise(F.lit(0.0))
    regime = F.when(g < local, F.lit("local")).when(g > global_, F.lit("global")).otherwise(F.lit("mixed"))
    depth = F.greatest(F.lit(1), F.least(F.lit(depth_max), F.ceil(g * depth_max))).cast("int")
    return regime, depth, (beam_min + F.floor(g * (beam_max - beam_min))).cast("int")
