"""Scoring candidates and packing them into a token budget with numbered citations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import minmax, ranked


def scored(candidates: DataFrame, floor: float = 0.48) -> DataFrame:
    """(.., cos_n, mass_n, score) of candidates (query_id, id, cos, mass, linked) at or above the cosine floor.

    Scales are those of the candidates that pass, 0.5 for one alone.
    """
    rows = candidates.filter(F.col("cos") >= floor)
    rows = minmax(minmax(rows, "cos", "cos_n"), "mass", "mass_n")
    return rows.withColumn("score", 0.5 * F.col("cos_n") + 0.4 * F.col("mass_n") + F.when(F.col("linked"), 0.1).otherwise(0.0))


def elbow(rows: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Rows down to ``ratio`` of the query's best score; 0 or less keeps all."""
    if ratio <= 0:
        return rows
    return rows.withColumn("_best", F.max("score").over(W.partitionBy("query_id"))).filter(F.col("score") >= ratio * F.col("_best")).drop("_best")


def pick(rows: pd.DataFrame, budget: int, reject: float) -> np.ndarray:
    """Places of the rows taken, in the order of score and id: what doesn't fit, has no tokens, or is nearer than
    ``reject`` to one taken is skipped."""
    order = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable").index
    taken: list = []
    vectors: list[np.ndarray] = []
    used = 0
    for i in order:
        n = rows.at[i, "token_count"]
        if pd.isna(n) or n <= 0 or used + n > budget:
            continue
        raw = rows.at[i, "embedding"]
        v = np.asarray(raw if raw is not None else [], float)
        length = np.sqrt(v @ v)
        v = v / length if length > 0 else v
        if any(len(v) == len(u) and float(u @ v) > reject for u in vectors):
            continue
        taken.append(i)
        vectors.append(v)
        used += int(n)
    return np.array(taken, dtype=int)


def knapsack(rows: DataFrame, budget: int = 3000, reject: float = 0.95) -> DataFrame:
    """(query_id, id, score, token_count, citation) of what is packed; each query's candidates are bounded."""

    def one(key, group: pd.DataFrame) -> pd.DataFrame:
        out = group.loc[pick(group, budget, reject), ["query_id", "id", "score", "token_count"]].copy()
        out["citation"] = np.arange(1, len(out) + 1)
        return out

    cols = rows.select("query_id", "id", "score", F.col("token_count").cast("int"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return cols.groupBy("query_id").applyInPandas(one, "query_id string, id string, score double, token_count int, citation int")


def cited(rows: DataFrame) -> DataFrame:
    return ranked(rows, "score", out="citation")


def source_header(citation: Column, doc_id: Column, page_start: Column, page_end: Column, start: Column, end: Column) -> Column:
    pages = F.when(page_start.isNull(), F.lit("?")).otherwise(F.concat_ws("-", page_start.cast("string"), F.coalesce(page_end, page_start).cast("string")))
    return F.format_string("[%d] (doc_id=%s, pages=%s, offsets=%d-%d)", citation, F.coalesce(doc_id, F.lit("unknown")), pages, start, end)
