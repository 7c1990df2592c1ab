"""Retrieval evaluation: per-question measures, grouped means, sweeps and checks of the gold set."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = ("precision_at_5", "recall_at_10", "hit_at_5", "retrieved_count", "relevant_count", "packed_tokens", "latency_ms", "evidence_found")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions from JSON lines; blank lines are skipped, an empty file is an error."""
    schema = "id string, type string, question string, reference_answer string, relevant_chunk_ids array<string>, doc_id string, tags array<string>, pair_of string, notes string"
    rows = spark.read.schema(schema).json(path).filter("id is not null")
    if rows.limit(1).count() == 0:
        raise ValueError(f"no questions in {path}")
    return rows


def query_metrics(hits: DataFrame, relevant: DataFrame, questions: DataFrame) -> DataFrame:
    """Measures of each question (query_id, type) from hits (query_id, id, rank) and relevant (query_id, id).

    P@5 is over what the top 5 holds. A negative question scores 1 when nothing was retrieved, else 0.
    """
    marked = hits.join(relevant.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    in5, in10, hit = F.col("rank") <= 5, F.col("rank") <= 10, F.coalesce("hit", F.lit(0))
    sums = marked.groupBy("query_id").agg(
        F.count("*").alias("retrieved_count"),
        F.sum(F.when(in5, 1).otherwise(0)).alias("top5"), F.sum(F.when(in5, hit).otherwise(0)).alias("hits5"),
        F.sum(F.when(in10, 1).otherwise(0)).alias("top10"), F.sum(F.when(in10, hit).otherwise(0)).alias("hits10"),
    )
    rows = questions.join(sums, "query_id", "left").join(relevant.groupBy("query_id").agg(F.count("*").alias("relevant_count")), "query_id", "left").na.fill(0)
    negative, none = F.col("type") == "negative", F.when(F.col("retrieved_count") == 0, 1.0).otherwise(0.0)
    return rows.select(
        "query_id", "type",
        F.when(negative, none).otherwise(F.col("hits5") / F.greatest("top5", F.lit(1))).alias("precision_at_5"),
        F.when(negative, none).otherwise(F.coalesce(F.try_divide("hits10", "relevant_count"), F.lit(0.0))).alias("recall_at_10"),
        F.when(negative, none).otherwise(F.when(F.col("hits5") > 0, 1.0).otherwise(0.0)).alias("hit_at_5"),
        "retrieved_count", "relevant_count", "top10", "hits10",
    )


def grouped_means(metrics: DataFrame, measures: tuple = ("precision_at_5", "recall_at_10", "hit_at_5")) -> DataFrame:
    """Means over all and by type; ``type`` is null for all."""
    return metrics.groupingSets([[], ["type"]], "type").agg(F.count("*").alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in measures])


def type_counts(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("type").agg(F.count("*").alias("n"))


def paraphrase_delta(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row (n, delta_p5, delta_r10): exact questions less their paraphrases (query_id, pair_of)."""
    a = metrics.select(F.col("query_id").alias("pair_of"), F.col("precision_at_5").alias("p"), F.col("recall_at_10").alias("r"))
    rows = metrics.join(pairs.filter("pair_of is not null"), "query_id").join(a, "pair_of")
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("p") - F.col("precision_at_5")).alias("delta_p5"), F.avg(F.col("r") - F.col("recall_at_10")).alias("delta_r10"))


def noise_at_10(metrics: DataFrame) -> DataFrame:
    """Mean share of irrelevant hits in the top 10, without negatives and questions without hits."""
    rows = metrics.filter("type <> 'negative' and top10 > 0")
    return rows.agg(F.avg(1 - F.col("hits10") / F.col("top10")).alias("noise_at_10"))


def percentiles(rows: DataFrame, column: str, by: list[str], points: tuple = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact, interpolated percentiles, with n, mean, min and max."""
    each = [F.percentile(column, p).alias(f"p{round(100 * p)}") for p in points]
    return rows.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"), *each)


def utility(means: DataFrame, noise: float, paraphrase_weight: float = 0.0) -> DataFrame:
    """One row ``utility`` from grouped means: precision and recall of exact questions weigh most, and recall below
    0.70 costs double."""
    def of(kind: str, m: str):
        match = F.col("type").isNull() if kind == "all" else F.col("type") == kind
        return F.coalesce(F.max(F.when(match, F.col(m))), F.lit(0.0))

    value = 1.2 * of("exact", "precision_at_5") + 0.8 * of("exact", "recall_at_10") + of("negative", "precision_at_5") + 0.8 * of("all", "precision_at_5")
    value = value - 0.6 * F.lit(noise) - 2 * F.greatest(F.lit(0.0), 0.70 - of("exact", "recall_at_10")) + paraphrase_weight * of("paraphrase", "recall_at_10")
    return means.agg(value.alias("utility"))


def grid(**choices) -> list[dict]:
    return [dict(zip(choices, v, strict=True)) for v in itertools.product(*choices.values())]


def sweep(points: list[dict], evaluate, confirm=None) -> dict:
    """Evaluate each point of a grid (the callable runs one batch job for all questions); the best one, by utility and
    then order, is confirmed on all questions."""
    rows = [(evaluate(p), -i, p) for i, p in enumerate(points)]
    best = max(rows, key=lambda r: r[:2])
    return {"rows": [{"utility": u, **p} for u, _, p in sorted(rows, key=lambda r: (-r[0], -r[1]))], "best": best[2], "utility": best[0], "confirmed": confirm(best[2]) if confirm else None}


def gold_problems(questions: DataFrame, chunk_ids: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(problem, id) of a gold set: repeated ids, wrong counts, negatives with chunks, multis with fewer than two,
    unknown chunks and paraphrases whose chunks differ from their twins'."""
    q = questions.withColumn("n", F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))))
    found = q.groupBy("id").count().filter("count > 1").select(F.lit("repeated id").alias("problem"), "id")
    for kind, n in counts.items():
        found = found.union(q.agg(F.count_if(F.col("type") == kind).alias("n")).filter(F.col("n") != n).select(F.lit("count of type"), F.lit(kind)))
    found = found.union(q.filter("type = 'negative' and n > 0").select(F.lit("negative with chunks"), "id"))
    found = found.union(q.filter("type = 'multi' and n < 2").select(F.lit("multi with fewer than two"), "id"))
    used = q.select("id", F.explode_outer("relevant_chunk_ids").alias("chunk")).filter("chunk is not null")
    found = found.union(used.join(chunk_ids.select(F.col("id").alias("chunk")), "chunk", "left_anti").select(F.lit("unknown chunk"), "id"))
    twin = q.select(F.col("id").alias("pair_of"), F.sort_array("relevant_chunk_ids").alias("theirs"))
    odd = q.filter("pair_of is not null").join(twin, "pair_of", "left").filter(~F.sort_array("relevant_chunk_ids").eqNullSafe(F.col("theirs")))
    return found.union(odd.select(F.lit("twin differs"), "id"))
