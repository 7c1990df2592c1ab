"""Evaluate an engine on gold questions, dump seed similarities, and tune settings."""

from __future__ import annotations

import json
import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import search
from ..sources import documents


def evaluated(engine, gold: DataFrame) -> tuple[DataFrame, float]:
    """Per-question measures, and seconds a question; all are answered in one batch."""
    start = time.perf_counter()
    sources, trace = engine.retrieve(gold.select(F.col("id").alias("query_id"), "question"))
    n = max(1, trace.count())
    each = (time.perf_counter() - start) / n
    hits = sources.select("query_id", "id", F.col("citation").alias("rank"))
    relevant = gold.select(F.col("id").alias("query_id"), F.explode("relevant_chunk_ids").alias("id"))
    metrics = ev.query_metrics(hits, relevant, gold.select(F.col("id").alias("query_id"), "type"))
    more = trace.select("query_id", "packed_tokens", "evidence_found", "regime", F.col("sources").alias("n_sources"))
    rows = metrics.join(more, "query_id", "left").withColumn("latency_ms", F.lit(1000 * each))
    return rows.na.fill(0, ["packed_tokens", "n_sources"]).withColumn("evidence_found", F.coalesce("evidence_found", F.lit(False))), each


MEASURES = ("precision_at_5", "recall_at_10", "hit_at_5", "packed_tokens", "n_sources", "latency_ms", "evidence_found")


def report(engine, gold: DataFrame) -> dict:
    """Means over all and by type, paraphrase deltas, noise and counts, as one document of plain values."""
    rows, _ = evaluated(engine, gold)
    rows = engine._save(rows.withColumn("evidence_found", F.col("evidence_found").cast("int")), "metrics")
    means = {r["type"] or "all": {m: r[m] for m in ("n", *MEASURES)} for r in ev.grouped_means(rows, MEASURES).collect()}
    pairs = gold.select(F.col("id").alias("query_id"), "pair_of")
    delta, noise = ev.paraphrase_delta(rows, pairs).first(), ev.noise_at_10(rows).first()[0]
    return {"means": means, "paraphrase_delta": delta.asDict(), "noise_at_10": noise, "types": {r["type"]: r["n"] for r in ev.type_counts(rows).collect()}}


def seed_similarities(engine, gold: DataFrame, chunks: int = 8, entities: int = 4) -> DataFrame:
    """Percentiles of the similarities of the nearest chunks and entities, by question type."""
    asked = documents.embedded(gold.select(F.col("id").alias("query_id"), "type", F.col("question").alias("text")), engine.embed, engine.settings.embedding_dim)
    asked = engine._save(asked.drop("text"), "asked")
    found = search.vector_topk(engine._t("text_chunk"), asked, chunks).withColumn("label", F.lit("TextChunk"))
    found = found.unionByName(search.vector_topk(engine._t("entity"), asked, entities).withColumn("label", F.lit("Entity")))
    return ev.percentiles(found.join(asked.select("query_id", "type"), "query_id"), "similarity", ["type", "label"])


def tuned(engine, gold: DataFrame, types: tuple[str, ...] = ("exact", "negative"), paraphrase_weight: float = 0.0, **choices) -> dict:
    """Sweep a grid of settings on some types of questions; the best is confirmed on all."""
    part = gold.filter(F.col("type").isin(*types))

    def score(point: dict, rows: DataFrame) -> float:
        e = replace(engine, settings=replace(engine.settings, **point))
        metrics = e._save(evaluated(e, rows)[0], "sweep")
        noise = ev.noise_at_10(metrics).first()[0] or 0.0
        return ev.utility(ev.grouped_means(metrics), noise, paraphrase_weight).first()["utility"]

    return ev.sweep(ev.grid(**choices), lambda p: score(p, part), lambda p: score(p, gold))


def write_report(path: str, value: dict) -> None:
    with open(path, "w") as f:
        json.dump(value, f, indent=1, sort_keys=True, default=str)
