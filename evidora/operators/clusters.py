"""Clusters of chunks and entities: fit, medoids, soft memberships, refits and remaps.

The density-based fit of the original design has no counterpart here: k-means on unit vectors takes its place, with
soft memberships from a softmax of distances, and the probability floor giving noise. Interfaces are kept, clusters differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import finite
from ..functions.vectors import dot, l2_normalized, matrix, norm, units

#: Most bytes of centres that a task may be sent.
CENTRE_BYTES = 64 << 20


def min_cluster_size(n: Column, configured: int = 0) -> Column:
    """The configured size, or half the root of the number of rows, 15 at least."""
    return F.lit(configured) if configured > 0 else F.greatest(F.lit(15), F.floor(F.floor(F.sqrt(n)) / 2)).cast("int")


def _unit_sums(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (cluster_id, id, unit) and each cluster's (cluster_id, n, sum): sums are made before anything moves."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    unit = rows.filter(norm(F.col("embedding")) > 0).select("cluster_id", "id", l2_normalized(F.col("embedding")).alias("unit"))
    sums = unit.groupBy("cluster_id").agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("unit"))).alias("sum"))
    return unit, sums


def medoids(rows: DataFrame) -> DataFrame:
    """(cluster_id, id, score): the row whose cosines to its cluster's others sum highest, the smallest id on ties.

    The sum over a cluster is the row's product with the sum of all: one vector a cluster is joined back, and no row
    meets another.
    """
    unit, sums = _unit_sums(rows)
    score = unit.join(sums.drop("n"), "cluster_id").select("cluster_id", "id", dot(F.col("unit"), F.col("sum")).alias("score"))
    best = score.groupBy("cluster_id").agg(F.min(F.struct(-F.round("score", 9), "id", "score")).alias("best"))
    return best.select("cluster_id", "best.id", "best.score")


def persistence(rows: DataFrame) -> DataFrame:
    """(cluster_id, persistence) of (cluster_id, id, embedding): how far its members point the same way, 0 to 1."""
    _, sums = _unit_sums(rows)
    return sums.select("cluster_id", (norm(F.col("sum")) / F.col("n")).alias("persistence"))


def top_memberships(rows: DataFrame, top_m: int = 2, least: float = 0.15) -> DataFrame:
    """(node_id, label, probability, rank) of the best finite probabilities from ``least`` up, ties to the smaller label."""
    good = rows.filter(finite(F.col("probability")) & (F.col("probability") >= least))
    rank = F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("probability"), "label"))
    return good.withColumn("rank", rank - 1).filter(F.col("rank") < top_m)


def noise(nodes: DataFrame, memberships: DataFrame) -> DataFrame:
    return nodes.join(memberships.select(F.col("node_id").alias("id")), "id", "left_anti")


def _softmax(shared, temperature: float, least: float):
    def run(batches):
        centres, labels, projection = shared.value
        dim = projection.shape[0] if projection is not None else centres.shape[1]
        for batch in batches:
            x = units(matrix(batch.column("embedding"), dim))
            x = x @ projection if projection is not None else x
            z = 2 * x @ centres.T - (centres**2).sum(1)
            e = np.exp((z - z.max(1, keepdims=True)) / temperature)
            p = e / e.sum(1, keepdims=True)
            i, j = np.nonzero(p >= least)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i)), pa.array(labels[j]), pa.array(p[i, j])], names=["node_id", "label", "probability"])

    return run


def soft_memberships(rows: DataFrame, centres: dict[int, list], projection: list | None = None, temperature: float = 0.1, least: float = 0.0) -> DataFrame:
    """(node_id, label, probability) from ``least`` up, so at most 1 / least a row; centres are sent to the rows, and
    the bytes of them are checked."""
    spark, labels = rows.sparkSession, sorted(centres)
    if not labels:
        return spark.createDataFrame([], "node_id string, label int, probability double")
    x = np.array([centres[k] for k in labels], float)
    if x.nbytes > CENTRE_BYTES:
        raise ValueError(f"centres of {x.nbytes} bytes; at most {CENTRE_BYTES} are sent to each task")
    shared = spark.sparkContext.broadcast((x, np.array(labels, np.int32), None if projection is None else np.array(projection, float)))
    return rows.select(F.col("id").cast("string"), "embedding").mapInArrow(_softmax(shared, temperature, least), "node_id string, label int, probability double")


def fit(rows: DataFrame, settings, k: int | None = None) -> tuple[DataFrame, dict[int, list], list | None]:
    """Hard labels (id, label), centres and projection of (id, embedding) by k-means on unit vectors.

    Unit vectors of more than ``reduced_dim`` dimensions are reduced to their main directions first. Clusters below
    the least size become noise (-1).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector

    n, least, dim = rows.agg(F.count("*"), min_cluster_size(F.count("*"), settings.min_cluster_size), F.max(F.size("embedding"))).first()
    k = k or max(2, min(1000, n // max(1, 2 * least)))
    data = rows.select("id", "embedding", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("raw"))
    data, projection = Normalizer(inputCol="raw", outputCol="features").transform(data), None
    if n and 0 < settings.reduced_dim < dim:
        pca = PCA(k=settings.reduced_dim, inputCol="features", outputCol="reduced").fit(data)
        projection = pca.pc.toArray().tolist()
        data = pca.transform(data).drop("features").withColumnRenamed("reduced", "features")
    model = KMeans(k=k, seed=settings.random_state, maxIter=20).fit(data.select("features"))
    labelled = model.transform(data).select("id", F.col("prediction").alias("label"), "embedding")
    sizes = labelled.groupBy("label").count().filter(F.col("count") >= least)
    kept = sorted(r["label"] for r in sizes.collect())
    centres = {i: model.clusterCenters()[v].tolist() for i, v in enumerate(kept)}
    renamed = F.create_map(*[x for i, v in enumerate(kept) for x in (F.lit(v), F.lit(i))]) if kept else F.create_map(F.lit(-9), F.lit(-1))
    return labelled.select("id", F.coalesce(renamed[F.col("label")], F.lit(-1)).alias("label"), "embedding"), centres, projection


def jaccard(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, label, jaccard) of the pairs of groups (old_id, node), (label, node) that share a member."""
    shared = old.join(new, "node").groupBy("old_id", "label").agg(F.count("*").alias("both"))
    sizes = shared.join(old.groupBy("old_id").agg(F.count("*").alias("n_old")), "old_id").join(new.groupBy("label").agg(F.count("*").alias("n_new")), "label")
    return sizes.select("old_id", "label", (F.col("both") / (F.col("n_old") + F.col("n_new") - F.col("both"))).alias("jaccard"))


def jaccard_of(a: set, b: set) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def remap(pairs: list[tuple[str, int, float, float]], old: list[str], labels: list[int], jaccard_least: float = 0.30, cosine_least: float = 0.85) -> tuple[dict[int, str], list[int], list[str]]:
    """Old id of each matched new label, labels that need an id, and old ids to deprecate.

    Pairs (old id, label, jaccard, cosine) that reach either limit match greedily, one to one, by jaccard, cosine,
    old id and label. ``remap_pairs`` gives those that do, as few as clusters that share members or lie side by side.
    """
    good = [p for p in pairs if p[2] >= jaccard_least or p[3] >= cosine_least]
    taken: dict[int, str] = {}
    used: set[str] = set()
    for ident, label, _, _ in sorted(good, key=lambda p: (-p[2], -p[3], p[0], p[1])):
        if ident not in used and label not in taken:
            taken[label] = ident
            used.add(ident)
    return taken, [x for x in labels if x not in taken], [x for x in old if x not in used]


def remap_pairs(shared: DataFrame, near: DataFrame, jaccard_least: float = 0.30, cosine_least: float = 0.85) -> DataFrame:
    """(old_id, label, jaccard, cosine) of the pairs that may match, from (old_id, label, jaccard) of those that share a
    member and (old_id, label, cosine) of those whose medoids lie near."""
    both = shared.join(near, ["old_id", "label"], "full").na.fill(0.0, ["jaccard", "cosine"])
    return both.filter((F.col("jaccard") >= jaccard_least) | (F.col("cosine") >= cosine_least)).select("old_id", "label", "jaccard", "cosine")


def refit_decision(status: DataFrame, member_of: DataFrame, fitted: int, growth: float = 1.3, noise_limit: float = 0.20, sample: int = 1000) -> DataFrame:
    """One row (current, noise_ratio, decision): growth beyond the fitted size wins, then noise among the last
    ``sample`` clustered ids by id; both limits are strict."""
    clustered = status.filter("stage = 'CLUSTERED'")
    last = clustered.orderBy(F.desc("chunk_id")).limit(sample)
    placed = member_of.select(F.col("node_id").alias("chunk_id")).distinct().withColumn("placed", F.lit(True))
    ratio = last.join(placed, "chunk_id", "left").agg(F.avg(F.when(F.col("placed").isNull(), 1.0).otherwise(0.0)).alias("noise_ratio"))
    current = status.filter("stage in ('EMBEDDED', 'EXTRACTED', 'CLUSTERED')").agg(F.count("*").alias("current"))
    both = current.withColumn("one", F.lit(1)).join(ratio.withColumn("one", F.lit(1)), "one").drop("one")
    decision = F.when(F.col("current") > fitted * growth, "growth").when(F.col("noise_ratio") > noise_limit, "noise").otherwise("none")
    return both.withColumn("decision", decision)
