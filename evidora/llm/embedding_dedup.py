"""Embedding near-dedup by collision-counting projections.

Vectors are projected on many random lines. A window on one line holds a constant share of all vectors however near
its centre, so scanning whole lines would compare a constant share of all pairs. So the lines are sorted in pieces: in
each of several tables, a randomly shifted grid on a few lines cuts the vectors into cells, and within its cell a
further line is sorted and scanned, each vector meeting those in the window centred on its own projection. Of two that
meet, the collisions are counted on 64 more lines: how often one's projection lies in the window centred on the
other's. Pairs that reach a count calibrated for recall at the limit are verified, as everything they connect, by their
cosines in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import STEP, binary_rows, fixed_binary, lean, mix, step
from .common import table, written
from .near_links import GROWTH, LINK, candidate_links, clusters, exact_links, in_blocks
from .ngram_join import resolved

COSINE, RECALL = 0.95, 0.985
#: Window of a grid's line, in standard deviations of a unit vector's projection; rows that may meet by chance.
WINDOW, CROWD = 1.25, 8
#: Half-width of the window centred on a vector's projection on the sorted line: 95 % of the pairs at the limit lie in
#: it, and a third of all others. Rows of a cell that is scanned without being split.
CENTRED, SCANNED = 0.62, 48
#: Lines on which collisions are counted; projections are kept in steps of 1/16.
LINES, GRAIN = 64, 16
#: Half-widths in steps and counts: pairs at the limit; pairs at cosine 0.88, which is as far as a neighbour of a
#: vector that the leader stands for can be; vectors that it stands for (cosine about 0.985).
NEAR, LINKED, COVERED = (10, 55), (12, 49), (3, 52)
SPLITS, SPLIT_LINES = 6, 4


def usable(vector: str = "embedding"):
    """Neither null nor empty nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def together(distance: float, window: float = WINDOW) -> float:
    """Chance that two projections which differ by a normal deviate of this size share a window of a shifted grid."""
    a = window / distance
    return math.erf(a / math.sqrt(2)) - math.sqrt(2 / math.pi) / a * (1 - math.exp(-a * a / 2))


def within(distance: float, half: float = CENTRED) -> float:
    """Chance that two projections which differ by a normal deviate of this size lie within a centred window."""
    return math.erf(half / distance / math.sqrt(2))


def stay_together(cosine: float = COSINE) -> float:
    """Chance that a pair at the limit shares one or more of a round's splits."""
    return 1 - (1 - together(math.sqrt(2 * (1 - cosine))) ** SPLIT_LINES) ** SPLITS


def split_rounds(n: int) -> int:
    """Rounds in which a cell of n rows would be split, at most."""
    rounds = 0
    while n > SCANNED * GROWTH**rounds:
        rounds += 1
    return rounds


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Lines of a table's grid, so that few vectors meet by chance among n, and tables, so that pairs at the limit meet,
    even in a cell of all n that splits round by round."""
    apart = math.sqrt(2 * (1 - cosine))
    lines = max(2, math.ceil(math.log(max(2, n / CROWD) * within(math.sqrt(2))) / -math.log(together(math.sqrt(2)))))
    met = together(apart) ** lines * within(apart) * stay_together(cosine) ** split_rounds(n)
    return lines, math.ceil(math.log(1 - recall) / math.log(1 - met))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    scale = np.abs(x).max(1, keepdims=True) if x.size else 1.0
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _tables(dim: int, lines: int, n_tables: int):
    def run(batches):
        rng = np.random.Generator(np.random.PCG64(303))
        count = rng.standard_normal((dim, LINES))
        rows = [(rng.standard_normal((dim, lines)), rng.uniform(0, WINDOW, lines), rng.integers(1, 2**63, lines, dtype=np.uint64)) for _ in range(n_tables)]
        sorted_ = rng.standard_normal((dim, n_tables))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column("embedding"))
            sketch = np.clip(np.rint(x @ count * GRAIN), -127, 127).astype(np.int8)
            out = np.zeros((len(x), n_tables), np.int64)
            for t, (line, shift, code) in enumerate(rows):
                cell = np.floor((x @ line + shift) / WINDOW).astype(np.int64).view(np.uint64)
                out[:, t] = mix((mix(cell + np.uint64(7)) * (code | np.uint64(1))).sum(1, dtype=np.uint64) + step(t + 1)).view(np.int64)
            again = np.repeat(np.arange(len(x)), n_tables)
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel()), batch.column("node").take(pa.array(again)), binary_rows(sketch[again]), pa.array((x @ sorted_).ravel())], names=["path", "node", "sketch", "at"])

    return run


def collisions(window: tuple[int, int]):
    half, least = window

    def hit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = np.abs(a.view(np.int8).astype(np.int16) - b.view(np.int8).astype(np.int16))
        return (apart <= half).sum(1) >= least

    return hit


def split(paths: np.ndarray, sketch: np.ndarray, depth: int) -> np.ndarray:
    """Paths of each row by the windows of SPLIT_LINES more lines, in SPLITS ways."""
    out = np.zeros((len(paths), SPLITS), np.int64)
    q, row, wide = sketch.view(np.int8).astype(np.int64), np.arange(len(paths)), round(WINDOW * GRAIN)
    for j in range(SPLITS):
        seed = mix(paths.view(np.uint64) + step(depth * SPLITS + j + 1))
        value = seed.copy()
        for i in range(SPLIT_LINES):
            pick = mix(seed + step(i + 1))
            cell = (q[row, (pick % np.uint64(LINES)).astype(np.int64)] + (pick >> np.uint64(40)).astype(np.int64) % wide + 1024) // wide
            value = mix(value + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))
        out[:, j] = value.view(np.int64)
    return out


def cosine_pairs(column: pa.Array, sides: np.ndarray | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    x = unit_rows(column)
    a = np.arange(len(x)) if sides is None else np.flatnonzero(sides == 0)
    b = a if sides is None else np.flatnonzero(sides == 1)
    enough = x[a] @ x[b].T >= cosine
    if sides is None:
        enough &= a[:, None] < b[None, :]
    i, j = np.nonzero(enough)
    return a[i], b[j]


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding).

    Equal vectors take part once, with their number, and link with each other. Vectors that can't be used link with
    nothing; those of each length, however few, are compared among themselves. Repeated rows are vectors like others;
    null ids come last. An empty table gives an empty result; other columns are not looked at.
    """
    rows = vectors.select("vec_id", "embedding")
    node = F.when(usable(), F.xxhash64(F.transform("embedding", lambda x: x.cast("double") + 0.0)))
    keyed = rows.select("vec_id", node.alias("node"), "embedding")
    classes = keyed.filter("node is not null").groupBy("node").agg(
        F.struct(F.min(F.coalesce("vec_id", F.lit(2**63 - 1))).alias("id"), F.lit(0).cast("long").alias("tk")).alias("low"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")
    )
    classes = written(classes, "vectors")
    links = vectors.sparkSession.createDataFrame([], LINK)
    for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():  # as few as there are models
        lines, n_tables = tables_for(r["n"])
        own = classes.filter(F.size("embedding") == r["dim"]).select("node", "embedding")
        paths = own.mapInArrow(lean(_tables(r["dim"], lines, n_tables)), "path long, node long, sketch binary, at double")
        links = links.union(candidate_links(paths, LINES, collisions(NEAR), collisions(LINKED), collisions(COVERED), split, CENTRED, SCANNED))
    members = clusters(links).join(classes, "node").withColumn("units", F.lit(1))
    linked, edges = exact_links(in_blocks(members), "embedding", cosine_pairs)
    out = resolved(keyed.select(F.col("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("tk"), "node"), classes.select("node", "low", "weight"), linked, edges)
    return out.select(F.col("doc_id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"), "kept")


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector's links and component: vec_id, n_links, component_id, kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
