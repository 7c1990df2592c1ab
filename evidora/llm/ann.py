"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue over all of them.

The first levels grow on a bounded sample; cells that hold too many of all rows grow on, level by level, in tasks. So
the rows a query meets depend on the cells it visits, not on the size of the table.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytes_kernel import lean, mix, step
from .common import shuffle_parts, small_batches, table, written
from .embedding_dedup import unit_rows, usable

TREES, LEAF = 8, 32
#: The bounded sample that trees are grown on, the queries in it that the search is calibrated with, and their recall.
SAMPLE, PROBES, RECALL = 16_384, 200, 0.97
NEAREST, EVERY = 5, 50
#: Most rows of a cell; the expected sample that a larger one grows on over, and the least of it in a leaf.
CELL, GROWN, LEAST = 512, 4096, 8
#: Cells that calibration looks at first, four times as many where that isn't enough; rows or queries of a cell that
#: meet in one task.
VISITS, BLOCK = 1024, 4096


@dataclass
class Tree:
    """Inner node i: plane and offset, children (>= 0 inner, < 0 leaf -1 - id)."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.planes) else np.full(len(x), -1)
        while (live := np.flatnonzero(at >= 0)).size:
            node = at[live]
            side = (x[live] * self.planes[node]).sum(1) > self.offsets[node]
            at[live] = self.children[node, side.astype(int)]
        return -1 - at


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    """Split by the plane between two random vectors, at the median, until leaves are small or all rows are equal."""
    planes, offsets, children, n_leaves = [], [], [], 0
    work = [(np.arange(len(x)), None)]
    while work:
        rows, parent = work.pop()
        made = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rows[rng.integers(len(rows))]], x[rows[rng.integers(len(rows))]]
                plane = a - b
                norm = np.sqrt((plane * plane).sum())
                if norm < 1e-9:
                    continue
                plane /= norm
                z = x[rows] @ plane
                cut = float(np.median(z))
                right = z > cut
                if 0 < right.sum() < len(rows):
                    made = len(planes)
                    planes.append(plane)
                    offsets.append(cut)
                    children.append([0, 0])
                    work += [(rows[~right], (made, 0)), (rows[right], (made, 1))]
                    break
        if made is None:
            made, n_leaves = -1 - n_leaves, n_leaves + 1
        if parent is not None:
            children[parent[0]][parent[1]] = made
    dim = x.shape[1]
    return Tree(np.array(planes).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2))


@dataclass
class Forest:
    trees: list[Tree]

    def search(self, q: np.ndarray, visits: int, worst: float = -math.inf, bound: float = math.inf) -> list[tuple[float, int, int]]:
        """The first ``visits`` leaves (margin, tree, leaf) that one queue over all trees gives: in the order of the
        largest margin on the wrong side on the way to them, from ``worst`` at the roots up to ``bound``."""
        margins = [t.planes @ q - t.offsets if len(t.planes) else np.zeros(0) for t in self.trees]
        queue = [(worst, k, 0 if len(t.planes) else -1) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found: list[tuple[float, int, int]] = []
        while queue and len(found) < visits:
            worst, k, node = heapq.heappop(queue)
            while node >= 0:
                z = margins[k][node]
                near, far = self.trees[k].children[node, ::-1] if z > 0 else self.trees[k].children[node]
                if max(worst, abs(z)) <= bound:
                    heapq.heappush(queue, (max(worst, abs(z)), k, int(far)))
                node = int(near)
            found.append((worst, k, -1 - node))
        return found


def fit(sample: np.ndarray, seed: int = 1010) -> Forest:
    """Trees over a sample of unit vectors."""
    if not len(sample):
        return Forest([Tree(np.zeros((0, 1)), np.zeros(0), np.zeros((0, 2), np.int64))])
    rng = np.random.Generator(np.random.PCG64(seed))
    return Forest([grow(sample, rng) for _ in range(TREES)])


def _index(shared):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column("embedding"))
            for k, tree in enumerate(shared.value.trees):
                cell = pa.array(tree.leaves(x).astype(np.int64) * TREES + k)
                yield pa.RecordBatch.from_arrays([cell, *(batch.column(c) for c in ("key", "ids", "embedding"))], names=["cell", "key", "ids", "embedding"])

    return run


def _grown(cell_rows: int):
    """A tree over the sampled rows of one cell, for leaves of some ``cell_rows`` / 2 of the cell's rows."""

    def run(rows: pa.Table) -> pa.Table:
        cell, n = rows.column("cell")[0].as_py(), rows.column("n")[0].as_py()
        rows = rows.sort_by("key")  # whatever order they arrived in
        x = unit_rows(rows.column("embedding").combine_chunks())
        tree = grow(x, np.random.Generator(np.random.PCG64(cell & (1 << 62) - 1)), max(LEAST, len(x) * cell_rows // (2 * n)))
        return pa.table([pa.array([cell], pa.int64()), pa.array([len(tree.planes)], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], names=["cell", "planes", "tree"])

    return run


def _below(cell: int, leaf: np.ndarray) -> np.ndarray:
    """Names of a cell's leaves."""
    return mix(mix(np.uint64(cell & (1 << 64) - 1) + leaf.astype(np.uint64)) + step(1)).view(np.int64)


def _rows_on(rows: pa.Table, trees: pa.Table) -> pa.Table:
    if rows.num_rows and trees.num_rows:
        x = unit_rows(rows.column("embedding").combine_chunks())
        leaf = pickle.loads(trees.column("tree")[0].as_py()).leaves(x)
        rows = rows.set_column(0, "cell", pa.array(_below(rows.column("cell")[0].as_py(), leaf)))
    return rows.select(["cell", "key", "ids", "embedding"])


def _queue_on(visits: int):
    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        row, cell, margin = [], [], []
        if rows.num_rows and trees.num_rows:
            forest = Forest([pickle.loads(trees.column("tree")[0].as_py())])
            x, own = unit_rows(rows.column("query").combine_chunks()), rows.column("cell")[0].as_py()
            for i, (worst, bound) in enumerate(zip(rows.column("margin").to_pylist(), rows.column("bound").to_pylist(), strict=True)):
                for m, _, leaf in forest.search(x[i], visits, worst, bound):
                    row.append(i)
                    cell.append(leaf)
                    margin.append(m)
            cell = _below(own, np.array(cell, np.int64))
        out = rows.select(["query_id", "query"]).take(pa.array(row, pa.int64()))
        return out.append_column("cell", pa.array(cell, pa.int64())).append_column("margin", pa.array(margin, pa.float64()))

    return run


def _in_blocks(rows: DataFrame, ident: str, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``block`` of their cell, at most some BLOCK rows, and cells repeated for each block they have."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(ident, F.lit(5)), F.col("blocks")).cast("int")).drop("blocks")
    return dealt, cells.join(sizes, "cell").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")


def build(rows: DataFrame, forest, cell_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Every row's cells, one for each tree, and the trees of each level below the broadcast ``forest``.

    A cell of more than ``cell_rows`` rows grows on, over a sample of its own, until all are small or can't be split
    (vectors of one direction). Cells are worked on in blocks of rows, so no task holds a large one.
    """
    vector = rows.schema["embedding"].dataType.simpleString()
    schema = f"cell long, key long, ids array<long>, embedding {vector}"
    open_ = written(rows.mapInArrow(lean(_index(forest)), schema), "cells")
    done, levels = None, []
    while True:
        sizes = open_.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
        chosen = open_.join(sizes, "cell").filter(F.pmod(F.xxhash64("key", F.lit(len(levels))), F.lit(1 << 20)) < F.lit(float(GROWN << 20)) / F.col("n"))
        trees = written(chosen.groupBy("cell").applyInArrow(_grown(cell_rows), "cell long, planes int, tree binary"), "trees").filter("planes > 0").drop("planes")
        if trees.limit(1).count() == 0:
            return open_ if done is None else done.unionByName(open_), levels
        rest = open_.join(trees.select("cell"), "cell", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        large, forked = _in_blocks(open_.join(trees.select("cell"), "cell", "left_semi"), "key", trees)
        open_ = written(large.groupBy("cell", "block").cogroup(forked.groupBy("cell", "block")).applyInArrow(_rows_on, schema), "cells")
        levels.append(trees)


def _probe(shared, visits: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column("query"))
            row, cell, margin = [], [], []
            for i in range(len(x)):
                for m, k, leaf in shared.value.search(x[i], visits):
                    row.append(i)
                    cell.append(leaf * TREES + k)
                    margin.append(m)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("query").take(take), pa.array(cell, pa.int64()), pa.array(margin, pa.float64())], names=["query_id", "query", "cell", "margin"])

    return run


def descend(asked: DataFrame, forest, levels: list[DataFrame], visits: int) -> DataFrame:
    """(query_id, query, cell, margin, place): the queue's first ``visits`` cells of each (query_id, query).

    The queue is carried from level to level: a cell that has grown on is replaced by its leaves up to the queue's
    largest margin, beyond which there are ``visits`` nearer ones for certain.
    """
    vector = asked.schema["query"].dataType.simpleString()
    schema = f"query_id long, query {vector}, cell long, margin double"
    spread = asked.repartition(shuffle_parts(asked.sparkSession), F.xxhash64("query_id"))  # few bytes, but each takes a search
    queue = written(spread.mapInArrow(lean(_probe(forest, visits)), schema), "queue")
    by_query = W.partitionBy("query_id")
    place = F.row_number().over(by_query.orderBy("margin", "cell"))
    for trees in levels:
        full = F.count("*").over(by_query) >= visits
        bound = F.when(full, F.max("margin").over(by_query)).otherwise(F.lit(float("inf")))
        large = queue.withColumn("bound", bound).join(trees.select("cell"), "cell", "left_semi")
        large, forked = _in_blocks(large, "query_id", trees)
        deeper = large.groupBy("cell", "block").cogroup(forked.groupBy("cell", "block")).applyInArrow(_queue_on(visits), schema)
        queue = queue.join(trees.select("cell"), "cell", "left_anti").unionByName(deeper)
        queue = written(queue.withColumn("place", place).filter(F.col("place") <= visits).drop("place"), "queue")
    return queue.withColumn("place", place)


def _best_of(shared, nearest: int):
    """Each probe's nearest rows of a batch, itself left out."""

    def run(batches):
        keys, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = unit_rows(batch.column("embedding")), batch.column("key").to_numpy()
            near = q @ x.T
            near[keys[:, None] == own[None, :]] = -2
            best = np.argsort(-near, axis=1)[:, :nearest]
            probe = np.repeat(np.arange(len(q)), best.shape[1])
            score = near[probe, best.ravel()]
            at = score > -2
            yield pa.RecordBatch.from_arrays([pa.array(probe[at]), pa.array(own[best.ravel()][at]), pa.array(score[at])], names=["query_id", "key", "score"])

    return run


def calibrated(rows: DataFrame, index: DataFrame, probes: pa.Table, forest, levels: list[DataFrame], nearest: int) -> int:
    """Cells that a search must see, so that RECALL of the nearest rows of PROBES sampled vectors lie in them, by brute
    force over all rows."""
    spark = rows.sparkSession
    keys = probes.column("key").to_numpy()
    shared = spark.sparkContext.broadcast((keys, unit_rows(probes.column("embedding").combine_chunks())))
    found = rows.select("key", "embedding").mapInArrow(lean(_best_of(shared, nearest)), "query_id long, key long, score double")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))).filter(F.col("r") <= nearest)
    truth = written(best.select("query_id", "key"), "truth")  # PROBES times ``nearest`` rows
    asked = spark.createDataFrame(pa.table([pa.array(np.arange(len(keys))), probes.column("embedding")], names=["query_id", "query"]))
    where = written(index.select("cell", "key").join(F.broadcast(truth), "key"), "where")
    n, visits = index.select("cell").distinct().count(), VISITS
    while True:
        queue = descend(asked, forest, levels, visits).select("query_id", "cell", "place")
        seen = where.join(queue, ["query_id", "cell"], "left").groupBy("query_id", "key").agg(F.min("place").alias("place"))
        needed = sorted(r["place"] or math.inf for r in seen.select("place").collect())
        most = needed[math.ceil(RECALL * len(needed)) - 1] if needed else 1
        if most <= visits or visits >= n:
            return max(2 * TREES, int(min(most, n)))
        visits *= 4


def best_in_cell(q: np.ndarray, own: np.ndarray, x: np.ndarray, flat: np.ndarray, ids: np.ndarray, nearest: int):
    """(query, id, score) of each query's ``nearest`` ids in a cell but its own, ties to the smaller id.

    ``ids`` belong to the rows ``flat`` of ``x``. What the matrix product puts near the last place is scored again,
    one product at a time, so that equal directions tie whatever block they stand in.
    """
    out = []
    width = max(1, 1_000_000 // max(1, len(ids)))
    for lo in range(0, len(q), width):
        part = q[lo : lo + width]
        near = (part @ x.T)[:, flat]
        near[own[lo : lo + width, None] == ids[None, :]] = -np.inf
        least = np.partition(near, -nearest, axis=1)[:, -nearest] if nearest < len(ids) else np.full(len(part), -2.0)
        i, j = np.nonzero((near >= least[:, None] - 1e-12) & (near > -2))
        if not len(i):
            continue
        score = np.concatenate([(x[flat[j[a : a + 65_536]]] * part[i[a : a + 65_536]]).sum(1) for a in range(0, len(i), 65_536)])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < nearest
        out.append((i[keep] + lo, ids[j[keep]], score[keep]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def _rank(nearest: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = vec = np.zeros(0, np.int64)
        score = np.zeros(0)
        own = left.column("query_id").to_numpy() if left.num_rows else np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            q, x = (unit_rows(t.column(c).combine_chunks()) for t, c in ((left, "query"), (right, "embedding")))
            lists = right.column("ids").combine_chunks()
            flat = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
            row, vec, score = best_in_cell(q, own, x, flat, lists.flatten().to_numpy(), nearest)
        return pa.table([pa.array(own[row], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


NEIGHBOUR = "query_id long, rank int, vec_id long, score double"


def _of_one_length(good: DataFrame, asked: DataFrame, nearest: int, cell_rows: int) -> DataFrame:
    spark = good.sparkSession
    key = F.xxhash64(F.transform("embedding", lambda x: x.cast("double") + 0.0))
    rows = good.withColumn("key", key).groupBy("key", "vec_id").agg(F.first("embedding").alias("embedding"))
    by_id = W.partitionBy("key").orderBy("vec_id")
    rows = rows.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= nearest + 1)
    rows = rows.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    rows = written(rows, "distinct")
    # rows of one id but several vectors ask with the smallest of these
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("embedding", key).alias("query"))
    sample = rows.orderBy(F.xxhash64("key")).limit(SAMPLE).select("key", "embedding").toArrow()
    forest = fit(unit_rows(sample.column("embedding").combine_chunks()) if sample.num_rows else np.zeros((0, 1)))
    shared = spark.sparkContext.broadcast(forest)  # planes of a bounded sample: some MB at any size
    index, levels = build(rows, shared, cell_rows)
    visits = calibrated(rows, index, sample.slice(0, PROBES), shared, levels, nearest)
    queue = descend(asked, shared, levels, visits)
    cells = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("row_blocks")).join(queue.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_blocks")), "cell")
    cells = written(cells, "blocks")
    block = lambda ident, n: F.pmod(F.xxhash64(ident, F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    held = index.join(cells, "cell").withColumn("rb", block("key", "row_blocks")).withColumn("qb", every("query_blocks"))
    asking = queue.join(cells, "cell").withColumn("qb", block("query_id", "query_blocks")).withColumn("rb", every("row_blocks"))
    held, asking = held.select("cell", "rb", "qb", "ids", "embedding"), asking.select("cell", "rb", "qb", "query_id", "query")
    pairs = asking.groupBy("cell", "rb", "qb").cogroup(held.groupBy("cell", "rb", "qb")).applyInArrow(_rank(nearest), "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, cell_rows: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding) of both: nearest by cosine, ties to the smaller id.

    Equal vectors are indexed once with their smallest ``nearest`` + 1 ids, which is all a result can need. Every row
    is in each tree, and cells grow on until they are small; cells that can't be split, and cells that many queries
    visit, meet in blocks. The recall is calibrated by brute force for PROBES vectors over all rows. Unusable vectors
    and null ids take no part; vectors of each length are searched by themselves; rows repeated in id and vector
    count once; columns beside vec_id and embedding are not looked at. No rows or no queries: no result.
    """
    small_batches(vectors.sparkSession)
    good = vectors.select("vec_id", "embedding").filter(usable() & F.col("vec_id").isNotNull())
    asked = queries.select("vec_id", "embedding").filter(usable() & F.col("vec_id").isNotNull())
    out = None
    for r in asked.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect():  # as few as there are models
        fits = F.size("embedding") == r["n"]
        part = _of_one_length(good.filter(fits), asked.filter(fits), nearest, cell_rows)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], NEIGHBOUR)


def op10_ann(spark, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
