"""What the two near-duplicate joins share: buckets to candidate links, candidate clusters to exact links.

Rows are (path, node, sketch) and, where a line is sorted, their place ``at`` on it. A bucket is the rows of one path.
Small buckets are compared pair by pair, or each row with those in the window centred on its place. In a larger one,
all rows are compared with its smallest node, in parallel; rows so near to it that it stands for them leave the
bucket, the others split into the paths that ``split`` gives them. What is small enough to be compared grows with the
rounds, since what has stayed together is alike; buckets beyond a block are dealt into blocks, with a task for each
two. So a bucket with a third of all rows is never gathered, whether it holds near copies (they leave in the first
round), rows with little in common (they split) or rows in between (they meet in blocks).
The links found so only have to connect: clusters of connected nodes are then compared exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import binary_rows, fixed_binary, lean
from .common import components, roots, shuffle_parts, whole_groups, written

#: Rows of a bucket that is compared pair by pair, and how many times as many in each further round: what has stayed
#: together through several rounds is alike, and splitting it on would copy its rows more often than comparing costs.
SMALL, GROWTH = 16, 8
LINK = "a long, b long, sure boolean"
#: Nodes and units of payload in a block of a cluster.
BLOCK, UNITS = 1024, 2_000_000


def _stars(links: np.ndarray, sure: bool) -> pa.RecordBatch:
    """What links connect stays so by links to the smallest node."""
    nodes, low = roots(links[:, 0], links[:, 1])
    at = nodes != low
    return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(low[at]), pa.array(np.full(at.sum(), sure))], names=["a", "b", "sure"])


def _pairs(width: int, near: Callable, sure: Callable | None, window: float | None):
    """Links in small buckets: each row against the one 1, 2, ... places on while the path is the same and, on a sorted
    line, the window centred on the row reaches so far."""

    def run(batches):
        for batch in whole_groups(batches, "path"):
            path, node = batch.column("path").to_numpy(), batch.column("node").to_numpy()
            at = batch.column("at").to_numpy() if window is not None else None
            sketch = fixed_binary(batch.column("sketch"), width)
            found, certain = ([np.zeros((0, 2), np.int64)] for _ in range(2))
            i = np.arange(len(path))
            step = 0
            while True:
                step += 1
                i = i[i + step < len(path)]
                i = i[path[i] == path[i + step]]
                if at is not None:
                    i = i[at[i + step] - at[i] <= window]
                if not len(i):
                    break
                for lo in range(0, len(i), 65_536):
                    a = i[lo : lo + 65_536]
                    hit = a[near(sketch[a], sketch[a + step])]
                    found.append(np.stack([node[hit], node[hit + step]], 1))
                    if sure is not None:
                        hit = hit[sure(sketch[hit], sketch[hit + step])]
                        certain.append(np.stack([node[hit], node[hit + step]], 1))
            for links, kind in ((np.concatenate(found), False), (np.concatenate(certain), True)):
                if len(links):
                    yield _stars(links, kind)

    return run


def _against_leader(width: int, linked: Callable, covered: Callable, sure: Callable | None, split: Callable, depth: int):
    """Rows of large buckets against the bucket's leader: kind 0 are links (node, leader), kind 2 such that are sure,
    kind 1 rows of new paths."""

    def run(batches):
        for batch in batches:
            path, node, leader = (batch.column(c).to_numpy() for c in ("path", "node", "leader"))
            if not len(path):
                continue
            sketch, lead = fixed_binary(batch.column("sketch"), width), fixed_binary(batch.column("lead"), width)
            other = node != leader
            link = np.flatnonzero(other & linked(sketch, lead))
            go = np.flatnonzero(other & ~covered(sketch, lead))
            new = split(path[go], sketch[go], depth)
            k = new.shape[1]
            again = np.repeat(go, k)
            certain = sure(sketch[link], lead[link]) if sure is not None else np.zeros(len(link), bool)
            kinds = np.concatenate([np.where(certain, 2, 0), np.ones(len(again), int)]).astype(np.int32)
            out_path = np.concatenate([leader[link], new.ravel()])
            out_node = np.concatenate([node[link], node[again]])
            out_sketch = np.concatenate([np.zeros((len(link), width), np.uint8), sketch[again]])
            columns = [pa.array(kinds), pa.array(out_path), pa.array(out_node), binary_rows(out_sketch)]
            if "at" in batch.schema.names:
                columns.append(batch.column("at").take(pa.array(np.concatenate([link, again]))))
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "path", "node", "sketch", "at"][: len(columns)])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (path, n, node, ...) of buckets beyond BLOCK rows dealt into blocks, with a path for each two of them."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = rows.filter(F.col("n") > BLOCK).withColumn("own", F.pmod(F.xxhash64("node", F.lit(13)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = many.withColumn("path", F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other")
    return rows.filter(F.col("n") <= BLOCK).unionByName(many)


def candidate_links(rows: DataFrame, width: int, near: Callable, linked: Callable, covered: Callable, split: Callable, window: float | None = None, small: int = SMALL, sure: Callable | None = None) -> DataFrame:
    """Links (a, b, sure) from rows (path, node, sketch of ``width`` bytes); a path has a node once.

    near, linked, covered, sure: of two arrays of sketches, which pairs may be near; may be near to something the
    second stands for; are stood for by the second; look near enough for recall to be measured on them. split(paths,
    sketches, round): new paths of each row, one row each.
    With ``window``, rows have a place ``at`` too, buckets are sorted by it, and pairs lie within the window.
    """
    spark = rows.sparkSession
    parts = shuffle_parts(spark)
    sorted_by, more = (["path"], "") if window is None else (["path", "at"], ", at double")
    columns = ["path", "node", "sketch", *sorted_by[1:]]
    links, depth = None, 0
    while True:
        depth += 1
        rows = written(rows, f"paths{depth}") if depth == 1 else rows
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1")
        full = rows.join(sizes, "path")
        most = small * GROWTH ** (depth - 1)
        full = written(full, f"full{depth}")
        compared = _dealt(full.filter(F.col("n") <= most)).select(*columns).repartition(parts, "path").sortWithinPartitions(*sorted_by)
        found = compared.mapInArrow(lean(_pairs(width, near, sure, window)), LINK)
        large = full.filter(F.col("n") > most)
        if large.limit(1).count() == 0:
            return found if links is None else links.union(found)
        lead = large.filter("node = leader").select("path", F.col("sketch").alias("lead"))
        step = large.join(lead, "path").select(*columns, "leader", "lead")
        step = written(step.mapInArrow(lean(_against_leader(width, linked, covered, sure, split, depth)), f"kind int, path long, node long, sketch binary{more}"), f"step{depth}")
        found = found.union(step.filter("kind <> 1").select(F.col("node").alias("a"), F.col("path").alias("b"), (F.col("kind") == 2).alias("sure")))
        links = found if links is None else links.union(found)
        rows = step.filter("kind = 1").select(*columns).dropDuplicates(["path", "node"])


def clusters(links: DataFrame) -> DataFrame:
    """(node, cluster) of the nodes that have a candidate link."""
    return components(links.select("a", "b")).withColumnRenamed("component", "cluster")


def in_blocks(members: DataFrame, block: int = BLOCK, units: int = UNITS) -> DataFrame:
    """Add (task, side, block) to members (node, cluster, units, ...): one row for each task that a node has a part in.

    A cluster of up to ``block`` nodes is one task. A larger one is dealt into blocks, with a task for each two; no
    task holds more than two blocks, and each pair of nodes meets in one task that counts it.
    """
    sums = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("units").alias("u"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("u") / units)).cast("int")
    out = members.join(sums.select("cluster", F.greatest(F.lit(1), blocks).alias("blocks")), "cluster")
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
    out = out.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    task = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
    same = (F.col("own") == F.col("other")).alias("same")
    return out.withColumns({"task": task, "side": (F.col("own") > F.col("other")).cast("int"), "same": same}).drop("own", "other", "blocks")


LINKED = "node long, root long, links long"


def _links(payload: str, pairs: Callable):
    def run(batches):
        for batch in whole_groups(batches, "task"):
            task = batch.column("task").to_numpy()
            node, weight, side = (batch.column(c).to_numpy() for c in ("node", "weight", "side"))
            same = batch.column("same").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            out = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo < 2:
                    continue
                own = slice(lo, hi)
                i, j = pairs(batch.column(payload).slice(lo, hi - lo), None if same[lo] else side[own])
                if not len(i):
                    continue
                links = np.bincount(i, weight[own][j], hi - lo) + np.bincount(j, weight[own][i], hi - lo)
                nodes, low = roots(node[own][i], node[own][j])
                order = np.argsort(node[own])
                at = order[np.searchsorted(node[own][order], nodes)]
                out.append((nodes, low, links[at].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "root", "links"])

    return run


def exact_links(tasks: DataFrame, payload: str, pairs: Callable) -> tuple[DataFrame, DataFrame]:
    """((node, links), (a, b) that connect what is linked) from rows of ``in_blocks`` with a payload and a weight.

    pairs(payloads, sides): places i < j of the linked pairs of a task; with sides, only pairs across. ``links`` sums
    the weights of a node's partners. Neither pairs nor neighbours leave the task.
    """
    parts = shuffle_parts(tasks.sparkSession)
    sorted_ = tasks.select("task", "node", "weight", "side", "same", payload).repartition(parts, "task").sortWithinPartitions("task")
    out = written(sorted_.mapInArrow(lean(_links(payload, pairs)), LINKED), "exact")
    return out.groupBy("node").agg(F.sum("links").alias("links")), out.select(F.col("node").alias("a"), F.col("root").alias("b"))
