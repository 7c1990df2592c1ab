"""N-gram Jaccard join by chosen paths: documents whose sets of five-word shingles have a similarity of 0.8 or more.

Each text becomes a signature of minima over its shingles, a sample of tokens that two texts share with the
probability of their similarity. The recursion picks tokens: from the root, two tokens a run; in a bucket that is still
large, two more for each row. Small buckets are compared by brute force on the signatures. Runs go in rounds of RUNS:
of the links with the agreement of the limit that a round finds, the share that the rounds before had connected
already estimates their recall, and rounds repeat until it reaches RECALL. What is connected is then compared on the
full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import STEP, binary_rows, column_bytes, fixed_binary, lean, mix, segment_min, shingles, slices, step, word_hashes, words
from .common import components, row_of, table, written
from .near_links import candidate_links, clusters, exact_links, in_blocks

SHINGLE, SIMILARITY = 5, 0.8
#: Tokens of a signature, runs of a round, and branches of a run at each depth; the recall at which rounds end.
TOKENS, RUNS, BRANCHES, RECALL = 64, 2, 2, 0.995
#: Agreeing tokens of 64: two texts of similarity 0.8 have 38 or more but for one in 30,000; a leader stands for texts
#: that agree in 52, whose partners are at 0.6 from it and agree in 26 but for one in 300. Recall is measured on pairs
#: that agree in 51, the share of the limit.
NEAR, LINKED, COVERED, SURE = 38, 26, 52, 51
_rng = np.random.Generator(np.random.PCG64(811))
FACTORS = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(column: pa.Array):
    """For each run of rows: (first, beyond, digest of the words, number of shingles, signature bytes)."""
    for lo, hi, data, at in slices(column):
        low, starts, ends, first = words(data, at)
        h = word_hashes(low, starts, ends)
        n = np.diff(first)
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        whole = mix(h + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))
        digest = np.zeros(hi - lo, np.uint64)
        full = n > 0
        if len(h):
            digest[full] = np.add.reduceat(whole, first[:-1][full])
        digest = mix(digest + n.astype(np.uint64))
        s, edges = shingles(h, first, SHINGLE)
        signature = np.zeros((hi - lo, TOKENS), np.uint8)
        wide = np.zeros((hi - lo, TOKENS), np.uint32)
        for c in range(TOKENS):
            x = s * FACTORS[c]
            x ^= x >> np.uint64(32)
            least = mix(segment_min(x, edges, 0))
            signature[:, c] = (least >> np.uint64(56)).astype(np.uint8)
            wide[:, c] = (least >> np.uint64(24)).astype(np.uint32)
        yield lo, hi, digest, np.diff(edges), signature, wide


def _sketch(batches):
    for batch in batches:
        keep = [batch.column(c) for c in ("doc_id", "tk")]
        for lo, hi, digest, n, signature, tokens in sketches(batch.column("text")):
            own = [x.slice(lo, hi - lo) for x in keep]
            node = pa.array(digest.view(np.int64), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*own, node, pa.array(n), binary_rows(signature), binary_rows(tokens)], names=["doc_id", "tk", "node", "units", "sketch", "tokens"])


def _first_paths(first_run: int):
    """Rows for the first tokens of RUNS runs, each by the full values of BRANCHES tokens."""

    def run(batches):
        k = RUNS * BRANCHES
        at = (first_run * BRANCHES + np.arange(k)) % TOKENS
        for batch in batches:
            tokens = fixed_binary(batch.column("tokens"), TOKENS, np.uint32)[:, at].astype(np.uint64)
            paths = np.stack([mix(tokens[:, c] + step(int(first_run * BRANCHES + c) + 1)) for c in range(k)], 1).view(np.int64)
            again = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays([pa.array(paths.ravel()), batch.column("node").take(again), batch.column("sketch").take(again)], names=["path", "node", "sketch"])

    return run


def connected(classes: DataFrame) -> DataFrame:
    """(node, cluster) of the classes (node, sketch, tokens) that rounds of runs connect, until the recall is reached
    or all tokens have been first in a run."""
    found, first_run = None, 0
    while True:
        paths = classes.select("node", "sketch", "tokens").mapInArrow(lean(_first_paths(first_run)), "path long, node long, sketch binary")
        links = written(candidate_links(paths, TOKENS, _agree(NEAR), _agree(LINKED), _agree(COVERED), split, sure=_agree(SURE)), "links")
        first_run += RUNS
        if found is None:
            found = written(clusters(links), "clusters")
            continue
        for end in ("a", "b"):
            links = links.join(found.withColumnsRenamed({"node": end, "cluster": f"c{end}"}), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        links = written(links.select("ca", "cb", "sure"), "between")
        other = F.col("ca") != F.col("cb")
        n, missed, more = links.agg(F.count_if("sure"), F.count_if(F.col("sure") & other), F.count_if(other)).first()
        if more:
            joined = components(links.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("cluster", "joined")
            nodes = found.unionByName(joined.select(F.col("cluster").alias("node"), "cluster")).dropDuplicates(["node"])
            found = written(nodes.join(joined, "cluster", "left").select("node", F.coalesce("joined", "cluster").alias("cluster")), "clusters")
        if missed <= (1 - RECALL) * n or first_run * BRANCHES >= TOKENS:
            return found


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes of each two rows, eight at a time: a byte of the difference is zero where both agree."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return a.shape[1] - np.bitwise_count(((x & low) + low | x) & ~low).sum(1, dtype=np.int64)


def _agree(least: int):
    return lambda a, b: agreements(a, b) >= least


def split(paths: np.ndarray, sketch: np.ndarray, depth: int) -> np.ndarray:
    """Paths of each row one token deeper, in BRANCHES ways; rows of one path choose the same tokens."""
    out = np.zeros((len(paths), BRANCHES), np.int64)
    for j in range(BRANCHES):
        seed = mix(paths.view(np.uint64) + step(depth * BRANCHES + j + 1))
        token = (seed % np.uint64(TOKENS)).astype(np.int64)
        value = sketch[np.arange(len(paths)), token].astype(np.uint64)
        out[:, j] = mix(seed + (value + np.uint64(1)) * np.uint64(STEP)).view(np.int64)
    return out


def _sets(batches):
    for batch in batches:
        out = []
        for lo, hi, data, at in slices(batch.column("text")):
            low, starts, ends, first = words(data, at)
            s, edges = shingles(word_hashes(low, starts, ends), first, SHINGLE)
            out += [np.unique(s[edges[i] : edges[i + 1]]).tobytes() for i in range(hi - lo)]
        keep = [batch.column(c) for c in ("task", "node", "weight", "side", "same")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.binary())], names=["task", "node", "weight", "side", "same", "set"])


def jaccard_pairs(column: pa.Array, sides: np.ndarray | None, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the sets (sorted 64-bit values) with at least the similarity; with sides, only across."""
    data, at = column_bytes(column)
    values = data[at[0] : at[-1]].view(np.uint64)
    edges = (at - at[0]) // 8
    sizes = np.diff(edges)
    _, code, seen = np.unique(values, return_inverse=True, return_counts=True)
    shared = seen > 1
    renamed = np.cumsum(shared) - 1
    use = shared[code]
    row, col = np.repeat(np.arange(len(sizes)), sizes)[use], renamed[code[use]]
    a = np.arange(len(sizes)) if sides is None else np.flatnonzero(sides == 0)
    b = a if sides is None else np.flatnonzero(sides == 1)
    n_cols = int(shared.sum())
    both = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(256, min(4096, 16_000_000 // max(1, len(sizes))))
    for lo in range(0, n_cols, width):
        x, y = np.searchsorted(col, [lo, lo + width])
        dense = np.zeros((len(sizes), min(width, n_cols - lo)), np.float32)
        dense[row[x:y], col[x:y] - lo] = 1
        both += dense[a] @ dense[b].T
    enough = both * (1 + similarity) >= similarity * (sizes[a][:, None] + sizes[b][None, :]) - 1e-3
    if sides is None:
        enough &= a[:, None] < b[None, :]
    i, j = np.nonzero(enough)
    return a[i], b[j]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, class_id, n_links, kept) for each document.

    Words are runs of letters, digits and bytes beyond ASCII, lower-cased; a text of fewer than five words has one
    shingle of them all. Texts with the same words are one class, which takes part once and counts for all its copies.
    ``n_links``: other documents of similarity 0.8 or more. ``class_id``: the smallest id reachable by links;
    documents without a word (null, empty, marks only) link with nothing and keep their own. ``kept``: one document
    of each class (by smallest id, then text hash ``tk``; rows equal in both are one document). Null ids come last.
    Texts of any length are read whole; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    known = written(rows.mapInArrow(lean(_sketch), "doc_id long, tk long, node long, units long, sketch binary, tokens binary"), "sketches")
    classes = known.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "tk")).alias("low"), F.count("*").alias("weight"), F.min("tk").alias("tk"), F.min("units").alias("units"), F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens")
    )
    classes = written(classes, "classes")
    members = connected(classes).join(classes.select("node", "tk", "weight", "units"), "node")
    tasks = in_blocks(members).select("tk", "task", "node", "weight", "side", "same")
    texts = rows.filter("text is not null").groupBy("tk").agg(F.first("text").alias("text"))
    sets = tasks.join(texts, "tk").mapInArrow(lean(_sets), "task long, node long, weight long, side int, same boolean, set binary")
    linked, edges = exact_links(sets, "set", jaccard_pairs)
    return resolved(known.select("doc_id", "tk", "node"), classes.select("node", "low", "weight"), linked, edges)


def resolved(rows: DataFrame, classes: DataFrame, linked: DataFrame, edges: DataFrame) -> DataFrame:
    """Bring links and components back to the rows (doc_id, tk, node); a class's own copies are links too.

    ``low`` of a class is its smallest (id, tk), null ids as the largest number; ``kept`` is the smallest of each
    component, so components of the same ids, or of none, keep one each.
    """
    near = components(edges)
    least = near.join(classes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least"))
    joined = near.join(least, "component").join(linked, "node")
    found = classes.join(joined, "node", "left")
    found = found.select("node", F.coalesce("least", "low").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(written(found, "found"), "node", "left")
    last = F.lit(2**63 - 1)
    first = F.col("least").isNull() | ((F.coalesce("doc_id", last) == F.col("least.id")) & (F.col("tk") == F.col("least.tk")))
    class_id = F.when(F.col("least").isNull(), F.col("doc_id")).when(F.col("least.id") != last, F.col("least.id"))
    return out.select("doc_id", "tk", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class of near-duplicates, with all its columns; all documents without a word stay, rows
    equal in id and text once."""
    key = ["id", "missing", "tk"]
    id_key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing")]
    keep = near_duplicates(docs).filter("kept").select(*id_key, "tk").distinct()
    # keys without nulls, and rows made one before the join, so that whole rows are shuffled once
    keyed = docs.select(*id_key, F.xxhash64("text").alias("tk"), row_of(docs)).dropDuplicates(key)
    return keyed.join(keep, key, "left_semi").select("row.*")


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates and number of links: doc_id, class_id, n_links, kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "kept")
