"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytes_kernel import give_back, lean, slices, step, word_hashes, words
from .common import shuffle_parts, small_batches, table, written

BITS, DIM, WIDTHS, FILTERS = 15, 8, (1, 2, 3), 8
#: Bytes of the word prefixes that are embedded beside the word itself.
PREFIXES = (4, 6)
THRESHOLD = 0.3
#: Label 1 has at least this share of the weight in training.
SHARE = 0.25
#: Rows of a shard. In an epoch each shard is learned from by itself, then the shards' weights are averaged.
SHARD = 16384
#: Bits a label in the bitmap that keeps most other texts from moving, and bits of each of its pieces.
BITS_A_LABEL, PIECE = 16, 32768
EPOCHS, BATCH = 6, 32
#: A batch of longer texts ends sooner.
BATCH_WORDS = 1 << 18
KINDS = 1 + len(PREFIXES)
SIZE = KINDS << BITS
COLUMNS = np.arange(FILTERS)
#: Buckets that are summed over the shards in one row.
PART = 2048
#: Logits are counted in steps of 1 / STEPS for the calibration; those beyond FAR count as FAR.
STEPS, FAR = 256, 64


def features(column: pa.Array):
    """For each run of rows: (first, beyond, buckets of each word by feature, first word of each text and the end)."""
    for lo, hi, data, at in slices(column, 1 << 19):
        low, starts, ends, first = words(data, at)
        hashes = [word_hashes(low, starts, ends), *(word_hashes(low, starts, ends, k) + step(k) for k in PREFIXES)]
        yield lo, hi, [(h >> np.uint64(64 - BITS)).astype(np.int32) + (k << BITS) for k, h in enumerate(hashes)], first


@dataclass
class Model:
    """Weights; ``slope`` and ``shift`` turn the output into a probability, ``thresholds`` are by language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def pooled(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest value of each filter over each text's windows; 0 where a text is shorter than the filter."""
        out = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        for k, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.biases, strict=True)):
            n = len(x) - w + 1
            if n <= 0:
                continue
            y = x[:n] @ f[:DIM]
            for j in range(1, w):
                y += x[j : n + j] @ f[j * DIM : (j + 1) * DIM]
            y += b
            lo, hi = first[:-1], first[1:] - w + 1
            full = np.flatnonzero(hi > lo)
            if len(full):
                # windows that cross into the next text lie between one segment's end and the next one's start
                edges = np.stack([lo[full], np.minimum(hi[full], n)], 1).ravel()
                closed = edges[-1] == n
                got = np.maximum.reduceat(y, edges[:-1] if closed else edges, axis=0)[::2]
                out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(got, 0)
        return out

    def embed(self, buckets: list[np.ndarray]) -> np.ndarray:
        x = self.embedding.take(buckets[0], 0)  # ten times faster than indexing
        for b in buckets[1:]:
            x += self.embedding.take(b, 0)
        return x

    def logits(self, buckets: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        return self.pooled(self.embed(buckets), first) @ self.weight + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for lo, hi, buckets, first in features(column):
            z = self.logits(buckets, first).astype(np.float64) * self.slope + self.shift
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


@dataclass
class Learner:
    """A model in training: the moments of its dense weights, the squared gradients of its buckets, and its steps."""

    model: Model
    first: np.ndarray
    second: np.ndarray
    grown: np.ndarray
    lift: float = 1.0
    steps: float = 0.0

    def dense(self) -> np.ndarray:
        m = self.model
        return np.concatenate([p.ravel() for p in (*m.filters, *m.biases, m.weight)])

    def load(self, flat: np.ndarray) -> None:
        at, m = 0, self.model
        for p in (*m.filters, *m.biases, m.weight):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def step(self, docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        """One step of Adam on the dense weights and Adagrad on the embeddings; returns the buckets it changed. Maxima
        pass gradients to one window of a text and filter only."""
        model, n_docs = self.model, len(docs)
        buckets = np.concatenate(docs, 1)
        first = np.concatenate([[0], np.cumsum([d.shape[1] for d in docs])])
        x = model.embed(list(buckets))
        top = np.zeros((n_docs, FILTERS * len(WIDTHS)), np.float32)
        place = np.zeros(top.shape, np.int64)
        taps = np.concatenate([f[j * DIM : (j + 1) * DIM] for f, w in zip(model.filters, WIDTHS, strict=True) for j in range(w)], 1)
        taps = taps.T @ x.T
        for k, (w, b) in enumerate(zip(WIDTHS, model.biases, strict=True)):
            n = len(x) - w + 1
            if n <= 0:
                continue
            at, taps = taps[: w * FILTERS], taps[w * FILTERS :]
            y = at[:FILTERS, :n]
            for j in range(1, w):
                y += at[j * FILTERS : (j + 1) * FILTERS, j : n + j]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for d in range(n_docs):
                lo, hi = first[d], first[d + 1] - w + 1
                if hi > lo:
                    place[d, cols] = y[:, lo:hi].argmax(1) + lo
                    top[d, cols] = y[COLUMNS, place[d, cols]]
            top[:, cols] += b * (np.diff(first) >= w)[:, None]
        pool = np.maximum(top, 0)
        z = pool @ model.weight + model.bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = (np.where(labels == 1, self.lift, 1.0) * (p - labels) / n_docs).astype(np.float32)
        back = np.outer(g, model.weight) * (top > 0)
        slopes, shifts, at, pull = [], [], [], []
        for k, w in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            on, c = np.nonzero(top[:, cols] > 0)
            own = np.zeros((len(on), FILTERS), np.float32)
            own[np.arange(len(on)), c] = back[:, cols][on, c]
            where = place[:, cols][on, c]
            slopes.append(np.concatenate([x[where + j].T @ own for j in range(w)]))
            shifts.append(own.sum(0))
            for j in range(w):
                at.append(where + j)
                pull.append(own @ model.filters[k][j * DIM : (j + 1) * DIM].T)
        grad = np.concatenate([q.ravel() for q in (*slopes, *shifts, pool.T @ g + 1e-4 * model.weight)])
        self.steps += 1
        self.first += 0.1 * (grad - self.first)
        self.second += 0.001 * (grad * grad - self.second)
        self.load(self.dense() - 5e-3 * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-7))
        model.bias -= 0.05 * float(g.sum())
        if not sum(map(len, at)):
            return np.zeros(0, np.int64)
        hit, back_at = np.unique(np.concatenate(at), return_inverse=True)
        gx = np.zeros((len(hit), DIM), np.float32)
        _add_rows(gx, back_at, np.concatenate(pull))
        changed = []
        for b in buckets:
            own = b[hit]
            np.add.at(self.grown, own, (gx**2).mean(1))
            _add_rows(model.embedding, own, -0.02 * gx / np.sqrt(self.grown[own])[:, None])
            changed.append(own)
        return np.concatenate(changed)


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add rows where indices may repeat; one flat index is several times faster than one of rows."""
    flat = at.astype(np.int64)[:, None] * DIM + np.arange(DIM)
    np.add.at(to.reshape(-1), flat.ravel(), rows.astype(np.float32, copy=False).ravel())


def beginner(seen: np.ndarray, n: np.ndarray, seed: int) -> Learner:
    """A learner before its first step. ``seen`` has the texts of each label with each bucket, ``n`` those of each label.

    Embeddings start from the log-odds of the buckets' presence, shrunk towards 0, filters at random. Without both
    labels, every score is the share of label 1.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Model(
        rng.normal(0, 0.05, (SIZE, DIM)).astype(np.float32),
        [rng.normal(0, 0.4 / np.sqrt(w), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        -1.0,
    )
    if not n.all():
        prior = n[1] / max(1, n.sum())
        model.weight[:] = 0
        model.bias = float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    else:
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        model.embedding[:, 0] = 0.3 * np.clip(odds * (seen.sum(0) >= 3), -3, 4)
        for f in model.filters:
            f[::DIM, : FILTERS // 2] = np.abs(f[::DIM, : FILTERS // 2]) + 0.3
        model.weight[:] = np.abs(model.weight)
    out = Learner(model, np.zeros(0), np.zeros(0), np.full(SIZE, 1e-2, np.float32), max(1.0, SHARE / (1 - SHARE) * n[0] / max(1, n[1])))
    out.first, out.second = np.zeros_like(out.dense()), np.zeros_like(out.dense())
    return out


class Replica:
    """The learners of one shard in one epoch: those of the two folds, by number, and the last one, of all rows."""

    def __init__(self, learners: dict[int, Learner]):
        self.learners = learners
        self.before = {k: v.steps for k, v in learners.items()}
        self.touched = {k: np.zeros(SIZE, bool) for k in learners}
        self.waiting: dict[int, list] = {k: [] for k in learners}
        self.words = dict.fromkeys(learners, 0)

    def learn(self, doc: np.ndarray, label: int, fold: int) -> None:
        for k in (fold, 2):
            if k in self.learners:
                if self.words[k] + doc.shape[1] > BATCH_WORDS:
                    self.flush(k)
                self.waiting[k].append((doc, label))
                self.words[k] += doc.shape[1]
                if len(self.waiting[k]) == BATCH:
                    self.flush(k)

    def flush(self, k: int) -> None:
        if self.waiting[k]:
            docs, labels = zip(*self.waiting[k], strict=True)
            self.touched[k][self.learners[k].step(list(docs), np.array(labels))] = True
            self.waiting[k], self.words[k] = [], 0

    def results(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(learner, part, indices, rows): the buckets that changed and, as part -1, dense weights weighed by steps."""
        for k, own in self.learners.items():
            self.flush(k)
            n = own.steps - self.before[k]
            if n:
                flat = np.concatenate([own.dense(), [own.model.bias], own.first, own.second, [own.steps, 1.0]]) * n
                flat = np.concatenate([flat, np.zeros(-len(flat) % (DIM + 1))]).reshape(-1, DIM + 1)
                yield k, -1, np.arange(len(flat)), flat
                at = np.flatnonzero(self.touched[k])
                for part in np.unique(at // PART):
                    use = at[at // PART == part]
                    yield k, int(part), use, np.column_stack([own.model.embedding[use], own.grown[use]])


def _averaged(learner: Learner, part: int, at: np.ndarray, rows: np.ndarray) -> None:
    """Take over the shards' mean: of a bucket, over those that changed it; of dense weights, weighed by steps."""
    if part >= 0:
        learner.model.embedding[at], learner.grown[at] = rows[:, :DIM], rows[:, DIM]
        return
    n = len(learner.first)
    flat = rows.ravel()[: 3 * n + 3]
    flat = flat / flat[-1]
    learner.load(flat[:n])
    learner.model.bias, learner.first, learner.second = float(flat[n]), flat[n + 1 : 2 * n + 1].astype(np.float32), flat[2 * n + 1 : 3 * n + 1].astype(np.float32)
    learner.steps = float(flat[3 * n + 1])


def _packed(at: np.ndarray, rows: np.ndarray) -> bytes:
    """Floats are exact for the counts of a task up to 16 million rows; sums over tasks are doubles."""
    return at.astype(np.int32).tobytes() + rows.astype(np.float32).tobytes()


def _unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (4 + 4 * width)
    return np.frombuffer(data, np.int32, n), np.frombuffer(data, np.float32, n * width, 4 * n).reshape(n, width)


def _gathered(parts: DataFrame, width: int, mean: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Sums or means, over shards, of the rows with the same learner, part and index. They are added up in tasks in
    the order of the shards, so that reruns agree; what the driver gets doesn't grow with the input."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, part, data in zip(*(batch.column(c).to_pylist() for c in ("learner", "part", "data")), strict=True):
                at, rows = _unpacked(data, width)
                own = sums.setdefault((k, part), np.zeros((PART, width + 1)))
                at = at % PART
                own[at, :width] += rows
                own[at, width] += 1
        for (k, part), own in sums.items():
            at = np.flatnonzero(own[:, width])
            rows = own[at, :width] / own[at, width:] if mean else own[at, :width]
            yield pa.RecordBatch.from_pydict({"learner": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([_packed(at, rows)], pa.binary())})

    dealt = parts.repartition(shuffle_parts(parts.sparkSession), "learner", "part").sortWithinPartitions("learner", "part", "shard", "piece")
    for r in dealt.mapInArrow(lean(run), "learner int, part int, data binary").collect():
        at, rows = _unpacked(r["data"], width)
        yield r["learner"], r["part"], at + max(r["part"], 0) * PART, rows


_PARTS = "learner int, part int, shard int, piece int, data binary"


def _part_rows(found, shard: int) -> pa.RecordBatch | None:
    found = list(found)
    if not found:
        return None
    piece = TaskContext.get().partitionId()
    columns = [[f[0] for f in found], [f[1] for f in found], [shard] * len(found), [piece] * len(found)]
    arrays = [*(pa.array(c, pa.int32()) for c in columns), pa.array([_packed(*f[2:]) for f in found], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["learner", "part", "shard", "piece", "data"])


def _to_words(batches):
    """Texts become the buckets of their words: two bytes for each word and kind of feature."""
    for batch in batches:
        out = []
        for _, _, buckets, first in features(batch.column("text")):
            low = np.stack([b & ((1 << BITS) - 1) for b in buckets]).astype(np.uint16)
            out += [low[:, i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
        rest = [batch.column(c) for c in ("shard", "fold", "lang", "toxic")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary())], names=["shard", "fold", "lang", "toxic", "words"])


def _from_words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16).reshape(KINDS, -1).astype(np.int32) + (np.arange(KINDS, dtype=np.int32) << BITS)[:, None]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(shard, fold, label, buckets) of each row."""
    columns = (batch.column(c).to_numpy() for c in ("shard", "fold", "toxic"))
    for shard, fold, label, data in zip(*columns, batch.column("words"), strict=True):
        yield int(shard), int(fold), int(label), _from_words(data.as_buffer())


def _presence(rows: DataFrame) -> np.ndarray:
    """Rows of each fold and label that have each bucket."""

    def run(batches):
        seen = np.zeros((2, 2, SIZE))
        for batch in batches:
            for _, fold, label, doc in _rows(batch):
                seen[fold, label, np.unique(doc)] += 1
        found = []
        for fold in (0, 1):
            at = np.flatnonzero(seen[fold].sum(0))
            found += [(fold, int(p), at[at // PART == p], seen[fold][:, at[at // PART == p]].T) for p in np.unique(at // PART)]
        batch = _part_rows(found, 0)
        if batch is not None:
            yield batch

    seen = np.zeros((2, 2, SIZE))
    for fold, _, at, counts in _gathered(rows.mapInArrow(lean(run), _PARTS), 2, mean=False):
        seen[fold][:, at] = counts.T
    return seen


def _epoch(rows: DataFrame, learners: dict[int, Learner]) -> None:
    """Each shard learns from all its rows, beginning with the same weights; then their weights are averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(learners)  # some 10 MB, whatever the input

    def run(batches):
        shard, own = -1, None
        for batch in batches:
            for at, fold, label, doc in _rows(batch):
                if at != shard:
                    if own is not None and (done := _part_rows(own.results(), shard)) is not None:
                        yield done
                    shard, own = at, Replica(copy.deepcopy(shared.value))
                own.learn(doc, label, fold)
        if own is not None and (done := _part_rows(own.results(), shard)) is not None:
            yield done

    for k, part, at, means in _gathered(rows.mapInArrow(lean(run), _PARTS), DIM + 1, mean=True):
        _averaged(learners[k], part, at, means)
    shared.destroy()


def _logits(rows: DataFrame, learners: dict[int, Learner]) -> DataFrame:
    """Of each row the logit that the fold it isn't in gives it, in steps: (lang, toxic, step)."""
    shared = rows.sparkSession.sparkContext.broadcast({k: v.model for k, v in learners.items() if k < 2})

    def run(batches):
        for batch in batches:
            step = [_step(shared.value[1 - fold].logits(list(doc), np.array([0, doc.shape[1]]))[0]) for _, fold, _, doc in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(step, pa.int32())], names=["lang", "toxic", "step"])

    return rows.mapInArrow(lean(run), "lang string, toxic int, step int")


def _step(z: float) -> int:
    return int(np.rint(np.clip(z, -FAR, FAR) * STEPS))


def _calibrate(model: Model, y: np.ndarray, step: np.ndarray, n: np.ndarray) -> None:
    """Fit slope and shift to all rows: ``n`` of label ``y`` have their logit in ``step``."""
    z = step / STEPS
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, s = n * (p - y), n * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 0.01 * (a - 1), r.sum()])
        h = np.array([[(s * z * z).sum() + 0.01, (s * z).sum()], [(s * z).sum(), s.sum()]])
        move = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    model.slope, model.shift = max(float(a), 0.05), float(b)


def _thresholds(model: Model, counts: DataFrame) -> None:
    """Each language's best threshold by F1 over all its rows, where 10 of them have label 1."""
    grid = np.arange(0.1, 0.91, 0.05)
    z = F.lit(model.slope) * F.col("step") / STEPS + F.lit(model.shift)
    p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))
    over = [F.sum(F.when(p >= float(c), F.col(v)).otherwise(0)).alias(f"{v}{i}") for i, c in enumerate(grid) for v in ("n", "hits")]
    own = counts.filter("lang is not null").withColumn("hits", F.col("n") * F.col("toxic"))
    for r in own.groupBy("lang").agg(F.sum("hits").alias("hits"), *over).filter("hits >= 10").collect():
        f1 = [2 * r[f"hits{i}"] / max(1, r["hits"] + r[f"n{i}"]) for i in range(len(grid))]
        model.thresholds[r["lang"]] = float(grid[int(np.argmax(f1))])


def fit(texts: list[str], labels: np.ndarray, langs: list, seed: int = 7) -> Model:
    """Train on all texts as ``train`` does on one shard, in the order given; slope, shift and thresholds stay as they
    begin. ``langs`` is not looked at."""
    labels = np.asarray(labels, np.int64)
    docs = []
    for _, _, buckets, first in features(pa.array(texts, pa.string())):
        docs += [np.stack([b[i:j] for b in buckets]) for i, j in zip(first[:-1], first[1:], strict=True)]
    seen = np.zeros((2, SIZE))
    for doc, y in zip(docs, labels, strict=True):
        seen[y, np.unique(doc)] += 1
    learner = beginner(seen, np.bincount(labels, minlength=2), seed)
    for _ in range(EPOCHS if len(set(labels.tolist())) == 2 else 0):
        own = Replica({2: learner})
        for doc, y in zip(docs, labels, strict=True):
            own.learn(doc, int(y), 0)
        own.flush(2)
    return learner.model


def train_rows(column: str = "doc_id"):
    """Rows to learn from: the id's checksum isn't 2 modulo 4; rows without an id are never learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 != 2


def _known(allowed: DataFrame, count: int):
    """A filter of ids: true for all labelled ones and some 6 % of the others. Its bitmap has two bytes a label."""
    bits = -(-max(count, 1) * BITS_A_LABEL // PIECE) * PIECE
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    pieces = allowed.select((place + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():
        lo = (r["piece"] - 1) * PIECE // 8
        bitmap[lo : lo + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    shared = allowed.sparkSession.sparkContext.broadcast(bitmap)

    def known(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7)) & 1 == 1)

    return F.pandas_udf(known, "boolean")(place)


def _labelled(docs: DataFrame, allowed: DataFrame, count: int) -> DataFrame:
    """The documents that have a label: (shard, fold, lang, toxic, text), by shard and hash. Texts and labels meet in
    their shard, so texts move once. Repeated rows are learned from as often as they occur."""
    shards = max(1, -(-count // SHARD))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    text = F.coalesce("text", F.lit(""))
    allowed = allowed.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "toxic")
    found = docs.filter(train_rows()).filter(_known(allowed, count))
    found = found.select(shard, "doc_id", F.xxhash64("doc_id", text).alias("h"), "lang", text.alias("text"), F.lit(None).cast("int").alias("toxic"))
    both = found.unionByName(allowed.select(shard, "doc_id", "toxic"), allowMissingColumns=True).repartition(shards, "shard")
    both = both.withColumn("toxic", F.max("toxic").over(W.partitionBy("shard", "doc_id"))).filter("h is not null and toxic is not null")
    fold = F.pmod(F.shiftright("h", 32), F.lit(2)).cast("int").alias("fold")
    return both.sortWithinPartitions("shard", "h", "lang").select("shard", fold, "lang", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Fit on all labelled rows that may be learned from; ids that have both labels aren't learned from.

    Their words are written down as buckets, in shards. Counts of words, then each epoch, are made by tasks: every
    shard learns from all its rows and the shards' weights are averaged. Beside the model of all rows, two are learned
    from the rows of a fold each; slope, shift and thresholds by language come from the logits that every row gets from
    the fold it isn't in.
    """
    allowed = labels.filter(train_rows()).filter("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    allowed = allowed.filter("toxic = most").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    count = allowed.count()
    rows = written(_labelled(docs, allowed, count).mapInArrow(lean(_to_words), "shard int, fold int, lang string, toxic int, words binary"), "labelled")
    n = np.zeros((2, 2), np.int64)
    for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect():
        n[r["fold"], r["toxic"]] = r["n"]
    if not n.sum(0).all():
        return beginner(np.zeros((2, SIZE)), n.sum(0), seed).model
    seen = _presence(rows)
    learners = {2: beginner(seen.sum(0), n.sum(0), seed)}
    if n.all():
        learners |= {k: beginner(seen[k], n[k], seed) for k in (0, 1)}
    for _ in range(EPOCHS):
        _epoch(rows, learners)
    model = learners[2].model
    if n.all():
        counts = written(_logits(rows, learners).groupBy("lang", "toxic", "step").agg(F.count("*").alias("n")), "logits")
        got = counts.groupBy("toxic", "step").agg(F.sum("n").alias("n")).orderBy("toxic", "step").collect()
        _calibrate(model, *(np.array([r[c] for r in got], np.float64) for c in ("toxic", "step", "n")))
        _thresholds(model, counts)
    give_back()
    return model


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add a column ``out`` to documents, or replace it: the probability of label 1 from the whole text. Null texts
    count as empty."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches):
        for batch in batches:
            yield batch.append_column(out, pa.array(shared.value.scores(batch.column("text"))))

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(lean(run), ", ".join([*columns, f"`{out}` double"]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged): ``flagged`` goes by the threshold calibrated for the
    document's language, ``predicted`` by THRESHOLD for all. Empty and null texts get the score of no words; repeated
    rows score alike; texts of any length are scored whole; without usable labels every score is 0 or the share of
    label 1; no documents give no rows; other columns are not looked at."""
    model = train(docs, labels)
    rows = score(docs.select("doc_id", "lang", "text"), model).drop("text")
    named = [x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(v))]
    threshold = F.coalesce(F.create_map(*named)[F.col("lang")], F.lit(THRESHOLD)) if named else F.lit(THRESHOLD)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted, threshold, flagged."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
