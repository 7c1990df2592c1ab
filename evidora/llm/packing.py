"""Mixture-controlled packing: deficit round-robin over source queues, cut into sequences of a fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import LOWER, SPACE_BYTE, kept, lean, slices, word_hashes, word_spans
from .common import ROWS_PER_BUCKET, running_sum, running_total, source_key, table, written

LENGTH, END = 2048, 1
#: Sequences in a window in which the mixture is held.
WINDOW = 64
VOCABULARY = "word_bpe_49k.json"


class WordTokenizer:
    """Token ids of whole texts through a bounded cache of words.

    The vocabulary's rules lower-case, drop white space and never join across it, nor across the border of an ASCII
    letter and a comma or full stop; so ids of such words are independent of what stands around. Words are found and
    hashed for a whole batch at once, looked up in a table of 2^21 slots (some 100 MB with the ids), and only unseen ones go to the tokenizer.
    Texts with the opening of a special token's string are tokenized by themselves.
    """

    SLOTS, POOL = 21, 16_000_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.SLOTS, np.uint64)
        self.start = np.zeros(1 << self.SLOTS, np.int32)
        self.count = np.zeros(1 << self.SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _encode(self, words: list[bytes]) -> list:
        """Ids of each word. Plain words are joined by blanks and told apart by the tokens that close a word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        out: list = [None] * len(words)
        plain = [i for i, t in enumerate(texts) if t.isalpha() and max(t) < "ɐ" and "İ" not in t]
        for lo in range(0, len(plain), 256):
            part = plain[lo : lo + 256]
            ids = np.array(self.tokenizer.encode(" ".join(texts[i] for i in part), add_special_tokens=False).ids, np.uint16)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part):
                for i, a, b in zip(part, np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    out[i] = ids[a:b]
        odd = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(odd, self.tokenizer.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint16)
        return out

    def _cached(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool and count of ids for each word."""
        h = word_hashes(low, starts, ends) | np.uint64(1)
        slot = (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        other = ((h >> np.uint64(20)) & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)
        slot = np.where(self.keys[slot] == h, slot, other)
        hit = self.keys[slot] == h
        at, n = self.start[slot], self.count[slot]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            ids = self._encode([low[starts[i] : ends[i]].tobytes() for i in miss[first]])
            sizes = np.array([len(x) for x in ids], np.int32)
            begin = self.used + np.cumsum(sizes) - sizes
            self.used += int(sizes.sum())
            if self.used > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(self.used - len(self.pool), len(self.pool)), np.uint16)])
            if len(ids):
                self.pool[begin[0] : self.used] = np.concatenate(ids)
            at[miss], n[miss] = begin[back], sizes[back]
            one = (new >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            two = ((new >> np.uint64(20)) & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)
            place = np.where(self.keys[one] == 0, one, two)
            self.keys[place], self.start[place], self.count[place] = new, begin, sizes
            # where two new words met in one slot, the table holds one of them, whole
            own = self.keys[place] == new
            self.start[place[own]], self.count[place[own]] = begin[own], sizes[own]
        return at, n

    def __call__(self, column: pa.Array):
        """For each run of rows: (first row, beyond, ids, first id of each text and the end)."""
        for lo, hi, data, at in slices(column):
            low = LOWER[data]
            letter = (low >= 97) & (low <= 122)
            stop = (low == 44) | (low == 46)
            inside = ~SPACE_BYTE[data]
            starts, ends = word_spans(inside, at)
            # cut words where an ASCII letter meets a comma or full stop
            edge = np.flatnonzero((letter[:-1] & stop[1:] | stop[:-1] & letter[1:]) & inside[:-1] & inside[1:]) + 1
            edge = edge[~np.isin(edge, at)]
            starts = np.sort(np.concatenate([starts, edge]))
            ends = np.sort(np.concatenate([ends, edge]))
            if self.used > self.POOL:
                self.clear()
            begin, n = self._cached(low, starts, ends)
            total = int(n.sum())
            before = np.cumsum(n) - n
            ids = self.pool[np.repeat(begin - before, n) + np.arange(total)]
            edges = np.concatenate([before, [total]])[np.searchsorted(starts, at)]
            special = b"<|" in data.tobytes()
            if special:
                pieces = [ids[edges[i] : edges[i + 1]] for i in range(hi - lo)]
                for i in range(hi - lo):
                    text = data[at[i] : at[i + 1]].tobytes()
                    if b"<|" in text:
                        pieces[i] = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint16)
                edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                ids = np.concatenate(pieces)
            yield lo, hi, ids, edges


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so that later tasks find the words of earlier ones."""
    return kept(f"tokenizer {path}", lambda: WordTokenizer(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _tokens(path: str):
    """Each row's ids, two bytes each, and their number with the end token."""

    def run(batches):
        for batch in batches:
            for lo, hi, ids, edges in tokenizer(path)(batch.column("text")):
                raw = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                keep = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "tk", "skey")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(edges) + 1, pa.int64()), raw], names=["doc_id", "tk", "skey", "n", "tokens"])

    return run


def schedule(rows: DataFrame, window: int = LENGTH * WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """Place rows (skey, tk, doc_id, n, copies) in one stream of tokens: adds ``at``, the row's first token.

    Deficit round-robin in closed form: each window gives a source's queue its quantum, ``window`` tokens times its
    share, and what a queue can't use because its next document is longer stays as deficit for the next window. So a
    document is served in the first window by whose end the queue's quanta cover it: the running sum of its queue
    over the quantum, rounded up. Shares are those of all tokens, or ``weights`` by source; a queue that is
    exhausted leaves the windows to the rest.
    """
    rows = rows.withColumn("total", F.col("n") * F.col("copies"))
    count = rows.count()
    buckets = max(1, count // ROWS_PER_BUCKET)
    spread = F.shiftright(F.xxhash64("tk", "doc_id"), 1).bitwiseAND(F.lit((1 << 62) - 1))
    rows = rows.withColumn("spread", spread).withColumn("bucket", F.floor(F.col("spread") / (float(1 << 62) / buckets)))
    rows = running_sum(rows, ["skey"], "bucket", ["spread", "tk", "doc_id"], "total", "before")
    sums = rows.groupBy("skey").agg(F.sum("total").alias("source_total"))
    whole = sums.agg(F.sum("source_total")).first()[0] or 1
    share = F.col("source_total") / float(whole)
    if weights:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(f"s{k}"), F.lit(float(v)))])
        share = F.coalesce(named[F.col("skey")], share)
    quantum = F.greatest(F.lit(1.0), float(window) * share)
    rows = rows.join(sums.select("skey", quantum.alias("quantum")), "skey")
    turn = (F.ceil((F.col("before") + F.col("total")) / F.col("quantum")) - 1).cast("long")
    rows = rows.withColumn("turn", F.greatest(F.lit(0).cast("long"), turn))
    return running_total(rows, "turn", ["skey", "spread", "tk", "doc_id"], "total", "at").select("doc_id", "tk", "n", "copies", "at")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE_NAMES = [x.split()[0] for x in PIECE.split(", ")]


def _cuts(at: int, n: int, length: int, total: int) -> list[int]:
    """Where a document of ``n`` tokens from ``at`` is cut: at each sequence's end, and in the last, short stretch at
    the ends of powers of two, so that nothing is padded."""
    full = total // length * length
    cuts = list(range(at // length * length + length, min(at + n, full + 1), length))
    if at + n > full:
        place, left, size = full, total - full, length
        while left:
            size //= 2
            if left >= size:
                place, left = place + size, left - size
                if at < place < at + n:
                    cuts.append(place)
    return [at, *cuts, at + n]


def _pieces(length: int, total: int, ids: bool):
    full = total // length * length
    ends, place, size = [], full, length
    while place < total:
        size //= 2
        if total - place >= size:
            place += size
            ends.append(place)
    starts_of = np.array([full, *ends[:-1]] if ends else [full])

    def run(batches):
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            ats, copies = (batch.column(c).to_numpy() for c in ("at", "copies"))
            out: list[list] = [[] for _ in range(7 + ids)]
            for row, tokens in enumerate(batch.column("tokens")):
                own = np.append(np.frombuffer(tokens.as_buffer(), "<u2"), np.uint16(END)).astype("<u4")
                raw = memoryview(own).cast("B")
                n = len(own)
                for copy in range(int(copies[row])):
                    at = int(ats[row]) + copy * n
                    cuts = _cuts(at, n, length, total)
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        if a < full:
                            sequence, first = a // length, a // length * length
                        else:
                            k = int(np.searchsorted(starts_of, a, "right")) - 1
                            sequence, first = full // length + k, int(starts_of[k])
                        s = a - at
                        values = (doc_ids[row], s, b - a, zlib.crc32(raw[4 * s : 4 * (s + b - a)]), n, sequence, a - first)
                        for column, v in zip(out, values, strict=False):
                            column.append(v)
                        if ids:
                            out[7].append(own[s : s + b - a].tolist())
                    if len(out[0]) >= 20_000:
                        yield _batch(out, ids)
                        out = [[] for _ in range(7 + ids)]
            if out[0]:
                yield _batch(out, ids)

    return run


def _batch(out: list[list], ids: bool) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.int64()) for x in out[:7]]
    return pa.RecordBatch.from_arrays(arrays + ([pa.array(out[7], pa.list_(pa.int64()))] if ids else []), names=PIECE_NAMES + ["ids"] * ids)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, weights: dict[str, float] | None = None, ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset), and their token ids if asked for.

    Every token of every document, with an end token after it, lies in one piece. All sequences but the last few are
    full; the rest is cut at powers of two. Null and empty texts are the end token alone. Rows equal in id and text
    are placed one after another, each with pieces of its own; rows equal in id only are different documents. Null
    sources are a queue. No rows give no pieces.
    """
    path = path or default_vocabulary()
    rows = docs.select("doc_id", F.xxhash64("text", F.col("doc_id").isNull()).alias("tk"), source_key(F.col("source")).alias("skey"), F.col("text"))
    every = rows.mapInArrow(lean(_tokens(path), "tokenizer"), "doc_id long, tk long, skey string, n long, tokens binary")
    every = written(every, "tokens")  # texts are tokenized once; from here on only their ids move
    slim = every.groupBy("doc_id", "tk").agg(F.min("skey").alias("skey"), F.max("n").alias("n"), F.count("*").alias("copies"))
    plan = written(schedule(slim, weights=weights), "plan")
    total = plan.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0
    known = F.coalesce("doc_id", F.lit(0)).alias("id0")  # null ids differ from others in tk
    one = every.select(known, "tk", "tokens").groupBy("id0", "tk").agg(F.first("tokens").alias("tokens"))
    joined = one.join(plan.select(known, "doc_id", "tk", "at", "copies"), ["id0", "tk"])
    schema = PIECE + (", ids array<long>" if ids else "")
    return joined.select("doc_id", "tokens", "at", "copies").mapInArrow(lean(_pieces(length, total, ids)), schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
