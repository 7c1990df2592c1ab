"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import BYTE_CODE, SPACE_BYTE, lean, slices, word_hashes
from .common import row_of, shuffle_parts, table, whole_groups, written

#: A chunk may end behind a blank where the gear hash of the 16 bytes up to it meets CUT of 32 values, and does unless
#: it might have within the APART words before: every 6.8 words, and never after one or two, which would often repeat
#: by chance.
CUT, APART = 11, 2
#: Beyond so many bytes without a blank, any character may end a chunk, at a rate of 1 in 64.
NO_BLANK = 256
#: Scripts written without blanks: so many bytes after the last blank, a character of three bytes or more may end a
#: chunk, at a rate of 1 in 32.
NO_BLANK_WIDE = 48
#: Repeated chunks in a row are removed when they hold so many words together, or CHARS characters for each of these
#: words, half of them beyond ASCII.
LEAST_WORDS, CHARS = 16, 6
GEAR = (BYTE_CODE >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash (h << 1) + gear[byte] of it and the 15 before, by doubling the window."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all texts; a border depends on at most the 16 bytes and APART words before it and the run
    without blanks it lies in, so insertions elsewhere don't shift it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = gear_hashes(data)
    value = (h >> np.uint32(11)) & np.uint32(31)
    blank = SPACE_BYTE[data]
    cut = blank & (value < CUT)
    behind = blank.copy()
    behind[:-1] &= ~blank[1:]  # a run of blanks ends a chunk behind its last one only
    cut = np.flatnonzero(behind & cut)
    word, own = np.cumsum(behind, dtype=np.int64)[cut], np.searchsorted(at, cut, "right")
    alone = np.ones(len(cut), bool)
    alone[1:] = (word[1:] - word[:-1] > APART) | (own[1:] != own[:-1])
    kept, cut = cut[alone], np.zeros(n, bool)
    cut[kept] = True
    last = np.maximum.accumulate(np.where(blank, np.arange(n), -1))
    run = np.arange(n) - np.maximum(last, at[np.searchsorted(at, np.arange(n), "right") - 1]) if n > NO_BLANK_WIDE else np.zeros(n, np.int64)
    far, wide = run > NO_BLANK, run > NO_BLANK_WIDE
    if wide.any():
        lead = np.ones(n, bool)
        lead[:-1] = (data[1:] & 0xC0) != 0x80
        cut |= far & lead & ((h >> np.uint32(10)) & np.uint32(63) == 0)
        wide[2:] &= (data[:-2] >= 0xE0) | (np.concatenate([[0], data[:-3]]) >= 0xF0)
        cut |= wide & lead & (data >= 0x80) & ((h >> np.uint32(10)) & np.uint32(31) == 0)
    cut[at[1:][at[1:] > 0] - 1] = True
    return np.flatnonzero(cut) + 1


#: Ids of texts without one lie beyond all others; positions take 40 bits, beside 24 bits of the text's hash.
NO_ID = 1 << 62
POS_BITS = 40


def document_key(doc_id, text):
    """A never-null id: null ids take theirs from the text, so that they spread."""
    return F.coalesce(doc_id, F.lit(NO_ID).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1))))


def text_tag(text):
    return F.xxhash64(text).bitwiseAND(F.lit((1 << (63 - POS_BITS)) - 1))


def _chunks(batches):
    for batch in batches:
        column = batch.column("text")
        keys, tags = (batch.column(c).to_numpy() for c in ("did", "tag"))
        for lo, hi, data, at in slices(column):
            ends = chunk_ends(data, at)
            if not len(ends):
                continue
            starts = np.concatenate([[0], ends[:-1]])
            digest = word_hashes(data, starts, ends).view(np.int64)
            blank = SPACE_BYTE[data]
            word = ~blank
            word[1:] &= blank[:-1]
            begin = at[:-1][at[:-1] < len(data)]
            word[begin] = ~blank[begin]
            many = np.add.reduceat(word.astype(np.int64), starts)
            doc = np.searchsorted(at, starts, "right") - 1
            spot = (tags[doc + lo] << POS_BITS) | (starts - at[doc])
            size = ((ends - starts) << 32) | many
            beyond = np.add.reduceat((data >= 0xC0).astype(np.int32), starts)
            chars = np.minimum(2 * beyond, np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int32), starts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest, keys[doc + lo], spot, size, chars)], names=["digest", "did", "spot", "size", "chars"])


def _runs(least_words: int):
    def run(batches):
        for batch in whole_groups(batches, "did"):
            digest, did, spot, size, chars, owner = (batch.column(c).to_numpy() for c in ("digest", "did", "spot", "size", "chars", "owner"))
            fresh = np.ones(len(did), bool)  # rows equal in id and text repeat their chunks
            fresh[1:] = (did[1:] != did[:-1]) | (spot[1:] != spot[:-1])
            digest, did, spot, size, chars, owner = (x[fresh] for x in (digest, did, spot, size, chars, owner))
            order = np.lexsort((spot, digest, did))
            first = np.zeros(len(did), bool)
            first[order[0]] = True
            first[order[1:]] = (did[order[1:]] != did[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])
            take = ~(first & (owner == did))
            did, spot, size, chars, owner = (x[take] for x in (did, spot, size, chars, owner))
            if not len(did):
                continue
            begin = np.ones(len(did), bool)
            begin[1:] = (did[1:] != did[:-1]) | (spot[1:] != spot[:-1] + (size[:-1] >> 32))
            at = np.flatnonzero(begin)
            length, many = np.add.reduceat(size >> 32, at), np.add.reduceat(size & 0xFFFFFFFF, at)
            source = np.minimum.reduceat(owner, at)
            keep = (many >= least_words) | (np.add.reduceat(chars.astype(np.int64), at) >= CHARS * least_words)
            at = at[keep]
            values = (did[at], spot[at] >> POS_BITS, spot[at] & ((1 << POS_BITS) - 1), length[keep], many[keep], source[keep])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["did", "tag", "start", "length", "words", "owner"])

    return run


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(did, tag, doc_id, start, length, words, source_doc_id): byte spans of documents that repeat earlier text.

    Of each chunk, the document with the smallest id keeps its first occurrence; all others are repeats. Repeats that
    adjoin make a span, and spans of fewer than ``least_words`` words are left alone, unless they hold CHARS times as
    many characters, half of them beyond ASCII, as in scripts without blanks. ``tag`` is of the text's hash, for rows
    that share an id; rows equal in both are one document. Null and empty texts have no spans; null ids come
    last and are told apart by their texts. Digests are counted before they move, so a passage that a third of all
    documents share costs one row a task; joined back, it is split by size. An empty table gives no spans; columns
    beside doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.filter("text is not null").select(document_key(F.col("doc_id"), F.col("text")).alias("did"), text_tag(F.col("text")).alias("tag"), "text")
    chunks = written(rows.mapInArrow(lean(_chunks), "digest long, did long, spot long, size long, chars int"), "chunks")
    many = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min("did").alias("owner")).filter("n > 1").drop("n")
    many = written(many, "digests")  # then the join has a shuffle on both sides, and a hot digest is split
    found = chunks.join(many, "digest")
    parts = shuffle_parts(spark)
    found = found.repartition(parts, "did").sortWithinPartitions("did", "spot")
    spans = found.mapInArrow(lean(_runs(least_words)), "did long, tag long, start long, length long, words long, owner long")
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return spans.select("did", "tag", known("did").alias("doc_id"), "start", "length", "words", known("owner").alias("source_doc_id"))


def _cut(batches):
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        rows = batch.column("row")
        names = [f.name for f in rows.type]
        texts = rows.field(names.index("text")).to_pylist()
        out = []
        for text, own in zip(texts, spans, strict=True):
            if own:
                raw, at, parts = text.encode(), 0, []
                for s in sorted(own, key=lambda x: x["start"]):
                    parts.append(raw[at : s["start"]])
                    at = s["start"] + s["length"]
                text = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            out.append(text)
        columns = [pa.array(out, pa.string()) if name == "text" else rows.field(i) for i, name in enumerate(names)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents, with all their columns, and repeated spans cut out of their texts; ``n_chars`` follows. Documents
    stay, even empty."""
    spans = repeated_spans(docs, least_words).groupBy("did", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    keyed = docs.select(document_key(F.col("doc_id"), F.col("text")).alias("did"), text_tag(F.col("text")).alias("tag"), row_of(docs))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = keyed.join(spans, ["did", "tag"], "left").select("row", "spans").mapInArrow(lean(_cut), schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The spans of documents that repeat earlier text: doc_id, start, length, words, source_doc_id."""
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "start", "length", "words", "source_doc_id")
