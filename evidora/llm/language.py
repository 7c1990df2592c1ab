"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import LOWER, WORD_BYTE, binary_rows, fixed_binary, give_back, lean, slices
from .common import small_batches, table

BUCKETS, ORDERS = 2048, (1, 2, 3)
#: The bounded training sample: expected texts of each language, languages (the commonest), and texts of all together.
SAMPLE, LANGUAGES, TEXTS = 600, 200, 6000
UNKNOWN = "und"
#: Language families by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("az", "kk", "tr", "uz"),
}


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def counts(column: pa.Array):
    """For each run of rows: (first, beyond, unit vectors of square-rooted counts of hashed byte n-grams).

    Letters are lower-cased and whatever is no letter or digit counts as a blank. The counts are of the whole text.
    """
    clean = np.where(WORD_BYTE & ~((np.arange(256) >= 48) & (np.arange(256) <= 57)), LOWER, 32).astype(np.uint32)
    for lo, hi, data, at in slices(column, 1 << 19):
        x = clean[data]
        out = np.zeros((hi - lo, BUCKETS * len(ORDERS)), np.float32)
        gram = np.zeros(len(x), np.uint32)
        for k, order in enumerate(ORDERS):
            gram = (gram << np.uint32(8)) | np.roll(x, -k)
            bucket = ((gram * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int32)
            for i in range(hi - lo):
                end = at[i + 1] - order + 1
                if end > at[i]:
                    out[i, k * BUCKETS : (k + 1) * BUCKETS] = np.bincount(bucket[at[i] : end], minlength=BUCKETS)
        np.sqrt(out, out)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        yield lo, hi, out


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (and bias, last) of a linear SVM with squared hinge loss; classes weigh the same. y is 1, -1, or 0 for
    rows that don't take part. Nothing is copied for a fit."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        pull = c * y * slack
        g = -2 * np.append(pull @ x, pull.sum()).astype(np.float32) + strength * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class Model:
    """Family weights (one against the rest) and, in each family, weights of each pair of its languages."""

    families: dict = field(default_factory=dict)
    members: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence of each row: the weaker of the two decisions."""
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        names = sorted(self.members)
        lang, sure = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        if not names:
            return lang, sure
        margins = x @ np.stack([self.families[n] for n in names], 1) if len(names) > 1 else np.ones((len(x), 1), np.float32)
        best = margins.argmax(1)
        for k, name in enumerate(names):
            own = np.flatnonzero(best == k)
            langs = self.members[name]
            votes, sums = np.zeros((len(own), len(langs))), np.zeros((len(own), len(langs)))
            for (i, j), w in self.pairs[name].items():
                z = x[own] @ w
                votes[:, i] += z > 0
                votes[:, j] += z <= 0
                sums[:, i] += z
                sums[:, j] -= z
            at = (votes + 1e-3 * np.tanh(sums / max(1, len(langs)))).argmax(1) if len(own) else np.zeros(0, int)
            lang[own] = np.array(langs, object)[at]
            within = sums[np.arange(len(own)), at] / (len(langs) - 1) if len(langs) > 1 else np.full(len(own), 9.0)
            sure[own] = 1 / (1 + np.exp(-3 * np.minimum(margins[own, k], within)))
        return lang, sure


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Train on the count vectors of texts."""
    model = Model()
    if not len(x):
        return model
    langs_ = np.array(langs, object)
    fams = np.array([family(v) for v in langs], object)
    for name in sorted(set(fams)):
        model.members[name] = sorted(set(langs_[fams == name]))
        if len(set(fams)) > 1:
            model.families[name] = svm(x, np.where(fams == name, 1, -1).astype(np.float32))
        model.pairs[name] = {}
        own = model.members[name]
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                model.pairs[name][i, j] = svm(x, ((langs_ == own[i]).astype(np.float32) - (langs_ == own[j])).astype(np.float32))
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _vectors(batches):
    for batch in batches:
        for lo, hi, x in counts(batch.column("text")):
            keep = [batch.column(c).slice(lo, hi - lo) for c in ("lang", "h")]
            yield pa.RecordBatch.from_arrays([*keep, binary_rows(x.astype(np.float16))], names=["lang", "h", "x"])


def train(docs: DataFrame) -> Model:
    """Fit on a bounded sample of the documents that may be learned from.

    Languages are counted first, before anything moves; then each task takes a document where the hash of its id and
    text is below its language's quota over its count, so no language meets in one place. Counts of n-grams are taken
    in the tasks, of texts however long; the driver gets vectors of fixed size, TEXTS of them at most. Rows equal in
    id and text are one. Languages beyond the LANGUAGES commonest aren't learned.
    """
    allowed = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    found = allowed.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not found:
        return Model()
    quota = min(SAMPLE, max(1, TEXTS // len(found)))
    h = F.xxhash64("doc_id", "text")
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, quota / r["n"])) for r in found], "lang string, share double")
    place = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    chosen = allowed.select("lang", "text", h.alias("h")).join(F.broadcast(share), "lang").filter(place < F.col("share"))
    rows = chosen.select("lang", "h", "text").mapInArrow(lean(_vectors), "lang string, h long, x binary")
    rows = rows.groupBy("h").agg(F.min("lang").alias("lang"), F.first("x").alias("x")).orderBy("h").limit(TEXTS).toArrow()
    x = fixed_binary(rows.column("x").combine_chunks(), BUCKETS * len(ORDERS), np.float16).astype(np.float32)
    model = fit(x, rows.column("lang").to_pylist())
    del x, rows
    give_back()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score). Null texts and texts without a letter are ``und`` with score 0; so is all
    where no language was learned. Whole texts count, however long; repeated rows are judged alike, and of languages
    that tie the first by name is taken. No rows give no rows; other columns are not looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 25 KB for each pair of languages

    def run(batches):
        for batch in batches:
            lang, sure = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for lo, hi, x in counts(batch.column("text")):
                lang[lo:hi], sure[lo:hi] = shared.value.predict(x)
            none = ~batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            lang[none], sure[none] = UNKNOWN, 0
            keep = [batch.column(c) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(sure)], names=["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out().alias("held_out"), letters.alias("letters"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs, train(docs))
