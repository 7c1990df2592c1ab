"""Packing, toxicity, language ID and the pipeline."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidora.llm import language, packing, toxicity
from evidora.llm.queries import QUERIES


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


ODD = [
    "It's a dog's life, isn't it? 3.14 e.g. U.S.A.", "x<|endoftext|>y <|ENDOFTEXT|>", "a.b,c ..,d,.e", "\x1c\x85  weird  spaces \x0b", "İstanbul ÄÖÜ ẞ ﬁ", "e\u0301 a.\u0301b", "  ", "日本語 テキスト。", "😀😀 a😀b", "don't'll've 'S", "-- —, “quoted”.", "1,000.50a"]


def test_token_ids(plain, prose):
    texts = [*ODD, prose(300, 1), "", "a" * 3000]
    tok = packing.WordTokenizer(packing.default_vocabulary())
    for _ in range(2):  # from an empty cache and a full one
        got = [ids[edges[i] : edges[i + 1]].tolist() for _, _, ids, edges in tok(pa.array(texts)) for i in range(len(edges) - 1)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack(docs_frame, prose, plain):
    rng = np.random.default_rng(0)
    texts = [*ODD, None, "", *[prose(int(rng.integers(1, 900)), i) for i in range(60)], prose(30_000, 5), "same", "same"]
    ids = [*range(len(texts) - 2), 5000, 5000]
    sources = [["a", "b", None][i % 3] for i in range(len(texts))]
    out = packing.pack_documents(docs_frame(texts, sources, ids=ids), ids=True).toPandas()
    expected = sorted((i, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in zip(ids, texts, strict=True))
    for row in out.itertuples():
        assert row.length == len(row.ids) and row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
    doubled = out[out.doc_id == 5000].sort_values(["sequence_id", "offset"])
    assert doubled.length.sum() == 2 * doubled.doc_tokens.iloc[0]
    got = []
    for i, own in out[out.doc_id != 5000].groupby("doc_id"):
        own = own.sort_values("start")
        assert (own.start.to_numpy() == np.concatenate([[0], own.length.cumsum()[:-1]])).all()
        got.append((i, tuple(x for r in own.ids for x in r)))
    assert sorted(got) == [e for e in expected if e[0] != 5000]
    out = out.sort_values(["sequence_id", "offset"])
    sizes = out.groupby("sequence_id").length.sum()
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert sorted(sizes.index) == list(range(len(sizes)))
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes) and (sizes != 2048).sum() <= 11
    assert packing.pack_documents(docs_frame([])).count() == 0


def test_windows_hold_the_mixture(spark):
    rng = np.random.default_rng(1)
    rows = [("sa" if i % 4 else "sb", i, i, int(rng.integers(50, 400)), 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "skey string, tk long, doc_id long, n long, copies long")
    window = 20_000
    plan = packing.schedule(df, window).toPandas().merge(pd.DataFrame(rows, columns=["skey", "tk", "doc_id", "n_", "c"]), on=["doc_id", "tk"])
    plan = plan.sort_values("at")
    assert (plan["at"].to_numpy() == np.concatenate([[0], plan.n.cumsum()[:-1]])).all()
    share = plan[plan.skey == "sb"].n.sum() / plan.n.sum()
    for lo in range(0, int(plan.n.sum()) - 3 * window, 3 * window):
        own = plan[(plan["at"] >= lo) & (plan["at"] < lo + 3 * window)]
        assert own[own.skey == "sb"].n.sum() / own.n.sum() == pytest.approx(share, abs=0.04)


def test_toxicity_learns_and_scores_alike(docs_frame, spark, prose):
    texts, labels = [], []
    for i in range(1200):
        words = prose(80, i).split()
        toxic = i % 6 == 0
        if toxic:
            words[i % 70] = ["idiotix", "scumbo", "trashil"][i % 3]
        texts.append(" ".join(words))
        labels.append(int(toxic))
    ids = list(range(1200))
    docs = docs_frame([*texts, None, "", prose(50_000, 1)], ids=[*ids, 5000, 5001, None], langs=["en"] * 1202 + [None])
    lab = spark.createDataFrame([(i, 1, y) for i, y in zip(ids, labels, strict=True)], "doc_id long, quality int, toxic int")
    out = toxicity.judge(docs, lab).toPandas()
    assert len(out) == 1203 and out.score.between(0, 1).all()
    held = out[out.held_out & (out.doc_id < 1200)]
    assert all((zlib.crc32(str(int(i)).encode()) % 4 == 2) for i in held.doc_id)
    y = np.array([labels[int(i)] for i in held.doc_id])
    assert ((held.predicted == y).mean()) > 0.97
    assert not out[out.doc_id.isna()].held_out.any()
    empty = toxicity.judge(docs_frame(["a", None]), lab.limit(0)).toPandas()
    assert (empty.predicted == 0).all()


def test_pooling_matches_each_text_alone(prose):
    model = toxicity.fit([prose(30, i) for i in range(40)], np.arange(40) % 2, ["en"] * 40)
    texts = [prose(n, n) for n in (1, 2, 3, 50, 400)] + ["", "a"]
    whole = model.scores(pa.array(texts))
    alone = [model.scores(pa.array([t]))[0] for t in texts]
    assert np.allclose(whole, alone, atol=1e-6)


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op9_language"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    held = out[out.held_out].merge(docs, on="doc_id")
    assert (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all() and len(out) == len(docs)


def test_language_edges(docs_frame):
    texts = ["the cat and the dog"] * 40 + ["der Hund und die Katze"] * 40 + ["le chien et le chat"] * 40 + [None, "", "123 !!", "der Hund"]
    langs = ["en"] * 40 + ["de"] * 40 + ["fr"] * 40 + [None] * 4
    docs = docs_frame(texts, langs=langs)
    out = language.identify(docs, language.train(docs)).toPandas().set_index("doc_id")
    assert out.lang_pred[[120, 121, 122]].tolist() == ["und"] * 3 and out.lang_pred[123] == "de" and out.lang_pred[100] == "fr"
    nothing = docs_frame(["abc"], langs=[None])
    assert language.identify(nothing, language.train(nothing)).first()["lang_pred"] == "und"
    assert language.family("en") == language.family("de") != language.family("fr") and language.family("xx") == "xx"


def test_pipeline_stages_meet_odd_rows(spark, docs_frame, prose, tmp_path):
    """Nulls, empty and very long texts, repeated rows, no rows, and columns that are named like the stages' own."""
    import corpus_pipeline

    t = prose(120, 5)
    docs = docs_frame([None, None, "", " ", t, t, t, prose(20_000, 6), "x" * 20_000, prose(60, 7)], ids=[None, 1, 2, None, 4, 4, None, 7, 8, 9], sources=["a", None, "b", "a", "a", "a", None, "b", None, "b"])
    extra = ("_toxicity", "_key", "tk", "h", "_did", "spans", "taken", "row", "at", "size", "score")
    docs = docs.selectExpr("*", *[f"cast({k} as int) as {c}" for k, c in enumerate(extra)])
    spark.createDataFrame([(9, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns, name
            got = out.toPandas()
            assert all((got[c] == k).all() for k, c in enumerate(extra)), name
            assert len(got) == 0 if rows is not docs else len(got) > 0
        assert stage(spark, rows, str(tmp_path)).count() >= 0
        corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count()


def test_pipeline_against_plain_python(spark, docs_frame, prose, plain, tmp_path):
    """Each stage's rows against a plain version of it, on a small table with copies, toxic texts and repeats."""
    import random
    from collections import Counter

    import corpus_pipeline
    from evidora.llm import mixing, substring_dedup

    rng = random.Random(11)
    texts = [prose(rng.randint(40, 90), 300 + i) for i in range(60)]
    passage = prose(70, 999)
    for i in range(0, 12):
        texts[i] = f"{texts[i]} {passage} {prose(25, 700 + i)}"
    texts += [texts[20], texts[20], texts[21].replace(texts[21].split()[5], "other", 1)]
    texts[40:50] = [t + " scumbo idiotix" for t in texts[40:50]]
    sources = [["a", "b", None][i % 3] for i in range(len(texts))]
    docs = docs_frame(texts, sources)
    spark.createDataFrame([(i, 1, int("scumbo" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = model.scores(pa.array(texts))
    one = stages["toxicity"](spark, docs, str(tmp_path)).toPandas()
    assert sorted(one.doc_id) == [i for i in range(len(texts)) if score[i] < 0.3]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, group = {r.doc_id: shingles(r.text) for r in one.itertuples()}, {}
    for i in sorted(sets):  # the fixture's groups are cliques
        near = [j for j in sorted(group) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        group[i] = group[near[0]] if near else i
    two = stages["near_duplicates"](spark, spark.createDataFrame(one, docs.schema), str(tmp_path)).toPandas()
    assert sorted(two.doc_id) == sorted(set(group.values())) and len(two) < len(one)

    seen, expected = set(), {}
    chunks = {}
    for r in two.sort_values("doc_id").itertuples():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        ends = substring_dedup.chunk_ends(raw, np.array([0, len(raw)])).tolist()
        chunks[r.doc_id] = [raw[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    for i in sorted(chunks):
        repeat = [c in seen or c in chunks[i][:k] for k, c in enumerate(chunks[i])]
        out, k = b"", 0
        while k < len(repeat):
            end = k
            while end < len(repeat) and repeat[end] == repeat[k]:
                end += 1
            run = b"".join(chunks[i][k:end])
            out += b"" if repeat[k] and len(run.split()) >= substring_dedup.LEAST_WORDS else run
            k = end
        seen |= set(chunks[i])
        expected[i] = out.decode()
    three = stages["substring_dedup"](spark, spark.createDataFrame(two, docs.schema), str(tmp_path)).toPandas()
    assert dict(zip(three.doc_id, three.text, strict=True)) == expected and sum(len(t) for t in expected.values()) < two.text.str.len().sum()

    frame = spark.createDataFrame(three, docs.schema)
    plan = mixing.sample_plan(frame).toPandas()
    four = stages["mixing"](spark, frame, str(tmp_path)).toPandas()
    words = Counter()
    for r in four.itertuples():
        words[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in words.items() if n} == {r.doc_id: r.taken for r in plan.itertuples() if r.taken}

    five = stages["packing"](spark, spark.createDataFrame(four, docs.schema), str(tmp_path)).toPandas()
    assert five.length.sum() == sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in four.text)
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert whole.groupby("doc_id").length.sum().equals(five.groupby("doc_id").length.sum()) and set(whole.columns) >= set(key)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < out.doc_id.nunique() <= n
    sizes = out.groupby("sequence_id").length.sum()
    assert (sizes != 2048).sum() <= 11


def test_language_sample(docs_frame, prose):
    """A language of long texts only is learned; repeated rows, ids and clashing columns are harmless."""
    long = [" ".join(["der Hund und die Katze"] * 4000)] * 12
    docs = docs_frame(["the cat and the dog"] * 300 + long + [prose(30_000, 1)], langs=["en"] * 300 + ["de"] * 12 + [None], ids=[1] * 300 + list(range(100, 112)) + [None])
    docs = docs.selectExpr("*", "1 as share", "2 as h", "3 as x", "4 as score", "5 as letters")
    out = language.identify(docs, language.train(docs)).toPandas()
    assert len(out) == 313 and (out[out.doc_id >= 100].lang_pred == "de").all() and (out[out.doc_id == 1].lang_pred == "en").all()
    empty = docs_frame([])
    assert language.identify(empty, language.train(docs)).count() == 0 and language.train(empty).members == {}


def test_contradicting_labels(docs_frame, spark, prose):
    docs = docs_frame([prose(30, i) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    out = toxicity.judge(docs, labels).toPandas()
    assert (out.predicted == 0).all() and out.score.nunique() == 1
    clash = docs.selectExpr("*", "1 as threshold", "0.5D as score", "2 as h")
    scored = toxicity.score(clash, toxicity.train(clash, labels)).toPandas()
    assert scored.columns.tolist().count("score") == 1 and (scored.score < 0.3).all()
    assert toxicity.judge(docs_frame([]), labels).count() == 0


def test_packing_of_long_texts_and_clashing_columns(docs_frame, prose):
    docs = docs_frame([prose(60_000, 3), "a", None], ["s", None, "t"]).selectExpr("*", "1 as tk", "2 as at", "3 as n", "4 as skey", "5 as bucket")
    out = packing.pack_documents(docs).toPandas()
    assert set(out.doc_id) == {0, 1, 2} and out.groupby("doc_id").length.sum().equals(out.groupby("doc_id").doc_tokens.first())


def test_toxicity_learns_from_every_row(docs_frame, spark, prose, monkeypatch):
    """Words and languages that only rows beyond the first 1,500 of label 1, by hash, have are learned too; reruns in
    several shards agree."""
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 4 != 2]
    ids, plain_ids = ids[:1900], ids[1900:]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    late = {r["doc_id"] for r in frame.orderBy(F.xxhash64("doc_id"), "doc_id").collect()[1500:]}
    assert len(late) == 400
    texts = [prose(12, i) + (" vermonto" if i in late else " scumbo") for i in ids] + [prose(12, i) for i in plain_ids]
    langs = ["de" if i in late else "en" for i in ids] + ["de" if i % 2 else "en" for i in plain_ids]
    docs = docs_frame(texts, langs=langs, ids=[*ids, *plain_ids])
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(i, 0) for i in plain_ids], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 1024, raising=False)
    model, again = toxicity.train(docs, labels), toxicity.train(docs, labels)
    score = {word: model.scores(pa.array([f"{prose(12, 9000 + i)} {word}" for i in range(50)])) for word in ("vermonto", "scumbo", "")}
    assert (score["vermonto"] >= 0.3).mean() > 0.95 and (score["scumbo"] >= 0.3).mean() > 0.95 and (score[""] < 0.3).mean() > 0.95
    assert set(model.thresholds) == {"de", "en"}
    assert np.array_equal(model.embedding, again.embedding) and (model.slope, model.shift, model.thresholds) == (again.slope, again.shift, again.thresholds)


def test_toxicity_counts_every_row(docs_frame, spark, prose):
    """Presence counts are those of a plain loop over all rows of both folds, odd ones too."""
    texts = [None, "", "a", *[prose(20, i) for i in range(30)], prose(40_000, 1), "a"]
    docs = docs_frame(texts).selectExpr("cast(pmod(doc_id, 3) as int) as shard", "cast(pmod(doc_id, 2) as int) as fold", "lang", "cast(pmod(doc_id, 5) = 0 as int) as toxic", "coalesce(text, '') as text")
    rows = docs.mapInArrow(toxicity._to_words, "shard int, fold int, lang string, toxic int, words binary")
    seen, expected = toxicity._presence(rows), np.zeros((2, 2, toxicity.SIZE))
    for i, t in enumerate(texts):
        for _, _, buckets, _ in toxicity.features(pa.array([t], pa.string())):
            expected[i % 2, int(i % 5 == 0), np.unique(np.concatenate(buckets))] += 1
    assert np.array_equal(seen, expected)
