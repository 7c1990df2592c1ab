"""Near-duplicate joins, substring dedup and nearest neighbours, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from evidora.llm import ann, common, embedding_dedup, ngram_join, substring_dedup


def brute_components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    out = dict(common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect())
    assert all(out[i] == 0 for i in range(41)) and out[102] == out[101] == 100


def shingles_of(text):
    words = []
    for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).split():
        words.append("".join(c.lower() if ord(c) < 128 else c for c in w))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_near_duplicates(docs_frame, prose):
    rng = random.Random(2)
    texts = []
    for g in range(30):
        base = prose(rng.randint(20, 200), 1000 + g).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "zz" + str(rng.randint(0, 99))
            texts.append(" ".join(own))
    hot = prose(120, 7)
    texts += [hot] * 60 + [hot.replace(hot.split()[k], "new" + str(k), 1) for k in range(1, 80)]
    texts += [None, "", " ", "!!", "Two words", "two, words", "a", prose(30_000, 3), "ÄÖ ü ß é", "ÄÖ ü ß é"]
    sets = [shingles_of(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(texts))
    expected = brute_components(len(texts), pairs)
    out = ngram_join.near_duplicates(docs_frame(texts).repartition(5)).toPandas().sort_values("doc_id")
    assert out.n_links.tolist() == degree.tolist()
    assert out.class_id.tolist() == expected
    assert out[out.kept].doc_id.tolist() == sorted(set(expected))
    kept = ngram_join.without_near_duplicates(docs_frame(texts)).toPandas()
    assert sorted(kept.doc_id) == sorted(set(expected))


def test_rows_without_ids_and_repeated_rows(docs_frame, prose):
    a, b = prose(40, 1), prose(40, 2)
    docs = docs_frame([a, a, b, b, None, None], ids=[None, None, 5, 5, None, 7])
    out = ngram_join.near_duplicates(docs).toPandas()
    assert len(out) == 6 and sorted(out.n_links) == [0, 0, 1, 1, 1, 1]
    assert len(ngram_join.without_near_duplicates(docs).toPandas()) == 4
    assert ngram_join.near_duplicates(docs_frame([])).count() == 0


def test_jaccard_pairs_in_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(40)] + [np.zeros(0, np.uint64)]
    column = pa.array([s.tobytes() for s in sets], pa.binary())
    i, j = ngram_join.jaccard_pairs(column, None, 0.4)
    expected = {(a, b) for a, b in itertools.combinations(range(41), 2) if len(sets[a]) and len(sets[b]) and len(np.intersect1d(sets[a], sets[b])) >= 0.4 * len(np.union1d(sets[a], sets[b])) - 1e-3}
    assert {(a, b) for a, b in zip(i, j, strict=True)} - {(a, b) for a, b in zip(i, j, strict=True) if not len(sets[a])} == expected
    sides = np.arange(41) % 2
    a, b = ngram_join.jaccard_pairs(column, sides, 0.4)
    assert {tuple(sorted(x)) for x in zip(a, b, strict=True)} >= {x for x in expected if sides[x[0]] != sides[x[1]]}


def test_agreements():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (200, 64), dtype=np.uint8), rng.integers(0, 3, (200, 64), dtype=np.uint8)
    assert (ngram_join.agreements(a, b) == (a == b).sum(1)).all()


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 32))
    for i in range(80):
        x[100 + i] = x[i % 9] + rng.normal(size=32) * 0.15
    x[300:340] = x[5]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, [1.0, 2.0]), (905, [])]
    return x.astype(np.float32).astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_near_vectors(vectors):
    x, df = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    pairs = [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if near[i, j]]
    out = embedding_dedup.near_vectors(df).toPandas().sort_values("vec_id")
    good = out[out.vec_id < 900]
    degree = near.sum(1) - 1
    assert (good.n_links.to_numpy() <= degree).all() and good.n_links.sum() >= 0.97 * degree.sum()
    expected = brute_components(len(x), pairs)
    assert (good.component_id.to_numpy() == expected).mean() > 0.97
    odd = out[out.vec_id >= 900]
    assert (odd.n_links == 0).all() and (odd.component_id == odd.vec_id).all() and odd.kept.all()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(empty).count() == 0
    assert ann.nearest_neighbours(empty, empty).count() == 0


def test_nearest(vectors):
    x, df = vectors
    queries = df.filter("vec_id % 50 = 0")
    out = ann.nearest_neighbours(df, queries).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, own in out.groupby("query_id"):
        score = u @ u[q]
        score[q] = -2
        assert own.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        assert np.allclose(own.score, score[own.vec_id])
        best = np.sort(score)[::-1][:5]
        hits += (own.score.to_numpy() >= best[-1] - 1e-9).sum()
        total += 5
    assert len(out) == total == 50 and hits / total >= 0.9


def test_few_vectors_and_ties(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (50, [1.0, 0.0])], "vec_id long, embedding array<float>")
    out = ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0")).toPandas()
    assert out[out.query_id == 0].sort_values("rank").vec_id.tolist() == [3, 7, 50]
    assert out[out.query_id == 50].sort_values("rank").vec_id.tolist() == [0, 3, 7]


def covered(spans, doc, lo, hi):
    return sum(max(0, min(hi, s.start + s.length) - max(lo, s.start)) for s in spans[spans.doc_id == doc].itertuples()) / (hi - lo)


def test_repeated_passages(docs_frame, prose):
    passage = prose(60, 99)
    texts = [prose(150, i) for i in range(40)]
    at = {}
    for k, i in enumerate(range(5, 35, 3)):
        words = texts[i].split()
        head = " ".join(words[: 20 + k])
        texts[i] = head + " " + passage + " " + " ".join(words[20 + k :])
        at[i] = (len(head) + 1, len(head) + 1 + len(passage))
    texts += [None, "", "x" * 5000, "x" * 5000, prose(40_000, 12345)]  # one word, however long, is no passage
    docs = docs_frame(texts)
    spans = substring_dedup.repeated_spans(docs).toPandas()
    first = min(at)
    assert set(spans.doc_id) == set(at) - {first}
    assert all(covered(spans, i, *at[i]) > 0.5 for i in at if i != first) if len(spans) else False
    assert (spans.source_doc_id == first).all()
    cut = substring_dedup.without_repeats(docs).toPandas().set_index("doc_id")
    assert cut.columns.tolist() == [c for c in docs.columns if c != "doc_id"] and len(cut) == len(texts)
    for i in range(len(texts)):
        if i not in set(spans.doc_id):
            assert cut.text[i] == texts[i] or (texts[i] is None and cut.text[i] is None)
    i = max(at)
    assert cut.text[i].startswith(texts[i][: at[i][0]]) and len(cut.text[i]) < len(texts[i]) - 150 and cut.n_chars[i] == len(cut.text[i])


def test_chunks_resist_insertions(prose):
    a = prose(400, 1).encode()
    b = b"something else in front, " + a
    ends = [set(), set()]
    for k, raw in enumerate((a, b)):
        data = np.frombuffer(raw, np.uint8)
        ends[k] = set((substring_dedup.chunk_ends(data, np.array([0, len(raw)])) - k * (len(b) - len(a))).tolist())
    assert len(ends[0] & ends[1]) >= len(ends[0]) - 2 and len(ends[0]) > 30


def test_repeats_without_ids(docs_frame, prose):
    t = prose(80, 4)
    docs = docs_frame([t, t, t, t], ids=[None, None, 3, 3])
    spans = substring_dedup.repeated_spans(docs).toPandas()
    assert spans.doc_id.isna().all() and len(spans) == 1 and spans.source_doc_id.tolist() == [3]
    assert substring_dedup.repeated_spans(docs_frame([])).count() == 0


def test_repeats_in_scripts_without_blanks(docs_frame):
    def unspaced(n, seed, low=0x4E00, high=0x9FA5):
        return "".join(chr(random.Random(f"{seed} {i}").randint(low, high)) for i in range(n))

    passage, thai, whole = unspaced(250, "p"), unspaced(250, "t", 0x0E01, 0x0E30), unspaced(400, "w")
    texts = [unspaced(40, "a") + passage + unspaced(300, "b"), unspaced(333, "c") + passage, unspaced(50, "d", 0x0E01, 0x0E30) + thai, thai + unspaced(90, "e", 0x0E01, 0x0E30), whole, whole, unspaced(400, "f")]
    spans = substring_dedup.repeated_spans(docs_frame(texts)).toPandas()
    assert set(spans.doc_id) == {1, 3, 5}
    for doc, part in ((1, passage), (3, thai), (5, whole)):
        lo = len(texts[doc][: texts[doc].index(part)].encode())
        assert covered(spans, doc, lo, lo + len(part.encode())) > 0.5
    cut = substring_dedup.without_repeats(docs_frame(texts)).toPandas().set_index("doc_id").text
    assert cut[5] == "" and cut[6] == texts[6] and cut[1].startswith(texts[1][:333]) and "\ufffd" not in "".join(cut)


def test_kept_rows_are_shuffled_once(spark, docs_frame, prose):
    """Whole rows move once, whether the join or the search for equal rows asks for it; no id is not the id 0."""
    a, b, c = (prose(40, i) for i in range(3))
    docs = docs_frame([a, a, b, b, c, None, None, None], ids=[None, 0, None, None, 0, None, None, 0])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on a large table

    def moves(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        whole = plan.nodeName() in ("Exchange", "BroadcastExchange") and "text:string" in plan.schema().simpleString()
        return whole + sum(map(moves, below))

    try:
        kept = ngram_join.without_near_duplicates(docs)
        assert moves(kept._jdf.queryExecution().executedPlan().initialPlan()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = [(None if r.doc_id is None else int(r.doc_id), r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(0, a), (None, b), (0, c), (None, None), (0, None)], key=str)


def test_classes_without_ids_or_of_one_id(docs_frame, prose):
    a, b, c, d = (prose(60, i) for i in range(21, 25))
    near = lambda t: t.replace(t.split()[7], "other", 1)
    docs = docs_frame([a, near(a), b, b, c, near(c), d, near(d)], ids=[None, None, None, None, 5, 5, 5, 6])
    out = ngram_join.near_duplicates(docs).toPandas()
    assert (out.n_links == 1).all() and out.class_id.dropna().tolist() == [5, 5, 5, 5]
    kept = ngram_join.without_near_duplicates(docs).toPandas().text.tolist()
    assert len(kept) == 4 and [len({x, near(x)} & set(kept)) for x in (a, b, c, d)] == [1, 1, 1, 1]
    marked = out[out.kept][["doc_id", "tk"]].drop_duplicates()
    assert len(marked) == 4


def test_recall_in_a_dense_cloud(spark):
    """Planted pairs just above the limit, in a cloud whose buckets split; by formula, and against brute force."""
    near = embedding_dedup.together((2 * 0.05) ** 0.5)
    for n, rounds in ((10**4, 4), (10**6, 6)):
        lines, tables = embedding_dedup.tables_for(n)
        stay = 1 - (1 - near**embedding_dedup.SPLIT_LINES) ** embedding_dedup.SPLITS
        assert 1 - (1 - near**lines * stay**rounds) ** tables >= embedding_dedup.RECALL
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(0.88 * unit(rng.normal(size=48)) + 0.475 * unit(rng.normal(size=(3000, 48))))
    side = rng.normal(size=(600, 48))
    side = unit(side - (side * x[:600]).sum(1, keepdims=True) * x[:600])
    x = np.concatenate([x, 0.952 * x[:600] + (1 - 0.952**2) ** 0.5 * side])
    out = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    degree = (x @ x.T >= 0.95).sum(1) - 1
    assert (out.n_links.to_numpy() <= degree).all()
    share = out.n_links.sum() / degree.sum()
    print("share of links", share, "of", degree.sum())
    assert share >= 0.97


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, [2.0, 0.01]), (4, [0.0, 1.0]), (None, [0.0, 2.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as path", "3 as low")
    out = embedding_dedup.near_vectors(df).toPandas()
    assert len(out) == 7 and out[out.vec_id.isin([1, 3])].n_links.tolist() == [1, 1]
    assert sorted(out[out.vec_id == 4].n_links) == [1, 1] and out[out.vec_id == 6].n_links.tolist() == [0]
    assert out[out.vec_id == 3].component_id.tolist() == [1] and out[out.vec_id == 2].component_id.tolist() == [2]


def test_neighbours_tie_across_the_last_place(spark):
    rows = [(i, [1.0, 0.0]) for i in (1, 9, 11, 13, 15)] + [(5, [2.0, 0.0]), (50, [1.0, 0.5]), (100, [1.0, 2.0, 3.0]), (101, [2.0, 4.0, 6.1]), (None, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as key")
    out = ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0")).toPandas().sort_values(["query_id", "rank"])
    assert out[out.query_id == 50].vec_id.tolist() == [1, 5, 9, 11, 13] and out[out.query_id == 100].vec_id.tolist() == [101]


def test_cells_that_grow_on(spark, monkeypatch):
    """A forest of several levels, with hot cells in blocks, finds what brute force finds."""
    monkeypatch.setattr(ann, "SAMPLE", 256)
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[:500] = x[0] * rng.integers(1, 6, (500, 1))  # one direction, which no plane splits
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), cell_rows=40).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, own in out.groupby("query_id"):
        score = u @ u[q]
        score[q] = -2
        hits += (own.score.to_numpy() >= np.sort(score)[-5] - 1e-9).sum()
        assert len(own) == 5 and np.allclose(own.score, score[own.vec_id])
    assert out.query_id.nunique() == 60 and hits / 300 >= 0.9


def test_buckets_in_blocks(spark, monkeypatch):
    """Buckets beyond a block are compared in tasks of two blocks each, and nothing is lost."""
    from evidora.llm import near_links

    monkeypatch.setattr(near_links, "BLOCK", 8)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(20, 24)), 20, axis=0) + 0.02 * rng.normal(size=(400, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = embedding_dedup.near_vectors(df).toPandas().sort_values("vec_id")
    assert out.n_links.tolist() == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def test_clashing_columns_and_empty_tables(docs_frame, prose):
    docs = docs_frame([prose(80, 1), prose(80, 1), prose(80, 2)]).selectExpr("*", "1 as _key", "2 as tk", "3 as _did", "4 as _tag", "5 as _spans", "6 as row", "7 as id", "8 as kept_id")
    for f, n in ((ngram_join.without_near_duplicates, 2), (substring_dedup.without_repeats, 3)):
        out = f(docs)
        assert out.columns == docs.columns and out.count() == n
        assert out.select("_key", "tk", "row", "kept_id").distinct().collect() == [(1, 2, 6, 8)]
        assert f(docs_frame([])).count() == 0
