"""Worked cases of single operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidora.config import Settings
from evidora.functions import scores, text, vectors
from evidora.operators import clusters, evaluate, graph, pack, resolution, search
from evidora.sources import store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_settings_from_environment():
    s = Settings.from_env({"TOKEN_BUDGET": "100", "SHADOW_ENABLED": "false", "RWR_RESTART": "0.2"})
    assert (s.token_budget, s.shadow_enabled, s.rwr_restart, s.beam_max) == (100, False, 0.2, 16)


def test_minmax_score_order(spark):
    data = [("q", "A", 0.60, 0.02, True), ("q", "B", 0.58, 0.15, False), ("q", "C", 0.50, 0.01, False)]
    out = pack.cited(pack.scored(spark.createDataFrame(data, "query_id string, id string, cos double, mass double, linked boolean"), 0.48))
    assert [r["id"] for r in out.orderBy("citation").collect()] == ["B", "A", "C"]


def test_minmax_edges(spark):
    for given, expected in (([3.0, 5.0], [0.0, 1.0]), ([2.0, 2.0, 2.0], [0.5] * 3), ([7.0], [0.5])):
        df = spark.createDataFrame([("q", x) for x in given], "query_id string, x double")
        assert sorted(r["n"] for r in scores.minmax(df, "x", "n").collect()) == expected


def test_entropy_and_routing(spark):
    data = [("a", 0.5), ("a", float("nan")), ("a", -1.0), ("a", 0.5), ("b", 1.0), ("b", 0.0), ("b", 0.0)]
    got = dict(rows(scores.normalized_entropy(spark.createDataFrame(data, "query_id string, p double")), "query_id", "globality"))
    assert got == {"a": pytest.approx(1.0), "b": 0.0}
    g = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (0.35,), (0.65,)], "g double")
    regime, depth, beam = scores.routing(F.col("g"))
    out = g.select(regime.alias("r"), depth.alias("d"), beam.alias("b")).collect()
    assert [tuple(r) for r in out] == [("local", 1, 4), ("global", 3, 16), ("local", 1, 4), ("mixed", 2, 8), ("mixed", 2, 11)]


def test_gate_keeps_the_best_chunk_and_clusters(spark):
    seeds = spark.createDataFrame([("q", "TextChunk", "a", 0.2), ("q", "TextChunk", "b", 0.2), ("q", "Cluster", "k", 0.1), ("q", "Entity", "e", 0.1), ("p", "TextChunk", "c", 0.5), ("p", "TextChunk", "d", 0.54)], "query_id string, label string, id string, similarity double")
    assert rows(search.gated(seeds, 0.54), "query_id", "id") == [("p", "d"), ("q", "b"), ("q", "k")]
    assert search.gated(seeds, 0).count() == 6


def test_rrf_ties_by_id(spark):
    lists = spark.createDataFrame([("q", "y", 1), ("q", "x", 1)], "query_id string, id string, rank int")
    assert [r["id"] for r in scores.ranked(scores.rrf(lists), "score").orderBy("rank").collect()] == ["x", "y"]


@pytest.mark.parametrize(("pools", "expected"), [(("core", "anchor"), [0.5, 0.5]), (("core", "anchor", "cluster"), [0.15, 0.425, 0.425]), (("cluster",), [1.0]), (("core", "cluster"), [0.15, 0.85])])
def test_pools(spark, pools, expected):
    data = [("q", p, "L", p, 0.4) for p in pools]
    out = search.pool_merge(spark.createDataFrame(data, "query_id string, pool string, label string, id string, similarity double"))
    assert sorted(r["mass"] for r in out.collect()) == [pytest.approx(x) for x in expected]


def test_shadow_sum(spark):
    hits = spark.createDataFrame([("q", "c1", 0.8), ("q", "c2", 0.4)], "query_id string, id string, similarity double")
    edges = spark.createDataFrame([("e1", "c1", 1.0), ("e1", "c2", 0.5)], "entity_id string, chunk_id string, confidence double")
    assert search.shadow_from_chunks(hits, edges).first()["s1"] == pytest.approx(0.8 + 0.4 * 0.5)


def test_arcs_take_the_larger(spark):
    arcs = spark.createDataFrame([("q", "a", "b", 0.5), ("q", "b", "a", 0.9), ("q", "a", "a", 1.0), ("q", "a", "c", float("nan"))], "query_id string, source string, target string, weight double")
    assert rows(graph.build_arcs(arcs), "source", "target", "weight") == [("a", "b", 0.9), ("b", "a", 0.9)]


def test_walk_on_two_nodes():
    p = 0.15
    moves = pd.DataFrame({"source": ["a", "b"], "target": ["b", "a"], "p": [1.0, 1.0]})
    out = graph.walk(moves, pd.DataFrame({"id": ["a", "b"], "r": [1.0, 0.0]}), p).set_index("id")["mass"]
    assert out["a"] == pytest.approx(p / (1 - (1 - p) ** 2), abs=0.05)
    assert out.sum() == pytest.approx(1.0)


def test_idle_nodes_stay(spark):
    nodes = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "query_id string, id string")
    arcs = spark.createDataFrame([("q", "a", "b", 1.0), ("q", "b", "a", 1.0)], "query_id string, source string, target string, weight double")
    assert ("c", "c", 1.0) in rows(graph.transitions(nodes, arcs), "source", "target", "p")


def test_expansion_keeps_the_beam(spark):
    seeds = spark.createDataFrame([("q", "e1", "Entity")], "query_id string, id string, label string")
    params = spark.createDataFrame([("q", 1, 2)], "query_id string, depth int, beam int")
    sourced = spark.createDataFrame([("e1", "c1", 0.9), ("e1", "c2", 0.8), ("e1", "c3", 0.7)], "entity_id string, chunk_id string, confidence double")
    member_of = spark.createDataFrame([], "node_id string, node_label string, cluster_id string, probability double")
    edges, members = spark.createDataFrame([], "id string, weight double"), spark.createDataFrame([], "hyperedge_id string, node_id string")
    nodes, arcs = graph.expand(seeds, params, sourced, member_of, edges, members, 1)
    assert rows(nodes, "id") == [("c1",), ("c2",), ("e1",)]
    assert arcs.count() == 2
    lit = [F.lit(x) for x in (4, 1, 1, 16, 3, 10)]
    assert tuple(spark.range(1).select(graph.ceiling(*lit[:3]), graph.ceiling(*lit[3:])).first()) == (25, 202)
    with pytest.raises(Exception, match="ceiling"):
        graph.guarded(spark.createDataFrame([("q", str(i)) for i in range(9)], "query_id string, id string"), spark.createDataFrame([("q", "0")], "query_id string, id string"), spark.createDataFrame([("q", 1, 1)], "query_id string, depth int, beam int")).count()


def test_hyperedges_drop_remainders(spark):
    data = [(f"c{i}", "d", "S/x" if i < 5 else "", i) for i in range(7)]
    chunks = spark.createDataFrame(data, "id string, doc_id string, section_path string, position long")
    assert rows(graph.section_hyperedges(chunks, 2)[0], "run", "size") == [(0, 2), (1, 2)]
    assert graph.proximity_hyperedges(chunks, 3)[1].count() == 6


def test_cooccurrence_order(spark):
    data = [("c", "b", 5), ("c", "a", 3), ("c", "a", 9), ("x", "a", 0)]
    edges, members = graph.cooccurrence(spark.createDataFrame(data, "chunk_id string, entity_id string, position int"))
    assert edges.count() == 1 and rows(members, "rank", "node_id") == [(0, "a"), (1, "b")]


def test_knapsack_skips_and_rejects():
    data = pd.DataFrame({"id": ["a", "b", "c", "d"], "score": [0.9, 0.8, 0.7, 0.6], "token_count": [60, 50, 40, 0], "embedding": [[1.0, 0], [0, 1.0], [1.0, 0.01], [0, 1]]})
    assert data.loc[pack.pick(data, 100, 0.95), "id"].tolist() == ["a"]
    assert data.loc[pack.pick(data, 110, 1.0), "id"].tolist() == ["a", "b"]


def test_source_header(spark):
    df = spark.createDataFrame([(1, None, None, None, 0, 5), (2, "d", 3, None, 1, 2), (3, "d", 3, 4, 1, 2)], "c int, d string, a int, b int, s int, e int")
    out = [r[0] for r in df.orderBy("c").select(pack.source_header(*[F.col(x) for x in "cdabse"])).collect()]
    assert out == ["[1] (doc_id=unknown, pages=?, offsets=0-5)", "[2] (doc_id=d, pages=3-3, offsets=1-2)", "[3] (doc_id=d, pages=3-4, offsets=1-2)"]


def test_cluster_arithmetic(spark):
    n = spark.createDataFrame([(10_000,), (100,), (0,), (40_001,)], "n long")
    assert [r[0] for r in n.select(clusters.min_cluster_size(F.col("n"))).collect()] == [50, 15, 15, 100]
    assert n.select(clusters.min_cluster_size(F.col("n"), 7)).first()[0] == 7
    data = [("n", i, p) for i, p in enumerate([0.10, 0.40, 0.40, 0.05, float("nan")])]
    out = clusters.top_memberships(spark.createDataFrame(data, "node_id string, label int, probability double"))
    assert rows(out, "rank", "label", "probability") == [(0, 1, 0.40), (1, 2, 0.40)]
    assert clusters.jaccard_of(set(), set()) == 1.0


def test_remap_keeps_and_deprecates():
    taken, new, gone = clusters.remap([("a", 0, 0.9, 0.1), ("b", 0, 0.4, 0.9), ("b", 1, 0.1, 0.86), ("c", 2, 0.1, 0.2)], ["a", "b", "c"], [0, 1, 2])
    assert taken == {0: "a", 1: "b"} and new == [2] and gone == ["c"]


def test_refit_decision(spark):
    status = spark.createDataFrame([(f"c{i}", "CLUSTERED") for i in range(10)], "chunk_id string, stage string")
    placed = spark.createDataFrame([(f"c{i}",) for i in range(8)], "node_id string")
    assert clusters.refit_decision(status, placed, 10).first()["decision"] == "none"
    assert clusters.refit_decision(status, placed.limit(7), 10).first()["decision"] == "noise"
    assert clusters.refit_decision(status, placed, 7).first()["decision"] == "growth"


def test_names_and_contexts(spark):
    df = spark.createDataFrame([("  IL-6 (–Receptor) ", "abc" * 300 + "needle" + "x" * 300)], "n string, t string")
    r = df.select(text.clean_string(F.col("n")).alias("c"), text.context_window(F.col("t"), F.lit("NEEDLE")).alias("w"), text.normalize_heading(F.lit("**Café** — Notes:")).alias("h")).first()
    assert r["c"] == "il-6 receptor" and len(r["w"]) == 400 and "needle" in r["w"] and r["h"] == "cafe - notes"


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_resolution_bands(spark):
    def v(angle):
        return [math.cos(angle), math.sin(angle)]

    known = spark.createDataFrame([("k1", "h1", "DRUG", v(0.0)), ("k2", "h2", "GENE", v(1.2))], "id string, name_hash string, entity_type string, embedding array<double>")
    data = [("c1", 0, "a", "DRUG", "h1", v(0.9)), ("c1", 1, "b", "DRUG", "hb", v(math.acos(0.95))), ("c2", 0, "c", "DRUG", "hc", v(-math.acos(0.85))), ("c2", 1, "d", "DRUG", "hd", v(1.2)), ("c3", 0, "d", "DRUG", "hd", v(1.2))]
    mentions = spark.createDataFrame(data, "chunk_id string, position int, name string, entity_type string, name_hash string, embedding array<double>")
    out = rows(resolution.resolve(mentions, known), "chunk_id", "position", "outcome", "entity_id")
    assert out == [("c1", 0, "EXACT", "k1"), ("c1", 1, "AUTO_MERGE", "k1"), ("c2", 0, "PROVISIONAL", "hc"), ("c2", 1, "NEW", "hd"), ("c3", 0, "EXACT", "hd")]


def test_resolution_against_one_after_another(spark):
    """Groups of connected names give what a plain loop over all names and entities gives."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 160)] + 0.35 * rng.normal(size=(160, 6))
    kinds = [("DRUG", "GENE")[i] for i in rng.integers(0, 2, 160)]
    known = [(f"k{i}", f"hk{i}", kinds[i], x[i].tolist()) for i in range(20)]
    new = [(f"c{i:03d}", 0, f"n{i}", kinds[i], f"h{i}", x[i].tolist()) for i in range(20, 160)]
    out = resolution.resolve(spark.createDataFrame(new, "chunk_id string, position int, name string, entity_type string, name_hash string, embedding array<double>"), spark.createDataFrame(known, "id string, name_hash string, entity_type string, embedding array<double>"), 3, 0.95, 0.85)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    entities = [(i, k, unit(v)) for i, _, k, v in known]
    expected = []
    for chunk, _, _, kind, h, v in new:
        near = sorted((-float(e @ unit(v)), i, k) for i, k, e in entities)[:3]
        best = next((n for n in near if n[2] == kind and -n[0] >= 0.85), None)
        outcome = "NEW" if best is None else "AUTO_MERGE" if -best[0] >= 0.95 else "PROVISIONAL"
        expected.append((chunk, outcome, best[1] if outcome == "AUTO_MERGE" else h))
        if outcome != "AUTO_MERGE":
            entities.append((h, kind, unit(v)))
    assert {e[1] for e in expected} == {"NEW", "AUTO_MERGE", "PROVISIONAL"}
    assert rows(out, "chunk_id", "outcome", "entity_id") == expected


def test_vectors_that_are_not_finite_take_no_part(spark):
    x = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [float("nan"), 1.0]), ("c", [float("inf"), 0.0]), ("d", [2.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [3.0])], "query_id string, embedding array<double>")
    assert rows(search.vector_topk(x, q, 5), "query_id", "id") == [("1", "a"), ("2", "d")]


def test_unit_vectors_and_persistence(spark):
    df = spark.createDataFrame([(0, "a", [3.0, 4.0]), (0, "b", [0.0, 5.0]), (1, "c", [1.0, 0.0])], "cluster_id int, id string, embedding array<double>")
    assert df.select(vectors.l2_normalized(F.col("embedding"))).first()[0] == [0.6, 0.8]
    got = dict(rows(clusters.persistence(df), "cluster_id", "persistence"))
    assert got[1] == pytest.approx(1.0) and got[0] == pytest.approx(math.hypot(0.6, 1.8) / 2)


def test_adjudication(spark):
    e = spark.createDataFrame([("k", "Insulin", "h1", "DRUG", ["ins"], 3, False), ("p", "insuline", "h2", "DRUG", [], 1, True)], "id string, canonical_name string, name_hash string, entity_type string, aliases array<string>, mention_count int, provisional boolean")
    merges = spark.createDataFrame([("p", "k", "Insulin")], "provisional_id string, candidate_id string, canonical_name string")
    row = resolution.merged_entities(e, merges).first()
    assert row["id"] == "k" and set(row["aliases"]) == {"ins", "insuline", "Insulin"} and row["mention_count"] == 3 and not row["provisional"]
    edges = spark.createDataFrame([("k", "c1"), ("p", "c1"), ("p", "c2")], "entity_id string, chunk_id string")
    assert rows(resolution.merged(edges, merges.drop("canonical_name"), "entity_id", ["entity_id", "chunk_id"]), "entity_id", "chunk_id") == [("k", "c1"), ("k", "c2")]
    tasks = spark.createDataFrame([("t", "p", "PENDING", None)], "id string, provisional_id string, status string, reason string")
    refused = spark.createDataFrame([("t", "p", "different")], "id string, provisional_id string, reason string")
    entities, tasks = resolution.rejected(e, tasks, refused)
    assert tasks.first()["status"] == "REJECTED" and not any(r["provisional"] for r in entities.collect())


def test_payload_errors_are_kept(spark):
    chunks = spark.createDataFrame([("c1", "h1", "ok"), ("c2", "h2", "bad")], "id string, content_hash string, text string")

    def call(t):
        if t == "bad":
            raise ValueError("x" * 900)
        return "{}"

    out = {r["chunk_id"]: r for r in resolution.extracted(chunks, call).collect()}
    assert out["c1"]["payload"] == "{}" and len(out["c2"]["error"]) == 500


def test_upsert_keeps_what_is_not_listed(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("b", None), ("c", 9)], "id string, n int")
    assert sorted(map(tuple, store.upserted(old, new, "id").collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 9, None)]


def test_gold_checks(spark):
    schema = "id string, type string, question string, reference_answer string, relevant_chunk_ids array<string>, doc_id string, tags array<string>, pair_of string, notes string"
    data = [("e1", "exact", "q", "", ["c1"], None, [], None, ""), ("p1", "paraphrase", "q", "", ["c2"], None, [], "e1", ""), ("n1", "negative", "q", "", ["c9"], None, [], None, ""), ("m1", "multi", "q", "", ["c1"], None, [], None, "")]
    found = evaluate.gold_problems(spark.createDataFrame(data, schema), spark.createDataFrame([("c1",), ("c2",)], "id string"), {"exact": 1, "paraphrase": 1, "negative": 1, "multi": 2})
    assert {r["problem"] for r in found.collect()} == {"count of type", "negative with chunks", "multi with fewer than two", "unknown chunk", "twin differs"}


def test_sweep_confirms_the_best():
    out = evaluate.sweep(evaluate.grid(a=[1, 2], b=[0, 1]), lambda p: p["a"] - p["b"], lambda p: p["a"] * 100)
    assert out["best"] == {"a": 2, "b": 0} and out["confirmed"] == 200 and len(out["rows"]) == 4


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    q = df.limit(10).withColumnRenamed("id", "query_id")
    monkeypatch.setattr(search, "QUERY_BYTES", 200)
    got = rows(search.vector_topk(df, q, 4), "query_id", "id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(u[:10] @ u.T), axis=1)[:, :4]
    assert got == sorted((str(i), str(j)) for i in range(10) for j in near[i])


def test_hybrid_keeps_keyword_hits_beyond_dense(spark):
    x = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0]), ("d", None), ("e", [1.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 2.0])], "query_id string, embedding array<double>")
    dense = search.vector_topk(x, q, 1)
    keyword = spark.createDataFrame([("1", "c", 1), ("1", "d", 2), ("1", "b", 3), ("1", "e", 4)], "query_id string, id string, rank int")
    out = search.hybrid_hits(dense, keyword, 4, x, q, 60)
    assert [(a, b, round(c, 9), r) for a, b, c, r in rows(out, "query_id", "id", "similarity", "rank")] == [("1", "a", 1.0, 1), ("1", "b", 0.8, 4), ("1", "c", 0.0, 2), ("2", "c", 1.0, 1)]
    assert rows(search.hybrid_hits(dense, keyword, 2, x, q, 60).filter("query_id = '1'"), "id", "rank") == [("a", 1), ("c", 2)]


def test_greedy_remap_takes_all_pairs(spark, tmp_path):
    from evidora.plans.queries import QUERIES

    n = 1600 * 7
    made = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), (F.col("id") / 7).cast("int").alias("label"))
    made.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    out = QUERIES["greedy_remap"](spark, f"file://{tmp_path}").collect()
    assert {r["id"] for r in out if r["id"] is not None} == {str(i) for i in range(1600)}


def test_heading_keys_take_whole_texts(spark, tmp_path):
    from evidora.plans.queries import QUERIES

    same = "word " * 30
    spark.createDataFrame([(1, same + "One."), (2, same + "two")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert rows(QUERIES["heading_keys"](spark, f"file://{tmp_path}"), "doc_id", "key") == [(1, same + "one"), (2, same + "two")]
