"""Parsing, chunking, the store and the engine from files to evidence."""

import hashlib
import json

import numpy as np
import pytest

from evidora.config import Settings
from evidora.plans import evaluation
from evidora.plans.engine import Engine
from evidora.sources import chunking, documents, model

MD = "<!-- page: 1 -->\n# Sample\n\nIntro text.\n\n## 1 First\n\nAlpha beta.\n\n$$\nx = 1\n$$\n\n<!-- PAGE 2 -->\n\n## 1.1 Inner\n\n![fig](a.png)\n\nFigure 1: a caption\n\n```\ncode\n\nmore\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## 2 Second\n\n\\[ open maths\n\nlast words\n"


def test_blocks():
    kinds = [b.kind for b in chunking.parse_blocks(MD)]
    assert kinds == ["page", "heading", "paragraph", "heading", "paragraph", "math", "page", "heading", "figure", "code", "table", "heading", "paragraph", "paragraph"]


def test_chunks_are_slices_within_sections():
    rows = chunking.chunk_document("d", MD, None, 8, 2)
    for r in rows:
        assert MD[r["start_offset"] : r["end_offset"]] == r["text"] and r["token_count"] == chunking.count_tokens(r["text"])
        assert r["id"] == hashlib.sha256(f"d|{r['start_offset']}|{r['end_offset']}".encode()).hexdigest()
    assert {r["section_path"] for r in rows} == {"Sample", "First", "First/Inner", "Second"}
    inner = [r for r in rows if r["section_path"] == "First/Inner"]
    assert all((r["page_start"], r["page_end"]) == (2, 2) for r in inner)


def test_overlap_carries_a_short_block():
    md = "one two three\n\nfour\n\nfive six seven\n"
    rows = chunking.chunk_document("d", md, None, 4, 1)
    assert [r["text"].split() for r in rows] == [["one", "two", "three", "four"], ["four", "five", "six", "seven"]]


def test_toc_sections_and_checks():
    entry = {"id": "a", "level": 1, "title": "First", "title_path": ["Book", "First"], "page_start": 1, "page_end": 1, "match": {"heading_text": "1 First", "normalized_key": "1 first"}}
    rows = chunking.chunk_document("d", MD, [entry], 500, 50)
    assert [r["section_path"] for r in rows] == ["", "Book/First"]
    good = {"schema_version": 1, "document_title": "T", "entries": [entry]}
    assert documents.load_toc(json.dumps(good))["document_title"] == "T"
    for bad in ({**good, "schema_version": 2}, {**good, "entries": [entry, entry]}, {**good, "entries": [{**entry, "title": "x"}]}, {**good, "entries": [{**entry, "level": 2, "parent_id": "z"}]}):
        with pytest.raises(documents.SourceError):
            documents.load_toc(json.dumps(bad))
    legacy = documents.load_toc(json.dumps([{"level": 1, "title": "A"}, {"level": 2, "title": "B", "page": 3}]))["entries"]
    assert legacy[1]["title_path"] == ["A", "B"] and legacy[1]["parent_id"] == legacy[0]["id"]


def test_blocks_of_odd_marks():
    def cut(md):
        return [(b.kind, md[b.start : b.end].strip()) for b in chunking.parse_blocks(md)]

    assert cut("$$x$$ is a price.\n\nmore\n\n# H\n\nit is $$\n") == [("paragraph", "$$x$$ is a price."), ("paragraph", "more"), ("heading", "# H"), ("paragraph", "it is $$")]
    assert cut("$$\nopen\n\nrest") == [("paragraph", "$$\nopen"), ("paragraph", "rest")]
    assert cut("| a | b |\n| 1 | 2 |\ntext\n| c |") == [("table", "| a | b |\n| 1 | 2 |"), ("paragraph", "text"), ("table", "| c |")]
    assert cut("![f](a(1).png)\n\n\nFig. 2 one\n| still caption |\n\nnext") == [("figure", "![f](a(1).png)\n\n\nFig. 2 one\n| still caption |"), ("paragraph", "next")]
    assert cut("![f](a.png)\nfigures are nice") == [("paragraph", "![f](a.png)"), ("paragraph", "figures are nice")]
    assert cut("~~~~\na\n~~~\nb\n~~~~~\nc") == [("code", "~~~~\na\n~~~\nb\n~~~~~"), ("paragraph", "c")] and cut("```\nopen") == [("code", "```\nopen")]


def test_short_blocks_carry_over_and_long_ones_stand_alone():
    def packed(sizes, size=500, overlap=50):
        md, blocks = "x" * sum(sizes), []
        for k in range(len(sizes)):
            blocks.append(chunking.Block("paragraph", sum(sizes[:k]), sum(sizes[: k + 1])))
        at = [b.start for b in blocks] + [len(md)]
        return [sizes[at.index(a) : at.index(b)] for a, b in chunking.pack_blocks(md, blocks, size, overlap, len)]

    assert packed([2, 499, 1, 500]) == [[2], [2, 499], [1], [1, 500]]
    assert packed([2, 749]) == [[2], [2, 749]] and packed([2, 751, 3]) == [[2], [2], [751], [3]]
    assert packed([300, 300, 20, 400]) == [[300], [300, 20], [20, 400]] and packed([2000, 10]) == [[2000], [10]] and packed([]) == []
    assert packed([40, 1460, 1501], 1400) == [[40], [40, 1460], [1501]]


def test_heading_keys():
    from evidora.functions.text import normal_heading as key

    assert key("**What** is it?") == "what is it?" and key("Results (2020)") == "results (2020" and key("On \\(x_1\\)") == "on \\(x_1\\)"
    assert key("1.2  Déjà–vu_ !:") == "1.2 deja-vu" and key("Cost $a_b$") == "cost $a_b$" and key("`x`‒y.") == "x‒y" and key(None) == ""


def test_toc_rules():
    def toc(**more):
        e = {"id": "a", "level": 1, "title": "Why?", "title_path": ["Why?"], "match": {"heading_text": "Why?", "normalized_key": "why?"}} | more
        return json.dumps({"schema_version": 1, "entries": [e]})

    assert len(documents.load_toc(toc())["entries"]) == 1 and len(documents.load_toc(toc(parent_id="gone"))["entries"]) == 1
    for bad in (json.dumps({"schema_version": 1}), json.dumps("x"), toc(level=2, parent_id="gone"), toc(children=["z"]), toc(match={"heading_text": "Why?", "normalized_key": "why"})):
        with pytest.raises(documents.SourceError):
            documents.load_toc(bad)
    e = json.loads(toc(page_start=1, page_end=3))["entries"][0]
    with pytest.warns(UserWarning):
        documents.load_toc(json.dumps({"schema_version": 1, "entries": [e, e | {"id": "b", "page_start": 3, "page_end": 4}]}))
    legacy = documents.load_toc(json.dumps([{"level": 1, "title": "1 A"}, {"level": 2, "title": "B"}, {"level": 1, "title": "C"}]))["entries"]
    assert [x["parent_id"] for x in legacy] == [None, "legacy-0", None] and legacy[0]["number"] == "1" and legacy[0]["children"] == ["legacy-1"]


def test_contents_beside_documents(spark, tmp_path):
    for folder, names in (("one", ["a.md", "toc.json"]), ("two", ["a.md", "b.MD", "toc.json", "b_toc.json", "c.txt"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text(f"{folder} {n}")
    files = documents.scan(spark, f"file://{tmp_path}")
    assert files.count() == 6
    got = {(r["folder"].rstrip("/").rsplit("/", 1)[1], r["name"]): r["toc"] for r in documents.with_toc(files).collect()}
    assert got == {("one", "a.md"): "one toc.json", ("two", "a.md"): None, ("two", "b.MD"): "two b_toc.json"}


def test_router_and_pdf():
    assert documents.route("auto", "md") == "md" and documents.route("ocr", "pdf") == "ocr"
    for mode, kind in (("auto", "txt"), ("nope", "md")):
        with pytest.raises(documents.SourceError):
            documents.route(mode, kind)
    parse = documents.pdf_pages(lambda _: ["x" * 300, "y"])
    assert "<!-- page: 2 -->" in parse(b"")["combined_md"]
    with pytest.raises(documents.SourceError):
        documents.pdf_pages(lambda _: ["short"])(b"")


def embed(texts):
    out = []
    for t in texts:
        v = np.zeros(16)
        for w in t.lower().split():
            v[int(hashlib.md5(w.encode()).hexdigest(), 16) % 16] += 1
        out.append((v / max(1e-9, np.linalg.norm(v))).tolist())
    return out


def extract(text):
    if "poison" in text:
        raise RuntimeError("refused")
    names = [w for w in ("Insulin", "Glucose", "CRP") if w.lower() in text.lower()]
    triples = [{"source": names[0], "relation": "affects", "target": names[1], "confidence": 0.9}] if len(names) > 1 else []
    return json.dumps({"entities": [{"name": n, "type": "CHEMICAL"} for n in names], "triples": triples})


def test_engine_end_to_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# Insulin\n\nInsulin lowers glucose in blood.\n\n## 1 More\n\nGlucose rises after meals.\n")
    (src / "b.md").write_text("# CRP\n\nCRP marks inflammation.\n\n# Odd\n\npoison words here\n")
    s = Settings(embedding_dim=16, chunk_tokens=40, seed_min_similarity=0.1, evidence_cos_floor=0.1, elbow_ratio=0.0, bootstrap_min_chunks=2, min_cluster_size=1)
    e = Engine(spark, str(tmp_path / "store"), embed, extract, s)
    got = e.ingest(f"file://{src}")
    assert got["documents"] == 2 and got["failed"] == 1
    assert e.ingest(f"file://{src}")["documents"] == 0
    ents = {r["canonical_name"]: r["mention_count"] for r in e._t("entity").collect()}
    assert ents == {"Insulin": 1, "Glucose": 2, "CRP": 1}
    assert {r["stage"] for r in e._t("ingest_status").collect()} == {"EMBEDDED", "EXTRACTED"}
    related = [r for r in e._t("hyperedge").collect() if r["relations"]]
    assert len(related) == 1 and related[0]["relations"][0]["relation"] == "affects"
    q = spark.createDataFrame([("1", "what lowers glucose"), ("2", "  "), ("3", "x" * 4001)], "query_id string, question string")
    sources, trace = e.retrieve(q)
    top = sources.orderBy("citation").collect()
    assert top and "glucose" in top[0]["text"].lower() and [r["citation"] for r in top] == list(range(1, len(top) + 1))
    assert sum(r["token_count"] for r in top) <= s.token_budget and all(a["score"] >= b["score"] for a, b in zip(top, top[1:], strict=False))
    traces = {r["query_id"]: r for r in trace.collect()}
    assert traces["1"]["evidence_found"] and traces["2"]["error"] == "empty question" and traces["3"]["error"] == "question too long"
    gold = spark.createDataFrame([("1", "exact", "what lowers glucose", [top[0]["id"]], None), ("9", "negative", "zzz qqq", [], None)], "id string, type string, question string, relevant_chunk_ids array<string>, pair_of string")
    means = evaluation.report(e, gold)["means"]
    assert means["exact"]["hit_at_5"] == 1.0 and means["all"]["n"] == 2
    fitted = e.fit(force=True, k=2)
    assert fitted["state"] == "FITTED" and e.health()["ok"]
    sources2, _ = e.retrieve(q)
    assert sources2.count() >= 1
    assert e.undo_clusters(dry_run=True)["clustered"] >= 1
    with pytest.raises(ValueError):
        e.undo_clusters()
    again = e.refit(force=True)
    assert again["state"] == "REFITTED" and e._t("cluster").filter("not deprecated").agg({"persistence": "min"}).first()[0] > 0
    e.undo_clusters(yes=True)
    assert e._t("cluster").count() == 0 and {r["stage"] for r in e._t("ingest_status").collect()} == {"EMBEDDED", "EXTRACTED"}


def test_a_break_between_tables_loses_nothing(spark, tmp_path, monkeypatch):
    """Whatever breaks off, readers find the old rows or the new ones, and a document is taken again until all of it is there."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nsome text\n")
    e = Engine(spark, str(tmp_path / "store"), embed, None, Settings(embedding_dim=16))
    whole = e.store.upsert
    monkeypatch.setattr(e.store, "upsert", lambda name, rows: (_ for _ in ()).throw(OSError("gone")) if name == "ingest_status" else whole(name, rows))
    with pytest.raises(OSError):
        e.ingest(f"file://{tmp_path}/in")
    assert e._t("text_chunk").count() == 1 and e._t("document").count() == 0
    monkeypatch.undo()
    assert e.ingest(f"file://{tmp_path}/in") == {"documents": 1, "chunks": 1} and e._t("text_chunk").count() == 1
    commit = e.store.commit
    monkeypatch.setattr(e.store, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        e.store.replace("document", e._t("document").limit(0))
    assert e._t("document").count() == 1
    monkeypatch.setattr(e.store, "commit", commit)
    monkeypatch.setattr(e.store, "_versions", lambda name: [])  # as a writer that has seen no version yet
    with pytest.raises(RuntimeError):
        e.store.commit("document", "other")
    monkeypatch.undo()
    assert e.store.vacuum() > 0 and e._t("document").count() == 1 and e._t("text_chunk").count() == 1


def test_adjudication_flow(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), embed, None, Settings(embedding_dim=16))
    names = {"k": "Insulin", "p": "Insuline", "q": "insulin B", "r": "Glucose"}
    e.store.upsert("entity", spark.createDataFrame([(i, n, i, "DRUG", [], 1, i in "pqr") for i, n in names.items()], "id string, canonical_name string, name_hash string, entity_type string, aliases array<string>, mention_count int, provisional boolean"))
    e.store.add_edges("sourced_from", spark.createDataFrame([("k", "c1", 1.0, None), ("p", "c1", 1.0, None), ("p", "c2", 1.0, None), ("q", "c3", 1.0, None)], "entity_id string, chunk_id string, confidence double, created_at timestamp"))
    e.store.add_edges("member", spark.createDataFrame([("h", "q", 0), ("h", "r", 1)], "hyperedge_id string, node_id string, rank int"))
    e.store.upsert("adjudication_task", spark.createDataFrame([("1", "PENDING", "k", "p"), ("2", "PENDING", "p", "q"), ("3", "PENDING", "k", "r")], "id string, status string, candidate_id string, provisional_id string"))
    asked = []

    def decide(task):
        asked.append((task["id"], task["candidate_id"]))
        return json.dumps({"same_entity": task["id"] != "3", "canonical_name": "Insulin", "reason": "why"})

    assert e.adjudicate(decide, batch=1, once=True) == {"merged": 1, "rejected": 0}
    assert e.adjudicate(decide, batch=1) == {"merged": 1, "rejected": 1}
    assert asked == [("1", "k"), ("2", "k"), ("3", "k")]  # what waited for a merged entity goes to where that went
    left = {r["id"]: r for r in e._t("entity").collect()}
    assert set(left) == {"k", "r"} and set(left["k"]["aliases"]) == {"Insulin", "Insuline", "insulin B"} and not left["r"]["provisional"]
    assert sorted((r["entity_id"], r["chunk_id"]) for r in e._t("sourced_from").collect()) == [("k", "c1"), ("k", "c2"), ("k", "c3")]
    assert sorted((r["node_id"], r["rank"]) for r in e._t("member").collect()) == [("k", 0), ("r", 1)]
    assert {r["id"]: r["status"] for r in e._t("adjudication_task").collect()} == {"1": "MERGED", "2": "MERGED", "3": "REJECTED"}


def test_prompts_and_forms():
    from evidora.sources import prompts

    good = {"entities": [{"name": "a", "type": "DRUG"}], "triples": [{"source": "a", "relation": "is", "target": "b", "confidence": 1}]}
    assert prompts.conforms(good, prompts.EXTRACTION_SCHEMA)
    for bad in ({}, good | {"more": 1}, good | {"entities": [{"name": "a", "type": "ANY"}]}, good | {"triples": [{"source": "a"}]}, []):
        assert not prompts.conforms(bad, prompts.EXTRACTION_SCHEMA)
    seen = []

    def send(prompt, **how):
        seen.append((prompt, how))
        return json.dumps({"same_entity": True, "canonical_name": "x", "reason": ""} if len(seen) > 1 else {"same_entity": "yes"})

    assert json.loads(model.adjudicator(send, per_minute=0)({"candidate_name": "x", "context": None}))["same_entity"] and len(seen) == 2
    assert "candidate_name: x" in seen[0][0] and seen[0][1]["schema"] == prompts.ADJUDICATION_SCHEMA and "JSON" in seen[0][1]["system"]
    assert model.extractor(lambda p, **_: json.dumps(good), per_minute=0)("text")


def test_files_that_are_too_large(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "LARGEST_FILE", 10)
    (tmp_path / "a.md").write_text("# more than ten bytes")
    with pytest.raises(Exception, match="larger"):
        documents.scan(spark, f"file://{tmp_path}").select("path").collect()


def test_commands(spark, tmp_path, capsys, monkeypatch):

    from evidora.__main__ import main

    monkeypatch.setenv("EMBEDDING_DIM", "16")
    (tmp_path / "gold.jsonl").write_text(json.dumps({"id": "e1", "type": "exact", "question": "q", "relevant_chunk_ids": ["gone"]}) + "\n")
    monkeypatch.setattr("pyspark.sql.SparkSession.builder.getOrCreate", lambda *a: spark, raising=False)
    at = [str(tmp_path / "store"), "--embed", f"{__name__}:embed"]
    assert main([*at, "check-gold", str(tmp_path / "gold.jsonl"), "--count", "exact=2"]) == 1
    assert {p["problem"] for p in json.loads(capsys.readouterr().out)["problems"]} == {"unknown chunk", "count of type"}
    assert main([*at, "health"]) == 0 and json.loads(capsys.readouterr().out)["clusters"] == "bootstrap"
    assert main([*at, "vacuum"]) == 0 and main([*at, "seeds", str(tmp_path / "gold.jsonl")]) == 0


def test_model_calls_are_repeated_and_spaced():
    answers, waits, now = iter(["nonsense", "[]", '{"entities": []}']), [], [0.0]
    m = model.JsonModel(lambda prompt, **_: next(answers), lambda t: t, per_minute=20, sleep=lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)), clock=lambda: now[0])
    assert m("text") == '{"entities": []}' and waits == [3.0, 3.0]
    with pytest.raises(RuntimeError):
        model.JsonModel(lambda prompt, **_: "no", lambda t: t, per_minute=0)("text")


def test_stream_ingests_what_has_landed(spark, tmp_path):
    from evidora.streaming.ingest import ingest_stream

    seen = []

    class Recorder:
        def ingest(self, folder):
            seen.append(folder)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\ntext\n")
    for _ in range(2):
        q = ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state", Recorder())
        q.awaitTermination(60)
    assert len(seen) == 1


def test_stream_ingests_every_folder(spark, tmp_path, monkeypatch):
    from evidora.streaming.ingest import ingest_stream

    seen = []

    class Recorder:
        def ingest(self, folder):
            seen.append(folder)

    frame = type(spark.range(0))
    whole = frame.limit
    monkeypatch.setattr(frame, "limit", lambda self, n: whole(self, min(n, 3)))  # a bound would show on few folders
    for i in range(7):
        (tmp_path / "in" / f"f{i}").mkdir(parents=True)
        (tmp_path / "in" / f"f{i}" / "a.md").write_text(f"# {i}\n")
    q = ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state", Recorder())
    q.awaitTermination(60)
    assert [s.rstrip("/").rsplit("/", 1)[1] for s in seen] == [f"f{i}" for i in range(7)]


def test_folders_inside_another_are_read_once():
    from evidora.streaming.ingest import outermost

    assert list(outermost(["x/a-b/", "x/a/", "x/a/c/", "x/a/c/d/", "x/a0/", "x/b/c/"])) == ["x/a-b/", "x/a/", "x/a0/", "x/b/c/"]
    assert list(outermost([])) == []
