"""Registered cases of what depends on order: literal rows go through the operator, and the SQL states what comes out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_heading
from ..operators import evaluate, pack, resolution, search
from ..sources import chunking, documents
from .queries import query, r6

MD = "<!-- page: 1 -->\n# 1 Top\n\n$$x$$ costs two.\n\n$$\ny\n$$\n\n<!-- page: 2 -->\n| a |\n| b |\n\n## 1.1 In\n\n![f](g.png)\n\nFigure 1 one\ntwo\n\n```\nc\n```\nend\n"


def _documents(spark) -> DataFrame:
    entry = lambda i, level, path, key, page: {"id": i, "level": level, "title": path[-1], "title_path": path, "page_start": page, "page_end": page, "match": {"heading_text": key, "normalized_key": key}}
    toc = [entry("a", 1, ["Book", "Top"], "1 top", 1), entry("b", 2, ["Book", "Top", "In"], "1.1 in", 9), entry("c", 2, ["Book", "Gone"], "gone", 1)]
    return spark.createDataFrame([("plain", MD, None), ("rich", MD, json.dumps(toc)), ("empty", "", None)], "id string, combined_md string, toc string")


BLOCK_ROWS = """
  (0, 'page', 0, 17, 0, ''), (1, 'heading', 17, 8, 1, '1 Top'), (2, 'paragraph', 26, 17, 0, ''), (3, 'math', 44, 8, 0, ''), (4, 'page', 53, 17, 0, ''), (5, 'table', 70, 12, 0, ''),
  (6, 'heading', 83, 10, 2, '1.1 In'), (7, 'figure', 94, 30, 0, ''), (8, 'code', 125, 10, 0, ''), (9, 'paragraph', 135, 4, 0, '')"""


@query(f"SELECT id, b.* FROM (VALUES {BLOCK_ROWS}) AS b(position, kind, start, length, level, title), (VALUES ('plain'), ('rich')) AS d(id)")
def block_cases(spark, d) -> DataFrame:
    return chunking.blocks(_documents(spark))


@query("""SELECT * FROM (VALUES
  ('plain', 0, 17, 82, 32, 1, 2, 'Top'), ('plain', 1, 83, 139, 27, 2, 2, 'Top/In'),
  ('rich', 0, 17, 82, 32, 1, 2, 'Book/Top'), ('rich', 1, 83, 139, 27, 2, 2, 'Book/Top/In')) AS t(doc_id, position, start_offset, end_offset, token_count, page_start, page_end, section_path)""")
def section_cases(spark, d) -> DataFrame:
    """Sections from headings and from contents: one chunk each."""
    return chunking.chunks(_documents(spark), 500, 50).select("doc_id", "position", "start_offset", "end_offset", "token_count", "page_start", "page_end", "section_path")


@query("""SELECT * FROM (VALUES ('two', 0, 'w0'), ('two', 1, 'w0 v0 v1 v2 v3 v4 v5'), ('two', 2, 'x0'), ('two', 3, 'x0 y0 y1 y2 y3 y4 y5'),
  ('long', 0, 'w0'), ('long', 1, 'w0'), ('long', 2, 'v0 v1 v2 v3 v4 v5 v6 v7 v8 v9'), ('long', 3, 'z0'),
  ('fit', 0, 'a0 a1 a2 b0'), ('fit', 1, 'b0 c0 c1 c2 d0')) AS t(doc_id, position, words)""")
def packing_cases(spark, d) -> DataFrame:
    """Blocks packed to six tokens with an overlap of one, so up to nine where nothing fits beside the overlap."""
    para = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    texts = {"two": [("w", 1), ("v", 6), ("x", 1), ("y", 6)], "long": [("w", 1), ("v", 10), ("z", 1)], "fit": [("a", 3), ("b", 1), ("c", 3), ("d", 1)]}
    rows = [(k, "\n\n".join(para(*p) for p in v) + "\n", None) for k, v in texts.items()]
    out = chunking.chunks(spark.createDataFrame(rows, "id string, combined_md string, toc string"), 6, 1)
    return out.select("doc_id", "position", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("words"))


@query(r"""SELECT * FROM (VALUES ('**What** is it?', 'what is it?'), ('Results (2020)', 'results (2020'), ('On \(x_1\)', 'on \(x_1\)'), ('1.2  Déjà–vu_ !:', '1.2 deja-vu'),
  ('Cost $a_b$', 'cost $a_b$'), ('ﬁne   Print.', 'fine print'), ('', '')) AS t(title, key)""")
def heading_cases(spark, d) -> DataFrame:
    titles = ["**What** is it?", "Results (2020)", "On \\(x_1\\)", "1.2  Déjà–vu_ !:", "Cost $a_b$", "ﬁne   Print.", ""]
    return spark.createDataFrame([(t,) for t in titles], "title string").select("title", normalize_heading(F.col("title")).alias("key"))


@query("""SELECT * FROM (VALUES ('good', TRUE), ('question', TRUE), ('top with unknown parent', TRUE), ('no entries', FALSE), ('version', FALSE), ('repeated', FALSE), ('path', FALSE), ('parent', FALSE), ('child', FALSE), ('key', FALSE), ('text', FALSE)) AS t(name, valid)""")
def contents_cases(spark, d) -> DataFrame:
    """Which tables of contents are taken."""
    e = {"id": "a", "level": 1, "title": "Why?", "title_path": ["Why?"], "match": {"heading_text": "Why?", "normalized_key": "why?"}}
    form = lambda *entries: json.dumps({"schema_version": 1, "entries": entries})
    cases = {
        "good": form({"id": "b", "level": 1, "title": "B", "title_path": ["B"]}), "question": form(e), "top with unknown parent": form(e | {"parent_id": "z"}), "no entries": '{"schema_version": 1}',
        "version": '{"schema_version": 2, "entries": []}', "repeated": form(e, e), "path": form(e | {"title_path": ["x"]}), "parent": form(e | {"level": 2, "parent_id": "z"}), "child": form(e | {"children": ["z"]}),
        "key": form(e | {"match": {"heading_text": "Why?", "normalized_key": "why"}}), "text": '"x"',
    }

    @F.udf("boolean")
    def valid(raw):
        try:
            documents.load_toc(raw)
            return True
        except documents.SourceError:
            return False

    return spark.createDataFrame(list(cases.items()), "name string, raw string").select("name", valid("raw").alias("valid"))


@query("""SELECT * FROM (VALUES ('legacy-0', NULL, 'One', 'one'), ('legacy-1', 'legacy-0', 'One/1.1 Two', '1.1 two'), ('legacy-2', 'legacy-1', 'One/1.1 Two/Deep', 'deep'), ('legacy-3', 'legacy-0', 'One/Three!', 'three'), ('legacy-4', NULL, 'Four', 'four')) AS t(id, parent_id, path, key)""")
def legacy_contents_cases(spark, d) -> DataFrame:
    rows = documents.upgrade_legacy([{"level": n, "title": t} for n, t in ((1, "One"), (2, "1.1 Two"), (3, "Deep"), (2, "Three!"), (1, "Four"))])
    return spark.createDataFrame([(e["id"], e["parent_id"], "/".join(e["title_path"]), e["match"]["normalized_key"]) for e in rows], "id string, parent_id string, path string, key string")


@query("""SELECT * FROM (VALUES ('c1', 0, 'EXACT', 'k1', NULL), ('c1', 1, 'AUTO_MERGE', 'k1', 'k1'), ('c1', 2, 'PROVISIONAL', 'h3', 'k1'), ('c1', 3, 'NEW', 'h4', NULL), ('c2', 0, 'AUTO_MERGE', 'h4', 'h4'), ('c2', 1, 'EXACT', 'h4', NULL), ('c3', 0, 'NEW', 'h6', NULL)) AS t(chunk_id, position, outcome, entity_id, candidate_id)""")
def resolve_cases(spark, d) -> DataFrame:
    """Mentions in order, over three candidates: c3 finds its type's entity only behind three nearer ones of another."""
    known = [("k1", "h1", "DRUG", [1.0, 0.0, 0.0]), *((f"g{i}", f"hg{i}", "GENE", [0.0, 0.01 * i, 1.0]) for i in range(3)), ("k2", "hk2", "DRUG", [0.0, 0.3, 0.95])]
    m = [("c1", 0, "a", "DRUG", "h1", [0.0, 1.0, 0.0]), ("c1", 1, "b", "DRUG", "h2", [0.95, 0.31, 0.0]), ("c1", 2, "c", "DRUG", "h3", [0.85, 0.0, 0.53]), ("c1", 3, "d", "DRUG", "h4", [0.0, 1.0, 0.0]), ("c2", 0, "e", "DRUG", "h5", [0.0, 1.0, 0.1]), ("c2", 1, "d", "DRUG", "h4", [0.0, 1.0, 0.0]), ("c3", 0, "f", "DRUG", "h6", [0.0, 0.0, 1.0])]
    mentions = spark.createDataFrame(m, "chunk_id string, position int, name string, entity_type string, name_hash string, embedding array<double>")
    out = resolution.resolve(mentions, spark.createDataFrame(known, "id string, name_hash string, entity_type string, embedding array<double>"), 3)
    # a name that joined an entity is met again as that entity
    return out.select("chunk_id", "position", "outcome", "entity_id", F.when(F.col("outcome") != "EXACT", F.col("candidate_id")).alias("candidate_id"))


@query("""SELECT * FROM (VALUES ('q1', 'a', 1, 60), ('q1', 'd', 2, 30), ('q1', 'f', 3, 10), ('q2', 'a', 1, 100)) AS t(query_id, id, citation, token_count)""")
def knapsack_cases(spark, d) -> DataFrame:
    """A budget of 100 tokens: b is too like a, c doesn't fit, e has no tokens, f fills the rest."""
    x, y, z = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]
    rows = [("q1", "a", 0.9, 60, x), ("q1", "b", 0.8, 20, x), ("q1", "c", 0.7, 41, y), ("q1", "d", 0.6, 30, y), ("q1", "e", 0.5, 0, z), ("q1", "f", 0.4, 10, z), ("q2", "b", 0.9, 100, y), ("q2", "a", 0.9, 100, x)]
    return pack.knapsack(spark.createDataFrame(rows, "query_id string, id string, score double, token_count int, embedding array<double>"), 100, 0.95).select("query_id", "id", "citation", "token_count")


@query("""SELECT * FROM (VALUES ('q', 'Entity', 'e1', 0.255), ('q', 'TextChunk', 'c9', 0.17), ('q', 'TextChunk', 'c1', 0.255), ('q', 'TextChunk', 'c2', 0.17), ('q', 'Cluster', 'k', 0.15)) AS t(query_id, label, id, mass)""")
def shadow_seed_cases(spark, d) -> DataFrame:
    """The two best core nodes and the two first chunks share what the cluster leaves, each in proportion."""
    row = "query_id string, label string, id string, "
    core = spark.createDataFrame([("q", "Entity", "e1", 0.6), ("q", "TextChunk", "c9", 0.4), ("q", "Entity", "e3", 0.1)], row + "score double")
    hybrid = spark.createDataFrame([("q", "TextChunk", "c1", 0.6), ("q", "TextChunk", "c2", 0.4), ("q", "TextChunk", "c3", 0.3), ("q", "Entity", "e7", 0.9)], row + "similarity double")
    cluster = spark.createDataFrame([("q", "Cluster", "k", 0.5)], row + "similarity double")
    return search.shadow_seeds(core, hybrid, cluster, 2, 2).select("query_id", "label", "id", r6("mass"))


@query("""SELECT * FROM (VALUES ('repeated id', 'e1'), ('count of type', 'negative'), ('negative with chunks', 'n1'), ('multi with fewer than two', 'm1'), ('unknown chunk', 'n1'), ('twin differs', 'p1')) AS t(problem, id)""")
def gold_cases(spark, d) -> DataFrame:
    rows = [("e1", "exact", ["c1"], None), ("e1", "exact", ["c1"], None), ("p1", "paraphrase", ["c2"], "e2"), ("e2", "exact", ["c1"], None), ("n1", "negative", ["c9"], None), ("m1", "multi", ["c1"], None)]
    gold = spark.createDataFrame(rows, "id string, type string, relevant_chunk_ids array<string>, pair_of string")
    return evaluate.gold_problems(gold, spark.createDataFrame([("c1",), ("c2",)], "id string"), {"exact": 3, "negative": 2})


@query("""SELECT * FROM (VALUES ('k', 'Insulin', 'ins,Insulin,insuline', 3, FALSE, NULL), ('r', 'Glucose', '', 1, FALSE, 'REJECTED'), ('s', 'CRP', '', 2, TRUE, 'PENDING')) AS t(id, name, aliases, mention_count, provisional, status)""")
def settled_cases(spark, d) -> DataFrame:
    """A merge, a refusal and a task that still waits."""
    e = spark.createDataFrame([("k", "ins", "h1", "DRUG", [], 3, False), ("p", "insuline", "h2", "DRUG", [], 1, True), ("r", "Glucose", "h3", "DRUG", [], 1, True), ("s", "CRP", "h4", "GENE", [], 2, True)], "id string, canonical_name string, name_hash string, entity_type string, aliases array<string>, mention_count int, provisional boolean")
    tasks = spark.createDataFrame([("t2", "r", "PENDING", None), ("t3", "s", "PENDING", None)], "id string, provisional_id string, status string, reason string")
    merged = resolution.merged_entities(e, spark.createDataFrame([("p", "k", "Insulin")], "provisional_id string, candidate_id string, canonical_name string"))
    entities, tasks = resolution.rejected(merged, tasks, spark.createDataFrame([("t2", "r", "no")], "id string, provisional_id string, reason string"))
    status = tasks.select(F.col("provisional_id").alias("id"), "status")
    aliases = F.array_join(F.array_sort("aliases", lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0)), ",")
    return entities.join(status, "id", "left").select("id", F.col("canonical_name").alias("name"), aliases.alias("aliases"), "mention_count", "provisional", "status")
