"""The engine: ingestion, clustering and batch retrieval over a store."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.scores import normalized_entropy, routing
from ..functions.vectors import cosine
from ..operators import clusters as cl
from ..operators import graph, pack, resolution, search
from ..schemas import CLUSTERED, EMBEDDED, EXTRACTED
from ..sources import chunking, documents, store


class RetrievalError(ValueError):
    """A question that can't be asked."""


LONGEST_QUESTION = 4000


@dataclass
class Engine:
    """embed: texts to vectors; extract: a chunk's text to a payload. Both are injected; nothing else is external."""

    spark: SparkSession
    path: str
    embed: Callable[[list[str]], list]
    extract: Callable[[str], str] | None = None
    settings: Settings = Settings()

    def __post_init__(self):
        self.store = store.Store(self.spark, self.path)
        self._saved = 0

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        self._saved += 1
        path = f"{self.path}/work/{name}-{time.time_ns()}-{self._saved}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _t(self, name: str) -> DataFrame:
        return self.store.table(name)

    # ingestion

    def ingest(self, path: str, mode: str = "auto", **parsers) -> dict:
        """Files to documents, chunks, hyperedges, and on through every later stage; known documents are skipped."""
        s, now = self.settings, F.current_timestamp()
        docs = documents.documents(self.spark, path, mode, **parsers).dropDuplicates(["id"])
        docs = self._save(docs.join(self._t("document").select(F.col("content_hash").alias("id")), "id", "left_anti"), "docs")
        chunks = chunking.chunks(docs, s.chunk_tokens, s.chunk_overlap_tokens)
        chunks = self._save(documents.embedded(chunks, self.embed, s.embedding_dim).withColumn("created_at", now), "chunks")
        # a document is known only when all of it is there; after a break it is taken again, under the same ids
        self.store.upsert("text_chunk", chunks.drop("position"))
        self.store.add_edges("contains", chunks.select(F.col("doc_id").alias("document_id"), F.col("id").alias("chunk_id")))
        for edges, members in (graph.section_hyperedges(chunks, s.section_hyperedge_cap), graph.proximity_hyperedges(chunks, s.proximity_window)):
            self._hyperedges(edges, members)
        self.store.upsert("ingest_status", chunks.select(F.col("id").alias("chunk_id"), F.lit(EMBEDDED).alias("stage"), F.lit(None).cast("string").alias("error"), now.alias("updated_at")))
        self.store.upsert("document", docs.select("id", "path", "title", "mime", F.col("id").alias("content_hash"), now.alias("ingested_at")))
        done = {"documents": docs.count(), "chunks": chunks.count()}
        if self.extract is not None:
            done |= self.extract_pending()
        if self._manifest():
            done |= self.assign_pending()
        return done

    def _hyperedges(self, edges: DataFrame, members: DataFrame) -> None:
        none = F.lit(None).cast("string")
        rows = edges.select("id", "layer", "kind", "weight", F.col("source_chunk_id") if "source_chunk_id" in edges.columns else none.alias("source_chunk_id"), F.current_timestamp().alias("created_at"))
        self.store.upsert("hyperedge", rows)
        self.store.add_edges("member", members.withColumn("rank", F.col("rank").cast("int")))

    def extract_pending(self, limit: int | None = None) -> dict:
        """EMBEDDED chunks to entities and co-occurrences; a chunk whose extraction fails keeps its stage and error."""
        s, now = self.settings, F.current_timestamp()
        todo = self._save(store.pending(self._t("text_chunk"), self._t("ingest_status"), EMBEDDED, limit=limit), "todo")
        hits, misses = resolution.cached_payloads(todo, self._t("extraction_cache"))
        fresh = self._save(resolution.extracted(misses, self.extract), "fresh")
        failed = fresh.filter("error is not null")
        good = fresh.filter("payload is not null")
        self.store.upsert("extraction_cache", good.select("content_hash", "payload", F.lit(resolution.PROMPT_VERSION).alias("prompt_version"), "chunk_id").dropDuplicates(["content_hash"]))
        payloads = hits.select(F.col("id").alias("chunk_id"), "payload").union(good.select("chunk_id", "payload"))
        entities = self._save(resolution.valid_entities(payloads, s.max_entities, s.max_name_chars), "entities")
        triples = self._save(resolution.valid_triples(payloads, entities, s.max_triples), "triples")
        mentions = resolution.deduped_mentions(entities).withColumnRenamed("type", "entity_type")
        mentions = documents.embedded(mentions.withColumn("text", F.col("name")), self.embed, s.embedding_dim).drop("text")
        resolved = self._save(resolution.resolve(self._save(mentions, "mentions"), self._t("entity"), s.er_candidates, s.er_auto_merge, s.er_adjudicate), "resolved")
        made = resolved.filter("outcome in ('NEW', 'PROVISIONAL')").join(self._save(mentions, "vectors").select("chunk_id", "position", "embedding"), ["chunk_id", "position"])
        self.store.upsert("entity", made.select(F.col("entity_id").alias("id"), F.col("name").alias("canonical_name"), "name_hash", "entity_type", F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("mention_count"), (F.col("outcome") == "PROVISIONAL").alias("provisional"), now.alias("created_at"), now.alias("updated_at"), "embedding"))
        alias = resolved.filter("outcome = 'AUTO_MERGE'").groupBy(F.col("entity_id").alias("id")).agg(F.collect_set("name").alias("more"))
        known = self._t("entity").join(alias, "id", "left")
        named = F.array_remove(F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>"))), F.col("canonical_name"))
        self.store.replace("entity", known.withColumn("aliases", named).drop("more"))
        self.store.upsert("adjudication_task", resolution.adjudication_tasks(resolved, self._t("text_chunk"), self._t("entity")).withColumn("created_at", now).dropDuplicates(["id"]))
        new = self.store.add_edges("sourced_from", resolved.select("entity_id", "chunk_id", F.lit(1.0).alias("confidence"), now.alias("created_at")))
        self.store.replace("entity", store.counted(self._t("entity"), new))
        edges, members = graph.cooccurrence(resolved)
        self._hyperedges(edges, members)
        ends = resolved.join(entities.select("chunk_id", "position", F.col("name").alias("surface")), ["chunk_id", "position"])
        rel = triples
        for end in ("source", "target"):
            rel = rel.join(ends.select("chunk_id", F.col("surface").alias(end), F.col("entity_id").alias(f"{end}_id")), ["chunk_id", end])
        rel = rel.groupBy("chunk_id").agg(F.collect_list(F.struct("source_id", "target_id", "relation", "confidence")).alias("relations"))
        self.store.upsert("hyperedge", edges.join(rel, edges["source_chunk_id"] == rel["chunk_id"]).select("id", "relations"))
        bad = failed.select("chunk_id", "error")
        status = self._t("ingest_status").drop("error").join(bad, "chunk_id", "left")
        ok = todo.join(bad.select(F.col("chunk_id").alias("id")), "id", "left_anti")
        self.store.replace("ingest_status", store.moved(status, ok, EXTRACTED, now))
        return {"extracted": ok.count(), "failed": failed.count()}

    def adjudicate(self, decide: Callable[[dict], str], batch: int = 20, once: bool = False) -> dict:
        """Put pending tasks to a model, ``batch`` at a time in the order of their ids, until none is left.

        ``decide`` gives JSON {same_entity, canonical_name, reason}. The same: the provisional entity's edges go to the
        candidate, which takes its names, and the entity goes. Else it is provisional no more. A batch is a handful of
        rows; of two merges in a row in one batch, the first entity goes where the second does.
        """
        done = {"merged": 0, "rejected": 0}
        while True:
            tasks = [r.asDict() for r in resolution.pending_tasks(self._t("adjudication_task"), batch).collect()]
            if not tasks:
                return done
            verdicts = [(t, json.loads(decide(t))) for t in tasks]
            self._settle(verdicts)
            same = sum(bool(v.get("same_entity")) for _, v in verdicts)
            done["merged"] += same
            done["rejected"] += len(tasks) - same
            if once:
                return done

    def _settle(self, verdicts: list[tuple[dict, dict]]) -> None:
        now, version = F.current_timestamp(), F.lit(resolution.PROMPT_VERSION)
        same = {t["provisional_id"]: t["candidate_id"] for t, v in verdicts if v.get("same_entity")}

        def last(ident: str) -> str:
            seen = {ident}
            while same.get(ident, ident) not in seen:
                ident = same[ident]
                seen.add(ident)
            return ident

        rows = [(t["id"], t["provisional_id"], last(t["candidate_id"]), bool(v.get("same_entity")), str(v.get("canonical_name") or t["provisional_name"]), str(v.get("reason") or "")) for t, v in verdicts]
        known = self._save(self.spark.createDataFrame(rows, "id string, provisional_id string, candidate_id string, same boolean, canonical_name string, reason string"), "verdicts")
        merges, refused = known.filter("same and provisional_id <> candidate_id"), known.filter("not same")
        for name, column, keys in (("sourced_from", "entity_id", ["entity_id", "chunk_id"]), ("member", "node_id", ["hyperedge_id", "node_id"])):
            self.store.replace(name, resolution.merged(self._t(name), merges.select("provisional_id", "candidate_id"), column, keys))
        gone = merges.select(F.col("provisional_id").alias("node_id"))
        self.store.replace("member_of", self._t("member_of").join(gone, "node_id", "left_anti"))
        entities = resolution.merged_entities(self._t("entity"), merges.select("provisional_id", "candidate_id", "canonical_name"))
        entities, tasks = resolution.rejected(entities, self._t("adjudication_task"), refused.select("id", "provisional_id", "reason"))
        self.store.replace("entity", entities)
        moved = merges.select(F.col("provisional_id").alias("candidate_id"), F.col("candidate_id").alias("_to"))  # what waits for one that is gone
        tasks = tasks.join(moved, "candidate_id", "left").withColumn("candidate_id", F.when(F.col("status") == "PENDING", F.coalesce("_to", "candidate_id")).otherwise(F.col("candidate_id"))).drop("_to")
        settled = merges.unionByName(known.filter("same and provisional_id = candidate_id"))
        settled = settled.select("id", F.lit("MERGED").alias("status"), "reason", "canonical_name").unionByName(refused.select("id", F.lit("REJECTED").alias("status"), "reason", F.lit(None).cast("string").alias("canonical_name")))
        # tasks last: a batch that broke off is put to the model again, and what it merged already stays merged
        self.store.replace("adjudication_task", store.upserted(tasks, settled.withColumns({"prompt_version": version, "resolved_at": now}), "id"))

    # clusters

    def _manifest(self) -> dict | None:
        raw = self.store.latest("manifest")
        if raw is None:
            return None
        m, s = json.loads(raw), self.settings
        if m.get("schema") != 1 or m.get("embedding_dim") != s.embedding_dim or m.get("reduced_dim") != s.reduced_dim:
            raise ValueError("the model on disk is of another schema or dimension")
        return m

    def fit(self, force: bool = False, k: int | None = None) -> dict:
        """Fit clusters; the manifest is written last. Below ``bootstrap_min_chunks`` chunks nothing is done unless forced."""
        s, now = self.settings, F.current_timestamp()
        chunks = store.vector_rows(self._t("text_chunk"), s.embedding_dim, True)
        n, old = chunks.count(), self._manifest()
        if n < s.bootstrap_min_chunks and not force:
            return {"state": "BOOTSTRAP", "chunks": n}
        labelled, centres, projection = cl.fit(chunks, s, k)
        labelled = self._save(labelled, "labelled")
        version = old["version"] + 1 if old else 1
        hard = labelled.filter("label >= 0")
        member = hard.withColumnRenamed("label", "cluster_id")
        medoid = cl.medoids(member).join(hard.select("id", "embedding"), "id").join(cl.persistence(member), "cluster_id")
        medoid = self._save(medoid.select(F.col("cluster_id").alias("label"), F.col("embedding").alias("medoid_embedding"), "persistence"), "medoids")
        sizes = hard.groupBy("label").agg(F.count("*").cast("int").alias("size"))
        ids, gone = self._remap(hard, medoid, sorted(centres), version)
        named = F.create_map(*[x for k_, v in ids.items() for x in (F.lit(k_), F.lit(v))]) if ids else F.create_map(F.lit(-9), F.lit(""))
        rows = sizes.join(medoid, "label").select(named[F.col("label")].alias("id"), F.col("label").cast("int").alias("label"), "size", "persistence", now.alias("fitted_at"), F.lit(version).alias("version"), F.lit(False).alias("deprecated"), F.lit(None).cast("timestamp").alias("deprecated_at"), "medoid_embedding")
        self.store.upsert("cluster", self._save(rows, "clusters"))
        self.store.replace("member_of", self._t("member_of").filter(F.lit(False)) if old is None else store.without_version(self._t("member_of"), old["version"]))
        manifest = {"schema": 1, "embedding_dim": s.embedding_dim, "reduced_dim": s.reduced_dim, "projection": projection, "version": version, "chunks": n, "centres": {str(k_): v for k_, v in centres.items()}, "ids": {str(k_): v for k_, v in ids.items()}}
        for name in ("text_chunk", "entity"):
            self._members(store.vector_rows(self._t(name), s.embedding_dim, False), manifest)
        self.store.replace("ingest_status", store.moved(self._t("ingest_status"), chunks, CLUSTERED, now))
        self.store.replace("cluster", store.deprecated(self._t("cluster"), gone, now))
        self.store.commit("manifest", json.dumps(manifest))
        return {"state": "REFITTED" if old else "FITTED", "clusters": len(ids), "chunks": n}

    def _remap(self, hard: DataFrame, medoid: DataFrame, labels: list[int], version: int) -> tuple[dict, DataFrame]:
        """Ids of the new labels, and the old clusters (id) that none of them takes over, however many there are."""
        s = self.settings
        live = self._save(self._t("cluster").filter("not deprecated").select("id", "medoid_embedding"), "live")
        before = self._t("member_of").select(F.col("cluster_id").alias("old_id"), F.col("node_id").alias("node")).join(live.select(F.col("id").alias("old_id")), "old_id", "left_semi")
        shared = cl.jaccard(before, hard.select("label", F.col("id").alias("node")))
        near = search.near_vectors(live.withColumnRenamed("medoid_embedding", "embedding"), medoid.select(F.col("label").alias("query_id"), F.col("medoid_embedding").alias("embedding")), 1 << 30, s.remap_cosine)
        near = near.select(F.col("id").alias("old_id"), F.col("query_id").cast("int").alias("label"), F.col("similarity").alias("cosine"))
        pairs = [tuple(r) for r in cl.remap_pairs(shared, near, s.remap_jaccard, s.remap_cosine).collect()]
        taken, new, _ = cl.remap(pairs, [], labels, s.remap_jaccard, s.remap_cosine)
        kept = self.spark.createDataFrame([(v,) for v in taken.values()], "id string")
        return taken | {k: f"cluster-{version}-{k}" for k in new}, self._save(live.select("id").join(kept, "id", "left_anti"), "gone")

    def _members(self, rows: DataFrame, manifest: dict) -> DataFrame:
        s = self.settings
        soft = cl.soft_memberships(rows, {int(k): v for k, v in manifest["centres"].items()}, manifest["projection"], least=s.membership_min_probability)
        best = cl.top_memberships(soft, s.membership_top_m, s.membership_min_probability)
        named = F.create_map(*[x for k, v in manifest["ids"].items() for x in (F.lit(int(k)), F.lit(v))]) if manifest["ids"] else F.create_map(F.lit(-9), F.lit(""))
        return self.store.add_edges("member_of", best.select("node_id", named[F.col("label")].alias("cluster_id"), "probability", F.col("rank").cast("int").alias("rank"), F.lit(manifest["version"]).alias("model_version")))

    def assign_pending(self) -> dict:
        """Memberships for EXTRACTED chunks and for entities without one of the current version."""
        m = self._manifest()
        if m is None:
            return {"assigned": 0}
        s = self.settings
        chunks = store.vector_rows(store.pending(self._t("text_chunk"), self._t("ingest_status"), EXTRACTED), s.embedding_dim, True)
        have = self._t("member_of").filter(F.col("model_version") == m["version"]).select(F.col("node_id").alias("id"))
        entities = store.vector_rows(self._t("entity").join(have, "id", "left_anti"), s.embedding_dim, False)
        new = self._members(chunks, m)
        self._members(entities, m)
        self.store.replace("ingest_status", store.moved(self._t("ingest_status"), chunks, CLUSTERED, F.current_timestamp()))
        return {"assigned": new.select("node_id").distinct().count()}

    def needs_refit(self) -> str:
        m = self._manifest()
        if m is None:
            return "none"
        row = cl.refit_decision(self._t("ingest_status"), self._t("member_of"), m["chunks"], self.settings.refit_growth, self.settings.refit_noise).first()
        return row["decision"]

    def refit(self, force: bool = False, if_needed: bool = False) -> dict:
        if force:
            return self.fit(force=True)
        if if_needed and self.needs_refit() == "none":
            return {"state": "NOT_NEEDED"}
        if self._manifest() is None or self.needs_refit() != "none":
            return self.fit()
        return self.assign_pending()

    def undo_clusters(self, yes: bool = False, dry_run: bool = False) -> dict:
        """Remove models first, then memberships and clusters, and restore statuses."""
        counts = {"clusters": self._t("cluster").count(), "member_of": self._t("member_of").count(), "clustered": self._t("ingest_status").filter(F.col("stage") == CLUSTERED).count()}
        if dry_run:
            return counts
        if not yes:
            raise ValueError("pass yes=True to remove clusters")
        self.store.commit("manifest", "")
        for name in ("member_of", "cluster"):
            self.store.replace(name, self._t(name).filter(F.lit(False)))
        self.store.replace("ingest_status", store.restored(self._t("ingest_status"), self._t("sourced_from")))
        return counts

    # retrieval

    def checked(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Questions (query_id, question) that may be asked, and the others with an error."""
        q = F.trim("question")
        error = F.when(F.col("question").isNull() | (q == ""), "empty question").when(F.length(q) > LONGEST_QUESTION, "question too long")
        rows = questions.select(F.col("query_id").cast("string"), q.alias("question"), error.alias("error"))
        return rows.filter("error is null").drop("error"), rows.filter("error is not null")

    def retrieve(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(sources, trace) of all questions (query_id, question) in one batch.

        sources: query_id, citation, header, id, doc_id, score, token_count, text, ...; trace: one row a question.
        """
        s = self.settings
        asked, bad = self.checked(questions)
        vectors = self._save(documents.embedded(asked.withColumn("text", F.col("question")), self.embed, s.embedding_dim).drop("text"), "asked")
        chunks, entities = self._t("text_chunk"), self._t("entity")
        m, memberships = self._manifest(), None
        if m is not None and m["ids"]:
            soft = cl.soft_memberships(vectors.select(F.col("query_id").alias("id"), "embedding"), {int(k): v for k, v in m["centres"].items()}, m["projection"])
            named = F.create_map(*[x for k, v in m["ids"].items() for x in (F.lit(int(k)), F.lit(v))])
            memberships = search.query_memberships(soft.select(F.col("node_id").alias("query_id"), named[F.col("label")].alias("id"), F.col("probability").alias("p")), self._t("cluster"))
        else:
            memberships = self.spark.createDataFrame([], "query_id string, id string, p double, rank int")
        memberships = self._save(memberships, "memberships")
        g = vectors.select("query_id").join(normalized_entropy(memberships), "query_id", "left").select("query_id", F.coalesce("globality", F.lit(0.5)).alias("globality"))
        regime, depth, beam = routing(F.col("globality"), s.globality_local, s.globality_global, s.depth_max, s.beam_min, s.beam_max)
        params = self._save(g.select("query_id", "globality", regime.alias("regime"), depth.alias("depth"), beam.alias("beam")), "params")
        k = max(s.beam_max, s.bm25_candidates)
        words = vectors.select("query_id", F.col("question").alias("text"))
        hits = self._save(search.hybrid_hits(search.vector_topk(chunks, vectors, k), search.bm25_topk(chunks.select("id", "text"), words, k), k, chunks, vectors, s.hybrid_rrf_k), "hits")
        k = max(1, s.beam_max // 2, s.bm25_candidates // 2)
        names = entities.select("id", F.col("canonical_name").alias("text"))
        ehits = search.hybrid_hits(search.vector_topk(entities, vectors, k), search.bm25_topk(names, words, k), k, entities, vectors, s.hybrid_rrf_k)
        hybrid = search.hybrid_seeds(hits, ehits, s.beam_max).join(params.select("query_id", "beam"), "query_id")
        room = F.when(F.col("label") == "TextChunk", F.col("beam")).otherwise(F.greatest(F.lit(1), F.floor(F.col("beam") / 2)))
        hybrid = hybrid.filter(F.col("rank") <= room).drop("beam")
        seeds, regimes = search.by_regime(params.select("query_id", "regime"), hybrid, memberships, s.membership_min_probability)
        seeds = self._save(search.gated(seeds, s.seed_min_similarity), "seeds")
        masses = search.legacy_masses(seeds, s.softmax_temperature)
        if s.shadow_enabled:
            masses = self._shadow(hits, memberships, seeds, regimes, masses)
        masses = self._save(masses, "masses")
        return self._answer(vectors, masses, params, regimes, bad)

    def _shadow(self, hits, memberships, seeds, regimes, legacy) -> DataFrame:
        """Shadow masses where a query has a core; the plain ones elsewhere and for global queries."""
        s = self.settings
        s1 = search.shadow_from_chunks(hits, self._t("sourced_from"))
        s3 = search.shadow_from_clusters(memberships, self._t("member_of").filter(F.col("node_id").isNotNull()), s.membership_top_m)
        labels = self._labels()
        core = search.soft_core(s1, s3, s.shadow_alpha).join(labels, "id").join(regimes.filter("regime <> 'global'").select("query_id"), "query_id", "left_semi")
        mixed = regimes.filter("regime = 'mixed'").select("query_id")
        clusters = search.cluster_seeds(memberships).join(mixed, "query_id", "left_semi")
        cored = core.select("query_id").distinct()
        plain = seeds.join(cored, "query_id", "left_semi").filter("label = 'TextChunk'")
        out = search.shadow_seeds(core, plain, clusters.join(cored, "query_id", "left_semi"), s.shadow_core_top_k, s.shadow_anchors, s.shadow_core_share, s.shadow_cluster_share)
        return out.unionByName(legacy.join(cored, "query_id", "left_anti"))

    def _labels(self) -> DataFrame:
        each = [self._t(t).select("id", F.lit(n).alias("label")) for t, n in (("text_chunk", "TextChunk"), ("entity", "Entity"), ("cluster", "Cluster"))]
        return each[0].union(each[1]).union(each[2])

    def _answer(self, vectors, masses, params, regimes, bad) -> tuple[DataFrame, DataFrame]:
        s = self.settings
        member_of = self._t("member_of").join(self._labels().withColumnsRenamed({"id": "node_id", "label": "node_label"}), "node_id")
        edges, members = self._t("hyperedge").select("id", "weight"), self._t("member").select("hyperedge_id", "node_id")
        nodes, arcs = graph.expand(masses, params, self._t("sourced_from").select("entity_id", "chunk_id", "confidence"), member_of.select("node_id", "node_label", "cluster_id", "probability"), edges, members, s.depth_max, self._save)
        weight = F.col("affinity") * graph.cross_layer(F.col("source_label"), F.col("target_label"), s.cross_entity_chunk, s.cross_chunk_cluster, s.cross_entity_cluster)
        moves = graph.transitions(nodes, graph.build_arcs(arcs.withColumn("weight", weight)))
        walk = graph.rwr(moves, graph.restart_vector(nodes, masses), s.rwr_restart, s.rwr_iterations, s.rwr_epsilon)
        linked = graph.linked_to_seed_entity(arcs, masses).withColumn("linked", F.lit(True))
        rows = nodes.filter("label = 'TextChunk'").join(walk, ["query_id", "id"]).join(linked, ["query_id", "id"], "left")
        chunk = self._t("text_chunk").filter("embedding is not null")
        rows = rows.join(chunk, "id").join(vectors.select("query_id", F.col("embedding").alias("q")), "query_id")
        rows = rows.withColumns({"cos": cosine(F.col("q"), F.col("embedding")), "linked": F.coalesce("linked", F.lit(False))}).drop("q")
        ranked = self._save(pack.elbow(pack.scored(rows, s.evidence_cos_floor), s.elbow_ratio), "ranked")
        packed = pack.knapsack(ranked, s.token_budget, s.mmr_reject_cosine)
        doc = self._t("document").select(F.col("id").alias("doc_id"), "title", "path", "mime")
        out = packed.join(ranked.drop("score", "token_count", "embedding"), ["query_id", "id"]).join(doc, "doc_id", "left")
        header = pack.source_header(F.col("citation"), F.col("doc_id"), F.col("page_start"), F.col("page_end"), F.col("start_offset"), F.col("end_offset"))
        sources = self._save(out.withColumn("header", header).select("query_id", "citation", "header", "id", "doc_id", "title", "path", "mime", "section_path", "page_start", "page_end", "start_offset", "end_offset", "token_count", "score", "cos", "mass", "linked", "text"), "sources")
        counts = nodes.groupBy("query_id").agg(F.count("*").alias("nodes"))
        used = sources.groupBy("query_id").agg(F.count("*").alias("sources"), F.sum("token_count").alias("packed_tokens"))
        trace = params.drop("regime").join(regimes, "query_id").join(counts, "query_id", "left").join(used, "query_id", "left")
        trace = trace.withColumns({"evidence_found": F.col("sources").isNotNull(), "error": F.lit(None).cast("string")}).na.fill(0, ["sources", "packed_tokens", "nodes"])
        return sources, trace.unionByName(bad.select("query_id", "error"), allowMissingColumns=True)

    def health(self) -> dict:
        """Whether tables, embedder and model can be used."""
        try:
            dim_ok = len(self.embed(["ping"])[0]) == self.settings.embedding_dim
        except Exception as e:  # an embedder that is down is a finding, not a failure
            return {"ok": False, "embedder": str(e)[:200]}
        m = self._manifest()
        return {"ok": dim_ok, "embedding_dim_ok": dim_ok, "clusters": "fitted" if m else "bootstrap", "model_version": m["version"] if m else None, "chunks": self._t("text_chunk").count()}
