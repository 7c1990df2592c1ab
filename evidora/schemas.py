"""Declared schemas of the node and edge tables; Parquet tables take the place of a graph store's indexes."""

from __future__ import annotations

RELATION = "struct<source_id:string,target_id:string,relation:string,confidence:double>"

#: Node tables: key column and columns.
NODES = {
    "document": ("id", "id string, path string, title string, mime string, content_hash string, ingested_at timestamp"),
    "text_chunk": (
        "id",
        "id string, doc_id string, text string, token_count int, start_offset int, end_offset int, page_start int, page_end int, "
        "section_path string, content_hash string, created_at timestamp, embedding array<float>",
    ),
    "entity": (
        "id",
        "id string, canonical_name string, name_hash string, entity_type string, aliases array<string>, mention_count int, "
        "provisional boolean, created_at timestamp, updated_at timestamp, embedding array<float>",
    ),
    "cluster": (
        "id",
        "id string, label int, size int, persistence double, fitted_at timestamp, version int, deprecated boolean, "
        "deprecated_at timestamp, medoid_embedding array<float>",
    ),
    "hyperedge": ("id", f"id string, layer int, kind string, weight double, source_chunk_id string, relations array<{RELATION}>, created_at timestamp"),
    "ingest_status": ("chunk_id", "chunk_id string, stage string, error string, updated_at timestamp"),
    "adjudication_task": (
        "id",
        "id string, status string, candidate_id string, provisional_id string, candidate_name string, provisional_name string, "
        "entity_type string, source_chunk_id string, context string, created_at timestamp, reason string, prompt_version string, "
        "resolved_at timestamp, canonical_name string",
    ),
    "extraction_cache": ("content_hash", "content_hash string, payload string, prompt_version string, chunk_id string"),
}

#: Edge tables: columns that identify an edge, and columns.
EDGES = {
    "contains": (("document_id", "chunk_id"), "document_id string, chunk_id string"),
    "member": (("hyperedge_id", "node_id"), "hyperedge_id string, node_id string, rank int"),
    "sourced_from": (("entity_id", "chunk_id"), "entity_id string, chunk_id string, confidence double, created_at timestamp"),
    "member_of": (("node_id", "cluster_id", "model_version"), "node_id string, cluster_id string, probability double, rank int, model_version int"),
}

TABLES = {**NODES, **{k: (keys, columns) for k, (keys, columns) in EDGES.items()}}

#: The layer of each node label.
LAYERS = {"TextChunk": 1, "Entity": 2, "Cluster": 3}
#: Stages of a chunk.
EMBEDDED, EXTRACTED, CLUSTERED = "EMBEDDED", "EXTRACTED", "CLUSTERED"
#: Entity types.
ENTITY_TYPES = ("PERSON", "ORG", "LOCATION", "CHEMICAL", "DISEASE", "DRUG", "GENE", "CONCEPT", "EVENT", "PRODUCT", "OTHER")
