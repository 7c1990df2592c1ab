"""Settings of the engine; each can be set by an environment variable of its upper-cased name."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 1024
    # chunks
    chunk_tokens: int = 500
    chunk_overlap_tokens: int = 50
    section_hyperedge_cap: int = 64
    proximity_window: int = 3
    # extraction
    max_triples: int = 15
    max_entities: int = 20
    max_name_chars: int = 80
    # entity resolution
    er_auto_merge: float = 0.92
    er_adjudicate: float = 0.80
    er_candidates: int = 10
    # clusters
    bootstrap_min_chunks: int = 5000
    min_cluster_size: int = 0
    reduced_dim: int = 32
    membership_top_m: int = 2
    membership_min_probability: float = 0.15
    refit_noise: float = 0.20
    refit_growth: float = 1.3
    random_state: int = 42
    remap_jaccard: float = 0.30
    remap_cosine: float = 0.85
    # retrieval
    token_budget: int = 3000
    beam_min: int = 4
    beam_max: int = 16
    depth_max: int = 3
    rwr_restart: float = 0.15
    rwr_iterations: int = 20
    rwr_epsilon: float = 1e-4
    globality_local: float = 0.35
    globality_global: float = 0.65
    mmr_reject_cosine: float = 0.95
    evidence_cos_floor: float = 0.48
    elbow_ratio: float = 0.6
    seed_min_similarity: float = 0.54
    softmax_temperature: float = 0.05
    hybrid_rrf_k: int = 60
    bm25_candidates: int = 20
    shadow_enabled: bool = True
    shadow_alpha: float = 0.5
    shadow_core_top_k: int = 10
    shadow_anchors: int = 2
    shadow_core_share: float = 0.5
    shadow_cluster_share: float = 0.15
    cross_entity_chunk: float = 0.9
    cross_chunk_cluster: float = 0.7
    cross_entity_cluster: float = 0.6

    @classmethod
    def from_env(cls, environ: dict | None = None) -> Settings:
        environ = os.environ if environ is None else environ
        known = {}
        for f in fields(cls):
            if (raw := environ.get(f.name.upper())) is not None:
                kind = type(f.default)
                known[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**known)
