"""Tables of the evidence graph: columns, keys and permitted values."""

from __future__ import annotations

#: Name to (columns, natural key).
TABLES: dict[str, tuple[str, list[str]]] = {
    "papers": ("arxiv_id string, title string, abstract string, doi string, published_at string, authors array<struct<name:string>>, latest_version string", ["arxiv_id"]),
    "paper_versions": ("paper_version string, arxiv_id string, version int, source_kind string, fidelity string, source_sha256 string, parser_version string, flattened_tex string, ingested_at timestamp", ["paper_version"]),
    "sections": ("id string, paper_version string, section_path string, level int, title string, latex_label string, body string, src_line_start int, src_line_end int, ordinal int", ["paper_version", "section_path"]),
    "equations": ("id string, paper_version string, content_hash string, latex string, environment string, is_numbered boolean, derived_number string, number_conf string, latex_label string, section_id string, src_line int, ordinal int", ["paper_version", "content_hash"]),
    "components": ("id string, paper_version string, slug string, name string, kind string, description string, section_id string, source string", ["paper_version", "slug"]),
    "algorithms": ("id string, paper_version string, slug string, name string, body string, presentation string, extractable boolean, section_id string, src_line int", ["paper_version", "slug"]),
    "stated_values": ("id string, paper_version string, symbol string, value_text string, value_num double, context string, section_id string, src_line int", ["id"]),
    "declared_urls": ("id string, paper_version string, url string, host string, owner string, repo string, context string, section_id string, in_abstract boolean, src_line int", ["paper_version", "url"]),
    "bib_entries": ("id string, paper_version string, bib_key string, raw string, authors string, title string, year int, arxiv_id string, doi string, cite_count bigint", ["paper_version", "bib_key"]),
    "citation_sites": ("id string, paper_version string, bib_key string, section_id string, context string, src_line int, command string", ["id"]),
    "claims": ("id string, paper_version string, statement string, kind string, section_id string, source string", ["id"]),
    "repos": ("id string, owner string, name string, stars bigint, license string, archived boolean, description string", ["id"]),
    "repo_snapshots": ("id string, repo_id string, commit_sha string, indexed_at timestamp, indexer string, symbol_count bigint, file_count bigint", ["repo_id", "commit_sha"]),
    "symbols": ("id string, snapshot_id string, qualified_name string, name string, kind string, file_path string, line_start int, line_end int, signature string, parent string", ["id"]),
    "code_files": ("repo string, path string, text string", ["repo", "path"]),
    "implementation_candidates": ("id string, paper_version string, repo_id string, relation string, confidence string, coverage_score double, coverage_checked string, rank int", ["paper_version", "repo_id"]),
    "mappings": ("id string, paper_version string, snapshot_id string, anchor_kind string, anchor_id string, symbol_id string, status string, confidence string, method string, reasoning string", ["id"]),
    "differences": ("id string, paper_version string, snapshot_id string, kind string, paper_states string, code_does string, difference string, severity string, confidence string", ["id"]),
    "evidence": ("id string, kind string, uri string, excerpt string, locator string, provenance string", ["id"]),
    "evidence_links": ("evidence_id string, subject_kind string, subject_id string, stance string", ["evidence_id", "subject_kind", "subject_id"]),
    "lineage_edges": ("id string, from_paper string, to_paper string, relation string, is_influential boolean, intents array<string>, contexts array<string>, confidence string, source string", ["from_paper", "to_paper", "relation"]),
    "analyses": ("id string, paper_version string, schema_version string, fields map<string,string>, author string, created_at timestamp", ["id"]),
    "http_cache": ("cache_key string, source string, url string, body binary, fetched_at timestamp, expires_at timestamp", ["cache_key"]),
    "rate_limit_buckets": ("source string, tokens double, last_refill_at timestamp, capacity double, refill_per_sec double", ["source"]),
    "meta": ("key string, value string", ["key"]),
}

#: Permitted values by table and column.
PERMITTED = {
    ("components", "kind"): ["architecture", "module", "loss", "optimizer", "dataset", "preprocessing", "training", "inference", "evaluation", "other"],
    ("components", "source"): ["DETERMINISTIC", "AGENT", "SERVER_LLM"],
    ("algorithms", "presentation"): ["latex_env", "listing", "figure_image", "prose"],
    ("mappings", "status"): ["MATCHED", "ABSENT", "DIVERGENT", "AMBIGUOUS", "UNKNOWN"],
    ("mappings", "confidence"): ["CONFIRMED", "LIKELY", "POSSIBLE", "UNKNOWN"],
    ("differences", "severity"): ["BLOCKING", "SIGNIFICANT", "MINOR", "COSMETIC"],
    ("lineage_edges", "confidence"): ["CONFIRMED", "LIKELY", "POSSIBLE", "UNKNOWN"],
    ("evidence_links", "stance"): ["SUPPORTS", "CONTRADICTS"],
}
