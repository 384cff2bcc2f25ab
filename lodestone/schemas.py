"""Schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

FILES = "file_id long, path string, size long, mtime timestamp, digest string, content binary"
LINES = "file_id long, path string, line int, content string"
CHUNKS = "chunk_id long, file string, start_line int, end_line int, text string"
POSTINGS = "gram string, chunk_id long"
EDGES = "src string, dst string, reason string"
SYMBOLS = (
    "id string, name string, qualified_name string, kind string, language string, file_path string, line_start int, line_end int, "
    "parent_symbol_id string, signature string, visibility string, modifiers array<string>, parser string, parser_version string, ord long"
)
RAW_SYMBOL_EDGES = "kind string, source_symbol_id string, target_name string, file_path string, line int, confidence double, provenance string, ord long"
SYMBOL_EDGES = (
    "id string, kind string, source_symbol_id string, target_symbol_id string, target_name string, file_path string, line int, "
    "confidence double, provenance string, parser string, parser_version string"
)
RECENCY = "path string, modified boolean, recent boolean, mtime timestamp"
HITS = (
    "file string, line_start int, line_end int, score double, reason string, snippet string, engine string, "
    "symbol_id string, kind string, qualified_name string, ord long"
)
CANDIDATES = (
    "section string, path string, line_start int, line_end int, title string, reason string, content string, confidence double, priority int, "
    "git_boost double, symbol_id string"
)
TRAJECTORY = (
    "run_id string, sequence long, type string, elapsed_ms double, tool string, category string, arguments map<string,string>, "
    "result_size_bytes long, file_paths array<string>, token_usage map<string,long>, usage_semantics string, milestone string, data map<string,string>"
)
