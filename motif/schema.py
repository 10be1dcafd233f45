"""Schemas of the entities and the engine's settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

SOURCE_FILES = "event_seq long, path string, language string, source string, event_ts timestamp"
SNAPSHOT = "path string, mtime double"
UNIT = (
    "unit_pos int, name string, language string, source_code string, node_type string, decorators array<string>, "
    "calls array<string>, exports boolean, line_start int, line_end int, n_lines int"
)
UNITS = f"event_seq long, path string, {UNIT}"
CANDIDATE = (
    "structural_hash string, source_code string, abstract_signature string, language string, frequency long, first_seen_file string, "
    "contexts array<string>, complexity_score double, node_type string, decorators array<string>, calls array<string>, first_seen_ts timestamp"
)
PARAMETERS = "array<struct<name:string,type:string,default:string,description:string>>"
SKILL = (
    "skill_name string, category string, description string, tags array<string>, code string, usage_example string, complexity string, "
    f"composes_with array<string>, parameters {PARAMETERS}, pattern_hash string, frequency long, contexts array<string>, language string, "
    "node_type string, crystallized_at double"
)
COMPOSITION = (
    "name string, component_names array<string>, component_sources array<string>, pattern_type string, language string, frequency long, "
    "contexts array<string>, call_chain array<string>"
)

# Languages by extension, unit kinds, and categories.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx"}
FILE_ENDINGS = {"python": "py", "javascript": "js", "typescript": "ts", "jsx": "jsx", "tsx": "tsx"}
NODE_TYPES = ("function", "class", "component", "hook", "arrow_fn", "composed")
CATEGORIES = (
    "io", "parsing", "api_client", "data_transform", "validation", "concurrency", "caching", "string_utils", "filesystem",
    "networking", "auth", "testing", "logging", "composed",
)


@dataclass(frozen=True)
class Settings:
    """What can be set; from_environment() reads MOTIF_<NAME> of each."""

    min_lines: int = 5
    min_frequency: int = 2
    min_complexity: float = 2.0
    similarity: float = 0.85
    detect_classes: bool = True
    detect_compositions: bool = True
    min_co_occurrence: int = 2
    max_results: int = 5
    backend: str = "offline"
    model: str = ""
    extensions: tuple = tuple(LANGUAGES)
    ignored_dirs: tuple = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".next", "coverage", ".motif")
    ignored_globs: tuple = (
        "*/.git/*", "*/node_modules/*", "*/__pycache__/*", "*/dist/*", "*/build/*", "*/.venv/*", "*/venv/*", "*/.next/*", "*/coverage/*",
    )
    debounce_seconds: float = 2.0

    @classmethod
    def from_environment(cls) -> Settings:
        found = {}
        for f in fields(cls):
            if (value := os.environ.get(f"MOTIF_{f.name.upper()}")) is not None:
                kind = type(f.default)
                found[f.name] = value.lower() in ("1", "true", "yes") if kind is bool else tuple(value.split(",")) if kind is tuple else kind(value)
        return cls(**found)
