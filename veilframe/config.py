"""Settings of the sanitization engine."""

from __future__ import annotations

import re
from collections.abc import MutableMapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of every operator; pass another instance to change them."""

    min_entity_confidence: float = 0.7
    native_text_min_alnum: int = 20
    native_over_ocr: float = 1.12
    chunk_size: int = 2000
    chunk_overlap: int = 200
    fuzzy_threshold: int = 90
    fuzzy_min_padding: int = 1
    fuzzy_max_padding: int = 2
    fuzzy_penalty: float = 2.0
    fuzzy_penalty_cap: float = 14.0
    llm_text_limit: int = 20_000
    llm_raw_limit: int = 300_000
    llm_max_pages: int = 0
    llm_passes: int = 2
    llm_attempts: int = 3
    llm_min_chars: int = 0
    llm_skip_when_found: int = 0
    max_span_tokens: int = 14
    max_span_chars: int = 140
    match_iou: float = 0.5
    box_merge_iou: float = 0.35
    padding_x: float = 0.8
    padding_y: float = 1.2
    tighten: bool = False
    inset_x_ratio: float = 0.0
    inset_y_ratio: float = 0.0
    inset_x_max: float = 0.0
    inset_y_max: float = 0.0
    safe_gap: float = 0.6
    max_upload_mb: int = 30
    queue_size: int = 32
    job_ttl_seconds: int = 1800
    table_min_rows: int = 2
    table_min_cols: int = 2
    table_min_confidence: float = 0.58
    table_row_tolerance: float = 4.0
    table_column_gap: float = 14.0
    table_column_drift: float = 14.0
    table_continuation_gap: float = 1.9
    mask: str = "█"


DEFAULT = EngineConfig()

#: ``NAME=value`` of an env file: the value bare up to a comment, or quoted.
_SETTING = re.compile(r"""\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(?:"((?:\\.|[^"\\])*)"|'([^']*)'|((?:(?!\s#)[^\n])*))""")


def read_env(text: str, env: MutableMapping[str, str]) -> dict[str, str]:
    """Settings of an env file's text; those that ``env`` lacks are put there.

    A ``#`` begins a comment at a line's start or after white space, but not in quotes.
    Lines that are no settings are passed over; of repeated names the last counts.
    """
    found: dict[str, str] = {}
    for line in text.splitlines():
        m = None if line.lstrip().startswith("#") else _SETTING.match(line)
        if m:
            value = next((g for g in m.groups()[1:] if g is not None), "")
            found[m.group(1)] = re.sub(r"\\(.)", r"\1", value) if m.group(2) is not None else value if m.group(3) is not None else "" if value.startswith("#") else value.strip()
    for name, value in found.items():
        env.setdefault(name, value)
    return found


def from_env(env: MutableMapping[str, str], prefix: str = "VEILFRAME_") -> EngineConfig:
    """The defaults, changed by variables like VEILFRAME_CHUNK_SIZE; a value that does not fit its setting's type raises ValueError."""
    changed = {}
    for f in fields(EngineConfig):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        kind = type(f.default)
        if kind is bool:
            if raw.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                raise ValueError(f"{f.name}: {raw!r} is no truth value")
            changed[f.name] = raw.lower() in ("1", "true", "yes", "on")
        else:
            changed[f.name] = kind(raw)
    return EngineConfig(**changed)



#: Bounding box of a word or entity, in page points; pages count from 0.
BOX = "struct<page_number:int,x0:double,y0:double,x1:double,y1:double>"
WORDS = f"doc_id long, word_index int, text string, bbox {BOX}, line_key string"
DETECTIONS = f"doc_id long, seq long, entity_text string, entity_type string, confidence_score double, source string, boxes array<{BOX}>, supporting_sources array<string>, decision_reason string"
