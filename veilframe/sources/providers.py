"""Seams for what needs a library or service that is not here: PDF, OCR, NER, faces, language models.

A provider is a picklable callable from a pandas frame to a pandas frame. It runs in
``mapInPandas``, so its model or session is made once a partition. Without a provider the
stage fails at once instead of yielding nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_REGISTERED: dict[str, tuple[Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], str]] = {}

KINDS = {
    "pdf": "doc_id long, page_number int, block_no int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double",
    "ocr": "doc_id long, page_number int, pass_no int, text array<string>, conf array<string>, left array<double>, top array<double>, width array<double>, height array<double>, block array<int>, par array<int>, line array<int>, scale_x double, scale_y double, shift_x double, shift_y double",
    "ner": "doc_id long, chunk_no int, start int, end int, entity_type string, score double",
    "vision": "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double",
    "llm": "doc_id long, page_number int, raw string",
    "chat": "doc_id long, page_number int, pass_no int, has_table boolean, raw string, error string",
    "pdf_writer": "doc_id long, content binary",
}


def register(kind: str, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
    """``factory`` makes the provider on the executor."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of provider: {kind}")
    _REGISTERED[kind] = (factory, KINDS[kind])


def unregister(kind: str) -> None:
    _REGISTERED.pop(kind, None)


def provide(kind: str, rows: DataFrame) -> DataFrame:
    if kind not in _REGISTERED:
        raise LookupError(f"no provider for {kind!r}: register one")
    factory, schema = _REGISTERED[kind]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for frame in frames:
            yield provider(frame)[names]

    return rows.mapInPandas(run, schema)
