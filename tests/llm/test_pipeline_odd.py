"""What the stages' docstrings say of null and empty texts, repeated rows and empty tables."""

import corpus_pipeline as P

from .helpers import frame, prose


def kept(stage, spark, rows, sf_dir):
    return sorted(((r.doc_id, r.text) for r in stage(spark, frame(spark, rows), sf_dir).collect()), key=repr)


def test_texts_without_words_and_repeated_rows(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, prose(8, 60)), (3, prose(8, 60)), (None, "alone here")]
    once = sorted({(k, t) for k, t in rows}, key=repr)
    assert kept(P.near_dedup, spark, rows, sf_dir) == once
    assert kept(P.decontamination, spark, rows, sf_dir) == sorted(rows, key=repr)
    pieces = P.pack(spark, frame(spark, rows), sf_dir).collect()
    assert sum(p.length for p in pieces if p.doc_id in (1, 2)) == 2
    whole = {p.doc_tokens for p in pieces if p.doc_id == 3}
    assert len(whole) == 1 and sum(p.length for p in pieces if p.doc_id == 3) == 2 * whole.pop()


def test_no_labels_and_empty_tables(spark, sf_dir):
    assert kept(P.language_id, spark, [(k, prose(k, 20)) for k in range(8)], sf_dir) == []
    for _, stage in P.STAGES:
        assert stage(spark, frame(spark, []), sf_dir).count() == 0
