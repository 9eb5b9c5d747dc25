import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, frame, prose
from veilframe.llm.suffixdedup import anchors, dedup_substrings, merge, neighbour_prefixes


def brute(docs, length):
    seen, out = set(), {}
    for k in sorted(docs):
        raw = (docs[k] or "").encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - length + 1):
            s = raw[q : q + length]
            if s in seen:
                gone[q : q + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    r = random.Random(3)
    docs, passage = {}, prose(99, 40, 3000)
    for k in range(40):
        text = prose(k, r.randrange(5, 200), 3000)
        if k % 3 == 0:
            cut = r.randrange(len(text))
            text = text[:cut] + passage[r.randrange(20) :] + text[cut:]
        if k % 5 == 0:
            text = prose(k // 10, 60, 3000) + " é" * (k % 7) + text
        docs[k] = text
    docs |= {100: docs[7], 101: docs[7], 102: "ab" * 300, 103: "x" * 500, 104: "x" * 99, 105: "x" * 100, 106: "", 107: None, 108: "ab" * 51}
    return docs


@pytest.mark.parametrize("hot", [50_000, 2])
def test_equals_brute_force(spark, hot):
    docs = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(frame(spark, docs.items()).repartition(3), hot=hot).collect()}
    assert got == brute(docs, 100)


def test_two_levels_of_exchange(spark):
    docs = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(frame(spark, docs.items()).repartition(5), fan=2, merge_rows=20).collect()}
    assert got == brute(docs, 100)


def test_very_long_texts(spark):
    """5 MB of one letter, and an n-gram that occurs a million times in one text."""
    grams = "".join(f"{k:06d}" + "the same thirty bytes in a row" for k in range(120_000))
    docs = [(1, "x" * 5_000_000), (2, "own words " + "y" * 1_000_000 + " and an end"), (3, grams), (4, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in dedup_substrings(frame(spark, docs)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got[1] == (5_000_000, 4_999_999, 1) and got[2] == (1_000_021, 999_999, 1) and got[4] == (0, 0, 0)
    assert got[3] == (len(grams), 0, 0)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        dedup_substrings(frame(spark, [("a", "x" * 200), ("b", "x" * 200)], "doc_id string, text string"))


def test_odd_rows_and_empty_table(spark):
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in dedup_substrings(frame(spark, [*ODD, (None, "x" * 120)])).collect()]
    assert sorted(x for x in got if x[0] == 7) == [(7, 5000, 5000)] * 2
    assert (None, 0, 0) in got and (None, 120, 119) in got and (1, 0, 0) in got
    assert dedup_substrings(frame(spark, [])).collect() == []


def test_windows_of_equal_bytes_have_equal_anchors():
    r = np.random.default_rng(1)
    raw = r.integers(97, 99, 3000).astype(np.uint8)
    raw = np.concatenate([raw, raw[500:1500], raw[:700]])
    h, place, first, last = anchors(raw)
    by_window, at = {}, 0
    for k in range(len(h)):
        assert first[k] == at and first[k] <= last[k] and first[k] <= place[k] <= first[k] + 76 and last[k] <= place[k]
        at = last[k] + 1
        for q in range(first[k], last[k] + 1):
            assert by_window.setdefault(raw[q : q + 100].tobytes(), (h[k], place[k] - q)) == (h[k], place[k] - q)
    assert at == len(raw) - 99


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 2 for x in b)), max_size=8), max_size=6))
def test_merge_sorts_and_gives_common_prefixes(runs):
    runs = [sorted(r) for r in runs]
    coded = [(r, neighbour_prefixes(r)) for r in runs]
    order, lcps = merge(coded)
    got = [runs[a][b] for a, b in order]
    assert got == sorted(x for r in runs for x in r)
    assert lcps[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(got, got[1:])]
