"""Greedy string tiling against a brute-force version."""

import random
import time

import numpy as np
import pytest

from tests.llm.helpers import ODD, frame, prose
from veilframe.llm import decontam


def brute(doc, item, size):
    """The longest common run of unmarked tokens is marked, the earliest of equal ones, until none of ``size`` is left."""
    used_doc, used_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not used_doc[i + k] and not used_item[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < size:
            return covered
        used_doc[i : i + k], used_item[j : j + k] = [True] * k, [True] * k
        covered += k


def case(r):
    words = r.choice([2, 4, 30])
    item = [r.randrange(words) for _ in range(r.randrange(1, 30))]
    doc = [r.randrange(words) for _ in range(r.randrange(0, 40))]
    for _ in range(r.randrange(4)):
        a, at = r.randrange(len(item)), r.randrange(len(doc) + 1)
        doc[at:at] = item[a : a + r.randrange(1, 15)]
    return doc, item


@pytest.mark.parametrize("seed", range(150))
def test_tiling_equals_brute_force(seed):
    doc, item = case(random.Random(seed))
    text = lambda x: " ".join(f"w{k}" for k in x)
    block = decontam.Benchmark([(7, text(item)), (8, "other words that are not there")], 5)
    got = dict(block.covered(decontam.Tokens().of(text(doc)))).get(7, 0.0)
    assert got == brute(doc, item, min(5, len(item))) / len(item)


def test_operator_equals_brute_force(spark):
    r = random.Random(5)
    items = [[r.randrange(6) for _ in range(r.randrange(1, 25))] for _ in range(12)]
    docs = {}
    for k in range(40):
        docs[k] = [r.randrange(6) for _ in range(r.randrange(30))] + r.choice(items) + [r.randrange(60) for _ in range(5)]
    text = lambda x: " ".join(f"w{k}" for k in x)
    bench = spark.createDataFrame([(f"item {k:02d}", text(x)) for k, x in enumerate(items)], "item_id string, text string")
    want = {}
    for k, doc in docs.items():
        shares = [brute(doc, x, min(5, len(x))) / len(x) for x in items]
        want[k] = (max(shares), [f"item {n:02d}" for n, share in enumerate(shares) if share >= 0.5])
    rows = frame(spark, [(k, text(x)) for k, x in docs.items()])
    for block_chars in (10**6, 150):
        got = {x.doc_id: (x.coverage, x.item_ids) for x in decontam.decontaminate(rows, bench, block_chars=block_chars).collect()}
        assert got == want


def test_longest_run_by_halving():
    r = np.random.default_rng(1)
    a, b = r.integers(1, 50, 300).astype(np.uint64), r.integers(1, 50, 200).astype(np.uint64)
    b[40:77] = a[200:237]
    assert decontam.longest(decontam.Runs(a), decontam.Runs(b), 5, 200) >= 37
    assert decontam.longest(decontam.Runs(a[:100]), decontam.Runs(b[:30]), 5, 30) == 0


def test_repetitive_documents_are_fast():
    block = decontam.Benchmark([(k, "one " * 200 + f"end{k}") for k in range(5)], 5)
    h = decontam.Tokens().of("one " * 20_000)
    began = time.perf_counter()
    assert {round(share, 6) for _, share in block.covered(h)} == {round(200 / 201, 6)}
    assert time.perf_counter() - began < 1


def test_extra_columns_and_odd_rows(spark):
    rows = frame(spark, [*ODD, (11, prose(4, 60, 3000))]).selectExpr("*", "'own' as coverage", "1 as digest", "2 as doc", "3 as own")
    bench = spark.createDataFrame([(1, prose(4, 60, 3000)), (2, prose(9, 60, 3000)), (None, "x"), (3, None)], "item_id long, text string")
    for block_chars in (10**6, 100):
        got = decontam.decontaminate(rows, bench, block_chars=block_chars)
        assert got.columns == [*(c for c in rows.columns if c != "coverage"), "coverage", "item_ids", "contaminated"]
        assert sorted((r.doc_id or 0, r.contaminated, r.own) for r in got.collect()) == sorted([(r[0] or 0, False, 3) for r in ODD] + [(11, True, 3)])
