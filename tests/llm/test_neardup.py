import random

import pytest

from tests.llm.helpers import ODD, frame, prose
from veilframe.llm.components import components
from veilframe.llm.neardup import near_duplicates


def word_sets(text, words):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(docs, words, percent):
    sets = {k: word_sets(v, words) for k, v in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in ids}


def near(text, share, seed):
    r = random.Random(seed)
    return " ".join("z%d" % r.randrange(10**6) if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    docs = {}
    for k in range(30):
        base = prose(k, 30 + 9 * k, 3000)
        docs |= {10 * k: base, 10 * k + 1: base.upper(), 10 * k + 2: base + " more"}
        docs |= {10 * k + 3 + j: near(base, 0.01 * (j + 1), j) for j in range(5)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, docs.items()), words, percent).collect()}
    assert got == brute(docs, words, percent)


def test_large_group_of_near_copies(spark):
    base = prose(1, 200, 3000)
    docs = {k: near(base, 0.02 + 0.01 * (k % 4), k) for k in range(300)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, docs.items()), 3, 85).collect()}
    assert got == brute(docs, 3, 85)


def test_odd_rows_and_empty_table(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, ODD), 3, 85).collect()}
    assert (5, 1, 5, True) in got and (6, 1, 5, False) in got
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (None, 0, None, True) in got and (None, 2, None, True) in got
    assert sum(x[0] == 7 for x in got) == 1
    assert near_duplicates(frame(spark, []), 3, 85).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200}


def test_group_around_the_threshold(spark):
    """Many copies on either side of the limit: linked and unlinked members share buckets."""
    base = prose(5, 150, 5000)
    docs = {k: near(base, 0.03 if k % 2 else 0.075, k) for k in range(160)}
    docs |= {500 + k: " ".join(base.split()[k % 40 :]) for k in range(60)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, docs.items()), 3, 85).collect()}
    want = brute(docs, 3, 85)
    assert got == want and len({c for _, c, _ in want.values()}) > 20
