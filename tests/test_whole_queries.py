"""Queries run over whole tables and texts: against brute force on small tables."""

import random

import pytest

from veilframe.config import DEFAULT
from veilframe.functions import similarity
from veilframe.operators import fuzzy
from veilframe.plans.queries import QUERIES

CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def full_similarity(quote, window):
    score = max(f(quote, window) for f in (similarity.ratio, similarity.token_sort_ratio, similarity.token_set_ratio, similarity.partial_ratio))
    extra = max(0, len(window.split()) - len(quote.split()))
    score -= min(DEFAULT.fuzzy_penalty_cap, extra * DEFAULT.fuzzy_penalty)
    return max(score, 96.0) if extra <= 2 and (quote in window or window in quote) else score


def test_similarity_is_exact_from_least_on():
    r = random.Random(5)
    for _ in range(3000):
        a, b = (" ".join("".join(r.choice("ABCD") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(0, 6))) for _ in range(2))
        want = full_similarity(a, b)
        assert similarity.window_similarity(a, b) == want
        got = similarity.window_similarity(a, b, least=80)
        assert got == want if want >= 80 else got <= want


def test_fuzzy_localization_takes_every_turn(spark, folder):
    r = random.Random(3)
    text = lambda: " ".join(r.choice(["Anna", "Smith,", "went", "home", "to", "Oslo", "x1"]) for _ in range(r.randrange(4, 14)))
    rows = [(c, t, "user", text()) for c in range(3) for t in range(4)] + [(7, 0, "user", "One"), (7, 1, "user", None), (7, 5, "user", "a  b Anna Smith went")]
    want = set()
    for c, t, _, v in rows:
        if v is None:
            continue
        quote, found, at = " ".join(v.split(" ")[1:4]), [], 0
        q = fuzzy.fold(quote)
        if not q:
            continue
        places = []
        for x in v.split():
            at = v.index(x, at)
            places.append((x, at, at + len(x)))
            at += len(x)
        n = max(1, min(len(quote.split()), len(q.split())))
        for i in range(len(places)):
            for size in range(max(1, n - DEFAULT.fuzzy_min_padding), n + DEFAULT.fuzzy_max_padding + 1):
                window = fuzzy.fold(" ".join(p[0] for p in places[i : i + size]))
                if i + size <= len(places) and window:
                    found.append((full_similarity(q, window), (window != q, abs(len(window.split()) - len(q.split())), -size), places[i][1], places[i + size - 1][2]))
        want |= {(c, t, quote, a, b, s) for s, _, a, b in fuzzy.non_overlapping(found, DEFAULT.fuzzy_threshold)}
    got = QUERIES["fuzzy_localization"](spark, folder("conversations", rows, CONVERSATIONS)).collect()
    assert {(g.doc_id, g.page_number, g.quote, g.start, g.end, g.similarity) for g in got} == want
    assert len(got) == len(want) and {(g.doc_id, g.page_number) for g in got} >= {(c, t) for c in range(3) for t in range(4)}


#: Texts and what is to be found in them.
SENSITIVE = [
    ("Write to ann@mail.example.org or see https://a.example.com/x?y=1 today", [("ann@mail.example.org", "EMAIL_ADDRESS"), ("https://a.example.com/x?y=1", "URL")]),
    ("pay to GB82 WEST 1234 5698 7654 32 not GB83 WEST 1234 5698 7654 32", [("GB82 WEST 1234 5698 7654 32", "IBAN_CODE")]),
    ("ssn 123-45-6789, born 1980-02-03", [("123-45-6789", "US_SSN"), ("1980-02-03", "DATE_TIME")]),
    ("my customer number is AB-778812 and the passcode: 4711", [("AB-778812", "CUSTOMER_IDENTIFIER"), ("4711", "SECURITY_CODE")]),
    ("host 10.1.2.3 card 4111 1111 1111 1111 not 4111 1111 1111 1112", [("10.1.2.3", "IP_ADDRESS"), ("4111 1111 1111 1111", "CREDIT_CARD")]),
    ('call +1 (555) 123-4567, password="hunter22x"', [("+1 (555) 123-4567", "PHONE_NUMBER"), ('password="hunter22x"', "PASSWORD")]),
    ("nothing here", []),
]


@pytest.fixture
def sensitive(folder):
    return folder("documents", list(enumerate(t for t, _ in SENSITIVE)), "doc_id long, text string")


def test_all_detectors_mask_and_locate(spark, sensitive):
    def run(name):
        return QUERIES[name](spark, sensitive).collect()

    spans, masked, hits = set(), {}, set()
    for k, (t, found) in enumerate(SENSITIVE):
        masked[k] = t
        for match, kind in found:
            start, at = t.index(match), 0
            spans.add((k, start, start + len(match), kind))
            masked[k] = masked[k].replace(match, "\u2588", 1)
            for w in t.split():
                at = t.index(w, at)
                if at < start + len(match) and at + len(w) > start:
                    hits.add((k, start, kind, w))
                at += len(w)
    assert {(r.doc_id, r.start, r.end) for r in run("segment_merge")} == {s[:3] for s in spans}
    assert {r.doc_id: r.masked_text for r in run("masked_text")} == masked
    assert {(r.doc_id, r.start, r.entity_type, r.word) for r in run("span_word_localization")} == hits
    assert {(r.doc_id, r.start, r.end, r.entity_type) for r in run("span_dedup")} == spans
    kinds = {s[3] for s in spans}
    assert len(kinds) == 11
    assert {(r.entity_type, r.n) for r in run("risk_tier_counts")} == {(k, 1) for k in kinds}
    assert {(r.entity_type, r.entities, r.documents) for r in run("entity_counts")} == {(k, 1, 1) for k in kinds}
    assert {r.doc_id for r in run("resolve_by_box")} == {r.doc_id for r in run("entity_merge")} == set(range(6))
    assert {r.entity_text for r in run("entity_merge")} == {m for _, found in SENSITIVE for m, _ in found}


def test_answers_hold_whole_turns(spark, folder):
    texts = ["short", 'He said "no" \\ and left', "two\nlines\tand more " + "word " * 400 + "end", "a, b: [c] {d} 'e'"]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    got = {r.turn: (r.ok, r.quote) for r in QUERIES["answer_items"](spark, folder("conversations", rows, CONVERSATIONS)).collect()}
    assert got == {k: (True, t) for k, t in enumerate(texts)}


def test_boxes_of_the_whole_text(spark, folder):
    rows = [(1, " ".join(f"word{k}" for k in range(200))), (2, "one"), (3, ""), (4, None)]
    want = {}
    for k, t in rows[:2]:
        every, at, places = t.split(), 0, []
        for w in every:
            places.append((at, at + len(w)))
            at += len(w) + 1
        lines = [(places[i][0], places[min(i + 16, len(places)) - 1][1]) for i in range(0, len(places), 16)]
        width = sum(lines[-1]) / 2
        want |= {(k, f"text:{n}"): (a - 0.8, min(b, width) + 0.8) for n, (a, b) in enumerate(lines)}
    got = QUERIES["box_clip_pad_whole"](spark, folder("documents", rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_key): (round(r.x0, 6), round(r.x1, 6)) for r in got} == {k: (round(a, 6), round(b, 6)) for k, (a, b) in want.items()}
