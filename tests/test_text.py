import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import labels, numbers, payloads, similarity, text, urls
from veilframe.sources import words


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expression).collect()]


def test_match_offsets_equal_finditer(spark):
    docs = {1: "a@b.co, x c@d.org", 2: "none", 3: "é a@b.com\n\nz@y.xw" * 3, 4: "", 5: None}
    pattern = r"[a-z]+@[a-z]+\.[a-z]+"
    got = {(r.doc_id, r.start, r.end, r.match) for r in text.match_spans(spark.createDataFrame(docs.items(), "doc_id long, text string"), ["doc_id"], pattern).collect()}
    assert got == {(k, *m.span(), m.group()) for k, v in docs.items() for m in re.finditer(pattern, v or "")}


@pytest.mark.parametrize("size,overlap", [(30, 5), (2000, 200), (7, 6), (1, 0)])
def test_chunks(spark, size, overlap):
    docs = [(n, "x" * n) for n in (0, 1, 25, 29, 30, 31, 54, 55, 56, 100, 2000, 2001, 3801)]
    want = set()
    for k, t in docs:
        at = 0
        while t:
            want.add((k, at, t[at : at + size]))
            if at + size >= len(t):
                break
            at += size - overlap
    got = {(r.k, r.global_offset, r.chunk_text) for r in text.chunk(spark.createDataFrame(docs, "k int, text string"), size, overlap).collect()}
    assert got == want


def test_chunk_arguments(spark):
    df = spark.createDataFrame([("x",)], "text string")
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            text.chunk(df, size, overlap)


def test_word_spans_rebuild_the_text(spark):
    docs = {1: "a  bc\n d", 2: " lead", 3: "", 4: None, 5: "one", 6: "é x " * 10}
    got = words.word_spans(spark.createDataFrame(docs.items(), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.word_index, r.start, r.end, r.word) for r in got} == {(k, i, *m.span(), m.group()) for k, v in docs.items() for i, m in enumerate(re.finditer(r"\S+", v or ""))}
    assert {r.line_key for r in got if r.doc_id == 6} == {"text:0", "text:1"}


def test_text_functions(spark):
    assert column(spark, ["abc", "1O2 I", "a1l", "x-y!", "", None], text.normalize_for_fuzzy("v")) == ["ABC", "102 I", "A11", "X Y", "", ""]
    assert column(spark, ["hi", "<think>a</think> b", "a <think>b", "x<think>1</think>y<think>2</think>z", "", None], text.strip_think("v")) == ["hi", "b", "a", "xyz", "", ""]
    assert column(spark, ["```json\n[1]\n```", "[1]", "``` \nx"], text.strip_fence("v")) == ["[1]", "[1]", "x"]
    assert column(spark, ["“a”: ‘b’,}", "[1, ]"], text.repair_json("v")) == ["\"a\": 'b'}", "[1 ]"]
    assert column(spark, ["id", "filename", "metadata.item", "x.id", "name", "email", "user.password"], text.is_ignored_key("v")) == [True] * 4 + [False] * 3
    assert column(spark, ["/tmp/A.PDF", "x.y.pdf"], text.sanitized_name("v")) == ["sanitized_A.pdf", "sanitized_x.y.pdf"]
    assert column(spark, [" a\n b ", "x" * 9], text.compact("v", 5)) == ["a b", "xxxxx..."]
    assert column(spark, ["ab", "é1 " * 10, None], text.is_meaningful("v")) == [False, True, False]
    got = column(spark, ["doc"], text.prompt("v", F.lit(True), F.lit("bad")))[0]
    assert [m.role for m in got] == ["system", "user"] and "[TABLE]" in got[0].content and "bad" in got[1].content


def test_number_functions(spark):
    assert column(spark, ["0.5", "90%", "score 85", "", None, "250", "-1", "7 %"], numbers.confidence("v")) == pytest.approx([0.5, 0.9, 0.85, 0.85, 0.85, 1.0, 0.0, 0.07])
    assert column(spark, ["A", "A B C D", "A B C D E F", "X" * 45], numbers.adaptive_threshold("v", 90)) == [88, 84, 80, 80]
    df = spark.createDataFrame([(0, 10, 5, 15), (0, 10, 10, 20), (0, 10, 0, 10)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(numbers.span_iou("a", "b", "c", "d")).collect()] == pytest.approx([1 / 3, 0.0, 1.0])
    assert column(spark, ["1.5", "x", None], numbers.safe_float("v", 9.0)) == [1.5, 9.0, 9.0]
    assert column(spark, ["2024-01-02T03:04:05Z", "nonsense", ""], numbers.parse_iso("v").isNull()) == [False, True, True]
    times = spark.createDataFrame([("2024-01-01T00:00:00", "2024-01-01T00:00:01.5"), ("2024-01-02T00:00:00", "2024-01-01T00:00:00"), (None, "2024-01-01T00:00:00")], "a string, b string")
    assert [r[0] for r in times.select(numbers.elapsed(numbers.parse_iso("a"), numbers.parse_iso("b"))).collect()] == [1.5, 0.0, None]
    sizes = spark.createDataFrame([(100.0, 100.0), (600.0, 800.0), (1000.0, 1000.0)], "w double, h double")
    assert [r[0] for r in sizes.select(numbers.ocr_scale("w", "h")).collect()] == pytest.approx([2.24, 2.0, 1.8])


def test_labels(spark):
    assert column(spark, ["email", " phone-", "Mobile Phone", "", None, "foo bar"], labels.normalize_label("v")) == ["EMAIL_ADDRESS", "PHONE_NUMBER", "PHONE_NUMBER", "UNKNOWN", "UNKNOWN", "FOO_BAR"]
    assert column(spark, ["email", "foo"], labels.capability_label("v")) == ["EMAIL_ADDRESS", None]
    assert column(spark, ["$ 1,000.50 fee", "New York.", "tx", "N.Y.", "Acme"], labels.classify_quote("v")) == ["FINANCIAL_PENALTY_AMOUNT", "JURISDICTION_STATE", "JURISDICTION_STATE", "LEGAL_PARTY_NAME", "LEGAL_PARTY_NAME"]
    assert column(spark, ["name", "phone", "street-address", " odd thing! ", ""], labels.normalize_category("v", F.lit("Acme"))) == ["PERSON", "PHONE_NUMBER", "STREET_ADDRESS", "ODD_THING", "LEGAL_PARTY_NAME"]
    assert column(spark, ["Acme Inc.", "Jane Roe"], labels.reclassify(F.lit("PERSON"), "v")) == ["ORGANIZATION", "PERSON"]
    assert labels.target_types("email_address, nope", ["EMAIL_ADDRESS", "URL"]) == (["EMAIL_ADDRESS"], ["NOPE"])
    assert labels.target_types("ALL", ["URL", "EMAIL_ADDRESS"]) == (["EMAIL_ADDRESS", "URL"], [])


@pytest.mark.parametrize(
    "quote,kind,rejected",
    [("", "PERSON", True), ("--", "PERSON", True), ("secure storage", "PERSON", True), ("the", "URL", True), ("Abc", "PERSON", True), ("IBM", "ORGANIZATION", False),
     ("john smith", "PERSON", True), ("John Smith", "PERSON", False), ("sk-12ab", "API_KEY", False), ("2024-01-02", "DATE", False), ("Acme", "RETENTION_POLICY", True)],
)
def test_low_signal(spark, quote, kind, rejected):
    assert column(spark, [quote], labels.is_low_signal("v", F.lit(kind))) == [rejected]


def test_oversized(spark):
    assert column(spark, ["a b", "w " * 15, "x" * 141, "A. B! c d e f g h", ""], labels.is_oversized("v")) == [False, True, True, True, False]


def test_promotion(spark):
    rows = [("URL", 0.5, "x.co", "see x.co"), ("DATE", 0.4, "1234", "your pin is 1234"), ("PHONE_NUMBER", 0.5, "12345678", "customer id 12345678"), ("PHONE_NUMBER", 0.9, "12345678", "customer id 12345678"), ("PERSON", 0.3, "Bo", "Bo")]
    got = spark.createDataFrame(rows, "t string, s double, m string, c string").select(labels.promote("t", "s", "m", "c").alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("URL", 0.85), ("SECURITY_CODE", 0.89), ("CUSTOMER_IDENTIFIER", 0.86), ("PHONE_NUMBER", 0.9), ("PERSON", 0.3)]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prior = 0
        for k, y in enumerate(b, 1):
            prior, row[k] = row[k], prior + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@pytest.mark.parametrize("a,b", [("", ""), ("abc", "abc"), ("kitten", "sitting"), ("a b c", "c b a"), ("abcdef", "xxabcdexx"), ("aaaa", "aa")])
def test_similarities(a, b):
    assert similarity.lcs(a, b) == brute_lcs(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a)
    assert not a or similarity.partial_ratio(a, a + "tail") == 100.0
    if set(a.split()) == set(b.split()) and a.split():
        assert similarity.token_sort_ratio(a, b) == 100.0 == similarity.token_set_ratio(a, b)
    assert all(0 <= f(a, b) <= 100 for f in (similarity.ratio, similarity.token_sort_ratio, similarity.token_set_ratio, similarity.partial_ratio))


def test_similarity_columns(spark):
    df = spark.createDataFrame([("AB CD", "CD AB"), (None, "x")], "a string, b string")
    got = df.select(similarity.token_sort_column("a", "b"), similarity.window_similarity_column("a", "b")).collect()
    assert got[0][0] == 100.0 and got[1][0] is None
    assert similarity.window_similarity("A", "A B C D E") == 100.0 - 8.0
    assert similarity.window_similarity("AB", "AB CD") >= 96.0


ANSWERS = [
    ('[{"quote": "Jane", "category": "name", "confidence": 0.9}]', [("Jane", "name", 0.9)], True),
    ("", [], True),
    ("   ", [], True),
    ('[{"quote": "Jane"}] ]', [("Jane", "", 0.85)], True),
    ("none found", [], True),
    ("I could not do this because the text is of a kind that I am unable to look at, sorry for that; please try it again with another one of your texts, will you", [], False),
    ('```json\n{"results": [{"text": "A", "type": "ORG", "score": "95%"}]}\n```', [("A", "ORG", 0.95)], True),
    ("[]", [], True),
    ("{'quote': 'Bo', 'category': 'person'}", [("Bo", "person", 0.85)], True),
    ("| Jane Roe | person | 80% |", [("Jane Roe", "person", 0.8)], True),
    ("- quote: Jane; category: name; confidence: 0.7", [("Jane", "name", 0.7)], True),
    ('1. "Acme" ORGANIZATION 0.9', [("Acme", "ORGANIZATION", 0.9)], True),
    ("[{“quote”: “X”,}]", [("X", "", 0.85)], True),
    ('[{"quote": "a  B", "confidence": 0.2}, {"quote": "A b", "confidence": 0.6}]', [("A b", "", 0.6)], True),
    ('<think>[{"quote": "no"}]</think>[{"quote": "yes"}]', [("yes", "", 0.85)], True),
]


def test_answers(spark):
    got = column(spark, [a for a, _, _ in ANSWERS], payloads.parse_answer(F.col("v")))
    assert [([tuple(i) for i in g["items"]], g.ok) for g in got] == [(items, ok) for _, items, ok in ANSWERS]


def test_completion(spark):
    raw = ['{"choices": [{"message": {"content": "hi"}}]}', '{"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}', "{}"]
    assert column(spark, raw, payloads.completion_text(F.col("v"))) == ["hi", "ab", None]


def test_json_values(spark):
    t = '{"name": "Jane", "id": 7, "tags": ["x", {"deep": true}]}'
    assert payloads.flatten(payloads.load(t)) == [("name", "Jane"), ("tags", "x"), ("tags.deep", "true")]
    assert [t[a:b] for a, b in payloads.value_segments(t)] == ["Jane", "x", "true"]
    assert payloads.value_segments("Some prose with [12] in it and more words all around it") == []
    assert payloads.value_segments("see [12]", mostly=0) == [(5, 7)]
    pairs = 'name: "Jane Roe", id: 5, city: Rome'
    assert [pairs[a:b] for a, b in payloads.value_segments(pairs)] == ["Jane Roe", "Rome"]
    got = column(spark, [t], payloads.project(F.col("v"), payloads.value_segments_column(F.col("v"))))
    assert got == ["Jane\nx\ntrue"]


def test_allowed_hosts(spark):
    pages = spark.createDataFrame([(1, "https://a.b.com/x"), (2, "http://b.com"), (3, "http://xb.com"), (4, "http://c.org:80/"), (5, "nonsense"), (6, None)], "page_id int, url string")
    rules = spark.createDataFrame([("*.b.com",), ("C.ORG ",), ("bad_rule",), (None,)], "rule string")
    assert {r.page_id for r in urls.allowed(pages, rules).collect()} == {1, 2, 4}
    assert urls.allowed(pages, rules.limit(0)).count() == 0
