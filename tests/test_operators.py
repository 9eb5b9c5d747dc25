import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.config import BOX, DETECTIONS, EngineConfig
from veilframe.functions import boxes as B
from veilframe.operators import canonical, detect, evaluate, fuzzy, localize, resolve, segments, tables
from veilframe.plans import sanitize
from veilframe.sources import files, providers, sinks, words
from veilframe.streaming import jobs

BOX0, BOX1 = (0, 0.0, 0.0, 10.0, 10.0), (0, 20.0, 0.0, 30.0, 10.0)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def detections(spark, *rows):
    """rows: (text, type, score, source, boxes[, supporting])."""
    return spark.createDataFrame([(1, k, r[0], r[1], r[2], r[3], r[4], r[5] if len(r) > 5 else [], None) for k, r in enumerate(rows)], DETECTIONS)


def test_separators_and_offsets(spark):
    rows = [(1, 0, "one", 0, "a"), (1, 1, "hy-", 0, "a"), (1, 2, "phen", 0, "b"), (1, 3, "next", 0, "c"), (1, 4, "page", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, word_index int, text string, page int, line_key string")
    placed = canonical.place_words(df, "page")
    assert [r.text for r in canonical.canonical_text(placed).collect()] == ["one hy-phen\nnext\npage"]
    whole = "one hy-phen\nnext\npage"
    assert all(whole[r.start_char : r.end_char] == r.text for r in placed.collect())
    pages = spark.createDataFrame([(1, 0, "abc"), (1, 1, None), (1, 2, "x")], "d int, p int, t string")
    assert [r.offset for r in canonical.page_offsets(pages, "d", "p", "t").orderBy("p").collect()] == [0, 4, 5]


def test_page_gate(spark):
    rows = spark.createDataFrame([(1, k, t, n) for k, (t, n) in enumerate([("long text", 0), (" ", 0), ("long text", 5), ("long text", 1), ("long text", 0)])], "doc_id int, page_number int, text string, n_found int")
    assert [r.page_number for r in canonical.gate_pages(rows, 2, 3, 4).orderBy("page_number").collect()] == [0, 3]


def test_detectors(spark):
    t = 'mail a.b@c.org, ip 10.0.0.255, card 4111 1111 1111 1111 or 4111 1111 1111 1112, +1 (499) 555-6503, https://x.y/z, iban GB82WEST12345698765432, ssn 123-45-6789, on 2024-05-06'
    got = {(r.entity_type, r.match) for r in detect.recognize(docs(spark, t)).collect()}
    assert {("EMAIL_ADDRESS", "a.b@c.org"), ("IP_ADDRESS", "10.0.0.255"), ("CREDIT_CARD", "4111 1111 1111 1111"), ("PHONE_NUMBER", "+1 (499) 555-6503"), ("IBAN_CODE", "GB82WEST12345698765432"), ("US_SSN", "123-45-6789"), ("DATE_TIME", "2024-05-06")} <= got
    assert ("CREDIT_CARD", "4111 1111 1111 1112") not in got
    for r in detect.recognize(docs(spark, t)).collect():
        assert t[r.start : r.end] == r.match


@pytest.mark.parametrize(
    "t,want",
    [("Your customer id is AB12-99", [("CUSTOMER_IDENTIFIER", "AB12-99")]), ("customer identifier 12345678", [("CUSTOMER_IDENTIFIER", "12345678")]), ("customer id is active", []), ("order # A1B2", []),
     ("the pin is 4821.", [("SECURITY_CODE", "4821")]), ("OTP: 123", []), ("one-time password 123456789", []), ("nothing", []), ("", []), ("é pin 9999, PIN=8888", [("SECURITY_CODE", "9999"), ("SECURITY_CODE", "8888")])],
)
def test_contextual_rules(spark, t, want):
    got = detect.contextual(docs(spark, t)).orderBy("start").collect()
    assert [(r.entity_type, r.match) for r in got] == want and all(t[r.start : r.end] == r.match for r in got)


def test_refine_keeps_sure_spans_only(spark):
    d = docs(spark, "customer id 12345678 and 999")
    spans = spark.createDataFrame([(0, 12, 20, "PHONE_NUMBER", 0.5, "12345678"), (0, 25, 28, "PHONE_NUMBER", 0.5, "999")], "doc_id long, start long, end long, entity_type string, score double, match string")
    assert [(r.entity_type, r.score) for r in detect.refine(spans, d).collect()] == [("CUSTOMER_IDENTIFIER", 0.86)]


def test_overlap_join_equals_brute_force(spark):
    ws = [(1, k, k * 5, k * 5 + 4) for k in range(200)] + [(2, 0, 0, 900)]
    ss = [(1, 0, 0), (1, 3, 5), (1, 4, 5), (1, 250, 520), (1, 999, 1200), (2, 255, 257), (2, 900, 901), (1, 9, 6)]
    words_df = spark.createDataFrame(ws, "doc_id long, word_index int, start_char long, end_char long")
    spans = spark.createDataFrame(ss, "doc_id long, start long, end long")
    got = sorted((r.doc_id, r.start, r.word_index) for r in localize.overlap_join(spans, words_df).collect())
    assert got == sorted((d, a, i) for d, a, b in ss for e, i, x, y in ws if a < b and d == e and x < b and y > a)


def test_boxes(spark):
    df = spark.createDataFrame([([BOX0, BOX0, (1, *BOX0[1:]), (0, 0.001, 0.0, 10.0, 10.0), BOX1],)], f"b array<{BOX}>")
    assert len(df.select(B.distinct_boxes("b")).first()[0]) == 3
    assert tuple(df.select(B.merge("b")).first()[0]) == (0, 0.0, 0.0, 30.0, 10.0)
    one = spark.createDataFrame([(BOX1,)], f"b {BOX}")
    assert tuple(one.select(B.clip("b", F.lit(25), F.lit(100))).first()[0]) == (0, 20.0, 0.0, 25.0, 10.0)
    assert one.select(B.clip("b", F.lit(15), F.lit(100))).first()[0] is None
    assert tuple(one.select(B.tighten("b")).first()[0]) == pytest.approx((0, 19.2, -1.2, 30.8, 11.2))
    config = EngineConfig(tighten=True, inset_x_ratio=0.5, inset_y_ratio=0.2, inset_x_max=99.0, inset_y_max=2.2)
    assert tuple(one.select(B.tighten("b", config)).first()[0]) == pytest.approx((0, 23.4 - 0.8, 2 - 1.2, 26.6 + 0.8, 8 + 1.2))
    assert tuple(one.select(B.tighten("b", config, F.lit(0.0))).first()[0])[2] == pytest.approx(-1.2)


def test_lines_and_maps(spark):
    rows = [(1, 0, "b", (0, 5.0, 0.0, 9.0, 8.0), "l"), (1, 1, "a", (0, 0.0, 1.0, 4.0, 9.0), "l"), (1, 2, "a", (0, 0.0, 20.0, 4.0, 28.0), "m")]
    df = spark.createDataFrame(rows, "doc_id long, word_index int, text string, bbox " + BOX + ", line_key string")
    assert {(r.line_key, r.phrase, r.y1) for r in localize.phrase_map(df).collect()} == {("l", "a b", 9.0), ("m", "a", 28.0)}
    assert {r.text: len(r.boxes) for r in localize.word_map(df).collect()} == {"a": 2, "b": 1}
    insets = {r.line_key: r.safe_inset for r in localize.safe_insets(localize.line_boxes(df)).collect()}
    assert insets == pytest.approx({"l": 11 / 2 - 0.6, "m": 11 / 2 - 0.6})


def test_nearest_anchor(spark):
    cells = spark.createDataFrame([("g", 10.0), ("g", 55.0), ("g", 90.0)], "g string, x0 double")
    anchors = spark.createDataFrame([("g", 0, 0.0), ("g", 1, 20.0), ("g", 2, 60.0)], "g string, col_index int, anchor double")
    assert [(r.x0, r.col_index, r.delta) for r in localize.nearest_anchor(cells, anchors, "g").orderBy("x0").collect()] == [(10.0, 0, 10.0), (55.0, 2, 5.0)]


def test_segments_and_masks(spark):
    spans = spark.createDataFrame([(0, 10, 20), (0, 5, 15), (0, 25, 30), (0, 30, 31), (0, 40, 40)], "doc_id long, start long, end long")
    assert sorted((r.start, r.end) for r in segments.merge_segments(spans).collect()) == [(5, 20), (25, 31)]
    d = docs(spark, "0123456789" * 5, "untouched")
    got = [r.masked_text for r in segments.mask_text(d, spans, mask="#").orderBy("doc_id").collect()]
    assert got == ["01234#01234#123456789" + "0123456789", "untouched"]


def test_remap(spark):
    segs = spark.createDataFrame([(0, 10, 15), (0, 20, 23)], "doc_id long, start long, end long")
    spans = spark.createDataFrame([(0, 0, 3, "a"), (0, 4, 8, "b"), (0, 6, 99, "c"), (0, 3, 3, "d"), (0, 5, 6, "e")], "doc_id long, start long, end long, n string")
    assert {r.n: (r.start, r.end) for r in segments.remap(spans, segs).collect()} == {"a": (10, 13), "b": (14, 22), "c": (20, 23), "e": (19, 20)}


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("x@y.z", "EMAIL_ADDRESS", 0.9, "Presidio", [BOX0]), ("x@y.z", "EMAIL_ADDRESS", 0.8, "LLM", [BOX0])], ("EMAIL_ADDRESS", "Hybrid", 0.9, "type_consensus")),
        ([("x", "PERSON", 0.85, "LLM", [BOX0]), ("x@y.z", "EMAIL_ADDRESS", 0.75, "Presidio", [BOX0])], ("EMAIL_ADDRESS", "Hybrid", 0.85, "type_matrix_structured_priority")),
        ([("x", "", 0.9, "Presidio", [BOX0])], ("UNKNOWN", "Presidio", 0.9, "type_matrix_missing_type")),
        ([("x", "PERSON", 0.95, "Presidio", [BOX0]), ("xx", "LEGAL_PARTY_NAME", 0.8, "LLM", [BOX0])], ("LEGAL_PARTY_NAME", "Hybrid", 0.95, "type_matrix_llm_context_priority")),
        ([("x", "PERSON", 0.8, "Presidio", [BOX0]), ("x", "ORGANIZATION", 0.85, "Presidio", [BOX0])], ("PERSON", "Presidio", 0.85, "type_matrix_conflict_resolved")),
        ([("x", "PERSON", 0.3, "Presidio", [BOX0])], None),
    ],
)
def test_resolution(spark, rows, want):
    got = resolve.resolve_entities(detections(spark, *rows)).collect()
    assert [(r.entity_type, r.source, r.confidence_score, r.decision_reason) for r in got] == ([want] if want else [])


def test_entities_merge_over_boxes(spark):
    rows = [("Jane  Roe", "PERSON", 0.8, "Presidio", [BOX0, BOX0]), ("jane roe", "PERSON", 0.9, "Presidio", [(1, *BOX1[1:])]), ("Jane Roe", "PERSON", 0.9, "LLM", [BOX1])]
    got = resolve.pages_per_entity(resolve.resolve_entities(detections(spark, *rows))).collect()
    assert {(r.entity_text, r.source, r.confidence_score, tuple(r.pages)) for r in got} == {("Jane Roe", "Presidio", 0.9, (1, 2)), ("Jane Roe", "LLM", 0.9, (1,))}
    again = resolve.resolve_entities(spark.createDataFrame([(1, k, r.entity_text, r.entity_type, r.confidence_score, r.source, r.boxes, r.supporting_sources, None) for k, r in enumerate(got)], DETECTIONS))
    assert again.count() == len(got)


def test_sources(spark):
    df = detections(spark, ("x", "T", 1.0, "Hybrid", [], ["LLM"]), ("x", "T", 1.0, "Vision", [], ["Presidio", "Odd"]))
    assert [r[0] for r in df.orderBy("seq").select(resolve.supporting_sources("source", "supporting_sources")).collect()] == [["LLM"], ["Presidio", "Vision"]]
    assert df.orderBy("seq").select(resolve.supporting_sources("source", "supporting_sources", True)).first()[0] == ["Presidio", "LLM", "Vision"]


def test_evaluation(spark):
    pred = spark.createDataFrame([(1, "email", 0, 0, 10, 0.9), (1, "email", 1, 2, 10, 0.8), (1, "url", 2, 50, 60, 0.9)], "doc_id long, label string, pred_index int, start long, end long, score double")
    gold = spark.createDataFrame([(1, "EMAIL_ADDRESS", 0, 0, 10), (1, "EMAIL_ADDRESS", 1, 3, 11), (1, "PERSON", 2, 50, 60)], "doc_id long, label string, gold_index int, start long, end long")
    pairs = evaluate.iou_pairs(pred, gold)
    matches = evaluate.match_spans(pairs)
    assert {(r.pred_index, r.gold_index) for r in matches.collect()} == {(0, 0), (1, 1)}
    got = evaluate.prf(evaluate.confusion(pred, gold, matches)).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall) == (2, 1, 1, 2 / 3, 2 / 3)
    empty = evaluate.prf(evaluate.confusion(pred.limit(0), gold.limit(0), matches.limit(0))).first()
    assert (empty.tp, empty.precision, empty.f1) == (0, 0.0, 0.0)
    assert {r.label for r in evaluate.capability_slice(gold).collect()} == {"EMAIL_ADDRESS", "PERSON"}
    none = evaluate.numeric_summary(pred.limit(0), "score").first()
    assert none["count"] == 0 and none["p90"] is None


def test_gold_spans(spark):
    rows = [
        ("a", "hello Jane", json.dumps([{"start": 6, "end": 10, "label": "name", "value": "Jane"}]), "[]"),
        ("b", "hello Jane", "", "[[0, 5, 'greet'], [6, 99, 'NAME'], [3, 3, 'x']]"),
        ("c", "hello", None, json.dumps([{"begin": 0, "stop": 5, "entity": "email"}])),
        ("d", "hello", "not json", None),
    ]
    got = {(r.id, r.start, r.end, r.label, r.text) for r in files.gold_spans(spark.createDataFrame(rows, "id string, source_text string, privacy_mask string, span_labels string")).collect()}
    assert got == {("a", 6, 10, "PERSON", "Jane"), ("b", 0, 5, "GREET", "hello"), ("b", 6, 10, "PERSON", "Jane"), ("c", 0, 5, "EMAIL_ADDRESS", "hello")}


def places(text_):
    out, at = [], 0
    for w in text_.split():
        out.append((w, at, at + len(w)))
        at += len(w) + 1
    return out


def find(quote, text_, threshold=90, compat=False):
    q = fuzzy.fold(quote)
    n = max(1, min(len(quote.split()), len(q.split())))
    return [text_[a:b] for a, b, _ in fuzzy.find_quote(q, range(max(1, n - 1), n + 3), places(text_), threshold, 80, compat=compat)]


def test_fuzzy_localization():
    assert find("Jane", "say Jane now") == ["Jane"]
    assert find("Jane Roe", "say Jane Roe now") == ["Jane Roe"]
    assert find("zzz qqq", "say Jane Roe now") == []
    assert find("Acme Holding Limited", "by Acme Holding Limited of x") == ["Acme Holding Limited"]
    assert find("Acme Holding Limited", "by Acme Holding Limited of x", compat=True) != ["Acme Holding Limited"]
    assert find("Roe 102", "to Roe 1O2 only") == ["Roe 1O2"]


def test_fuzzy_pages_are_apart(spark):
    w = spark.createDataFrame([(1, 0, "Jane", 0, 4), (1, 1, "Roe", 5, 8), (1, 2, "Jane", 0, 4), (1, 2, "Roe", 5, 8)], "doc_id long, page_number int, text string, start_char long, end_char long")
    quotes = spark.createDataFrame([(1, p, "Jane Roe", "PERSON", 0.9) for p in (0, 1, 2, 3)] + [(1, 0, "", "PERSON", 0.9)], "doc_id long, page_number int, quote string, category string, confidence double")
    got = {(r.page_number, r.start, r.end) for r in fuzzy.localize_quotes(quotes, w).collect()}
    assert (2, 0, 8) in got and not any(p == 3 for p, _, _ in got)


def grid(rows, dx=100.0, dy=12.0):
    return [(1, 0, i * 10 + j, t, j * dx, i * dy, j * dx + 40, i * dy + 10) for i, row in enumerate(rows) for j, t in enumerate(row) if t]


TABLE_WORDS = "doc_id long, page_number int, word_index int, text string, x0 double, y0 double, x1 double, y1 double"


def test_tables(spark):
    cells = tables.detect_tables(spark.createDataFrame(grid([["h1", "h2", "h3"], ["a", "b", "c"], ["", "more", ""], ["d", "", "f"]]), TABLE_WORDS))
    assert [r.text for r in tables.table_texts(cells).collect()] == ["[TABLE]\nh1 | h2 | h3\na | b more | c\nd |  | f\n[/TABLE]"]
    prose = [(1, 0, k, "w", k * 45.0, 0.0, k * 45.0 + 40, 10.0) for k in range(9)]
    assert tables.detect_tables(spark.createDataFrame(prose, TABLE_WORDS)).count() == 0
    assert tables.detect_tables(spark.createDataFrame([], TABLE_WORDS)).count() == 0


def test_box_merging(spark):
    a, b, c, far, page = (0, 0, 0, 10, 10), (0, 1, 1, 11, 11), (0, 2, 2, 5, 5), (0, 50, 50, 60, 60), (1, 0, 0, 10, 10)
    assert tables.merge_boxes([]) == [] and tables.merge_boxes([a]) == [a]
    assert tables.merge_boxes([a, far]) == [a, far]
    assert tables.merge_boxes([a, b]) == [(0, 0, 0, 11, 11)]
    assert tables.merge_boxes([a, c]) == [a, c]
    assert sorted(tables.merge_boxes([a, page])) == [a, page]
    rows = [(7, x[0], *map(float, x[1:])) for x in (a, b, page)]
    assert tables.merge_box_rows(spark.createDataFrame(rows, "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")).count() == 2


def test_ocr(spark):
    result = [(1, 0, 0, ["ab", " ", "cd"], ["90", "-1", "30"], [0.0, 0.0, 20.0], [0.0] * 3, [10.0] * 3, [10.0] * 3, [1] * 3, [1] * 3, [1, 1, 2], 2.0, 2.0, 0.0, 0.0)]
    schema = providers.KINDS["ocr"]
    got = words.ocr_words(spark.createDataFrame(result, schema), 40.0).collect()
    assert [(r.text, r.bbox.x1, r.line_key) for r in got] == [("ab", 5.0, "ocr:1:1:1")]
    metrics = spark.createDataFrame([(1, 0, 1.0, False), (1, 1, 2.0, True), (1, 2, 9.0, True), (2, 0, 1.0, False), (2, 1, 3.0, False), (2, 2, 3.0, False)], "doc_id int, pass_no int, quality double, strong boolean")
    assert {r.doc_id: r.pass_no for r in words.best_pass(metrics, ["doc_id"]).collect()} == {1: 1, 2: 1}
    native = spark.createDataFrame([(1, "x"), (2, "meaningful words are here"), (3, "x")], "doc_id int, text string")
    ocr = spark.createDataFrame([(1, "many"), (1, "more words"), (2, "x")], "doc_id int, text string")
    assert {r.doc_id: r.origin for r in words.choose_words(native, ocr, ["doc_id"]).collect()} == {1: "ocr", 2: "native", 3: "native"}


def test_native_words(spark):
    rows = [(1, 0, 1, 0, 0, "late"), (1, 0, 0, 1, 0, "b"), (1, 0, 0, 0, 1, " a2 "), (1, 0, 0, 0, 0, "a1"), (1, 0, 0, 2, 0, " ")]
    got = words.native_words(spark.createDataFrame(rows, "doc_id long, page_number int, block_no int, line_no int, word_no int, text string")).orderBy("word_index").collect()
    assert [(r.text, r.line_key) for r in got] == [("a1", "native:0:0"), ("a2", "native:0:0"), ("b", "native:0:1"), ("late", "native:1:0")]


def test_files(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF-1.7", "c.txt": b"%PDF", "d.pdf": b"plain", "e.PDF": b"%PDF" + b"x" * 2_000_000}.items():
        (tmp_path / name).write_bytes(content)
    read = files.read_binary(spark, str(tmp_path), "*")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in files.validate_uploads(read, max_mb=1).collect()}
    empty = spark.createDataFrame([("x/b.pdf", 0, b"")], "path string, length long, content binary")
    assert [(r.status, r.reason) for r in files.validate_uploads(empty).collect()] == [(400, "empty file")]
    assert got == {"a.pdf": 200, "c.txt": 400, "d.pdf": 400, "e.PDF": 413}
    assert [r.filename for r in files.manifest(read, 2).collect()] == ["a.pdf", "c.txt"]
    sample = files.sample_rows(spark.range(100), 5)
    assert sample.count() == 5 and sample.collect() == files.sample_rows(spark.range(100).repartition(7), 5).collect()


def test_sinks(spark, tmp_path):
    df = detections(spark, ("x", "T", 1.7, "LLM", [BOX0, BOX0]))
    row = sinks.api_entities(df).first()
    assert row.confidence_score == 1.0 and [b.page_number for b in row.boxes] == [1]
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"), ["entity_text", "source"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["entity_text", "source"]
    page = sinks.html_report(spark.createDataFrame([("f1", 0.5), ("none", None)], "metric string, value double")).first().html
    assert "<td>0.5000</td>" in page and "<td>-</td>" in page


def test_providers_fail_loudly(spark):
    with pytest.raises(LookupError):
        providers.provide("llm", spark.range(1))
    with pytest.raises(ValueError):
        providers.register("nope", lambda: None)


def test_answers_become_spans(spark):
    def factory():
        return lambda f: pd.DataFrame({"doc_id": f["doc_id"], "page_number": f["page_number"], "raw": ['[{"quote": "Jane Roe", "category": "name", "confidence": 0.95}, {"quote": "the", "category": "name"}]'] * len(f)})

    providers.register("llm", factory)
    try:
        d = docs(spark, "It was Jane Roe who came.")
        answers = providers.provide("llm", d.withColumn("page_number", F.lit(0)))
        got = sanitize.answer_spans(answers, sanitize.placed_words(d).withColumn("page_number", F.lit(0))).collect()
        assert [(r.start, r.end, r.category) for r in got] == [(7, 15, "PERSON")]
    finally:
        providers.unregister("llm")


def test_sanitize_leaves_no_detected_text(spark):
    d = docs(spark, "write to a@b.org or 10.1.2.3, pin is 4821", "clean", None)
    got = [r.masked_text for r in sanitize.sanitize(d).orderBy("doc_id").collect()]
    assert got == ["write to █ or █, pin is █", "clean", None]
    assert {r.entity_type for r in sanitize.entities(d).collect()} == {"EMAIL_ADDRESS", "IP_ADDRESS", "SECURITY_CODE"}


def test_job_stream(spark, tmp_path):
    src, out, st, ck = (str(tmp_path / x) for x in ("src", "out", "st", "ck"))
    spark.createDataFrame([(1, "a@b.org"), (2, "x")], "job_id long, text string").repartition(2).write.parquet(src)
    stream = jobs.intake(spark, src, "job_id long, text string", queue_size=1)
    jobs.work(stream, lambda b: b.withColumn("n", F.length("text")), out, st, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert {(r.job_id, r.status) for r in spark.read.parquet(st).collect()} == {(1, "completed"), (2, "completed")}
    bad = str(tmp_path / "bad")
    jobs.work(jobs.intake(spark, src, "job_id long, text string"), lambda b: b.select("missing"), out + "2", bad, ck + "2").awaitTermination()
    assert {r.status for r in spark.read.parquet(bad).collect()} == {"failed"}


def test_job_states(spark):
    rows = [(1, "queued", 0), (1, "completed", 5), (1, "processing", 5), (2, "queued", 1), (3, "failed", 1)]
    events = spark.createDataFrame(rows, "job_id int, status string, s int").withColumn("ts", F.timestamp_seconds("s"))
    states = jobs.latest_states(events)
    assert {r.job_id: r.status for r in states.collect()} == {1: "completed", 2: "queued", 3: "failed"}
    assert {r.job_id for r in jobs.visible(states, F.timestamp_seconds(F.lit(1804))).collect()} == {1, 2}
    status = jobs.job_status(states, spark.createDataFrame([(2, 0.4, "page 1")], "job_id int, progress double, message string"))
    assert {r.job_id: r.progress for r in status.collect()} == {1: 1.0, 2: 0.4, 3: 0.0}


def test_event_streams(spark, tmp_path, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = str(tmp_path / "ev")
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    spark.read.parquet(src).limit(50).write.mode("append").parquet(src)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString().replace('timestamp_ntz', 'timestamp')}" for f in schema)
    stream = jobs.intake(spark, src, kinds, queue_size=100)
    q = jobs.distinct_events(stream).writeStream.format("memory").queryName("dist").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("dist").count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    q = jobs.windowed_counts(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()


def test_text_with_tables(spark):
    before = [(1, 0, 0, "Intro", "l0", 0.0, 0.0), (1, 0, 1, "line", "l0", 50.0, 0.0)]
    table = [(1, 0, 2 + k, t, f"t{k // 2}", (k % 2) * 100.0, 50.0 + (k // 2) * 12) for k, t in enumerate(["h1", "h2", "a", "b"])]
    after = [(1, 0, 6, "end", "l9", 0.0, 200.0), (1, 1, 0, "next", "l0", 0.0, 0.0)]
    w = spark.createDataFrame(before + table + after, "doc_id long, page_number int, word_index int, text string, line_key string, x0 double, y0 double")
    cells = spark.createDataFrame([(1, 0, 0, i, j, 3, 3, [2 + 2 * i + j]) for i in range(2) for j in range(2)], "doc_id long, page_number int, table_no int, row_index int, col_index int, row_count int, col_count int, word_indexes array<int>")
    placed = canonical.place_words_and_tables(w, cells)
    want = "Intro line\n[TABLE]\nh1 | h2 | \na | b | \n |  | \n[/TABLE]\nend\nnext"
    assert [r.text for r in canonical.text_with_tables(placed).collect()] == [want]
    assert all(want[r.start_char : r.end_char] == r.text for r in placed.collect())
    plain = canonical.place_words_and_tables(w, cells.limit(0))
    assert [r.text for r in canonical.text_with_tables(plain).collect()] == ["Intro line\nh1 h2\na b\nend\nnext"]


def test_faces_logs_and_counts(spark):
    faces = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 5.0), (1, 0, 9.0, 0.0, 12.0, 5.0), (1, 2, 0.0, 0.0, 5.0, 5.0)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    got = resolve.resolve_entities(detect.face_detections(faces)).collect()
    assert [(r.entity_type, len(r.boxes)) for r in got] == [("FACE", 3)]
    logs = spark.createDataFrame([(k, f"m{k}") for k in range(9)], "ts int, message string")
    assert [r.ts for r in jobs.newest(logs, 2).collect()] == [8, 7]
    df, seen = jobs.observed(logs, "logs")
    df.collect()
    assert seen.get["rows"] == 9
    times = spark.createDataFrame([(1, "ocr", 0.5), (1, "ocr", 0.25), (1, "llm", 1.0)], "job_id int, stage string, seconds double")
    assert {r.stage: r.seconds for r in jobs.stage_seconds(times).collect()} == {"ocr": 0.75, "llm": 1.0}
