import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.config import BOX, EngineConfig
from veilframe.functions.fonts import scrubbed_font
from veilframe.plans import pages, triage
from veilframe.sources import chat, providers

WORDS = f"doc_id long, page_number int, word_index int, text string, line_key string, bbox {BOX}"


def placed(spark, *texts):
    """Words of one document, a text a page, all on one line."""
    rows = []
    for page, t in enumerate(texts):
        for k, w in enumerate(t.split()):
            rows.append((1, page, k, w, "0", (page, 10.0 * k, 0.0, 10.0 * k + 8, 10.0)))
    return spark.createDataFrame(rows, WORDS)


def test_documents_of_several_pages(spark):
    words = placed(spark, "write to a@b.org now", "nothing here", "again A@B.org and 10.1.2.3")
    got = pages.page_texts(words).orderBy("page_number").collect()
    assert [(r.text, r.offset) for r in got] == [("write to a@b.org now", 0), ("nothing here", 21), ("again A@B.org and 10.1.2.3", 34)]
    found = pages.ordered(pages.document_entities(words))
    assert [(r.entity_type, r.entity_text, r.pages) for r in found.collect()] == [("EMAIL_ADDRESS", "a@b.org", [1, 3]), ("IP_ADDRESS", "10.1.2.3", [3])]
    sizes = spark.createDataFrame([(1, 0, 25.0, 10.0), (1, 1, 99.0, 99.0), (1, 2, 5.0, 99.0)], "doc_id long, page_number int, width double, height double")
    boxes = pages.redaction_boxes(found, sizes).collect()
    assert [tuple(b) for b in boxes] == [(1, 0, 19.2, 0.0, 25.0, 10.0)]
    every, by_word, lines = pages.extraction(words)
    assert (every.count(), by_word.count(), lines.count()) == (10, 10, 3)
    assert pages.document_entities(words.limit(0)).count() == 0


def test_fonts(spark):
    rows = [("/Helvetica", 1), ("/ABCDEF+Own", 2), ("/Own-Bold", 3), ("null", 4), ("", 5), (None, 6), ("/Times-Bold", 7)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string, n int").orderBy("n").select(scrubbed_font("v", "n")).collect()]
    assert got == ["/Helvetica", "/ABCDEF+SanitizedFont2", "/SanitizedFont3", "null", "", None, "/Times-Bold"]


def completion(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


def model():
    """The first pass is answered at once, the second after a bad answer, page 2 never, page 3 not at all."""

    def answer(row):
        system, user = (m["content"] for m in row["messages"])
        assert system.startswith("You find") and user.startswith("Text:\n")
        if row["page_number"] == 3:
            return None, "status 500"
        again = "Why you are asked again" in user
        if row["page_number"] == 2 or (row["pass_no"] == 2 and not again):
            return completion("I can not say what there is, " * 10), None
        assert not again or "The last answer could not be read" in user
        sure = 0.99 if again else 0.9
        return completion(json.dumps([{"quote": "Jane  Roe", "category": "name", "confidence": sure}, {"quote": "the", "category": "name", "confidence": 1}])), None

    def run(rows):
        got = [answer(r) for r in rows.to_dict("records")]
        return rows.assign(raw=pd.Series([g[0] for g in got], index=rows.index, dtype=object), error=pd.Series([g[1] for g in got], index=rows.index, dtype=object))

    return run


def test_triage_asks_again_and_unites_passes(spark, tmp_path):
    words = placed(spark, "It was Jane Roe who came", "and Jane Roe went", "no use", "down")

    rows = pages._placed(words.drop("start_char", "end_char")).drop("page")
    texts = pages.page_texts(words).select("doc_id", "page_number", "text")
    providers.register("chat", lambda: model())
    try:
        answers = triage.ask(texts, str(tmp_path / "a"))
        last = {(r.page_number, r.pass_no): (r.attempt, r.ok) for r in answers.collect()}
        assert last == {(0, 1): (1, True), (1, 1): (1, True), (0, 2): (2, True), (1, 2): (2, True), (2, 1): (3, False), (2, 2): (3, False), (3, 1): (3, False), (3, 2): (3, False)}
        assert {(r.page_number, r.quote, r.confidence) for r in triage.candidates(answers).collect() if r.quote != "the"} == {(0, "Jane  Roe", 0.99), (1, "Jane  Roe", 0.99)}
        said = {(r.page_number, r.pass_no): r.message for r in triage.warnings(answers).collect()}
        assert set(said) == {(2, 1), (2, 2), (3, 1), (3, 2)} and "status 500" in said[3, 1] and "I can not say" in said[2, 2] and said[2, 1].startswith("Pass 1/2")
        found, _ = triage.triage(texts, rows, str(tmp_path / "b"))
        assert {(r.page_number, r.start, r.end) for r in found.collect()} == {(0, 7, 15), (1, 4, 12)}
        one = triage.ask(texts.where("page_number < 2"), str(tmp_path / "c"), EngineConfig(llm_passes=1))
        assert {(r.attempt, r.ok) for r in one.collect()} == {(1, True)}
        assert triage.ask(texts.limit(0), str(tmp_path / "d")).count() == 0
    finally:
        providers.unregister("chat")


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body))
            kind = body["model"]
            replies = {
                "good": (200, completion("[]")), "text": (200, "no json"), "list": (200, "[]"), "error": (200, '{"error": {"message": "busy"}}'),
                "denied": (401, "x" * 500), "moved": (307, ""), "loop": (307, ""),
            }
            status, reply = replies[kind] if "there" not in self.path or kind == "loop" else replies["good"]
            self.send_response(status)
            if status == 307:
                self.send_header("Location", "/there")
            self.end_headers()
            self.wfile.write(reply.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", asked
    server.shutdown()
    server.server_close()


def test_chat_service(service):
    base, asked = service
    of = lambda m: chat.ChatService(f' "{base}/chat/completions/" ', "Bearer  sEcret ", m, timeout=10)
    messages = [{"role": "user", "content": "é"}]
    assert of("good").complete(messages) == completion("[]")
    assert asked[0][:2] == ("/v1/chat/completions", "Bearer sEcret") and asked[0][2]["messages"] == messages
    assert of("moved").complete(messages) == completion("[]") and asked[-1][0] == "/there"
    for kind, said in {"text": "no JSON", "list": "no object", "error": "busy", "denied": r"401.*x{400}\.\.\.$", "loop": "307"}.items():
        with pytest.raises(chat.ChatError, match=said):
            of(kind).complete(messages)
    rows = pd.DataFrame({"doc_id": [1], "page_number": [0], "pass_no": [1], "has_table": [False], "messages": [messages]})
    assert chat.provider(of("error"))()(rows)[["raw", "error"]].values.tolist() == [[None, "busy"]]
    with pytest.raises(chat.ChatError):
        chat.ChatService("http://127.0.0.1:1", "k", "good", timeout=2).complete(messages)


def test_keys_and_addresses():
    assert [chat.clean_key(k) for k in ("'bearer  aB '", "aB", None, "")] == ["aB", "aB", "", ""]
    assert [chat.clean_base(b) for b in ("https://h/v1/", "https://h/v1/Chat/Completions/", None)] == ["https://h/v1", "https://h/v1", ""]
