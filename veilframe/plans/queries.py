"""Registered queries of the engine and, where SQL can tell them, the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions import boxes as B
from ..functions import fonts, labels, numbers, payloads, text, urls
from ..operators import canonical, detect, evaluate, fuzzy, localize, resolve, segments, tables
from ..sources import sinks, words
from ..streaming import jobs
from . import pages as whole
from . import sanitize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_sql(table: str, key: str, column: str, pattern: str) -> str:
    """Matches with offsets in DuckDB, by the same alternation of gaps and matches."""
    p = pattern.replace("'", "''")
    whole = rf"(?s)(.*?)({p}|\z)"
    return f"""SELECT {key}, ("end" - length(match))::BIGINT AS start, "end", match FROM (
      SELECT {key}, match, sum(length(gap) + length(match)) OVER (PARTITION BY {key} ORDER BY pos)::BIGINT AS "end" FROM (
        SELECT {key}, unnest(g) AS gap, unnest(m) AS match, generate_subscripts(g, 1) AS pos FROM (
          SELECT {key}, regexp_extract_all({column}, '{whole}', 1) AS g, regexp_extract_all({column}, '{whole}', 2) AS m
          FROM {table} WHERE regexp_matches({column}, '{p}'))))
    WHERE length(match) > 0"""


LUHN_SQL = """(WITH d AS (SELECT unnest(string_split(reverse(regexp_replace(match, '[^0-9]', '', 'g')), ''))::INT AS v, generate_subscripts(string_split(reverse(regexp_replace(match, '[^0-9]', '', 'g')), ''), 1) AS i)
  SELECT sum(CASE WHEN i % 2 = 1 THEN v WHEN v * 2 > 9 THEN v * 2 - 9 ELSE v * 2 END) % 10 = 0 FROM d)"""


def typed_sql(entity_type: str, table: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    r = detect.RECOGNIZERS[entity_type]
    where = f" WHERE {LUHN_SQL}" if r.check == "luhn" else ""
    return f"SELECT {key}, start, \"end\", '{entity_type}' AS entity_type, {r.score}::DOUBLE AS score, match FROM ({spans_sql(table, key, column, r.pattern)}){where}"


def _recognizer_query(name: str, entity_type: str, table: str, key: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect.recognize(read(spark, sf_dir, table), [entity_type], key, column)

    QUERIES[name], ORACLE[name] = run, typed_sql(entity_type, table, key, column)


for _name, _args in {
    "email_spans": ("EMAIL_ADDRESS", "documents", "doc_id", "text"),
    "ipv4_spans": ("IP_ADDRESS", "documents", "doc_id", "text"),
    "card_spans": ("CREDIT_CARD", "documents", "doc_id", "text"),
    "phone_spans": ("PHONE_NUMBER", "documents", "doc_id", "text"),
    "secret_spans": ("PASSWORD", "documents", "doc_id", "text"),
    "page_email_spans": ("EMAIL_ADDRESS", "pages", "page_id", "html"),
    "page_url_spans": ("URL", "pages", "page_id", "url"),
}.items():
    _recognizer_query(_name, *_args)

SPANS = " UNION ALL ".join(f"({typed_sql(t)})" for t in sanitize.TYPES)
WORDS = r"""SELECT doc_id, pos - 1 AS word_index, ("end" - length(word))::BIGINT AS start, "end", word, 'text:' || ((pos - 1) // 16) AS line_key FROM (
  SELECT doc_id, pos, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS "end" FROM (
    SELECT doc_id, unnest(g) AS gap, unnest(m) AS word, generate_subscripts(g, 1) AS pos FROM (
      SELECT doc_id, regexp_extract_all(text, '(?s)([ \t\n\x0B\f\r]*)([^ \t\n\x0B\f\r]+|\z)', 1) AS g, regexp_extract_all(text, '(?s)([ \t\n\x0B\f\r]*)([^ \t\n\x0B\f\r]+|\z)', 2) AS m FROM documents)))
  WHERE word <> ''"""


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def _spans(spark, sf_dir):
    """Spans of all detectors. The SQL tells those of ``sanitize.TYPES``, the only ones that the given tables hold."""
    return detect.detect(_docs(spark, sf_dir))


@query(WORDS)
def word_spans(spark, sf_dir):
    return words.word_spans(_docs(spark, sf_dir)).drop("bbox").withColumn("word_index", F.col("word_index").cast("long"))


@query("""SELECT doc_id, (s // 1800)::BIGINT AS chunk_no, s::BIGINT AS global_offset, substring(text, s + 1, 2000) AS chunk_text FROM (
  SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 201, 0), 1800)) AS s FROM documents WHERE length(text) > 0)""")  # fmt: skip
def text_chunks(spark, sf_dir):
    rows = text.chunk(_docs(spark, sf_dir)).select("doc_id", "chunk_no", "global_offset", "chunk_text")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("chunk_no", "global_offset")})


CANONICAL = f"""WITH w AS ({WORDS}), s AS (
  SELECT doc_id, word_index, word, CASE WHEN word_index = 0 THEN '' WHEN lag(line_key) OVER o <> line_key THEN CASE WHEN suffix(lag(word) OVER o, '-') THEN '' ELSE chr(10) END ELSE ' ' END AS sep
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY word_index))"""


def _placed(spark, sf_dir):
    return canonical.place_words(words.word_spans(_docs(spark, sf_dir)).withColumnRenamed("word", "text"))


@query(CANONICAL + " SELECT doc_id, string_agg(sep || word, '' ORDER BY word_index) AS text FROM s GROUP BY doc_id")
def canonical_text(spark, sf_dir):
    return canonical.canonical_text(_placed(spark, sf_dir))


@query(CANONICAL + ' SELECT doc_id, word_index, sum(length(sep) + length(word)) OVER (PARTITION BY doc_id ORDER BY word_index)::BIGINT AS end_char FROM s')
def canonical_offsets(spark, sf_dir):
    return _placed(spark, sf_dir).select("doc_id", F.col("word_index").cast("long").alias("word_index"), "end_char")


@query("""SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM conversations""")
def doc_char_offsets(spark, sf_dir):
    return canonical.page_offsets(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "offset")


@query("""SELECT * FROM (SELECT conv_id AS doc_id, turn AS page_number, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS budget_rank
  FROM conversations WHERE length(text) >= 40 AND trim(text) <> '') WHERE budget_rank <= 2""")  # fmt: skip
def page_gate(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text", F.lit(0).alias("n_found"))
    return canonical.gate_pages(rows, max_pages=2, min_chars=40, skip_when_found=1).select("doc_id", "page_number", F.col("budget_rank").cast("long").alias("budget_rank"))


@query(f"""SELECT s.doc_id, s.start, s."end", s.entity_type, w.word_index, w.word FROM ({SPANS}) s JOIN ({WORDS}) w
  ON s.doc_id = w.doc_id AND w.start < s."end" AND w."end" > s.start""")  # fmt: skip
def span_word_localization(spark, sf_dir):
    hits = localize.overlap_join(_spans(spark, sf_dir), sanitize.placed_words(_docs(spark, sf_dir).where(detect.holds_any())))
    return hits.select("doc_id", "start", "end", "entity_type", F.col("word_index").cast("long").alias("word_index"), F.col("text").alias("word"))


@query(f"""SELECT doc_id, line_key, min(start)::DOUBLE AS x0, max("end")::DOUBLE AS x1, string_agg(word, ' ' ORDER BY start) AS phrase FROM ({WORDS}) GROUP BY doc_id, line_key""")
def phrase_map(spark, sf_dir):
    return localize.phrase_map(words.word_spans(_docs(spark, sf_dir)), text="word").select("doc_id", "line_key", "x0", "x1", "phrase")


@query(f"""SELECT doc_id, word, count(*) AS boxes, min(start)::DOUBLE AS first_x0 FROM ({WORDS}) GROUP BY doc_id, word""")
def word_map(spark, sf_dir):
    rows = localize.word_map(words.word_spans(_docs(spark, sf_dir)), text="word")
    return rows.select("doc_id", "word", F.size("boxes").cast("long").alias("boxes"), F.get("boxes", 0)["x0"].alias("first_x0"))


@query(f"""SELECT doc_id, line_key, min(start) - 0.8 AS x0, -1.2::DOUBLE AS y0, least(max("end"), 400) + 0.8 AS x1, 2.2::DOUBLE AS y1
  FROM ({WORDS}) GROUP BY doc_id, line_key HAVING min(start) < 400""")  # fmt: skip
def box_clip_pad(spark, sf_dir):
    rows = localize.line_boxes(words.word_spans(_docs(spark, sf_dir)))
    rows = rows.select("doc_id", "line_key", B.clip(B.box("page_number", "x0", "y0", "x1", "y1"), F.lit(400), F.lit(800)).alias("b")).where("b is not null")
    return rows.select("doc_id", "line_key", B.pad("b").alias("b")).select("doc_id", "line_key", "b.x0", "b.y0", "b.x1", "b.y1")


@query(f"""WITH l AS (SELECT doc_id, line_key, min(start) AS x0, max("end") AS x1 FROM ({WORDS}) GROUP BY doc_id, line_key)
  SELECT doc_id, line_key, (x0 - 0.8)::DOUBLE AS x0, -1.2::DOUBLE AS y0, least(x1, max((x0 + x1) / 2) OVER (PARTITION BY doc_id)) + 0.8 AS x1, 2.2::DOUBLE AS y1 FROM l""")  # fmt: skip
def box_clip_pad_whole(spark, sf_dir):
    """Boxes of all lines: a document's page ends in the middle of its last line, which is clipped."""
    rows = localize.line_boxes(words.word_spans(_docs(spark, sf_dir)))
    width = F.max((F.col("x0") + F.col("x1")) / 2).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("width", width).select("doc_id", "line_key", B.clip(B.box("page_number", "x0", "y0", "x1", "y1"), "width", F.lit(800)).alias("b"))
    return rows.select("doc_id", "line_key", B.pad("b").alias("b")).select("doc_id", "line_key", "b.x0", "b.y0", "b.x1", "b.y1")


@query("""WITH l AS (SELECT l_orderkey AS doc_id, (l_partkey % 3)::INT AS page_number, l_linenumber::VARCHAR AS line_key, l_quantity * 10 AS y0, l_quantity * 10 + 4 + l_linenumber AS y1 FROM lineitem),
  n AS (SELECT a.*, (SELECT max(b.y1) FROM l b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.y1 <= a.y0) AS above,
    (SELECT min(b.y0) FROM l b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.y0 >= a.y1) AS below FROM l a)
  SELECT doc_id, page_number, line_key, greatest(0, least(y0 - above, below - y1) / 2 - 0.6)::DOUBLE AS safe_inset FROM n
  WHERE above IS NOT NULL OR below IS NOT NULL
  UNION ALL SELECT doc_id, page_number, line_key, NULL FROM n WHERE above IS NULL AND below IS NULL""")  # fmt: skip
def safe_insets(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 3).cast("int").alias("page_number"), F.col("l_linenumber").cast("string").alias("line_key"), F.lit(0.0).alias("x0"), (F.col("l_quantity") * 10).alias("y0"), F.lit(1.0).alias("x1"), (F.col("l_quantity") * 10 + 4 + F.col("l_linenumber")).alias("y1"))
    out = localize.safe_insets(rows).select("doc_id", "page_number", "line_key", "safe_inset")
    return out


MERGED = f"""SELECT doc_id, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT doc_id, start, "end", max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({SPANS})))
  GROUP BY doc_id, island"""


@query(MERGED)
def segment_merge(spark, sf_dir):
    return segments.merge_segments(_spans(spark, sf_dir))


@query(f"""WITH m AS ({MERGED}), p AS (SELECT doc_id, "end", coalesce(lag("end") OVER o, 0) AS before, start, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC) AS back FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
  j AS (SELECT p.doc_id, string_agg(substring(d.text, before + 1, start - before) || '█', '' ORDER BY start) AS head, max("end") AS last FROM p JOIN documents d USING (doc_id) GROUP BY p.doc_id)
  SELECT d.doc_id, CASE WHEN j.doc_id IS NULL THEN d.text ELSE head || substring(d.text, last + 1) END AS masked_text FROM documents d LEFT JOIN j USING (doc_id)""")  # fmt: skip
def masked_text(spark, sf_dir):
    return sanitize.sanitize(_docs(spark, sf_dir)).select("doc_id", "masked_text")


@query(f"""SELECT doc_id, start, "end", entity_type, max(score) AS score, max(match) AS match FROM ({SPANS}) WHERE score >= 0.7 GROUP BY doc_id, start, "end", entity_type, lower(match)""")
def span_dedup(spark, sf_dir):
    spans = _spans(spark, sf_dir).withColumn("half", F.explode(F.array(F.lit(1.0), F.lit(0.5))))
    return detect.dedupe_spans(spans.withColumn("score", F.col("score") * F.col("half")).drop("half")).where("score >= 0.7")


@query(f"""SELECT entity_type, CASE WHEN entity_type IN ({", ".join(f"'{t}'" for t in labels.HIGH_RISK)}) THEN 'high' ELSE 'standard' END AS risk_tier, count(*) AS n FROM ({SPANS}) GROUP BY 1, 2""")
def risk_tier_counts(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("entity_type", labels.risk_tier("entity_type").alias("risk_tier")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::BIGINT AS alnum, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 20 AS meaningful FROM documents""")
def doc_quality_gate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.alnum_count("text").cast("long").alias("alnum"), text.is_meaningful("text").alias("meaningful"))


PASSES = f"""SELECT doc_id, (word_index % 3)::INT AS pass_no, count(*) AS n, avg(length(word) * 7.0)::DOUBLE AS mean_conf, sum(length(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g')))::BIGINT AS alnum FROM ({WORDS}) GROUP BY 1, 2"""


def _passes(spark, sf_dir):
    rows = words.word_spans(_docs(spark, sf_dir)).select("doc_id", (F.col("word_index") % 3).cast("int").alias("pass_no"), F.col("word").alias("text"), (F.length("word") * 7.0).cast("double").alias("conf"))
    return words.pass_metrics(rows, ["doc_id", "pass_no"])


@query(f"""SELECT doc_id, pass_no, n, round(mean_conf, 6) AS mean_conf, alnum, (n >= 16 AND mean_conf >= 46) OR (n >= 8 AND mean_conf >= 34 AND alnum >= 40) AS strong FROM ({PASSES})""")
def ocr_pass_metrics(spark, sf_dir):
    return _passes(spark, sf_dir).select("doc_id", "pass_no", "n", F.round("mean_conf", 6).alias("mean_conf"), "alnum", "strong")


@query(f"""WITH m AS ({PASSES}), s AS (SELECT *, round(2 * n + 0.45 * mean_conf + 0.03 * alnum, 9) AS quality, (n >= 16 AND mean_conf >= 46) OR (n >= 8 AND mean_conf >= 34 AND alnum >= 40) AS strong FROM m)
  SELECT doc_id, coalesce(min(pass_no) FILTER (strong), arg_min(pass_no, row(-quality, pass_no))) AS pass_no FROM s GROUP BY doc_id""")  # fmt: skip
def ocr_best_pass(spark, sf_dir):
    return words.best_pass(_passes(spark, sf_dir).withColumn("quality", F.round("quality", 9)), ["doc_id"])


def _shifted(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    pred = spans.select("doc_id", F.col("entity_type").alias("label"), (F.col("start") * 8 + F.length("entity_type")).alias("pred_index"), "start", "end", "score")
    gold = spans.select("doc_id", F.col("entity_type").alias("label"), (F.col("start") * 8).alias("gold_index"), (F.col("start") + F.col("start") % 9).alias("start"), (F.col("end") + F.col("start") % 9).alias("end"))
    return pred, gold


PAIRS = f"""WITH s AS ({SPANS}), p AS (SELECT doc_id, entity_type AS label, start * 8 + length(entity_type) AS pred_index, start, "end", score FROM s),
  g AS (SELECT doc_id, entity_type AS label, start * 8 AS gold_index, start + start % 9 AS g0, "end" + start % 9 AS g1 FROM s),
  x AS (SELECT p.doc_id, p.label, pred_index, gold_index, score, (least("end", g1) - greatest(start, g0)) / (greatest("end", g1) - least(start, g0))::DOUBLE AS iou
    FROM p JOIN g ON p.doc_id = g.doc_id AND p.label = g.label AND least("end", g1) > greatest(start, g0))"""


@query(PAIRS + " SELECT doc_id, label, pred_index::BIGINT AS pred_index, gold_index::BIGINT AS gold_index, round(iou, 6) AS iou FROM x WHERE iou >= 0.5")
def span_iou_pairs(spark, sf_dir):
    rows = evaluate.iou_pairs(*_shifted(spark, sf_dir))
    return rows.select("doc_id", "label", "pred_index", "gold_index", F.round("iou", 6).alias("iou"))


@query(PAIRS.replace("WITH s", "WITH RECURSIVE s", 1) + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY iou DESC, score DESC, pred_index, gold_index) AS n FROM x WHERE iou >= 0.5),
  walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, []::BIGINT[] AS ps, []::BIGINT[] AS gs, false AS taken FROM r
    UNION ALL SELECT w.doc_id, r.n, CASE WHEN f.free THEN list_append(ps, r.pred_index) ELSE ps END, CASE WHEN f.free THEN list_append(gs, r.gold_index) ELSE gs END, f.free
      FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.n = w.n + 1, LATERAL (SELECT NOT list_contains(w.ps, r.pred_index) AND NOT list_contains(w.gs, r.gold_index) AS free) f)
  SELECT r.doc_id, label, pred_index::BIGINT AS pred_index, gold_index::BIGINT AS gold_index, iou, score FROM r JOIN walk w ON r.doc_id = w.doc_id AND r.n = w.n WHERE taken""")
def span_matches(spark, sf_dir):
    return evaluate.match_spans(evaluate.iou_pairs(*_shifted(spark, sf_dir)))


@query("""WITH c AS (SELECT sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS fn FROM labels),
  r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
  SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""")  # fmt: skip
def micro_prf(spark, sf_dir):
    counts = read(spark, sf_dir, "labels").select(((F.col("quality") == 1) & (F.col("toxic") == 1)).cast("long").alias("tp"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long").alias("fp"), ((F.col("quality") == 0) & (F.col("toxic") == 1)).cast("long").alias("fn"))
    return evaluate.prf(counts).select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""SELECT l_returnflag, count(*) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1""")  # fmt: skip
def numeric_summary(spark, sf_dir):
    out = evaluate.numeric_summary(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "count", "min", "max", *(F.round(c, 4).alias(c) for c in ("mean", "median", "p90", "p95")))


def _jobs(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    rows = events.groupBy("user_id").agg(F.min("ts").alias("submitted_at"), F.max("ts").alias("completed_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("processing_started_at"))
    return rows.withColumn("final_status", F.when(F.col("last") == "purchase", "failed").otherwise("completed")).withColumn("downloaded_at", F.lit(None).cast("timestamp"))


JOBS = """WITH j AS (SELECT user_id, min(ts) AS a, max(ts) AS b, arg_max(event_type, row(ts, event_id)) AS last, min(ts) FILTER (event_type = 'click') AS c FROM events GROUP BY 1)"""


@query(JOBS + """ SELECT user_id, round(greatest(0, epoch_us(c) - epoch_us(a)) / 1e6 + CASE WHEN c IS NULL THEN NULL ELSE 0 END, 6) AS queue_wait_sec,
  round(greatest(0, epoch_us(b) - epoch_us(a)) / 1e6, 6) AS total_sec FROM j""")  # fmt: skip
def job_latency(spark, sf_dir):
    return evaluate.job_latency(_jobs(spark, sf_dir)).select("user_id", F.round("queue_wait_sec", 6).alias("queue_wait_sec"), F.round("total_sec", 6).alias("total_sec"))


@query(JOBS + """ SELECT count(*) AS total, count(*) FILTER (last <> 'purchase') AS completed, count(*) FILTER (last = 'purchase') AS failed, round(count(*) FILTER (last = 'purchase') / count(*), 6) AS failure_rate,
  round(count(*) FILTER (last <> 'purchase') * 3600 / ((epoch_us(max(b)) - epoch_us(min(a))) / 1e6), 4) AS per_hour FROM j""")  # fmt: skip
def throughput(spark, sf_dir):
    out = evaluate.throughput(_jobs(spark, sf_dir))
    return out.select("total", "completed", "failed", F.round("failure_rate", 6).alias("failure_rate"), F.round("per_hour", 4).alias("per_hour"))


@query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY user_id")
def latest_job_state(spark, sf_dir):
    return jobs.latest_states(read(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("SELECT event_type, min(event_id) AS first_seq FROM events GROUP BY event_type")
def warnings_distinct_first(spark, sf_dir):
    return resolve.distinct_first(read(spark, sf_dir, "events"), "event_type", "event_id")


RULES = ["*.example.com", "www.thering.example.org", "bad_rule", "tionsh.example.net"]


@query("""SELECT page_id, url FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
  WHERE host = 'example.com' OR suffix(host, '.example.com') OR host IN ('www.thering.example.org', 'tionsh.example.net')""")  # fmt: skip
def allowlist_match(spark, sf_dir):
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    return urls.allowed(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


@query("SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.explode(payloads.json_flat(F.col("props"))).alias("path", "value"))


@query("""SELECT event_id, regexp_replace(substring(t.fullkey, 3), '\\[[0-9]+\\]', '', 'g') AS path, CASE WHEN t.atom IS NULL THEN 'null' ELSE t.atom->>'$' END AS value
  FROM events, LATERAL (SELECT fullkey, atom, type FROM json_tree(props)) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")  # fmt: skip
def json_flatten_nested(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.explode(payloads.flatten_column("props")).alias("p")).select("event_id", "p.path", "p.value")


@query("""SELECT p_type, count(*) AS n, regexp_replace(regexp_replace(upper(trim(p_type)), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS label FROM part GROUP BY 1""")
def label_normalize(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).withColumn("label", labels.normalize_label("p_type"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '([0-9])[OQ]([0-9]|$)', '\10\2', 'g'), '([0-9])[OQ]([0-9]|$)', '\10\2', 'g'), '([0-9])[IL]([0-9]|$)', '\11\2', 'g'), '([0-9])[IL]([0-9]|$)', '\11\2', 'g'), '[^A-Z0-9$]+', ' ', 'g')) AS folded FROM documents""")
def fuzzy_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize_for_fuzzy("text").alias("folded"))


def _detections(spark, sf_dir):
    """Two detections of every span: one as recognized, one of another source and, for some, another type."""
    rows = sanitize.detections(_docs(spark, sf_dir).where(detect.holds_any()), _spans(spark, sf_dir), held=True)
    rows = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seq", F.col("seq") * 2 + F.col("again"))
    again, even = F.col("again") == 1, F.pmod(F.length("entity_text"), F.lit(2)) == 0
    return rows.withColumns(
        {
            "source": F.when(again, "LLM").otherwise(F.col("source")),
            "supporting_sources": F.when(again, F.array(F.lit("LLM"))).otherwise(F.col("supporting_sources")),
            "entity_type": F.when(again & even, "LEGAL_PARTY_NAME").otherwise(F.col("entity_type")),
            "confidence_score": F.when(again, 0.8).otherwise(F.col("confidence_score")),
        }
    ).drop("again")


@query(f"""WITH h AS (SELECT s.*, w.start AS w0, w."end" AS w1, w.word FROM ({SPANS}) s JOIN ({WORDS}) w ON s.doc_id = w.doc_id AND w.start < s."end" AND w."end" > s.start),
  d AS (SELECT doc_id, w0, w1, entity_type, score AS conf, match, 0 AS llm, start, "end" FROM h UNION ALL
        SELECT doc_id, w0, w1, CASE WHEN length(match) % 2 = 0 THEN 'LEGAL_PARTY_NAME' ELSE entity_type END, 0.8, match, 1, start, "end" FROM h),
  r AS (SELECT *, CASE WHEN entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') THEN 2 WHEN entity_type = 'LEGAL_PARTY_NAME' THEN 1 ELSE 0 END AS tier,
        conf + CASE WHEN entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') THEN 0.25 WHEN entity_type = 'LEGAL_PARTY_NAME' THEN 0.15 ELSE 0 END AS points FROM d)
  SELECT doc_id, w0::DOUBLE AS x0, w1::DOUBLE AS x1, arg_max(entity_type, row(tier, points, conf)) AS entity_type, max(conf)::DOUBLE AS confidence_score, 'Hybrid' AS source,
    CASE WHEN count(DISTINCT entity_type) = 1 THEN 'type_consensus' WHEN max(tier) = 2 THEN 'type_matrix_structured_priority' WHEN max(tier) = 1 THEN 'type_matrix_llm_context_priority' ELSE 'type_matrix_conflict_resolved' END AS decision_reason
  FROM r GROUP BY doc_id, w0, w1""")  # fmt: skip
def resolve_by_box(spark, sf_dir):
    rows = resolve.resolve_boxes(_detections(spark, sf_dir))
    return rows.select("doc_id", "box.x0", "box.x1", "entity_type", "confidence_score", "source", "decision_reason")


@query(f"""WITH h AS (SELECT s.*, w.start AS w0, w."end" AS w1 FROM ({SPANS}) s JOIN ({WORDS}) w ON s.doc_id = w.doc_id AND w.start < s."end" AND w."end" > s.start),
  d AS (SELECT doc_id, w0, w1, entity_type, score AS conf, match, 0 AS llm, start FROM h UNION ALL
        SELECT doc_id, w0, w1, CASE WHEN length(match) % 2 = 0 THEN 'LEGAL_PARTY_NAME' ELSE entity_type END, 0.8, match, 1, start FROM h),
  p AS (SELECT *, CASE WHEN entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') THEN 2 WHEN entity_type = 'LEGAL_PARTY_NAME' THEN 1 ELSE 0 END AS tier,
        conf + CASE WHEN entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') THEN 0.25 WHEN entity_type = 'LEGAL_PARTY_NAME' THEN 0.15 ELSE 0 END AS points FROM d),
  t AS (SELECT doc_id, w0, w1, entity_type, max(row(tier, points, conf, -start, -llm)) AS claim, arg_max(match, row(conf, length(match), -start, -llm)) AS said, max(conf) AS conf, min(start) AS s, max(tier) AS tier FROM p GROUP BY ALL),
  b AS (SELECT doc_id, w0, w1, arg_max(entity_type, claim) AS entity_type, arg_max(said, claim) AS said, max(conf) AS conf, min(s) AS s,
    CASE WHEN count(*) = 1 THEN 'type_consensus' WHEN max(tier) = 2 THEN 'type_matrix_structured_priority' WHEN max(tier) = 1 THEN 'type_matrix_llm_context_priority' ELSE 'type_matrix_conflict_resolved' END AS reason FROM t GROUP BY doc_id, w0, w1)
  SELECT doc_id, arg_min(said, row(s, w0)) AS entity_text, entity_type, max(conf)::DOUBLE AS confidence_score, 'Hybrid' AS source, 'Presidio,LLM' AS sources, arg_max(reason, row(s, w0)) AS decision_reason, count(*)::INT AS n_boxes, '1' AS pages
  FROM b GROUP BY doc_id, lower(said), entity_type""")  # fmt: skip
def entity_merge(spark, sf_dir):
    rows = resolve.pages_per_entity(resolve.resolve_entities(_detections(spark, sf_dir)))
    return sinks.api_entities(rows).select("doc_id", "entity_text", "entity_type", "confidence_score", "source", F.array_join("supporting_sources", ",").alias("sources"), "decision_reason", F.size("boxes").alias("n_boxes"), F.array_join("pages", ",").alias("pages"))


@query(f"""WITH h AS (SELECT DISTINCT s.doc_id, s.match, s.entity_type, w.start AS w0, w."end" AS w1 FROM ({SPANS}) s JOIN ({WORDS}) w ON s.doc_id = w.doc_id AND w.start < s."end" AND w."end" > s.start),
  r AS (SELECT doc_id, w0, w1, arg_max(entity_type, row(tier, points, -start)) AS entity_type, arg_max(match, row(tier, points, -start)) AS match FROM (
    SELECT h.*, s2.start, CASE WHEN h.entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') THEN 2 ELSE 0 END AS tier, s2.score + CASE WHEN h.entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') THEN 0.25 ELSE 0 END AS points
    FROM h JOIN ({SPANS}) s2 ON s2.doc_id = h.doc_id AND s2.match = h.match AND s2.entity_type = h.entity_type AND s2.start < h.w1 AND s2."end" > h.w0) GROUP BY doc_id, w0, w1)
  SELECT entity_type, CASE WHEN entity_type IN ({", ".join(f"'{t}'" for t in labels.HIGH_RISK)}) THEN 'high' ELSE 'standard' END AS risk_tier, count(DISTINCT (doc_id, lower(match))) AS entities, count(DISTINCT doc_id) AS documents, count(*) AS boxes
  FROM r GROUP BY 1, 2""")  # fmt: skip
def entity_counts(spark, sf_dir):
    return sanitize.entity_counts(_docs(spark, sf_dir))


@query()
def contextual_spans(spark, sf_dir):
    return detect.contextual(_docs(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, 'Your order number is ORD-' || o_orderkey || '-' || o_custkey || '. The ' || CASE WHEN o_orderkey % 2 = 0 THEN 'passcode: ' ELSE 'parcel: ' END || (1000 + o_custkey % 9000) || ' opens it.' AS text,
    'ORD-' || o_orderkey || '-' || o_custkey AS number, (1000 + o_custkey % 9000)::VARCHAR AS code FROM orders)
  SELECT doc_id, 21::BIGINT AS start, 21 + length(number) AS "end", 'CUSTOMER_IDENTIFIER' AS entity_type, 0.9::DOUBLE AS score, number AS match FROM o
  UNION ALL SELECT doc_id, strpos(text, ': ') + 1, strpos(text, ': ') + 1 + length(code), 'SECURITY_CODE', 0.92::DOUBLE, code FROM o WHERE doc_id % 2 = 0""")  # fmt: skip
def contextual_order_spans(spark, sf_dir):
    """Order numbers and codes that the words before them give away, in a notice on every order."""
    notice = F.concat(
        F.lit("Your order number is ORD-"), "o_orderkey", F.lit("-"), "o_custkey", F.lit(". The "),
        F.when(F.col("o_orderkey") % 2 == 0, "passcode: ").otherwise("parcel: "), (F.col("o_custkey") % 9000 + 1000).cast("string"), F.lit(" opens it."),
    )
    return detect.contextual(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), notice.alias("text")))


@query()
def fuzzy_localization(spark, sf_dir):
    """Quotes from every turn of the conversations, each turn a page."""
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), "text")
    w = words.word_spans(pages.select(F.struct("doc_id", "page_number").alias("page"), "text"), "page")
    w = w.select("page.*", "word_index", F.col("word").alias("text"), F.col("start").alias("start_char"), F.col("end").alias("end_char"))
    quotes = pages.select("doc_id", "page_number", F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("quote"), F.lit("PERSON").alias("category"), F.lit(0.9).alias("confidence"))
    return fuzzy.localize_quotes(quotes, w)


@query("SELECT conv_id, turn, true AS ok, text AS quote, 'name' AS category, 0.9::DOUBLE AS confidence FROM conversations WHERE trim(text) <> ''")
def answer_items(spark, sf_dir):
    item = F.to_json(F.struct(F.col("text").alias("quote"), F.lit("name").alias("category"), F.lit("90%").alias("confidence")))
    raw = F.concat(F.lit("<think>x</think>```json\n["), item, F.lit(",]\n```"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", payloads.parse_answer(raw).alias("a"))
    return rows.select("conv_id", "turn", "a.ok", F.explode("a.items").alias("i")).select("conv_id", "turn", "ok", "i.*")


def _grid(spark, sf_dir):
    """Words laid out as a table: a line item's fields in columns, a page an order."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("a"), F.max("l_quantity").cast("string").alias("b"), F.max("l_extendedprice").cast("string").alias("c"))
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    cells = rows.select(F.col("l_orderkey").alias("doc_id"), "line", F.posexplode(F.array("a", "b", "c")).alias("k", "text"))
    y = F.col("line") * 12.0
    return cells.select("doc_id", F.lit(0).alias("page_number"), (F.col("line") * 3 + F.col("k")).cast("int").alias("word_index"), "text", (F.col("k") * 100.0).alias("x0"), y.alias("y0"), (F.col("k") * 100.0 + 40).alias("x1"), (y + 10).alias("y1"))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
  SELECT doc_id, 1.0::DOUBLE AS confidence, n::INT AS row_count, 3 AS col_count, (3 * n)::BIGINT AS cells FROM c WHERE n >= 2""")  # fmt: skip
def table_regions(spark, sf_dir):
    cells = tables.detect_tables(_grid(spark, sf_dir))
    return cells.groupBy("doc_id", "confidence", "row_count", "col_count").agg(F.count("*").alias("cells"))


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_returnflag) || ' | ' || max(l_quantity) || ' | ' || max(l_extendedprice) AS line FROM lineitem GROUP BY 1, 2)
  SELECT doc_id, 0::INT AS page_number, 0::INT AS table_no, '[TABLE]' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) || '[/TABLE]' AS text FROM r GROUP BY 1 HAVING count(*) >= 2""")  # fmt: skip
def table_texts(spark, sf_dir):
    return tables.table_texts(tables.detect_tables(_grid(spark, sf_dir)))


@query("""SELECT o_orderkey, round(greatest(0, least(1, CASE WHEN o_totalprice > 1 THEN o_totalprice / 100 ELSE o_totalprice END)), 6) AS confidence FROM orders""")
def confidence_values(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(numbers.confidence("o_totalprice"), 6).alias("confidence"))


def _paged(spark, sf_dir):
    """Words of documents of four pages: four texts that follow one another by id."""
    rows = words.word_spans(_docs(spark, sf_dir).where(detect.holds_any()))
    page = (F.col("doc_id") % 4).cast("int")
    box = B.box(page, F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1"), F.col("bbox.y1"))
    return rows.select(F.floor(F.col("doc_id") / 4).alias("doc_id"), page.alias("page_number"), "word_index", F.col("word").alias("text"), "line_key", box.alias("bbox"))


FOUND = " UNION ALL ".join(f"({typed_sql(t, 'canon')})" for t in sanitize.TYPES)


# Spans are those of the pages' canonical text, in which a line ends by a line feed.
@query(CANONICAL + f""", canon AS (SELECT doc_id, string_agg(sep || word, '' ORDER BY word_index) AS text FROM s GROUP BY doc_id),
  placed AS (SELECT doc_id, word_index, length(word) AS n, sum(length(sep) + length(word)) OVER (PARTITION BY doc_id ORDER BY word_index)::BIGINT AS reach FROM s),
  hit AS (SELECT DISTINCT p.doc_id, p.word_index FROM ({FOUND}) f JOIN placed p ON p.doc_id = f.doc_id AND p.reach - p.n < f."end" AND p.reach > f.start)
  SELECT doc_id // 4 AS doc_id, (doc_id % 4)::INT AS page_number, greatest(0, w.start - 0.8)::DOUBLE AS x0, 0::DOUBLE AS y0, w."end"::DOUBLE + 0.8 AS x1, 2.2::DOUBLE AS y1 FROM w JOIN hit USING (doc_id, word_index)""")  # fmt: skip
def redaction_boxes(spark, sf_dir):
    """Boxes to blacken on every page: entities of whole documents, their boxes padded and clipped."""
    placed = _paged(spark, sf_dir)
    sizes = placed.groupBy("doc_id", "page_number").agg((F.max("bbox.x1") + 10).alias("width"), F.lit(100.0).alias("height"))
    return whole.redaction_boxes(whole.document_entities(placed), sizes)


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/Times-Bold' WHEN 1 THEN '/ABCDEF+SanitizedFont' || p_partkey ELSE '/SanitizedFont' || p_partkey END AS font FROM part""")
def font_names(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, "/Times-Bold").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/ABCDEF+"), "p_type")).otherwise(F.concat(F.lit("/"), "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", fonts.scrubbed_font("name", "p_partkey").alias("font"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS w, 4 + l_linenumber AS h FROM lineitem),
  i AS (SELECT *, least(least(3, w * 0.1), (w - greatest(0.8, w * 0.32)) / 2) AS ix, least(least(1.5, h * 0.2), (h - greatest(0.8, h * 0.4)) / 2) AS iy FROM b)
  SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(ix, 0) - 0.8, 6) AS x0, round(greatest(iy, 0) - 1.2, 6) AS y0, round(w - greatest(ix, 0) + 0.8, 6) AS x1, round((h - greatest(iy, 0) + 1.2)::DOUBLE, 6) AS y1 FROM i""")  # fmt: skip
def box_tighten(spark, sf_dir):
    config = EngineConfig(tighten=True, inset_x_ratio=0.1, inset_x_max=3.0, inset_y_ratio=0.2, inset_y_max=1.5)
    b = B.box(F.lit(0), F.lit(0.0), F.lit(0.0), F.col("l_quantity"), (F.col("l_linenumber") + 4).cast("double"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.tighten(b, config).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(F.col("b")[e], 6).alias(e) for e in ("x0", "y0", "x1", "y1")))


def _states(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "failed").otherwise("queued")
    return jobs.latest_states(read(spark, sf_dir, "events").withColumn("status", kind), "user_id", "status", "ts", "event_id")


STATES = """WITH s AS (SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'failed' ELSE 'queued' END, row(ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY 1)"""


@query(STATES + " SELECT * FROM s WHERE status = 'queued' OR updated_at >= TIMESTAMP '2024-01-30 17:00:00' - INTERVAL 1800 SECOND")
def live_jobs(spark, sf_dir):
    return jobs.visible(_states(spark, sf_dir), F.lit("2024-01-30 17:00:00").cast("timestamp"))


@query(STATES + """, p AS (SELECT user_id, max(event_id) % 150 / 100 AS progress FROM events WHERE event_type = 'click' GROUP BY 1)
  SELECT user_id, status, coalesce(least(1, progress), CASE WHEN status = 'completed' THEN 1 ELSE 0 END)::DOUBLE AS progress, CASE WHEN p.user_id IS NULL THEN status ELSE 'clicked' END AS message FROM s LEFT JOIN p USING (user_id)""")  # fmt: skip
def job_progress(spark, sf_dir):
    seen = read(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("job_id")).agg((F.max("event_id") % 150 / 100).alias("progress"), F.lit("clicked").alias("message"))
    rows = jobs.job_status(_states(spark, sf_dir).select(F.col("user_id").alias("job_id"), "status"), seen)
    return rows.select(F.col("job_id").alias("user_id"), "status", "progress", "message")


@query("""SELECT conv_id, turn, '[{"n": ' || turn || ', "t": "' || length(text) || '"} ]' AS answer FROM conversations WHERE text IS NOT NULL""")
def answer_cleaning(spark, sf_dir):
    """Answers without thoughts, code fences, curly quotes and commas before a bracket; the turn's whole text is the thought."""
    raw = F.concat(F.lit("<think>"), "text", F.lit("</think>\n```json\n[{“n”: "), F.col("turn").cast("string"), F.lit(", “t”: “"), F.length("text").cast("string"), F.lit("”,}, ]\n```"))
    rows = read(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", text.repair_json(text.strip_fence(text.strip_think(raw))).alias("answer"))
