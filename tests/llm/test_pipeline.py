import corpus_pipeline as P
from tests.llm.helpers import frame, prose


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert 0 < now.count() <= docs.count()
        assert now.select("doc_id").distinct().count() == now.count()
    pieces = P.STAGES[-1][1](spark, now, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir).collect()
    assert len({r.sequence_id for r in got}) > 1 and all(r.length > 0 for r in got)


def test_near_dedup_keeps_one_of_a_group(spark, sf_dir):
    base = prose(1, 80, 3000)
    rows = [(3, base), (5, base + " more"), (5, base + " more"), (9, prose(2, 80, 3000)), (9, prose(2, 80, 3000)), (None, "alone")]
    got = P.near_dedup(spark, frame(spark, rows), sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 3, 9]


def test_line_dedup_drops_emptied_texts(spark, sf_dir):
    base = prose(1, 80)
    rows = [(1, base), (2, base), (3, base + "\nown line"), (4, ""), (5, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in P.line_dedup(spark, frame(spark, [(k, t, None, None, 7) for k, t in rows]), sf_dir).collect()}
    assert got == {1: (base, 7), 3: ("own line", 8), 4: ("", 7), 5: (None, 7)}


def test_clashing_columns_and_empty_tables(spark, sf_dir):
    """Columns named like those the stages use survive every stage; empty tables pass."""
    names = ["score", "lang_pred", "n_lines", "n_removed", "runs", "th", "h", "kept", "_id", "coverage", "contaminated", "item_ids", "row", "_row", "set_key", "document", "doc", "id"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").selectExpr("*", *(f"'own {n}' as {n}" for n in names))
    for now in (docs, docs.where("doc_id < 0")):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, now, sf_dir)
            assert out.columns == docs.columns
            assert all(r[n] == f"own {n}" for r in out.collect() for n in names)
        P.STAGES[-1][1](spark, now, sf_dir).collect()
