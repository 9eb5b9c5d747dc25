"""Training-corpus pipeline: five filtering and shaping stages over ``documents``.

Each stage takes all that its predecessor kept. ``run`` writes every stage's rows to the
shared folder and reads them again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontam, langid, linededup, neardup, packing
from veilframe.llm.common import crc_fold, staged, table, tokenizer

#: Documents go whose language is unknown or less certain than this.
LEAST_SCORE = 0.3
#: Words in a shingle, and similarity in percent, of near-duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _carried(docs: DataFrame) -> DataFrame:
    """Each document's other columns as one beside its id and text: what an operator adds cannot clash with them."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("document"), "doc_id", "text")


def _unpacked(docs: DataFrame, like: DataFrame, **changed) -> DataFrame:
    """The columns of ``like`` again."""
    return docs.select(*(changed[c].alias(c) if c in changed else F.col("text") if c == "text" else F.col("document")[c].alias(c) for c in like.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones; without letters they go.

    So do null and empty texts. Repeated rows are judged alike; an empty table, or one
    without labelled rows, leaves none.
    """
    model = langid.fit(docs, crc_fold(F.col("doc_id"), 4) != 2)
    found = langid.identify(_carried(docs), model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _unpacked(found, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that repeat earlier ones; texts left empty go.

    Earlier is by doc_id, then by place. Null and empty texts that lost nothing stay as they
    are; n_chars is counted anew where lines went. An empty table stays empty.
    """
    out = linededup.dedup_lines(_carried(docs), both_ways=True).where("n_removed = 0 or trim(text) != ''")
    if "n_chars" not in docs.columns:
        return _unpacked(out, docs)
    return _unpacked(out, docs, n_chars=F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("document.n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id.

    Documents without words are linked with nothing and stay, null ids too. Where an id
    occurs more than once, its rows with equal texts become one. An empty table stays empty.
    """
    found = staged(neardup.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY), "near")
    kept = found.where("kept").select(F.col("doc_id").alias("_id")).distinct()
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, repeated rows are judged alike; without
    benchmark items all stay.
    """
    return _unpacked(decontam.decontaminate(_carried(docs), table(spark, sf_dir, "benchmark")).where("not contaminated"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens.

    A null or empty text is its closing id alone; repeated rows are packed each. An empty
    table gives no pieces.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The stages are iterative or run tokenizers: none of the whole can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
