"""From raw documents to token digests: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. SQL cannot express the classifier or the tokenizer, so ORACLE_SQL is None and tests/llm holds the
rows of run() against brute-force versions of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontaminate, language_id, line_dedup, near_dups
from tidewatch.llm.common import BROADCAST_ROWS, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the language classifier rejects.

    Null texts and texts without a letter are rejected. Repeated rows and null ids are judged like any other; an empty
    table stays empty, and all goes if no row has a language to learn from. Long texts are read whole. Own columns named
    lang_pred, score or rejected would be replaced; documents has none.
    """
    model = language_id.train(docs.where(~language_id.is_held_out()).select("doc_id", "text", "lang"))
    return language_id.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of line runs of 50 words or more from the texts; n_chars follows.

    Every row stays, also where nothing of its text does. Null and empty texts and rows with a null id are unchanged;
    rows that repeat both id and text are one document and no repeats of each other. Of ties the smaller doc_id, then the
    higher place in the text keeps its lines. Columns of any name are carried along.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


#: Percent of shared word shingles from which two documents are near-duplicates in the near_dedup stage.
NEAR_PERCENT = 80


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, a similarity of 0.8), the one of the smallest doc_id.

    Null, empty and blank texts have no shingles and stay, as do rows with a null id; rows that repeat the id that is kept
    all stay. Long texts are compared whole, an empty table stays empty, other columns are carried along.
    """
    gone = written(near_dups.near_duplicates(docs, percent=NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap a benchmark item: 13 tokens with two substitutions, or the whole of a shorter item.

    Null and empty texts and rows with a null id overlap nothing and stay; repeated rows go or stay together; without a
    benchmark all stays. Long texts are read whole, other columns are carried along.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row each; null and empty texts have no tokens."""
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text")))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", leak_stage), ("bpe", token_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
