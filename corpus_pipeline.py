"""The corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, PII surrogates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. Columns of docs other
than doc_id, text and n_chars go through untouched whatever their names; repeated rows are treated alike, an empty table stays empty, and
texts of any length are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.decontaminate import contamination
from terrane.llm.near_dedup import near_duplicates
from terrane.llm.packing import best_fit_packing
from terrane.llm.shared import materialise, surrogate_key, table, tidied, without
from terrane.llm.surrogates import checked
from terrane.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go; null and empty texts are scored by the bias alone."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of least doc_id stays; rows without doc_id stay."""
    return without(docs, near_duplicates(docs).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; rows without doc_id stay."""
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts get surrogates; n_chars follows the text where the column is there."""
    done = checked(docs, surrogate_key(spark)).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024, one row for each piece of a document; a null or empty text is one piece of one token."""
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: No SQL: the stages learn a model, hash and pack. tests/llm holds run() against a plain version.
ORACLE_SQL = None


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
