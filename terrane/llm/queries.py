"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .decontaminate import contamination
from .importance import resampled
from .language import languages
from .language_model import score_corpus
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import best_fit_packing
from .quality import quality
from .shared import surrogate_key, table
from .surrogates import pseudonymised
from .token_edits import edit_aware_counts, standard_edits
from .toxicity import toxicity
from .turns import damaged, repaired
from .warc import round_trip


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_aware_counts(table(spark, sf_dir, "documents"), standard_edits(F.col("text")))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_learned_partitions, op3_language_id, op4_toxicity, op5_lm_scoring, op6_minhash, op7_decontamination, op8_warc, op9_best_fit_packing, op10_pii_surrogates, op11_quality_classifier, op12_conversation_repair, op13_importance_resampling)}
SQL: dict[str, str] = {"op6_minhash": sql.MINHASH, "op7_decontamination": sql.DECONTAMINATION, "op8_warc": sql.WARC, "op12_conversation_repair": sql.CONVERSATIONS, "op13_importance_resampling": sql.IMPORTANCE}
