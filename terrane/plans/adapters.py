"""Reads, signals, regions and sequences derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    length = F.col("l_quantity").cast("int")
    return x.select(
        F.when(F.col("l_suppkey") % 3 == 0, "control").otherwise("chip").alias("sample"), F.concat("l_returnflag", "l_linestatus").alias("chrom"),
        F.when(F.col("l_linenumber") % 2 == 0, "R").otherwise("F").alias("strand"), (F.col("l_orderkey") + 1).cast("int").alias("start"), F.concat(length.cast("string"), F.lit("M")).alias("cigar"),
    )


READS = """reads AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'control' ELSE 'chip' END AS sample, concat(l_returnflag, l_linestatus) AS chrom,
 CASE WHEN l_linenumber % 2 = 0 THEN 'R' ELSE 'F' END AS strand, CAST(l_orderkey + 1 AS INT) AS start, CAST(floor(l_quantity) AS INT) AS len,
 concat(CAST(floor(l_quantity) AS INT), 'M') AS cigar FROM lineitem)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos, value): events numbered along each type in time."""
    from ..operators.chunked import ranked

    x = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "value")
    return ranked(x, ["chrom"], ["t", "event_id"], "pos", chunk=86_400_000_000).select("chrom", "pos", "value")


SIGNAL = "signal AS (SELECT event_type AS chrom, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, value FROM events)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") * 40 + 1
    return x.select(
        F.col("o_orderstatus").alias("chrom"), start.alias("start"), (start + F.floor("o_totalprice") % 200).cast("long").alias("end"), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("+").alias("strand"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.floor("o_totalprice").cast("long").alias("score"), (F.col("o_orderkey") % 4).cast("int").alias("part"),
    )


REGIONS = """regions AS (SELECT o_orderstatus AS chrom, o_orderkey * 40 + 1 AS start, o_orderkey * 40 + 1 + CAST(floor(o_totalprice) AS BIGINT) % 200 AS "end",
 CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand, concat('o', o_orderkey) AS name, CAST(floor(o_totalprice) AS BIGINT) AS score, o_orderkey % 4 AS part FROM orders),
 a AS (SELECT * FROM regions WHERE part < 2), b AS (SELECT * FROM regions WHERE part >= 2)"""


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = regions(spark, sf_dir)
    return x.filter("part < 2").drop("part"), x.filter("part >= 2").drop("part")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, seq): the letters A, C, G and T of whole texts."""
    x = table(spark, sf_dir, "documents")
    return x.select(F.col("doc_id").cast("string").alias("chrom"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


SEQUENCES = "seqs AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
