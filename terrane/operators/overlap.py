"""The range join: intervals meet in bins, each overlapping pair in exactly one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 4096


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*(prefix + c for c in df.columns))


def _binned(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    first, last = F.floor(F.col(start) / size), F.floor(F.col(end) / size)
    return df.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chrom",), bin_size: int = BIN) -> DataFrame:
    """All pairs of rows of a and b that share the keys and overlap (ends inclusive), columns prefixed a_ and b_.

    A pair is kept in the bin where its overlap starts, so no DISTINCT is needed. Catalyst picks the join; the overlap is its residual.
    """
    left, right = _binned(prefixed(a, "a_"), "a_start", "a_end", bin_size), _binned(prefixed(b, "b_"), "b_start", "b_end", bin_size)
    same = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    met = left.withColumnRenamed("_bin", "_abin").join(
        right.withColumnRenamed("_bin", "_bbin"),
        [*same, F.col("_abin") == F.col("_bbin"), F.col("a_start") <= F.col("b_end"), F.col("b_start") <= F.col("a_end"), F.col("_abin") == F.floor(F.greatest("a_start", "b_start") / bin_size)],
    )
    return met.drop("_abin", "_bbin").withColumns({"ol_start": F.greatest("a_start", "b_start"), "ol_end": F.least("a_end", "b_end")})
