"""Resampling towards a target: hashed n-gram counts of corpus and target, log-ratio weights, and a draw without replacement by keyed noise."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, materialise, tidied, utf8
from .text import word_blocks

#: Longest run of words, buckets, words a document needs to be drawn, percent of such documents that are drawn, and the key of the noise.
WIDTH, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024


class CrcRing:
    """Running CRC-32 states of the last `width` starts: each word extends them all by a space and itself, and starts one more."""

    def __init__(self, width: int):
        self.older, self.states = width - 1, []

    def extend(self, words: list[bytes]) -> list[int]:
        """The CRCs of all runs that end with one of the words."""
        out = []
        for word in words:
            behind = b" " + word
            self.states = [crc32(word), *(crc32(behind, s) for s in self.states[: self.older])]
            out += self.states
        return out


def bucket_list(text: bytes, width: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the bucket of every run of 1 to `width` of its words, repeats included."""
    ring, n, found = CrcRing(width), 0, [np.empty(0, np.uint32)]
    for words in word_blocks(text):
        n += len(words)
        found.append((np.array(ring.extend(words), np.uint32) % np.uint32(buckets)).astype(np.uint32))
    return n, np.concatenate(found)


def bucketed(docs: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, keep: str | None = "doc_id") -> DataFrame:
    """n_words and the buckets of the features (little-endian 32-bit numbers) of every text, in one scan; null counts as empty."""
    kept = [F.col(keep).cast("long").alias(keep)] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [bucket_list(t, width, buckets) for t in utf8(batch.column("text"))]
            made = [pa.array([n for n, _ in found], pa.int64()), pa.array([b.astype("<u4").tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*([batch.column(keep)] if keep else []), *made], names=[*([keep] if keep else []), "n_words", "buckets"])

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{f'{keep} long, ' if keep else ''}n_words long, buckets binary")


def bucket_counts(lists: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences in each bucket over all rows. A task sends one row for each bucket it met, so at most `buckets` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), "<u4"), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in lists.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) of each bucket, p and q being the shares of target and corpus with one added to every count."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratios = [(float(t) + 1) * (s_all + size) / ((float(s) + 1) * (t_all + size)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighed(lists: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(2)]
            sizes, sums = [len(x) for x in found], [int(gain[x].sum()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return lists.select("doc_id", "n_words", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int = SEED) -> F.Column:
    """floor(1000 times Gumbel noise) from the first 32 bits of sha256("seed:doc_id"); a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add `rank` (1, 2, ...) to the rows of the highest scores among those with enough words: floor(percent N / 100) of N; null on others.

    One order over all rows is dealt out by ranges: a rank is a place in a range plus the sizes of the ranges before it.
    Rows that agree in score and doc_id are ordered by their other columns; wholly equal rows are spread by a number of their own, so that
    however many there are, they needn't share a range.
    """
    enough = scored.withColumns({"_few": F.col("n_words") < least_words, "_own": F.monotonically_increasing_id()})
    order = [F.col("_few"), F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("_own")]
    placed = materialise(enough.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    n = placed.filter("not _few").count() * percent // 100
    along = Window.orderBy("_range")  # over as many rows as there are ranges
    before = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", (F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return placed.join(F.broadcast(before), "_range").withColumn("_place", place).withColumn("rank", F.when(~F.col("_few") & (F.col("_place") <= n), F.col("_place"))).select(*scored.columns, "rank")


@tidied
def resampled(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of docs; rank is null where a row isn't drawn.

    Null and empty texts have no features and weight 0; repeated rows are weighed, and can be drawn, each; with an empty target, or empty
    docs, the counts on that side are 0. Texts of any length are taken whole, in blocks. Columns other than doc_id and text are not read.
    Gains (one number a bucket) are all that goes to every task.
    """
    lists = materialise(bucketed(docs, width, buckets), "buckets")
    gain = gains(bucket_counts(lists, buckets), bucket_counts(bucketed(target, width, buckets, keep=None), buckets))
    scored = weighed(lists, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    return drawn(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
