"""Binary profile, mappability and sequence files, and FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import normalise_chrom
from ..operators.chunked import settled
from .binary import BLOCK_VALUES, BinarySource


def _reader(spark: SparkSession, **options) -> DataFrameReader:
    spark.dataSource.register(BinarySource)
    return spark.read.format(BinarySource.name()).options(**options)


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("chrom", normalise_chrom(F.col("chrom")))


def _write(rows: DataFrame, path: str, kind: str) -> None:
    """Rows with `chrom` and `l`; a chromosome is a file, so its rows go to one task, which takes them in order as a stream."""
    rows.sparkSession.dataSource.register(BinarySource)
    rows.repartition("chrom").sortWithinPartitions("chrom", "start").write.format(BinarySource.name()).mode("append").options(kind=kind).save(path)


def read_profiles(spark: SparkSession, path: str, kind: str, scale: float = 1.0, range_bytes: int | None = None) -> DataFrame:
    """Runs other than 0 of `<chrom>.bin` files; mappability files are uint8 with scale 0.01. A run may be cut where a range ends: compact() joins
    them. Files that lack the padding value, or the end, give what they hold."""
    return _named(_reader(spark, kind=kind, scale=scale, **({"range_bytes": range_bytes} if range_bytes else {})).load(path))


def write_profiles(profile: DataFrame, ends: DataFrame, path: str, kind: str) -> None:
    """A `<chrom>.bin` for each row (chrom, l) of ends, with positions 1 to l of the profile and a value of padding; gaps are 0."""
    own = profile.select("chrom", F.col("start").cast("long"), F.col("end").cast("long"), F.col("value").cast("double"))
    ends = settled(ends.select("chrom", F.col("l").cast("long")), "ends")
    heads = ends.select("chrom", "l", *(F.lit(None).cast(t).alias(c) for c, t in own.dtypes if c != "chrom"))  # also of chromosomes without runs
    _write(own.join(F.broadcast(ends), "chrom").unionByName(heads), path, kind)


def read_lengths(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(chrom, l) for each chrom of `wanted`: the length that its file states, 0 where there is no file."""
    found = _named(_reader(spark, kind="length").load(path))
    return wanted.select("chrom").distinct().join(found, "chrom", "left").withColumn("l", F.coalesce("l", F.lit(0).cast("long")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq) of FASTA records longer than one base; the whole header line names the record."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s+", "")
    return records.select(normalise_chrom(F.regexp_replace(head, r"\s+$", "")).alias("chrom"), body.alias("seq")).filter(F.length("seq") > 1)


def read_sequence_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, piece) of binary sequence files, pieces of bounded length."""
    return _named(_reader(spark, kind="text").load(path))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq) of binary sequence files, each sequence in one value."""
    pieces = read_sequence_pieces(spark, path).groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("p"))
    return pieces.select("chrom", F.array_join("p.piece", "").alias("seq"))


def write_sequences(seqs: DataFrame, path: str) -> None:
    """A `<chrom>.bin` for each row (chrom, seq), or for each chrom of pieces (chrom, start, piece) without gaps."""
    if "seq" in seqs.columns:
        begins = F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(BLOCK_VALUES))
        seqs = seqs.select("chrom", "seq", F.explode(begins).alias("at")).select("chrom", F.col("at").cast("long").alias("start"), F.substring("seq", F.col("at"), F.lit(BLOCK_VALUES)).alias("piece"))
    ends = seqs.groupBy("chrom").agg(F.sum(F.length("piece")).alias("l"))
    _write(ends.join(seqs, "chrom"), path, "text")
