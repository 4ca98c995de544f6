"""Mapped reads from text lines. A parser is a set of column expressions over `value`; reads are (chrom, strand, start, cigar)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import normalise_chrom

Parser = Callable[[DataFrame], DataFrame]


def _fields(lines: DataFrame, pattern: str, least: int, trim: bool = False) -> DataFrame:
    value = F.trim("value") if trim else F.col("value")
    return lines.withColumn("_f", F.split(value, pattern)).filter(F.size("_f") >= least)


def _at(k: int) -> Column:
    return F.col("_f")[k]


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _strand(reverse: Column) -> Column:
    return F.when(reverse, "R").otherwise("F")


def _reads(parsed: DataFrame, chrom: Column, start: Column, strand: Column, cigar: Column) -> DataFrame:
    found = parsed.select(normalise_chrom(chrom).alias("chrom"), strand.alias("strand"), start.cast("int").alias("start"), cigar.alias("cigar"))
    return found.filter((F.col("start") >= 1) & (F.col("chrom") != ""))


def _block(length: Column) -> Column:
    return F.concat(length.cast("string"), F.lit("M"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Unmapped reads (flag 4) and header lines go; flag 16 is the reverse strand."""
    f = _fields(lines.filter(~F.col("value").startswith("@")), "\t", 11)
    flag = _number(_at(1))
    return _reads(f.filter(flag.bitwiseAND(4) == 0), _at(2), _number(_at(3)), _strand(flag.bitwiseAND(16) != 0), _at(5))


def parse_eland(lines: DataFrame) -> DataFrame:
    f = _fields(lines, r"\s+", 9, trim=True)
    return _reads(f, _at(6), _number(_at(7)), _strand(_at(8).startswith("-") | _at(8).startswith("R")), _block(F.length(_at(1))))


def parse_bowtie(lines: DataFrame) -> DataFrame:
    f = _fields(lines, "\t", 5)
    return _reads(f, _at(2), _number(_at(3)) + 1, _strand(_at(1).startswith("-")), _block(F.length(_at(4))))


def parse_tagalign(lines: DataFrame) -> DataFrame:
    """Starts and ends are taken as 1-based and inclusive."""
    f = _fields(lines, r"\s+", 6, trim=True)
    return _reads(f, _at(0), _number(_at(1)), _strand(_at(5).startswith("-")), _block(_number(_at(2)) - _number(_at(1)) + 1))


def _bed(lines: DataFrame, strand: int) -> DataFrame:
    f = _fields(lines, r"\s+", strand + 1, trim=True)
    return _reads(f, _at(0), _number(_at(1)) + 1, _strand(_at(strand).startswith("-")), _block(_number(_at(2)) - _number(_at(1))))


def parse_bed5(lines: DataFrame) -> DataFrame:
    return _bed(lines, 4)


def parse_bed6(lines: DataFrame) -> DataFrame:
    return _bed(lines, 5)


def parse_gff_reads(lines: DataFrame) -> DataFrame:
    """chrom, position, CIGAR, strand."""
    f = _fields(lines, r"\s+", 4, trim=True)
    return _reads(f, _at(0), _number(_at(1)), _strand(_at(3).startswith("-") | _at(3).startswith("R")), _at(2))


def parse_preprocessed(lines: DataFrame) -> DataFrame:
    """CIGAR, strand, start, with the chromosome in a column `chrom`."""
    f = _fields(lines, r"\s+", 3, trim=True)
    return _reads(f, F.col("chrom"), _number(_at(2)), _at(1), _at(0))


#: BED4 lines are read as BED5 lines are.
PARSERS: dict[str, Parser] = {"SAM": parse_sam, "ELAND": parse_eland, "bowtie": parse_bowtie, "tagAlign": parse_tagalign, "BED4": parse_bed5, "BED5": parse_bed5, "BED6": parse_bed6, "GFF3": parse_gff_reads}


def read_mapped(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Reads of text files (plain or .gz) in one of PARSERS."""
    if kind not in PARSERS:
        raise ValueError(f"unknown read format {kind!r}; known: {', '.join(PARSERS)}")
    return PARSERS[kind](spark.read.text(paths))


def preprocess(reads: DataFrame, path: str, sample: str, pool: bool = True) -> None:
    """Add reads to a table partitioned by sample and chromosome; without pool an existing table is an error."""
    dealt = reads.withColumn("sample", F.lit(sample)).repartition("chrom", F.floor(F.col("start") / (1 << 22)))
    dealt.write.mode("append" if pool else "errorifexists").partitionBy("sample", "chrom").parquet(path)


def mapped_lines(lines: DataFrame) -> DataFrame:
    """One row: how many SAM lines are mapped reads."""
    f = lines.filter(~F.col("value").startswith("@")).select(_number(F.split("value", "\t")[1]).alias("flag"))
    return f.agg(F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("mapped"))
