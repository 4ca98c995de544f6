"""Region files: BED and its relatives, narrowPeak, Interval, chromosome lengths, sequences beside regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import normalise_chrom, to_internal


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines (`value`) other than blank ones, comments and track lines."""
    return lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("track"))


def line_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(F.trim("value") != "").alias("n_filled"))


def _split(lines: DataFrame, pattern: str = r"\s+") -> DataFrame:
    return data_lines(lines).withColumn("_f", F.split(F.trim("value"), pattern))


def _at(k: int) -> Column:
    return F.get("_f", F.lit(k))


def _or(k: int, default: str) -> Column:
    return F.coalesce(_at(k), F.lit(default))


def _int(k: int) -> Column:
    return _at(k).cast("long")


def _ints(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast("long"))


def parse_bed(lines: DataFrame) -> DataFrame:
    """BED3 to BED6; missing name `.`, score 0, strand `+`. A start behind its end is an error."""
    f = _split(lines, "\t").withColumns({"start": to_internal(_int(1), "bed"), "end": to_internal(_int(2), "bed", "end")})
    start = F.when(F.col("start") <= F.col("end"), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("region starts behind its end: "), F.col("value"))).cast("long"))
    return f.select(normalise_chrom(_at(0)).alias("chrom"), start.alias("start"), "end", _or(5, "+").alias("strand"), _or(3, ".").alias("name"), F.coalesce(_at(4).try_cast("long"), F.lit(0)).alias("score"))


def parse_bed12(lines: DataFrame) -> DataFrame:
    """Blocks become intervals; starts stay as they are written."""
    f = _split(lines)
    blocks = F.zip_with(_ints(_at(11)), _ints(_at(10)), lambda s, n: F.struct((_int(1) + s).alias("start"), (_int(1) + s + n).alias("end")))
    return f.select(normalise_chrom(_at(0)).alias("chrom"), _int(1).alias("start"), _int(2).alias("end"), _at(5).alias("strand"), _at(3).alias("name"), _at(4).try_cast("long").alias("score"), _int(6).alias("thick_start"), _int(7).alias("thick_end"), blocks.alias("intervals"))


def parse_bed_with_lines(lines: DataFrame) -> DataFrame:
    f = _split(lines, "\t")
    return f.select(normalise_chrom(_at(0)).alias("chrom"), to_internal(_int(1), "bed").alias("start"), _int(2).alias("end"), _or(5, "+").alias("strand"), F.col("value").alias("line"))


def parse_bed_log_p(lines: DataFrame) -> DataFrame:
    """chrom start end _ log_p, without a shift; strand +."""
    f = _split(lines)
    return f.select(normalise_chrom(_at(0)).alias("chrom"), _int(1).alias("start"), _int(2).alias("end"), F.lit("+").alias("strand"), _at(4).cast("double").alias("log_p"))


def parse_narrowpeak(lines: DataFrame) -> DataFrame:
    """narrowPeak and broadPeak; `.` is null. The peak's own strand is a payload column, the region's is +."""
    f = _split(lines)
    known = lambda k: F.when(_at(k) != ".", _at(k))
    return f.select(
        normalise_chrom(_at(0)).alias("chrom"), to_internal(_int(1), "narrowpeak").alias("start"), _int(2).alias("end"), F.lit("+").alias("strand"), known(3).alias("name"),
        known(4).cast("double").alias("score"), known(5).alias("peak_strand"), known(6).cast("double").alias("signal"), known(7).cast("double").alias("p"), known(8).cast("double").alias("q"), known(9).cast("long").alias("peak"),
    )


def parse_interval(lines: DataFrame) -> DataFrame:
    """name chrom strand start end n starts ends, 0-based starts; lists of different lengths are an error."""
    f = _split(lines)
    starts, ends = _ints(_at(6)), _ints(_at(7))
    same = F.when(F.size(starts) == F.size(ends), F.zip_with(starts, ends, lambda s, e: F.struct((s + 1).alias("start"), e.alias("end"))))
    wrong = F.raise_error(F.concat(F.lit("starts and ends differ in number: "), F.col("value"))).cast("array<struct<start:bigint,end:bigint>>")
    return f.select(normalise_chrom(_at(1)).alias("chrom"), to_internal(_int(3), "interval").alias("start"), _int(4).alias("end"), _at(2).alias("strand"), _at(0).alias("name"), F.coalesce(same, wrong).alias("intervals"))


def parse_lengths(lines: DataFrame) -> DataFrame:
    return _split(lines).select(normalise_chrom(_at(0)).alias("chrom"), _int(1).alias("length"))


def parse_bed_with_sequence(lines: DataFrame, sequences: int = 1) -> DataFrame:
    """BED6 and one sequence (starts shifted) or two, ancestral and derived (starts as written)."""
    f = _split(lines)
    start = to_internal(_int(1), "bed") if sequences == 1 else _int(1)
    extra = [_at(6).alias("sequence")] if sequences == 1 else [_at(6).alias("ancestral"), _at(7).alias("derived")]
    return f.select(normalise_chrom(_at(0)).alias("chrom"), start.alias("start"), _int(2).alias("end"), _at(5).alias("strand"), _at(3).alias("name"), _at(4).try_cast("long").alias("score"), *extra)


def parse_bedgraph(lines: DataFrame, order: str | None = None) -> DataFrame:
    """Runs of a bedGraph. With `order` (a column of the lines), later lines overwrite earlier ones where they overlap."""
    f = _split(lines)
    cols = [normalise_chrom(_at(0)).alias("chrom"), to_internal(_int(1), "bedgraph").alias("start"), _int(2).alias("end"), _at(3).cast("double").alias("value")]
    if order is None:
        return f.select(*cols)
    from ..operators.chunked import neighbours
    from ..operators.overlap import overlap_join

    runs = f.select(*cols, F.col(order).alias("_line"))
    cuts = runs.select("chrom", F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("pos")).distinct()
    pieces = neighbours(cuts, ["chrom"], ["pos"], ["pos"], previous=False).filter("next_pos is not null").select("chrom", F.col("pos").alias("start"), (F.col("next_pos") - 1).alias("end"))
    last = overlap_join(pieces, runs).groupBy("a_chrom", "a_start", "a_end").agg(F.max_by("b_value", "b__line").alias("value"))
    return last.select(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), "value")


def parse_window_stats(lines: DataFrame) -> DataFrame:
    f = _split(lines)
    names = ("l_win", "fc_fnr", "p_fnr", "fc_fpr", "p_fpr", "sensitivity")
    return f.select(_int(0).cast("int").alias(names[0]), *(_at(k).cast("double").alias(n) for k, n in enumerate(names) if k))
