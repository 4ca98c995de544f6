"""Text forms of regions, profiles and statistics as a column `value`; write() puts them out."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import from_internal

LN10 = math.log(10)


def write(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def _tabbed(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)).alias("value")


def bed_lines(regions: DataFrame) -> DataFrame:
    """BED6 for regions on a strand (name `.` if null), else BED3; starts become 0-based."""
    start = from_internal(F.col("start"), "bed")
    six = _tabbed("chrom", start, "end", F.coalesce("name", F.lit(".")), F.coalesce("score", F.lit(0)), "strand")
    return regions.select(F.when(F.col("strand").isin("+", "-"), six).otherwise(_tabbed("chrom", start, "end")).alias("value"))


def bed_p_lines(regions: DataFrame) -> DataFrame:
    """SSER form: untranslated starts, log10 p as the score."""
    return regions.select(_tabbed("chrom", "start", "end", F.lit("."), F.col("log_p") / LN10, F.coalesce("strand", F.lit("+"))))


def bed_q_lines(regions: DataFrame) -> DataFrame:
    """Untranslated starts, natural log q as the score."""
    return regions.select(_tabbed("chrom", "start", "end", F.lit("."), "log_q", F.coalesce("strand", F.lit("+"))))


def fold_change(chip: Column, control: Column) -> Column:
    return chip / (control + 1)


def er_lines(regions: DataFrame) -> DataFrame:
    """chrom start end . log10-q strand summit trough fold-change, untranslated."""
    return regions.select(_tabbed("chrom", "start", "end", F.lit("."), F.col("log_q") / LN10, F.coalesce("strand", F.lit("+")), "summit", "trough", fold_change(F.col("chip_mass"), F.col("control_mass"))))


def broadpeak_lines(regions: DataFrame) -> DataFrame:
    fc = F.floor(fold_change(F.col("chip_mass"), F.col("control_mass")))
    return regions.select(_tabbed("chrom", "start", "end", F.lit("."), F.lit(0), F.lit("."), fc, F.col("log_p") / LN10, F.col("log_q") / LN10))


def interval_lines(regions: DataFrame) -> DataFrame:
    """name chrom strand start end n starts ends; nameless regions are numbered by their place on their chromosome."""
    from ..operators.intervals import numbered

    named = numbered(regions)
    name = F.coalesce("name", F.concat(F.lit("Interval_"), F.col("chrom"), F.lit("_"), F.col("number").cast("string")))
    joined = lambda f: F.array_join(F.transform("intervals", f), ",")
    return named.select(_tabbed(name, "chrom", "strand", F.col("start") - 1, "end", F.size("intervals"), joined(lambda x: (x["start"] - 1).cast("string")), joined(lambda x: x["end"].cast("string"))))


def gff_lines(regions: DataFrame, source: str = "terrane", parent: str = "region", child: str = "interval") -> DataFrame:
    """A parent line for each region and a line for each of its intervals, 1-based."""
    name = F.coalesce("name", F.concat_ws("_", "chrom", "start", "end"))
    line = lambda kind, s, e, tag: F.concat_ws("\t", F.col("chrom"), F.lit(source), F.lit(kind), s.cast("string"), e.cast("string"), F.lit("."), F.coalesce("strand", F.lit(".")), F.lit("."), F.concat(F.lit(tag), name))
    children = F.transform("intervals", lambda x: line(child, x["start"], x["end"], "Parent="))
    return regions.select(F.explode(F.concat(F.array(line(parent, F.col("start"), F.col("end"), "ID=")), children)).alias("value"))


def bedgraph_lines(rows: DataFrame) -> DataFrame:
    return rows.select(_tabbed("chrom", "start", "end", "value"))


def statistics_lines(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.format_string(f"%.{digits}f", F.col(c)) if t == "double" else F.col(c).cast("string") for c, t in df.dtypes]
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def lines_sampled(lines: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n lines drawn by a seeded hash of a line and its number among equal ones, whatever the partitioning."""
    numbered = lines.groupBy("value").agg(F.count("*").alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return numbered.orderBy(F.xxhash64("value", "_i", F.lit(seed)), "value").limit(n).select("value")


def wav_bytes(tracks: list[np.ndarray], rate: int = 44_100) -> bytes:
    """The sum of tracks as mono 16-bit sound, loudness compressed by a root."""
    total = np.sum(tracks, axis=0) if tracks else np.zeros(0)
    peak = max(float(np.abs(total).max(initial=0.0)), 1e-12)
    shaped = np.sign(total) * np.sqrt(np.abs(total) / peak)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((shaped * 32_000).astype("<i2").tobytes())
    return out.getvalue()
