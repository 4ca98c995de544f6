"""The other commands as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.chunked import settled, tidied
from ..operators.intervals import merge
from ..operators.multiscale import median_tracks, scales
from ..operators.overlap import overlap_join
from ..operators.reads import pileup
from ..sources.sinks import wav_bytes
from .params import CallParams
from .peaks import scale_regions, signals


@tidied
def decomposition_tracks(reads: DataFrame, params: CallParams, mappability: DataFrame | None = None) -> DataFrame:
    """(chrom, scale, start, end, value): the median track of each scale over the smoothed chip profile, as bedGraph rows."""
    chip = settled(pileup(reads.filter("sample = 'chip'"), params.fragment, keys=("chrom",)))
    ends = P.lengths(chip)
    smooth = chip if mappability is None else P.mappable_median(chip, mappability, ends, params.mappability_window, params.mappability_limit)
    tracks = median_tracks(smooth, ends, scales(params.scale_start, params.scale_end, params.scale_step))
    return tracks.withColumn("start", F.col("start") - 1)


@tidied
def log_ratio_signal(reads: DataFrame, params: CallParams) -> DataFrame:
    return P.log_ratio(*signals(reads, params))


@tidied
def scale_spectrum(reads: DataFrame, params: CallParams, chrom: str | None = None) -> DataFrame:
    """(scale_index, scale, n_regions, coverage): merged regions of all scales by the largest scale whose regions overlap them, on one
    chromosome, the first unless one is given."""
    chip, control = signals(reads, params)
    name = chrom or chip.agg(F.min("chrom")).first()[0]
    only = lambda p: p.filter(F.col("chrom") == name)
    found = settled(scale_regions(only(chip), only(control), params))
    at = scales(params.scale_start / params.bin_width, params.scale_end / params.bin_width, params.scale_step)
    spectrum = found.sparkSession.createDataFrame([(k, s * params.bin_width) for k, s in enumerate(at)], "scale_index int, scale double")
    met = overlap_join(merge(found.select("chrom", "start", "end"), 0), found.select("chrom", "start", "end", "scale"))
    largest = met.groupBy("a_chrom", "a_start", "a_end").agg(F.max("b_scale").alias("scale"))
    sums = largest.groupBy("scale").agg(F.count("*").alias("n_regions"), F.sum(F.col("a_end") - F.col("a_start") + 1).alias("coverage"))
    rows = spectrum.join(F.broadcast(sums), F.abs(spectrum["scale"] - sums["scale"]) < 1e-6, "left").drop(sums["scale"])
    return rows.select("scale_index", "scale", F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.coalesce("coverage", F.lit(0)).alias("coverage"))


def multimappability(reads: DataFrame, read_length: int) -> DataFrame:
    """Quantised depth of re-mapped genome fragments."""
    return P.mappability_quantised(pileup(reads, keys=("chrom",)), read_length)


def sonified(tracks: DataFrame, chrom: str, start: int, end: int) -> bytes:
    """A stretch of the scale tracks as sound. The stretch is what the caller asks to hear."""
    import numpy as np

    part = tracks.filter((F.col("chrom") == chrom) & (F.col("end") >= start) & (F.col("start") <= end)).collect()
    out: dict[float, np.ndarray] = {}
    for r in part:
        x = out.setdefault(r["scale"], np.zeros(end - start + 1))
        x[max(0, r["start"] - start) : r["end"] - start + 1] = r["value"]
    return wav_bytes(list(out.values()))
