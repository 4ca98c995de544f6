"""Signal profiles as runs (chrom, start, end, value), 1-based and inclusive; positions without a run are 0."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunked import CHUNK, islands, neighbours, ranked, running

def span() -> Column:
    return F.col("end") - F.col("start") + 1


#: Positions of one dense stretch that a kernel holds, besides its margins; four times the margin where that is more.
DENSE = 1 << 16


def lengths(profile: DataFrame) -> DataFrame:
    """(chrom, l): the last position of each chromosome's runs."""
    return profile.groupBy("chrom").agg(F.max("end").cast("long").alias("l"))


def compact(profile: DataFrame, keys: tuple[str, ...] = ("chrom",), chunk: int = CHUNK) -> DataFrame:
    """Adjacent runs of equal value as one."""
    keys = list(keys)
    near = neighbours(profile, keys, ["start"], ["end", "value"], chunk=chunk, following=False)
    fresh = F.col("prev_end").isNull() | (F.col("prev_end") + 1 != F.col("start")) | (F.col("prev_value") != F.col("value"))
    return islands(near, keys, ["start"], fresh, chunk=chunk).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("island")


def filled(profile: DataFrame, ends: DataFrame, keys: tuple[str, ...] = ("chrom",), first: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Runs over every position from `first` to each chromosome's l, gaps as runs of 0."""
    keys = list(keys)
    edge = ends.select(*keys, (F.col("l") + 1).alias("start"), F.col("l").alias("end"), F.lit(0.0).alias("value"))
    near = neighbours(profile.select(*keys, "start", "end", "value").unionByName(edge), keys, ["start"], ["end"], chunk=chunk, following=False)
    gap = F.struct((F.coalesce("prev_end", F.lit(first - 1)) + 1).alias("s"), (F.col("start") - 1).alias("e"), F.lit(0.0).alias("v"))
    own = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("value").alias("v"))
    return near.select(*keys, F.explode(F.array(gap, own)).alias("x")).filter("x.s <= x.e").select(*keys, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.v").alias("value"))


def positions(profile: DataFrame) -> DataFrame:
    """One row per position; for small results only."""
    return profile.withColumn("pos", F.explode(F.sequence("start", "end"))).drop("start", "end")


def runs_of(signal: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs of a table of positions (chrom, pos, value)."""
    return compact(signal.select("chrom", F.col("pos").cast("long").alias("start"), F.col("pos").cast("long").alias("end"), "value"), chunk=chunk)


def aligned(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chrom",), chunk: int = CHUNK) -> DataFrame:
    """Stretches on which both profiles are constant: (start, end, a, b), 0 where one has no run; a running sum of value steps, no join."""
    def steps(p: DataFrame, is_a: bool) -> DataFrame:
        e = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("value").alias("d"), F.lit(1).alias("n")), F.struct((F.col("end") + 1).alias("pos"), (-F.col("value")).alias("d"), F.lit(-1).alias("n"))))
        x = p.select(*keys, e.alias("_e"))
        own, none = [F.col("_e.d"), F.col("_e.n")], [F.lit(0.0), F.lit(0)]
        pick = (own, none) if is_a else (none, own)
        return x.select(*keys, "_e.pos", pick[0][0].alias("da"), pick[0][1].alias("na"), pick[1][0].alias("db"), pick[1][1].alias("nb"))

    keys = list(keys)
    both = steps(a, True).unionByName(steps(b, False)).groupBy(*keys, "pos").agg(*(F.sum(c).alias(c) for c in ("da", "na", "db", "nb")))
    for c in ("da", "na", "db", "nb"):
        both = running(both, keys, ["pos"], F.col(c), "sum", f"s{c}", chunk=chunk)
    runs = neighbours(both, keys, ["pos"], ["pos"], chunk=chunk, previous=False).filter("next_pos is not null and (sna > 0 or snb > 0)")
    exact = lambda n, v: F.when(F.col(n) > 0, F.col(v)).otherwise(F.lit(0.0))
    return runs.select(*keys, F.col("pos").alias("start"), (F.col("next_pos") - 1).alias("end"), exact("sna", "sda").alias("a"), exact("snb", "sdb").alias("b"))


def scaled(profile: DataFrame, by: Column | float) -> DataFrame:
    return profile.withColumn("value", F.col("value") * by)


def shifted(profile: DataFrame, by: int) -> DataFrame:
    return profile.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def circularly_shifted(profile: DataFrame, by: int, ends: DataFrame) -> DataFrame:
    """Every position moved on by `by`, behind the end to the front."""
    x = profile.join(ends, "chrom").withColumns({"s": F.pmod(F.col("start") - 1 + by, F.col("l")) + 1, "n": span()})
    parts = F.array(F.struct(F.col("s").alias("a"), F.least(F.col("s") + F.col("n") - 1, F.col("l")).alias("b")), F.struct(F.lit(1).cast("long").alias("a"), (F.col("s") + F.col("n") - 1 - F.col("l")).alias("b")))
    return x.withColumn("p", F.explode(parts)).filter("p.a <= p.b").select("chrom", F.col("p.a").alias("start"), F.col("p.b").alias("end"), "value")


def permuted_blocks(profile: DataFrame, width: int, ends: DataFrame, key: str) -> DataFrame:
    """The profile with its full blocks of `width` positions in another order; what is behind the last one stays.

    The order is that of md5("key:chrom:block") among a chromosome's blocks, a bijection that the key alone decides. Runs are cut at
    the edges of blocks; only block numbers, one row a block, go through an order along the chromosome.
    """
    full = ends.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("l") / width) - 1)).alias("_block")).filter("_block >= 0")
    place = F.row_number().over(Window.partitionBy("chrom").orderBy(F.md5(F.concat_ws(":", F.lit(key), "chrom", F.col("_block").cast("string")).cast("binary")))) - 1
    to = full.withColumn("_to", place.cast("long"))
    block = lambda c: F.floor((F.col(c) - 1) / width)
    cut = profile.select("chrom", "start", "end", "value", F.explode(F.sequence(block("start"), block("end"))).alias("_block"))
    cut = cut.withColumns({"start": F.greatest("start", F.col("_block") * width + 1), "end": F.least("end", (F.col("_block") + 1) * width)})
    by = (F.coalesce("_to", "_block") - F.col("_block")) * width
    return cut.join(to, ["chrom", "_block"], "left").select("chrom", (F.col("start") + by).alias("start"), (F.col("end") + by).alias("end"), "value")


def binned(profile: DataFrame, width: int, ends: DataFrame | None = None) -> DataFrame:
    """(chrom, bin, value): sums over full bins of `width` positions; the rest of a chromosome is dropped."""
    full = (ends or lengths(profile)).select("chrom", F.floor(F.col("l") / width).alias("n"))
    cut = profile.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("end") - 1) / width))))
    part = F.least("end", (F.col("bin") + 1) * width) - F.greatest("start", F.col("bin") * width + 1) + 1
    return cut.groupBy("chrom", "bin").agg(F.sum(F.col("value") * part).alias("value")).join(F.broadcast(full), "chrom").filter("bin < n").select("chrom", F.col("bin").cast("long").alias("bin"), "value")


def window_sums(profile: DataFrame, width: int, used: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(keys, win, mass): sums over the first `used` positions of the windows that start at win * width + 1."""
    cut = profile.withColumn("win", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("end") - 1) / width))))
    low, high = F.greatest("start", F.col("win") * width + 1), F.least("end", F.col("win") * width + used)
    return cut.filter(low <= high).groupBy(*keys, "win").agg(F.sum(F.col("value") * (high - low + 1)).alias("mass"))


def paired_windows(a: DataFrame, b: DataFrame, width: int = 10_000) -> DataFrame:
    """Window sums of both profiles where both are above 0. Windows leave out their last position; the shorter profile's last position is left out too."""
    both = lengths(a).withColumnRenamed("l", "la").join(lengths(b).withColumnRenamed("l", "lb"), "chrom").select("chrom", F.least("la", "lb").alias("l"))
    clip = lambda p: p.join(F.broadcast(both), "chrom").filter("start < l").withColumn("end", F.least("end", F.col("l") - 1)).drop("l")
    wins = lambda p, n: window_sums(clip(p), width, width - 1).withColumnRenamed("mass", n)
    return wins(a, "x").join(wins(b, "y"), ["chrom", "win"]).join(F.broadcast(both), "chrom").filter((F.col("win") < F.floor(F.col("l") / width)) & (F.col("x") > 0) & (F.col("y") > 0)).drop("l")


def slope_through_origin(x: Column, y: Column) -> Column:
    xy, xx = F.sum(x * y), F.sum(x * x)
    return F.when((xy == 0) | (xx == 0) | xx.isNull(), F.lit(1.0)).otherwise(xy / xx)


def slope_with_offset(x: Column, y: Column) -> Column:
    n = F.count(x)
    up, down = n * F.sum(x * y) - F.sum(x) * F.sum(y), n * F.sum(x * x) - F.sum(x) * F.sum(x)
    return F.when((up == 0) | (down == 0) | down.isNull(), F.lit(1.0)).otherwise(up / down)


def scaling_factors(chip: DataFrame, control: DataFrame, width: int = 10_000) -> DataFrame:
    """(chrom, slope1, slope2, total_ratio, pearson): chip against control; slope1 is what control is multiplied by."""
    wins = paired_windows(chip, control, width)
    x, y = F.col("y"), F.col("x")
    fits = wins.groupBy("chrom").agg(slope_through_origin(x, y).alias("slope1"), slope_with_offset(x, y).alias("slope2"), F.when((F.count("*") > 1) & (F.var_pop("x") > 0) & (F.var_pop("y") > 0), F.corr("x", "y")).alias("pearson"))
    total = lambda p, n: p.groupBy("chrom").agg(F.sum(F.col("value") * span()).alias(n))
    ratio = total(chip, "tx").join(total(control, "ty"), "chrom").select("chrom", (F.col("tx") / F.nullif(F.col("ty"), F.lit(0.0))).alias("total_ratio"))
    return ratio.join(fits, "chrom", "left").select("chrom", F.coalesce("slope1", F.lit(1.0)).alias("slope1"), F.coalesce("slope2", F.lit(1.0)).alias("slope2"), "total_ratio", "pearson")


def log_ratio(chip: DataFrame, control: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ln(chip / control) where both are above 0, else 0; over the positions both profiles have."""
    both = lengths(chip).join(lengths(control).withColumnRenamed("l", "m"), "chrom").select("chrom", F.least("l", "m").alias("l"))
    runs = aligned(chip, control, chunk=chunk).join(F.broadcast(both), "chrom").filter("start <= l").withColumn("end", F.least("end", "l"))
    value = F.when((F.col("a") > 0) & (F.col("b") > 0), F.ln(F.when(F.col("a") > 0, F.col("a")).otherwise(1.0) / F.when(F.col("b") > 0, F.col("b")).otherwise(1.0))).otherwise(F.lit(0.0))
    return runs.select("chrom", "start", "end", value.alias("value"))


def mappability_quantised(depth: DataFrame, read_length: int) -> DataFrame:
    return depth.withColumn("value", F.least(F.lit(255), F.ceil(F.col("value") * 100 / (2 * read_length))).cast("int"))


def mappability_stats(profile: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(chrom, n_unique, fraction): positions with a value within 0.005 of 1."""
    unique = profile.groupBy("chrom").agg(F.sum(F.when((F.col("value") > 0.995) & (F.col("value") < 1.005), span()).otherwise(0)).cast("long").alias("n_unique"))
    return unique.join(ends or lengths(profile), "chrom").select("chrom", "n_unique", (F.col("n_unique") / F.col("l")).alias("fraction"))


def extremes(profile: DataFrame, bound: float = 1e6) -> DataFrame:
    return profile.groupBy("chrom").agg(F.least(F.min("value"), F.lit(bound)).alias("least"), F.greatest(F.max("value"), F.lit(-bound)).alias("most"))


def quantised(profile: DataFrame, thresholds: list[float]) -> DataFrame:
    """The largest threshold at or below each value; a value below all of them is an error."""
    out = F.raise_error(F.concat(F.lit("no threshold at or below "), F.col("value").cast("string"))).cast("double")
    for t in sorted(thresholds):
        out = F.when(F.col("value") >= t, F.lit(float(t))).otherwise(out)
    return profile.withColumn("value", out)


def jointly_pruned(tracks: DataFrame, limits: dict[str, float], chunk: int = CHUNK) -> DataFrame:
    """Positions (chrom, pos, one column per track) where any track exceeds its limit, numbered anew; a limit of -1000 or less is none."""
    keep = reduce(lambda a, b: a | b, [F.col(c) > t for c, t in limits.items() if t > -1000], F.lit(False))
    return ranked(tracks.filter(keep), ["chrom"], ["pos"], "new_pos", chunk=chunk)


def sliced(profile: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """A stretch of a chromosome, numbered from 1."""
    part = profile.filter((F.col("chrom") == chrom) & (F.col("end") >= start) & (F.col("start") <= end))
    return part.withColumns({"start": F.greatest("start", F.lit(start)) - start + 1, "end": F.least("end", F.lit(end)) - start + 1})


def without_regions(profile: DataFrame, regions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What regions don't cover, closed up: positions move left by the covered positions before them."""
    from .intervals import merge, subtract

    holes = merge(regions.select("chrom", "start", "end"), 1)
    left = subtract(profile, holes)
    marks = left.select("chrom", "start", "end", "value", F.lit(0).cast("long").alias("_h")).unionByName(holes.select("chrom", "start", "end", F.lit(0.0).alias("value"), span().cast("long").alias("_h")))
    moved = running(marks, ["chrom"], ["start"], F.col("_h"), "sum", "_gone", chunk=chunk).filter("_h = 0")
    return compact(moved.select("chrom", (F.col("start") - F.col("_gone")).alias("start"), (F.col("end") - F.col("_gone")).alias("end"), "value"), chunk=chunk)


def log_plus_one(profile: DataFrame, base: float) -> DataFrame:
    return profile.withColumn("value", F.log1p("value") / F.ln(F.lit(base)))


def floored(profile: DataFrame) -> DataFrame:
    return profile.withColumn("value", F.floor("value").cast("double"))


def threshold_regions(profile: DataFrame, thresholds: list[int], ends: DataFrame, valleys: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(threshold, chrom, start, end): longest stretches with value >= threshold, or <= for valleys. One still open at a chromosome's end isn't there."""
    whole = filled(profile, ends, chunk=chunk) if valleys or min(thresholds) <= 0 else profile
    tried = whole.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    inside = tried.filter(F.col("value") <= F.col("threshold") if valleys else F.col("value") >= F.col("threshold")).withColumn("value", F.lit(0.0))
    joined = compact(inside.select("chrom", "threshold", "start", "end", "value"), ("chrom", "threshold"), chunk)
    return joined.join(F.broadcast(ends), "chrom").filter("end < l").select("threshold", "chrom", "start", "end")


def summed(tracks: list[DataFrame], chunk: int = CHUNK) -> DataFrame:
    """Sum of profiles, position by position."""
    return reduce(lambda x, y: aligned(x, y, chunk=chunk).select("chrom", "start", "end", (F.col("a") + F.col("b")).alias("value")), tracks)


def symmetry_origin(signal: DataFrame, reach: int, tolerance: float = 1e-5) -> DataFrame:
    """(chrom, pos): the first place of (chrom, pos, value), `reach` away from 0 and the last position, whose neighbours at every distance
    below `reach` mirror each other."""
    ends = signal.groupBy("chrom").agg(F.max("pos").alias("_l"))
    far = signal.select("chrom", F.col("pos").alias("p"), F.col("value").alias("v"))
    right = signal.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(reach - 1)))).withColumns({"l": F.col("pos") - F.col("i"), "r": F.col("pos") + F.col("i")})
    pairs = right.join(far.withColumnsRenamed({"p": "l", "v": "vl"}), ["chrom", "l"]).join(far.withColumnsRenamed({"p": "r", "v": "vr"}), ["chrom", "r"])
    good = pairs.groupBy("chrom", "pos").agg(F.count_if(F.abs(F.col("vl") - F.col("vr")) <= tolerance).alias("n")).filter(F.col("n") == reach).join(F.broadcast(ends), "chrom").filter((F.col("pos") >= reach) & (F.col("pos") < F.col("_l") - reach))
    return good.groupBy("chrom").agg(F.min("pos").alias("pos"))


def bedgraph(profile: DataFrame, ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs as bedGraph rows (0-based starts), zeros and the last run included."""
    runs = compact(filled(profile, ends, chunk=chunk), chunk=chunk)
    return runs.select("chrom", (F.col("start") - 1).alias("start"), "end", "value")


# Dense kernels: sliding windows over stretches of bounded length with margins.


def sliding_mean(x: np.ndarray, half: int) -> np.ndarray:
    """Mean over [i - half, i + half], cut at the array's ends."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    low, high = np.maximum(np.arange(len(x)) - half, 0), np.minimum(np.arange(len(x)) + half + 1, len(x))
    return (total[high] - total[low]) / (high - low)


def sliding_median(x: np.ndarray, half: int, skip: float | None = None) -> np.ndarray:
    """Upper median of the whole parts over [i - half, i + half], cut at the ends; `skip` is left out, nothing left gives 0.

    All windows are answered together, bit by bit of the median's place among the distinct values (a wavelet matrix), so the work grows
    with the logarithm of their number.
    """
    values = np.trunc(x).astype(np.int64)
    counted = np.ones(len(x), bool) if skip is None else values != int(skip)
    place = np.concatenate(([0], np.cumsum(counted)))
    at = np.arange(len(x))
    low, high = place[np.maximum(at - half, 0)], place[np.minimum(at + half + 1, len(x))]
    filled = high > low
    if not filled.any():
        return np.zeros(len(x))
    levels, codes = np.unique(values[counted], return_inverse=True)
    nth, found = (high - low) // 2, np.zeros(len(x), np.int64)
    for b in reversed(range((len(levels) - 1).bit_length())):
        bit = (codes >> b & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~bit)))
        below_low, below_high = zeros[low], zeros[high]
        less = below_high - below_low
        upper = nth >= less
        nth = np.where(upper, nth - less, nth)
        found = found << 1 | upper
        low, high = np.where(upper, zeros[-1] + low - below_low, below_low), np.where(upper, zeros[-1] + high - below_high, below_high)
        codes = np.concatenate((codes[~bit], codes[bit]))
    return np.where(filled, levels[np.where(filled, found, 0)], 0).astype(float)


def _dense(batch_runs: list[dict], start: int, n: int, name: str = "v") -> np.ndarray:
    x = np.zeros(n)
    for r in batch_runs:
        a, b = max(r["s"] - start, 0), min(r["e"] - start + 1, n)
        if a < b:
            x[a:b] = r[name]
    return x


def dense_kernel(profile: DataFrame, ends: DataFrame, margin: int, kernels: dict[float, object], size: int = DENSE, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """(chrom, scale, start, end, value): each kernel f(first column, ..., in stretches of `size` positions with margins).

    A run goes to the stretches it touches, so no task holds more than size + 2 * margin positions of a chromosome at once, and margins
    are a half of what it computes at most.
    """
    size = max(size, 4 * margin)
    n_cells = F.sequence(F.floor((F.greatest(F.col("start") - margin, F.lit(1)) - 1) / size), F.floor((F.col("end") + margin - 1) / size))
    cut = profile.withColumn("cell", F.explode(n_cells))
    every = ends.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("l") - 1) / size)))).filter("l >= 1")
    held = cut.groupBy("chrom", "cell").agg(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), *[F.col(c).cast("double").alias(c) for c in columns])).alias("runs"))
    rows = every.join(held, ["chrom", "cell"], "left").select("chrom", "cell", "l", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chrom, cell, l, runs = (c[row].as_py() for c in batch.columns)
                first, last = cell * size + 1, min((cell + 1) * size, l)
                low, high = max(1, first - margin), min(l, last + margin)
                x = [_dense(runs or [], low, high - low + 1, c) for c in columns]
                for scale, f in kernels.items():
                    y = f(*x)[first - low : last - low + 1]
                    cuts = np.flatnonzero(np.diff(y)) + 1
                    s, e = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(y)]))
                    k = len(s)
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * k, pa.string()), pa.array([float(scale)] * k), pa.array(s + first, pa.int64()), pa.array(e + first - 1, pa.int64()), pa.array(y[s], pa.float64())], names=["chrom", "scale", "start", "end", "value"])

    return rows.mapInArrow(run, "chrom string, scale double, start long, end long, value double")


def mean_filtered(profile: DataFrame, ends: DataFrame, window: int) -> DataFrame:
    return dense_kernel(profile, ends, window // 2, {window: lambda x: sliding_mean(x, window // 2)}).drop("scale")


def median_filtered(profile: DataFrame, ends: DataFrame, window: int, skip: float | None = None, chunk: int = CHUNK) -> DataFrame:
    return compact(dense_kernel(profile, ends, window // 2, {window: lambda x: sliding_median(x, window // 2, skip)}).drop("scale"), chunk=chunk)


def mappable_median(profile: DataFrame, mappability: DataFrame, ends: DataFrame, window: int, most: float, chunk: int = CHUNK) -> DataFrame:
    """Each value or, if greater, the median of the positions around it whose mappability is at most `most`. Positions from mappability's
    last one on count as mappable."""
    known = mappability.join(F.broadcast(lengths(mappability)), "chrom").withColumn("end", F.least("end", F.col("l") - 1)).filter("start <= end").drop("l")
    both = aligned(profile, known, chunk=chunk)
    half = window // 2
    kernel = lambda x, m: np.maximum(sliding_median(np.where(m > most, -1, x), half, -1), x)
    return compact(dense_kernel(both, ends, half, {window: kernel}, columns=("a", "b")).drop("scale"), chunk=chunk)
