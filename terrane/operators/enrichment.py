"""Significance of regions: masses of chip against control in the five ways the p-value is formed, and window statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import binomial_log_p, binomial_log_tail, poisson_threshold
from .chunked import settled, tidied
from .overlap import overlap_join
from .profile import lengths, window_sums
from .stretches import CELLS, Tails, by_length, by_stretch, greatest, upto

RUNS = "array<struct<s:bigint,e:bigint,v:double>>"
WINDOW = 1_000_000


#: Positions of a block of the cumulative profile. Sums begin anew in each, which keeps them exact and tasks small.
BLOCK = 1 << 16


def _cumulative(points: DataFrame, profiles: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """points (chrom, at), distinct, with each profile's sum up to `at` in its block (p_<name>) and in the blocks before (c_<name>).

    A run is a step up at its start and one down behind its end, in every block that it reaches; with A the sum of the steps so far and B that of
    steps times places, the sum up to place x is (x + 1) A - B. A block holds at most its positions' steps and points, so no task grows with the
    depth or with the number of regions. Only one row a block goes through the order along a chromosome.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    names = [name for name, _, _ in profiles]
    rows = points.select("chrom", block("at").alias("_block"), F.pmod("at", F.lit(BLOCK)).cast("long").alias("_x"), F.lit(True).alias("_asked"), *(F.lit(0.0).alias(f"d_{n}") for n in names))
    for name, profile, floored in profiles:
        value = F.floor("value").cast("double") if floored else F.col("value").cast("double")
        cut = profile.filter("start <= end").select("chrom", "start", "end", value.alias("v"), F.explode(F.sequence(block("start"), block("end"))).alias("_block"))
        origin = F.col("_block") * BLOCK
        low, behind = F.greatest(F.col("start") - origin, F.lit(0)), F.least(F.col("end") - origin, F.lit(BLOCK - 1)) + 1
        steps = cut.select("chrom", "_block", F.explode(F.array(F.struct(low.cast("long").alias("_x"), F.col("v").alias("d")), F.struct(behind.cast("long").alias("_x"), (-F.col("v")).alias("d")))).alias("s"))
        steps = steps.groupBy("chrom", "_block", "s._x").agg(F.sum("s.d").alias("d"))
        rows = rows.unionByName(steps.select("chrom", "_block", "_x", F.lit(False).alias("_asked"), *(F.col("d").alias(f"d_{n}") if n == name else F.lit(0.0).alias(f"d_{n}") for n in names)))
    order = Window.partitionBy("chrom", "_block").orderBy("_x", "_asked")
    along = order.rowsBetween(Window.unboundedPreceding, 0)
    steps_sum, places_sum = (lambda n: F.sum(f"d_{n}").over(along)), (lambda n: F.sum(F.col(f"d_{n}") * F.col("_x")).over(along))
    told = rows.select("chrom", "_block", "_x", "_asked", F.lead("_x").over(order).isNull().alias("_last"), *(x for n in names for x in ((((F.col("_x") + 1) * steps_sum(n) - places_sum(n)).alias(f"p_{n}")), (BLOCK * steps_sum(n) - places_sum(n)).alias(f"t_{n}"))))
    told = settled(told.filter("_asked or _last"), "cumulative")
    before = Window.partitionBy("chrom").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = told.filter("_last").select("chrom", "_block", *(F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0.0)).alias(f"c_{n}") for n in names))
    return told.filter("_asked").join(blocks, ["chrom", "_block"]).select("chrom", (F.col("_block") * BLOCK + F.col("_x")).alias("at"), *(f"{k}_{n}" for n in names for k in "pc"))


def range_sums(regions: DataFrame, profiles: list[tuple[str, DataFrame, bool]], skip_first: bool = False) -> DataFrame:
    """Regions with a column for each (name, profile, floored): the profile's sum over each region, of whole parts if `floored`.

    A sum is the difference of two values of a cumulative profile, whose ends are looked up in one ordered pass over runs and ends; no run
    meets a region. What is shuffled follows regions and runs, however many runs a region has. `skip_first` leaves out a region's first position.
    """
    low, high = F.col("start") - (0 if skip_first else 1), F.col("end")
    points = regions.select("chrom", F.explode(F.array(low.cast("long"), high.cast("long"))).alias("at")).distinct()
    sums = _cumulative(points, profiles)
    left, right = (sums.select(F.col("chrom").alias(f"_{e}chrom"), F.col("at").alias(f"_{e}"), *(F.col(f"{k}_{n}").alias(f"_{e}{k}_{n}") for n, _, _ in profiles for k in "pc")) for e in ("a", "b"))
    met = regions.join(left, (F.col("chrom") == F.col("_achrom")) & (low == F.col("_a")), "left").join(right, (F.col("chrom") == F.col("_bchrom")) & (high == F.col("_b")), "left")
    mass = lambda n: F.when(high > low, (F.col(f"_bp_{n}") - F.col(f"_ap_{n}")) + (F.col(f"_bc_{n}") - F.col(f"_ac_{n}"))).otherwise(0.0)
    kept = [c for c in regions.columns if c not in {n for n, _, _ in profiles}]
    return met.select(*kept, *(F.coalesce(mass(n), F.lit(0.0)).alias(n) for n, _, _ in profiles))


def masses(regions: DataFrame, profile: DataFrame, name: str, floored: bool = True, skip_first: bool = False) -> DataFrame:
    """Regions with the column `name`: the profile's sum over each, of whole parts if `floored`."""
    return range_sums(regions, [(name, profile, floored)], skip_first)


def mass_log_p(signal: Column, control: Column, length: Column, fragment: float, norm: int | Column | None = None, flip: float = 0.5) -> Column:
    """Log p of masses. With `norm`, longer regions are scaled to that length, a control below 1 becomes 1 and a signal below 1 gives 0."""
    s, c = signal / fragment, control / fragment
    if norm is None:
        return binomial_log_p(s, c, flip)
    norm = norm if isinstance(norm, Column) else F.lit(norm)
    by = F.when(length > norm, length / norm.cast("double")).otherwise(F.lit(1.0))
    s, c = s / by, c / by
    c = F.when((length > norm) & (F.floor(c) == 0), F.lit(1.0)).otherwise(c)
    return F.when((length > norm) & (F.floor(s) == 0), F.lit(0.0)).otherwise(binomial_log_p(s, c, flip))


def region_p_values(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, norm: int | None = None, flip: float = 0.5, floor_control: bool = False) -> DataFrame:
    """Regions with signal, control and log_p. floor_control and flip give the modified variant."""
    both = range_sums(regions, [("signal", chip, True), ("control", control, floor_control)])
    return both.withColumn("log_p", mass_log_p(F.col("signal"), F.col("control"), F.col("end") - F.col("start") + 1, fragment, norm, flip))


def with_runs(regions: DataFrame, profile: DataFrame, name: str, pad: Column | int = 0) -> DataFrame:
    """Regions (distinct on chrom, start, end) with the profile's runs in `pad` positions around as an array column."""
    wide = regions.select("chrom", F.col("start").alias("s0"), F.col("end").alias("e0")).distinct()
    wide = wide.withColumns({"start": F.greatest(F.col("s0") - pad, F.lit(1)).cast("long"), "end": (F.col("e0") + pad).cast("long")})
    runs = overlap_join(wide, profile.select("chrom", "start", "end", "value")).groupBy("a_chrom", "a_s0", "a_e0").agg(F.collect_list(F.struct(F.col("b_start").cast("long").alias("s"), F.col("b_end").cast("long").alias("e"), F.col("b_value").cast("double").alias("v"))).alias(name))
    runs = runs.withColumnsRenamed({"a_chrom": "chrom", "a_s0": "start", "a_e0": "end"})
    return regions.join(runs, ["chrom", "start", "end"], "left").withColumn(name, F.coalesce(name, F.array().cast(RUNS)))


def spread(runs: list[dict], start: int, end: int) -> np.ndarray:
    """Values at the positions from start to end."""
    x = np.zeros(max(0, end - start + 1))
    for r in runs:
        if r["s"] <= end and r["e"] >= start:
            x[max(r["s"] - start, 0) : r["e"] - start + 1] = r["v"]
    return x


def per_region(rows: DataFrame, f, added: dict[str, pa.DataType], without: tuple[str, ...] = ()) -> DataFrame:
    """Apply f(row as dict) -> dict or None to each row; None drops it. The arrays of runs and the columns `without` go."""
    kept = [c for c, t in rows.dtypes if t != RUNS and c not in without]
    schema = rows.select(*kept).schema
    names = {pa.int64(): "long", pa.float64(): "double"}
    ddl = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema if x.name not in added) + "".join(f", `{n}` {names[t]}" for n, t in added.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, made = [], []
            for k, row in enumerate(batch.to_pylist()):
                out = f(row)
                if out is not None:
                    take.append(k)
                    made.append(out)
            rest = batch.take(pa.array(take, pa.int64()))
            fields = [(c, rest.column(c)) for c in kept if c not in added] + [(n, pa.array([m[n] for m in made], t)) for n, t in added.items()]
            yield pa.RecordBatch.from_arrays([v for _, v in fields], names=[n for n, _ in fields])

    return rows.mapInArrow(run, ddl)


def _log_p(signal: float, control: float) -> float:
    n = int(signal + control)
    return binomial_log_tail(math.floor(control), n)


def _slide(x: np.ndarray, start: int, width: int, end: int, origin: int) -> float:
    """Greatest sum of `width` positions that starts at `start` or up to where start + width reaches end; one slide at least."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    sums = lambda a: total[np.clip(a - origin + width, 0, len(x))] - total[np.clip(a - origin, 0, len(x))]
    last = max(start + 1, end - width)
    return float(sums(np.arange(start, last + 1)).max())


def peak_p_value(chip: np.ndarray, control: np.ndarray, start: int, end: int, origin: int, fragment: float, reach: int, l_control: int) -> float:
    """Max mode of a region no longer than the norm: its sum, and the greatest sum as wide as it in `reach` lengths around."""
    length, width = end - start + 1, end - start
    signal = float(np.floor(chip[start - origin : end - origin + 1]).sum())
    s, e = max(1, start - reach * length), min(l_control, end + reach * length)
    if s + width > l_control:
        return 0.0
    mass = _slide(control, s, width, e, origin)
    c, x = mass / fragment, signal / fragment
    c = 1.0 if math.floor(c) == 0 else c
    return 0.0 if math.floor(x) == 0 else _log_p(x, c)


def greatest_windows(ranges: DataFrame, profile: DataFrame, width: int, name: str, floored: bool) -> DataFrame:
    """Ranges (chrom, start, end), distinct, of first positions, with the profile's greatest sum over `width` positions from one of them on.

    From one first position to the next the sum changes by the depth behind the window less that at its first position. This slope changes
    only where a run begins or ends at one side of the window, so the sum is greatest there or at an end of the range. Sums at such places
    are found once for the whole profile; a range takes the greatest of those inside.
    """
    edges = F.explode(F.array(*(x.cast("long") for e in (F.col("start"), F.col("end") + 1) for x in (e, e - width))))
    turns = profile.filter("start <= end").select("chrom", edges.alias("start")).filter("start >= 1").distinct().withColumn("end", F.col("start") + width - 1)
    turns = range_sums(settled(turns, "turns"), [(name, profile, floored)]).withColumn("end", F.col("start"))
    inner = overlap_join(ranges.select("chrom", "start", "end"), turns).select(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col(f"b_{name}").alias(name))
    posts = ranges.select("chrom", F.col("start").alias("_from"), F.col("end").alias("_to"), F.explode(F.array_distinct(F.array("start", "end"))).alias("start")).withColumn("end", F.col("start") + width - 1)
    posts = range_sums(posts, [(name, profile, floored)]).select("chrom", F.col("_from").alias("start"), F.col("_to").alias("end"), name)
    return inner.unionByName(posts).groupBy("chrom", "start", "end").agg(F.max(name).alias(name))


def long_peaks(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, norm: int, reach: int) -> DataFrame:
    """Regions longer than norm with log_p in max mode: greatest sums of `norm` positions in the region and in `reach` lengths around."""
    length = F.col("end") - F.col("start") + 1
    spots = regions.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct().join(lengths(control), "chrom")
    low, high = F.greatest(F.lit(1), F.col("start") - reach * length), F.least(F.col("l"), F.col("end") + reach * length)
    spots = spots.withColumns({"_last": F.greatest(F.col("start") + 1, F.col("end") - norm), "_a": low.cast("long")}).withColumn("_b", F.greatest(F.col("_a") + 1, high - norm))
    spots = settled(spots, "spots")
    own = spots.select("chrom", "start", F.col("_last").alias("end")).distinct()
    around = spots.filter(F.col("_a") + norm <= F.col("l")).select("chrom", F.col("_a").alias("start"), F.col("_b").alias("end")).distinct()
    own = greatest_windows(own, chip, norm, "_x", True).withColumnsRenamed({"end": "_last"})
    around = greatest_windows(around, control, norm, "_c", False).withColumnsRenamed({"start": "_a", "end": "_b"})
    x, c = F.col("_x") / fragment, F.col("_c") / fragment
    log_p = F.when(F.col("_c").isNull() | (F.floor(x) == 0), F.lit(0.0)).otherwise(binomial_log_p(x, F.when(F.floor(c) == 0, F.lit(1.0)).otherwise(c)))
    scored = spots.join(own, ["chrom", "start", "_last"]).join(around, ["chrom", "_a", "_b"], "left").select("chrom", "start", "end", log_p.alias("log_p"))
    return regions.drop("log_p").join(scored, ["chrom", "start", "end"]).select(*[k for k in regions.columns if k != "log_p"], "log_p")


def mean_vicinity(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, norm: int, reach: int) -> DataFrame:
    """Regions with log_p in mean mode: control is the greatest sum of windows as long as the region (or 2 * norm around its middle, where it is
    no longer than norm) that step through `reach` lengths on either side and share their ends. Each window is a range sum."""
    length, mid = F.col("end") - F.col("start") + 1, F.floor((F.col("start") + F.col("end")) / 2)
    own = length > norm
    spots = regions.select("chrom", "start", "end").distinct().join(F.broadcast(lengths(control)), "chrom")
    first, last = F.when(own, F.col("start")).otherwise(mid - norm), F.when(own, F.col("end")).otherwise(mid + norm)
    spots = spots.withColumns({"_a": F.when(first < 0, F.lit(1)).otherwise(first), "_b": F.least(last, F.col("l"))}).withColumn("_w", F.col("_b") - F.col("_a")).filter("_w > 0")
    begins = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_a") - reach * F.col("_w")), F.least("l", F.col("_b") + reach * F.col("_w")) - 1, F.col("_w"))
    wins = spots.filter(F.greatest(F.lit(1), F.col("_a") - reach * F.col("_w")) < F.least("l", F.col("_b") + reach * F.col("_w"))).withColumn("_c", F.explode(begins))
    wins = settled(wins.select("chrom", F.col("start").alias("_s"), F.col("end").alias("_e"), "_w", F.col("_c").alias("start"), F.least("l", F.col("_c") + F.col("_w")).alias("end")))
    top = masses(wins, control, "_m", floored=False).groupBy("chrom", F.col("_s").alias("start"), F.col("_e").alias("end"), "_w").agg(F.max("_m").alias("_m"))
    scored = masses(regions, chip, "_x").join(top, ["chrom", "start", "end"], "left")
    by = F.when(own, length / F.lit(float(norm))).otherwise(F.lit(1.0))
    c, x = F.col("_m") * length / (F.col("_w") + 1) / fragment / by, F.col("_x") / fragment / by
    at_least = F.when(own & (F.floor(c) == 0), F.lit(1.0)).otherwise(c)
    log_p = F.when(F.col("_m").isNull() | own & (F.floor(x) == 0), F.lit(0.0)).otherwise(binomial_log_p(x, at_least))
    return scored.withColumn("log_p", log_p).select(*[k for k in regions.columns if k != "log_p"], "log_p")


def vicinity_p_values(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, norm: int, reach: int, peak: bool) -> DataFrame:
    """Regions with log_p in mean mode, or max mode for `peak`."""
    if not peak:
        return mean_vicinity(regions, chip, control, fragment, norm, reach)
    ends = F.broadcast(lengths(control).withColumnRenamed("l", "_l"))
    short = lambda r, longest: by_stretch(r.join(ends, "chrom"), [chip, control], _peak_kernel(fragment, norm, reach), {"log_p": float}, behind=(reach + 1) * longest + norm + 1, before=reach * longest).drop("_l")
    return by_length(regions.drop("log_p"), short, lambda r: _long_vicinity(r, chip, control, fragment, norm, reach))


def _peak_kernel(fragment: float, norm: int, reach: int):
    """Max mode: as long_peaks of regions longer than the norm, as peak_p_value of the others."""
    tails = Tails()

    def kernel(arrays: list[np.ndarray], low: int):
        signal, back = upto(np.floor(arrays[0])), upto(arrays[1])
        wide = lambda sums: np.append(sums[norm:], np.full(norm, sums[-1])) - sums
        inside, around = greatest(wide(signal)), greatest(wide(back))

        def slid(a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
            n, out = int((b - a).max(initial=0)) + 1, np.empty(len(a))
            for k in range(0, len(a), max(1, CELLS // n)):
                part = slice(k, k + max(1, CELLS // n))
                at = np.minimum(a[part, None] + np.arange(n), b[part, None])
                out[part] = (back[at + width[part, None]] - back[at]).max(1)
            return out

        def f(first: np.ndarray, last: np.ndarray, column):
            l, length = column("_l") - low, last - first + 1
            s, e = np.maximum(1 - low, first - reach * length), np.minimum(l, last + reach * length)
            long = length > norm
            width = np.where(long, norm, length - 1)
            ok = s + width <= l
            a, b = np.where(ok, s, 0), np.where(ok, np.maximum(s + 1, e - width), 1)
            x, c = signal[last + 1] - signal[first], np.empty(len(first))
            x[long] = inside(first[long], np.maximum(first + 1, last - norm)[long])
            c[long], c[~long] = around(a[long], b[long]), slid(a[~long], b[~long], width[~long])
            x, c = x / fragment, c / fragment
            c = np.where(np.floor(c) == 0, 1.0, c)
            return None, [np.where(ok & (np.floor(x) != 0), tails.of_masses(x, c), 0.0)]

        return f

    return kernel


def _long_vicinity(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, norm: int, reach: int) -> DataFrame:
    """Max mode without kernels."""
    length = F.col("end") - F.col("start") + 1
    long = long_peaks(regions.filter(length > norm), chip, control, fragment, norm, reach)
    pad = ((F.col("e0") - F.col("s0") + 1) * (reach + 1) + norm).cast("long")  # of short regions, so it is bounded by norm
    rows = with_runs(with_runs(regions.filter(length <= norm), chip, "_chip", norm), control, "_control", pad).join(lengths(control).withColumnRenamed("l", "_l"), "chrom")

    def f(row: dict) -> dict:
        width = (row["end"] - row["start"] + 1) * (reach + 1) + norm
        low, high = max(1, row["start"] - width), row["end"] + width
        return {"log_p": peak_p_value(spread(row["_chip"], low, high), spread(row["_control"], low, high), row["start"], row["end"], low, fragment, reach, row["_l"])}

    return per_region(rows, f, {"log_p": pa.float64()}).drop("_l").unionByName(long)


def poisson_windows(profile: DataFrame, fdr: float, width: int = WINDOW, first: int = 1) -> DataFrame:
    """(chrom, win, threshold): the Poisson threshold of each window's mean depth, at most the greatest whole depth in it, else 0.

    Windows begin at first + win * width (first is 1 or 0) as long as that is before a chromosome's end l, and are width long, or
    reach to l, which is then not part of them. A mean is taken over a window and the position behind it, but for a window's length.
    """
    at = lambda p: F.floor((F.col(p) - first) / width)
    begin = F.col("win") * width + first
    ends = lengths(profile)
    used = profile.withColumn("start", F.greatest("start", F.lit(1))).filter("start <= end")
    cut = used.withColumn("win", F.explode(F.sequence(F.greatest(F.floor((F.col("start") - 1 - first) / width), F.lit(0)), at("end")))).join(F.broadcast(ends), "chrom")
    cut = cut.withColumn("n", F.least(F.lit(width), F.col("l") - begin)).filter("n > 0")
    low, high = F.greatest("start", begin), F.least("end", begin + F.col("n"))
    inside = F.least("end", begin + F.col("n") - 1) >= low
    sums = cut.filter(low <= high).groupBy("chrom", "win", "n").agg(F.sum(F.col("value") * (high - low + 1)).alias("mass"), F.max(F.when(inside, F.col("value"))).alias("most"))
    most = F.least(F.floor(F.coalesce("most", F.lit(0.0))), F.lit(2**31 - 1)).cast("int")
    return sums.select("chrom", F.col("win").cast("long").alias("win"), poisson_threshold(F.col("mass") / F.col("n"), fdr, most).alias("threshold"))


@tidied
def window_statistics(chip: DataFrame, control: DataFrame, window_lengths: list[int], fragment: float, within: int = 50_000_000, low: float = 1.5, high: float = 2.0, level: float = 0.05) -> DataFrame:
    """(l_win, n_pp, n_pi, n_ip, n_ii, fc_fnr, p_fnr, fc_fpr, p_fpr, sensitivity): p-values against fold changes in windows of each length.

    Windows start at 1 with a stride of two lengths in the first `within` positions and are counted under their own length, which
    a chromosome's end may shorten. Fold change and mean are over the window, p over the position behind it too, scaled to the window's length.
    Windows at a profile's end, with log_p 0, no control or a mean chip of 1 or less don't count. n_xy: x is significance of p, y of
    the fold change, which between low and high is neither.
    """
    chip, control = settled(chip), settled(control)  # both are read several times
    ends = lengths(chip).join(lengths(control).withColumnRenamed("l", "m"), "chrom")
    wins = ends.withColumn("asked", F.explode(F.array(*map(F.lit, window_lengths)))).filter("l > 1")
    wins = wins.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.least("l", F.lit(within)) - 1, (2 * F.col("asked")).cast("long"))))
    wins = wins.withColumn("l_win", F.when(F.col("start") + F.col("asked") > F.col("l"), F.col("l") - F.col("start") - 1).otherwise(F.col("asked")).cast("int"))
    wins = wins.withColumn("end", F.col("start") + F.col("l_win")).filter("l_win > 0 and end < l and end < m").select("chrom", "l_win", "start", "end")
    wins = settled(wins)
    scored = range_sums(wins, [("signal", chip, True), ("control", control, False)])
    scored = scored.withColumn("log_p", mass_log_p(F.col("signal"), F.col("control"), F.col("l_win") + 1, fragment, F.col("l_win")))
    inner = scored.select("chrom", "l_win", "start", (F.col("end") - 1).alias("end"), "log_p")
    inner = range_sums(inner, [("x", chip, False), ("y", control, False)]).filter((F.col("log_p") != 0) & (F.col("y") > 0) & (F.col("x") / F.col("l_win") > 1))
    fc = F.col("x") / F.col("y")
    p_sig, f_sig, f_not = F.col("log_p") < math.log(level), fc > high, fc < low
    n = inner.groupBy("l_win").agg(F.count_if(p_sig & f_sig).alias("n_pp"), F.count_if(p_sig & f_not).alias("n_pi"), F.count_if(~p_sig & f_sig).alias("n_ip"), F.count_if(~p_sig & f_not).alias("n_ii"), F.count_if(p_sig).alias("_p"), F.count_if(~p_sig).alias("_i"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    f_sig, f_not = F.col("n_pp") + F.col("n_ip"), F.col("n_pi") + F.col("n_ii")
    out = n.withColumns({"fc_fnr": ratio("n_ip", f_sig), "p_fnr": ratio("n_ip", F.col("_i")), "fc_fpr": ratio("n_pi", f_not), "p_fpr": ratio("n_pi", F.col("_p")), "sensitivity": ratio("n_pp", f_sig)})
    return out.drop("_p", "_i").filter(F.col("l_win").isin(window_lengths))


#: Targets of the window-length choice.
TARGET_FPR, TARGET_SENSITIVITY, EARLY_SENSITIVITY, EARLY_FPR, ABSOLUTE_FPR = 0.01, 0.96, 0.99, 0.0, 0.05


def select_window_length(stats: DataFrame, target_fpr: float = TARGET_FPR, target_sensitivity: float = TARGET_SENSITIVITY, early_sensitivity: float = EARLY_SENSITIVITY, early_fpr: float = EARLY_FPR, absolute_fpr: float = ABSOLUTE_FPR) -> DataFrame:
    """One row: the first length that meets a rule to stop, else the last. Both rates (fc_fpr and p_fpr) must keep a bound; a missing rate keeps none."""
    at_most = lambda t: F.coalesce((F.col("fc_fpr") <= t) & (F.col("p_fpr") <= t), F.lit(False))
    least = lambda t: F.coalesce(F.col("sensitivity") >= t, F.lit(False))
    beyond = F.coalesce(F.col("fc_fpr") > absolute_fpr, F.lit(False)) | F.coalesce(F.col("p_fpr") > absolute_fpr, F.lit(False))
    fpr_ok, sens_ok = at_most(target_fpr), least(target_sensitivity)
    stop = beyond | (fpr_ok & sens_ok & (least(early_sensitivity) | at_most(early_fpr))) | (sens_ok & ~fpr_ok)
    return stats.agg(F.coalesce(F.min(F.when(stop, F.col("l_win"))), F.max("l_win")).alias("l_win"))


def select_window_length_simple(stats: DataFrame, target_fpr: float = TARGET_FPR, target_sensitivity: float = TARGET_SENSITIVITY, early_sensitivity: float = EARLY_SENSITIVITY) -> DataFrame:
    """The two older rules: stop where both rates are below the target at the early sensitivity, or a rate is above it beyond the target sensitivity."""
    below = (F.col("fc_fpr") < target_fpr) & (F.col("p_fpr") < target_fpr) & (F.col("sensitivity") >= early_sensitivity)
    above = ((F.col("fc_fpr") > target_fpr) | (F.col("p_fpr") > target_fpr)) & (F.col("sensitivity") > target_sensitivity)
    stop = F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))
    return stats.agg(F.coalesce(F.min(F.when(stop, F.col("l_win"))), F.max("l_win")).alias("l_win"))


def background(chip: DataFrame, window: int, fragment: float, mean_window: int = WINDOW, step: float = 0.05, most_steps: int = 500, target: float = 0.10, enough: int = 100) -> DataFrame:
    """A control profile where there is none: the chip's wide mean, at least 1, raised until its windows' p-values and fold changes disagree
    as often as `target` allows. Only window sums go through the loop."""
    from .profile import mean_filtered

    ends = lengths(chip)
    base = mean_filtered(chip, ends, mean_window).withColumn("value", F.greatest("value", F.lit(1.0)))
    full = F.broadcast(ends.select("chrom", F.floor(F.col("l") / window).alias("n")))
    x = window_sums(chip, window, window - 1).withColumnRenamed("mass", "x")
    wins = x.join(window_sums(base, window, window - 1).withColumnRenamed("mass", "y"), ["chrom", "win"]).join(full, "chrom").filter(F.col("win") < F.col("n"))
    # Steps a window needs until each side of the two comparisons changes depend on (x, y) alone, so counts by step are aggregates.
    kept = wins.filter(F.col("x") >= window).select("chrom", "x", "y")
    steps = kept.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most_steps)))).withColumn("c", F.col("y") + F.col("k") * (window * step)).filter(F.col("c") >= window)
    s, c = F.floor(F.col("x") / fragment), F.floor(F.col("c") / fragment)
    cells = steps.groupBy("chrom", "k", s.alias("s"), c.alias("b"), (F.col("x") / F.col("c") > 2).alias("up"), (F.col("x") / F.col("c") < 1.5).alias("down")).agg(F.count("*").alias("n"))
    log_p = binomial_log_p(F.col("s").cast("double"), F.col("b").cast("double"))
    sig = log_p < math.log(0.05)
    n = cells.withColumn("sig", sig).groupBy("chrom", "k").agg(*(F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(a) for a, cond in (("pp", F.col("sig") & F.col("up")), ("pi", F.col("sig") & F.col("down")), ("ip", ~F.col("sig") & F.col("up")))))
    n = n.withColumn("_ready", (F.col("pp") + F.col("ip") > enough) & (F.col("pp") + F.col("pi") > enough))
    n = n.withColumn("_ready", F.max(F.col("_ready").cast("int")).over(Window.partitionBy("chrom").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) == 1)
    fine = F.col("_ready") & (F.coalesce(F.try_divide(F.col("ip"), F.col("pp") + F.col("ip")), F.lit(0.0)) <= target) & (F.coalesce(F.try_divide(F.col("pi"), F.col("pp") + F.col("pi")), F.lit(1.0)) >= target)
    chosen = n.filter(fine).groupBy("chrom").agg(F.min("k").alias("k"))
    raised = base.join(F.broadcast(chosen), "chrom", "left").join(F.broadcast(ends), "chrom").withColumn("k", F.coalesce("k", F.lit(most_steps)))
    piece = lambda s, e, v: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), v.alias("v"))
    up, last = F.col("value") + F.col("k") * step, F.col("end") == F.col("l")  # a chromosome's last position isn't raised
    pieces = F.array(piece(F.col("start"), F.col("end") - last.cast("int"), up), piece(F.when(last, F.col("l")).otherwise(F.col("end") + 1), F.col("end"), F.col("value")))
    return raised.select("chrom", F.explode(pieces).alias("_p")).filter("_p.s <= _p.e").select("chrom", F.col("_p.s").alias("start"), F.col("_p.e").alias("end"), F.col("_p.v").alias("value"))

