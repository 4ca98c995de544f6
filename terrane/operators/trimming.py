"""Trimming, filtering and annotation of enriched regions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import binomial_log_p, binomial_log_tail
from .chunked import CHUNK, neighbours, ranked, running, settled
from .enrichment import WINDOW, per_region, poisson_windows, range_sums
from .overlap import overlap_join
from .profile import compact, filled, floored, lengths
from .stretches import CELLS, Tails, by_length, by_stretch, upto


#: Logs of p-values that are closer count as equal, so that rounding decides nothing.
EQUAL = 1e-10


def _thresholds(regions: DataFrame, chip: DataFrame, fdr: float, width: int, first: int = 1) -> DataFrame:
    """Regions with the threshold of the window they start in; those that start before the first window or behind the last, or whose
    window has no threshold, go."""
    limits = poisson_windows(chip, fdr, width, first).filter("threshold > 0").withColumnRenamed("win", "_win")
    placed = regions.filter(F.col("start") >= first).withColumn("_win", F.floor((F.col("start") - first) / width).cast("long"))
    return placed.join(F.broadcast(lengths(chip)), "chrom").filter("start < l").drop("l").join(limits, ["chrom", "_win"]).drop("_win")


def tune_boundaries(regions: DataFrame, chip: DataFrame, fdr: float = 0.05, width: int = WINDOW, by: int = 100) -> DataFrame:
    """A region whose start has the depth of its window's threshold grows by `by` to the left, else one whose end has it to the right."""
    limits = poisson_windows(chip, fdr, width).withColumnRenamed("win", "_win")
    placed = regions.withColumn("_win", F.floor((F.greatest(F.col("start"), F.lit(1)) - 1) / width).cast("long")).join(limits, ["chrom", "_win"], "left")
    ends = F.explode(F.array(F.col("start"), F.col("end")))
    points = regions.select("chrom", ends.alias("start")).distinct().withColumn("end", F.col("start"))
    depth = overlap_join(points, chip).select(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("_p"), F.col("b_value").alias("_v"))
    for end in ("start", "end"):
        placed = placed.join(depth.withColumnsRenamed({"_p": end, "_v": f"_{end}"}), ["chrom", end], "left")
    t = F.col("threshold")
    asked = (t > 0) & (F.col("start") >= 1) & (F.col("start") < F.col("l"))
    left = F.coalesce(asked & (F.coalesce("_start", F.lit(0.0)) >= t), F.lit(False))
    right = F.coalesce(~left & asked & (F.coalesce("_end", F.lit(0.0)) >= t), F.lit(False))
    tuned = placed.join(F.broadcast(lengths(chip)), "chrom").withColumns({"_s": F.when(left, F.greatest(F.col("start") - by, F.lit(1))).otherwise(F.col("start")).cast("long"), "_e": F.when(right, F.least(F.col("end") + by, F.col("l"))).otherwise(F.col("end")).cast("long")})
    return tuned.withColumns({"start": F.col("_s"), "end": F.col("_e")}).select(*regions.columns)


def rd_trim(regions: DataFrame, chip: DataFrame, fdr: float, width: int = WINDOW) -> DataFrame:
    """Regions cut to their first and last position above their window's threshold; those without such a position go. A chromosome's
    last position counts for nothing."""
    placed = _thresholds(regions, chip, fdr, width).distinct()
    open_ = chip.join(F.broadcast(lengths(chip)), "chrom").withColumn("end", F.least("end", F.col("l") - 1)).filter("start <= end").drop("l")
    met = overlap_join(placed, open_).filter(F.col("b_value") > F.col("a_threshold"))
    own = [F.col(f"a_{c}").alias(c) for c in regions.columns]
    cut = met.groupBy(*own).agg(F.min("ol_start").alias("_s"), F.max("ol_end").alias("_e"))
    return cut.withColumns({"start": F.col("_s"), "end": F.col("_e")}).select(*regions.columns)


def median_filter_regions(regions: DataFrame, chip: DataFrame, fdr: float, width: int = WINDOW) -> DataFrame:
    """Regions whose upper median of depths is above the threshold of the window they start in; windows begin at 0 here.

    The median is over threshold if the positions above it are more than half: n - n // 2 of n at least. So it is a sum over runs.
    """
    placed = _thresholds(regions, chip, fdr, width, first=0).distinct()
    met = overlap_join(placed, chip).filter(F.col("b_value") > F.col("a_threshold"))
    own = [F.col(f"a_{c}").alias(c) for c in regions.columns]
    above = met.groupBy(*own).agg(F.sum(F.col("ol_end") - F.col("ol_start") + 1).alias("_n"))
    n = F.col("end") - F.col("start") + 1
    return above.filter(F.col("_n") >= n - F.floor(n / 2)).select(*regions.columns)


def _within(regions: DataFrame, control: DataFrame) -> DataFrame:
    """The regions that control reaches, ends as long."""
    placed = regions.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})
    return placed.join(F.broadcast(lengths(control).withColumnRenamed("l", "_l")), "chrom").filter("end <= _l").select(*regions.columns)


def _spots(regions: DataFrame) -> DataFrame:
    """(chrom, start, end) of regions, each once."""
    return settled(regions.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct(), "spots")


def _recut(regions: DataFrame, cuts: DataFrame) -> DataFrame:
    """Regions with the ends _s and _e that cuts (chrom, _from, _to, _s, _e) gives them; those without go."""
    met = regions.join(cuts.withColumnsRenamed({"_from": "start", "_to": "end"}), ["chrom", "start", "end"])
    return met.withColumns({"start": F.col("_s").cast("long"), "end": F.col("_e").cast("long")}).select(*regions.columns)


def nested_trims(spots: DataFrame, chip: DataFrame, most: int = 500) -> DataFrame:
    """(chrom, _from, _to, start, end, t, total): the different trims of each spot to its first and last position of a depth above t, over all
    whole t from its least whole depth to its greatest, or to `most`; a trim's t is its least. total is the spot's mass.

    Depths above t are those whose next whole number is, so a spot's runs are aggregated by that number, up to most + 1, and a trim is the
    running minimum and maximum of their ends from the greatest down. No row or window holds more than most + 2 levels, however long a spot is.
    """
    own = ["chrom", "_from", "_to"]
    n, v = F.col("ol_end") - F.col("ol_start") + 1, F.col("b_value").cast("double")
    met = overlap_join(spots, chip.select("chrom", "start", "end", "value"))
    level = F.least(F.ceil(v), F.lit(most + 1)).cast("long").alias("t")
    steps = met.groupBy(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("_from"), F.col("a_end").alias("_to"), level).agg(
        F.min("ol_start").alias("_first"), F.max("ol_end").alias("_last"), F.sum(n).alias("_n"), F.sum(n * v).alias("_mass"), F.min(v).alias("_low"), F.max(v).alias("_high")
    )
    steps = settled(steps, "levels")
    wholes = spots.withColumnsRenamed({"start": "_from", "end": "_to"}).join(steps.groupBy(*own).agg(F.sum("_n").alias("_n"), F.sum("_mass").alias("total"), F.min("_low").alias("_low"), F.max("_high").alias("_high")), own, "left")
    bare = F.coalesce("_n", F.lit(0)) < F.col("_to") - F.col("_from") + 1  # a position without a run has depth 0
    zero = F.when(bare, F.lit(0.0))
    bounds = wholes.select(*own, F.coalesce("total", F.lit(0.0)).alias("total"), F.floor(F.least("_low", zero)).cast("long").alias("_least"), F.least(F.floor(F.greatest("_high", zero)), F.lit(most)).cast("long").alias("_top"))
    least = bounds.select(*own, F.col("_least").alias("t"), F.lit(None).cast("long").alias("_first"), F.lit(None).cast("long").alias("_last"))
    above = Window.partitionBy(*own).orderBy(-F.col("t")).rangeBetween(Window.unboundedPreceding, -1)
    rows = steps.select(*own, "t", "_first", "_last").unionByName(least)
    rows = rows.withColumns({"start": F.coalesce(F.min("_first").over(above), F.col("_from")), "end": F.coalesce(F.max("_last").over(above), F.col("_to"))})
    return rows.join(bounds, own).filter("t between _least and _top").groupBy(*own, "start", "end").agg(F.min("t").alias("t"), F.first("total").alias("total"))


def _trim_kernel(fragment: float, modified: bool, most: int, least_mass: float):
    """The trims of nested_trims, depth by depth for all regions together, and the first of least p-value."""
    tails = Tails()

    def kernel(arrays: list[np.ndarray], low: int):
        chip, control = arrays
        whole = np.floor(chip)
        raw, signal, back = upto(chip), upto(whole), upto(np.floor(control) if modified else control)
        level = np.minimum(np.ceil(chip), most + 1).astype(np.int64)

        def f(first: np.ndarray, last: np.ndarray, column):
            bounds = np.stack([first, last + 1], 1).ravel()
            least, top = np.minimum.reduceat(whole, bounds)[::2], np.minimum(np.maximum.reduceat(whole, bounds)[::2], most)
            total, n = raw[last + 1] - raw[first], len(first)
            s, e, best, tried = np.full(n, -1), np.full(n, -1), np.full(n, np.inf), []
            going, (a, b) = least <= top, (first.min(), last.max() + 1)
            for t in range(int(least.min()), int(top.max()) + 1):
                now = np.flatnonzero(going & (least <= t) & (t <= top))
                above = np.flatnonzero(level[a:b] > t) + a
                place = np.concatenate(([0], np.cumsum(level[a:b] > t)))
                i, j = place[first[now] - a], place[last[now] + 1 - a]
                any_ = j > i
                held = np.append(above, 0)
                x, y = np.where(any_, held[np.minimum(i, len(above))], first[now]), np.where(any_, held[j - 1], last[now])
                new = (x != s[now]) | (y != e[now])
                now, x, y = now[new], x[new], y[new]
                s[now], e[now] = x, y
                p = tails.of_masses((signal[y + 1] - signal[x]) / fragment, (back[y + 1] - back[x]) / fragment)
                best[now] = np.minimum(best[now], p)
                tried.append((now, x, y, p))
                some = total[now] > 0
                going[now[some & ((raw[y + 1] - raw[x]) / np.where(some, total[now], 1) <= least_mass)]] = False
            open_ = np.ones(n, bool)
            for now, x, y, p in tried:
                taken = open_[now] & (p <= best[now] + EQUAL)
                s[now[taken]], e[now[taken]] = x[taken], y[taken]
                open_[now[taken]] = False
            return ~open_, [s + low, e + low]

        return f

    return kernel


def p_value_trim(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, modified: bool = False, most: int = 500, least_mass: float = 0.5) -> DataFrame:
    """Regions cut to the trim (see nested_trims) of least p-value, the first of equals from the least depth up to the first that leaves
    `least_mass` of the mass or less; those that reach past control go. `modified` floors control too.

    Regions no longer than SHORT are trimmed over stretches of both profiles. The others' masses are range sums, so a region may be as long as a
    chromosome.
    """
    short = lambda r, longest: by_stretch(r, [chip, control], _trim_kernel(fragment, modified, most, least_mass), {"start": int, "end": int}, behind=longest)
    return by_length(_within(regions, control), short, lambda r: _long_p_value_trim(r, chip, control, fragment, modified, most, least_mass))


def _long_p_value_trim(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, modified: bool, most: int, least_mass: float) -> DataFrame:
    own = ["chrom", "_from", "_to"]
    tried = settled(nested_trims(_spots(regions), chip, most), "trims")
    scored = range_sums(tried, [("_chip", chip, True), ("_control", control, modified), ("_raw", chip, False)])
    whole = Window.partitionBy(*own)
    stop = F.min(F.when((F.col("total") > 0) & (F.try_divide("_raw", "total") <= least_mass), F.col("t"))).over(whole)
    scored = scored.withColumn("_stop", stop).filter("_stop is null or t <= _stop").withColumn("_p", binomial_log_p(F.col("_chip") / fragment, F.col("_control") / fragment))
    best = scored.withColumn("_best", F.min("_p").over(whole)).filter(F.col("_p") <= F.col("_best") + EQUAL)
    cuts = best.groupBy(*own).agg(F.min(F.struct("t", F.col("start").alias("_s"), F.col("end").alias("_e"))).alias("_cut"))
    return _recut(regions, cuts.select(*own, "_cut._s", "_cut._e"))


def best_on_grid(sums: dict[int, tuple[float, float, float]], start: int, end: int, step: int, fragment: float) -> tuple[int, int]:
    """Ends of the least p-value among pairs of grid points that hold more than half the mass, the first of equals; else the whole.

    sums: chip, whole chip and control from `start` to each grid point, to the place before it and to the end. The end is no grid point.
    """
    at = np.arange(start, end + 1, step)
    before, upto = (np.array([sums[int(x)] for x in at + d]).T for d in (-1, 0))
    i, j = (k.ravel() for k in np.meshgrid(np.arange(len(at)), np.flatnonzero(at < end), indexing="ij"))
    kept = (j > i) & (upto[0][j] - before[0][i] > 0.5 * sums[end][0])
    i, j = i[kept], j[kept]
    s, c = ((upto[k][j] - before[k][i]) / fragment for k in (1, 2))
    k, total = np.floor(c).astype(np.int64), np.trunc(s + c).astype(np.int64)
    known = {pair: binomial_log_tail(*pair) for pair in set(zip(k.tolist(), total.tolist()))}
    p = np.array([known[pair] for pair in zip(k.tolist(), total.tolist())])
    first = np.flatnonzero(p <= p.min(initial=math.inf) + EQUAL)
    return (int(at[i[first[0]]]), int(at[j[first[0]]])) if len(p) else (start, end)


def _grid_kernel(fragment: float, step: int, share: int):
    """best_on_grid for all regions together."""
    tails = Tails()

    def kernel(arrays: list[np.ndarray], low: int):
        chip, control = arrays
        raw, signal, back = upto(chip), upto(np.floor(chip)), upto(control)

        def best(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by = np.maximum(step, (last - first) // share)
            at = first[:, None] + by[:, None] * np.arange(int(((last - first) // by).max()) + 1)
            inside, at = at < last[:, None], np.minimum(at, last[:, None])
            i, j = np.triu_indices(at.shape[1], 1)
            row, pair = np.nonzero(inside[:, j] & (raw[at + 1][:, j] - raw[at][:, i] > 0.5 * (raw[last + 1] - raw[first])[:, None]))
            x, y = at[row, i[pair]], at[row, j[pair]]
            p = tails.of_masses((signal[y + 1] - signal[x]) / fragment, (back[y + 1] - back[x]) / fragment)
            least = np.full(len(first), np.inf)
            np.minimum.at(least, row, p)
            found = np.flatnonzero(p <= least[row] + EQUAL)
            rows, k = np.unique(row[found], return_index=True)  # pairs are in order, so these are the first
            s, e = first.copy(), last.copy()
            s[rows], e[rows] = x[found[k]], y[found[k]]
            return s, e

        def f(first: np.ndarray, last: np.ndarray, column):
            points = int(((last - first) // np.maximum(step, (last - first) // share)).max()) + 1
            n = max(1, CELLS // points**2)
            cut = [best(first[k : k + n], last[k : k + n]) for k in range(0, len(first), n)]
            return None, [np.concatenate([c[k] for c in cut]) + low for k in (0, 1)]

        return f

    return kernel


def grid_trim(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, step: int = 100, share: int = 40) -> DataFrame:
    """Regions cut to the pair of grid points of least p-value that keep more than half the mass; the grid's step is a 40th of the length, or
    `step`. Regions that reach past control go.

    Regions no longer than SHORT are cut over stretches of both profiles. For the others sums up to grid points are range sums; a region's row
    holds those, two for each of at most 2 * share points, and no runs.
    """
    short = lambda r, longest: by_stretch(r, [chip, control], _grid_kernel(fragment, step, share), {"start": int, "end": int}, behind=longest)
    return by_length(_within(regions, control), short, lambda r: _long_grid_trim(r, chip, control, fragment, step, share))


def _long_grid_trim(regions: DataFrame, chip: DataFrame, control: DataFrame, fragment: float, step: int, share: int) -> DataFrame:
    own = ["chrom", "_from", "_to"]
    spots = _spots(regions).withColumn("_step", F.greatest(F.lit(step), F.floor((F.col("end") - F.col("start")) / share)).cast("long"))
    grid = F.sequence(F.col("start"), F.col("end"), F.col("_step"))
    asked = F.array_distinct(F.concat(grid, F.transform(grid, lambda x: x - 1), F.array(F.col("end"))))
    points = spots.select("chrom", F.col("start").alias("_from"), F.col("end").alias("_to"), "_step", "start", F.explode(asked).alias("end"))
    held = range_sums(points, [("_raw", chip, False), ("_chip", chip, True), ("_control", control, False)])
    rows = held.groupBy(*own, "_step").agg(F.collect_list(F.struct("end", "_raw", "_chip", "_control")).alias("_sums"))

    def f(row: dict) -> dict:
        sums = {x["end"]: (x["_raw"], x["_chip"], x["_control"]) for x in row["_sums"]}
        s, e = best_on_grid(sums, row["_from"], row["_to"], row["_step"], fragment)
        return {"_s": s, "_e": e}

    return _recut(regions, per_region(rows, f, {"_s": pa.int64(), "_e": pa.int64()}, ("_sums",)).drop("_step"))


def significant(regions: DataFrame, cutoff: float, longer_than: float | None = None) -> DataFrame:
    out = regions.filter(F.col("log_p") < math.log(cutoff))
    return out if longer_than is None else out.filter(F.col("end") - F.col("start") > longer_than)


def strand_info(regions: DataFrame, stranded: DataFrame) -> DataFrame:
    """Regions with mass, centre of mass, greatest depth and its position on each strand; forward takes the leftmost of equals, reverse the rightmost."""
    spots = regions.select("chrom", "start", "end").distinct()
    met = overlap_join(spots, stranded)
    n = F.col("ol_end") - F.col("ol_start") + 1
    mass, moment = F.col("b_value") * n, F.col("b_value") * n * (F.col("ol_start") + F.col("ol_end")) / 2
    fore, back = F.col("b_strand") == "F", F.col("b_strand") == "R"
    only = lambda cond, x: F.when(cond, x)
    top = lambda cond, sign, pos: F.max(only(cond, F.struct(F.col("b_value").alias("v"), (sign * pos).alias("p"))))
    out = met.groupBy(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end")).agg(
        F.coalesce(F.sum(only(fore, mass)), F.lit(0.0)).alias("fore_mass"), F.coalesce(F.sum(only(back, mass)), F.lit(0.0)).alias("rev_mass"),
        F.try_divide(F.sum(only(fore, moment)), F.sum(only(fore, mass))).alias("fore_centre"), F.try_divide(F.sum(only(back, moment)), F.sum(only(back, mass))).alias("rev_centre"),
        top(fore, -1, F.col("ol_start")).alias("_f"), top(back, 1, F.col("ol_end")).alias("_r"),
    )
    out = out.withColumns({"fore_max": F.col("_f.v"), "fore_peak": -F.col("_f.p"), "rev_max": F.col("_r.v"), "rev_peak": F.col("_r.p")}).drop("_f", "_r")
    return regions.join(out, ["chrom", "start", "end"], "left").fillna(0.0, ["fore_mass", "rev_mass"])


def strand_even(regions: DataFrame, least: float, both: bool = False) -> DataFrame:
    """Regions whose strands' masses differ by less than 1 / least; a mass of 0 counts as 1, or with `both` fails."""
    one = lambda c: F.col(c) if both else F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.col(c))
    a, b = one("fore_mass"), one("rev_mass")
    even = (F.try_divide(a, b) > least) & (F.try_divide(b, a) > least)
    return regions.filter(F.coalesce(even & (a > 0) & (b > 0), F.lit(False)))


def strand_share(reads: DataFrame, chrom: str) -> float:
    """Half the lesser ratio of the numbers of reads on the strands of a chromosome; 0 where one strand has none."""
    n = reads.filter(F.col("chrom") == chrom).agg(F.count_if(F.col("strand") == "F").alias("f"), F.count_if(F.col("strand") != "F").alias("r")).first()
    return min(n["f"] / n["r"], n["r"] / n["f"]) / 2 if n["f"] and n["r"] else 0.0


def summits(regions: DataFrame, chip: DataFrame, control: DataFrame) -> DataFrame:
    """Regions with masses and maxima of whole depths over (start, end], and the summit: the middle of the first highest plateau that falls
    inside, where a plateau that the region starts in counts from 0.

    Regions that end at or behind either profile's end have none of these (0), and `inside` is false.
    """
    ends = lengths(chip).join(lengths(control).withColumnRenamed("l", "m"), "chrom")
    inside = regions.join(F.broadcast(ends), "chrom", "left").withColumn("inside", F.coalesce((F.col("end") < F.col("l")) & (F.col("end") < F.col("m")), F.lit(False))).drop("l", "m")
    inside = settled(inside, "inside")
    spots = settled(inside.filter("inside").select("chrom", "start", "end").distinct(), "spots")
    plateaus = compact(floored(chip).filter("value > 0"))
    near = neighbours(plateaus, ["chrom"], ["start"], ["start", "value"], previous=False)
    falls = near.filter(F.col("next_start").isNull() | (F.col("next_start") > F.col("end") + 1) | (F.col("next_value") < F.col("value"))).select("chrom", "start", "end", "value")
    met = overlap_join(spots, falls).filter("b_end < a_end")
    own = [F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end")]
    begin = F.when(F.col("b_start") > F.col("a_start"), F.col("b_start")).otherwise(F.lit(0))
    top = met.groupBy(*own).agg(F.max(F.struct(F.col("b_value").alias("v"), (-F.col("b_start")).alias("s"), F.floor((F.col("b_end") + begin) / 2).alias("at"))).alias("_top"))
    behind = spots.withColumn("start", F.col("start") + 1).filter("start <= end")
    most = overlap_join(behind, control).groupBy(F.col("a_chrom").alias("chrom"), (F.col("a_start") - 1).alias("start"), F.col("a_end").alias("end")).agg(F.floor(F.max("b_value")).cast("double").alias("control_max"))
    out = range_sums(spots, [("chip_mass", chip, True), ("control_mass", control, True)], skip_first=True)
    at = ["chrom", "start", "end"]
    out = inside.join(out.join(top, at, "left").join(most, at, "left"), at, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c if isinstance(c, str) else "chip_max")
    return out.select(*regions.columns, "inside", zero("chip_mass"), zero("control_mass"), zero(F.col("_top.v")), zero("control_max"), F.coalesce("_top.at", F.lit(0)).cast("long").alias("summit"))


def region_extrema(spots: DataFrame, chip: DataFrame) -> DataFrame:
    """(chrom, start, end, pos, kind, height): maxima and minima of each spot's own stretch of chip, pos counted from its start.

    A plateau inside a spot is an extremum there if it is one of the whole profile, so extrema are found once and joined. Where a spot has two
    or more, sentinels of alternating kind stand at its ends, as multiscale.extrema has them; one with fewer has none.
    """
    at = ["chrom", "start", "end"]
    reach = spots.select("chrom", F.col("end").alias("l")).unionByName(lengths(chip)).groupBy("chrom").agg((F.max("l") + 1).alias("l"))
    plateaus = compact(filled(chip.select("chrom", "start", "end", F.col("value").cast("double").alias("value")), reach, first=0))
    v, p, n = F.col("value"), F.col("prev_value"), F.col("next_value")
    kind = F.when((p < v) & (n < v), "MAX").when((p > v) & (n > v), "MIN")
    found = neighbours(plateaus, ["chrom"], ["start"], ["value"]).withColumn("kind", kind).filter("kind is not null").select(*at, "kind", "value")
    met = overlap_join(spots.select(*at), found).filter("b_start > a_start and b_end < a_end")
    pos = (F.floor((F.col("b_start") + F.col("b_end") + 1) / 2) - F.col("a_start")).cast("long")
    inner = settled(met.select(*(F.col(f"a_{c}").alias(c) for c in at), pos.alias("pos"), F.col("b_kind").alias("kind"), F.col("b_value").alias("height")), "extrema")
    sides = inner.groupBy(*at).agg(F.count("*").alias("n"), F.min(F.struct("pos", "kind"))["kind"].alias("first"), F.max(F.struct("pos", "kind"))["kind"].alias("last")).filter("n >= 2")
    other = lambda c: F.when(F.col(c) == "MAX", "MIN").otherwise("MAX")
    posts = F.array(F.struct(F.col("start").alias("at"), other("first").alias("kind")), F.struct(F.col("end").alias("at"), other("last").alias("kind")))
    posts = sides.select("chrom", F.col("start").alias("_from"), F.col("end").alias("_to"), F.explode(posts).alias("_p")).select("chrom", "_from", "_to", "_p.kind", F.col("_p.at").alias("start"), F.col("_p.at").alias("end"))
    posts = range_sums(posts, [("height", chip, False)])
    posts = posts.select("chrom", F.col("_from").alias("start"), F.col("_to").alias("end"), (F.col("start") - F.col("_from")).alias("pos"), "kind", "height")
    return inner.join(sides.select(*at), at, "left_semi").unionByName(posts)


def _trough_kernel(mapped: bool, most: float, width: int):
    """Troughs of many regions: a row of extrema for each, the two posts among them, ranked row by row."""
    half = width // 2

    def kernel(arrays: list[np.ndarray], low: int):
        chip = arrays[0]
        mapp = upto(arrays[1]) if mapped else None
        cuts = np.flatnonzero(np.diff(chip)) + 1
        begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts - 1, [len(chip) - 1]))
        v = chip[begin]
        rise = np.diff(v) > 0
        turns = np.flatnonzero(rise[:-1] != rise[1:]) + 1
        begin, end, high, height = begin[turns], end[turns], rise[turns - 1], v[turns]
        mid = (begin + end + 1) // 2

        def found(first: np.ndarray, last: np.ndarray, i: np.ndarray, n: np.ndarray) -> np.ndarray:
            rows, column = np.arange(len(first)), np.arange(n.max() + 2)
            at = np.minimum(np.maximum(i[:, None] + column - 1, 0), len(mid) - 1)
            there, pos, top, h = column < (n + 2)[:, None], mid[at], high[at], height[at]
            for k, place, post in ((np.zeros_like(n), first, i), (n + 1, last, i + n - 1)):
                pos[rows, k], top[rows, k], h[rows, k] = place, ~high[post], chip[place]
            pos = np.minimum(pos, last[:, None])
            highs, lows = there & top, there & ~top

            def ranks(kind: np.ndarray, key: np.ndarray) -> np.ndarray:
                out = np.empty(kind.shape, np.int64)
                np.put_along_axis(out, np.argsort(np.where(kind, key, np.inf), axis=1, kind="stable"), column[None, :], axis=1)
                return out

            none = 3 * len(column)
            best = np.where(highs, ranks(highs, -h), none)
            left, right = np.minimum.accumulate(best, axis=1), np.minimum.accumulate(best[:, ::-1], axis=1)[:, ::-1]
            rank, worst = ranks(lows, h), (2 * highs.sum(1) + lows.sum(1))[:, None]
            bad = (left == none) | (right == none)
            if mapped:
                bad |= (mapp[pos + half] - mapp[np.maximum(pos - half, first[:, None])]) / width >= most - EQUAL
            score = np.where(bad, worst, rank + left + right)
            return pos[rows, np.argmin(np.where(lows, score * len(column) + rank, np.iinfo(np.int64).max), axis=1)]

        def f(first: np.ndarray, last: np.ndarray, column):
            i = np.searchsorted(begin, first, "right")
            n = np.searchsorted(end, last, "left") - i
            out = np.full(len(first), -low)
            order = np.flatnonzero(n >= 2)
            order = order[np.argsort(n[order], kind="stable")]
            while len(order):
                now = order[-max(1, CELLS // int(n[order[-1]] + 2)) :]
                order = order[: -len(now)]
                out[now] = found(first[now], last[now], i[now], n[now])
            return None, [out + low]

        return f

    return kernel


def troughs(regions: DataFrame, chip: DataFrame, mappability: DataFrame | None, most: float, width: int = 100) -> DataFrame:
    """Regions with `trough`: the minimum of least rank sum (its own by height, and those of the highest maxima on either side by
    depth); minima without both, or in poorly mappable places, come last. 0 without extrema.

    Regions no longer than SHORT are gone through over stretches of the profiles. A mean mappability within EQUAL of `most` counts as `most`.
    """
    tables = [chip] if mappability is None else [chip, mappability]
    short = lambda r, longest: by_stretch(r, tables, _trough_kernel(mappability is not None, most, width), {"trough": int}, behind=longest + width)
    return by_length(regions.drop("trough"), short, lambda r: _long_troughs(r, chip, mappability, most, width))


def _long_troughs(regions: DataFrame, chip: DataFrame, mappability: DataFrame | None, most: float, width: int) -> DataFrame:
    """A rank is the number of extrema at better heights, a running sum over heights, plus a place among equal ones; the best maximum on a side
    is a running minimum of ranks. So extrema stay rows, however many a region has.
    """
    at = ["chrom", "start", "end"]
    spots = _spots(regions)
    found = region_extrema(spots, chip)
    found = settled(found.withColumn("_key", F.when(F.col("kind") == "MAX", -F.col("height")).otherwise(F.col("height"))), "extrema")
    alike = [*at, "kind", "_key"]
    levels = running(found.groupBy(*alike).agg(F.count("*").alias("_n")), [*at, "kind"], ["_key"], F.col("_n"), "sum", "_better", inclusive=False)
    placed = ranked(found, alike, ["pos"], "_place").join(levels.drop("_n"), alike)
    placed = placed.withColumn("rank", F.coalesce("_better", F.lit(0)) + F.col("_place") - 1)
    high = F.when(F.col("kind") == "MAX", F.col("rank"))
    placed = running(placed.select(*at, "pos", "kind", "rank"), at, ["pos"], high, "min", "_left", inclusive=False)
    placed = running(placed.withColumn("_back", -F.col("pos")), at, ["_back"], high, "min", "_right", inclusive=False)
    sizes = found.groupBy(*at).agg((2 * F.count_if(F.col("kind") == "MAX") + F.count_if(F.col("kind") == "MIN")).alias("_worst"))
    lows = placed.filter("kind = 'MIN'").join(sizes, at)
    lows = lows.withColumn("score", F.coalesce(F.col("rank") + F.col("_left") + F.col("_right"), F.col("_worst")))
    if mappability is not None:  # nothing before the region counts
        half = width // 2
        low, back = F.col("_from") + F.greatest(F.col("pos") - half, F.lit(0)), F.col("_from") + F.col("pos") + half - 1
        spread_ = settled(lows.withColumnsRenamed({"start": "_from", "end": "_to"}).withColumns({"start": low, "end": back}), "lows")
        lows = range_sums(spread_, [("_map", mappability, False)]).drop("start", "end").withColumnsRenamed({"_from": "start", "_to": "end"})
        lows = lows.withColumn("score", F.when(F.col("_map") / width >= most - EQUAL, F.col("_worst")).otherwise(F.col("score")))
    best = lows.groupBy(*at).agg(F.min(F.struct("score", "rank", "pos"))["pos"].alias("_pos"))
    out = regions.join(best, at, "left")
    return out.select(*regions.columns, F.coalesce(F.col("start") + F.col("_pos"), F.lit(0)).cast("long").alias("trough"))


def merge_by_significance(by_scale: DataFrame, p_value, cutoff: float) -> DataFrame:
    """Regions (chrom, scale, start, end) of several scales as features (chrom, start, end, scale, log_p), each merged region of all scales at
    the largest scale at which it holds a significant one.

    Up to each scale that has regions, the regions of it and of all smaller ones are merged (those that touch too); p_value gives
    regions (chrom, start, end, scale) their log_p. Inside a merged region of all scales, the scales are gone through from the
    largest down to the first with a log_p below the log of the cutoff, and all its merged regions come out, the insignificant
    too. Without such a scale a merged region gives nothing.
    """
    from .intervals import merge

    regions = by_scale.select("chrom", "scale", "start", "end")
    up_to = regions.select("scale").distinct().withColumnRenamed("scale", "_up_to")  # one row for each scale
    pooled = regions.join(F.broadcast(up_to), F.col("scale") <= F.col("_up_to")).select("chrom", F.col("_up_to").alias("scale"), "start", "end")
    merged = merge(pooled, 1, ("chrom", "scale")).select("chrom", "scale", "start", "end")
    scored = settled(p_value(merged).select("chrom", "scale", "start", "end", "log_p"))
    met = overlap_join(scored, merge(regions, 1).select("chrom", "start", "end"))
    found = met.filter(F.col("a_log_p") < math.log(cutoff)).groupBy("b_chrom", "b_start", "b_end").agg(F.max("a_scale").alias("_scale"))
    out = met.join(found, ["b_chrom", "b_start", "b_end"]).filter(F.col("a_scale") == F.col("_scale"))
    return out.select(*(F.col(f"a_{c}").alias(c) for c in ("chrom", "start", "end", "scale", "log_p")))


def mass_trim(regions: DataFrame, profile: DataFrame, lost: float = 0.05, chunk: int = CHUNK) -> DataFrame:
    """Regions cut at both ends to where half of `lost` of their mass lies outside at most, `src_start` and `src_end` being the ends before.

    The new start is the first position up to which more than that lies inside, the new end the last one from which on it does. Depths count in
    whole parts; a region without mass goes. A region's mass and the places of its units come from the profile's running mass: two ordered passes
    over runs and ends, by position and by mass, in which no region meets its runs, however long it is.
    """
    depth = F.floor("value").cast("long")
    own = F.col("m") * (F.col("end") - F.col("start") + 1)
    runs = profile.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), depth.alias("m")).filter("m > 0 and start <= end")
    runs = running(runs, ["chrom"], ["start"], own, "sum", "_upto", chunk=chunk).withColumn("before", F.col("_upto") - own)
    runs = settled(runs.select("chrom", F.struct("start", "end", "m", "before").alias("run")))

    def last_run(points: DataFrame, by: str) -> DataFrame:
        """points (chrom, at), distinct, with the last run whose `by` isn't beyond `at`."""
        asked = points.select("chrom", "at", F.lit(True).alias("_asked"), F.lit(None).cast(runs.schema["run"].dataType).alias("run"))
        rows = runs.select("chrom", F.col(f"run.{by}").alias("at"), F.lit(False).alias("_asked"), "run").unionByName(asked)
        return running(rows, ["chrom"], ["at", "_asked"], F.col("run"), "max", "found", chunk=chunk).filter("_asked").select("chrom", "at", "found")

    def looked_up(rows: DataFrame, first: Column, last: Column, by: str, told: Column, names: tuple[str, str]) -> DataFrame:
        points = rows.select("chrom", F.explode(F.array(first, last)).alias("at")).distinct()
        found = settled(last_run(points, by).select("chrom", "at", told.alias("_told")))
        for at, name in zip((first, last), names):
            side = found.select(F.col("chrom").alias("_c"), F.col("at").alias("_at"), F.col("_told").alias(name))
            rows = rows.join(side, (F.col("chrom") == F.col("_c")) & (at == F.col("_at"))).drop("_c", "_at")
        return rows

    mass = F.coalesce(F.col("found.before") + (F.least("at", "found.end") - F.col("found.start") + 1) * F.col("found.m"), F.lit(0).cast("long"))
    place = F.col("found.start") + F.floor((F.col("at") - F.col("found.before")) / F.col("found.m"))
    spots = regions.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    held = looked_up(spots, F.col("start") - 1, F.col("end"), "start", mass, ("_low", "_high")).filter("_high > _low")
    cut = F.floor((F.col("_high") - F.col("_low")) * F.lit(float(lost)) / 2).cast("long")
    held = settled(held.withColumns({"_first": F.col("_low") + cut, "_last": F.col("_high") - cut - 1}))
    ends = looked_up(held, F.col("_first"), F.col("_last"), "before", place.cast("long"), ("_from", "_to")).select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), "_from", "_to")
    met = regions.withColumnsRenamed({"start": "src_start", "end": "src_end"}).join(ends, (F.col("chrom") == F.col("_c")) & (F.col("src_start") == F.col("_s")) & (F.col("src_end") == F.col("_e")))
    return met.drop("_c", "_s", "_e").withColumnsRenamed({"_from": "start", "_to": "end"})
