"""Peak calling and its parts against the plain version, on seeded profiles."""

import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from terrane.operators import enrichment, intervals, multiscale, profile, reads, trimming
from terrane.plans import commands, params, peaks

SMALL = params.BROAD.but(scale_start=33, scale_end=130, bin_width=2, window=100, mappability_window=20, fragment=20, poisson_window=700, scaling_window=500, p_cutoff=0.5, q=0.9, tune_by=10, filter_length=False)


def made_reads(seed=4, l=3000):
    """Reads in heaps of several widths, some deep, on two chromosomes and one with next to nothing."""
    rng, rows = np.random.default_rng(seed), []
    for chrom in ("1", "2"):
        for k in range(14):
            centre, width, n = int(rng.integers(60, l - 60)), int(rng.choice([8, 40, 150])), int(rng.choice([20, 80, 300]))
            for at in np.clip(rng.normal(centre, width, n), 1, l).astype(int):
                rows.append(("chip", chrom, "FR"[int(rng.integers(0, 2))], int(at), "12M"))
        for sample, n in (("chip", 700), ("control", 900)):
            for at in rng.integers(1, l, n):
                rows.append((sample, chrom, "FR"[int(rng.integers(0, 2))], int(at), "12M"))
    rows += [("chip", "3", "F", 5, "12M"), ("control", "3", "R", 9, "12M"), ("chip", "M", "F", 5, "12M")]
    return rows


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(made_reads(), "sample string, chrom string, strand string, start int, cigar string")
    chip, control = peaks.signals(df, SMALL)
    return df, chip.cache(), control.cache()


def arrays(df, by=("chrom",)):
    runs = {}
    for r in df.collect():
        key = tuple(r[k] for k in by)
        runs.setdefault(key[0] if len(by) == 1 else key, []).append((r["start"], r["end"], r["value"]))
    return {k: plain.dense(v, max(e for _, e, _ in v)) for k, v in runs.items()}


@pytest.fixture(scope="module")
def flat(made):
    return arrays(made[1]), arrays(made[2])


@pytest.fixture(scope="module")
def spots(spark, flat):
    """Regions of many lengths, some to and behind the ends."""
    rng, rows = np.random.default_rng(7), set()
    for chrom, x in flat[0].items():
        for _ in range(60):
            s = int(rng.integers(1, max(2, len(x) - 3)))
            rows.add((chrom, s, s + int(rng.choice([1, 7, 40, 130, 400]))))
        rows |= {(chrom, max(1, len(x) - 12), len(x) - 1), (chrom, max(1, len(x) - 12), len(x) - 2), (chrom, 1, 30)}
    return sorted(rows), spark.createDataFrame(sorted(rows), "chrom string, start long, end long")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select("chrom", "start", "end", *columns).collect())


def expected(rows, f, *arrays_):
    out = []
    for chrom in sorted({r[0] for r in rows}):
        out += [(chrom, *r) for r in f([r[1:] for r in rows if r[0] == chrom], *(a[chrom] for a in arrays_))]
    return sorted(out)


@pytest.mark.parametrize("times", [1, 40])
def test_thresholds_and_depth_trims(spark, made, flat, spots, times):
    """Depths up to some tens, and up to several thousands."""
    rows, df = spots
    chip, x = profile.scaled(made[1], float(times)), {k: v * times for k, v in flat[0].items()}
    assert times == 1 or max(v.max() for v in x.values()) > 1000
    for first in (0, 1):
        got = {(r["chrom"], r["win"]): r["threshold"] for r in enrichment.poisson_windows(chip, 0.05, 700, first).collect()}
        want = {(c, (at - first) // 700): t for c, v in x.items() for at, _, t in plain.thresholds(v, 0.05, 700, first)}
        assert {k: t for k, t in got.items() if t} == {k: t for k, t in want.items() if t} and any(want.values())
    assert pairs(trimming.rd_trim(df, chip, 0.05, 700)) == expected(rows, lambda r, v: plain.rd_trim(r, v, 0.05, 700), x)
    kept = expected(rows, lambda r, v: plain.median_kept(r, v, 0.5, 700), x)
    assert pairs(trimming.median_filter_regions(df, chip, 0.5, 700)) == kept and 0 < len(kept) < len(rows)
    assert pairs(trimming.tune_boundaries(df, chip, 0.05, 700, 10)) == expected(rows, lambda r, v: plain.tune(r, v, 0.05, 700, 10), x)


def test_p_value_trims(spark, made, flat, spots):
    rows, df = spots
    _, chip, control = made
    x, y = flat
    half = {k: v / 2 for k, v in x.items()}
    for modified in (False, True):
        got = pairs(trimming.p_value_trim(df, chip, control, 20, modified))
        assert got == expected(rows, lambda r, v, w: plain.p_trim(r, v, w, 20, modified), x, y)
        got = pairs(trimming.p_value_trim(df, profile.scaled(chip, 0.5), control, 20, modified))
        assert got == expected(rows, lambda r, v, w: plain.p_trim(r, v, w, 20, modified), half, y)
    assert pairs(trimming.grid_trim(df, chip, control, 20, 10)) == expected(rows, lambda r, v, w: plain.grid(r, v, w, 20, 10), x, y)


def test_vicinity_p_values(spark, made, flat, spots):
    rows, df = spots
    _, chip, control = made
    x, y = flat
    inside = [r for r in rows if r[2] < len(x[r[0]]) - 1 and r[2] < len(y[r[0]]) - 1]
    df = spark.createDataFrame(inside, "chrom string, start long, end long")
    for norm, reach, peak, f in ((50, 1, False, plain.vicinity), (50, 3, True, plain.strongest), (500, 1, False, plain.vicinity)):
        got = {r[:3]: r[3] for r in pairs(enrichment.vicinity_p_values(df, chip, control, 20, norm, reach, peak), "log_p")}
        assert len(got) == len(inside)
        for c, s, e in inside:
            assert got[c, s, e] == pytest.approx(f(s, e, x[c], y[c], 20, norm, reach), abs=1e-6), (c, s, e, norm)


def test_summits_and_troughs(spark, made, flat, spots):
    rows, df = spots
    _, chip, control = made
    x, y = flat
    mapp = spark.createDataFrame([(c, k * 40 + 1, k * 40 + 40, 0.8 + k % 5 * 0.2) for c in "123" for k in range(80)], "chrom string, start long, end long, value double")
    m = arrays(mapp)
    for r in trimming.summits(df, chip, control).collect():
        c, s, e = r["chrom"], r["start"], r["end"]
        ok = e < len(x[c]) - 1 and e < len(y[c]) - 1
        want = plain.summit(s, e, x[c], y[c]) if ok else (0.0, 0.0, 0.0, 0.0, 0)
        assert r["inside"] == ok and (r["chip_mass"], r["chip_max"], r["summit"]) == (want[0], want[2], want[4]) and (r["control_mass"], r["control_max"]) == pytest.approx((want[1], want[3]))
    whole = [r for r in rows if r[2] < len(x[r[0]])]
    df = spark.createDataFrame(whole, "chrom string, start long, end long")
    for used, table in ((None, None), (m, mapp)):
        got = {r[:3]: r[3] for r in pairs(trimming.troughs(df, chip, table, 1.2), "trough")}
        assert got == {(c, s, e): plain.trough(s, e, x[c], used and used[c], 1.2) for c, s, e in whole}


@pytest.mark.parametrize("limit", [None, 0])
def test_regions_as_long_as_a_chromosome(spark, limit, monkeypatch):
    """Trims, greatest windows and troughs of one region of 60,000 runs and of parts of it, also by the plan for large inputs."""
    if limit is not None:
        monkeypatch.setattr("terrane.operators.chunked.PLAIN_BYTES", limit)
    rng, n = np.random.default_rng(5), 60_000
    x, y = (np.concatenate(([0.0], v)) for v in (rng.integers(0, 9, n) * (1 + (np.arange(n) // 9000) % 3), rng.integers(0, 4, n) * 0.75))
    chip, control = (spark.createDataFrame([("1", k, k, float(v)) for k, v in enumerate(z) if v or k == n], "chrom string, start long, end long, value double") for z in (x, y))
    rows = [("1", 1, n), ("1", 1, n), ("1", 500, n - 700), ("1", 20_000, 20_400), ("1", 20_000, n + 1)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "chrom string, start long, end long, n int")
    inside, whole = [r[1:] for r in rows[:4]], df.filter("n < 4")
    assert pairs(trimming.p_value_trim(df, chip, control, 20)) == sorted(("1", *r) for r in plain.p_trim(inside, x, y, 20))
    assert pairs(trimming.grid_trim(df, chip, control, 20)) == sorted(("1", *r) for r in plain.grid(inside, x, y, 20, 100))
    assert {r[1:] for r in pairs(trimming.troughs(whole, chip, None, 1.2), "trough")} == {(s, e, _trough(s, e, x)) for s, e in inside}
    got = {r[1:3]: r[3] for r in pairs(enrichment.vicinity_p_values(whole, chip, control, 20, 300, 1, True), "log_p")}
    for s, e in set(inside):
        width = lambda z, a, b: max((np.cumsum(z)[np.arange(a, max(a + 1, b - 300) + 1) + 299] - np.cumsum(z)[np.arange(a, max(a + 1, b - 300) + 1) - 1]).tolist())
        a, b = max(1, s - (e - s + 1)), min(n, e + (e - s + 1))
        assert got[s, e] == pytest.approx(plain.tail(width(np.pad(x, (0, 400)), s, e) / 20, max(1, width(np.pad(y, (0, 400)), a, b) / 20)), abs=1e-6)


def _trough(s, e, x):
    """plain.trough without mappability, by running minima of ranks."""
    found = plain.extrema(x[s : e + 1])
    highs = sorted(((p, h) for p, top, h in found if top), key=lambda m: (-m[1], m[0]))
    lows = sorted(((p, h) for p, top, h in found if not top), key=lambda m: (m[1], m[0]))
    rank, worst = np.full(e - s + 1, 10**9), 2 * len(highs) + len(lows)
    for k, (p, _) in enumerate(highs):
        rank[p] = k
    left, right = np.minimum.accumulate(rank), np.minimum.accumulate(rank[::-1])[::-1]
    best = min(range(len(lows)), key=lambda k: (min(worst, k + int(left[lows[k][0]]) + int(right[lows[k][0]])), k))
    return s + lows[best][0]


def test_filters_and_minima(spark, made, flat):
    _, chip, _ = made
    mapp = spark.createDataFrame([(c, k * 40 + 1, k * 40 + 40, 0.8 + k % 5 * 0.2) for c in "12" for k in range(60)], "chrom string, start long, end long, value double")
    m, ends = arrays(mapp), profile.lengths(chip)
    got = arrays(profile.mappable_median(chip, mapp, ends, 20, 1.2))
    for c, x in flat[0].items():
        want = plain.mappable(x, m[c], 20, 1.2) if c in m else np.maximum(plain.median(x, 10), x)
        assert np.array_equal(got[c][1 : len(want)], want[1 : len(got[c])])
    found = {(r["chrom"], r["scale"], r["start"], r["end"]) for r in multiscale.minima_regions(chip, ends, [5.06, 11.4, 38.4], 1.5).collect()}
    assert found == {(c, s, a, b) for c, x in flat[0].items() for s in (5.06, 11.4, 38.4) for a, b in plain.minima_regions(x, s, 1.5)} and len(found) > 20


def test_background(spark, made, flat):
    _, chip, _ = made
    got = arrays(enrichment.background(chip, 20, 4, 200, enough=5))
    assert {c: len(y) for c, y in got.items()} == {c: len(x) for c, x in flat[0].items()}
    for c, x in flat[0].items():
        assert np.allclose(got[c], plain.background(x, 20, 4, 200, enough=5)), c


@pytest.mark.parametrize("changes", [{}, {"bin_width": 1, "scale_start": 9, "scale_end": 30, "peak_mode": True, "trim_after_merge": True, "trough": True, "q": 5.0}, {"bin_width": 1, "scale_start": 8, "scale_end": 16, "window": 50, "trim_after_merge": True, "p_cutoff": None}, {"filter_length": True, "strand_share": 0.4}])
def test_calls(spark, made, flat, changes):
    df, chip, control = made
    p = SMALL.but(**changes)
    x, y = flat
    used = df.filter("sample = 'chip' and chrom <> 'M'")
    strands = arrays(reads.pileup(used, 20, stranded=True, keys=("chrom",)), ("chrom", "strand"))
    for c, v in x.items():
        for s in "FR":
            a = strands.get((c, s), np.zeros(1))
            strands[c, s] = np.pad(a, (0, max(0, len(v) - len(a))))
    counts = {r["chrom"]: (r["n_forward"], r["n_reverse"]) for r in reads.strand_counts(used).collect()}
    mapp = spark.createDataFrame([(c, k * 40 + 1, k * 40 + 40, 0.8 + k % 5 * 0.2) for c in "12" for k in range(60)], "chrom string, start long, end long, value double") if p.trough else None
    want = sorted(plain.call(x, y, strands, counts, p, arrays(mapp) if mapp else None))
    out = peaks.call(df, p, mapp).orderBy("chrom", "start")
    got = sorted((r["chrom"], r["start"], r["end"], r["summit"], r["trough"], r["chip_mass"], r["control_mass"], r["log_p"]) for r in out.collect())
    assert len(want) > 5 and [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:8] for w in want], atol=1e-6)
    assert all(r["fold_change"] == pytest.approx(r["chip_mass"] / (r["control_mass"] + 1)) for r in out.collect())
    q = {(w[0], w[1], w[2]): w[8] for w in want}
    ties = len({round(w[7], 9) for w in want}) < len(want)
    assert ties or all(r["log_q"] == pytest.approx(q[r["chrom"], r["start"], r["end"]], abs=1e-6) for r in out.collect())


def test_call_without_control(made, flat):
    """The background of the chip profile stands in for control."""
    df, x, p = made[0], flat[0], SMALL.but(bin_width=1, scale_start=8, scale_end=16, window=50)
    used = df.filter("sample = 'chip' and chrom <> 'M'")
    strands = arrays(reads.pileup(used, 20, stranded=True, keys=("chrom",)), ("chrom", "strand"))
    for c, v in x.items():
        for s in "FR":
            a = strands.get((c, s), np.zeros(1))
            strands[c, s] = np.pad(a, (0, max(0, len(v) - len(a))))
    counts = {r["chrom"]: (r["n_forward"], r["n_reverse"]) for r in reads.strand_counts(used).collect()}
    y = {c: plain.background(v, p.window, p.fragment, p.poisson_window) for c, v in x.items()}
    want = sorted(w[:8] for w in plain.call(x, y, strands, counts, p))
    got = sorted((r["chrom"], r["start"], r["end"], r["summit"], r["trough"], r["chip_mass"], r["control_mass"], r["log_p"]) for r in peaks.call(used, p, has_control=False).collect())
    assert len(want) > 3 and [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-6)


@pytest.mark.parametrize("changes", [{}, {"bin_width": 1, "scale_start": 9, "scale_end": 60}])
def test_scale_spectrum(made, flat, changes):
    p = SMALL.but(**changes)
    for chrom in ("1", "2"):
        got = commands.scale_spectrum(made[0], p, chrom).orderBy("scale_index").collect()
        want = plain.scale_spectrum(flat[0][chrom], flat[1][chrom], p)
        assert [(r["n_regions"], r["coverage"]) for r in got] == [w[1:] for w in want] and sum(w[1] for w in want) > 3
        assert [r["scale"] for r in got] == pytest.approx([w[0] for w in want])


def test_tracks_and_log_ratios(made, flat):
    df, _, _ = made
    tracks = {}
    for r in commands.decomposition_tracks(df.filter("chrom <> 'M'"), SMALL).collect():
        tracks.setdefault((r["chrom"], r["scale"]), []).append((r["start"] + 1, r["end"], r["value"]))
    assert len(tracks) == 3 * len(plain.scales(SMALL.scale_start, SMALL.scale_end, SMALL.scale_step))
    for (chrom, scale), runs in tracks.items():
        x = flat[0][chrom]
        assert np.array_equal(plain.dense(runs, len(x) - 1), plain.median(x, int(scale) // 2))
    got = arrays(commands.log_ratio_signal(df, SMALL))
    for chrom, z in got.items():
        x, y = (a[chrom][: len(z)] for a in flat)
        assert len(z) == min(len(flat[0][chrom]), len(flat[1][chrom]))
        assert np.allclose(z, [math.log(a / b) if a > 0 and b > 0 else 0.0 for a, b in zip(x, y)])


def test_mass_trim_of_long_and_empty_regions(spark):
    """A region over 10 million positions, whose runs no row may hold; one without mass, equal ones, one whose mass is one position."""
    runs = [("1", k * 1000 + 1, k * 1000 + 10, 3.7) for k in range(10_000)] + [("2", 50, 50, 1.0)]
    profile = spark.createDataFrame(runs, "chrom string, start long, end long, value double")
    rows = [("1", 1, 10_000_000, "a"), ("1", 1, 10_000_000, "b"), ("1", 11, 900, "none"), ("2", 1, 99, "one"), ("3", 1, 5, "absent")]
    got = {r["name"]: (r["start"], r["end"]) for r in trimming.mass_trim(spark.createDataFrame(rows, "chrom string, start long, end long, name string"), profile, 0.1).collect()}
    x = np.zeros(10_000_001, dtype=np.int64)
    for _, s, e, v in runs[:-1]:
        x[s : e + 1] = int(v)
    up, down = np.cumsum(x), np.cumsum(x[::-1])[::-1]
    cut = int(up[-1] * 0.1 / 2)
    want = (int(np.argmax(up > cut)), int(len(x) - 1 - np.argmax(down[::-1] > cut)))
    assert got == {"a": want, "b": want, "one": (50, 50)}
    assert trimming.mass_trim(spark.createDataFrame([], "chrom string, start long, end long"), profile).count() == 0
    assert trimming.mass_trim(spark.createDataFrame(rows, "chrom string, start long, end long, name string"), profile.limit(0)).count() == 0


def test_association_of_lists(spark):
    rows = [("1", 1, 10, "x"), ("1", 5, 20, "x"), ("1", 21, 30, "x"), ("1", 8, 25, "y"), ("2", 8, 25, "z"), ("1", 40, 41, None)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, list string")
    got = sorted(tuple(r)[:5] for r in intervals.association(df, "list").collect())
    assert got == [("x", "x", 30, 30, 30), ("x", "y", 18, 30, 18), ("y", "x", 18, 18, 30), ("y", "y", 18, 18, 18), ("z", "z", 18, 18, 18)]
    assert intervals.association(df.limit(0), "list").count() == 0


def test_significant_small_scale_inside_an_insignificant_large_one(spark):
    """Worked by hand: of the merged region 100-400 the largest scale isn't significant, the middle one has 100-200 and 260-300, of which the first is."""
    rows = [("1", 1.0, 120, 140), ("1", 2.0, 100, 200), ("1", 2.0, 260, 300), ("1", 3.0, 180, 400), ("1", 1.0, 900, 950), ("1", 3.0, 2000, 2100), ("1", 1.0, 2010, 2020), ("2", 2.0, 5, 6)]
    df = spark.createDataFrame(rows, "chrom string, scale double, start long, end long")
    log_p = {(1.0, 120): -9.0, (2.0, 100): -5.0, (2.0, 260): -0.1, (3.0, 100): -0.5, (1.0, 900): -9.0, (2.0, 900): -9.0, (3.0, 900): -9.0, (3.0, 2000): -4.0, (1.0, 2010): -0.2, (2.0, 2010): -0.2, (2.0, 5): -0.1, (3.0, 5): -0.1}
    known = spark.createDataFrame([(*k, v) for k, v in log_p.items()], "scale double, start long, log_p double")
    out = trimming.merge_by_significance(df, lambda r: r.join(known, ["scale", "start"]), 0.05)
    got = sorted((r["chrom"], r["start"], r["end"], r["scale"]) for r in out.collect())
    assert math.log(0.05) > -4.0
    assert got == [("1", 100, 200, 2.0), ("1", 260, 300, 2.0), ("1", 900, 950, 3.0), ("1", 2000, 2100, 3.0)]
    assert trimming.merge_by_significance(df.limit(0), lambda r: r.withColumn("log_p", F.lit(0.0)), 0.05).count() == 0
