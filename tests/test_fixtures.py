"""Hand-sized examples with results worked out from the semantics."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import sequence, stats
from terrane.operators import chunked, enrichment, intervals, multiscale, profile, reads, trimming
from terrane.sources import profiles, sinks
from terrane.sources import reads as sources
from terrane.sources import regions as region_files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def sam(spark):
    lines = ["@HD\tVN:1.6", "r1\t0\tchr1\t101\t37\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII", "r2\t16\tchr1\t104\t37\t5M2D5M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII"]
    lines += [lines[1].replace("r1", f"r{k}", 1) for k in (4, 5)]
    return sources.parse_sam(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_reads(sam):
    assert rows(sam, "chrom", "strand", "start", "cigar") == [("1", "F", 101, "10M")] * 3 + [("1", "R", 104, "5M2D5M")]
    two = reads.remove_duplicates(sam, 2)
    assert two.count() == 3
    assert rows(reads.pileup(two), "start", "end", "value") == [(101, 103, 2.0), (104, 108, 3.0), (109, 110, 2.0), (111, 115, 1.0)]
    assert rows(reads.pileup(two, 20), "start", "end", "value") == [(96, 100, 1.0), (101, 115, 3.0), (116, 120, 2.0)]


@pytest.fixture(scope="module")
def ab(spark):
    schema = "chrom string, start long, end long, strand string"
    a = spark.createDataFrame([("1", 10, 20, "+"), ("1", 18, 30, "+"), ("1", 31, 40, "-"), ("1", 50, 60, "+"), ("2", 5, 9, "+")], schema)
    return a, spark.createDataFrame([("1", 15, 19, "+"), ("1", 35, 52, "+"), ("3", 1, 9, "+")], schema)


def test_intervals(ab):
    a, b = ab
    merged = lambda gap: rows(intervals.merge(a, gap), "chrom", "start", "end")
    assert merged(0) == merged(-2) == [("1", 10, 30), ("1", 31, 40), ("1", 50, 60), ("2", 5, 9)]
    assert merged(1) == [("1", 10, 40), ("1", 50, 60), ("2", 5, 9)]
    assert merged(10) == [("1", 10, 60), ("2", 5, 9)]
    assert rows(intervals.intersect(a, b), "start", "end") == [(15, 19), (18, 19), (35, 40), (50, 52)]
    assert rows(intervals.exclude(a, b), "chrom", "start", "end") == [("2", 5, 9)]
    assert rows(intervals.subtract(a, b), "chrom", "start", "end") == [("1", 10, 14), ("1", 20, 20), ("1", 20, 30), ("1", 31, 34), ("1", 53, 60), ("2", 5, 9)]
    assert intervals.coverage(a).first()[0] == 50
    assert rows(intervals.nearest_distance(a, b), "chrom", "start", "distance") == [("1", 10, 0), ("1", 18, 0), ("1", 31, 0), ("1", 50, 0), ("2", 5, intervals.FAR)]
    assert rows(intervals.nearest_distance(b, a.filter("start > 40")), "chrom", "start", "distance") == [("1", 15, 31), ("1", 35, 0), ("3", 1, intervals.FAR)]
    assert round(intervals.nucleotide_overlap(a, b).first()[0], 6) == 0.390244


def test_signal(spark):
    x = spark.createDataFrame([("1", k + 1, float(v)) for k, v in enumerate([1, 1, 3, 3, 5, 2, 2, 4, 0])], "chrom string, pos long, value double")
    runs = profile.runs_of(x)
    ends = profile.lengths(runs)
    assert [r[1] for r in rows(profile.positions(profile.median_filtered(runs, ends, 2)), "pos", "value")] == [1, 1, 3, 3, 3, 2, 2, 2, 4]
    track = runs.withColumn("scale", F.lit(1.0))
    assert rows(multiscale.extrema(track, ends), "pos", "kind") == [(0, "MIN"), (5, "MAX"), (7, "MIN"), (8, "MAX")]
    assert rows(profile.bedgraph(runs, ends), "start", "end", "value") == [(0, 2, 1.0), (2, 4, 3.0), (4, 5, 5.0), (5, 7, 2.0), (7, 8, 4.0), (8, 9, 0.0)]


def test_poisson_threshold_of_deep_windows(spark):
    for rate in (999.0, 1000.0, 3990.5, 4200.0, 25000.0, 1.5e6):
        low = int(rate - 12 * math.sqrt(rate))
        total, t = 0.0, low
        while total <= 0.95:
            total += math.exp(t * math.log(rate) - rate - math.lgamma(t + 1))
            t += 1
        assert stats.poisson_limit(rate, 0.05, 2**31 - 1) == t - 1
    assert stats.poisson_limit(25000.0, 0.05, 25000) == 0
    deep = spark.createDataFrame([("1", 1, 100, 1.0), ("1", 101, 125, 2e6), ("1", 126, 2000, 1.0)], "chrom string, start long, end long, value double")
    spots = spark.createDataFrame([("1", 50, 200)], "chrom string, start long, end long")
    assert rows(trimming.rd_trim(spots, deep, 0.05, 2000), "start", "end") == [(101, 125)]


def test_statistics(spark):
    assert stats.binomial_log_tail(2, 10) == pytest.approx(math.log(56 / 1024))
    assert stats.poisson_limit(2.0, 0.05, 10) == 5
    q = stats.benjamini_hochberg(spark.createDataFrame([("1", k, k, math.log(p)) for k, p in enumerate([0.01, 0.02, 0.04, 0.5])], "chrom string, start long, end long, log_p double"))
    assert [round(math.exp(r[1]), 6) for r in rows(q, "start", "log_q")] == [0.04, 0.04, 0.053333, 0.5]
    pairs = spark.createDataFrame([(10.0, 20.0), (20.0, 50.0)], "x double, y double")
    assert tuple(pairs.agg(profile.slope_through_origin(F.col("x"), F.col("y")), profile.slope_with_offset(F.col("x"), F.col("y"))).first()) == pytest.approx((2.4, 3.0))
    w = spark.createDataFrame([(200, 0.001, 0.002, 0.90), (250, 0.004, 0.006, 0.965), (300, 0.012, 0.009, 0.975), (350, 0.0, 0.0, 1.0)], "l_win int, fc_fpr double, p_fpr double, sensitivity double")
    assert enrichment.select_window_length(w).first()[0] == 300


def test_equal_p_values_are_dealt_out(spark):
    """A million regions of one p-value: none of the ranges that rank them is much larger than the others."""
    x = spark.range(1_000_000).select(F.lit("1").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"), F.lit(0.0).alias("log_p"))
    ranked = stats.benjamini_hochberg(x)
    n = x.repartitionByRange("log_p", "chrom", "start", "end").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert n < 600_000
    row = ranked.agg(F.countDistinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_if(F.col("rank") != F.col("start") + 1).alias("odd")).first()
    assert tuple(row) == (1_000_000, 1, 1_000_000, 0)


def test_windows_of_long_sequences(spark):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("ACGT"), 70_000))
    s = spark.createDataFrame([("c", text), ("d", "ACG"), ("e", "AC"), ("f", "")], "chrom string, seq string")
    got = {(r["chrom"], r["offset"]): r["window"] for r in sequence.windows(s, 3).collect()}
    assert got == {("c", k): text[k : k + 3] for k in range(69_998)} | {("d", 0): "ACG"}
    assert rows(sequence.fragments(s, 2).filter("chrom = 'd'"), "strand", "offset", "fragment") == [("F", 0, "AC"), ("R", 0, "CG")]


def test_sequence(spark):
    s = spark.createDataFrame([("c", "AACGTN")], "chrom string, seq string")
    assert s.select(sequence.reverse_complement(F.col("seq"))).first()[0] == "NACGTT"
    assert [r[0] for r in rows(sequence.fragments(s, 3).filter("strand = 'F'"), "fragment")] == ["AAC", "ACG", "CGT"]


def test_large_inputs_give_the_same(spark):
    """The chunked forms agree with plain windows."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"c{int(c)}", int(p), float(v)) for c, p, v in zip(rng.integers(0, 3, 400), rng.integers(0, 900, 400), rng.normal(size=400).round(3))], "chrom string, pos long, v double").dropDuplicates(["chrom", "pos"])
    for kind in ("sum", "max", "min"):
        for inclusive in (True, False):
            f = lambda limit: sorted((r[0], r[1], None if r[2] is None else round(r[2], 6)) for r in chunked.running(df, ["chrom"], ["pos"], F.col("v"), kind, "x", inclusive, chunk=50, limit=limit).select("chrom", "pos", "x").collect())
            assert f(0) == f(1 << 40)
    g = lambda limit: rows(chunked.neighbours(df, ["chrom"], ["pos"], ["v"], chunk=50, limit=limit).fillna(-9e9), "chrom", "pos", "prev_v", "next_v")
    assert g(0) == g(1 << 40)


def test_runs_clear_their_folders(spark, tmp_path, monkeypatch):
    import os

    @chunked.tidied
    def outer(n, fail=False):
        inner = chunked.tidied(lambda: chunked.settled(spark.range(n)))()
        if fail:
            raise ValueError("no")
        return chunked.settled(inner).filter("id > 1")

    monkeypatch.setattr(chunked, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    assert outer(5).count() == 3
    assert [n.split("-")[0] for n in os.listdir(tmp_path / "shared" / "terrane")] == ["outer"]
    with pytest.raises(ValueError):
        outer(5, True)
    assert len(os.listdir(tmp_path / "shared" / "terrane")) == 1


def test_shared_folder(monkeypatch):
    class Session:
        def __init__(self, master, named=None):
            self.sparkContext = self
            self.master, self.conf = master, self
            self.get = lambda key, default=None: named

        def getConf(self):
            return self

    assert chunked.shared_dir(Session("yarn", "hdfs://x/")) == "hdfs://x"
    assert chunked.shared_dir(Session("local[8]")).startswith("file:///")
    with pytest.raises(ValueError):
        chunked.shared_dir(Session("spark://host:7077"))


def test_sliding_median():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, half = rng.integers(-1, 9, rng.integers(1, 60)).astype(float), int(rng.integers(0, 12))
        for skip in (None, -1):
            want = []
            for i in range(len(x)):
                w = sorted(v for v in x[max(0, i - half) : i + half + 1] if v != skip)
                want.append(w[len(w) // 2] if w else 0)
            assert profile.sliding_median(x, half, skip).tolist() == want


def test_region_extrema(spark):
    """Sentinels of alternating kind at a region's ends; a region with one extremum has none."""
    chip = spark.createDataFrame([("1", 101, 102, 2.0), ("1", 103, 103, 1.0), ("1", 104, 104, 3.0), ("1", 301, 301, 4.0)], "chrom string, start long, end long, value double")
    spots = spark.createDataFrame([("1", 100, 105), ("1", 300, 302), ("2", 1, 9)], "chrom string, start long, end long")
    got = rows(trimming.region_extrema(spots, chip), "start", "pos", "kind", "height")
    assert sorted(got) == [(100, 0, "MIN", 0.0), (100, 2, "MAX", 2.0), (100, 3, "MIN", 1.0), (100, 4, "MAX", 3.0), (100, 5, "MIN", 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "chr1.bin").write_bytes(struct.pack("<i", 4) + bytes([0, 100, 100, 200, 0]))
    assert rows(profiles.read_profiles(spark, str(tmp_path), "uint8", 0.01), "chrom", "start", "end", "value") == [("1", 2, 3, 1.0), ("1", 4, 4, 2.0)]
    (tmp_path / "a.fa").write_text(">chr1\nACG\nT\n>two\nA\n>x.y\nGGC\n")
    assert rows(profiles.read_fasta(spark, str(tmp_path / "a.fa")), "chrom", "seq") == [("1", "ACGT"), ("x_y", "GGC")]
    lines = spark.createDataFrame([("1\t0\t4\t1", 0), ("1\t2\t6\t2", 1)], "value string, n int")
    assert rows(region_files.parse_bedgraph(lines, "n"), "start", "end", "value") == [(1, 2, 1.0), (3, 4, 2.0), (5, 6, 2.0)]
    assert sinks.wav_bytes([np.ones(10)])[:4] == b"RIFF"


def test_binary_files(spark, tmp_path, monkeypatch):
    """Files byte by byte, in ranges of every size; files without padding or end; lengths; failed and second writes."""
    runs = [("a", 3, 4, 1.5), ("a", 5, 5, -2.0), ("b", 1, 9, 7.0), ("b", 12, 30, 1.0)]
    frame = lambda r: spark.createDataFrame(r, "chrom string, start long, end long, value double")
    ends = spark.createDataFrame([("a", 6), ("b", 20), ("c", 3)], "chrom string, l long")
    path = f"file://{tmp_path}/p"
    profiles.write_profiles(frame(runs), ends, path, "double")
    assert (tmp_path / "p/a.bin").read_bytes() == struct.pack("<i7d", 6, 0, 0, 1.5, 1.5, -2, 0, 0) and (tmp_path / "p/c.bin").read_bytes() == struct.pack("<i4d", 3, 0, 0, 0, 0)
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["a.bin", "b.bin", "c.bin"]
    want = [("a", 3, 4, 1.5), ("a", 5, 5, -2.0), ("b", 1, 9, 7.0), ("b", 12, 20, 1.0)]
    for size in (8, 24, 40, 1 << 20):
        back = profiles.read_profiles(spark, path, "double", range_bytes=size)
        assert rows(profile.compact(back), "chrom", "start", "end", "value") == want
    assert rows(profiles.read_lengths(spark, path, spark.createDataFrame([("a",), ("z",)], "chrom string")), "chrom", "l") == [("a", 6), ("z", 0)]
    with pytest.raises(Exception, match="overlap"):
        profiles.write_profiles(frame([("a", 1, 3, 1.0), ("a", 3, 4, 2.0)]), ends, path, "double")
    assert rows(profile.compact(profiles.read_profiles(spark, path, "double")), "chrom", "start", "end", "value") == want
    profiles.write_profiles(frame([("c", 2, 2, 200.0)]), ends.filter("chrom = 'c'"), path, "uint8")  # takes the place of the file before
    assert (tmp_path / "p/c.bin").read_bytes() == struct.pack("<i4B", 3, 0, 200, 0, 0)
    (tmp_path / "cut.bin").write_bytes(struct.pack("<i2d", 9, 1, 1))
    assert rows(profiles.read_profiles(spark, str(tmp_path), "double"), "chrom", "start", "end", "value") == [("cut", 1, 2, 1.0)]
    assert profiles.read_profiles(spark, f"{tmp_path}/none", "double").count() == 0
    monkeypatch.setattr(profiles, "BLOCK_VALUES", 3)
    profiles.write_sequences(spark.createDataFrame([("s", "ACGTACGTA"), ("e", "")], "chrom string, seq string"), f"{tmp_path}/s")
    assert (tmp_path / "s/s.bin").read_bytes() == struct.pack("<i", 9) + b"ACGTACGTA"
    assert rows(profiles.read_sequences(spark, f"{tmp_path}/s"), "chrom", "seq") == [("e", ""), ("s", "ACGTACGTA")]


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_range_sums(spark, monkeypatch, block):
    """Sums from the cumulative profile against sums position by position, runs that overlap and regions across blocks included."""
    monkeypatch.setattr(enrichment, "BLOCK", block)
    rng = np.random.default_rng(block)
    dense = {(c, n): np.zeros(120) for c in "xyz" for n in "ab"}
    runs = {"a": [], "b": []}
    for n, found in runs.items():
        for _ in range(40):
            c, s, size, v = "xy"[rng.integers(0, 2)], int(rng.integers(1, 80)), int(rng.integers(1, 30)), float(rng.integers(0, 40)) / 4
            found.append((c, s, s + size - 1, v))
            dense[c, n][s : s + size] += np.floor(v) if n == "a" else v
    regions = [("xyz"[rng.integers(0, 3)], int(s := rng.integers(1, 90)), int(s + rng.integers(0, 29))) for _ in range(60)] + [("x", 5, 5), ("x", 5, 4), ("y", 0, 110)]
    frames = [spark.createDataFrame(r, "chrom string, start long, end long, value double") for r in (runs["a"], runs["b"])]
    df = spark.createDataFrame(regions, "chrom string, start long, end long")
    for skip in (False, True):
        got = enrichment.range_sums(df, [("a", frames[0], True), ("b", frames[1], False)], skip_first=skip).collect()
        assert len(got) == len(regions)
        for r in got:
            for n in "ab":
                assert abs(r[n] - dense[r["chrom"], n][r["start"] + skip : r["end"] + 1].sum()) < 1e-9


def test_other_forms(spark, tmp_path):
    from terrane.plans import commands

    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    two = region_files.parse_bed_with_sequence(lines("chr1\t4\t9\tn\t0\t-\tACGT\tAGGT"), 2)
    assert rows(two, "chrom", "start", "end", "ancestral", "derived") == [("1", 4, 9, "ACGT", "AGGT")]
    stats_ = region_files.parse_window_stats(lines("200\t0.1\t0.2\t0.3\t0.4\t0.9"))
    assert rows(stats_, "l_win", "fc_fnr", "p_fpr", "sensitivity") == [(200, 0.1, 0.4, 0.9)]
    r = spark.createDataFrame([("1", 5, 9, 3.0), ("1", 1, 30, 1.0), ("1", 2, 4, 2.0)], "chrom string, start long, end long, score double")
    assert [x["start"] for x in intervals.in_order(r, "length", True).collect()] == [1, 5, 2] and [x["start"] for x in intervals.in_order(r, "score").collect()] == [1, 2, 5]
    tracks = spark.createDataFrame([("1", 8.0, 0, 4, 1.0), ("1", 8.0, 4, 9, 3.0), ("1", 16.0, 2, 9, 2.0)], "chrom string, scale double, start long, end long, value double")
    sound = commands.sonified(tracks, "1", 2, 8)
    assert sound[:4] == b"RIFF" and len(sound) == 44 + 2 * 7
    (tmp_path / "chr2.bin").write_bytes(struct.pack("<i", 5) + b"ACGTN")
    assert rows(profiles.read_sequences(spark, str(tmp_path)), "chrom", "seq") == [("2", "ACGTN")]
    with pytest.raises(Exception, match="region starts behind its end"):
        intervals.valid(r.withColumn("start", F.col("end") + 1)).collect()


def test_streaming(spark, tmp_path):
    from terrane.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("chr1\t9\t19\tx\t0\t+\nchr2\t4\t9\ty\t0\t-\n")
    q = ingest.pool_reads(ingest.stream_reads(spark, str(tmp_path / "in"), "BED6"), str(tmp_path / "out"), str(tmp_path / "ck"), "chip")
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "chrom", "start", "cigar") == [(1, 10, "10M"), (2, 5, "5M")]


def test_binomial_tails():
    """Against sums of whole numbers; time doesn't follow n."""
    for n in [*range(40), 257, 1000]:
        for k in range(-1, n + 2, max(1, n // 30)):
            want = math.log(sum(math.comb(n, i) for i in range(min(k, n) + 1))) - n * math.log(2) if k >= 0 else stats.LOG_ZERO
            assert abs(stats.binomial_log_tail(k, n) - want) < 1e-9
            assert k < 0 or abs(stats.binomial_log_tail(k, n, math.log(0.3)) - want - n * math.log(0.6)) < 1e-9
    assert stats.binomial_log_tail(4_900_000, 10**7) == pytest.approx(-2005.17956, abs=1e-4)


def test_log_factorial_column(spark):
    x = spark.createDataFrame([(n,) for n in (None, -1, 0, 1, 2, 15, 16, 17, 170, 10**9)], "n long")
    got = {r["n"]: r["f"] for r in x.select("n", stats.log_factorial(F.col("n")).alias("f")).collect()}
    assert got.pop(None) is None and got.pop(-1) is None and all(abs(v - math.lgamma(n + 1)) <= 1e-9 * max(1, v) for n, v in got.items())


def test_orders_over_all_rows(spark):
    """Ranks and sums over one order, with a hot value that no range holds alone."""
    x = spark.createDataFrame([(5, k % 3) for k in range(600)] + [(k % 7, 9) for k in range(50)], "a int, b int").repartition(5)
    ranks = [(r["rank"], r["a"], r["b"]) for r in chunked.ranked_overall(x, ["a"], "rank").collect()]
    assert sorted(r[0] for r in ranks) == list(range(1, 651)) and [r[1] for r in sorted(ranks)] == sorted(r[1] for r in ranks)
    sums = sorted((r["a"], r["held"], r["b"], r["all"]) for r in chunked.summed_overall(x, ["a"], F.col("b"), "held", "all").collect())
    held = 0
    for a, before, b, everything in sums:
        assert before <= 599 // 3 * 3 + 450 + 600 and everything == sum(r[2] for r in sums)
    for a, before, b, _ in sorted(sums, key=lambda r: (r[0], r[1])):
        assert before == held or b == 0
        held = before + b


def test_subtract(spark):
    a = spark.createDataFrame([("1", 1, 10, "p"), ("1", 1, 10, "p"), ("1", 5, 6, "q"), ("2", 3, 4, "r"), (None, 1, 2, "s"), ("1", 20, 30, "t")], "chrom string, start long, end long, name string")
    b = spark.createDataFrame([("1", 3, 4), ("1", 4, 6), ("1", 9, 25), ("3", 1, 9), (None, 1, 2)], "chrom string, start long, end long")
    got = sorted(((r["name"], r["chrom"], r["start"], r["end"]) for r in intervals.subtract(a, b).collect()), key=repr)
    assert got == sorted([("p", "1", 1, 2), ("p", "1", 7, 8), ("p", "1", 1, 2), ("p", "1", 7, 8), ("r", "2", 3, 4), ("s", None, 1, 2), ("t", "1", 26, 30)], key=repr)
    assert intervals.subtract(a, b.limit(0)).count() == a.count()
