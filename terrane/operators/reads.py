"""Read-level operators: CIGAR blocks, deduplication, counts, pileup, fragment length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunked import CHUNK, neighbours, running

_OPS = r"(\d+)([MIDNSHPX=])"
BLOCKS = "array<struct<start:bigint,end:bigint>>"


def cigar_ok(cigar: Column) -> Column:
    """Digits and operations take turns, and nothing else occurs."""
    return cigar.rlike(r"^[0-9]*([MIDNSHPX=][0-9]+)*[MIDNSHPX=]?$")


def cigar_spliced(cigar: Column) -> Column:
    return cigar.rlike(r"[IDNSHPX=]")


def cigar_operations(cigar: Column) -> Column:
    """array<struct<length, op>> in order."""
    n, op = F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(1)), F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("long").alias("length"), b.alias("op")))


def cigar_blocks(start: Column, cigar: Column) -> Column:
    """The M blocks as array<struct<start, end>>. D, M and N move along the genome; =, X, S, H, I and P don't."""
    empty = F.struct(start.cast("long").alias("at"), F.array().cast(BLOCKS).alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        moved = F.when(x["op"].isin("M", "D", "N"), acc["at"] + x["length"]).otherwise(acc["at"])
        block = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + x["length"] - 1).alias("end")))
        return F.struct(moved.alias("at"), F.when(x["op"] == "M", F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"))

    whole = F.substring(cigar, F.lit(1), F.length(cigar) - 1).cast("long")  # of a single M, as most are
    single = F.array(F.struct(start.cast("long").alias("start"), (start + whole - 1).cast("long").alias("end")))
    return F.when(cigar.rlike(r"^[0-9]+M$"), single).otherwise(F.aggregate(cigar_operations(cigar), empty, step, lambda acc: acc["blocks"]))


def read_span(cigar: Column, moving: tuple[str, ...] = ("S", "M", "I")) -> Column:
    """Bases of the read that its CIGAR moves over."""
    return F.aggregate(cigar_operations(cigar), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["op"].isin(*moving), x["length"]).otherwise(0))


def sort_reads(reads: DataFrame) -> DataFrame:
    """Dealt by ranges of (chrom, start) and sorted in each, so long chromosomes spread."""
    return reads.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "strand", "cigar")


def remove_duplicates(reads: DataFrame, most: int) -> DataFrame:
    """At most `most` reads for each start, whatever their strand and CIGAR; of equal starts the first by (strand, cigar)."""
    keys = [k for k in ("sample", "chrom", "start") if k in reads.columns]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("strand", "cigar"))
    return reads.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")


def count_reads(reads: DataFrame) -> DataFrame:
    """Reads by chromosome, with a `Total` row."""
    out = reads.rollup("chrom").agg(F.count("*").alias("n_reads"), F.grouping("chrom").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "Total").otherwise(F.col("chrom")).alias("chrom"), "n_reads")


def strand_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("chrom").agg(F.count_if(F.col("strand") == "F").alias("n_forward"), F.count_if(F.col("strand") == "R").alias("n_reverse"))


def profile_length_bound(reads: DataFrame, extension: int = 0) -> DataFrame:
    return reads.groupBy("chrom").agg((F.max("start") + 1000 + max(extension, 0)).cast("long").alias("l_signal"))


def fragments(reads: DataFrame, extension: int = 0) -> DataFrame:
    """Stretches (start, end) that the reads put on the signal.

    Without extension the M blocks; with it, `extension` positions from the 5' end, where a start below 0 becomes 1. Reads whose CIGAR
    isn't valid or has no M block put nothing.
    """
    blocks = reads.filter(cigar_ok(F.col("cigar"))).withColumn("_b", cigar_blocks(F.col("start"), F.col("cigar"))).filter(F.size("_b") > 0)
    keep = [c for c in ("sample", "chrom", "strand") if c in reads.columns]
    if extension <= 0:
        return blocks.select(*keep, F.explode("_b").alias("_x")).select(*keep, "_x.start", "_x.end")
    leftmost, rightmost = F.array_min(F.transform("_b", lambda x: x["start"])), F.array_max(F.transform("_b", lambda x: x["end"]))
    begin = F.when(F.col("strand") == "F", leftmost).otherwise(rightmost - extension + 1)
    return blocks.select(*keep, F.when(begin < 0, F.lit(1)).otherwise(begin).cast("long").alias("start"), (begin + extension - 1).cast("long").alias("end")).filter("end >= start")


def mapped_bases(reads: DataFrame) -> DataFrame:
    return fragments(reads).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n_bases"))


def reads_per_window(reads: DataFrame, window: int = 1_000_000) -> DataFrame:
    return reads.groupBy("chrom", F.floor(F.col("start") / window).cast("long").alias("window")).agg(F.count("*").alias("n_reads"))


def pileup(reads: DataFrame, extension: int = 0, stranded: bool = False, keys: tuple[str, ...] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Depth as runs (keys, start, end, value) of equal value above 0.

    Every stretch adds 1 at its start and takes it back behind its end; sums by position are combined before the shuffle, and a
    two-level running sum turns them into depth.
    """
    keys = list(keys or [k for k in ("sample", "chrom") if k in reads.columns]) + (["strand"] if stranded else [])
    return depth(fragments(reads, extension), keys, chunk)


def depth(stretches: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))))
    steps = stretches.select(*keys, ends.alias("_e")).groupBy(*keys, F.col("_e.pos").alias("pos")).agg(F.sum("_e.d").alias("d")).filter("d <> 0")
    level = running(steps, keys, ["pos"], F.col("d"), "sum", "value", chunk=chunk)
    runs = neighbours(level, keys, ["pos"], ["pos"], chunk=chunk, previous=False).filter("value > 0")
    return runs.select(*keys, F.col("pos").alias("start"), (F.col("next_pos") - 1).alias("end"), F.col("value").cast("double").alias("value"))


def signal_length(profile: DataFrame) -> DataFrame:
    """Last position with a value above 0, by chromosome."""
    return profile.filter("value > 0").groupBy("chrom").agg(F.max("end").alias("l_signal"))


def _presence(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct starts of forward reads, and of reverse reads start plus the length of the first M block."""
    forward = reads.filter("strand = 'F'").select("chrom", F.col("start").cast("long").alias("pos")).distinct()
    first = F.regexp_extract("cigar", r"(\d+)M", 1).try_cast("long")
    reverse = reads.filter("strand = 'R'").select("chrom", (F.col("start") + first).alias("pos")).filter("pos is not null").distinct()
    return forward, reverse


def _banded(f: DataFrame, r: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs with low <= r.pos - f.pos <= high: positions meet in cells as wide as the band."""
    width = max(1, high - low + 1)
    left = f.withColumn("_c", F.explode(F.sequence(F.floor((F.col("pos") + low) / width), F.floor((F.col("pos") + high) / width))))
    right = r.select(F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), *[F.col(c).alias(f"_{c}") for c in r.columns if c not in ("chrom", "pos")]).withColumn("_rc", F.floor(F.col("_pos") / width))
    d = F.col("_pos") - F.col("pos")
    return left.join(right, (F.col("chrom") == F.col("_chrom")) & (F.col("_c") == F.col("_rc")) & d.between(low, high)).withColumn("separation", d.cast("long"))


def fragment_length_scan(reads: DataFrame, low: int, high: int) -> DataFrame:
    """(separation, n): positions where a forward start meets a reverse end at each separation, 0 included."""
    f, r = _presence(reads)
    found = _banded(f, r, low, high).groupBy("separation").agg(F.count("*").alias("n"))
    every = reads.sparkSession.range(low, high + 1).withColumnRenamed("id", "separation")
    return every.join(F.broadcast(found), "separation", "left").select("separation", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fragment_length(scan: DataFrame, mode: str = "min") -> DataFrame:
    """The first separation with the least count, or the greatest for mode="max"."""
    order = F.struct("n", "separation") if mode == "min" else F.struct(-F.col("n"), "separation")
    return scan.agg(F.min_by("separation", order).alias("fragment_length"))


def cross_correlation(reads: DataFrame, chrom: str, low: int, high: int) -> DataFrame:
    """(separation, product): sum over positions of forward depth times reverse depth `separation` further, of 5' ends."""
    ends = fragments(reads.filter(F.col("chrom") == chrom), 1).groupBy("chrom", "strand", F.col("start").alias("pos")).agg(F.count("*").alias("n"))
    f, r = ends.filter("strand = 'F'").drop("strand"), ends.filter("strand = 'R'").drop("strand")
    found = _banded(f, r, low, high).groupBy("separation").agg(F.sum(F.col("n") * F.col("_n")).alias("product"))
    every = reads.sparkSession.range(low, high + 1).withColumnRenamed("id", "separation")
    return every.join(F.broadcast(found), "separation", "left").select("separation", F.coalesce("product", F.lit(0)).cast("long").alias("product"))


def mappable_reads(reads: DataFrame, mappability: DataFrame, most: float = 1.05) -> DataFrame:
    """Reads whose mean mappability over [start, start + length of the first M block] is below `most`; uncovered positions are 0."""
    from .overlap import overlap_join

    first = F.regexp_extract("cigar", r"(\d+)M", 1).try_cast("long")
    placed = reads.withColumn("_len", first).filter("_len is not null").withColumn("end", F.col("start") + F.col("_len"))
    spots = placed.select("chrom", "start", "end").distinct()
    mass = overlap_join(spots, mappability).groupBy(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end")).agg(F.sum(F.col("b_value") * (F.col("ol_end") - F.col("ol_start") + 1)).alias("_mass"))
    joined = placed.join(mass, ["chrom", "start", "end"], "left")
    return joined.filter(F.coalesce("_mass", F.lit(0.0)) / (F.col("end") - F.col("start") + 1) < most).select(*reads.columns)


def fragment_length_scan_mappable(reads: DataFrame, mappability: DataFrame, low: int, high: int, most: float = 1.05) -> DataFrame:
    """As fragment_length_scan over mappable reads, but a position counts if either end is there (|F| + |R| - |F and R|), as long as both stay inside the chromosome's bound.

    All positions count at every separation but for those within `high` of an end, so only these are listed by separation.
    """
    f, r = _presence(mappable_reads(reads, mappability, most))
    length = profile_length_bound(reads)
    f, r = f.join(length, "chrom").filter("pos >= 1"), r.join(length, "chrom").filter("pos < l_signal")
    total = f.select("chrom").union(r.select("chrom")).count()
    beyond = lambda d, first: d.filter(first <= high).select(F.explode(F.sequence(F.greatest(first, F.lit(low).cast("long")), F.lit(high).cast("long"))).alias("separation"))
    lost = beyond(f, F.col("l_signal") - F.col("pos")).union(beyond(r, F.greatest("pos", F.lit(0).cast("long"))))
    both = _banded(f.select("chrom", "pos"), r.select("chrom", "pos"), low, high).select("separation")
    less = lost.union(both).groupBy("separation").agg(F.count("*").alias("_less"))
    every = reads.sparkSession.range(low, high + 1).withColumnRenamed("id", "separation")
    return every.join(F.broadcast(less), "separation", "left").select("separation", (F.lit(total) - F.coalesce("_less", F.lit(0))).cast("long").alias("n"))


def five_prime(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "F", start).otherwise(end)


def three_prime(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "F", end).otherwise(start)
