"""Set algebra of regions (chrom, start, end, strand, ...): 1-based, ends inclusive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunked import CHUNK, islands, neighbours, ranked, ranked_overall, running, settled, summed_overall
from .overlap import BIN, overlap_join, prefixed

FAR = 10_000_000


def valid(regions: DataFrame) -> DataFrame:
    """Fails on a region that starts behind its end."""
    wrong = F.raise_error(F.concat(F.lit("region starts behind its end: "), F.concat_ws(":", "chrom", "start", "end")))
    return regions.withColumn("start", F.when(F.col("start") <= F.col("end"), F.col("start")).otherwise(wrong))


def merge(regions: DataFrame, max_gap: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Fused runs of regions: in (start, end) order a region joins the run if it starts at most max_gap behind the run's end.

    A run carries the strand of its last member. With keys ("chrom", "strand") strands merge apart.
    """
    keys = list(keys)
    has_strand = "strand" in regions.columns
    cols = [*keys, "start", "end", *(["strand"] if has_strand and "strand" not in keys else [])]
    reach = running(regions.select(*cols), keys, ["start", "end"], F.col("end"), "max", "_reach", inclusive=False)
    placed = islands(reach, keys, ["start", "end"], F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + max_gap))
    aggs = [F.min("start").alias("start"), F.max("end").alias("end")]
    if has_strand and "strand" not in keys:
        aggs.append(F.max_by("strand", F.struct("start", "end", "strand")).alias("strand"))
    return placed.groupBy(*keys, "island").agg(*aggs).drop("island")


def merge_all(lists: list[DataFrame], max_gap: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    return merge(reduce(DataFrame.unionByName, (x.select("chrom", "start", "end", "strand") for x in lists)), max_gap, keys)


def intersect(a: DataFrame, b: DataFrame, find_all: bool = True, match_strands: bool = False, bin_size: int = BIN) -> DataFrame:
    """Overlaps clipped to both regions, with a's attributes, b's bounds and the overlap's length; or only each a's first partner in b's order."""
    pairs = overlap_join(a, b, ("chrom", "strand") if match_strands else ("chrom",), bin_size)
    if not find_all:
        own = [f"a_{c}" for c in a.columns]
        first = F.min(F.struct("b_start", "b_end", "ol_start", "ol_end")).alias("_f")
        # equal rows of a have equal first partners; each of them keeps its own
        copies = a.groupBy(*a.columns).agg(F.count("*").cast("int").alias("_copies"))
        met = overlap_join(copies, b, ("chrom", "strand") if match_strands else ("chrom",), bin_size)
        pairs = met.groupBy(*own, "a__copies").agg(first).withColumn("_k", F.explode(F.sequence(F.lit(1), "a__copies"))).select(*own, "_f.*")
    kept = [F.col(f"a_{c}").alias(c) for c in a.columns if c not in ("start", "end")]
    return pairs.select(*kept, F.col("ol_start").alias("start"), F.col("ol_end").alias("end"), F.col("a_start").alias("src_start"), F.col("a_end").alias("src_end"), F.col("b_start").alias("dst_start"), F.col("b_end").alias("dst_end"), (F.col("ol_end") - F.col("ol_start") + 1).alias("overlap"))


def exclude(a: DataFrame, b: DataFrame, match_strands: bool = False, bin_size: int = BIN) -> DataFrame:
    """Rows of a without overlap with b; a touch at exactly a's end doesn't count."""
    keys = ("chrom", "strand") if match_strands else ("chrom",)
    fused = merge(b, 0, keys)
    binned = lambda d, p: prefixed(d, p).withColumn(f"{p}bin", F.explode(F.sequence(F.floor(F.col(f"{p}start") / bin_size), F.floor(F.col(f"{p}end") / bin_size))))
    own = [f"a_{c}" for c in a.columns]
    left = binned(a.distinct(), "a_")
    on = [*(F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys), F.col("a_bin") == F.col("b_bin"), F.col("b_start") < F.col("a_end"), F.col("a_start") <= F.col("b_end")]
    touched = left.join(binned(fused, "b_"), on, "left_semi").select(*own).distinct().toDF(*a.columns)
    return a.join(touched.withColumn("_hit", F.lit(True)), [a[c].eqNullSafe(touched[c]) for c in a.columns], "left_anti")


def subtract(a: DataFrame, b: DataFrame, bin_size: int = BIN) -> DataFrame:
    """What is left of each row of a without merged b, in pieces; a row of a on a chromosome without b stays."""
    gaps = overlap_join(a, uncovered(a, b), ("chrom",), bin_size)
    rest = [c for c in a.columns if c not in ("start", "end")]
    left = gaps.select(*(F.col(f"a_{c}").alias(c) for c in rest), F.col("ol_start").cast("long").alias("start"), F.col("ol_end").cast("long").alias("end"))
    return left.unionByName(a.filter("chrom is null and start <= end").select(*rest, F.col("start").cast("long"), F.col("end").cast("long")))


def uncovered(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chrom, start, end) of the gaps that merged b leaves between the first and last positions of a, chromosomes without b as one gap."""
    reach = a.groupBy("chrom").agg(F.min("start").cast("long").alias("_low"), F.max("end").cast("long").alias("_high"))
    fused = merge(b, 0).select("chrom", F.col("start").cast("long"), F.col("end").cast("long"))
    near = neighbours(fused, ["chrom"], ["start"], ["end"]).join(reach, "chrom")
    piece = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    before = piece(F.coalesce(F.col("prev_end") + 1, F.col("_low")), F.col("start") - 1)
    behind = F.when(F.col("next_end").isNull(), piece(F.col("end") + 1, F.col("_high")))
    pieces = near.select("chrom", F.explode(F.array(before, behind)).alias("_p")).select("chrom", F.col("_p.s").alias("start"), F.col("_p.e").alias("end")).filter("start <= end")
    bare = reach.join(fused.select("chrom").distinct(), "chrom", "left_anti")
    return pieces.unionByName(bare.select("chrom", F.col("_low").alias("start"), F.col("_high").alias("end")))


def subtract_pair(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Pieces of one region without another, sharing the overlap's ends; an overlap of one position or none leaves it whole."""
    low, high = F.greatest(s1, s2), F.least(e1, e2)
    piece = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    parts = F.filter(F.array(F.when(s1 < low, piece(s1, low)), F.when(high < e1, piece(high, e1))), lambda x: x.isNotNull())
    return F.when(high - low + 1 > 1, parts).otherwise(F.array(piece(s1, e1)))


def merge_within(regions: DataFrame, supers: DataFrame, bin_size: int = BIN) -> DataFrame:
    """The span of the regions inside each super-region: from the first start to the end of the last in (start, end) order.

    A region that overlaps a super-region without lying in it is an error; regions on chromosomes without super-regions pass through.
    """
    pairs = overlap_join(supers.select("chrom", "start", "end"), regions, ("chrom",), bin_size)
    outside = F.raise_error(F.concat(F.lit("region not inside its super-region: "), F.concat_ws(":", "b_chrom", "b_start", "b_end")))
    inside = (F.col("a_start") <= F.col("b_start")) & (F.col("b_end") <= F.col("a_end"))
    pairs = pairs.withColumn("b_start", F.when(inside, F.col("b_start")).otherwise(outside))
    spans = pairs.groupBy(F.col("a_chrom").alias("chrom"), "a_start", "a_end").agg(F.min("b_start").alias("start"), F.max(F.struct("b_start", "b_end"))["b_end"].alias("end")).select("chrom", "start", "end")
    others = regions.join(supers.select("chrom").distinct(), "chrom", "left_anti").select("chrom", "start", "end")
    return spans.unionByName(others)


def coverage(regions: DataFrame) -> DataFrame:
    """One row: the summed lengths of the regions that aren't inverted."""
    return regions.filter(F.col("start") <= F.col("end")).agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long").alias("coverage"))


def nucleotide_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: twice the coverage of each a's first overlap over the coverage of both."""
    both = coverage(intersect(a, b, find_all=False)).withColumnRenamed("coverage", "_ab")
    sizes = coverage(a.unionByName(b, allowMissingColumns=True)).withColumnRenamed("coverage", "_sum")
    return both.join(sizes).select((2.0 * F.col("_ab") / F.nullif(F.col("_sum"), F.lit(0))).alias("nuc_overlap"))


def overlapping(a: DataFrame, b: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Distinct rows of a that overlap any of b."""
    pairs = overlap_join(a.distinct(), b.select("chrom", "start", "end"), ("chrom",), bin_size)
    return pairs.select(*(F.col(f"a_{c}").alias(c) for c in a.columns)).distinct()


def overlap_fractions(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the share of a's coverage in regions that overlap b, and the overlap's share of both sides' overlapping regions."""
    hit_a, hit_b = overlapping(a, b), overlapping(b, a)
    common = coverage(intersect(merge(a), merge(b))).select(F.col("coverage").alias("_ab"))
    sizes = coverage(a.distinct()).select(F.col("coverage").alias("_a")).join(coverage(hit_a).select(F.col("coverage").alias("_ha"))).join(coverage(hit_b).select(F.col("coverage").alias("_hb"))).join(common)
    return sizes.select((F.col("_ha") / F.nullif("_a", F.lit(0))).alias("src_over_src"), (F.col("_ab") / F.nullif(F.col("_ha") + F.col("_hb") - F.col("_ab"), F.lit(0))).alias("src_over_both"))


def overlap_histogram(a: DataFrame, b: DataFrame, step: float, bin_size: int = BIN) -> DataFrame:
    """(bucket, n): regions of a by the largest share of them that a region of b overlaps, in steps."""
    pairs = overlap_join(a.distinct(), b.select("chrom", "start", "end"), ("chrom",), bin_size)
    own = [F.col(f"a_{c}").alias(c) for c in a.columns]
    best = pairs.groupBy(*own).agg(F.max(F.col("ol_end") - F.col("ol_start") + 1).alias("_ol"))
    share = F.coalesce("_ol", F.lit(0)) / (a["end"] - a["start"] + 1)
    joined = a.join(best, [a[c].eqNullSafe(best[c]) for c in a.columns], "left")
    return joined.select(F.floor(share / step).cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def nearest_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a with the distance to the nearest region of b: 0 on overlap, FAR at most and where b has none on the chromosome.

    An as-of join without a join: a and b go along the chromosome together. Behind a region the nearest end is the running maximum of
    ends; before it the nearest start is the running minimum of starts from the other side.
    """
    x = a.select("chrom", "start", "end", F.lit(None).cast("long").alias("_bs"), F.lit(None).cast("long").alias("_be"), F.lit(1).alias("_of"))
    y = b.select("chrom", "start", "end", F.col("start").cast("long").alias("_bs"), F.col("end").cast("long").alias("_be"), F.lit(0).alias("_of"))
    # regions of b that start at or before a's start: their furthest end
    back = running(x.unionByName(y), ["chrom"], ["start", "_of", "end"], F.col("_be"), "max", "_reach").filter("_of = 1")
    # regions of b that start behind a's start: the first of them
    turned = x.unionByName(y).withColumn("_minus", -F.col("start"))
    ahead = running(turned, ["chrom"], ["_minus", "_of", "end"], F.col("_bs"), "min", "_next").filter("_of = 1")
    near = back.groupBy("chrom", "start", "end").agg(F.max("_reach").alias("_reach")).join(ahead.groupBy("chrom", "start", "end").agg(F.min("_next").alias("_next")), ["chrom", "start", "end"])
    to = lambda known, gap: F.when(F.col(known).isNotNull(), F.greatest(gap, F.lit(0))).otherwise(F.lit(FAR))
    near = near.select("chrom", "start", "end", F.least(to("_reach", F.col("start") - F.col("_reach")), to("_next", F.col("_next") - F.col("end")), F.lit(FAR)).cast("long").alias("distance"))
    return a.join(near, ["chrom", "start", "end"])


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), s1 - e2, s2 - e1)


def gaps(regions: DataFrame) -> DataFrame:
    """Distance from each region's end to the next start, in (start, end) order; negative where they overlap."""
    return neighbours(regions.select("chrom", "start", "end"), ["chrom"], ["start", "end"], ["start"], previous=False).filter(F.col("next_start").isNotNull()).select("chrom", "start", "end", (F.col("next_start") - F.col("end")).alias("distance"))


def middles(regions: DataFrame, length: int) -> DataFrame:
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    return regions.withColumns({"start": F.greatest(mid - length // 2, F.lit(1)).cast("long"), "end": (mid + length // 2).cast("long")})


def ends(regions: DataFrame, length: int | None = None, fraction: float | None = None, five: bool = True, three: bool = True) -> DataFrame:
    """Windows around the 5' and 3' ends of each region: `length` to either side, or that share of the region's length. 0 to 2 rows each."""
    half = F.lit(length) if fraction is None else F.floor((F.col("end") - F.col("start") + 1) * fraction)
    plus = F.coalesce(F.col("strand") != "-", F.lit(True))
    around = lambda p, side: F.struct(F.lit(side).alias("side"), F.greatest(p - half, F.lit(1)).cast("long").alias("s"), (p + half).cast("long").alias("e"))
    at5, at3 = F.when(plus, F.col("start")).otherwise(F.col("end")), F.when(plus, F.col("end")).otherwise(F.col("start"))
    wanted = [*([around(at5, "5p")] if five else []), *([around(at3, "3p")] if three else [])]
    rest = [c for c in regions.columns if c not in ("start", "end")]
    return regions.withColumn("_w", F.explode(F.array(*wanted))).select(*rest, F.col("_w.side").alias("side"), F.col("_w.s").alias("start"), F.col("_w.e").alias("end"))


def left_flanks(regions: DataFrame, length: int) -> DataFrame:
    return regions.withColumns({"end": F.col("start"), "start": F.greatest(F.col("start") - length, F.lit(1)).cast("long")})


def right_flanks(regions: DataFrame, length: int) -> DataFrame:
    return regions.withColumns({"start": F.col("end"), "end": (F.col("end") + length).cast("long")})


def extend(regions: DataFrame, length: int, three: bool = True, five: bool = True) -> DataFrame:
    """Regions longer by `length` on the ends asked for, by strand; a length of 0 or less means the region's own."""
    by = F.lit(length) if length > 0 else F.col("end") - F.col("start") + 1
    plus = F.coalesce(F.col("strand") != "-", F.lit(True))
    at_start, at_end = (plus & F.lit(five)) | (~plus & F.lit(three)), (plus & F.lit(three)) | (~plus & F.lit(five))
    start = F.when(at_start, F.greatest(F.col("start") - by, F.lit(1))).otherwise(F.col("start"))
    end = F.when(at_end, F.col("end") + by).otherwise(F.col("end"))
    return regions.withColumns({"start": start.cast("long"), "end": end.cast("long")})


def sub_intervals(regions: DataFrame) -> DataFrame:
    rest = [c for c in regions.columns if c not in ("start", "end", "intervals")]
    return regions.select(*rest, F.explode("intervals").alias("_i")).select(*rest, "_i.start", "_i.end")


def ends_before(regions: DataFrame, most: int) -> DataFrame:
    return regions.filter(F.col("end") < most)


def longer_than(regions: DataFrame, run: int) -> DataFrame:
    return regions.filter(F.col("end") - F.col("start") > run)


def shorter_than(regions: DataFrame, run: int) -> DataFrame:
    return regions.filter(F.col("end") - F.col("start") < run)


def on(regions: DataFrame, **equal: str) -> DataFrame:
    """Regions whose columns (chrom=..., strand=...) have these values."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), equal.items(), regions)


def top_coverage(regions: DataFrame, most: int, order: str = "score") -> DataFrame:
    """The first regions by descending `order` until their summed lengths reach `most`; for 0 the first alone."""
    down = regions.withColumns({"_down": -F.col(order).cast("double"), "_len": (F.col("end") - F.col("start") + 1).cast("long")})
    summed = summed_overall(down, ["_down", "chrom", "start", "end"], F.col("_len"), "_held", "_total")
    return summed.filter(F.col("_held") < max(most, 1)).drop("_down", "_len", "_held", "_total")


def sorting_reach(regions: DataFrame) -> DataFrame:
    """Regions with the furthest end up to them and the least start from them on, in (start, end) order."""
    out = running(regions, ["chrom"], ["start", "end"], F.col("end"), "max", "furthest_end")
    return running(out.withColumns({"_s": -F.col("start"), "_e": -F.col("end")}), ["chrom"], ["_s", "_e"], F.col("start"), "min", "least_start").drop("_s", "_e")


def in_order(regions: DataFrame, by: str = "position", descending: bool = False) -> DataFrame:
    """A total order by position, length, score, end, log_p or log_q."""
    key = {"position": F.col("start"), "length": F.col("end") - F.col("start")}.get(by)
    key = F.col(by) if key is None else key
    return regions.orderBy(key.desc() if descending else key.asc(), "chrom", "start", "end")


def by_chromosome_and_strand(regions: DataFrame) -> DataFrame:
    return regions.repartitionByRange("chrom", "strand", "start").sortWithinPartitions("chrom", "strand", "start", "end")


def chromosomes(regions: DataFrame) -> DataFrame:
    return regions.select("chrom").distinct()


def predecessor(queries: DataFrame, positions: DataFrame) -> DataFrame:
    """Each query position (chrom, pos) with the largest position at or before it, or null."""
    x = queries.select("chrom", "pos", F.lit(None).cast("long").alias("_p"), F.lit(1).alias("_of"))
    y = positions.select("chrom", "pos", F.col("pos").cast("long").alias("_p"), F.lit(0).alias("_of"))
    return running(x.unionByName(y), ["chrom"], ["pos", "_of"], F.col("_p"), "max", "before").filter("_of = 1").select("chrom", "pos", "before")


def numbered(regions: DataFrame) -> DataFrame:
    return ranked(regions, ["chrom"], ["start", "end"], "number")


#: Lists in a word of a bitmap.
WORD = 62


def association(regions: DataFrame, by: str, chunk: int = CHUNK) -> DataFrame:
    """(list_a, list_b, shared, of_a, of_b, jaccard): the positions that each two lists of regions share; lists are the values of `by`.

    Each list is fused by itself, so that along a chromosome the sum of its powers of 2, added at starts and taken off behind ends, is the bitmap of
    the lists that hold a place. One pass finds the stretches and their bitmaps, lengths are summed by bitmap, and only then do bitmaps become
    pairs: no list meets another. Lists that share nothing have no row; a list meets itself. A null in `by` is no list.
    """
    fused = merge(regions.filter(F.col(by).isNotNull()).select("chrom", "start", "end", by), 0, ("chrom", by))
    names = settled(ranked_overall(fused.select(by).distinct(), [by], "_id").withColumn("_id", F.col("_id") - 1))  # one row a list, as the result has their square
    words = [f"_w{k}" for k in range(max(1, -(-names.count() // WORD)))]
    bit = F.pow(F.lit(2.0), F.col("_id") % WORD).cast("long")
    step = F.explode(F.array(F.struct(F.col("start").cast("long").alias("pos"), bit.alias("d")), F.struct((F.col("end") + 1).cast("long").alias("pos"), (-bit).alias("d"))))
    steps = fused.join(names, by).select("chrom", F.floor(F.col("_id") / WORD).alias("_word"), step.alias("s"))
    held = steps.groupBy("chrom", "s.pos").agg(*(F.sum(F.when(F.col("_word") == k, F.col("s.d")).otherwise(0)).alias(f"_d{k}") for k in range(len(words))))
    for k, w in enumerate(words):
        held = running(held, ["chrom"], ["pos"], F.col(f"_d{k}"), "sum", w, chunk=chunk)
    near = neighbours(held.select("chrom", "pos", *words), ["chrom"], ["pos"], ["pos"], chunk=chunk, previous=False)
    maps = near.filter("next_pos is not null").groupBy(*words).agg(F.sum(F.col("next_pos") - F.col("pos")).alias("n"))
    ids = F.flatten(F.array(*(F.expr(f"transform(filter(sequence(0, {WORD - 1}), i -> (shiftright({w}, i) & 1) = 1), i -> i + {k * WORD})") for k, w in enumerate(words))))
    pairs = maps.select("n", ids.alias("ids")).select("n", "ids", F.explode("ids").alias("a")).select("n", "a", F.explode("ids").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    pairs = settled(pairs)
    own = lambda x: pairs.filter("a = b").join(names, F.col("a") == F.col("_id")).select(F.col("a").alias(x), F.col(by).alias(f"list_{x}"), F.col("shared").alias(f"of_{x}"))
    out = pairs.join(own("a"), "a").join(own("b"), "b")
    return out.select("list_a", "list_b", "shared", "of_a", "of_b", (F.col("shared") / (F.col("of_a") + F.col("of_b") - F.col("shared"))).alias("jaccard"))
