"""Near-duplicate detection by MinHash: universal hash minima, banding, signature verification, connected components.

Equal shingle sets are one class first, so copies never meet in pairs. Representatives of classes that share a band are tested in two
steps, neither of which lists the pairs of a bucket:

1. star: each bucket's members against its least member. Confirmed links give components.
2. rest: in buckets that still hold several components, the members outside the bucket's most frequent component against all its
   members of other components, in blocks of bounded size.

A pair that shares a band is thus tested, or already connected, or lies in one component after step 1. Within a block, sizes and
signatures rule pairs out and full sets confirm the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import chunks, drop, materialise, tidied, utf8
from .shingles import band_keys, minima, shingle_set

#: 24 bands of 4 minima: a pair at similarity 0.8 misses every band with probability 3e-6.
MINIMA, BANDS = 96, 24
#: Signatures rule a pair out below this share of equal minima under the threshold; five standard deviations at 0.8.
MARGIN = 0.2
#: Rows, and bytes of their sets, of one side of a block, on average.
BLOCK_ROWS, BLOCK_BYTES = 256, 2 << 20


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = [shingle_set(t, width) for t in utf8(batch.column(1))]
            some = [k for k, s in enumerate(sets) if len(s)]
            keys: list[list[int] | None] = [None] * len(sets)
            for k, row in zip(some, band_keys(minima([sets[k] for k in some], MINIMA), BANDS).tolist()):
                keys[k] = row
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "bands"]
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = [shingle_set(t, width).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def link_block(xs: list[tuple], ys: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between two lists of (rep, component, set): one for each x and component among its partners."""
    x_set, y_set = ([np.frombuffer(r[2], np.uint64) for r in rows] for rows in (xs, ys))
    nx, ny = (np.array([len(s) for s in sets], np.int64) for sets in (x_set, y_set))
    x_comp, y_comp = (np.array([r[1] for r in rows], np.int64) for rows in (xs, ys))
    low, high = np.minimum(nx[:, None], ny), np.maximum(nx[:, None], ny)
    open_ = (x_comp[:, None] != y_comp) & (100 * low >= percent * high)
    if open_.sum() > 4 * (len(xs) + len(ys)):
        sx, sy = minima(x_set, MINIMA), minima(y_set, MINIMA)
        for i in np.flatnonzero(open_.any(axis=1)):
            open_[i] &= (sy == sx[i]).mean(axis=1) >= percent / 100 - MARGIN
    out = []
    for i in np.flatnonzero(open_.any(axis=1)):
        js = np.flatnonzero(open_[i])
        flat = np.concatenate([y_set[j] for j in js])
        at = np.searchsorted(x_set[i], flat)
        at[at == nx[i]] = 0
        both = np.add.reduceat((x_set[i][at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(ny[js])[:-1])))
        hit = js[100 * both >= percent * (nx[i] + ny[js] - both)]
        for j in hit[np.unique(y_comp[hit], return_index=True)[1]]:
            out.append((int(xs[i][0]), int(ys[j][0])))
    return out


def _linker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            found = []
            for label, hx, hy, is_x, rep, comp, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, hx, hy) != now:
                    found += link_block(*held, percent) if all(held) else []
                    now, held = (label, hx, hy), ([], [])
                held[0 if is_x else 1].append((rep, comp, shingles))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
        found = link_block(*held, percent) if all(held) else []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _links(roles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of roles (label, is_x, rep, comp, size): x against y under each label, dealt out in blocks bounded in rows and bytes."""
    roles = materialise(roles, "roles")
    x, y = F.col("is_x"), ~F.col("is_x")
    blocks = lambda side: F.ceil(F.greatest(F.count_if(side) / BLOCK_ROWS, F.sum(F.when(side, F.col("size"))) * 8 / BLOCK_BYTES)).cast("int")
    n = materialise(roles.groupBy("label").agg(blocks(x).alias("_xs"), blocks(y).alias("_ys")), "blocks")  # as a table, it lets the join split a hot label
    dealt = roles.join(n, "label")
    own = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    dealt = dealt.withColumn("hx", F.explode(F.when(F.col("is_x"), F.array(own("_xs"))).otherwise(every("_xs"))))
    dealt = dealt.withColumn("hy", F.explode(F.when(F.col("is_x"), every("_ys")).otherwise(F.array(own("_ys")))))
    rows = dealt.join(sets, "rep").select("label", "hx", "hy", "is_x", "rep", "comp", "shingles")
    return rows.repartition("label", "hx", "hy").sortWithinPartitions("label", "hx", "hy").mapInArrow(_linker(percent), "u long, v long")


@tidied
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * intersection >= percent * union of their sets of `width`-word shingles; a shorter text is one
    shingle; component_id is the least doc_id reachable. Shingles are told apart by 64-bit hashes; a pair at the threshold goes unseen with
    probability 3e-6. A text that is null or without words has no set and links with nothing.
    Rows that share a doc_id count as one document. A null doc_id links with nothing, has no component and is kept.
    An empty table gives no rows; columns other than doc_id and text are not read.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialise(source.mapInArrow(_signatures(width), "doc_id long, n_shingles long, print binary, bands array<long>"), "signatures")
    classes = materialise(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    rows = signed.withColumnRenamed("doc_id", "rep").join(classes, ["print", "rep"]).select("rep", F.col("n_shingles").alias("size"), F.explode("bands").alias("key")).distinct()
    buckets = rows.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("_most")).filter("pivot <> _most").select("key", "pivot")
    buckets = materialise(buckets, "buckets")  # as a table, it lets the join split a hot bucket
    members = materialise(rows.join(buckets, "key"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(source.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "rep long, shingles binary").distinct(), "sets")

    star = members.filter("rep <> pivot").select(F.col("pivot").alias("label"), F.lit(False).alias("is_x"), "rep", "size").distinct()
    pivots = members.filter("rep = pivot").select(F.col("pivot").alias("label"), F.lit(True).alias("is_x"), "rep", "size").distinct()
    star = star.union(pivots).withColumn("comp", F.col("rep"))
    same = signed.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("print").alias("_a"), F.max("print").alias("_b")).filter("_a <> _b")
    same = signed.join(same, "doc_id").join(classes, "print").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    first = materialise(components(_links(star, sets, percent).union(same)), "components")

    placed = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"), "size")
    counted = placed.groupBy("key", "comp").count()
    main = counted.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("_main"), F.count("*").alias("_n")).filter("_n > 1").select("key", F.col("_main.comp").alias("label"))
    main = materialise(main, "mains")
    left = placed.join(main, "key")
    roles = left.filter("comp <> label").select("label", F.lit(True).alias("is_x"), "rep", "comp", "size").union(left.select("label", F.lit(False), "rep", "comp", "size")).distinct()
    late = _links(roles, sets, percent)
    of = lambda end: first.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    late = late.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    second = materialise(components(late), "components")
    joined = first.select(F.col("node").alias("rep"), F.col("component").alias("node")).join(second, "node", "left").select("rep", F.coalesce("component", "node").alias("component_id"))
    alone = second.withColumnRenamed("node", "rep").join(first.select(F.col("node").alias("rep")), "rep", "left_anti").select("rep", F.col("component").alias("component_id"))
    final = joined.union(alone)

    named = classes.join(final, "rep", "left").select("print", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print")).join(named, "print", "left")
    component = F.coalesce("component_id", "doc_id")
    drop(members)  # `second` is written: nothing reads these any more
    drop(sets)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
