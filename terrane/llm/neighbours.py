"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced partitions with few edges between them. A small classifier learns, from
each sample vector, the share of its graph neighbours in every partition; it indexes all rows (most probable partition) and routes
queries to as many partitions as a probability mass asks for that was measured on the sample. Partitions that are still large are cut
in the same way, each by a classifier of its own, so that their number grows with the rows and a leaf stays small. Candidates
are ranked exactly, in blocks of neighbouring leaves: a query takes one short list from each block, not from each leaf.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, tidied

GRAPH_NEIGHBOURS = 16
#: Recall on the sample that routing is set to reach, over all levels.
AIM = 0.97
HIDDEN, EPOCHS, BATCH, RATE = 96, 40, 128, 3e-3
#: Queries ranked at once, and rows routed by one task below the first level.
AT_ONCE, ROUTE_ROWS = 128, 20_000


class Shape(NamedTuple):
    """sample: vectors of a node's sample, in expectation, drawn by a hash of vec_id (all rows are indexed, not only those learned from).
    partition_rows: rows of a leaf. leaf_rows: rows up to which a partition isn't cut again. fan_out: partitions of a node at most.
    block_bytes, block_queries: vectors and queries ranked by one task."""

    sample: int = 6144
    partition_rows: int = 800
    leaf_rows: int = 3200
    fan_out: int = 128
    block_bytes: int = 8 << 20
    block_queries: int = 4096

    def child(self, node: int, part: np.ndarray) -> np.ndarray:
        """Numbers of a node's partitions; 0 is the root."""
        return np.int64(node) * (self.fan_out + 1) + part + 1

    def above(self) -> Column:
        return F.floor((F.col("node") - 1) / (self.fan_out + 1)).cast("long")

    def part(self) -> Column:
        return ((F.col("node") - 1) % (self.fan_out + 1)).cast("int")


def neighbour_graph(x: np.ndarray, k: int, queries: np.ndarray | None = None) -> np.ndarray:
    """The k nearest rows of x by inner product for each row (itself left out), or for each query."""
    out = []
    own = queries is None
    queries = x if own else queries
    for at in range(0, len(queries), 512):
        s = queries[at : at + 512] @ x.T
        if own:
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        part = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        out.append(part)
    return np.concatenate(out)


def balanced_partition(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 25, slack: float = 1.1) -> np.ndarray:
    """A partition of the graph's nodes with at most slack times the mean size each.

    Regions grow from random seeds along edges; then nodes move to the partition most of their neighbours, either way, are in,
    largest gain first, while it has room.
    """
    n, k = graph.shape
    most = int(np.ceil(slack * n / parts))
    src, dst = np.repeat(np.arange(n), k), graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    label = np.full(n, -1)
    label[rng.permutation(n)[:parts]] = np.arange(parts)
    size = np.bincount(label[label >= 0], minlength=parts)
    for step in range(200 + rounds):
        known = label[dst] >= 0
        votes = np.bincount(src[known] * parts + label[dst[known]], minlength=n * parts).reshape(n, parts)
        here = np.where(label >= 0, votes[np.arange(n), np.maximum(label, 0)], -1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - here
        moving = np.flatnonzero((gain > 0) & (best != label) & (votes[np.arange(n), best] > 0))
        free = (label < 0).sum()
        moved = 0
        for i in moving[np.argsort(-gain[moving], kind="stable")]:
            if size[best[i]] < most:
                if label[i] >= 0:
                    size[label[i]] -= 1
                label[i] = best[i]
                size[best[i]] += 1
                moved += 1
        if not moved and free:
            rest = np.flatnonzero(label < 0)
            for i in rest:
                label[i] = size.argmin()
                size[label[i]] += 1
        if not moved and not free or step > rounds and not free:
            break
    return label


@dataclass
class Router:
    """A network with one hidden layer; scale is the mean length of the sample's vectors."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x / self.scale) @ self.w1 + self.b1, 0)
        s = h @ self.w2 + self.b2
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def routes(self, p: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Partitions of each query, most probable first: until they hold the mass and `least` rows."""
        order = np.argsort(-p, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        rows = np.cumsum(sizes[order], axis=1)
        n = 1 + ((held < self.mass) | (rows < least)).sum(axis=1)
        return [o[:k] for o, k in zip(order, n)]


def _fit(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    d, parts = x.shape[1], target.shape[1]
    scale = float(np.sqrt((x * x).sum(axis=1)).mean()) / np.sqrt(d)
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            xb = x[rows] / scale
            h = np.maximum(xb @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((xb.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                w[i] -= RATE * (1 - epoch / EPOCHS) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*w, scale)


def learn(x: np.ndarray, rows: int, k: int, aim: float, shape: Shape) -> Router:
    """A router from a sample of distinct vectors, for a node of `rows` rows and searches of the k nearest."""
    rng = np.random.default_rng(11)
    parts = int(max(1, min(max(2, rows // shape.partition_rows), len(x) // 24, shape.fan_out)))  # two at least from 48 distinct vectors on
    if parts < 2:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    test = rng.permutation(len(x)) < len(x) // 8
    graph = neighbour_graph(x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    label = balanced_partition(graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += 1
    target /= target.sum(axis=1, keepdims=True)
    router = _fit(x[~test], target[~test], rng)
    # Where would the true neighbours of the vectors held back be found? The mass that finds `aim` of them is the routing rule.
    p = router.probabilities(x)
    home = p.argmax(axis=1)
    near = neighbour_graph(x, min(k, len(x) - 1), None)[test]
    order = np.argsort(-p[test], axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    before = np.cumsum(np.take_along_axis(p[test], order, axis=1), axis=1)
    need = np.take_along_axis(before - np.take_along_axis(p[test], order, axis=1), np.take_along_axis(place, home[near], axis=1), axis=1)
    router.mass = float(np.quantile(need, aim)) + 1e-9
    return router


def _prepared(vectors: DataFrame) -> DataFrame:
    """Usable vectors as (vec_id, v array<double>); of rows that share a vec_id the greatest."""
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _learned(k: int, aim: float, shape: Shape):
    def run(key: tuple, sample: pa.Table) -> pa.Table:
        x = np.unique(_matrix(sample.column("v")), axis=0)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "router": pa.array([pickle.dumps(learn(x, sample.column("n")[0].as_py(), k, aim, shape))], pa.binary())})

    return run


def _homes(shape: Shape):
    def run(router: Router, node: int, ids: pa.Array, vectors: np.ndarray) -> dict:
        return {"id": ids, "node": pa.array(shape.child(node, router.probabilities(vectors).argmax(axis=1)), pa.int64())}

    return run


def _routes(k: int, shape: Shape):
    def run(router: Router, node: int, ids: pa.Array, vectors: np.ndarray, sizes: np.ndarray) -> dict:
        to = [t[sizes[t] > 0] for t in router.routes(router.probabilities(vectors), sizes, k + 1)]
        of = np.repeat(ids.to_numpy(zero_copy_only=False), [len(t) for t in to])
        return {"id": pa.array(of, pa.int64()), "node": pa.array(shape.child(node, np.concatenate(to)) if to else [], pa.int64())}

    return run


def _through(rows: DataFrame, routers: DataFrame, f) -> DataFrame:
    """(id, node): what f makes of the rows (id, v, node) at the nodes that have a router (node, n, router, ...).

    The first level has one router, of bounded size, which goes to every task; below, rows and routers meet by node and block.
    """
    schema = "id long, node long"
    extra = [c for c in routers.columns if c == "sizes"]

    def arguments(router: bytes, *sizes) -> tuple:
        router = pickle.loads(router)
        counted = np.zeros(router.w2.shape[1], np.int64)
        for s in sizes[0] if sizes else ():
            counted[s["part"]] = s["n"]
        return router, (counted,) if sizes else ()

    first = routers.filter("node = 0").select("router", *extra).collect()
    if first:
        held = tuple(first[0])

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            router, more = arguments(*held)
            for batch in batches:
                if batch.num_rows:
                    out = f(router, 0, batch.column(0), _matrix(batch.column(1)), *more)
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        return rows.select("id", "v").mapInArrow(one, schema)

    def met(key: tuple, part: pa.Table, router: pa.Table) -> pa.Table:
        if not len(part) or not len(router):
            return pa.table({"id": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        made, more = arguments(*(router.column(c)[0].as_py() for c in ("router", *extra)))
        return pa.table(f(made, key[0].as_py(), part.column("id").combine_chunks(), _matrix(part.column("v")), *more))

    blocks = F.ceil(F.col("n") / ROUTE_ROWS).cast("int")
    left = rows.join(routers.select("node", "n"), "node").select("node", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id", "v")
    right = routers.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("node", "block", "router", *extra)
    return left.groupBy("node", "block").cogroup(right.groupBy("node", "block")).applyInArrow(met, schema)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k rows of largest inner product with each query, its own id left out, ties to the smaller id. rough: products up to rounding, -inf for no candidate."""
    slack = 8 * rows.shape[1] * np.finfo(float).eps * float(np.sqrt((rows * rows).sum(axis=1)).max(initial=0.0))
    for i, q in enumerate(query_ids):
        s = rough[i]
        s[ids == q] = -np.inf
        n = min(k, int((s > -np.inf).sum()))
        if not n:
            continue
        edge = np.partition(s, len(s) - n)[len(s) - n]
        near = np.flatnonzero((s >= edge - slack * float(np.sqrt(queries[i] @ queries[i]))) & (s > -np.inf))
        exact = np.add.accumulate(rows[near] * queries[i], axis=1)[:, -1]
        top = np.lexsort((ids[near], -exact))[:n]
        yield int(q), ids[near][top], exact[top]


def _rank_block(k: int):
    """Queries (id, v, nodes) against the rows (id, v, node) of the leaves they were routed to."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_by("node")
            query_ids, queries, wanted = left.column("id").to_numpy(), _matrix(left.column("v")), left.column("nodes").to_pylist()
            ids, rows, nodes = right.column("id").to_numpy(), _matrix(right.column("v")), right.column("node").to_numpy()
            leaves, begins = np.unique(nodes, return_index=True)
            ends = np.append(begins[1:], len(nodes))
            for at in range(0, len(query_ids), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                asks = np.array([np.isin(leaves, w) for w in wanted[part]])
                rough = np.full((len(asks), len(ids)), -np.inf)
                for leaf, (a, b) in enumerate(zip(begins, ends)):
                    if asks[:, leaf].any():
                        rough[asks[:, leaf], a:b] = queries[part][asks[:, leaf]] @ rows[a:b].T
                out += _best(query_ids[part], queries[part], ids, rows, rough, k)
        of = np.repeat([o[0] for o in out], [len(o[1]) for o in out]) if out else []
        cat = lambda n, t: pa.array(np.concatenate([o[n] for o in out]) if out else [], t)
        return pa.table({"query_id": pa.array(of, pa.int64()), "vec_id": cat(1, pa.int64()), "score": cat(2, pa.float64())})

    return run


def partitioned(rows: DataFrame, asked: DataFrame, total: int, k: int, shape: Shape = Shape()) -> tuple[DataFrame, DataFrame]:
    """The leaf of every row (id, node), and the leaves of every query (id, node), one row for each. rows, asked: id, v."""
    levels = max(1, math.ceil(math.log(max(1.0, total / shape.leaf_rows), shape.fan_out)))
    placed, sent = rows.select("id", F.lit(0).cast("long").alias("node")), asked.select("id", F.lit(0).cast("long").alias("node"))
    large = rows.sparkSession.createDataFrame([(0, total)], "node long, n long")
    for level in range(levels + 1):  # one more for nodes that came out larger than meant; what can't be cut then, like equal vectors, stays whole
        here = rows.join(placed, "id") if level else rows.withColumn("node", F.lit(0).cast("long"))
        drawn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < F.ceil(F.lit(float(shape.sample << 30)) / F.col("n"))
        sized = here.join(large, "node") if level else here.withColumn("n", F.lit(total).cast("long"))
        sample = sized.filter(drawn).select("node", "n", "v")
        routers = sample.groupBy("node").applyInArrow(_learned(k, AIM ** (1 / levels), shape), "node long, router binary").join(large, "node")
        routers = materialise(routers.select("node", "n", "router"), "routers")
        new = _through(here, routers, _homes(shape))
        stay = lambda t: t.join(routers.select("node"), "node", "left_anti").select("id", "node")
        placed = materialise(new.unionByName(stay(placed)) if level else new, "index")
        counts = materialise(placed.groupBy("node").agg(F.count("*").alias("n")), "sizes")
        sizes = counts.filter("node > 0").groupBy(shape.above().alias("node")).agg(F.collect_list(F.struct(shape.part().alias("part"), "n")).alias("sizes"))
        there = asked.join(sent, "id") if level else asked.withColumn("node", F.lit(0).cast("long"))
        routed = _through(there, routers.join(sizes, "node"), _routes(k, shape))
        sent = materialise(routed.unionByName(stay(sent)) if level else routed, "routes")
        large = counts.filter(F.col("n") > shape.leaf_rows)
        if level + 1 >= levels and (level == levels or large.isEmpty()):
            break
    return placed, sent


@tidied
def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shape: Shape = Shape()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another length than most
    (ties: the shorter), nor rows without a vec_id. Of rows that share a vec_id the greatest vector counts. Equal scores go to the smaller vec_id. With fewer
    than k candidates all are returned; an empty table gives no rows. Columns other than vec_id and embedding are not read.
    """
    rows = _prepared(vectors)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension = lengths[0]["n"] if lengths else 0
    rows = rows.filter(F.size("v") == dimension).groupBy(F.col("vec_id").alias("id")).agg(F.max("v").alias("v"))
    rows = materialise(rows, "vectors")
    total = rows.count()
    if not total:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    asked = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("id"), F.col("v").alias("v"))  # columns of their own beside those of rows
    placed, sent = partitioned(rows, asked, total, k, shape)
    # Neighbouring leaves share a block; a leaf larger than a block has several to itself.
    most = max(1, shape.block_bytes // (8 * dimension))
    own = F.ceil(F.col("n") / most).cast("int")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(shape.above()).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leaves = placed.groupBy("node").agg(F.count("*").alias("n"))
    leaves = leaves.select("node", F.when(own > 1, F.col("node")).otherwise(shape.above()).alias("owner"), F.when(own > 1, own).otherwise(F.lit(1)).alias("parts"), F.floor(before / most).cast("int").alias("at"))
    leaves = materialise(leaves, "leaves")
    several = F.col("parts") > 1
    held = placed.join(leaves, "node").select("id", "node", "owner", F.when(several, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).otherwise(F.col("at")).alias("block"))
    to = sent.join(leaves, "node").select("id", "node", "owner", F.explode(F.when(several, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("at"))).alias("block"))
    to = materialise(to.groupBy("id", "owner", "block").agg(F.collect_list("node").alias("nodes")), "asked")
    blocks = to.groupBy("owner", "block").agg(F.ceil(F.count("*") / shape.block_queries).cast("int").alias("of"))
    left = to.join(blocks, ["owner", "block"]).join(asked, "id").select("owner", "block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int").alias("nth"), "id", "v", "nodes")
    right = held.join(blocks, ["owner", "block"]).join(rows, "id").select("owner", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("nth"), "id", "v", "node")
    dealt = lambda t: t.groupBy("owner", "block", "nth")
    found = dealt(left).cogroup(dealt(right)).applyInArrow(_rank_block(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
