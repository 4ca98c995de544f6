"""Best-fit packing by minimum bin slack.

Token sequences are cut into pieces of at most one bin. How pieces fill bins depends only on how many pieces of each
length there are, so the search runs on that histogram (at most `capacity` rows, whatever the corpus): a bitset subset-sum
finds the fullest feasible combination of the lengths left, which is taken as often as the counts allow and removed.
Pieces then learn their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PieceEncoder, default_tokenizer
from .shared import chunks, materialise, tidied

CAPACITY = 1024
END_ID = 2
#: Pieces that one window group may hold; hash buckets split larger lengths.
GROUP_ROWS = 4_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(available: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to capacity, as {length: copies}.

    Bit s of a Python integer says that sum s can be reached. Copies are added in powers of two; the bitset before each step
    is kept to walk back from the best sum. Longer lengths come first, so of equal sums one with longer pieces is found.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(available, reverse=True):
        left, k = min(available[length], capacity // length if length else 0), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            used[length] = used.get(length, 0) + k
    return used


def _slack_run(histogram: dict[int, int], capacity: int, seeded: bool) -> list[tuple[int, dict[int, int]]]:
    left, out = {n: c for n, c in histogram.items() if c > 0}, []
    while left:
        if seeded:
            first = max(left)
            rest = {n: c - (n == first) for n, c in left.items() if n <= capacity - first and c - (n == first) > 0}
            pattern = fullest(rest, capacity - first)
            pattern[first] = pattern.get(first, 0) + 1
        else:
            pattern = fullest(left, capacity)
        times = min(left[n] // k for n, k in pattern.items())
        out.append((times, pattern))
        for n, k in pattern.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(bins, {length: copies in each}), ...] for all pieces.

    Two runs, the fullest combination of all and the fullest one that holds the longest piece left; the one with fewer bins counts.
    """
    if any(n > capacity or n < 1 for n, c in histogram.items() if c):
        raise ValueError("every piece must have 1 to `capacity` tokens")
    runs = [_slack_run(histogram, capacity, seeded) for seeded in (True, False)]
    return min(runs, key=lambda run: sum(times for times, _ in run))


def placement(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Rank ranges of each length and where they lie; sorted by (length, first rank)."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for times, pattern in patterns:
        at = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            rows.append((length, seen.get(length, 0), base, copies, at))
            seen[length] = seen.get(length, 0) + times * copies
            at += length * copies
        base += times
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "base", "copies", "at"), cols))


def tokenise(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: its ids, then the end id; only documents beyond the capacity are cut, the first piece takes the rest."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch in chunks(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                first = (len(ids) - 1) % capacity + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity)
                    out.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop])))
            doc, piece, start, length, crc = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. Reads its input three times: give it a written table."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = placement(minimum_slack(histogram, capacity))
    buckets = 1 + sum(histogram.values()) // GROUP_ROWS
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_n", F.row_number().over(within)).join(first, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_n") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = np.int64(1) << 50
        keys = plan["length"] * stride + plan["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            row = np.searchsorted(keys, length * stride + rank, side="right") - 1
            nth, copy = np.divmod(rank - plan["rank"][row], plan["copies"][row])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(plan["base"][row] + nth), pa.array(plan["at"][row] + copy * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


@tidied
def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack whole documents into sequences of at most `capacity` tokens.

    Null and empty texts are one piece with the end id alone. Repeated rows are packed as often as they come. An empty table
    gives no rows. Columns other than doc_id and text are not read.
    """
    return pack(materialise(tokenise(docs, capacity, tokenizer), "pieces"), capacity)
