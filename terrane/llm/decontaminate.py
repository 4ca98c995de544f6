"""Benchmark decontamination on a distributed positional inverted index.

The index is sharded by document: a segment holds, for some documents, every term with its ascending word positions. Segments are rows
of a table in the shared folder, built once without a shuffle and good for any number of searches. A search takes the test phrases in
blocks of bounded size, one after the other, to every segment (test sets are small beside what is indexed); there it starts from the rarest term of a phrase and intersects the offset-adjusted position
lists of the others in order of their length. With a slop of 0 the matches are exact phrases, else proximity matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, materialise, tidied, utf8
from .text import words

WINDOW = 10
SEGMENT_BYTES = 6 << 20
#: Bytes of test texts in one block, which is collected and sent to every task as term numbers: some 10 bytes for each byte of text.
BLOCK_BYTES = 2 << 20
SEGMENT = "segment string, doc_ids array<long>, bounds binary, terms array<binary>, ends binary, positions binary"
MATCHES = "segment string, nth int, doc_id long, n_words long, hits array<int>, items array<string>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in chunks(batches, limit=SEGMENT_BYTES):
        number: dict[bytes, int] = defaultdict(lambda: len(number))
        ids, lengths = [], []
        for text in utf8(batch.column(1)):
            found = words(text)
            lengths.append(len(found))
            ids.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        bounds = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64) + 1)))  # one place stays free behind each document
        keys = np.concatenate([(x << 32) + np.arange(at, at + len(x)) for x, at in zip(ids, bounds)])
        keys.sort()
        ends = np.cumsum(np.bincount(keys >> 32, minlength=len(number)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{part}-{n}"]),
                pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([bounds.astype("<i4").tobytes()], pa.binary()),
                pa.array([list(number)], pa.list_(pa.binary())),
                pa.array([ends.astype("<i4").tobytes()], pa.binary()),
                pa.array([(keys & 0xFFFFFFFF).astype("<i4").tobytes()], pa.binary()),
            ],
            names=["segment", "doc_ids", "bounds", "terms", "ends", "positions"],
        )
        n += 1


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of all documents. Null texts have no words; columns other than doc_id and text are not read."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_segments, SEGMENT)


class Phrases:
    """Windows of `window` words of some items as rows of term numbers, each once, and the items that hold them. A shorter item is one window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        number: dict[bytes, int] = defaultdict(lambda: len(number))
        self.names, grids, owners = [i for i, _ in items], [], []
        for k, (_, text) in enumerate(items):
            found = np.array([number[w] for w in words(text)], np.int32)
            if len(found):
                rows = np.lib.stride_tricks.sliding_window_view(found, window) if len(found) >= window else np.pad(found, (0, window - len(found)), constant_values=-1)[None]
                grids.append(rows.astype(np.int32))
                owners.append(np.full(len(rows), k, np.int32))
        self.terms = pa.array(list(number), pa.binary())
        every = np.concatenate(grids) if grids else np.zeros((0, window), np.int32)
        self.grid, of = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([of.ravel(), np.concatenate(owners)]), axis=0) if grids else np.zeros((0, 2), np.int64)
        self.owners, self.cuts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.grid) + 1))
        self.sizes = (self.grid >= 0).sum(axis=1)

    def items(self, phrase: int) -> list[str | None]:
        return [self.names[k] for k in self.owners[self.cuts[phrase] : self.cuts[phrase + 1]]]


def occurrences(lists: list[np.ndarray], bounds: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a phrase occurs whose words have these ascending position lists: its first-word places, and where each word was found.

    From the rarest word on, places are kept while each further word stands at its offset, or at most `slop` words off it (the nearest
    one, the earlier of two), in the same document.
    """
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    first = order[0]
    places = lists[first].astype(np.int64) - first
    doc = np.searchsorted(bounds, lists[first], side="right") - 1
    low, high = bounds[doc], bounds[doc + 1] - 1
    if not slop:
        for i in order[1:]:
            if not len(places):
                break
            there = np.searchsorted(lists[i], places + i)
            keep = (there < len(lists[i])) & (places + i < high) & (places >= low)
            keep[keep] = lists[i][there[keep]] == (places + i)[keep]
            places, low, high = places[keep], low[keep], high[keep]
        return places, places + np.arange(len(lists))[:, None]
    at = np.empty((len(lists), len(places)), np.int64)
    at[first] = lists[first]
    for i in order[1:]:
        if not len(places):
            break
        own, wanted = lists[i], places + i
        behind = np.searchsorted(own, wanted)
        best, off = np.zeros(len(wanted), np.int64), np.full(len(wanted), slop + 1, np.int64)
        for k in (behind - 1, behind):
            there = own[np.clip(k, 0, len(own) - 1)].astype(np.int64) if len(own) else wanted
            away = np.abs(there - wanted)
            nearer = (k >= 0) & (k < len(own)) & (there >= low) & (there < high) & (away < off)
            best[nearer], off[nearer] = there[nearer], away[nearer]
        keep = off <= slop
        at[i] = best
        places, low, high, at = places[keep], low[keep], high[keep], at[:, keep]
    return places, at


def _search(wanted: Phrases, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment, doc_ids, bounds, own, ends, positions = (c[row] for c in batch.columns)
                bounds, ends, positions = (np.frombuffer(x.as_buffer(), "<i4") for x in (bounds, ends, positions))
                place = pc.index_in(wanted.terms, value_set=own.values if own.is_valid else pa.array([], pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                there = np.append(place >= 0, True)  # the last one for places behind a short phrase's end
                alive = np.flatnonzero(there[wanted.grid].all(axis=1))
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                hit = np.zeros(bounds[-1] + 1, bool)
                items: dict[int, set] = defaultdict(set)
                for k in alive.tolist():
                    found, at = occurrences([positions[starts[t] : ends[t]] for t in place[wanted.grid[k, : wanted.sizes[k]]]], bounds, slop)
                    if len(found):
                        hit[at.ravel()] = True
                        for d in np.unique(np.searchsorted(bounds, at[0], side="right") - 1).tolist():
                            items[d].update(wanted.items(k))
                where = np.flatnonzero(hit)
                cut = np.searchsorted(where, bounds)
                places = [(where[a:b] - at).tolist() for a, b, at in zip(cut[:-1], cut[1:], bounds)]
                n_docs = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment.as_py()] * n_docs),
                        pa.array(range(n_docs), pa.int32()),
                        pa.array(doc_ids.as_py(), pa.int64()),
                        pa.array((np.diff(bounds) - 1).astype(np.int64)),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array([sorted(x for x in items[d] if x is not None) if d in items else [] for d in range(n_docs)], pa.list_(pa.string())),
                    ],
                    names=["segment", "nth", "doc_id", "n_words", "hits", "items"],
                )

    return run


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row for each document of the index: its words inside occurrences (`hits`) and the items that occur (`items`).

    With a slop, hits are the words where they were found, not the places they were looked for at.

    The benchmark is read in blocks of about BLOCK_BYTES, split by a hash of item and text, so that what is sent to the tasks is
    bounded whatever its size; with several blocks, the matches of a document are united.
    """
    source = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = []
    for b in range(blocks):
        items = [(r["item"], bytes(r["text"])) for r in source.filter(block == b).collect()]
        rows = index.mapInArrow(_search(Phrases(items, window), slop), MATCHES)
        if blocks == 1:
            return rows
        # a table for each block, so that the driver holds one block at a time; all documents are in the first
        found.append(materialise(rows.filter((F.size("hits") > 0) | F.lit(b == 0)), "matches"))
    united = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return reduce(DataFrame.union, found).groupBy("segment", "nth", "doc_id", "n_words").agg(united("hits"), united("items"))


@tidied
def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A null or empty text has no words and is clean. Items without words have no window; windows of an item without an id count as
    hits, but the item is not listed. Repeated documents give a row each; repeated items count once. An empty benchmark leaves all
    documents clean, an empty docs gives no rows. Very long texts are a segment by themselves; columns other than doc_id, item_id and text
    are not read.
    """
    matches = search(materialise(build_index(docs), "postings"), benchmark, window)
    items = F.array_join(F.array_sort("items"), ",")
    return matches.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(items, "UTF-8"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
