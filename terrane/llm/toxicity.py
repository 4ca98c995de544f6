"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, drop, fold, materialise, release, utf8
from .shingles import _MIX, WordHashes
from .text import distinct, words

#: Features are hashed to 2 ** BITS places; place 0 is the bias.
BITS = 20
#: Chosen by the log loss of a threefold cross-validation inside the training fold (sf0.1 and sf0.01), as STEMS are.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
EPOCHS = 6
#: The labelled sample: documents, and features of them all, in expectation; one share, drawn by a hash of doc_id, keeps both.
SAMPLE_ROWS, SAMPLE_FEATURES = 16_000, 60_000_000

#: Bytes of text whose features are held at once; they take some fifty times as much.
STEP_BYTES = 1 << 20

_WORDS = WordHashes()
#: Beginnings of words, in bytes, that stand in for their inflected forms.
STEMS = (4, 5, 6, 7, 8)


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, place) of every feature of some texts, repeated as it occurs: words, pairs of neighbours, pairs with one
    word between, and stems of words that are longer."""
    split = [words(t) for t in texts]
    found = list(chain.from_iterable(split))
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    text = np.repeat(np.arange(len(texts)), sizes)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    out = [(text, h * _MIX[0])]
    for gap, salt in ((1, _MIX[1]), (2, _MIX[2])):
        x = (h[:-gap] ^ salt) * _MIX[1] + h[gap:]
        same = text[:-gap] == text[gap:]
        out.append((text[:-gap][same], ((x ^ (x >> np.uint64(31))) * _MIX[2])[same]))
    letters = np.frombuffer(b"".join(found), np.uint8)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths) - lengths
    for n in STEMS:
        longer = lengths > n
        stem = np.full(int(longer.sum()), n, np.uint64)
        for k in range(n):
            stem = (stem << np.uint64(8)) | letters[starts[longer] + k]
        stem = (stem ^ (stem >> np.uint64(23))) * _MIX[1]
        out.append((text[longer], (stem ^ (stem >> np.uint64(29))) * _MIX[2]))
    return np.concatenate([o[0] for o in out]), (np.concatenate([o[1] for o in out]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct places of each text; the bias is place 0."""
    text, at = places(texts)
    keys = distinct(np.concatenate([text << BITS | at, np.arange(len(texts)) << BITS]))
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << BITS)
    return [(keys[a:b] & ((1 << BITS) - 1)).astype("<u4") for a, b in zip(cuts, cuts[1:])]


class Ftrl:
    """Per-coordinate learning rates; weights whose gradient sums stay within L1 are exactly 0."""

    def __init__(self, size: int = 1 << BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that aren't 0."""
    model, order = Ftrl(), np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.learn(*rows[k])
    w = model.weights()
    at = np.flatnonzero(w)
    return at, w[at]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=STEP_BYTES):
        found = [f.tobytes() for f in features(utf8(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "toxic", "places"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from labelled documents outside the held-out fold (crc32 of doc_id modulo 5 is 0).

    The learning task holds a sample: the documents whose hash lies below a share, which is set so that they come to sample_rows and their
    features to sample_features at most, in expectation. A document with contradicting labels counts as toxic.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, sample_rows / max(1, known.count()))
    below = lambda share: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = known.filter(below(share))
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    sample = materialise(joined.mapInArrow(_featured, "doc_id long, toxic int, places binary"), "toxic-sample")
    size = sample.agg(F.sum(F.octet_length("places"))).first()[0] or 0
    share *= min(1.0, 4 * sample_features / max(1, size))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for toxic, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((np.frombuffer(data, "<u4"), int(toxic > 0)))
        at, value = fit(rows)
        rows.clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([value.astype("<f8").tobytes()], pa.binary())], names=["at", "value"])

    # one task learns from the bounded sample, in the order of a hash
    dealt = sample.filter(below(share)).repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "places").select("toxic", "places")
    row = dealt.mapInArrow(learned, "at binary, value binary").first()
    drop(sample)
    if row is None:  # an empty sample may leave no task to learn
        return fit([])
    return np.frombuffer(row["at"], "<i8"), np.frombuffer(row["value"], "<f8")


def _sums(texts: list[bytes], dense: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's distinct features and of the bias."""
    text, place = places(texts)
    live = (dense[place] != 0) & (place != 0)
    keys = distinct(text[live] << BITS | place[live])
    return dense[0] + np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], len(texts))


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every row; whole texts, null counts as empty."""
    at, value = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[at] = value
        for batch in chunks(batches, limit=STEP_BYTES):
            texts = utf8(batch.column(1))
            total = _sums(texts, dense)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5. Null and empty texts are scored by the bias; repeated rows stay or go together."""
    at, value = train(docs, labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[at] = value
        for batch in chunks(batches, "text", STEP_BYTES):
            yield batch.filter(pa.array(_sums(utf8(batch.column(place)), dense) < 0))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Empty and null texts get the score of the bias, and so does every text where no label can be learned from. Repeated rows get a
    row each; an empty docs gives no rows. Very long texts are scored whole. Columns other than doc_id, text and toxic are not read.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
