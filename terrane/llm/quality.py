"""Quality: a factorisation machine over hashed words, statistics of a text's structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, drop, fold, materialise, release, utf8
from .shingles import _MIX, WordHashes
from .text import words

#: Words are hashed to 2 ** WORD_BITS places; behind them come LEVELS places for each statistic and each column of metadata.
WORD_BITS, LEVELS = 17, 24
RANK = 8
#: Log loss on sf0.1 depends little on them: 0.003 to 0.007 with rates of 0.02 to 0.1, decays of 2e-5 to 1e-3 and 4 to 15 epochs.
RATE, DECAY, EPOCHS, BATCH = 0.05, 2e-5, 8, 64
#: Documents of the labelled sample, and features of them all, in expectation; one share, drawn by a hash of doc_id, keeps both.
SAMPLE_ROWS, SAMPLE_FEATURES = 16_000, 8_000_000
#: Bytes of text whose features are held at once; they take some fifty times as much.
STEP_BYTES = 1 << 20
#: Columns that are taken as metadata where they are there; never label, language, source or id.
METADATA = ("n_chars",)

_WORDS = WordHashes()
#: Kinds of bytes: lower and upper case letters, digits, white space, line ends, stops, other marks, parts of characters beyond ASCII.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, OTHER = range(8)
_KIND = np.array([OTHER if c > 127 else LOWER if chr(c).islower() else UPPER if chr(c).isupper() else DIGIT if chr(c).isdigit() else LINE if chr(c) == "\n" else SPACE if chr(c).isspace() else STOP if chr(c) in ".,;:'\"-" else MARK for c in range(256)], np.uint8)


def _share(x: float) -> int:
    """Level of a share between 0 and 1: finer near 0."""
    return min(LEVELS - 1, int(LEVELS * min(1.0, max(0.0, x)) ** 0.5))


def _size(x: float) -> int:
    """Level of a size, by its logarithm."""
    return min(LEVELS - 1, int(1.5 * np.log2(1 + max(0.0, x))))


def _sum_between(marked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marked bytes lie in each stretch, both ends included."""
    upto = np.concatenate((np.zeros(1, np.int32), np.cumsum(marked, dtype=np.int32)))
    return upto[ends + 1] - upto[starts]


def structure(text: bytes) -> list[int]:
    """The level of each statistic of a text: its size, what characters it is made of, how words and lines repeat, how they end and how long they are."""
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    tokens, lines = text.split(), text.split(b"\n")
    gap = np.ones(len(kinds) + 2, bool)
    gap[1:-1] = (kinds == SPACE) | (kinds == LINE)
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[1:-1] & gap[2:])  # of tokens
    lengths = ends - starts + 1
    lower, upper, spoken = _sum_between(kinds == LOWER, starts, ends), _sum_between(kinds == UPPER, starts, ends), _sum_between((kinds <= DIGIT) | (kinds == OTHER), starts, ends)
    last = kinds[ends]
    n, m, k = max(1, len(text)), max(1, len(tokens)), len(lines)
    same = sum(map(bytes.__eq__, tokens, tokens[1:]))
    full = sum(x.rstrip()[-1:] in b".!?" for x in lines if x)
    some = lengths if len(lengths) else np.zeros(1)
    return [
        _size(len(text)), _size(len(tokens)), _size(k), _size(len(tokens) / k), _size(float(some.mean())), _size(float(some.std())), _size(float(some.max())),
        *(_share(x / n) for x in np.bincount(kinds, minlength=8).tolist()), _share(len(set(tokens)) / m), _share(len(set(lines)) / k), _share(same / m), _share(int(((upper > 0) & (lower == 0)).sum()) / m),
        _share(int((last == MARK).sum()) / m), _share(int((spoken == 0).sum()) / m), _share(int(((lengths == 1) & (last == MARK)).sum()) / m), _share(full / k),
    ]


STATISTICS = 23
SIZE = (1 << WORD_BITS) + LEVELS * (STATISTICS + len(METADATA))


def features(texts: list[bytes], metadata: list[list[float | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by text, places, values): distinct words share the weight of one feature of length 1, every statistic and column of metadata has one."""
    places, sizes, values = [], [], []
    for text, known in zip(texts, metadata):
        found = set(words(text))
        at = np.unique(np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found)) * _MIX[0] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        levels = structure(text) + [0 if x is None or x != x else 1 + min(LEVELS - 2, _size(x)) for x in known]
        level = np.array(levels, np.int64) + np.arange(len(levels)) * LEVELS + (1 << WORD_BITS)
        places += [at, level]
        values += [np.full(len(at), 1 / max(1, len(at)) ** 0.5), np.ones(len(level))]
        sizes.append(len(at) + len(level))
    return np.cumsum([0, *sizes]), np.concatenate(places) if places else np.empty(0, np.int64), np.concatenate(values) if values else np.empty(0)


class FactorisationMachine:
    """bias + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, the pairs as half of (sum v x)^2 - sum (v x)^2 in every factor."""

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = 11):
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32).astype(float)
        self.seen = np.zeros(size, bool)

    def sums(self, offsets: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The raw score and the sums of v x, by text; every text has features."""
        if len(offsets) < 2:
            return np.empty(0), np.empty((0, self.v.shape[1]))
        xv = x[:, None] * self.v[at]
        total = np.add.reduceat(xv, offsets[:-1])
        pairs = (total**2 - np.add.reduceat(xv**2, offsets[:-1])).sum(1) / 2
        return self.bias + np.add.reduceat(self.w[at] * x, offsets[:-1]) + pairs, total

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> FactorisationMachine:
        """Adaptive gradient steps over small batches; what no row has stays out of the model (its weight is 0, its factors are 0)."""
        rng = np.random.default_rng(3)
        for at, _, _ in rows:
            self.seen[at] = True
        self.v[~self.seen] = 0
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(len(self.v), 1e-6), 1e-6
        share = min(max(np.mean([y for _, _, y in rows]), 1e-3), 1 - 1e-3) if rows else 0.5
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for cut in range(0, len(rows), BATCH):
                some = [rows[k] for k in order[cut : cut + BATCH]]
                sizes = [len(a) for a, _, _ in some]
                offsets, at, x = np.cumsum([0, *sizes]), np.concatenate([a for a, _, _ in some]), np.concatenate([b for _, b, _ in some])
                raw, total = self.sums(offsets, at, x)
                g = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - np.array([y for _, _, y in some])) / len(some)
                own = np.repeat(np.arange(len(some)), sizes)
                places, inverse = np.unique(at, return_inverse=True)
                d = g[own] * x
                dw = np.bincount(inverse, d, len(places)) + decay * self.w[places]
                moved = d[:, None] * (total[own] - x[:, None] * self.v[at])
                dv = np.stack([np.bincount(inverse, moved[:, f], len(places)) for f in range(moved.shape[1])], 1) + decay * self.v[places]
                gw[places] += dw**2
                gv[places] += (dv**2).mean(1)
                gb += g.sum() ** 2
                self.w[places] -= rate * dw / np.sqrt(gw[places])
                self.v[places] -= rate * dv / np.sqrt(gv[places])[:, None]
                self.bias -= rate * g.sum() / np.sqrt(gb)
        return self

    def packed(self) -> dict[str, bytes | float]:
        at = np.flatnonzero(self.seen)
        return {"bias": float(self.bias), "at": at.astype("<i8").tobytes(), "w": self.w[at].astype("<f8").tobytes(), "v": self.v[at].astype("<f4").tobytes()}

    @classmethod
    def unpacked(cls, bias: float, at: bytes, w: bytes, v: bytes, size: int = SIZE, rank: int = RANK) -> FactorisationMachine:
        self = cls.__new__(cls)
        places = np.frombuffer(at, "<i8")
        self.bias, self.w, self.v = bias, np.zeros(size), np.zeros((size, rank), np.float32)
        self.w[places], self.v[places] = np.frombuffer(w, "<f8"), np.frombuffer(v, "<f4").reshape(-1, rank)
        return self


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, text and metadata; a column of metadata that isn't there, or isn't a number, is null."""
    given = {c: t for c, t in docs.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *((F.col(c) if c in given else F.lit(None)).cast("double").alias(c) for c in METADATA))


def _known(batch: pa.RecordBatch) -> list[list[float | None]]:
    return [list(x) for x in zip(*(batch.column(c).to_pylist() for c in METADATA))]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=STEP_BYTES):
        offsets, at, x = features(utf8(batch.column("text")), _known(batch))
        cuts = list(zip(offsets[:-1], offsets[1:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([at[a:b].astype("<i4").tobytes() for a, b in cuts], pa.binary()), pa.array([x[a:b].astype("<f4").tobytes() for a, b in cuts], pa.binary())], names=["doc_id", "quality", "places", "amounts"]
        )


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), int(y)) for batch in batches for y, at, x in zip(*(c.to_pylist() for c in batch.columns))]
    if rows:
        made = FactorisationMachine().fit(rows).packed()
        rows.clear()
        release()
        yield pa.RecordBatch.from_pylist([made], pa.schema([("bias", pa.float64()), ("at", pa.binary()), ("w", pa.binary()), ("v", pa.binary())]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> dict[str, bytes | float]:
    """The model learned from labelled documents outside the held-out fold (crc32 of doc_id modulo 5 is 0), packed.

    One task learns from a sample: the documents whose hash lies below a share, set so that they come to sample_rows and their features to
    sample_features at most, in expectation. A document with contradicting labels counts as bad, any label above 0 as good.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold("doc_id", 5) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("quality"))
    share = min(1.0, sample_rows / max(1, known.count()))
    below = lambda share: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    # sent to every task: 12 bytes for each of sample_rows documents
    joined = _read(docs).join(F.broadcast(known.filter(below(share))), "doc_id").select("doc_id", "text", *METADATA, "quality")
    sample = materialise(joined.mapInArrow(_featured, "doc_id long, quality int, places binary, amounts binary"), "quality-sample")
    size = sample.agg(F.sum(F.octet_length("places"))).first()[0] or 0
    share *= min(1.0, 4 * sample_features / max(1, size))
    # in the order of a hash, so that the layout of the input changes nothing
    dealt = sample.filter(below(share)).repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "places").select("quality", "places", "amounts")
    row = dealt.mapInArrow(_learned, "bias double, at binary, w binary, v binary").first()
    drop(sample)
    return row.asDict() if row else FactorisationMachine().fit([]).packed()  # nothing to learn from


def score(docs: DataFrame, model: dict[str, bytes | float]) -> DataFrame:
    """doc_id and score of every row; whole texts, null counts as empty. The model (what the sample holds, 44 bytes a feature) goes to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorisationMachine.unpacked(**model)
        for batch in chunks(batches, limit=STEP_BYTES):
            raw, _ = machine.sums(*features(utf8(batch.column("text")), _known(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))], names=["doc_id", "score"])

    return _read(docs).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of `least` on) for every row of docs.

    Null and empty texts are scored by the bias and the statistics of an empty text; where no label can be learned from, every text gets 0.5.
    Repeated rows get a row each; an empty docs gives no rows; very long texts are scored whole. Columns other than doc_id, text and n_chars
    are not read.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
