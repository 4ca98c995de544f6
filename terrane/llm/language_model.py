"""LM scoring: exact add-one unigram scores and a gated recurrent model, both learned from the training fold.

1. Documents become segments, filled across the batches of a partition: token numbers with a dictionary of the segment (64-bit hashes of
   its tokens, their tail classes and their counts in training documents), written once.
2. Counts of all training tokens are summed over the dictionaries. The most frequent tokens make the short list.
3. A model is started on a bounded sample; then every partition trains it further on all of its own training documents, and the
   weights are averaged slice by slice in a tree. Scores therefore depend, in small measure, on how the rows are dealt to partitions.
4. The tokens of every dictionary meet their counts in a join, those that differ from the segment's own return to it, and each segment
   is scored with them: whole texts, the recurrent state carried through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .shared import chunks, fold, materialise, tidied

#: Bytes of a segment's rows, and of text of the pieces it is filled with; a text beyond them is a piece, or a segment, by itself.
SEGMENT_BYTES, PIECE_BYTES = 24 << 20, 1 << 20
#: Words of the short list, and classes they are dealt to.
WORDS, HEADS = 1024, 32
SUFFIXES = 12
TAILS = 4 * 2 * SUFFIXES
HIDDEN = 24
#: Expected bytes of the sample on which a model is started, characters of the windows it is drawn from, and passes over it.
SEED_BYTES, SEED_WINDOW, SEED_PASSES = 4 << 20, 1 << 16, 3
SEED_RATE, RATE = 6e-3, 4e-3
#: Lanes and steps of a window of the training over all documents; many lanes keep the cost of a token low.
LANES, STEPS = 512, 16
#: Slices of the weights that are averaged apart, and how many sets of them a task takes in.
SLICES, FAN_IN = 64, 256
FOLDS, HELD_OUT = 7, 2
SEGMENT = "segment long, doc_ids array<long>, folds binary, lengths binary, codes binary, hashes binary, tails binary, counts binary"
_END = b""
_TRAIL = bytes(c for c in range(128) if chr(c) not in "0123456789abcdefghijklmnopqrstuvwxyz")


def tail_class(token: bytes) -> int:
    """Class by what a token ends with: punctuation, the hash of its last two letters, and whether it is long."""
    core = token.rstrip(_TRAIL)
    trail = token[len(core) :]
    kind = 0 if not trail else 1 if trail == b"," else 2 if trail == b"." else 3
    return (kind * 2 + (len(core) > 8)) * SUFFIXES + zlib.crc32(core[-2:]) % SUFFIXES


def tokens(text: bytes) -> list[bytes]:
    """Words parted by ASCII white space, A-Z lower-cased, and the end."""
    return [*text.lower().split(), _END]


def _packed(codes: np.ndarray) -> bytes:
    """Codes by byte planes, compressed; most of them are small."""
    return zstandard.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a segment each, from as many batches as it takes."""
    held, size = [], 0
    for piece in chunks(batches, limit=PIECE_BYTES):
        if held and size + piece.nbytes > SEGMENT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(piece)
        size += piece.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Token numbers of all texts, tokens of each, and the tokens by number, the end first."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, n = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(pc.binary_length(found), 0)  # white space around a text leaves empty words
    kept = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)))[np.concatenate(([0], np.cumsum(n)))]
    found = found.filter(some).dictionary_encode()
    lengths = np.diff(kept) + 1
    codes = np.zeros(int(lengths.sum()), "<i4")
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(lengths) - 1] = False
    codes[inner] = found.indices.to_numpy() + 1
    return codes, lengths, [_END, *found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for n, rows in enumerate(_filled(batches)):
        ids, texts, folds = (c.chunk(0) for c in rows.columns)
        flat, lengths, found = _coded(texts)
        folds = np.array(folds.to_pylist(), "<i1")
        counts = np.bincount(flat[np.repeat(folds != HELD_OUT, lengths)], minlength=len(found))
        cells = (
            [part << 32 | n],
            [ids.to_pylist()],
            *([x if isinstance(x, bytes) else x.tobytes()] for x in (folds, lengths.astype("<i8"), _packed(flat), np.array([xxhash.xxh3_64_intdigest(w) for w in found], "<u8"), np.array([tail_class(w) for w in found], "<u1"), counts.astype("<i4"))),
        )
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6))], names=["segment", "doc_ids", "folds", "lengths", "codes", "hashes", "tails", "counts"])


def _entries(counted: bool):
    """Dictionary entries as rows: those with training counts, or all with their segment, place and count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment, hashes, tails, counts = (c[i].as_py() for c in batch.columns)
                h, tail, c = np.frombuffer(hashes, "<i8"), np.frombuffer(tails, "<u1"), np.frombuffer(counts, "<i4")
                if counted:
                    some = c > 0
                    yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(tail[some].astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["h", "tail", "c"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), segment)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(c)], names=["h", "segment", "place", "own"])

    return run


class Vocabulary:
    """The short list by hash, its classes, and the masses of the tail classes."""

    def __init__(self, words: list[tuple[int, int]], tails: dict[int, tuple[int, int]], total: int, distinct: int):
        """words: (hash, count), most frequent first; tails: (sum of counts, distinct tokens) of each tail class."""
        self.total, self.distinct = total, distinct
        count = np.array([c for _, c in words], np.float64)
        self.end = next((k for k, (h, _) in enumerate(words) if h == end_hash()), None)
        edges = np.searchsorted(np.cumsum(count), np.arange(1, HEADS) * count.sum() / HEADS) + 1 if words else []
        self.bounds = np.unique(np.concatenate(([0], edges, [len(words)]))).astype(np.int64) if words else np.array([0], np.int64)
        order = np.argsort([h for h, _ in words]) if words else np.array([], np.int64)
        self.hashes, self.numbers = np.array([words[k][0] for k in order], np.int64), order.astype(np.int64)
        self.counts = count
        self.mass = np.array([sum(tails.get(k, (0, 0))) + 1 for k in range(TAILS)], np.float64)

    def layout(self) -> gru.Layout:
        return gru.Layout(self.bounds, TAILS, self.end if self.end is not None else len(self.counts) + tail_class(_END))

    def numbered(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Word numbers of dictionary entries."""
        if not len(self.hashes):
            return tails.astype(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], len(self.counts) + tails.astype(np.int64))

    def start(self) -> gru.Weights:
        layout = self.layout()
        heads = np.add.reduceat(self.counts, self.bounds[:-1]) if layout.n_heads else np.array([])
        return gru.start(layout, np.concatenate([heads, self.mass]) + 1.0, self.counts + 1.0, HIDDEN)


def end_hash() -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(_END), np.uint64).view(np.int64))


def _read(batch: pa.RecordBatch, row: int, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """Places in the dictionary and word numbers by them, lengths and folds of a segment (folds, lengths, codes, hashes, tails)."""
    folds, lengths, hashes, tails = (np.frombuffer(batch.column(k)[row].as_py(), t) for k, t in (("folds", "<i1"), ("lengths", "<i8"), ("hashes", "<i8"), ("tails", "<u1")))
    return _unpacked(batch.column("codes")[row].as_py()), vocabulary.numbered(hashes, tails).astype(np.int32), lengths, folds


def _taught(vocabulary: Vocabulary, weights: gru.Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = gru.Trainer(weights, vocabulary.layout(), RATE, LANES, STEPS), 0
        for batch in batches:
            for row in range(batch.num_rows):
                codes, numbers, lengths, folds = _read(batch, row, vocabulary)
                seen += trainer.learn(numbers[codes[np.repeat(folds != HELD_OUT, lengths)]])
        if seen:
            parts = np.array_split(np.frombuffer(trainer.w.flat(), np.float32), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([seen] * SLICES, pa.int64())], names=["slice", "weights", "seen"])

    return run


def _averaged(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("seen", "ascending"), ("weights", "ascending")])  # one order of adding, whatever comes first
    seen = np.array(rows.column("seen").to_pylist(), np.float64)
    total = sum(np.frombuffer(x.as_py(), np.float32) * s for x, s in zip(rows.column("weights"), seen / seen.sum()))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary()), "seen": pa.array([int(seen.sum())], pa.int64())})


def _seed(known: DataFrame) -> list[tuple[bytes, bool]]:
    """Windows of texts, and whether a text ends there, that come to SEED_BYTES in expectation, in the order of a hash. Texts up to SEED_WINDOW characters are
    one window; every window of every text can be drawn, whatever the text's length."""
    size = known.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    limit = min(1 << 30, -(-(SEED_BYTES << 30) // size))
    begins = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(SEED_WINDOW))
    windows = known.filter("text is not null").withColumn("at", F.explode(begins)).withColumn("last", F.col("at") + SEED_WINDOW > F.length("text"))
    windows = windows.withColumn("text", F.when(F.col("last") & (F.col("at") == 1), F.col("text")).otherwise(F.substring("text", F.col("at"), F.lit(SEED_WINDOW))))
    sample = windows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < limit).select(F.encode("text", "UTF-8").alias("text"), "last", "at", F.xxhash64("doc_id", F.lit(1)).alias("h"))
    return [(bytes(r["text"]), r["last"]) for r in sample.orderBy("h", "at", "text").collect()]


def train(segments: DataFrame, docs: DataFrame, vocabulary: Vocabulary) -> gru.Weights:
    """docs: doc_id, text, fold. Every training document is learned from; the seed only decides where that begins."""
    trainer = gru.Trainer(vocabulary.start(), vocabulary.layout(), SEED_RATE)
    found = [w for t, last in _seed(docs.filter(F.col("fold") != HELD_OUT)) for w in tokens(t)[: None if last else -1]]
    if found:
        distinct = list(dict.fromkeys(found))
        number = dict(zip(distinct, vocabulary.numbered(np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64).view(np.int64), np.array([tail_class(w) for w in distinct]))))
        stream = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        for k in range(SEED_PASSES):
            trainer.learn(stream, (1 - k / SEED_PASSES * 0.8, 1 - (k + 1) / SEED_PASSES * 0.8))
    schema = "slice int, weights binary, seen long"
    taught = materialise(segments.select("folds", "lengths", "codes", "hashes", "tails").mapInArrow(_taught(vocabulary, trainer.w), schema), "weights")
    n = taught.count() // SLICES
    while n > 1:  # a tree, so that no task holds more than some FAN_IN slices of one place
        n = -(-n // FAN_IN)
        taught = taught.groupBy("slice", F.pmod(F.xxhash64("weights"), F.lit(n))).applyInArrow(_averaged, schema)
    rows = sorted(taught.collect(), key=lambda r: r["slice"])
    return trainer.w.filled(np.frombuffer(b"".join(bytes(r["weights"]) for r in rows), np.float32)) if rows else trainer.w


def _scored(vocabulary: Vocabulary, weights: gru.Weights):
    layout = vocabulary.layout()
    names = ("doc_id", "fold", "n_tokens", "n_known", "base_score", "score")

    def run(key: tuple, segment: pa.Table, found: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        for row in range(len(segment)):
            codes, numbers, lengths, folds = _read(segment, row, vocabulary)
            tails = np.frombuffer(segment.column("tails")[row].as_py(), "<u1").astype(np.int64)
            count = np.frombuffer(segment.column("counts")[row].as_py(), "<i4").astype(np.float64)  # right unless other segments have the token
            count[found.column("place").to_numpy()] = found.column("c").to_numpy()
            base = np.log10((count + 1) / (vocabulary.total + (vocabulary.distinct + 1)))
            inner = np.where(numbers < layout.n_words, 0.0, np.log((count + 1) / vocabulary.mass[tails]))
            logs = gru.score_documents(weights, layout, numbers[codes], lengths)
            logs += inner[codes]
            begins = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x[codes], begins) for x in ((count > 0).astype(np.int64), base)] + [np.add.reduceat(logs, begins)]
            for o, x in zip(out, (segment.column("doc_ids")[row].as_py(), folds, lengths, sums[0], sums[1], sums[2] / np.log(10))):
                o.extend(x if isinstance(x, list) else x.tolist())
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({n: pa.array(o, t) for n, o, t in zip(names, out, types)})

    return run


@tidied
def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from documents whose crc32 of doc_id modulo 7 is not 2. A null or empty text is the end token alone. Without training
    documents every token is unknown. Repeated rows get a row each; an empty table gives no rows. Tokens are told apart by 64-bit
    hashes. base_score adds log10((c+1)/(N+V+1)); score is the recurrent model's, where an unseen token has the weight of one
    training token in its tail class. Very long texts are scored whole, a segment by themselves; columns other than doc_id and text are
    not read.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), fold("doc_id", FOLDS).cast("int").alias("fold"))
    segments = materialise(source.mapInArrow(_segments, SEGMENT), "segments")
    entries = segments.select("segment", "hashes", "tails", "counts")
    counts = materialise(entries.mapInArrow(_entries(True), "h long, tail int, c long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c")), "counts")
    words = counts.orderBy(F.desc("c"), "h").limit(WORDS).collect()
    listed = [r["h"] for r in words]
    tails = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    mass = {r["tail"]: [r["c"], r["n"]] for r in tails}
    total, distinct = sum(m[0] for m in mass.values()), sum(m[1] for m in mass.values())
    for r in words:
        mass[r["tail"]][0] -= r["c"]
        mass[r["tail"]][1] -= 1
    vocabulary = Vocabulary([(h, r["c"]) for h, r in zip(listed, words)], {k: tuple(v) for k, v in mass.items()}, total, distinct)
    weights = train(segments, source, vocabulary)
    asked = entries.mapInArrow(_entries(False), "h long, segment long, place int, own int").join(counts.select("h", "c"), "h").filter("c <> own").select("segment", "place", "c")
    scored = segments.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(_scored(vocabulary, weights), "doc_id long, fold int, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
