"""Language identification: scripts narrow the candidates of each word, Viterbi with a switching penalty labels spans."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, fold, utf8
from .shingles import _MIX
from .text import letter_words

#: Byte n-grams of 1 to ORDER bytes, hashed to 2 ** BITS places for each language.
ORDER, BITS = 4, 16
#: Overlapping n-grams count a letter several times; log scores of a word are divided by this.
OVERLAP = 3.0
SWITCH = 8.0
#: A language is a candidate for a script that at least this share of its training words has.
SCRIPT_SHARE = 0.002
#: Expected training documents of each language, drawn by a hash of doc_id.
SAMPLE_ROWS = 1500
CHUNK = 12 << 20
#: First and last code point of the scripts told apart; anything else is Latin.
SCRIPTS = [
    ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = ["latin", *dict.fromkeys(s[0] for s in SCRIPTS)]
_STARTS, _ENDS, _CODES = np.array([s[1] for s in SCRIPTS]), np.array([s[2] for s in SCRIPTS]), np.array([NAMES.index(s[0]) for s in SCRIPTS])


def script(word: bytes) -> int:
    """Number of the script of the first character of a word that isn't Latin, or 0."""
    if not word.isascii():
        for c in map(ord, word.decode("utf-8", "replace")):
            k = int(np.searchsorted(_STARTS, c, side="right")) - 1
            if k >= 0 and c <= _ENDS[k]:
                return int(_CODES[k])
    return 0


def distinct_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the word number at each place of all texts, and the number of words of each text."""
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    found = [letter_words(t) for t in texts]
    lengths = np.array([len(f) for f in found], np.int64)
    at = np.fromiter((number[w] for f in found for w in f), np.int64, int(lengths.sum()))
    return list(number), at, lengths


def grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the n-grams of all words, with a space on either side, and where those of each word start."""
    data = np.frombuffer(b" " + b" ".join(vocabulary) + b" " * ORDER, np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in vocabulary], np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    end = int(sizes.sum())
    rolled, places = np.zeros(end, np.uint64), np.empty((end, ORDER), np.int64)
    for n in range(ORDER):  # n-grams that reach into the next word see its first letters at most; the space marks the border
        rolled = (rolled ^ data[n : n + end]) * _MIX[0]
        rolled ^= rolled >> np.uint64(29)
        places[:, n] = ((rolled * _MIX[2]) >> np.uint64(64 - BITS)).astype(np.int64)
    inside = np.repeat(starts + sizes, sizes) + 1 - np.arange(end)  # bytes from here to the closing space
    places[np.arange(1, ORDER + 1) > inside[:, None]] = 1 << BITS  # a place without weight
    return places, starts


class Model:
    """Log probabilities of n-grams in each language and the scripts it is written in."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        smooth = counts + 0.5
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) / OVERLAP
        if languages:
            logs -= logs.mean(axis=0)
        self.languages, self.logs = languages, np.vstack([logs.T, np.zeros(len(languages))]).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        open_ = share.T >= SCRIPT_SHARE
        self.barred = np.where(open_ | ~open_.any(axis=1, keepdims=True), 0, -1e4).astype(np.float32)

    def word_scores(self, vocabulary: list[bytes]) -> np.ndarray:
        places, starts = grams(vocabulary)
        out = sum(np.add.reduceat(self.logs[places[:, n]], starts) for n in range(ORDER))
        return out + self.barred[[script(w) for w in vocabulary]]


def viterbi(scores: np.ndarray, at: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word of each text: highest sum of word scores less `switch` for each change.

    Texts go forward together, longest first; ties stay with the language before, or go to the smaller number.
    """
    n_lang = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts longer than t
    kind = np.int8 if n_lang < 128 else np.int32
    came = np.empty((len(at), n_lang), kind)
    own = np.arange(n_lang, dtype=kind)
    value = np.zeros((len(sizes), n_lang), np.float32)
    for t, n in enumerate(active):
        v = value[:n]
        place = begins[:n] + t
        if t:
            top = v.argmax(axis=1)
            change = v[np.arange(n), top][:, None] - switch
            moved = change > v
            came[place] = np.where(moved, top[:, None], own)
            v = np.where(moved, change, v)
        value[:n] = v + scores[at[place]]
    out = np.empty(len(at), kind)
    now = value.argmax(axis=1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        place = begins[:n] + t
        out[place] = now[:n]
        if t:
            now[:n] = came[place, now[:n]]
    return out


def _counted(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scripts = np.zeros((len(languages), (1 << BITS) + 1), np.int64), np.zeros((len(languages), len(NAMES)), np.int64)
        for batch in chunks(batches):
            lang = np.array([languages.index(x) for x in batch.column(1).to_pylist()])
            vocabulary, at, lengths = distinct_words(utf8(batch.column(0)))
            if not vocabulary:
                continue
            places, starts = grams(vocabulary)
            kinds = np.array([script(w) for w in vocabulary])
            of = np.repeat(lang, lengths)
            for k in np.unique(of):
                times = np.bincount(at[of == k], minlength=len(vocabulary))
                each = np.repeat(times, np.diff(np.append(starts, len(places))))
                for n in range(ORDER):
                    counts[k] += np.bincount(places[:, n], weights=each, minlength=counts.shape[1]).astype(np.int64)
                scripts[k] += np.bincount(kinds, weights=times, minlength=len(NAMES)).astype(np.int64)
        for k in np.flatnonzero(scripts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([counts[k, :-1].tobytes()], pa.binary()), pa.array([scripts[k].tobytes()], pa.binary())], names=["lang", "counts", "scripts"])

    return run


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    add = lambda c: sum(np.frombuffer(x, np.int64) for x in rows.column(c).to_pylist()).tobytes()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([add("counts")], pa.binary()), "scripts": pa.array([add("scripts")], pa.binary())})


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages of documents whose crc32 of doc_id modulo 3 is not 1 and whose lang and text are known.

    About sample_rows documents of each language, chosen by a hash of doc_id, are read; their counts are summed on the executors, so
    one vector for each language comes to the driver.
    """
    known = docs.filter((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"), F.xxhash64("doc_id").alias("h"))
    sizes = known.groupBy("lang").count().orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.ones((0, 1 << BITS)), np.ones((0, len(NAMES))))
    limit = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1 << 30, -(-(sample_rows << 30) // r["count"])))])
    sample = known.filter(F.pmod("h", F.lit(1 << 30)) < limit[F.col("lang")]).select("text", "lang")
    counted = sample.mapInArrow(_counted(languages), "lang int, counts binary, scripts binary")
    for n in (16, 1):
        counted = counted.groupBy("lang", F.pmod(F.xxhash64("counts"), F.lit(n)).alias("_part")).applyInArrow(_summed, "lang int, counts binary, scripts binary")
    rows = {r["lang"]: r for r in counted.collect()}
    read = lambda c, n: np.array([np.frombuffer(rows[k][c], np.int64) if k in rows else np.zeros(n, np.int64) for k in range(len(languages))])
    return Model(languages, read("counts", 1 << BITS), read("scripts", len(NAMES)))


def _has_letter(text: bytes) -> bool:
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in text) if text.isascii() else any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row, with spans=True also the labelled spans of words (from, to, lang).

    lang_pred is the language whose spans hold the most bytes of words (ties: first by name), score their share. Texts that are
    null or have no letter are `und` with score 0, and so is every text if no language is known.
    """
    fields = "doc_id long, lang_pred string, score double" + ", spans array<struct<from:int,to:int,lang:string>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            texts = utf8(batch.column(1))
            vocabulary, at, lengths = distinct_words(texts)
            pred, score, found = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if vocabulary and model.languages:
                labels = viterbi(model.word_scores(vocabulary), at, lengths)
                size = np.array([len(w) for w in vocabulary])[at]
                begins = np.cumsum(lengths) - lengths
                text_of = np.repeat(np.arange(len(texts)), lengths)
                mass = np.bincount(text_of * len(model.languages) + labels.astype(np.int64), weights=size, minlength=len(texts) * len(model.languages)).reshape(len(texts), -1)
                best = mass.argmax(axis=1)
                for k, text in enumerate(texts):
                    if lengths[k] and _has_letter(text[:64]) or lengths[k] and _has_letter(text):
                        pred[k], score[k] = model.languages[best[k]], float(mass[k, best[k]] / mass[k].sum())
                        if spans:
                            own = labels[begins[k] : begins[k] + lengths[k]]
                            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                            found[k] = [{"from": a, "to": b, "lang": model.languages[own[a]]} for a, b in zip(cuts, cuts[1:])]
            columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Repeated rows get a row each; an empty table gives no rows. Very long texts are labelled whole. Only training reads lang; source, doc_id
    and other columns are never inputs.
    """
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
