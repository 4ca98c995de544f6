"""Importance resampling against a plain version, and its ring against CRCs of whole runs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terrane.llm import importance, queries, text


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def buckets(t, width, size):
    w = words(t)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % size for n in range(1, width + 1) for i in range(len(w) - n + 1))


def plain(docs, target, width=1, size=10_000, least=20, percent=10):
    corpus, wanted = sum((buckets(t, width, size) for _, t in docs), Counter()), sum((buckets(t, width, size) for t in target), Counter())
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + size) / ((corpus[b] + 1) * (t + size)))) for b in corpus}
    out = []
    for i, body in docs:
        found = buckets(body, width, size)
        weight = sum(gain[b] * n for b, n in found.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(body))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("width", [1, 2, 4])
def test_ring(monkeypatch, width):
    monkeypatch.setattr(text.word_blocks, "__defaults__", (50,))
    rng = np.random.default_rng(width)
    for _ in range(50):
        t = "".join(["a", "B", " ", "-", "ñ", "7", "日本"][k] for k in rng.integers(0, 7, rng.integers(0, 900)))
        n, found = importance.bucket_list(t.encode(), width, 997)
        assert n == len(words(t)) and Counter(found.tolist()) == buckets(t, width, 997)


@pytest.mark.parametrize("width", [1, 3])
def test_resampled(spark, width):
    sf = "/root/testdata/sf0.001"
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], width)
    out = queries.op13_importance_resampling(spark, sf) if width == 1 else importance.resampled(docs, target, width)
    assert got(out) == want and sum(r[4] is not None for r in want) > 5


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " - "), (4, "one " * 19), (5, "one " * 20), (6, "Two, " * 21), (None, "x " * 30), (7, "long words here " * 40_000), *[(i, f"w{i} " * 25) for i in range(10, 40)]]
    df = spark.createDataFrame([(i, t, 1, "k", 2.0) for i, t in rows], "doc_id long, text string, rank int, `weight` string, score double")
    target = df.selectExpr("doc_id item_id", "text").filter("item_id % 3 = 0 or item_id is null")
    assert got(importance.resampled(df, target)) == plain(rows, [r["text"] for r in target.collect()])
    assert importance.resampled(df.limit(0), target).count() == 0
    assert got(importance.resampled(df, target.limit(0))) == plain(rows, [])
    many = df.filter("doc_id = 5").crossJoin(spark.range(400)).select("doc_id", "text")  # repeated rows are drawn each
    assert sorted(r["rank"] for r in importance.resampled(many, target).filter("rank is not null").collect()) == list(range(1, 41))
