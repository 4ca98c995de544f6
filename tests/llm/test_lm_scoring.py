"""Segments, tokens and sums of the language model (op5)."""

import numpy as np
import pyarrow as pa
import pytest

from terrane.llm import gru
from terrane.llm import language_model as lm


def test_segments_are_filled_across_batches(spark):
    """Ten rows a batch: the rows of a partition are one segment, not one for each batch, so that a token has one entry in it."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        docs = spark.range(95).selectExpr("id as doc_id", "concat('same words ', id % 3) as text", "cast(id % 7 as int) as fold").coalesce(1)
        rows = docs.mapInArrow(lm._segments, lm.SEGMENT).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == 1 and rows[0]["doc_ids"] == list(range(95))
    assert len(rows[0]["hashes"]) == 8 * 6  # the end, two words and three numbers
    assert sum(np.frombuffer(rows[0]["counts"], "<i4")) == 4 * sum(k % 7 != 2 for k in range(95))


def test_segments_are_bounded(monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1000)
    monkeypatch.setattr(lm, "PIECE_BYTES", 100)
    texts = [None if k % 11 == 0 else "ab " * (k % 17) if k != 50 else "x" * 5000 for k in range(200)]
    table = pa.table({"doc_id": range(200), "text": pa.array(texts), "fold": pa.array([0] * 200, pa.int32())})
    parts = [*lm._filled(iter(table.to_batches(max_chunksize=7)))]
    assert [t for p in parts for t in p["text"].to_pylist()] == texts
    assert all(p.nbytes < 1100 for p in parts if 50 not in p["doc_id"].to_pylist()) and 4 < len(parts) < 30
    assert max(p.nbytes for p in parts) < 5300  # the long text with no more than its piece


def test_codes_are_those_of_the_tokens():
    texts = [None, "", " ", "\t a\x0bB\x0c", "a  b\r\n", "É ß\x1cx\x85 y\xa0z", "a b", "Z.!"]
    codes, lengths, found = lm._coded(pa.array(texts))
    parts = np.split(codes, np.cumsum(lengths)[:-1])
    assert [[found[k] for k in p] for p in parts] == [lm.tokens((t or "").encode()) for t in texts]
    assert len(set(found)) == len(found)


def test_sums_by_id():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 3, 200), rng.integers(0, 300, 200), np.concatenate([np.zeros(50, int), rng.integers(0, 300, 50)])):
        rows = rng.normal(size=(len(ids), 6)).astype(np.float32)
        want = np.zeros((300, 6))
        np.add.at(want, ids, rows)
        assert gru._summed(rows, ids, 300) == pytest.approx(want, abs=1e-4)


def test_scores_of_many_documents_are_those_of_each(monkeypatch):
    monkeypatch.setattr(gru, "SLAB", 3)
    layout = gru.Layout(np.array([0, 3, 5]), 4, 0)
    w, rng = gru.start(layout, np.ones(6), np.ones(5), 5), np.random.default_rng(6)
    lengths = rng.integers(1, 120, 10)
    stream = rng.integers(1, 9, lengths.sum()).astype(np.int32)
    stream[np.cumsum(lengths) - 1] = 0
    together = gru.score_documents(w, layout, stream, lengths)
    apart = [gru.score_documents(w, layout, s, np.array([len(s)])) for s in np.split(stream, np.cumsum(lengths)[:-1])]
    assert together == pytest.approx(np.concatenate(apart), abs=1e-5)


def test_log_probabilities_are_finite_with_large_weights():
    layout = gru.Layout(np.array([0, 3, 5]), 4, 0)
    w = gru.start(layout, np.ones(6), np.ones(5), 5)
    w.wc[:] *= 1e5
    w.ww[:] *= 1e5
    states = np.random.default_rng(7).uniform(-1, 1, (9, 5)).astype(np.float32)
    logs = gru.log_probabilities(w, layout, states, np.arange(9))
    assert np.isfinite(logs).all() and logs.min() < -150
