"""The factorisation machine against its definition, and its held-out accuracy."""

import numpy as np
import pytest

from terrane.llm import quality, queries


def plain_sum(m, at, x):
    """The score with every pair written out."""
    pairs = sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
    return m.bias + sum(m.w[a] * b for a, b in zip(at, x)) + pairs


def rows_of(rng, n, places=40):
    out = []
    for _ in range(n):
        at = np.sort(rng.choice(places, rng.integers(1, 9), replace=False))
        out.append((at.astype(np.int64), rng.uniform(0.2, 1, len(at)), int((3 in at) != (5 in at))))
    return out


def test_linear_time_equals_pairs():
    rng = np.random.default_rng(1)
    rows = rows_of(rng, 50)
    m = quality.FactorisationMachine(size=40, rank=4).fit(rows, epochs=2)
    raw, _ = m.sums(np.cumsum([0] + [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
    assert np.allclose(raw, [plain_sum(m, *r[:2]) for r in rows])
    again = quality.FactorisationMachine.unpacked(**m.packed(), size=40, rank=4)
    assert np.allclose(again.w, m.w) and np.allclose(again.v, m.v, atol=1e-6)


def test_gradient_against_differences():
    """One small step goes down the loss along its numerical gradient, in weights and factors."""
    rows = rows_of(np.random.default_rng(2), 8, places=12)

    def loss(m):
        p = [1 / (1 + np.exp(-plain_sum(m, *r[:2]))) for r in rows]
        return -np.mean([np.log(q if r[2] else 1 - q) for q, r in zip(p, rows)])

    def start():
        m = quality.FactorisationMachine(size=12, rank=2)
        m.fit(rows, epochs=0)
        return m

    before, after = start(), start().fit(rows, epochs=1, rate=1e-4, decay=0)
    for name in ("w", "v"):
        moved = getattr(after, name) - getattr(before, name)
        for place in zip(*np.nonzero(np.abs(moved) > 1e-6)):
            m = start()
            getattr(m, name)[place] += 1e-5
            assert np.sign(loss(m) - loss(before)) == -np.sign(moved[place])


def test_pairs_are_learned():
    """An exclusive or of two features, which no linear model separates."""
    rng = np.random.default_rng(3)
    rows, held = rows_of(rng, 4000), rows_of(rng, 500)
    m = quality.FactorisationMachine(size=40).fit(rows, epochs=60, rate=0.2)
    assert np.mean([(plain_sum(m, *r[:2]) > 0) == r[2] for r in held]) > 0.95


def test_op11_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op11_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = [r["score"] for r in held if not labels[r["doc_id"]]], [r["score"] for r in held if labels[r["doc_id"]]]
    assert len(held) > 500 and np.mean(np.array(bad) < 0.3) >= 0.95 and np.mean(np.array(good) >= 0.3) >= 0.995
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize("n_chars", ["long", "string", None])
def test_odd_documents(spark, n_chars):
    """Null, empty, long and repeated texts, ids without label, contradicting labels, clashing names; nothing to learn from."""
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b c " * 50_000), (4, "a b c " * 50_000), (None, "no id"), (5, "ñ 日本"), (6, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, None if i == 3 else 7, "en", 0.1, 2) for i, t in rows], "doc_id long, text string, n_chars long, lang string, score double, quality int")
    df = df.drop("n_chars") if n_chars is None else df.withColumn("n_chars", df["n_chars"].cast(n_chars))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 1), (None, 1, 0), (4, 1, 0), (6, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        out = quality.quality(df, given).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in out} == {0.5}
    assert quality.quality(df.limit(0), labels).count() == 0
