"""Long texts, many entities, damaged and uneven archives, small indexes: nothing grows with the square of a text, and nothing is left out."""

import gzip
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import language_model, neighbours, surrogates, warc


def within(seconds, f, *args):
    began = time.perf_counter()
    out = f(*args)
    assert time.perf_counter() - began < seconds
    return out


def test_one_long_entity():
    token = "ghp_" + "".join("abcdefghij0123456789"[k] for k in np.random.default_rng(1).integers(0, 20, 1_000_000))
    new, made = within(5, surrogates.replace, f"key {token} end", "key")
    assert len(made) == 1 and len(new) == len(token) + 8 and new[:8] == "key ghp_" and token[4:] not in new


def test_many_entities_in_one_text():
    mails = " ".join(f"user{k}@mail{k % 97}.example.com" for k in range(50_000))
    new, made = within(8, surrogates.replace, mails, "key")
    assert len(made) == 50_000 == len({x[2] for x in made})
    letters = "bcdfghklmnprst"
    names = [f"{a.upper()}{v}{b}{w}{c}o" for a in letters for v in "aei" for b in letters for w in "ou" for c in letters][:16_000]
    text = " ".join(f"Mrs. {n} and {n} met." for n in names)
    found = within(5, surrogates.mentions, text)
    assert len(found) == 2 * len(names) and [text[a:b] for a, b, _ in found] == [n for n in names for _ in range(2)]


def test_mentions_equal_an_alternation():
    """Parts of names alone, hyphens and neighbours included, against a pattern of all parts."""
    rng = np.random.default_rng(4)
    words = ["Mrs. Anna-Maria Lopez", "Mr. Jo Li", "Anna", "Maria", "Anna-Maria", "Lopez", "Li-Lopez", "Lopezs", "xLi", "Li", "-", "Jo-Li-Jo", "and", "Dr. Maria-Li Jo"]
    for _ in range(200):
        text = " ".join(words[k] for k in rng.integers(0, len(words), 12))
        found = surrogates.detect(text)
        parts = {p for a, b, kind in found if kind == "person" for p in text[a:b].split(" ")}
        want = list(found)
        if parts:
            for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})(?!\w)", text):
                if all(b <= m.start() or m.end() <= a for a, b, _ in found):
                    want.append((*m.span(), "person"))
        assert surrogates.mentions(text) == sorted(want)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_blocks_are_a_permutation(monkeypatch, size):
    """All texts of a shape, cut into blocks, have surrogates that differ from each other and from them."""
    monkeypatch.setattr(surrogates, "BLOCK", size)
    texts = [a + b + "-" + c + d for a in "aei" for b in "0123456789" for c in "aeiou" for d in "ou"]
    new = [surrogates.recast(t, "x", "key") for t in texts]
    everything = [a + b + "-" + c + d for a in "aeiou" for b in "0123456789" for c in "aeiou" for d in "aeiou"]
    assert len(set(new)) == len(texts) and all(a != b for a, b in zip(texts, new))
    assert sorted(surrogates.recast(t, "x", "key") for t in everything) == sorted(everything)


def test_phone_numbers_have_ranges_of_their_own(spark):
    """National numbers and those of country codes of every length never share a surrogate."""
    rng = np.random.default_rng(3)
    forms = ["({0}{1}{2}) {3}{4}{5}-{6}{7}{8}{9}", "+49 {0}{1} {2}{3}{4}{5}{6}{7}", "+1 ({0}{1}{2}) {3}{4}{5}-{6}{7}{8}{9}", "+420 {0}{1}{2} {3}{4}{5} {6}{7}"]
    numbers = {form.format(*rng.integers(0, 10, 10)) for form in forms for _ in range(15_000)}
    for key in ("a", "b"):
        new = {n: surrogates.surrogate("phone", n, key) for n in numbers}
        bare = lambda x: re.sub(r"[^\d+]", "", x)
        assert len({bare(x) for x in new.values()}) == len({bare(x) for x in new}) and all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) for a, b in new.items())
        assert all(b.startswith(a[:3] if a.startswith("+4") else a[:2] if a[0] == "+" else "(") for a, b in new.items())
    assert surrogates.surrogate("phone", "+4923615306", "k") == re.sub(" ", "", surrogates.surrogate("phone", "+49 23 615306", "k"))


def test_ibans_by_check_digits():
    plain = "The AB12 THIS TEXT WITH SOME WORD here"
    assert surrogates.detect(plain) == []
    text = "Pay DE89 3704 0044 0532 0130 00 THEN or GB82WEST12345698765432."
    new, made = surrogates.replace(text, "key")
    assert [x[1] for x in made] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    for _, old, put in made:
        assert old[:2] == put[:2] and old != put and surrogates._remainder(put.replace(" ", "")) == 1 and [c == " " for c in old] == [c == " " for c in put]
    assert surrogates.surrogate("iban", "DE89370400440532013000", "key") == made[0][2].replace(" ", "")


def test_false_magics_are_salvaged_in_line():
    """Bytes that look like members without being any; the record behind them is found, and time follows the bytes."""
    rng = np.random.default_rng(2)
    noise = b"".join(b"\x1f\x8b\x08" + rng.bytes(11).replace(b"WARC", b"") for _ in range(20_000))
    last = warc.record(7, "http://x/", b"payload")
    out = within(10, lambda: list(warc.salvage(noise + last + noise)))
    assert [r["page_id"] for r in out if "gap" not in r] == [7] and [r["start"] for r in out if "gap" in r] == [0, len(noise) + len(last)]


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Large pages next to each other among many small ones: no archive holds more than its bytes, but for single records."""
    sizes = [10] * 300 + [40_000] * 30 + [250_000, 5, 250_000] + [10] * 100
    rows = [(k, f"http://h/{k}", "ab"[k % 2] * n + str(k), 1, "x") for k, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int, member string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=100_000)
    held = []
    for p in (tmp_path / "w").rglob("part-*"):
        records = [r for r in warc.salvage(p.read_bytes()) if "gap" not in r]
        size = len(gzip.decompress(p.read_bytes()))
        assert size <= 100_000 or len(records) == 1
        held += [r["page_id"] for r in records]
    assert sorted(held) == list(range(len(sizes)))
    back = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert back == {k: len(h) for k, _, h, _, _ in rows}
    out = warc.round_trip(pages.select("page_id", "url", F.when(F.col("page_id") == 5, None).otherwise(F.repeat("html", F.lit(40))).alias("html"), "archive", "member"))
    assert {r["page_id"]: r["payload_bytes"] for r in out.collect()} == {k: 0 if k == 5 else 40 * len(h) for k, _, h, _, _ in rows}


def test_small_indexes_have_leaves(spark):
    """From 48 vectors on there are at least two leaves, and recall holds."""
    for n in (48, 500):
        x = np.random.default_rng(n).normal(size=(n, 16))
        assert neighbours.learn(x, n, 21, neighbours.AIM, neighbours.Shape()).probabilities(x).shape[1] >= 2
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    df = spark.createDataFrame(rows)
    found = {}
    for r in neighbours.nearest(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits.append(len(found[int(ids[i])] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_seed_takes_windows_of_every_text(spark, monkeypatch):
    """With room for all, the seed is every window of every training text, long ones too; with less, long texts are drawn from like others."""
    monkeypatch.setattr(language_model, "SEED_WINDOW", 100)
    rows = [(k, f"w{k} " * (2000 if k == 3 else 10)) for k in range(20)] + [(20, None), (21, "")]
    known = spark.createDataFrame(rows, "doc_id long, text string")
    seed = language_model._seed(known)
    assert sum(len(t) for t, _ in seed) == sum(len(t or "") for _, t in rows) and max(len(t) for t, _ in seed) == 100
    assert sum(last for _, last in seed) == 21
    monkeypatch.setattr(language_model, "SEED_BYTES", 3000)
    some = language_model._seed(known)
    assert 500 < sum(len(t) for t, _ in some) < 6000 and any(b"w3 " in t for t, _ in some)
