"""Conversation repair against exhaustive search over edits."""

import hashlib
import re
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import queries, turns

LEGAL = ("su", "ua", "au")


def plain(rows):
    """Result of a conversation's rows (turn, role, text) in order, by trying every edit of every row."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))

    after = {"": ("user", "system"), "s": ("user",), "u": ("assistant",), "a": ("user",)}  # by the initial of the role written last

    @cache
    def edited(j, made):
        """Row j deleted, kept or given another role, nothing before it."""
        _, role, text = rows[j]
        more, ways = 3 if faults[j] == "t" else 0, []

        def then(price, letter, to, line):
            c, a, out = best(j + 1, to)
            ways.append((price + c, letter + a, line + out))

        then(4, "D", made, ())
        if faults[j] not in ("b", "d"):
            if role[:1] in [r[0] for r in after[made]]:
                then(more, "K", role[:1], (f"{role}:{text}",))
            for to in set(after[made]) - {"system"}:
                then(3 + more, "R", to[0], (f"{to}:{text}",))
        return min(ways)

    @cache
    def best(j, made):
        """Up to three rows inserted, then row j or the end."""
        ways, lines = [], ()
        for k in range(4):
            if j < len(rows):
                c, a, out = edited(j, made)
                ways.append((3 * k + c, "I" * k + a, lines + out))
            elif made in ("", "a"):
                ways.append((3 * k, "I" * k, lines))
            to = after[made][0]
            made, lines = to[0], (*lines, f"{to}:")
        return min(ways)

    cost, audit, out = best(0, "")
    turns_ = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in LEGAL for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def results(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def drawn(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", " ", "user", "assistant", "u"], ["a.", "b", " ", "c!", "", "a.", "x y", "d?\n", "e. \t"]
    return [(None if rng.random() < 0.1 else int(rng.integers(0, n + 3)), roles[rng.integers(0, len(roles))], texts[rng.integers(0, len(texts))] if rng.random() < 0.5 else f"t{rng.integers(0, 10**6)}{'.' if rng.random() < 0.6 else ''}") for _ in range(n)]


def frame(spark, found):
    return spark.createDataFrame([(c, *r, 1) for c, rows in found.items() for r in rows], "conv_id long, turn long, role string, text string, n long")


def test_layers_equal_exhaustive_search():
    rng = np.random.default_rng(2)
    for _ in range(400):
        rows = in_order(drawn(rng, int(rng.integers(0, 9))))
        s = turns.Stretch(1)
        seen = set()
        for t, role, text in rows:
            s.add(t, role, text, 1, (role, text) not in seen)
            seen.add((role, text))
        got = turns._done(s)
        assert tuple(got[n] for n, _ in turns._RESULT) == plain(tuple(rows))


@pytest.mark.parametrize("stretch", [256, 3])
def test_repaired(spark, monkeypatch, stretch):
    """Conversations of every length, dealt over partitions and cut into stretches."""
    monkeypatch.setattr(turns, "STRETCH_ROWS", stretch)
    rng = np.random.default_rng(stretch)
    found = {k: drawn(rng, int(rng.integers(1, 12))) for k in range(60)} | {100: drawn(rng, 300), None: drawn(rng, 150)}
    got = results(turns.repaired(frame(spark, found).repartition(7)))
    assert got == {k: plain(tuple(in_order(rows))) for k, rows in found.items()}


def test_copies_and_lost_rows(spark):
    """n copies of a row are one row and n - 1 duplicates; a conversation whose rows are all lost keeps its id."""
    rows = [(1, 0, "user", "a.", 1), (1, 1, "assistant", "b.", 5000), (2, 0, "user", "x", 0), (3, None, "user", " ", 3)]
    got = results(turns.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")))
    assert got[1][:7] == (0, 0, 4999, 0, 4999, 4 * 4999, "KK" + "D" * 4999)
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[3][:7] == (0, 3, 0, 0, 2, 12, "DDD")


def test_op12(spark):
    """The registered query against damage done by hand and exhaustive search."""
    import zlib

    sf = "/root/testdata/sf0.001"
    found = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        role, text = r["role"] or " ", " " if r["text"] is None else r["text"]
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        rows = found[r["conv_id"]]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(r["turn"], "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert results(queries.op12_conversation_repair(spark, sf)) == {k: plain(tuple(in_order(v))) for k, v in found.items()}


def test_odd_conversations(spark):
    """Nulls, no text, long texts, ties, clashing names, an empty table."""
    rows = [(1, None, None, None, "x", 1), (1, 2, "user", "", "y", 2), (None, 3, "user", "z" * 100_000, None, 3), (2, 1, "user", "same.", "", 4), (2, 1, "user", "same.", "", 4), (2, 1, "assistant", "same.", "", 4), (3, 5, "", "ß", "", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string, n long")
    found = {1: [(None, " ", " "), (2, "user", "")], None: [(3, "user", "z" * 100_000)], 2: [(1, "user", "same."), (1, "user", "same."), (1, "assistant", "same.")], 3: [(5, "", "ß")]}
    got = results(turns.repaired(df.withColumn("n", F.lit(1))))
    assert got == {k: plain(tuple(in_order(v))) for k, v in found.items()}
    damaged = turns.repaired(turns.damaged(df)).collect()
    assert {r["conv_id"] for r in damaged} == set(found)
    assert turns.repaired(turns.damaged(df.limit(0))).count() == 0
