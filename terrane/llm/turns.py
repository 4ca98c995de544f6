"""Repair of conversations: the cheapest edits that make the roles of a conversation follow its grammar.

The grammar of role initials is `(s?(ua)+)?`. Its states are the bits of a small set: START, after a system turn, after a user turn, after
an assistant turn. Costs are taken in layers: `layers[c][j]` is the set of states from which the rows from j on can be edited into an
accepted end at cost c exactly, each layer made from cheaper ones (and, for rows kept, from the rows behind). The first layer that holds the
state at the beginning gives the cost, and walking its bits forward, letters in ASCII order, gives the least audit.

Between a row's edits and the next row's the audit of a stretch of rows can be cut: two audits of the same rows never begin one another,
as each ends with the letter of a row. So a conversation may lie in several partitions: each stretch gives the least cost and audit from every state to
every state, and these are composed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, tidied

#: Fixed by the task: prices of a changed role, a deleted row, an inserted row and an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state: where an inserted row or a changed role leads, and the role it has; by initial: where a kept row leads.
NEXT, NEXT_ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Rows inserted at the end of a conversation that stops in a state.
CLOSING = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}

#: Live rows of one table of layers (whose height grows with its width), and bytes of text of a conversation that a task holds.
STRETCH_ROWS, STRETCH_BYTES = 256, 4 << 20


def _back(step: dict[int, int]) -> list[int]:
    """For each set of states, the set of those from which `step` leads into it."""
    return [sum(1 << a for a, b in step.items() if s >> b & 1) for s in range(16)]


_NEXT_BACK = _back(dict(enumerate(NEXT)))
_KEPT_BACK = {r: _back(step) for r, step in KEPT.items()}
_NONE_BACK = [0] * 16

#: A live row: (initial of the role, whether it is truncated).
Live = tuple[str, bool]


def cost_layers(rows: list[Live], ends: dict[int, int], wanted: int) -> list[list[int]]:
    """Layers from cost 0 until every state of `wanted` has been met before the first row. `ends` has states by the cost of ending there.

    What each truncated row costs at least, deleted or not, is left out of the costs."""
    n = len(rows)
    back = [_KEPT_BACK.get(r, _NONE_BACK) for r, _ in rows]
    price = [DELETE - TRUNCATED * cut for _, cut in rows]
    none, out, met = [0] * (n + 1), [], 0
    while wanted & ~met:
        c = len(out)
        here, dearer = [0] * n + [ends.get(c, 0)], out[c - INSERT] if c >= INSERT else none
        behind = here[n]
        for j in range(n - 1, -1, -1):
            at = c - price[j]
            behind = back[j][behind] | _NEXT_BACK[dearer[j + 1] | dearer[j]] | (out[at][j + 1] if at >= 0 else 0)
            here[j] = behind
        out.append(here)
        met |= behind
    return out


def trace(rows: list[Live], layers: list[list[int]], state: int, cost: int) -> tuple[list[str], int]:
    """The least audit, as one text for each live row (inserted rows before it, then its own letter), and the state it ends in."""
    out = []
    for j, (role, cut) in enumerate(rows):
        price, before = DELETE - TRUNCATED * cut, ""
        while True:
            if cost >= price and layers[cost - price][j + 1] >> state & 1:
                out.append(before + "D")
                cost -= price
                break
            if cost >= INSERT and layers[cost - INSERT][j] >> NEXT[state] & 1:
                before, cost, state = before + "I", cost - INSERT, NEXT[state]
                continue
            to = KEPT.get(role, {}).get(state)
            if to is not None and layers[cost][j + 1] >> to & 1:
                out.append(before + "K")
                state = to
            else:
                out.append(before + "R")
                cost, state = cost - REROLE, NEXT[state]
            break
    return out, state


def _reachable(rows: list[Live], end: int) -> int:
    """States from which a stretch can end in a state at any cost, no rows being inserted behind its last row."""
    found = 1 << end
    for role, _ in reversed(rows):
        found |= _NEXT_BACK[found] | _KEPT_BACK.get(role, _NONE_BACK)[found]
        for _ in range(3):
            found |= _NEXT_BACK[found]
    return found


def least(rows: list[Live]) -> tuple[int, list[str], int]:
    """Cost, audit by live rows and last state of a whole conversation's live rows; rows inserted at its end are not in the audit."""
    ends: dict[int, int] = {}
    for state, n in CLOSING.items():
        ends[n * INSERT] = ends.get(n * INSERT, 0) | 1 << state
    layers = cost_layers(rows, ends, 1 << START)
    cost = len(layers) - 1
    letters, state = trace(rows, layers, START, cost)
    return cost + TRUNCATED * sum(cut for _, cut in rows), letters, state


def between(rows: list[Live]) -> dict[tuple[int, int], tuple[int, list[str]]]:
    """Cost and audit by live rows from each state to each state that it can end in."""
    out, base = {}, TRUNCATED * sum(cut for _, cut in rows)
    for end in range(4):
        wanted = _reachable(rows, end)
        layers = cost_layers(rows, {0: 1 << end}, wanted)
        for start in range(4):
            cost = next((c for c, layer in enumerate(layers) if layer[0] >> start & 1), None)
            if cost is not None:
                out[start, end] = (cost + base, trace(rows, layers, start, cost)[0])
    return out


_LAST = re.compile(r"[^ \t-\r](?=[ \t-\r]*\Z)")


class Stretch:
    """Consecutive rows of one conversation, in a partition: counts, and what repairs it."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "n_turns")

    def __init__(self, conv):
        self.conv, self.held, self.texts, self.size = conv, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = self.forced = self.deleted = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.whole: dict[tuple[int, int], tuple[int, str]] | None = None

    def add(self, turn, role: str, text: str, n: int, first: bool) -> None:
        """n equal rows; first: none of this role and text came before."""
        if not n:
            return
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.n_turns += 1
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += n - 1
        self.last_role = initial
        last = _LAST.search(text)
        if last is None:
            self.blank += n
            self.forced += n
            return
        again = n - first
        if first:
            cut = last[0] not in ".!?"
            self.truncated += cut
            self.held.append((initial, cut))
            self.texts.append((self.forced, role, text))
            self.size += len(text)
            self.forced = 0
        self.duplicate += again
        self.forced += again

    def full(self) -> bool:
        return len(self.held) >= STRETCH_ROWS or self.size >= STRETCH_BYTES

    def fold(self) -> list[tuple[int, str, str]]:
        """Compose what is held with what came before it; gives (rows deleted before it, role, text) of the live rows."""
        behind = {pair: (cost, "".join("D" * n + x for (n, _, _), x in zip(self.texts, letters))) for pair, (cost, letters) in between(self.held).items()}
        if self.whole is None:
            self.whole = behind
        else:
            made: dict[tuple[int, int], tuple[int, str]] = {}
            for (a, b), (x, u) in self.whole.items():
                for (c, d), (y, v) in behind.items():
                    if b == c and ((a, d) not in made or (x + y, u + v) < made[a, d]):
                        made[a, d] = (x + y, u + v)
            self.whole = made
        texts, self.held, self.texts, self.size = self.texts, [], [], 0
        return texts

    def counts(self) -> dict:
        return {f: getattr(self, f) for f in self.FIELDS}


class Repaired:
    """SHA-256 of the repaired rows of a conversation, which come one by one."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.sha.update(("\n" * self.any + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def row(self, state: int, letters: str, role: str, text: str) -> int:
        """A live row with its letters; gives the state behind it."""
        for x in letters:
            if x == "I":
                self.put(NEXT_ROLE[state], "")
                state = NEXT[state]
            elif x == "R":
                self.put(NEXT_ROLE[state], text)
                state = NEXT[state]
            elif x == "K":
                self.put(role, text)
                state = KEPT[role[:1]][state]
        return state

    def close(self, state: int) -> str:
        """Insert what a conversation that stops in a state needs."""
        for _ in range(CLOSING[state]):
            self.put(NEXT_ROLE[state], "")
            state = NEXT[state]
        return self.sha.hexdigest()


_RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
#: kind 0: a whole conversation's result. 1: the sums of a stretch. 2: a live row of a stretch.
_MADE = [("conv_id", "long"), ("kind", "int"), ("part", "int"), ("number", "int"), ("seq", "long"), *_RESULT, ("n_turns", "long"), ("first_turn", "long"), ("last_turn", "long"), ("first_role", "string"), ("last_role", "string"),
         ("costs", "array<long>"), ("ranks", "array<int>"), ("audits", "array<string>"), ("forced", "long"), ("role", "string"), ("text", "string")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def _batches(rows: Iterator[dict], fields: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    schema, held, size = pa.schema([(n, _ARROW[t]) for n, t in fields]), [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("text") or "") + len(row.get("audit") or "")
        if len(held) >= 4096 or size >= STRETCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _values(batches: Iterator[pa.RecordBatch], step: int = 1024) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def _gaps(first, last, n_turns: int) -> int:
    return last - first + 1 - n_turns if n_turns else 0


def _done(s: Stretch) -> dict:
    """The result of a conversation that is held whole."""
    cost, letters, state = least(s.held)
    deleted, out, at = s.blank + s.duplicate, Repaired(), START
    for (_, role, text), x in zip(s.texts, letters):
        at = out.row(at, x, role, text)
    audit = "".join("D" * n + x for (n, _, _), x in zip(s.texts, letters)) + "D" * s.forced + "I" * CLOSING[state]
    return {"conv_id": s.conv, "kind": 0, "gaps": _gaps(s.first_turn, s.last_turn, s.n_turns), **{f: getattr(s, f) for f in ("blank", "duplicate", "truncated", "illegal")},
            "cost": cost + DELETE * deleted, "audit": audit, "repaired_sha256": out.close(state)}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that lie in the partition; of the first and the last one, and of long ones, stretches to be composed."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[dict]:
        now, number, seq, open_ = None, 0, 0, True  # open_: the conversation may have begun in the partition before, or is long

        def live(s: Stretch) -> Iterator[dict]:
            nonlocal seq
            for forced, role, text in s.fold():
                yield {"conv_id": s.conv, "kind": 2, "part": part, "number": number, "seq": seq, "forced": forced, "role": role, "text": text}
                seq += 1

        def summed(s: Stretch) -> Iterator[dict]:
            nonlocal number, seq
            yield from live(s)
            found = {pair: (cost, audit + "D" * s.forced) for pair, (cost, audit) in s.whole.items()}
            grid = [found.get((a, b)) for a in range(4) for b in range(4)]
            order = sorted({x[1] for x in grid if x})
            place = {x: k for k, x in enumerate(order)}
            yield {"conv_id": s.conv, "kind": 1, "part": part, "number": number, "first_turn": s.first_turn, "last_turn": s.last_turn, "first_role": s.first_role, "last_role": s.last_role, **s.counts(),
                   "costs": [x and x[0] + DELETE * (s.blank + s.duplicate) for x in grid], "ranks": [x and place[x[1]] for x in grid], "audits": [x and x[1] for x in grid]}
            number, seq = number + 1, 0

        for conv, turn, role, text, n, first in _values(batches):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from summed(now) if open_ else [_done(now)]
                    open_ = False
                now = Stretch(conv)
            now.add(turn, role, text, n, first)
            if now.full():
                open_ = True
                yield from live(now)
        if now is not None:
            yield from summed(now)

    return _batches(rows(), _MADE)


_STITCHED = [("part", "int"), ("number", "int"), ("begin", "int"), ("end", "int"), ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long")]


def _stitch(found: pd.DataFrame) -> pd.DataFrame:
    """The way of one conversation through its stretches, one row each; the first has the sums over all."""
    found = found.sort_values(["part", "number"])
    costs, ranks = found["costs"].tolist(), found["ranks"].tolist()
    left = [{state: n * INSERT for state, n in CLOSING.items()}]  # from the last stretch back: what is still to be paid from each state
    for grid in reversed(costs):
        came = {}
        for a in range(4):
            ways = [grid[4 * a + b] + left[-1][b] for b in range(4) if not pd.isna(grid[4 * a + b]) and b in left[-1]]
            if ways:
                came[a] = min(ways)
        left.append(came)
    left.reverse()
    state, begins, ends = START, [], []
    for k, (grid, rank) in enumerate(zip(costs, ranks)):
        ways = [b for b in range(4) if not pd.isna(grid[4 * state + b]) and b in left[k + 1] and grid[4 * state + b] + left[k + 1][b] == left[k][state]]
        begins.append(state)
        state = min(ways, key=lambda b: rank[4 * begins[-1] + b])
        ends.append(state)
    # counts across the seams, where nothing may lie in a stretch
    n_turns, illegal, last_turn, last_role, turns = int(found["n_turns"].sum()), int(found["illegal"].sum()), None, None, []
    for r in found[["first_turn", "last_turn", "first_role", "last_role"]].astype(object).itertuples(index=False):
        if not pd.isna(r.first_turn):
            n_turns -= last_turn is not None and int(r.first_turn) == last_turn
            last_turn = int(r.last_turn)
            turns += [int(r.first_turn), last_turn]
        if isinstance(r.first_role, str):
            illegal += last_role is not None and last_role + r.first_role not in ("su", "ua", "au")
            last_role = r.last_role
    sums = [_gaps(turns[0], turns[-1], n_turns) if turns else 0, *(int(found[c].sum()) for c in ("blank", "duplicate", "truncated")), illegal, int(left[0][START])]
    rows = [(p, n, b, e, *(sums if k == 0 else [None] * len(sums))) for k, (p, n, b, e) in enumerate(zip(found["part"].tolist(), found["number"].tolist(), begins, ends))]
    out = pd.DataFrame(rows, columns=[n for n, _ in _STITCHED])
    return out.astype({n: "Int64" for n, t in _STITCHED if t == "long"})


_STREAM = ["conv_id", "part", "number", "seq", "begin", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "forced", "role", "text"]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of composed conversations: each stretch comes as a row with its audit, then its live rows; none is kept."""

    def rows() -> Iterator[dict]:
        now, out, audits, state, at = None, None, [], START, 0

        def result() -> dict:
            return {**now, "audit": "".join(audits) + "I" * CLOSING[state], "repaired_sha256": out.close(state)}

        for row in _values(batches):
            r = dict(zip(_STREAM, row))
            if r["seq"] < 0:
                if r["gaps"] is not None:  # a conversation's first stretch
                    if now is not None:
                        yield result()
                    now, out, audits = {n: r[n] for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, Repaired(), []
                audits.append(r["audit"])
                state, at = r["begin"], 0
            else:
                at += r["forced"]
                stop = at
                while audits[-1][stop] == "I":
                    stop += 1
                state = out.row(state, audits[-1][at : stop + 1], r["role"], r["text"])
                at = stop + 1
        if now is not None:
            yield result()

    return _batches(rows(), [("conv_id", "long"), *_RESULT])


@tidied
def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conv_id of rows.

    rows: conv_id, turn, role, text and n, how often the row stands there; n = 0 keeps a conversation that has lost its rows. Rows follow each
    other by turn (nulls first), then role and text. Nulls in role and text count as one space; a null conv_id is a conversation of its own.
    Repeated rows count as duplicates, however many; an empty table gives no rows; texts of any length are taken whole; other columns aren't read.

    Rows are dealt out by ranges of (conv_id, turn, role, text), so a conversation of any length spreads over tasks, which hold a stretch of it at a time.
    Stretches are composed from one small row for each conversation and partition. Only the digest of a conversation that lies in
    several stretches is made by one task, as a stream: a SHA-256 can't be made in parts.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.col("n").cast("long"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)))
    # the first place of each role and text, as a row that adds none
    firsts = rows.filter("n > 0").groupBy("conv_id", "key").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("none"))
    firsts = firsts.select("conv_id", F.when(~F.col("none"), F.col("turn")).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "key", F.lit(True).alias("first"))
    told = rows.withColumn("first", F.lit(False)).unionByName(firsts)
    told = told.groupBy("conv_id", "turn", "key").agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("n").alias("n"), F.max("first").alias("first"))
    order = ["conv_id", "turn", "role"]
    dealt = told.repartitionByRange(*order, F.left("text", F.lit(256))).sortWithinPartitions(*order, "text").select("conv_id", "turn", "role", "text", "n", "first")
    made = materialise(dealt.mapInArrow(_stretches, _ddl(_MADE)), "stretches")
    sums = made.filter("kind = 1")
    way = sums.select("conv_id", "part", "number", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn", "first_role", "last_role", "costs", "ranks").groupBy("conv_id").applyInPandas(_stitch, _ddl(_STITCHED))
    heads = sums.select("conv_id", "part", "number", "audits").join(way, ["part", "number"]).withColumn("audit", F.expr("audits[begin * 4 + end]")).withColumns({"seq": F.lit(-1).cast("long"), "forced": F.lit(0).cast("long"), "role": F.lit(""), "text": F.lit("")})
    lives = made.filter("kind = 2").select("conv_id", "part", "number", "seq", "forced", "role", "text")
    stream = heads.select(*_STREAM).unionByName(lives, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "number", "seq")
    result = ["conv_id", *(n for n, _ in _RESULT)]
    return made.filter("kind = 0").select(*result).unionByName(stream.select(*_STREAM).mapInArrow(_hashed, _ddl([("conv_id", "long"), *_RESULT])))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n after the damage that crc32("conv_id:turn") modulo 20 tells: 0 drops a row, 1 empties its text, 2 removes its
    `[.!?]`, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", or_space("conv_id"), or_space("turn")).cast("binary")) % 20
    role, text = or_space("role"), or_space("text")

    def when(k: int, x: Column, other: Column) -> Column:
        return F.when(kind == k, x).otherwise(other)

    text = when(0, F.lit(""), when(1, F.lit(""), when(2, F.regexp_replace(text, "[.!?]", ""), text)))
    return conversations.select("conv_id", "turn", when(0, F.lit(" "), when(4, F.lit("user"), role)).alias("role"), text.alias("text"), when(0, F.lit(0), when(3, F.lit(2), F.lit(1))).alias("n"))
