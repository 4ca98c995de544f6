"""String helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(s: Column, first: int, last: int) -> Column:
    """Characters first to last, counted from 0, both included."""
    return F.substring(s, first + 1, last - first + 1)


def starts_with(s: Column, prefix: str, case: bool = False) -> Column:
    return s.startswith(prefix) if case else F.lower(s).startswith(prefix.lower())


def ends_with(s: Column, suffix: str, case: bool = False) -> Column:
    return s.endswith(suffix) if case else F.lower(s).endswith(suffix.lower())


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def common_prefix(a: Column, b: Column) -> Column:
    """Whether the shorter text is the start of the other."""
    n = F.least(F.length(a), F.length(b))
    return F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)


def is_number(s: Column) -> Column:
    return s.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$")


def is_empty(s: Column) -> Column:
    return ~s.rlike(r"\S")


def tokens(s: Column, delimiters: str, keep_empty: bool = False) -> Column:
    """Parts between any of the characters of `delimiters`."""
    cls = "[" + "".join("\\" + c if c in r"\]^-[" else c for c in delimiters) + "]"
    parts = F.split(s, cls)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def tokens_by_text(s: Column, delimiter: str) -> Column:
    return F.split(s, "\\Q" + delimiter + "\\E")


def first_tokens(s: Column, delimiters: str, n: int) -> Column:
    return F.slice(tokens(s, delimiters), 1, n)


def replaced(s: Column, characters: str, by: str) -> Column:
    """Each of the characters replaced by one, or left out for the empty text."""
    return F.translate(s, characters, by * len(characters))


def alphanumeric(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9]", "")


def integers(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def in_base(n: Column, base: int) -> Column:
    return F.conv(n.cast("string"), 10, base)


def from_base(s: Column, base: int) -> Column:
    return F.conv(s, base, 10).cast("long")


def balanced(s: Column, opening: str = "(", closing: str = ")") -> Column:
    """Every bracket closes one that is open."""
    chars = F.split(s, "")
    depth = F.aggregate(chars, F.lit(0), lambda acc, c: F.when(acc < 0, acc).when(c == opening, acc + 1).when(c == closing, acc - 1).otherwise(acc))
    return depth == 0


def position(items: Column, item: Column) -> Column:
    """Index of an item from 0, or -1."""
    return F.array_position(items, item) - 1


def with_item(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def interleaved(a: Column, b: Column) -> Column:
    return F.flatten(F.zip_with(a, b, lambda x, y: F.filter(F.array(x, y), lambda z: z.isNotNull())))


def batches(items: Column, n: int) -> Column:
    """The items in at most n runs of equal length, the last one shorter."""
    size = F.greatest(F.ceil(F.size(items) / F.lit(n)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), size), lambda i: F.slice(items, i, size))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    return F.when(F.instr(file_name(path), ".") > 0, F.substring_index(file_name(path), ".", -1)).otherwise(F.lit(""))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))
