"""Edit-aware token counts: a segment tree of pre-tokens for each document.

Leaves are pre-tokens with their character and token counts, held in blocks; inner nodes hold sums. An edit finds its leaves by
descending the character sums, encodes again only from the pre-token before the touched characters (plus the boundary context that
the pre-token pattern looks at) to the first pre-token boundary behind the edit that both versions share, and updates the sums
on the path to the root. Trees are kept as rows of a table: a batch of edits reads the trees of the documents it touches, encodes the
edited regions alone, and gives the new table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PieceEncoder, default_tokenizer
from .shared import CHUNK_BYTES, chunks, materialise, tidied

#: Pre-tokens in a block of a new tree; a block is split by rebuilding once it holds eight times as many.
BLOCK = 32
EDITS = "array<struct<start:bigint,n_delete:bigint,inserted:string>>"
#: A tree in a table: the text, the leaves of each block, and the characters and tokens of each leaf (little-endian, 32 bits).
TREE = "doc_id long, text string, n_tokens long, n_pretokens long, blocks binary, chars binary, tokens binary"


class SegmentTree:
    """Pre-tokens of one text with sums of characters and tokens."""

    def __init__(self, text: str, encoder: PieceEncoder, leaves: list[tuple[list[int], list[int]]] | None = None):
        """leaves: the blocks of a tree of this text that was stored; nothing is encoded then."""
        self.text, self.encoder, self.reencoded = text, encoder, 0
        if leaves is None:
            pieces = encoder.pattern(text).findall(text)
            self._build(list(map(len, pieces)), encoder.piece_counts(pieces))
        else:
            self._sum(leaves)

    @classmethod
    def stored(cls, text: str, encoder: PieceEncoder, blocks: bytes, chars: bytes, tokens: bytes) -> SegmentTree:
        sizes, flat = np.frombuffer(blocks, "<i4"), [np.frombuffer(x, "<i4").tolist() for x in (chars, tokens)]
        ends = np.cumsum(sizes).tolist()
        return cls(text, encoder, [(flat[0][b - n : b], flat[1][b - n : b]) for n, b in zip(sizes.tolist(), ends)])

    def leaves(self) -> tuple[bytes, bytes, bytes]:
        """blocks, chars and tokens for a table."""
        packed = lambda x: np.array(x, "<i4").tobytes()
        return packed([len(c) for c, _ in self.blocks]), packed([n for c, _ in self.blocks for n in c]), packed([n for _, t in self.blocks for n in t])

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self._sum([(chars[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(chars), BLOCK)] or [([], [])])

    def _sum(self, blocks: list[tuple[list[int], list[int]]]) -> None:
        self.blocks = blocks
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (c, t) in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(c), sum(t)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, block: int, chars: list[int], tokens: list[int]) -> None:
        self.blocks[block] = (chars, tokens)
        i = self.width + block
        self.chars[i], self.tokens[i] = sum(chars), sum(tokens)
        while i := i >> 1:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(len(c) for c, _ in self.blocks)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, leaf in it and start of the pre-token that holds character `at`; behind the last one at the end."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if start + self.chars[i] <= at < self.chars[1]:
                start += self.chars[i]
                i += 1
            elif at >= self.chars[1]:
                return len(self.blocks) - 1, len(self.blocks[-1][0]), self.chars[1]
        block = i - self.width
        for k, n in enumerate(self.blocks[block][0]):
            if at < start + n:
                return block, k, start
            start += n
        return block, len(self.blocks[block][0]), start

    def _ends_from(self, block: int, leaf: int, start: int) -> Iterator[tuple[int, int, int]]:
        """(start, block, leaf) of the pre-tokens from there on, and of the end of the text."""
        for b in range(block, len(self.blocks)):
            for k in range(leaf if b == block else 0, len(self.blocks[b][0])):
                yield start, b, k
                start += self.blocks[b][0][k]
        yield start, len(self.blocks) - 1, len(self.blocks[-1][0])

    def edit(self, start: int, n_delete: int, inserted: str) -> int:
        """Replace `n_delete` characters at `start`; places beyond the text count as its end. Gives the new token count."""
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(n_delete, 0), len(self.text))
        shift = len(inserted) - (stop - start)
        self.text = self.text[:start] + inserted + self.text[stop:]
        block, leaf, at = self._find(max(0, start - self.encoder.context))
        old = self._ends_from(block, leaf, at)
        old_at, old_block, old_leaf = next(old)
        pieces: list[str] = []
        pos = at
        for m in self.encoder.pattern(self.text).finditer(self.text, at):
            pos = m.start()
            if pos >= start + len(inserted):
                while old_at < pos - shift or old_at < stop:
                    old_at, old_block, old_leaf = next(old)
                if old_at == pos - shift:
                    break
            pieces.append(m.group())
        else:
            for old_at, old_block, old_leaf in old:
                pass
        self.reencoded += len(pieces)
        chars, tokens = list(map(len, pieces)), self.encoder.piece_counts(pieces)
        head, tail = self.blocks[block], self.blocks[old_block]
        chars, tokens = head[0][:leaf] + chars + tail[0][old_leaf:], head[1][:leaf] + tokens + tail[1][old_leaf:]
        for b in range(block + 1, old_block + 1):
            self._set(b, [], [])
        self._set(block, chars, tokens)
        if len(chars) > 8 * BLOCK:
            self._build([n for c, _ in self.blocks for n in c], [n for _, t in self.blocks for n in t])
        return self.n_tokens


def _row(doc: int | None, tree: SegmentTree) -> tuple:
    return doc, tree.text, tree.n_tokens, tree.n_pretokens, *tree.leaves()


def _batch(rows: list[tuple], more: tuple[str, ...] = ()) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * len(more))
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text", "n_tokens", "n_pretokens", "blocks", "chars", "tokens", *more])


def build_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A tree for every row of docs, in the columns of TREE. A null text counts as empty."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch in chunks(batches, limit=CHUNK_BYTES // 4):
            yield _batch([_row(doc, SegmentTree(text or "", encoder)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TREE)


def edit_trees(trees: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """Trees after a batch of edits, given as a column beside those of TREE (join a table of edits by doc_id), with n_tokens_before and
    n_reencoded, the number of pre-tokens that had to be encoded.

    `edits` is an array of (start, n_delete, inserted) in characters, applied in order to what the ones before left; null, or a null
    member, is no edit, and null parts are 0 or empty.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch in chunks(batches, limit=CHUNK_BYTES // 4):
            rows = []
            for doc, text, *leaves, before, script in zip(*(c.to_pylist() for c in batch.columns)):
                tree = SegmentTree.stored(text or "", encoder, *leaves)
                for e in script or ():
                    if e:
                        tree.edit(e["start"] or 0, e["n_delete"] or 0, e["inserted"] or "")
                rows.append((*_row(doc, tree), before, tree.reencoded))
            yield _batch(rows, ("n_tokens_before", "n_reencoded"))

    columns = trees.select("doc_id", "text", "blocks", "chars", "tokens", "n_tokens", edits.cast(EDITS).alias("edits"))
    return columns.mapInArrow(run, TREE + ", n_tokens_before long, n_reencoded long")


@tidied
def edit_aware_counts(docs: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_pretokens (edited) and n_reencoded: trees of all documents, written, then a batch of edits on them.

    Repeated rows are counted each; an empty table gives no rows; very long texts are a step by themselves. `edits` is a column over the
    trees' doc_id and text; other columns of docs are not read.
    """
    trees = materialise(build_trees(docs, tokenizer), "trees")
    return edit_trees(trees, edits, tokenizer).select("doc_id", "n_pretokens", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded")


def standard_edits(text: Column) -> Column:
    """The edit script of the registered query: a marker is put in after a quarter of the text, 40 characters go from its middle, and 25 after three quarters of it become its first letters as spaced capitals."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda start, drop, put: F.struct(start.cast("long").alias("start"), drop.cast("long").alias("n_delete"), put.alias("inserted"))
    late = F.greatest(F.floor(n * 3 / 4), F.lit(0))
    return F.array(
        edit(F.floor(n / 4), F.lit(0), F.lit(" [section]\n\n")),
        edit(F.floor(n / 2), F.lit(40), F.lit("")),
        edit(late, F.lit(25), F.concat(F.lit(" "), F.upper(F.substring(F.coalesce(text, F.lit("")), 1, 12)), F.lit(" "))),
    )
