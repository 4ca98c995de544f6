"""Byte-level BPE: ids of texts, and token counts of pre-tokens with a bounded cache in each worker.

The ids are those of the `tokenizers` file. Where its merges are in the order of their ids, as in byte-level BPE files commonly, its own
vocabulary is given as ranks to tiktoken, whose encoder yields the same ids at several times the speed; any other file, and any text
that holds a special token's string, goes through `tokenizers` itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: Fixed value: the pre-token pattern of the public byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How many characters behind its end can decide a pre-token ("'l" looks at two more).
LOOKAHEAD = 3
CACHE_ENTRIES = 400_000


def with_specials(specials: list[str]) -> str:
    """The pre-token pattern for texts that hold special tokens: these come first, and all else ends before them as at the text's end."""
    special = "|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))
    run = lambda c: rf"(?:(?!{special}){c})+"
    return "|".join([special, *(f"'{x}" for x in ("s", "t", "re", "ve", "m", "ll", "d")), *(" ?" + run(c) for c in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")), rf"\s+(?={special})", r"\s+(?!\S)", r"\s+"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level BPE files: itself, or one from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """The file's vocabulary as {bytes: id}, or None if ids don't give the order of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    split, bpe = model.get("pre_tokenizer") or {}, model["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("normalizer") and bpe.get("type", "BPE") == "BPE"
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in bpe.get("merges", [])]
    vocab, special = bpe.get("vocab", {}), {t["content"] for t in model.get("added_tokens", ())}
    ids = [vocab.get(m, -1) for m in merges]
    if not plain or ids != sorted(ids) or len(merges) + 256 != len(vocab.keys() - special) or bpe.get("ignore_merges"):
        return None
    byte = _byte_of()
    return {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in special}


class PieceEncoder:
    """Ids of texts and token counts of pre-tokens; pre-tokens are encoded one by one, so their ids make up those of the text."""

    _open: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PRETOKEN)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_split = regex.compile(with_specials(self.specials)) if self.specials else self.split
        #: Characters before and behind an edit that can decide a pre-token.
        self.context = max([LOOKAHEAD, *map(len, self.specials)])
        self.fast = None
        if ranks := ranks_of(path):
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self.counts: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        """One encoder for each worker process."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def pattern(self, text: str) -> regex.Pattern:
        """What cuts a text into pre-tokens; special tokens are pre-tokens of their own."""
        return self.special_split if any(s in text for s in self.specials) else self.split

    def piece_counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token, one for a special token. The cache starts anew when it is full."""
        known = self.counts
        if len(known) > CACHE_ENTRIES:
            known.clear()
        try:
            return [known[p] for p in pieces]
        except KeyError:
            for p in pieces:
                if p not in known:
                    known[p] = 1 if p in self.specials else len(self.fast.encode_to_numpy(p, disallowed_special=()) if self.fast else self.tokenizer.encode(p, add_special_tokens=False).ids)
            return [known[p] for p in pieces]
