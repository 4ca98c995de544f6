"""Splitting texts into words, as bytes, and sorted distinct numbers."""

from collections.abc import Iterator

import numpy as np

#: ASCII other than digits and letters parts words; A-Z become a-z.
_WORD_BYTES = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
#: As above, but digits part words too.
_LETTER_BYTES = bytes(ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def letter_words(text: bytes) -> list[bytes]:
    return text.translate(_LETTER_BYTES).split()


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; the sort in place is faster than numpy.unique's table on millions of keys."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def word_blocks(text: bytes, size: int = 1 << 18) -> Iterator[list[bytes]]:
    """The words of a text in lists of some `size` bytes of text each, so that a very long text never lies about as words."""
    text, at = text.translate(_WORD_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
