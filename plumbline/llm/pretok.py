"""Encoding whole texts through a bounded cache of their pieces.

The pre-tokeniser's pattern always cuts before a space that a non-space
follows, and what stands left of such a space is cut as if the text ended
there. So a text can be split at these spaces, each piece encoded on its own,
and the ids joined. Pieces repeat, so most are found in a cache whose size is
bounded: when it is full the older half goes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space before anything that some engine might take for white space.
_AWKWARD = re.compile("[ ](?:[\\s\x1c-\x1f\x85\xa0]|$)")
_CUT = re.compile("[ ](?=[^\\s\x1c-\x1f\x85\xa0])")

CACHED = 250_000
LONGEST = 48
#: Marks that are a match of their own when they end a piece after a letter.
MARKS = frozenset(".,;:!?")


class PieceEncoder:
    """``encode`` gives the ids of a piece as packed little-endian 32-bit integers."""

    def __init__(self, encode: Callable[[str], bytes], cached: int = CACHED) -> None:
        self.encode = encode
        self.cached = cached
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.alone = {mark: encode(mark) for mark in (*MARKS, "\n")}

    def forget(self) -> None:
        """Free the cache, at the end of a task: Spark keeps Python workers."""
        self.new, self.old = {}, {}

    def _after_space(self, piece: str) -> bytes:
        """Ids of a piece behind its space. What its last mark or its line break cuts
        off is looked up by itself, since it repeats more often than the whole."""
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            return self._one(piece[:-1]) + self.alone[piece[-1]]
        left, line, right = piece.partition("\n")
        if line and left and right and "\n" not in right and not left[-1].isspace() and not right[0].isspace():
            return self._one(left) + self.alone[line] + self.encode(right)
        return self.encode(" " + piece)

    def _one(self, piece: str) -> bytes:
        got = self.new.get(piece)
        return self._missing(piece) if got is None else got

    def _missing(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self._after_space(piece)
        if len(piece) <= LONGEST:
            if len(self.new) >= self.cached:
                self.new, self.old = {}, self.new
            self.new[piece] = got
        return got

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = _CUT.split(text) if _AWKWARD.search(text) else text.split(" ")
        out = list(map(self.new.get, rest))
        if None in out:
            one = self._one
            out = [one(p) if x is None else x for p, x in zip(rest, out)]
        return (self.encode(first) if first else b"") + b"".join(out)
