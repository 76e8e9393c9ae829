"""Byte-level BPE, encoded in linear time by backtracking over longest matches.

Bytes are mapped to the characters 0 to 255, so that one Aho-Corasick automaton
over all tokens gives the longest token that starts at each position. Encoding
goes from left to right with the longest token; a token is taken only if the
merges of a byte pair encoder would leave the border between it and the one
before, else the next shorter one is tried, and if there is none the one before
is given up. Positions from which nothing leads on are remembered, so no
position is tried twice. Whether two adjacent tokens are compatible is derived
from the last merges that made them and memoised.

A match of the pattern that is itself a token is that token, as the library
tiktoken has it. Null text counts as empty. Rows are encoded one by one, so
repeated rows give equal rows, and an empty table an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pretok import PieceEncoder
from plumbline.llm.scratch import texts_of
from plumbline.llm.textbatch import slices

#: Pieces that a worker keeps (about 100 MB, twice that in the worst case).
CACHED = 400_000
#: Entries of the memo of pairs; it is emptied when full.
MEMO = 1_000_000


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            elif (pair := self._last_merge(token, rank)) is not None:
                self.halves[rank] = pair
                self.joined[pair] = rank
        self.size_of = [0] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for rank in self.halves:
            token = self.bytes_of[rank]
            self.size_of[rank] = len(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.size_of)
        for rank in self.halves:
            token = self.bytes_of[rank]
            for n in range(len(token) - 1, 0, -1):
                if (r := ranks.get(token[:n])) is not None and r in self.halves:
                    self.shorter[rank] = r
                    break
        self.memo: dict[int, bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two parts that merges of lower rank leave; None if no merge makes the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether a byte pair encoder of left + right ends with these two tokens."""
        known = self.memo.get(left << 32 | right)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges of both sides, latest first; a merge across the border
        # that comes before the one just undone would have destroyed it.
        before = 1 << 62
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < before:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    part = self.halves[left][1]
                    if part != left:
                        before, left = left, part
                        break
                else:
                    part = self.halves[right][0]
                    if part != right:
                        before, right = right + 1, part
                        break
                undo_left = not undo_left
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        size_of, shorter, memo = self.size_of, self.shorter, self.memo
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size_of[rank]] = rank  # later ends are longer tokens
        dead: set[int] = set()
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            end = at + size_of[token]
            if end not in dead:
                fits = before < 0 or memo.get(before << 32 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, before, token = end, token, longest[end]
                    continue
            less = shorter[token]
            if less >= 0:
                token = less
            else:
                dead.add(at)
                token = out.pop()
                at -= size_of[token]
                before = out[-1] if out else -1


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _tools(path: str) -> tuple[PieceEncoder, list[bytes]]:
    import regex
    from public_tokenizers import PATTERN

    encoder, matches = Encoder(ranks_of(path)), regex.compile(PATTERN)

    def encode(piece: str) -> bytes:
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            ids = encoder.encode(piece.encode())  # letters alone are one match
        else:
            ids = [i for match in matches.findall(piece) for i in encoder.encode(match.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    table = [encoder.bytes_of.get(i, b"") for i in range(max(encoder.bytes_of) + 1)]
    return PieceEncoder(encode, CACHED), table


def encode(text: str, path: str) -> np.ndarray:
    """Ids of one text."""
    return np.frombuffer(_tools(path)[0].ids(text), "<u4")


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ids."""
    table = _tools(path)[1]
    return b"".join([table[i] for i in ids.tolist()])


def _encoded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:  # Spark keeps Python workers
            _tools(path)[0].forget()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            ids = [encode(texts.raw(i).decode("utf-8", "replace"), path) for i in range(len(texts))]
            columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64())]
            if with_ids:
                yield pa.record_batch([*columns, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])
                continue
            hashes = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            texts_again = [hashlib.sha256(decode(x, path)).hexdigest() for x in ids]
            yield pa.record_batch([*columns, pa.array(hashes, pa.string()), pa.array(texts_again, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of ``docs`` (doc_id, text)."""
    return texts_of(docs).mapInArrow(_encoded(path, True), "doc_id bigint, n_tokens bigint, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes decoded from them."""
    return texts_of(docs).mapInArrow(_encoded(path, False), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
