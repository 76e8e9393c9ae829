"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents longer than the capacity are cut into pieces of exactly the capacity,
the first piece being the shorter one. Which sequence a piece goes to depends
only on the numbers of pieces of each length, at most ``capacity`` numbers
whatever the corpus. These are packed at once: lengths over a third of the
capacity, of which at most two fit a sequence, are matched greedily (the
longest with the longest that still fits); shorter ones, longest first, go to
the open sequence that they fill best. The result is a list of runs: "the
pieces of length L ranked r to r + n go to sequences s to s + n at offset o".
Each piece finds its run by its rank among the pieces of its length, which is
its rank in its task plus a running sum over tasks, so that no key gathers the
pieces of a common length.

Null or empty text is a document of the end token alone. A repeated row is
packed again. Pieces of equal length are alike to the plan: which of them goes
where follows the order of tasks and rows, so it may differ between runs, but
never how many sequences there are. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.pretok import PieceEncoder
from plumbline.llm.scratch import texts_of, written
from plumbline.llm.textbatch import released, slices

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"


# --------------------------------------------------------------------------- ids


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(2)
def document_encoder(path: str) -> tuple[Callable[[str], bytes], Callable[[], None]]:
    """A function for the ids of a whole text, as the tokenizer in the JSON file at ``path`` gives them.

    The file's vocabulary is in merge order, so its ids serve as ranks. Strings
    of its special tokens are cut out first, as that tokenizer does. The second
    function frees the cache.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte_of = _byte_of()
    special = {x["content"]: int(x["id"]) for x in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def packed(piece: str) -> bytes:
        return np.array(encoding.encode(piece, allowed_special="all"), "<u4").tobytes()

    def ordinary(piece: str) -> bytes:
        ids = encoding.encode_ordinary(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    pieces = PieceEncoder(ordinary)

    def ids(text: str) -> bytes:
        return packed(text) if any(x in text for x in special) else pieces.ids(text)

    return ids, pieces.forget


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    head = n % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids_of, forget), last = document_encoder(path), np.array([end], "<u4").tobytes()
        task, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        try:
            yield from numbered(batches, ids_of, last, task, ranks)
        finally:
            forget()
            del ids_of, forget
            document_encoder.cache_clear()  # 20 MB of an idle worker; made again in 0.1 s
            released()

    def numbered(batches, ids_of, last: bytes, task: int, ranks: list[int]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for i in range(len(texts)):
                held = ids_of(texts.raw(i).decode("utf-8", "replace")) + last
                for k, (start, length) in enumerate(cut(len(held) // 4, capacity)):
                    rows.append((ids[i], k, start, length, zlib.crc32(held[4 * start : 4 * (start + length)]), task, ranks[length]))
                    ranks[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


# --------------------------------------------------------------------------- plan


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence, offset) and the number of sequences."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # ascending
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number)
    sequences = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in open_at:
                bisect.insort(gaps, gap)
            open_at.setdefault(gap, []).append((first, number))

    def put(length: int, number: int, first: int, offset: int) -> None:
        runs.append((length, used[length], number, first, offset))
        used[length] += number
        left[length] -= number

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect.bisect_right(large, min(length, capacity - length)) - 1
            while at >= 0 and left[large[at]] - (large[at] == length) <= 0:
                at -= 1
            if at < 0:
                number = left[length]
                put(length, number, sequences, 0)
                leave(capacity - length, sequences, number)
            else:
                other = large[at]
                number = left[length] // 2 if other == length else min(left[length], left[other])
                put(length, number, sequences, 0)
                put(other, number, sequences, length)
                leave(capacity - length - other, sequences, number)
            sequences += number
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                number = -(-left[length] // (capacity // length))
                leave(capacity, sequences, number)
                sequences += number
                continue
            gap = gaps[at]
            first, number = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[at]
            now = min(number, left[length])
            put(length, now, first, capacity - gap)
            leave(gap, first + now, number - now)
            leave(gap - length, first, now)
    return runs, sequences


def _placed(runs: list[tuple[int, int, int, int, int]], capacity: int):
    """Runs are at most a few per pair of lengths: a bounded table, sent with the task."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n in ("length", "task", "rank", "base")}
            rank = get["rank"] + get["base"]
            sequence = -1 - ((get["task"].astype(np.int64) << 40) + get["rank"])  # a full piece has its own
            offset = np.zeros(len(rank), np.int64)
            part = get["length"] < capacity
            if part.any():
                at = np.searchsorted(keys, (get["length"][part] << 44) + rank[part], side="right") - 1
                sequence[part] = table[at, 3] + rank[part] - table[at, 1]
                offset[part] = table[at, 4]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and offset."""
    texts = texts_of(docs)
    pieces = written(texts.mapInArrow(_pieces(path, end, capacity), PIECES), "pieces")
    counts = pieces.where(F.col("length") < capacity).groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under capacity rows
    runs, _ = plan(histogram, capacity)
    # bases grows with the number of tasks, so it is never broadcast; pieces are narrow, and none of its keys is large.
    ranked = pieces.join(bases.drop("n").hint("merge"), ["task", "length"], "left").select("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", F.coalesce("base", F.lit(0)).cast("bigint").alias("base"))
    return ranked.mapInArrow(_placed(runs, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
