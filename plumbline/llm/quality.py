"""Quality rules by compression bands.

Zstandard's ratio (compressed / raw bytes) of the whole text and of fixed
chunks must lie in a band that depends on the length: below the band a text
repeats itself, above it there is nothing to compress, as in random letters or
encoded data. A text fails if its whole ratio leaves the band, or more than a
quarter of its chunks leave theirs. The measures beside it (words, symbols,
repeated lines and 3-word windows) come from the same pass.

``learned`` sets the bands close around the ratios of clean text: for each length
class (half an octave) the central part of the ratios of all training rows that
are labelled good and pass the base rule, from a histogram of all of them. Where
a class has fewer than LEAST_ROWS such rows, and where there are no labels, the
constants below hold; they are wider, since they must hold for any language, and
long texts, which are the rarest, are then judged by their chunks, whose band
doesn't depend on the length.

Words are runs of characters other than 0x20 and 0x09 to 0x0D. Null text counts
as no words and fails the base rule; an empty table gives an empty result; rows
are judged one by one, so repeated rows get equal rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.langid import held_out
from plumbline.llm.scratch import texts_of
from plumbline.llm.textbatch import SEPARATOR, Texts, mix, salted, shingles, slices, words

#: (bytes from, least ratio, largest ratio) of whole texts, and of chunks of CHUNK bytes.
WHOLE_BANDS = ((0, 0.50, 0.74), (300, 0.42, 0.76), (1000, 0.37, 0.61), (4000, 0.33, 0.55), (16_000, 0.30, 0.50), (64_000, 0.26, 0.48))
CHUNK, CHUNK_TAIL = 4096, 1024
CHUNK_BAND = (0.33, 0.58)

#: Length classes of learned bands, in bytes.
CLASSES = (0, *(round(300 * 2 ** (k / 2)) for k in range(20)))
#: A band is learned from so many rows at least; it leaves out OUTSIDE of them on each side and is then
#: wider by SLACK of BINS, the steps in which ratios are counted.
LEAST_ROWS, OUTSIDE, SLACK, BINS = 50, 0.002, 5, 1000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, whole_ratio double, low_chunks int, high_chunks int"


@dataclass(frozen=True)
class Limits:
    whole: tuple[tuple[int, float, float], ...] = WHOLE_BANDS
    chunk: tuple[float, float] = CHUNK_BAND
    least_words: int = 50
    most_repeated_percent: int = 50
    most_bad_chunks_percent: int = 25


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])[offsets])


def _repeated_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
    return n


def measures(texts: Texts) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    w = words(texts)
    chars = _per_row(((texts.data & 0xC0) != 0x80) & ~SEPARATOR[texts.data], texts.offsets)
    symbols = _per_row(SYMBOL[texts.data], texts.offsets)
    broken = _per_row(texts.data == 10, texts.offsets)
    lines = np.array([_repeated_lines(texts.raw(i)) if broken[i] else 0 for i in range(len(texts))], np.int64)
    n = np.diff(w.first)
    window, whole = shingles(w, 3)
    with np.errstate(over="ignore"):
        keys = mix(window + np.repeat(np.arange(len(n), dtype=np.uint64), n) * salted(9))
    ordered = np.sort(keys[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    again = np.flatnonzero(whole & np.isin(keys, twice)) if len(twice) else np.zeros(0, np.int64)
    covered = np.zeros(len(keys) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    return n, chars, symbols, lines, _per_row(covered[: len(keys)], w.first)


def ratios(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """The ratio of the whole, and of each chunk (a tail under CHUNK_TAIL joins the one before)."""
    whole = len(packer.compress(raw)) / max(1, len(raw))
    cuts = [*range(0, max(1, len(raw) - CHUNK_TAIL), CHUNK), len(raw)]
    if len(cuts) < 3:
        return whole, []
    return whole, [len(packer.compress(raw[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:])]


def in_bands(size: int, whole: float, parts: list[float], limits: Limits) -> tuple[bool, int, int]:
    low, high = next((low, high) for at, low, high in reversed(limits.whole) if size >= at)
    under = sum(x < limits.chunk[0] for x in parts)
    over = sum(x > limits.chunk[1] for x in parts)
    return low <= whole <= high and 100 * (under + over) <= limits.most_bad_chunks_percent * len(parts), under, over


def _base_failed(n: np.ndarray, repeated: np.ndarray, limits: Limits) -> np.ndarray:
    return (n < limits.least_words) | (100 * repeated > limits.most_repeated_percent * n)


def _counted(limits: Limits):
    """(doc_id, class, bin, n) of rows that pass the base rule; class -1 is that of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch, texts in slices(batches):
            n, _, _, _, repeated = measures(texts)
            ids, out = batch.column(0).to_pylist(), []
            for i in np.flatnonzero(~_base_failed(n, repeated, limits)):
                raw = texts.raw(i)
                whole, parts = ratios(raw, packer)
                out.append((ids[i], bisect_right(CLASSES, len(raw)) - 1, int(whole * BINS), 1))
                out += [(ids[i], -1, bin, k) for bin, k in Counter(int(x * BINS) for x in parts).items()]
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "class", "bin", "n"])

    return run


def band(bins: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The ratios between which all but OUTSIDE of a histogram's rows lie on each side, and the slack."""
    order = np.argsort(bins)
    bins, below = bins[order], np.cumsum(n[order])
    low = bins[np.searchsorted(below, int(OUTSIDE * below[-1]), side="right")]
    high = bins[np.searchsorted(below, below[-1] - int(OUTSIDE * below[-1]))]
    return float(low - SLACK) / BINS, float(high + 1 + SLACK) / BINS


def learned(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Limits:
    """``limits`` with the bands of the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) call good."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    counted = texts_of(docs).mapInArrow(_counted(limits), "doc_id bigint, class int, bin int, n bigint")
    # At most BINS or so rows for each class.
    found = counted.join(good, "doc_id", "left_semi").groupBy("class", "bin").agg(F.sum("n").alias("n")).toArrow()
    place, bins, n = (found[c].to_numpy() for c in ("class", "bin", "n"))

    def close(k: int, otherwise: tuple[float, float]) -> tuple[float, float]:
        mine = place == k
        return band(bins[mine], n[mine]) if n[mine].sum() >= LEAST_ROWS else otherwise

    starts = sorted({*CLASSES, *(at for at, _, _ in limits.whole)})
    constant = {s: next((low, high) for at, low, high in reversed(limits.whole) if s >= at) for s in starts}
    whole = tuple((s, *close(bisect_right(CLASSES, s) - 1, constant[s])) for s in starts)
    return replace(limits, whole=whole, chunk=close(-1, limits.chunk))


def limits_of(docs: DataFrame, sf_dir: str) -> Limits:
    """Limits learned from the rows of ``docs`` that are not held out, if there is a table of labels."""
    try:
        labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return Limits()
    return learned(docs.where(~held_out()), labels)


def _judge(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch, texts in slices(batches):
            n, chars, symbols, lines, repeated = measures(texts)
            failed = _base_failed(n, repeated, limits)
            kept, whole, under, over = [], [], [], []
            for i in range(len(texts)):
                raw = texts.raw(i)
                ratio, parts = ratios(raw, packer)
                good, low, high = in_bands(len(raw), ratio, parts, limits)
                kept.append(good and not failed[i])
                whole.append(ratio)
                under.append(low)
                over.append(high)
            columns = [pa.array(x) for x in (n, chars, symbols, lines, repeated, failed)]
            columns += [pa.array(np.array(kept, bool)), pa.array(whole, pa.float64()), pa.array(under, pa.int32()), pa.array(over, pa.int32())]
            yield pa.record_batch([batch.column(0), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def judged(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the measures, the verdict and what it rests on."""
    return texts_of(docs).mapInArrow(_judge(limits), SCHEMA)


def passing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` without the rows that fail, in one pass over their texts."""
    at = docs.columns.index("text")
    texts_of(docs)  # bounds the batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(limits)
        for batch in batches:
            pair = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["doc_id", "text"])
            mask = [x for part in judge(iter([pair])) for x in part.column(7).to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
