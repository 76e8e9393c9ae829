"""Exact n-gram Jaccard self-join by PartEnum signatures, and its components.

A document's set holds its distinct word shingles (A-Z lower-cased; a document
with fewer words than a shingle has its whole sequence as one element; one
without words has no set and links with nothing). Documents A and B link when
``100 * |A & B| >= percent * |A | B|``.

How it finds links without comparing all pairs:

1. Documents with equal sets form one class; only the smallest doc_id of a
   class goes on. Copies are therefore never paired with each other.
2. Sizes are cut into bands. Within a band, and between a band and the next,
   linked sets differ in at most ``k`` elements (their Hamming distance). The
   64-bit domain of elements is cut into ``n1`` equal ranges of ``n2`` sub-ranges
   each; by the pigeonhole principle some range has at most ``k2`` differing
   elements, hence some ``n2 - k2`` of its sub-ranges agree. A signature is the
   hash of one such choice of sub-ranges; all choices are enumerated, so linked
   sets share one. ``shape`` sets k2 and n2 for a band.
3. Where few documents share a signature, all their pairs are candidates. Where
   more than ``small_run`` do, each is compared with one centre only. A run that
   this leaves in more than one component, which happens where documents share a
   passage or are distant copies of one text, is split by finer signatures: its
   documents are signed again by prefixes, elements in the order of their
   frequency among these documents, rarest first. Two linked sets of n and m
   elements share at least ``o = ceil(percent * (n + m) / (100 + percent))``, so
   one of the first ``n - o + 1`` of each; m is known but for the width of a narrow
   band. Elements of one document alone come first in that order, and use up the
   prefix of a document that has too many of them to link with anything; a shared
   passage comes last. The centre of a run is the document with the fewest elements
   of its own. The runs that are still unsettled then, of distant copies of one
   text, are compared whole: in blocks, of which each pair is compared by products
   of matrices (documents by elements), and which give only links that join
   components. A block grows with the square root of its run up to a bound, so a
   text of a run of n documents is sent about sqrt(n) / 32 times, at most n / 8192
   times beyond 65,536. So no link is lost at any size, and no pairs are listed.
4. Candidates are verified by comparing whole sets, those of one centre together,
   so that a centre is read once for CHUNK members.

Elements are 64-bit hashes of shingles; two different shingles of a pair meet
by chance with a probability of about 1e-13 for texts of a thousand words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.exact_dedup import text_hash, without
from plumbline.llm.scratch import few, texts_of, written
from plumbline.llm.textbatch import LOWER, SLICE_BYTES, Texts, U, mix, released, salted, shingles, slices, words

#: Up to this distance ranges have three sub-ranges, beyond it two: sets with many
#: elements have strong signatures anyway, and many of them.
FINE = 64
#: Members compared with one reading of their centre.
CHUNK = 64
#: Members and elements of a tile, in which a block is compared; elements in a matrix at a time, and its rows judged at a time.
TILE, ELEMENTS, COLUMNS, ROWS = 1024, 1 << 18, 2048, 256
#: A block has so many tiles at most (on average), in members and in elements.
TILES = 8
#: Elements looked at for those of one document alone, as a multiple of what a document may have.
ALONE = 1.6
#: Ratio of the bounds of size bands for prefixes.
WIDTH = 1.05

EDGE = pa.schema({"kind": pa.int32(), "sig": pa.int64(), "a": pa.int64(), "b": pa.int64(), "rank": pa.int64()})
SETS = "row bigint, doc_id bigint, text_sha256 string, n bigint, h1 bigint, h2 bigint, packed binary"
EDGES = "kind int, sig bigint, a bigint, b bigint, rank bigint"


@dataclass(frozen=True)
class Rule:
    """Shingle length in words, the least similarity in percent, and how the work is cut:
    runs up to ``small_run`` give all their pairs, and tiles have ``tile`` members at most."""

    size: int = 5
    percent: int = 80
    small_run: int = 8
    tile: int = TILE


# --------------------------------------------------------------------------- sets


def element_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """For each row, its distinct shingle hashes in ascending order."""
    w = words(texts, LOWER[texts.data])
    grams, _ = shingles(w, size)
    out = []
    for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if e - s >= size:
            a = np.sort(grams[s : e - size + 1])
            out.append(a[np.concatenate([np.ones(1, bool), a[1:] != a[:-1]])] if len(a) > 1 else a)
        elif e > s:
            with np.errstate(over="ignore"):
                h = U(e - s)
                for k in range(s, e):
                    h = mix(np.array([h * salted(7) + w.hash[k]], U))[0]
            out.append(np.array([h], U))
        else:
            out.append(np.zeros(0, U))
    return out


def _fingerprints(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        row = TaskContext.get().partitionId() << 40
        for batch, texts in slices(batches):
            sets = element_sets(texts, size)
            n = np.array([len(x) for x in sets], np.int64)
            with np.errstate(over="ignore"):
                one = np.array([mix(x ^ salted(11)).sum() for x in sets], U)
                two = np.array([mix(x ^ salted(12)).sum() for x in sets], U)
            packed = [pack.compress(texts.raw(i)) if n[i] else None for i in range(len(texts))]
            own = pa.array(np.arange(row, row + len(texts), dtype=np.int64))
            row += len(texts)
            yield pa.record_batch([own, *batch.columns[:2], pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(packed, pa.binary())], names=[x.split()[0] for x in SETS.split(", ")])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[np.ndarray], Texts]]:
    """The named bigint columns and the texts of column packed, slice by slice."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        held, at, size = [], 0, 0
        packed = batch.column(batch.schema.get_field_index("packed"))
        for i in range(len(packed)):
            held.append(unpack.decompress(packed[i].as_py()))
            size += len(held[-1])
            if size >= SLICE_BYTES or i + 1 == len(packed):
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in held])])
                yield [k[at : i + 1] for k in keys], Texts(np.frombuffer(b"".join(held), np.uint8), ends, np.ones(len(held), bool))
                held, at, size = [], i + 1, 0
    released()


# --------------------------------------------------------------------------- signatures


class Bands:
    """Size bands of a similarity, and the Hamming distance within each."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.last = [0]

    def _grow(self, size: int) -> None:
        while self.last[-1] < size:
            low = self.last[-1] + 1
            self.last.append(max(low, low * 10_000 // self.percent**2))

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, k) under which a set of n elements is signed; k = 0 needs no signature."""
        self._grow(n)
        band = int(np.searchsorted(self.last, n))
        out = [band]
        if n * 100 // self.percent > self.last[band]:
            self._grow(self.last[band] + 1)
            out.append(band + 1)
        return [(b, k) for b in out if (k := 2 * self.last[b] * (100 - self.percent) // (100 + self.percent)) > 0]


def shape(k: int) -> tuple[int, int]:
    """k2 and n2 of a distance: differing elements allowed in a range, and its sub-ranges."""
    return (1, 3) if k <= FINE else (1, 2)


@lru_cache(4096)
def _ranges(k: int, k2: int, n2: int) -> tuple[int, int, np.ndarray]:
    """Ranges n1, spare ranges, and the lower bounds of all sub-ranges.

    ``1 + spare`` ranges have at most k2 differences, so linked sets share as many
    signatures. Each set leaves out its ``spare`` weakest ones, in an order of what
    they stand for (fewest elements first): of the shared ones, the last in that
    order has ``spare`` before it in either set, so both keep it. This costs no
    signatures, and those of one or no element, in which documents with a common
    passage would meet, are hardly ever left.
    """
    spare = 1 + k // 10
    n1 = k // (k2 + 1) + 1 + spare
    m = n1 * n2
    return n1, spare, np.array([(j << 64) // m for j in range(1, m)], U)


def signatures(elements: np.ndarray, bands: Bands, shape: Callable[[int], tuple[int, int]] = shape) -> np.ndarray:
    """PartEnum signatures of one set (ascending distinct hashes)."""
    own = bands.of(len(elements))
    if not own:
        return np.zeros(0, U)
    out = []
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(elements ^ salted(200)), dtype=U)])
        for band, k in own:
            k2, n2 = shape(k)
            n1, spare, lower = _ranges(k, k2, n2)
            at = np.concatenate([[0], np.searchsorted(elements, lower), [len(elements)]])
            sums = np.diff(total[at]).reshape(n1, n2)
            held = np.diff(at).reshape(n1, n2)
            chosen = [list(c) for c in combinations(range(n2), n2 - k2)]
            hashes = np.stack([mix(sums[:, c].sum(axis=1, dtype=U) + (np.arange(n1, dtype=U) * U(len(chosen)) + U(j)) * salted(300) + U(band) * salted(400)) for j, c in enumerate(chosen)], axis=1).ravel()
            number = np.stack([held[:, c].sum(axis=1) for c in chosen], axis=1).ravel()
            out.append(hashes[np.lexsort((hashes, number))[spare:]])
    return np.concatenate(out)


SIGNED = "key bigint, a bigint, rank bigint, b bigint, sig bigint"


def _combined(sig: np.ndarray, doc: np.ndarray, rank: np.ndarray, small_run: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, rank, b, sig). A signature that more than small_run documents of
    a slice share goes on once (b = a), for the one of least rank; the others become
    edges to that one, with a key of their own, so that no key gathers a large group."""

    def rows(key: np.ndarray, a: np.ndarray, r: np.ndarray, b: np.ndarray | None, s: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(key), pa.int64())
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(a), pa.array(r), none if b is None else pa.array(b), none if s is None else pa.array(s.view(np.int64))], names=["key", "a", "rank", "b", "sig"])

    if not len(sig):
        return
    order = np.lexsort((doc, rank, sig))
    sig, doc, rank = sig[order], doc[order], rank[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(first, len(sig)))
    hot = np.repeat(length > small_run, length)
    if hot.any():
        centre, its_rank = np.repeat(doc[first], length), np.repeat(rank[first], length)
        head = np.zeros(len(sig), bool)
        head[first] = True
        lead, rest = hot & head, hot & ~head
        yield rows(sig[lead], doc[lead], rank[lead], doc[lead], sig[lead])
        with np.errstate(over="ignore"):
            yield rows(mix(doc[rest].view(U) + sig[rest]), doc[rest], its_rank[rest], centre[rest], sig[rest])
    yield rows(sig[~hot], doc[~hot], rank[~hot], None, None)


def _signed(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """PartEnum signatures of packed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(rule.percent)
        for (ids,), texts in _unpacked(batches, ["doc_id"]):
            signed = [signatures(x, bands) for x in element_sets(texts, rule.size)]
            doc = np.repeat(ids, [len(x) for x in signed])
            yield from _combined(np.concatenate([*signed, np.zeros(0, U)]), doc, np.zeros(len(doc), np.int64), rule.small_run)

    return run


def _elements(rule: Rule, share: float = 1.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(element, a) of packed texts, of the elements in the lowest ``share`` of their domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in _unpacked(batches, ["doc_id"]):
            sets = element_sets(texts, rule.size)
            if share < 1:
                sets = [x[: int(np.searchsorted(x, U(int(share * 2.0**64))))] for x in sets]
            yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in sets]))], names=["element", "a"])

    return run


def _combine_rows(small_run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, rank = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            yield from _combined(key.view(U), doc, rank, small_run)

    return run


def _band(size: Column) -> Column:
    """The narrow band of a size; its least size is at least ``WIDTH ** band`` but for rounding."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(WIDTH)) + 1e-9).cast("int")


def _may_link(nodes: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """``nodes`` without those that can link with none of them, by what a part of the domain shows.

    A set of n elements links only if at least ``ceil(percent * n / 100)`` of them are shared,
    so not if more than the rest occur in no other set. These are counted in the lowest part of
    the domain of elements, which is so large that a document with little text in common with
    others has enough of them there. What is left is not decided here.
    """
    share = min(1.0, ALONE * (100 - rule.percent) / 100)
    some = nodes.mapInArrow(_elements(rule, share), "element bigint, a bigint")
    once = some.groupBy("element").agg(F.count("*").alias("df"), F.min("a").alias("a")).where("df = 1")
    alone = once.groupBy("a").agg(F.count("*").alias("alone")).join(sizes, "a")
    lone = alone.where(F.col("alone") > F.col("n") - F.ceil(F.col("n") * rule.percent / 100))
    return nodes.join(few(lone.select(F.col("a").alias("doc_id"))), "doc_id", "left_anti")


def _by_prefix(nodes: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Prefix signatures of ``nodes``. Elements of one document alone can't be shared;
    they only move the others back, which their number tells."""
    percent = rule.percent
    each = nodes.mapInArrow(_elements(rule), "element bigint, a bigint")
    shared = each.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("a")
    alone = F.col("n") - F.count("*").over(own)
    placed = each.join(shared, "element").join(sizes, "a").select("element", "a", "n", alone.alias("alone"), (alone + F.row_number().over(own.orderBy("df", "element"))).alias("place"))
    n = F.col("n")
    fewest = F.ceil(n * percent / 100)  # of a partner

    def reaches(band: Column) -> Column:
        least = F.greatest(fewest, F.floor(F.pow(F.lit(WIDTH), band) * 0.999999))
        return F.col("place") <= n - F.ceil((n + least) * percent / (100 + percent)) + 1

    some = placed.where(F.col("place") <= n - fewest + 1)  # the longest prefix
    partner = F.explode(F.filter(F.sequence(_band(fewest), _band(F.ceil(n * 100 / percent))), reaches)).alias("other")
    rows = some.select("element", "a", "alone", _band(n).alias("band"), partner)
    key = F.xxhash64("element", F.least("band", "other"), F.greatest("band", "other"))
    return rows.select(key.alias("key"), "a", F.col("alone").alias("rank")).mapInArrow(_combine_rows(rule.small_run), SIGNED)


def _edges(batches: Iterator[pa.RecordBatch], small_run: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from rows sorted by key, rank, a. kind 0: a pair of a small
    run; kind 1: a member and the centre of a large run, with its signature. Only
    the run at the end of a batch is held, and of a large run only its centre."""

    def out(kind: int, sig: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), *map(pa.array, (sig, a, b, rank))], schema=EDGE)

    empty = np.zeros(0, np.int64)
    key, a, rank, marked = empty, empty, empty, np.zeros(0, bool)
    large: tuple[int, int, int] | None = None  # key, centre and its rank of a large run that may go on

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal key, a, rank, marked, large
        if large is not None and len(key):
            same = key == large[0]
            n = int(same.sum())
            if n:
                yield out(1, key[same], a[same], np.full(n, large[1]), np.full(n, large[2]))
                key, a, rank, marked = key[~same], a[~same], rank[~same], marked[~same]
            if len(key):
                large = None
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        any_marked = np.add.reduceat(marked, first, dtype=np.int64) > 0
        done = len(key)
        if not last and length[-1] <= small_run:
            done = int(first[-1])  # the run may go on in the next batch
            first, length, any_marked = first[:-1], length[:-1], any_marked[:-1]
        big = (length > small_run) | any_marked
        in_big = np.repeat(big, length)
        k, x, r = key[:done], a[:done], rank[:done]
        if in_big.any():
            centre, its_rank = np.repeat(x[first], length), np.repeat(r[first], length)
            yield out(1, k[in_big], x[in_big], centre[in_big], its_rank[in_big])
            if not last and big[-1] and done == len(key):
                large = (int(k[-1]), int(centre[-1]), int(its_rank[-1]))
        k, x, r = k[~in_big], x[~in_big], r[~in_big]
        for d in range(1, small_run):
            both = np.flatnonzero((k[d:] == k[:-d]) & (x[d:] != x[:-d])) if len(k) > d else empty
            if not len(both):
                break
            yield out(0, k[both], np.maximum(x[both + d], x[both]), np.minimum(x[both + d], x[both]), r[both])
        key, a, rank, marked = key[done:], a[done:], rank[done:], marked[done:]

    for batch in batches:
        b = batch.column(3)
        has_b = b.is_valid().to_numpy(zero_copy_only=False)
        new_key, new_a, new_rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new_b = b.fill_null(-1).to_numpy(zero_copy_only=False)
        edge = has_b & (new_a != new_b)
        if edge.any():
            yield out(1, batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)[edge], new_a[edge], new_b[edge], new_rank[edge])
        key, a, rank, marked = (np.concatenate([old, new[~edge]]) for old, new in ((key, new_key), (a, new_a), (rank, new_rank), (marked, has_b)))
        yield from close(False)
    yield from close(True)


# --------------------------------------------------------------------------- verification


def _verified(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (b, chunk, member, a, packed), sorted, the centre of each chunk first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre_of: tuple[int, int] | None = None
        centre = np.zeros(0, U)
        for (b, chunk, member, a), texts in _unpacked(batches, ["b", "chunk", "member", "a"]):
            keep = []
            for i, x in enumerate(element_sets(texts, rule.size)):
                if not member[i]:
                    centre_of, centre = (b[i], chunk[i]), x
                    continue
                assert centre_of == (b[i], chunk[i]), "a member without its centre"
                least = min(len(x), len(centre))
                if 100 * least < rule.percent * max(len(x), len(centre)):
                    continue
                place = np.searchsorted(centre, x)
                common = int((centre[np.minimum(place, len(centre) - 1)] == x).sum())
                if 100 * common >= rule.percent * (len(x) + len(centre) - common):
                    keep.append(i)
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, packed: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Those of the distinct pairs (a, b) that link. Each centre b is read once per CHUNK members."""
    sized = pairs.join(sizes, "a").join(sizes.select(F.col("a").alias("b"), F.col("n").alias("m")), "b").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * rule.percent)
    close = written(sized.select("a", "b"), "close")
    degree = close.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = close.join(degree, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk"))
    texts = _of(packed, close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct())
    members = dealt.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "chunk", F.lit(1).cast("bigint").alias("member"), "a", "packed")
    centres = dealt.select("b", "chunk").distinct().join(texts.withColumnRenamed("doc_id", "b"), "b").select("b", "chunk", F.lit(0).cast("bigint").alias("member"), F.col("b").alias("a"), "packed")
    rows = members.unionByName(centres).repartition("b", "chunk").sortWithinPartitions("b", "chunk", "member")
    return rows.mapInArrow(_verified(rule), "a bigint, b bigint")


def _tiles(sets: list[np.ndarray], chosen: np.ndarray, tile: int) -> list[np.ndarray]:
    """The chosen sets in runs of bounded numbers of members and elements."""
    size = np.array([len(sets[i]) for i in chosen], np.int64)
    number = np.maximum(np.arange(len(chosen)) // tile, (np.cumsum(size) - size) // ELEMENTS)
    return [chosen[number == k] for k in np.unique(number)]


def _joined_by(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that join different roots, as a forest: among all sets, or if both sides occur, between these."""
    root, out = roots.copy(), []
    sides = [_tiles(sets, np.flatnonzero(side == x), rule.tile) for x in np.unique(side)]
    pairs = [(x, y) for i, x in enumerate(sides[0]) for y in sides[0][i:]] if len(sides) == 1 else [(x, y) for x in sides[0] for y in sides[1]]
    for x, y in pairs:
        both = x if x is y else np.concatenate([x, y])
        if (root[both] == root[both[0]]).all():
            continue
        for i, j in _linked([sets[k] for k in both], root[both], rule.percent):
            a, b = both[i], both[j]
            out.append((int(a), int(b)))
            root[root == root[a]] = root[b]
    return out


def _linked(sets: list[np.ndarray], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among a few sets that join different roots, as a forest."""
    n = np.array([len(x) for x in sets], np.float64)
    every = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    order = np.argsort(every, kind="stable")
    every, doc = every[order], doc[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(new) - 1
    twice = np.bincount(number)[number] > 1
    doc, number = doc[twice], np.unique(number[twice], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.int32)
    for at in range(0, int(number.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(number, (at, at + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[doc[lo:hi], number[lo:hi] - at] = 1
        np.add(common, part @ part.T, out=common, casting="unsafe")  # whole numbers up to COLUMNS
    linked = np.zeros(common.shape, bool)
    for at in range(0, len(sets), ROWS):
        own = slice(at, at + ROWS)
        linked[own] = (100 + percent) * common[own].astype(np.int64) >= percent * (n[own, None] + n[None, :])
    linked &= roots[:, None] != roots[None, :]
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked))):
        a, b = find(int(roots[i])), find(int(roots[j]))
        if a != b:
            above[a] = b
            out.append((int(i), int(j)))
    return out


def _compare_blocks(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (sig, x, y, own, a, root, packed), sorted: one pair of blocks of a run after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int, int] | None = None
        held: list[tuple[int, int, int]] = []
        sets: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            own, ids, roots = (np.array(x, np.int64) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
            one_side = key is not None and key[1] != key[2] and len(np.unique(own)) < 2
            if len(held) > 1 and not one_side and (roots != roots[0]).any():
                found = _joined_by(sets, roots, own, rule)
                yield pa.record_batch([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])
            held.clear()
            sets.clear()

        for (sig, x, y, own, a, root), texts in _unpacked(batches, ["sig", "x", "y", "own", "a", "root"]):
            for i, elements in enumerate(element_sets(texts, rule.size)):
                if (sig[i], x[i], y[i]) != key:
                    yield from close()
                    key = (sig[i], x[i], y[i])
                held.append((int(own[i]), int(a[i]), int(root[i])))
                sets.append(elements)
        yield from close()

    return run


def _by_blocks(runs: DataFrame, packed: DataFrame, sizes: DataFrame, labels: DataFrame | None, rule: Rule) -> DataFrame:
    """Links that join components, among all pairs of each run (sig, a)."""
    member = runs.select("sig", "a").distinct()
    parts = [F.sum(F.xxhash64("a", F.lit(i)).cast("decimal(20,0)")).alias(f"part{i}") for i in range(2)]
    each = member.join(sizes, "a").groupBy("sig").agg(F.count("*").alias("members"), F.sum("n").alias("elements"), *parts)
    # Of runs with the same members one is enough.
    def blocks(amount: str, tile: int) -> Column:
        return F.col(amount) / F.least(F.greatest(F.lit(float(tile)), F.sqrt(F.lit(float(tile)) * F.col(amount))), F.lit(float(TILES * tile)))

    many = each.groupBy("members", "elements", "part0", "part1").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.greatest(blocks("members", rule.tile), blocks("elements", ELEMENTS))).alias("blocks"))
    own = F.pmod(F.xxhash64("a"), F.col("blocks"))
    dealt = _labelled(member, labels).join(many, "sig").select("sig", "a", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    dealt = written(dealt.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "a", "root"), "blocks")
    texts = _of(packed, dealt.select(F.col("a").alias("id")).distinct())
    rows = dealt.join(texts.withColumnRenamed("doc_id", "a"), "a").select("sig", "x", "y", "own", "a", "root", "packed")
    return rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(_compare_blocks(rule), "a bigint, b bigint").distinct()


def _of(packed: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``packed`` with these ids; a broadcast only of a counted, bounded set."""
    return packed.join(few(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    if labels is None:
        return pairs
    one = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    two = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


# --------------------------------------------------------------------------- operator


@dataclass
class JaccardClasses:
    """members: doc_id, n_shingles, class_id, component_id of every row; class_id is the
    smallest doc_id of the rows with the same set, component_id that of its component.
    links: verified links (a, b) between classes, by class_id, that join the components."""

    members: DataFrame
    links: DataFrame | None


@dataclass
class _Found:
    """rows: row, doc_id, text_sha256, n, node (the class; null without a set), class_id.
    classes: node, class_id, n. labels (node, root) and links (a, b) between nodes."""

    rows: DataFrame
    classes: DataFrame
    labels: DataFrame | None
    links: DataFrame | None


def _found(docs: DataFrame, rule: Rule, hashed: bool) -> _Found:
    own = text_hash(F.col("text")) if hashed else F.lit(None).cast("string")
    sets = written(texts_of(docs, own.alias("text_sha256")).mapInArrow(_fingerprints(rule.size), SETS), "sets")
    classes = written(sets.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("class_id")), "classes")
    packed = sets.where("n > 0").select(F.col("row").alias("doc_id"), "packed")
    nodes = packed.join(few(classes.select(F.col("node").alias("doc_id"))), "doc_id")

    links: DataFrame | None = None
    labels: DataFrame | None = None
    sizes = classes.select(F.col("node").alias("a"), "n")
    signed = nodes.mapInArrow(_signed(rule), SIGNED)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for by_prefix in (False, True):
        # A fixed number of parts: these rows are small, but what is done with them is not.
        found = written(signed.repartition(parts, "key").sortWithinPartitions("key", "rank", "a").mapInArrow(lambda rows: _edges(rows, rule.small_run), EDGES), "found")
        # All pairs of small runs, and of a document's large runs the centre of least rank; in the end all centres.
        pairs = found.where("a <> b")
        if not by_prefix:
            best = pairs.where("kind = 1").groupBy("a").agg(F.min_by("b", F.struct("rank", "b")).alias("b"))
            pairs = pairs.where("kind = 0").select("a", "b").unionByName(best)
        new = written(_verify(_apart(pairs.select("a", "b").distinct(), labels), packed, sizes, rule), "links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
        large = found.where("kind = 1")
        runs = written(large.join(_apart(large, labels).select("sig").distinct(), "sig", "left_semi"), "runs")
        if runs.isEmpty():
            break
        if not by_prefix:
            again = runs.select(F.col("a").alias("id")).unionByName(runs.select(F.col("b").alias("id"))).distinct()
            signed = _by_prefix(_may_link(_of(packed, again), sizes, rule), sizes, rule)
            continue
        new = written(_by_blocks(runs, packed, sizes, labels, rule), "links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)

    rows = sets.select("row", "doc_id", "text_sha256", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left").drop("h1", "h2")
    return _Found(rows, classes, labels, links)


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> JaccardClasses:
    """Components of ``docs`` (doc_id, text; other columns are ignored) under ``rule``.

    Rows are what is linked: rows that share a doc_id are linked by their texts alone,
    and a row that occurs twice comes out twice. Null doc_ids are never the smallest;
    class_id and component_id are null where no row has one. Null text counts as
    empty; rows without a word form a class each. An empty table gives an empty result.
    """
    found = _found(docs, rule, False)
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    members = found.rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("class_id"), "node")
    if found.labels is None or found.links is None:
        return JaccardClasses(members.select("doc_id", "n_shingles", "class_id", F.col("class_id").alias("component_id")), None)
    named = found.classes.select("node", F.col("class_id").alias("its_id"))
    grown = found.labels.select("node", "root").unionByName(found.labels.select(F.col("root").alias("node"), "root").distinct())
    least = grown.join(named, "node").groupBy("root").agg(F.min("its_id").alias("least"))
    component = few(grown.join(least, "root").select("node", "root", "least"))
    joined = members.join(component, "node", "left").select("doc_id", "n_shingles", "class_id", F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("least")).alias("component_id"))
    one, two = (named.select(F.col("node").alias(c), F.col("its_id").alias(f"{c}_id")) for c in "ab")
    links = found.links.join(one, "a").join(two, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return JaccardClasses(joined, links)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("root", F.col("a"))
    own = labels.select(F.col("node").alias("a"), "root")
    return rows.join(own, "a", "left").withColumn("root", F.coalesce("root", "a"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with exactly one row of every component, and all rows without a word.

    It is the row of the smallest doc_id (null comes last), of rows with the same
    doc_id that of the least SHA-256 of its text, and of equal rows any one.
    """
    found = _found(docs, rule, True)
    rows = _labelled(found.rows.where("node IS NOT NULL").withColumnRenamed("node", "a"), found.labels)
    each = written(rows.groupBy("root", "doc_id", "text_sha256").agg(F.count("*").alias("n")), "each")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_sha256"))
    several = few(each.groupBy("root").agg(F.min(rank).alias("best"), F.count("*").alias("rows")).where("rows > 1").select("root", F.col("best.text_sha256").alias("best_text"), F.col("best.doc_id").alias("best_id")))
    chosen = F.col("best_text").isNull() | (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_sha256") == F.col("best_text")))
    judged = written(each.join(several, "root", "left").select("doc_id", "text_sha256", "n", chosen.alias("chosen")), "judged")
    return without(docs, judged.where("NOT chosen"), judged.where("chosen AND n > 1"))
