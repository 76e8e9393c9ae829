"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the
counts of what followed. A byte costs -log2 of its share in the longest known
context; if it never followed there, it costs the context's escape (method C:
distinct / (total + distinct)) and then what it costs in the next shorter
context, at last 8 bits. The statistics are frozen after training, so the code
length of a text is exact and a text's language is the one with the shortest.

What is coded is the whole text in a plain form: words (runs of bytes that are ASCII
letters, lower-cased, or not ASCII) with one space between them and at both ends;
the first space is free. Contexts reach over spaces into the words before. All
positions of a slice of texts are coded side by side: the costs of all grams seen
in training are tabulated in a hash table that numpy probes, so most bytes take
one look-up for all languages.

Grams of three and more bytes that training saw once aren't kept. Their contexts'
totals and numbers of distinct symbols still count them, and their share goes to
the escape, so that what is left is a proper code.

Training reads about ``per_language`` documents of each label (fewer if ``total``
would be passed, all if there are no more): of those of at most ``longest`` bytes,
and where these are too few, of the first ``longest`` characters of longer ones, those
whose hash of doc_id lies below the share that is wanted; no task ranks a
language's rows. score is the posterior of the language from the code lengths under
equal priors, so it says nothing of texts in none of the languages; ``speaking``
therefore also wants a text's bits per byte to be within its language's limit.
Limits are learned from the sample by two folds: each text is coded by a model of
the other fold, and the limit is SLACK times what all but OUTSIDE of the language's
texts need at most.

Texts that are null or without a letter are ``und`` with score 0, and so is every
text if nothing was learned. Of equal code lengths the language first by name wins.
Rows are judged one by one, so repeated rows get equal rows; other columns may have
any name; an empty table gives an empty result. A text of n bytes takes a worker
about 30 n bytes, since it is coded in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import below_share, texts_of, written
from plumbline.llm.textbatch import Texts, U, mix, slices

ORDER = 4
LETTER = regex.compile(r"\p{L}")
#: Bytes coded at a time.
SEGMENT = 1 << 18
OUTSIDE, SLACK = 0.005, 1.2

#: Letters lower-cased; 0x20 for what stands between words.
CODED = np.full(256, 0x20, np.uint8)
CODED[0x80:] = np.arange(0x80, 0x100)
CODED[0x61:0x7B] = CODED[0x41:0x5B] = np.arange(0x61, 0x7B)


@dataclass(frozen=True)
class Sample:
    per_language: int = 1500
    longest: int = 20_000
    total: int = 200_000


# --------------------------------------------------------------------------- grams


def plain(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words, each with one space after it, and one space before the first;
    and where each row begins. A row without a word is empty."""
    data, offsets = CODED[texts.data], texts.offsets
    inside = data != 0x20
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    start = np.flatnonzero(inside & (~before | edge[:n]))
    row = np.searchsorted(start, offsets)
    letters = np.concatenate([[0], np.cumsum(inside)])
    size = np.diff(np.append(letters[start], letters[-1])) + 1
    leads = np.zeros(len(start), np.int64)
    leads[row[:-1][np.diff(row) > 0]] = 1
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + leads)])
    out = np.full(at[-1], 0x20, np.uint8)
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = inner[at[:-1][leads == 1]] = False
    out[inner] = data[inside]
    return out, at[row]


def places(first: np.ndarray) -> np.ndarray:
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def endings(coded: np.ndarray) -> np.ndarray:
    """The last ORDER + 1 bytes up to each byte as one integer."""
    out = coded.astype(np.int64)
    for k in range(1, ORDER + 1):
        out[k:] |= coded[: len(coded) - k].astype(np.int64) << (8 * k)
    return out


def gram(ending: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes that end at a byte as an integer with its length."""
    return (length << 40) | (ending & ((1 << (8 * length)) - 1))


def begins(length: int) -> int:
    """The first place in a row of which a gram of this length is coded; the row's own space never is."""
    return max(1, length - 1)


def shorter(key: np.ndarray) -> np.ndarray:
    """Without the first (oldest) byte."""
    n = key >> 40
    return ((n - 1) << 40) | (key & ((np.int64(1) << (8 * (n - 1))) - 1))


def context(key: np.ndarray) -> np.ndarray:
    """Without the last byte."""
    n = key >> 40
    return ((n - 1) << 40) | ((key & ((np.int64(1) << 40) - 1)) >> 8)


def counts(coded: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All grams of up to ORDER + 1 bytes with their numbers; shorter ones from longer ones."""
    ending = endings(coded)
    keys, n = np.unique(gram(ending[place >= begins(ORDER + 1)], ORDER + 1), return_counts=True)
    out = [(keys, n)]
    for length in range(ORDER, 0, -1):
        more = gram(ending[(place >= begins(length)) & (place < begins(length + 1))], length)
        keys, at = np.unique(np.concatenate([shorter(keys), more]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, np.ones(len(more), n.dtype)]), len(keys)).astype(np.int64)
        out.append((keys, n))
    return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, even) of each slice; ``even`` counts the rows so marked."""
    for batch, texts in slices(batches):
        names = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        even = batch.column(batch.schema.get_field_index("even")).to_numpy(zero_copy_only=False).astype(bool)
        coded, first = plain(texts)
        place = places(first)
        for lang in dict.fromkeys(names):
            for half in (False, True):
                pick = np.repeat((names == lang) & (even == half), np.diff(first))
                keys, n = counts(coded[pick], place[pick])
                yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n), pa.array(n if half else np.zeros_like(n))], names=["lang", "gram", "n", "even"])


# --------------------------------------------------------------------------- model


class Model:
    """Costs in bits of all grams kept, and escapes of their contexts, for each language.

    ``total`` and ``kinds`` are those of each gram's context before anything was left
    out; without them, of the grams given.
    """

    def __init__(self, languages: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray, total: np.ndarray | None = None, kinds: np.ndarray | None = None) -> None:
        self.languages = languages
        #: Bits per byte up to which a text is in the language.
        self.limits = np.full(len(languages), np.inf)
        keys, at = np.unique(grams, return_inverse=True)
        shape = (len(keys), max(1, len(languages)))
        counted = np.zeros(shape)
        counted[at, lang] = n
        contexts, place = np.unique(context(keys), return_inverse=True) if len(keys) else (keys, at)
        held = np.zeros((len(contexts), shape[1]))
        np.add.at(held, place, counted)
        all_, different = held.copy(), np.zeros_like(held)
        if total is None or kinds is None:
            np.add.at(different, place, counted > 0)
        else:
            all_[place[at], lang], different[place[at], lang] = total, kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(held > 0, -np.log2((different + all_ - held) / (all_ + different)), 0.0)
            direct = -np.log2(counted / (all_ + different)[place])
        cost = np.where(counted > 0, direct, 0.0)
        for length in range(1, ORDER + 2):  # shorter grams first
            rows = np.flatnonzero(keys >> 40 == length)
            if not len(rows):
                continue
            if length == 1:
                less = np.full((len(rows), cost.shape[1]), 8.0)
            else:
                less = self._look(keys, cost, shorter(keys[rows]))
            cost[rows] = np.where(counted[rows] > 0, cost[rows], escape[place[rows]] + less)
        self.costs = Table(keys, cost.astype(np.float32))
        self.escapes = Table(contexts, escape.astype(np.float32))

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        # A gram's tail was seen whenever the gram was, and at least as often, so it was kept.
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], values[at], 8.0)

    def bits(self, coded: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code length of every byte, a column for each language; a row's own first space is free."""
        out = np.zeros((len(coded), max(1, len(self.languages))), np.float32)
        ending = endings(coded)
        left = np.flatnonzero(place > 0)
        for length in range(ORDER + 1, 0, -1):
            if not len(left):
                break
            use = place[left] >= begins(length)
            key = gram(ending[left], length)
            at = self.costs.find(key)
            hit = use & (at >= 0)
            out[left[hit]] += self.costs.values[at[hit]]
            miss = use & ~hit
            if miss.any():
                esc = self.escapes.find(context(key[miss]))
                rows = left[miss]
                out[rows[esc >= 0]] += self.escapes.values[esc[esc >= 0]]
                if length == 1:
                    out[rows] += 8.0
            left = left[~hit]
        return out


class Table:
    """Open addressing, probed by vectors of keys; slots hold rows, whose keys are looked up, so that empty ones cost four bytes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys.astype(np.int64), values
        size = 1 << max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.mask = size - 1
        self.rows = np.full(size, -1, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(self.keys[left], self.probes)
            free = self.rows[slot] == -1
            taken, who = np.unique(slot[free], return_index=True)
            put = left[free][who]
            self.rows[taken] = put
            left = np.setdiff1d(left, put, assume_unique=True)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((mix(keys.astype(np.int64).view(U)) + U(probe)) & U(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys) if len(self.keys) else 0)
        for probe in range(self.probes):
            row = self.rows[self._slot(keys[left], probe)]
            full = row >= 0
            left, row = left[full], row[full]
            hit = self.keys[row] == keys[left]
            out[left[hit]] = row[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def _sample(docs: DataFrame, sample: Sample) -> tuple[list[str], DataFrame]:
    """The languages, and the sampled rows (lang, even, text)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    long = F.octet_length("text") > sample.longest
    # One row for each language.
    found = labelled.groupBy("lang").agg(F.count_if(~long).alias("short"), F.count_if(long).alias("long")).collect()
    most = max(1, min(sample.per_language, sample.total // max(1, len(found))))
    shares = [(r["lang"], most / max(1, r["short"]), max(0, most - r["short"]) / max(1, r["long"])) for r in found]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, short double, long double"))
    begun = F.when(long, F.substring("text", 1, sample.longest)).otherwise(F.col("text"))
    even = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)) == 0
    chosen = labelled.select("doc_id", "lang", "text").join(share, "lang").where(below_share(F.when(long, F.col("long")).otherwise(F.col("short")), "doc_id"))
    # A row that is there twice is learned once.
    rows = chosen.select("doc_id", "lang", even.alias("even"), begun.alias("text")).groupBy("doc_id", "lang", "even", "text").agg(F.lit(1).alias("one"))
    return sorted(r["lang"] for r in found), written(rows.select("lang", "even", "text"), "sample")


def train(docs: DataFrame, sample: Sample = Sample(), limited: bool = True) -> Model:
    """A model from ``docs`` (doc_id, text, lang), of which only labelled rows count; with limits if wanted."""
    languages, texts = _sample(docs, sample)
    every = texts.mapInArrow(_counted, "lang string, gram bigint, n bigint, even bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("even").alias("even"))
    every = written(every.withColumn("context", F.expr("shiftleft(shiftright(gram, 40) - 1, 40) | shiftright(gram & 1099511627775, 8)")), "grams")
    odd = F.col("n") - F.col("even")
    whole = every.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("even").alias("even_total"), F.count_if(F.col("even") > 0).alias("even_kinds"), F.count_if(odd > 0).alias("odd_kinds"))
    kept = every.where((F.col("gram") < (3 << 40)) | (F.col("n") > 1)).join(whole, ["lang", "context"]).drop("context").toArrow()
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[x] for x in kept["lang"].to_pylist()], np.int64)
    get = {c: kept[c].to_numpy().astype(np.float64) for c in kept.column_names if c not in ("lang", "gram")}
    grams = kept["gram"].to_numpy().astype(np.int64)
    model = Model(languages, lang, grams, get["n"], get["total"], get["kinds"])
    if limited and len(grams):
        crossed = None
        for fold, (m, total, kinds) in enumerate(((get["n"] - get["even"], get["total"] - get["even_total"], get["odd_kinds"]), (get["even"], get["even_total"], get["even_kinds"]))):
            some = (m > 1) | (m > 0) & (grams < (3 << 40))
            half = Model(languages, lang[some], grams[some], m[some], total[some], kinds[some])
            # A task has one of the two models.
            coded = texts.where(~F.col("even") if fold else F.col("even")).mapInArrow(_crossed(half, set(lang[some].tolist())), "lang string, bits double")
            crossed = coded if crossed is None else crossed.unionByName(coded)
        bits = crossed.groupBy("lang").agg(F.percentile("bits", 1 - OUTSIDE).alias("most"))
        found = {number[r["lang"]]: SLACK * r["most"] for r in bits.collect()}
        for i in range(len(languages)):  # a language of one text has the widest limit of the others
            model.limits[i] = found.get(i, max(found.values(), default=np.inf))
    return model


def _crossed(model: Model, known: set[int]):
    """(lang, bits per byte) of texts by the model of the fold that they aren't in, which knows some languages."""
    number = {x: i for i, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            place = [number[x] for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]
            total, size = code_lengths(model, texts)
            out = [(model.languages[k], total[i, k] / size[i]) for i, k in enumerate(place) if k in known and size[i]]
            yield pa.record_batch([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=["lang", "bits"])

    return run


# --------------------------------------------------------------------------- prediction


def code_lengths(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bits of every row in each language, and the number of bytes coded."""
    coded, first = plain(texts)
    place = places(first)
    total = np.zeros((len(texts), max(1, len(model.languages))))
    for a in range(0, len(coded), SEGMENT):
        b, s = min(a + SEGMENT, len(coded)), max(0, a - ORDER)
        sums = np.zeros((b - a + 1, total.shape[1]))
        np.cumsum(model.bits(coded[s:b], np.where(np.arange(s, b) < a, 0, place[s:b]))[a - s :], axis=0, out=sums[1:])
        edge = np.clip(first, a, b) - a
        total += sums[edge[1:]] - sums[edge[:-1]]
    return total, np.maximum(np.diff(first) - 1, 0)


def _judged(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index of the language, its posterior, and its bits per byte; -1, 0 and 0 for texts without a letter."""
    data = CODED[texts.data]
    ascii_letter = (data >= 0x61) & (data < 0x7B)
    some = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[texts.offsets]) > 0
    for i in np.flatnonzero(~some & (np.diff(texts.offsets) > 0)):
        some[i] = LETTER.search(texts.raw(i).decode("utf-8", "replace")) is not None
    if not len(model.languages):
        return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    total, size = code_lengths(model, texts)
    best, least = total.argmin(axis=1), total.min(axis=1)
    with np.errstate(over="ignore"):
        posterior = 1.0 / np.exp2(np.clip(least[:, None] - total, -1000, 0)).sum(axis=1)
    return np.where(some, best, -1), np.where(some, posterior, 0.0), np.where(some, least / np.maximum(size, 1), 0.0)


def scores(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The index of the language and its posterior; -1 and 0 for texts without a letter."""
    return _judged(model, texts)[:2]


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            best, posterior = scores(model, texts)
            names = [model.languages[i] if i >= 0 else "und" for i in best]
            yield pa.record_batch([*batch.columns[:2], pa.array(names, pa.string()), pa.array(posterior)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out() -> Column:
    """Every fifth document by the checksum of its id; never one without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of ``docs`` (doc_id, text)."""
    rows = texts_of(docs, held_out().alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out, then predict every row."""
    return predicted(docs, train(docs.where(~held_out()), sample, limited=False))


def speaking(docs: DataFrame, model: Model, wanted: tuple[str, ...] | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` in a wanted language (None: any learned one) with at least this score and within the language's limit."""
    at = docs.columns.index("text")
    texts_of(docs)  # bounds the batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.record_batch([batch.column(at)], names=["text"])
            mask: list[bool] = []
            for _, texts in slices(iter([pair])):
                best, posterior, bits = _judged(model, texts)
                mask += [bool(b >= 0 and p >= least and x <= model.limits[b]) and (wanted is None or model.languages[b] in wanted) for b, p, x in zip(best, posterior, bits)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
