"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words and of lexicon beginnings
(first four bytes), both learned from the sample; second-person words and
lexicon words near them; capitals; punctuation; obfuscation (lexicon words that
show only after look-alike characters are put back, and words that mix letters
with digits or symbols).

Training reads a bounded sample of labelled documents: about ``toxic`` and
``clean`` ones (all, if there are fewer), those whose hash of doc_id lies below
the share that is wanted, so that no task ever ranks a label's rows. Rows weigh
as many documents of their label as they stand for. Four fifths of the sample
make the lexicon and fit the trees, the rest, which neither has seen, the
calibration. Only features (a few kilobytes a document at most) and the lexicon
(at most ``entries``) reach the driver.

Null and empty texts get the score of a text without words. Labels that are
null, or of rows without an id, don't count; of several labels of a document
the largest counts. Rows are scored one by one; an empty table gives an empty
result; without any label all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.langid import held_out
from plumbline.llm.scratch import below_share, texts_of, written
from plumbline.llm.textbatch import Texts, U, Words, flat, mix, range_hash, salted, slices, words
from plumbline.llm.trees import Isotonic, Trees, calibrate, fit

PREFIX = 4
NEAR = 5
#: Fixed list: words for the one spoken to, in the languages at hand.
SECOND_PERSON = "you your yours yourself ur u tu te toi vous votre vos du dich dir dein deine sie ihr euch ti usted ustedes vosotros".split()

UPPER, DIGIT, ALPHA, PUNCT, SYMBOL = (np.zeros(256, bool) for _ in range(5))
UPPER[0x41:0x5B] = True
DIGIT[0x30:0x3A] = True
ALPHA[0x41:0x5B] = ALPHA[0x61:0x7B] = ALPHA[0x80:] = True
PUNCT[0x21:0x7F] = True
PUNCT &= ~(ALPHA | DIGIT)
SYMBOL[list(b"#*$%&@^~|<>_+=")] = True

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[0x41:0x5B] += 32
LOOKALIKE = PLAIN.copy()
LOOKALIKE[list(b"013457@$")] = np.frombuffer(b"oieastas", np.uint8)

N_FEATURES = 17


@dataclass(frozen=True)
class Sample:
    toxic: int = 5_000
    clean: int = 10_000
    entries: int = 4_000
    rounds: int = 80


def normal(texts: Texts, look_alike: bool) -> tuple[np.ndarray, Texts, Words]:
    """Words in lower case without punctuation; look-alike characters as letters if asked."""
    drop = PUNCT.copy()
    if look_alike:
        drop[list(b"@$")] = False
    keep = ~drop[texts.data]
    data = (LOOKALIKE if look_alike else PLAIN)[texts.data[keep]]
    offsets = np.concatenate([[0], np.cumsum(keep)])[texts.offsets]
    out = Texts(data, offsets, texts.valid)
    return data, out, words(out)


def entries(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lexicon keys of each word: of the whole, and of its beginning (0 if it is no longer than that)."""
    longer = w.end - w.start > PREFIX
    start = range_hash(data, w.start, np.minimum(w.end, w.start + PREFIX))
    return w.hash, np.where(longer, mix(start ^ salted(21)), U(0))


def _hashes(listed: list[str]) -> np.ndarray:
    return words(flat(pa.array([" ".join(listed)]))).hash


YOU = np.sort(_hashes(SECOND_PERSON))


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]).astype(np.float64)


def features(texts: Texts, lexicon: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    data, _, w = normal(texts, False)
    whole, start = entries(data, w)
    hit, begun = _in(lexicon, whole), _in(lexicon, start)
    odd_data, _, odd = normal(texts, True)
    odd_hit = _in(lexicon, entries(odd_data, odd)[0])
    you = _in(YOU, whole)
    n_words = np.diff(w.first).astype(np.float64)
    place, row = np.arange(len(whole)), np.repeat(np.arange(len(texts)), np.diff(w.first))
    near = np.zeros(len(whole), bool)
    if you.any():
        marks = np.flatnonzero(you)
        after = np.minimum(np.searchsorted(marks, place), len(marks) - 1)
        for at in (marks[after], marks[np.maximum(after - 1, 0)]):
            near |= (np.abs(at - place) <= NEAR) & (row[at] == row)
    raw, offsets = texts.data, texts.offsets
    size = np.diff(offsets).astype(np.float64)
    letters, upper = _sum(ALPHA[raw], offsets), _sum(UPPER[raw], offsets)
    own = words(texts)
    mixed = np.zeros(len(own.start), bool)
    shouted = np.zeros(len(own.start), bool)
    if len(own.start):
        def count(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[own.end] - total[own.start]

        alpha, other, caps = count(ALPHA[raw]), count(DIGIT[raw] | SYMBOL[raw]), count(UPPER[raw])
        mixed, shouted = (alpha > 0) & (other > 0), (caps == alpha) & (caps > 1)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(size, 1)
    hits, starts, odd_hits = _sum(hit, w.first), _sum(begun, w.first), _sum(odd_hit, odd.first)
    hidden = np.maximum(odd_hits - hits, 0)
    columns = [
        np.log1p(n_words), hits * per_word, np.log1p(hits), starts * per_word, np.log1p(starts), hidden * per_word, np.log1p(hidden),
        _sum(you, w.first) * per_word, _sum(near & (hit | begun), w.first) * per_word, upper / np.maximum(letters, 1), _sum(shouted, own.first) * per_word,
        _sum(PUNCT[raw], offsets) * per_byte, _sum(raw == 0x21, offsets) * per_byte, _sum(SYMBOL[raw], offsets) * per_byte, _sum(DIGIT[raw], offsets) * per_byte,
        _sum(mixed, own.first) * per_word, letters * per_word,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    lexicon: np.ndarray
    trees: Trees
    calibration: Isotonic
    blank: bool = False

    def score(self, texts: Texts) -> np.ndarray:
        if self.blank:
            return np.zeros(len(texts))
        return self.calibration(self.trees.raw(features(texts, self.lexicon)))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, toxic, n): in how many documents of a slice each lexicon key occurs."""
    for batch, texts in slices(batches):
        toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
        data, _, w = normal(texts, False)
        row = np.repeat(np.arange(len(texts)), np.diff(w.first))
        for label in (0, 1):
            mine = toxic[row] == label
            once = []
            for keys in entries(data, w):
                pair = np.unique(np.rec.fromarrays([row[mine], keys[mine]])) if mine.any() else None
                if pair is not None:
                    once.append(pair["f1"])
            if once:
                key, n = np.unique(np.concatenate(once), return_counts=True)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.full(len(key), label, np.int32)), pa.array(n)], names=["entry", "toxic", "n"])


def _described(lexicon: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows = features(texts, lexicon)
            yield pa.record_batch([*batch.columns[:3], pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "toxic", "fits", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """A model from labelled rows: ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known, "known")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, sample.toxic / max(1, totals.get(1, 0))).otherwise(sample.clean / max(1, totals.get(0, 0)))
    fits = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(5)) != 0
    chosen = written(known.where(below_share(share, "doc_id")).select("doc_id", "toxic", fits.alias("fits")), "sample")
    # About toxic + clean ids. A document that is there twice is learned once.
    rows = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "fits", "text")
    rows = written(rows.groupBy("doc_id", "toxic", "fits", "text").agg(F.lit(1).alias("one")).drop("one"), "labelled")
    counted = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("fits").alias("n_fits")).collect()
    sizes, fitted = {r["toxic"]: r["n"] for r in counted}, {r["toxic"]: r["n_fits"] for r in counted}
    if not sizes:
        return Model(np.zeros(0, U), fit(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0)), Isotonic(np.zeros(0), np.zeros(0)), True)
    n1, n0 = fitted.get(1, 0), fitted.get(0, 0)
    seen = rows.where("fits").mapInArrow(_seen, "entry bigint, toxic int, n bigint").groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    telling = seen.where((F.col("t") >= max(3, n1 // 200)) & (F.col("entry") != 0)).select("entry", "t", odds.alias("odds")).where("odds >= 2.5")
    best = telling.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "entry").limit(sample.entries).toArrow()
    lexicon = np.sort(best["entry"].to_numpy().astype(np.int64).view(U))
    found = rows.select("doc_id", "toxic", "fits", "text").mapInArrow(_described(lexicon), "doc_id bigint, toxic int, fits boolean, x array<double>").orderBy("doc_id", "x").toArrow()
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, N_FEATURES)
    y = found["toxic"].to_numpy().astype(np.float64)
    weight = np.where(y == 1, totals.get(1, 0) / max(sizes.get(1, 0), 1), totals.get(0, 0) / max(sizes.get(0, 0), 1))
    rest = ~found["fits"].to_numpy().astype(bool)
    trees = fit(x[~rest], y[~rest], weight[~rest], sample.rounds)
    return Model(lexicon, trees, calibrate(trees.raw(x[rest]), y[rest], weight[rest]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            score = model.score(texts)
            yield pa.record_batch([*batch.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = texts_of(docs, held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def identified(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """Train on the labels of rows that are not held out, then score every row."""
    return scored(docs, train(docs, labels.where(~held_out()), sample))
