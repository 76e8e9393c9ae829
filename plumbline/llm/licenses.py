"""License texts found by MinHash bands over text windows. DataFrame functions only.

Texts are lower-cased and cut into words (runs of letters and digits), and both
texts and templates into shingles of five words. Templates are grouped by size:
class c holds those of at most ``c`` shingles (a power of two). For each class a
text is read in windows of ``2 c`` shingles that begin every ``c``, so any copy
of a template lies whole in one window. A window retrieves a template if one of
``BANDS`` MinHash values agrees, which an index of the class tells (a map from a
value and its band to templates), so that each window and template come together
once, however many bands agree. The least similarity of a window and a
template of which it holds 80 percent is about 0.19, so a copy is missed with a
probability under (1 - 0.19) ** 64 = 1.4e-6. A retrieved template is then
verified exactly: the share of its distinct shingles that the window holds must
be at least 0.8.

Only windows that could be verified are hashed: they must hold an anchor (for each
template a few words without which under 80 percent of its shingles can be there)
and enough of the class's words at all, since each word that is missing takes a
shingle with it. So this leaves out no match.

One row for each document and license: doc_id, license, containment (the
largest), n_windows. A text may hold several licenses; of equal containments none
is preferred. Null and empty texts, and texts of under five words, match nothing;
rows that repeat a doc_id (null is one, too) are one document; other columns may
have any name; an empty table gives an empty result. A long text is read window
by window: its words are held once for each size class.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.license_texts import TEMPLATES

SHINGLE, LEAST, BANDS = 5, 0.8, 64

@dataclass(frozen=True)
class Template:
    number: int
    license: str
    words: tuple[str, ...]
    size_class: int


def templates_of(texts: tuple[tuple[str, str], ...]) -> list[Template]:
    out = []
    for number, (name, text) in enumerate(texts):
        found = tuple(re.findall(r"[^\W_]+", text.lower()))
        n = len(found) - SHINGLE + 1
        if n < 1:
            raise ValueError(f"the template of {name} has under {SHINGLE} words")
        out.append(Template(number, name, found, 1 << (n - 1).bit_length()))
    return out


def anchors(template: Template) -> list[str]:
    """Words without which under 80 percent of the template's shingles can be there."""
    grams = {template.words[i : i + SHINGLE] for i in range(len(template.words) - SHINGLE + 1)}
    rest, out = set(grams), []
    for word in sorted(set(template.words), key=lambda w: (-len(w), w)):
        if len(rest) < LEAST * len(grams):
            break
        out.append(word)
        rest = {g for g in rest if word not in g}
    return out


def least_words(template: Template) -> int:
    """How many of a template's distinct words any window must hold in which it is found.

    A missing word takes the shingle that begins with it (the last four words begin none,
    and some shingles may repeat).
    """
    n = len(template.words) - SHINGLE + 1
    distinct = len({template.words[i : i + SHINGLE] for i in range(n)})
    return max(1, len(set(template.words)) - int((1 - LEAST) * distinct + 1e-9) - (SHINGLE - 1) - (n - distinct))


def one_of(words: list[str]) -> str:
    """A regular expression for any of the words, which reads each common beginning once."""
    rest: dict[str, list[str]] = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    tree = "|".join(re.escape(c) + one_of(tails) for c, tails in sorted(rest.items()))
    return "" if "" in words else f"(?:{tree})"


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, n: Column) -> Column:
    """Hashes of all shingles of five words; n is their number, at least 1."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))


def band_values(grams: Column) -> Column:
    """The least value of each of BANDS hash functions over the shingles, hashed with its band."""

    def least(band: int) -> Column:
        return F.xxhash64(F.array_min(F.transform(grams, lambda g: F.xxhash64(g, F.lit(band)))), F.lit(band))

    return F.array(*map(least, range(BANDS)))


def scanned(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Licenses found in ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    templates = templates_of(texts)
    of_class = {c: [t for t in templates if t.size_class == c] for c in sorted({t.size_class for t in templates})}
    words = sorted({w for t in templates for w in anchors(t)})
    # The templates are a parameter: tables of a few rows for each, whatever the corpus.
    table = spark.createDataFrame([(t.number, t.license, list(t.words), t.size_class) for t in templates], "number int, license string, words array<string>, size_class int")
    table = table.withColumn("template", F.array_distinct(shingle_hashes(F.col("words"), F.size("words") - (SHINGLE - 1)))).drop("words")
    values = table.select("size_class", "number", F.explode(band_values(F.col("template"))).alias("value")).groupBy("size_class", "value").agg(F.collect_set("number").alias("numbers"))
    index = values.groupBy("size_class").agg(F.map_from_entries(F.collect_list(F.struct("value", "numbers"))).alias("index"))

    # Words begin after anything but a letter or digit; what passes here in vain is found out below.
    some = docs.where(F.lower("text").rlike("(?<![a-z0-9])" + one_of(words))).select(F.col("doc_id").cast("bigint").alias("doc_id"), word_list(F.col("text")).alias("words"))
    enough = some.where(F.size("words") >= SHINGLE).withColumn("n", F.size("words") - (SHINGLE - 1))

    def listed(found: set[str]) -> Column:
        return F.array(*map(F.lit, sorted(found)))

    classes = F.array(*(F.struct(F.lit(c).alias("size_class"), listed({w for t in some_ for w in anchors(t)}).alias("anchors"), listed({w for t in some_ for w in t.words}).alias("known"), F.lit(min(map(least_words, some_))).alias("least")) for c, some_ in of_class.items()))
    starts = enough.select("doc_id", "words", "n", F.inline(classes)).where(F.arrays_overlap("words", "anchors")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.col("size_class"))).alias("start"))
    held = starts.select("doc_id", "size_class", "anchors", "known", "least", "start", F.slice("words", F.col("start") + 1, 2 * F.col("size_class") + (SHINGLE - 1)).alias("held"))
    windows = held.where((F.size("held") >= SHINGLE) & F.arrays_overlap("held", "anchors")).where(F.size(F.array_intersect("held", "known")) >= F.col("least"))
    hashed = windows.select("doc_id", "size_class", "start", shingle_hashes(F.col("held"), F.size("held") - (SHINGLE - 1)).alias("grams"))
    banded = hashed.withColumn("values", band_values(F.col("grams"))).join(F.broadcast(index), "size_class")
    retrieved = F.array_distinct(F.flatten(F.transform(F.array_intersect("values", F.map_keys("index")), lambda v: F.col("index")[v])))
    found = banded.select("doc_id", "start", "grams", F.explode(retrieved).alias("number")).join(F.broadcast(table.select("number", "license", "template")), "number")
    share = F.size(F.array_intersect("template", "grams")) / F.size("template")
    verified = found.select("doc_id", "license", "number", "start", share.alias("containment")).where(F.col("containment") >= LEAST)
    return verified.groupBy("doc_id", "license", "number", "start").agg(F.max("containment").alias("containment")).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"))
