import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import jaccard_join, quality, textbatch
from plumbline.llm.textbatch import flat, range_hash, shingles, slices, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def thue_morse(n, first="A", second="B"):
    return "".join((first, second)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", range(1, 7))
@pytest.mark.parametrize("n", range(8))
def test_shingles_of_few_words(size, n):
    for texts in ([" ".join("abcdefg"[:n])], [" ".join("abcdefg"[:n]), "", None], ["x", " ".join("abcdefg"[:n])]):
        t = flat(pa.array(texts, pa.string()))
        w = words(t)
        _, whole = shingles(w, size)
        assert whole.sum() == sum(max(0, len((x or "").split()) - size + 1) for x in texts)
        assert [len(x) for x in jaccard_join.element_sets(t, size)] == [max(1, k - size + 1) if (k := len((x or "").split())) else 0 for x in texts]


def test_short_texts_between_long_ones():
    long = "many words here " * 100_000
    batch = pa.record_batch([pa.array([long, "two words", long, "one", None, ""])], names=["text"])
    got = [len(x) for _, t in slices(iter([batch])) for x in jaccard_join.element_sets(t, 5)]
    assert got == [3, 1, 3, 1, 0, 0]


def test_words_and_hashes_against_a_dictionary():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "b", "é", " ", "\n", "\x00", "longer", "y" * rnd.randrange(60, 70)]) for _ in range(rnd.randrange(60))) for _ in range(200)]
    t = flat(pa.array(texts))
    w = words(t)
    found = [t.data[s:e].tobytes() for s, e in zip(w.start, w.end)]
    assert found == [x for text in texts for x in WORD.findall(text.encode())]
    hash_of = {}
    for word, h in zip(found, w.hash.tolist()):
        assert hash_of.setdefault(word, h) == h
    assert len(set(hash_of.values())) == len(hash_of)


def test_no_family_of_words_meets_by_construction():
    pair = [thue_morse(2048), thue_morse(2048, "B", "A")]
    short = [thue_morse(n, *x) for n in (8, 16, 32, 64) for x in ("AB", "BA")] + ["", "\x00", "\x00\x00", "a", "a\x00"]
    data = np.frombuffer("".join(pair + short).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in pair + short])
    starts = np.concatenate([[0], ends[:-1]])
    assert len(set(range_hash(data, starts, ends).tolist())) == len(starts)
    a, b = pair
    t = flat(pa.array([f"{a} x y {b} x y", f"{a} x y {a} x y"]))
    assert quality.measures(t)[4].tolist() == [0, 6]
    one, two = jaccard_join.element_sets(flat(pa.array([f"p q {a} r", f"p q {b} r"])), 4)
    assert len(one) == len(two) == 1 and one[0] != two[0]


def test_the_last_word_ends_with_the_buffer():
    assert range_hash(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([2, 2])).shape == (2,)
    assert textbatch.range_hash(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0,)
