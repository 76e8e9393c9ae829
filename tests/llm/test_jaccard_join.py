import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import jaccard_join as jj
from plumbline.llm.textbatch import LOWER, flat


def brute(rows, size, percent):
    """(doc_id, n, component) by comparing all pairs of sets of word tuples."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def made(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(30)]
    rows = []
    for d in range(n):
        kind = rnd.random()
        if kind < 0.45 and rows:
            w = rnd.choice(rows[: 1 + len(rows) // 3])[1].split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.3:
                w = w[: len(w) - rnd.randrange(3)]
        else:
            w = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 12, 20, 60, 150]))]
            if rnd.random() < 0.3:
                w = w + passage
        text = " ".join(w)
        rows.append((d * 3 + 1, text.upper() if rnd.random() < 0.1 else text.replace(" ", "\n", 1)))
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "é" * 50_000)]


@pytest.mark.parametrize("size,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 90, 3)])
def test_against_brute_force(spark, size, percent, seed):
    rows = made(seed)
    df = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id bigint, n string")
    got = jj.jaccard_components(df, jj.Rule(size, percent)).members
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, size, percent)


@pytest.mark.parametrize("small,tile", [(1, 3), (2, 256)])
def test_large_runs_reach_the_last_step(spark, small, tile):
    rows = made(4, 220)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    got = jj.jaccard_components(df, jj.Rule(4, 85, small, tile)).members
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 4, 85)


def test_distant_copies_of_one_text(spark):
    """A run in which no centre links with all, and many documents that share a passage."""
    rnd = random.Random(11)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = []
    for d in range(150):
        w = base.copy()
        for _ in range(rnd.choice([1, 2, 3, 4])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(6)}"
        rows.append((d, " ".join(w)))
    for d in range(150, 260):
        rows.append((d, " ".join([f"u{rnd.randrange(10_000)}" for _ in range(rnd.randrange(5, 40))] + passage)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jj.jaccard_components(df, jj.Rule(4, 85, 3, 16)).members
    want = brute(rows, 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want and len({c for _, _, c in want}) > 100


def test_empty_repeated_and_null_rows(spark):
    schema = "doc_id bigint, text string, a bigint, b bigint, key string"
    assert jj.jaccard_components(spark.createDataFrame([], schema)).members.count() == 0
    rows = [(1, "a b c d e f", 1, 2, "k"), (1, "a b c d e f", 1, 2, "k"), (None, "a b c d e f", None, None, None), (None, "x y", None, None, None), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(df).members.collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (2, 0, 2)], key=str)
    assert [(r.doc_id, r.text) for r in jj.keep_one(df).orderBy("doc_id").collect()] == [(None, "x y"), (1, "a b c d e f"), (2, None)]


def test_rows_are_kept_not_ids(spark):
    t, near, other = "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten twelve", "quite another text of some words that no one has"
    rows = [(5, t), (1, t), (5, other), (5, other), (None, near), (7, "hello world"), (7, "Hello world"), (None, ""), (8, None), (8, None)]
    df = spark.createDataFrame([(x, d, "k") for d, x in rows], "text string, doc_id bigint, root string")
    for percent in (80, 60):
        stays = jj.keep_one(df, jj.Rule(5, percent))
        assert stays.columns == df.columns
        got = sorted(((r.doc_id, r.text) for r in stays.collect()), key=str)
        hellos = [x for x in got if x[0] == 7]
        assert len(hellos) == 1  # equal but for capitals
        want = [(1, t), (5, other), (None, ""), (8, None), (8, None)] + ([(None, near)] if percent == 80 else [])
        assert [x for x in got if x[0] != 7] == sorted(want, key=str)


def test_slices_of_two_words(spark):
    df = spark.createDataFrame([(1, "hello world")], "doc_id bigint, text string")
    assert [tuple(r) for r in jj.jaccard_components(df).members.collect()] == [(1, 1, 1, 1)]
    long = "word " * 300_000
    df = spark.createDataFrame([(1, long), (2, "two words"), (3, long), (4, "two words")], "doc_id bigint, text string").coalesce(1)
    assert sorted((r.doc_id, r.component_id) for r in jj.jaccard_components(df).members.collect()) == [(1, 1), (2, 2), (3, 1), (4, 2)]


def test_linked_sets_always_share_a_signature():
    rnd = np.random.default_rng(5)
    for percent in (80, 85, 95):
        bands = jj.Bands(percent)
        for n in (3, 7, 8, 13, 14, 20, 33, 60, 150, 700):
            for k2, n2 in ((0, 1), (1, 2), (1, 3), (2, 5)):
                for _ in range(25):
                    a = rnd.integers(0, 1 << 63, n).astype(np.uint64)
                    k = int(rnd.integers(0, 1 + n * (100 - percent) // 100))
                    b = a.copy()
                    swap = k // 2
                    b[:swap] = rnd.integers(0, 1 << 63, swap).astype(np.uint64)
                    b = b[k - swap :]
                    a, b = np.unique(a), np.unique(b)
                    common = len(np.intersect1d(a, b))
                    if len(b) and 100 * common >= percent * (len(a) + len(b) - common) and common < len(a):
                        assert np.isin(jj.signatures(a, bands, lambda _: (k2, n2)), jj.signatures(b, bands, lambda _: (k2, n2))).any()


def test_element_sets_are_exact():
    texts = flat(pa.array(["A b a B a b", "x", None, "one two"]))
    assert [len(x) for x in jj.element_sets(texts, 2)] == [2, 1, 0, 1]
    assert LOWER[65] == 97


def test_blocks_give_a_forest_of_all_links():
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy()
        s[rnd.integers(0, 60, rnd.integers(0, 9))] = rnd.integers(0, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(s))
    roots = np.arange(40)
    root = list(range(40))
    for i in range(40):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                root = [root[j] if r == root[i] else r for r in root]
    got = list(range(40))
    links = jj._joined_by(sets, roots, np.zeros(40, np.int64), jj.Rule(4, 85, 8, 7))
    sides = np.arange(40) % 2
    for i, j in jj._joined_by(sets, roots, sides, jj.Rule(4, 85, 8, 7)):
        assert root[i] == root[j]
    for i, j in links:
        got = [got[j] if r == got[i] else r for r in got]
    assert len(links) == 40 - len(set(root))
    assert len({(a, b) for a, b in zip(root, got)}) == len(set(root)) == len(set(got))


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_only_documents_without_a_link_are_left_out(spark, percent):
    """Documents of one passage and much text of their own go; whatever links with another stays."""
    r = random.Random(percent)
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(i, f"{passage} " + " ".join(f"w{r.randrange(10**9)}" for _ in range(180))) for i in range(40)]
    rows += [(100 + i, " ".join(f"c{k}" for k in range(i, i + 120))) for i in range(6)]
    rows += [(200, "one"), (201, "two words"), (202, f"{passage} end")]
    rule = jj.Rule(3, percent, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    packed = docs.selectExpr("doc_id", "cast(null as string) text_sha256", "text").mapInArrow(jj._fingerprints(rule.size), jj.SETS).select("doc_id", "n", "packed")
    left = {x.doc_id for x in jj._may_link(packed.select("doc_id", "packed"), packed.selectExpr("doc_id a", "n"), rule).collect()}
    root = {d: c for d, _, c in brute(rows, rule.size, percent)}
    linked = {d for d in root if list(root.values()).count(root[d]) > 1}
    assert {100 + i for i in range(6)} <= linked <= left
    assert len(left & set(range(40))) < 4
