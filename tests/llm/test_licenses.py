import random
import re

from plumbline.llm import licenses


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(text, templates):
    """License -> largest containment in any window that the operator would read."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = {}
    for t in templates:
        want = grams(t.words)
        for start in range(0, max(0, len(words) - 4), t.size_class):
            share = len(want & grams(words[start : start + 2 * t.size_class + 4])) / len(want)
            if share >= 0.8:
                out[t.license] = max(share, out.get(t.license, 0))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(1)
    filler = [f"w{i}" for i in range(500)] + ["license", "software", "licensed", "version"]
    rows = [(-1, None), (-2, ""), (-3, "MIT license"), (-4, "x " * 20_000 + "released under the mit license")]
    for d in range(150):
        words = [rnd.choice(filler) for _ in range(rnd.randrange(0, 300))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            copy = licenses.TEMPLATES[rnd.randrange(len(licenses.TEMPLATES))][1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(filler)
            at = rnd.randrange(len(words) + 1)
            words[at:at] = copy
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame([(t, d, "n") for d, t in rows] + [(dict(rows)[9], 9, "n")], "text string, doc_id bigint, license string")
    templates = licenses.templates_of(licenses.TEMPLATES)
    want = {(d, lic): round(c, 6) for d, t in rows for lic, c in brute(t, templates).items()}
    result = licenses.scanned(df)
    got = {(r.doc_id, r.license): round(r.containment, 6) for r in result.collect()}
    assert got == want and len(want) > 80
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert licenses.scanned(df.limit(0)).count() == 0


def test_anchors_cover_every_match():
    for t in licenses.templates_of(licenses.TEMPLATES):
        chosen = set(licenses.anchors(t))
        all_grams = grams(t.words)
        assert sum(chosen.isdisjoint(g) for g in all_grams) < 0.8 * len(all_grams)


def test_no_verified_window_lacks_words():
    rnd = random.Random(2)
    for t in licenses.templates_of(licenses.TEMPLATES):
        want = grams(t.words)
        for _ in range(60):
            words = list(t.words)
            for _ in range(rnd.randrange(len(words))):
                words[rnd.randrange(len(words))] = "other"
                if len(want & grams(words)) < 0.8 * len(want):
                    break
                assert len(set(words) & set(t.words)) >= licenses.least_words(t)


def test_expression_finds_just_the_words():
    words = ["license", "licensed", "general", "a.b", "x"]
    found = re.compile(licenses.one_of(words))
    for text in ("my license", "licens", "GENERAL", "genera", "a.b", "axb", "x", ""):
        assert bool(found.search(text)) == any(w in text for w in words)


def test_whole_texts_with_a_few_changes(spark):
    rows = [(i, f"Copyright 2020 someone {text} end of file") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {}
    for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[i][name] == 1.0
