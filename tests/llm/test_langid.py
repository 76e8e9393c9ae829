import math
import pickle
import random

import numpy as np
import pyarrow as pa

from plumbline.llm import langid
from plumbline.llm.textbatch import flat

SOUNDS = {"aa": "ka lo mi nu pe".split(), "bb": "sch ung ein ver ich".split(), "cc": "eau oui tre ment é".split()}


def text(lang, n, rnd):
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def documents(seed=1, n=240):
    rnd = random.Random(seed)
    rows = [(i, text(lang := rnd.choice(sorted(SOUNDS)), rnd.randrange(3, 60), rnd), lang) for i in range(n)]
    return rows + [(1001, None, "aa"), (1002, "12 34 !", "aa"), (1003, "", None), (1004, "Ω", None), (None, text("bb", 30, rnd), None), (1005, text("cc", 20_000, rnd), "cc")]


def plain(text):
    words = bytes(langid.CODED[np.frombuffer(text.encode(), np.uint8)]).split()
    return b" " + b" ".join(words) + b" " if words else b""


def learn(texts):
    """What followed each context, over whole texts."""
    counts = {}
    for s in map(plain, texts):
        for i in range(1, len(s)):
            for n in range(min(langid.ORDER, i) + 1):
                at = counts.setdefault(s[i - n : i], {})
                at[s[i]] = at.get(s[i], 0) + 1
    return counts


def brute_bits(text, counts, least):
    """PPM with method C over dictionaries; symbols seen under ``least`` times in contexts of two
    and more bytes are left out, and their share is the escape's."""
    total, s = 0.0, plain(text)
    for i in range(1, len(s)):
        for n in range(min(langid.ORDER, i), -1, -1):
            followed = counts.get(s[i - n : i], {})
            known = {x: c for x, c in followed.items() if n < 2 or c >= least}
            if not known:
                continue
            every = sum(followed.values()) + len(followed)
            if s[i] in known:
                total -= math.log2(known[s[i]] / every)
                break
            total -= math.log2((every - sum(known.values())) / every)
        else:
            total += 8
    return total


def samples(rnd):
    return ["Zzz kalo q", "ein kalo eauz 7 é", "", "12", " x", *(text(lang, rnd.randrange(1, 12), rnd) for lang in sorted(SOUNDS) for _ in range(3))]


def test_code_lengths_against_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 7)
    rnd = random.Random(3)
    learned = {lang: [text(lang, 40, rnd) for _ in range(4)] for lang in SOUNDS}
    seen = {}
    for lang, texts in learned.items():
        batch = pa.record_batch([pa.array([lang] * len(texts)), pa.array([i % 2 == 0 for i in range(len(texts))]), pa.array(texts)], names=["lang", "even", "text"])
        for got in langid._counted(iter([batch])):
            for g, n in zip(got["gram"].to_pylist(), got["n"].to_pylist()):
                seen[lang, g] = seen.get((lang, g), 0) + n
    languages, keys = sorted(SOUNDS), list(seen)
    model = langid.Model(languages, np.array([languages.index(a) for a, _ in keys]), np.array([g for _, g in keys]), np.array([float(seen[k]) for k in keys]))
    counts = {lang: learn(texts) for lang, texts in learned.items()}
    rows = samples(rnd)
    got, size = langid.code_lengths(model, flat(pa.array(rows)))
    assert np.allclose(got, [[brute_bits(t, counts[lang], 1) for lang in languages] for t in rows], rtol=1e-4)
    assert size.tolist() == [max(0, len(plain(t)) - 1) for t in rows]


def test_trained_model_against_brute_force(spark):
    rnd = random.Random(5)
    learned = [(i, text(lang := rnd.choice(sorted(SOUNDS)), rnd.randrange(5, 60), rnd), lang) for i in range(60)]
    df = spark.createDataFrame(learned + learned[:5], "doc_id bigint, text string, lang string").repartition(3)
    model = langid.train(df, limited=False)
    counts = {lang: learn([t for _, t, x in learned if x == lang]) for lang in SOUNDS}
    rows = samples(rnd)
    got, _ = langid.code_lengths(model, flat(pa.array(rows)))
    assert np.allclose(got, [[brute_bits(t, counts[lang], 2) for lang in model.languages] for t in rows], rtol=1e-4)
    best = [int(np.argmin(x)) for x in got]
    assert langid.scores(model, flat(pa.array(rows)))[0].tolist() == [k if any(c.isalpha() for c in t) else -1 for k, t in zip(best, rows)]


def test_equal_code_lengths_take_the_first_name(spark):
    rows = [(1, "aba", "yy"), (2, "aba", "xx"), (3, "aba", None), (3, "aba", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = [r for r in langid.predicted(df, langid.train(df)).collect() if r.doc_id == 3]
    assert [r.lang_pred for r in got] == ["xx", "xx"] and all(abs(r.score - 0.5) < 1e-9 for r in got)


def test_samples_are_bounded(spark):
    rows = [(i, f"text {i}", ("aa", "bb")[i % 3 == 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    languages, found = langid._sample(df, langid.Sample(per_language=200))
    assert languages == ["aa", "bb"] and all(150 < r["count"] < 250 for r in found.groupBy("lang").count().collect())
    assert langid._sample(df, langid.Sample(per_language=200, total=100))[1].count() < 150


def test_held_out_accuracy_and_edges(spark):
    rows = documents()
    df = spark.createDataFrame([(d, t, lang, 1.0) for d, t, lang in rows], "doc_id bigint, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identified(df).collect()}
    assert len(got) == len(rows)
    tested = [(got[d].lang_pred, lang) for d, _, lang in rows[:240] if got[d].held_out]
    assert len(tested) > 20 and np.mean([a == b for a, b in tested]) > 0.97
    for d in (1001, 1002, 1003):
        assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
    assert got[1004].lang_pred in SOUNDS and got[None].lang_pred == "bb" and not got[None].held_out
    assert got[1005].lang_pred == "cc"
    stays = langid.speaking(df, langid.train(df), least=0.9)
    assert stays.columns == df.columns and {1001, 1002, 1003}.isdisjoint(r.doc_id for r in stays.collect())
    assert langid.identified(df.limit(0)).count() == 0
    nothing = df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in langid.identified(nothing).collect()} == {"und"}


def test_scores_are_probabilities():
    model = langid.Model(["x"], np.array([0]), np.array([(1 << 40) | 97]), np.array([1.0]))
    best, posterior = langid.scores(model, flat(pa.array(["a", "b", "", None, "…"])))
    assert best.tolist() == [0, 0, -1, -1, -1] and posterior.tolist() == [1.0, 1.0, 0.0, 0.0, 0.0]


def test_speaking_rejects_what_no_language_explains(spark):
    rnd = random.Random(8)
    rows = [(i, text(lang := rnd.choice(["aa", "bb"]), rnd.randrange(50, 90), rnd), lang) for i in range(200)]
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрст", "αβγδεζηθικλμνξο", "".join(map(chr, range(0x4E00, 0x5200))))
    noise = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(100)) for letters in alphabets for _ in range(5)]
    russian = "широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства " * 8
    polish = "pchnąć w tę łódź jeża lub ośm skrzyń fig zażółć gęślą jaźń książkę czytał " * 8
    unlearned = noise + [russian, polish] + [text("cc", 80, rnd) for _ in range(5)]
    more = [(500 + i, text("bb", 60, rnd), None) for i in range(50)] + [(1000 + i, t, None) for i, t in enumerate(unlearned)]
    df = spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string")
    stays = {r.doc_id for r in langid.speaking(df, langid.train(df)).collect()}
    assert max(stays) < 1000 and len([d for d in stays if d >= 500]) >= 48 and len(stays) >= 245


def test_a_language_of_long_texts_only_is_learned(spark):
    rnd = random.Random(12)
    rows = [(i, text("aa", 40, rnd), "aa") for i in range(30)] + [(100 + i, text("bb", 4000, rnd), "bb") for i in range(6)] + [(200 + i, text("bb", 30, rnd), None) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert min(len(t) for d, t, _ in rows if 100 <= d < 200) > 20_000
    assert {r.lang_pred for r in langid.identified(df).where("doc_id >= 200").collect()} == {"bb"}


def test_a_table_is_small_and_finds_what_it_holds():
    rnd = np.random.default_rng(3)
    keys = np.unique(rnd.integers(0, 1 << 42, 100_000))
    table = langid.Table(keys, rnd.random((len(keys), 4)).astype(np.float32))
    assert table.find(keys).tolist() == list(range(len(keys)))
    absent = np.setdiff1d(rnd.integers(0, 1 << 42, 50_000), keys)
    assert (table.find(absent) == -1).all() and len(table.find(keys[:0])) == 0
    assert (langid.Table(keys[:0], np.zeros((0, 4), np.float32)).find(keys) == -1).all()
    assert len(pickle.dumps(table)) < 50 * len(keys)  # each worker holds it twice while it is sent


def test_a_task_that_learns_limits_has_one_model(spark, monkeypatch):
    sent, made = [], langid._crossed
    monkeypatch.setattr(langid, "_crossed", lambda *what: sent.append(what) or made(*what))
    df = spark.createDataFrame(documents(), "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert np.isfinite(model.limits).all() and [isinstance(what[0], langid.Model) for what in sent] == [True, True]
