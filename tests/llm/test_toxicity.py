import math
import random
import re

import numpy as np
import pyarrow as pa

from plumbline.llm import toxicity, trees
from plumbline.llm.textbatch import flat


def documents(n=500, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 5))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = rnd.random() < 0.25
        w = [rnd.choice(words) for _ in range(rnd.randrange(15, 120))]
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["badword", "nasty", "you", "vile"]))
        rows.append((i, " ".join(w).capitalize() + ".", int(toxic)))
    return rows


def test_held_out_quality_and_edges(spark):
    rows = documents()
    docs = spark.createDataFrame([(d, t, 0.5) for d, t, _ in rows] + [(9001, None, 0.0), (9002, "", 0.0), (9001, None, 0.0), (None, "badword", 0.0), (9003, "nasty badword " * 20_000, 0.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(d, y, "x") for d, _, y in rows] + [(None, 1, "x"), (3, None, "x"), (77_777, 1, "x")], "doc_id bigint, toxic int, text string")
    got = toxicity.identified(docs, labels).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    tested = [(by[d].predicted, y) for d, _, y in rows if by[d].held_out]
    assert np.mean([a == b for a, b in tested]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[9003].predicted == 1 and by[9001].predicted == 0 == by[9002].predicted
    assert toxicity.identified(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.identified(docs, labels.limit(0)).collect()} == {0.0}


def test_features_of_a_known_text():
    lexicon = np.sort(toxicity._hashes(["idiot", "fool"]))
    x = toxicity.features(flat(pa.array(["You IDIOT, fool!", "an 1d10t here", None, "no no"])), lexicon)
    assert np.allclose(x[0, [1, 7, 8, 10]], [2 / 3, 1 / 3, 2 / 3, 1 / 3])
    assert x[1, 1] == 0 and x[1, 5] > 0 and x[1, 15] > 0
    assert not x[2].any() and not x[3, 1:6].any()


def test_trees_learn_and_calibration_rises():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = trees.fit(x[:1500], y[:1500], np.ones(1500))
    raw = model.raw(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.93
    rise = trees.calibrate(raw, y[1500:], np.ones(500))(np.sort(raw))
    assert (np.diff(rise) >= 0).all() and rise.min() >= 0 and rise.max() <= 1


def test_calibration_is_isotonic_regression():
    raw = np.array([1.0, 2, 3, 4, 5, 6])
    y = np.array([0.0, 1, 0, 1, 1, 0])
    got = trees.calibrate(raw, y, np.ones(6))
    assert np.allclose(got.value, [0, 0.5, 2 / 3])


WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_PUNCT = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def plain(word, look_alike=False):
    """A word in lower case (A-Z only) without punctuation; look-alike characters as letters."""
    out = ""
    for c in word:
        if look_alike and c in "013457@$":
            out += dict(zip("013457@$", "oieastas"))[c]
        elif c not in ASCII_PUNCT:
            out += c.lower() if "A" <= c <= "Z" else c
    return out


def brute_features(text, known):
    """The features of one text by its words; ``known`` says whether a lexicon key (word, kind) is there."""
    text = text or ""
    own = WORD.findall(text)
    words = [w for w in map(plain, own) if w]
    odd = [w for w in (plain(w, True) for w in own) if w]
    # Punctuation may leave nothing of a word, but never joins two.
    hit = [(w, "whole") in known for w in words]
    begun = [len(w.encode()) > 4 and (w.encode()[:4], "start") in known for w in words]
    you = [w in toxicity.SECOND_PERSON for w in words]
    near = [any(you[max(0, i - 5) : i + 6]) for i in range(len(words))]
    raw = text.encode()
    alpha = [c for c in raw if chr(c).isascii() and chr(c).isalpha() or c >= 0x80]
    upper = [c for c in raw if 0x41 <= c <= 0x5A]
    n, size = max(1, len(words)), max(1, len(raw))
    hits, starts = sum(hit), sum(begun)
    hidden = max(0, sum((w, "whole") in known for w in odd) - hits)

    def is_letter(c):
        return c >= 0x80 or chr(c).isalpha()

    shouted = sum(1 for w in own if (k := sum(map(is_letter, w.encode()))) > 1 and k == sum(0x41 <= c <= 0x5A for c in w.encode()))
    mixed = sum(1 for w in own if any(map(is_letter, w.encode())) and any(chr(c).isdigit() or c in b"#*$%&@^~|<>_+=" for c in w.encode() if c < 0x80))
    return [
        math.log1p(len(words)), hits / n, math.log1p(hits), starts / n, math.log1p(starts), hidden / n, math.log1p(hidden), sum(you) / n,
        sum(a and (b or c) for a, b, c in zip(near, hit, begun)) / n, len(upper) / max(1, len(alpha)), shouted / n,
        sum(chr(c) in ASCII_PUNCT for c in raw if c < 0x80) / size, raw.count(b"!") / size, sum(c in b"#*$%&@^~|<>_+=" for c in raw) / size, sum(0x30 <= c <= 0x39 for c in raw) / size,
        mixed / n, len(alpha) / n,
    ]


def brute_score(model, x):
    """Trees walked node by node, then the rising line between neighbouring points."""
    raw = model.trees.start
    for feature, threshold, leaf in zip(model.trees.feature, model.trees.threshold, model.trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
        raw += leaf[node - len(feature)]
    at, value = model.calibration.at.tolist(), model.calibration.value.tolist()
    if raw <= at[0]:
        return value[0]
    for a, b, u, v in zip(at, at[1:], value, value[1:]):
        if raw <= b:
            return u + (v - u) * (raw - a) / (b - a)
    return value[-1]


def test_scores_against_brute_force(spark):
    rows = documents(300, 7)
    odd = ["", None, "!!! ... ???", "YOU N4STY, b@dword you vileness", "é É ÀB 12 a1 _x_", "nasty\nyou\tbadword " * 30, "you " + "word " * 5 + "nasty " + "word " * 6 + "vile"]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(9000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    texts = [t for _, t, _ in rows] + odd
    keys = set()
    for w in {plain(w) for t in texts for w in WORD.findall(t or "")} | {plain(w, True) for t in texts for w in WORD.findall(t or "")}:
        if not w:
            continue
        data, _, found = toxicity.normal(flat(pa.array([w])), False)
        whole, start = toxicity.entries(data, found)
        if whole[0] in model.lexicon:
            keys.add((w, "whole"))
        if start[0] in model.lexicon:
            keys.add((w.encode()[:4], "start"))
    assert len(keys) >= 3
    x = [brute_features(t, keys) for t in texts]
    assert np.allclose(toxicity.features(flat(pa.array(texts)), model.lexicon), x)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for d, f in zip([d for d, _, _ in rows] + list(range(9000, 9000 + len(odd))), x):
        assert abs(got[d] - brute_score(model, f)) < 1e-9


def test_calibration_rows_make_no_lexicon(spark):
    """A word that only calibration rows have is not learned."""
    from pyspark.sql import functions as F

    ids = spark.range(2000).select("id", (F.pmod(F.xxhash64("id", F.lit(31)), F.lit(5)) != 0).alias("fits")).collect()
    rows = [(r.id, ("fitword " if r.fits else "restword ") * (r.id % 2) + f"plain text {r.id % 7}", r.id % 2) for r in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    learned = set(model.lexicon.tolist())
    assert set(toxicity._hashes(["fitword"]).tolist()) <= learned and not set(toxicity._hashes(["restword"]).tolist()) & learned


def test_samples_are_bounded_and_repeats_learned_once(spark):
    rows = documents(400, 9)
    df = spark.createDataFrame([(d, t) for d, t, _ in rows + rows + rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id bigint, toxic int")
    one = toxicity.train(df, labels, toxicity.Sample(rounds=5))
    two = toxicity.train(df.dropDuplicates(["doc_id"]), labels, toxicity.Sample(rounds=5))
    assert (one.lexicon == two.lexicon).all() and np.allclose(one.trees.leaf, two.trees.leaf)
