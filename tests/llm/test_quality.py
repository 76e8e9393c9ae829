import random
import re

import pyarrow as pa

from plumbline.llm import quality
from plumbline.llm.textbatch import flat

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rnd = random.Random(4)
    out = ["", None, " \n\t", "a b c a b c", "x\nx\nx\n\n\n", "é é é é", "one\x0btwo\x0cthree\u00a0four"]
    for _ in range(60):
        out.append("".join(rnd.choice(["a ", "b ", "c\n", "#", "é ", "  ", "long%word ", "\n"]) for _ in range(rnd.randrange(120))))
    return out


def test_measures_against_brute_force():
    rows = texts()
    got = [tuple(int(x) for x in r) for r in zip(*quality.measures(flat(pa.array(rows))))]
    assert got == [brute(t) for t in rows]


def prose(n, seed):
    rnd = random.Random(seed)
    syllables = "an the er in re on at en nd st es or te of ed is it al ar con per mul lig fro qua dis wem".split()
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5))) for _ in range(n)) + "."


def test_bands_reject_repetition_and_noise(spark):
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rnd.choice(letters) for _ in range(40)) for _ in range(200))
    rows = [(1, prose(300, 1)), (2, prose(4000, 2)), (3, prose(60, 3)), (4, "\n".join(f"row {i % 7} of the same table here" for i in range(900))), (5, noise), (6, None), (7, "a b c"), (8, prose(40_000, 4))]
    df = spark.createDataFrame([(t, d, True) for d, t in rows], "text string, doc_id bigint, kept boolean")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert {d for d, r in got.items() if r.kept} == {1, 2, 3, 8}
    assert got[6].base_failed and got[7].base_failed and not got[5].base_failed
    stays = quality.passing(df)
    assert stays.columns == df.columns and {r.doc_id for r in stays.collect()} == {1, 2, 3, 8}
    assert quality.judged(df.limit(0)).count() == 0 and quality.passing(df.limit(0)).count() == 0


def test_learned_bands_reject_what_clean_text_is_not(spark):
    """Texts of few words repeat a little more than clean text, random letters less; the base rule passes both."""
    rnd = random.Random(6)
    few = [prose(1, 900 + i).rstrip(".") for i in range(150)]
    poor = [" ".join(rnd.choice(few) for _ in range(rnd.randrange(250, 330))) for _ in range(20)]
    noise = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9))) for _ in range(300)) for _ in range(20)]
    rows = [(i, prose(rnd.randrange(250, 330), i), 1) for i in range(400)] + [(1000 + i, t, 0) for i, t in enumerate(poor + noise)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    limits = quality.learned(df.where("doc_id < 200 OR doc_id >= 1000"), df.select("doc_id", "quality"))
    got = {r.doc_id: r for r in quality.judged(df, limits).collect()}
    assert not any(got[d].base_failed for d in got)
    assert sum(got[d].kept for d in range(200, 400)) >= 194 and sum(got[d].kept for d in range(1000, 1040)) <= 2
    assert quality.learned(df.limit(0), df.select("doc_id", "quality")).chunk == quality.CHUNK_BAND


def test_short_texts_have_a_band_and_a_third_of_bad_chunks_is_too_many():
    assert not quality.in_bands(250, 0.95, [], quality.Limits())[0] and not quality.in_bands(250, 0.2, [], quality.Limits())[0]
    assert not quality.in_bands(12_000, 0.45, [0.45, 0.45, 0.9], quality.Limits())[0] and quality.in_bands(16_000, 0.45, [0.45, 0.45, 0.45, 0.9], quality.Limits())[0]
