import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from plumbline.llm import langid, quality  # noqa: E402

LANGUAGES = {"xx": "the and ing tion for with ed er ly un pre dis con per ver".split(), "yy": "sch ung der ein ich keit über für lich zu ge be ent aus auf".split()}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(LANGUAGES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def documents():
    rnd = random.Random(9)
    rows = [(i, prose(rnd, lang, rnd.randrange(80, 300)), lang) for i in range(90) for lang in [rnd.choice(["xx", "yy"])]]
    for i in range(90, 140):
        d, text, lang = rnd.choice(rows[:40])
        words = text.split()
        for _ in range(rnd.choice([0, 0, 1, 3])):
            words[rnd.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), lang))
    rows += [(200, None, None), (201, "too short", "xx"), (202, "same line again\n" * 200, "xx"), (203, "12 34 56 " * 60, None)]
    rnd.shuffle(rows)
    return rows


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "sf"))
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    text_of = {d: t for d, t, _ in rows}

    judged = {r.doc_id for r in quality.judged(df).collect() if r.kept}
    assert set(kept["quality_rules"]) == judged and {200, 201, 202, 203}.isdisjoint(judged) and len(judged) > 120
    assert set(kept["language_id"]) == judged  # all of it is clean prose
    last = {}
    for d in kept["language_id"]:
        last[text_of[d]] = max(d, last.get(text_of[d], -1))
    assert set(kept["exact_dedup"]) == set(last.values())
    ids = sorted(last.values())
    sets = {d: shingles(text_of[d].lower()) for d in ids}
    root = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert set(kept["jaccard_join"]) == {d for d in ids if root[d] == d} and len(set(root.values())) < len(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / "sf")).collect()
    assert {r.doc_id for r in packed} == set(kept["jaccard_join"])
    whole = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_empty_documents(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() == 0
    assert langid.identified(df).count() == 0
