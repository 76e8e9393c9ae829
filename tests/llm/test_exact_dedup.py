import hashlib
import random

from pyspark.sql import functions as F

from plumbline.llm import exact_dedup


def rows():
    rnd = random.Random(1)
    long = ["".join(rnd.choice(["word. ", "x\n", "more ", "é! "]) for _ in range(4000)) for _ in range(4)]
    texts = ["", None, "a", "A", "a ", "same", "x" * 30_000, "x" * 30_001, "x" * 20_000 + "y" + "x" * 9_999, *long, long[0] + "!", long[1][:-1] + "?"]
    out = [(i, rnd.choice(texts)) for i in range(200)]
    return out + [(7, out[7][1]), (None, "only null id"), (None, "a"), (500, "a")]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(t, 1, d) for d, t in data], "text string, size int, doc_id bigint")
    groups = {}
    for d, t in data:
        groups.setdefault(t or "", []).append(d)
    want = []
    for d, t in data:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.equal_texts(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    stays = exact_dedup.keep_last(df)
    assert stays.columns == df.columns
    assert {r.text or "" for r in stays.collect()} == set(groups)
    assert exact_dedup.equal_texts(df.limit(0)).count() == 0


def test_chunks_rebuild_the_text(spark):
    df = spark.createDataFrame([(t or "",) for _, t in rows()], "text string")
    c = exact_dedup.chunks(F.col("text"))
    assert df.where(F.concat_ws("", c) != F.col("text")).count() == 0
    assert df.select(F.max(F.array_max(F.transform(c, F.length)))).first()[0] <= exact_dedup.CHUNK_MOST


def test_ambiguous_identifiers_give_way(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "IDENTIFIERS", (lambda c: F.length(c).cast("bigint"), *exact_dedup.IDENTIFIERS[1:]))
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.equal_texts(df).collect()) == [(1, 3), (2, 2), (3, 3)]


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "aa")], "doc_id bigint, text string")
    plan = exact_dedup.equal_texts(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def kept_by_hand(data):
    """One (doc_id, text) of each text: the largest doc_id, null only if there is no other."""
    best = {}
    for d, t in data:
        t = t or ""
        best[t] = max(best.get(t, -1), -1 if d is None else d)
    return [((None if d == -1 else d), t) for t, d in best.items()]


def test_rows_are_kept_not_ids(spark):
    data = [(1, "a b"), (1, "only here"), (2, "a b"), (None, "a b"), (None, "lonely"), (None, "lonely"), (3, "twin"), (3, "twin"), (3, None), (4, ""), (4, ""), (4, "a b c")]
    df = spark.createDataFrame([(t, d, i, "h") for i, (d, t) in enumerate(data)], "text string, doc_id bigint, id int, hash string")
    stays = exact_dedup.keep_last(df)
    assert stays.columns == df.columns and stays.schema == df.schema
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.text or "") for r in stays.collect()), key=key) == sorted(kept_by_hand(data), key=key)
    rnd = random.Random(3)
    many = [(rnd.choice([None, *range(8)]), rnd.choice(["", None, "a", "b", "c" * 3000, "d"])) for _ in range(300)]
    df = spark.createDataFrame([(d, t, None) for d, t in many], "doc_id bigint, text string, row string")
    assert sorted(((r.doc_id, r.text or "") for r in exact_dedup.keep_last(df).collect()), key=key) == sorted(kept_by_hand(many), key=key)
    assert exact_dedup.keep_last(df.limit(0)).count() == 0


def test_large_groups_are_not_joined_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    data = [(i, "same" if i % 3 else f"text {i // 2}") for i in range(90)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.equal_texts(df).collect()}
    groups = {}
    for d, t in data:
        groups.setdefault(t, []).append(d)
    assert got == {d: (max(groups[t]), len(groups[t])) for d, t in data}
