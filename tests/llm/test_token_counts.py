import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.llm import token_counts  # noqa: E402


def test_limits_against_brute_force(spark):
    rnd = random.Random(1)
    lengths = [rnd.choice([0, 1, 5, 1023, 1024, 1025, 5000, rnd.randrange(9000)]) for _ in range(400)]
    counts = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "length bigint, n_docs bigint")
    got = token_counts.at_limits(counts).collect()
    assert len(got) == len(set(lengths))
    for r in got:
        n = r.length
        assert r.docs_within == sum(x <= n for x in lengths) and r.docs_over == sum(x > n for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.total_tokens == sum(lengths) and abs(r.quantile - r.docs_within / len(lengths)) < 1e-12


def test_query(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "Hello  world", "Hello  world", "a\nb " * 900]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, length int")
    want = {}
    for t in texts:
        n = len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids)
        want[n] = want.get(n, 0) + 1
    assert {r.length: r.n_docs for r in token_counts.histogram(df, path).collect()} == want
    assert token_counts.at_limits(token_counts.histogram(df.limit(0), path)).count() == 0


def test_any_limit_is_answered(spark):
    lengths = [0, 3, 3, 700, 1500, 1500, 9000]
    counts = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "length bigint, n_docs bigint")
    got = {r.length: r for r in token_counts.for_limits(counts, [2048, 1024, 3, 1, 1024, 99_999]).collect()}
    assert sorted(got) == [1, 3, 1024, 2048, 99_999]
    for n, r in got.items():
        assert (r.n_docs, r.docs_within, r.docs_over) == (lengths.count(n), sum(x <= n for x in lengths), sum(x > n for x in lengths))
        assert (r.tokens_within, r.truncated_tokens, r.total_tokens) == (sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths), sum(lengths))
        assert abs(r.quantile - r.docs_within / len(lengths)) < 1e-12
    same = {tuple(r) for r in token_counts.at_limits(counts).collect()}
    assert {tuple(r) for r in token_counts.for_limits(counts, lengths).collect()} == same
    assert token_counts.for_limits(counts.limit(0), [1024]).count() == 0
