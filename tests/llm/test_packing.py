import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.llm import packing  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(counts, capacity):
    runs, n = packing.plan(counts, capacity)
    held, seen = {}, {}
    for length, first, number, sequence, offset in runs:
        assert number > 0 and first == seen.get(length, 0)
        seen[length] = first + number
        for k in range(number):
            held.setdefault(sequence + k, []).append((offset, length))
    assert seen == {k: v for k, v in counts.items() if v}
    assert sorted(held) == list(range(n))
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in items) <= 2
    return n


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_whole_and_gapless(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 30, 100, 1024])
    counts = {}
    for _ in range(rnd.choice([0, 1, 5, 300])):
        length = rnd.randrange(1, capacity)
        counts[length] = counts.get(length, 0) + rnd.choice([1, 1, 2, 50])
    n = check_plan(counts, capacity)
    least = -(-sum(k * v for k, v in counts.items()) // capacity)
    assert n >= least
    if sum(counts.values()) > 200 and capacity >= 100:
        assert n <= 1.12 * least + 2


def test_plan_of_known_cases():
    assert check_plan({600: 2, 400: 2}, 1000) == 2
    assert check_plan({500: 5}, 1000) == 3
    assert check_plan({1: 10_000}, 1000) == 10
    assert check_plan({10**6: 3}, 10**6 + 1) == 3


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def test_query_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rnd = random.Random(1)
    texts = ["", None, "Hello  world\n\n  x ", "a<|endoftext|>b <|endoftext|>", "naïve café 日本語 \u2003 \x1c x", "it's  we'll\tgo " * 40]
    texts += [" ".join(rnd.choice(["alpha", "beta", "12345", "don't", "x\ny", "", "—"]) for _ in range(rnd.choice([1, 5, 300, 2500]))) for _ in range(60)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int").repartition(3)
    got = packing.packed(df, PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))
        if i == 3:
            assert len(pieces) == 2
            pieces = pieces[:1]
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in pieces) == len(ids)
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.1 * -(-total // 1024) + 2


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "text string, doc_id bigint"), PATH).count() == 0


def test_a_task_leaves_no_encoder_in_its_worker(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(["some words", None])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in packing._pieces(PATH, 2, 1024)(iter([batch]))) == 2
    assert packing.document_encoder.cache_info().currsize == 0
