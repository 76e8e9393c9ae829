import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from plumbline.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = bpe.encode(text, PATH)
    library = tiktoken_encoding()
    assert ids.tolist() == library.encode_ordinary(text)
    assert bpe.decode(ids, PATH) == text.encode()


_ENCODING = []


def tiktoken_encoding():
    if not _ENCODING:
        _ENCODING.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={}))
    return _ENCODING[0]


def test_white_space_and_repeats(library):
    rnd = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "a", "ab", "é", "12", "'s", "'ll", "—", "日本", "aaaaaaaa", "the", "\r\n", "😀"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert bpe.encode(text, PATH).tolist() == library.encode_ordinary(text), repr(text)
    for text in ("a" * 5000, "ab" * 3000, "é" * 2000, "x" * 47 + " y", " " * 300, "zq" * 30 + " " + "zq" * 30):
        assert bpe.encode(text, PATH).tolist() == library.encode_ordinary(text)


def test_random_bytes_as_one_match(library):
    encoder = bpe.Encoder(bpe.ranks_of(PATH))
    rnd = random.Random(3)
    for _ in range(1500):
        raw = bytes(rnd.choice(b"abcdethe \xc3\xa9\xff\x00in") for _ in range(rnd.randrange(1, 40)))
        assert encoder.encode(raw) == library._core_bpe.encode_single_piece(raw)


def test_query(spark, library):
    rows = [(1, "Grüße  aus\n Köln", "x"), (2, None, None), (2, None, None), (None, "", "y"), (3, "word " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    for r in bpe.digests(df, PATH).collect():
        text = dict((a, b or "") for a, b, _ in rows)[r.doc_id]
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encoded(df, PATH).where("doc_id = 1").first().ids == library.encode_ordinary(rows[0][1])
    assert bpe.digests(df.limit(0), PATH).count() == 0
