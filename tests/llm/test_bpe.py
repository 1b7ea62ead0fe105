import random

import pytest
import tiktoken

from cortigraph.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_a_reference(ranks, reference):
    rng = random.Random(4)
    for _ in range(400):
        s = "".join(rng.choice("abcdeé中 ไ'.1\n") for _ in range(rng.randint(1, 40)))
        assert [i for w in __import__("regex").findall(bpe.PATTERN, s) for i in bpe.encode_piece(w.encode(), ranks)] == reference.encode_ordinary(s)


def test_very_long_pieces(ranks, reference):
    for s in ("a" * 30_000, "abcd" * 5_000, "中文" * 3_000):
        ids = bpe.encode_piece(s.encode(), ranks)
        by = {i: b for b, i in ranks.items()}
        assert bpe.decode_bytes(ids, by) == s.encode()
        assert len(s) > 20_000 or ids == reference.encode_ordinary(s)


def test_frames(spark, reference):
    rows = [(1, "Hello  world"), (2, ""), (3, None), (1, "Hello  world"), (4, "<|endoftext|> x"), (None, "a\n b")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id bigint, text string, ids string")
    out = bpe.encode(df, "doc_id", "text").collect()
    want = {(r[0], tuple(reference.encode_ordinary(r[1] or ""))) for r in rows}
    assert {(r["doc_id"], tuple(r["ids"])) for r in out} == want and len(out) == 6
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
