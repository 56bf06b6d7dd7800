import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from reelgrid.llm import byte_bpe
from reelgrid.llm.queries import op5_byte_bpe

DOCS = "doc_id long, text string, _row string"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_chunks_equal_library(spark, library):
    texts = [None, "", " ", "\n\n", "a  b", "x" * 300, ("word, it's  \n\n odd\u3000 1234 \u0378 " * 30), "é" * 500 + " ok " * 100, " " * 400, "日本語。" * 200, "ab \u0085 c" * 90, "'s't " * 120]
    rows = [(i % 10 or None, t, "clash") for i, t in enumerate(texts * 2)]
    got = sorted(tuple(r)[1:] for r in byte_bpe.digests(spark.createDataFrame(rows, DOCS), PATH, P.PATTERN, chunk=64, overlap=16).collect())
    assert got == sorted(want(library, t) for _, t, _ in rows)


def test_round_trip(spark, library):
    rows = [(1, "one two " * 100, ""), (2, "Ünï", "")]
    parts = byte_bpe.encoded(spark.createDataFrame(rows, DOCS), PATH, P.PATTERN, chunk=50, overlap=20).orderBy("doc_id", "_piece").collect()
    coder = byte_bpe.byte_pieces(PATH, P.PATTERN)
    for d, text, _ in rows:
        assert b"".join(x for r in parts if r["doc_id"] == d for x in coder.decode(bytes(r["ids"]))) == text.encode()


def test_empty(spark):
    assert byte_bpe.digests(spark.createDataFrame([], DOCS), PATH, P.PATTERN).collect() == []


def test_query_equals_library(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in op5_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {d: want(library, t) for d, t in rows}
