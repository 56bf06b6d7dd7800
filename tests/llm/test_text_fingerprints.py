"""Weighted SimHash, its permuted block tables, and neighbours by doc_id."""

import hashlib
import re

import pytest
import xxhash

from reelgrid.llm import text_fingerprints as T

DOCS = "doc_id long, text string"


def word_pair_fingerprint(text: str) -> int:
    """Plain voting, one occurrence at a time."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    sums = [0] * 64
    for a, b in zip(words, [*words[1:], ""]):
        # Spark hashes several columns in a chain: each one's hash is the next one's seed.
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        for i in range(64):
            sums[i] += (len(a) + len(b)) * (1 if h >> i & 1 else -1)
    return sum(1 << i for i in range(64) if sums[i] > 0)


def brute(rows: list[tuple]) -> dict:
    rows = sorted(rows)
    texts = [t or "" for _, t in rows]
    fps = [word_pair_fingerprint(t) for t in texts]
    out = {}
    for i, (k, _) in enumerate(rows):
        j = (i + 1) % len(rows)
        q = len(texts[i]) // 4
        new = texts[i][: len(texts[i]) - q] + texts[j][:q]
        e = word_pair_fingerprint(new)
        near = lambda x, y: 1 - (x ^ y).bit_count() / 64
        n = sum((fps[i] ^ f).bit_count() <= 3 for f in fps) - 1 if k % 20 == 0 else None
        out[k] = (len(texts[i]), hashlib.sha256(new.encode()).hexdigest(), f"{fps[i]:016x}", f"{e:016x}", near(fps[i], e), near(fps[i], fps[j]), n)
    return out


def told(df) -> dict:
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert told(T.likenesses(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_slices_of_every_size(spark):
    rows = [(i * 7 % 101, f"word{i} " * (i % 9) + "ünï 😀" * (i % 3)) for i in range(101)]
    docs = spark.createDataFrame(rows, DOCS)
    for parts in (1, 2, 7, 64):
        got = {r["doc_id"]: r["_following"] for r in T.with_next(docs, parts).collect()}
        by = dict(rows)
        assert got == {k: by[(k + 1) % 101] for k in by}


def test_null_empty_repeated_and_clashing(spark):
    rows = [(None, "alone", 1), (1, None, 2), (2, "", 3), (3, "a b", 4), (3, "a b", 5), (40, " \t\n", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumnRenamed("fp", "_row")
    out = T.likenesses(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) if r["doc_id"] else (False, 0) for r in out) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 3), (True, 40)]
    zero = [r for r in out if r["doc_id"] in (1, 2, 40)]
    assert {r["fingerprint"] for r in zero} == {"0" * 16} and [r["n_within"] for r in out if r["doc_id"] == 40] == [2]
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 3}) == 1
    assert T.likenesses(spark.createDataFrame([], DOCS)).collect() == []
    one = T.likenesses(spark.createDataFrame([(5, "one two three four")], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_very_long_text(spark):
    text = "lorem ipsum dolor " * 60_000
    out = told(T.likenesses(spark.createDataFrame([(1, text), (2, text + "x")], DOCS)))
    assert out[1][2] == f"{word_pair_fingerprint(text):016x}" and out[1][0] == len(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_block_tables_find_all_within_radius(spark, radius):
    import random

    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(radius + 3))) for b in base for _ in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(f), 1) for f in fps], "fp long, n long")
    asked = table.limit(40)
    got = [(x["fp"] % 2**64, x["near"] % 2**64) for x in T.within(asked, table, radius).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a["fp"] % 2**64, b) for a in asked.collect() for b in fps if ((a["fp"] % 2**64) ^ b).bit_count() <= radius}
