"""The pipeline's near-duplicate stage against brute force over all pairs."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from reelgrid.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string"


def shingles(text, k=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_kept(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, None) for d, t in rows], DOCS)
    return sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect())


def edited(n, *places):
    words = [f"w{i}" for i in range(n)]
    for p in places:
        words[p] = f"x{p}"
    return " ".join(words)


def test_near_stage_takes_similarity_of_shingles(spark):
    """Copies far apart in fingerprint bits go; a chain is one component; 0.8 itself is near."""
    rows = [(1, edited(100)), (2, edited(100, 50)), (3, edited(100, 50, 60)), (4, edited(100, 50, 60, 70)), (5, "other " * 40), (6, None), (7, ""), (8, "A b c"), (9, "a B c"), (10, "a b d")]
    rows += [(20, " ".join(f"v{i}" for i in range(13))), (21, " ".join(f"v{i}" for i in range(12)) + " z"), (22, " ".join(f"u{i}" for i in range(13))), (23, " ".join(f"u{i}" for i in range(15)))]
    assert kept(spark, rows) == brute_kept(rows)
    assert not {2, 3, 4, 7, 9} & set(kept(spark, rows))


def test_near_stage_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows) == brute_kept(rows)


def test_near_stage_of_nothing(spark):
    assert kept(spark, []) == []


def test_near_stage_in_rounds_and_hot_buckets(spark, monkeypatch):
    """Rounds go on as if every group were dense, and every token is dealt to several buckets: the same rows stay."""
    monkeypatch.setattr(near_copies, "PAIRS", 0)
    monkeypatch.setattr(near_copies, "PAIRS_EACH", 0)
    monkeypatch.setattr(near_copies, "MEMBERS", 2)
    monkeypatch.setattr(near_copies, "_hot", lambda counts: 2)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(12):
            words = list(base)
            for p in rng.choice(120, rng.integers(0, 5), replace=False):
                words[p] = f"n{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(f"g0w{j}" for j in range(30)) + " " + " ".join(f"o{i}x{j}" for j in range(60))) for i in range(8)]
    assert kept(spark, rows) == brute_kept(rows)


def test_rows_stay_by_row(spark):
    """Ids may repeat and be null; a text that nothing is like stays, whatever its id; user columns are kept."""
    t, u = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, t, "a"), (5, t, "b"), (5, "a text of its own which nothing else is like", "c"), (7, u, "d"), (7, u, "e"), (None, t, "f"), (None, "alone", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    for keep in (near_copies.near_kept, simhash.near_kept):
        got = keep(docs)
        assert got.columns == docs.columns
        got = sorted((r["doc_id"] or 0, r["_key"]) for r in got.collect())
        assert got in ([(0, "g"), (1, "a"), (5, "c"), (7, "d")], [(0, "g"), (1, "a"), (5, "c"), (7, "e")])


def test_ids_may_be_texts(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "other")], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in near_copies.near_kept(docs).collect()) == ["a", "c"]


def test_sketches_never_differ_more_than_sets(spark):
    """Bits differ in at most as many places as sets in hashes, of other sizes too; sets too large have no sketch."""
    rng = np.random.default_rng(3)
    rows = []
    for n in [0, 1, 30, 33, 255, 257, 600, 1000, 2049, 4096]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype("<u8"))
        b = np.unique(np.concatenate([a[n // 8 :], rng.integers(0, 1 << 63, n // 50).astype("<u8")]))
        x, y = near_copies.sketches(np.concatenate([a, b]), np.array([len(a), len(b)])).to_pylist()
        rows.append((x, y, len(np.setxor1d(a, b))))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, d int")
    got = [tuple(r) for r in got.select(near_copies.differing(F.col("a"), F.col("b")), near_copies.differing(F.col("b"), F.col("a")), "d").collect()]
    assert all(x == y <= d and (d - x) % 2 == 0 for x, y, d in got) and any(x for x, _, _ in got)
    assert any(len(a) != len(b) for a, b, _ in rows)
    large = np.arange(near_copies.SKETCHED + 1, dtype="<u8")
    assert near_copies.sketches(np.append(large, large[:2]), np.array([len(large), 2])).to_pylist()[0] is None


def test_a_dense_group_is_linked_by_few_comparisons(spark, monkeypatch):
    """Sets that step 3 alone brings together: links are about as many as sets, not as pairs of sets; the same rows stay."""
    found, verified = [], near_copies.verified

    def counted(pairs, *a):
        out = verified(pairs, *a)
        found.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "verified", counted)
    monkeypatch.setattr(near_copies, "fullest", lambda rows: rows.where("false").select(F.col("id").alias("fp"), F.col("head").alias("to")))
    monkeypatch.setattr(near_copies, "AT_LAST", 0, raising=False)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        words = [f"w{j}" for j in range(150)]
        for p in rng.choice(150, 2, replace=False):
            words[p] = f"n{i}x{p}"
        rows.append((i, " ".join(words)))
    rows += [(60 + i, " ".join(f"w{j}" for j in range(60)) + " " + " ".join(f"o{i}x{j}" for j in range(40))) for i in range(5)]
    assert kept(spark, rows) == brute_kept(rows)
    assert sum(found) <= 4 * len(rows)


def test_rounds_end_when_they_bring_nothing_together(spark, monkeypatch):
    """Sets of the same few passages share early tokens but are not near: one round shows that, others would only repeat it."""
    calls, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda *a: calls.append(1) or verified(*a))
    monkeypatch.setattr(near_copies, "PAIRS", 0)
    monkeypatch.setattr(near_copies, "PAIRS_EACH", 0)
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"p{b}w{j}" for b in rng.choice(12, 5, replace=False) for j in range(20))) for i in range(40)]
    rows += [(40, edited(100)), (41, edited(100, 50)), (42, edited(100, 50, 60))]
    assert kept(spark, rows) == brute_kept(rows)
    assert len(calls) <= 3


def test_rounds_leave_sparse_groups_out(spark, monkeypatch):
    """Rounds move the rows of dense groups only; all rows meet the largest component of their tokens once, for the last step."""
    joined, stored = [], near_copies.stored

    def counted(df, *a):
        out = stored(df, *a)
        if {"token", "id", "root"} <= set(df.columns) and {"head", "major"} & set(df.columns):
            joined.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "stored", counted)
    monkeypatch.setattr(near_copies, "PAIRS", 0)
    monkeypatch.setattr(near_copies, "PAIRS_EACH", 1)
    monkeypatch.setattr(near_copies, "fullest", lambda rows: rows.where("id <> head").groupBy("id").agg(F.min("head").alias("to")).select(F.col("id").alias("fp"), "to"))
    rng = np.random.default_rng(13)
    rows = []
    for i in range(40):  # one dense group: members share tokens, few are near each other
        words = [f"w{j}" for j in range(150)]
        for p in rng.choice(150, 5, replace=False):
            words[p] = f"n{i}x{p}"
        rows.append((i, " ".join(words)))
    for g in range(150):  # many groups of two that share some early words and are not near
        rows += [(1000 + 2 * g + i, " ".join(f"g{g}w{j}" for j in range(40)) + " " + " ".join(f"o{g}x{i}x{j}" for j in range(20))) for i in range(2)]
    assert kept(spark, rows) == brute_kept(rows)
    assert len(joined) > 1 and max(joined[:-1]) < joined[-1]
