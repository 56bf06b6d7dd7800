"""The stages against brute force, each on its own input."""

import re

import numpy as np
import pytest
import zlib
from collections import Counter

import corpus_pipeline
from reelgrid.llm import pitman_yor
from reelgrid.llm.common import TEXT_BATCH, small_batches
from reelgrid.llm.queries import op1_pitman_yor

from .test_near_copies import brute_kept
from .test_packing import well_packed


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_columns(stages):
    assert all(set(x.columns) == set(stages[0].columns) for x in stages[:-1])


def test_language_keeps_clean_documents(stages):
    assert stages[1].count() >= 0.99 * stages[0].count()


def test_exact_and_near(stages):
    rows = [tuple(r) for r in stages[1].select("doc_id", "text").collect()]
    best = {}
    for d, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (0, d)), (-len(t or ""), d))
    assert sorted(r[0] for r in stages[2].select("doc_id").collect()) == sorted(d for _, d in best.values())
    # The stage takes five words and a similarity of 0.8; the three bits and words bind the query op10 alone.
    rows = [tuple(r) for r in stages[2].select("doc_id", "text").collect()]
    assert sorted(r[0] for r in stages[3].select("doc_id").collect()) == brute_kept(rows)


def test_packed(stages):
    got = stages[4].collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in stages[3].select("doc_id").collect()}
    assert well_packed(got, 4096) == -(-sum(r["length"] for r in got) // 4096)


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[4].count()


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def check_counts(rows, got):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows if i is not None}
    seen = Counter(w for i, t in rows if not held.get(i, False) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        want[(i, held.get(i, False), len(w), sum(seen[x] > 0 for x in w), n, round(float(sum(np.log10((seen[x] + 1) / (n + v + 1)) for x in w)), 6))] += 1
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)


def test_language_model(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op1_pitman_yor(spark, sf).collect()
    check_counts(rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in got)


def test_language_model_edges(spark):
    texts = [None, "", " \n", "a b a b", "A B", "the the the", "x" * 5000, *["the cat sat on the mat"] * 40, "dog cat"]
    docs = spark.createDataFrame([(i % 30 or None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, cell string")
    got = pitman_yor.text_scores(docs).collect()
    check_counts([tuple(r)[:2] for r in docs.collect()], got)
    assert pitman_yor.text_scores(docs.limit(0)).collect() == []
    nothing = pitman_yor.text_scores(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert nothing and all(r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in nothing)


def test_stirling_numbers():
    """Stirling numbers of many customers against their recurrence."""
    for d in (0.4, 0.8):
        want = pitman_yor.log_stirling(d, 300)[300, 1:301]
        got = pitman_yor.ManyCustomers(d, np.full(300, 300))(np.arange(1, 301))
        assert np.abs(got - want)[:290].max() < 0.1


@pytest.mark.parametrize("exact", [128, 1])
def test_tables_follow_their_conditional(exact, monkeypatch):
    """Drawn numbers of tables, from all numbers or by steps, against the conditional."""
    d, c, weight, n = 0.8, 120, -1.5, 20_000
    table = pitman_yor.log_stirling(d, 128)
    monkeypatch.setattr(pitman_yor, "EXACT", exact)
    t = pitman_yor.drawn_tables(np.full(n, c), np.full(n, weight), d, np.random.default_rng(0))
    p = np.exp(table[c, 1 : c + 1] + np.arange(1, c + 1) * weight - (table[c, 1 : c + 1] + np.arange(1, c + 1) * weight).max())
    p /= p.sum()
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - p).max() < 0.015
    assert abs(t.mean() - p @ np.arange(1, c + 1)) < 0.1


def test_sweeps_find_the_joint_distribution():
    """Two dishes of one restaurant, by the auxiliary variable, against all seatings counted one by one."""
    d, s, p, c = 0.5, 1.0, np.array([0.3, 0.1]), np.array([3, 4])
    table = pitman_yor.log_stirling(d, 128)
    want = np.zeros((4, 5))
    for a in range(1, 4):
        for b in range(1, 5):
            want[a, b] = np.exp(table[3, a] + table[4, b]) * np.prod(s + d * np.arange(a + b)) * p[0] ** a * p[1] ** b
    want /= want.sum()
    rng, n = np.random.default_rng(3), 40_000
    tables = np.ones((n, 2), np.int64)
    for _ in range(12):
        x = rng.gamma(s / d + tables.sum(axis=1))
        tables = pitman_yor.drawn_tables(np.tile(c, n), np.log(d * np.outer(x, p)).ravel(), d, rng).reshape(n, 2)
    got = np.zeros((4, 5))
    np.add.at(got, (tables[:, 0], tables[:, 1]), 1 / n)
    assert np.abs(got - want).max() < 0.012


@pytest.mark.parametrize("grid", [(1, 1), (4, 4)])
def test_predictions_sum_to_one(spark, grid):
    """However many cells and owners there are, the probabilities after each context are one in all.

    With g = P(end | word), score(s t) / score(s) is P(t | s) g(t) / g(s) =: B(s, t). That the probabilities
    after s sum to one means 1 / g = B (1 / g) + 1. Solved for g, those after the start must sum to one too.
    """
    rng = np.random.default_rng(1)
    vocabulary, unknown = [f"w{i}" for i in range(12)], [f"unknown{i}" for i in range(12)]
    train = [(f"t{i}", " ".join(rng.choice(vocabulary, 30, p=np.arange(1, 13) / 78)), True) for i in range(200)]
    words = [*vocabulary, unknown[0]]
    asked = ["", *vocabulary, *unknown, *(f"{s} {t}" for s in words for t in words)]
    rows = spark.createDataFrame(train + [(t, t, False) for t in asked], "_row string, text string, _train boolean")
    got = {r["_row"]: r["score"] for r in pitman_yor.model_scores(rows, pitman_yor.Prior(), grid).collect()}
    assert np.ptp([got[u] for u in unknown]) < 1e-9  # alike, whichever owner they have
    one = np.array([10 ** got[s] for s in words])
    b = np.array([[10 ** got[f"{s} {t}"] for t in words] for s in words]) / one[:, None]
    ends = 1 / np.linalg.solve(np.eye(len(words)) - b, np.ones(len(words)))
    assert (ends > 0).all() and (ends < 1).all()
    assert abs((one / ends).sum() + 10 ** got[""] - 1) < 1e-6


def test_perplexity(spark):
    scores = spark.createDataFrame([(True, -4.0, 2), (True, -2.0, 4), (False, -1.0, 1)], "held_out boolean, score double, n_tokens long")
    assert {r["held_out"]: round(r["perplexity"], 9) for r in pitman_yor.perplexity(scores).collect()} == {True: 10.0, False: 10.0}


def test_language_keeps_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id AS _lid")
    got = corpus_pipeline.language(spark, docs, sf)
    assert got.columns == docs.columns and got.where("NOT _lid <=> doc_id").isEmpty()


def test_batches_of_texts_are_small_unless_the_session_says(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "33554432")
        small_batches(spark)
        assert spark.conf.get(name).startswith("33554432")
        spark.conf.unset(name)
        small_batches(spark)
        assert spark.conf.get(name).startswith(str(TEXT_BATCH))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
