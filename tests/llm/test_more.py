"""Language ID, vector search, URL rules, line dedup, revisits and exact dedup: edge cases and brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from reelgrid.llm import exact_dedup, language_id, line_dedup, revisit, url_filter, vector_search
from reelgrid.llm.queries import op6_language_id, op7_vector_search, op8_url_filter

DOCS = "doc_id long, text string, lang string, _row string"
TEXTS = [None, "", " ", "\n\n", "a\nb\nc", "x\na\nb\nc\ny", "a b", "ab", "A b", "z" * 30_000, ("line one\n" * 9).strip(), "e\u0301 日本", "日本 e\u0301"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[4], rows[4], (None, "a b", "en", None)], DOCS)


def test_exact_dedup(odd):
    rows = odd.select("doc_id", "text").collect()
    normal = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    got = exact_dedup.exact_duplicates(odd).collect()
    sizes = Counter(normal)
    assert sorted(r["group_size"] for r in got) == sorted(sizes[n] for n in normal)
    assert sum(r["kept"] for r in got) == len(sizes) == exact_dedup.exact_kept(odd).count()
    for r in got:
        if r["doc_id"] == 7:
            assert r["keep_id"] == 6
    assert set(exact_dedup.exact_kept(odd).columns) == set(odd.columns)
    assert exact_dedup.exact_duplicates(odd.limit(0)).collect() == []


def test_chunks_of_every_script(spark):
    """Texts are cut by their content, whatever the script: after an inserted character most chunks recur."""
    rng = np.random.default_rng(0)
    for first, last in ((0x61, 0x7B), (0x400, 0x450), (0x3B1, 0x3C9), (0x627, 0x64A), (0x4E00, 0x9000), (0x1F300, 0x1F500)):
        text = "".join(map(chr, rng.integers(first, last, 20_000)))
        a, b = (spark.createDataFrame([(t,)], "text string").select(exact_dedup.chunks(exact_dedup.F.col("text"))).first()[0] for t in (text, chr(first) + text))
        assert "".join(a).encode("latin-1").decode() == text and len(a) > 10
        assert len(set(a) & set(b)) > len(a) / 2


def brute_lines(rows, n, words):
    """rows in order of doc_id: the lines of each that later copies hold, all pairs of suffixes compared."""
    places, gone = [(d, i) for d, text in enumerate(rows) for i in range(len(text))], [set() for _ in rows]
    for at, (d, i) in enumerate(places):
        longest = 0
        for e, j in places[:at]:
            k = 0
            while i + k < len(rows[d]) and j + k < len(rows[e]) and rows[d][i + k] == rows[e][j + k]:
                k += 1
            longest = max(longest, k)
        if longest and (longest >= n or sum(len(x.split()) for x in rows[d][i : i + longest]) >= words):
            gone[d].update(range(i, i + longest))
    return gone


@pytest.mark.parametrize("n,words", [(1, 20), (2, 20), (3, 3), (3, 4), (5, 20), (5, 4)])
def test_line_dedup(spark, n, words):
    rng = np.random.default_rng(n)
    texts = ["\n".join(rng.choice(["a", "b", "c c", "d"], rng.integers(1, 14))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], DOCS)
    gone = brute_lines([t.split("\n") for t in texts], n, words)
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in line_dedup.deduplicated(docs, n, words).collect()}
    assert got == {d: (len(g), "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in g)) for d, g in enumerate(gone)}


def test_maximal_runs(spark):
    """Runs of 1 to 50 lines, planted between lines that occur once."""
    fresh = (f"line {i}" for i in itertools.count())
    runs = {k: [next(fresh) for _ in range(k)] for k in (1, 2, 3, 4, 7, 16, 31, 50)}
    texts = [[next(fresh), *r, next(fresh)] for r in runs.values()] + [[next(fresh), *r, next(fresh), *r[:2]] for r in runs.values()]
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("struct(0L as file, doc_id as at) as _row", "*")
    got = sorted((r["_row"]["at"], r["_start"], r["_end"]) for r in line_dedup.repeated_runs(docs).collect())
    assert got == [(len(runs) + i, 1, 1 + k) for i, k in enumerate(runs) if k >= 3]


def test_line_dedup_edges(spark, odd):
    got = line_dedup.deduplicated(odd).collect()
    assert len(got) == odd.count() and {r["text"] for r in got if r["doc_id"] == 0} == {None}
    assert {r["n_lines"] for r in got if r["doc_id"] == 0} == {0}
    assert {r["_row"] for r in got} == {"clash", None}
    assert set(line_dedup.deduplicated(odd.withColumnRenamed("_row", "_gone")).columns) == {"doc_id", "text", "lang", "_gone", "n_lines", "n_deleted"}
    with pytest.raises(ValueError):
        line_dedup.deduplicated(odd.withColumnRenamed("_row", "n_lines"))
    assert line_dedup.deduplicated(odd.limit(0)).collect() == []
    long = "\n".join(f"line {i}" for i in range(30_000))
    got = line_dedup.deduplicated(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_deleted"]) for r in got} == {1: (30_000, 0), 2: (30_000, 30_000)}


def test_language_edges(odd):
    got = language_id.languages(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (0, 1, 2, 3):
            assert r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]
        assert 0 <= r["score"] <= 1
    assert language_id.languages(odd.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language_id.languages(odd.withColumn("lang", language_id.F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy(spark, sf):
    rows = op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.02


def test_foreign_script_is_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs)
    greek = spark.createDataFrame([(-1, "Αυτό είναι ένα κείμενο σε άλλη γλώσσα και άλλη γραφή. " * 5, None, None)], DOCS)
    assert language_id.predicted(greek, model).first()["_lid"]["rejected"]


def brute_nearest(rows, every, k):
    out = []
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n, (q, a) in enumerate(fine):
        if q % every:
            continue
        near = sorted((-(a @ v) / np.sqrt((a @ a) * (v @ v)), i) for m, (i, v) in enumerate(fine) if m != n and len(v) == len(a))
        out += [(q, r + 1, i, pytest.approx(-s, abs=1e-12)) for r, (s, i) in enumerate(near[:k])]
    return sorted(out, key=lambda x: (x[0], x[1], x[2]))


def test_vectors_equal_brute_force(spark, sf):
    schema = "vec_id long, embedding array<float>, v string"
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], "c") for i in range(120)]
    rows += [(200, None, "c"), (201, [0.0] * 8, "c"), (202, [1.0, None] * 4, "c"), (203, [float("nan")] * 8, "c"), (204, [float("inf")] * 8, "c"), (None, [1.0] * 8, "c"), (205, [1.0, 2.0], "c"), (250, [1.0, 2.5], None), (300, [], "c")]
    rows += [(1000 + i, rows[50][1], "tie") for i in range(8)] + [(100, rows[7][1], "an id twice")]
    got = vector_search.nearest(spark.createDataFrame(rows, schema), every=50)
    assert sorted(map(tuple, got.collect())) == brute_nearest([r[:2] for r in rows], 50, 5)
    cells = vector_search.nearest(spark.createDataFrame(rows, schema), every=50, query_bytes=100, candidate_bytes=400)
    assert sorted(map(tuple, cells.collect())) == brute_nearest([r[:2] for r in rows], 50, 5)
    assert vector_search.nearest(spark.createDataFrame([], schema)).collect() == []
    far = spark.createDataFrame([(50, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [1e-200, 1e-200]), (3, [-1e300, 1e300])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], round(r["score"], 12)) for r in vector_search.nearest(far).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, round(0.5**0.5, 12)), (3, round(-(0.5**0.5), 12))]
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, op7_vector_search(spark, sf).collect())) == brute_nearest(table, 50, 5)


URLS = "page_id long, url string, host string"


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/70?x=/de/", "x://example.com/en/6", "x://notexample.com", "x://de.net/de/", "x://a.net?/de/", "x://b.org/es/#y", "x://b.org/Es/", "x://spam.pills.biz/buy", "x://ok.biz/buy", "x://pills.biz/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "x://b.org/es/", None)], URLS)
    labelled = spark.createDataFrame([(f"x://s{i}.pills.biz/buy", True) for i in range(20)] + [(f"x://s{i}.biz/buy", False) for i in range(20)] + [(None, True), ("x://a.b/c", None)], "url string, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judged(pages, labelled, ["com/en/", "net/de/", "org/es/"], ["example.com/en/7"]).collect()}
    assert len(got) == len(urls) + 1
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("a.example.com", "/en/70", "example.com/en/7", "allow")
    assert got[5]["rule"] == "com/en/" and got[5]["verdict"] == "block"
    assert [got[i]["rule"] for i in (0, 1, 2, 3, 6, 8, 10)] == [None] * 7
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 6, 8, 12)] == ["allow"] * 7
    assert got[7]["rule"] == "net/de/" and got[9]["rule"] == "org/es/" and got[None]["verdict"] == "block"
    assert got[11]["verdict"] == got[13]["verdict"] == "block" and got[11]["rule"] is None
    assert url_filter.judged(pages.limit(0), labelled.limit(0), [], []).collect() == []


def test_url_query_equals_brute_force(spark):
    """Mined rules against all token sets counted one by one, at a size at which labels yield rules."""
    sf = "/root/testdata/sf0.1"
    pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels"))
    rows = url_filter.labelled_pages(pages, labels).select(url_filter.tokens(url_filter.F.col("url")).alias("t"), "bad").collect()
    n, share, seen = len(rows), np.mean([r["bad"] for r in rows]), Counter()
    for r in rows:
        for k in range(1, len(r["t"]) + 1):
            for s in itertools.combinations(sorted(r["t"]), k):
                seen[(s, False)] += 1
                seen[(s, True)] += r["bad"]
    least = max(url_filter.SUPPORT * n, url_filter.LEAST)
    rules = [set(s) for (s, bad), c in seen.items() if bad and c >= np.ceil(least) and c >= url_filter.LIFT * share * seen[(s, False)]]
    got = op8_url_filter(spark, sf).join(pages.select("page_id", url_filter.tokens(url_filter.F.col("url")).alias("t")), "page_id").where("rule is null").collect()
    for r in got:
        assert (r["verdict"] == "block") == any(s <= set(r["t"]) for s in rules)
    assert rules and any(r["verdict"] == "block" for r in got)


def test_url_rules_of_the_contract(spark, tmp_path):
    """Each rule by its word: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    want = {
        "x://a.com/en/1": ("com/en/", "block"),
        "x://example.com/en/70": ("example.com/en/7", "allow"),
        "x://a.net/de/8": ("net/de/", "allow"),
        "x://www.example.net/de/7": ("net/de/", "allow"),
        "x://www.example.net/de/81": ("example.net/de/8", "block"),
        "x://b.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op8_url_filter(spark, str(tmp_path)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == dict(enumerate(want.values()))


def test_tokens_that_always_come_together(spark):
    """A template of twenty tokens is one item; a url with a part of it is judged like the whole."""
    template = "/".join(f"t{chr(97 + i)}" for i in range(20))
    labelled = spark.createDataFrame([(f"x://h.biz/{template}/p{chr(97 + i)}", True) for i in range(20)] + [(f"x://h.biz/q{chr(97 + i)}", False) for i in range(20)], "url string, bad boolean")
    rules, items = url_filter.mined(labelled)
    assert rules.count() == 1 and len(rules.first()["antecedent"]) == 1
    pages = spark.createDataFrame([(1, "x://other.org/td", ""), (2, "x://h.biz/z", "")], URLS)
    assert {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, labelled, [], []).collect()} == {1: "block", 2: "allow"}


RECORDS = "record_id long, url string, time long, status int, etag string, last_modified string, headers map<string,string>, _url string"


def test_revisits(spark):
    r = [
        (1, "http://www.A.com:80/x/?utm_source=q&b=1&a=2#f", 10, 200, '"v1"', "mon", {"Content-Length": "5", "Date": "1", "X": "old"}, "c"),
        (2, "https://a.com/x?a=2&b=1", 20, 304, 'W/"v1"', None, {"date": "2", "content-length": "0", "y": "new"}, "c"),
        (3, "https://a.com/x?a=2&b=1", 30, 200, '"v2"', "tue", None, "c"),
        (4, "https://a.com/x?a=2&b=1", 30, 304, '"v1"', "tue", None, "c"),
        (5, "https://a.com/x?a=2&b=1", 31, 304, None, "tue", None, "c"),
        (6, "https://a.com/x?a=2&b=1", 5, 304, None, None, None, "c"),
        (7, None, 50, 304, None, None, None, "c"),
        (8, "https://a.com/x?a=2&b=1", None, 304, None, None, None, "c"),
        (9, "https://a.com/x?a=2&b=1", 9_000, 304, None, None, {}, "c"),
        (10, "https://a.com/x?a=2&b=1", 40, 500, None, None, {}, "c"),
    ]
    records = spark.createDataFrame(r, RECORDS)
    got = {x["record_id"]: x for x in revisit.resolved(records).collect()}
    assert set(got) == {2, 4, 5, 6, 7, 8, 9}
    assert got[2]["origin_id"] == 1 and got[2]["canonical_url"] == "a.com/x?a=2&b=1"
    assert got[2]["headers"] == {"Content-Length": "5", "X": "old", "date": "2", "y": "new"}
    assert [got[i]["outcome"] for i in (4, 5, 6, 7, 8, 9)] == ["validator_mismatch", "resolved", "no_origin", "no_origin", "no_origin", "resolved"]
    assert got[9]["origin_id"] == got[5]["origin_id"] == 3
    assert revisit.resolved(records.limit(0)).collect() == []
    # Repeated records, and a burst at one time, in slices of few records each.
    burst = spark.createDataFrame([r[0], r[1], r[1], *[(100 + i, r[0][1], 20, 200, f'"{i}"', None, None, "c") for i in range(50)], (200, r[0][1], 20, 304, '"49"', None, None, "c")], RECORDS)
    got = revisit.resolved(burst, 7).collect()
    assert sorted((x["record_id"], x["outcome"], x["origin_id"]) for x in got) == [(2, "resolved", 1), (2, "resolved", 1), (200, "resolved", 149)]
