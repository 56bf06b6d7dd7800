import re

import numpy as np
import pyarrow as pa
import xxhash

from reelgrid.llm import simhash
from reelgrid.llm.queries import op10_simhash

DOCS = "doc_id long, text string, lang string, fp string"


def brute_fp(text, k=3, seed=42):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget=3):
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    fps = np.array([f for _, f in rows], np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= budget):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {d: min(x for x in groups[find(i)] if x is not None) for i, (d, _) in enumerate(rows) if d is not None}


def test_links_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False))) for b in np.repeat(base, 20)]
    a = np.unique(np.array(near, np.uint64))
    got = {frozenset(map(int, p)) for i, j in simhash.trie_links(a, a, 3, small=4) for p in zip(i, j)}
    want = {frozenset((i, j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist() if i != j}
    assert got == want
    cells = simhash.trie_cells({(int(p), 16): int(n) for p, n in zip(*np.unique(a >> np.uint64(48), return_counts=True))}, 30)
    number = {int(v): k for v in a for k, (p, d) in enumerate(cells) if int(v) >> (64 - d) == p}
    assert len(number) == len(a)
    pairs = set(simhash.cell_pairs(cells, 3))
    for i, j in map(tuple, want):
        assert tuple(sorted((number[int(a[i])], number[int(a[j])]))) in pairs


def test_documents_equal_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "  ", "One", "one", "a b", "A\tb c", base, base.replace("w7 ", "x "), base + " tail", base.upper(), "z" * 100_000, "q " * 50_000, *(f"t{i} u{i * 7} v{i} w" for i in range(50))]
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)] + [(3, "One", "en", None), (None, "One", "en", None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    want = brute_components(fps)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{dict((d, f) for d, f in fps)[r['doc_id']]:016x}"
            assert r["component_id"] == want[r["doc_id"]]
    kept = {r["doc_id"] for r in simhash.near_kept(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept - {None} == {v for v in want.values()}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    want = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op10_simhash(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in fps}


def test_components_leave_few_files(spark, tmp_path, monkeypatch):
    """Rounds over few labels are removed when the next one is written, whatever the number of shuffle partitions; shuffled joins find the same."""
    context, was = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    before = context._jsc.sc().getCheckpointDir()
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1012)]
    edges = spark.createDataFrame(pairs, "fp long, to long")
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    want = {x: r for x, r in up.items() if any(x in p and p[0] != p[1] for p in pairs)}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setCheckpointDir(str(tmp_path))
        got = simhash.components(edges)
        assert {r["fp"]: r["root"] for r in got.collect()} == want
        assert len([x for x in tmp_path.rglob("*part-*") if x.is_file() and x.suffix != ".crc"]) <= simhash.LABEL_FILES
        monkeypatch.setattr(simhash, "LABELS", 0)
        assert {r["fp"]: r["root"] for r in simhash.components(edges).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        if before.isDefined():
            context.setCheckpointDir(before.get())
