import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from reelgrid.llm import packing
from reelgrid.llm.queries import op4_best_fit_packing

DOCS = "doc_id long, text string, item string"
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def well_packed(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def pieces_of(library, rows, size):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out += [(d, k, at, len(p := ids[at : at + size]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), size))]
    return out


def test_edge_cases(spark, library):
    texts = [None, "", "  ", "Hello WORLD", "e\u0301 É", "long " * 100, "x" * 500, "a b", "a b", "<|endoftext|>"]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)]
    got = packing.packed_documents(spark.createDataFrame(rows, DOCS), PATH, 16).collect()
    well_packed(got, 16)
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted((str(a), *b) for a, *b in pieces_of(library, [r[:2] for r in rows], 16))


def test_rounds_merge_what_groups_leave(spark):
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in rng.integers(1, 400, 3000)] + [1000] * 40
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.pack(items, 1000, group=100).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r["bin"]] += lengths[r["item"]]
    assert len(got) == len(lengths) and max(fill.values()) <= 1000
    assert len(fill) <= 1.01 * sum(lengths) / 1000 + 1


@pytest.mark.parametrize("least,most", [(2100, 2600), (1400, 1600), (500, 3000)])
def test_tasks_hold_about_a_group(spark, monkeypatch, least, most):
    """No round deals out fewer groups than its items need."""
    seen, packed = [], packing._packed

    def watch(items, groups, size, level):
        seen.append(items.count() / groups)
        return packed(items, groups, size, level)

    monkeypatch.setattr(packing, "_packed", watch)
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(least, most, 4000))], "item long, length long")
    assert packing.pack(items, 4096, group=500).count() == 4000
    assert len(seen) > 1 and max(seen) <= 500


def test_ids_of_another_type(spark):
    rows = spark.createDataFrame([("a", "one two", ""), (None, "three", "")], "doc_id string, text string, item string")
    assert {r["doc_id"] for r in packing.packed_documents(rows, PATH).collect()} == {"a", None}


def test_items_over_half_end(spark):
    items = spark.createDataFrame([(i, 600) for i in range(500)], "item long, length long")
    assert packing.pack(items, 1000, group=50).select("bin").distinct().count() == 500


def test_empty(spark):
    assert packing.packed_documents(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_query(spark, sf, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op4_best_fit_packing(spark, sf).collect()
    want = pieces_of(library, rows, 4096)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert well_packed(got, 4096) == -(-sum(x[3] for x in want) // 4096)


def test_pieces_equal_library(library):
    """Words by merges or by the library, with and without marks, against whole texts encoded at once."""
    import random

    import pyarrow as pa

    from reelgrid.llm.vocab import word_pieces

    rng = random.Random(2)
    letters = "aaeiou" + "bcdfghlmnrstth" + "éèüßñçœæ" + "AEST" + "ÀÉÜ" + "ΣςΔ" + "İıǅ" + "'’-" + "09" + "́" + "日語"
    words = ["".join(rng.choice(letters[: rng.choice((20, 28, 35, len(letters)))]) for _ in range(rng.randint(1, 40))) + rng.choice(["", "", ".", ",", "!!", '."', "***", "'s"]) for _ in range(20_000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["", " ", "\x85　a"]
    coder = word_pieces(PATH)
    assert coder.merges is not None
    ids, begin = coder.encode(pa.array(texts))
    for t, a, b in zip(texts, begin[:-1], begin[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_special_tokens_and_odd_strings_as_the_library(library):
    """The plain call, on 20,000 random strings with the two special strings, marks, accents and white space of all kinds among them."""
    import random

    import pyarrow as pa

    from reelgrid.llm.vocab import WordPieces

    r = random.Random(11)
    bits = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", " ", " ", " ", "\n", " ", " ", "Word", "straße", "É", "é", "́", "İ", "x1", "'s", "'LL", "...", "|>", "日本", "9", "ǅ", "_", "\x85"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(20_000)]
    coder = WordPieces(PATH)
    coder.pieces.most = 1 << 16  # several generations
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        ids, begin = coder.encode(pa.array(part))
        for t, a, b in zip(part, begin[:-1].tolist(), begin[1:].tolist()):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t
