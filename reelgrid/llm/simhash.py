"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: each text's bits are voted on by the XXH64 of its word shingles (numpy, slice by
slice). The distinct fingerprints form a binary trie. Node pairs are traversed together from the
root: a pair carries the number of bits in which its two prefixes differ and is dropped as soon as
that exceeds the budget, so what reaches the leaves are exactly the links.

The top of the trie is cut into cells of about equal numbers of fingerprints; the pairs of cells
within the budget are the tasks, and a task goes on with the traversal below its two cells. A task
returns not its links but a spanning forest of them, so a dense group makes as many rows as it has
members. Components are then found by label propagation over the forests, with checkpoints.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is
linked like any other; rows may repeat; a null doc_id is never a component's name unless all its
rows have none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, others, rows_without, stored, text_key
from .textscan import Words, slices, words, xxh64

U64 = np.uint64
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 17
#: At most about this many cells make up the top of the trie, whatever the input.
CELLS = 8192


def shingle_spans(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, size and text number of each shingle; a text of fewer words has one of all its words."""
    first = w.first
    count = np.diff(first)
    shingles = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(w.n), shingles)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[:-1][doc]
    last = begin + np.minimum(count[doc], k) - 1
    return w.start[begin], w.start[last] + w.size[last] - w.start[begin], doc


def voted(h: np.ndarray, doc: np.ndarray, ones: np.ndarray) -> None:
    """Add to ones[text, bit] the hashes h, whose texts ascend in doc."""
    for at in range(0, len(doc), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        bits = np.unpackbits(h[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, where = np.unique(doc[part], return_index=True)
        ones[own] += np.add.reduceat(bits, where, axis=0, dtype=np.int32)


def won(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The fingerprints: a bit is 1 if set in over half of the hashes."""
    return np.packbits((2 * ones > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(texts: pa.Array, k: int = 3, seed: int = 42) -> np.ndarray:
    """One uint64 per text."""
    out = np.zeros(len(texts), U64)
    for begin, end in slices(texts):
        w = words(texts.slice(begin, end - begin))
        start, size, doc = shingle_spans(w, k)
        ones = np.zeros((w.n, 64), np.int64)
        for at in range(0, len(doc), SHINGLES_AT_ONCE):
            part = slice(at, at + SHINGLES_AT_ONCE)
            voted(xxh64(w.text, start[part], size[part], seed), doc[part], ones)
        out[begin:end] = won(ones, np.bincount(doc, minlength=w.n))
    return out


def fingerprint_rows(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, key (of the row) and the fingerprint as a (signed) long, for each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprints(b.column(2), k, seed).view(np.int64))], ["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(scan, f"doc_id {kind}, key long, fp long")


class Forest:
    """Union of links between positions 0..n-1, in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            on = x != y
            if not on.any():
                return
            a, b = a[on], b[on]
            np.minimum.at(self.root, np.maximum(x[on], y[on]), np.minimum(x[on], y[on]))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, small: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all a[i], b[j] that differ in at most budget bits; a and b ascend, each without repeats.

    Where a is b, a link may come in one direction only. The frontier of node pairs goes down bit
    by bit; what exceeds PAIRS_AT_ONCE waits on a stack, so memory is bounded.
    """
    same = a is b
    if not len(a) or not len(b):
        return
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def below(bit: int) -> tuple[np.ndarray, np.ndarray]:
        if bit not in zeros:
            count = lambda v: np.concatenate([[0], np.cumsum((v >> U64(bit)) & U64(1) == 0)])
            zeros[bit] = (za := count(a), za if same else count(b))
        return zeros[bit]

    root = np.array([[0], [len(a)], [0], [len(b)], [0]])
    stack = [(63, root)]
    while stack:
        bit, pairs = stack.pop()
        a0, a1, b0, b1, spent = pairs
        rows = (a1 - a0) * (b1 - b0)
        few = rows <= small if bit >= 0 else np.ones(len(rows), bool)
        if few.any():
            at = np.flatnonzero(few)
            for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(rows[at]) // PAIRS_AT_ONCE)) + 1):
                n = rows[part]
                own = np.repeat(part, n)
                k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                width = (b1 - b0)[own]
                i, j = a0[own] + k // width, b0[own] + k % width
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    near &= i != j
                yield i[near], j[near]
            pairs = pairs[:, ~few]
            if not pairs.shape[1]:
                continue
            a0, a1, b0, b1, spent = pairs
        za, zb = below(bit)
        am, bm = a0 + za[a1] - za[a0], b0 + zb[b1] - zb[b0]
        self_pair = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        children = [
            np.stack([a0, am, b0, bm, spent]),
            np.stack([am, a1, bm, b1, spent]),
            np.stack([a0, am, bm, b1, spent + 1]),
            np.stack([am, a1, b0, bm, spent + 1])[:, ~self_pair],
        ]
        pairs = np.concatenate(children, axis=1)
        pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)]
        for part in range(0, pairs.shape[1], PAIRS_AT_ONCE):
            stack.append((bit - 1, pairs[:, part : part + PAIRS_AT_ONCE]))


def forest_of(a: np.ndarray, b: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, value) that connect what the links between a and b connect."""
    same = a is b
    values = a if same else np.concatenate([a, b])
    forest = Forest(len(values))
    for i, j in trie_links(a, b, budget):
        forest.add(i, j if same else j + len(a))
    on = np.flatnonzero(forest.root != np.arange(len(values)))
    return values[on], values[forest.root[on]]


def trie_cells(counts: dict[tuple[int, int], int], most: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the cells: nodes with at most so many fingerprints, or as deep as counts go."""
    sums: dict[tuple[int, int], int] = {}
    deepest: dict[tuple[int, int], bool] = {}
    for (prefix, depth), n in counts.items():
        for d in range(depth, -1, -1):
            key = (prefix >> (depth - d), d)
            sums[key] = sums.get(key, 0) + n
            deepest.setdefault(key, False)
        deepest[(prefix, depth)] = True
    out, stack = [], [(0, 0)]
    while stack:
        key = stack.pop()
        if sums.get(key, 0) == 0:
            continue
        if sums[key] <= most or deepest[key]:
            out.append(key)
        else:
            stack += [(2 * key[0], key[1] + 1), (2 * key[0] + 1, key[1] + 1)]
    return out


def cell_pairs(cells: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs of cell numbers (a <= b) whose prefixes differ within the budget, by traversing the top of the trie.

    Below a cell, bits of the other side are not charged: the task itself does that.
    """
    nodes: set[tuple[int, int]] = set()
    for prefix, depth in cells:
        for d in range(depth + 1):
            nodes.add((prefix >> (depth - d), d))
    number = {c: i for i, c in enumerate(cells)}

    def children(x: tuple[int, int]) -> list[tuple[int, tuple[int, int]]]:
        return [(bit, y) for bit in (0, 1) if (y := (2 * x[0] + bit, x[1] + 1)) in nodes]

    out: set[tuple[int, int]] = set()
    stack = [((0, 0), (0, 0), 0)] if nodes else []
    while stack:
        x, y, spent = stack.pop()
        if x in number and y in number:
            out.add((min(number[x], number[y]), max(number[x], number[y])))
        elif x in number:
            stack += [(x, v, spent) for _, v in children(y)]
        elif y in number:
            stack += [(u, y, spent) for _, u in children(x)]
        else:
            for p, u in children(x):
                for q, v in children(y):
                    if (x != y or p <= q) and spent + (p != q) <= budget:
                        stack.append((u, v, spent + (p != q)))
    return sorted(out)


def _spread(fps: DataFrame, most: int) -> list[tuple[int, int]]:
    """Cells of the distinct fingerprints, from counts of prefixes.

    The counts of at most 65,536 prefixes come to the driver; a prefix that holds too many is
    counted again, 8 bits deeper each time. Fewer than CELLS prefixes can hold too many.
    """
    counts = {(r["p"], 16): r["count"] for r in fps.groupBy(F.shiftrightunsigned("fp", 48).alias("p")).count().collect()}
    for depth in range(24, 65, 8):
        heavy = [p for (p, d), n in counts.items() if d == depth - 8 and n > most]
        if not heavy:
            break
        upper = fps.sparkSession.createDataFrame(pa.table({"u": pa.array(heavy, pa.int64())}))
        rows = fps.withColumn("u", F.shiftrightunsigned("fp", 72 - depth)).join(F.broadcast(upper), "u", "left_semi")
        finer = rows.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("p")).count().collect()
        for p in heavy:
            del counts[(p, depth - 8)]
        counts |= {(r["p"] % (1 << depth), depth): r["count"] for r in finer}
    return trie_cells(counts, most)


def trie_forest(fps: DataFrame, budget: int) -> DataFrame:
    """Edges (fp, to) of spanning forests of all links between distinct fingerprints."""
    spark = fps.sparkSession
    n = fps.count()
    cells = _spread(fps, max(2048, -(-n // (CELLS // 2))))
    pairs = cell_pairs(cells, budget)
    if not pairs:
        return spark.createDataFrame([], "fp long, to long")
    # Arrow tables: rows of Python objects would start workers of another kind, which stay.
    places = spark.createDataFrame(pa.table({"cell": pa.array(range(len(cells)), pa.int32()), "depth": pa.array([d for _, d in cells], pa.int32()), "low": pa.array([_signed(p, d) for p, d in cells], pa.int64())}))
    prefixes = F.array(*[F.struct(F.lit(d).alias("depth"), F.col("fp").bitwiseAND(F.lit(_signed((1 << d) - 1, d))).alias("low")) for d in sorted({d for _, d in cells})])
    placed = fps.select("fp", F.explode(prefixes).alias("k")).select("fp", "k.depth", "k.low").join(F.broadcast(places), ["depth", "low"])
    held = checkpointed(placed.groupBy("cell").agg(F.collect_list("fp").alias("fps")))
    tasks = spark.createDataFrame(pa.table({c: pa.array(x, pa.int32()) for c, x in zip("ab", zip(*pairs))}))
    sides = tasks.select("a", "b", F.col("a").alias("cell")).union(tasks.where("a <> b").select("a", "b", F.col("b").alias("cell")))

    def run(task: pa.Table) -> pa.Table:
        x, *y = (np.sort(np.asarray(v.values).view(U64)) for v in task.column("fps").combine_chunks())
        p, q = forest_of(x, y[0] if y else x, budget)
        return pa.table({"fp": p.view(np.int64), "to": q.view(np.int64)})

    return held.join(F.broadcast(sides), "cell").select("a", "b", "fps").groupBy("a", "b").applyInArrow(run, "fp long, to long")


def _signed(prefix: int, depth: int) -> int:
    value = prefix << (64 - depth) if depth else 0
    return value - (1 << 64) if value >= 1 << 63 else value


#: Labels up to which they are broadcast (16 bytes each) and kept in LABEL_FILES files; beyond it they meet edges in shuffled joins.
LABELS, LABEL_FILES = 1 << 19, 16


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): for every fp of an edge, the smallest fp of its component.

    Labels travel along edges and are then shortened by looking up the label of the label; both
    are plain joins, whose hot keys Spark splits, and minima with partial sums. Each round is
    written to the shared folder, and the one before it removed; it ends when no label has changed.
    Few labels are broadcast: a shuffle of little data leaves small files for each pair of its tasks.
    Edges from stored() are read from there, and removed in the end.
    """
    edges = edges if hasattr(edges, "stored_in") else stored(edges)
    few = 2 * edges.count() <= LABELS
    both = edges.select("fp", "to").union(edges.select(F.col("to").alias("fp"), F.col("fp").alias("to"))).where("fp <> to")
    both = both if few else stored(both.distinct())
    labels = stored(both.groupBy("fp").agg(F.least(F.min("to"), F.col("fp")).alias("root")), LABEL_FILES if few else None)
    few = few or labels.count() <= LABELS
    side = F.broadcast if few else (lambda rows: rows)
    while True:
        heard = both.join(side(labels.withColumnRenamed("fp", "to")), "to").select("fp", "root")
        lower = labels.union(heard).groupBy("fp").agg(F.min("root").alias("root"))
        up = labels.select(F.col("fp").alias("root"), F.col("root").alias("over"))
        short = lower.join(side(up), "root", "left").select("fp", F.least("root", F.coalesce("over", "root")).alias("root"))
        new = stored(short, LABEL_FILES if few else None)
        changed = new.join(side(labels.withColumnRenamed("root", "was")), "fp").where("root <> was").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both, edges)
            return labels


def named_rows(docs: DataFrame, k: int, seed: int, budget: int) -> DataFrame:
    """doc_id, key, fp, root (a fingerprint of the component), component_id of every row."""
    rows = stored(fingerprint_rows(docs, k, seed))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(trie_forest(nodes.select("fp"), budget))
    inside = labels.join(nodes, "fp")
    named = inside.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = inside.join(named, "root").select("fp", "root", "component_id")
    told = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id")))
    return rows.join(told, "fp")


def near_duplicates(docs: DataFrame, k: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return named_rows(docs, k, seed, budget).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_row() -> Column:
    """The order in which rows of a component stay: the smallest doc_id, null last, then a hash of the text."""
    return F.struct(F.col("doc_id").isNull(), "doc_id", "key")


def near_kept(docs: DataFrame, k: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row that is first_row()."""
    rows = stored(named_rows(docs, k, seed, budget).select("doc_id", "key", "root"))
    best = rows.groupBy("root").agg(F.min(first_row()).alias("best")).select("best.doc_id", "best.key")
    return rows_without(docs, rows, others(rows, best))
