"""Hard negatives by partial products in an orthogonal PCA basis.

Components are floored to integers. The basis is that of the principal axes of all rows (their second
moments are summed exactly where rows are read; only a d x d table reaches the driver). Products of the
leading components of rotated vectors are accumulated, and what is left of a product is bounded by the
norms of what is left of the vectors, plus room for rounding. A pair is discarded as soon as its bounds
say that it can't be among the answers; pairs that survive all steps are scored as integers.

Anchors and candidates meet as a grid: blocks of anchors by blocks of candidates, each cell a task of
bounded size, neither side passing through the driver. A cell answers the first few of each anchor (of
each anchor and positive), and these are ranked together. Two passes: positives, then negatives within
the bands that the positives' scores set.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part;
vectors of another dimension are never compared; a row isn't its own positive, one that repeats it is;
ties go to the smaller vec_id; the order of repeated ids is that of their place in the files; where a
positive's score is negative no score fits its band; components or scores beyond 64 bits are an error,
never a wrong number; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, small_batches, stored

#: Components up to which products are accumulated before each look at the bounds.
STEPS = (8, 16, 32)
#: Rows of a tile: anchors, candidates. Pairs that are refined or verified at once.
ANCHORS, CANDIDATES, PAIRS = 256, 2048, 1 << 17
#: Bytes of vectors (8 a component) in a block of anchors and of candidates.
ANCHOR_BYTES, CANDIDATE_BYTES = 8 << 20, 8 << 20
#: Room for rounding, as a share of the product of two lengths (2^-40; a sum of d products errs by about d * 2^-52).
SLACK = 2.0**-40


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def whole_rows(vectors: DataFrame, relabel: int) -> DataFrame:
    """vec_id, label, v (integer components), d, file, at of the rows that take part."""
    rows = numbered(vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "_row")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    # Beyond 64 bits a cast would cut: such a component is told.
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**54, F.floor(256 * x)).otherwise(F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long")))
    return rows.select("vec_id", label.alias("label"), whole.alias("v"), F.size("v").alias("d"), "_row.file", "_row.at")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """The sum of outer products of all vectors, for each dimension."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            sizes = b.column(1).to_numpy()
            for d in np.unique(sizes).tolist():
                x = matrix(b.column(0).filter(pa.array(sizes == d)), d).astype(np.float64)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))], ["d", "i", "m"])

    parts = rows.select("v", "d").where("d > 0").mapInArrow(scan, "d int, i int, m array<double>")
    cells = parts.select("d", "i", F.posexplode("m").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in cells.toLocalIterator():
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["x"]
    return out


def basis(moment: np.ndarray) -> np.ndarray:
    """Orthonormal axes, the one with the largest spread first."""
    big = np.abs(moment).max()
    return np.linalg.eigh(moment / big if big else moment)[1][:, ::-1]


class Side:
    """Vectors of a block: exact, rotated, and the norms of what is left after each step."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x, self.r = x, x.astype(np.float64) @ axes
        d = x.shape[1]
        self.steps = [s for s in STEPS if s < d] + [d]
        squares = np.cumsum((self.r**2)[:, ::-1], axis=1)[:, ::-1]
        self.norm = np.sqrt(squares[:, 0]) if d else np.zeros(len(x))
        # Rounding of the rotation is part of the slack, as a share of the whole length.
        self.left = [np.sqrt(squares[:, s]) if s < d else np.zeros(len(x)) for s in self.steps]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of a with rows of b, or an error."""
    if not len(a):
        return np.zeros(0, np.int64)
    if a.shape[1] == 0 or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(p * q for p, q in zip(x, y)) for x, y in zip(a.tolist(), b.tolist())], dtype=np.int64)  # OverflowError beyond 64 bits


def tile_pairs(a: Side, b: Side, i: slice, j: slice, allowed: np.ndarray, judge) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of a, of b) of the allowed pairs of a tile that judge never discards.

    judge(rows, lower, upper) gives which pairs may still count; rows are their anchors, ascending.
    """
    first = a.steps[0]
    part = a.r[i, :first] @ b.r[j, :first].T
    room = a.left[0][i, None] * b.left[0][None, j] + SLACK * a.norm[i, None] * b.norm[None, j]
    p, q = np.nonzero(allowed)
    part, room = part[p, q], room[p, q]
    p, q = p + i.start, q + j.start
    stay = judge(p, part - room, part + room)
    p, q, part = p[stay], q[stay], part[stay]
    for k in range(1, len(a.steps)):
        more = slice(a.steps[k - 1], a.steps[k])
        for at in range(0, len(p), PAIRS):
            own = slice(at, at + PAIRS)
            part[own] += np.einsum("ij,ij->i", a.r[p[own], more], b.r[q[own], more])
        room = a.left[k][p] * b.left[k][q] + SLACK * a.norm[p] * b.norm[q]
        stay = judge(p, part - room, part + room)
        p, q, part = p[stay], q[stay], part[stay]
    return p, q


def kth_largest(rows: np.ndarray, values: np.ndarray, counts: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n rows the k-th largest of its values that count, else minus infinity; rows ascend."""
    rows, values = rows[counts], values[counts]
    out = np.full(n, -np.inf)
    order = np.lexsort((-values, rows))
    rows, values = rows[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    at = place == k - 1
    out[rows[at]] = values[at]
    return out


def best(p: np.ndarray, q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the first k of their anchor: by score, then smaller id."""
    order = np.lexsort((ids[q], -score, p))
    place = np.arange(len(p)) - np.searchsorted(p[order], p[order])
    return order[place < k]


def topped(p: np.ndarray, q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, held: tuple) -> tuple:
    """The first k of each anchor of what was held and what is new."""
    p, q, score = (np.concatenate([x, y]) for x, y in zip(held, (p, q, score)))
    keep = best(p, q, score, ids, k)
    return p[keep], q[keep], score[keep]


NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


class Cell:
    """A block of anchors and one of candidates, of one dimension."""

    def __init__(self, anchors: dict, candidates: dict, axes: np.ndarray):
        self.of, self.to = anchors, candidates
        self.a, self.b = Side(anchors["v"], axes), Side(candidates["v"], axes)
        self.n = len(anchors["vec_id"])

    def tiles(self) -> Iterator[tuple[slice, slice]]:
        for i in range(0, self.n, ANCHORS):
            for j in range(0, len(self.to["vec_id"]), CANDIDATES):
                yield slice(i, min(i + ANCHORS, self.n)), slice(j, min(j + CANDIDATES, len(self.to["vec_id"])))

    def same_label(self, i: slice, j: slice) -> np.ndarray:
        return self.of["label"][i, None] == self.to["label"][None, j]

    def positives(self, k: int) -> tuple:
        held = NOTHING
        for i, j in self.tiles():
            own = (self.of["file"][i, None] == self.to["file"][None, j]) & (self.of["at"][i, None] == self.to["at"][None, j])
            known = np.full(self.n, -np.inf)
            counts = np.bincount(held[0], minlength=self.n) >= k
            if len(held[0]):
                low = np.full(self.n, np.inf)
                np.minimum.at(low, held[0], held[2].astype(np.float64))
                known[counts] = low[counts]

            def judge(rows, lower, upper, known=known):
                floor = np.maximum(known, kth_largest(rows, lower, np.ones(len(rows), bool), k, self.n))
                return upper >= floor[rows]

            p, q = tile_pairs(self.a, self.b, i, j, self.same_label(i, j) & ~own, judge)
            held = topped(p, q, self.exact(p, q), self.to["vec_id"], k, held)
        return held

    def exact(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[products(self.a.x[p[at : at + PAIRS]], self.b.x[q[at : at + PAIRS]]) for at in range(0, len(p), PAIRS)]])

    def negatives(self, bands: np.ndarray, k: int, low: int, high: int) -> list[tuple]:
        """For each positive (a column of bands: [anchor, positive], its score, or -1) the first k whose 100 * score lies between low and high times it."""
        out = [NOTHING] * bands.shape[1]
        floor, top = bands * (low / 100.0), bands * (high / 100.0)
        floor, top = floor - np.abs(floor) * 1e-12, top + np.abs(top) * 1e-12
        for i, j in self.tiles():

            def judge(rows, lower, upper):
                stay = np.zeros(len(rows), bool)
                for c in range(bands.shape[1]):
                    on = bands[rows, c] >= 0
                    # Only pairs that surely lie inside the band may raise what others must reach.
                    inside = on & (lower >= bands[rows, c] * (low / 100.0) * (1 + 1e-12)) & (upper <= bands[rows, c] * (high / 100.0) * (1 - 1e-12))
                    need = np.maximum(floor[rows, c], kth_largest(rows, lower, inside, k, self.n)[rows])
                    stay |= on & (upper >= need) & (lower <= top[rows, c])
                return stay

            p, q = tile_pairs(self.a, self.b, i, j, ~self.same_label(i, j), judge)
            score = self.exact(p, q)
            for c in range(bands.shape[1]):
                positive = bands[p, c]
                fits = (positive >= 0) & within_band(positive, score, low, high)
                out[c] = topped(p[fits], q[fits], score[fits], self.to["vec_id"], k, out[c])
        return out


def within_band(positive: np.ndarray, score: np.ndarray, low: int, high: int) -> np.ndarray:
    """low * positive <= 100 * score <= high * positive, exactly."""
    if len(score) and max(np.abs(positive).max(), np.abs(score).max()) >= 1 << 56:
        positive, score = positive.astype(object), score.astype(object)
    return ((low * positive <= 100 * score) & (100 * score <= high * positive)).astype(bool)


# ---- the grid

KEYS = ["vec_id", "label", "file", "at"]
#: Numbers of blocks that are broadcast; beyond it they meet in a join that Spark splits.
NUMBERS = 1 << 20


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(block: pa.Scalar, d: int) -> dict[str, np.ndarray]:
    t = pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks()
    out = {c: t.column(c).to_numpy() for c in KEYS}
    out["v"] = np.concatenate([np.zeros((0, d), np.int64), *[matrix(c, d) for c in t.column("v").chunks]])
    if "bands" in t.column_names:
        out["bands"] = np.array(t.column("bands").to_pylist(), np.int64)
    return out


def blocks(rows: DataFrame, block_bytes: int, name: str) -> DataFrame:
    """rows packed into blocks of one dimension: d, a number (name) and the bytes (of_name)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(d: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([packed(pa.concat_batches(held.pop(d)))], pa.binary())], ["d", f"of_{name}"])

        for b in batches:
            sizes = b.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                own, most = b.filter(pa.array(sizes == d)), max(1, block_bytes // (8 * max(1, d)))
                while own.num_rows:
                    room = most - sum(x.num_rows for x in held.get(d, ()))
                    held.setdefault(d, []).append(own.slice(0, room))
                    own = own.slice(room)
                    if sum(x.num_rows for x in held[d]) >= most:
                        yield block(d)
        for d in list(held):
            yield block(d)

    more = [c for c in ("bands",) if c in rows.columns]
    out = rows.select("d", "v", *KEYS, *more).mapInArrow(scan, f"d int, of_{name} binary")
    return stored(out.withColumn(name, F.monotonically_increasing_id()))


def grid(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """d, a, c, of_a, of_c: every block of anchors with every block of candidates of its dimension, one row each."""

    def numbers(of: DataFrame, name: str) -> DataFrame:
        some = of.select("d", name)
        return F.broadcast(some) if some.count() <= NUMBERS else some

    left = candidates.join(numbers(anchors, "a"), "d")
    return left.join(anchors.join(numbers(candidates, "c"), "d"), ["d", "a", "c"])


def found(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], of) -> Iterator[pa.RecordBatch]:
    """file, at (of the anchor), c, vec_id, f, t (of the row found), score of what of(cell) gives: (c, (p, q, score)) each."""
    for b in batches:
        for d, a, c in zip(b.column("d").to_pylist(), b.column("of_a"), b.column("of_c")):
            cell = Cell(unpacked(a, d), unpacked(c, d), axes.get(d, np.zeros((d, d))))
            for number, (p, q, score) in of(cell):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (cell.of["file"][p], cell.of["at"][p], np.full(len(p), number, np.int32), cell.to["vec_id"][q], cell.to["file"][q], cell.to["at"][q], score)], ["file", "at", "c", "vec_id", "f", "t", "score"]
                )


FOUND = "file long, at long, c int, vec_id long, f long, t long, score long"


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor (and positive), with their rank from 1."""
    order = Window.partitionBy("file", "at", "c").orderBy(F.desc("score"), "vec_id", "f", "t")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    vectors: DataFrame, every: int = 100, relabel: int = 7, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, anchor_bytes: int = ANCHOR_BYTES, candidate_bytes: int = CANDIDATE_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The first n_negatives rows of another label, for each row whose vec_id is divisible by every and
    each of its first n_positives rows of its label, whose score lies between low and high hundredths
    of the positive's.
    """
    small_batches(vectors.sparkSession)
    rows = stored(whole_rows(vectors, relabel))
    axes = {d: basis(m) for d, m in moments(rows).items()}
    candidates = blocks(rows, candidate_bytes, "c")
    anchors = stored(rows.where(F.col("vec_id") % every == 0))

    def anchor_blocks(of: DataFrame) -> DataFrame:
        size = of.agg(F.coalesce(F.sum(F.col("d").cast("long") * 8), F.lit(0))).first()[0]
        return blocks(of.coalesce(max(1, -(-size // anchor_bytes))), anchor_bytes, "a")

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return found(batches, axes, lambda cell: [(0, cell.positives(n_positives))])

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return found(batches, axes, lambda cell: enumerate(cell.negatives(cell.of["bands"], n_negatives, low, high), 1))

    near = stored(first_of(grid(anchor_blocks(anchors), candidates).mapInArrow(positives, FOUND), n_positives))
    scores = near.groupBy("file", "at").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("m"))
    bands = F.transform(F.sequence(F.lit(1), F.lit(n_positives)), lambda r: F.greatest(F.coalesce(F.get(F.array("m"), F.lit(0))[r], F.lit(-1)), F.lit(-1)))
    banded = stored(anchors.join(scores, ["file", "at"]).withColumn("bands", bands).drop("m"))
    far = first_of(grid(anchor_blocks(banded), candidates).mapInArrow(negatives, FOUND), n_negatives)
    far = far.select("file", "at", F.col("c").alias("rank_of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("file", "at", F.col("rank").alias("rank_of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = named.join(anchors.select("file", "at", F.col("vec_id").alias("anchor_id")), ["file", "at"])
    return far.join(named, ["file", "at", "rank_of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a_id, b_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) <= 5
)
SELECT a_id AS anchor_id, positive_id, row_number() OVER (PARTITION BY a_id, positive_id ORDER BY score DESC, b_id)::INT AS rank, b_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (a_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY a_id, positive_id ORDER BY score DESC, b_id) <= 10
"""
