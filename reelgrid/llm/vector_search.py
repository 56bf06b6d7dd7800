"""Exact nearest neighbours by int8 product tiles with error bounds.

Vectors are normalised and rounded to int8 with a scale each; the length of what rounding took away
is kept, so the product of two codes is within a known distance of the cosine. A tile of queries by
candidates is one matrix product of codes (in float32, where sums of such products are exact). Pairs
whose upper bound reaches the query's k-th lower bound survive, are computed again in double
precision from the original vectors, and go to a heap per query; heaps of partitions are merged.

Queries and candidates meet as a grid: blocks of queries by blocks of candidates, each cell a task's row
of bounded size. Neither side passes through the driver or is broadcast, and all cells run at once, so
the number of queries may grow with the table; candidates are moved once for each QUERY_BYTES of queries.

Defined results: vectors that are null, zero, or hold a null or non-finite component, and rows with
a null id, take no part; ids must be whole numbers (a column of another type is an error); vectors of another dimension are not compared; ties go to the smaller
vec_id; of rows with one id each is a query of its own, and a candidate for the others; vectors are
scaled by powers of two, so very large and very small components neither overflow nor vanish; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_batches, stored
from .hard_negatives import KEYS, blocks, grid

#: Bytes of vectors (8 a component) in a block of queries and of candidates.
QUERY_BYTES, CANDIDATE_BYTES = 16 << 20, 8 << 20
#: Rows of a tile on either side, and surviving pairs that are computed again at once.
TILE, PAIRS = 2048, 1 << 17
#: Room for rounding in double precision.
SLACK = 1e-9


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the normalised rows (as float32), their scales, and the lengths of the rounding errors."""
    big = np.abs(x).max(axis=1, keepdims=True)
    u = x / big
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    code = np.rint(u / scale[:, None])
    return code.astype(np.int8).astype(np.float32), scale, np.linalg.norm(u - code * scale[:, None], axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: at most 1,024 components at a time fit float32's integers."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024] @ b[:, at : at + 1024].T
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, to lie between 1/2 and 1; no digit of a component that counts is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


class Heaps:
    """The k best (score, smaller id) of each query."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def offer(self, query: Hashable, score: float, vec: int) -> None:
        heap = self.of.setdefault(query, [])
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -vec))
        elif (score, -vec) > heap[0]:
            heapq.heapreplace(heap, (score, -vec))

    def rows(self) -> list[tuple[Hashable, int, int, float]]:
        """Query, rank, id and score, the nearest first."""
        return [(q, i + 1, -v, s) for q, heap in self.of.items() for i, (s, v) in enumerate(sorted(heap, reverse=True))]


class Queries:
    """A block of queries of one dimension, ready for tiles; ids are their numbers in the block, keys tell their rows."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.keys, self.x, self.k = np.arange(len(x)), keys, x, k
        self.code, self.scale, self.error = coded(x)

    def tile(self, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, heaps: Heaps) -> None:
        code, scale, error = coded(x)
        for at in range(0, len(self.ids), TILE):
            q = slice(at, at + TILE)
            near = product(self.code[q], code) * self.scale[q, None] * scale
            off = self.error[q, None] * (1 + error) + error * (1 + self.error[q, None]) + self.error[q, None] * error + SLACK
            near[(self.keys[q, None, 0] == keys[:, 0]) & (self.keys[q, None, 1] == keys[:, 1])] = -np.inf
            lower = near - off
            floor = np.partition(lower, -self.k, axis=1)[:, -self.k] if len(ids) > self.k else np.full(len(near), -np.inf)
            own = [heaps.of.get(i, ()) for i in self.ids[q].tolist()]
            floor = np.maximum(floor, [h[0][0] - SLACK if len(h) == self.k else -np.inf for h in own])
            i, j = np.nonzero((near + off >= floor[:, None]) & (near > -np.inf))
            for part in range(0, len(i), PAIRS):
                self._again(at + i[part : part + PAIRS], j[part : part + PAIRS], ids, x, heaps)

    def _again(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, x: np.ndarray, heaps: Heaps) -> None:
        """Pairs (query, candidate), in the order of queries, in double precision; the best go to the heaps."""
        score, vec = cosines(self.x[i], x[j]), ids[j]
        order = np.lexsort((vec, -score, i))
        i, score, vec = i[order], score[order], vec[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < self.k  # of a vector with many copies only these can count
        for a, s, v in zip(self.ids[i[best]].tolist(), score[best].tolist(), vec[best].tolist()):
            heaps.offer(a, s, v)


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


OUT = "query_id long, rank int, vec_id long, score double"
#: What a cell finds: query_id and the query's row, the id found, the score.
FOUND = "query_id long, file long, at long, vec_id long, score double"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _block(block: pa.Scalar, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, rows (file, at) and vectors of a block."""
    t = pa.ipc.open_stream(block.as_buffer()).read_all()
    vec_id, _, file, at = (t.column(c).to_numpy() for c in KEYS)
    return vec_id, np.stack([file, at], axis=1), np.concatenate([matrix(c, d) for c in t.column("v").chunks])


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, query_bytes: int = QUERY_BYTES, candidate_bytes: int = CANDIDATE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each row whose vec_id is divisible by every."""
    small_batches(vectors.sparkSession)
    if vectors.schema["vec_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("vec_id must be a column of whole numbers")
    rows = numbered(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "_row").where(F.col("vec_id").isNotNull())
    rows = rows.where(usable(F.col("v"))).select(F.col("vec_id").cast("long"), F.lit(0).alias("label"), "v", F.size("v").alias("d"), "_row.file", "_row.at")
    asked = stored(rows.where(F.col("vec_id") % every == 0))
    size = asked.agg(F.coalesce(F.sum(F.col("d").cast("long") * 8), F.lit(0))).first()[0]
    cells = grid(blocks(asked.coalesce(max(1, -(-size // query_bytes))), query_bytes, "a"), blocks(rows, candidate_bytes, "c"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, of, to in zip(b.column("d").to_pylist(), b.column("of_a"), b.column("of_c")):
                query_id, own, x = _block(of, d)
                vec_id, keys, y = _block(to, d)
                queries, heaps = Queries(own, x, k), Heaps(k)
                for at in range(0, len(y), TILE):
                    part = slice(at, at + TILE)
                    queries.tile(vec_id[part], keys[part], y[part], heaps)
                yield _batch([(int(query_id[q]), *own[q].tolist(), vec, score) for q, _, vec, score in heaps.rows()], FOUND)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for b in batches:
            for *query, vec, score in zip(*(c.to_pylist() for c in b.columns)):
                heaps.offer(tuple(query), score, vec)
        yield _batch([(query[0], rank, vec, score) for query, rank, vec, score in heaps.rows()], OUT)

    return cells.mapInArrow(search, FOUND).repartition("query_id", "file", "at").mapInArrow(merge, OUT)
