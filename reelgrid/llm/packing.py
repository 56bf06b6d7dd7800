"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Only documents longer than a sequence are cut. What is packed are narrow rows (item, length): items
are dealt out at random into groups of bounded size, each group is packed best-fit (longest first,
each item into the fullest bin that still takes it), and bins with almost no room left are final.
The other bins become items of the next round, in which fewer groups meet; rounds go on until one
group has packed the rest, or until a round no longer lowers the number of open bins. There are never
fewer groups than items need, so a task holds about GROUP items at most, as evenly as hashes fall.

Defined results: a null text counts as empty and makes one piece, the end token; repeated rows are
packed each; a null doc_id stays null; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, released, releasing, small_batches
from .textscan import slices
from .vocab import word_pieces

#: Tokens of a sequence, items of a group, and the room in tokens with which a bin is final.
SIZE, GROUP, ROOM = 4096, 50_000, 4
#: The token that ends each document.
END = 1


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its ids on demand."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_pieces(vocabulary), np.array([END], "<u4")
        released()  # what reading the vocabulary took
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                rows: list[tuple] = []
                tokens, begin = coder.encode(texts.slice(a, b - a))
                for doc, x, y in zip(ids.slice(a, b - a).to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                    own = np.concatenate([tokens[x:y], end])
                    for k, at in enumerate(range(0, len(own), size)):
                        part = own[at : at + size].tobytes()
                        rows.append((doc, k, at, len(part) // 4, zlib.crc32(part), part))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (ids.type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()) if with_ids else (ids.type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)
        coder.forget()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(releasing(scan), schema)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and what each bin holds; longest items first, fullest fitting bin."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    fills: list[int] = []
    rooms = 0  # bit r is set if some bin has exactly r tokens of room
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), size
            fills.append(0)
        fills[b] += n
        room -= n
        by_room[room].append(b)
        rooms |= 1 << room
        bins[i] = b
    return bins, np.array(fills, np.int64)


def _packed(items: DataFrame, groups: int, size: int, level: int) -> DataFrame:
    """(item, length) in groups -> (item, bin, fill)."""

    def run(t: pa.Table) -> pa.Table:
        group, item = t.column("group")[0].as_py(), t.column("item").to_numpy()
        order = np.argsort(item, kind="stable")
        bins, fills = best_fit(t.column("length").to_numpy()[order], size)
        return pa.table({"item": item[order], "bin": bins + (group << 32) + (level << 56), "fill": fills[bins]})

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(run, "item long, bin long, fill long")


def pack(items: DataFrame, size: int = SIZE, group: int = GROUP, room: int = ROOM) -> DataFrame:
    """(item, length) with unique items and 1 <= length <= size -> (item, bin)."""
    groups = max(1, -(-items.count() // group))
    placed = checkpointed(_packed(items, groups, size, 0))
    out = placed.select("item", "bin")
    bins, level, before = placed, 0, None
    while groups > 1:
        open_bins = bins.where(F.col("fill") < size - room).select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        open_bins = checkpointed(open_bins)
        n = open_bins.count()
        if n == 0 or (before is not None and n > 0.98 * before):
            break
        level, before, groups = level + 1, n, max(-(-groups // 4), -(-n // group))
        bins = checkpointed(_packed(open_bins, groups, size, level))
        moved = bins.select(F.col("item").alias("bin"), F.col("bin").alias("over"))
        out = out.join(moved, "bin", "left").select("item", F.coalesce("over", "bin").alias("bin"))
    return out


def packed_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset, the place in the sequence."""
    rows = checkpointed(pieces(docs, vocabulary, size, with_ids)).withColumn("item", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    placed = rows.join(pack(rows.select("item", "length"), size), "item").withColumnRenamed("bin", "sequence_id")
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("item")
