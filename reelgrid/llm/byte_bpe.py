"""Byte-level BPE of whole texts: overlapping chunks, stitched where pre-tokens resynchronise.

Texts of at most one chunk are encoded where they are read. Longer ones are cut into chunks that
overlap their neighbours; each chunk is pre-tokenised on its own, in parallel. From a boundary on,
matches of the pattern depend only on the text that follows, so at the first boundary that a chunk
shares with the true boundaries of the one before it, in their overlap, both have resynchronised
and the text is cut there. A chunk that shares none (a run of letters longer than the overlap) is
joined to the one before. The pieces between cuts are encoded in parallel, and the ids of a text are
concatenated in order; decoding concatenates the raw bytes of the ids.

Defined results: a null text counts as empty (no tokens); rows may repeat; a null doc_id stays null;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .textscan import slices
from .vocab import byte_pieces

#: Characters of a chunk, and those that it shares with the next.
CHUNK, OVERLAP = 16_384, 512


class Digest:
    """SHA-256 of the decimal ids joined by commas and of the decoded bytes, as ids come in."""

    def __init__(self, coder):
        self.coder, self.n, self.ids, self.raw = coder, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: bytes) -> Digest:
        for at in range(0, len(ids), 1 << 22):
            part = np.frombuffer(ids[at : at + (1 << 22)], "<u4")
            self.ids.update((("," if self.n else "") + ",".join(map(str, part.tolist()))).encode())
            self.n += len(part)
        for raw in self.coder.decode(ids):
            self.raw.update(raw)
        return self

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.raw.hexdigest()


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the matches of the pattern, without one at the end of the text."""
    return [m.end() for m in regex.finditer(pattern, text) if m.end() < len(text)]


def settled(text: str) -> bool:
    """Whether each character has a category, so that all Unicode versions part the text alike."""
    return text.isascii() or not any(unicodedata.category(c) == "Cn" for c in text)


def long_pieces(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, piece, text: the long texts of docs, cut where chunks resynchronise."""
    step, start = F.lit(chunk), F.col("_chunk") * chunk
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), ((F.char_length("text") - 1) / chunk).cast("int"))))
    rows = checkpointed(rows.select("_row", "doc_id", "_chunk", F.substring("text", start + 1, step).alias("_core"), F.substring("text", start + 1 + step, F.lit(overlap)).alias("_tail")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail = [], []
            for core, rest in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                ends = boundaries(core + rest, pattern)
                head.append([e for e in ends if e < overlap] if settled(core[: overlap + 1]) else [])
                tail.append([e - chunk for e in ends if e >= chunk] if settled(rest) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], ["_row", "_chunk", "_head", "_ends"])

    dealt = rows.repartition("_row", "_chunk").select("_row", "_chunk", "_core", "_tail")
    marks = dealt.mapInArrow(scan, "_row long, _chunk int, _head array<int>, _ends array<int>")
    own = Window.partitionBy("_row").orderBy("_chunk")
    shared = F.array_min(F.array_intersect("_head", F.lag("_ends").over(own)))
    marks = marks.withColumn("_cut", F.when(F.col("_chunk") == 0, F.lit(0)).otherwise(shared))
    marks = marks.withColumn("_piece", F.max(F.when(F.col("_cut").isNotNull(), F.col("_chunk"))).over(own))
    cuts = marks.select("_row", "_chunk", "_piece", "_cut", F.lead("_cut").over(own).alias("_next"), F.lead("_chunk").over(own).isNull().alias("_last"))
    whole_chunk = F.col("_cut").isNotNull() & (F.col("_next").isNotNull() | F.col("_last"))
    cuts = cuts.withColumn("_alone", whole_chunk).drop("_last")
    met = rows.join(cuts, ["_row", "_chunk"])
    alone = met.where("_alone").select("_row", "_piece", "doc_id", "_cut", F.col("_core").alias("_cores"), "_tail", "_next")
    parts = met.where("not _alone").groupBy("_row", "_piece").agg(
        F.min("doc_id").alias("doc_id"),
        F.min("_cut").alias("_cut"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "_core"))), lambda x: x["_core"]), "").alias("_cores"),
        F.max_by("_tail", "_chunk").alias("_tail"),
        F.max_by("_next", "_chunk").alias("_next"),
    )
    whole = F.concat("_cores", F.when(F.col("_next").isNotNull(), F.expr("left(_tail, _next)")).otherwise(F.lit("")))
    parts = alone.unionByName(parts)
    return parts.withColumn("_whole", whole).select("_row", "doc_id", "_piece", F.expr("substring(_whole, _cut + 1)").alias("text"))


IDS, DIGESTS = "_row long, doc_id long, _piece int, ids binary", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _parts(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Short and long texts as _row, doc_id, _piece, text; each short one is a single piece."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = docs.where(F.char_length("text") <= chunk).select((-1 - F.monotonically_increasing_id()).alias("_row"), "doc_id", F.lit(0).alias("_piece"), "text")
    return short, long_pieces(docs.where(F.char_length("text") > chunk), pattern, chunk, overlap)


def _encoder(vocabulary: str, pattern: str, narrow: bool = False):
    """narrow: ids that fit are held in 16 bits on their way to the digests."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pieces(vocabulary, pattern)
        for b in batches:
            for at, end in slices(b.column(3)):
                part = b.slice(at, end - at)
                found = coder.encode(part.column(3).to_pylist())
                if narrow and len(coder.size) <= 1 << 16:
                    found = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in found]
                ids = pa.array(found, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], ids], ["_row", "doc_id", "_piece", "ids"])

    return scan


def _digester(vocabulary: str, pattern: str, narrow: bool = False):
    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a text follow each other in order; only those of one batch are held."""
        coder = byte_pieces(vocabulary, pattern)
        row, doc, sums = None, None, None
        for b in batches:
            out = []
            for r, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if r != row or sums is None:
                    if sums is not None:
                        out.append((doc, *sums.row()))
                    row, doc, sums = r, d, Digest(coder)
                sums.add(np.frombuffer(ids, "<u2").astype("<u4").tobytes() if narrow and len(coder.size) <= 1 << 16 else ids)
            yield told(out)
        if sums is not None:
            yield told([(doc, *sums.row())])

    return scan


def encoded(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """_row, doc_id, _piece, ids: the ids (little-endian unsigned 32-bit) of each piece.

    _row tells texts apart; the ids of a text are those of its pieces in the order of _piece.
    """
    short, long = _parts(docs, pattern, chunk, overlap)
    return short.union(long).mapInArrow(_encoder(vocabulary, pattern), IDS)


def digests(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, encoded and decoded again."""
    short, long = _parts(docs, pattern, chunk, overlap)
    encode, digest = _encoder(vocabulary, pattern), _digester(vocabulary, pattern)
    direct = short.mapInArrow(lambda batches: digest(encode(batches)), DIGESTS)
    pieced = long.mapInArrow(_encoder(vocabulary, pattern, True), IDS).repartition("_row").sortWithinPartitions("_row", "_piece")
    return direct.union(pieced.mapInArrow(_digester(vocabulary, pattern, True), DIGESTS))
