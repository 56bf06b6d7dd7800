"""Containers as tables: structure checks by byte ranges, and the tracks and packets of Matroska files.

`read_structure`, `read_tracks` and `read_packets` are Python data sources: files are opened in tasks and
read by seeks, so a file of any size takes little memory. They open what pyarrow's file systems reach
(local and mounted folders, hdfs, s3, gs). Where only Spark reaches a folder, its `binaryFile` source
gives rows of bytes, and the same walks run over these (`files.verified`, `demuxed`).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import binwalk
from ..functions.binwalk import LENGTHS, VALUES, Source, vint

#: Element names of Matroska (fixed values of the format).
INFO, TIMECODE_SCALE, DURATION = 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID, CODEC_PRIVATE, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x63A2, 0x23E383
VIDEO, PIXEL_WIDTH, PIXEL_HEIGHT, ALPHA_MODE, AUDIO, SAMPLING, CHANNELS = 0xE0, 0xB0, 0xBA, 0x53C0, 0xE1, 0xB5, 0x9F
CLUSTER, TIMECODE, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, ADDITIONS, MORE, ADD_ID, ADDITIONAL = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x75A1, 0xA6, 0xEE, 0xA5
TOP = {INFO, TRACKS, CLUSTER, 0x114D9B74, 0x1C53BB6B, 0x1043A770, 0x1941A469, 0x1254C367, binwalk.SEGMENT, binwalk.EBML_HEADER}

#: Bytes of a track's entry up to which it is looked up among those walked before.
ENTRY = 4096

#: What ends an element of unknown size.
ENDS = {CLUSTER: TOP, binwalk.SEGMENT: {binwalk.SEGMENT, binwalk.EBML_HEADER}}


class Malformed(ValueError):
    """The bytes are not what they claim to be."""


@dataclass
class Track:
    number: int = 0
    type: int = 0
    codec: str = ""
    private: bytes | None = None
    default_duration_ns: int | None = None
    width: int | None = None
    height: int | None = None
    alpha: bool = False
    rate: float | None = None
    channels: int | None = None


@dataclass
class Header:
    doc_type: str | None = None
    scale: int = 1_000_000
    duration_ns: int = 0
    tracks: dict[int, Track] = field(default_factory=dict)


def elements(s: Source, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(name, begin, end) of the elements between at and end, up to a name that ends what they are inside."""
    ends, read = ENDS.get(inside, ()), s.read
    while at < end:
        # A name and a size, as vint() reads them, by one read.
        data = read(at, 16)
        n = LENGTHS[data[0]] if data else 0
        m = LENGTHS[data[n]] if n and len(data) > n else 0
        if not m or len(data) < n + m:
            raise Malformed(f"element header at {at}")
        name, size = int.from_bytes(data[:n], "big"), int.from_bytes(data[n : n + m], "big") & VALUES[m]
        if name in ends:
            return
        body, unknown = at + n + m, size == VALUES[m]
        stop = end if unknown else body + size
        if stop > end:
            raise Malformed(f"element 0x{name:X} at {at} goes beyond its parent")
        if unknown and name == CLUSTER:
            stop = end_of_open(s, body, end)
        yield name, body, stop
        at = stop


def end_of_open(s: Source, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next top element, or the end."""
    for _, _, at in elements(s, at, end, CLUSTER):
        pass
    return at


def number(s: Source, at: int, end: int) -> int:
    return int.from_bytes(s.read(at, min(8, end - at)), "big")


def real(s: Source, at: int, end: int) -> float:
    data = s.read(at, min(8, end - at))
    return struct.unpack({4: ">f", 8: ">d"}[len(data)], data)[0] if len(data) in (4, 8) else 0.0


def track_of(s: Source, at: int, end: int) -> Track:
    """What an entry tells; files of one origin have many equal ones, each of which is walked once."""
    if end - at <= ENTRY:
        try:
            return _known_track(s.read(at, end - at))
        except Malformed:
            pass  # again, for the place in the file
    return _walked_track(s, at, end)


@lru_cache(8192)
def _known_track(entry: bytes) -> Track:
    return _walked_track(binwalk.Held(entry), 0, len(entry))


def _walked_track(s: Source, at: int, end: int) -> Track:
    t = Track()
    for name, b, e in elements(s, at, end):
        if name == TRACK_NUMBER:
            t.number = number(s, b, e)
        elif name == TRACK_TYPE:
            t.type = number(s, b, e)
        elif name == CODEC_ID:
            t.codec = s.read(b, e - b).rstrip(b"\0").decode("latin-1")
        elif name == CODEC_PRIVATE:
            t.private = s.read(b, e - b)
        elif name == DEFAULT_DURATION:
            t.default_duration_ns = number(s, b, e) or None
        elif name in (VIDEO, AUDIO):
            for inner, x, y in elements(s, b, e):
                if inner == PIXEL_WIDTH:
                    t.width = number(s, x, y)
                elif inner == PIXEL_HEIGHT:
                    t.height = number(s, x, y)
                elif inner == ALPHA_MODE:
                    t.alpha = number(s, x, y) != 0
                elif inner == SAMPLING:
                    t.rate = real(s, x, y)
                elif inner == CHANNELS:
                    t.channels = number(s, x, y)
    return t


def frames_of(s: Source, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, time code and flags of a block, and (begin, size) of its frames, whatever their lacing."""
    data = s.read(at, 12)
    n = LENGTHS[data[0]] if data else 0
    if not n or len(data) < n + 3:
        raise Malformed(f"block header at {at}")
    track = int.from_bytes(data[:n], "big") & VALUES[n]
    time, flags = int.from_bytes(data[n : n + 2], "big", signed=True), data[n + 2]
    at += n + 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, flags, [(at, end - at)]
    count = int.from_bytes(s.read(at, 1), "big") + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:  # sums of bytes, the last of which isn't 255
        for _ in range(count - 1):
            size = 0
            while True:
                x = s.read(at, 1)
                if not x:
                    raise Malformed(f"lacing at {at}")
                at, size = at + 1, size + x[0]
                if x[0] != 255:
                    break
            sizes.append(size)
    elif lacing == 3:  # the first size, then signed differences
        for i in range(count - 1):
            x = vint(s, at, False)
            if not x:
                raise Malformed(f"lacing at {at}")
            at += x[1]
            sizes.append(x[0] if not i else sizes[-1] + x[0] - ((1 << (7 * x[1] - 1)) - 1))
    else:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or (lacing == 2 and sizes[-1] != sizes[0]):
        raise Malformed(f"lacing of the block that ends at {end}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, flags, out


def segment_of(s: Source) -> Iterator[tuple[int, int, int]]:
    """Elements of the first segment."""
    for name, b, e in elements(s, 0, s.size):
        if name == binwalk.SEGMENT:
            yield from elements(s, b, e, binwalk.SEGMENT)
            return
    raise Malformed("no segment")


def header_of(s: Source) -> Header:
    """Document type, times and tracks; clusters are passed over."""
    h = Header(binwalk.doc_type(s))
    if h.doc_type is None:
        raise Malformed("no EBML header")
    ticks = 0.0
    for name, b, e in segment_of(s):
        if name == INFO:
            for inner, x, y in elements(s, b, e):
                if inner == TIMECODE_SCALE:
                    h.scale = number(s, x, y)
                elif inner == DURATION:
                    ticks = real(s, x, y)
        elif name == TRACKS:
            for inner, x, y in elements(s, b, e):
                if inner == TRACK_ENTRY:
                    t = track_of(s, x, y)
                    h.tracks[t.number] = t
        elif name == CLUSTER and h.tracks:
            break
    h.duration_ns = round(ticks * h.scale)
    return h


@dataclass(slots=True)
class Frame:
    track: int
    pts_ns: int
    key: bool
    at: int
    size: int
    alpha: tuple[int, int] | None = None


def packets_of(s: Source, h: Header) -> Iterator[Frame]:
    """All packets in the order of the file. Frames laced into one block are a default duration apart."""
    for name, b, e in segment_of(s):
        if name != CLUSTER:
            continue
        base = 0
        for inner, x, y in elements(s, b, e, CLUSTER):
            if inner == TIMECODE:
                base = number(s, x, y)
                continue
            block, key, alpha = None, True, None
            if inner == SIMPLE_BLOCK:
                block = (x, y)
            elif inner == BLOCK_GROUP:
                for part, p, q in elements(s, x, y):
                    if part == BLOCK:
                        block = (p, q)
                    elif part == REFERENCE:
                        key = False
                    elif part == ADDITIONS:
                        alpha = alpha_of(s, p, q) or alpha
            if block:
                track, time, flags, frames = frames_of(s, *block)
                step = (h.tracks[track].default_duration_ns if track in h.tracks else None) or 0
                for i, (at, size) in enumerate(frames):
                    yield Frame(track, (base + time) * h.scale + i * step, bool(flags & 0x80) if inner == SIMPLE_BLOCK else key, at, size, alpha)


def alpha_of(s: Source, at: int, end: int) -> tuple[int, int] | None:
    """(begin, size) of the additional data with number 1: the alpha plane."""
    for name, b, e in elements(s, at, end):
        if name == MORE:
            own, data = 1, None
            for inner, x, y in elements(s, b, e):
                if inner == ADD_ID:
                    own = number(s, x, y)
                elif inner == ADDITIONAL:
                    data = (x, y - x)
            if own == 1 and data:
                return data
    return None


# ---- rows

STRUCTURE = f"path string, length long, kind string, checks {binwalk.CHECKS}"
TRACK_ROWS = "path string, container string, duration_s double, track long, type string, codec string, private binary, default_duration_ns long, width long, height long, alpha boolean, rate double, channels long, error string"
PACKET_ROWS = "path string, seq long, track long, pts_ns long, keyframe boolean, at long, size long, alpha_at long, alpha_size long, data binary, error string"
MEDIA_ROWS = f"{PACKET_ROWS}, container string, type string, codec string"
TYPES = {1: "video", 2: "audio", 17: "subtitle"}


def structure_rows(path: str, s: Source | None, _: bool = False) -> Iterator[tuple]:
    kind, found = binwalk.walked(s)
    yield path, s.size if s else None, kind, binwalk.as_structs(found)


def track_rows(path: str, s: Source | None, _: bool = False) -> Iterator[tuple]:
    """One row per track; one with an error where there is no header."""
    try:
        if s is None:
            raise Malformed("unreadable")
        h = header_of(s)
    except Malformed as e:
        yield (path, *[None] * 12, str(e))
        return
    for t in h.tracks.values():
        yield path, "webm" if h.doc_type == "webm" else "matroska", h.duration_ns / 1e9, t.number, TYPES.get(t.type, "other"), t.codec, t.private, t.default_duration_ns, t.width, t.height, t.alpha, t.rate, t.channels, None


def packet_rows(path: str, s: Source | None, with_data: bool = False) -> Iterator[tuple]:
    """One row per packet, up to where the file is malformed; a last row tells the error."""
    seq = 0
    try:
        if s is None:
            raise Malformed("unreadable")
        for f in packets_of(s, header_of(s)):
            yield path, seq, f.track, f.pts_ns, f.key, f.at, f.size, *(f.alpha or (None, None)), s.read(f.at, f.size) if with_data else None, None
            seq += 1
    except Malformed as e:
        yield (path, seq, *[None] * 8, str(e))


def media_rows(path: str, s: Source | None, with_data: bool = False) -> Iterator[tuple]:
    """The rows of packet_rows with what the same walk's header tells of their tracks; packets of a track that it doesn't tell are counted, but left out."""
    seq = 0
    try:
        if s is None:
            raise Malformed("unreadable")
        h = header_of(s)
        container, read = "webm" if h.doc_type == "webm" else "matroska", s.read
        told = {t.number: (None, container, TYPES.get(t.type, "other"), t.codec) for t in h.tracks.values()}
        for f in packets_of(s, h):
            if f.track in told:
                yield path, seq, f.track, f.pts_ns, f.key, f.at, f.size, *(f.alpha or (None, None)), read(f.at, f.size) if with_data else None, *told[f.track]
            seq += 1
    except Malformed as e:
        yield (path, seq, *[None] * 8, str(e), None, None, None)


TABLES = {"structure": (STRUCTURE, structure_rows), "tracks": (TRACK_ROWS, track_rows), "packets": (PACKET_ROWS, packet_rows), "media": (MEDIA_ROWS, media_rows)}
AT_ONCE = 4096


ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), binwalk.CHECKS: binwalk.CHECKS_ARROW}


def arrow_schema(ddl: str, path: pa.DataType) -> pa.Schema:
    """Workers have no session that could parse it; path is of the given type."""
    pairs = [x.split(" ", 1) for x in ddl.split(", ")]
    return pa.schema([("path", path), *[(n, ARROW[t]) for n, t in pairs[1:]]])


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most AT_ONCE rows, or 8 MB of bytes."""
    held, size = [], 0
    blobs = [i for i, t in enumerate(schema.types) if pa.types.is_binary(t)]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        for i in blobs:
            size += len(r[i] or b"")
        if len(held) == AT_ONCE or size > 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options.get("table", "structure")
        self.each, self.with_data = int(options.get("filespertask", "16")), options.get("data", "false").lower() == "true"

    def partitions(self) -> list[Files]:
        """Names only are listed here; files are opened in tasks."""
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        names = [root] if info.type == fs.FileType.File else sorted(x.path for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File)
        return [Files(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        ddl, rows = TABLES[self.table]

        def every() -> Iterator[tuple]:
            for name in partition.paths:
                try:
                    opened = store.open_input_file(name)
                except OSError:
                    yield from rows(name, None)
                    continue
                with opened:
                    yield from rows(name, binwalk.Seekable(opened), self.with_data)

        yield from batched(every(), arrow_schema(ddl, pa.string()))


class Containers(DataSource):
    """Options: path (a file or folder), table (structure, tracks, packets, media: packets with their tracks), filesPerTask, data (packets with their bytes)."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "structure")][0]

    def reader(self, schema) -> ContainerReader:
        return ContainerReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, table: str = "structure", **options) -> DataFrame:
    spark.dataSource.register(Containers)
    return spark.read.format("containers").options(table=table, **{k: str(v) for k, v in options.items()}).load(path)


def demuxed(rows: DataFrame, table: str, with_data: bool = False) -> DataFrame:
    """As read(), of rows (path, content) of bytes; path may be of any type."""
    ddl, make = TABLES[table]
    ddl = ddl.replace("path string", f"path {rows.schema['path'].dataType.simpleString()}", 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = ((path, binwalk.Held(content.as_buffer()) if content.is_valid else None) for path, content in zip(b.column("path").to_pylist(), b.column("content")))
            yield from batched((row for path, s in of for row in make(path, s, with_data)), arrow_schema(ddl, b.column("path").type))

    return rows.select("path", "content").mapInArrow(scan, ddl)


def track_packets(tracks: DataFrame, packets: DataFrame) -> DataFrame:
    """Packets with the codec and type of their track; packets of a track that isn't told are left out.

    Both tables hold many files, so both are keyed by file and track; Spark splits a file with most packets.
    """
    told = tracks.where("error is null").select("path", "track", "container", "type", "codec")
    return packets.where("error is null").join(told, ["path", "track"])
