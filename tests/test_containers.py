"""Structure checks and Matroska tables: hand-made bytes, files of every kind, by seeks and in rows."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import binwalk
from reelgrid.operators import policy
from reelgrid.plans import container_queries
from reelgrid.sources import containers, files


def box(kind, body=b"", size=None):
    return struct.pack(">I4s", len(body) + 8 if size is None else size, kind) + body


def chunk(kind, data=b""):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def el(name, body, unknown=False):
    name = bytes.fromhex(name)
    return name + (b"\x01" + b"\xff" * 7 if unknown else (len(body) | 1 << 56).to_bytes(8, "big")) + body


FTYP, MOOV, MDAT = box(b"ftyp", b"isom"), box(b"moov"), box(b"mdat", b"x" * 100)
PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"abc" * 9) + chunk(b"IEND")
JPEG = b"\xff\xd8\xff\xe0" + b"x" * 20 + b"\xff\xd9"
#: A header, a segment of 5 bytes and an empty element in it.
EBML = bytes.fromhex("1A45DFA38400000000" + "1853806785" + "1549A96680")


def judged(data):
    kind, found = binwalk.walked(binwalk.Held(data) if data is not None else None)
    made = [x for x in found if x[0] != "readable"]
    verdict = "corrupt" if any(x[1] == "failed" for x in made) else "intact" if any(x[1] != "skipped" for x in made) else "unverified"
    return kind, verdict, next((x[2] for x in found if x[1] == "failed"), None)


@pytest.mark.parametrize(("data", "kind", "verdict", "why"), [
    (FTYP + MDAT + MOOV, "isobmff", "intact", None),
    ((FTYP + MDAT + MOOV)[:-20], "isobmff", "corrupt", "truncated"),
    (FTYP + MDAT + MOOV[:-3], "isobmff", "corrupt", "not a box"),
    (FTYP + MDAT, "isobmff", "corrupt", "moov"),
    (FTYP + box(b"moof"), "isobmff", "corrupt", "moov"),
    (FTYP, "isobmff", "intact", None),
    (MDAT + box(b"meta"), "isobmff", "corrupt", "moov"),
    (box(b"ftyp", b"heic") + MDAT, "isobmff", "corrupt", "meta"),
    (box(b"ftyp", b"avis") + MDAT + box(b"meta"), "isobmff", "intact", None),
    (box(b"styp", b"abcd") + MOOV + box(b"mdat", b"abc", 0), "isobmff", "intact", None),
    (MOOV + struct.pack(">I4sQ", 1, b"mdat", 19) + b"abc", "isobmff", "intact", None),
    (MOOV + struct.pack(">I4sQ", 1, b"mdat", 15) + b"abc", "isobmff", "corrupt", "less than its header"),
    (MOOV + struct.pack(">I4s", 1, b"mdat"), "isobmff", "corrupt", "64-bit"),
    (MOOV + box(b"\0\1\2\3", b"abcd"), "isobmff", "corrupt", "invalid box type"),
    *[(box(k, b"abcd") + MOOV, "isobmff", "intact", None) for k in (b"free", b"skip", b"wide", b"pnot", b"moov")],
    (PNG, "png", "intact", None),
    (PNG.replace(b"abcabc", b"abXabc", 1), "png", "corrupt", "CRC mismatch"),
    (PNG[: len(PNG) * 3 // 5], "png", "corrupt", "truncated"),
    (PNG[:-12], "png", "corrupt", "not IEND"),
    (PNG + b"x", "png", "corrupt", "not a chunk"),
    (PNG[:8] + chunk(b"IDAT") + chunk(b"IEND"), "png", "corrupt", "not IHDR"),
    (PNG[:8] + chunk(b"I-DR"), "png", "corrupt", "invalid chunk type"),
    (PNG[:8] + b"\xff\xff\xff\xffIHDR" + b"x" * 30, "png", "corrupt", "declares"),
    (JPEG, "jpeg", "intact", None),
    (JPEG + b"t" * 4000, "jpeg", "intact", None),
    (JPEG + b"t" * 5000, "jpeg", "corrupt", "EOI"),
    (JPEG[:-1], "jpeg", "corrupt", "EOI"),
    (EBML, "ebml", "intact", None),
    (EBML[:-2], "ebml", "corrupt", "invalid|truncated"),
    (EBML[:9] + bytes.fromhex("18538067FF") + EBML[14:], "ebml", "intact", None),
    (EBML[:9] + bytes.fromhex("18538067FF1F43B675FF") + b"\0\0", "ebml", "intact", None),
    (EBML + b"\0", "ebml", "corrupt", "invalid element ID"),
    (b"GIF89a" + b"0" * 20, "gif", "intact", None), (b"BM" + b"0" * 20, "bmp", "intact", None), (b"II*\0" + b"0" * 20, "tiff", "intact", None), (b"MM\0*" + b"0" * 20, "tiff", "intact", None),
    (b"RIFF0000WEBP", "webp", "intact", None), (b"RIFF0000AVI ", "avi", "intact", None), (b"RIFF0000AVIX", "avi", "intact", None), (b"RIFF0000WAVE", "unknown", "unverified", None),
    (bytes((i * 37 + 11) % 256 for i in range(1024)), "unknown", "unverified", None),
    (PNG[:11], "unknown", "unverified", None), (b"", "unknown", "unverified", "missing"), (None, "unknown", "unverified", "missing"),
])
def test_walks(spark, data, kind, verdict, why):
    import re

    got = judged(data)
    assert got[:2] == (kind, verdict)
    assert got[2] is None if why is None else re.search(why, got[2])


def test_cap_of_elements_passes():
    assert binwalk.ebml(binwalk.Held(EBML[:9] * 50), most=10)[0][1] == "passed"


def test_files_by_seeks_and_in_rows(spark, tmp_path):
    made = {"a.png": PNG, "lied.png": JPEG, "c.mp4": FTYP + MDAT, "d.mov": FTYP + MDAT + MOOV, "e.bin": b"?" * 40, "empty.mp4": b"", "h.mkv": EBML}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    short = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["kind"], r["verdict"], r["failure"]) for r in df.collect())
    by_seeks = short(files.verified_files(spark, str(tmp_path)))
    assert by_seeks == sorted((n, *judged(d)) for n, d in made.items())
    assert short(files.verified(files.files(spark, str(tmp_path)))) == [x for x in by_seeks if x[0] != "empty.mp4"]  # binaryFile has no row for it
    assert short(files.judged(containers.read(spark, f"{tmp_path}/lied.png"))) == [("lied.png", "jpeg", "intact", None)]
    routes = {r["path"].rsplit("/", 1)[1]: r["container"] for r in files.probed(files.files(spark, str(tmp_path))).collect()}
    assert (routes["d.mov"], routes["c.mp4"], routes["h.mkv"], routes["a.png"]) == ("mov", "mp4", "matroska", "none")


def test_a_file_of_3_gb_is_walked_by_its_headers(spark, tmp_path):
    import pyarrow as pa

    size = 3 << 30
    with open(tmp_path / "large.mp4", "wb") as f:
        f.write(FTYP + struct.pack(">I4sQ", 1, b"mdat", size))
        f.truncate(len(FTYP) + size)
        f.seek(len(FTYP) + size)
        f.write(MOOV)
    with pa.OSFile(str(tmp_path / "large.mp4")) as f:
        s = binwalk.Seekable(f)
        assert [x[1] for x in binwalk.walked(s)[1]] == ["passed"] * 3 and s.told < 200
    r = files.verified_files(spark, str(tmp_path)).first()
    assert r["verdict"] == "intact"


def test_doc_type_is_parsed():
    header = el("1A45DFA3", el("4286", b"\1") + el("4282", b"webm\0"))
    assert binwalk.doc_type(binwalk.Held(header)) == "webm"
    assert binwalk.doc_type(binwalk.Held(el("1A45DFA3", el("4282", b"matroska")) + b"webm")) == "matroska"
    assert binwalk.doc_type(binwalk.Held(b"webm" * 9)) is None and binwalk.doc_type(binwalk.Held(EBML)) is None


def vsize(n, width=1):
    return (n | 1 << 7 * width).to_bytes(width, "big")


def mkv(blocks, unknown=False, track=b""):
    video = el("AE", el("D7", b"\1") + el("83", b"\1") + el("86", b"V_VP9") + el("63A2", b"priv") + el("E0", el("B0", b"\x02\x80") + el("BA", b"\x01\xe0") + el("53C0", b"\1")) + track)
    audio = el("AE", el("D7", b"\2") + el("83", b"\2") + el("86", b"A_OPUS") + el("23E383", (20_000_000).to_bytes(4, "big")) + el("E1", el("B5", struct.pack(">d", 48000)) + el("9F", b"\2")))
    info = el("1549A966", el("2AD7B1", (1_000_000).to_bytes(4, "big")) + el("4489", struct.pack(">f", 1500)))
    clusters = b"".join(el("1F43B675", el("E7", struct.pack(">H", t)) + b, unknown) for t, b in blocks)
    return el("1A45DFA3", el("4282", b"webm")) + el("18538067", info + el("1654AE6B", video + audio) + clusters, unknown)


def laced(kind, frames, time=0, track=2):
    head, body = bytes([0x80 | track]) + struct.pack(">hB", time, kind << 1 | 0x80), b"".join(frames)
    if kind == 0:
        return el("A3", head + body)
    sizes = b""
    if kind == 1:
        for f in frames[:-1]:
            sizes += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        sizes = vsize(len(frames[0]), 2) if len(frames) > 1 else b""  # the last size is never told
        for a, b in zip(frames, frames[1:-1]):
            sizes += vsize(len(b) - len(a) + (1 << 13) - 1, 2)
    return el("A3", head + bytes([len(frames) - 1]) + sizes + body)


@pytest.mark.parametrize("unknown", [False, True])
@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_every_lacing(spark, tmp_path, kind, unknown):
    r = random.Random(kind)
    want, blocks, seq = [], [], 0
    for cluster in range(4):
        body = b""
        for b in range(5):
            n = 1 if kind == 0 else r.randrange(1, 6)
            size = r.randrange(1, 700)
            frames = [r.randbytes(size if kind == 2 else r.randrange(1, 700)) for _ in range(n)]
            body += laced(kind, frames, b - 2)
            for i, f in enumerate(frames):
                want.append((seq, 2, (cluster * 1000 + b - 2) * 1_000_000 + i * 20_000_000, True, f, "A_OPUS"))
                seq += 1
        blocks.append((cluster * 1000, body))
    (tmp_path / "a.webm").write_bytes(mkv(blocks, unknown))
    for tracks, packets in (
        (containers.read(spark, str(tmp_path), "tracks"), containers.read(spark, str(tmp_path), "packets", data=True)),
        tuple(containers.demuxed(files.files(spark, str(tmp_path)), t, True) for t in ("tracks", "packets")),
    ):
        got = sorted((x["seq"], x["track"], x["pts_ns"], x["keyframe"], bytes(x["data"]), x["codec"]) for x in containers.track_packets(tracks, packets).collect())
        assert got == want


def test_groups_alpha_and_tracks(spark):
    group = el("A0", el("A1", b"\x81\0\5\0frame") + el("FB", b"\1") + el("75A1", el("A6", el("EE", b"\1") + el("A5", b"alpha plane"))))
    rows = spark.createDataFrame([("a", bytearray(mkv([(10, group + el("EC", b"zzz"))])))], "path string, content binary")
    p = containers.demuxed(rows, "packets", True).collect()
    assert [(x["track"], x["pts_ns"], x["keyframe"], bytes(x["data"]), x["alpha_size"]) for x in p] == [(1, 15_000_000, False, b"frame", 11)]
    t = {x["track"]: x for x in containers.demuxed(rows, "tracks").collect()}
    assert (t[1]["type"], t[1]["codec"], bytes(t[1]["private"]), t[1]["width"], t[1]["height"], t[1]["alpha"]) == ("video", "V_VP9", b"priv", 640, 480, True)
    assert (t[2]["rate"], t[2]["channels"], t[2]["default_duration_ns"], t[2]["container"], t[2]["duration_s"]) == (48000.0, 2, 20_000_000, "webm", 1.5)


def test_malformed_files_are_told(spark):
    good = mkv([(0, laced(0, [b"x"])), (1, laced(1, [b"a", b"b"]))])
    rows = spark.createDataFrame([("cut", bytearray(good[:-4])), ("none", None), ("junk", bytearray(b"junk" * 9)), ("lace", bytearray(mkv([(0, el("A3", b"\x82\0\0\x02\x05\xff"))])))], "path string, content binary")
    errors = {r["path"]: r["error"] for r in containers.demuxed(rows, "packets").where("error is not null").collect()}
    assert set(errors) == {"cut", "none", "junk", "lace"}
    assert containers.demuxed(rows, "tracks").where("path in ('none', 'junk') and error is null").isEmpty()


def test_chunked_crc_is_that_of_the_whole(spark, sf):
    got = {r["doc_id"]: r["crc"] for r in container_queries.chunked_crc32(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in rows}
    long = spark.createDataFrame([(1, bytearray(b"0123456789" * 300_000)), (2, bytearray(b""))], "k int, t binary")
    assert {r["k"]: (r["crc"], r["n_chunks"]) for r in binwalk.chunked_crc(long, "k", "t").collect()} == {1: (zlib.crc32(b"0123456789" * 300_000), 46), 2: (0, 1)}


def test_gif_blocks():
    assert binwalk.gif_frames(binwalk.Held(b"GIF89a\1\0\1\0\0\0\0" + b"\x2c" + b"\0" * 9 + b"\2\1x\0" + b"\x3b")) == 1
    assert binwalk.gif_frames(binwalk.Held(b"GIF80a" + b"\0" * 20)) == 0 == binwalk.gif_frames(binwalk.Held(b""))


def test_readable_alone_says_nothing(spark):
    one = lambda name, outcome: F.array(F.struct(F.lit(name).alias("name"), F.lit(outcome).alias("outcome"), F.lit("why").alias("detail")))
    row = spark.range(1).select(policy.verdict(one("readable", "failed")), policy.verdict(one("magic", "skipped")), policy.verdict(one("magic", "passed")), policy.first_failure(one("x", "failed"))).first()
    assert tuple(row) == ("unverified", "unverified", "intact", "why")


def test_media_equals_tables_joined(spark):
    """One walk gives what the tables of tracks and packets give when joined: of whole, cut and unreadable files, and of packets of no track."""
    good = mkv([(0, laced(0, [b"x"])), (1, laced(1, [b"a", b"b"])), (2, el("A3", b"\x85\0\0\0none") + laced(0, [b"y"]))])
    rows = spark.createDataFrame([("good", bytearray(good)), ("cut", bytearray(good[:-4])), ("none", None), ("junk", bytearray(b"junk" * 9))], "path string, content binary")
    columns = "path", "seq", "track", "pts_ns", "keyframe", "at", "size", "data", "container", "type", "codec"
    of = lambda found: sorted(repr(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in found.select(*columns).collect())
    media = containers.demuxed(rows, "media", True)
    want = of(containers.track_packets(containers.demuxed(rows, "tracks"), containers.demuxed(rows, "packets", True)))
    assert want and of(media.where("error is null")) == want
    told = lambda found: sorted((r["path"], r["seq"], r["error"]) for r in found.where("error is not null").collect())
    assert told(media) == told(containers.demuxed(rows, "packets"))
