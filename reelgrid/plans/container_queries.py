"""Queries over container bytes. The bytes are built from the driver's tables by Spark expressions, so
that the SQL knows, from sizes alone, what the walks must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binwalk
from ..operators import policy
from ..sources import containers, files
from . import views as V
from .registry import query

c = F.col


def be(value: Column | int, n: int) -> Column:
    """A number as n bytes, the highest first."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def raw(text: str | bytes) -> Column:
    return F.lit(text.encode() if isinstance(text, str) else text)


def box(kind: str, body: Column, more: int = 0) -> Column:
    """A box, or one that declares more bytes than it has."""
    return F.concat(be(F.octet_length(body) + 8 + more, 4), raw(kind), body)


def chunk(kind: str, body: Column, wrong: int = 0) -> Column:
    crc = F.crc32(F.concat(raw(kind), body))
    return F.concat(be(F.octet_length(body), 4), raw(kind), body, be((crc + wrong) % (1 << 32), 4))


def element(name: str, body: Column, more: int = 0) -> Column:
    """An element with a size of 8 bytes."""
    return F.concat(F.unhex(F.lit(name)), be(F.octet_length(body).cast("long") + more + (1 << 56), 8), body)


def files_of_texts(spark, sf) -> DataFrame:
    """(id, shape, content): each document's text as the payload of one of 24 files, some of them damaged."""
    d = V.table(spark, sf, "documents").select(c("doc_id").alias("id"), (c("doc_id") % 24).alias("shape"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    t, none = c("t"), raw("")
    ftyp, moov, signature = box("ftyp", raw("isom")), box("moov", none), raw(b"\x89PNG\r\n\x1a\n")
    ihdr, iend = chunk("IHDR", raw(b"\0" * 13)), chunk("IEND", none)
    head, open_segment = element("1A45DFA3", element("4282", raw("webm"))), F.concat(F.unhex(F.lit("18538067")), raw(b"\x01" + b"\xff" * 7))
    shapes = [
        F.concat(ftyp, box("mdat", t), moov),
        F.concat(ftyp, box("mdat", t)),
        F.concat(ftyp, moov, box("mdat", t, 5)),
        ftyp,
        F.concat(box("ftyp", raw("heic")), box("mdat", t)),
        F.concat(box("ftyp", raw("avif")), box("meta", none), box("mdat", t)),
        F.concat(be(1, 4), raw("mdat"), be(F.octet_length(t) + 16, 8), t, moov),
        F.concat(moov, be(0, 4), raw("mdat"), t),
        F.concat(signature, ihdr, chunk("tEXt", t), iend),
        F.concat(signature, ihdr, chunk("tEXt", t, 1), iend),
        F.concat(signature, ihdr, chunk("tEXt", t)),
        F.concat(raw(b"\xff\xd8\xff\xe0JFIF\0\0\0\0"), t, raw(b"\xff\xd9")),
        F.concat(raw(b"\xff\xd8\xff\xe0JFIF\0\0\0\0"), t),
        F.concat(head, element("18538067", element("EC", t))),
        F.concat(head, element("18538067", element("EC", t), 2)),
        F.concat(raw("GIF89a-------"), t),
        F.concat(raw("????????????"), t),
        F.lit(None).cast("binary"),
        F.concat(ftyp, box("\x01\x02\x03\x04", t)),
        F.concat(ftyp, moov, raw("abc")),
        F.concat(signature, ihdr, chunk("te1t", t), iend),
        F.concat(head, open_segment, F.unhex(F.lit("1F43B675")), raw(b"\x01" + b"\xff" * 7), t),
        F.concat(ftyp, box("meta", none), box("mdat", t)),
        F.concat(raw("RIFF\0\0\0\0AVIX"), t),
    ]
    content = F.element_at(F.array(*shapes), 1)
    for k, shape in enumerate(shapes[1:], 1):
        content = F.when(c("shape") == k, shape).otherwise(content)
    return d.select("id", "shape", F.when(c("shape") == 0, shapes[0]).otherwise(content).alias("content"))


@query("""WITH d AS (SELECT doc_id AS id, doc_id % 24 AS shape, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT id, shape, n, CASE WHEN shape IN (0,1,2,3,4,5,6,7,18,19,22) THEN 'isobmff' WHEN shape IN (8,9,10,20) THEN 'png' WHEN shape IN (11,12) THEN 'jpeg' WHEN shape IN (13,14,21) THEN 'ebml' WHEN shape = 15 THEN 'gif' WHEN shape = 23 THEN 'avi' ELSE 'unknown' END AS kind,
  CASE shape WHEN 1 THEN 'media data without a moov box' WHEN 22 THEN 'media data without a moov box' WHEN 4 THEN 'an image without a meta box'
    WHEN 2 THEN 'truncated: box ''mdat'' at 20 declares ' || (n + 13) || ' bytes, the file ends 5 short' WHEN 9 THEN 'CRC mismatch in chunk ''tEXt'' at 33'
    WHEN 10 THEN 'truncated: the last chunk is ''tEXt'', not IEND' WHEN 12 THEN 'truncated: no EOI marker in the last ' || least(4096, n + 12) || ' bytes'
    WHEN 14 THEN 'truncated: element 0x18538067 at 26 declares ' || (n + 11) || ' bytes, the file ends 2 short' WHEN 17 THEN 'missing, empty or unreadable'
    WHEN 18 THEN 'invalid box type at 12' WHEN 19 THEN 'truncated: the last 3 bytes are not a box' WHEN 20 THEN 'invalid chunk type at 33' END AS failure FROM d)
SELECT id, kind, CASE WHEN shape IN (16, 17) THEN 'unverified' WHEN failure IS NULL THEN 'intact' ELSE 'corrupt' END AS verdict, failure,
  CASE shape WHEN 17 THEN 'readable:failed' ELSE 'readable:passed,' || CASE WHEN shape IN (2,18,19) THEN 'box-chain:failed' WHEN shape = 3 THEN 'box-chain:passed' WHEN shape IN (0,6,7) THEN 'box-chain:passed,moov-present:passed' WHEN shape IN (1,22) THEN 'box-chain:passed,moov-present:failed'
    WHEN shape = 4 THEN 'box-chain:passed,meta-present:failed' WHEN shape = 5 THEN 'box-chain:passed,meta-present:passed' WHEN kind = 'png' THEN 'png-chunks:' || CASE WHEN shape = 8 THEN 'passed' ELSE 'failed' END
    WHEN shape = 11 THEN 'jpeg-eoi:passed' WHEN shape = 12 THEN 'jpeg-eoi:failed' WHEN shape = 14 THEN 'ebml-elements:failed' WHEN kind = 'ebml' THEN 'ebml-elements:passed' WHEN shape IN (15, 23) THEN 'magic:passed' ELSE 'magic:skipped' END END AS checks FROM s""")
def structure_checks(spark, sf):
    rows = files.verified(files_of_texts(spark, sf).select(c("id").alias("path"), "content"))
    told = F.array_join(F.transform("checks", lambda x: F.concat_ws(":", x["name"], x["outcome"])), ",")
    return rows.select(c("path").alias("id"), "kind", "verdict", "failure", told.alias("checks"))


@query("WITH v AS (SELECT doc_id % 24 AS s FROM documents) SELECT CASE WHEN s IN (16, 17) THEN 'unverified' WHEN s IN (0, 3, 5, 6, 7, 8, 11, 13, 15, 21, 23) THEN 'intact' ELSE 'corrupt' END AS verdict, count(*) AS n FROM v GROUP BY 1")
def structure_verdicts(spark, sf):
    return files.verified(files_of_texts(spark, sf).select(c("id").alias("path"), "content")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 24 IN (0,1,2,3,4,5,6,7,18,19,22) THEN CASE WHEN doc_id % 2 = 0 THEN 'mov' ELSE 'mp4' END WHEN doc_id % 24 IN (13, 14, 21) THEN 'webm' ELSE 'none' END AS container FROM documents")
def container_probe(spark, sf):
    rows = files_of_texts(spark, sf).select(F.concat(c("id").cast("string"), F.when(c("id") % 2 == 0, ".MOV").otherwise(".bin")).alias("path"), "content")
    return files.probed(rows).select(F.split("path", r"\.")[0].cast("long").alias("id"), "container")


@query()
def chunked_crc32(spark, sf):
    """The CRC-32 of each text, summed over chunks of 1,000 bytes; equal to that of the whole (tests)."""
    d = V.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return binwalk.chunked_crc(d, "doc_id", "t", 1000)


# ---- Matroska


def order_files(spark, sf) -> DataFrame:
    """(path, content): each order's lines as a Matroska file. Video: lines 1, 3, ...; audio: the others, two frames laced into a block."""
    n = c("l_linenumber")
    frame = F.encode(F.concat(F.lit("part "), c("l_partkey").cast("string")), "UTF-8")
    video = element("A3", F.concat(be(0x81, 1), be(n * 40, 2), be(0x80, 1), frame))
    audio = element("A3", F.concat(be(0x82, 1), be(n * 40, 2), be(0x04, 1), be(1, 1), frame, frame))
    block = F.struct(n.alias("n"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_extendedprice").alias("e"), F.when(n % 2 == 1, video).otherwise(audio).alias("b"))
    orders = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    track = lambda number, kind, codec, more: element("AE", F.concat(element("D7", be(number, 1)), element("83", be(kind, 1)), element("86", raw(codec)), element("23E383", be(20_000_000, 4)), more))
    picture = element("E0", F.concat(element("B0", be(c("l_orderkey") % 4096, 2)), element("BA", be(480, 2))))
    tracks = element("1654AE6B", F.concat(track(1, 1, "V_VP9", picture), track(2, 2, "A_OPUS", raw(""))))
    body = F.aggregate("blocks", raw(""), lambda s, x: F.concat(s, x["b"]))
    cluster = element("1F43B675", F.concat(element("E7", be(c("l_orderkey") % 1000, 8)), body))
    header = element("1A45DFA3", element("4282", F.when(c("l_orderkey") % 2 == 0, raw("webm")).otherwise(raw("matroska"))))
    return orders.select(c("l_orderkey").alias("path"), F.concat(header, element("18538067", F.concat(tracks, cluster))).alias("content"))


@query("""SELECT l_orderkey AS path, CASE WHEN l_orderkey % 2 = 0 THEN 'webm' ELSE 'matroska' END AS container, t AS track, CASE t WHEN 1 THEN 'video' ELSE 'audio' END AS type, CASE t WHEN 1 THEN 'V_VP9' ELSE 'A_OPUS' END AS codec,
CASE t WHEN 1 THEN l_orderkey % 4096 END AS width, 50.0::DOUBLE AS fps FROM (SELECT DISTINCT l_orderkey FROM lineitem), (VALUES (1), (2)) AS v(t)""")
def matroska_tracks(spark, sf):
    found = containers.demuxed(order_files(spark, sf), "tracks")
    return found.select("path", "container", "track", "type", "codec", "width", policy.probe_fps(c("default_duration_ns")).alias("fps"))


@query("""WITH l AS (SELECT l_orderkey AS path, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e, unnest(CASE WHEN l_linenumber % 2 = 1 THEN [0] ELSE [0, 1] END) AS i FROM lineitem)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY n, p, s, e, i) - 1 AS seq, CASE WHEN n % 2 = 1 THEN 'V_VP9' ELSE 'A_OPUS' END AS codec, CASE WHEN n % 2 = 1 THEN 'video' ELSE 'audio' END AS type,
  (path % 1000 + n * 40)::BIGINT * 1000000 + i * 20000000 AS pts_ns, n % 2 = 1 AS keyframe, 'part ' || p AS data FROM l""")
def matroska_packets(spark, sf):
    """Packets with what is told of their tracks: each file is built and walked once, and no row of a packet is moved.

    `containers.track_packets` joins the two tables where they come apart.
    """
    found = containers.demuxed(order_files(spark, sf), "media", True).where("error is null")
    return found.select("path", "seq", "codec", "type", "pts_ns", "keyframe", F.decode("data", "UTF-8").alias("data"))


# ---- animations


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 + o_orderkey % 4 END AS frames FROM orders")
def gif_frame_count(spark, sf):
    """Images of GIFs with a table of colours, an extension before each image, and blocks of data."""
    k = c("o_orderkey")
    image = F.concat(raw(b"\x21\xf9\x04\x00\x00\x00\x00\x00"), raw(b"\x2c" + b"\0" * 8 + b"\x80" + b"\1\2\3" * 2 + b"\x02"), be(F.octet_length("o_orderpriority"), 1), F.encode("o_orderpriority", "UTF-8"), raw(b"\0"))
    gif = F.concat(raw(b"GIF89a\x01\0\x01\0\x81\0\0" + b"\7" * 12), F.aggregate(F.sequence(F.lit(0), (k % 4).cast("int")), raw(""), lambda s, _: F.concat(s, image)), raw(b"\x3b"))
    rows = V.table(spark, sf, "orders").select(k.alias("id"), F.when(k % 5 == 0, raw("not an animation")).otherwise(gif).alias("content"))
    return rows.select("id", files.gif_frames(c("content")).alias("frames"))
