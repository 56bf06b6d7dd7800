"""Structure checks of containers: what bytes claim to be, and whether their parts chain to the end.

A walk reads through a Source, which gives bytes at a place: of a value in a row, or of a file that is
opened for seeks. Headers are all that is read, but for the checksums of a PNG, which take its bytes
in pieces. A walk never raises for what the bytes say; it tells it.
"""

from __future__ import annotations

import zlib
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Check = tuple[str, str, str | None]

#: Types of first boxes, brands of images (fixed values of the format).
FIRST_BOXES = ["ftyp", "styp", "moov", "mdat", "free", "skip", "wide", "pnot"]
IMAGE_BRANDS = ["heic", "heix", "mif1", "msf1", "avif", "avis"]
#: Element names of the format (fixed values).
EBML_HEADER, DOC_TYPE, SEGMENT = 0x1A45DFA3, 0x4282, 0x18538067
PIECE = 1 << 20


class Source(Protocol):
    size: int

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from at; fewer at the end."""


class Held:
    """A Source of bytes in memory; few bytes are copied once, since slices of them take less time."""

    def __init__(self, data: bytes):
        self.data, self.size = bytes(data) if len(data) <= PIECE else memoryview(data), len(data)

    def read(self, at: int, n: int) -> bytes:
        return bytes(self.data[at : at + n])


class Seekable:
    """A Source of an open file; told counts the bytes that were read."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.told = file, file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(max(0, min(n, self.size - at)))
        self.told += len(out)
        return out


def sniff(head: bytes) -> str:
    """Kind by the first bytes, never by a name; at least 12 are needed."""
    if len(head) < 12:
        return "unknown"
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if head.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if head.startswith(b"\x1a\x45\xdf\xa3"):
        return "ebml"
    if head[4:8].decode("latin-1") in FIRST_BOXES:
        return "isobmff"
    for magic, kind in ((b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff")):
        if head.startswith(magic):
            return kind
    if head.startswith(b"RIFF"):
        return "webp" if head[8:12] == b"WEBP" else "avi" if head[8:11] == b"AVI" else "unknown"
    return "unknown"


def sniffed(content: Column) -> Column:
    """sniff(), as an expression."""
    h = F.hex(F.substring(content, 1, 16))
    at = lambda pos, text: F.substring(h, 2 * pos + 1, 2 * len(text)) == text.encode().hex().upper()
    return (
        F.when(content.isNull() | (F.length(content) < 12), "unknown")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("1A45DFA3"), "ebml")
        .when(F.substring(h, 9, 8).isin([x.encode().hex().upper() for x in FIRST_BOXES]), "isobmff")
        .when(at(0, "GIF8"), "gif")
        .when(at(0, "BM"), "bmp")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff")
        .when(at(0, "RIFF") & at(8, "WEBP"), "webp")
        .when(at(0, "RIFF") & at(8, "AVI"), "avi")
        .otherwise("unknown")
    )


def isobmff(s: Source) -> list[Check]:
    """Top boxes must chain to the end exactly; media data needs a moov, an image brand a meta."""
    at, kinds, image = 0, [], False

    def failed(why: str) -> list[Check]:
        return [("box-chain", "failed", why)]

    while at < s.size:
        head = s.read(at, 16)
        if len(head) < 8:
            return failed(f"truncated: the last {s.size - at} bytes are not a box")
        size, kind, own = int.from_bytes(head[:4], "big"), head[4:8].decode("latin-1"), 8
        if not all(" " <= x <= "~" for x in kind):
            return failed(f"invalid box type at {at}")
        if size == 1:
            if len(head) < 16:
                return failed(f"unreadable 64-bit size of box '{kind}' at {at}")
            size, own = int.from_bytes(head[8:16], "big"), 16
        elif size == 0:
            size = s.size - at
        if size < own:
            return failed(f"box '{kind}' at {at} declares {size} bytes, less than its header")
        if at + size > s.size:
            return failed(f"truncated: box '{kind}' at {at} declares {size} bytes, the file ends {at + size - s.size} short")
        if kind == "ftyp" and len(head) >= 12:
            image = head[8:12].decode("latin-1") in IMAGE_BRANDS
        kinds.append(kind)
        at += size
    out: list[Check] = [("box-chain", "passed", f"{len(kinds)} boxes chain to the end")]
    if image:
        out.append(("meta-present", "passed", None) if "meta" in kinds else ("meta-present", "failed", "an image without a meta box"))
    elif "mdat" in kinds or "moof" in kinds:
        out.append(("moov-present", "passed", None) if "moov" in kinds else ("moov-present", "failed", "media data without a moov box"))
    return out


def png(s: Source) -> list[Check]:
    """Every chunk has its checksum, IHDR is first, IEND last and at the end."""
    at, kinds, first, n = 8, "none", "none", 0

    def failed(why: str) -> list[Check]:
        return [("png-chunks", "failed", why)]

    while at < s.size:
        if s.size - at < 12:
            return failed(f"truncated: the last {s.size - at} bytes are not a chunk")
        head = s.read(at, 8)
        size, kind = int.from_bytes(head[:4], "big"), head[4:].decode("latin-1")
        if not (kind.isascii() and kind.isalpha()):
            return failed(f"invalid chunk type at {at}")
        if size > 0x7FFFFFFF or at + 12 + size > s.size:
            return failed(f"truncated: chunk '{kind}' at {at} declares {size} bytes, the file ends first")
        crc = zlib.crc32(head[4:])
        for piece in range(at + 8, at + 8 + size, PIECE):
            crc = zlib.crc32(s.read(piece, min(PIECE, at + 8 + size - piece)), crc)
        if crc != int.from_bytes(s.read(at + 8 + size, 4), "big"):
            return failed(f"CRC mismatch in chunk '{kind}' at {at}")
        first, kinds, n, at = (kind if not n else first), kind, n + 1, at + 12 + size
    if first != "IHDR":
        return failed(f"the first chunk is '{first}', not IHDR")
    if kinds != "IEND":
        return failed(f"truncated: the last chunk is '{kinds}', not IEND")
    return [("png-chunks", "passed", f"{n} chunks with their checksums")]


def jpeg(s: Source) -> list[Check]:
    """The end marker lies in the last 4 KB; what follows it is allowed."""
    window = min(4096, s.size)
    if b"\xff\xd9" in s.read(s.size - window, window):
        return [("jpeg-eoi", "passed", "end marker present")]
    return [("jpeg-eoi", "failed", f"truncated: no EOI marker in the last {window} bytes")]


#: By first byte the length of a variable-size number, 0 for none; by length the bits of its value.
LENGTHS, VALUES = [9 - x.bit_length() if x else 0 for x in range(256)], [(1 << 7 * n) - 1 for n in range(9)]


def vint(s: Source, at: int, keep_marker: bool) -> tuple[int, int, bool] | None:
    """Value, length and whether it says unknown, of a variable-size number; None where it is cut off or has no marker."""
    data = s.read(at, 8)
    n = LENGTHS[data[0]] if data else 0
    if not n or len(data) < n:
        return None
    value = int.from_bytes(data[:n], "big")
    bare = value & VALUES[n]
    return (value if keep_marker else bare), n, not keep_marker and bare == VALUES[n]


def ebml(s: Source, most: int = 2_000_000) -> list[Check]:
    """Elements must fit; a Segment is entered, any other of unknown size ends the walk, as does the cap."""
    at, n, stopped = 0, 0, ""

    def failed(why: str) -> list[Check]:
        return [("ebml-elements", "failed", why)]

    while at < s.size and n < most:
        name = vint(s, at, True)
        if not name:
            return failed(f"invalid element ID at {at}")
        size = vint(s, at + name[1], False)
        if not size:
            return failed(f"invalid element size at {at}")
        body, n = at + name[1] + size[1], n + 1
        if size[2]:
            if name[0] != SEGMENT:
                stopped = f", stopped at 0x{name[0]:X} of unknown size"
                break
        elif body + size[0] > s.size:
            return failed(f"truncated: element 0x{name[0]:X} at {at} declares {size[0]} bytes, the file ends {body + size[0] - s.size} short")
        at = body if name[0] == SEGMENT else body + size[0]
    return [("ebml-elements", "passed", f"{n} elements" + stopped)]


WALKS = {"isobmff": isobmff, "png": png, "jpeg": jpeg, "ebml": ebml}
CHECKS = "array<struct<name:string,outcome:string,detail:string>>"
CHECKS_ARROW = pa.list_(pa.struct([("name", pa.string()), ("outcome", pa.string()), ("detail", pa.string())]))


def walked(s: Source | None) -> tuple[str, list[Check]]:
    """Kind and checks; None or no bytes: it can't be read, and nothing is known."""
    if s is None or not s.size:
        return "unknown", [("readable", "failed", "missing, empty or unreadable")]
    kind, passed = sniff(s.read(0, 16)), ("readable", "passed", None)
    if kind in WALKS:
        return kind, [passed, *WALKS[kind](s)]
    if kind == "unknown":
        return kind, [passed, ("magic", "skipped", "unknown first bytes")]
    return kind, [passed, ("magic", "passed", f"{kind}: recognised, there is no walk")]


def as_structs(found: list[Check]) -> list[dict]:
    return [dict(zip(("name", "outcome", "detail"), x)) for x in found]


def checks(content: Column) -> Column:
    """The checks of bytes in rows, readable among them."""

    @F.arrow_udf(CHECKS)
    def walk(contents: pa.Array) -> pa.Array:
        return pa.array([as_structs(walked(Held(c.as_buffer()) if c.is_valid else None)[1]) for c in contents], CHECKS_ARROW)

    return walk(content)


def doc_type(s: Source) -> str | None:
    """DocType of an EBML header; None without one."""
    name, size = vint(s, 0, True), vint(s, 4, False)
    if not name or name[0] != EBML_HEADER or not size:
        return None
    at, end = name[1] + size[1], s.size if size[2] else min(s.size, name[1] + size[1] + size[0])
    while at < end:
        name = vint(s, at, True)
        size = name and vint(s, at + name[1], False)
        if not name or not size or size[2]:
            return None
        at += name[1] + size[1]
        if name[0] == DOC_TYPE:
            return s.read(at, min(size[0], end - at)).rstrip(b"\0").decode("latin-1")
        at += size[0]
    return None


def gif_frames(s: Source) -> int:
    """Images in a GIF, by its blocks; 0 if it isn't one or is cut off before the first."""
    head = s.read(0, 13)
    if len(head) < 13 or head[:6] not in (b"GIF87a", b"GIF89a"):
        return 0
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at, n = 13 + table(head[10]), 0
    while at < s.size:
        kind = s.read(at, 10)
        if kind[:1] == b"\x21":
            at += 2
        elif kind[:1] == b"\x2c" and len(kind) == 10:
            at, n = at + 10 + table(kind[9]) + 1, n + 1
        else:
            break
        while size := s.read(at, 1):  # blocks of data, up to an empty one
            at += 1 + size[0]
            if not size[0]:
                break
    return n


# ---- CRC-32 that is summed in parts


def crc_shifts(levels: int = 36) -> list[list[int]]:
    """For each level k what 2^k zero bytes after it make of each single bit of a checksum."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit: the polynomial, and a shift

    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    square = lambda m: [times(m, x) for x in m]
    for _ in range(3):
        step = square(step)
    out = [step]
    while len(out) < levels:
        out.append(square(out[-1]))
    return out


def crc_followed(crc: Column, after: Column) -> Column:
    """What a part's CRC-32 adds to that of the whole, if so many bytes follow it; these are put together by bit_xor."""
    levels = F.array(*[F.array(*[F.lit(x).cast("long") for x in m]) for m in crc_shifts()])

    def moved(c: Column, k: Column) -> Column:
        m = F.get(levels, k)
        bits = F.sequence(F.lit(0), F.lit(31))
        shifted = F.aggregate(bits, F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.when(F.getbit(c, i) == 1, F.get(m, i)).otherwise(F.lit(0).cast("long"))))
        return F.when(F.getbit(after, k) == 1, shifted).otherwise(c)

    return F.aggregate(F.sequence(F.lit(0), F.lit(35)), crc.cast("long"), moved)


def chunked_crc(rows, key: str, content: str, chunk: int = 1 << 16):
    """key, crc, n_chunks: the CRC-32 of each row's bytes (null: none), summed over chunks that are dealt out; key must tell rows apart."""
    n = F.octet_length(content).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")), F.lit(chunk).cast("long"))
    parts = rows.select(key, F.col(content).alias("_of"), n.alias("_n"), F.explode(starts).alias("_at"))
    part = F.substring("_of", (F.col("_at") + 1).cast("int"), F.lit(chunk))
    after = F.greatest(F.col("_n") - F.col("_at") - chunk, F.lit(0).cast("long"))
    return parts.select(key, crc_followed(F.crc32(part), after).alias("_c")).groupBy(key).agg(F.bit_xor("_c").alias("crc"), F.count("*").alias("n_chunks"))


# ---- decoder configuration


def nal_length_size(private: bytes, hevc: bool) -> int:
    """Bytes of a unit's length, from the decoder configuration record."""
    at, least = (21, 23) if hevc else (4, 7)
    if len(private) < least:
        raise ValueError("malformed configuration")
    return (private[at] & 3) + 1


def parameter_sets(private: bytes, hevc: bool) -> list[bytes]:
    """Parameter sets of an avcC or hvcC record, in order."""

    def unit(at: int) -> tuple[bytes, int]:
        if at + 2 > len(private):
            raise ValueError("malformed configuration")
        n = int.from_bytes(private[at : at + 2], "big")
        if at + 2 + n > len(private):
            raise ValueError("malformed configuration")
        return private[at + 2 : at + 2 + n], at + 2 + n

    nal_length_size(private, hevc)
    out = []
    if hevc:
        at = 23
        for _ in range(private[22]):
            n, at = int.from_bytes(private[at + 1 : at + 3], "big"), at + 3
            for _ in range(n):
                one, at = unit(at)
                out.append(one)
        return out
    at = 5
    for mask in (0x1F, 0xFF):
        if at >= len(private):
            raise ValueError("malformed configuration")
        n, at = private[at] & mask, at + 1
        for _ in range(n):
            one, at = unit(at)
            out.append(one)
    return out
