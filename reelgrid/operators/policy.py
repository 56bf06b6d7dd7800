"""Rules that classify, route and clamp, as column expressions. Unknown stays unknown (null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codec names of containers.
NATIVE_VIDEO = ["V_MPEG4/ISO/AVC", "V_MPEGH/ISO/HEVC", "V_AV1", "V_MPEG2", "V_MPEG1"]
NATIVE_AUDIO = ["A_OPUS", "A_FLAC", "A_ALAC", "A_AC3", "A_EAC3", "A_MPEG/L1", "A_MPEG/L2", "A_MPEG/L3", "A_PCM/INT/LIT", "A_PCM/INT/BIG", "A_PCM/FLOAT/IEEE"]
DECODABLE_AUDIO = ["A_OPUS", "A_AC3", "A_EAC3", "A_MPEG/L1", "A_MPEG/L2", "A_MPEG/L3"]
# Four-character codes and names of codecs, extensions of containers and of camera formats.
UNIFIED = {"avc1": "V_MPEG4/ISO/AVC", "avc3": "V_MPEG4/ISO/AVC", "hvc1": "V_MPEGH/ISO/HEVC", "hev1": "V_MPEGH/ISO/HEVC", "av01": "V_AV1", "vp09": "V_VP9", "mp4a": "A_AAC", "aac": "A_AAC", "alac": "A_ALAC", "opus": "A_OPUS", "Opus": "A_OPUS", "fLaC": "A_FLAC", "flac": "A_FLAC"}
#: Nominal frames in a packet of each audio codec (fixed values).
PACKET_FRAMES = {"A_FLAC": 4096, "A_OPUS": 960, "A_AC3": 1536, "A_EAC3": 1536, "A_MPEG/L3": 1152, "A_MPEG/L2": 1152, "A_MPEG/L1": 384}
NATIVE_EXTENSIONS = ["mp4", "mov", "m4v", "qt"]
RAW_EXTENSIONS = ["cr2", "cr3", "nef", "arw", "raf", "orf", "rw2", "dng", "pef", "3fr", "iiq", "gpr"]
STILL_TYPES = {"public.png": "png", "public.jpeg": "jpeg", "public.tiff": "tiff", "public.heic": "heic", "public.heif": "heic", "public.avif": "avif", "com.microsoft.bmp": "bmp", "com.compuserve.gif": "gif"}
STILL_EXTENSIONS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "heic": "heic", "heif": "heic", "avif": "avif", "bmp": "bmp", "gif": "gif"}


def codec_gate(codec: Column) -> Column:
    return F.when(codec.isin(NATIVE_VIDEO), "nativeVideo").when(codec.isin(NATIVE_AUDIO) | codec.startswith("A_AAC"), "nativeAudio").otherwise("deferred")


def unified(fourcc: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in UNIFIED.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.trim(fourcc)), F.trim(fourcc))


def audio_decodable(codec: Column) -> Column:
    return codec.startswith("A_AAC") | codec.isin(DECODABLE_AUDIO)


def needs_private(codec: Column) -> Column:
    return codec.startswith("A_AAC") | codec.isin("A_OPUS", "A_FLAC")


def packet_frames(codec: Column) -> Column:
    frames = F.create_map(*[F.lit(x) for pair in PACKET_FRAMES.items() for x in pair])
    return F.when(codec.startswith("A_AAC"), 1024).otherwise(F.try_element_at(frames, codec))


def decode_rate(codec: Column, rate: Column) -> Column:
    return F.when(codec == "A_OPUS", 48000.0).otherwise(rate)


def audio_track(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """The first track that can be decoded, has channels and a rate, and private data if it needs any."""
    fit = audio_decodable(F.col("codec")) & (F.col("channels") > 0) & (F.col("rate") > 0) & (~needs_private(F.col("codec")) | F.col("has_private"))
    return tracks.where(fit).groupBy(*keys).agg(F.min_by("codec", "id").alias("codec"), F.min("id").alias("track"))


def normalize_route(extension: Column, codec: Column) -> Column:
    native = F.lower(extension).isin(NATIVE_EXTENSIONS)
    return F.when(native & (codec == "V_MPEGH/ISO/HEVC"), "passthrough").when(native, "transcode").otherwise("demux")


def bits_per_pixel(w: Column, h: Column, fps: Column, bps: Column) -> Column:
    return F.when((bps > 0) & (fps > 0) & (w * h > 0), bps / (w * h * fps))


def enhance_class(w: Column, h: Column, bpp: Column, floor: int = 450_000, starved: float = 0.09) -> Column:
    small, low = w * h < floor, F.coalesce(bpp < starved, F.lit(False))
    return F.when(small & low, "mixed").when(small, "resolutionLimited").when(low, "bitrateStarved").otherwise("clean")


def resolution_class(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Output width and height: the short side is capped, both become even, nothing grows."""
    cap = most - most % 2
    even = lambda x: x - x % 2
    scaled = lambda long, short: even(F.round(long * F.lit(float(cap)) / short).cast("long"))
    big = F.least(w, h) > most
    return F.when(big & (h <= w), scaled(w, h)).when(big, cap).otherwise(w), F.when(big & (h <= w), cap).when(big, scaled(h, w)).otherwise(h)


def delivered(met: Column, best_effort: Column, require_smaller: Column, out: Column, source: Column) -> Column:
    return (met | best_effort) & (~require_smaller | (out < source))


def saved_fraction(out: Column, source: Column) -> Column:
    return F.coalesce(F.try_divide(F.greatest(F.lit(0.0), source - out), source), F.lit(0.0))


#: Encode profiles (fixed values): name, codec, web audio, ceiling scale, require smaller, best effort, max and min QP, look-ahead, audio rate per channel, SDR.
PROFILES = [
    ("hevc", "hevc", False, 1.0, True, False, 38, 18, None, None, False),
    ("webH264", "h264", True, 2.0, False, True, 34, 20, 16, 112_000, True),
    ("webH264Shrink", "h264", True, 1.0, True, False, 34, 20, 16, 112_000, True),
]
PROFILE_SCHEMA = "profile string, codec string, web_audio boolean, ceiling_scale double, require_smaller boolean, best_effort boolean, max_qp int, min_qp int, look_ahead int, audio_bps int, sdr boolean"


def audio_rung(codec: Column, rate: Column, channels: Column, limit: int = 112_000) -> Column:
    """Target bitrate where audio is encoded again, else null: AAC above the limit per channel, all others always."""
    again = ~codec.startswith("A_AAC") | (rate > limit * channels)
    return F.when(again, F.least(96_000 * channels, F.lit(384_000)))


def is_hdr(transfer: Column) -> Column:
    return F.coalesce(transfer.isin("HLG", "PQ"), F.lit(False))


def colour_default(w: Column, h: Column, tag: Column) -> Column:
    return F.coalesce(tag, F.when((h < 720) & (w < 1280), "601").otherwise("709"))


def gif_delay(unclamped: Column, clamped: Column) -> Column:
    d = F.coalesce(unclamped, clamped, F.lit(0.1))
    return F.when(d <= 0.010, 0.1).otherwise(d)


def still_delay(unclamped: Column, clamped: Column) -> Column:
    d = F.coalesce(unclamped, clamped, F.lit(0.0))
    return F.when(d > 0.0001, d).otherwise(0.1)


def mezzanine(w: Column, h: Column, fps: Column) -> tuple[Column, Column, Column]:
    """Even width and height of a rendered animation, and its clamped bitrate."""
    return w - w % 2, h - h % 2, F.least(F.greatest(w * h * fps * 0.3, F.lit(8e6)), F.lit(60e6))


def pdf_size(w: Column, h: Column, rotation: Column, dpi: int) -> tuple[Column, Column]:
    side = lambda x: F.greatest(F.lit(1), F.round(x * dpi / 72.0).cast("long"))
    turned = rotation % 180 != 0
    return F.when(turned, side(h)).otherwise(side(w)), F.when(turned, side(w)).otherwise(side(h))


def _named(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def still_format(path: Column, declared: Column | None = None) -> Column:
    """By the declared type, if it is a known one, else by lower-cased extension, camera formats among them, else unknown.

    A declared type that conforms to `public.camera-raw-image` is raw.
    """
    e = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.coalesce(_named(STILL_EXTENSIONS, e), F.when(e.isin(RAW_EXTENSIONS), "raw").otherwise("unknown"))
    if declared is None:
        return by_name
    return F.coalesce(_named(STILL_TYPES, declared), F.when(declared == "public.camera-raw-image", "raw"), by_name)


def still_route(path: Column, declared: Column | None = None) -> Column:
    """What decodes a still: pdf pages, the raw decoder (which may defer), or the image decoder."""
    raw = still_format(path, declared) == "raw"
    return F.when(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)) == "pdf", "pdf").when(raw, "raw").otherwise("image")


def still_status(route: Column, supported: Column) -> Column:
    """A camera file of a body that the raw decoder doesn't know is deferred, never failed; so is one of which nothing is known."""
    return F.when((route == "raw") & ~F.coalesce(supported, F.lit(False)), "deferred").otherwise("ready")


def still_metadata(w: Column, h: Column, depth: Column, alpha: Column, premultiplied: Column, orientation: Column, dpi: Column, tiff_dpi: Column) -> Column:
    """Properties of a still with their defaults: no size is 0, depth 8, orientation 1; DPI is the explicit one, else that of the TIFF block."""
    mode = F.when(~F.coalesce(alpha, F.lit(False)), "none").when(F.coalesce(premultiplied, F.lit(False)), "premultiplied").otherwise("straight")
    return F.struct(
        F.coalesce(w, F.lit(0)).alias("width"), F.coalesce(h, F.lit(0)).alias("height"), F.coalesce(depth, F.lit(8)).alias("depth"),
        mode.alias("alpha"), F.coalesce(orientation, F.lit(1)).alias("orientation"), F.coalesce(dpi, tiff_dpi).alias("dpi"),
    )


def native_probe(extension: Column, w: Column, h: Column, rate: Column) -> Column:
    """Container, size and rate of a file that the system reads: `.mov` is mov, all else mp4; sizes are absolute, then rounded; no rate is 0."""
    side = lambda x: F.round(F.abs(x)).cast("long")
    return F.struct(
        F.when(F.lower(extension) == "mov", "mov").otherwise("mp4").alias("container"),
        side(w).alias("width"), side(h).alias("height"), F.coalesce(rate, F.lit(0.0)).alias("fps"), F.lit(True).alias("decodable"),
    )


def noisy(probe: Column, gate: float = 90.0) -> Column:
    """The camera gate: a probe score under the gate; without a probe nothing is noisy."""
    return F.coalesce(probe < gate, F.lit(False))


def raw_options(knobs: dict[str, Column]) -> Column:
    """The settings that are made: a knob that is null is not touched, which differs from 0."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in knobs.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def probe_fps(default_duration_ns: Column) -> Column:
    return F.coalesce(F.when(default_duration_ns > 0, 1e9 / default_duration_ns), F.lit(0.0))


def rebased(pts: Column, first: Column) -> Column:
    """Real time stamps from the first frame on, never negative."""
    return F.greatest(F.lit(0), pts - first)


def step_pts(index: Column, fps: Column, scale: int = 600) -> Column:
    return index * F.round(scale / fps).cast("long")


def sequence_name(stem: Column, index: Column, count: Column, extension: str) -> Column:
    """A single frame has no number; others count from 1."""
    return F.when(count == 1, F.concat(stem, F.lit(f".{extension}"))).otherwise(F.format_string(f"%s-%03d.{extension}", stem, index + 1))


def transparent(extension: Column, registered: Column) -> Column:
    return F.lower(extension).isin("mov", "mp4") | ((F.lower(extension) == "webm") & registered)


def alpha_refused(has_alpha: Column, reads_alpha: Column) -> Column:
    return F.coalesce(has_alpha, F.lit(False)) & ~F.coalesce(reads_alpha, F.lit(False))


def verdict(checks: Column) -> Column:
    """Of (name, outcome) checks: corrupt if any failed, intact if any was made, else unverified; `readable` alone says nothing."""
    made = lambda c: c["name"] != "readable"
    return F.when(F.exists(checks, lambda c: made(c) & (c["outcome"] == "failed")), "corrupt").when(F.exists(checks, lambda c: made(c) & (c["outcome"] != "skipped")), "intact").otherwise("unverified")


def first_failure(checks: Column) -> Column:
    """The diagnosis of the first check that failed."""
    return F.get(F.filter(checks, lambda c: c["outcome"] == "failed"), 0)["detail"]


def last_registered(registry: DataFrame, keys: list[str]) -> DataFrame:
    return registry.groupBy(*keys).agg(F.max_by("impl", "seq").alias("impl"))


def smallest_variant(variants: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest of the variants that keep the guarantee."""
    return variants.where("met").groupBy(*keys).agg(F.min(F.struct("bytes", "variant")).alias("v")).select(*keys, "v.variant", "v.bytes")


def premultiplied(c: Column, alpha: Column) -> Column:
    return F.least(F.lit(255), F.round(c * alpha / 255.0)).cast("int")


def unpremultiplied(c: Column, alpha: Column) -> Column:
    return F.when(alpha == 0, 0).otherwise(F.least(F.lit(255), F.round(c * 255.0 / F.when(alpha > 0, alpha))).cast("int"))


def expected_signature(bands: Column, base: Column, ratio: float = 0.5) -> Column:
    """Whether deep bands lose little against the finest one."""
    deficits = F.transform(bands, lambda b: 1.0 - b)
    deep = F.greatest(F.array_max(F.slice(deficits, 3, 1000)), 1.0 - base)
    top = F.get(deficits, 0)
    return F.when(F.size(bands) <= 2, True).when(F.greatest(top, deep) < 1e-3, True).otherwise(deep <= top * ratio)


def clamped_detector(window: Column, history: Column, gap: Column) -> Column:
    return F.struct(F.greatest(F.lit(4), window).alias("window"), F.greatest(F.lit(2), history).alias("history"), F.greatest(F.lit(1), gap).alias("gap"))


def clamped_encoder(quality: Column, level: Column) -> Column:
    return F.struct(F.least(F.greatest(quality, F.lit(0.0)), F.lit(1.0)).alias("quality"), F.least(level, F.lit(6)).alias("level"))
