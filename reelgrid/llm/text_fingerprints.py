"""SimHash fingerprints of whole texts and their search by permuted block tables, in DataFrame functions only.

Terms are pairs of neighbouring words (the last word stands alone), in lower case. Each occurrence of
a term votes on the 64 bits of the fingerprint with the signs of its 64-bit hash, weighed by the code
points of its words. Votes are summed where a text is read, two bits to a long, so one narrow row a
text is shuffled.

Search: the 64 bits are cut into radius + 3 blocks, and there is one table for each choice of 3 blocks,
keyed by their bits, as if permuted to the front. Of any two fingerprints within the radius at least
3 blocks agree, so they meet in a table; the first one in which they agree reports the pair. Tables
hold distinct fingerprints with the number of their rows, so copies are never paired.

A text is also compared with its edited form, whose last quarter the next text has replaced, and with
that next text. Rows are cut into slices of their order, by bounds that are found on keys alone; texts
are shuffled once, to their slice, and the first row of a slice is also sent to the slice before it.

Defined results: a null text counts as empty; a text without words has fingerprint zero, is found like
any other and is unlike none; rows of one doc_id are ordered by where they lie in the files, a null
doc_id comes first and asks nothing in a search; the next of the last row is the first, a single row
is its own next; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import SPACE, numbered, stored, text_bytes

#: Two counters of 32 bits in a long.
LANES = 0x0000000100000001
LOW = 0xFFFFFFFF
#: Bytes of texts in a slice, and slices at most (then slices grow; they are sorted and scanned with spills).
SLICE_BYTES, SLICES = 4 << 20, 16384
RADIUS = 3


def terms(text: Column) -> Column:
    """(hash, weight) of each occurrence of a term."""
    words = F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: w != "")

    def pairs(w: Column) -> Column:
        follows = F.concat(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), F.array(F.lit("")))
        return F.zip_with(w, follows, lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), (F.char_length(a) + F.char_length(b)).cast("long").alias("w")))

    # The lambda's variable, so that the words are split once.
    return F.flatten(F.transform(F.array(words), pairs))


def votes(h: Column, weight: Column) -> list[Column]:
    """_v0 to _v31: what an occurrence adds to the counters of bits i and i + 32."""
    return [(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * weight).alias(f"_v{i}") for i in range(32)]


def elected(total: Column) -> Column:
    """The fingerprint, from the sums _v0 to _v31: a bit is 1 if over half of all weight says so."""
    out = F.lit(0).cast("long")
    for i in range(32):
        for bit, count in ((i, F.col(f"_v{i}").bitwiseAND(F.lit(LOW))), (i + 32, F.shiftrightunsigned(F.col(f"_v{i}"), 32))):
            out = out.bitwiseOR(F.shiftleft(F.when(2 * count > total, 1).otherwise(0).cast("long"), bit))
    return out


def fingerprints(texts: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of texts, which must tell rows apart, and fp (a signed long)."""
    keys = [c for c in texts.columns if c != text]
    # The outer form keeps texts without terms.
    each = texts.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("_t"))
    weight = F.coalesce(F.col("_t.w"), F.lit(0).cast("long"))
    each = each.select(*keys, weight.alias("_w"), *votes(F.coalesce(F.col("_t.h"), F.lit(0).cast("long")), weight))
    sums = each.groupBy(*keys).agg(F.sum("_w").alias("_w"), *[F.sum(f"_v{i}").alias(f"_v{i}") for i in range(32)])
    return sums.select(*keys, elected(F.col("_w")).alias("fp"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(64.0)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_masks(radius: int) -> list[int]:
    """The bits of each table's key, as signed longs: every choice of 3 of radius + 3 blocks."""
    n = radius + 3
    ends = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (sum(c) for c in combinations(blocks, 3))]


def within(queries: DataFrame, all_of: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, near, n) for each fingerprint near of all_of (fp, n; distinct) within radius of a distinct fp of queries."""
    if not 0 <= radius <= 29:
        raise ValueError("a radius of 0 to 29 bits leaves blocks of 2 bits at least")
    masks = block_masks(radius)

    def tables(fps: DataFrame, name: str, *more: str) -> DataFrame:
        keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
        return fps.select(F.col("fp").alias(name), *more, F.posexplode(keys).alias("table", "key"))

    left, right = tables(queries.select("fp").distinct(), "fp"), tables(all_of, "near", "n")
    differ = F.col("fp").bitwiseXOR(F.col("near"))
    first = F.array_position(F.array(*[differ.bitwiseAND(F.lit(m)) == 0 for m in masks]), True) == F.col("t") + 1
    right = right.withColumnsRenamed({"table": "t", "key": "k"})
    met = (F.col("table") == F.col("t")) & (F.col("key") == F.col("k")) & (F.bit_count(differ) <= radius) & first
    return left.join(right, met).select("fp", "near", "n")


def bounds(rows: DataFrame, parts: int) -> list[dict]:
    """The first key (id, file, at) of each slice of the order, at most parts of them; only keys are shuffled."""
    key = F.struct(F.col("doc_id").alias("id"), F.col("_row.file").alias("file"), F.col("_row.at").alias("at"))
    cut = rows.select(key.alias("k")).repartitionByRange(parts, "k")
    return [json.loads(r["k"]) for r in cut.groupBy(F.spark_partition_id().alias("p")).agg(F.to_json(F.min("k"), {"ignoreNullFields": "false"}).alias("k"), F.min("k").alias("o")).orderBy("o").collect()]


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """_row, doc_id, text (null: empty), and _next, _following: the row and text of the next row by doc_id."""
    rows = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "_row")
    parts = parts or max(12, min(SLICES, -(-text_bytes(docs) // SLICE_BYTES)))
    found = bounds(rows.select("doc_id", "_row"), parts)
    kind = StructType([StructField("id", docs.schema["doc_id"].dataType), StructField("file", LongType()), StructField("at", LongType())])
    firsts = F.from_json(F.lit(json.dumps(found)), ArrayType(kind))
    steps, step = [], 1
    while step < len(found):
        steps, step = [step, *steps], 2 * step
    key = F.struct(F.col("doc_id").alias("id"), F.col("_row.file").alias("file"), F.col("_row.at").alias("at"))

    def further(at: Column, by: Column) -> Column:
        """Binary search for the last bound that isn't beyond the key."""
        return F.when(at + by < len(found), F.when(F.get(firsts, at + by) <= F.col("_key"), at + by).otherwise(at)).otherwise(at)

    rows = rows.withColumn("_key", key).withColumn("_slice", F.aggregate(F.array(*[F.lit(s) for s in steps]).cast("array<int>"), F.lit(0), further))
    # The first row of a slice also ends the slice before it; that of the first one ends the last.
    own = F.struct(F.col("_slice").alias("slice"), F.lit(False).alias("ghost"))
    before = F.struct(F.pmod(F.col("_slice") - 1, F.lit(max(1, len(found)))).alias("slice"), F.lit(True).alias("ghost"))
    sent = F.when(F.get(firsts, F.col("_slice")) == F.col("_key"), F.array(own, before)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "_row", F.explode(sent).alias("_to")).select("doc_id", "text", "_row", "_to.slice", "_to.ghost")
    order = Window.partitionBy("slice").orderBy("ghost", "doc_id", "_row")
    return dealt.select("*", F.lead("_row").over(order).alias("_next"), F.lead("text").over(order).alias("_following")).where("not ghost").select("_row", "doc_id", "text", "_next", "_following")


def edited(text: Column, following: Column) -> Column:
    """text, its last quarter of code points replaced by the first as many (or all) of following."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def likenesses(docs: DataFrame, every: int = 20, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_within of each row.

    n_within: how many other rows have a fingerprint within the radius, for the rows whose doc_id is
    divisible by every; else null.
    """
    pairs = with_next(docs).select("_row", "doc_id", "_next", "text", edited(F.col("text"), F.col("_following")).alias("_edited"))
    meta = F.struct(F.col("doc_id"), F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("_edited", 256)).alias("sha"), F.col("_next").alias("next"))
    none = F.lit(None).cast(f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},n_chars:bigint,sha:binary,next:struct<file:bigint,at:bigint>>")
    both = F.array(F.struct(meta.alias("of"), F.col("text").alias("text")), F.struct(none.alias("of"), F.col("_edited").alias("text")))
    fps = stored(fingerprints(pairs.select("_row", F.explode(both).alias("_b")).select("_row", F.col("_b.of").alias("_of"), F.col("_b.text").alias("text"))))
    own = fps.where("_of is not null").select("_row", "_of.*", "fp")
    other = fps.where("_of is null").select("_row", F.col("fp").alias("_edited"))
    following = own.select(F.col("_row").alias("next"), F.col("fp").alias("_next"))
    held = own.groupBy("fp").agg(F.count("*").alias("n"))
    asks = F.col("doc_id") % every == 0
    counts = within(own.where(asks).select("fp"), held, radius).groupBy("fp").agg((F.sum("n") - 1).alias("n_within"))
    # A hot fingerprint's rows meet its one count; the key is salted by nothing, since Spark splits that side.
    out = own.join(other, "_row").join(following, "next").join(counts, "fp", "left")
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("_edited")).alias("near_edited"), likeness(F.col("fp"), F.col("_next")).alias("near_next"), F.when(asks, F.col("n_within")).alias("n_within"),
    )
