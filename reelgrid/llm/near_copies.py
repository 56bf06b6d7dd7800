"""Near copies by SimHash links and, for what fingerprints can't see, by prefixes of shingle sets.

Texts become sets of 64-bit hashes of SHINGLE words, and rows are told apart by their sets. Two
sets are near if their Jaccard similarity is at least PERCENT / 100; near sets are linked, and of
each component one row stays. Links are found in three steps, each link computed from whole sets:

1. Fingerprints of the sets' shingles meet in the binary trie self-join of simhash; its links are
   candidates. At similarity 0.8 fingerprints differ in up to 14 of 64 bits and more, where a trie
   no longer prunes, so this step finds the closest copies only.
2. With all hashes in one order (rare ones first, by counts of hashed places) two near sets share
   one of the first n - ceil(s n) + 1 hashes of each. The sets that share such a token form a group.
   Each set is compared with one other of its groups, that with which it shares most tokens, if their
   sizes allow it; this is done again for dense groups, from another set of each, while they have many sets
   in different components.
3. A group's sets that are still in different components are candidates, if their sizes are alike and
   the token stands so early in both that near sets of their sizes may share it first. Groups are
   parted by size; of tokens that the same sets have the first stands for all. The first token that
   two near sets share is such a one, so no link between components is lost. Of the candidates those
   go whose sketches (a bit for each place of a hash, set where an odd number of the set's hashes fall
   on it) differ in more bits than two near sets may differ in hashes: that is never so for near sets.
   Of many candidates each set's closest by sketches are compared first; what they link drops the other
   candidates between the same components, and the rest is compared last. So links are about as many as
   sets, not as pairs of sets.

Defined results: a null text counts as empty; texts with equal sets are linked, those without words
among them; a text of fewer words has one shingle of all its words; of each component the row with
the smallest doc_id stays (null comes last, then a hash of the text decides), and of rows alike in
doc_id and text one; extra columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEYS, discard, others, parts_for, released, releasing, rows_without, small_batches, stored, text_key
from .simhash import LABELS, components, first_row, shingle_spans, trie_forest, voted, won
from .textscan import mix, slices, words, xxh64

U64 = np.uint64
SHINGLE, PERCENT, BITS = 5, 80, 3
#: Places in which hashes are counted, and how many of them a row holds.
PLACES, BLOCK = 1 << 20, 1 << 15
#: Tokens that are dealt out at once, bytes of input for a bucket of tokens, and rows of a token that a bucket takes.
TOKENS, BUCKET_BYTES, HOT = 1 << 18, 8 << 20, 1 << 20
#: Sets that are compared with one other in a task's group.
MEMBERS = 2048
#: Texts whose sets a task computes at once.
AT_ONCE = 64
#: Hashes of a set up to which it has a sketch (of two to four bits a hash); larger sets are compared without.
SKETCHED = 1 << 12
#: Pairs of dense groups left for the last step: at least so many, or this many for each shared token; rounds of step 2 at most.
PAIRS, PAIRS_EACH, ROUNDS = 1 << 22, 8, 6
#: A token's group is dense if more than this many times PAIRS_EACH of its sets are outside its largest component; others add fewer pairs to a row.
DENSE = 16
#: Files that intermediate rows take at least, sets for each further one, and texts for each task that compares them.
FILES, SETS_EACH, TEXTS_EACH = 16, 1 << 12, 1 << 10
#: Candidates of step 3 that are compared at once; of more, each set's closest come first, so many times.
AT_LAST, CLOSEST = 1 << 12, 2


def sets_of(texts: pa.Array, k: int, votes: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each slice of texts the hashes of all sets, each ascending, how many each text has, and the fingerprints if asked for."""
    for begin, end in slices(texts, 1 << 20):
        w = words(texts.slice(begin, end - begin))
        start, size, doc = shingle_spans(w, k)
        h = xxh64(w.text, start, size)
        fps = None
        if votes:
            ones = np.zeros((w.n, 64), np.int64)
            voted(h, doc, ones)
            fps = won(ones, np.bincount(doc, minlength=w.n))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield h[first], np.bincount(doc[first], minlength=w.n), fps


def names_of(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The names of sets: equal sets have equal names."""
    ends = np.cumsum(n)
    total = np.concatenate([[U64(0)], np.cumsum(mix(h, 11), dtype=U64)])
    return mix(total[ends] - total[ends - n], 12).view(np.int64)


def sketches(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each set the parities of the numbers of its hashes on each place, 64 to a long; null for sets over SKETCHED.

    Places are powers of two, so the halves of a sketch, combined by exclusive or, are the sketch of half the places.
    """
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64))
    longs = np.where(n > SKETCHED, 0, bits // 64)
    ends = np.cumsum(longs)
    own = np.repeat(np.arange(len(n)), n)
    on = n[own] <= SKETCHED
    own, place = own[on], mix(h[on], 15).astype(np.int64)
    at = 64 * (ends - longs)[own] + (place & (bits[own] - 1))
    odd = (np.bincount(at, minlength=64 * int(longs.sum())) & 1).astype(np.uint8)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.packbits(odd, bitorder="little").view("<i8")), mask=pa.array(n > SKETCHED))


def differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the larger one folded to the other's places; at most the hashes that one of the two sets has alone."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda p, q: p.bitwiseXOR(q))
    ones = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return F.when(F.size(a) == F.size(b), ones(a, b)).when(F.size(a) == 2 * F.size(b), ones(half(a), b)).when(2 * F.size(a) == F.size(b), ones(a, half(b)))


def named_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key (of the row), id (the set's name), n (its size), fp and sketch of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for h, n, fps in sets_of(b.column(2), k, votes=True):
                own = [b.column(i).slice(at, len(n)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names_of(h, n)), pa.array(n.astype(np.int64)), pa.array(fps.view(np.int64)), sketches(h, n)], ["doc_id", "key", "id", "n", "fp", "sketch"])
                at += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(releasing(scan), f"doc_id {kind}, key long, id long, n long, fp long, sketch array<long>")


def _place(h: np.ndarray) -> np.ndarray:
    return (mix(h, 13) % U64(PLACES)).astype(np.int64)


def place_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many hashes fall on each place: PLACES numbers reach the driver, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for b in batches:
            for h, _, _ in sets_of(b.column(0), k):
                total += np.bincount(_place(h), minlength=PLACES)
        if total.any():
            blocks = [x.tobytes() for x in np.split(total.astype("<i8"), PLACES // BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "counts"])

    def summed(block: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for b in parts:
            for x in b.column(1):
                total += np.frombuffer(x.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([block[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    out = np.zeros(PLACES, np.int64)
    for r in docs.select("text").mapInArrow(releasing(count), "block int, counts binary").groupBy("block").applyInArrow(summed, "block int, counts binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["counts"]), "<i8")
    return out


def _hot(counts: np.ndarray) -> int:
    """Rows beyond which a token is dealt to several buckets: where hashes fall on one place as on others, none is."""
    return max(HOT, 16 * int(counts.mean()))


def shared_tokens(docs: DataFrame, counts: Broadcast, k: int, percent: int, hot: int) -> DataFrame:
    """token, id, head, pos of the tokens that more than one set has; head is one of the token's sets, pos the token's place in the set.

    The tokens of many texts go to a bucket as one row. A token that may have more than hot rows is
    dealt to several buckets; it is kept in each, and has a head in each.
    """
    buckets = parts_for(docs, BUCKET_BYTES)

    def salts(token: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-counts.value[_place(token)] // hot)).astype(U64)

    def dealt(token: np.ndarray, name: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        bucket = (mix(token, mix(name, 14) % salts(token)) % U64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        own, first = np.unique(bucket[order], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        blobs = [pa.array([v[order[a:b]].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()) for v in (token, name, pos)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *blobs], ["bucket", "tokens", "ids", "places"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for h, n, _ in sets_of(b.column(0), k):
                own = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, counts.value[_place(h)], own))
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                on = rank < (n - -(-percent * n // 100) + 1)[own]
                held.append((h[order][on], names_of(h, n).view(U64)[own[on]], rank[on].astype("<i4")))
                size += int(on.sum())
                if size >= TOKENS:
                    yield dealt(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield dealt(*map(np.concatenate, zip(*held)))

    def meet(t: pa.Table) -> pa.Table:
        token, name, pos = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("tokens", "<u8"), ("ids", "<u8"), ("places", "<i4")))
        order = np.lexsort((mix(name, 21), token))
        token, name, pos = token[order], name[order], pos[order]
        other = np.ones(len(token), bool)
        other[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        token, name, pos = token[other], name[other], pos[other]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        head, size = np.repeat(name[first], size), np.repeat(size, size)
        on = (size > 1) | (salts(token) > 1)
        released()
        return pa.table([*(pa.array(v[on].view(np.int64)) for v in (token, name, head)), pa.array(pos[on])], ["token", "id", "head", "pos"])

    return docs.select("text").mapInArrow(releasing(scan), "bucket int, tokens binary, ids binary, places binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "token long, id long, head long, pos int")


def described(rows: DataFrame, sets: int) -> DataFrame:
    """rows (of stored(), of at most so many sets) with what told() and stored() need of their number."""
    rows.few, rows.files = sets <= LABELS, max(FILES, -(-sets // SETS_EACH))
    return rows


def told(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of described() rows as the side of a join that is broadcast, if rows are few."""
    return F.broadcast(rows.select(*columns)) if rows.few else rows.select(*columns)


def fitting(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (fp, to, ...) whose sizes n and m let them be near; n and m are added."""
    both = pairs.where("fp <> to").join(told(reps, F.col("id").alias("fp"), "n"), "fp").join(told(reps, F.col("id").alias("to"), F.col("n").alias("m")), "to")
    return both.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (fp, to) of the names of different sets those that are near, computed from the whole sets.

    The sets of many are compared with that of one (to), which every MEMBERS of them get. What is moved
    are compressed texts, which are smaller than their sets.
    """
    pairs = stored(pairs.select("fp", "to"), reps.files)
    parts = pairs.groupBy("to").count().select("to", F.ceil(F.col("count") / MEMBERS).alias("parts"))
    many = pairs.join(F.broadcast(parts) if reps.few else parts, "to").select(F.col("fp").alias("id"), "to", F.pmod(F.xxhash64("fp"), "parts").alias("part"), F.lit(True).alias("member"))
    asked = many.unionAll(parts.select(F.col("to").alias("id"), "to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member")))
    asked = kept = stored(asked.join(told(reps, "id", "doc_id", "key"), "id").select("to", "part", "member", "id", F.col("doc_id").alias("_id"), F.col("key").alias("_key")), reps.files)
    n = asked.count()
    asked = F.broadcast(asked) if n <= KEYS else asked
    texts = docs.select("doc_id", "text", text_key().alias("key"))
    sides = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for b in batches:
            blobs = pa.array([press.compress((t or "").encode()) for t in b.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), blobs], ["to", "part", "member", "id", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (to, part), the one set before the many."""
        held, one, press = None, np.zeros(0, "<u8"), zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                b = batch.slice(at, AT_ONCE)
                to, part, member, name = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(4))
                texts = pa.array([press.decompress(x.as_buffer()) for x in b.column(4)], pa.binary()).cast(pa.string())
                sets = [(h, n) for h, n, _ in sets_of(texts, k)]
                h, n = (np.concatenate(x) for x in zip(*sets))
                ends = np.cumsum(n)
                near: list[np.ndarray] = []
                starts = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (part[1:] != part[:-1]) | ~member[1:]]))
                for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(to)]):
                    if not member[x]:
                        held, one, x = (to[x], part[x]), h[ends[x] - n[x] : ends[x]].copy(), x + 1
                    assert held is not None
                    if x < y:
                        own, many = n[x:y], h[ends[x] - n[x] : ends[y - 1]]
                        hit = np.zeros(len(many), bool)
                        if len(one):
                            hit = one[np.minimum(np.searchsorted(one, many), len(one) - 1)] == many
                        both = np.bincount(np.repeat(np.arange(y - x), own), hit, y - x)
                        near.append(x + np.flatnonzero((100 * both >= percent * (own + len(one) - both)) & (to[x:y] == held[0])))
                on = np.concatenate(near) if near else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(to[on])], ["fp", "to"])

    found = sides.select("to", "part", "member", "id", "text").mapInArrow(releasing(packed), "to long, part long, member boolean, id long, packed binary")
    dealt = found.repartition("to", "part").coalesce(max(FILES, -(-n // TEXTS_EACH)))
    out = stored(dealt.sortWithinPartitions("to", "part", "member").mapInArrow(releasing(compare), "fp long, to long"))
    discard(pairs, kept)
    return out


def fullest(rows: DataFrame) -> DataFrame:
    """(id, head) with repeats -> pairs (fp, to): each id with the head that it has most often."""
    counted = rows.where("id <> head").groupBy("id", "head").count()
    return counted.groupBy("id").agg(F.max_by("head", F.struct("count", "head")).alias("to")).select(F.col("id").alias("fp"), "to")


def apart(shared: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """token, id, pos, root of the tokens (token, id, pos) that sets of different components have; of tokens that the same sets have the first.

    Tokens with the same sets have the same order in all of them.
    """
    placed = _rooted(shared.select("token", "id", "pos", F.col("id").alias("root")), labels, "root")
    of = placed.groupBy("token").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b"), F.min_by("pos", "id").alias("at"), F.min("root").alias("least"), F.max("root").alias("most"))
    first = stored(of.where("least <> most").groupBy("sets", "a", "b").agg(F.min_by("token", "at").alias("token")).select("token"), reps.files)
    out = stored(placed.join(_side(first), "token", "left_semi"), reps.files)
    discard(first)
    return out


def early_pairs(left: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(fp, to, root, over, gap) of the sets of different components (root, over) that may be near by a token that both have; left: token, id, pos, root, major.

    gap: bits in which their sketches differ, for each of their hashes; 0 for sets without a sketch.

    Two near sets of n and m hashes share least(n, m) of them, and so share one that has as many at and
    behind its place in either. A set meets those that are as large or larger, by a factor of 100 / percent
    at most. The sets of a token's largest component (major) don't meet each other, only the token's other sets.
    """
    # A little more than the factor, so that rounding can't part two sizes by two bands.
    band = F.floor(F.log("n") / (1.001 * log(100 / min(percent, 99))))
    rows = left.join(reps.select("id", "n", "sketch"), "id").select("token", "id", "root", "pos", "n", "sketch", band.alias("band"), (F.col("root") == F.col("major")).alias("within"))
    least = lambda both: F.ceil(both * percent / (100 + percent))  # noqa: E731  (hashes that near sets share)
    small = rows.where(F.col("pos") <= F.col("n") - least(2 * F.col("n"))).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    small = small.withColumn("within", F.explode(F.when(F.col("within"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    large = rows.select("token", "band", "within", F.col("id").alias("to"), F.col("root").alias("over"), F.col("pos").alias("place"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    alike = (F.struct("n", "id") < F.struct("m", "to")) & (percent * F.col("m") <= 100 * F.col("n")) & (F.col("root") != F.col("over"))
    shared = least(F.col("n") + F.col("m"))
    early = alike & (F.col("pos") <= F.col("n") - shared) & (F.col("place") <= F.col("m") - shared)
    # Sketches last: they cost most.
    bits = differing(F.col("sketch"), F.col("other"))
    near = F.when(early, F.coalesce(bits <= F.col("n") + F.col("m") - 2 * shared, F.lit(True))).otherwise(False)
    met = small.join(large, ["token", "band", "within"]).where(near)
    return met.select(F.col("id").alias("fp"), "to", "root", "over", F.coalesce(bits / (F.col("n") + F.col("m")), F.lit(0.0)).alias("gap")).distinct()


def grouped(left: DataFrame, turn: int = 0) -> DataFrame:
    """For each token all its sets, those of its largest component (own, major) and one set (head: id, root), another each turn."""
    some = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "root")).alias("some")
    by_root = left.groupBy("token", "root").agg(F.count("*").cast("double").alias("own"), some)
    return by_root.groupBy("token").agg(F.sum("own").alias("all"), F.max("own").alias("own"), F.max_by("root", "own").alias("major"), F.min("some").alias("some")).select("token", "all", "own", "major", F.struct("some.id", "some.root").alias("head"))


def _side(rows: DataFrame) -> DataFrame:
    """rows as the side of a join that is broadcast, if they are few."""
    return F.broadcast(rows) if rows.count() <= LABELS else rows


def _rooted(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """rows with the roots of sets in place of their names, in these columns."""
    side = F.broadcast if labels.count() <= LABELS else (lambda x: x)
    for c in columns:
        rows = rows.join(side(labels.select(F.col("fp").alias(c), F.col("root").alias("_root"))), c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    return rows


def grown(labels: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """labels with what links (fp, to) bring together; only components that they touch are looked at."""
    found = components(_rooted(links.select("fp", "to"), labels, "fp", "to"))
    new = found.join(_side(labels.select("fp")), "fp", "left_anti")
    rows = labels.union(new.select("fp", F.col("fp").alias("root")))
    out = stored(_rooted(rows, found, "root").select("fp", "root"), files)
    discard(labels, links, found)
    return out


def closest(pairs: DataFrame) -> DataFrame:
    """Of pairs (fp, to, gap), for each set on either side the one of the smallest gap."""
    of = lambda c: pairs.groupBy(c).agg(F.min(F.struct("gap", "fp", "to")).alias("p")).select("p.fp", "p.to")
    return of("fp").union(of("to")).distinct()


def last_links(pairs: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """labels with the links of all pairs of early_pairs that are near; pairs that others have linked need no comparison."""
    pairs = stored(pairs, reps.files)
    for _ in range(CLOSEST):
        if pairs.count() <= AT_LAST:
            break
        first = stored(closest(pairs), reps.files)
        labels = grown(labels, verified(first, reps, docs, k, percent), reps.files)
        rest = _rooted(pairs.join(_side(first), ["fp", "to"], "left_anti"), labels, "root", "over").where("root <> over")
        pairs, old = stored(rest.select("fp", "to", "root", "over", "gap"), reps.files), pairs
        discard(old, first)
    return grown(labels, verified(pairs, reps, docs, k, percent), reps.files)


def labelled(docs: DataFrame, rows: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """(fp, root) of the sets that are near others; rows: named_rows(docs)."""
    spark, sets = docs.sparkSession, rows.count()
    files = described(rows, sets).files
    reps = described(stored(rows.groupBy("id").agg(F.min(F.struct("doc_id", "key", "n", "fp", "sketch")).alias("r")).select("id", "r.*"), files), sets)
    heads = described(stored(reps.groupBy("fp").agg(F.min("id").alias("head")), files), sets)
    equal = reps.select("id", "fp").join(told(heads, "fp", "head"), "fp").select(F.col("id").alias("fp"), F.col("head").alias("to"))
    links = trie_forest(heads.select("fp"), bits)
    close = links.join(told(heads, "fp", F.col("head").alias("a")), "fp").join(told(heads, F.col("fp").alias("to"), F.col("head").alias("b")), "to").select(F.col("a").alias("fp"), F.col("b").alias("to"))

    counts = place_counts(docs, k)
    shared = stored(shared_tokens(docs, spark.sparkContext.broadcast(counts), k, percent, _hot(counts)), files)
    pairs = equal.unionAll(close).unionAll(fullest(shared.select("id", "head"))).distinct()
    labels = components(verified(fitting(pairs, reps, percent), reps, docs, k, percent))
    left = apart(shared, labels, reps)
    discard(shared)
    dense, rows = left, left.count()
    for turn in range(ROUNDS - 1):
        groups = stored(grouped(dense, turn).where(F.col("all") - F.col("own") > DENSE * PAIRS_EACH), files)
        pairs = groups.agg(F.coalesce(F.sum(F.col("all") * (F.col("all") - F.col("own"))), F.lit(0.0))).first()[0]
        if pairs <= max(PAIRS, PAIRS_EACH * rows):
            discard(groups)
            break
        met = stored(dense.join(_side(groups.select("token", "head")), "token"), files)
        tried = met.where(F.col("root") != F.col("head.root")).select("id", F.col("head.id").alias("head"))
        found = verified(fitting(fullest(tried), reps, percent), reps, docs, k, percent)
        if found.isEmpty():
            discard(groups, met)
            break
        labels = grown(labels, found, files)
        before, dense = dense, stored(_rooted(met.select("token", "id", "pos", "root"), labels, "root"), files)
        discard(groups, met, *([] if before is left else [before]))

    if dense is not left:  # what rounds have linked is linked for all tokens
        before, left = left, stored(_rooted(left, labels, "root").select("token", "id", "pos", "root"), files)
        discard(before, dense)
    mixed = stored(grouped(left).where("all > own").select("token", "major"), files)
    if mixed.isEmpty():
        return labels
    before, left = left, stored(left.join(_side(mixed), "token"), files)
    discard(before, mixed)
    return last_links(early_pairs(left, reps, percent), labels, reps, docs, k, percent)


def near_kept(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component of near texts."""
    small_batches(docs.sparkSession)
    rows = stored(named_rows(docs, k))
    labels = labelled(docs, rows, k, percent, bits)
    placed = stored(rows.select("doc_id", "key", "id").join(_side(labels.withColumnRenamed("fp", "id")), "id", "left").select("doc_id", "key", F.coalesce("root", "id").alias("root")), rows.files)
    best = placed.groupBy("root").agg(F.min(first_row()).alias("best")).select("best.doc_id", "best.key")
    return rows_without(docs, placed, stored(others(placed, best), rows.files))
