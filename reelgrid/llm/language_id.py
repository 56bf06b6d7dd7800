"""Language ID: nearest of several centroids per language, over normalised TF-IDF n-gram vectors.

Letters are lower-cased and everything else is a space; the byte 2- and 3-grams of the whole text
are counted in DIMENSIONS hashed places. Document frequencies count every learning document. The
centroids of a language come from spherical k-means over a bounded sample of its learning
documents (SAMPLE, those with the smallest hashes of their ids). A text gets the language of the
nearest centroid by cosine; it is rejected if its cosine is below the limit of that centroid for texts
of its length: a low quantile (QUANTILE) of the cosines of all learning documents of that length whose
nearest centroid it is and whose language it has. Where these are fewer than ENOUGH, those of the
language are taken, then those of all languages.

Defined results: a null text or one without a letter is `und` with score 0, rejected; so is every
text if nothing could be learned. A row with a null id is not learned from and not held out. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, released, releasing, small_batches
from .textscan import slices

DIMENSIONS = 8192
#: Texts counted at once: dense counts take 64 KB each.
AT_ONCE = 128
#: Learning documents of a language that its centroids are fitted on, centroids, and rounds of k-means.
SAMPLE, CENTROIDS, ROUNDS = 1000, 4, 12
#: A cluster holds at least one of so many of the sample, or is given up.
SHARE = 50
#: Share of learning documents below a limit, how many a limit is taken from, steps of cosines, and lengths (characters) at which limits change.
QUANTILE, ENOUGH, STEPS, LENGTHS = 0.002, 500, 1000, (32, 128)

_SPACED = np.full(256, 32, np.uint8)
_SPACED[97:123] = np.arange(97, 123)
_SPACED[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts of each text, as float32 [texts, DIMENSIONS]."""
    raw = [b" " + t.lower().encode() + b"  " for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = _SPACED[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)[:-2]
    two = (data[:-1] << np.uint32(8) | data[1:])[: len(doc)]
    three = two << np.uint32(8) | data[2:]
    place = lambda x, seed: ((x + np.uint32(seed)) * np.uint32(2654435761)) >> np.uint32(19)
    inside = two != 0x2020
    n = len(raw) * DIMENSIONS
    out = np.bincount((doc * DIMENSIONS + place(two, 1 << 28))[inside], minlength=n)
    out += np.bincount((doc * DIMENSIONS + place(three, 0))[inside & (data[2:] != 32)], minlength=n)
    return out.reshape(len(raw), DIMENSIONS).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = counts(texts)
    np.log1p(v, out=v)
    v *= idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def fitted(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from a farthest-first start; deterministic. Clusters of single outliers are given up."""
    mean = x.mean(axis=0)
    centres = [mean / max(float(np.linalg.norm(mean)), 1e-12)]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        # An eighth of the sample is further away: the farthest of all are outliers.
        centres.append(x[int(np.argsort(near, kind="stable")[len(x) // 8])])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    while True:
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            for i in range(len(c)):
                if (own == i).any():
                    m = x[own == i].mean(axis=0)
                    c[i] = m / max(float(np.linalg.norm(m)), 1e-12)
        held = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        least = int(np.argmin(held))
        if len(c) == 1 or held[least] >= max(1, len(x) / SHARE):
            return c
        c = np.delete(c, least, axis=0)


def length_class(texts: list[str]) -> np.ndarray:
    return np.searchsorted(LENGTHS, [len(t) for t in texts], side="right")


def limits_of(langs: list[str], seen: np.ndarray) -> np.ndarray:
    """The limit of each centroid and length, from counts of cosines [centroids, lengths, STEPS]."""
    out = np.zeros(seen.shape[:2])
    names = np.array(langs)
    for i, lang in enumerate(langs):
        for k in range(seen.shape[1]):
            pools = [seen[i, k], seen[names == lang, k].sum(axis=0), seen[:, k].sum(axis=0)]
            pool = next((p for p in pools if p.sum() >= ENOUGH), pools[-1])
            if pool.any():
                out[i, k] = int(np.searchsorted(np.cumsum(pool), QUANTILE * pool.sum(), side="right")) / STEPS
    return out


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # of each centroid and length
    idf: np.ndarray

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each text, and the cosine."""
        near = vectors(texts, self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        return best, near[np.arange(len(texts)), best]

    def predict(self, texts: pa.Array) -> pa.Array:
        """lang_pred, score and rejected of each text."""
        lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for begin, end in slices(texts, 1 << 20):
            rows = texts.slice(begin, end - begin).to_pylist()
            on = [i for i, t in enumerate(rows) if has_letter(t)] if self.langs else []
            for at in range(0, len(on), AT_ONCE):
                part = on[at : at + AT_ONCE]
                own = [rows[i] for i in part]
                best, near = self.nearest(own)
                least = self.limits[best, length_class(own)]
                for i, b, s, limit in zip(part, best.tolist(), near.tolist(), least.tolist()):
                    lang[begin + i], score[begin + i], rejected[begin + i] = self.langs[b], min(1.0, max(0.0, s)), s < limit
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"])


PREDICTED = "struct<lang_pred:string,score:double,rejected:boolean>"


def fold(divisor: int = 4):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def learn(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """From text and non-null lang of those whose crc32(doc_id) mod 4 isn't 2."""
    small_batches(docs.sparkSession)
    known = docs.where((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, langs = np.zeros(DIMENSIONS, np.int64), {}
        for b in batches:
            for x in b.column(0).value_counts().to_pylist():
                langs[x["values"]] = langs.get(x["values"], 0) + x["counts"]
            for begin, end in slices(b.column(1), 1 << 20):
                rows = b.column(1).slice(begin, end - begin).to_pylist()
                for at in range(0, len(rows), AT_ONCE):
                    df += np.count_nonzero(counts(rows[at : at + AT_ONCE]), axis=0)
        place = pa.array([*range(DIMENSIONS), *[-1] * len(langs)], pa.int32())
        yield pa.RecordBatch.from_arrays([place, pa.array([*[None] * DIMENSIONS, *langs], pa.string()), pa.array([*df.tolist(), *langs.values()], pa.int64())], ["place", "lang", "n"])

    # DIMENSIONS + languages rows reach the driver, whatever the input.
    sums = known.select("lang", "text").mapInArrow(releasing(frequencies), "place int, lang string, n long").groupBy("place", "lang").agg(F.sum("n").alias("n")).collect()
    sizes = {r["lang"]: r["n"] for r in sums if r["place"] < 0}
    df = np.zeros(DIMENSIONS)
    for r in sums:
        if r["place"] >= 0:
            df[r["place"]] = r["n"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)).astype(np.float32) + 1
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, len(LENGTHS) + 1)), idf)

    # A hash below this share of all hashes leaves about twice the sample, of which the smallest are taken.
    share = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(sizes, pa.string()), "share": pa.array([min(1.0, (2 * sample + 50) / n) for n in sizes.values()], pa.float64())}))
    drawn = known.withColumn("_h", F.xxhash64("doc_id", F.lit("sample"))).join(F.broadcast(share), "lang").where(F.col("_h") / (2.0**64) + 0.5 <= F.col("share"))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    drawn = drawn.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= sample).select("lang", "_k", "text")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("_k")
        texts = [x for x in t.column("text").to_pylist() if has_letter(x)]
        if not texts:
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary())})
        x = np.concatenate([vectors(texts[i : i + 64], idf) for i in range(0, len(texts), 64)])
        c = fitted(x, k)
        lang = t.column("lang")[0].as_py()
        del x
        released()
        return pa.table({"lang": [lang] * len(c), "centroid": pa.array([v.astype("<f4").tobytes() for v in c], pa.binary())})

    rows = drawn.groupBy("lang").applyInArrow(fit, "lang string, centroid binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    centroids = np.stack([np.frombuffer(bytes(r["centroid"]), "<f4") for r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    model = Model([r["lang"] for r in rows], centroids, np.zeros((len(rows), len(LENGTHS) + 1)), idf)
    model.limits = limits_of(model.langs, cosines(known, model))
    return model


def cosines(known: DataFrame, model: Model) -> np.ndarray:
    """How many learning documents (lang, text) have which cosine with their nearest centroid, if it has their language: [centroids, lengths, STEPS]."""
    shape = (len(model.langs), len(LENGTHS) + 1, STEPS)
    out = np.zeros(shape, np.int64)
    if not model.langs:
        return out
    held = known.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = held.value, np.zeros(shape, np.int64)
        names = np.array(model.langs)
        for b in batches:
            for begin, end in slices(b.column(1), 1 << 20):
                langs, texts = (b.column(i).slice(begin, end - begin).to_pylist() for i in (0, 1))
                on = [i for i, t in enumerate(texts) if has_letter(t)]
                for at in range(0, len(on), AT_ONCE):
                    part = [texts[i] for i in on[at : at + AT_ONCE]]
                    best, near = model.nearest(part)
                    right = names[best] == np.array([langs[i] for i in on[at : at + AT_ONCE]])
                    step = np.clip((near * STEPS).astype(np.int64), 0, STEPS - 1)
                    np.add.at(total, (best[right], length_class(part)[right], step[right]), 1)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "n"])

    # At most one row for each centroid, length and step reaches the driver, whatever the input.
    for r in known.select("lang", "text").mapInArrow(releasing(scan), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out.ravel()[r["place"]] = r["n"]
    return out


def predicted(docs: DataFrame, model: Model, name: str = "_lid") -> DataFrame:
    """docs with a column of that name: lang_pred, score, rejected. Nothing but the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTED)
    def predict(texts: pa.Array) -> pa.Array:
        out = held.value.predict(texts)
        released()
        return out

    return docs.withColumn(name, predict("text"))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    found = predicted(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "_lid.lang_pred", "_lid.score", "_lid.rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    name = free_name(docs, "_lid")
    return predicted(docs, learn(docs), name).where(~F.col(f"{name}.rejected")).drop(name)


