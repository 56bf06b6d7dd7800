"""Language ID rejects what isn't in a learned language, in Latin script too, and keeps clean short texts."""

import base64
import random

import pytest

from reelgrid.llm import language_id

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def model(spark):
    return language_id.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def rejected(spark, model, texts):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    return [r["_lid"]["rejected"] for r in sorted(language_id.predicted(docs, model).collect())]


def test_other_latin_text_is_rejected(spark, model):
    r = random.Random(1)
    texts = [
        "Tämä on aivan tavallinen suomenkielinen teksti, jossa kerrotaan metsästä, järvestä ja talven pitkistä öistä. " * 5,
        "To jest zwykły tekst w języku polskim, który opowiada o lesie, jeziorze i długich zimowych nocach. " * 5,
        "Bu, ormandan, gölden ve uzun kış gecelerinden bahseden sıradan bir Türkçe metindir. " * 5,
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(200)),
        base64.b64encode(r.randbytes(900)).decode(), r.randbytes(600).hex(), r.randbytes(600).hex(" "),
    ]
    assert all(rejected(spark, model, texts))


def test_clean_short_texts_stay(spark, model):
    short = ["Und üheiten.\nHeitge die ber.", "Edstou reinan ed for.", "This.", "Osque ue domente cióndotaja osuebo.", "Laèoueau la ément est éailele.", "Que en ue adouear. Las de ciónjaarbo."]
    assert not any(rejected(spark, model, short))


def test_clusters_are_not_single_outliers():
    import numpy as np

    x = np.abs(np.random.default_rng(0).normal(1, 0.2, (300, 64))).astype(np.float32)
    x[:3] = np.eye(64, dtype=np.float32)[:3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.argmax(x @ language_id.fitted(x).T, axis=1)
    assert np.bincount(own).min() >= 6
