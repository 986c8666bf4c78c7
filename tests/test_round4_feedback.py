"""What round 4 mended outside the training-data subpackage."""

import numpy as np
from pyspark.sql import functions as F

from voicegrain.functions import rules
from voicegrain.functions.text import parse_combined
from voicegrain.operators import agglomerative


def test_rule_answers_cut_a_text_into_words_once(spark):
    """Each field of an answer once asked for the whole answer anew, which cut the text into words dozens of times."""
    texts = [("a", "Great app, but it crashes: how slow!"), ("b", "plain words"), ("c", "please add, love love hate"), ("d", None)]
    docs = spark.createDataFrame(texts, "id string, t string")
    got = docs.select("id", parse_combined(rules.combined_answer(F.col("t"))).alias("b"))
    got = got.select("id", "b.sentiment.polarity", "b.sentiment.intensity", "b.intent.intent_type", "b.intent.urgency")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[^a-zà-ÿ]+") == 1
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        ("a", -1 / 3, "mild", "bug_report", "high"),
        ("b", 0.0, "mild", "general_comment", "low"),
        ("c", 1 / 3, "mild", "feature_request", "low"),
        ("d", 0.0, "mild", "general_comment", "low"),
    ]


def test_nearest_by_tiles_are_nearest_in_billionths():
    """Rows that a tile cannot better are not searched; of cosines that round to one billionth the least id holds, whichever tile comes first."""
    rng = np.random.default_rng(8)
    cosines = rng.integers(-5, 6, (40, 60)) / 5 * 0.9 + rng.integers(0, 2, (40, 60)) * 1e-13
    ids, rows, tiles = np.arange(100, 200), np.arange(40), [np.arange(40 + k, 60 + k) for k in (40, 0, 20)]
    top, near = np.full(100, np.iinfo(np.int64).min), np.zeros(100, np.int64)
    for at in tiles:
        agglomerative._better(ids, rows, at, cosines[:, at - 40], top, near)
    whole = np.rint(cosines * agglomerative.SCALE).astype(np.int64)
    assert top[:40].tolist() == whole.max(axis=1).tolist() and near[:40].tolist() == (140 + whole.argmax(axis=1)).tolist()
    agglomerative._better(ids, rows, np.arange(40, 42), np.full((40, 2), -np.inf), top, near)
    assert top[:40].tolist() == whole.max(axis=1).tolist()
