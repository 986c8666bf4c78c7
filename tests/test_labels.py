"""Near labels, their unification and merged knowledge against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from voicegrain.functions import rules
from voicegrain.operators import labels
from voicegrain.plans import signals


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(seed, n):
    rng, out = random.Random(seed), ["", "a", "b", "ab", "ba", "é", "😀a", "login error", "Login error", "login errors", "log in error"]
    while len(out) < n:
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        out.append(w)
        i = rng.randint(0, len(w))
        out.append(w[:i] + rng.choice("abcx") + w[i + rng.randint(0, 1) :])
    return out


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_near_labels_equal_all_pairs(spark, distance):
    told = words(distance, 160)
    rows = [(w, 1) for w in [*told, *told[:20], None]]
    got = {(r.a, r.b): r.edits for r in labels.near_labels(spark.createDataFrame(rows, "label string, weight long"), distance).collect()}
    each = sorted(set(told))
    want = {(a, b): edits(a, b) for i, a in enumerate(each) for b in each[i + 1 :] if edits(a, b) <= distance}
    assert got == want


def test_labels_are_unified_in_order_of_weight(spark):
    rng = random.Random(4)
    rows = [(w, rng.choice([None, 1, 2, 3])) for w in words(9, 200)] + [(None, 50)]
    weight = {}
    for w, n in rows:
        if w is not None:
            weight[w] = weight.get(w, 0) + (n or 0)
    want, kept = {}, []
    for w in sorted(weight, key=lambda w: (-weight[w], w)):
        near = [(edits(w, k), i, k) for i, k in enumerate(kept) if edits(w, k) <= 1]
        want[w] = min(near)[2] if near else w
        if not near:
            kept.append(w)
    found = labels.unified(spark.createDataFrame(rows, "label string, weight long"))
    assert {r.label: (r.canonical, r.weight) for r in found.collect()} == {w: (c, weight[w]) for w, c in want.items()}


def test_knowledge_under_near_labels_is_merged(spark):
    rows = [("login error", 1, "bug", 5), ("login eror", 1, "bug", 2), ("login eror", 2, "bug", 1), ("billing", 1, "bug", 1), (None, 1, "bug", 3)]
    edges = spark.createDataFrame(rows, "label string, channel_id long, intent_type string, weight long")
    edges = edges.withColumns({"first_seen": F.lit("2024-01-02").cast("timestamp"), "last_seen": F.lit("2024-01-03").cast("timestamp"), "__own": F.lit(1)})
    one = labels.unified(edges)
    got = {(r.label, r.channel_id): r.weight for r in signals.unify_knowledge(edges, one).collect()}
    assert got == {("login error", 1): 7, ("login error", 2): 1, ("billing", 1): 1, (None, 1): 3}


def test_no_labels(spark):
    none = spark.createDataFrame([], "label string, weight long")
    assert labels.unified(none).count() == labels.near_labels(none).count() == 0
    assert labels.unified(spark.createDataFrame([(None, 1)], "label string, weight long")).count() == 0


def test_longest_words_of_whole_texts_go_through_arrays(spark, monkeypatch):
    monkeypatch.setattr(labels, "CHUNK", 12)
    told = [None, "", " ", "...", "b a", "Zz aa", "über ÜBER-all ÿÿ", "a😀bc é÷é", "no\nnewline", "x" * 40, "one\u0000two", "İstanbul ſhort", "abc abd abb", "end"] * 2
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "id long, text string").repartition(3)
    got = rows.select(labels.longest_word(F.col("text")).alias("a"), rules.longest_word(F.col("text")).alias("b"))
    assert all(r.a == r.b for r in got.collect()) and got.where("a = 'overall'").count() == 0
    from voicegrain.plans import catalog

    monkeypatch.setattr(catalog, "table", lambda *_: rows)
    plan = catalog._words(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "split(" not in plan


def test_few_parts_are_sought(spark):
    """A label looks for 12 parts within two edits, not for all 45 that lie up to two places off."""
    near = labels.near_labels(spark.createDataFrame([("abcdefghijkl",)], "label string"), 2)
    assert near._jdf.queryExecution().analyzed().toString().count("CASE WHEN") <= 3 * (1 + 3) + 12 + 3 * 5
