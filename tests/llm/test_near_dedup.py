import random

import pytest
from brute import near_groups as plain

from voicegrain.llm.components import connected_components
from voicegrain.llm.near_dedup import near_groups

SCHEMA = "doc_id long, text string"


def found(spark, rows, k):
    out = near_groups(spark.createDataFrame(rows, SCHEMA), k=k).collect()
    assert len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(30):
        base = rng.choices(words, k=rng.randint(3, 150))
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    assert found(spark, rows, 4) == plain(rows, 4)


def test_one_family_larger_than_a_block(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(120)] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows, 4) == plain(rows, 4)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "one"), (7, "a b c d e"), (8, "a  b\tc d e"), (9, None)]
    assert found(spark, rows, 4) == plain(rows, 4)
    long = " ".join(f"v{i}" for i in range(60_000))
    assert found(spark, [(1, long), (2, long + " tail"), (3, "short text here now")], 5)[2][1] == 1


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z y x w v u")]
    got = near_groups(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS component", "3 AS key")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("4", "4", True), ("4", "4", True), ("None", "4", False), ("None", "None", False)
    ]


def test_near_copies_without_ids_are_linked(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(None, words), (None, words + " tail"), (5, words + " more"), (None, "p q r s t u v"), (None, "p q r s t u v"), (9, "a b c d e f g"), (-3, words + " tail")]
    got = near_groups(spark.createDataFrame(rows, SCHEMA), k=4).collect()
    told = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got)
    assert told == [("-3", "-3", True), ("5", "-3", False), ("9", "9", True), ("None", "-3", False), ("None", "-3", False), ("None", "None", False), ("None", "None", False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (102, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_components_that_do_not_converge_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)
