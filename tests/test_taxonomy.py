"""Trees of any depth: paths by doubling, intervals by pointer jumping, moves by renumbering, against plain walks."""

import random

import pytest

from voicegrain.plans import taxonomy

NODES = "node_id string, parent_id string, label string, weight double"


def walk(rows):
    """{node_id: (parent_id, lo, hi, total)} by a plain walk with a stack."""
    kids = {}
    for node, parent, _, _ in sorted(rows, key=lambda r: r[0], reverse=True):
        kids.setdefault(parent, []).append(node)
    weight, parent_of = {r[0]: r[3] or 0.0 for r in rows}, {r[0]: r[1] for r in rows}
    lo, order, stack = {}, [], list(kids.get(None, []))
    while stack:
        node = stack.pop()
        order.append(node)
        lo[node] = len(order)
        stack += kids.get(node, [])
    size, total = {}, {}
    for node in reversed(order):
        size[node] = 1 + sum(size[k] for k in kids.get(node, []))
        total[node] = weight[node] + sum(total[k] for k in kids.get(node, []))
    return {v: (parent_of[v], lo[v], lo[v] + size[v] - 1, round(total[v], 2)) for v in order}


def told(df):
    return {r.node_id: (r.parent_id, r.lo, r.hi, r.total) for r in df.collect()}


def grown(n, seed):
    rng = random.Random(seed)
    return [(f"n{i}", None if i < 2 else f"n{rng.randrange(max(0, i - 6), i)}", f"l{i}", rng.randrange(1000) / 4 if i % 5 else None) for i in range(n)]


def test_a_chain_of_a_thousand(spark):
    chain = [(f"{i:04d}", f"{i - 1:04d}" if i else None, f"l{i}", 1.0) for i in range(1_000)]
    nodes = spark.createDataFrame(chain, NODES)
    deepest = taxonomy.paths(nodes).orderBy("depth", ascending=False).first()
    assert (deepest.node_id, deepest.root, deepest.depth, len(deepest.ancestors)) == ("0999", "0000", 999, 1_000)
    assert deepest.path == " > ".join(f"l{i}" for i in range(1_000))
    assert told(taxonomy.intervals(nodes)) == walk(chain)


def test_moves_renumber_what_lies_between(spark):
    rows = grown(60, 1)
    numbers = taxonomy.intervals(spark.createDataFrame(rows, NODES)).cache()
    assert told(numbers) == walk(rows)
    lo = walk(rows)
    below = {v for v, (_, at, _, _) in lo.items() if lo["n9"][1] <= at <= lo["n9"][2]}
    assert {r.node_id for r in taxonomy.subtree(numbers, "n9").collect()} == below
    rng, tried = random.Random(2), 0
    while tried < 12:
        node, parent = rng.choice(rows)[0], rng.choice(rows)[0]
        inside = lo[node][1] <= lo[parent][1] <= lo[node][2]
        after = rows if inside else [(v, parent if v == node else p, label, w) for v, p, label, w in rows]
        assert told(taxonomy.move_interval(numbers, node, parent)) == walk(after), (node, parent)
        tried += 1
    for node, parent in (("n5", "none"), ("none", "n5")):
        assert told(taxonomy.move_interval(numbers, node, parent)) == lo
    numbers.unpersist()


def test_orphans_are_left_out_and_cycles_refused(spark):
    rows = [("a", None, "A", 1.0), ("b", "a", "B", None), ("c", "gone", "C", 1.0), ("d", "c", "D", 1.0)]
    nodes = spark.createDataFrame(rows, NODES)
    assert {r.node_id: r.path for r in taxonomy.paths(nodes).collect()} == {"a": "A", "b": "A > B"}
    assert told(taxonomy.intervals(nodes)) == {"a": (None, 1, 2, 1.0), "b": ("a", 2, 2, 0.0)}
    looped = spark.createDataFrame(rows[:2] + [("x", "y", "X", 1.0), ("y", "x", "Y", 1.0), ("z", "y", "Z", 1.0)], NODES)
    for f in (taxonomy.paths, taxonomy.intervals):
        with pytest.raises(ValueError, match="cycle"):
            f(looped)
    empty = nodes.limit(0)
    assert taxonomy.paths(empty).count() == taxonomy.intervals(empty).count() == 0
