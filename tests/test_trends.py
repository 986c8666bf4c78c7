"""Decomposition by loess, average-linkage clusters and alert rules against plain loops."""

import datetime
import math

import numpy as np
import pytest

from voicegrain.operators import agglomerative
from voicegrain.plans import alerts, loess

# Loess


def plain_line(y, weights, q, at):
    n = len(y)
    gaps = sorted(abs(at - i) for i in range(n))
    reach = gaps[min(q, n) - 1] * max(1.0, q / n)
    tri = [(1 - (abs(at - i) / reach) ** 3) ** 3 if abs(at - i) < reach else 0.0 for i in range(n)]
    w = [t * r for t, r in zip(tri, weights, strict=True)]
    if sum(w) == 0:
        w = tri
    a = np.array([[1.0, i] for i in range(n)])
    root = np.sqrt(np.array(w))[:, None]
    solved = np.linalg.lstsq(a * root, np.array(y) * root[:, 0], rcond=1e-12)[0]
    return solved[0] + solved[1] * at


def plain_stl(y, period, seasonal, inner, outer):
    n = len(y)
    low = period if period % 2 else period + 1
    slow = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    slow += 1 - slow % 2
    mean = lambda v, k: [sum(v[i : i + k]) / k for i in range(len(v) - k + 1)]
    trend, weights = [0.0] * n, [1.0] * n
    for turn in range(outer + 1):
        for _ in range(inner):
            cycle = [0.0] * (n + 2 * period)
            for day in range(period):
                own = [y[i] - trend[i] for i in range(day, n, period)]
                for k, at in enumerate(range(-1, len(own) + 1)):
                    cycle[day + k * period] = plain_line(own, weights[day::period], seasonal, at)
            passed = mean(mean(mean(cycle, period), period), 3)
            season = [cycle[period + i] - plain_line(passed, [1.0] * n, low, i) for i in range(n)]
            trend = [plain_line([y[j] - season[j] for j in range(n)], weights, slow, i) for i in range(n)]
        rest = [y[i] - trend[i] - season[i] for i in range(n)]
        if turn < outer:
            size = 6 * sorted(map(abs, rest))[n // 2] if n % 2 else 3 * sum(sorted(map(abs, rest))[n // 2 - 1 : n // 2 + 1])
            weights = [(1 - (abs(r) / size) ** 2) ** 2 if abs(r) < size else 0.0 for r in rest]
    return trend, season, rest


@pytest.mark.parametrize(("n", "outer"), [(60, 0), (60, 3), (45, 2), (14, 1)])
def test_decomposition_equals_a_plain_one(n, outer):
    rng = np.random.default_rng(n)
    y = 20 + 0.3 * np.arange(n) + 5 * np.sin(2 * np.pi * np.arange(n) / 7) + rng.normal(size=n)
    y[n // 3] += 40
    got = loess.stl(y, outer=outer)
    for a, b in zip(got[:3], plain_stl(y.tolist(), 7, 7, 2, outer), strict=True):
        assert np.allclose(a, b, atol=1e-6)


def test_an_outlier_is_found_and_bends_nothing(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(t, day + datetime.timedelta(i), 50 + 10 * (i % 7 == 0) + (i * i) % 3 + (200 if (t, i) == (1, 50) else 0)) for t in (1, 2) for i in range(70)] + [(3, day, 4)]
    series = spark.createDataFrame(rows, "topic_id long, day date, n long").repartition(4)
    got = {(r.topic_id, (r.day - day).days): r for r in loess.outliers(loess.decompose(series)).collect()}
    assert len(got) == 141 and got[1, 50].is_anomaly and not got[2, 50].is_anomaly
    assert abs(got[1, 50].expected - got[2, 50].expected) < 3 and got[1, 50].weight == 0
    assert (got[3, 0].trend, got[3, 0].season, got[3, 0].remainder) == (4, 0, 0)
    assert all(abs(r.n - r.trend - r.season - r.remainder) < 1e-9 for r in got.values())


# Clusters


def plain_dendrogram(m):
    sim = np.rint((m @ m.T) * 10**9).astype(np.int64)
    groups, out = {i: [i] for i in range(len(m))}, []
    while len(groups) > 1:
        keys = sorted(groups)
        best = max((sum(int(sim[i, j]) for i in groups[a] for j in groups[b]) / (len(groups[a]) * len(groups[b])), -a, -b) for k, a in enumerate(keys) for b in keys[k + 1 :])
        a, b = -best[1], -best[2]
        groups[a] += groups.pop(b)
        out.append((a, b, best[0] / 10**9, len(groups[a])))
    return out


def plain_flat(merges, n, made):
    root = list(range(n))
    for a, b, *_ in sorted(merges, key=lambda r: -r[2])[:made]:
        root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("last", [1_024, 30])
def test_average_linkage_equals_merging_one_pair_at_a_time(spark, last):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(9, 8))[rng.integers(0, 9, 60)] + 0.3 * rng.normal(size=(60, 8))
    m = m.astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "seq long, embedding array<float>")
    flat32 = np.array([np.array(v, np.float32) for v in m], float)
    flat32 /= np.linalg.norm(flat32, axis=1, keepdims=True)
    merges = agglomerative.dendrogram(df, last)
    want = plain_dendrogram(flat32)
    assert sorted(tuple(r) for r in merges.collect()) == sorted(want)
    heights = sorted((r[2] for r in want), reverse=True)
    made = max(range(60 - 12, 60 - 5 + 1), key=lambda k: (heights[k - 1] - (heights[k] if k < 59 else -1), -k))
    got = {r.seq: r.cluster for r in agglomerative.flat(df, merges, 5, 12).collect()}
    assert [got[i] for i in range(60)] == plain_flat(want, 60, made) and 5 <= len(set(got.values())) <= 12


def test_average_linkage_with_copies_by_vectors_alone(spark, tmp_path, monkeypatch):
    """Copies count as members, and no table of pairs is written."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 16)).astype(np.float32)
    m[7], m[30], m[31] = m[3], m[3], m[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "seq long, embedding array<float>")
    flat = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    monkeypatch.setattr("voicegrain.operators.cells.shared_dir", lambda spark: str(tmp_path))
    merges = agglomerative.dendrogram(df, 100)
    assert sorted(tuple(r) for r in merges.collect()) == sorted(plain_by_sums(flat))
    assert max(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()) <= 400  # was 400 * 399


def plain_by_sums(m):
    """As plain_dendrogram, on a matrix of sums."""
    sums, n, alive, out = np.rint((m @ m.T) * 10**9).astype(np.int64), np.ones(len(m), int), list(range(len(m))), []
    while len(alive) > 1:
        at = np.array(alive)
        mean = np.triu(sums[np.ix_(at, at)] / np.outer(n[at], n[at]) + 2e9, 1)
        i, j = divmod(int(mean.argmax()), len(at))
        a, b = alive[i], alive[j]
        out.append((a, b, sums[a, b] / (n[a] * n[b]) / 10**9, n[a] + n[b]))
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        n[a] += n[b]
        alive.remove(b)
    return out


def test_clusters_of_few_vectors(spark):
    one = spark.createDataFrame([(4, [1.0, 0.0])], "seq long, embedding array<float>")
    assert agglomerative.dendrogram(one).count() == 0
    assert [tuple(r) for r in agglomerative.flat(one, agglomerative.dendrogram(one)).collect()] == [(4, 4)]


# Alerts


def test_rules_are_checked_and_states_follow_actions(spark):
    with pytest.raises(ValueError, match="one of"):
        alerts.Rule("x", "topic", "volume")
    with pytest.raises(ValueError, match="no such"):
        alerts.Rule("x", "planet", "volume", above=1)
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)
    rows = [(f"{d}-{k}", 1, day(d), "question", 5, 0.0, 0.9, 0, False) for d, n in enumerate([2, 2, 2, 9, 9, 2, 9, 2, 2, 2, 2, 9]) for k in range(n)]
    units = spark.createDataFrame(rows, "unit_id string, account_id long, unit_date date, intent_type string, topic_id long, polarity double, confidence double, channel_id long, is_new_topic boolean")
    accounts = spark.createDataFrame([(1, "A")], "account_id long, segment string")
    rules = alerts.rules_from([{"rule_id": "many", "entity": "topic", "measure": "volume", "above": 5.0, "below": None, "cooldown": 2, "quiet": 5}, {"rule_id": "twice", "entity": "segment", "measure": "volume", "times": 2.0, "days": 3}])
    fired = alerts.firings(alerts.daily(units, accounts), rules)
    by_rule = {}
    for r in fired.collect():
        by_rule.setdefault(r.rule_id, []).append((r.day - day(0)).days)
    # The day before the first has no units, so that day 1 fires: 2 > 2 * 2 / 3. Day 4: 9 > 2 * 13 / 3; day 6: 9 < 2 * 20 / 3.
    assert {k: sorted(v) for k, v in by_rule.items()} == {"many": [3, 4, 6, 11], "twice": [1, 3, 4, 11]}
    told = lambda actions: [
        ((r.opened - day(0)).days, (r.last_fired - day(0)).days, r.n_firings, r.state)
        for r in alerts.alerts(fired, rules, spark.createDataFrame(actions, "rule_id string, entity string, day date, action string")).where("rule_id = 'many'").orderBy("opened").collect()
    ]
    none = [("many", "6", day(4), "resolve")]
    assert told(none) == [(3, 6, 3, "resolved"), (11, 11, 1, "open")]  # quiet since day 6
    assert told([("many", "5", day(4), "resolve"), ("many", "5", day(12), "acknowledge")]) == [(3, 4, 2, "resolved"), (6, 6, 1, "resolved"), (11, 11, 1, "acknowledged")]


def test_means_are_sums_in_the_order_of_units(spark):
    """Three numbers add up to -2.4 or to a bit beside it: the order of unit_id decides, whatever the order of the rows."""
    fiftieths = next(
        p for p in ([a, b, c] for a in range(-50, 1) for b in range(-50, 1) for c in range(-50, 1) if a + b + c == -120)
        if (p[0] / 50 + p[1] / 50 + p[2] / 50) / 3 < -0.8 <= (p[2] / 50 + p[1] / 50 + p[0] / 50) / 3
    )
    day = datetime.date(2024, 1, 1)
    schema = "unit_id long, account_id long, unit_date date, intent_type string, topic_id long, polarity double, confidence double, channel_id long, is_new_topic boolean"
    rows = [(3 * who + i, who, day, "question", 1, x / 50, 0.9, 0, False) for who in range(40) for i, x in enumerate(fiftieths if who % 2 else fiftieths[::-1])]
    accounts = spark.createDataFrame([(who, "A") for who in range(40)], "account_id long, segment string")
    rule = alerts.Rule("mood", "account", "polarity", below=-0.8)
    for parts, given in ((1, rows), (1, rows[::-1]), (7, sorted(rows, key=lambda r: (r[0] * 7_919) % 121))):
        units = spark.createDataFrame(given, schema).repartition(parts) if parts > 1 else spark.createDataFrame(given, schema).coalesce(1)
        got = sorted(int(r.entity) for r in alerts.firings(alerts.daily(units, accounts), [rule]).collect())
        assert got == list(range(1, 40, 2))
