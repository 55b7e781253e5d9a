"""Ordered operators against plain loops, with one key that holds most rows."""

import random

import pytest

from gradeloom.operators import ordered as od


def rows_of(rng, n):
    """(key, order, value): half of the rows are of key 0, some values are null."""
    return [(rng.choice([0, 0, 0, 1, 2, None]), k, None if rng.random() < 0.1 else rng.uniform(-5, 5)) for k in range(n)]


@pytest.mark.parametrize(("alpha", "start"), [(0.3, None), (0.001, None), (0.97, None), (0.12, 1.0)])
def test_ema(spark, alpha, start):
    rows = rows_of(random.Random(3), 6000)
    df = spark.createDataFrame(rows, "k int, n int, x double").repartition(5)
    got = {r.n: r.smooth for r in od.ema(df, "k", ["n"], "x", alpha, start).collect()}
    state, want = {}, {}
    for k, n, x in rows:
        if x is not None:
            before = state.get(k, x if start is None else start)
            state[k] = (1 - alpha) * before + alpha * x
        want[n] = state.get(k, start)
    assert got.keys() == want.keys() and all(got[n] == (None if want[n] is None else pytest.approx(want[n], abs=1e-12)) for n in want)


def test_throttle(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(40_000), i) for i in range(1500)]
    rows += [(7, 5, 9001), (7, 5, 9002), (7, 355, 9003), (7, 354, 9004)]
    df = spark.createDataFrame(rows, "k int, t long, id long").repartition(3)
    want, last = set(), {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or t - last[k] >= 350:
            last[k] = t
            want.add(i)
    assert {r.id for r in od.throttle_events(df, "k", "t", "id", 350).collect()} == want
    assert od.throttle_events(df.filter("k > 99"), "k", "t", "id", 350).collect() == []


def test_steady_labels(spark):
    from gradeloom.streaming.stateful import label_step

    rng = random.Random(9)
    rows = [(rng.choice([0, 0, 1, 2]), n, rng.choice("aaabbc"), rng.choice([0.2, 0.4, 0.9]), rng.random() < 0.8) for n in range(900)]
    df = spark.createDataFrame(rows, "k int, frame int, label string, confidence double, usable boolean").repartition(4)
    for confirm, switch in ((2, 3), (1, 2), (4, 1)):
        state, want = {}, {}
        for r in df.orderBy("frame").collect():
            state[r.k], out = label_step(state.get(r.k, (None, 0, [], [], None, 0)), r, confirm, switch)
            want[r.frame] = out[1]
        got = {r.frame: r.shown for r in od.steady_labels(df, "k", "frame", "label", "confidence", "usable", confirm, switch).collect()}
        assert got == want


def test_deal_equals_greedy():
    rng = random.Random(4)
    for _ in range(300):
        k = rng.randint(2, 6)
        loads = [rng.randrange(30) for _ in range(k)]
        totals, ties = [x + rng.randrange(40) for x in loads], rng.sample(range(k), k)
        size, number = rng.randint(1, 9), rng.randint(1, 60)
        segments, taken = od.deal(list(loads), list(totals), ties, size, number)
        now, whole, want = list(loads), list(totals), []
        for _ in range(number):
            f = min(range(k), key=lambda f: (now[f], whole[f], ties[f]))
            want.append(f)
            now[f] += size
            whole[f] += size
        got = []
        for j in range(number):
            start, active = [s for s in segments if s[0] <= j][-1]
            got.append(active[(j - start) % len(active)])
        assert got == want and taken == [want.count(f) for f in range(k)]


def test_balanced_folds(spark):
    rng = random.Random(6)
    rows = [(f"g{g}", g % 2) for g in range(60) for _ in range(rng.choice([1, 1, 1, 2, 5, 9]))]
    df = spark.createDataFrame(rows, "grp string, label int")
    got = {r.grp: r for r in od.balanced_group_folds(df, "grp", "label", 4, 1).collect()}
    assert {g: r.rows for g, r in got.items()} == {g: [x for x, _ in rows].count(g) for g in {x for x, _ in rows}}
    for label in (0, 1):
        loads = [sum(r.rows for r in got.values() if r.label == label and r.fold == f) for f in range(4)]
        assert max(loads) - min(loads) <= 9
    with pytest.raises(ValueError, match="several labels"):
        od.balanced_group_folds(df.union(spark.createDataFrame([("g0", 1)], df.schema)), "grp", "label", 4, 1)
    with pytest.raises(ValueError, match="fewer groups"):
        od.balanced_group_folds(df, "grp", "label", 31, 1)
