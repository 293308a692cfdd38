"""T4/T5: the vectorised, partition-parallel fold against the rules one call at
a time."""

import random

import numpy as np
import pytest

from threatlens.streaming import state as st


def plain(times, limit, window):
    log = st.SlidingLog(limit, window)
    return [log.step(t) for t in times]


@pytest.mark.parametrize("limit", [1, 2, 5, 30])
def test_decide_matches_the_rule_in_any_batches(limit):
    rng = random.Random(limit)
    for trial in range(150):
        window = rng.choice([1, 5, 50, 1000])
        t = np.cumsum([rng.choice([0, 0, 1, 2, rng.randrange(2 * window + 1)]) for _ in range(rng.randrange(1, 120))])
        want = plain(t.tolist(), limit, window)
        got, kept, lo = [], [], 0
        while lo < len(t):
            hi = min(len(t), lo + rng.randrange(1, 40))
            part = t[lo:hi]
            before = t[lo - 1] if lo else None
            head = np.r_[before is None or part[0] - before >= window, part[1:] - part[:-1] >= window]
            flags, kept = st.decide(part, head, kept, limit, window)
            got += flags.tolist()
            lo = hi
        assert got == want, (trial, window, t.tolist())


def test_anchor_rule_is_the_throttle_with_one_place():
    t = [0, 3, 9, 10, 11, 20, 20, 35]
    anchor = st.TtlAnchor(10)
    assert [anchor.step(x) for x in t] == plain(t, 1, 10)


@pytest.mark.parametrize("limit,window", [(1, 300), (3, 60), (30, 60)])
def test_hot_key_spread_over_partitions(spark, limit, window):
    """Two keys of long stretches without gaps, one with gaps, null keys, ties."""
    rng = random.Random(5)
    rows, i = [], 0
    for key, n, gap in (("hot", 6000, 3), ("warm", 3000, 40), ("gaps", 500, 4 * window), (None, 300, 20), ("one", 1, 1)):
        t = 0
        for _ in range(n):
            t += rng.randrange(gap)
            rows.append((key, t, i))
            i += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, s long, id long").selectExpr("k", "id", "timestamp_seconds(s) AS ts").repartition(6)
    out = st.throttle(df, "k", "ts", limit, window, num_partitions=23, tie="id").collect()
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((s, i) for k, s, i in rows if k == key)
        want |= dict(zip((i for _, i in mine), plain([s for s, _ in mine], limit, window)))
    assert len(out) == len(rows) and {r.id: r.limited for r in out} == want
    if limit == 1:
        hit = st.ttl_reuse(df, "k", "ts", window, num_partitions=7, tie="id").collect()
        assert {r.id: r.cache_hit for r in hit} == want


def test_hot_key_is_not_one_task(spark):
    df = spark.range(40_000).selectExpr("'hot' AS k", "id", "timestamp_seconds(id) AS ts")
    out = st.throttle(df, "k", "ts", 5, 60, num_partitions=16, tie="id")
    sizes = [n for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert sum(sizes) == 40_000 and max(sizes) < 15_000
    assert out.where("not limited").count() == sum(not x for x in plain(range(40_000), 5, 60))


def test_empty_table(spark):
    df = spark.range(0).selectExpr("'x' AS k", "id", "timestamp_seconds(id) AS ts")
    assert st.throttle(df, "k", "ts", 2, 60, tie="id").collect() == []
