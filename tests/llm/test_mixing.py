"""Training positions of the mix: they follow the schedules, and every pass has its own."""

import random
from collections import defaultdict

from starloom.llm import mixing


def words(n):
    return "w " * n


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_every_tenth_of_training_holds_its_share_of_each_source(spark):
    rng = random.Random(4)
    rows = [(i, words(rng.randrange(1, 30)), rng.choice("aaaaabbbbbbcccccccccccccc")) for i in range(3000)]
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    got = mixing.mix(table(spark, rows)).collect()
    target = {source[r.doc_id]: r.target for r in got}
    whole = {source[r.doc_id]: r.source_size for r in got}
    assert target["a"] == 2 * whole["a"]  # at its cap: taken twice
    seen = defaultdict(lambda: [0.0] * 10)
    for r in got:
        left = r.taken
        for p in r.positions:
            n = min(left, size[r.doc_id])
            left -= n
            seen[source[r.doc_id]][min(9, int(p * 10))] += n
        assert left == 0
    for k, name in enumerate("abc"):
        knots = mixing.SCHEDULES[k]
        weight = lambda t, knots=knots: next(w0 + (w1 - w0) * (t - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t <= t1)
        for d in range(10):
            area = sum(weight((d * 100 + i + 0.5) / 1000) for i in range(100)) / 1000  # midpoints
            assert abs(seen[name][d] - target[name] * area / mixing.integral(knots)) <= 31
    late = max(p for r in got if source[r.doc_id] == "a" for p in r.positions)
    assert late > 0.99


def test_copies_are_far_apart(spark):
    rows = [(i, words(5), "a") for i in range(100)] + [(1000 + i, words(5), "b") for i in range(400)]
    df = table(spark, rows)
    ids = [r.doc_id for r in mixing.mixed_documents(df).collect()]
    places = defaultdict(list)
    for k, i in enumerate(ids):
        places[i].append(k)
    twice = [p for p in places.values() if len(p) == 2]
    assert len(twice) >= 100 and all(len(p) <= 2 for p in places.values())
    assert min(b - a for a, b in twice) > 50


def test_repeated_and_null_ids_ties_and_clashing_names(spark):
    rows = [(7, words(3), "a")] * 20 + [(None, words(2), "a"), (None, words(2), "a"), (None, None, "b"), (3, "", None), (4, words(100_000), "b")]
    df = table(spark, rows).selectExpr("*", "1 as _key", "2 as size", "'x' as _order", "3 as _bucket", "4 as positions")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == 60 + 4 + 100_000
    assert all(len(r.positions) == (r.taken > 0) + (r.taken > r.size) for r in got)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, mixing.mixed_documents(df.repartition(3)).collect()))
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_targets_of_many_sources_over_many_partitions(spark):
    rng = random.Random(6)
    sizes = {f"h{k}": rng.choice([0, 1, 5, 200, 9000]) for k in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.source: (r.rank, r.target) for r in mixing.source_targets(df, [5.0, 2.0, 1.0]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(sizes)
    assert [got[n][0] for n in names] == list(range(700))
    low, high = 0.0, 1e9  # the level by halving
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[n], mid * (5, 2, 1)[k % 3]) for k, n in enumerate(names)) < 1.5 * sum(sizes.values()) else (low, mid)
    for k, n in enumerate(names):
        want = min(2 * sizes[n], low * (5, 2, 1)[k % 3])
        assert abs(got[n][1] - want) <= 1e-6 * max(1, want)
