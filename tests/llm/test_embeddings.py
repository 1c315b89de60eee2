"""Links of vectors against all pairs in plain numpy."""

import math

import numpy as np
import pytest

from starloom.llm import embedding_dedup


def brute_vectors(rows, t=0.93):
    n = len(rows)
    deg, up, unit = [0] * n, list(range(n)), []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        v = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t:
                deg[i] += 1
                deg[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    first = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            first[root(i)] = min(first.get(root(i), vec), vec)
    return [(rows[i][0], deg[i], None if rows[i][0] is None else first[root(i)], rows[i][0] is not None and first[root(i)] == rows[i][0]) for i in range(n)]


def check(spark, rows, schema="vec_id long, embedding array<double>, label int", **more):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as h1", "2 as cls", "3 as n_links", "4 as component")
    got = [tuple(r) for r in embedding_dedup.dedup_embeddings(df, **more).collect()]
    assert sorted(got, key=repr) == sorted(brute_vectors(rows), key=repr)


def clusters(dims=16, groups=12, members=9, labels=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(groups):
        center = rng.standard_normal(dims)
        for _ in range(members):
            rows.append((len(rows), (center + rng.standard_normal(dims) * rng.choice([0.05, 0.2, 0.3])).tolist(), c % labels))
    return rows


# all in one chunk; two chunks a label; chunks of ten vectors
@pytest.mark.parametrize("more", [{}, {"halved": 5}, {"chunk_bytes": 10 * 16 * 8}])
def test_near_vectors(spark, more):
    rows = clusters()
    odd = [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1), ([None] * 16, 1), (rows[0][1], 0), (rows[0][1], 0), (rows[0][1], None), ([2 * x for x in rows[0][1]], 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([], 0), ([3.0], 0), ([-3.0], 0), ([5.0], 0)]
    rows += [(len(rows) + k, v, lab) for k, (v, lab) in enumerate(odd)]
    check(spark, rows, **more)


def test_repeated_and_null_ids_have_links_of_their_own(spark):
    rows = clusters(groups=4, members=5, labels=1)
    rows = [(k // 3, v, lab) for k, v, lab in rows] + [(None, rows[0][1], 0), (None, rows[7][1], 0), (5, rows[0][1], 0), (5, [9.0] * 16, 0), (5, [9.0] * 16, 0)]
    check(spark, rows)


def test_vectors_of_any_size(spark):
    base = np.random.default_rng(2).standard_normal(8)
    rows = [(k, (base * s).tolist(), 1) for k, s in enumerate([1, 1e200, -1e200, 1e-200, 1e-310, 1e300])]
    check(spark, rows)
    floats = [(k, np.float32(base * s).tolist(), 1) for k, s in enumerate([1, 1e30, 1e-30])]
    check(spark, floats, "vec_id long, embedding array<float>, label int")


def test_one_hot_vector_and_many_near_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(k, (base + rng.standard_normal(32) * 0.15).tolist() if k % 3 else base.tolist(), 0) for k in range(900)]
    check(spark, rows, halved=200)
    check(spark, rows)


def test_tiles_hold_every_row_once_and_their_boxes_prune_nothing_near():
    rng = np.random.default_rng(5)
    # far-apart clusters, so that most pairs of tiles are skipped
    centers = rng.standard_normal((40, 24))
    v = np.concatenate([c + rng.standard_normal((60, 24)) * 0.12 for c in centers])
    tiles = embedding_dedup.tiles_of(v, np.arange(len(v)), 64)
    assert sorted(np.concatenate(tiles).tolist()) == list(range(len(v))) and max(map(len, tiles)) <= 64
    for side in (None, rng.integers(0, 2, len(v))):
        links, root = embedding_dedup.links_among(v, np.ones(len(v), np.int64), side, 0.93, 8)
        u = embedding_dedup.unit(v)
        hit = (u @ u.T >= 0.93) & ~np.eye(len(v), dtype=bool)
        if side is not None:
            hit &= side[:, None] != side
        assert (links == hit.sum(axis=1)).all() and (links > 0).any()
        want = np.arange(len(v))
        while (after := np.where(hit, want, len(v)).min(axis=1)).__le__(want - 1).any():
            want = np.minimum(want, after)
        assert (root == want).all()
