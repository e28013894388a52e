import hashlib
import random

import numpy as np
from arborlake.llm import shallot, vectors

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int"


def slow_clusters(rows, k, rounds, dims=64):
    """rows: (id, integers); plain k-means with exact integers, as lists sorted like the result."""
    name = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [list(v) for _, v in sorted(rows, key=lambda r: (*name(r[0]), r[1]))[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda: [min((gap(v, c), i) for i, c in enumerate(centres)) for _, v in rows]
    for _ in range(rounds):
        at = place()
        for i in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(rows, at) if c == i]
            if own:
                centres[i] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, c, d) for (i, _), (d, c) in zip(rows, place())], centres


def random_rows(n, dims, seed, clumps=5):
    draw = random.Random(seed)
    middle = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(clumps)]
    return [(i, [x + draw.gauss(0, 0.02 if i % 3 else 0.5) for x in draw.choice(middle)], 0) for i in range(n)]


def test_equals_plain_rounds(spark):
    rows = random_rows(300, 8, 1)
    rows += [(1000 + i, rows[i][1], 0) for i in range(40)]  # equal vectors under other ids
    df = spark.createDataFrame(rows, SCHEMA)
    ints = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v, _ in rows]
    for k, rounds in ((7, 4), (1, 2), (12, 0)):
        got = shallot.clusters(df, k=k, rounds=rounds, dims=8).collect()
        want, centres = slow_clusters(ints, k, rounds)
        assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
        assert all(list(r.centroid) == centres[r.cluster] for r in got)
        total = sum(d for *_, d in want)
        assert all(r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) for r in got)


def test_bounds_skip_and_stay_right():
    draw = np.random.default_rng(3)
    x = np.rint(draw.normal(0, 300, (20, 16))[draw.integers(0, 20, 4000)] + draw.normal(0, 10, (4000, 16))).astype(np.int64)
    centres = x[:20].copy()
    n = len(x)
    state = (np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n))
    geo, stats = shallot._geometry(centres), []
    for _ in range(6):
        stats.append({})
        state = shallot.nearest(x, geo, *state, stats=stats[-1])
        full = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (state[0] == full.argmin(axis=1)).all()
        assert (np.sqrt(full[np.arange(n), state[0]]) <= state[2]).all()
        others = full.astype(float)
        others[np.arange(n), state[0]] = np.inf
        assert (np.sqrt(others.min(axis=1)) >= state[3]).all()
        after = np.array([x[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else centres[c]
                          for c in range(20)])
        geo = shallot._geometry(after, np.sqrt(((after - centres) ** 2).sum(axis=1)) * (1 + shallot.SLACK))
        centres = after
    assert sum(s["distances"] for s in stats) < 6 * n * 20 / 3 and stats[-1]["skipped"] > n / 2


def test_ties_go_to_the_smaller_number(spark):
    """Centroids that coincide, and rows halfway between two."""
    rows = [(i, [float(i % 3) / 256] * 4, 1) for i in range(30)]
    got = shallot.clusters(spark.createDataFrame(rows, SCHEMA), k=6, rounds=3, dims=4).collect()
    want, _ = slow_clusters([(i, [i % 3] * 4) for i in range(30)], 6, 3)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)


def test_odd_rows(spark):
    good = [0.5, -0.25]
    rows = [(1, good, None), (1, good, None), (2, None, 1), (3, [], 1), (4, [1.0], 1), (5, [1.0, None], 1), (6, [NAN, 1.0], 1),
            (7, [INF, 1.0], 1), (None, [0.25, 0.25], 1), (8, [3e38, -3e38], 1), (9, [1.0, 2.0, 3.0], 1)]
    extra = [(*r, "x", 1, 2.0) for r in rows]
    df = spark.createDataFrame(extra, SCHEMA + ", v string, cluster int, distance double")
    got = shallot.clusters(df, k=3, rounds=2, dims=2)
    assert sorted((str(r.vec_id), r.distance >= 0) for r in got.collect()) == [("1", True), ("1", True), ("8", True), ("None", True)]
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    none = shallot.clusters(spark.createDataFrame([], SCHEMA))
    assert none.columns == got.columns and none.count() == 0
    assert shallot.clusters(df.filter("vec_id = 2"), dims=2).count() == 0


def test_packed_rows_keep_their_values():
    small, large = np.array([[1, -2], [300, 4]]), np.array([[1 << 20, -5]])
    import pyarrow as pa

    both = pa.concat_arrays([vectors.pack(small), vectors.pack(large)])
    assert vectors.unpack(both, 2).tolist() == [[1, -2], [300, 4], [1 << 20, -5]]
    assert vectors.unpack(both.slice(1), 2).tolist() == [[300, 4], [1 << 20, -5]]
    assert vectors.unpack(vectors.pack(np.zeros((3, 0), np.int64)), 0).shape == (3, 0)
