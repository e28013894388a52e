import random

import numpy as np
from arborlake.llm import covertree
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df, every=10, **kw):
    return covertree.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **kw)


def slow_mined(rows, every=10, positives=5, negatives=10, low=30, high=90):
    ints = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v], label) for i, v, label in rows]
    out = []
    for n, (a, v, label) in enumerate(ints):
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for m, (i, w, other) in enumerate(ints) if m != n)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            hits = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a, pid, r, h[1], -p, -h[0]) for r, h in enumerate(hits, 1)]
    return sorted(out)


def random_rows(n, dims, seed):
    """Clumps, loose rows, lengths that differ, exact ties."""
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        base = draw.choice(middle) if i % 2 else [draw.gauss(0, 1) for _ in range(dims)]
        stretch = draw.choice([0.3, 1, 1, 2])
        rows.append((i, [stretch * x + draw.gauss(0, 0.05) for x in base], draw.randrange(4)))
    rows += [(n + i, rows[i * 3][1], draw.randrange(4)) for i in range(n // 10)]
    return rows


def test_equals_brute_force(spark):
    for seed, dims in ((1, 6), (2, 24)):
        rows = random_rows(700, dims, seed)
        got = mined(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect())) == slow_mined(rows)


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    """Small regions, some of which are dealt over several shards, and small leaves."""
    rows = random_rows(900, 5, 7) + [(2000 + i, [1.0, 1.0, 0.0, 0.0, 0.5], i % 2) for i in range(120)]
    monkeypatch.setattr(covertree, "shard_rows", lambda count: 60)
    got = mined(spark.createDataFrame(rows, SCHEMA), every=30, positives=3, negatives=4)
    assert sorted(map(tuple, got.collect())) == slow_mined(rows, 30, 3, 4)


def searcher(x, labels=None):
    n = len(x)
    return covertree.Searcher(np.arange(n), np.arange(n), np.ones(n, bool), np.zeros(n, np.int64) if labels is None else labels, x,
                              int((x * x).sum(axis=1).max()))


def test_tree_covers_and_separates():
    draw = np.random.default_rng(1)
    points = covertree.augmented(np.rint(draw.normal(0, 40, (30, 8))[draw.integers(0, 30, 3000)] + draw.normal(0, 6, (3000, 8))).astype(np.int64), 10 ** 6)
    tree = covertree.Tree(points)
    assert sorted(tree.order.tolist()) == list(range(3000))

    def below(node):
        a, b = tree.child[node]
        if a == b:
            return tree.order[slice(*tree.leaf[node])]
        return np.concatenate([below(c) for c in range(a, b)])

    for node in range(len(tree.centre)):
        away = np.linalg.norm(points[below(node)] - points[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] * (1 + 1e-9) + 1e-9
        a, b = tree.child[node]
        if b > a:
            inside = points[tree.centre[a:b]]
            apart = np.linalg.norm(inside[:, None] - inside[None], axis=2)[np.triu_indices(b - a, 1)]
            assert tree.centre[a] == tree.centre[node] and (apart > tree.radius[node] / 2).all()


def test_windows_skip_nodes():
    """Of clumps far from the anchor's window nothing is verified."""
    draw = np.random.default_rng(2)
    x = np.rint(draw.normal(0, 100, (40, 16))[draw.integers(0, 40, 8000)] + draw.normal(0, 2, (8000, 16))).astype(np.int64)
    tree = searcher(x)
    anchor = (np.array([9999]), np.array([1]), x[:1])
    scores = x @ x[0]
    low, high = np.percentile(scores, [90, 95]).astype(np.int64)
    win, at, score = tree.search(anchor, np.zeros(1, np.int64), np.array([low]), np.array([high]), False, 10)
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if low <= s <= high)[:10]
    assert [(-s, i) for s, i in zip(score.tolist(), tree.rows[at].tolist())] == want
    assert tree.visited < 8000 / 4


def test_odd_rows(spark):
    good = [1.0, 0.5]
    rows = [(0, good, 1), (0, good, 1), (10, None, 1), (20, good, None), (30, [1.0, None], 1), (40, [NAN, 1.0], 1), (50, [INF, 1.0], 1),
            (60, [], 1), (70, [0.5], 2), (None, [0.5, 0.4], 2), (3, [3e38, 1.0], 2), (4, [0.4, 0.5], 2), (5, [-1.0, -1.0], 3)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", v string, anchor int, score int")
    got = mined(df)
    assert got.columns == COLUMNS
    # Both rows 0 have each other and the empty vector as positives; 0.5 * 1 stays in the window of the first.
    found = sorted({(r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in got.collect() if r.anchor_id == 0}, key=str)
    assert found == [(0, 0, 1, None), (0, 0, 2, 4), (0, 0, 3, 70)]
    none = mined(spark.createDataFrame([], SCHEMA))
    assert none.columns == COLUMNS and none.count() == 0
    assert mined(df.filter("vec_id = 5")).count() == 0
    assert mined(df.filter("vec_id = 60")).count() == 0
