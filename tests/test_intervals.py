import random

from pyspark.sql import functions as F

from arborlake.operators import hierarchy as h, intervals
from conftest import frame, record
from test_hierarchy import random_tree


def nodes_of(spark, parents, drive="C"):
    return spark.createDataFrame([(drive, i, p) for i, p in parents.items()], "drive string, frs long, up long")


def slow_numbers(parents):
    """Pre-order of a forest {id: parent or None}, siblings by id."""
    kids = {}
    for i, p in sorted(parents.items()):
        kids.setdefault(p if p in parents else None, []).append(i)
    out, at, todo = {}, 0, [("in", i) for i in reversed(kids.get(None, []))]
    while todo:
        turn, i = todo.pop()
        if turn == "in":
            out[i] = [at, None]
            at += 1
            todo.append(("out", i))
            todo += [("in", k) for k in reversed(kids.get(i, []))]
        else:
            out[i][1] = at
    return {i: tuple(v) for i, v in out.items()}


def forest(seed, n, reach):
    rng = random.Random(seed)
    ids = list(range(1, n + 1))
    rng.shuffle(ids)
    return {x: (rng.choice(ids[max(0, k - reach):k]) if k and rng.random() > 0.03 else rng.choice([None, 10 ** 6])) for k, x in enumerate(ids)}


def above(parents, i):
    while i in parents:
        yield i
        i = parents[i]


def test_numbers_of_any_forest(spark):
    for seed, n, reach in ((1, 200, 3), (2, 300, 300), (3, 1, 1)):
        parents = forest(seed, n, reach)
        two = nodes_of(spark, parents).unionByName(nodes_of(spark, {5: None, 7: 5}, "D"))
        got = {(r.drive, r.frs): (r.lo, r.hi) for r in intervals.number(two).collect()}
        assert {k[1]: v for k, v in got.items() if k[0] == "C"} == slow_numbers(parents)
        assert got["D", 5] == (0, 2) and got["D", 7] == (1, 2)


def test_chain_of_ten_thousand_levels(spark):
    """Rows stay narrow and rounds few, however deep the chain is."""
    n = 10_000
    chain = nodes_of(spark, {i: i - 1 if i > 1 else None for i in range(1, n + 1)})
    numbers = intervals.materialize(intervals.number(chain), "numbers")
    assert numbers.filter("lo <> frs - 1 or hi <> 10000").count() == 0 and numbers.count() == n
    roots = spark.createDataFrame([("C", 4000), ("C", 9000)], "drive string, frs long")
    assert intervals.inside(numbers, roots).agg(F.min("frs"), F.max("frs"), F.count("*")).first() == (4000, n, 6001)
    near, around = intervals.innermost(numbers, roots)
    assert {(r.root, r.n) for r in near.groupBy("root").agg(F.count("*").alias("n")).collect()} == {(4000, 5000), (9000, 1001)}
    assert {(r.root, r.outer) for r in around.collect()} == {(4000, 4000), (9000, 9000), (9000, 4000)}


def test_below_and_nearest_root_of_many(spark):
    parents = forest(4, 250, 6)
    numbers = intervals.materialize(intervals.number(nodes_of(spark, parents)), "numbers")
    chosen = set(random.Random(1).sample(sorted(parents), 80))
    roots = spark.createDataFrame([("C", i) for i in chosen], "drive string, frs long")
    inside = {i for i in parents if chosen & set(above(parents, i))}
    assert {r.frs for r in intervals.inside(numbers, roots).collect()} == inside
    near, around = intervals.innermost(numbers, roots)
    assert {(r.frs, r.root) for r in near.collect()} == {(i, next(a for a in above(parents, i) if a in chosen)) for i in inside}
    assert {(r.root, r.outer) for r in around.collect()} == {(i, a) for i in chosen for a in above(parents, i) if a in chosen}


def test_operators_equal_a_walk(spark, monkeypatch):
    """Nested roots, broken chains, a cycle; by a filter and by a sorted pass."""
    records = random_tree(7, n_dirs=80, lost=9)
    records += [record(900, 901, "x", is_dir=True), record(901, 900, "y", is_dir=True), record(902, 901, "in_cycle"),
                record(903, 7777, "hanging", is_dir=True), record(904, 903, "under", is_dir=True), record(905, 904, "file")]
    df = frame(spark, records)
    dirs = h.build_directories(df)
    chosen = {("C", i) for i in (100, 107, 112, 900, 903, 1003)} | {("D", i) for i in (5, 101, 130)}
    roots = df.join(spark.createDataFrame(list(chosen), "drive string, frs long"), h.KEY, "left_semi")
    by_key = {(r[0], r[1]): r for r in records}

    def ups(key):
        seen, row = [], by_key[key]
        while (up := (row[0], row[2])) in by_key and up != (row[0], row[1]) and up not in seen:
            seen.append(up)
            row = by_key[up]
        return seen

    pairs = set()
    for key in by_key:
        if key[1] in (0, 5):
            continue
        chain = [key, *ups(key)]
        for i, up in enumerate(chain[1:], 1):
            if up in chosen and up != key:
                pairs.add((*key, up[1], chain[i - 1][1]))
    outside = lambda rows: {r for r in rows if r[1] not in (900, 901, 902)}
    got = outside({tuple(r) for r in h.descendants_of(df, dirs, roots).collect()})
    assert got == outside(pairs)
    want = chosen | {(d, f) for d, f, *_ in pairs}
    for few in (64, 0):
        monkeypatch.setattr(h, "FEW_INTERVALS", few)
        rows = h.expand_descendants(df, dirs, roots).select(*h.KEY).collect()
        assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == want | {("C", 902), ("C", 901)}


def test_few_roots_are_a_range_filter(spark, small):
    dirs = h.build_directories(small)
    plan = h.directories_below(dirs, small.filter("frs = 11"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(lo" in plan and "LessThan(lo" in plan
