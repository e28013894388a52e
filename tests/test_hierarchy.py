import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from arborlake.operators import aggregate as agg, hierarchy as h, links
from arborlake.sources import binding
from conftest import frame, record, walk


def random_tree(seed, n_dirs=60, n_files=150, drives="CD", lost=0):
    rng = random.Random(seed)
    out = []
    for drive in drives:
        out.append(record(5, 5, ".", is_dir=True, drive=drive))
        ids = [5]
        for i in range(n_dirs):
            frs = 100 + i
            out.append(record(frs, rng.choice(ids[-8:]), f"d{i}", rng.randrange(3) * 10, True, drive))
            ids.append(frs)
        for i in range(n_files):
            parent = 9_000 + i % 7 if i < lost else rng.choice(ids)
            out.append(record(1_000 + i, parent, f"f{i}.txt", rng.randrange(100_000), drive=drive))
    return out


def as_dict(df, *columns):
    return {(r["drive"], r["frs"]): tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
            for r in df.collect()}


def test_paths_of_small_tree(spark, small):
    dirs = h.build_directories(small)
    got = as_dict(h.with_paths(small, dirs), "path")
    assert got[("C", 15)] == "C:\\folder_a\\sub_folder\\file_y.PDF"
    assert got[("C", 5)] == "C:\\" and got[("C", 11)] == "C:\\folder_a"
    closed = as_dict(h.with_paths(small, dirs, dir_suffix=True), "path")
    assert closed[("C", 14)] == "C:\\folder_a\\sub_folder\\" and closed[("C", 5)] == "C:\\"


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_match_a_walk(spark, seed):
    records = random_tree(seed, lost=9)
    df = frame(spark, records)
    plain = h.build_directories(df)
    assert as_dict(h.with_paths(df, plain), "path") == walk(records)
    assert as_dict(h.with_paths(df, plain, covered=True), "path") == walk(records)


def test_deep_chain_and_cycle(spark):
    deep = [record(5, 5, ".", is_dir=True)]
    deep += [record(100 + i, 5 if i == 0 else 99 + i, f"d{i}", is_dir=True) for i in range(300)]
    deep += [record(900, 901, "x", is_dir=True), record(901, 902, "y", is_dir=True), record(902, 900, "z", is_dir=True),
             record(903, 900, "tail", is_dir=True), record(904, 904, "self", is_dir=True), record(950, 903, "f")]
    df = frame(spark, deep)
    dirs = h.build_directories(df)
    states = as_dict(dirs.table, "state")
    assert states[("C", 399)] == h.OK and all(states[("C", i)] == h.CYCLIC for i in (900, 901, 902, 903, 904))
    paths = as_dict(h.with_paths(df, dirs), "path")
    assert paths[("C", 399)] == "C:\\" + "\\".join(f"d{i}" for i in range(300))
    assert {r["frs"] for r in h.orphans(df, dirs).collect()} == {900, 901, 902, 903, 904, 950}


def subtree(records):
    kids = {}
    for r in records:
        if r[1] != 5:
            kids.setdefault((r[0], r[2]), []).append(r)

    @lru_cache(None)
    def below(key):
        out = []
        for r in kids.get(key, []):
            out.append(r)
            if r[4]:
                out += below((r[0], r[1]))
        return out

    return kids, below


def test_tree_sums_against_recursion(spark):
    records = random_tree(5)
    df = frame(spark, records)
    dirs = h.build_directories(df)
    _, below = subtree(records)
    expected = {}
    for r in records:
        rows = below((r[0], r[1])) if r[4] else []
        expected[(r[0], r[1])] = (len(rows), r[5] + sum(x[5] for x in rows), r[6] + sum(x[6] for x in rows))
    got = as_dict(h.with_tree_metrics(df, h.tree_sums(df, dirs)), *h.TREE_COLUMNS)
    assert got == expected


def test_bulkiness_sums_against_recursion(spark):
    records = random_tree(6)
    df = frame(spark, records)
    dirs = h.build_directories(df)
    sums = h.tree_sums(df, dirs)
    allocated = as_dict(sums, "tree_allocated")
    kids, _ = subtree(records)

    def value(r):
        if not r[4]:
            return r[6]
        limit = allocated[(r[0], r[1])] // 100
        parts = [value(k) for k in kids.get((r[0], r[1]), [])]
        return sum(p for p in parts if limit == 0 or p < limit)

    expected = {(r[0], r[1]): value(r) for r in records if r[4]}
    assert as_dict(h.bulkiness_sums(df, dirs, sums), "bulkiness_sum") == expected


def test_expand_and_first_steps(spark):
    records = random_tree(8, drives="C")
    df = frame(spark, records)
    dirs = h.build_directories(df)
    _, below = subtree(records)
    roots = [r for r in records if r[1] in (100, 103, 120)]
    expected = {r[1] for root in roots for r in [root, *below(("C", root[1]))]}
    got = [r["frs"] for r in h.expand_descendants(df, dirs, frame(spark, roots)).collect()]
    assert sorted(got) == sorted(expected)
    steps = h.descendants_of(df, dirs, frame(spark, roots[:1])).collect()
    parent = {r[1]: r[2] for r in records}
    for r in steps:
        current = r["frs"]
        while parent[current] != 100:
            current = parent[current]
        assert r["first_step"] == current
    assert len(steps) == len(below(("C", 100)))


def test_ancestor_and_rollups(spark):
    records = random_tree(9, lost=5)
    df = frame(spark, records)
    dirs = h.build_directories(df)
    paths = walk(records)

    def key(r, depth):
        path = paths[(r[0], r[1])]
        if r[1] == 5:
            return path
        parts = path.split("\\")
        return "\\".join(parts[:depth + (2 if path.startswith("<") else 1)])

    for depth in (1, 2, 4):
        expected = {}
        for r in records:
            n, size = expected.get(key(r, depth), (0, 0))
            expected[key(r, depth)] = (n + 1, size + r[5])
        got = agg.rollup_path(df, dirs, depth, None, ("total_bytes",)).collect()
        assert {r["key"]: (r["count"], r["total_bytes"]) for r in got} == expected
    top = agg.rollup_path(df, dirs, 2, 5, ("total_bytes",)).collect()
    assert [r["total_bytes"] for r in top] == sorted((r["total_bytes"] for r in top), reverse=True)


def test_missing_parents_and_placeholders(spark):
    records = random_tree(10, lost=10)
    df = frame(spark, records)
    missing = {(r["drive"], r["parent_frs"]): r["children"] for r in h.missing_parents(df).collect()}
    assert set(k[1] for k in missing) == set(range(9_000, 9_007)) and sum(missing.values()) == 20
    filled = h.with_placeholders(df)
    assert h.missing_parents(filled).count() == 0
    assert filled.count() == len(records) + 14


def test_visible_rows(spark):
    records = [record(5, 5, ".", is_dir=True), record(11, 5, "$Extend", is_dir=True), record(30, 11, "in", is_dir=True),
               record(31, 30, "hidden.txt"), record(40, 5, "ok", is_dir=True), record(41, 40, "seen.txt"),
               record(42, 99, "lost.txt"), record(6, 5, "$Bitmap")]
    df = frame(spark, records)
    got = {r["frs"] for r in h.visible_rows(df, h.build_directories(df)).collect()}
    assert got == {5, 40, 41}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refresh_equals_rebuild(spark, seed):
    rng = random.Random(seed)
    records = random_tree(20 + seed, drives="C", lost=4)
    df = frame(spark, records)
    dirs = h.build_directories(df)
    after, changed = [], []
    for r in records:
        roll = rng.random() if r[4] and r[1] != 5 else 1
        if roll < 0.1:
            changed.append(r)                                   # deleted, children break
            continue
        if roll < 0.25:
            changed.append(r)
            r = (*r[:3], r[3] + "_new", *r[4:])                 # renamed
        after.append(r)
    new = record(9_001, 5, "found", is_dir=True)                # repairs broken chains
    files = [record(9_100, 777_000, "under_unknown"), record(9_101, 9_001, "plain_file"), record(9_102, None, "nowhere")]
    after += [new, *files]
    changed += [new, *files]
    now = frame(spark, after)
    refreshed = h.refresh_directories(dirs, now, frame(spark, changed))
    expected = {k: p for k, p in walk([r for r in after if r[2] is not None]).items()} | {("C", 9_102): "<unknown:>\\nowhere"}
    assert as_dict(h.with_paths(now, refreshed), "path") == expected
    assert as_dict(h.with_paths(now, refreshed, covered=True), "path") == expected
    rebuilt = h.build_directories(now)
    columns = ("path", "chain", "depth", "state")
    assert refreshed.table.count() == rebuilt.table.count()
    assert as_dict(refreshed.table, *columns) == as_dict(rebuilt.table, *columns)


def test_links_and_streams(spark):
    df = binding.linked_catalog(frame(spark, [
        record(5, 5, ".", is_dir=True), record(20, 5, "d", is_dir=True), record(31, 20, "a.txt", 1000, links=3),
        record(33, 20, "b.txt", 7, links=2), record(32, 20, "c.txt", 10)]))
    rows = links.expand_links(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["frs"], []).append((r["name"], r["stream_name"], r["size"]))
    assert len(by[31]) == 6 and len(by[33]) == 2 and len(by[32]) == 2   # $OBJECT_ID is left out
    assert ("link1_a.txt", "Zone.Identifier", 26 + 31 % 7) in by[31]
    dirs = h.build_directories(df)
    sums = as_dict(links.tree_sums_by_stream(df, dirs), "descendants", "treesize")
    # 31 has two streams on three links, link 1 in the root; 33 one on two; 32 three on one.
    assert sums[("C", 20)][0] == 2 * 2 + 1 + 3 + 1
    assert sums[("C", 5)] == (2 * 3 + 1 * 2 + 3 + 1 + 1, 1000 + (26 + 3) + 7 + 10 + 16 + 26 + 32 % 7)
    legacy = links.expand_links(df, legacy_dir_names=True).filter("is_directory").collect()
    assert {r["name"] for r in legacy} == {""}


def test_overlay_compressed_stream_counts_once(spark):
    base = binding.linked_catalog(frame(spark, [record(5, 5, ".", is_dir=True), record(30, 5, "w.bin", 100, alloc=0)]))
    stream = F.struct(*[F.lit(v).alias(n) for n, v in (
        ("name", "WofCompressedData"), ("size", 60), ("allocated_size", 64), ("is_sparse", False),
        ("is_compressed", False), ("is_resident", False))])
    kind = base.schema["streams"].dataType
    df = base.withColumns({
        "streams": F.when(F.col("frs") == 30, F.array(stream).cast(kind)).otherwise(F.col("streams")),
        "reparse_tag": F.when(F.col("frs") == 30, F.lit(links.OVERLAY_TAG))})
    got = as_dict(links.tree_sums_by_stream(df, h.build_directories(df)), "treesize", "tree_allocated")
    assert got[("C", 5)] == (100, 64)


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_deltas_of_many_changes_equal_rebuilds(spark, seed, monkeypatch):
    """Nested renames and moves, deletions and new directories, lost and found parents, over several layers."""
    monkeypatch.setattr(h, "MAX_LAYERS", 3)
    rng = random.Random(seed)
    rows = {(r[0], r[1]): r for r in random_tree(seed, n_dirs=40, n_files=40, lost=5)}
    bad = {k for k in rows if seed == 13 and rng.random() < 0.1}

    def frames():
        df = frame(spark, list(rows.values()))
        names = F.encode("name", "UTF-8")
        keys = F.concat_ws(":", "drive", F.col("frs").cast("string")).isin(*[f"{d}:{f}" for d, f in bad] or [""])
        return df.withColumn("name_bytes", F.when(keys, F.concat(names, F.unhex(F.lit("EDB3BF")))).otherwise(names))

    dirs, columns = h.build_directories(frames()), ("path", "chain", "depth", "state", "top", "parent_frs", "bad_name")
    written = []
    for step in range(4):
        changed = set()
        folders = sorted(k for k, r in rows.items() if r[4] and k[1] != 5)
        for key in rng.sample(folders, 7):
            r = rows[key]
            turn = rng.random()
            changed.add(key)
            if turn < 0.15:
                del rows[key]
            elif turn < 0.5:
                rows[key] = (*r[:3], f"r{step}{r[3]}", *r[4:])
            else:
                target, below = rng.choice([k for k in folders if k in rows and k[0] == key[0]] + [(key[0], 5)]), {key}
                for _ in rows:
                    below |= {k for k, x in rows.items() if (x[0], x[2]) in below}
                if target not in below:
                    rows[key] = (*r[:2], target[1], *r[3:])
        for i in range(2):
            key = ("C", 9_000 + i + step) if step % 2 else ("C", 500 + 10 * step + i)
            rows[key] = record(key[1], rng.choice([k[1] for k in rows if k[0] == "C" and rows[k][4]]), f"new{step}{i}", is_dir=True)
            changed.add(key)
        df = frames()
        delta = h._delta
        monkeypatch.setattr(h, "_delta", lambda *a: written.append(delta(*a)) or written[-1])
        dirs = h.refresh_directories(dirs, df, frame(spark, [record(f, 5, "x", drive=d) for d, f in changed]))
        monkeypatch.setattr(h, "_delta", delta)
        assert as_dict(dirs.table, *columns) == as_dict(h.build_directories(df).table, *columns)
    assert seed == 13 or all(w is not None for w in written)


def test_a_rename_writes_only_what_is_below(spark):
    tree = random_tree(5, n_dirs=200, n_files=0, drives="C")
    df = frame(spark, tree)
    dirs = h.build_directories(df)
    now = df.withColumn("name", F.when(F.col("frs") == 290, F.lit("other")).otherwise(F.col("name")))
    keys = df.filter("frs = 290").select(h.KEY)
    rows, gone = h._delta(dirs, now, keys)
    below = h.affected_directories(dirs, keys)
    assert rows.count() == gone.count() == below.count() < 60
    assert h.refresh_directories(dirs, now, keys).layers == 1
