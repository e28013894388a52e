"""Rollups and samples don't exchange rows or the directory table to meet a few directories."""

from arborlake.operators import aggregate as agg, hierarchy as h
from conftest import frame, record

ROWS = ([record(5, 5, ".", is_dir=True), record(10, 5, "a", is_dir=True), record(11, 5, "b", is_dir=True)]
        + [record(100 + i, 10 + i % 2, f"d{i}", is_dir=True) for i in range(8)]
        + [record(1000 + i, 100 + i % 8, f"f{i % 5}.txt", 10 + i) for i in range(64)] + [record(2000, 5, "top.txt", 7), record(2001, 10, "in_a.txt", 8)])


def test_rows_near_the_root_are_found_without_an_exchange(spark, capsys):
    df = frame(spark, ROWS)
    dirs = h.build_directories(df)
    agg._subtree_groups(df, dirs, *_places(), {}).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin [drive" in plan and "/own-" in plan
    got = {r.key: (r["count"], r.total_bytes) for r in agg.rollup_path(df, dirs, 1).collect()}
    a = [r for r in ROWS if r[2] in (10, *range(100, 108, 2))]
    assert got["C:\\a"] == (len(a) + 1, sum(r[5] for r in a)) and got["C:\\top.txt"] == (1, 7)


def _places():
    from pyspark.sql import functions as F
    deep = F.col("depth") > 1
    return F.when(deep, h.path_at_depth(F.col("path"), 1)), ~deep


def test_samples_take_only_the_parents_they_need(spark, capsys):
    df = frame(spark, ROWS)
    dirs = h.build_directories(df)
    out = agg.terms(df.filter("not is_directory"), "name", 2, sample=2, dirs=dirs)
    out.explain()
    assert "/picked-" in capsys.readouterr().out
    paths = {(s.rank, s.path) for r in out.collect() for s in r.samples}
    assert all(p is not None and "<unknown" not in p for _, p in paths) and paths
