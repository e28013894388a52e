"""Directories without directories below them are not walked in rounds."""

from arborlake.operators import hierarchy as h, intervals
from conftest import frame, record, walk

# a(10) > b(11) > c(12), each with leaves; a broken chain, a leaf without a parent row, a cycle with a leaf.
INNER = [record(5, 5, ".", is_dir=True), record(10, 5, "a", is_dir=True), record(11, 10, "b", is_dir=True), record(12, 11, "c", is_dir=True)]
LEAVES = [record(100 + i, (5, 10, 11, 12)[i % 4], f"leaf{i}", is_dir=True) for i in range(40)]
BROKEN = [record(20, 999, "lost", is_dir=True), record(21, 20, "below", is_dir=True)]
CYCLE = [record(30, 31, "x", is_dir=True), record(31, 30, "y", is_dir=True), record(32, 30, "z", is_dir=True)]
ROWS = INNER + LEAVES + BROKEN + CYCLE


def test_rounds_take_the_directories_that_hold_directories(spark, monkeypatch):
    seen = []
    double = h._double
    monkeypatch.setattr(h, "_double", lambda rows, lookup: seen.append(lookup.count()) or double(rows, lookup))
    table = {r.frs: r for r in h.build_directories(frame(spark, ROWS)).table.collect()}
    # Holders are 10, 11, 12, 20, 30 and 31; the root is nobody's open pointer.
    assert max(seen) == 6
    paths = walk(ROWS)
    for row in INNER[1:] + LEAVES + BROKEN:
        assert table[row[1]].path == paths[row[0], row[1]]
    assert table[139].chain == [5, 10, 11, 12, 139] and table[139].depth == 5 and table[139].state == h.OK
    assert table[21].state == h.BROKEN and table[21].top == 999 and table[999].state == h.LOST
    # The leaf hangs on its parent's chain, which holds each directory of the cycle once.
    assert table[32].state == h.CYCLIC and table[32].chain == [*table[30].chain, 32] and sorted(table[30].chain) == [30, 31]


def test_places_are_given_to_those_only(spark, monkeypatch):
    sizes = []
    number = intervals.number
    monkeypatch.setattr(intervals, "number", lambda nodes: sizes.append(nodes.count()) or number(nodes))
    df = frame(spark, ROWS)
    dirs = h.build_directories(df)
    for few in (64, 0):
        monkeypatch.setattr(h, "FEW_INTERVALS", few)
        for roots, expected in (([11], {11, 12, *range(102, 140, 4), *range(103, 140, 4)}), ([100, 20], {100, 20, 21}), ([5], {r[1] for r in INNER + LEAVES}),
                                ([12, 101, 31], {12, 101, 30, 31, 32, *range(103, 140, 4)})):
            got = [r.frs for r in h.directories_below(dirs, df.filter(df.frs.isin(roots))).filter("frs > 0").collect()]
            assert len(got) == len(set(got)) and {f for f in got if f != 0 or 5 not in roots} == expected
    assert sizes == [5]
