import math
import random

import pytest

from arborlake.operators.contraction import sums_below_cuts

SCHEMA = "drive string, frs long, up long, part long, cut long"


def expected(rows):
    """Values from the last row up; parents come before their children."""
    total = {(d, f): part for d, f, _, part, _ in rows}
    cut = {(d, f): c for d, f, _, _, c in rows}
    for d, f, up, _, _ in reversed(rows):
        limit = cut.get((d, up))
        if (d, up) in total and (limit is None or total[(d, f)] < limit):
            total[(d, up)] += total[(d, f)]
    return total


def tree(seed, n, near):
    """A random tree; a small ``near`` makes long chains with twigs."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        up = None if i == 0 else rnd.randint(max(0, i - near), i - 1)
        rows.append(("C" if seed % 2 else "D", i, up, rnd.choice((0, 1, 5, 40)), rnd.choice((None, 3, 50, 400, 10**6))))
    return rows


@pytest.mark.parametrize("near", [1, 2, 5, 400])
def test_against_a_walk_from_the_leaves(spark, near):
    rows = tree(near, 400, near) + tree(near + 1, 150, near)
    got, rounds = sums_below_cuts(spark.createDataFrame(rows, SCHEMA))
    assert {(r.drive, r.frs): r.total for r in got.collect()} == expected(rows)
    assert rounds <= 2 * math.log2(len(rows)) + 2


def test_cuts_that_chains_meet_one_after_the_other(spark):
    """Each node's limit is met by the sum of all below it, or just not."""
    rows = [("C", i, i - 1 if i else None, 7, 7 * (500 - i) - (i % 3)) for i in range(500)]
    got, _ = sums_below_cuts(spark.createDataFrame(rows, SCHEMA))
    assert {(r.drive, r.frs): r.total for r in got.collect()} == expected(rows)


def test_lone_nodes_unknown_parents_and_empty_tables(spark):
    rows = [("C", 1, None, 4, None), ("C", 2, 99, 6, 1), ("D", 1, 2, 5, 3), ("C", 3, 2, 1, None), ("C", 4, 2, 0, None)]
    got, _ = sums_below_cuts(spark.createDataFrame(rows, SCHEMA))
    assert {(r.drive, r.frs): r.total for r in got.collect()} == {("C", 1): 4, ("C", 2): 6, ("D", 1): 5, ("C", 3): 1, ("C", 4): 0}
    assert sums_below_cuts(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_links_in_a_circle_raise(spark, monkeypatch):
    monkeypatch.setattr("arborlake.operators.contraction.MAX_ROUNDS", 3)
    with pytest.raises(RuntimeError, match="cycle"):
        sums_below_cuts(spark.createDataFrame([("C", 1, 2, 1, None), ("C", 2, 1, 1, None)], SCHEMA))
