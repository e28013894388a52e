"""Paths of one or both listings are told apart in one exchange."""

import pytest

from arborlake.operators import diff
from checks import base, tree


@pytest.mark.parametrize("find, expected", [
    (diff.only_in, ["None", "c:/b"]), (diff.common_paths, ["None", "c:/a"]), (lambda a, b: diff.only_in(b, a), ["None", "c:/d"])])
def test_one_sided_and_common_paths_meet_in_one_exchange(spark, capsys, find, expected):
    left = spark.createDataFrame([("C:\\a",), ("C:\\A\\",), ("C:\\b",), (None,)], "path string")
    right = spark.createDataFrame([("c:/a",), ("C:\\d",), (None,)], "path string")
    found = find(left, right)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(path_norm") == 1 and "Join" not in plan
    assert sorted(str(r.path_norm) for r in found.collect()) == expected


def test_listings_of_files_need_no_subtree_sums(spark, monkeypatch):
    monkeypatch.setattr(base, "_CATALOGS", {})
    tree.listings(spark, "/root/testdata/sf0.001")
    assert [c for c in base._CATALOGS.values() if "sums" in vars(c)] == []
