"""Two listings meet in one exchange of their paths."""

from arborlake.operators import diff

LISTING = "path string, size long, is_hidden boolean"


def test_pairs_of_both_sides_without_a_sort_before_the_exchange(spark, capsys):
    left = spark.createDataFrame([("C:\\a", 1, False), ("C:\\A\\", 3, True), ("C:\\b", 2, False), (None, 9, False), ("C:\\e", None, None)], LISTING)
    right = spark.createDataFrame([("c:/a", 3), ("C:\\d", 4), (None, 9), ("C:\\e", 5)], "path string, size long")
    pairs = diff.matched(left, right)
    pairs.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(path_norm") == 1 and "SortMergeJoin" not in plan
    got = [(str(r.path_norm), r.l and r.l.size, r.r and r.r.size) for r in pairs.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("c:/a", 3, 3), ("c:/b", 2, None), ("c:/d", None, 4), ("c:/e", None, 5),
                                                     ("None", 9, None), ("None", None, 9)]))
