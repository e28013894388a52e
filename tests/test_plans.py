"""Shapes of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arborlake import Catalog, Filters
from arborlake.operators import aggregate as agg, hierarchy as h
from arborlake.operators.filters import where_all
from arborlake.runtime import scratch_path, scratch_root
from arborlake.sources import catalog_io
from checks import base
from conftest import AS_OF, frame, record


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    records = [record(5, 5, ".", is_dir=True, drive=d) for d in "CD"]
    records += [record(20 + i, 5, f"d{i}", is_dir=True, drive=d) for d in "CD" for i in range(5)]
    records += [record(100 + i, 20 + i % 5, f"f{i}.pdf", i * 1000, drive=d) for d in "CD" for i in range(50)]
    return Catalog.prepare(frame(spark, records), AS_OF)


def test_filters_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(stored.search("*.pdf", Filters(min_size="10KB", drives=["C"])).select("frs"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "dirs" not in stored.__dict__        # a name search builds no directory table
    assert "EqualTo(ext,pdf)" in text and "GreaterThanOrEqual(size,10240)" in text
    assert "PartitionFilters: [isnotnull(drive" in text and "Exchange" not in text
    read = text.split("ReadSchema: ")[1]
    assert "created" not in read and "allocated_size" not in read


def test_extensions_of_patterns_and_predicates_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        for pattern, whole in (("f7.pdf", True), ("F*.PDF", False), ("f?.pdf", False)):
            found = stored.search(pattern, whole_word=whole)
            assert "EqualTo(ext,pdf)" in plan(found.select("frs")) and found.count() > 0
        assert "EqualTo(ext" not in plan(stored.search("f7.pdf").select("frs"))    # any name that contains it
        assert "In(ext, [pdf,txt])" in plan(where_all(stored.rows, [("extension", "in", ["PDF", "txt"])]).select("frs"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_type_filter_is_an_extension_list(stored):
    text = plan(stored.search("*", Filters(type="archive")).select("frs"))
    assert "zip" in text and "CASE WHEN" not in text


def test_short_result_is_the_broadcast_side(spark, stored):
    stored.dirs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
    try:
        text = plan(stored.search("*", sort="-size", limit=5, paths=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "TakeOrderedAndProject" in text and "BuildLeft" in text


def test_samples_are_limited_before_the_exchange(stored):
    text = plan(agg.terms(stored.rows, "extension", 5, ("count",), sample=2, sample_fields=("name",)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_totals_reuse_the_grouping(stored):
    df = agg.terms(stored.rows, "extension", 5)
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1


def test_bucketed_tables_join_without_an_exchange(spark, stored):
    catalog_io.write_bucketed(stored.rows, stored.dirs.table, "bucketed", scratch_path(spark, "bucketed"), 4)
    dirs = h.Directories(spark.table("bucketed_dirs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = h.with_paths(spark.table("bucketed"), dirs)
        assert "Exchange" not in plan(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in rows.select("drive", "frs", "path").collect()} == {
        tuple(r) for r in stored.with_paths().select("drive", "frs", "path").collect()}


def test_files_are_summed_before_they_meet_ancestors(stored):
    text = plan(h.tree_sums(stored.rows, stored.dirs))
    assert text.index("Generate explode") > text.index("partial_sum")     # deeper in the plan
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_every_query_is_registered_with_an_oracle(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 250
    assert set(base.QUERIES) - set(oracles) == {"j07_cadence_compaction"}


@pytest.mark.parametrize("key", [
    "b02_semantic_type", "c27_match", "d13_any_depth", "d16_ngram_search", "e01_with_paths", "e07_tree_metrics_streams",
    "f12_rollup_path_2", "f15_top_hits", "f17_duplicates", "g07_top_n_path", "h03_overlay"])
def test_plans_stay_in_the_jvm_without_cross_joins(spark, key):
    text = plan(base.QUERIES[key](spark, "/root/testdata/sf0.001"))
    for word in ("PythonUDF", "ArrowEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_flagship_query(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r["count"] for r in rows) > 0
    assert "share_bytes" in rows[0].asDict()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch_root(Session())
