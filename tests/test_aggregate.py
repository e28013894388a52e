import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arborlake import Catalog, Filters
from arborlake.operators import aggregate as agg, diff, duplicates as dup, filters as flt, ngrams, ordering, search as s
from arborlake.plans import cookbook, presets
from arborlake.runtime import running_totals, scratch_path
from arborlake.sources import catalog_io, sinks
from conftest import AS_OF, frame, record


@pytest.fixture(scope="module")
def catalog(small):
    return Catalog(small, AS_OF)


def one(df):
    return df.first().asDict()


def test_stats_and_scalars(small):
    assert one(agg.stats(small, "size", ["count", "sum", "min", "max", "missing_count"])) == {
        "count": 8, "sum": 75_200, "min": 0, "max": 70_000, "missing_count": 4}
    assert one(agg.stats(small.filter("size < 0"), "size"))["avg"] == 0.0
    assert one(agg.missing(small, "modified"))["missing"] == 4
    assert one(agg.distinct(small, "extension"))["distinct"] == 3
    with pytest.raises(ValueError):
        agg.stats(small, "name")
    with pytest.raises(ValueError):
        agg.terms(small, "size")
    with pytest.raises(ValueError):
        agg.date_histogram(small, "size")
    with pytest.raises(ValueError):
        agg.terms(small, "type", metrics=("nonsense",))


def test_terms_other_and_samples(catalog):
    rows = catalog.terms("type", 1, sample=2, dirs=catalog.dirs).collect()
    assert len(rows) == 1 and rows[0]["other_count"] == 4 and rows[0]["total_groups"] == 3
    assert rows[0]["key"] == "directory" and len(rows[0]["samples"]) == 2
    docs = {r["key"]: r for r in catalog.terms("type", sample=3, dirs=catalog.dirs).collect()}["document"]
    assert [x["name"] for x in docs["samples"]] == ["file_y.PDF", "file_x.txt", "file_x.txt"]
    assert docs["samples"][0]["path"] == "C:\\folder_a\\sub_folder\\file_y.PDF"
    assert round(docs["share_count"], 3) == 37.5
    with pytest.raises(ValueError):
        catalog.terms("type", sample=6)


def test_flag_facets_agree_with_terms(small):
    facets = {(r["flag"], r["key"]): r["count"] for r in agg.flag_facets(small).collect()}
    for name in ("hidden", "archive", "directory_flag"):
        for r in agg.terms(small, name, 2).collect():
            key = {"directory": "true", "file": "false"}.get(r["key"], r["key"])
            assert facets[(name, key)] == r["count"]


def test_drilldown_reproduces_buckets(small):
    for name in ("type", "extension", "drive", "hidden", "name"):
        for r in agg.terms(small, name).collect():
            if r["key"]:
                assert flt.where_all(small, [agg.key_predicate(name, r["key"])]).count() == r["count"]


def test_range_and_histogram(small):
    got = {r["key"]: r["count"] for r in agg.range_(small, "size", [100, 10_000]).collect()}
    assert got == {"< 100": 4, "100 - 10000": 3, ">= 10000": 1}
    assert {r["key"]: r["count"] for r in agg.histogram(small, "size", 5000).collect()} == {0: 6, 5000: 1, 70_000: 1}


def test_predicates_that_do_not_fit(small):
    for bad in (("name_hex", "eq", "x"), ("size", "contains", "1"), ("hidden", "lt", True), ("name", "lt", "a")):
        with pytest.raises(ValueError):
            flt.where_all(small, [bad])


def test_presets_and_recipes_run(catalog):
    for name in presets.PRESETS:
        for label, df in catalog.preset(name).items():
            assert df.columns, (name, label)
    assert {r["key"] for r in catalog.preset("top_folders")["top_folders"].collect()} == {
        "C:\\", "C:\\folder_a", "C:\\folder_b"}
    with pytest.raises(ValueError):
        catalog.preset("nope")
    assert len(cookbook.SEARCHES) + len(cookbook.REPORTS) >= 68
    for name in cookbook.SEARCHES:
        cookbook.search(catalog, name).schema
    for name in cookbook.REPORTS:
        out = cookbook.report(catalog, name)
        [df.schema for df in (out.values() if isinstance(out, dict) else [out])]


def test_recipe_results(catalog):
    names = [r["name"] for r in cookbook.search(catalog, "largest_files").collect()]
    assert names == ["file_z", "file_y.PDF", "file_x.txt", "file_x.txt"]
    assert [r["frs"] for r in cookbook.search(catalog, "modified_last_week").collect()] == [13]
    assert [r["name"] for r in cookbook.search(catalog, "largest_subtrees", limit=2).collect()] == [".", "folder_b"]


def test_search_options(catalog):
    def ids(*a, **k):
        return sorted(r["frs"] for r in catalog.search(*a, **k).collect())

    assert ids("FILE_X") == [13, 17] and ids("FILE_X", case="sensitive") == []
    assert ids("dir:*a*") == [11] and ids("c:*.pdf") == [15] and ids("d:*") == []
    assert ids("\\folder_a\\**\\*.pdf") == [15] and ids("folder_a\\*") == [13, 14]
    assert ids("\\folder_a\\**") == [13, 14, 15]
    assert ids("sub_folder", expand=True) == [14, 15]
    assert ids("path:folder_b\\file") == [16, 17]
    assert ids(">^file_[xy]") == [13, 15, 17]
    assert ids("*", Filters(path_contains="folder_b", older="2023-06-01")) == [16, 17]
    assert ids("*", Filters(mode="dirs", max_descendants=0)) == []
    assert ids("*", Filters(mode="dirs", exact_descendants=1)) == [14]
    assert [r["frs"] for r in catalog.search("*", Filters(mode="files"), sort="-size", limit=2, offset=1).collect()] == [15, 13]
    with pytest.raises(Exception):
        catalog.search(">[").collect()
    assert s.find_by_path(catalog.rows, catalog.dirs, "c:\\FOLDER_A\\sub_folder").first()["frs"] == 14


def test_sort_arguments():
    assert ordering.parse_sort("size,-name,modified:asc,attributes,zzz") == [
        ("size", True), ("name", True), ("modified", False)]


def test_running_totals_and_deep_pages(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v long")
    got = {r["id"]: r["t"] for r in running_totals(df, [F.col("v"), F.col("id")], {"t": F.col("v")}, 7).collect()}
    total = 0
    for i, v in sorted(data, key=lambda x: (x[1], x[0])):
        total += v
        assert got[i] == total
    order = [i for i, _ in sorted(data, key=lambda x: (x[1], x[0]))]
    for limit, offset in ((20, 300), (10, 0), (400, 90), (5, 498), (5, 600)):
        page = [r["id"] for r in ordering.page_by(df, [F.col("v"), F.col("id")], limit, offset).collect()]
        assert page == order[offset:offset + limit]


def test_ngram_index(spark, small):
    grams = ngrams.build_ngrams(small)
    for needle in ("file", "LE_X", "older", "zzz", "fi", ""):
        expected = {r["frs"] for r in small.collect() if needle.lower() in r["name"].lower() and r["name"] != "."}
        assert {r["frs"] for r in ngrams.ngram_search(small, grams, needle).collect()} == expected, needle


def test_duplicate_rules(spark):
    df = frame(spark, [record(20, 5, "A.txt", 10), record(21, 5, "a.TXT", 10), record(22, 5, "b", 10),
                       record(23, 5, "a.txt", 0), record(24, 5, "a.txt", 0), record(25, 5, "a.txt", 10, is_dir=True)])
    rows = dup.duplicates(df, ("size", "name"), sample=2).collect()
    assert len(rows) == 1 and rows[0]["count"] == 2 and rows[0]["reclaimable_bytes"] == 10
    assert [x["name"] for x in rows[0]["samples"]] == ["A.txt", "a.TXT"]
    with pytest.raises(ValueError):
        dup.duplicates(df, ("hidden",))


def verify_case(spark, bodies, **options):
    """bodies: frs -> (size, content or None)."""
    df = frame(spark, [record(frs, 5, f"f{frs}", size) for frs, (size, _) in bodies.items()])
    contents = spark.createDataFrame([("C", frs, bytearray(c)) for frs, (_, c) in bodies.items() if c is not None],
                                     "drive string, frs long, content binary")
    groups = dup.groups(df, ("size",))
    out = dup.verify(groups, dup.members(df, groups, ("size",)), contents, ("size",), **options)
    return {r["k_size"]: r["outcome"] for r in out.collect()}


def test_verification_outcomes(spark):
    bodies = {1: (4, b"same"), 2: (4, b"same"), 3: (5, b"aaaa1"), 4: (5, b"aaaa2"), 5: (6, b"sixsix"), 6: (6, None),
              7: (7, b"alone77"), 8: (9, b"x" * 9), 9: (9, b"x" * 9), 10: (9, b"y" * 9)}
    assert verify_case(spark, bodies) == {4: "verified", 5: "rejected", 6: "errored", 9: "rejected"}
    assert verify_case(spark, bodies, mode="first_bytes", n_bytes=4) == {
        4: "verified", 5: "verified", 6: "errored", 9: "rejected"}
    assert verify_case(spark, bodies, mode="none") == dict.fromkeys((4, 5, 6, 9), "verified")


def test_budget_passes_over_what_does_not_fit(spark):
    sizes = [50, 40, 30, 9, 8, 7, 1]
    bodies = {i: (size, b"z" * size) for i, size in enumerate(x for s_ in sizes for x in (s_, s_))}
    for budget in (0, 20, 115, 199):
        left, expected = budget or 10**9, {}
        for size in sizes:
            fits = 2 * size <= left
            left -= 2 * size if fits else 0
            expected[size] = "verified" if fits else "skipped"
        assert verify_case(spark, bodies, max_bytes=budget) == expected, budget


def test_diff_of_listings(spark):
    schema = "path string, size long, is_hidden boolean, treesize long"
    left = spark.createDataFrame([("C:\\A", 1, True, 5), ("C:\\b\\", 2, False, None), ("C:\\only:ads", 3, False, 1)], schema)
    right = spark.createDataFrame([("c:/a", 4, True, 5), ("C:\\B", 2, True, 7), ("D:\\new", 9, False, 2)], schema)
    out = diff.diff(left, right)
    assert one(out["summary"]) == {"common_paths": 2, "left_only": 1, "right_only": 1, "match_rate": pytest.approx(200 / 3),
                                   "left_ads": 1, "right_ads": 0}
    fields = {r["field"]: r for r in out["fields"].collect()}
    assert (fields["size"]["mismatches"], fields["size"]["sum_abs_diff"]) == (1, 3)
    assert (fields["is_hidden"]["exact_matches"], fields["is_hidden"]["mismatches"]) == (1, 1)
    assert (fields["treesize"]["total_compared"], fields["treesize"]["right_values_only"]) == (1, 1)
    assert {(r["field"], r["path_norm"]) for r in out["samples"].collect()} == {("size", "c:/a"), ("is_hidden", "c:/b")}
    assert [r["path_norm"] for r in out["paths"].collect()] == ["c:/only:ads", "d:/new"]
    assert one(diff.diff_breakdown(left, right))["left_only_ads"] == 1
    assert diff.column_differences(left, right.drop("size"))["left_only"] == ["size"]


def test_exports(spark, catalog):
    path = scratch_path(spark, "out")
    catalog.export(path, columns="path,size,hidden,modified", sep="TAB", pos="Y", neg="N", tz_offset=60)
    text = {line for line in (r["value"] for r in spark.read.text(path).collect())}
    assert "Path\tSize\tHidden\tLast Written" in text
    assert "C:\\folder_b\\file_z\t70000\tY\t2023-01-01 00:01:00" in text
    legacy = scratch_path(spark, "legacy")
    catalog.export(legacy, legacy=True, quote="'")
    listing = catalog_io.read_listing(spark, legacy, schema=None or catalog_io.LISTING_SCHEMA)
    assert "Path" in listing.columns
    with pytest.raises(ValueError):
        catalog.export(path + "x", fmt="xml")
    back = diff.from_listing(catalog_io.read_listing(spark, export_listing(spark, catalog)))
    assert one(diff.summary(diff.matched(back, catalog.with_paths())))["match_rate"] == 100.0


def export_listing(spark, catalog):
    path = scratch_path(spark, "listing")
    catalog.export(path, columns=["path", "size", "size_on_disk", "descendants", "directory_flag", "hidden", "system",
                                  "archive", "read_only", "compressed", "encrypted", "sparse", "reparse"])
    return path


def test_bad_listing_lines_are_skipped(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Path,Size,"Size on Disk"\n"C:\\a",1,2\n"C:\\b",x,2\n"C:\\c",3,4,5,6\n')
    schema = "Path string, Size long, `Size on Disk` long"
    rows = catalog_io.read_listing(spark, str(tmp_path), schema=schema).collect()
    assert "C:\\a" in {r["Path"] for r in rows} and "C:\\b" not in {r["Path"] for r in rows}


def test_separators_and_projection(small):
    assert [sinks.separator(x) for x in ("tab", "NULL", "Single", ";")] == ["\t", "\0", "'", ";"]
    assert sinks.project(small, "name, SIZE, name, bogus").columns == ["name", "size"]
    assert len(sinks.resolve_columns("parity")) == 25


def test_volumes(spark, small):
    path = scratch_path(spark, "vol")
    small.drop("drive").write.parquet(path)
    rows, report = catalog_io.read_volumes(spark, {"C": path, "X": path + "-none"})
    assert rows.count() == 8 and {r["drive"]: r["records"] for r in report.collect()} == {"C": 8, "X": 0}
    with pytest.raises(RuntimeError):
        catalog_io.read_volumes(spark, {"X": path + "-none"})


def test_decayed_rate_of_steady_stream(spark):
    events = spark.sql("select 'k' key, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,0,id) ts from range(3600)")
    rate = agg.decayed_rate(events, "key", "ts", datetime(2024, 1, 1, 1), 60).first()["rate"]
    assert abs(rate - 1.0) < 0.02
