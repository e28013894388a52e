"""Checked queries: derived columns, filters, pattern search, sorting, set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from arborlake.functions import arguments as args, derive as d, patterns as p
from arborlake.functions.categories import type_extensions
from arborlake.operators import filters as flt, hierarchy as h, ngrams, ordering, overlay as ov
from arborlake.operators.search import find_by_path, sugar
from arborlake.runtime import materialize
from arborlake.schema import FLAG_BITS
from arborlake.sources import binding, catalog_io, sinks

from checks.base import AS_OF, AS_OF_SQL, cat, ordered, query, rows


def id_and(spark, sf, *columns, paths=False, tree=False, files=False):
    c = cat(spark, sf)
    df = c.tree_rows if tree else c.rows
    df = df.filter(~F.col("is_directory")) if files else df
    df = c.with_paths(df) if paths else df
    return df.select("drive", "frs", *columns)


# ---------------------------------------------------------------- B: derived columns

@query("b01_ext", "SELECT drive, frs, ext AS e FROM catalog")
def _(spark, sf):
    return id_and(spark, sf, d.ext("name").alias("e"))


@query("b02_semantic_type", "SELECT drive, frs, type AS t FROM catalog")
def _(spark, sf):
    return id_and(spark, sf, d.semantic_type(d.ext("name"), "is_directory").alias("t"))




@query("b03_type_extensions", """
SELECT c.ext, count(*) AS files FROM catalog c
WHERE NOT is_directory AND ext IN ('mp4','avi','mkv','mov','wmv','flv','webm','mpeg','mpg','m4v','3gp',
  'sys','dll','drv','ocx','cpl','ax','mui') GROUP BY c.ext""")
def _(spark, sf):
    wanted = [*type_extensions("video"), *type_extensions("system")]
    return (cat(spark, sf).rows.filter(~F.col("is_directory") & F.col("ext").isin(*wanted))
            .groupBy("ext").agg(F.count("*").alias("files")))


@query("b04_bulkiness", """
SELECT drive, frs, CASE WHEN size = 0 THEN 0 ELSE CAST(allocated_size AS HUGEINT) * 1000000 // size END::BIGINT AS b
FROM catalog WHERE NOT is_directory""")
def _(spark, sf):
    return id_and(spark, sf, d.bulkiness("size", "allocated_size").alias("b"), files=True)


@query("b04_bulkiness_tree", """
SELECT drive, frs, CASE WHEN treesize = 0 THEN 0
  ELSE CAST(tree_allocated AS HUGEINT) * 1000000 // treesize END::BIGINT AS b FROM tree WHERE is_directory""")
def _(spark, sf):
    c = cat(spark, sf)
    dirs = c.tree_rows.filter("is_directory")
    return dirs.select("drive", "frs", d.field_column(dirs, "bulkiness").alias("b"))


@query("b05_tree_allocated_eff", "SELECT drive, frs, tree_allocated AS a FROM tree")
def _(spark, sf):
    return id_and(spark, sf, d.effective_size("is_directory", "allocated_size", "tree_allocated").alias("a"),
                  tree=True)


@query("b06_attr_flags", "SELECT drive, frs, " + ", ".join(
    f"(flags & {bit}) <> 0 AS {name}" for name, bit in FLAG_BITS.items()) + " FROM catalog")
def _(spark, sf):
    return id_and(spark, sf, *[c.alias(n) for n, c in d.attribute_flags("flags").items()])


@query("b07_parity_attrs", "SELECT drive, frs, CAST(flags & 1764919 AS INT) AS a FROM catalog")
def _(spark, sf):
    return id_and(spark, sf, d.parity_attributes("flags").alias("a"))


@query("b08_name_length", "SELECT drive, frs, CAST(length(name) AS INT) AS n FROM catalog")
def _(spark, sf):
    return id_and(spark, sf, d.name_length("name").alias("n"))


@query("b09_path_length", "SELECT drive, frs, CAST(length(path) AS INT) AS n FROM paths")
def _(spark, sf):
    return id_and(spark, sf, d.path_length("path").alias("n"), paths=True)


@query("b10_path_only", r"""
SELECT drive, frs, CASE WHEN frs = 5 THEN path WHEN parent_frs = 5 THEN parent_path
                        ELSE parent_path || '\' END AS po FROM paths""")
def _(spark, sf):
    return id_and(spark, sf, d.path_only("path").alias("po"), paths=True)


def linked(spark, sf):
    return binding.linked_catalog(cat(spark, sf).rows)


@query("b11_malformed", "SELECT drive, frs, frs % 13 = 0 AS bad FROM catalog")
def _(spark, sf):
    return linked(spark, sf).select("drive", "frs", d.is_malformed("name_bytes").alias("bad"))


@query("b12_malformed_path", """
SELECT drive, frs, frs % 13 = 0 OR len([x FOR x IN above IF x % 13 = 0]) > 0 AS bad FROM paths""")
def _(spark, sf):
    df = linked(spark, sf)
    dirs = h.build_directories(df)
    return h.with_malformed_path(df, dirs).select("drive", "frs", F.col("malformed_path").alias("bad"))


@query("b13_name_hex", """
SELECT drive, frs, lower(hex(encode(name))) || 'edb3bf' AS hx FROM catalog WHERE frs % 13 = 0""")
def _(spark, sf):
    return linked(spark, sf).select("drive", "frs", d.name_hex("name_bytes").alias("hx")).filter("hx is not null")


@query("b14_render_malformed", """
SELECT drive, frs, CASE WHEN frs % 13 = 0 THEN name || chr(65533) ELSE name END AS lossy,
       CASE WHEN frs % 13 = 0 THEN name || '<BAD:DCFF>' ELSE name END AS marked FROM catalog""")
def _(spark, sf):
    return linked(spark, sf).select("drive", "frs", d.render_name("name_bytes").alias("lossy"),
                                    d.render_name("name_bytes", normalized=True).alias("marked"))


_META = ("CASE WHEN frs % 5 = 0 THEN '$mft' WHEN frs % 5 = 1 THEN '$Recycle.Bin' "
         "WHEN frs % 5 = 2 THEN name || ':zone' ELSE name END")


def odd_names(spark, sf):
    """Catalog in which some records carry reserved, '$' and stream names."""
    m = F.col("frs") % 5
    name = (F.when(m == 0, F.lit("$mft")).when(m == 1, F.lit("$Recycle.Bin"))
            .when(m == 2, F.concat("name", F.lit(":zone"))).otherwise(F.col("name")))
    return cat(spark, sf).rows.withColumn("name", name)


@query("b15_is_metafile", f"SELECT drive, frs, upper({_META}) = '$MFT' AS m FROM catalog")
def _(spark, sf):
    return odd_names(spark, sf).select("drive", "frs", d.is_metafile("name").alias("m"))


@query("b16_is_ads", f"""
SELECT drive, frs, contains({_META}, ':') AS a, frs % 5 = 2 AS ap FROM catalog""")
def _(spark, sf):
    df = odd_names(spark, sf)
    full = F.concat(F.col("drive"), F.lit(":\\"), F.col("name"))
    return df.select("drive", "frs", d.is_ads("name").alias("a"), d.is_ads_path(full).alias("ap"))


@query("b17_case_fold", "SELECT drive, frs, upper(name) AS f FROM catalog")
def _(spark, sf):
    return id_and(spark, sf, d.fold("name").alias("f"))


@query("b18_filetime", """
SELECT drive, frs, strftime(modified, '%Y-%m-%d %H:%M:%S') AS t, strftime(modified + INTERVAL 19800 SECOND, '%Y-%m-%d %H:%M:%S') AS local,
  CAST(year(modified) AS INT) AS y, CAST(month(modified) AS INT) AS mo, CAST(day(modified) AS INT) AS da,
  CAST(hour(modified) AS INT) AS ho, CAST(minute(modified) AS INT) AS mi, CAST(second(modified) AS INT) AS se
FROM catalog WHERE NOT is_directory""")
def _(spark, sf):
    ticks = d.micros(F.col("modified")) * 10 + F.lit(116_444_736_000_000_000)
    df = cat(spark, sf).rows.filter(~F.col("is_directory")).withColumn("ts", d.filetime_to_timestamp(ticks))
    parts = d.calendar_parts("ts")
    return df.select("drive", "frs", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"),
                     F.date_format(d.shift_seconds("ts", 19_800), "yyyy-MM-dd HH:mm:ss").alias("local"),
                     *[c.alias(n[:1] if n == "year" else n[:2]) for n, c in parts.items()])


@query("b19_month_of", "SELECT drive, frs, CAST(month(modified) AS INT) AS m FROM catalog WHERE NOT is_directory")
def _(spark, sf):
    return id_and(spark, sf, d.month_of("modified").alias("m"), files=True)


@query("b20_size_bucket", """
SELECT drive, frs, CASE WHEN size < 1024 THEN '0 – 1 KB' WHEN size < 102400 THEN '1 KB – 100 KB'
  WHEN size < 1048576 THEN '100 KB – 1 MB' WHEN size < 104857600 THEN '1 MB – 100 MB'
  WHEN size < 1073741824 THEN '100 MB – 1 GB' WHEN size < 10737418240 THEN '1 GB – 10 GB'
  ELSE '> 10 GB' END AS b FROM catalog""")
def _(spark, sf):
    return id_and(spark, sf, d.size_bucket("size").alias("b"))


@query("b21_size_bucket8", """
SELECT drive, frs, CAST(CASE WHEN size < 1024 THEN 0 WHEN size < 10240 THEN 1 WHEN size < 102400 THEN 2
  WHEN size < 1048576 THEN 3 WHEN size < 10485760 THEN 4 WHEN size < 104857600 THEN 5
  WHEN size < 1073741824 THEN 6 ELSE 7 END AS INT) AS b FROM catalog""")
def _(spark, sf):
    return id_and(spark, sf, d.size_bucket8("size").alias("b"))


@query("b22_age_bucket", f"""
SELECT drive, frs, CASE WHEN age < 1 THEN 'Today' WHEN age < 7 THEN 'This week' WHEN age < 30 THEN 'This month'
  WHEN age < 90 THEN 'Last 90 days' WHEN age < 365 THEN 'This year' WHEN age < 1095 THEN '1 – 3 years'
  WHEN age < 3650 THEN '3 – 10 years' ELSE '> 10 years' END AS b
FROM (SELECT *, epoch({AS_OF_SQL} - modified) / 86400 AS age FROM catalog WHERE NOT is_directory)""")
def _(spark, sf):
    return id_and(spark, sf, d.age_bucket("modified", AS_OF).alias("b"), files=True)


@query("b23_path_risk_bucket", """
SELECT drive, frs, CASE WHEN n < 128 THEN '< 128 chars' WHEN n < 200 THEN '128 – 199 chars'
  WHEN n < 260 THEN '200 – 259 chars' ELSE '≥ 260 chars' END AS b
FROM (SELECT drive, frs, length(path) * 3 AS n FROM paths)""")
def _(spark, sf):
    return id_and(spark, sf, d.path_risk(d.path_length("path") * 3).alias("b"), paths=True)


@query("b24_normalize_path", r"""
SELECT drive, frs, rtrim(replace(lower(path), '\', '/'), '/') AS n FROM paths""")
def _(spark, sf):
    return id_and(spark, sf, d.normalize_path("path").alias("n"), paths=True)


@query("b25_projection", """
SELECT name, size, allocated_size AS size_on_disk, ext AS extension, type, drive FROM catalog WHERE NOT is_directory""")
def _(spark, sf):
    files = cat(spark, sf).rows.filter(~F.col("is_directory"))
    return sinks.project(files, "Name,size,SIZEONDISK,ext,type,size,nonsense,drv")


@query("b25_projection_parity", """
SELECT path, frs, allocated_size AS size_on_disk, descendants, (flags & 2) <> 0 AS hidden,
  CAST(flags & 1764919 AS INT) AS parity_attributes FROM tree""")
def _(spark, sf):
    c = cat(spark, sf)
    full = c.with_paths(c.tree_rows)
    wide = full.select("frs", *[d.field_column(full, n).alias(n) for n in sinks.resolve_columns("parity")])
    return wide.select("path", "frs", "size_on_disk", "descendants", "hidden", "parity_attributes")


@query("b26_display_format", """
SELECT drive, frs, strftime(modified + INTERVAL 3600 SECOND, '%Y-%m-%d %H:%M:%S') AS t,
  CASE WHEN flags & 2 <> 0 THEN '+' ELSE '-' END AS hid,
  CASE WHEN size = 0 THEN 0 ELSE CAST(allocated_size AS HUGEINT) * 1000000 // size // 10000 END::BIGINT AS pct
FROM catalog WHERE NOT is_directory""")
def _(spark, sf):
    return id_and(spark, sf, d.display_time("modified", 3600).alias("t"),
                  d.display_flag(d.has_flag("flags", "hidden"), "+", "-").alias("hid"),
                  F.call_function("div", d.bulkiness("size", "allocated_size"), F.lit(10_000)).alias("pct"),
                  files=True)


@query("b27_add_ext_column", "SELECT drive, frs, ext FROM catalog WHERE ext = 'pdf'")
def _(spark, sf):
    return cat(spark, sf).rows.filter(F.col("ext") == "pdf").select("drive", "frs", "ext")


@query("b28_human_size", """
SELECT drive, frs, CASE WHEN v >= 1099511627776 THEN printf('%.2f TB', v / 1099511627776.0)
  WHEN v >= 1073741824 THEN printf('%.2f GB', v / 1073741824.0) WHEN v >= 1048576 THEN printf('%.1f MB', v / 1048576.0)
  WHEN v >= 1024 THEN printf('%.1f KB', v / 1024.0) ELSE v || ' B' END AS hs,
  format('{:,}', v) AS digits FROM (SELECT drive, frs, size * (frs % 3) * (frs % 257) AS v FROM catalog WHERE NOT is_directory)""")
def _(spark, sf):
    v = F.col("size") * (F.col("frs") % 3) * (F.col("frs") % 257)
    df = cat(spark, sf).rows.filter(~F.col("is_directory")).withColumn("v", v)
    return df.select("drive", "frs", d.human_size("v").alias("hs"), d.grouped_digits("v").alias("digits"))


@query("b29_reason_names", """
SELECT usn, CASE WHEN kind = 'created' THEN 'CREATE' WHEN kind = 'deleted' THEN 'DELETE' WHEN kind = 'renamed' THEN 'RENAME'
  WHEN kind = 'size_changed' THEN 'SIZE' WHEN kind = 'metadata_changed' THEN 'META' ELSE '0x00000000' END
  || '+CLOSE' AS names FROM classified""")
def _(spark, sf):
    reason = F.col("reason").bitwiseOR(F.lit(d.REASON_CLOSE))
    return binding.changes(spark, sf).select("usn", d.reason_names(reason).alias("names"))


# ---------------------------------------------------------------- C: filters

rows("c01_files_only", "NOT is_directory", filters={"mode": "files"})
rows("c01_dirs_only", "is_directory", filters={"mode": "dirs"})
rows("c02_exclude_hidden_system", "flags & 2 = 0 AND flags & 4 = 0",
     filters={"exclude_hidden": True, "exclude_system": True})


@query("c03_hide_system_files", f"SELECT drive, frs FROM catalog WHERE upper({_META}) <> '$MFT'")
def _(spark, sf):
    return odd_names(spark, sf).filter(flt.hide_system_files()).select("drive", "frs")


@query("c04_hide_metadata_records", """
SELECT drive, frs FROM catalog WHERE frs % 40 >= 16 OR frs % 40 = 5""")
def _(spark, sf):
    df = cat(spark, sf).rows.select("drive", F.col("frs").alias("id"), (F.col("frs") % 40).alias("frs"))
    return df.filter(flt.hide_metadata_records()).select("drive", F.col("id").alias("frs"))


@query("c05_hide_system", f"""
SELECT drive, frs FROM catalog WHERE (frs % 40 >= 16 OR frs % 40 = 5) AND upper({_META}) <> '$MFT'""")
def _(spark, sf):
    df = odd_names(spark, sf).select("drive", "name", F.col("frs").alias("id"), (F.col("frs") % 40).alias("frs"))
    kept = df.filter(flt.hide_metadata_records()).filter(flt.hide_system_files())
    return kept.select("drive", F.col("id").alias("frs"))


@query("c06_hide_ads", "SELECT drive, frs FROM catalog WHERE frs % 5 <> 2")
def _(spark, sf):
    return flt.apply(odd_names(spark, sf), flt.Filters(hide_ads=True), AS_OF).select("drive", "frs")


rows("c07_size_between", "size >= 102400 AND size <= 10485760",
     filters={"min_size": "100KB", "max_size": "10 mb"})
rows("c07_exact_size", "size = 0 AND NOT is_directory", filters={"exact_size": 0, "mode": "files"})
rows("c08_size_on_disk", "allocated_size >= 4096 AND allocated_size <= 2097152",
     filters={"min_allocated": 4096, "max_allocated": "2MB"})
rows("c09_descendants", "descendants >= 10 AND descendants <= 50", source="tree",
     filters={"min_descendants": 10, "max_descendants": 50})
rows("c09_exact_descendants", "descendants = 4", source="tree", filters={"exact_descendants": 4})
rows("c10_tree_size", "treesize >= 10485760 AND tree_allocated <= 1073741824", source="tree",
     filters={"min_treesize": "10MB", "max_tree_allocated": "1GB"})
rows("c11_bulkiness", """
  CASE WHEN treesize = 0 THEN 0 ELSE tree_allocated::HUGEINT * 1000000 // treesize END BETWEEN 1000000 AND 1010000""",
     source="tree", filters={"min_bulkiness": 100, "max_bulkiness": 101})
rows("c12_newer_older", "modified >= TIMESTAMP '1999-01-01' AND modified < TIMESTAMP '2000-06-15'",
     filters={"newer": "1999-01-01", "older": "2000-06-15"})
rows("c12_created_accessed", "created >= TIMESTAMP '1997-03-01' AND accessed < TIMESTAMP '1999-01-01'",
     filters={"newer_created": "1997-03-01", "older_accessed": "1999-01-01"})


@query("c13_strict_times", """
SELECT drive, frs FROM catalog WHERE modified > TIMESTAMP '1998-02-01' AND modified < TIMESTAMP '1998-02-10'
  AND created > TIMESTAMP '1996-01-01'""")
def _(spark, sf):
    c = flt.time_after("modified", datetime(1998, 2, 1)) & flt.time_before("modified", datetime(1998, 2, 10))
    return cat(spark, sf).rows.filter(c & flt.time_after("created", datetime(1996, 1, 1))).select("drive", "frs")


rows("c14_between_dates", "modified >= TIMESTAMP '1998-01-01' AND modified < TIMESTAMP '1998-03-01'",
     filters={"between": "1998-01-01,1998-03-01"})
# AS_OF is Friday 2001-06-15 12:00.
_RANGES = {
    "today": ("2001-06-15", "2001-06-15"), "yesterday": ("2001-06-14", "2001-06-15"),
    "this_week": ("2001-06-11", "2001-06-11"), "last_week": ("2001-06-04", "2001-06-11"),
    "this_month": ("2001-06-01", "2001-06-01"), "last_month": ("2001-05-01", "2001-06-01"),
    "this_year": ("2001-01-01", "2001-01-01"), "ytd": ("2001-01-01", "2001-01-01"),
    "last_year": ("2000-01-01", "2001-01-01"), "last_7d": ("2001-06-08 12:00", "2001-06-08 12:00"),
    "last_30d": ("2001-05-16 12:00", "2001-05-16 12:00"), "last_90d": ("2001-03-17 12:00", "2001-03-17 12:00"),
    "last_365d": ("2000-06-15 12:00", "2000-06-15 12:00"), "next_day": ("2001-06-16", "2001-06-17"),
    "next_week": ("2001-06-18", "2001-06-25"), "next_month": ("2001-07-01", "2001-08-01"),
    "next_year": ("2002-01-01", "2003-01-01"), "2w": ("2001-06-01 12:00",) * 2,
    "36h": ("2001-06-14 00:00",) * 2, "90m": ("2001-06-15 10:30",) * 2, "30s": ("2001-06-15 11:59:30",) * 2,
}


@query("c15_relative_times", " UNION ALL ".join(
    f"SELECT '{n}' AS spec, count(*) FILTER (WHERE modified >= TIMESTAMP '{a}') AS newer, "
    f"count(*) FILTER (WHERE modified < TIMESTAMP '{b}') AS older FROM catalog" for n, (a, b) in _RANGES.items()))
def _(spark, sf):
    m = F.col("modified")

    def bound(spec, lower):
        return F.lit(args.time_bound(spec, AS_OF, lower)).cast("timestamp_ntz")

    wide = cat(spark, sf).rows.agg(*[F.struct(
        F.lit(n).alias("spec"), F.count_if(m >= bound(n, True)).alias("newer"),
        F.count_if(m < bound(n, False)).alias("older")).alias(f"r_{n}") for n in _RANGES])
    return wide.select(F.explode(F.array(*[F.col(f"r_{n}") for n in _RANGES])).alias("r")).select("r.*")


rows("c16_months", "month(modified) IN (1, 7, 8, 9)", filters={"months": "jan,Q3,nonsense"})
rows("c18_attributes", "flags & 34 = 34 AND flags & 1 = 0", filters={"attributes": "hidden,archive,!readonly"})
rows("c18_attribute_preset", "flags & 6 = 0", filters={"attributes": "user-files"})
rows("c19_extension_list", "ext IN ('jpg','jpeg','png','gif','bmp','tiff','tif','webp','svg','ico','raw','heic','dll')",
     filters={"ext": "pictures,.DLL"})
rows("c20_type_filter", "type = 'document'", filters={"type": "document"})
rows("c20_type_and_ext", "ext = 'pdf'", filters={"type": "document", "ext": "pdf,jpg"})
rows("c20_type_of_row", "type = 'file'", filters={"type": "file"})
rows("c21_exclude", "NOT (name ILIKE '%ring%' OR name ILIKE 'order%')", filters={"exclude": "*RING*,order*"})
rows("c22_in_path", r"contains(lower(CASE WHEN frs = 5 THEN path WHEN parent_frs = 5 THEN parent_path ELSE parent_path || '\' END), 'nation_1\')",
     source="paths", filters={"path_contains": "nation_1/"})
rows("c22_not_in_path", r"""
  NOT contains(lower(CASE WHEN frs = 5 THEN path WHEN parent_frs = 5 THEN parent_path ELSE parent_path || '\' END), 'nation_1')
  AND NOT regexp_full_match(lower(CASE WHEN frs = 5 THEN path WHEN parent_frs = 5 THEN parent_path ELSE parent_path || '\' END), '.*customer#00000000..*')""",
     source="paths", filters={"path_excludes": r"nation_1,*\customer#00000000?*"})
rows("c23_name_length", "length(name) BETWEEN 8 AND 12", filters={"min_name_length": 8, "max_name_length": 12})
rows("c24_path_length", "length(path) >= 60", source="paths", filters={"min_path_length": 60})


@query("c25_malformed", "SELECT drive, frs FROM catalog WHERE frs % 13 = 0 AND NOT is_directory")
def _(spark, sf):
    return flt.apply(linked(spark, sf), flt.Filters(malformed=True, mode="files"), AS_OF).select("drive", "frs")


@query("c25_well_formed", "SELECT drive, frs FROM catalog WHERE frs % 13 <> 0")
def _(spark, sf):
    return flt.apply(linked(spark, sf), flt.Filters(malformed=False), AS_OF).select("drive", "frs")


@query("c25_malformed_path", """
SELECT drive, frs FROM paths WHERE frs % 13 <> 0 AND len([x FOR x IN above IF x % 13 = 0]) > 0""")
def _(spark, sf):
    df = linked(spark, sf)
    found = flt.apply(df, flt.Filters(malformed=False, malformed_path=True), AS_OF, h.build_directories(df))
    return found.select("drive", "frs")


rows("c26_volume_filter", "drive IN ('D', 'F')", filters={"drives": ["d", "F:"]})

_PREDICATES = {
    "c27_eq": ([("name", "eq", "OLD_RING_3.PDF")], "lower(name) = 'old_ring_3.pdf'"),
    "c27_ne_lt": ([("type", "ne", "document"), ("size", "lt", 5000)], "type <> 'document' AND size < 5000"),
    "c27_gt_lte": ([("size", "gt", 5_000_000), ("size_on_disk", "lte", 8_000_000)],
                   "size > 5000000 AND allocated_size <= 8000000"),
    "c27_in_not_in": ([("extension", "in", ["PDF", "txt"]), ("drive", "not_in", ["c", "D"])],
                      "ext IN ('pdf', 'txt') AND drive NOT IN ('C', 'D')"),
    "c27_match": ([("name", "match", "*ring_?.p*"), ("name", "not_match", "old*")],
                  "regexp_full_match(lower(name), '.*ring_.\\.p.*') AND NOT starts_with(lower(name), 'old')"),
    "c27_text_ops": ([("name", "contains", "RING"), ("name", "starts_with", "Cold"), ("name", "ends_with", ".Mp4")],
                     "contains(lower(name), 'ring') AND starts_with(lower(name), 'cold') AND ends_with(lower(name), '.mp4')"),
    "c27_has_text": ([("name", "has_all", ["ring", "_3"]), ("name", "has_any", ["old", "cold"]),
                      ("name", "has_none", ["mp4", "dll"])],
                     "lower(name) LIKE '%ring%' AND contains(name, '_3') AND contains(lower(name), 'old') "
                     "AND NOT contains(lower(name), 'mp4') AND NOT contains(lower(name), 'dll')"),
    "c27_attributes": ([("attributes", "has_all", ["archive"]), ("attributes", "has_any", ["hidden", "system"]),
                        ("attributes", "has_none", ["readonly"])], "flags = 34"),
    "c27_bool_time": ([("hidden", "eq", True), ("modified", "gte", "2000-01-01"), ("directory", "ne", True)],
                      "flags & 2 <> 0 AND modified >= TIMESTAMP '2000-01-01' AND NOT is_directory"),
}
for _key, (_preds, _where) in _PREDICATES.items():
    @query(_key, f"SELECT drive, frs, name FROM catalog WHERE {_where}")
    def _(spark, sf, preds=tuple(_preds)):
        return flt.where_all(cat(spark, sf).rows, preds, AS_OF).select("drive", "frs", "name")


@query("c28_frame_matching", """
SELECT drive, frs, name FROM catalog WHERE name = 'old_ring_3.pdf' OR contains(name, 'JPG')
  OR regexp_matches(name, '^hot_b[aeiou]lt_[12]') OR regexp_full_match(name, 'cold_[^/\\\\]*_[13]\\.p[a-d]f')""")
def _(spark, sf):
    n = F.col("name")
    c = ((n == "old_ring_3.pdf") | n.contains("JPG") | p.regex(n, "^hot_b[aeiou]lt_[12]", True)
         | p.class_glob(n, "cold_*_[13].p[a-d]f"))
    return cat(spark, sf).rows.filter(c).select("drive", "frs", "name")


@query("c29_forensic_scope", """
SELECT drive, frs FROM catalog WHERE frs % 7 <> 0 AND frs % 11 <> 0""")
def _(spark, sf):
    m = F.col("frs")
    df = cat(spark, sf).rows.withColumns({
        "is_deleted": m % 7 == 0, "is_corrupt": m % 11 == 0, "is_extension": m % 13 == 0})
    return flt.scope(df, continuation=True).select("drive", "frs")


# ---------------------------------------------------------------- D: pattern search

rows("d01_match_all", "TRUE", "*")
rows("d02_substring", "contains(lower(name), 'ring') AND name <> '.'", "RiNg")
rows("d03_glob", r"regexp_full_match(lower(name), 'o?ld.*_[0-9]\.p.f') AND starts_with(name, 'old')", "old*_?.p?f")


@query("d04_class_glob", r"""
SELECT drive, frs, name FROM catalog WHERE regexp_full_match(name, '[a-h][^/\\]*[^aeiou]_[1-3]\.[^/\\][^/\\][^/\\]')""")
def _(spark, sf):
    c = p.class_glob(F.col("name"), "[a-h]*[!aeiou]_[1-3].???")
    return cat(spark, sf).rows.filter(c).select("drive", "frs", "name")


_SPECIAL = {
    "d05_exact": ("old_ring_3.pdf", "lower(name) = 'old_ring_3.pdf'", {"whole_word": True}),
    "d05_prefix": ("cold_*", "starts_with(lower(name), 'cold_')", {}),
    "d05_suffix": ("*_3.pdf", "ends_with(lower(name), '_3.pdf')", {}),
    "d05_extension": ("*.jpg", "ext = 'jpg'", {}),
    "d05_contains": ("*gear*", "contains(lower(name), 'gear')", {}),
    "d05_prefix_suffix": ("old*.dll", "starts_with(lower(name), 'old') AND ends_with(lower(name), '.dll')", {}),
    "d07_or": ("*.pdf|ring|hot_b?lt*", "ends_with(name, '.pdf') OR contains(name, 'ring') OR regexp_full_match(name, 'hot_b.lt.*')", {}),
    "d08_regex": (r">^(hot|cold)_\w+_[0-9]+\.JPG$", r"regexp_matches(lower(name), '^(hot|cold)_\w+_[0-9]+\.jpg$')", {}),
    "d09_case_sensitive": ("*.JPG", "ends_with(name, '.JPG')", {"case": "sensitive"}),
    "d09_smart_case": ("Customer", "contains(name, 'Customer')", {"case": "smart"}),
    "d09_smart_case_lower": ("customer", "contains(lower(name), 'customer')", {"case": "smart"}),
    "d10_whole_word": ("NATION_1", "name = 'NATION_1'", {"whole_word": True}),
    "d12_dir_scope": ("dir:order_1*", "is_directory AND starts_with(name, 'order_1')", {}),
    "d12_file_scope": ("file:*1*", "NOT is_directory AND contains(name, '1')", {}),
    "d12_volume_scope": ("d:*.pdf", "drive = 'D' AND ext = 'pdf'", {}),
}
for _key, (_pattern, _where, _options) in _SPECIAL.items():
    rows(_key, f"({_where}) AND name <> '.'", _pattern, **_options)


@query("d06_sets", """
SELECT drive, frs, name FROM catalog WHERE name IN ('old_ring_3.pdf', 'hot_gear_1') OR contains(name, 'plate')
  OR contains(name, 'widget') OR ends_with(name, '.dll') OR ends_with(name, '_4.mp4')""")
def _(spark, sf):
    n = F.col("name")
    c = (p.exact_set(n, ["old_ring_3.pdf", "hot_gear_1"]) | p.contains_any(n, ["plate", "widget"])
         | p.suffix_set(n, [".dll", "_4.mp4"]))
    return cat(spark, sf).rows.filter(c).select("drive", "frs", "name")


rows("d11_begins_with", "starts_with(lower(name), 'hot')", sugar(begins="hot"))
rows("d11_ends_with", "ends_with(lower(name), 'f')", sugar(ends="f"))
rows("d11_contains_not", "contains(name, 'ring') AND NOT contains(name, 'old')",
     sugar(contains="ring"), filters={"exclude": "*old*"})
rows("d12_path_scope", r"contains(lower(path), 'nation_2\customer')", r"path:NATION_2\Customer",
     columns=("drive", "frs", "path"), source="paths")
rows("d13_path_pattern", r"regexp_full_match(lower(path), '.:\\nation_1\\[^\\]+\\order_1[^\\]*\\[^\\]*\.pdf')",
     r"\nation_1\*\order_1*\*.pdf", columns=("drive", "frs", "path"), source="paths")
rows("d13_any_depth", r"regexp_full_match(lower(path), '.:\\nation_1\\(?:[^\\]+\\)+[^\\]*ring[^\\]*')",
     r"nation_1\**\*ring*", columns=("drive", "frs", "path"), source="paths")
rows("d13_inner_segment", r"regexp_full_match(lower(path), '.:\\(?:[^\\]+\\)*order_1.\\[^\\]*gear[^\\]*')",
     "order_1?/gear", columns=("drive", "frs", "path"), source="paths")
rows("d13_leaf_any_depth", r"starts_with(lower(path), 'c:\nation_0\')",
     r"NATION_0\**", columns=("drive", "frs", "path"), source="paths")
rows("d13_volume_anchor", r"regexp_full_match(lower(path), 'd:\\nation_1\\customer#[^\\]*')",
     r"D:\nation_1\customer#*", columns=("drive", "frs", "path"), source="paths")
rows("d15_literal_on_path", r"contains(lower(path), '01\order_1') ", r"01\ORDER_1", match_path=True,
     columns=("drive", "frs", "path"), source="paths")


def gram_table(spark, sf):
    return cat(spark, sf).grams


for _key, _expression, _where in (
        ("d08_regex_indexed", r"^(hot|cold)_\w+_[0-9]+\.JPG$", r"regexp_matches(lower(name), '^(hot|cold)_\w+_[0-9]+\.jpg$')"),
        ("d08_regex_optional", r"(old_)?ring_[13]\.(pdf|txt)", r"regexp_matches(lower(name), '(old_)?ring_[13]\.(pdf|txt)')"),
        ("d08_regex_repeats", r"[0-9]{7,}[37]$|n(at)+ion_[12]", r"regexp_matches(lower(name), '[0-9]{7,}[37]$|n(at)+ion_[12]')"),
        ("d08_regex_nowhere", r"zzqx.*pdf", "FALSE")):
    query(_key, f"SELECT drive, frs, name FROM catalog WHERE {_where}")(
        lambda spark, sf, e=_expression: cat(spark, sf).regex(e).select("drive", "frs", "name"))


@query("d16_ngram_search", "SELECT drive, frs, name FROM catalog WHERE contains(lower(name), 'd_ring_3')")
def _(spark, sf):
    c = cat(spark, sf)
    return ngrams.ngram_search(c.rows, gram_table(spark, sf), "d_Ring_3").select("drive", "frs", "name")


@query("d16_ngram_short", "SELECT drive, frs, name FROM catalog WHERE contains(lower(name), 'ng')")
def _(spark, sf):
    c = cat(spark, sf)
    return ngrams.ngram_search(c.rows, gram_table(spark, sf), "ng").select("drive", "frs", "name")


@query("d16_ngram_index", """
SELECT gram, count(*) AS postings FROM (
  SELECT DISTINCT drive, frs, substr(upper(name), i, 3) AS gram
  FROM (SELECT drive, frs, name, unnest(range(1, length(name) - 1)) AS i FROM catalog WHERE length(name) >= 3))
GROUP BY gram""")
def _(spark, sf):
    return gram_table(spark, sf).groupBy("gram").agg(F.count("*").alias("postings"))


@query("d17_volume_skip", """
SELECT drive, frs, name FROM catalog WHERE ext = 'pdf' AND drive IN ('C', 'E')""")
def _(spark, sf):
    df = cat(spark, sf).rows
    # Volumes D, F and G hold no PDF in this variant.
    thinned = df.filter((F.col("ext") != "pdf") | F.col("drive").isin("C", "E"))
    return ngrams.prune_volumes(thinned, ngrams.volume_summary(thinned), "pdf").select("drive", "frs", "name")


@query("d18_find_by_path", r"""
SELECT drive, frs, path FROM paths WHERE lower(path) IN ('c:\nation_0', 'd:\nation_1\customer#000000019', 'e:\')
  OR (drive = 'C' AND parent_frs = 5 AND lower(path) = 'c:\nation_5')""")
def _(spark, sf):
    c = cat(spark, sf)
    wanted = [r"C:\NATION_0", r"d:\nation_1\customer#000000019", "E:\\", r"C:\NATION_5"]
    found = [find_by_path(c.rows, c.dirs, w) for w in wanted]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return c.with_paths(out).select("drive", "frs", "path")


# ---------------------------------------------------------------- G: order and limits

ordered("g01_multi_sort", "upper(ext), ext, size DESC, upper(name), name, drive, frs", 500,
        columns=("drive", "frs", "name", "ext", "size"), sort=["extension:asc", "-size"])
ordered("g02_default_direction", "modified DESC NULLS LAST, upper(name), name, drive, frs", 200, sort="modified")
ordered("g02_ignored_fields", "upper(name), name, drive, frs", 100, sort="attributes,nonsense,name")
ordered("g04_sort_size", "size DESC, upper(name), name, drive, frs", 100, sort="-size")
ordered("g04_sort_name", "upper(name), name, drive, frs", 100, sort="name:asc")
ordered("g04_sort_created", "created ASC NULLS FIRST, upper(name), name, drive, frs", 100, sort="created:asc",
        where="NOT is_directory", filters={"mode": "files"})
ordered("g05_limit_offset", "size DESC, upper(name), name, drive, frs", 50, sort="-size", offset=1000)
ordered("g06_top_n_numeric", "allocated_size DESC, upper(name), name, drive, frs", 1000, sort="-size_on_disk")
ordered("g06_top_n_tree", "treesize DESC, upper(name), name, drive, frs", 100, source="tree",
        where="is_directory", filters={"mode": "dirs"}, sort="-treesize")
ordered("g07_top_n_path", "upper(path), path, upper(name), name, drive, frs", 200, source="paths",
        columns=("drive", "frs", "path"), sort="path:asc")
ordered("g07_top_n_path_only", r"""
  upper(po) DESC, po DESC, upper(name), name, drive, frs""", 200,
        source=r"(SELECT *, CASE WHEN frs = 5 THEN path WHEN parent_frs = 5 THEN parent_path ELSE parent_path || '\' END AS po FROM paths)",
        columns=("drive", "frs", "path"), sort="-path_only")
ordered("g08_flag_sort", "(flags & 2) <> 0 DESC, upper(name) DESC, name DESC, drive, frs", 300, sort="-hidden")


@query("g09_total_count", """
SELECT * FROM (SELECT drive, frs, name, count(*) OVER () AS total_count, count(*) OVER () > 20 AS truncated
  FROM catalog WHERE ext = 'pdf' ORDER BY size DESC, upper(name), name, drive, frs LIMIT 20)""")
def _(spark, sf):
    return ordering.with_total(cat(spark, sf).search("*.pdf"), "-size", 20).select(
        "drive", "frs", "name", "total_count", "truncated")


@query("g05_deep_page", """
SELECT drive, frs, name FROM catalog ORDER BY upper(name), name, drive, frs LIMIT 100 OFFSET 30000""")
def _(spark, sf):
    from arborlake.runtime import running_totals
    df = cat(spark, sf).rows
    order = ordering.sort_columns(df, "name:asc")
    numbered = running_totals(df, order, {"row": F.lit(1).cast("bigint")})
    return numbered.filter("row > 30000 and row <= 30100").select("drive", "frs", "name")


# ---------------------------------------------------------------- A: sources and sinks

def stored(spark, sf, tag="stored"):
    from checks.base import out_path
    path = out_path(spark, tag)
    catalog_io.write_catalog(cat(spark, sf).rows, path)
    return path


@query("scan_parquet", "SELECT drive, frs, name, size FROM catalog WHERE drive = 'E'")
def _(spark, sf):
    df = catalog_io.read_catalog(spark, stored(spark, sf))
    return df.filter(F.col("drive") == "E").select("drive", "frs", "name", "size")


def volumes(spark, sf):
    path = stored(spark, sf, "volumes")
    return {**{x: f"{path}/drive={x}" for x in "CDEFG"}, "Q": f"{path}/missing"}


@query("scan_multi_volume", "SELECT drive, frs, name FROM catalog")
def _(spark, sf):
    return catalog_io.read_volumes(spark, volumes(spark, sf))[0].select("drive", "frs", "name")


@query("scan_volume_report", """
SELECT drive, count(*) AS records, FALSE AS failed FROM catalog GROUP BY drive UNION ALL SELECT 'Q', 0, TRUE""")
def _(spark, sf):
    report = catalog_io.read_volumes(spark, volumes(spark, sf))[1]
    return report.select("drive", "records", (F.col("error") != "").alias("failed"))


@query("scan_listing_csv", """
SELECT path AS "Path", size AS "Size", CAST(CASE WHEN is_directory THEN 1 ELSE 0 END AS INT) AS folder FROM tree""")
def _(spark, sf):
    from checks.base import out_path
    path = out_path(spark, "listing")
    names = ["path", "size", "size_on_disk", "descendants", "directory_flag", "hidden", "system", "archive",
             "read_only", "compressed", "encrypted", "sparse", "reparse"]
    cat(spark, sf).export(path, columns=names)
    return catalog_io.read_listing(spark, path).select("Path", "Size", F.col("Directory Flag").alias("folder"))


@query("listing_from_json", """
SELECT path AS "Path", allocated_size AS "Size on Disk", descendants AS "Descendants" FROM tree""")
def _(spark, sf):
    from checks.base import out_path
    path = out_path(spark, "listing-json")
    cat(spark, sf).export(path, fmt="json", columns=["path", "size_on_disk", "descendants"])
    listing = catalog_io.read_listing(spark, path, "json")
    return listing.select("Path", "Size on Disk", "Descendants")


_SHOWN = r"""
SELECT path AS "Path", CAST(size AS VARCHAR) AS "Size",
  coalesce(strftime(modified + INTERVAL 3600 SECOND, '%Y-%m-%d %H:%M:%S'), '') AS "Last Written",
  CASE WHEN flags & 2 <> 0 THEN 'yes' ELSE 'no' END AS "Hidden", type AS "Type" FROM paths"""


def shown(spark, sf, fmt, sep=","):
    from checks.base import out_path
    path = out_path(spark, fmt)
    columns = "path,size,modified,hidden,type"
    cat(spark, sf).export(path, fmt=fmt, columns=columns, sep=sep, pos="yes", neg="no", tz_offset=3600)
    if fmt == "json":
        return spark.read.schema("Path string, Size string, `Last Written` string, Hidden string, Type string").json(path)
    mark = "\t" if fmt == "tsv" else sinks.separator(sep)
    raw = (spark.read.option("header", True).option("sep", mark).option("quote", '"').option("escape", '"')
           .csv(path))
    return raw.na.fill("")


@query("sink_csv", _SHOWN)
def _(spark, sf):
    return shown(spark, sf, "csv")


@query("sink_tsv_sep", _SHOWN)
def _(spark, sf):
    return shown(spark, sf, "csv", "TAB")


@query("sink_json", _SHOWN)
def _(spark, sf):
    return shown(spark, sf, "json")


@query("sink_bulk_export", """SELECT drive AS "Drive", path AS "Path", treesize AS "Tree Size" FROM tree""")
def _(spark, sf):
    from checks.base import out_path
    path = out_path(spark, "bulk")
    cat(spark, sf).export(path, fmt="parquet", columns="all", per_volume=True)
    return spark.read.parquet(path).select(F.col("Drive").cast("string").alias("Drive"), "Path", "Tree Size")


@query("sink_legacy_rows", r"""
SELECT CASE WHEN is_directory AND frs <> 5 THEN path || '\' ELSE path END AS "Path",
  CASE WHEN is_directory THEN '' ELSE name END AS "Name",
  CASE WHEN is_directory AND frs <> 5 THEN path || '\' WHEN frs = 5 THEN path
       WHEN parent_frs = 5 THEN parent_path ELSE parent_path || '\' END AS "Path Only",
  treesize AS "Size", tree_allocated AS "Size on Disk", CAST(flags & 1764919 AS INT) AS "Attributes" FROM tree""")
def _(spark, sf):
    c = cat(spark, sf)
    full = sinks.listing(c.with_paths(c.tree_rows), legacy=True)
    return full.select("Path", "Name", "Path Only", "Size", "Size on Disk", "Attributes")


@query("dir_treesize_as_size", "SELECT drive, frs, treesize AS size, tree_allocated AS allocated_size FROM tree")
def _(spark, sf):
    return h.with_directory_sizes(cat(spark, sf).tree_rows).select("drive", "frs", "size", "allocated_size")


# ---------------------------------------------------------------- H: set operations

@query("h01_union_volumes", "SELECT drive, frs, name, CASE WHEN drive = 'D' THEN ext ELSE '' END AS ext FROM catalog")
def _(spark, sf):
    df = cat(spark, sf).rows
    parts = [df.filter(F.col("drive") == x).select("drive", "frs", "name", *(["ext"] if x == "D" else []))
             for x in "CDEFG"]
    return catalog_io.union_volumes(parts).select("drive", "frs", "name", F.coalesce("ext", F.lit("")).alias("ext"))


def delta_rows(spark, sf):
    """Two delta batches: sizes grow, then some rows vanish and new ones appear."""
    df = cat(spark, sf).rows.filter(~F.col("is_directory"))
    first = df.filter(F.col("frs") % 5 == 0).withColumns({
        "size": F.col("size") + 1, "batch": F.lit(1), "tombstone": F.lit(False)})
    second = df.filter(F.col("frs") % 15 == 0).withColumns({"batch": F.lit(2), "tombstone": F.lit(True)})
    new = df.filter(F.col("frs") % 7 == 0).withColumns({
        "frs": F.col("frs") + F.lit(5_000_000_000), "batch": F.lit(2), "tombstone": F.lit(False)})
    return first.unionByName(second).unionByName(new)


_OVERLAID = """
SELECT drive, frs, name, CASE WHEN frs % 5 = 0 AND NOT is_directory THEN size + 1 ELSE size END AS size
FROM catalog WHERE is_directory OR frs % 15 <> 0
UNION ALL SELECT drive, frs + 5000000000, name, size FROM catalog WHERE NOT is_directory AND frs % 7 = 0"""


@query("h03_overlay", _OVERLAID)
def _(spark, sf):
    return ov.overlay(cat(spark, sf).rows, delta_rows(spark, sf)).select("drive", "frs", "name", "size")


@query("h04_compaction", f"SELECT * FROM ({_OVERLAID}) WHERE drive IN ('C', 'D')")
def _(spark, sf):
    delta = delta_rows(spark, sf).filter(F.col("drive").isin("C", "D"))
    return ov.compact(cat(spark, sf).rows, delta).select("drive", "frs", "name", "size")
