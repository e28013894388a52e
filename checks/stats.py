"""Checked queries: aggregations, rollups, duplicates, volume statistics, presets."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from arborlake import Filters
from arborlake.functions import derive
from arborlake.functions.derive import SIZE_BOUNDS
from arborlake.operators import aggregate as agg, duplicates as dup, filters as flt
from arborlake.runtime import materialize
from arborlake.sources import binding, sinks

from checks.base import cat, query

FLOATS = ("waste_pct", "avg_size", "share_count", "share_bytes", "avg", "rate")


def rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in df.columns if c in FLOATS})


def files(spark, sf):
    return cat(spark, sf).rows.filter(~F.col("is_directory"))


_METRIC_SQL = {
    "count": "count(*)", "total_bytes": "CAST(sum(size) AS BIGINT)",
    "total_allocated": "CAST(sum(allocated_size) AS BIGINT)",
    "waste_bytes": "CAST(greatest(sum(allocated_size) - sum(size), 0) AS BIGINT)",
    "waste_pct": "round(CASE WHEN sum(allocated_size) = 0 THEN 0.0 ELSE greatest(sum(allocated_size) - sum(size), 0)::DOUBLE"
                 " / sum(allocated_size)::DOUBLE * 100 END, 4)::DOUBLE",
    "avg_size": "round(sum(size)::DOUBLE / count(*), 4)", "min_size": "min(size)", "max_size": "max(size)",
    "share_count": "round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 4)::DOUBLE",
    "share_bytes": "round(sum(size)::DOUBLE / (sum(sum(size)) OVER ())::DOUBLE * 100, 4)",
}


def buckets_sql(key: str, source: str = "catalog", where: str = "TRUE", metrics=None, tail: str = "") -> str:
    """Oracle of a bucket table; metrics come out rounded."""
    wanted = list(metrics or _METRIC_SQL)
    cols = ", ".join(f"{_METRIC_SQL[m]} AS {m}" for m in wanted)
    return f"SELECT {key} AS key, {cols} FROM {source} WHERE {where} GROUP BY 1 {tail}"


def terms_sql(key: str, top: int, source: str = "catalog", where: str = "TRUE", metrics=None) -> str:
    inner = buckets_sql(key, source, where, metrics)
    return (f"WITH g AS ({inner}) SELECT g.*, CAST((SELECT sum(count) FROM g) - sum(count) OVER () AS BIGINT) AS other_count, "
            f"(SELECT count(*) FROM g) AS total_groups FROM (SELECT * FROM g ORDER BY count DESC, key LIMIT {top}) g")


# ---------------------------------------------------------------- scalars

@query("f01_count", "SELECT count(*) AS count FROM catalog")
def _(spark, sf):
    return agg.count(cat(spark, sf).rows)


@query("f02_stats_size", """
SELECT count(*) AS count, CAST(sum(size) AS BIGINT) AS sum, min(size) AS min, max(size) AS max, round(avg(size), 4) AS avg,
  count(*) FILTER (WHERE size <> 0) AS value_count, count(*) FILTER (WHERE size = 0) AS missing_count,
  CAST(sum(allocated_size) - sum(size) AS BIGINT) AS waste_bytes,
  round((sum(allocated_size) - sum(size))::DOUBLE / sum(allocated_size)::DOUBLE * 100, 4) AS waste_pct FROM catalog""")
def _(spark, sf):
    return rounded(agg.stats(cat(spark, sf).rows, "size"))


@query("f02_stats_empty", """
SELECT CAST(0 AS BIGINT) AS count, CAST(0 AS BIGINT) AS sum, CAST(0 AS BIGINT) AS min, CAST(0 AS BIGINT) AS max,
  0.0::DOUBLE AS avg FROM catalog LIMIT 1""")
def _(spark, sf):
    return agg.stats(cat(spark, sf).rows.filter("size < 0"), "size", ["count", "sum", "min", "max", "avg"])


@query("f02_stats_tree", """
SELECT count(*) AS count, CAST(sum(descendants) AS BIGINT) AS sum, max(descendants) AS max, round(avg(descendants), 4) AS avg
FROM tree WHERE is_directory""")
def _(spark, sf):
    dirs = cat(spark, sf).tree_rows.filter("is_directory")
    return rounded(agg.stats(dirs, "descendants", ["count", "sum", "max", "avg"]))


@query("f02_stats_times", """
SELECT count(*) AS count, strftime(min(modified), '%Y-%m-%d') AS first, strftime(max(modified), '%Y-%m-%d') AS last,
  count(modified) AS value_count, count(*) - count(modified) AS missing_count FROM catalog""")
def _(spark, sf):
    out = agg.stats(cat(spark, sf).rows, "modified")
    return out.select("count", F.date_format("min", "yyyy-MM-dd").alias("first"),
                      F.date_format("max", "yyyy-MM-dd").alias("last"), "value_count", "missing_count")


@query("f02_combined_pass", """
SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT ext) AS exts,
  count(*) FILTER (WHERE ext = '') AS no_ext FROM catalog WHERE NOT is_directory""")
def _(spark, sf):
    df = files(spark, sf)
    return agg.combined(df, {"n": F.count("*"), "bytes": F.sum("size"), "exts": F.count_distinct("ext"),
                             "no_ext": agg.missing_column(df, "extension")})


# ---------------------------------------------------------------- terms

@query("f03_terms_extension", terms_sql("ext", 4, where="NOT is_directory"))
def _(spark, sf):
    return rounded(agg.terms(files(spark, sf), "extension", 4))


@query("f04_terms_type", terms_sql("type", 30))
def _(spark, sf):
    return rounded(agg.terms(cat(spark, sf).rows, "type"))


@query("f04_terms_drive", terms_sql("drive || ':'", 3))
def _(spark, sf):
    return rounded(agg.terms(cat(spark, sf).rows, "drive", 3))


@query("f04_terms_directory_flag", terms_sql("CASE WHEN is_directory THEN 'directory' ELSE 'file' END", 2))
def _(spark, sf):
    return rounded(agg.terms(cat(spark, sf).rows, "directory_flag"))


_FLAG_KEYS = {"hidden": 2, "read_only": 1, "archive": 32, "system": 4, "compressed": 2048, "encrypted": 16384,
              "sparse": 512, "reparse": 1024, "offline": 4096, "not_indexed": 8192, "temporary": 256,
              "virtual": 65536, "pinned": 524288, "unpinned": 1048576, "integrity": 32768, "no_scrub": 131072,
              "recall_on_open": 262144, "recall_on_data_access": 4194304}


@query("f04_terms_flags", " UNION ALL ".join(
    f"SELECT '{n}' AS flag, CASE WHEN flags & {b} <> 0 THEN 'true' ELSE 'false' END AS key, count(*) AS count "
    f"FROM catalog GROUP BY 2" for n, b in _FLAG_KEYS.items()))
def _(spark, sf):
    return agg.flag_facets(cat(spark, sf).rows, list(_FLAG_KEYS)).select("flag", "key", "count")


@query("f04_terms_hidden", terms_sql("CASE WHEN flags & 2 <> 0 THEN 'true' ELSE 'false' END", 2))
def _(spark, sf):
    return rounded(agg.terms(cat(spark, sf).rows, "hidden"))


@query("f04_terms_name", terms_sql("name", 50, where="NOT is_directory", metrics=("count", "total_bytes")))
def _(spark, sf):
    return agg.terms(files(spark, sf), "name", 50, ("total_bytes",))


@query("f04_terms_path_only", terms_sql(
    r"CASE WHEN frs = 5 THEN path WHEN parent_frs = 5 THEN parent_path ELSE parent_path || '\' END", 30, "paths",
    metrics=("count", "total_bytes")))
def _(spark, sf):
    return agg.terms(cat(spark, sf).with_paths(), "path_only", 30, ("total_bytes",))


@query("f05_bucket_metrics", terms_sql("ext", 50, where="NOT is_directory AND size > 0"))
def _(spark, sf):
    return rounded(agg.terms(files(spark, sf).filter("size > 0"), "extension"))


# ---------------------------------------------------------------- ranges

@query("f06_histogram", buckets_sql("size // 1048576 * 1048576", where="NOT is_directory"))
def _(spark, sf):
    return rounded(agg.histogram(files(spark, sf), "size", 1_048_576))


@query("f07_range", buckets_sql("""CASE WHEN size < 1048576 THEN '< 1048576' WHEN size < 8388608 THEN '1048576 - 8388608'
  WHEN size < 1073741824 THEN '8388608 - 1073741824' ELSE '>= 1073741824' END""", where="NOT is_directory"))
def _(spark, sf):
    return rounded(agg.range_(files(spark, sf), "size", [1_048_576, 8_388_608, 1_073_741_824]))


for _calendar in ("hour", "day", "week", "month", "quarter", "year"):
    _form = "%Y-%m-%d %H:00" if _calendar == "hour" else "%Y-%m-%d"

    @query(f"f08_date_{_calendar}", buckets_sql(
        f"coalesce(strftime(date_trunc('{_calendar}', modified), '{_form}'), '')"))
    def _(spark, sf, calendar=_calendar):
        return rounded(agg.date_histogram(cat(spark, sf).rows, "modified", calendar))


for _calendar, _days in (("month", 30), ("quarter", 90), ("year", 365)):
    @query(f"f08_fixed_{_calendar}", buckets_sql(
        f"strftime(DATE '1601-01-01' + CAST(date_diff('day', DATE '1601-01-01', CAST(created AS DATE)) // {_days} * {_days} AS INT), '%Y-%m-%d')",
        where="NOT is_directory", metrics=("count", "total_bytes")))
    def _(spark, sf, calendar=_calendar):
        return agg.date_histogram(files(spark, sf), "created", calendar, ("total_bytes",), mode="fixed_days")


@query("f09_missing", """
SELECT 'extension' AS field, count(*) FILTER (WHERE ext = '') AS missing FROM catalog UNION ALL
SELECT 'size', count(*) FILTER (WHERE size = 0) FROM catalog UNION ALL
SELECT 'modified', count(*) FILTER (WHERE modified IS NULL) FROM catalog""")
def _(spark, sf):
    out = None
    for name in ("extension", "size", "modified"):
        part = agg.missing(cat(spark, sf).rows, name).select(F.lit(name).alias("field"), "missing")
        out = part if out is None else out.unionByName(part)
    return out


@query("f10_distinct", "SELECT count(DISTINCT name) AS names, count(DISTINCT ext) AS exts FROM catalog")
def _(spark, sf):
    df = cat(spark, sf).rows
    names = agg.distinct(df, "name").select(F.col("distinct").alias("names"))
    return names.withColumn("exts", agg.distinct(df, "extension").scalar())


@query("f10_distinct_approx", "SELECT TRUE AS close FROM catalog LIMIT 1")
def _(spark, sf):
    df = cat(spark, sf).rows
    exact = agg.distinct(df, "name").scalar()
    return agg.distinct(df, "name", approx=True).select(
        (F.abs(F.col("distinct") - exact) < exact * 0.2).alias("close"))


# ---------------------------------------------------------------- rollups

@query("f11_rollup_drive", buckets_sql("drive || ':'"))
def _(spark, sf):
    return rounded(agg.rollup_drive(cat(spark, sf).rows))


def _depth_key(k: int) -> str:
    return rf"CASE WHEN frs = 5 THEN path ELSE array_to_string(string_split(path, '\')[1:{k + 1}], '\') END"


for _k in (1, 2, 3):
    @query(f"f12_rollup_path_{_k}", buckets_sql(_depth_key(_k), "paths", tail="ORDER BY total_bytes DESC, key LIMIT 40"))
    def _(spark, sf, k=_k):
        c = cat(spark, sf)
        return rounded(agg.rollup_path(c.rows, c.dirs, k, 40))


@query("f13_rollup_ancestor", buckets_sql(
    r"CASE WHEN drive = 'C' AND above[2] = 1000 THEN array_to_string(string_split(path, '\')[1:3], '\') ELSE path END",
    "paths", tail="ORDER BY total_bytes DESC, key LIMIT 60"))
def _(spark, sf):
    c = cat(spark, sf)
    return rounded(agg.rollup_ancestor(c.rows, c.dirs, "C", 1000, 60))


@query("f13_rollup_ancestor_inside", buckets_sql(
    r"array_to_string(string_split(path, '\')[1:3], '\')", "paths", "drive = 'C' AND above[2] = 1000",
    metrics=("count", "total_bytes", "total_allocated")))
def _(spark, sf):
    c = cat(spark, sf)
    return agg.rollup_ancestor(c.rows, c.dirs, "C", 1000, None, ("total_bytes", "total_allocated"), outside="drop")


@query("f14_rollup_nested", rf"""
WITH g AS (SELECT {_depth_key(1)} AS key, type AS sub_key, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_bytes
           FROM paths GROUP BY 1, 2),
o AS (SELECT key FROM g GROUP BY key ORDER BY sum(total_bytes) DESC, key LIMIT 10)
SELECT key, sub_key, count, total_bytes, CAST(sub_rank AS INT) AS sub_rank FROM (
  SELECT g.*, row_number() OVER (PARTITION BY key ORDER BY count DESC, sub_key) AS sub_rank FROM g JOIN o USING (key))
WHERE sub_rank <= 3""")
def _(spark, sf):
    c = cat(spark, sf)
    return agg.rollup_path(c.rows, c.dirs, 1, 10, ("total_bytes",), sub="type", sub_top=3)


def flat_samples(df, keys, shown=("drive",)):
    """One row per sample."""
    return df.select(*keys, F.explode("samples").alias("s"))


@query("f15_rollup_samples", rf"""
WITH r AS (SELECT *, {_depth_key(2)} AS key FROM paths),
o AS (SELECT key, CAST(sum(size) AS BIGINT) AS total_bytes FROM r GROUP BY key ORDER BY 2 DESC, key LIMIT 25)
SELECT key, total_bytes, CAST(rank AS INT) AS rank, name, size, path FROM (
  SELECT r.*, o.total_bytes, row_number() OVER (PARTITION BY key ORDER BY size DESC, drive, frs) AS rank FROM r JOIN o USING (key))
WHERE rank <= 4""")
def _(spark, sf):
    c = cat(spark, sf)
    out = agg.rollup_path(c.rows, c.dirs, 2, 25, ("total_bytes",), sample=4, sample_fields=("name", "size", "path"))
    return flat_samples(out, ["key", "total_bytes"]).select("key", "total_bytes", "s.rank", "s.name", "s.size", "s.path")


@query("f14_nested_samples", rf"""
WITH r AS (SELECT *, {_depth_key(1)} AS key, type AS sub_key FROM paths),
g AS (SELECT key, sub_key, count(*) AS count, sum(size) AS b FROM r GROUP BY 1, 2),
o AS (SELECT key FROM g GROUP BY key ORDER BY sum(b) DESC, key LIMIT 10),
k AS (SELECT key, sub_key FROM g JOIN o USING (key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY count DESC, sub_key) <= 3)
SELECT key, sub_key, CAST(rank AS INT) AS rank, name FROM (
  SELECT r.*, row_number() OVER (PARTITION BY key, sub_key ORDER BY modified ASC NULLS FIRST, drive, frs) AS rank FROM r JOIN k USING (key, sub_key))
WHERE rank <= 2""")
def _(spark, sf):
    c = cat(spark, sf)
    out = agg.rollup_path(c.rows, c.dirs, 1, 10, ("total_bytes",), sub="type", sub_top=3, sample=2, sample_sort="modified",
                          sample_desc=False, sample_fields=("name",))
    return flat_samples(out, ["key", "sub_key"]).select("key", "sub_key", "s.rank", "s.name")


@query("f15_top_hits", """
SELECT key, CAST(rank AS INT) AS rank, name, size, path FROM (
  SELECT type AS key, name, size, path, row_number() OVER (PARTITION BY type ORDER BY size DESC, drive, frs) AS rank
  FROM paths) WHERE rank <= 3""")
def _(spark, sf):
    c = cat(spark, sf)
    out = agg.terms(c.rows, "type", 30, ("count",), sample=3, sample_fields=("name", "size", "path"), dirs=c.dirs)
    return flat_samples(out, ["key"]).select("key", "s.rank", "s.name", "s.size", "s.path")


@query("f15_top_hits_time", """
SELECT key, CAST(rank AS INT) AS rank, name FROM (
  SELECT ext AS key, name, row_number() OVER (PARTITION BY ext ORDER BY modified ASC NULLS FIRST, drive, frs) AS rank
  FROM catalog WHERE ext IN (SELECT ext FROM catalog WHERE NOT is_directory GROUP BY ext ORDER BY count(*) DESC, ext LIMIT 3)
  AND NOT is_directory) WHERE rank <= 5""")
def _(spark, sf):
    out = agg.terms(files(spark, sf), "extension", 3, ("count",), sample=5, sample_sort="modified",
                    sample_desc=False, sample_fields=("name",))
    return flat_samples(out, ["key"]).select("key", "s.rank", "s.name")


def round_trip(rows, buckets):
    """Counts of the rows that each bucket's own predicates select, all from one pass over the rows."""
    found, counts = [], []
    kind = buckets.schema["key"].dataType
    for i, b in enumerate(buckets.collect()):   # a bucket for each type, flag value, volume, range or quarter
        asked = [(d["field"], d["op"], d["value"]) for d in b["drilldown"]]
        counts.append(F.count_if(derive.all_of([flt.predicate(rows, *p) for p in asked])).alias(f"n{i}"))
        found.append(F.struct(F.lit(b["key"]).cast(kind).alias("key"), F.lit(b["count"]).cast("bigint").alias("count"), F.col(f"n{i}").alias("again"),
                              F.lit("; ".join(" ".join(p) for p in asked)).alias("predicates")))
    return rows.agg(*counts).select(F.inline(F.array(*found)))


@query("f16_drilldown", """
SELECT type AS key, count(*) AS count, count(*) AS again, 'drive eq D; type eq ' || type AS predicates FROM catalog
WHERE drive = 'D' GROUP BY 1""")
def _(spark, sf):
    rows, scope = cat(spark, sf).rows, [("drive", "eq", "D")]
    return round_trip(rows, agg.drilldown(agg.terms(flt.where_all(rows, scope), "type", 30, ("count",)), "type", scope))


@query("f16_drilldown_drive", """
SELECT drive || ':' AS key, count(*) AS count, count(*) AS again, 'drive eq ' || drive AS predicates FROM catalog GROUP BY drive""")
def _(spark, sf):
    rows = cat(spark, sf).rows
    return round_trip(rows, agg.drilldown(agg.rollup_drive(rows), "drive"))


@query("f16_drilldown_flag", """
SELECT key, count(*) AS count, count(*) AS again, 'hidden eq ' || key AS predicates
FROM (SELECT CASE WHEN flags & 2 <> 0 THEN 'true' ELSE 'false' END AS key FROM catalog) GROUP BY key""")
def _(spark, sf):
    rows = cat(spark, sf).rows
    return round_trip(rows, agg.drilldown(agg.terms(rows, "hidden", None, ("count",)), "hidden"))


_BOUNDS = (1000, 1_000_000, 2_000_000, 4_000_000, 8_000_000)
_NAMED = "CASE WHEN size < 1000 THEN '< 1000'" + "".join(
    f" WHEN size < {b} THEN '{a} - {b}'" for a, b in zip(_BOUNDS, _BOUNDS[1:])) + f" ELSE '>= {_BOUNDS[-1]}' END"
_NAMED_ENDS = "CASE WHEN size < 1000 THEN 'size lt 1000'" + "".join(
    f" WHEN size < {b} THEN 'size gte {a}; size lt {b}'" for a, b in zip(_BOUNDS, _BOUNDS[1:])) + f" ELSE 'size gte {_BOUNDS[-1]}' END"


@query("f16_drilldown_range", f"""
SELECT key, count(*) AS count, count(*) AS again, 'drive eq D; ' || ends AS predicates
FROM (SELECT {_NAMED} AS key, {_NAMED_ENDS} AS ends FROM catalog WHERE drive = 'D') GROUP BY key, ends""")
def _(spark, sf):
    """All named ranges, those open at an end too."""
    rows, scope = cat(spark, sf).rows, [("drive", "eq", "D")]
    buckets = agg.range_(flt.where_all(rows, scope), "size", list(_BOUNDS), ("count",))
    return round_trip(rows, agg.drilldown_named_range(buckets, "size", list(_BOUNDS), scope))


@query("f16_drilldown_histogram", """
SELECT b AS key, count(*) AS count, count(*) AS again, 'drive eq D; size gte ' || b || '; size lt ' || (b + 1000000) AS predicates
FROM (SELECT size // 1000000 * 1000000 AS b FROM catalog WHERE drive = 'D') GROUP BY b""")
def _(spark, sf):
    rows, scope = cat(spark, sf).rows, [("drive", "eq", "D")]
    buckets = agg.histogram(flt.where_all(rows, scope), "size", 1_000_000, ("count",))
    return round_trip(rows, agg.drilldown_histogram(buckets, "size", 1_000_000, scope))


@query("f16_drilldown_date", """
SELECT strftime(m, '%Y-%m-%d') AS key, count(*) AS count, count(*) AS again,
  'modified gte ' || strftime(m, '%Y-%m-%d 00:00:00') || '; modified lt ' || strftime(m + INTERVAL 3 MONTH, '%Y-%m-%d 00:00:00') AS predicates
FROM (SELECT date_trunc('quarter', modified) AS m FROM catalog WHERE NOT is_directory) GROUP BY m""")
def _(spark, sf):
    rows = files(spark, sf)
    buckets = agg.date_histogram(rows, "modified", "quarter", ("count",)).select("key", "count")
    return round_trip(rows, agg.drilldown_date(buckets, "modified", "quarter"))


# ---------------------------------------------------------------- duplicates

def coarse(spark, sf):
    """Catalog with sizes in whole 4 MiB blocks, so that equal files exist."""
    c = cat(spark, sf)
    return replace(c, whole=c, rows=c.rows.withColumn("size", F.expr("size div 4194304 * 4194304")))


_GROUPS = """
  SELECT size AS k_size, lower(name) AS k_name, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_bytes,
    CAST(sum(size) AS BIGINT) // count(*) AS file_size,
    CAST(sum(size) AS BIGINT) - CAST(sum(size) AS BIGINT) // count(*) AS reclaimable_bytes
  FROM (SELECT * REPLACE (size // 4194304 * 4194304 AS size) FROM catalog) WHERE NOT is_directory AND size > 0 GROUP BY 1, 2 HAVING count(*) > 1"""


@query("f17_duplicates", f"SELECT * FROM ({_GROUPS}) ORDER BY reclaimable_bytes DESC, k_size, k_name LIMIT 25")
def _(spark, sf):
    return dup.duplicates(coarse(spark, sf).rows, ("size", "name"), 25)


@query("f17_duplicate_names", """
SELECT lower(name) AS k_name, ext AS k_extension, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_bytes,
  CAST(sum(size) AS BIGINT) // count(*) AS file_size,
  CAST(sum(size) AS BIGINT) - CAST(sum(size) AS BIGINT) // count(*) AS reclaimable_bytes
FROM catalog WHERE NOT is_directory AND size > 0 GROUP BY 1, 2 HAVING count(*) > 1
ORDER BY reclaimable_bytes DESC, 1, 2 LIMIT 100""")
def _(spark, sf):
    return dup.duplicates(cat(spark, sf).rows, ("name", "extension"), 100)


@query("f17_duplicate_samples", """
WITH g AS (SELECT lower(name) AS k, sum(size) - sum(size) // count(*) AS r FROM catalog WHERE NOT is_directory AND size > 0
           GROUP BY 1 HAVING count(*) > 1 ORDER BY r DESC, k LIMIT 10)
SELECT k_name, CAST(rank AS INT) AS rank, size, path FROM (
  SELECT lower(name) AS k_name, size, path, row_number() OVER (PARTITION BY lower(name) ORDER BY size DESC, drive, frs) AS rank
  FROM paths WHERE NOT is_directory AND size > 0 AND lower(name) IN (SELECT k FROM g)) WHERE rank <= 2""")
def _(spark, sf):
    c = cat(spark, sf)
    out = dup.duplicates(c.rows, ("name",), 10, 2, c.dirs)
    return flat_samples(out, ["k_name"]).select("k_name", "s.rank", "s.size", "s.path")


@query("f18_duplicates_summary", """
SELECT count(*) AS candidate_groups, CAST(sum(n) AS BIGINT) AS candidate_files, CAST(sum(b) AS BIGINT) AS duplicate_bytes,
  CAST(sum(b - b // n) AS BIGINT) AS reclaimable_bytes
FROM (SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS b FROM catalog WHERE NOT is_directory AND size > 0
      GROUP BY lower(name) HAVING count(*) > 1)""")
def _(spark, sf):
    return dup.summary(dup.groups(cat(spark, sf).rows, ("name",)))


_DOC_GROUPS = """
  SELECT size AS k_size, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_bytes, size AS file_size,
    CAST(sum(size) AS BIGINT) - size AS reclaimable_bytes, count(DISTINCT {body}) AS bodies, CAST({est} AS BIGINT) AS estimate
  FROM docs WHERE size > 0 GROUP BY size HAVING count(*) > 1"""
_WHOLE = _DOC_GROUPS.format(body="sha256(text)", est="size * count(*)")


def verified(spark, sf, **options):
    docs = binding.documents(spark, sf)
    groups = materialize(dup.groups(docs, ("size",)), "docgroups")
    members = dup.members(docs, groups, ("size",))
    return dup.verify(groups, members, docs, ("size",), **options)


@query("f19_verify_sha256", f"""
SELECT k_size, count, reclaimable_bytes, CASE WHEN bodies = 1 THEN 'verified' ELSE 'rejected' END AS outcome FROM ({_WHOLE})""")
def _(spark, sf):
    return verified(spark, sf).select("k_size", "count", "reclaimable_bytes", "outcome")


@query("f19_verify_first_bytes", """
SELECT k_size, CASE WHEN lo = hi THEN 'verified' ELSE 'rejected' END AS outcome FROM (
  SELECT size AS k_size, min(encode(text)::BLOB[:8]) AS lo, max(encode(text)::BLOB[:8]) AS hi
  FROM docs WHERE size > 0 GROUP BY size HAVING count(*) > 1)""".replace("::BLOB[:8]", "[:8]"))
def _(spark, sf):
    return verified(spark, sf, mode="first_bytes", n_bytes=8).select("k_size", "outcome")


@query("f19_verify_summary", f"""
SELECT count(*) FILTER (WHERE bodies = 1) AS groups_verified, count(*) FILTER (WHERE bodies > 1) AS groups_rejected,
  CAST(0 AS BIGINT) AS groups_skipped, CAST(0 AS BIGINT) AS groups_errored,
  CAST(coalesce(sum(reclaimable_bytes) FILTER (WHERE bodies = 1), 0) AS BIGINT) AS reclaimable_bytes,
  CAST(sum(estimate) AS BIGINT) AS bytes_read, CAST(sum(count) AS BIGINT) AS files_read, FALSE AS budget_exhausted FROM ({_WHOLE})""")
def _(spark, sf):
    return dup.verification_summary(verified(spark, sf))


@query("f19_verify_budget", f"""
WITH RECURSIVE g AS (SELECT *, row_number() OVER (ORDER BY reclaimable_bytes DESC, k_size) AS seq FROM ({_WHOLE})),
walk AS (SELECT CAST(0 AS BIGINT) AS seq, CAST(200000 AS BIGINT) AS left_bytes, CAST(0 AS BIGINT) AS k_size, FALSE AS taken
  UNION ALL SELECT g.seq, CASE WHEN g.estimate <= w.left_bytes THEN w.left_bytes - g.estimate ELSE w.left_bytes END, g.k_size,
    g.estimate <= w.left_bytes FROM walk w JOIN g ON g.seq = w.seq + 1)
SELECT g.k_size, CASE WHEN NOT w.taken THEN 'skipped' WHEN g.bodies = 1 THEN 'verified' ELSE 'rejected' END AS outcome
FROM g JOIN walk w ON w.seq = g.seq""")
def _(spark, sf):
    return verified(spark, sf, max_bytes=200_000).select("k_size", "outcome")


@query("f19_verify_budget_files", f"""
WITH RECURSIVE g AS (SELECT *, row_number() OVER (ORDER BY reclaimable_bytes DESC, k_size) AS seq FROM ({_WHOLE})),
walk AS (SELECT CAST(0 AS BIGINT) AS seq, CAST(9 AS BIGINT) AS left_files, CAST(0 AS BIGINT) AS k_size, FALSE AS taken
  UNION ALL SELECT g.seq, CASE WHEN g.count <= w.left_files THEN w.left_files - g.count ELSE w.left_files END, g.k_size,
    g.count <= w.left_files FROM walk w JOIN g ON g.seq = w.seq + 1)
SELECT g.k_size, CASE WHEN NOT w.taken THEN 'skipped' WHEN g.bodies = 1 THEN 'verified' ELSE 'rejected' END AS outcome
FROM g JOIN walk w ON w.seq = g.seq""")
def _(spark, sf):
    return verified(spark, sf, max_files=9).select("k_size", "outcome")


# ---------------------------------------------------------------- presets

def preset(key, name, label, sql):
    @query(key, sql)
    def _(spark, sf):
        return rounded(cat(spark, sf).preset(name)[label])


_B = ("count", "total_bytes", "waste_bytes", "share_count", "share_bytes")
_T = ("count", "total_bytes")
_MONTH = "coalesce(strftime(date_trunc('month', {}), '%Y-%m-%d'), '')"
_RANGE = "CASE " + " ".join(
    f"WHEN size < {b} THEN '{'< ' + str(b) if i == 0 else str(SIZE_BOUNDS[i - 1]) + ' - ' + str(b)}'"
    for i, b in enumerate(SIZE_BOUNDS)) + f" ELSE '>= {SIZE_BOUNDS[-1]}' END"
preset("f20_overview_count", "overview", "total_count", "SELECT count(*) AS count FROM catalog")
preset("f20_overview_files_vs_dirs", "overview", "files_vs_dirs",
       terms_sql("CASE WHEN is_directory THEN 'directory' ELSE 'file' END", 2, metrics=_B))
preset("f20_overview_size_stats", "overview", "size_stats", """
SELECT CAST(sum(size) AS BIGINT) AS sum, min(size) AS min, max(size) AS max, round(avg(size), 4) AS avg FROM catalog""")
preset("f20_overview_by_type", "overview", "by_type", terms_sql("type", 30, metrics=_B))
preset("f20_overview_by_drive", "overview", "by_drive", terms_sql("drive || ':'", 26, metrics=_B))
preset("f20_overview_monthly", "overview", "modified_monthly", buckets_sql(_MONTH.format("modified"), metrics=_T))
preset("f20_by_type", "by_type", "by_type", terms_sql("type", 30, metrics=(
    "count", "total_bytes", "total_allocated", "waste_bytes", "waste_pct", "avg_size", "share_count", "share_bytes")))
preset("f20_by_extension", "by_extension", "by_extension", terms_sql("ext", 50, metrics=(
    "count", "total_bytes", "avg_size", "share_count", "share_bytes")))
preset("f20_by_drive", "by_drive", "by_drive", terms_sql("drive || ':'", 26, metrics=(
    "count", "total_bytes", "total_allocated", "waste_bytes", "waste_pct", "share_count", "share_bytes")))
preset("f20_by_size", "by_size", "by_size", buckets_sql(_RANGE, metrics=(
    "count", "total_bytes", "share_count", "share_bytes")))
preset("f20_by_age", "by_age", "by_age", buckets_sql(_MONTH.format("modified"), metrics=(
    "count", "total_bytes", "share_count", "share_bytes")))
preset("f20_storage_allocated", "storage", "allocated_size",
       "SELECT CAST(sum(allocated_size) AS BIGINT) AS sum FROM catalog")
preset("f20_storage_extension", "storage", "waste_by_extension", terms_sql("ext", 20, metrics=(
    "count", "total_bytes", "waste_bytes", "waste_pct")))
preset("f20_storage_drive", "storage", "waste_by_drive", terms_sql("drive || ':'", 26, metrics=(
    "count", "total_bytes", "total_allocated", "waste_bytes", "waste_pct")))
preset("f20_activity_created", "activity", "created_monthly", buckets_sql(_MONTH.format("created"), metrics=_T))
preset("f20_activity_accessed", "activity", "accessed_monthly", buckets_sql(_MONTH.format("accessed"), metrics=("count",)))
preset("f20_top_folders", "top_folders", "top_folders", buckets_sql(_depth_key(1), "paths", metrics=(
    "count", "total_bytes", "total_allocated", "waste_bytes", "share_bytes"), tail="ORDER BY total_bytes DESC, key LIMIT 30"))
preset("f20_media_types", "media", "media_type_breakdown", terms_sql("type", 12, metrics=(
    "count", "total_bytes", "avg_size", "share_bytes")))
preset("f20_media_extensions", "media", "media_extensions", terms_sql("ext", 30, metrics=(
    "count", "total_bytes", "share_bytes")))
preset("f20_cleanup_no_extension", "cleanup", "no_extension",
       "SELECT count(*) FILTER (WHERE ext = '') AS missing FROM catalog")
preset("f20_cleanup_zero", "cleanup", "zero_byte_files", "SELECT count(*) FILTER (WHERE size = 0) AS missing FROM catalog")
preset("f20_cleanup_distinct", "cleanup", "distinct_extensions", "SELECT count(DISTINCT ext) AS distinct FROM catalog"
       .replace("AS distinct", 'AS "distinct"'))


@query("f20_duplicates", f"""
SELECT k_size, k_name, count, total_bytes, file_size, reclaimable_bytes
FROM ({_GROUPS}) ORDER BY reclaimable_bytes DESC, k_size, k_name LIMIT 100""")
def _(spark, sf):
    return coarse(spark, sf).preset("duplicates")["duplicate_candidates"].drop("samples")


@query("f21_filtered_aggregation", terms_sql(
    "ext", 50, where="NOT is_directory AND size >= 1048576 AND modified >= TIMESTAMP '2000-01-01' AND contains(name, 'ring')"))
def _(spark, sf):
    part = cat(spark, sf).scoped("ring", Filters(mode="files", min_size="1MB", newer="2000-01-01"))
    return rounded(part.terms("extension"))


@query("f21_scoped_preset", terms_sql("type", 30, where="drive IN ('D') AND name LIKE '%.pdf'", metrics=_B))
def _(spark, sf):
    return rounded(cat(spark, sf).scoped("*.pdf", drives=["D"]).preset("overview")["by_type"])


@query("f22_facet_values", terms_sql("name", 12, where="starts_with(lower(name), 'old_r')", metrics=_T))
def _(spark, sf):
    return agg.facet_values(cat(spark, sf).rows, "name", "OLD_R", 12)


@query("f23_pagination", """
WITH g AS (SELECT name AS key, count(*) AS count FROM catalog GROUP BY 1)
SELECT key, count, (SELECT count(*) FROM g) AS total, CAST(75 AS INT) AS next_offset
FROM g ORDER BY count DESC, key LIMIT 25 OFFSET 50""")
def _(spark, sf):
    groups = cat(spark, sf).rows.groupBy(F.col("name").alias("key")).agg(F.count("*").alias("count"))
    return agg.page(groups, [F.col("count").desc(), F.col("key")], 50, 25)


_B8 = ("CASE WHEN size < 1024 THEN 0 WHEN size < 10240 THEN 1 WHEN size < 102400 THEN 2 WHEN size < 1048576 THEN 3 "
       "WHEN size < 10485760 THEN 4 WHEN size < 104857600 THEN 5 WHEN size < 1073741824 THEN 6 ELSE 7 END")


@query("f24_volume_stats", "SELECT drive, count(*) AS record_count, count(*) FILTER (WHERE is_directory) AS dir_count, "
       "count(*) FILTER (WHERE NOT is_directory) AS file_count, max(frs) AS max_frs, "
       "CAST(sum(strlen(name)) AS BIGINT) AS total_name_bytes, count(*) FILTER (WHERE link_count > 1) AS multi_name_count, "
       "CAST(0 AS BIGINT) AS ads_count, CAST(0 AS BIGINT) AS system_metafile_count, CAST(0 AS BIGINT) AS system_child_count, "
       "CAST(sum(size) AS BIGINT) AS total_bytes, CAST(0 AS BIGINT) AS dir_bytes, "
       "CAST(sum(CASE WHEN flags & 2 <> 0 THEN size ELSE 0 END) AS BIGINT) AS hidden_bytes, "
       + ", ".join(f"CAST(0 AS BIGINT) AS {n}_bytes" for n in ("system", "compressed", "encrypted", "sparse", "reparse"))
       + ", " + ", ".join(
           f"count(*) FILTER (WHERE NOT is_directory AND {_B8} = {i}) AS bucket{i}_count, "
           f"CAST(coalesce(sum(size) FILTER (WHERE NOT is_directory AND {_B8} = {i}), 0) AS BIGINT) AS bucket{i}_bytes"
           for i in range(8)) + " FROM catalog GROUP BY drive")
def _(spark, sf):
    return agg.volume_stats(cat(spark, sf).rows)


@query("f25_extension_stats", """
SELECT ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes FROM catalog WHERE NOT is_directory GROUP BY ext""")
def _(spark, sf):
    return agg.extension_stats(cat(spark, sf).rows)


@query("f25_extension_totals", """
SELECT count(DISTINCT ext) FILTER (WHERE ext <> '') AS unique_extensions, count(*) FILTER (WHERE ext <> '') AS with_extension,
  count(*) FILTER (WHERE ext = '') AS without_extension FROM catalog WHERE NOT is_directory""")
def _(spark, sf):
    return agg.extension_totals(cat(spark, sf).rows)


@query("f26_match_counts", "SELECT drive, count(*) AS matches FROM catalog WHERE ext = 'dll' GROUP BY drive")
def _(spark, sf):
    return agg.match_counts(cat(spark, sf).search("*.dll"))


@query("f27_decayed_rate", """
SELECT event_type, count(*) AS events, round(sum(pow(0.5, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 86400000000.0))
  * 0.6931471805599453 / 86400, 9) AS rate FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def _(spark, sf):
    events = binding.table(spark, sf, "events")
    out = agg.decayed_rate(events, "event_type", "ts", datetime(2024, 1, 20), 86_400)
    return out.withColumn("rate", F.round("rate", 9))


@query("agg_export", terms_sql("type", 30, metrics=_B))
def _(spark, sf):
    from checks.base import out_path
    path = out_path(spark, "results")
    results = cat(spark, sf).preset("overview")
    sinks.export_results({"by_type": results["by_type"], "total_count": results["total_count"]}, path)
    schema = ("key string, count long, total_bytes long, waste_bytes long, share_count double, share_bytes double, "
              "other_count long, total_groups long")
    return rounded(spark.read.schema(schema).option("header", True).csv(f"{path}/by_type"))
