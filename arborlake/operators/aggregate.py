"""Aggregations over a (filtered) catalog.  Every result is a DataFrame.

Grouped results carry one row per bucket with these metrics: count, total_bytes,
total_allocated, waste_bytes, waste_pct, avg_size, min_size, max_size,
share_count and share_bytes (percent of the scope).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborlake.functions import derive
from arborlake.operators import hierarchy as h
from arborlake.operators.hierarchy import Directories
from arborlake.operators.ordering import page_by
from arborlake.runtime import materialize
from arborlake.schema import FLAG_BITS, Field, field

METRICS = ("count", "total_bytes", "total_allocated", "waste_bytes", "waste_pct", "avg_size",
           "min_size", "max_size", "share_count", "share_bytes")
SCALARS = ("count", "sum", "min", "max", "avg", "value_count", "missing_count", "waste_bytes",
           "waste_pct")
MAX_SAMPLE = 5
SAMPLE_FIELDS = ("name", "size", "modified", "path", "type", "extension")
# Keys with a small fixed number of values; others may have one group per row.
_FEW_GROUPS = ("drive", "type")


# ---------------------------------------------------------------- metrics

def _partials() -> list[Column]:
    return [F.count("*").alias("count"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
            F.coalesce(F.sum("allocated_size"), F.lit(0)).alias("total_allocated"),
            F.coalesce(F.min("size"), F.lit(0)).alias("min_size"),
            F.coalesce(F.max("size"), F.lit(0)).alias("max_size")]


def _merged() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("count", "total_bytes", "total_allocated")] + [
        F.min("min_size").alias("min_size"), F.max("max_size").alias("max_size")]


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * 100)


def _with_metrics(grouped: DataFrame, metrics, total_count: Column, total_bytes: Column) -> DataFrame:
    """Derived metrics of grouped partial sums, and the choice of columns."""
    waste = F.greatest(F.col("total_allocated") - F.col("total_bytes"), F.lit(0))
    formulas = {
        "waste_bytes": waste,
        "waste_pct": _percent(waste, F.col("total_allocated")),
        "avg_size": F.when(F.col("count") == 0, F.lit(0.0)).otherwise(F.col("total_bytes") / F.col("count")),
        "share_count": _percent(F.col("count"), total_count),
        "share_bytes": _percent(F.col("total_bytes"), total_bytes),
    }
    wanted = _check_metrics(metrics)
    keys = [c for c in grouped.columns if c not in METRICS]
    return grouped.select(*keys, *[
        formulas[m].alias(m) if m in formulas else F.col(m) for m in wanted])


def _check_metrics(metrics) -> tuple[str, ...]:
    wanted = METRICS if metrics is None else tuple(dict.fromkeys(("count", *metrics)))
    unknown = [m for m in wanted if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    return wanted


def _group_totals(grouped: DataFrame, metrics) -> tuple[Column, Column, Column]:
    """Rows, bytes and number of groups of a grouped table, as one scalar subquery.

    It sums exactly the partial columns the bucket rows use, so both sides ask for
    the same grouping and its exchange is computed once.
    """
    wanted = set(_check_metrics(metrics))
    use_bytes = wanted & {"total_bytes", "waste_bytes", "waste_pct", "avg_size", "share_bytes"}
    parts = {"n": F.sum("count"), "g": F.count("*")}
    if use_bytes:
        parts["b"] = F.sum("total_bytes")
    if wanted & {"total_allocated", "waste_bytes", "waste_pct"}:
        parts["a"] = F.sum("total_allocated")
    if "min_size" in wanted:
        parts["lo"] = F.min("min_size")
    if "max_size" in wanted:
        parts["hi"] = F.max("max_size")
    whole = grouped.agg(F.struct(*[c.alias(k) for k, c in parts.items()]).alias("t")).scalar()
    zero = F.lit(0).cast("bigint")
    return F.coalesce(whole["n"], zero), F.coalesce(whole["b"], zero) if use_bytes else zero, whole["g"]


def _scope_totals(df: DataFrame, metrics) -> tuple[Column, Column]:
    """Count and bytes of the whole scope as scalar subqueries, when shares ask for them."""
    wanted = _check_metrics(metrics)
    count = df.agg(F.count("*")).scalar() if "share_count" in wanted else F.lit(1)
    size = df.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar() if "share_bytes" in wanted else F.lit(1)
    return count, size


def _capable(name: str, what: str) -> Field:
    f = field(name)
    ok = {"group": f.groupable, "aggregate": f.aggregatable, "bucket": f.aggregatable}[what]
    if not ok:
        raise ValueError(f"field {f.name!r} does not support {what}")
    return f


# ---------------------------------------------------------------- scalars

def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def stats_columns(df: DataFrame, name: str, metrics=None, prefix: str = "") -> list[Column]:
    """Aggregate columns of one field, to be combined with others in one pass."""
    f = _capable(name, "aggregate")
    value = derive.field_column(df, f.name)
    if f.kind == "timestamp":
        forms = {"count": F.count("*"), "min": F.min(value), "max": F.max(value),
                 "value_count": F.count_if(value.isNotNull()),
                 "missing_count": F.count_if(value.isNull())}
    else:
        total = F.coalesce(F.sum(value), F.lit(0))
        allocated = F.coalesce(F.sum("allocated_size"), F.lit(0))
        waste = F.greatest(allocated - total, F.lit(0))
        forms = {
            "count": F.count("*"), "sum": total,
            "min": F.coalesce(F.min(value), F.lit(0)), "max": F.coalesce(F.max(value), F.lit(0)),
            "avg": F.coalesce(F.avg(value), F.lit(0.0)),
            "value_count": F.count_if(value != 0),
            "missing_count": F.count_if(value.isNull() | (value == 0)),
            "waste_bytes": waste, "waste_pct": _percent(waste, allocated)}
    wanted = metrics or [m for m in SCALARS if m in forms]
    return [forms[m].alias(prefix + m) for m in wanted]


def stats(df: DataFrame, name: str, metrics=None) -> DataFrame:
    """count, sum, min, max, avg, presence and waste of one field; empty input gives 0."""
    return df.agg(*stats_columns(df, name, metrics))


def missing_column(df: DataFrame, name: str) -> Column:
    f = field(name)
    value = derive.field_column(df, f.name)
    empty = value.isNull()
    if f.kind == "numeric":
        empty = empty | (value == 0)
    elif f.kind in ("string", "enum"):
        empty = empty | (value == "")
    return F.count_if(empty)


def missing(df: DataFrame, name: str) -> DataFrame:
    """Rows without a value: NULL, 0 or ''."""
    return df.agg(missing_column(df, name).alias("missing"))


def distinct(df: DataFrame, name: str, approx: bool = False) -> DataFrame:
    """Number of different values; exact unless ``approx``."""
    value = derive.field_column(df, name)
    how = F.approx_count_distinct(value) if approx else F.count_distinct(value)
    return df.agg(how.alias("distinct"))


def combined(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Several global results from one pass over the rows."""
    return df.agg(*[c.alias(label) for label, c in columns.items()])


# ---------------------------------------------------------------- terms

def group_key(df: DataFrame, name: str) -> Column:
    """Text key of a groupable field."""
    f = _capable(name, "group")
    value = derive.field_column(df, f.name)
    if f.name == "drive":
        return F.concat(value, F.lit(":"))
    if f.name == "directory_flag":
        return F.when(value, F.lit("directory")).otherwise(F.lit("file"))
    if f.kind == "bool":
        return F.when(value, F.lit("true")).otherwise(F.lit("false"))
    return F.coalesce(value, F.lit(""))


def terms(df: DataFrame, name: str, top: int | None = None, metrics=None, sample: int = 0,
          sample_sort: str = "size", sample_desc: bool = True, sample_fields=SAMPLE_FIELDS,
          prefix: str | None = None, dirs: Directories | None = None) -> DataFrame:
    """Buckets of a field, most rows first, with ``other_count`` and ``total_groups``.

    ``prefix`` keeps only keys that start with it, before the top-n.  ``sample``
    adds an array of representative rows to each surviving bucket.
    """
    keyed = df.withColumn("key", group_key(df, name))
    if prefix:
        keyed = keyed.filter(F.lower("key").startswith(prefix.lower()))
    out = top_terms(keyed.groupBy("key").agg(*_partials()), name, top, metrics)
    if not sample:
        return out
    hits = top_hits(keyed, out.select("key"), ["key"], sample, sample_sort, sample_desc,
                    sample_fields, dirs)
    return out.join(hits, "key", "left")


def top_terms(grouped: DataFrame, name: str, top: int | None, metrics) -> DataFrame:
    """The buckets with most rows of a table of partial metrics per ``key``."""
    f = _capable(name, "group")
    top = f.default_top if top is None else top
    order = [F.col("count").desc(), F.col("key").asc()]
    if f.kind == "bool" or f.name in _FEW_GROUPS:
        # At most a few dozen groups: one window over the grouped table.
        whole = W.partitionBy()
        sized = grouped.withColumns({
            "_n": F.sum("count").over(whole), "_b": F.sum("total_bytes").over(whole),
            "_g": F.count("*").over(whole)})
        totals = F.col("_n"), F.col("_b"), F.col("_g")
    else:
        sized = grouped
        totals = _group_totals(grouped, metrics)
    first = sized.orderBy(*order).limit(top)
    kept = W.partitionBy()
    rows = first.withColumns({
        "other_count": totals[0] - F.sum("count").over(kept), "total_groups": totals[2]})
    # The window above runs over the limited rows only.
    out = _with_metrics(rows, metrics, totals[0], totals[1])
    return out.select("key", *_check_metrics(metrics), "other_count", "total_groups")


def flag_facets(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(flag, key, count, total_bytes) of many attribute flags in one pass.

    Rows are counted per distinct attribute mask first; only those few masks are
    split into flags.
    """
    wanted = names or list(FLAG_BITS)
    masks = df.groupBy("flags").agg(F.count("*").alias("count"), F.sum("size").alias("total_bytes"))
    entries = [F.struct(F.lit(n).alias("flag"), F.when(derive.has_flag("flags", n), F.lit("true"))
                        .otherwise(F.lit("false")).alias("key")) for n in wanted]
    split = masks.select("count", "total_bytes", F.explode(F.array(*entries)).alias("e"))
    return split.groupBy("e.flag", "e.key").agg(
        F.sum("count").alias("count"), F.sum("total_bytes").alias("total_bytes"))


def top_hits(keyed: DataFrame, surviving: DataFrame, keys: list[str], n: int = 2,
             sort: str = "size", descending: bool = True, fields=SAMPLE_FIELDS,
             dirs: Directories | None = None) -> DataFrame:
    """Up to ``n`` (at most 5) rows per surviving bucket as an array of structs.

    The row limit runs before the exchange as well as after it, so a bucket with
    a third of all rows still sends only ``n`` rows per task.
    """
    order = _sample_order(keyed, n, sort, descending)
    return _samples(_best(keyed.join(surviving, keys, "left_semi"), keys, n, order), keys, fields, dirs)


def _sample_order(df: DataFrame, n: int, sort: str, descending: bool) -> list[Column]:
    f = field(sort)
    if not f.sortable:
        raise ValueError(f"cannot sort samples by {f.name!r}")
    if not 1 <= n <= MAX_SAMPLE:
        raise ValueError(f"sample must be 1..{MAX_SAMPLE}")
    value = derive.field_column(df, f.name)
    return [value.desc_nulls_last() if descending else value.asc_nulls_first(), F.col("drive"), F.col("frs")]


def _best(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each bucket with their ``rank``; the limit runs before the exchange and after it."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def _samples(picked: DataFrame, keys: list[str], fields, dirs: Directories | None) -> DataFrame:
    """Ranked rows as one array per bucket."""
    if dirs is not None and any(field(x).needs == "path" for x in fields):
        # Written, so that only the parents of these rows are taken from the directory table, by a broadcast if they are few.
        picked = materialize(picked, "picked")
        parents = picked.select("drive", h._parent_key().alias("frs")).distinct()
        picked = h.with_paths(picked, Directories(dirs.table.join(parents, h.KEY, "left_semi")))
    shown = [x for x in fields if field(x).needs != "path" or "path" in picked.columns]
    entry = F.struct("rank", *[derive.field_column(picked, x).alias(field(x).name) for x in shown])
    return picked.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("samples"))


def drilldown(buckets: DataFrame, name: str, scope: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Add the predicates that select the rows of each bucket: those of the scope, then the key.

    They are what :func:`filters.where_all` takes.
    """
    def entry(field_name, op, value: Column) -> Column:
        return F.struct(F.lit(field_name).alias("field"), F.lit(op).alias("op"),
                        value.cast("string").alias("value"))

    f = field(name)
    key = F.col("key")
    if f.name == "drive":
        key = F.rtrim(key, F.lit(":"))
    elif f.kind == "bool":
        key = key.isin("true", "directory")
    return buckets.withColumn("drilldown", F.array(*[entry(n, op, F.lit(str(v))) for n, op, v in scope], entry(f.name, "eq", key)))


def drilldown_range(buckets: DataFrame, name: str, low: Column, high: Column,
                    scope: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Add the predicates of buckets from ``low`` (included) to ``high`` (excluded); a NULL bound is open."""
    def entry(field_name, op, value: Column) -> Column:
        return F.struct(F.lit(field_name).alias("field"), F.lit(op).alias("op"), value.cast("string").alias("value"))

    f = field(name)
    every = F.array(*[entry(n, op, F.lit(str(v))) for n, op, v in scope], entry(f.name, "gte", low), entry(f.name, "lt", high))
    return buckets.withColumn("drilldown", F.filter(every, lambda e: e["value"].isNotNull()))


def drilldown_histogram(buckets: DataFrame, name: str, interval: int, scope=()) -> DataFrame:
    """Predicates of fixed-width buckets."""
    return drilldown_range(buckets, name, F.col("key"), F.col("key") + interval, scope)


def drilldown_named_range(buckets: DataFrame, name: str, boundaries: list[int], scope=()) -> DataFrame:
    """Predicates of the buckets of ``range_``, open at both ends."""
    bounds = sorted(boundaries)
    low = reduce(lambda chain, b: chain.when(F.col("key").startswith(f"{b} - ") | (F.col("key") == f">= {b}"), F.lit(b)),
                 bounds, F.when(F.lit(False), F.lit(0)))
    high = reduce(lambda chain, b: chain.when(F.col("key").endswith(f" - {b}") | (F.col("key") == f"< {b}"), F.lit(b)),
                  bounds, F.when(F.lit(False), F.lit(0)))
    return drilldown_range(buckets, name, low, high, scope)


def drilldown_date(buckets: DataFrame, name: str, calendar: str = "month", scope=()) -> DataFrame:
    """Predicates of calendar buckets: from the bucket's start to the next one's; unset times are those without a value."""
    start = F.to_timestamp_ntz(F.rpad(F.when(F.col("key") != "", F.col("key")), 16, " 00:00").substr(1, 16), F.lit("yyyy-MM-dd HH:mm"))
    step = {"hour": F.make_dt_interval(hours=F.lit(1)), "day": F.make_dt_interval(days=F.lit(1)), "week": F.make_dt_interval(days=F.lit(7)),
            "month": F.make_ym_interval(months=F.lit(1)), "quarter": F.make_ym_interval(months=F.lit(3)), "year": F.make_ym_interval(years=F.lit(1))}
    text = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return drilldown_range(buckets, name, text(start), text(start + step[calendar]), scope)


def key_predicate(name: str, key: str) -> tuple[str, str, object]:
    """Predicate of one bucket key, for :func:`filters.where_all`."""
    f = field(name)
    if f.name == "drive":
        return f.name, "eq", key.rstrip(":")
    if f.kind == "bool":
        return f.name, "eq", key in ("true", "directory")
    return f.name, "eq", key


def facet_values(df: DataFrame, name: str, prefix: str | None = None, top: int | None = None) -> DataFrame:
    """Values of a field with counts; the prefix filter acts before the top-n."""
    return terms(df, name, top, ("total_bytes",), prefix=prefix)


def page(buckets: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of a bucket table with its ``total`` and ``next_offset`` (-1 at the end)."""
    total = buckets.agg(F.count("*")).scalar()
    following = F.when(total > offset + size, F.lit(offset + size)).otherwise(F.lit(-1))
    return page_by(buckets, order, size, offset).withColumns({
        "total": total, "next_offset": following})


# ---------------------------------------------------------------- ranges

def histogram(df: DataFrame, name: str, interval: int, metrics=None) -> DataFrame:
    """Fixed-width buckets keyed by their lower bound."""
    f = _capable(name, "bucket")
    value = derive.field_column(df, f.name)
    low = F.call_function("div", value, F.lit(interval)) * F.lit(interval)
    grouped = df.withColumn("key", low).groupBy("key").agg(*_partials())
    return _with_metrics(grouped, metrics, *_group_totals(grouped, metrics)[:2])


def range_key(value: Column, boundaries: list[int]) -> Column:
    chain = F.when(value < F.lit(boundaries[0]), F.lit(f"< {boundaries[0]}"))
    for low, high in zip(boundaries, boundaries[1:]):
        chain = chain.when(value < F.lit(high), F.lit(f"{low} - {high}"))
    return chain.when(value.isNotNull(), F.lit(f">= {boundaries[-1]}"))


def range_(df: DataFrame, name: str, boundaries: list[int], metrics=None) -> DataFrame:
    """Half-open buckets between ascending bounds, open at both ends; no empty ones."""
    f = _capable(name, "bucket")
    value = derive.field_column(df, f.name)
    grouped = df.withColumn("key", range_key(value, sorted(boundaries))).groupBy("key").agg(*_partials())
    return _with_metrics(grouped, metrics, *_group_totals(grouped, metrics)[:2])


_FIXED_DAYS = {"hour": None, "day": 1, "week": 7, "month": 30, "quarter": 90, "year": 365}
_DAYS_1601_TO_1970 = 134_774


def date_key(ts: Column, calendar: str, mode: str = "calendar") -> Column:
    """ISO text of the bucket start; '' for unset times.

    ``mode="fixed_days"`` counts steps of 30, 90 or 365 days from 1601.
    """
    if calendar not in _FIXED_DAYS:
        raise ValueError(f"unknown calendar interval: {calendar!r}")
    days = _FIXED_DAYS[calendar]
    if mode == "fixed_days" and days:
        number = F.unix_date(ts.cast("date")) + F.lit(_DAYS_1601_TO_1970)
        start = number - number % days - F.lit(_DAYS_1601_TO_1970)
        text = F.date_format(F.date_from_unix_date(start), "yyyy-MM-dd")
    else:
        pattern = "yyyy-MM-dd HH:00" if calendar == "hour" else "yyyy-MM-dd"
        text = F.date_format(F.date_trunc(calendar, ts), pattern)
    return F.coalesce(text, F.lit(""))


def date_histogram(df: DataFrame, name: str, calendar: str = "month", metrics=None,
                   mode: str = "calendar") -> DataFrame:
    """Time buckets of hour, day, week (from Monday), month, quarter or year."""
    f = _capable(name, "bucket")
    if f.kind != "timestamp":
        raise ValueError(f"field {f.name!r} is not a time")
    key = date_key(derive.field_column(df, f.name), calendar, mode)
    grouped = df.withColumn("key", key).groupBy("key").agg(*_partials())
    return _with_metrics(grouped, metrics, *_group_totals(grouped, metrics)[:2])


# ---------------------------------------------------------------- rollups

def _ranked(buckets: DataFrame, top: int | None) -> DataFrame:
    ordered = buckets.orderBy(F.col("total_bytes").desc(), F.col("key").asc())
    return ordered.limit(top) if top else ordered


def rollup_drive(df: DataFrame, top: int | None = None, metrics=None) -> DataFrame:
    """Totals per volume, most bytes first."""
    grouped = df.groupBy(F.concat("drive", F.lit(":")).alias("key")).agg(*_partials())
    return _ranked(_with_metrics(grouped, metrics, *_group_totals(grouped, metrics)[:2]), top)


def _placed(dirs: Directories, bucket: Column, own: Column) -> tuple[DataFrame, DataFrame]:
    """Directories whose rows share a bucket (``key``), and those whose rows are buckets of their own."""
    placed = dirs.table.select("drive", F.col("frs").alias("parent_frs"), bucket.alias("key"),
                               own.alias("own"), F.col("path").alias("p_path"))
    # Written: where these are few, as near the root, the planner sees it and no row is exchanged to meet them.
    single = materialize(placed.filter("own").select("drive", "parent_frs", "p_path"), "own")
    return placed.filter(F.col("key").isNotNull()).select("drive", "parent_frs", "key"), single


def _own_path() -> Column:
    return h._path_expr(F.coalesce("name", F.lit("")))


def _subtree_groups(df: DataFrame, dirs: Directories, bucket: Column, own: Column,
                    extra: dict[str, Column]) -> DataFrame:
    """Partial metrics per bucket path (and extra keys).

    ``bucket`` is the bucket of everything under a directory, or NULL; where
    ``own`` holds, rows directly inside are buckets of their own.  Rows are summed
    per directory before they meet the directory table; only rows that are their
    own bucket are joined one by one.
    """
    rows = df.withColumns(extra) if extra else df
    shared, single = _placed(dirs, bucket, own)
    per_dir = rows.groupBy("drive", "parent_frs", *extra).agg(*_partials())
    inner = per_dir.join(shared, ["drive", "parent_frs"]).select("key", *extra, *METRICS[:3], "min_size", "max_size")
    own_rows = (dirs.join_parent(rows, single, "inner").withColumn("key", _own_path())
                .groupBy("key", *extra).agg(*_partials()))
    return inner.unionByName(own_rows.select(*inner.columns)).groupBy("key", *extra).agg(*_merged())


def _subtree_samples(df: DataFrame, dirs: Directories, bucket: Column, own: Column, extra: dict[str, Column],
                     surviving: DataFrame, sample: int, sort: str, descending: bool, fields) -> DataFrame:
    """Up to ``sample`` rows per surviving bucket: the best of each directory first, then the best of those.

    The best rows of a union are among the best of its parts, so no more than ``sample`` rows of a
    directory meet the directory table, and no more of a bucket leave a task.
    """
    rows = df.withColumns(extra) if extra else df
    order = _sample_order(rows, sample, sort, descending)
    shared, single = _placed(dirs, bucket, own)
    columns = list(rows.columns)
    per_dir = _best(rows, ["drive", "parent_frs", *extra], sample, order).select(*columns)
    inner = per_dir.join(shared, ["drive", "parent_frs"]).select(*columns, "key")
    own_rows = dirs.join_parent(rows, single, "inner").withColumn("key", _own_path()).select(*columns, "key")
    keys = ["key", *extra]
    both = inner.unionByName(own_rows).join(surviving.select(*keys), keys, "left_semi")
    return _samples(_best(both, keys, sample, _sample_order(both, sample, sort, descending)), keys, fields, dirs)


def _rollup(df, dirs, bucket, own, top, metrics, sub, sub_top, sample=0, sample_sort="size", sample_desc=True,
            sample_fields=SAMPLE_FIELDS) -> DataFrame:
    totals = _scope_totals(df, metrics)
    extra = {"sub_key": group_key(df, sub)} if sub else {}
    groups = _subtree_groups(df, dirs, bucket, own, extra)
    if not sub:
        out = _ranked(_with_metrics(groups, metrics, *totals), top)
    else:
        outer = _ranked(groups.groupBy("key").agg(F.sum("total_bytes").alias("total_bytes")), top)
        order = W.partitionBy("key").orderBy(F.col("count").desc(), F.col("sub_key"))
        inside = groups.join(outer.select("key"), "key", "left_semi")
        ranked = (_with_metrics(inside, metrics, *totals)
                  .withColumn("sub_rank", F.row_number().over(order)))
        out = ranked.filter(F.col("sub_rank") <= sub_top) if sub_top else ranked
    if not sample:
        return out
    hits = _subtree_samples(df, dirs, bucket, own, extra, out, sample, sample_sort, sample_desc, sample_fields)
    return out.join(hits, ["key", *extra], "left")


def rollup_path(df: DataFrame, dirs: Directories, depth: int = 1, top: int | None = None,
                metrics=None, sub: str | None = None, sub_top: int | None = None, **samples) -> DataFrame:
    """Totals per ancestor ``depth`` levels under the root, most bytes first.

    Rows that are not that deep are their own bucket.  With ``sub`` each bucket is
    split by a second field, ranked inside it.  ``sample`` (with ``sample_sort``, ``sample_desc``, ``sample_fields``)
    adds representative rows to each bucket that is returned.
    """
    deep = F.col("depth") > depth
    bucket = F.when(deep, h.path_at_depth(F.col("path"), depth))
    return _rollup(df, dirs, bucket, ~deep, top, metrics, sub, sub_top, **samples)


def rollup_ancestor(df: DataFrame, dirs: Directories, drive: str, ancestor: int,
                    top: int | None = None, metrics=None, sub: str | None = None,
                    sub_top: int | None = None, outside: str = "own", **samples) -> DataFrame:
    """Totals per direct child of one directory.

    Rows not below it are their own buckets, or left out with ``outside="drop"``. Samples as in ``rollup_path``.
    """
    at = F.when(F.col("drive") == drive, F.array_position("chain", F.lit(ancestor).cast("bigint"))).otherwise(0)
    below = (at > 0) & (F.col("depth") > at)
    level = at.cast("int") + F.when(F.col("state") == h.OK, 1).otherwise(2)
    bucket = F.when(below, _leading(F.col("path"), level))
    inside = (at > 0) & ~below
    own = inside if outside == "drop" else ~below
    return _rollup(df, dirs, bucket, own, top, metrics, sub, sub_top, **samples)


def _leading(path: Column, parts: Column) -> Column:
    """First ``parts`` backslash-separated parts of a path."""
    return F.array_join(F.slice(F.split(path, r"\\"), 1, parts), "\\")


# ---------------------------------------------------------------- volumes

def volume_stats(df: DataFrame) -> DataFrame:
    """Counters and byte sums per volume in one pass."""
    is_dir = F.col("is_directory")
    reserved = (F.col("frs") <= 15) & (F.col("frs") != 5)
    parent_reserved = (F.col("parent_frs") <= 15) & (F.col("parent_frs") != 5)
    size = F.col("size")

    def bytes_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, size)), F.lit(0))

    streams = F.count_if(F.col("stream_count") > 1) if "stream_count" in df.columns else F.lit(0).cast("bigint")
    columns = {
        "record_count": F.count("*"), "dir_count": F.count_if(is_dir), "file_count": F.count_if(~is_dir),
        "max_frs": F.max("frs"), "total_name_bytes": F.sum(F.octet_length("name")),
        "multi_name_count": F.count_if(F.col("link_count") > 1), "ads_count": streams,
        "system_metafile_count": F.count_if(reserved), "system_child_count": F.count_if(parent_reserved),
        "total_bytes": F.sum(size), "dir_bytes": bytes_where(is_dir),
        **{f"{flag}_bytes": bytes_where(derive.has_flag("flags", flag)) for flag in (
            "hidden", "system", "compressed", "encrypted", "sparse", "reparse")},
    }
    bucket = derive.size_bucket8("size")
    for i in range(8):
        in_bucket = ~is_dir & (bucket == i)
        columns[f"bucket{i}_count"] = F.count_if(in_bucket)
        columns[f"bucket{i}_bytes"] = bytes_where(in_bucket)
    return df.groupBy("drive").agg(*[c.alias(n) for n, c in columns.items()])


def extension_stats(df: DataFrame) -> DataFrame:
    """Files and bytes per extension."""
    files = df.filter(~F.col("is_directory")).withColumn("key", derive.field_column(df, "extension"))
    return files.groupBy(F.col("key").alias("ext")).agg(
        F.count("*").alias("files"), F.sum("size").alias("total_bytes"))


def extension_totals(df: DataFrame) -> DataFrame:
    """Number of extensions, files with and without one."""
    per_ext = extension_stats(df)
    named = F.col("ext") != ""
    return per_ext.agg(
        F.count_if(named).alias("unique_extensions"),
        F.coalesce(F.sum(F.when(named, F.col("files"))), F.lit(0)).alias("with_extension"),
        F.coalesce(F.sum(F.when(~named, F.col("files"))), F.lit(0)).alias("without_extension"))


def match_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("drive").agg(F.count("*").alias("matches"))


def decayed_rate(events: DataFrame, key: str, ts: str, as_of: Column | str,
                 half_life_seconds: int = 60) -> DataFrame:
    """Time-decayed events per second and key: each event weighs 0.5^(age/half-life).

    A steady stream of R events per second gives R.
    """
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    age = (derive.micros(moment) - derive.micros(F.col(ts))) / F.lit(1e6)
    past = events.filter(F.col(ts) <= moment)
    weight = F.pow(F.lit(0.5), age / F.lit(float(half_life_seconds)))
    scale = 0.6931471805599453 / half_life_seconds
    return past.groupBy(key).agg(F.count("*").alias("events"), (F.sum(weight) * F.lit(scale)).alias("rate"))
