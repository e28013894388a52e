"""Sorting, limits and top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborlake.functions import derive
from arborlake.runtime import materialize
from arborlake.schema import find_field

DEFAULT_SORT = ["-modified"]


def parse_sort(spec: str | list[str]) -> list[tuple[str, bool]]:
    """[(field, descending)] of ``'size'``, ``'-size'``, ``'size:asc'``.

    A bare name sorts in the field's default direction; unknown and unsortable
    names are ignored.
    """
    out = []
    for token in (spec.split(",") if isinstance(spec, str) else spec):
        name, _, direction = token.strip().partition(":")
        negated = name.startswith("-")
        f = find_field(name.lstrip("-+"))
        if f is None or not f.sortable:
            continue
        descending = f.descending
        if negated:
            descending = True
        elif direction:
            descending = direction.lower().startswith("d")
        out.append((f.name, descending))
    return out


def sort_columns(df: DataFrame, spec: str | list[str]) -> list[Column]:
    """Order of a sort argument: folded text then raw text, name and ids last.

    The trailing ids make the order total, so a range partitioning can split any
    run of equal keys.
    """
    tiers = parse_sort(spec) or parse_sort(DEFAULT_SORT)
    columns: list[Column] = []

    def add(column: Column, descending: bool) -> None:
        columns.append(column.desc_nulls_last() if descending else column.asc_nulls_first())

    for name, descending in tiers:
        value = derive.field_column(df, name)
        if name in ("path", "name", "path_only", "extension", "type", "drive"):
            add(derive.fold(value), descending)
        add(value, descending)
    # The name tie follows the direction of a single flag tier, else ascends.
    first, first_desc = tiers[0]
    reverse = first_desc and len(tiers) == 1 and find_field(first).kind == "bool"
    add(derive.fold("name"), reverse)
    add(F.col("name"), reverse)
    add(F.col("drive"), False)
    add(F.col("frs"), False)
    return columns


def sort_by(df: DataFrame, spec: str | list[str]) -> DataFrame:
    return df.orderBy(*sort_columns(df, spec))


def top_n(df: DataFrame, spec: str | list[str], n: int) -> DataFrame:
    """First ``n`` rows of the order, as one bounded heap per task."""
    return sort_by(df, spec).limit(n)


def page(df: DataFrame, spec: str | list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset+limit of the order."""
    return page_by(df, sort_columns(df, spec), limit, offset)


def page_by(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset+limit of a total order.

    Without an offset that is a bounded top-n. Otherwise rows are range partitioned and counted
    per partition; only the partitions that hold the page are sorted and numbered, so nothing
    before it passes through a task.
    """
    if not offset:
        return df.orderBy(*order).limit(limit)
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "page")
    before, starts = 0, {}
    for row in ranged.groupBy("_part").count().orderBy("_part").collect():   # one row per partition
        if before < offset + limit and before + row["count"] > offset:
            starts[row["_part"]] = before
        before += row["count"]
    held = ranged.filter(F.col("_part").isin(*starts))
    known = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else F.lit(None).cast("map<int,int>")
    row = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + known[F.col("_part")]
    numbered = held.withColumn("_row", row).filter((F.col("_row") > offset) & (F.col("_row") <= offset + limit))
    return numbered.orderBy("_row").drop("_row", "_part")


def with_total(df: DataFrame, spec: str | list[str], limit: int) -> DataFrame:
    """Limited rows with the number of all matches and whether rows were cut."""
    total = df.agg(F.count("*")).scalar()
    return top_n(df, spec, limit).withColumns({
        "total_count": total, "truncated": total > F.lit(limit)})
