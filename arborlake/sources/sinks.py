"""Exports of rows and of aggregate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import derive
from arborlake.schema import ALL_COLUMNS, PARITY_COLUMNS, Field, field, find_field

# Separator names.
SEPARATORS = {"TAB": "\t", "NEWLINE": "\n", "NEW LINE": "\n", "SPACE": " ", "RETURN": "\r",
              "DOUBLE": '"', "SINGLE": "'", "NULL": "\0"}


def separator(name: str) -> str:
    return SEPARATORS.get(name.upper(), name)


def resolve_columns(columns: str | list[str] | None) -> list[str]:
    """Field names of a column list or preset; unknown ones dropped, each once."""
    if columns is None or (isinstance(columns, str) and columns.strip().lower() == "all"):
        return list(ALL_COLUMNS)
    if isinstance(columns, str) and columns.strip().lower() == "parity":
        return list(PARITY_COLUMNS)
    tokens = columns.split(",") if isinstance(columns, str) else columns
    found = [f.name for f in map(find_field, tokens) if f is not None]
    return list(dict.fromkeys(found)) or list(ALL_COLUMNS)


def project(df: DataFrame, columns: str | list[str] | None) -> DataFrame:
    """Select fields by name or alias, derived ones included."""
    return df.select(*[derive.field_column(df, n).alias(n) for n in resolve_columns(columns)])


def _display(df: DataFrame, f: Field, pos: str, neg: str, tz_offset: int, legacy: bool) -> Column:
    value = derive.field_column(df, f.name)
    folder = F.col("is_directory") if legacy else F.lit(False)
    closed = F.when(F.col("path").endswith("\\"), F.col("path")).otherwise(
        F.concat("path", F.lit("\\"))) if legacy else None
    if f.kind == "timestamp":
        return derive.display_time(value, tz_offset)
    if f.kind == "bool":
        return derive.display_flag(value, pos, neg)
    if f.name == "bulkiness":
        return F.call_function("div", value, F.lit(10_000))
    if legacy:
        if f.name in ("path", "path_only"):
            return F.when(folder, closed).otherwise(value)
        if f.name == "name":
            return F.when(folder, F.lit("")).otherwise(value)
        if f.name == "size":
            return F.when(folder, F.col("treesize")).otherwise(value)
        if f.name == "size_on_disk":
            return F.when(folder, F.col("tree_allocated")).otherwise(value)
    return value


def shown_columns(columns: str | list[str] | None, legacy: bool = False) -> list[str]:
    return resolve_columns("parity" if legacy and columns is None else columns)


def needs_tree(columns: str | list[str] | None = None, legacy: bool = False) -> bool:
    """Whether a listing shows subtree values; the legacy layout shows them as sizes."""
    names = shown_columns(columns, legacy)
    return any(field(n).needs == "tree" for n in names) or (legacy and not {"size", "size_on_disk"}.isdisjoint(names))


def listing(df: DataFrame, columns: str | list[str] | None = None, pos: str = "1", neg: str = "0",
            tz_offset: int = 0, legacy: bool = False) -> DataFrame:
    """Display form of the rows under display names.

    The legacy layout closes directory paths with a backslash, blanks their names
    and shows subtree sizes.
    """
    names = shown_columns(columns, legacy)
    return df.select(*[
        _display(df, field(n), pos, neg, tz_offset, legacy).alias(field(n).display) for n in names])


def export(df: DataFrame, path: str, fmt: str = "csv", columns: str | list[str] | None = None,
           sep: str = ",", quote: str = '"', header: bool = True, pos: str = "1", neg: str = "0",
           tz_offset: int = 0, legacy: bool = False, per_volume: bool = False,
           mode: str = "errorifexists", compression: str | None = None) -> None:
    """Write rows as CSV, TSV, JSON or Parquet files.

    Every task writes its own part; rows are neither sorted nor collected.
    ``per_volume`` writes one folder per drive. ``compression`` is one of Spark's for the format, or "none"; if it is
    not given, JSON, which names every column in every row, is gzipped, CSV is plain and Parquet as the session has it.
    """
    shown = listing(df, columns, pos, neg, tz_offset, legacy)
    if per_volume and "Drive" not in shown.columns:
        names = shown_columns(columns, legacy)
        shown = listing(df, [*names, "drive"], pos, neg, tz_offset, legacy)
    writer = shown.write.mode(mode)
    if fmt == "json" or compression:
        writer = writer.option("compression", compression or "gzip")
    if per_volume:
        writer = writer.partitionBy("Drive")
    if fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("csv", "tsv"):
        mark = "\t" if fmt == "tsv" else separator(sep)
        (writer.option("sep", mark).option("quote", quote).option("escape", quote)
         .option("header", header).option("emptyValue", "").csv(path))
    else:
        raise ValueError(f"unknown format: {fmt!r}")


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def export_results(results: dict[str, DataFrame], path: str, fmt: str = "csv",
                   mode: str = "errorifexists") -> None:
    """Write each labelled result to its own folder."""
    for label, df in results.items():
        target = f"{path.rstrip('/')}/{label}"
        if fmt == "json":
            df.write.mode(mode).json(target)
        else:
            (_flat(df).write.mode(mode).option("header", True)
             .option("sep", "\t" if fmt == "tsv" else ",").csv(target))
