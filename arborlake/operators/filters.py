"""Metadata filters: a parameter record turned into Column conditions.

Conditions on stored columns come first and reach the Parquet scan; those on
paths or subtree values need the extra column and are applied after its join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import arguments as args, derive, patterns
from arborlake.functions.categories import expand_extensions, type_extensions
from arborlake.operators.hierarchy import Directories, with_malformed_path, with_paths
from arborlake.schema import LAST_RESERVED_FRS, ROOT_FRS, field

FILES, DIRS, ALL = "files", "dirs", "all"


@dataclass(frozen=True)
class Filters:
    """Search filters; every one is off by default and all must hold."""

    mode: str = ALL
    drives: tuple[str, ...] | list[str] | None = None
    hide_system: bool = False
    hide_ads: bool = False
    exclude_hidden: bool = False
    exclude_system: bool = False
    min_size: int | str | None = None
    max_size: int | str | None = None
    exact_size: int | str | None = None
    min_allocated: int | str | None = None
    max_allocated: int | str | None = None
    exact_allocated: int | str | None = None
    min_descendants: int | None = None
    max_descendants: int | None = None
    exact_descendants: int | None = None
    min_treesize: int | str | None = None
    max_treesize: int | str | None = None
    min_tree_allocated: int | str | None = None
    max_tree_allocated: int | str | None = None
    min_bulkiness: int | None = None        # percent
    max_bulkiness: int | None = None
    newer: str | datetime | None = None
    older: str | datetime | None = None
    newer_created: str | datetime | None = None
    older_created: str | datetime | None = None
    newer_accessed: str | datetime | None = None
    older_accessed: str | datetime | None = None
    between: str | None = None              # "start,end" on modified
    months: str | list[int] | None = None
    attributes: str | None = None           # "hidden,!system", presets
    ext: str | list[str] | None = None
    type: str | None = None
    exclude: str | list[str] | None = None  # name globs or substrings
    path_contains: str | None = None
    path_excludes: str | list[str] | None = None
    min_name_length: int | None = None
    max_name_length: int | None = None
    min_path_length: int | None = None
    max_path_length: int | None = None
    malformed: bool | None = None
    malformed_path: bool | None = None

    @property
    def needs_path(self) -> bool:
        return any(v is not None for v in (
            self.path_contains, self.path_excludes, self.min_path_length, self.max_path_length))

    @property
    def needs_tree(self) -> bool:
        return any(v is not None for v in (
            self.min_descendants, self.max_descendants, self.exact_descendants, self.min_treesize,
            self.max_treesize, self.min_tree_allocated, self.max_tree_allocated))


def bounds(column: Column, low, high, exact=None) -> list[Column]:
    """Inclusive bounds; an exact value replaces both."""
    low, high = (low, high) if exact is None else (exact, exact)
    out = [] if low is None else [column >= F.lit(args.size_bytes(low))]
    return out if high is None else out + [column <= F.lit(args.size_bytes(high))]


def window(column: Column, newer, older, as_of: datetime) -> list[Column]:
    """Lower bound inclusive, upper bound exclusive."""
    out = []
    if newer is not None:
        out.append(column >= F.lit(args.time_bound(newer, as_of, True)).cast("timestamp_ntz"))
    if older is not None:
        out.append(column < F.lit(args.time_bound(older, as_of, False)).cast("timestamp_ntz"))
    return out


def files_only() -> Column:
    return ~F.col("is_directory")


def hide_system_files() -> Column:
    return ~derive.is_metafile("name")


def hide_metadata_records() -> Column:
    return (F.col("frs") > LAST_RESERVED_FRS) | (F.col("frs") == ROOT_FRS)


def attributes(spec: str) -> list[Column]:
    required, excluded = args.attribute_masks(spec)
    flags = F.col("flags")
    out = [flags.bitwiseAND(F.lit(required)) == required] if required else []
    return out + ([flags.bitwiseAND(F.lit(excluded)) == 0] if excluded else [])


def extension_and_type(df: DataFrame, ext, category: str | None) -> list[Column]:
    """An extension list and a category together mean their intersection."""
    extension = derive.field_column(df, "extension")
    wanted = expand_extensions(ext) if ext is not None else None
    if category is None:
        return [extension.isin(*wanted)] if wanted else []
    members = type_extensions(category)
    if members is None:
        row_type = derive.semantic_type(extension, "is_directory") == category.lower()
        return ([extension.isin(*wanted)] if wanted else []) + [row_type]
    chosen = [e for e in wanted if e in members] if wanted else list(members)
    return [extension.isin(*chosen)] if chosen else [F.lit(False)]


def _listed(spec) -> list[str]:
    tokens = spec.split(",") if isinstance(spec, str) else spec
    return [t.strip() for t in tokens if t.strip()]


def directory_matches(directory: Column, pattern: str) -> Column:
    """Glob or substring on the folded directory part, '/' taken as a backslash."""
    text = "\\".join(pattern.replace("/", "\\").split("\\"))
    while "\\\\" in text:
        text = text.replace("\\\\", "\\")
    return patterns.text_matches(derive.fold(directory), text.upper())


def stored_conditions(df: DataFrame, f: Filters, as_of: datetime) -> list[Column]:
    """Conditions that need only stored columns."""
    c: list[Column] = []
    if f.drives:
        c.append(F.col("drive").isin(*[d.upper().rstrip(":\\") for d in f.drives]))
    if f.mode != ALL:
        c.append(files_only() if f.mode == FILES else F.col("is_directory"))
    if f.hide_system:
        c.append(hide_system_files())
    if f.hide_ads:
        c.append(~derive.is_ads("name"))
    if f.exclude_hidden:
        c.append(~derive.has_flag("flags", "hidden"))
    if f.exclude_system:
        c.append(~derive.has_flag("flags", "system"))
    c += bounds(F.col("size"), f.min_size, f.max_size, f.exact_size)
    c += bounds(F.col("allocated_size"), f.min_allocated, f.max_allocated, f.exact_allocated)
    newer, older = f.newer, f.older
    if f.between is not None:
        start, _, end = f.between.partition(",")
        newer, older = newer or start or None, older or end or None
    c += window(F.col("modified"), newer, older, as_of)
    c += window(F.col("created"), f.newer_created, f.older_created, as_of)
    c += window(F.col("accessed"), f.newer_accessed, f.older_accessed, as_of)
    if f.months is not None:
        c.append(derive.month_of("modified").isin(*args.months(f.months)))
    if f.attributes:
        c += attributes(f.attributes)
    c += extension_and_type(df, f.ext, f.type)
    if f.exclude is not None:
        c += [~patterns.text_matches(derive.fold("name"), p.upper()) for p in _listed(f.exclude)]
    c += bounds(derive.name_length("name"), f.min_name_length, f.max_name_length)
    if f.malformed is not None:
        bad = derive.is_malformed("name_bytes")
        c.append(bad if f.malformed else ~bad)
    return c


def tree_conditions(f: Filters) -> list[Column]:
    return (bounds(F.col("descendants"), f.min_descendants, f.max_descendants, f.exact_descendants)
            + bounds(F.col("treesize"), f.min_treesize, f.max_treesize)
            + bounds(F.col("tree_allocated"), f.min_tree_allocated, f.max_tree_allocated))


def bulkiness_conditions(df: DataFrame, f: Filters) -> list[Column]:
    def scaled(percent):
        return None if percent is None else percent * 10_000

    if f.min_bulkiness is None and f.max_bulkiness is None:
        return []
    return bounds(derive.field_column(df, "bulkiness"), scaled(f.min_bulkiness), scaled(f.max_bulkiness))


def path_conditions(f: Filters) -> list[Column]:
    c: list[Column] = []
    directory = derive.path_only("path")
    if f.path_contains is not None:
        c.append(directory_matches(directory, f.path_contains))
    if f.path_excludes is not None:
        c += [~directory_matches(directory, p) for p in _listed(f.path_excludes)]
    return c + bounds(derive.path_length("path"), f.min_path_length, f.max_path_length)


def apply(df: DataFrame, f: Filters, as_of: datetime, dirs: Directories | None = None) -> DataFrame:
    """Rows of ``df`` that pass every filter.

    Subtree filters read the tree columns of ``df``; path filters join ``dirs``
    after all other filters have thinned the rows.
    """
    if f.needs_tree and "descendants" not in df.columns:
        raise ValueError("subtree filters need the tree columns, see with_tree_metrics")
    out = df.filter(derive.all_of(
        stored_conditions(df, f, as_of) + tree_conditions(f) + bulkiness_conditions(df, f)))
    if f.needs_path:
        if "path" not in out.columns:
            out = with_paths(out, _need(dirs))
        out = out.filter(derive.all_of(path_conditions(f)))
    if f.malformed_path is not None:
        flagged = with_malformed_path(out, _need(dirs))
        out = flagged.filter(F.col("malformed_path") == f.malformed_path).drop("malformed_path")
    return out


def _need(dirs: Directories | None) -> Directories:
    if dirs is None:
        raise ValueError("this filter needs the directory table, see build_directories")
    return dirs


def time_after(column: str, ts: datetime) -> Column:
    """Strict bounds of the frame interface."""
    return F.col(column) > F.lit(ts).cast("timestamp_ntz")


def time_before(column: str, ts: datetime) -> Column:
    return F.col(column) < F.lit(ts).cast("timestamp_ntz")


# ---------------------------------------------------------------- predicate lists

_COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
}


def _string_predicate(column: Column, op: str, value) -> Column:
    subject = derive.fold(column)
    values = [v.upper() for v in ([value] if isinstance(value, str) else value)]
    single = values[0]
    match op:
        case "eq":
            return subject == single
        case "ne":
            return subject != single
        case "in":
            return subject.isin(*values)
        case "not_in":
            return ~subject.isin(*values)
        case "match":
            return patterns.glob(subject, single)
        case "not_match":
            return ~patterns.glob(subject, single)
        case "contains":
            return subject.contains(single)
        case "starts_with":
            return subject.startswith(single)
        case "ends_with":
            return subject.endswith(single)
        case "has_all":
            return derive.all_of([subject.contains(v) for v in values])
        case "has_any":
            return derive.any_of([subject.contains(v) for v in values])
        case "has_none":
            return ~derive.any_of([subject.contains(v) for v in values])
    raise ValueError(f"operator {op!r} does not fit a text field")


def _mask_predicate(column: Column, op: str, value) -> Column:
    names = [value] if isinstance(value, str) else value
    set_bits = [column.bitwiseAND(F.lit(args.attribute_bit(n))) != 0 for n in names]
    match op:
        case "has_all":
            return derive.all_of(set_bits)
        case "has_any":
            return derive.any_of(set_bits)
        case "has_none":
            return ~derive.any_of(set_bits)
    raise ValueError(f"operator {op!r} does not fit an attribute field")


def predicate(df: DataFrame, name: str, op: str, value, as_of: datetime | None = None) -> Column:
    """One (field, operator, value) condition."""
    f, op = field(name), op.lower()
    if f.name in ("attributes", "attribute_value"):
        return _mask_predicate(F.col("flags"), op, value)
    if not f.filterable:
        raise ValueError(f"field {f.name!r} cannot be filtered")
    column = derive.field_column(df, f.name)
    if f.name == "extension" and op in ("eq", "ne", "in", "not_in"):
        # Extensions are lower-case, so the stored column itself is compared and the scan can use it.
        values = [v.lower() for v in ([value] if isinstance(value, str) else value)]
        return column.isin(*values) if op in ("eq", "in") else ~column.isin(*values)
    if f.kind in ("string", "enum"):
        return _string_predicate(column, op, value)
    if op == "in":
        return column.isin(*value)
    if op == "not_in":
        return ~column.isin(*value)
    if op not in _COMPARE or (f.kind == "bool" and op not in ("eq", "ne")):
        raise ValueError(f"operator {op!r} does not fit field {f.name!r}")
    if f.kind == "timestamp":
        if isinstance(value, str):
            if as_of is None and not re.match(r"\d{4}-", value):
                raise ValueError(f"{value!r} is relative to a time: give as_of")
            value = args.time_bound(value, as_of or datetime.max, op in ("gt", "gte"))
        value = F.lit(value).cast("timestamp_ntz")
    return _COMPARE[op](column, value)


def where_all(df: DataFrame, predicates, as_of: datetime | None = None) -> DataFrame:
    """Rows that satisfy every (field, operator, value) predicate."""
    return df.filter(derive.all_of([predicate(df, *p, as_of=as_of) for p in predicates]))


def scope(df: DataFrame, deleted: bool = False, corrupt: bool = False,
          continuation: bool = False) -> DataFrame:
    """Live base rows, plus deleted, corrupt or continuation rows on request."""
    c = []
    if not deleted:
        c.append(~F.col("is_deleted"))
    if not corrupt:
        c.append(~F.col("is_corrupt"))
    if not continuation:
        c.append(~F.col("is_extension"))
    return df.filter(derive.all_of(c))
