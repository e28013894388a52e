"""Ready-made groups of aggregations: name -> {label: DataFrame}."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arborlake.functions.derive import SIZE_BOUNDS
from arborlake.operators import aggregate as agg, duplicates as dup
from arborlake.operators.hierarchy import Directories
from arborlake.plans.fold import Spec, fold

_BASIC = ("count", "total_bytes", "waste_bytes", "share_count", "share_bytes")
_TIME = ("count", "total_bytes")


def _terms(name, top, metrics):
    return Spec("terms", name, metrics, top)


def _months(name, metrics=_TIME):
    return Spec("date", name, metrics)


def _stats(name, *metrics):
    return Spec("stats", name, metrics)


# Labels, fields, metrics and numbers of buckets of the presets.
FOLDED = {
    "overview": {
        "total_count": Spec("count"),
        "files_vs_dirs": _terms("directory_flag", 2, _BASIC),
        "size_stats": _stats("size", "sum", "min", "max", "avg"),
        "by_type": _terms("type", 30, _BASIC),
        "by_drive": _terms("drive", 26, _BASIC),
        "modified_monthly": _months("modified"),
    },
    "by_type": {"by_type": _terms("type", 30, (
        "count", "total_bytes", "total_allocated", "waste_bytes", "waste_pct", "avg_size", "share_count", "share_bytes"))},
    "by_extension": {"by_extension": _terms("extension", 50, ("count", "total_bytes", "avg_size", "share_count", "share_bytes"))},
    "by_drive": {"by_drive": _terms("drive", 26, (
        "count", "total_bytes", "total_allocated", "waste_bytes", "waste_pct", "share_count", "share_bytes"))},
    "by_size": {
        "by_size": Spec("range", "size", ("count", "total_bytes", "share_count", "share_bytes"), bounds=tuple(SIZE_BOUNDS)),
        "size_totals": _stats("size", "sum", "min", "max", "avg"),
    },
    "by_age": {"by_age": _months("modified", ("count", "total_bytes", "share_count", "share_bytes"))},
    "storage": {
        "logical_size": _stats("size", "sum"),
        "allocated_size": _stats("size_on_disk", "sum"),
        "waste_by_drive": _terms("drive", 26, ("count", "total_bytes", "total_allocated", "waste_bytes", "waste_pct")),
        "waste_by_extension": _terms("extension", 20, ("count", "total_bytes", "waste_bytes", "waste_pct")),
    },
    "activity": {
        "modified_monthly": _months("modified"),
        "created_monthly": _months("created"),
        "accessed_monthly": _months("accessed", ("count",)),
    },
    "media": {
        "media_type_breakdown": _terms("type", 12, ("count", "total_bytes", "avg_size", "share_bytes")),
        "media_size_stats": _stats("size", "sum", "avg", "max"),
        "media_extensions": _terms("extension", 30, ("count", "total_bytes", "share_bytes")),
        "media_created_monthly": _months("created"),
    },
    "cleanup": {
        "no_extension": Spec("missing", "extension"),
        "zero_byte_files": Spec("missing", "size"),
        "distinct_extensions": Spec("distinct", "extension"),
        "total_files": Spec("count"),
    },
}


def top_folders(df, dirs):
    return {"top_folders": agg.rollup_path(df, dirs, 1, 30, (
        "count", "total_bytes", "total_allocated", "waste_bytes", "share_bytes"))}


def duplicates(df, dirs=None):
    return {"duplicate_candidates": dup.duplicates(df, ("size", "name"), 100, 2, dirs)}


PRESETS = (*FOLDED, "top_folders", "duplicates")


def preset(df: DataFrame, name: str, dirs: Directories | None = None) -> dict[str, DataFrame]:
    """Results of a preset over a (filtered) catalog; all its parts from one scan, whose partial sums are written first."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset: {name!r}, one of {sorted(PRESETS)}")
    if name == "top_folders" and dirs is None:
        raise ValueError("top_folders needs the directory table")
    if name in FOLDED:
        return fold(df, FOLDED[name])
    return top_folders(df, dirs) if name == "top_folders" else duplicates(df, dirs)
