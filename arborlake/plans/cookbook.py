"""Ready-made searches and reports over a catalog: name -> DataFrame(s).

A search recipe is a pattern with filters, order and limit; a report recipe is a
function of the catalog.  Every entry is lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as dc_field, replace

from pyspark.sql import DataFrame, functions as F

from arborlake.operators import aggregate as agg, duplicates as dup, filters as flt
from arborlake.operators.filters import Filters


@dataclass(frozen=True)
class Recipe:
    """One search; the largest and most recent rows come first unless said otherwise."""

    pattern: str = "*"
    sort: str = "modified"
    limit: int = 50
    mode: str = flt.FILES
    options: dict = dc_field(default_factory=dict)
    filters: dict = dc_field(default_factory=dict)

    def run(self, catalog, **changes) -> DataFrame:
        given = replace(self, **changes)
        return catalog.search(given.pattern, Filters(mode=given.mode, **given.filters), paths=True,
                              sort=given.sort, limit=given.limit, **given.options)


def _where(pattern: str = "*", sort: str = "modified", limit: int = 50, mode: str = flt.FILES,
           options: dict | None = None, **filters) -> Recipe:
    return Recipe(pattern, sort, limit, mode, options or {}, filters)


DIRS = {"mode": flt.DIRS}
SEARCHES: dict[str, Recipe] = {
    # names
    "all_pdfs": _where("*.pdf"),
    "name_contains": _where("invoice", mode=flt.ALL),
    "whole_name": _where("test", mode=flt.ALL, options={"whole_word": True}),
    "dated_csv": _where(">[0-9]{4}-[0-9]{2}-[0-9]{2}", ext="csv", mode=flt.ALL),
    "mail_archives_on_volume": _where("*.pst", "-size", 5, drives=["D"]),
    "one_config_file": _where("settings.toml", limit=20),
    "installers": _where("*setup*|*install*", "-size", ext="exe,msi"),
    # size
    "largest_files": _where(sort="-size", limit=20),
    "files_over_1gb": _where(sort="-size", min_size="1GB"),
    "large_archives": _where(sort="-size", limit=30, ext="archives,zst,tgz,cab", min_size="100MB"),
    "zero_byte_files": _where(limit=100, max_size=0),
    "high_bulkiness": _where(sort="-bulkiness", limit=20, min_size="1MB", min_bulkiness=500),
    # time
    "modified_last_week": _where(limit=100, newer="7d"),
    "archives_untouched_2_years": _where(sort="-size", ext="archives", older="730d"),
    "created_today": _where(sort="created", newer_created="today"),
    "recently_accessed": _where(sort="-accessed", newer_accessed="7d"),
    # kinds
    "images": _where(sort="-size", ext="pictures"),
    "code_this_week": _where(limit=100, type="code", newer="7d"),
    "executables_by_size": _where(sort="-size", limit=30, type="executable"),
    "recent_executables": _where(type="executable", newer="7d"),
    "large_media": _where(sort="-size", ext="pictures,videos", min_size="50MB"),
    "project_manifests": _where(ext="json,toml,yaml,yml,ini,env,cfg,conf"),
    # folders
    "files_in_folder": _where(sort="-size", limit=30, path_contains="Users\\"),
    "code_in_folder": _where("*.rs", path_contains="projects"),
    "recent_config_in_folder": _where(ext="toml,yaml,yml,json", path_contains="projects", newer="30d"),
    "largest_subtrees": _where(sort="-treesize", limit=20, **DIRS),
    "empty_directories": _where(sort="path", limit=100, max_descendants=0, **DIRS),
    "crowded_directories": _where(sort="-descendants", limit=20, min_descendants=1000, **DIRS),
    # cleanup
    "old_temp_files": _where("*.tmp", "-size", older="30d"),
    "temp_and_cache": _where(sort="-size", ext="tmp,temp,log,bak,old,cache", min_size="1MB"),
    "old_large_on_volume": _where(sort="-size", min_size="100MB", older="365d", drives=["C"]),
    "paths_near_limit": _where(sort="-path_length", limit=20, min_path_length=240),
    "paths_over_limit": _where(sort="-path_length", min_path_length=260),
    # attributes
    "hidden_files": _where(sort="-size", attributes="hidden"),
    "compressed_files": _where(sort="-size", attributes="compressed"),
}

REPORTS: dict[str, Callable[..., DataFrame | dict[str, DataFrame]]] = {
    **{name: (lambda c, n=name: c.preset(n)) for name in (
        "overview", "by_type", "by_extension", "by_drive", "by_size", "by_age", "storage", "activity",
        "top_folders", "duplicates", "media", "cleanup")},
    "volume_overview": lambda c, drive="D": c.scoped(drives=[drive]).preset("overview"),
    "top_extensions": lambda c: c.terms("extension", 30),
    "size_statistics": lambda c: agg.stats(c.rows, "size"),
    "size_histogram": lambda c: agg.histogram(c.rows, "size", 104_857_600),
    "creation_timeline": lambda c: agg.date_histogram(c.rows, "created", "month"),
    "size_brackets": lambda c: agg.range_(c.rows, "size", [1_048_576, 1_073_741_824]),
    "path_length_brackets": lambda c: agg.range_(c.with_paths(), "path_length", [100, 200, 260]),
    "without_extension": lambda c: agg.missing(c.rows, "extension"),
    "extension_count": lambda c: agg.distinct(c.rows, "extension"),
    "folders_at_depth_2": lambda c: c.rollup(2, 10),
    "folders_with_types": lambda c: c.rollup(1, 10, sub="type"),
    "extensions_with_samples": lambda c: c.terms("extension", 10, sample=3, dirs=c.dirs),
    "several_at_once": lambda c: {
        "count": agg.count(c.rows), "size": agg.stats(c.rows, "size"),
        "types": c.terms("type", 10), "extensions": c.terms("extension", 20)},
    "code_in_folder_stats": lambda c, pattern="*.rs", folder="GitHub": _scoped_stats(c, pattern, folder),
    "first_page_of_extensions": lambda c: _extension_page(c, 0),
    "next_page_of_extensions": lambda c: _extension_page(c, 50),
    "common_extensions": lambda c: agg.facet_values(c.rows, "extension", top=20),
    "volumes": lambda c: agg.facet_values(c.rows, "drive"),
    "types_of_pattern": lambda c, pattern="*.log": agg.facet_values(c.scoped(pattern).rows, "type", top=10),
    "extensions_with_prefix": lambda c, prefix="doc": agg.facet_values(c.rows, "extension", prefix, 10),
    "duplicate_summary": lambda c: dup.summary(dup.groups(c.rows)),
    "photo_space": lambda c: c.scoped(filters=Filters(ext="pictures")).preset("overview"),
    "modification_last_2_years": lambda c: agg.date_histogram(
        c.scoped(filters=Filters(newer="730d")).rows, "modified", "month"),
    "extensions_on_volume": lambda c, drive="D": agg.distinct(c.scoped(drives=[drive]).rows, "extension"),
    "music_timeline": lambda c, drive=None: c.scoped(
        filters=Filters(ext="music", drives=[drive] if drive else None)).preset("activity"),
}


def _scoped_stats(c, pattern: str, folder: str) -> dict[str, DataFrame]:
    rows = c.scoped(pattern, Filters(path_contains=folder)).rows
    return {"count": agg.count(rows), "size": agg.stats(rows, "size"),
            "modified": agg.date_histogram(rows, "modified", "month")}


def _extension_page(c, offset: int) -> DataFrame:
    groups = agg.extension_stats(c.rows)
    return agg.page(groups, [F.col("files").desc(), F.col("ext")], offset, 50)


def search(catalog, name: str, **changes) -> DataFrame:
    """Run a search recipe; ``changes`` replace its pattern, limit, sort or filters."""
    return SEARCHES[name].run(catalog, **changes)


def report(catalog, name: str, **options):
    return REPORTS[name](catalog, **options)
