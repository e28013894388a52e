"""Checked queries: ready-made searches over the fixture catalog."""

from __future__ import annotations

from arborlake.plans import cookbook

from checks.base import ORACLES, QUERIES, cat, compose

_TAIL = "upper(name), name, drive, frs"
_MODIFIED = f"modified DESC NULLS LAST, {_TAIL}"
_SIZE = f"size DESC, {_TAIL}"
_FILE = "NOT is_directory"
_AGO = "modified {} TIMESTAMP '2001-06-15 12:00' - INTERVAL {} DAY"

# name -> (source, where, order, changes made to the recipe)
_RECIPES = {
    "all_pdfs": ("paths", f"{_FILE} AND ext = 'pdf'", _MODIFIED, {}),
    "name_contains": ("paths", "contains(lower(name), 'widget')", _MODIFIED, {"pattern": "widget"}),
    "whole_name": ("paths", "lower(name) = 'hot_ring_1.jpg'", _MODIFIED, {"pattern": "hot_ring_1.jpg"}),
    "largest_files": ("paths", _FILE, _SIZE, {}),
    "files_over_1gb": ("paths", f"{_FILE} AND size >= 20971520", _SIZE, {"filters": {"min_size": "20MB"}}),
    "zero_byte_files": ("paths", f"{_FILE} AND size = 0", _MODIFIED, {}),
    "high_bulkiness": ("tree", f"{_FILE} AND size > 0 AND allocated_size::HUGEINT * 1000000 // size >= 1010000",
                       f"allocated_size::HUGEINT * 1000000 // size DESC, {_TAIL}",
                       {"filters": {"min_size": 1, "min_bulkiness": 101}}),
    "modified_last_week": ("paths", f"{_FILE} AND {_AGO.format('>=', 7)}", _MODIFIED, {}),
    "archives_untouched_2_years": ("paths", f"{_FILE} AND ext IN ('pdf', 'txt') AND {_AGO.format('<', 730)}", _SIZE,
                                   {"filters": {"ext": "pdf,txt", "older": "730d"}}),
    "images": ("paths", f"{_FILE} AND ext = 'jpg'", _SIZE, {}),
    "large_media": ("paths", f"{_FILE} AND ext IN ('jpg', 'mp4') AND size >= 5242880", _SIZE,
                    {"filters": {"ext": "pictures,videos", "min_size": "5MB"}}),
    "files_in_folder": ("paths", rf"{_FILE} AND contains(lower(path), 'nation_3\')", _SIZE,
                        {"filters": {"path_contains": r"NATION_3\ ".strip()}}),
    "largest_subtrees": ("tree", "is_directory", f"treesize DESC, {_TAIL}", {}),
    "empty_directories": ("tree", "is_directory AND descendants = 0", f"upper(path), path, {_TAIL}", {}),
    "crowded_directories": ("tree", "is_directory AND descendants >= 1000", f"descendants DESC, {_TAIL}", {}),
    "old_large_on_volume": ("paths", f"{_FILE} AND size >= 10485760 AND drive = 'C' AND {_AGO.format('<', 365)}", _SIZE,
                            {"filters": {"min_size": "10MB", "older": "365d", "drives": ["C"]}}),
    "paths_near_limit": ("paths", f"{_FILE} AND length(path) >= 50", f"length(path) DESC, {_TAIL}",
                         {"filters": {"min_path_length": 50}}),
    "hidden_files": ("paths", f"{_FILE} AND flags & 2 <> 0", _SIZE, {}),
}


def _register(name, source, where, order, changes):
    limit = cookbook.SEARCHES[name].limit

    def run(spark, sf_dir):
        return cookbook.search(cat(spark, sf_dir), name, **changes).select("drive", "frs", "path")

    QUERIES[f"l_{name}"] = run
    ORACLES[f"l_{name}"] = compose(
        f"SELECT drive, frs, path FROM {source} WHERE {where} ORDER BY {order} LIMIT {limit}")


for _name, _spec in _RECIPES.items():
    _register(_name, *_spec)


def _path_brackets(spark, sf_dir):
    return cookbook.report(cat(spark, sf_dir), "path_length_brackets").select("key", "count", "total_bytes")


QUERIES["l_path_length_brackets"] = _path_brackets
ORACLES["l_path_length_brackets"] = compose("""
SELECT CASE WHEN length(path) < 100 THEN '< 100' WHEN length(path) < 200 THEN '100 - 200'
  WHEN length(path) < 260 THEN '200 - 260' ELSE '>= 260' END AS key, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_bytes
FROM paths GROUP BY 1""")
