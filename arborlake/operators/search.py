"""Pattern search: pattern, filters, order and limit in one lazy DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import derive, patterns
from arborlake.operators import filters as flt, ordering
from arborlake.operators.filters import Filters
from arborlake.operators.hierarchy import Directories, OK, ROOT_IDS, expand_descendants, with_paths
from arborlake.schema import find_field

INSENSITIVE, SENSITIVE, SMART = "insensitive", "sensitive", "smart"


@dataclass(frozen=True)
class Scoped:
    """Pattern left after its scope prefix, and what the prefix asked for."""

    pattern: str
    match_path: bool = False
    mode: str | None = None
    drive: str | None = None


def read_scope(pattern: str) -> Scoped:
    """Take off ``path:``, ``dir:``, ``file:`` or a bare volume prefix ``C:``."""
    if pattern.startswith("path:"):
        return Scoped(pattern[5:], match_path=True)
    if pattern.startswith("dir:"):
        return Scoped(pattern[4:], mode=flt.DIRS)
    if pattern.startswith("file:"):
        return Scoped(pattern[5:], mode=flt.FILES)
    volume = re.match(r"([A-Za-z]):(?![\\/])(.*)$", pattern, re.DOTALL)
    if volume:
        return Scoped(volume[2] or "*", drive=volume[1].upper())
    return Scoped(pattern)


def sugar(begins: str | None = None, ends: str | None = None, contains: str | None = None) -> str:
    """Pattern of the prefix, suffix and substring options."""
    if begins is not None:
        return f"{begins}*"
    if ends is not None:
        return f"*{ends}"
    return "*" if contains is None else f"*{contains}*"


def is_case_sensitive(pattern: str, case: str) -> bool:
    return case == SENSITIVE or (case == SMART and any(ch.isupper() for ch in pattern))


def is_path_pattern(pattern: str) -> bool:
    return not pattern.startswith(">") and ("\\" in pattern or "/" in pattern)


def name_condition(df: DataFrame, pattern: str, case_sensitive: bool, whole_word: bool) -> Column:
    """Condition on the name; everything matches '*'."""
    if pattern.startswith(">"):
        return patterns.named(F.col("name")) & patterns.regex(F.col("name"), pattern[1:], case_sensitive)
    if pattern in ("", "*"):
        return F.lit(True)
    condition = patterns.name_matches(F.col("name"), pattern, case_sensitive, whole_word)
    extension = _fixed_extension(pattern, whole_word)
    if extension and not case_sensitive:
        # The stored extension reaches the scan, decides for most files and prunes row groups.
        condition = condition & (derive.field_column(df, "extension") == extension)
    return condition


def _fixed_extension(pattern: str, whole_word: bool) -> str | None:
    """The extension of every name that the pattern can match, if it has the whole name's end in plain letters."""
    if not whole_word and "*" not in pattern and "?" not in pattern or "|" in pattern:
        return None
    end = re.fullmatch(r"[^\\/]+\.([A-Za-z0-9_~]+)", pattern)
    return end[1].lower() if end else None


def search_path(df: DataFrame, dirs: Directories, pattern: str) -> DataFrame:
    """Path pattern such as ``\\nation\\**\\*.pdf``.

    The directory part is a regex over the directory table only; rows then need
    one semi-join on their parent and the test of the last segment on the name.
    """
    anchored = re.match(r"([A-Za-z]):[\\/](.*)$", pattern, re.DOTALL)
    segments = patterns.split_path_pattern(anchored[2] if anchored else pattern)
    rows = df.filter(F.col("drive") == anchored[1].upper()) if anchored else df
    if not segments:
        return rows.filter(F.lit(False))
    *folders, leaf = segments
    if not folders and not anchored:
        return rows.filter(patterns.named(F.col("name")) & derive.fold("name").contains(leaf.upper()))
    expression = patterns.directory_regex(folders, leaf == "**")
    if anchored:
        expression = expression.replace(r"^[A-Z]:\\(?:[^\\]+\\)*", rf"^{anchored[1].upper()}:\\", 1)
    closed = F.when(F.col("path").endswith("\\"), F.col("path")).otherwise(F.concat("path", F.lit("\\")))
    parents = dirs.table.filter(F.col("state") == OK).filter(derive.fold(closed).rlike(expression))
    name = patterns.named(F.col("name"))
    if leaf != "**":
        name = patterns.name_matches(F.col("name"), leaf)
    not_root = ~F.col("frs").isin(*ROOT_IDS)
    lookup = parents.select("drive", F.col("frs").alias("parent_frs"))
    return dirs.join_parent(rows.filter(name & not_root), lookup, "left_semi").select(*df.columns)


def search(df: DataFrame, pattern: str = "*", *, dirs: Directories | Callable[[], Directories] | None = None,
           case: str = INSENSITIVE, whole_word: bool = False, match_path: bool = False,
           filters: Filters | None = None, as_of: datetime | None = None,
           expand: bool = False, sort: str | list[str] | None = None, limit: int | None = None,
           offset: int = 0, drives: list[str] | None = None) -> DataFrame:
    """Matching rows, sorted and cut last, as a lazy DataFrame.

    Needs ``dirs`` when the pattern, a filter or the sort looks at paths; a
    function that gives it is called only then.  With ``expand`` every matching
    directory brings everything below it.
    """
    scoped = read_scope(pattern)
    f = filters or Filters()
    if scoped.mode:
        f = replace(f, mode=scoped.mode)
    if drives or (scoped.drive and not f.drives):
        f = replace(f, drives=tuple(drives or (scoped.drive,)))
    moment = as_of or datetime.now()
    out = df
    path_pattern = is_path_pattern(scoped.pattern) and not (match_path or scoped.match_path)
    if not path_pattern and not (match_path or scoped.match_path):
        sensitive = is_case_sensitive(scoped.pattern, case)
        out = out.filter(name_condition(df, scoped.pattern, sensitive, whole_word))
    elif path_pattern:
        out = search_path(out, _dirs(dirs), scoped.pattern)
    if expand:
        matched = out
        out = expand_descendants(df, _dirs(dirs), matched)
    walks = f.needs_path or f.malformed_path is not None
    out = flt.apply(out, f, moment, _dirs(dirs) if walks else None)
    if (match_path or scoped.match_path) and scoped.pattern not in ("", "*"):
        if "path" not in out.columns:
            out = with_paths(out, _dirs(dirs))
        sensitive = is_case_sensitive(scoped.pattern, case)
        if scoped.pattern.startswith(">"):
            out = out.filter(patterns.regex(F.col("path"), scoped.pattern[1:], sensitive))
        else:
            subject = F.col("path") if sensitive else derive.fold("path")
            wanted = scoped.pattern if sensitive else scoped.pattern.upper()
            out = out.filter(patterns.text_matches(subject, wanted, whole_word))
    if sort is not None:
        if _sort_needs_path(sort) and "path" not in out.columns:
            out = with_paths(out, _dirs(dirs))
        if limit is not None:
            return ordering.page(out, sort, limit, offset)
        return ordering.sort_by(out, sort)
    if limit is not None:
        return ordering.page(out, ordering.DEFAULT_SORT, limit, offset)
    return out


def _sort_needs_path(sort: str | list[str]) -> bool:
    return any(find_field(name).needs == "path" for name, _ in ordering.parse_sort(sort))


def _dirs(dirs: Directories | Callable[[], Directories] | None) -> Directories:
    if dirs is None:
        raise ValueError("this search needs the directory table, see build_directories")
    return dirs() if callable(dirs) else dirs


def find_by_path(df: DataFrame, dirs: Directories, path: str) -> DataFrame:
    """The row of one full path: its directory is looked up first."""
    folder, _, leaf = path.rstrip("\\").rpartition("\\")
    if not leaf or leaf.endswith(":"):
        letter = path[:1].upper()
        return df.filter((F.col("drive") == letter) & F.col("frs").isin(*ROOT_IDS))
    folder = folder + "\\" if folder.endswith(":") else folder
    parents = dirs.table.filter((F.col("drive") == path[:1].upper())
                                & (derive.fold("path") == folder.upper()))
    return (df.filter((F.col("drive") == path[:1].upper()) & (derive.fold("name") == leaf.upper()))
            .join(parents.select("drive", F.col("frs").alias("parent_frs")),
                  ["drive", "parent_frs"], "left_semi").select(*df.columns))
