"""A catalog with its derived tables, and the user-facing calls on it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from arborlake.operators import aggregate as agg, duplicates as dup, hierarchy as h, ngrams, search as srch
from arborlake.operators.filters import Filters, apply as apply_filters
from arborlake.plans import presets
from arborlake.runtime import materialize
from arborlake.sources import binding, catalog_io, sinks


@dataclass
class Catalog:
    """Rows of a catalog; directory table and subtree sums are built on first use
    and kept as tables in the shared folder."""

    rows: DataFrame
    as_of: datetime | None = None
    whole: Catalog | None = None    # the catalog this one is a part of

    @classmethod
    def read(cls, spark: SparkSession, path: str, as_of: datetime | None = None) -> Catalog:
        return cls(catalog_io.read_catalog(spark, path), as_of)

    @classmethod
    def prepare(cls, rows: DataFrame, as_of: datetime | None = None) -> Catalog:
        """Write rows in the search layout (extension stored, clustered) and open them."""
        return cls(materialize(binding.prepared(rows), "catalog", "drive"), as_of)

    @cached_property
    def dirs(self) -> h.Directories:
        return self.whole.dirs if self.whole else h.build_directories(self.rows)

    @cached_property
    def sums(self) -> DataFrame:
        return materialize(h.tree_sums(self.rows, self.dirs), "sums")

    @cached_property
    def tree_rows(self) -> DataFrame:
        """Rows with descendants, treesize and tree_allocated."""
        return h.with_tree_metrics(self.rows, self.sums)

    @cached_property
    def grams(self) -> DataFrame:
        """Index of the 3-character pieces of all names."""
        return self.whole.grams if self.whole else ngrams.postings(materialize(ngrams.posting_lists(self.rows), "grams"))

    @cached_property
    def gram_counts(self) -> DataFrame:
        return self.whole.gram_counts if self.whole else materialize(ngrams.gram_counts(self.grams), "gram_counts")

    def regex(self, expression: str, case_sensitive: bool = False) -> DataFrame:
        """Rows whose name has a match, by way of the index of pieces."""
        return ngrams.regex_search(self.rows, self.grams, expression, case_sensitive, counts=self.gram_counts)

    def with_paths(self, df: DataFrame | None = None, dir_suffix: bool = False) -> DataFrame:
        """Add paths to this catalog's rows or to any other rows."""
        if df is None:
            return h.with_paths(self.rows, self.dirs, dir_suffix, covered=True)
        return h.with_paths(df, self.dirs, dir_suffix)

    def search(self, pattern: str = "*", filters: Filters | None = None, *, paths: bool = False,
               **options) -> DataFrame:
        """See :func:`arborlake.operators.search.search`; ``paths`` adds the path of
        the surviving rows."""
        f = filters or Filters()
        sort = options.get("sort")
        tree = f.needs_tree or f.min_bulkiness is not None or f.max_bulkiness is not None
        tree = tree or (sort is not None and any(
            srch.find_field(n).needs == "tree" for n, _ in srch.ordering.parse_sort(sort)))
        source = self.tree_rows if tree else self.rows
        options.setdefault("as_of", self.as_of)
        limit = options.get("limit")
        late_sort = paths and limit is None and sort is not None
        if late_sort:
            options.pop("sort")
        found = srch.search(source, pattern, filters=f, dirs=lambda: self.dirs, **options)
        if paths and "path" not in found.columns:
            found = h.with_paths(found, self.dirs, covered=True)
        if late_sort:
            return srch.ordering.sort_by(found, sort)
        if paths and limit is not None:
            # The path join does not keep the order of the limited rows.
            return srch.ordering.top_n(found, sort or srch.ordering.DEFAULT_SORT, limit)
        return found

    def scoped(self, pattern: str = "*", filters: Filters | None = None, **options) -> Catalog:
        """Catalog of the matching rows, sharing this one's directory table."""
        part = replace(self, rows=self.search(pattern, filters, **options))
        part.whole = self.whole or self
        return part

    def preset(self, name: str) -> dict[str, DataFrame]:
        return presets.preset(self.rows, name, self.dirs if name in ("top_folders", "duplicates") else None)

    def terms(self, name: str, top: int | None = None, **options) -> DataFrame:
        return agg.terms(self.rows, name, top, **options)

    def rollup(self, depth: int = 1, top: int | None = None, **options) -> DataFrame:
        return agg.rollup_path(self.rows, self.dirs, depth, top, **options)

    def duplicates(self, keys=("size", "name"), top: int = 100, sample: int = 2) -> DataFrame:
        return dup.duplicates(self.rows, keys, top, sample, self.dirs)

    def filter(self, filters: Filters) -> DataFrame:
        walks = filters.needs_path or filters.malformed_path is not None
        return apply_filters(self.rows, filters, self.as_of or datetime.now(), self.dirs if walks else None)

    def export(self, path: str, **options) -> None:
        """Write all rows with paths, and with subtree columns where the listing shows them, see :func:`sinks.export`."""
        tree = sinks.needs_tree(options.get("columns"), options.get("legacy", False))
        sinks.export(h.with_paths(self.tree_rows if tree else self.rows, self.dirs, covered=True), path, **options)
