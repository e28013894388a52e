"""Paths that follow a change stream: the store takes each batch, the directory table a delta of what it moved."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arborlake.operators import hierarchy as h
from arborlake.streaming.upkeep import CatalogStore


class CurrentPaths:
    """Directory table of a store, kept current batch by batch; ``step`` is what ``foreachBatch`` takes."""

    def __init__(self, store: CatalogStore, dirs: h.Directories | None = None):
        self.store = store
        self.dirs = dirs or h.build_directories(store.read())

    def step(self, changes: DataFrame, batch: int) -> None:
        """Fold a batch into the store, then the directories it created, renamed, moved or deleted into the table."""
        if self.store.apply_batch(changes, batch) is not None:
            self.dirs = h.refresh_directories(self.dirs, self.store.read(), changes.select(h.KEY))

    def rows(self) -> DataFrame:
        """Current rows with their current paths."""
        return h.with_paths(self.store.read(), self.dirs)
