"""Keeping a stored catalog current from a change stream.

A store holds, per volume, one base folder and the deltas that arrived since.
Each micro-batch writes only its changed rows; a compaction folds deltas into new
base folders of the touched volumes.  A small manifest names what is current, so
readers see whole versions and a replayed batch is recognised and skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from arborlake.functions import derive
from arborlake.operators.overlay import KEY, overlay
from arborlake.runtime import hadoop_fs, materialize
from arborlake.streaming.changes import META_COLUMNS, net_changes

DIRECTORY_BIT = 0x10
# Base folders are split by record id, so that a batch reads only the parts of a
# volume it touches.
BLOCK_RECORDS = 1 << 24


def block_of(frs: Column) -> Column:
    return F.call_function("div", frs, F.lit(BLOCK_RECORDS))


def decide(current: Column) -> Column:
    """Action of a net change; ``current`` tells whether the key has a live row."""
    named = F.col("n_name") != ""
    return (F.when(F.col("is_deleted"), F.when(current, F.lit("deleted")).otherwise(F.lit("skipped")))
            .when(F.col("is_created"), F.when(named, F.lit("created")).otherwise(F.lit("skipped")))
            .when(F.col("is_renamed"),
                  F.when(current & named, F.lit("renamed")).otherwise(F.lit("skipped")))
            .otherwise(F.lit("skipped")))


def plan_changes(current: DataFrame, net: DataFrame) -> DataFrame:
    """New row of every net change with its ``action``.

    ``current`` needs to hold only rows with a changed key.  A create overwrites a
    reused id; a rename moves and re-derives; a delete is a tombstone.
    """
    rest = [c for c in current.columns if c not in KEY]
    changes = net.select(*KEY, F.col("name").alias("n_name"), F.col("parent_frs").alias("n_parent"),
                         "is_created", "is_deleted", "is_renamed",
                         *[F.col(c).alias(f"n_{c}") for c in META_COLUMNS if c in net.columns])
    joined = changes.join(current.withColumn("_live", F.lit(True)), KEY, "left")
    action = decide(F.coalesce("_live", F.lit(False)))
    rows = joined.withColumn("action", action)
    created, renamed = F.col("action") == "created", F.col("action") == "renamed"

    def value(column: str, dtype: T.DataType) -> Column:
        old = F.col(column)
        given = F.col(f"n_{column}") if f"n_{column}" in joined.columns else F.lit(None).cast(dtype)
        blank = {"size": 0, "allocated_size": 0, "flags": 0, "link_count": 1, "stream_count": 1}
        if column in META_COLUMNS:
            fresh = F.coalesce(given, F.lit(blank.get(column)).cast(dtype))
            return F.when(created, fresh).when(renamed, F.coalesce(given, old)).otherwise(old)
        if column == "name":
            return F.when(created | renamed, F.col("n_name")).otherwise(old)
        if column == "parent_frs":
            return F.when(created | renamed, F.col("n_parent")).otherwise(old)
        if column == "ext":
            return F.when(created | renamed, derive.ext("n_name")).otherwise(old)
        if column == "is_directory":
            flags = F.coalesce(F.col("n_flags"), F.lit(0)) if "n_flags" in joined.columns else F.lit(0)
            return F.when(created, flags.bitwiseAND(F.lit(DIRECTORY_BIT)) != 0).otherwise(old)
        return F.when(created, F.lit(blank.get(column)).cast(dtype)).otherwise(old)

    types = {f.name: f.dataType for f in current.schema}
    return rows.select(*KEY, *[value(c, types[c]).cast(types[c]).alias(c) for c in rest], "action",
                       (F.col("action") == "deleted").alias("tombstone"))


def action_counts(planned: DataFrame) -> DataFrame:
    return planned.groupBy("action").agg(F.count("*").alias("files"))


def apply_changes(catalog: DataFrame, net: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog after the net changes, number of files per action).

    The change side is small next to the catalog, so when it fits the broadcast
    limit the catalog is scanned without an exchange.
    """
    current = catalog.join(net.select(*KEY), KEY, "left_semi")
    planned = plan_changes(current, net)
    effective = planned.filter(F.col("action") != "skipped")
    kept = catalog.join(effective.select(*KEY), KEY, "left_anti")
    live = effective.filter(~F.col("tombstone")).select(*catalog.columns)
    return kept.select(*catalog.columns).unionByName(live), action_counts(planned)


@dataclass
class Manifest:
    """Current folders of a store."""

    version: int = 0
    base: dict[str, str] = dc_field(default_factory=dict)      # drive -> base folder
    floor: dict[str, int] = dc_field(default_factory=dict)     # drive -> last batch in its base
    deltas: dict[str, str] = dc_field(default_factory=dict)    # batch -> delta folder
    journal: dict[str, int] = dc_field(default_factory=dict)   # drive -> journal id
    last_batch: int = -1


class CatalogStore:
    """Versioned catalog under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ manifest

    def _manifests(self) -> list[int]:
        fs, folder = hadoop_fs(self.spark, f"{self.root}/manifest")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self) -> Manifest:
        versions = self._manifests()
        if not versions:
            raise FileNotFoundError(f"no catalog in {self.root}")
        text = "\n".join(row.value for row in self.spark.read.text(
            f"{self.root}/manifest/{versions[-1]:012d}.json").collect())
        return Manifest(**json.loads(text))

    def _publish(self, m: Manifest) -> Manifest:
        """Write the next manifest beside the others, then rename it into place."""
        m.version += 1
        target = f"{self.root}/manifest/{m.version:012d}.json"
        fs, final = hadoop_fs(self.spark, target)
        draft = hadoop_fs(self.spark, target + ".draft")[1]
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"another writer published {target}")
        return m

    # ------------------------------------------------------------ reading

    def create(self, df: DataFrame, journal: dict[str, int] | None = None) -> Manifest:
        if self._manifests():
            raise FileExistsError(self.root)
        m = Manifest(journal=dict(journal or {}))
        self._write_base(m, df, 0)
        return self._publish(m)

    def _write_base(self, m: Manifest, df: DataFrame, number: int) -> None:
        # A name of its own for each call: two volumes may be replaced in one batch.
        folder = f"{self.root}/base/v={number}-{uuid.uuid4().hex}"
        (df.withColumn("block", block_of(F.col("frs"))).repartitionByRange("drive", "frs")
         .write.mode("errorifexists").partitionBy("drive", "block").parquet(folder))
        fs, jpath = hadoop_fs(self.spark, folder)
        for status in fs.listStatus(jpath):
            name = status.getPath().getName()
            if name.startswith("drive="):
                drive = name[len("drive="):]
                m.base[drive], m.floor[drive] = f"{folder}/{name}", m.last_batch

    def base(self, m: Manifest, drives: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Base rows of all or some volumes, or of some keys.

        A look-up of keys joins on the block folders too, so run-time partition
        pruning opens only the blocks that hold one of them.
        """
        paths = [p for d, p in sorted(m.base.items()) if drives is None or d in drives]
        empty = not paths
        rows = self.spark.read.option("basePath", f"{self.root}/base").parquet(*(paths or m.base.values()))
        rows = rows.withColumns({"drive": F.col("drive").cast("string"), "block": F.col("block").cast("bigint")})
        if keys is not None:
            wanted = keys.select(*KEY, block_of(F.col("frs")).alias("block"))
            rows = rows.join(wanted, ["drive", "block", "frs"], "left_semi")
        rows = rows.drop("v", "block")
        return rows.filter(F.lit(False)) if empty else rows

    def delta(self, m: Manifest) -> DataFrame | None:
        """Pending delta rows above each volume's floor."""
        if not m.deltas:
            return None
        rows = self.spark.read.parquet(*m.deltas.values())
        floors = F.lit(-1)
        for drive, floor in m.floor.items():
            floors = F.when(F.col("drive") == drive, F.lit(floor)).otherwise(floors)
        return rows.filter(F.col("batch") > floors)

    def read(self, drives: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Current rows: base overlaid with the pending deltas."""
        m = self.manifest()
        rows, pending = self.base(m, drives, keys), self.delta(m)
        if pending is None:
            return rows
        if drives is not None:
            pending = pending.filter(F.col("drive").isin(*drives))
        if keys is not None:
            pending = pending.join(keys.select(*KEY), KEY, "left_semi").select(*pending.columns)
        return overlay(rows, pending.drop("action"))

    # ------------------------------------------------------------ writing

    def apply_batch(self, changes: DataFrame, batch: int,
                    snapshot: Callable[[str], DataFrame] | None = None) -> DataFrame | None:
        """Fold one micro-batch into the store; None when it was applied before.

        A volume whose journal id changed is replaced from ``snapshot``.
        """
        m = self.manifest()
        if batch <= m.last_batch:
            return None
        changes = materialize(changes, "changes")
        if "journal_id" in changes.columns:
            self._reset_volumes(m, changes, batch, snapshot)
            stale = [d for d in m.journal if m.floor.get(d) == batch]
            changes = changes.filter(~F.col("drive").isin(*stale)) if stale else changes
        net = materialize(net_changes(changes), "net")
        drives = [r["drive"] for r in net.select("drive").distinct().collect()]   # volume letters
        current = self.read(drives, net)
        planned = plan_changes(current, net).withColumn("batch", F.lit(batch).cast("bigint"))
        folder = f"{self.root}/delta/batch={batch:012d}-v{m.version}"
        planned.write.mode("overwrite").parquet(folder)
        written = self.spark.read.parquet(folder)
        effective = f"{folder}-rows"
        written.filter(F.col("action") != "skipped").write.mode("overwrite").parquet(effective)
        m.deltas[str(batch)] = effective
        m.last_batch = batch
        self._publish(m)
        return action_counts(written)

    def _reset_volumes(self, m: Manifest, changes: DataFrame, batch: int, snapshot) -> None:
        seen = changes.groupBy("drive").agg(F.max_by("journal_id", "usn").alias("id")).collect()
        for row in seen:   # one row per volume letter
            known = m.journal.get(row["drive"])
            m.journal[row["drive"]] = row["id"]
            if known is None or known == row["id"]:
                continue
            if snapshot is None:
                raise RuntimeError(f"journal of {row['drive']} was reset and there is no snapshot")
            rows = snapshot(row["drive"]).withColumn("drive", F.lit(row["drive"]))
            last, m.last_batch = m.last_batch, batch
            self._write_base(m, rows, m.version + 1)
            m.last_batch = last

    def compact(self) -> Manifest:
        """Fold the pending deltas into new base folders of the volumes they touch."""
        m = self.manifest()
        pending = self.delta(m)
        if pending is None:
            return m
        drives = [r["drive"] for r in pending.select("drive").distinct().collect()]   # volume letters
        if drives:
            fresh = overlay(self.base(m, drives), pending.drop("action"))
            self._write_base(m, fresh, m.version + 1)
        m.deltas = {}
        return self._publish(m)


def start_upkeep(stream: DataFrame, store: CatalogStore, checkpoint: str, trigger: str | None = "2 seconds",
                 compact_every: int = 50, snapshot: Callable[[str], DataFrame] | None = None,
                 on_batch: Callable[[int, DataFrame], None] | None = None):
    """Run the store from a change stream; ``trigger=None`` drains what is there and stops."""
    def step(batch_rows: DataFrame, batch: int) -> None:
        counts = store.apply_batch(batch_rows, batch, snapshot)
        if counts is not None and on_batch is not None:
            on_batch(batch, counts)
        if (batch + 1) % compact_every == 0:
            store.compact()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()
