"""Checked queries: change journal, net changes, upkeep, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.operators import overlay as ov
from arborlake.runtime import materialize
from arborlake.sources import binding
from arborlake.streaming import changes as ch, paths, upkeep

from checks.base import cat, out_path, query


def base_catalog(spark, sf):
    """Volume C plus one file per third user, so that changes meet existing ids."""
    c = cat(spark, sf)
    users = (binding.table(spark, sf, "events").select(F.col("user_id").alias("frs")).distinct()
             .filter("frs % 3 = 0 and frs <> 5"))
    blank = users.select(
        F.lit("C").alias("drive"), "frs", F.lit(5).cast("bigint").alias("parent_frs"),
        F.concat(F.lit("user_"), F.col("frs").cast("string"), F.lit(".log")).alias("name"),
        F.lit(False).alias("is_directory"), (F.col("frs") * 10).alias("size"), (F.col("frs") * 10).alias("allocated_size"),
        F.lit(32).alias("flags"), F.lit(1).alias("link_count"), F.lit("log").alias("ext"))
    return c.rows.unionByName(blank, allowMissingColumns=True)


_BASE = """
base AS MATERIALIZED (SELECT drive, frs, parent_frs, name, size, ext, is_directory FROM catalog
  UNION ALL SELECT 'C', frs, CAST(5 AS BIGINT), 'user_' || frs || '.log', frs * 10, 'log', FALSE
  FROM (SELECT DISTINCT user_id AS frs FROM events WHERE user_id % 3 = 0 AND user_id <> 5)),
planned AS MATERIALIZED (SELECT n.*, b.frs IS NOT NULL AS live, b.size AS old_size,
  CASE WHEN is_deleted THEN CASE WHEN b.frs IS NOT NULL THEN 'deleted' ELSE 'skipped' END
       WHEN is_created THEN CASE WHEN n.name <> '' THEN 'created' ELSE 'skipped' END
       WHEN is_renamed AND b.frs IS NOT NULL AND n.name <> '' THEN 'renamed' ELSE 'skipped' END AS action
  FROM net n LEFT JOIN base b ON b.drive = n.drive AND b.frs = n.frs),
touched AS MATERIALIZED (SELECT drive, frs FROM planned WHERE action <> 'skipped'),
applied AS MATERIALIZED (SELECT b.drive, b.frs, b.parent_frs, b.name, b.size, b.ext FROM base b
    WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.drive = b.drive AND t.frs = b.frs)
  UNION ALL SELECT drive, frs, parent_frs, name, CASE WHEN action = 'created' THEN 0 ELSE old_size END, 'txt'
    FROM planned WHERE action IN ('created', 'renamed'))"""


@query("j01_classify_change", "SELECT usn, kind, reason & 2147483648 <> 0 AS closed FROM classified")
def _(spark, sf):
    df = binding.changes(spark, sf)
    return df.select("usn", ch.classify("reason").alias("kind"), ch.is_close("reason").alias("closed"))


@query("j02_net_changes", "SELECT * FROM net")
def _(spark, sf):
    return ch.net_changes(binding.changes(spark, sf))


#: Files of a quarter of the journal, read in one micro-batch.
FILES_PER_PART = 2


def change_files(spark, sf, parts=4):
    """Journal in files that arrive one after the other, by sequence number."""
    path = out_path(spark, "journal")
    df = binding.changes(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "journal_id": F.lit(1).cast("bigint")})
    wanted = [f.name for f in ch.CHANGE_SCHEMA]
    first, last = df.agg(F.min("usn"), F.max("usn")).first()
    step = (last - first) // parts + 1
    for i in range(parts):
        low = first + i * step
        part = df.filter((F.col("usn") >= low) & (F.col("usn") < low + step)).select(*wanted)
        part.repartition(FILES_PER_PART).write.mode("append").parquet(path)
    return path


@query("j03_net_changes_stateful", "SELECT * FROM net")
def _(spark, sf):
    """Daily parts over micro-batches in update mode, whose state expires a day later; the parts are added up."""
    stream = ch.change_parts(ch.read_changes(spark, change_files(spark, sf), max_files=FILES_PER_PART), "1 day", "1 day")
    out, points = out_path(spark, "net-updates"), out_path(spark, "points")

    def keep(rows, batch):
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", points)
     .trigger(availableNow=True).start().awaitTermination())
    return ch.merge_parts(ch.latest_parts(spark.read.parquet(out)))


@query("j04_apply_changes", f"WITH {_BASE} SELECT drive, frs, parent_frs, name, size, ext FROM applied")
def _(spark, sf):
    net = materialize(ch.net_changes(binding.changes(spark, sf)), "net")
    after, _ = upkeep.apply_changes(base_catalog(spark, sf), net)
    return after.select("drive", "frs", "parent_frs", "name", "size", "ext")


@query("j04_apply_stats", f"WITH {_BASE} SELECT action, count(*) AS files FROM planned GROUP BY 1")
def _(spark, sf):
    net = materialize(ch.net_changes(binding.changes(spark, sf)), "net")
    return upkeep.apply_changes(base_catalog(spark, sf), net)[1]


@query("j04_stream_upkeep", f"WITH {_BASE} SELECT drive, frs, parent_frs, name, size, ext FROM applied")
def _(spark, sf):
    """One micro-batch from the file source into a versioned store."""
    store = upkeep.CatalogStore(spark, out_path(spark, "store"))
    store.create(base_catalog(spark, sf), {"C": 1})
    stream = ch.read_changes(spark, change_files(spark, sf))
    upkeep.start_upkeep(stream, store, out_path(spark, "points"), trigger=None).awaitTermination()
    return store.read().select("drive", "frs", "parent_frs", "name", "size", "ext")


@query("j05_overlay_read", f"WITH {_BASE} SELECT drive, frs, parent_frs, name, size, ext FROM applied")
def _(spark, sf):
    base = base_catalog(spark, sf)
    net = materialize(ch.net_changes(binding.changes(spark, sf)), "net")
    current = base.join(net.select("drive", "frs"), ["drive", "frs"], "left_semi")
    delta = upkeep.plan_changes(current, net).filter("action <> 'skipped'").withColumn("batch", F.lit(0)).drop("action")
    return ov.overlay(base, delta).select("drive", "frs", "parent_frs", "name", "size", "ext")


def directory_changes(rows, usn=0):
    """Journal entries that rename, and partly move, directories: rows with the new name and parent."""
    return rows.select("drive", (F.monotonically_increasing_id() + usn).alias("usn"), "frs", "parent_frs",
                       F.lit(0x2000).cast("bigint").alias("reason"), "name", F.lit(0).alias("ts"), F.lit(1).cast("bigint").alias("journal_id"))


@query("j06_store_paths", r"""
WITH now AS MATERIALIZED (SELECT drive, frs, is_directory,
  CASE WHEN frs BETWEEN 1000000 AND 99999999 AND frs % 100 = 0 THEN CAST(5 AS BIGINT) ELSE parent_frs END AS parent_frs,
  CASE WHEN frs BETWEEN 1000 AND 1024 AND frs % 3 = 0 THEN 'N_' || name
       WHEN frs BETWEEN 1000000 AND 99999999 AND frs % 50 = 0 THEN 'moved_' || name
       WHEN frs BETWEEN 100000000 AND 999999999 AND frs % 40 = 0 THEN 'o_' || frs ELSE name END AS name FROM catalog),
places AS (SELECT drive, frs, drive || ':\' AS path, drive || ':\' AS front FROM now WHERE frs = 5
  UNION ALL SELECT n.drive, n.frs, p.front || n.name, p.front || n.name || '\'
  FROM now n JOIN places p ON n.drive = p.drive AND n.parent_frs = p.frs WHERE n.is_directory AND n.frs <> 5)
SELECT n.drive, n.frs, CASE WHEN n.frs = 5 THEN n.drive || ':\' ELSE p.front || n.name END AS path
FROM now n JOIN places p ON p.drive = n.drive AND p.frs = n.parent_frs""")
def _(spark, sf):
    """Two batches rename nested directories and move some to the root; paths follow in the store."""
    c = cat(spark, sf)
    store = upkeep.CatalogStore(spark, out_path(spark, "store"))
    store.create(c.rows, {d.drive: 1 for d in c.rows.select("drive").distinct().collect()})   # volume letters
    current = paths.CurrentPaths(store, c.dirs)
    frs = F.col("frs")
    nations = c.rows.filter(frs.between(1000, 1024) & (frs % 3 == 0)).withColumn("name", F.concat(F.lit("N_"), "name"))
    customers = c.rows.filter("is_directory").filter(frs.between(1_000_000, 99_999_999) & (frs % 50 == 0)).withColumns({
        "name": F.concat(F.lit("moved_"), "name"), "parent_frs": F.when(frs % 100 == 0, F.lit(5)).otherwise(F.col("parent_frs"))})
    orders = c.rows.filter("is_directory").filter(frs.between(100_000_000, 999_999_999) & (frs % 40 == 0)).withColumn(
        "name", F.concat(F.lit("o_"), frs.cast("string")))
    current.step(directory_changes(nations.unionByName(customers)), 0)
    current.step(directory_changes(orders, 1 << 40), 1)
    return current.rows().select("drive", "frs", "path")


@query("j07_cadence_compaction", None)
def _(spark, sf):
    """Four micro-batches with a compaction after every second one."""
    store = upkeep.CatalogStore(spark, out_path(spark, "store"))
    store.create(base_catalog(spark, sf), {"C": 1})
    stream = ch.read_changes(spark, change_files(spark, sf), max_files=FILES_PER_PART)
    upkeep.start_upkeep(stream, store, out_path(spark, "points"), trigger=None, compact_every=2).awaitTermination()
    return store.read().select("drive", "frs", "parent_frs", "name", "size", "ext")


@query("j09_journal_reset", """
SELECT drive, frs, name FROM catalog WHERE drive <> 'C' OR frs % 2 = 0""")
def _(spark, sf):
    """The journal of C gets a new id: C is replaced by its snapshot."""
    c = cat(spark, sf)
    store = upkeep.CatalogStore(spark, out_path(spark, "store"))
    store.create(c.rows, {"C": 1})
    changes = binding.changes(spark, sf).withColumn("journal_id", F.lit(2).cast("bigint"))
    snapshot = c.rows.filter("drive = 'C' and frs % 2 = 0").drop("drive")
    store.apply_batch(changes, 0, lambda drive: snapshot)
    return store.read().select("drive", "frs", "name")


@query("j09_reset_two_volumes", """
SELECT drive, frs, name FROM catalog WHERE frs % 2 = 0 OR drive NOT IN (SELECT DISTINCT drive FROM catalog ORDER BY drive LIMIT 2)""")
def _(spark, sf):
    """Two volumes get new journals in one batch, with Spark's own default of the overwrite mode."""
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        c = cat(spark, sf)
        two = [r.drive for r in c.rows.select("drive").distinct().orderBy("drive").limit(2).collect()]
        store = upkeep.CatalogStore(spark, out_path(spark, "store"))
        store.create(c.rows, {d: 1 for d in two})
        some = binding.changes(spark, sf).withColumn("journal_id", F.lit(2).cast("bigint"))
        changes = some.withColumn("drive", F.explode(F.array(*map(F.lit, two))))
        store.apply_batch(changes, 0, lambda drive: c.rows.filter((F.col("drive") == drive) & (F.col("frs") % 2 == 0)).drop("drive"))
        return store.read().select("drive", "frs", "name")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


@query("source_changes", "SELECT usn, drive, frs, CAST(reason AS BIGINT) AS reason, name FROM changes")
def _(spark, sf):
    out = out_path(spark, "received")
    stream = ch.read_changes(spark, change_files(spark, sf), max_files=2).select("usn", "drive", "frs", "reason", "name")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out_path(spark, "points"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


def rates(df):
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"),
                     F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "drive", "changes")


@query("j10_rates_tumbling", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end",
  'C' AS drive, count(*) AS changes FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s FROM events) GROUP BY s""")
def _(spark, sf):
    return rates(ch.change_rates(binding.changes(spark, sf), "tumbling", "6 hours"))


@query("j10_rates_sliding", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end",
  'C' AS drive, count(*) AS changes
FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts) - unnest([INTERVAL 0 HOUR, INTERVAL 2 HOUR, INTERVAL 4 HOUR]) AS s FROM events)
GROUP BY s""")
def _(spark, sf):
    return rates(ch.change_rates(binding.changes(spark, sf), "sliding", "6 hours", "2 hours"))


@query("j10_rates_session", """
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end",
  'C' AS drive, count(*) AS changes
FROM (SELECT ts, sum(fresh) OVER (ORDER BY ts, event_id) AS sid FROM (
  SELECT ts, event_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY sid""")
def _(spark, sf):
    return rates(ch.change_rates(binding.changes(spark, sf), "session", gap="5 minutes"))
