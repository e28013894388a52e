"""Change journal: classification, net changes and rates, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from arborlake.functions.derive import (
    REASON_CLOSE, REASON_CREATE, REASON_DELETE, REASON_METADATA, REASON_RENAME, REASON_SIZE,
    reason_has)

CHANGE_SCHEMA = T.StructType([
    T.StructField("drive", T.StringType()),
    T.StructField("journal_id", T.LongType()),
    T.StructField("usn", T.LongType()),
    T.StructField("frs", T.LongType()),
    T.StructField("parent_frs", T.LongType()),
    T.StructField("reason", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

# Metadata a source may attach to a change.
META_COLUMNS = ("size", "allocated_size", "created", "modified", "accessed", "flags")


def classify(reason: Column | str) -> Column:
    """One class per record; a delete outranks a create in the same record."""
    return (F.when(reason_has(reason, REASON_DELETE), F.lit("deleted"))
            .when(reason_has(reason, REASON_CREATE), F.lit("created"))
            .when(reason_has(reason, REASON_RENAME), F.lit("renamed"))
            .when(reason_has(reason, REASON_SIZE), F.lit("size_changed"))
            .when(reason_has(reason, REASON_METADATA), F.lit("metadata_changed"))
            .otherwise(F.lit("other")))


def is_close(reason: Column | str) -> Column:
    return reason_has(reason, REASON_CLOSE)


def _named() -> Column:
    return F.col("name").isNotNull() & (F.col("name") != "")


def _last_of(kind: Column):
    """Sequence number of the last change of a class, -1 if there is none."""
    return lambda what: F.coalesce(F.max(F.when(kind == what, F.col("usn"))), F.lit(-1))


def _with_state(folded: DataFrame) -> DataFrame:
    c, d, r = F.col("_c"), F.col("_d"), F.col("_r")
    return folded.withColumns({
        "is_created": c > d, "is_deleted": d > F.greatest(c, r), "is_renamed": r > F.greatest(c, d),
    }).drop("_c", "_d", "_r")


def net_changes(changes: DataFrame) -> DataFrame:
    """One row per file: last parent, last non-empty name and net state flags.

    The last create, delete or rename decides, so three maxima of the sequence
    number replace an ordered fold, and combine before the exchange however many
    changes one file has.  For a stream, whose state would never end, there is
    ``change_parts``.
    """
    if changes.isStreaming:
        raise ValueError("a stream needs change_parts, whose state expires")
    kind, named = classify("reason"), _named()
    last = _last_of(kind)
    meta = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("usn"))).alias(c)
            for c in META_COLUMNS if c in changes.columns]
    folded = changes.groupBy("drive", "frs").agg(
        F.max_by("parent_frs", "usn").alias("parent_frs"),
        F.coalesce(F.max_by("name", F.when(named, F.col("usn"))), F.lit("")).alias("name"),
        last("created").alias("_c"), last("deleted").alias("_d"), last("renamed").alias("_r"),
        F.bool_or(kind == "size_changed").alias("size_changed"),
        F.bool_or(kind == "metadata_changed").alias("metadata_changed"),
        F.max("usn").alias("last_usn"), *meta)
    return _with_state(folded)


def change_parts(changes: DataFrame, span: str, watermark: str) -> DataFrame:
    """Changes of a file within one window of event time, in a form that ``merge_parts`` can add up.

    For streams: a window's state goes once the watermark has passed its end, so state is bounded by the files that
    change within ``span`` and ``watermark``.  Rows later than that are dropped and counted by the query's progress
    (``numRowsDroppedByWatermark``); they are still in the journal.  Append mode gives each part once, when its window is
    closed; update mode gives it again with every change (see ``latest_parts``).
    """
    kind = classify("reason")
    last = _last_of(kind)

    def at(name: str, when: Column) -> Column:
        return F.max(F.when(when, F.struct("usn", F.col(name).alias("value")))).alias(f"{name}_at")

    meta = [at(c, F.col(c).isNotNull()) for c in META_COLUMNS if c in changes.columns]
    grouped = changes.withWatermark("ts", watermark).groupBy(F.window("ts", span).alias("span"), "drive", "frs").agg(
        at("parent_frs", F.lit(True)), at("name", _named()),
        last("created").alias("_c"), last("deleted").alias("_d"), last("renamed").alias("_r"),
        F.bool_or(kind == "size_changed").alias("size_changed"),
        F.bool_or(kind == "metadata_changed").alias("metadata_changed"),
        F.max("usn").alias("last_usn"), *meta)
    return grouped.select(F.col("span.start").alias("span_start"), *[c for c in grouped.columns if c != "span"])


def latest_parts(updates: DataFrame, batch: str = "batch") -> DataFrame:
    """Of parts that were written in update mode, with the number of their micro-batch, the last of each."""
    key = ["span_start", "drive", "frs"]
    rest = [c for c in updates.columns if c not in (*key, batch)]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), batch).alias("row")).select(*key, "row.*")


def merge_parts(parts: DataFrame) -> DataFrame:
    """``net_changes`` of the journal whose parts these are; the order of windows doesn't matter."""
    def value(name: str) -> Column:
        return F.max(f"{name}_at")["value"]

    meta = [value(c).alias(c) for c in META_COLUMNS if f"{c}_at" in parts.columns]
    return _with_state(parts.groupBy("drive", "frs").agg(
        value("parent_frs").alias("parent_frs"), F.coalesce(value("name"), F.lit("")).alias("name"),
        *[F.max(c).alias(c) for c in ("_c", "_d", "_r")],
        F.bool_or("size_changed").alias("size_changed"), F.bool_or("metadata_changed").alias("metadata_changed"),
        F.max("last_usn").alias("last_usn"), *meta))


def read_changes(spark: SparkSession, path: str, schema: T.StructType = CHANGE_SCHEMA,
                 max_files: int = 100) -> DataFrame:
    """Streaming journal from Parquet files; the checkpoint keeps the cursor."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path))


def change_rates(changes: DataFrame, kind: str = "tumbling", size: str = "1 hour",
                 slide: str | None = None, gap: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    """Changes per volume in tumbling, sliding or session windows; a stream needs a watermark, by which its state expires."""
    if changes.isStreaming and not watermark:
        raise ValueError("a stream needs a watermark")
    rows = changes.withWatermark("ts", watermark) if watermark else changes
    if kind == "session":
        bucket = F.session_window("ts", gap)
    elif kind == "sliding":
        bucket = F.window("ts", size, slide or size)
    elif kind == "tumbling":
        bucket = F.window("ts", size)
    else:
        raise ValueError(f"unknown window kind: {kind!r}")
    grouped = rows.groupBy(bucket.alias("span"), "drive").agg(F.count("*").alias("changes"))
    return grouped.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"),
                          "drive", "changes")
