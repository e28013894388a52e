"""Session settings, shared scratch tables and distributed running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "arborlake", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    session may fall back to a temporary folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="arborlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/arborlake/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative work, survives lost executors, and gives the
    planner real table sizes, so a broadcast is chosen only under its limit.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*df.columns)


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path) of the storage behind ``path``."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = hadoop_fs(spark, path)
    return fs.exists(jpath)


def drop_written(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` wrote and nothing reads any more; others stay."""
    root = scratch_root(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, jpath = hadoop_fs(df.sparkSession, folder)
        if jpath.toUri().getPath().startswith(hadoop_fs(df.sparkSession, root)[1].toUri().getPath() + "/"):
            fs.delete(jpath, True)


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column],
                   partitions: int | None = None, fold=F.sum) -> DataFrame:
    """Add running totals over a total order without one task seeing all rows; ``fold`` is F.sum or F.max.

    ``order`` must be a total order (end it with a unique key).  Rows are range
    partitioned, summed per partition, and each partition starts from the sum of
    those before it; only one row per partition is ever brought together.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v_{name}": col for name, col in totals.items()}
    ranged = (df.withColumns(values)
              .repartitionByRange(n, *order)
              .withColumn("_part", F.spark_partition_id()))
    ranged = materialize(ranged, "ranged")
    per_part = ranged.groupBy("_part").agg(*[fold(v).alias(v) for v in values])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    adds = fold is F.sum
    starts = per_part.select("_part", *[
        (F.coalesce(fold(v).over(before), F.lit(0)) if adds else fold(v).over(before)).alias(f"_s{v}") for v in values])
    inside = (W.partitionBy("_part").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    # One row per range partition: the table is as small as the partition count.
    joined = ranged.join(F.broadcast(starts), "_part")
    plus = (lambda a, b: a + b) if adds else F.greatest
    out = joined.withColumns({
        name: plus(fold(f"_v_{name}").over(inside), F.col(f"_s_v_{name}")) for name in totals})
    return out.drop("_part", *values, *[f"_s{v}" for v in values])
