"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Lower-cases A-Z only, as the word definitions ask.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they can import what tasks name."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="arborlake-code-")
        archive = f"{folder}/arborlake.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for f in sorted((top / "arborlake").rglob("*.py")):
                out.write(f, f.relative_to(top))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would also change other letters)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_rows(batches, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches one by one; texts as UTF-8 bytes, so that no batch is held twice."""
    import pyarrow as pa

    for batch in batches:
        cols = []
        for name in columns:
            col = batch.column(name)
            cols.append(col.cast(pa.large_binary()) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col)
        for i in range(batch.num_rows):
            yield tuple(col[i].as_py() for col in cols)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_spans(df: DataFrame, column: str, n: int) -> list[tuple[int, int]]:
    """(least, largest) values of at most ``n`` even ranges of an integer column; equal values share a range.

    Reads this column alone. The list has an entry for each range that the caller asks for.
    """
    ranges = (df.select(column).filter(F.col(column).isNotNull()).repartitionByRange(n, column)
              .groupBy(F.spark_partition_id()).agg(F.min(column).alias("low"), F.max(column).alias("high")))
    return sorted((r.low, r.high) for r in ranges.collect())


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    return [low for low, _ in range_spans(df, column, n)]


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """Number of the range that holds ``value``, by binary search; nulls are in range 0."""
    if len(bounds) < 2:
        return F.lit(0)
    array = F.lit(bounds[1:])
    low = lambda s: s["low"]

    def halve(s, _):
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(array, mid) <= value
        return F.when(s["low"] >= s["high"], s).when(
            right, F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), mid.alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds) - 1).alias("high"))
    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halve, low))
