"""Reading and writing catalogs and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from arborlake.runtime import exists, materialize
from arborlake.schema import CATALOG_SCHEMA

# Columns of an exported listing that a comparison reads.
LISTING_SCHEMA = T.StructType([
    T.StructField("Path", T.StringType()),
    T.StructField("Size", T.LongType()),
    T.StructField("Size on Disk", T.LongType()),
    T.StructField("Descendants", T.LongType()),
    *[T.StructField(name, T.IntegerType()) for name in (
        "Directory Flag", "Hidden", "System", "Archive", "Read-only", "Compressed", "Encrypted",
        "Sparse", "Reparse")],
])

#: Column that holds a line which does not fit the schema.
CORRUPT = "_malformed_line"


def write_catalog(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save a catalog as Parquet, one folder per volume."""
    df.write.mode(mode).partitionBy("drive").parquet(path)


def read_catalog(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Load a catalog; a filter on ``drive`` reads only those volumes."""
    reader = spark.read.option("recursiveFileLookup", "false")
    return (reader.schema(schema) if schema else reader).parquet(path)


def write_bucketed(rows: DataFrame, directories: DataFrame, table: str, path: str, buckets: int) -> None:
    """Save rows and their directory table as ``table`` and ``table_dirs``, bucketed so
    that the join of rows to their parent needs no exchange.

    Worth it for a catalog whose paths are asked for often.
    """
    (rows.write.bucketBy(buckets, "drive", "parent_frs").sortBy("drive", "parent_frs")
     .option("path", f"{path}/rows").mode("overwrite").saveAsTable(table))
    (directories.write.bucketBy(buckets, "drive", "frs").sortBy("drive", "frs")
     .option("path", f"{path}/dirs").mode("overwrite").saveAsTable(f"{table}_dirs"))


def read_volumes(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Union of several volumes with their letter, and a report per volume.

    Volumes that cannot be opened are left out and named in the report; only
    when all fail is it an error.
    """
    opened: list[DataFrame] = []
    failed: list[tuple[str, str]] = []
    for drive, path in paths.items():
        if not exists(spark, path):
            failed.append((drive, f"no such path: {path}"))
            continue
        try:
            opened.append(spark.read.parquet(path).withColumn("drive", F.lit(drive)))
        except AnalysisException as error:
            failed.append((drive, str(error).splitlines()[0]))
    if not opened:
        raise RuntimeError(f"no volume could be read: {failed}")
    rows = union_volumes(opened)
    report = rows.groupBy("drive").agg(F.count("*").alias("records")).withColumn(
        "error", F.lit("").cast("string"))
    if failed:
        errors = spark.createDataFrame(failed, "drive string, error string")
        report = report.unionByName(
            errors.select("drive", F.lit(0).cast("bigint").alias("records"), "error"))
    return rows, report


def union_volumes(volumes: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), volumes)


def read_listing(spark: SparkSession, path: str, fmt: str = "csv",
                 schema: T.StructType = LISTING_SCHEMA, sep: str = ",", quote: str = '"') -> DataFrame:
    """Rows of an exported listing; lines that do not fit the schema are in :func:`malformed_lines`."""
    return (_listing(spark, path, fmt, schema, sep, quote).filter(F.col(CORRUPT).isNull()).drop(CORRUPT))


def malformed_lines(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = LISTING_SCHEMA,
                    sep: str = ",", quote: str = '"') -> DataFrame:
    """(line): the text of each line that :func:`read_listing` can't place in the schema."""
    # Written first: a parser that needs few columns checks those alone.
    rows = materialize(_listing(spark, path, fmt, schema, sep, quote), "listing")
    return rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def _listing(spark, path, fmt, schema, sep, quote) -> DataFrame:
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    full = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    reader = (spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if fmt == "json":
        return reader.json(path)
    # An escape equal to the quote keeps the backslashes of Windows paths.
    return (reader.option("header", True).option("sep", sep).option("quote", quote)
            .option("escape", quote).option("enforceSchema", True).csv(path))


def conform(df: DataFrame) -> DataFrame:
    """Missing catalog columns as NULL, types as in the catalog schema."""
    have = set(df.columns)
    return df.withColumns({
        f.name: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
        for f in CATALOG_SCHEMA})
