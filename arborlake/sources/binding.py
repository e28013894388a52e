"""Binding of order tables to the catalog schema.

Region, nation, customer, order and line item form a five-level tree: a volume
per region, directories for nations, customers and orders, and one file per
(order, line number).  Repeated line rows are further hard links of that file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.functions import derive
from arborlake.schema import CATALOG_SCHEMA, ROOT_FRS

_NATION_BASE, _CUSTOMER_BASE, _ORDER_BASE, _FILE_BASE = 1_000, 1_000_000, 100_000_000, 1_000_000_000
_SUFFIX = {"ECONOMY": ".pdf", "SMALL": ".txt", "PROMO": ".JPG", "MEDIUM": ".dll", "LARGE": ".mp4"}
_FLAGS = {"R": 34, "N": 33}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _choose(column, mapping: dict, default):
    chain = None
    for key, value in mapping.items():
        chain = (F if chain is None else chain).when(column == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    letter = F.substring(F.lit("CDEFG"), F.col("n_regionkey") + 1, F.lit(1))
    return table(spark, folder, "nation").select("n_nationkey", "n_name", letter.alias("drive"))


def _files(spark: SparkSession, folder: str, nations: DataFrame) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    lines = (table(spark, folder, "lineitem")
             .join(parts, F.col("l_partkey") == F.col("p_partkey"))
             .select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
                     "l_quantity", "l_shipdate", "l_returnflag", "p_name", "p_type"))
    # One exchange by order serves the grouping and the join with the orders, and keeps the grouping's sort
    # out of the tasks that sort for the join with the parts.
    leaf = (lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber")
            .agg(F.count("*").alias("link_count"),
                 F.sum("cents").alias("cents"),
                 F.sum("l_quantity").cast("bigint").alias("qty"),
                 F.max("l_shipdate").alias("modified"),
                 F.max("l_returnflag").alias("rf"),
                 F.min("p_name").alias("p_name"),
                 F.min("p_type").alias("p_type")))
    owners = (table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
              .join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"),
                    F.col("o_custkey") == F.col("c_custkey"))
              .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))
    size = F.when(F.col("qty") % 10 == 0, F.lit(0).cast("bigint")).otherwise(F.col("cents"))
    return leaf.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "drive",
        (F.lit(_FILE_BASE) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("frs"),
        (F.lit(_ORDER_BASE) + F.col("l_orderkey")).cast("bigint").alias("parent_frs"),
        F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("l_linenumber").cast("string"),
                 _choose(F.col("p_type"), _SUFFIX, "")).alias("name"),
        F.lit(False).alias("is_directory"),
        size.alias("size"),
        (size + (4096 - size % 4096) % 4096).alias("allocated_size"),
        F.col("o_orderdate").alias("created"), "modified", F.col("modified").alias("accessed"),
        F.col("link_count").cast("int").alias("link_count"),
        _choose(F.col("rf"), _FLAGS, 32).alias("flags"))


def _directories(spark: SparkSession, folder: str, nations: DataFrame) -> DataFrame:
    customers = (table(spark, folder, "customer")
                 .join(nations.select("n_nationkey", "drive"),
                       F.col("c_nationkey") == F.col("n_nationkey")))
    orders = (table(spark, folder, "orders").select("o_orderkey", "o_custkey")
              .join(customers.select("c_custkey", "drive"), F.col("o_custkey") == F.col("c_custkey")))

    def rows(df, frs, parent, name):
        return df.select("drive", frs.cast("bigint").alias("frs"),
                         parent.cast("bigint").alias("parent_frs"), name.alias("name"))

    root = F.lit(ROOT_FRS)
    dirs = (rows(nations.select("drive").distinct(), root, root, F.lit("."))
            .unionByName(rows(nations, F.lit(_NATION_BASE) + F.col("n_nationkey"), root, F.col("n_name")))
            .unionByName(rows(customers, F.lit(_CUSTOMER_BASE) + F.col("c_custkey"),
                              F.lit(_NATION_BASE) + F.col("c_nationkey"), F.col("c_name")))
            .unionByName(rows(orders, F.lit(_ORDER_BASE) + F.col("o_orderkey"),
                              F.lit(_CUSTOMER_BASE) + F.col("o_custkey"),
                              F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")))))
    unset = F.lit(None).cast("timestamp_ntz")
    zero = F.lit(0).cast("bigint")
    return dirs.select(
        "drive", "frs", "parent_frs", "name", F.lit(True).alias("is_directory"),
        zero.alias("size"), zero.alias("allocated_size"),
        unset.alias("created"), unset.alias("modified"), unset.alias("accessed"),
        F.lit(1).alias("link_count"), F.lit(16).alias("flags"))


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows of the order tables in ``folder``."""
    nations = _nations(spark, folder)
    rows = _files(spark, folder, nations).unionByName(_directories(spark, folder, nations))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CATALOG_SCHEMA])


def linked_catalog(catalog_df: DataFrame) -> DataFrame:
    """Catalog with hard links, named streams and stored name bytes.

    Link 0 keeps the file's name and directory; later links get a numbered name,
    every second one below the root.  Two thirds of the files carry streams, every
    13th record a name that ends in a lone surrogate.
    """
    link = F.struct(
        F.col("name").alias("name"), F.col("parent_frs").alias("parent_frs"),
        F.lit(3).alias("namespace"))

    def extra_link(i):
        return F.struct(
            F.concat(F.lit("link"), i.cast("string"), F.lit("_"), F.col("name")).alias("name"),
            F.when(i % 2 == 1, F.lit(ROOT_FRS).cast("bigint")).otherwise(F.col("parent_frs"))
            .alias("parent_frs"), F.lit(1).alias("namespace"))

    names = F.when(~F.col("is_directory"), F.concat(
        F.array(link),
        F.when(F.col("link_count") > 1,
               F.transform(F.sequence(F.lit(1), F.col("link_count") - 1), extra_link))
        .otherwise(F.array().cast("array<struct<name:string,parent_frs:bigint,namespace:int>>"))))

    def stream(name, size, allocated):
        return F.struct(
            F.lit(name).alias("name"), size.cast("bigint").alias("size"),
            allocated.cast("bigint").alias("allocated_size"), F.lit(False).alias("is_sparse"),
            F.lit(False).alias("is_compressed"), F.lit(True).alias("is_resident"))

    default = stream("", F.col("size"), F.col("allocated_size"))
    zone = stream("Zone.Identifier", 26 + F.col("frs") % 7, F.lit(0))
    internal = stream("$OBJECT_ID", F.lit(16), F.lit(0))
    kind = F.col("frs") % 3
    streams = (F.when(F.col("is_directory") | (kind == 0), F.array().cast(
        "array<struct<name:string,size:bigint,allocated_size:bigint,is_sparse:boolean,"
        "is_compressed:boolean,is_resident:boolean>>"))
        .when(kind == 1, F.array(default, zone))
        .otherwise(F.array(default, internal, zone)))
    raw = F.encode("name", "UTF-8")
    name_bytes = F.when(F.col("frs") % 13 == 0, F.concat(raw, F.unhex(F.lit("EDB3BF")))).otherwise(raw)
    return catalog_df.withColumns({
        "names": names, "streams": streams, "name_bytes": name_bytes,
        "stream_count": F.greatest(F.size(streams), F.lit(1))})


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change journal of the events table, ordered by ``usn``."""
    # Journal reason of each event type.
    reasons = {"signup": 0x100, "purchase": 0x2000, "error": 0x200, "click": 0x2, "view": 0x8000}
    return change_rows(table(spark, folder, "events"), reasons)


def change_rows(events: DataFrame, reasons: dict[str, int]) -> DataFrame:
    name = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.concat(
        F.lit("f_"), F.col("user_id").cast("string"), F.lit("_"),
        (F.col("event_id") % 7).cast("string"), F.lit(".txt")))
    return events.select(
        F.lit("C").alias("drive"), F.col("event_id").alias("usn"),
        F.col("user_id").alias("frs"), (5 + F.col("user_id") % 3).alias("parent_frs"),
        _choose(F.col("event_type"), reasons, 0).cast("bigint").alias("reason"),
        name.alias("name"), "ts")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files with contents, for duplicate verification."""
    return table(spark, folder, "documents").select(
        F.col("source").alias("drive"), F.col("doc_id").alias("frs"),
        F.lit(ROOT_FRS).cast("bigint").alias("parent_frs"),
        F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("name"),
        F.lit(False).alias("is_directory"), F.col("n_chars").alias("size"),
        F.col("n_chars").alias("allocated_size"), F.col("lang").alias("ext"),
        F.encode("text", "UTF-8").alias("content"))


def prepared(catalog_df: DataFrame) -> DataFrame:
    """Storage layout: extension stored, the rows of each task sorted, so that within
    a volume's files extension and name filters skip pages.

    Rows stay in the partitions they come in: every task writes its share of all
    volumes and extensions, and no exchange moves the whole catalog once more.
    """
    return derive.with_extension(catalog_df).sortWithinPartitions("drive", "ext", "name")
