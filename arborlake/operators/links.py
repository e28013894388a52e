"""Hard links, named streams and continuation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import derive
from arborlake.operators import hierarchy as h
from arborlake.operators.hierarchy import Directories, KEY

# Reparse tag and stream name of overlay-compressed files.
OVERLAY_TAG = -2147483625            # 0x80000017 as a signed 32-bit number
OVERLAY_STREAM = "WofCompressedData"


def is_internal_stream(name: Column) -> Column:
    """'$' and an upper-case ASCII letter: streams of the file system itself."""
    return name.rlike("^\\$[A-Z]")


def _names(df: DataFrame) -> Column:
    own = F.array(F.struct(F.col("name").alias("name"), F.col("parent_frs").alias("parent_frs"),
                           F.lit(3).alias("namespace")))
    return F.when(F.size(F.coalesce(F.col("names"), F.array().cast(_type(df, "names")))) > 0,
                  F.col("names")).otherwise(own)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _streams(df: DataFrame) -> Column:
    own = F.array(F.struct(
        F.lit("").alias("name"), F.col("size").alias("size"),
        F.col("allocated_size").alias("allocated_size"), F.lit(False).alias("is_sparse"),
        F.lit(False).alias("is_compressed"), F.lit(False).alias("is_resident")))
    return F.when(F.size(F.coalesce(F.col("streams"), F.array().cast(_type(df, "streams")))) > 0,
                  F.col("streams")).otherwise(own)


def expand_links(df: DataFrame, legacy_dir_names: bool = False) -> DataFrame:
    """One row per (hard link x named stream), internal streams left out.

    A record without names or streams yields its own name and default stream; a
    named stream shows its own sizes.  Both explodes happen in place, without an
    exchange.
    """
    kept = F.filter(_streams(df), lambda s: ~is_internal_stream(s["name"]))
    rows = (df.withColumns({"_names": _names(df), "_streams": kept})
            .select("*", F.posexplode("_names").alias("link_index", "_link"))
            .select("*", F.explode("_streams").alias("_stream")))
    default = F.col("_stream")["name"] == ""
    name = F.col("_link")["name"]
    if legacy_dir_names:
        name = F.when(F.col("is_directory"), F.lit("")).otherwise(name)
    return rows.withColumns({
        "name": name, "parent_frs": F.col("_link")["parent_frs"],
        "stream_name": F.col("_stream")["name"],
        "size": F.when(default, F.col("size")).otherwise(F.col("_stream")["size"]),
        "allocated_size": F.when(default, F.col("allocated_size")).otherwise(
            F.col("_stream")["allocated_size"]),
        "link_count": F.lit(1), "stream_count": F.lit(1),
    }).drop("names", "streams", "_names", "_streams", "_link", "_stream")


def paths_per_link(df: DataFrame, dirs: Directories) -> DataFrame:
    """Every link and stream with its own path, streams as ``file:stream``."""
    rows = h.with_paths(expand_links(df), dirs)
    suffix = F.when(F.col("stream_name") == "", F.lit("")).otherwise(F.concat(F.lit(":"), "stream_name"))
    return rows.withColumn("path", F.concat("path", suffix))


def link_share(value: Column | str, i: Column, n: Column) -> Column:
    return derive.link_share(value, i, n)


def _overlay_allocated(df: DataFrame) -> Column:
    """Allocated size of the overlay stream, counted with the default stream."""
    if "reparse_tag" not in df.columns:
        return F.lit(0).cast("bigint")
    overlay = F.filter("streams", lambda s: s["name"] == OVERLAY_STREAM)
    return F.when(F.col("reparse_tag") == OVERLAY_TAG,
                  F.coalesce(F.try_element_at(overlay, F.lit(1))["allocated_size"], F.lit(0))).otherwise(
        F.lit(0).cast("bigint"))


def tree_sums_by_stream(df: DataFrame, dirs: Directories) -> DataFrame:
    """Per directory: streams below plus one, and link-shared sizes.

    Each link of a file passes its share of every stream to its own directory;
    a directory's streams count for the directories above it, and its default
    stream for itself.
    """
    extra = F.filter(F.coalesce(F.col("streams"), F.array().cast(_type(df, "streams"))),
                     lambda s: s["name"] != "")
    merged = _overlay_allocated(df)
    if "reparse_tag" in df.columns:
        tagged = F.col("reparse_tag") == OVERLAY_TAG
        extra = F.filter(extra, lambda s: ~(F.coalesce(tagged, F.lit(False)) & (s["name"] == OVERLAY_STREAM)))
    rows = df.withColumns({
        "_extra": extra, "_alloc": F.col("allocated_size") + merged,
        "_count": F.greatest(F.coalesce(F.size("streams"), F.lit(1)), F.lit(1)), "_names": _names(df)})

    def shared(own: Column, part: str, i: Column, n: Column) -> Column:
        return derive.link_share(own, i, n) + F.aggregate(
            "_extra", F.lit(0).cast("bigint"),
            lambda acc, s: acc + derive.link_share(s[part], i, n))

    files = rows.filter(~F.col("is_directory")).select(
        "*", F.posexplode("_names").alias("_pos", "_link"))
    n = F.size("_names")
    i = n - 1 - F.col("_pos")
    per_dir = files.select(
        "drive", F.col("_link")["parent_frs"].alias("frs"), F.col("_count").alias("s_count"),
        shared(F.col("size"), "size", i, n).alias("s_size"),
        shared(F.col("_alloc"), "allocated_size", i, n).alias("s_alloc"),
    ).groupBy(*KEY).agg(F.sum("s_count").alias("f_n"), F.sum("s_size").alias("f_size"),
                        F.sum("s_alloc").alias("f_alloc"))
    one = F.lit(1)
    own = rows.filter("is_directory").select(
        "drive", "frs", F.col("_count").alias("d_n"),
        shared(F.col("size"), "size", one, one).alias("d_size"),
        shared(F.col("_alloc"), "allocated_size", one, one).alias("d_alloc"),
        F.col("size").alias("first_size"), F.col("_alloc").alias("first_alloc"))
    zero = F.lit(0).cast("bigint")
    local = (dirs.table.select("drive", "frs", "chain").join(own, KEY, "left").join(per_dir, KEY, "left")
             .na.fill(0, ["d_n", "d_size", "d_alloc", "first_size", "first_alloc", "f_n", "f_size", "f_alloc"]))
    pairs = local.select("*", F.explode("chain").alias("anc"))
    above = F.col("anc") != F.col("frs")

    def passed(files_part: str, dir_part: str) -> Column:
        return F.sum(F.col(files_part) + F.when(above, F.col(dir_part)).otherwise(zero))

    sums = pairs.groupBy("drive", F.col("anc").alias("frs")).agg(
        (passed("f_n", "d_n") + 1).alias("descendants"),
        passed("f_size", "d_size").alias("_size"), passed("f_alloc", "d_alloc").alias("_allocated"))
    firsts = own.select("drive", "frs", "first_size", "first_alloc")
    return sums.join(firsts, KEY, "left").select(
        "drive", "frs", "descendants",
        (F.col("_size") + F.coalesce("first_size", zero)).alias("treesize"),
        (F.col("_allocated") + F.coalesce("first_alloc", zero)).alias("tree_allocated"))


def merge_continuations(base: DataFrame, ext: DataFrame) -> DataFrame:
    """Fold continuation rows into their base records.

    ``ext`` has (drive, frs, base_frs, names, streams).  Names are appended in
    order of their source record.  Internal streams stay one by one; equal data
    streams add their sizes.  The default stream gives the record's sizes, and a
    record without a name takes the last Win32 name.  Records left without a name
    are dropped.
    """
    link_fields = ["name", "parent_frs", "namespace"]

    def links(df: DataFrame, owner: str) -> DataFrame:
        return (df.select("drive", F.col(owner).alias("owner"), F.col("frs").alias("source"),
                          F.posexplode("names").alias("pos", "link"))
                .select("drive", "owner", F.struct(
                    "source", "pos", *[F.col("link")[c].alias(c) for c in link_fields]).alias("link")))

    extended = ext.select("drive", F.col("base_frs").alias("owner")).distinct()
    touched = base.join(extended.withColumnRenamed("owner", "frs"), KEY, "left_semi")
    untouched = base.join(extended.withColumnRenamed("owner", "frs"), KEY, "left_anti")
    # The links of one record fit its array cell by nature.
    names = (links(touched, "frs").unionByName(links(ext, "base_frs"))
             .groupBy("drive", F.col("owner").alias("frs"))
             .agg(F.array_sort(F.collect_list("link")).alias("_links")))

    def streams(df: DataFrame, owner: str) -> DataFrame:
        return (df.select("drive", F.col(owner).alias("owner"), F.col("frs").alias("source"),
                          F.posexplode("streams").alias("pos", "s"))
                .select("drive", "owner", "source", "pos", "s.*"))

    every = streams(touched, "frs").unionByName(streams(ext, "base_frs"))
    single = is_internal_stream(F.col("name"))
    merged = every.groupBy(
        "drive", "owner", "name",
        F.when(single, F.col("source")).otherwise(F.lit(-1)).alias("one"),
        F.when(single, F.col("pos")).otherwise(F.lit(-1)).alias("at")).agg(
            F.min("source").alias("source"), F.sum("size").alias("size"),
            F.sum("allocated_size").alias("allocated_size"), F.bool_or("is_sparse").alias("is_sparse"),
            F.bool_or("is_compressed").alias("is_compressed"), F.bool_and("is_resident").alias("is_resident"))
    stream = F.struct("name", "size", "allocated_size", "is_sparse", "is_compressed", "is_resident")
    stream_lists = merged.groupBy("drive", F.col("owner").alias("frs")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source", "at", stream.alias("s")))),
                    lambda x: x["s"]).alias("_streams"))
    joined = touched.join(names, KEY, "left").join(stream_lists, KEY, "left")
    default = F.try_element_at(F.filter("_streams", lambda s: s["name"] == ""), F.lit(1))
    win32 = F.filter("_links", lambda x: x["namespace"].isin(1, 3))
    best = F.coalesce(F.try_element_at(win32, F.lit(-1)), F.try_element_at("_links", F.lit(1)))
    nameless = F.coalesce(F.col("name"), F.lit("")) == ""
    folded = joined.withColumns({
        "size": F.coalesce(default["size"], F.col("size")),
        "allocated_size": F.coalesce(default["allocated_size"], F.col("allocated_size")),
        "parent_frs": F.when(nameless, best["parent_frs"]).otherwise(F.col("parent_frs")),
        "name": F.when(nameless, best["name"]).otherwise(F.col("name")),
        "names": F.transform("_links", lambda x: F.struct(*[x[c].alias(c) for c in link_fields])),
        "streams": F.col("_streams"),
    }).select(*base.columns)
    return untouched.unionByName(folded).filter(F.coalesce(F.col("name"), F.lit("")) != "")
