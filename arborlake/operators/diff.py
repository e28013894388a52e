"""Comparison of two listings and of two record tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborlake.functions.derive import is_ads_path, normalize_path

NUMERIC_FIELDS = ("size", "allocated_size", "descendants", "treesize", "tree_allocated")
FLAG_FIELDS = ("is_directory", "is_hidden", "is_system", "is_archive", "is_readonly",
               "is_compressed", "is_encrypted", "is_sparse", "is_reparse")
SAMPLES_PER_FIELD = 10
# Names of listing columns and of the fields they hold.
LISTING_FIELDS = {
    "Size": "size", "Size on Disk": "allocated_size", "Descendants": "descendants",
    "Directory Flag": "is_directory", "Hidden": "is_hidden", "System": "is_system",
    "Archive": "is_archive", "Read-only": "is_readonly", "Compressed": "is_compressed",
    "Encrypted": "is_encrypted", "Sparse": "is_sparse", "Reparse": "is_reparse",
}


def from_listing(listing: DataFrame) -> DataFrame:
    """Listing columns renamed to fields, flags as booleans."""
    columns = [F.col("Path").alias("path")]
    for shown, name in LISTING_FIELDS.items():
        if shown in listing.columns:
            value = F.col(f"`{shown}`")
            columns.append((value.cast("int") != 0 if name in FLAG_FIELDS else value.cast("bigint")).alias(name))
    return listing.select(*columns)


def _sided(df: DataFrame, fields: list[str], side: str) -> DataFrame:
    """Normalised paths with the fields as a struct in the column of their side."""
    values = F.struct(*[(F.col(f) if f in df.columns else F.lit(None).cast("bigint")).alias(f) for f in fields] or [F.lit(True)])
    return df.select(normalize_path("path").alias("path_norm"), values.alias(side))


def matched(left: DataFrame, right: DataFrame, fields=None) -> DataFrame:
    """Full outer join of two listings on the normalised path: (path_norm, l, r); of equal paths of a side the greatest row stays."""
    fields = list(fields or [f for f in (*NUMERIC_FIELDS, *FLAG_FIELDS)
                             if f in left.columns or f in right.columns])
    both = _sided(left, fields, "l").unionByName(_sided(right, fields, "r"), allowMissingColumns=True)
    # Paths of both sides meet in one exchange and are sorted after it only. Rows without a path match nothing.
    unmatched = F.when(F.col("path_norm").isNull(), F.col("l").isNotNull()).alias("_side")
    return (both.repartition("path_norm").groupBy("path_norm", unmatched).agg(F.max("l").alias("l"), F.max("r").alias("r"))
            .drop("_side"))


def summary(pairs: DataFrame) -> DataFrame:
    """Common and one-sided path counts, match rate and named-stream counts."""
    has_l, has_r = F.col("l").isNotNull(), F.col("r").isNotNull()
    common = F.count_if(has_l & has_r)
    total = F.count_if(has_l)
    ads = is_ads_path("path_norm")
    return pairs.agg(
        common.alias("common_paths"), F.count_if(has_l & ~has_r).alias("left_only"),
        F.count_if(~has_l & has_r).alias("right_only"),
        F.when(total == 0, F.lit(0.0)).otherwise(common * 100.0 / total).alias("match_rate"),
        F.count_if(has_l & ads).alias("left_ads"), F.count_if(has_r & ads).alias("right_ads"))


def field_stats(pairs: DataFrame) -> DataFrame:
    """Per field over common paths: compared, matches, mismatches, one-sided
    values, sum and maximum of absolute differences.

    All fields are counted in one pass; only the one-row result is unpivoted.
    """
    fields = pairs.schema["l"].dataType.fieldNames()
    both = pairs.filter(F.col("l").isNotNull() & F.col("r").isNotNull())
    names = ("total_compared", "exact_matches", "mismatches", "left_values_only", "right_values_only",
             "sum_abs_diff", "max_abs_diff")
    parts: list[Column] = []
    for f in fields:
        a, b = F.col("l")[f], F.col("r")[f]
        known = a.isNotNull() & b.isNotNull()
        numeric = f in NUMERIC_FIELDS
        gap = F.when(known & (a != b), F.abs(a - b)) if numeric else F.lit(0).cast("bigint")
        parts.append(F.struct(
            F.lit(f).alias("field"), F.count_if(known).alias(names[0]),
            F.count_if(known & (a == b)).alias(names[1]), F.count_if(known & (a != b)).alias(names[2]),
            F.count_if(a.isNotNull() & b.isNull()).alias(names[3]),
            F.count_if(a.isNull() & b.isNotNull()).alias(names[4]),
            F.coalesce(F.sum(gap), F.lit(0)).cast("bigint").alias(names[5]),
            F.coalesce(F.max(gap), F.lit(0)).cast("bigint").alias(names[6])).alias(f))
    wide = both.agg(*parts)
    return wide.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("s")).select("s.*")


def field_samples(pairs: DataFrame, per_field: int = SAMPLES_PER_FIELD) -> DataFrame:
    """Up to ``per_field`` differing values of each field, by path."""
    fields = pairs.schema["l"].dataType.fieldNames()
    entries = [F.struct(F.lit(f).alias("field"), F.col("l")[f].cast("string").alias("left_value"),
                        F.col("r")[f].cast("string").alias("right_value")) for f in fields]
    differing = F.filter(F.array(*entries), lambda e: e["left_value"] != e["right_value"])
    rows = (pairs.filter(F.col("l").isNotNull() & F.col("r").isNotNull())
            .select("path_norm", F.explode(differing).alias("e")).select("path_norm", "e.*"))
    rank = F.row_number().over(W.partitionBy("field").orderBy("path_norm"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= per_field)


def path_samples(pairs: DataFrame, per_side: int = 20) -> DataFrame:
    """First paths found on one side only."""
    left_only = pairs.filter(F.col("r").isNull()).select(F.lit("left").alias("side"), "path_norm")
    right_only = pairs.filter(F.col("l").isNull()).select(F.lit("right").alias("side"), "path_norm")
    return (left_only.orderBy("path_norm").limit(per_side)
            .unionByName(right_only.orderBy("path_norm").limit(per_side)))


def diff(left: DataFrame, right: DataFrame, fields=None) -> dict[str, DataFrame]:
    pairs = matched(left, right, fields)
    return {"summary": summary(pairs), "fields": field_stats(pairs),
            "samples": field_samples(pairs), "paths": path_samples(pairs)}


def paths(df: DataFrame) -> DataFrame:
    return df.select(normalize_path("path").alias("path_norm")).distinct()


def common_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    return matched_sides(left, right).filter("in_left and in_right").select("path_norm")


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of ``left`` without a row in ``right``; rows without a path match nothing."""
    alone = F.col("in_left") & (~F.col("in_right") | F.col("path_norm").isNull())
    return matched_sides(left, right).filter(alone).select("path_norm")


def _parent(path: Column) -> Column:
    tail = F.substring_index(path, "/", -1)
    return F.when(path.contains("/"),
                  F.substring(path, F.lit(1), F.char_length(path) - F.char_length(tail) - 1))


def missing_by_drive(left: DataFrame, right: DataFrame) -> DataFrame:
    drive = F.substring("path_norm", 1, 1)
    return (only_in(left, right).groupBy(drive.alias("drive")).agg(F.count("*").alias("missing"))
            .filter(F.col("drive").rlike("^[a-z]$")))


def missing_by_parent(left: DataFrame, right: DataFrame, top: int = 20) -> DataFrame:
    """Directories that miss the most paths."""
    return (only_in(left, right).select(_parent(F.col("path_norm")).alias("parent"))
            .filter(F.col("parent").isNotNull())
            .groupBy("parent").agg(F.count("*").alias("missing"))
            .orderBy(F.col("missing").desc(), "parent").limit(top))


def diff_breakdown(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts that explain the differences, one row."""
    sides = matched_sides(left, right)
    leaf = F.substring_index("path_norm", "/", -1)
    in_l, in_r = F.col("in_left"), F.col("in_right")
    path = F.col("path_norm")
    short = F.octet_length(path) < 10
    dot = path.endswith("/.")
    ads = is_ads_path(path)
    return sides.agg(
        F.count_if(in_l & ~in_r & leaf.startswith("$")).alias("missing_system"),
        F.count_if(in_r & path.contains("<unknown")).alias("right_unknown"),
        F.count_if(in_l & short).alias("left_short"), F.count_if(in_r & short).alias("right_short"),
        F.count_if(in_l & dot).alias("left_dot"), F.count_if(in_r & dot).alias("right_dot"),
        F.count_if(in_l & ads).alias("left_ads"), F.count_if(in_r & ads).alias("right_ads"),
        F.count_if(in_l & ~in_r & ads).alias("left_only_ads"),
        F.count_if(~in_l & in_r & ads).alias("right_only_ads"))


def matched_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path_norm, in_left, in_right) by one grouped union."""
    tagged = [df.select(normalize_path("path").alias("path_norm"), F.lit(side).alias("in_left"),
                        F.lit(not side).alias("in_right"))
              for df, side in ((left, True), (right, False))]
    # Grouped after the exchange only: few paths of a listing repeat.
    return tagged[0].unionByName(tagged[1]).repartition("path_norm").groupBy("path_norm").agg(
        F.bool_or("in_left").alias("in_left"), F.bool_or("in_right").alias("in_right"))


def missing_parent_dirs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Number of parent directories seen on the left only."""
    def parents(df):
        return df.select(_parent(normalize_path("path")).alias("parent")).filter("parent is not null").distinct()

    return parents(left).join(parents(right), "parent", "left_anti").agg(F.count("*").alias("missing_parents"))


def column_differences(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    a, b = left.columns, right.columns
    return {"left_only": [c for c in a if c not in b], "right_only": [c for c in b if c not in a],
            "common": [c for c in a if c in b]}


def crosscheck(left: DataFrame, right: DataFrame, keys: list[str], flags: dict[str, tuple[str, str]],
               focus: DataFrame | None = None) -> DataFrame:
    """Agreement counts of flag pairs between two record tables.

    ``flags`` maps a label to (left column, right column); ``focus`` limits the
    check to some keys.
    """
    if focus is not None:
        left = left.join(focus.select(*keys).distinct(), keys, "left_semi")
    wanted_l = [F.col(a).alias(f"_l_{label}") for label, (a, _) in flags.items()]
    wanted_r = [F.col(b).alias(f"_r_{label}") for label, (_, b) in flags.items()]
    pairs = left.select(*keys, *wanted_l).join(right.select(*keys, *wanted_r), keys)
    entries = [F.struct(F.lit(label).alias("flag"), F.col(f"_l_{label}").alias("left_value"),
                        F.col(f"_r_{label}").alias("right_value")) for label in flags]
    return (pairs.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
            .groupBy("flag", "left_value", "right_value").agg(F.count("*").alias("rows")))
