"""Substring index over names, and skipping of volumes by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import derive, patterns, regexgrams
from arborlake.functions.categories import expand_extensions

SIZE = 3


def grams_of(name: Column | str, n: int = SIZE) -> Column:
    """Distinct n-character pieces of the folded name; empty for shorter names."""
    folded = derive.fold(name)
    last = F.char_length(folded) - (n - 1)
    pieces = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(folded, i, F.lit(n)))
    return F.array_distinct(F.when(last >= 1, pieces).otherwise(F.array().cast("array<string>")))


#: Ids in a block: a list of one name holds no more.
BLOCK_IDS = 1 << 20


def posting_lists(df: DataFrame, n: int = SIZE) -> DataFrame:
    """(gram, drive, ids) of every name, with the stored extension if there is one.

    Rows of one name in a volume, extension and block of ids are one list, so a name that occurs often is cut into grams,
    exchanged and sorted once a block.  Written in this order, range partitioned so that a frequent gram spreads over
    many files, a lookup reads only the row groups of its grams.
    """
    stored = ["ext"] if "ext" in df.columns else []
    block = F.call_function("div", F.col("frs"), F.lit(BLOCK_IDS)).alias("block")
    named = (df.filter(patterns.named(F.col("name"))).groupBy("drive", *stored, "name", block)
             .agg(F.collect_list("frs").alias("ids")))
    rows = named.select(F.explode(grams_of("name", n)).alias("gram"), "drive", "block", "ids", *stored)
    return (rows.repartitionByRange("gram", "drive", "block", F.get("ids", F.lit(0))).sortWithinPartitions("gram", "drive", "block")
            .drop("block"))


def postings(lists: DataFrame) -> DataFrame:
    """(gram, drive, frs) of posting lists; a filter on the gram still reaches their scan."""
    stored = ["ext"] if "ext" in lists.columns else []
    return lists.select("gram", "drive", F.explode("ids").alias("frs"), *stored)


def build_ngrams(df: DataFrame, n: int = SIZE) -> DataFrame:
    """(gram, drive, frs) of every name, with the stored extension if there is one."""
    return postings(posting_lists(df, n))


def gram_counts(grams: DataFrame) -> DataFrame:
    """(gram, postings): a small table by which look-ups choose their rarest grams."""
    return grams.groupBy("gram").agg(F.count("*").alias("postings"))


#: Parts of a conjunction that are looked up; the names of the survivors are tested anyway.
LOOKED_UP = 2
#: Places (volume, extension, range of ids) up to which survivors narrow the scan of the rows.
PLACES = 64


def indexed(df: DataFrame, grams: DataFrame, wanted: regexgrams.All, counts: DataFrame | None = None) -> DataFrame:
    """Rows whose names may satisfy the formula: of each conjunction the rarest grams are looked up.

    The survivors' volumes, extensions and id ranges become a filter on the scan, so only their row groups are read.
    """
    named = sorted(regexgrams.grams(wanted))  # as many as the pattern spells out
    counts = gram_counts(grams) if counts is None else counts
    known = {r.gram: r.postings for r in counts.filter(F.col("gram").isin(*named)).collect()}
    chosen = regexgrams.cheapest(wanted, lambda g: known.get(g, 0), LOOKED_UP)
    used = sorted(regexgrams.grams(chosen))
    if not regexgrams.holds(chosen, set(known)):
        return df.filter(F.lit(False))
    has = {g: F.col(f"_g{i}") for i, g in enumerate(used)}

    def condition(f) -> Column:
        if isinstance(f, str):
            return has[f]
        parts = [condition(p) for p in f.parts]
        return derive.all_of(parts) if isinstance(f, regexgrams.All) else derive.any_of(parts)

    stored = ["ext"] if "ext" in grams.columns and "ext" in df.columns else []
    flags = [F.max(F.col("gram") == g).alias(f"_g{i}") for i, g in enumerate(used)]
    hits = (grams.filter(F.col("gram").isin(*used)).groupBy("drive", "frs", *stored).agg(*flags)
            .filter(condition(chosen)).select("drive", "frs", *stored))
    places = hits.groupBy("drive", *stored).agg(F.min("frs").alias("low"), F.max("frs").alias("high")).limit(PLACES + 1).collect()
    if len(places) <= PLACES:
        near = F.lit(False)
        for r in places:
            here = (F.col("drive") == r.drive) & F.col("frs").between(r.low, r.high)
            near = near | (here & (F.col("ext") == r.ext) if stored else here)
        df = df.filter(near)
    return df.join(hits.select("drive", "frs"), ["drive", "frs"], "left_semi")


def ngram_search(df: DataFrame, grams: DataFrame, needle: str, n: int = SIZE, counts: DataFrame | None = None) -> DataFrame:
    """Rows whose name contains ``needle``: index lookup, then a test of the name.

    Shorter needles scan the names.
    """
    wanted = needle.upper()
    contains = patterns.named(F.col("name")) & derive.fold("name").contains(wanted)
    pieces = frozenset(wanted[i:i + n] for i in range(len(wanted) - n + 1))
    return indexed(df, grams, regexgrams.All(pieces), counts).filter(contains) if pieces else df.filter(contains)


def regex_search(df: DataFrame, grams: DataFrame, expression: str, case_sensitive: bool = False, n: int = SIZE,
                 counts: DataFrame | None = None) -> DataFrame:
    """Rows whose name has a match of ``expression``: what it requires is looked up, the survivors are tested.

    An expression from which nothing is sure scans the names.
    """
    test = patterns.named(F.col("name")) & patterns.regex(F.col("name"), expression, case_sensitive)
    wanted = regexgrams.formula(expression, n)
    return df.filter(test) if wanted == regexgrams.NOTHING_SURE else indexed(df, grams, wanted, counts).filter(test)


def volume_summary(df: DataFrame) -> DataFrame:
    """(drive, ext) that occur: one small row per volume and extension."""
    return df.select("drive", derive.field_column(df, "extension").alias("ext")).distinct()


def prune_volumes(df: DataFrame, summary: DataFrame, extensions) -> DataFrame:
    """Rows of the wanted extensions, volumes without any of them left unread.

    The semi-join is on the partition column, so the volumes are pruned at run
    time before their files are opened.
    """
    wanted = expand_extensions(extensions)
    able = summary.filter(F.col("ext").isin(*wanted)).select("drive").distinct()
    return (df.join(able, "drive", "left_semi")
            .filter(derive.field_column(df, "extension").isin(*wanted)))
