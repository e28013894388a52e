"""Duplicate candidates and their verification by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborlake.functions import derive
from arborlake.operators.aggregate import top_hits
from arborlake.operators.hierarchy import Directories
from arborlake.runtime import materialize, running_totals
from arborlake.schema import field

KEY_FIELDS = ("size", "size_on_disk", "extension", "modified", "created", "name")


def _keyed(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    names = [field(k).name for k in keys]
    wrong = [n for n in names if n not in KEY_FIELDS]
    if wrong:
        raise ValueError(f"not a duplicate key: {wrong}")
    columns = {f"k_{n}": F.lower("name") if n == "name" else derive.field_column(df, n) for n in names}
    files = df.filter(~F.col("is_directory") & (F.col("size") > 0))
    return files.withColumns(columns), list(columns)


def groups(df: DataFrame, keys=("size", "name")) -> DataFrame:
    """All groups of more than one non-empty file with an equal key.

    Counts combine before the exchange, so a group of a third of all files is
    one partial row per task.
    """
    keyed, cols = _keyed(df, keys)
    grouped = keyed.groupBy(*cols).agg(F.count("*").alias("count"), F.sum("size").alias("total_bytes"))
    file_size = F.call_function("div", F.col("total_bytes"), F.col("count"))
    return (grouped.filter(F.col("count") > 1)
            .withColumn("file_size", file_size)
            .withColumn("reclaimable_bytes", F.col("total_bytes") - F.col("file_size")))


def duplicates(df: DataFrame, keys=("size", "name"), top: int = 100, sample: int = 0,
               dirs: Directories | None = None) -> DataFrame:
    """Top groups by reclaimable bytes, with up to ``sample`` members each."""
    keyed, cols = _keyed(df, keys)
    first = groups(df, keys).orderBy(F.col("reclaimable_bytes").desc(), *cols).limit(top)
    if not sample:
        return first
    hits = top_hits(keyed, first.select(*cols), cols, sample, dirs=dirs)
    return first.join(hits, cols, "left")


def summary(group_table: DataFrame) -> DataFrame:
    """Groups, files, bytes and reclaimable bytes of a group table."""
    zero = F.lit(0).cast("bigint")
    return group_table.agg(
        F.count("*").alias("candidate_groups"),
        F.coalesce(F.sum("count"), zero).alias("candidate_files"),
        F.coalesce(F.sum("total_bytes"), zero).alias("duplicate_bytes"),
        F.coalesce(F.sum("reclaimable_bytes"), zero).alias("reclaimable_bytes"))


def members(df: DataFrame, group_table: DataFrame, keys=("size", "name")) -> DataFrame:
    """Rows of the candidate groups."""
    keyed, cols = _keyed(df, keys)
    return keyed.join(group_table.select(*cols), cols, "left_semi")


def _within_budget(table: DataFrame, cols: list[str], max_bytes: int, max_files: int) -> DataFrame:
    """Flag ``affordable``: groups read in order of reclaimable bytes while they fit.

    A group that does not fit is passed over and later, smaller ones may still
    be read, as a one-by-one reader would do.  Each round takes the longest
    fitting run with distributed running totals; a group above what is left can
    never fit again, so rounds end when no candidate does.
    """
    order = [F.col("reclaimable_bytes").desc(), *[F.col(c) for c in cols]]
    rest = running_totals(table, order, {"_seq": F.lit(1).cast("bigint")})
    rest = materialize(rest, "budget")
    base = rest
    taken = None
    left_bytes = max_bytes or None
    left_files = max_files or None
    while True:
        fits = F.lit(True)
        if left_bytes is not None:
            fits = fits & (F.col("estimate") <= left_bytes)
        if left_files is not None:
            fits = fits & (F.col("count") <= left_files)
        candidates = rest.filter(fits)
        totals = materialize(running_totals(
            candidates, [F.col("_seq")], {"_bytes": F.col("estimate"), "_files": F.col("count")}), "budget")
        run = F.lit(True)
        if left_bytes is not None:
            run = run & (F.col("_bytes") <= left_bytes)
        if left_files is not None:
            # A group starts as long as one file is left, and must end within the limit.
            run = run & (F.col("_files") <= left_files)
        chosen = totals.filter(run)
        end = chosen.agg(F.max("_seq").alias("seq"), F.max("_bytes").alias("bytes"),
                         F.max("_files").alias("files")).first()
        if end["seq"] is not None:
            part = chosen.select("_seq")
            taken = part if taken is None else taken.unionByName(part)
            left_bytes = None if left_bytes is None else left_bytes - end["bytes"]
            left_files = None if left_files is None else left_files - end["files"]
        blocked = totals.filter(~run).agg(F.min("_seq").alias("seq")).first()["seq"]
        if blocked is None or left_bytes == 0 or left_files == 0:
            break
        rest = rest.filter(F.col("_seq") > blocked)
    if taken is None:
        return base.withColumn("affordable", F.lit(False)).drop("_seq")
    flagged = base.join(taken.withColumn("affordable", F.lit(True)), "_seq", "left")
    return flagged.withColumn("affordable", F.coalesce("affordable", F.lit(False))).drop("_seq")


def verify(group_table: DataFrame, member_rows: DataFrame, contents: DataFrame, keys=("size", "name"),
           mode: str = "sha256", n_bytes: int = 4096, max_bytes: int = 0,
           max_files: int = 0) -> DataFrame:
    """Candidate groups with an ``outcome``: verified, rejected, errored or skipped.

    Contents are (drive, frs, content).  Each file is reduced to one digest where
    it lies, so only digests of fixed length are exchanged, never file bodies.  A
    group agrees when its least and greatest digest are equal, which combines
    before the exchange.
    """
    if mode not in ("none", "first_bytes", "sha256"):
        raise ValueError(f"unknown verification mode: {mode!r}")
    cols = [f"k_{field(k).name}" for k in keys]
    if mode == "none":
        return group_table.withColumn("outcome", F.lit("verified"))
    per_file = F.col("file_size") if mode == "sha256" else F.least(F.col("file_size"), F.lit(n_bytes))
    table = group_table.withColumn("estimate", per_file * F.col("count"))
    if max_bytes or max_files:
        table = _within_budget(table, cols, max_bytes, max_files)
    else:
        table = table.withColumn("affordable", F.lit(True))
    body = F.col("content") if mode == "sha256" else F.substring("content", 1, n_bytes)
    readable = table.filter("affordable").select(*cols)
    wanted = member_rows.join(readable, cols, "left_semi").select("drive", "frs", *cols)
    if max_bytes or max_files:
        # The budget bounds what is read: other bodies are left out before any is hashed.
        wanted = materialize(wanted, "wanted")
        contents = contents.join(wanted.select("drive", "frs").distinct(), ["drive", "frs"], "left_semi")
    digests = contents.select("drive", "frs", F.sha2(body, 256).alias("digest"))
    read = wanted.join(digests, ["drive", "frs"], "left")
    seen = read.groupBy(*cols).agg(
        F.min("digest").alias("low"), F.max("digest").alias("high"),
        F.count_if(F.col("digest").isNull()).alias("unreadable"))
    outcome = (F.when(~F.col("affordable"), F.lit("skipped"))
               .when(F.col("low") != F.col("high"), F.lit("rejected"))
               .when(F.col("unreadable") > 0, F.lit("errored"))
               .otherwise(F.lit("verified")))
    return (table.join(seen, cols, "left").withColumn("outcome", outcome)
            .drop("low", "high", "unreadable", "affordable"))


def verification_summary(verified: DataFrame) -> DataFrame:
    """Number of groups per outcome, what remains after rejection, what was read, and whether a budget cut it short."""
    kept, read = F.col("outcome") != "rejected", F.col("outcome") != "skipped"
    estimate = F.col("estimate") if "estimate" in verified.columns else F.lit(0)
    files = F.col("count") if "estimate" in verified.columns else F.lit(0)
    total = lambda c: F.coalesce(F.sum(F.when(read, c)), F.lit(0)).cast("bigint")

    def number(outcome: str):
        return F.count_if(F.col("outcome") == outcome)

    return verified.agg(
        number("verified").alias("groups_verified"), number("rejected").alias("groups_rejected"),
        number("skipped").alias("groups_skipped"), number("errored").alias("groups_errored"),
        F.coalesce(F.sum(F.when(kept, F.col("reclaimable_bytes"))), F.lit(0)).alias("reclaimable_bytes"),
        total(estimate).alias("bytes_read"), total(files).alias("files_read"),
        (F.count_if(~read) > 0).alias("budget_exhausted"))
