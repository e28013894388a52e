"""Paths, closures and subtree measures over the parent links.

Only directories take part in the iterative work.  A *directory table* holds for
each directory its full path and the chain of ids from the root down to itself;
everything else is one join or one grouped sum against that table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from arborlake.functions import derive
from arborlake.operators import contraction, intervals
from arborlake.runtime import materialize
from arborlake.schema import LAST_RESERVED_FRS, ROOT_FRS, ROOT_IDS

KEY = ["drive", "frs"]
#: Stands for a NULL parent in the directory table; record ids are not negative.
NO_PARENT = -1
OK, BROKEN, CYCLIC, LOST, OPEN = "ok", "broken", "cyclic", "lost", "open"


@dataclass(frozen=True)
class Directories:
    """Directory table of a catalog; ``layers`` counts the changes that lie over its written form."""

    table: DataFrame
    layers: int = 0

    @cached_property
    def numbers(self) -> DataFrame:
        """(drive, frs, lo, hi): places in a pre-order walk, kept as a table; cycles have none."""
        return materialize(intervals.number(_nodes(self.table)), "numbers")

    @cached_property
    def inner_numbers(self) -> DataFrame:
        """The same in a walk of the directories that hold directories, which are few in most trees."""
        nodes = _nodes(self.table)
        holders = nodes.filter("up is not null").select("drive", F.col("up").alias("frs")).distinct()
        return materialize(intervals.number(materialize(nodes.join(holders, KEY, "left_semi"), "inner")), "numbers")

    def join_parent(self, rows: DataFrame, lookup: DataFrame, how: str = "left") -> DataFrame:
        """Join rows to ``lookup``, which has one row per (drive, parent_frs).

        Adaptive execution splits the rows of a directory that directly holds a large share of all rows.
        """
        return rows.join(lookup, ["drive", "parent_frs"], how)


def build_directories(df: DataFrame) -> Directories:
    """Directory table of a catalog.

    Parents that rows name but that have no row are in the table too, the NULL parent as NO_PARENT, so every
    row finds its parent.
    """
    named = df.select("drive", _parent_key().alias("frs")).distinct()
    table = directory_table(df)
    lost = named.join(df.filter("is_directory").select(KEY), KEY, "left_anti")
    return Directories(materialize(table.unionByName(_lost_rows(lost)), "directories"))


def _lost_rows(keys: DataFrame) -> DataFrame:
    """Directory rows of parents without a record; a root needs none to be one."""
    root = _is_root(F.col("frs"))
    chain = F.when(root, F.array("frs")).otherwise(F.array().cast("array<bigint>"))
    unknown = _unknown("frs")
    return keys.select(
        "drive", "frs", F.col("frs").alias("parent_frs"),
        F.when(root, _root_path(F.col("drive"))).otherwise(unknown).alias("path"),
        chain.alias("chain"), F.size(chain).alias("depth"),
        F.when(root, F.lit(OK)).otherwise(F.lit(LOST)).alias("state"),
        F.col("frs").alias("top"), F.lit(False).alias("bad_name"))


def _parent_key() -> Column:
    return F.coalesce("parent_frs", F.lit(NO_PARENT).cast("bigint"))


def _unknown(frs: str) -> Column:
    """Path that stands for a parent without a record; the id is empty if there is none."""
    known = F.when(F.col(frs) != NO_PARENT, F.col(frs).cast("string"))
    return F.concat(F.lit("<unknown:"), F.coalesce(known, F.lit("")), F.lit(">\\"))


def _joined(head: Column, tail: Column) -> Column:
    """head \\ tail, leaving out empty parts."""
    return (F.when(head == "", tail).when(tail == "", head)
            .otherwise(F.concat(head, F.lit("\\"), tail)))


def _is_root(frs: Column) -> Column:
    return frs.isin(*ROOT_IDS)


def _root_path(drive: Column) -> Column:
    return F.concat(drive, F.lit(":\\"))


def directory_table(df: DataFrame) -> DataFrame:
    """(drive, frs, parent_frs, path, chain, depth, state, top, bad_name) per directory.

    Only directories that hold directories are walked; the others, the most of a
    tree, take one join to their finished parent and are written once.

    Pointer doubling: each round joins every unfinished directory to the
    directory its pointer names and appends that one's chain, so a chain of
    depth d is complete after log2(d) rounds, whatever the depth.  A pointer that
    re-enters its own chain is a cycle and ends there; one without a row is
    broken.  Rounds are written to the shared folder, which cuts the lineage.
    """
    start = _start(df.filter("is_directory"))
    is_open = F.col("state") == OPEN
    holders = materialize(start.filter(is_open).select("drive", F.col("top").alias("frs")).distinct(), "holders")
    resolved = _resolve(materialize(start.join(holders, KEY, "left_semi"), "inner"))
    leaves = start.join(holders, KEY, "left_anti")
    placed = _double(leaves.filter(is_open), resolved)
    return _finished(resolved.unionByName(leaves.filter(~is_open)).unionByName(placed))


def _start(dirs: DataFrame) -> DataFrame:
    """Unresolved state: every directory points at its parent."""
    bad = (derive.is_malformed("name_bytes") if "name_bytes" in dirs.columns else F.lit(False))
    at_root = _is_root(F.col("frs"))
    none = F.array().cast("array<bigint>")
    return dirs.select(
        "drive", "frs", "parent_frs",
        F.when(at_root, F.lit(ROOT_FRS).cast("bigint")).otherwise(F.col("parent_frs")).alias("top"),
        F.when(at_root, none).otherwise(F.array("frs")).alias("ids"),
        F.when(at_root, F.lit("")).otherwise(F.coalesce("name", F.lit(""))).alias("rel"),
        F.when(at_root | _is_root(F.col("parent_frs")), F.lit(OK))
        .when(F.col("parent_frs") == F.col("frs"), F.lit(CYCLIC))
        .otherwise(F.lit(OPEN)).alias("state"),
        bad.alias("bad_name"))


def _resolve(start: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Double pointers until no row is open; ``settled`` rows only serve as targets.

    The number of open rows is observed while a round is written.
    """
    still_open = F.col("state") == OPEN
    working, n_open = start, 1
    while n_open:
        targets = working if settled is None else working.unionByName(settled)
        stepped = _double(working.filter(still_open), targets)
        rows = working.filter(~still_open).unionByName(stepped)
        seen = Observation()
        working = materialize(rows.observe(seen, F.count_if(still_open).alias("open")), "dirs")
        n_open = seen.get["open"]
    return working


def _double(open_rows: DataFrame, lookup: DataFrame) -> DataFrame:
    upper = lookup.select(
        "drive", F.col("frs").alias("top"), F.col("top").alias("top2"), F.col("ids").alias("ids2"),
        F.col("rel").alias("rel2"), F.col("state").alias("state2"), F.col("bad_name").alias("bad2"))
    joined = open_rows.join(upper, ["drive", "top"], "left")
    missing = F.col("top2").isNull()
    chain = F.when(missing, F.col("ids")).otherwise(F.concat("ids2", "ids"))
    top = F.when(missing, F.col("top")).otherwise(F.col("top2"))
    outcome = (F.when(missing, F.lit(BROKEN))
               .when(F.col("state2") != OPEN, F.col("state2"))
               .when(F.array_contains(chain, top), F.lit(CYCLIC))
               .otherwise(F.lit(OPEN)))
    return joined.select(
        "drive", "frs", "parent_frs", top.alias("top"), chain.alias("ids"),
        F.when(missing, F.col("rel")).otherwise(_joined(F.col("rel2"), F.col("rel"))).alias("rel"),
        outcome.alias("state"),
        (F.col("bad_name") | F.coalesce("bad2", F.lit(False))).alias("bad_name"))


def _finished(state: DataFrame) -> DataFrame:
    good = F.col("state") == OK
    chain = F.when(good, F.concat(F.array(F.lit(ROOT_FRS).cast("bigint")), "ids")).otherwise(F.col("ids"))
    path = F.when(good, F.concat(_root_path(F.col("drive")), "rel")).otherwise(
        F.concat(F.lit("<unknown:"), F.col("top").cast("string"), F.lit(">\\"), F.col("rel")))
    return state.select("drive", "frs", "parent_frs", path.alias("path"), chain.alias("chain"),
                        F.size(chain).alias("depth"), "state", "top", "bad_name")


def _reopened(table: DataFrame) -> DataFrame:
    """Finished rows back in the form the doubling works on."""
    good = F.col("state") == OK
    rel = F.when(good, F.substring("path", 4, 1 << 30)).otherwise(
        F.substring(F.col("path"), F.instr("path", ">\\") + 2, F.lit(1 << 30)))
    ids = F.when(good, F.slice("chain", F.lit(2), F.size("chain"))).otherwise(F.col("chain"))
    return table.select("drive", "frs", "parent_frs", "top", ids.alias("ids"), rel.alias("rel"),
                        "state", "bad_name")


def affected_directories(old: Directories, changed: DataFrame) -> DataFrame:
    """(drive, frs) of directories whose path a change of ``changed`` rows can alter:
    those rows, everything that was below them, and chains that ended at them."""
    keys = changed.select(KEY).distinct()
    ended = old.table.join(keys.withColumnRenamed("frs", "top"), ["drive", "top"], "left_semi")
    wanted = keys.unionByName(ended.select(KEY)).select("drive", F.col("frs").alias("anc"))
    below = ancestor_pairs(old).join(wanted, ["drive", "anc"], "left_semi").select(KEY)
    return below.unionByName(keys).distinct()


#: Changes that may lie over a directory table before it is written anew.
MAX_LAYERS = 8


def refresh_directories(old: Directories, df: DataFrame, changed: DataFrame) -> Directories:
    """Directory table after changes: old rows, overlaid with a written delta of those that differ.

    ``df`` is the current catalog, ``changed`` the keys created, renamed, moved or deleted. Only the changed directories are
    resolved, against each other and the old rows of their parents; everything below them keeps its rest behind the
    nearest changed directory and gets that one's new path and chain in front. After MAX_LAYERS deltas the table is
    written whole, and so it is if cycles or bad names above a change leave the rest of a path open.
    """
    keys = materialize(changed.select(KEY).distinct(), "changed")
    delta = _delta(old, df, keys)
    if delta is None:
        return _refreshed_whole(old, df, keys)
    rows, gone = delta
    table = old.table.join(gone, KEY, "left_anti").unionByName(rows)
    if old.layers + 1 >= MAX_LAYERS:
        return Directories(materialize(table, "directories"))
    return Directories(table, old.layers + 1)


def _delta(old: Directories, df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(new rows of directories whose row may differ, keys of the old rows they replace); None if it can't tell."""
    if keys.filter(_is_root(F.col("frs"))).limit(1).count():
        return None
    found = _behind_changes(old, keys)
    doubtful = found.agg(F.count_if("doubtful")).first()[0]
    start = materialize(_started(old, df, keys, found), "moved")
    if doubtful or old.table.filter(F.col("state") == CYCLIC).limit(1).count():
        return None
    resolved = _resolve(start)
    if resolved.filter(F.col("state") == CYCLIC).limit(1).count():
        return None
    rows = _finished(resolved.unionByName(_put_behind(found.filter("frs <> anc"), resolved)))
    rows = materialize(rows, "delta")
    before_lost = old.table.filter(F.col("state") == LOST).select(KEY)
    gone = materialize(found.select(KEY).unionByName(keys).unionByName(before_lost).distinct(), "gone")
    # Lost before, deleted by the change, or first named by a changed row; not recorded now, and named by some row.
    named = df.join(keys, KEY, "left_semi").select("drive", _parent_key().alias("frs"))
    stays = old.table.filter(F.col("state") != LOST).select(KEY)
    maybe = (before_lost.unionByName(keys).unionByName(named).distinct().join(rows.select(KEY), KEY, "left_anti")
             .join(stays.join(gone, KEY, "left_anti"), KEY, "left_anti"))
    lost = maybe.join(df.select("drive", _parent_key().alias("frs")), KEY, "left_semi")
    return materialize(rows.unionByName(_lost_rows(lost)), "delta"), gone


def _behind_changes(old: Directories, keys: DataFrame) -> DataFrame:
    """Old directories at or below a changed one, or that ended at one: the nearest (``anc``) and what follows it."""
    recorded = old.table.filter(F.col("state").isin(OK, BROKEN))
    wanted = keys.withColumnRenamed("frs", "anc")
    inside = (recorded.select(*KEY, F.posexplode("chain").alias("pos", "anc")).join(wanted, ["drive", "anc"], "left_semi")
              .groupBy(KEY).agg(F.max(F.struct("pos", "anc")).alias("near")))
    ended = (recorded.filter(F.col("state") == BROKEN).select(*KEY, F.col("top").alias("anc")).join(wanted, ["drive", "anc"], "left_semi")
             .select(*KEY, F.struct(F.lit(-1).alias("pos"), "anc").alias("near")))
    near = inside.unionByName(ended).groupBy(KEY).agg(F.max("near").alias("near"))
    near = materialize(near.select(*KEY, "near.pos", "near.anc"), "near")
    shape = _reopened(recorded).select(*KEY, "rel", "bad_name")
    above = (shape.join(keys, KEY, "left_semi")
             .select("drive", F.col("frs").alias("anc"), F.length("rel").alias("skipped"), F.col("bad_name").alias("bad_above")))
    rows = (recorded.select(*KEY, "parent_frs", "chain").join(shape, KEY).join(near, KEY).join(above, ["drive", "anc"], "left"))
    inner = F.col("pos") >= 0
    cut = F.when(inner & (F.col("skipped") > 0), F.substring(F.col("rel"), F.col("skipped") + 2, F.lit(1 << 30))).otherwise(F.col("rel"))
    rest = F.slice(F.col("chain"), F.col("pos") + 2, F.greatest(F.size("chain") - F.col("pos") - 1, F.lit(0)))
    above_bad = F.coalesce(F.col("bad_above") & inner, F.lit(False))
    return materialize(rows.select(
        *KEY, "parent_frs", "anc", rest.alias("rest_ids"), F.when(F.col("frs") == F.col("anc"), F.lit("")).otherwise(cut).alias("rest_rel"),
        F.when(above_bad, F.lit(False)).otherwise(F.col("bad_name") & (F.col("frs") != F.col("anc"))).alias("rest_bad"),
        (above_bad & F.col("bad_name") & (F.col("frs") != F.col("anc"))).alias("doubtful")), "behind")


def _started(old: Directories, df: DataFrame, keys: DataFrame, found: DataFrame) -> DataFrame:
    """The changed directories with a pointer to the nearest changed one above their new parent, or resolved."""
    start = materialize(_start(df.filter("is_directory").join(keys, KEY, "left_semi")), "started")
    parents = start.select("drive", F.col("top").alias("frs")).distinct()
    behind = found.select("drive", F.col("frs").alias("top"), "anc", "rest_ids", "rest_rel", "rest_bad")
    settled = (_reopened(old.table.filter(F.col("state").isin(OK, BROKEN, CYCLIC)).join(parents, KEY, "left_semi")).select(
        "drive", F.col("frs").alias("top"), F.col("top").alias("top2"), F.col("ids").alias("ids2"), F.col("rel").alias("rel2"),
        F.col("state").alias("state2"), F.col("bad_name").alias("bad2")))
    known = keys.select("drive", F.col("frs").alias("top"), F.lit(True).alias("itself"))
    is_open = F.col("state") == OPEN
    joined = (start.filter(is_open).join(known, ["drive", "top"], "left").join(behind, ["drive", "top"], "left")
              .join(settled, ["drive", "top"], "left"))
    itself, follows, rests = F.col("itself").isNotNull(), F.col("anc").isNotNull(), F.col("state2").isNotNull()

    def pick(own: Column, behind_: Column, settled_: Column) -> Column:
        return F.when(itself, own).when(follows, behind_).when(rests, settled_).otherwise(own)

    placed = joined.select(
        "drive", "frs", "parent_frs", pick(F.col("top"), F.col("anc"), F.col("top2")).alias("top"),
        pick(F.col("ids"), F.concat("rest_ids", "ids"), F.concat("ids2", "ids")).alias("ids"),
        pick(F.col("rel"), _joined(F.col("rest_rel"), F.col("rel")), _joined(F.col("rel2"), F.col("rel"))).alias("rel"),
        pick(F.col("state"), F.col("state"), F.col("state2")).alias("state"),
        (F.col("bad_name") | pick(F.lit(False), F.col("rest_bad"), F.col("bad2"))).alias("bad_name"))
    return start.filter(~is_open).unionByName(placed)


def _put_behind(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Directories below changed ones behind their new places; below a deleted one a chain is broken."""
    new = resolved.select("drive", F.col("frs").alias("anc"), F.col("top").alias("top2"), F.col("ids").alias("ids2"),
                          F.col("rel").alias("rel2"), F.col("state").alias("state2"), F.col("bad_name").alias("bad2"))
    joined, gone = found.join(new, ["drive", "anc"], "left"), F.col("state2").isNull()
    return joined.select(
        "drive", "frs", "parent_frs", F.when(gone, F.col("anc")).otherwise(F.col("top2")).alias("top"),
        F.when(gone, F.col("rest_ids")).otherwise(F.concat("ids2", "rest_ids")).alias("ids"),
        F.when(gone, F.col("rest_rel")).otherwise(_joined(F.col("rel2"), F.col("rest_rel"))).alias("rel"),
        F.coalesce("state2", F.lit(BROKEN)).alias("state"),
        (F.col("rest_bad") | F.coalesce("bad2", F.lit(False))).alias("bad_name"))


def _refreshed_whole(old: Directories, df: DataFrame, changed: DataFrame) -> Directories:
    """The same by resolving all affected directories and writing the whole table."""
    affected = materialize(affected_directories(old, changed), "affected")
    recorded = old.table.filter(F.col("state") != LOST)
    settled = materialize(_reopened(recorded.join(affected, KEY, "left_anti")), "settled")
    moved = df.filter("is_directory").join(affected, KEY, "left_semi")
    table = _finished(_resolve(_start(moved), settled).unionByName(settled))
    # Lost before, deleted by the change, or first named by a changed row; and named by some row now.
    parents = df.select("drive", _parent_key().alias("frs"))
    named = df.join(changed.select(KEY), KEY, "left_semi").select("drive", _parent_key().alias("frs"))
    maybe = (old.table.filter(F.col("state") == LOST).select(KEY).unionByName(changed.select(KEY)).unionByName(named)
             .distinct().join(table.select(KEY), KEY, "left_anti"))
    lost = maybe.join(parents, KEY, "left_semi")
    return Directories(materialize(table.unionByName(_lost_rows(lost)), "directories"))


def refreshed_rows(df: DataFrame, dirs: Directories, affected: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose path may differ after a change, with their new path."""
    inside = df.join(affected.withColumnRenamed("frs", "parent_frs"), ["drive", "parent_frs"], "left_semi")
    keys = inside.select(KEY).unionByName(changed.select(KEY)).distinct()
    return with_paths(df.join(keys, KEY, "left_semi"), dirs)


# ---------------------------------------------------------------- paths

def _with_parent(df: DataFrame, dirs: Directories, *columns: str, how: str = "left") -> DataFrame:
    """Join of rows to their parent's directory row, columns prefixed ``p_``."""
    parent = dirs.table.select("drive", F.col("frs").alias("parent_frs"),
                               *[F.col(c).alias(f"p_{c}") for c in columns])
    return dirs.join_parent(df, parent, how)


def _path_expr(name: Column) -> Column:
    """Full path from the parent's path column ``p_path``."""
    parent = (F.when(_is_root(F.col("parent_frs")), _root_path(F.col("drive")))
              .when(F.col("p_path").isNull(), _unknown("parent_frs"))
              .otherwise(F.col("p_path")))
    glue = F.when(parent.endswith("\\"), F.lit("")).otherwise(F.lit("\\"))
    return (F.when(_is_root(F.col("frs")), _root_path(F.col("drive")))
            .when(name == "", parent)
            .otherwise(F.concat(parent, glue, name)))


def with_paths(df: DataFrame, dirs: Directories, dir_suffix: bool = False, covered: bool = False) -> DataFrame:
    """Add ``path``; rows of any filtered subset resolve against the full table.

    With ``dir_suffix`` directories end in a backslash and a named stream is
    appended as ``file:stream``.  ``covered`` promises that ``dirs`` was built from
    a table that holds all these rows; every row then finds its parent, a NULL one too,
    and an inner join lets a short result be the broadcast side instead of the table.
    """
    if covered:
        found = dirs.table.select("drive", F.col("frs").alias("_parent"), F.col("path").alias("p_path"))
        joined = df.withColumn("_parent", _parent_key()).join(found, ["drive", "_parent"], "inner")
    else:
        joined = _with_parent(df, dirs, "path")
    path = _path_expr(F.coalesce("name", F.lit("")))
    if dir_suffix:
        stream = F.coalesce(F.col("stream_name"), F.lit("")) if "stream_name" in df.columns else F.lit("")
        suffix = (F.when(stream != "", F.concat(F.lit(":"), stream))
                  .when(F.col("is_directory") & ~path.endswith("\\"), F.lit("\\"))
                  .otherwise(F.lit("")))
        path = F.concat(path, suffix)
    return joined.withColumn("path", path).select(*df.columns, "path")


def with_malformed_path(df: DataFrame, dirs: Directories) -> DataFrame:
    """Add ``malformed_path``: the record or any directory above has a bad name."""
    joined = _with_parent(df, dirs, "bad_name")
    flag = derive.is_malformed("name_bytes") | F.coalesce("p_bad_name", F.lit(False))
    return joined.withColumn("malformed_path", flag).select(*df.columns, "malformed_path")


def with_ancestor(df: DataFrame, dirs: Directories, depth: int) -> DataFrame:
    """Add ``ancestor_frs``: the ancestor ``depth`` levels under the root, the row
    itself when it is not that deep."""
    joined = _with_parent(df, dirs, "chain")
    full = F.when(_is_root(F.col("frs")), F.array("frs")).otherwise(
        F.concat(F.coalesce(F.col("p_chain"), F.array().cast("array<bigint>")), F.array("frs")))
    picked = F.coalesce(F.try_element_at(full, F.lit(depth + 1)), F.col("frs"))
    return joined.withColumn("ancestor_frs", picked).select(*df.columns, "ancestor_frs")


def path_at_depth(path: Column, depth: int) -> Column:
    """Leading part of a path down to ``depth`` levels under its top."""
    # A broken path starts with a marker instead of the volume, one level more.
    broken = path.startswith("<unknown:")
    return (F.when(broken, F.substring_index(path, "\\", depth + 2))
            .when(F.substring(path, 4, 1) == "", path)
            .otherwise(F.substring_index(path, "\\", depth + 1)))


def _as_parent(keys: DataFrame) -> DataFrame:
    return keys.select("drive", F.col("frs").alias("parent_frs"))


# ---------------------------------------------------------------- closures

def ancestor_pairs(dirs: Directories) -> DataFrame:
    """(drive, frs, anc, step): every directory with each directory above it and
    itself; ``step`` is the id one level below ``anc`` on the way down."""
    positions = F.posexplode("chain").alias("pos", "anc")
    step = F.try_element_at(F.col("chain"), F.col("pos") + 2)
    return (dirs.table.select("drive", "frs", "chain", positions)
            .select("drive", "frs", "anc", F.coalesce(step, F.col("frs")).alias("step")))


#: Intervals up to which "below" is a filter on the places of directories, instead of a sorted pass.
FEW_INTERVALS = 64


def _nodes(table: DataFrame) -> DataFrame:
    """(drive, frs, up) of the directories outside cycles; all root ids are one node."""
    outside = table.filter(F.col("state").isin(OK, BROKEN) & ~_is_root(F.col("frs")))
    up = F.when(_is_root(F.col("parent_frs")), F.lit(ROOT_FRS).cast("bigint")).otherwise(F.col("parent_frs"))
    tops = table.filter(F.col("state") == OK).select("drive").distinct().select(
        "drive", F.lit(ROOT_FRS).cast("bigint").alias("frs"), F.lit(None).cast("bigint").alias("up"))
    return outside.select("drive", "frs", up.alias("up")).unionByName(tops)


def _one_root(keys: DataFrame) -> DataFrame:
    frs = F.when(_is_root(F.col("frs")), F.lit(ROOT_FRS).cast("bigint")).otherwise(F.col("frs"))
    return keys.select("drive", frs.alias("frs")).distinct()


def _all_roots(found: DataFrame) -> DataFrame:
    """Rows of the root's node for each of the root ids."""
    ids = F.when(F.col("frs") == ROOT_FRS, F.array(*[F.lit(i).cast("bigint") for i in ROOT_IDS])).otherwise(F.array("frs"))
    return found.withColumn("frs", F.explode(ids))


def _cyclic_pairs(dirs: Directories, roots: DataFrame) -> DataFrame:
    """(drive, frs, anc, step) within cycles, which have no places."""
    rounds = Directories(dirs.table.filter(F.col("state") == CYCLIC))
    return ancestor_pairs(rounds).join(roots.select("drive", F.col("frs").alias("anc")), ["drive", "anc"], "left_semi")


def directories_below(dirs: Directories, roots: DataFrame) -> DataFrame:
    """(drive, frs) of every directory at or below one of ``roots``.

    A directory is below another if its place is in the other's interval. A few roots become a range filter on the
    stored places, more of them one sorted pass over places and ends of intervals. Only directories that hold
    directories need places: what they hold is inside with them.
    """
    keys = _one_root(roots)
    numbers = dirs.inner_numbers
    spans = numbers.join(keys, KEY, "left_semi").select("drive", "lo", "hi")
    few = spans.limit(FEW_INTERVALS + 1).collect()
    if len(few) <= FEW_INTERVALS:
        within = F.lit(False)
        for r in few:
            within = within | ((F.col("drive") == r.drive) & (F.col("lo") >= r.lo) & (F.col("lo") < r.hi))
        found = numbers.filter(within).select(KEY)
    else:
        found = intervals.inside(numbers, keys)
    nodes = _nodes(dirs.table)
    held = nodes.join(found.withColumnRenamed("frs", "up"), ["drive", "up"], "left_semi").select(KEY)
    below = held.unionByName(nodes.join(keys, KEY, "left_semi").select(KEY))
    return _all_roots(below).unionByName(_cyclic_pairs(dirs, roots).select(KEY)).distinct()


def expand_descendants(df: DataFrame, dirs: Directories, roots: DataFrame) -> DataFrame:
    """Rows of ``roots`` plus everything below their directories, each once."""
    parents = materialize(_as_parent(directories_below(dirs, roots)), "parents")
    at_root = _is_root(F.col("frs"))
    inside = dirs.join_parent(df.filter(~at_root), parents, "left_semi")
    own = df.join(roots.select(KEY).distinct(), KEY, "left_semi")
    outer = dirs.join_parent(own.filter(~at_root), parents, "left_anti")
    return reduce(DataFrame.unionByName, [x.select(*df.columns) for x in (inside, outer, own.filter(at_root))])


def descendants_of(df: DataFrame, dirs: Directories, roots: DataFrame) -> DataFrame:
    """(drive, frs, root, first_step): each row below a root with the direct
    child of that root it is under.

    A sorted pass gives each directory the nearest root above it; other roots are those around that one. The
    stored chain of ids then names the step below the root.
    """
    near, around = intervals.innermost(dirs.numbers, _one_root(roots))
    asked = roots.select("drive", F.col("frs").alias("outer")).distinct()
    around = _all_roots(around.withColumnRenamed("outer", "frs")).withColumnRenamed("frs", "outer").join(asked, ["drive", "outer"], "left_semi")
    chains = dirs.table.filter(F.col("state").isin(OK, BROKEN)).select("drive", "frs", "chain")
    top = F.when(_is_root(F.col("outer")), F.lit(ROOT_FRS).cast("bigint")).otherwise(F.col("outer"))
    step = F.coalesce(F.try_element_at(F.col("chain"), F.array_position("chain", top).cast("int") + 1), F.col("frs"))
    pairs = (_all_roots(near).join(around, ["drive", "root"]).join(chains, KEY)
             .select("drive", "frs", F.col("outer").alias("anc"), step.alias("step")))
    pairs = pairs.unionByName(_cyclic_pairs(dirs, roots).select("drive", "frs", "anc", "step"))
    parents = pairs.select("drive", F.col("frs").alias("parent_frs"), F.col("anc").alias("root"), "step")
    rows = df.select("drive", "frs", "parent_frs").filter(~_is_root(F.col("frs")))
    first = F.when(F.col("parent_frs") == F.col("root"), F.col("frs")).otherwise(F.col("step"))
    return (dirs.join_parent(rows, parents, "inner")
            .select("drive", "frs", "root", first.alias("first_step")))


def orphans(df: DataFrame, dirs: Directories) -> DataFrame:
    """Rows whose chain does not reach the root."""
    reached = _as_parent(dirs.table.filter(F.col("state") == OK))
    hanging = df.filter(~_is_root(F.col("frs")) & ~_is_root(F.col("parent_frs")))
    return dirs.join_parent(hanging, reached, "left_anti").select(*df.columns)


def missing_parents(df: DataFrame) -> DataFrame:
    """(drive, parent_frs, children): parents named by rows but without a row."""
    named = (df.filter(~_is_root(F.col("parent_frs")))
             .groupBy("drive", "parent_frs").agg(F.count("*").alias("children")))
    present = df.select("drive", F.col("frs").alias("parent_frs"))
    return named.join(present, ["drive", "parent_frs"], "left_anti")


def with_placeholders(df: DataFrame) -> DataFrame:
    """Add one directory row below the root for every missing parent."""
    rows = missing_parents(df).select(
        "drive", F.col("parent_frs").alias("frs"),
        F.lit(ROOT_FRS).cast("bigint").alias("parent_frs"),
        F.concat(F.lit("<missing:"), F.col("parent_frs").cast("string"), F.lit(">")).alias("name"),
        F.lit(True).alias("is_directory"), F.lit(0).cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("allocated_size"), F.lit(1).alias("link_count"),
        F.lit(0x10).alias("flags"))
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def visible_rows(df: DataFrame, dirs: Directories) -> DataFrame:
    """Rows outside reserved records and their subtrees whose chain ends in the root."""
    def reserved(frs: Column) -> Column:
        return (frs <= LAST_RESERVED_FRS) & (frs != ROOT_FRS)

    good = _as_parent(dirs.table.filter((F.col("state") == OK) & ~F.exists("chain", reserved)))
    candidates = df.filter(~reserved(F.col("frs")))
    top = candidates.filter(_is_root(F.col("parent_frs")))
    below = dirs.join_parent(candidates.filter(~_is_root(F.col("parent_frs"))), good, "left_semi")
    return top.unionByName(below.select(*df.columns))


# ---------------------------------------------------------------- subtree sums

TREE_COLUMNS = ("descendants", "treesize", "tree_allocated")


def tree_sums(df: DataFrame, dirs: Directories, skip_orphans: bool = False) -> DataFrame:
    """(drive, frs, descendants, treesize, tree_allocated) per directory.

    Files are summed per directory first, so only directories meet their
    ancestors: the exchange carries directories x depth rows, never files.
    """
    files = (df.filter(~F.col("is_directory")).groupBy("drive", F.col("parent_frs").alias("frs"))
             .agg(F.count("*").alias("f_n"), F.sum("size").alias("f_size"),
                  F.sum("allocated_size").alias("f_alloc")))
    own = df.filter("is_directory").select("drive", "frs", F.col("size").alias("d_size"),
                                           F.col("allocated_size").alias("d_alloc"))
    base = dirs.table.filter(F.col("state") == OK) if skip_orphans else dirs.table
    zero = F.lit(0).cast("bigint")
    local = (base.select("drive", "frs", "chain")
             .join(own, KEY, "left").join(files, KEY, "left")
             .select("drive", "frs", "chain",
                     F.coalesce("f_n", zero).alias("n"),
                     (F.coalesce("f_size", zero) + F.coalesce("d_size", zero)).alias("bytes"),
                     (F.coalesce("f_alloc", zero) + F.coalesce("d_alloc", zero)).alias("alloc")))
    pairs = local.select("drive", "frs", F.explode("chain").alias("anc"), "n", "bytes", "alloc")
    counted = F.col("n") + F.when(F.col("anc") != F.col("frs"), 1).otherwise(0)
    return (pairs.groupBy("drive", F.col("anc").alias("frs"))
            .agg(F.sum(counted).alias("descendants"), F.sum("bytes").alias("treesize"),
                 F.sum("alloc").alias("tree_allocated")))


def with_tree_metrics(df: DataFrame, sums: DataFrame) -> DataFrame:
    """Add subtree columns: sums for directories, own values for files."""
    files = df.filter(~F.col("is_directory")).withColumns({
        "descendants": F.lit(0).cast("bigint"), "treesize": F.col("size"),
        "tree_allocated": F.col("allocated_size")})
    zero = F.lit(0).cast("bigint")
    dirs = df.filter("is_directory").join(sums, KEY, "left").withColumns({
        "descendants": F.coalesce("descendants", zero),
        "treesize": F.coalesce("treesize", F.col("size")),
        "tree_allocated": F.coalesce("tree_allocated", F.col("allocated_size"))})
    return files.unionByName(dirs.select(*files.columns))


def with_directory_sizes(df: DataFrame) -> DataFrame:
    """Replace directory sizes by subtree sizes; named streams keep their own."""
    whole = F.col("is_directory")
    if "stream_name" in df.columns:
        whole = whole & (F.col("stream_name") == "")
    return df.withColumns({
        "size": F.when(whole, F.col("treesize")).otherwise(F.col("size")),
        "allocated_size": F.when(whole, F.col("tree_allocated")).otherwise(F.col("allocated_size"))})


def bulkiness_sums(df: DataFrame, dirs: Directories, sums: DataFrame) -> DataFrame:
    """(drive, frs, bulkiness_sum): children's sums below 1 % of the directory's
    allocated subtree; all children when that threshold is 0.

    Thresholds are known from the subtree sums, so the files of all directories
    count in one pass.  Only directories take part in the tree contraction, whose
    rounds grow with the log of their number and not with the depth.
    """
    limits = sums.select("drive", "frs",
                         F.call_function("div", F.col("tree_allocated"), F.lit(100)).alias("limit"))

    def small(value: str) -> Column:
        limit = F.coalesce("limit", F.lit(0).cast("bigint"))
        return F.when((limit == 0) | (F.col(value) < limit), F.col(value)).otherwise(F.lit(0))

    per_parent = limits.withColumnRenamed("frs", "parent_frs")
    files = df.filter(~F.col("is_directory")).select("drive", "parent_frs", "frs", "allocated_size")
    from_files = (dirs.join_parent(files, per_parent)
                  .groupBy("drive", F.col("parent_frs").alias("frs"))
                  .agg(F.sum(small("allocated_size")).alias("file_part")))
    nodes = (dirs.table.filter("depth >= 1").join(from_files, KEY, "left").join(limits, KEY, "left")
             .select("drive", "frs", F.when(~_is_root(F.col("frs")), F.col("parent_frs")).alias("up"),
                     F.coalesce("file_part", F.lit(0).cast("bigint")).alias("part"),
                     F.when(F.col("limit") != 0, F.col("limit")).alias("cut")))
    return contraction.sums_below_cuts(nodes)[0].withColumnRenamed("total", "bulkiness_sum")
