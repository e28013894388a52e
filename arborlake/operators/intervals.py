"""Pre-order numbers of the directory tree: what is below a directory is an interval.

Every directory gets ``lo``, its place in a walk of its volume that takes siblings by id, and ``hi``, the first place
after its subtree.  Both come from sums by pointer doubling: log2(depth) rounds over rows of fixed width, so a chain of
10,000 levels is no wider than a flat tree.  Questions about "below" are then answered by one sorted pass over the places of
directories and the ends of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from arborlake.runtime import materialize, running_totals

NODE = ["drive", "frs"]


def _jump(rows: DataFrame, lookup: DataFrame, *carried: str) -> DataFrame:
    """Rows with the pointer of the node their pointer names, and that node's ``carried`` columns as ``t_``."""
    target = lookup.select("drive", F.col("frs").alias("jump"), F.col("jump").alias("t_jump"),
                           *[F.col(c).alias(f"t_{c}") for c in carried])
    return rows.join(target, ["drive", "jump"], "left")


def _rounds(rows: DataFrame, step, tag: str) -> DataFrame:
    """Repeat ``step`` on written rows until no pointer is left."""
    left = 1
    rows = materialize(rows, tag)
    while left:
        seen = Observation()
        rows = materialize(step(rows).observe(seen, F.count("jump").alias("left")), tag)
        left = seen.get["left"]
    return rows


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes (drive, frs, up, ...) with ``jump``: ``up`` where that is a node, else NULL."""
    known = nodes.select("drive", F.col("frs").alias("up"), F.col("frs").alias("jump"))
    return nodes.drop("jump").join(known, ["drive", "up"], "left")


def subtree_totals(nodes: DataFrame, *values: str) -> DataFrame:
    """Nodes (drive, frs, up, values) with the sums of each value over the node and all below it.

    After k rounds a node has the sum over everything less than 2^k levels down, and its pointer names the ancestor 2^k
    levels up; the next round adds to each node what the nodes that point at it have.  Pointers must form no cycle.
    """
    def step(rows: DataFrame) -> DataFrame:
        parts = (rows.filter(F.col("jump").isNotNull()).groupBy("drive", F.col("jump").alias("frs"))
                 .agg(*[F.sum(v).alias(f"p_{v}") for v in values]))
        zero = F.lit(0).cast("bigint")
        return (_jump(rows, rows).join(parts, NODE, "left")
                .select("drive", "frs", "up", F.col("t_jump").alias("jump"),
                        *[(F.col(v) + F.coalesce(f"p_{v}", zero)).alias(v) for v in values]))

    start = linked(nodes).select("drive", "frs", "up", "jump", *[F.col(v).cast("bigint").alias(v) for v in values])
    return _rounds(start, step, "below").select("drive", "frs", "up", *values)


def root_path_sums(nodes: DataFrame, value: str) -> DataFrame:
    """Nodes (drive, frs, up, value) with the sum of ``value`` over the node and all above it."""
    def step(rows: DataFrame) -> DataFrame:
        total = F.col(value) + F.coalesce(f"t_{value}", F.lit(0).cast("bigint"))
        rest = [c for c in rows.columns if c not in ("drive", "frs", "jump", value)]
        return _jump(rows, rows, value).select("drive", "frs", *rest, F.col("t_jump").alias("jump"), total.alias(value))

    return _rounds(linked(nodes), step, "above").drop("jump")


def number(nodes: DataFrame) -> DataFrame:
    """(drive, frs, lo, hi) of nodes (drive, frs, up); ``up`` is NULL, or no node, for the top of a tree."""
    sized = subtree_totals(nodes.withColumn("size", F.lit(1)), "size")
    known = linked(sized).withColumnRenamed("jump", "above")
    # Sizes of earlier siblings: a running sum over all siblings, less the sum at the first of them. No family is one task.
    order = [F.col("drive"), F.coalesce("above", F.lit(-1).cast("bigint")), F.col("frs")]
    ran = running_totals(known, order, {"ran": F.col("size")}).withColumn("ran", F.col("ran") - F.col("size"))
    ran = materialize(ran, "siblings")
    family = F.coalesce("above", F.lit(-1).cast("bigint")).alias("family")
    first = ran.groupBy("drive", family).agg(F.min("ran").alias("first"))
    placed = (ran.withColumn("family", family).join(first, ["drive", "family"])
              .select("drive", "frs", "up", "size",
                      (F.col("ran") - F.col("first") + F.when(F.col("above").isNull(), 0).otherwise(1)).alias("lo")))
    return root_path_sums(placed, "lo").select("drive", "frs", "lo", (F.col("lo") + F.col("size")).alias("hi"))


def _events(spans: DataFrame, opened: Column, closed: Column) -> DataFrame:
    """Both ends of intervals as rows (drive, pos, kind, lo, value); an end at a place comes before a start there."""
    start = spans.select("drive", F.col("lo").alias("pos"), F.lit(1).alias("kind"), "lo", "frs", opened.alias("value"))
    end = spans.select("drive", F.col("hi").alias("pos"), F.lit(0).alias("kind"), "lo", "frs", closed.alias("value"))
    return start.unionByName(end)


_ORDER = ("drive", "pos", "kind", "lo", "frs")


def inside(numbers: DataFrame, roots: DataFrame) -> DataFrame:
    """(drive, frs) of numbered directories at or below one of ``roots`` (drive, frs).

    One running count over the places in order: it rises at the start of a root's interval and falls at its end.
    """
    spans = numbers.join(roots.select(NODE).distinct(), NODE, "left_semi")
    places = numbers.select("drive", F.col("lo").alias("pos"), F.lit(2).alias("kind"), "lo", "frs", F.lit(0).alias("value"))
    rows = places.unionByName(_events(spans, F.lit(1), F.lit(-1)))
    counted = running_totals(rows, [F.col(c) for c in _ORDER], {"open": F.col("value").cast("bigint")})
    return counted.filter("kind = 2 and open > 0").select(NODE)


def _last_of(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows with ``last``: the latest non-NULL ``value`` at or before them in ``order``, with its place."""
    at = F.when(F.col("value").isNotNull(), F.struct(*order, "value"))
    return running_totals(rows, [F.col(c) for c in order], {"last": at}, fold=F.max)


def innermost(numbers: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((drive, frs, root) of every directory at or below a root with the nearest one, (drive, root, outer) of the roots).

    ``outer`` runs over a root and all roots that enclose it.
    """
    spans = materialize(numbers.join(roots.select(NODE).distinct(), NODE, "left_semi"), "spans")
    counted = running_totals(_events(spans, F.lit(1), F.lit(-1)), [F.col(c) for c in _ORDER], {"open": F.col("value").cast("bigint")})
    levels = materialize(counted.filter("kind = 1").select("drive", "frs", "lo", F.col("open").alias("level")), "levels")
    # The root around a root of level n is the last one of level n - 1 that starts before it.
    offers = levels.select("drive", "level", "lo", F.lit(0).alias("kind"), "frs", F.col("frs").alias("value"))
    asks = levels.select("drive", (F.col("level") - 1).alias("level"), "lo", F.lit(1).alias("kind"), "frs", F.lit(None).cast("bigint").alias("value"))
    found = _last_of(offers.unionByName(asks), ("drive", "level", "lo", "kind", "frs")).filter("kind = 1")
    same = (F.col("last.drive") == F.col("drive")) & (F.col("last.level") == F.col("level"))
    around = materialize(found.select("drive", "frs", F.when(same, F.col("last.value")).alias("up")), "around")

    closed = spans.join(around, NODE)
    none = F.lit(-1).cast("bigint")
    events = _events(closed, F.col("frs"), F.coalesce("up", none))
    places = numbers.select("drive", F.col("lo").alias("pos"), F.lit(2).alias("kind"), "lo", "frs", F.lit(None).cast("bigint").alias("value"))
    # Ends at one place close from the inside outwards, so the outermost end decides: it has the least start.
    order = ("drive", "pos", "kind", "turn", "frs")
    turned = events.unionByName(places).withColumn("turn", F.when(F.col("kind") == 0, -F.col("lo")).otherwise(F.col("lo")))
    near = (_last_of(turned, order).filter("kind = 2").filter((F.col("last.drive") == F.col("drive")) & (F.col("last.value") >= 0))
            .select("drive", "frs", F.col("last.value").alias("root")))
    return near, enclosing(around)


def enclosing(around: DataFrame) -> DataFrame:
    """(drive, root, outer): every root with itself and the roots around it; ``around`` has each root's next one (``up``).

    Pairs less than 2^k steps apart are joined to pointers of 2^k steps, so the rounds grow with the log of the nesting.
    """
    pairs = materialize(around.select("drive", F.col("frs").alias("root"), F.col("frs").alias("outer")), "pairs")
    jumps = materialize(around.filter("up is not null").select("drive", "frs", F.col("up").alias("jump")), "jumps")
    while jumps.limit(1).count():
        further = jumps.join(pairs.withColumnRenamed("root", "jump"), ["drive", "jump"]).select("drive", F.col("frs").alias("root"), "outer")
        pairs = materialize(pairs.unionByName(further), "pairs")
        jumps = materialize(_jump(jumps, jumps).select("drive", "frs", F.col("t_jump").alias("jump")).filter("jump is not null"), "jumps")
    return pairs
