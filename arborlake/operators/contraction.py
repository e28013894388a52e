"""Bottom-up sums over a tree whose edges may drop what they carry, in a logarithmic number of rounds.

The value of a node is its own part plus what its children hand up; a child's value passes only below the node's ``cut``.
Plain pointer doubling can't add this up, since whether a value passes is known only once it is whole.  So the tree is
contracted: each round finishes every node whose children are finished, and halves every chain of nodes that wait
for one child each.  What a chain does to the value at its lower end is "add a part while below a limit, else
one of a few constants", and two such functions in a row are again one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from arborlake.runtime import materialize

NODE = ["drive", "frs"]
#: Twice the bits of an id: trees of 2^64 nodes need no more rounds.
MAX_ROUNDS = 130
_STEPS = "array<struct<start:bigint,value:bigint>>"
_STATE = ["drive", "frs", "up", "up_cut", "cut", "part", "open", "ids", "at", "steps", "total", "age"]


def _passed(value: Column, cut: Column) -> Column:
    return F.when(cut.isNull() | (value < cut), value).otherwise(F.lit(0).cast("bigint"))


def _applied(x: Column, part: Column, steps: Column) -> Column:
    """The function of a chain at ``x``: the value of the last step from ``x`` down; below all steps, part + x."""
    step = F.try_element_at(F.filter(steps, lambda s: s["start"] <= x), F.lit(-1))
    return F.coalesce(step["value"], part + x)


def _composed(outer: tuple[Column, Column], inner: tuple[Column, Column]) -> tuple[Column, Column]:
    """(part, steps) of ``outer`` after ``inner``."""
    part, steps = outer
    in_part, in_steps = inner
    first = F.try_element_at(in_steps, F.lit(1))["start"]
    moved = F.filter(F.transform(steps, lambda s: F.struct((s["start"] - in_part).alias("start"), s["value"].alias("value"))),
                     lambda s: first.isNull() | (s["start"] < first))
    mapped = F.transform(in_steps, lambda s: F.struct(s["start"].alias("start"), _applied(s["value"], part, steps).alias("value")))
    return part + in_part, F.concat(moved, mapped)


def _merged(steps: Column) -> Column:
    """Steps without those that repeat the value before them."""
    return F.filter(steps, lambda s, i: (i == 0) | (s["value"] != F.try_element_at(steps, i)["value"]))


def _settled(rows: DataFrame) -> DataFrame:
    """Branches by their open children: none finishes them, one makes them a chain that waits for it."""
    last, alone = F.col("open") == 0, F.col("open") == 1
    step = F.array(F.struct(F.col("cut").alias("start"), F.col("part").alias("value"))).cast(_STEPS)
    return rows.withColumns({
        "total": F.when(last, F.col("part")), "age": F.when(last, F.lit(0)), "at": F.when(alone, F.col("ids")),
        "steps": F.when(alone & F.col("cut").isNotNull(), step).otherwise(F.array().cast(_STEPS)),
    }).select(*_STATE)


def _started(nodes: DataFrame) -> DataFrame:
    parents = nodes.select("drive", F.col("frs").alias("up"), F.col("cut").alias("up_cut"), F.lit(True).alias("known"))
    placed = (nodes.filter("up is not null").join(parents, ["drive", "up"], "left")
              .withColumn("up", F.when(F.col("known"), F.col("up"))).drop("known"))
    tops = nodes.filter("up is null").withColumn("up_cut", F.lit(None).cast("bigint"))
    placed = placed.unionByName(tops)
    children = (placed.filter("up is not null").groupBy("drive", F.col("up").alias("frs"))
                .agg(F.count("*").alias("open"), F.bit_xor("frs").alias("ids")))
    zero = F.lit(0).cast("bigint")
    return _settled(placed.join(children, NODE, "left").withColumns(
        {"open": F.coalesce("open", zero), "ids": F.coalesce("ids", zero)}))


def _round(state: DataFrame) -> DataFrame:
    """One step for all rows; finished ones stay while a chain points at them or may come to do so."""
    named = state.filter("total is null and at is not null").select("drive", F.col("at").alias("frs"))
    state = state.withColumn("steps", _merged(F.col("steps")))
    old = state.filter("total is not null").join(named, NODE, "left_semi").withColumn("age", F.lit(1))
    ready = (state.filter("age = 0 and up is not null").groupBy("drive", F.col("up").alias("frs"))
             .agg(F.sum(_passed(F.col("total"), F.col("up_cut"))).alias("r_part"), F.count("*").alias("r_open"), F.bit_xor("frs").alias("r_ids")))
    zero = F.lit(0).cast("bigint")
    branches = _settled(state.filter("total is null and at is null").join(ready, NODE, "left").withColumns({
        "part": F.col("part") + F.coalesce("r_part", zero), "open": F.col("open") - F.coalesce("r_open", zero),
        "ids": F.col("ids").bitwiseXOR(F.coalesce("r_ids", zero))}))

    target = state.select("drive", F.col("frs").alias("at"), *[F.col(c).alias(f"t_{c}") for c in ("total", "at", "part", "steps")])
    own, below = (tuple(F.col(p + c) for c in ("part", "steps")) for p in ("", "t_"))
    met, longer = F.col("t_total").isNotNull(), F.col("t_at").isNotNull()
    part, steps = _composed(own, below)
    # New columns take the old names only afterwards: within a lambda a name would mean the new one.
    chains = (state.filter("total is null and at is not null").join(target, ["drive", "at"], "left").select(
        "drive", "frs", "up", "up_cut", "cut", "open", "ids",
        F.when(met, F.lit(None)).when(longer, F.col("t_at")).otherwise(F.col("at")).cast("bigint").alias("at"),
        *[F.when(~met & longer, new).otherwise(F.col(name)).alias(f"n_{name}") for name, new in (("part", part), ("steps", steps))],
        F.when(met, _applied(F.col("t_total"), *own)).alias("total"), F.when(met, F.lit(0)).alias("age"))
        .withColumnsRenamed({"n_part": "part", "n_steps": "steps"}))
    return old.unionByName(branches).unionByName(chains)


def sums_below_cuts(nodes: DataFrame) -> tuple[DataFrame, int]:
    """((drive, frs, total), rounds) of nodes (drive, frs, up, part, cut).

    ``up`` is NULL, or no node, at the top of a tree; ``cut`` NULL lets all pass.  Values are not negative and links form no
    cycle.  A node leaves the working table once it is finished and no chain waits for it, so the rounds shrink with what is left.
    """
    finished, rounds, left = [], 0, 1
    state = _started(nodes.select("drive", "frs", "up", F.col("part").cast("bigint").alias("part"), F.col("cut").cast("bigint").alias("cut")))
    while left:
        if rounds > MAX_ROUNDS:
            raise RuntimeError("the links of the tree form a cycle")
        seen = Observation()
        state = materialize(state.observe(seen, F.count(F.when(F.col("total").isNull(), 1)).alias("left")), "contract")
        finished.append(state.filter("age = 0").select("drive", "frs", "total"))
        left, rounds = seen.get["left"], rounds + 1
        state = _round(state)
    return reduce(DataFrame.unionByName, finished), rounds
