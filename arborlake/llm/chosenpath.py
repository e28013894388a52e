"""MinHash near-duplicates: a chosen-path set similarity join over word shingles.

Each distinct set of shingles has FUNCTIONS minwise values. A tree branches: at its root and at every large node a few of the
functions are chosen, and a set goes to the child that its value names. Two sets that agree in a share s of the functions
go to a common child with probability 1 - (1 - s) ** branches at each level, so they part for good with a probability
that has a fixed bound for trees of any depth; independent trees are repeated until the bound meets the target recall. Nodes that are
small, or whose children hardly get smaller (their sets are alike), are compared exhaustively by sketches. Candidates
are confirmed on whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from arborlake.llm.common import byte_rows, shuffle_partitions
from arborlake.llm.components import components
from arborlake.llm.shinglesets import confirmed, set_key, shingles, text_rows, tile_forests
from arborlake.runtime import materialize

#: Minwise functions; two bits of each value make the sketch, four longs of 64 bits.
FUNCTIONS = 128
#: Sets up to which a node is compared without branching, and sets of a tile of a larger one.
SMALL, TILE = 1024, 4096
#: A child with at least this share of its parent's sets is compared, as more branches would not part them.
ALIKE = 0.5
#: Branches of a node, and standard deviations by which the sketches of a link may be off.
BRANCHES, DEVIATIONS = 2, 6
_LOW_BITS = 0x5555555555555555


def trees_needed(share: float, recall: float, branches: int = BRANCHES) -> int:
    """Trees after which a pair at the threshold has met with the probability ``recall``, however deep they are."""
    lost = 0.0
    for _ in range(10_000):
        lost = (1 - share + share * lost) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost))) if lost > 0 else 1


def minwise(hashes, functions: int = FUNCTIONS):
    """Least 32-bit value of each function over a set's hashes, as signed integers."""
    import numpy as np

    draw = np.random.default_rng(0x5EED)
    odd = draw.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mix = draw.integers(0, 1 << 63, functions, dtype=np.uint64)
    least = np.full(functions, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[None, at:at + 2048] ^ mix[:, None]
        part *= odd[:, None]
        np.minimum(least, part.min(axis=1) >> np.uint64(32), out=least)
    return least.astype(np.uint32).view(np.int32)


def sketch(values):
    """Two bits of each minwise value, as four signed longs."""
    import numpy as np

    two = (values.view(np.uint32) & np.uint32(3)).astype(np.uint64).reshape(4, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def most_mismatches(share: float) -> int:
    """Differing functions that the sketches of two sets with this share in common have at most."""
    p = (1 - share) * 0.75
    return math.floor(FUNCTIONS * p + DEVIATIONS * math.sqrt(FUNCTIONS * p * (1 - p)))


def near_sketches(n, *s, share: tuple[int, int]):
    """Test of ``shinglesets.spread`` for set sizes ``n`` and the four columns of sketches."""
    import numpy as np

    up, down = share
    most, low = most_mismatches(up / down), np.uint64(_LOW_BITS)
    s = [c.view(np.uint64) for c in s]

    def near(a, b):
        differ = np.zeros((len(a), len(b)), np.uint8)
        for c in range(4):
            x = s[c][a][:, None] ^ s[c][b][None, :]
            differ += np.bitwise_count((x | (x >> np.uint64(1))) & low)
        x, y = n[a][:, None], n[b][None, :]
        return (differ <= most) & (np.minimum(x, y) * down >= np.maximum(x, y) * up)

    return near


def _prints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text keys, set keys, size, minwise values and sketch) of all rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys, sizes, mins, bits = [], [], [], []
                for (text,) in byte_rows([part], "text"):
                    found = shingles(text, words)
                    values = minwise(found)
                    keys.append(set_key(found))
                    sizes.append(len(found))
                    mins.append(values)
                    bits.append(sketch(values))
                mins, bits = np.array(mins).reshape(-1), np.array(bits).reshape(-1, 4)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(mins) + 1, FUNCTIONS, dtype=np.int32)), pa.array(mins))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key1"), part.column("key2"), pa.array([k[0] for k in keys], pa.int64()),
                     pa.array([k[1] for k in keys], pa.int64()), pa.array(sizes, pa.int64()), rows, *(pa.array(bits[:, c]) for c in range(4))],
                    names=["id", "key1", "key2", "set1", "set2", "n", "mins", "s0", "s1", "s2", "s3"])

    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "id long, key1 long, key2 long, set1 long, set2 long, n long, mins array<int>, s0 long, s1 long, s2 long, s3 long")


def _unused(used, branch: int):
    """A function that only the path and the branch decide, and that no step of the path was taken by."""
    drawn = [F.pmod(F.xxhash64("path", F.lit(branch), F.lit(i)), FUNCTIONS).cast("int") for i in range(8)]
    return F.get(F.array_except(F.array(*drawn), used), F.lit(0))


def tree_candidates(sets: DataFrame, share: tuple[int, int], recall: float, columns: list[str], near: Callable) -> DataFrame:
    """Forests of candidate pairs (a, b) of the sets (node, mins and ``columns``), compared by ``near`` where a branch ends.

    Only ids travel down the trees; a set's ``columns`` are fetched for the nodes it ends in, and for most sets
    of a corpus that is none, as no other set shares a value with them.
    """
    spark = sets.sparkSession
    trees = trees_needed(share[0] / share[1], recall)
    roots = [F.struct(F.xxhash64(F.lit(c), F.get("mins", F.lit(c % FUNCTIONS))).alias("path"), F.array(F.lit(c % FUNCTIONS)).alias("used"))
             for c in range(trees * BRANCHES)]
    level = sets.select(F.explode(F.array(*roots)).alias("at"), F.lit(None).cast("long").alias("above"), "node")
    done = []
    while True:
        level = level.select("at.path", "at.used", "above", "node")
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        level = materialize(level.join(sizes, "path"), "sized")
        alike = F.coalesce(F.col("size") >= F.col("above") * ALIKE, F.lit(False))
        done.append(level.filter((F.col("size") <= SMALL) | alike).select("path", "size", "node"))
        large = level.filter((F.col("size") > SMALL) & ~alike)
        if not large.limit(1).count():
            break
        used, children = F.col("used"), []
        for b in range(BRANCHES):
            choice = _unused(used, b)
            used = F.array_append(used, choice)
            path = F.xxhash64("path", F.lit(b), F.get("mins", choice))
            children.append(F.struct(path.alias("path"), F.array_append(F.col("used"), choice).alias("used")))
        level = (large.join(sets.select("node", "mins"), "node")
                 .select(F.explode(F.array(*children)).alias("at"), F.col("size").alias("above"), "node"))
        level = materialize(level, "level")
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    kept = ["node", *columns]
    rows = rows.join(sets.select(*kept), "node")
    rows = rows.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    # One row for the tile that holds the set, and one for each tile before it that it visits.
    tile = F.explode(F.sequence(F.lit(0), F.col("own")))
    placed = rows.withColumn("tile", tile).select("path", "tile", (F.col("tile") < F.col("own")).cast("int").alias("visitor"), *kept)
    n = 4 * shuffle_partitions(spark)
    return (placed.repartition(n, "path", "tile").sortWithinPartitions("path", "tile", "visitor", "node")
            .mapInArrow(tile_forests(near, "path", columns), "a long, b long"))


def _candidates(sets: DataFrame, share: tuple[int, int], recall: float) -> DataFrame:
    """Forests of candidate pairs (a, b) of the sets (node, n, mins, sketch)."""
    return tree_candidates(sets, share, recall, ["n", "s0", "s1", "s2", "s3"], functools.partial(near_sketches, share=share))


def near_duplicates(docs: DataFrame, words: int = 3, share: tuple[int, int] = (85, 100), recall: float = 1 - 1e-6,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept) of all rows of ``docs``.

    Two rows are linked if their sets of distinct shingles have at least ``share`` of all their shingles in common; a text
    of fewer words than a shingle is one shingle. ``component_id`` is the smallest id that chains of links reach; ``kept``
    says that it is the row's own. Null and empty texts have no shingles and are linked with nothing. A row with a
    null id takes part in chains, is never kept, and has a null component if no linked row has an id; repeated rows are
    one set and all stay. An empty table gives no rows. Other columns aren't read, whatever their names. Ids are cast to long.

    Every link found is confirmed on whole sets. A link is missed with a probability of at most 1 - ``recall``
    for a pair at the threshold, less above it; equal sets are always linked.
    """
    rows = materialize(_prints(docs, words, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "prints")
    distinct = (rows.filter("n > 0").groupBy("set1", "set2")
                .agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies")))
    distinct = materialize(distinct, "distinct")
    chosen = distinct.select(F.col("node").alias("row"))
    sets = materialize(rows.join(chosen, "row", "left_semi").withColumnRenamed("row", "node")
                       .select("node", "key1", "key2", "n", "mins", "s0", "s1", "s2", "s3"), "sets")
    candidates = _candidates(sets, share, recall)
    texts = text_rows(docs, id_col, text_col).select("key1", "key2", "text")
    links = confirmed(candidates, sets.select("node", "key1", "key2"), texts, words, share)
    found = materialize(components(links, "a", "b"), "found")
    group = F.coalesce("component", "node")
    placed = distinct.join(found, "node", "left").withColumn("group", group)
    least = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    # Sets of one row that are linked with nothing have their own id.
    placed = materialize(placed.filter("copies > 1 or component is not null").join(least, "group")
                         .select("set1", "set2", F.lit(True).alias("placed"), "component_id"), "placed")
    component = F.when(F.col("placed"), F.col("component_id")).otherwise(F.col("id"))
    return (rows.select("id", "n", "set1", "set2").join(placed, ["set1", "set2"], "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                    F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")))
