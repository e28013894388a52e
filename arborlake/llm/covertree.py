"""Hard-negative mining: cover trees over norm-augmented candidates, searched best first for windows of scores.

With one more component that brings all candidates to one norm, an inner product is a matter of distance:
2 <q, x> = |q|^2 + M^2 - d(q, x)^2, where the anchor's own extra component is zero. A node of a cover tree knows
its centre and the largest distance from it to anything below (its covering radius), which bounds the inner products
below it from both sides. Nodes outside an anchor's window are never entered; the leaves of the others are verified by
integer inner products, those with the highest bound first, until no bound reaches the worst of the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.llm.common import shuffle_partitions
from arborlake.llm.vectors import lists, pack, quantized, unpack, usable
from arborlake.runtime import drop_written, materialize

#: Rows up to which a node is a leaf, and children of a node at most.
LEAF, FAN = 192, 32
#: Rows from which the pivots of regions are chosen; it decides about speed only.
PIVOT_SAMPLE, PIVOTS = 4096, 512
#: Windows that are searched together, and leaves that each of them takes at first; each time it takes twice as many.
BLOCK, WIDTH = 1024, 4
#: Open ends of a window.
LOW, HIGH = -(1 << 61), 1 << 61


def augmented(x, largest):
    """Float vectors with the component that brings their squared norm to ``largest``."""
    import numpy as np

    norm = (x * x).sum(axis=1)
    return np.concatenate([x.astype(float), np.sqrt(np.maximum(largest - norm, 0).astype(float))[:, None]], axis=1)


class Tree:
    """Cover tree over a block of rows, as arrays with a row for each node; a child comes after its parent.

    As centres of a node's children rows are taken that none so far covers within half the node's radius, until all rows are
    covered (or there are as many as leaves are needed, FAN at most), so centres lie farther apart than that; a
    row goes to its nearest centre, a node's own centre is its first child, and radii are those really needed.
    """

    def __init__(self, points):
        import numpy as np

        self.order = np.arange(len(points))
        centre, radius, child, leaves = [0], [0.0], [(0, 0)], [(0, len(points))]
        away = self._distance(points, np.arange(len(points)), 0)
        todo = [(0, 0, len(points), away)]
        while todo:
            node, a, b, away = todo.pop()
            radius[node] = float(away.max()) if b > a else 0.0
            if b - a <= LEAF or radius[node] == 0:
                continue
            rows = self.order[a:b]
            nearest, owner, centres = away.copy(), np.zeros(b - a, np.int64), [centre[node]]
            fan = min(FAN, max(2, -(-(b - a) // LEAF)))
            while len(centres) < fan and len(bare := np.flatnonzero(nearest > radius[node] / 2)):
                one = rows[bare[len(bare) // 2]]
                d = self._distance(points, rows, one)
                closer = d < nearest
                owner[closer], nearest[closer] = len(centres), d[closer]
                centres.append(int(one))
            by = np.argsort(owner, kind="stable")
            self.order[a:b], nearest, owner = rows[by], nearest[by], owner[by]
            first = len(centre)
            child[node] = (first, first + len(centres))
            leaves[node] = (0, 0)
            ends = np.searchsorted(owner, np.arange(len(centres) + 1))
            for i, c in enumerate(centres):
                lo, hi = int(ends[i]), int(ends[i + 1])
                centre.append(c)
                radius.append(0.0)
                child.append((0, 0))
                leaves.append((a + lo, a + hi))
                todo.append((first + i, a + lo, a + hi, nearest[lo:hi]))
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.child, self.leaf = np.array(child).reshape(-1, 2), np.array(leaves).reshape(-1, 2)
        self.centres = points[self.centre] if len(points) else points

    @staticmethod
    def _distance(points, rows, at):
        import numpy as np

        return np.sqrt(((points[rows] - points[at]) ** 2).sum(axis=1)) if len(rows) else np.zeros(0)

    def levels(self):
        """Numbers of the nodes of each level, from the root."""
        import numpy as np

        level = np.array([0])
        while len(level):
            yield level
            spans = self.child[level]
            level = np.concatenate([np.arange(a, b) for a, b in spans] or [np.zeros(0, np.int64)])


def bounds(centres, radius, anchors, largest):
    """Least and largest possible inner product of each anchor with anything below each node."""
    import numpy as np

    norm = (anchors * anchors).sum(axis=1)[:, None]
    inner = anchors @ centres[:, :-1].T
    away = np.sqrt(np.maximum(norm + (centres * centres).sum(axis=1)[None, :] - 2 * inner, 0))
    slack = 1 + 1e-9 * (norm + largest)
    reach = np.sqrt(norm) * radius[None, :]
    top = np.minimum((norm + largest - np.maximum(away - radius[None, :], 0) ** 2) / 2, inner + reach)
    low = np.maximum((norm + largest - (away + radius[None, :]) ** 2) / 2, inner - reach)
    return low - slack, top + slack


class Searcher:
    """Search of one block of candidates."""

    def __init__(self, rows, ids, known, labels, x, largest):
        import numpy as np

        self.largest = float(largest)
        self.tree = Tree(augmented(x, largest))
        o = self.tree.order
        self.rows, self.ids, self.known, self.labels, self.x = rows[o], ids[o], known[o], labels[o], x[o]
        # Products of doubles are exact while every sum stays below 2^53.
        self.exact = float(largest) < 2.0 ** 52
        self.floats = self.x.astype(float) if self.exact else None
        self.visited = 0
        self._levels = list(self.tree.levels())

    def search(self, anchors, of, low, high, same, k):
        """For each window (anchor number, low, high) the first ``k`` rows of the anchor's label (or of others) in it.

        ``anchors``: (rows, labels, vectors). Returns arrays (window, candidate, score), best first in each window.
        """
        import numpy as np

        rows, labels, v = anchors
        w, tree = len(of), self.tree
        floats = v.astype(float)
        products = (lambda mine, a, b: np.rint(floats[mine] @ self.floats[a:b].T)) if self.exact else (lambda mine, a, b: v[mine] @ self.x[a:b].T)
        alive = np.ones((w, 1), bool)
        held_leaves, held_top = [], []
        for level in self._levels:
            lo, top = (b[of] for b in bounds(tree.centres[level], tree.radius[level], floats, self.largest))
            alive = alive & (top >= low[:, None]) & (lo <= high[:, None])
            ends = np.flatnonzero(tree.leaf[level, 1] > tree.leaf[level, 0])
            held_leaves.append(level[ends])
            held_top.append(np.where(alive[:, ends], top[:, ends], -np.inf))
            fan = tree.child[level, 1] - tree.child[level, 0]
            alive = np.repeat(alive, fan, axis=1)
        leaf, top = tree.leaf[np.concatenate(held_leaves)], np.concatenate(held_top, axis=1)
        floor = low.copy()
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        width = WIDTH
        while (top > -np.inf).any():
            # Each window takes its leaves with the highest bounds; windows that want the same leaf are verified together.
            take = np.argpartition(-top, width - 1, axis=1)[:, :width] if top.shape[1] > width else np.broadcast_to(np.arange(top.shape[1]), top.shape)
            who, where = np.nonzero(np.take_along_axis(top, take, 1) > -np.inf)
            node = take[who, where]
            top[who, node] = -np.inf
            by = np.argsort(node, kind="stable")
            who, node = who[by], node[by]
            cuts = np.flatnonzero(np.diff(node, prepend=-1))
            found = [best]
            for i, j in zip(cuts, [*cuts[1:], len(node)]):
                a, b = leaf[node[i]]
                windows = who[i:j]
                mine, back = np.unique(of[windows], return_inverse=True)
                scores = products(mine, a, b)
                self.visited += scores.size
                match = self.labels[None, a:b] == labels[mine, None]
                if same:
                    match &= self.rows[None, a:b] != rows[mine, None]
                scores = np.where(match if same else ~match, scores, LOW - 1)[back]
                x, y = np.nonzero((scores >= floor[windows, None]) & (scores <= high[windows, None]))
                found.append((windows[x], y + a, scores[x, y].astype(np.int64)))
            win, at, score = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((self.rows[at], self.ids[at], ~self.known[at], -score, win))
            win, at, score = win[order], at[order], score[order]
            starts = np.flatnonzero(np.diff(win, prepend=-1))
            rank = np.arange(len(win)) - np.repeat(starts, np.diff([*starts, len(win)]))
            full = rank == k - 1
            floor[win[full]] = np.maximum(floor[win[full]], score[full])
            best = win[rank < k], at[rank < k], score[rank < k]
            top[top < floor[:, None]] = -np.inf
            width *= 2
        return best


_HITS = "anchor long, window int, row long, id long, score long"


def _searching(dims: int, largest: int, same: bool, k: int):
    """Rows of one shard after another: first its candidates (visitor 0), of which a tree is built, then windows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["anchor", "window", "row", "id", "score"]
        key, parts, tree = None, [], None

        def answer(p):
            nonlocal tree
            if tree is None:
                tree = Searcher(*(np.concatenate(c) for c in zip(*parts)), largest)
                parts.clear()
            row, label, x, window, low, high = p
            each, first, of = np.unique(row, return_index=True, return_inverse=True)
            for s in range(0, len(row), BLOCK):
                mine, back = np.unique(of[s:s + BLOCK], return_inverse=True)
                anchors = each[mine], label[first[mine]], x[first[mine]]
                win, at, score = tree.search(anchors, back, low[s:s + BLOCK], high[s:s + BLOCK], same, k)
                ids = pa.array(tree.ids[at], mask=~tree.known[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[s:s + BLOCK][win]), pa.array(window[s:s + BLOCK][win].astype(np.int32)),
                     pa.array(tree.rows[at]), ids, pa.array(score)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, visitor = (np.asarray(batch.column(c)) for c in ("shard", "visitor"))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(visitor) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if shard[a] != key:
                    key, parts, tree = shard[a], [], None
                row, label = np.asarray(part.column("row")), np.asarray(part.column("label"))
                x = unpack(part.column("v"), dims)
                if visitor[a] == 0:
                    ids = part.column("id")
                    parts.append((row, np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), label, x))
                elif parts or tree is not None:
                    yield from answer((row, label, x, *(np.asarray(part.column(c)) for c in ("window", "low", "high"))))

    return run


def _regions(pivots, dims: int, salts=None):
    """Region of each row: that of its nearest pivot, and the distance to it; large regions are dealt over shards."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = unpack(batch.column("v"), dims).astype(float)
            gaps = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
            region = gaps.argmin(axis=1)
            away = np.sqrt(((x - pivots[region]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region.astype(np.int32)), pa.array(away)],
                                             names=[*batch.schema.names, "region", "away"])

    return run


def _routed(dims: int, pivots, radius, shards, norms):
    """Copies of a window for each shard whose region's bounds meet it."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        first = np.cumsum(shards) - shards
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = unpack(part.column("v"), dims).astype(float)
                inner = q @ pivots.T
                reach = np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
                slack = 1 + 1e-9 * (np.abs(inner) + reach + norms)
                low, high = np.asarray(part.column("low")), np.asarray(part.column("high"))
                meets = (inner + reach + slack >= low[:, None]) & (inner - reach - slack <= high[:, None]) & (shards > 0)[None, :]
                who, region = np.nonzero(meets)
                each = shards[region]
                who = np.repeat(who, each)
                shard = np.repeat(first[region], each) + np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *part.take(pa.array(who)).columns],
                                                 names=["shard", *part.schema.names])

    return run


def shard_rows(count: int) -> int:
    """Rows of a shard: both what a task holds and how many shards a window goes to grow slower than the comparisons."""
    return int(min(max(64 * count ** 0.5, 4096), 1 << 19))


class Index:
    """Candidates (row, id, label, v) in shards: regions around pivots, large ones dealt over several shards."""

    def __init__(self, rows: DataFrame, dims: int, largest: int, count: int):
        import numpy as np

        self.dims, self.largest = dims, largest
        size = shard_rows(count)
        n = min(max(1, -(-count // size)), PIVOTS)
        sample = rows.orderBy(F.xxhash64("row")).limit(PIVOT_SAMPLE).select("v").toArrow().column("v").combine_chunks()
        points = unpack(sample.chunk(0) if hasattr(sample, "chunk") else sample, dims).astype(float)
        chosen, gaps = [0], None
        while len(chosen) < n:
            d = ((points - points[chosen[-1]]) ** 2).sum(axis=1)
            gaps = d if gaps is None else np.minimum(gaps, d)
            if gaps.max() == 0:
                break
            chosen.append(int(gaps.argmax()))
        self.pivots = points[chosen]
        k = len(chosen)
        placed = rows.mapInArrow(_regions(self.pivots, dims), "row long, id long, label int, v binary, region int, away double")
        self.rows = materialize(placed, "regions")
        about = self.rows.groupBy("region").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()  # PIVOTS rows
        self.radius, held = np.zeros(k), np.zeros(k, np.int64)
        for r in about:
            self.radius[r.region], held[r.region] = r.r, r.n
        self.shards = -(-held // size)
        first = F.lit((np.cumsum(self.shards) - self.shards).tolist())
        deal = F.pmod(F.xxhash64("row"), F.get(F.lit(self.shards.tolist()), F.col("region")))
        self.dealt = self.rows.select((F.get(first, F.col("region")) + deal).cast("int").alias("shard"), F.lit(0).alias("visitor"),
                                      "row", "id", "label", "v", F.lit(0).alias("window"), F.lit(0).cast("long").alias("low"),
                                      F.lit(0).cast("long").alias("high"))

    def search(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """Rows (anchor, window, row, id, score, rank): the first ``k`` hits of each window (row, label, v, window, low, high)."""
        import numpy as np

        route = _routed(self.dims, self.pivots, self.radius, self.shards, float(self.largest))
        windows = windows.select("row", "label", "v", F.col("window").cast("int").alias("window"), "low", "high")
        sent = (windows.mapInArrow(route, "shard int, row long, label int, v binary, window int, low long, high long")
                .select("shard", F.lit(1).alias("visitor"), "row", F.lit(None).cast("long").alias("id"), "label", "v", "window", "low", "high"))
        n = max(shuffle_partitions(windows.sparkSession), int(np.sum(self.shards)))
        hits = (self.dealt.union(sent).repartition(n, "shard").sortWithinPartitions("shard", "visitor", "row")
                .mapInArrow(_searching(self.dims, self.largest, same, k), _HITS))
        # At most k rows of a window come from a shard; their best k are taken before the exchange and after it.
        order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
        return hits.withColumn("rank", F.row_number().over(_by_window().orderBy(*order))).filter(F.col("rank") <= k)


def _by_window():
    from pyspark.sql import Window

    return Window.partitionBy("anchor", "window")


def hard_negatives(candidates: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Candidates are all rows with a label and a vector of finite components, which become floor(scale * x); ``label``
    gives a row's label, rows for which ``anchor`` holds are anchors; both are expressions over ``candidates``. An
    anchor's positives are the ``positives`` other rows of its label with the highest inner products. For each positive the
    first ``negatives`` rows of other labels come whose score is at least ``low`` and at most ``high`` hundredths of the positive's.
    Higher scores come first, ties by smaller id (rows without an id last), then in any fixed order.

    Rows with a null id are candidates but no anchors. Repeated rows count one by one, and of two rows with one id each is
    "other" to the other. Shorter vectors, also empty ones, end in zeros. An empty table, an anchor without
    positives or a positive without negatives give no rows. Other columns are not read, whatever their names. Every window is answered
    exactly. The bounded sample of PIVOT_SAMPLE rows only chooses the regions in which rows are stored.
    """
    spark = candidates.sparkSession
    rows = (candidates.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"),
                              F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), F.col(vector_col).alias("_v"))
            .filter(F.col("label").isNotNull() & usable("_v")).select("id", "label", "anchor", quantized("_v", scale).alias("v")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    n, dims, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    packed = materialize(rows.mapInArrow(_packed(dims), "row long, id long, label int, anchor boolean, v binary"), "packed")
    drop_written(rows)
    index = Index(packed.select("row", "id", "label", "v"), dims, largest, n)
    asked = packed.filter("anchor").select("row", "label", "v", F.lit(0).alias("window"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"))
    near = materialize(index.search(asked, True, positives), "positives")
    windows = (near.select(F.col("anchor").alias("row"), F.col("rank").alias("window"), F.col("score"))
               .join(packed.select("row", "label", "v"), "row")
               .select("row", "label", "v", "window", F.ceil(F.col("score") * F.lit(low).cast("decimal(5,0)") / 100).cast("long").alias("low"),
                       F.floor(F.col("score") * F.lit(high).cast("decimal(5,0)") / 100).cast("long").alias("high"))
               .filter("low <= high"))
    hard = index.search(windows, False, negatives)
    about = (near.join(packed.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
             .select("anchor", "anchor_id", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    return (hard.join(about, ["anchor", "window"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def _packed(dims: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "anchor")), pack(lists(batch.column("v"), dims))],
                                             names=["row", "id", "label", "anchor", "v"])

    return run


#: DuckDB SQL for the rows of the query.
REFERENCE_SQL = """
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
                        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
                        FROM kept a JOIN kept b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT s.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY s.ar, p.r ORDER BY s.score DESC, s.vec_id) AS rank
        FROM scored s JOIN pos p ON s.ar = p.ar
        WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""
