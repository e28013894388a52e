"""Centroid clustering: exact k-means whose rows remember their two nearest centroids and bounds on the distances.

A row keeps an upper bound on the distance to its centroid and a lower bound on that to all others. While the bounds
stay apart after the centroids moved, nothing is compared. Otherwise the distances to both remembered centroids
are taken, and the search starts from the closer one: its neighbours come in order of their distance from it, and
those beyond the sum of the two least distances so far can be neither nearest nor second nearest, so the ball
shrinks while better ones are found. All comparisons that decide are of squared distances in integers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from arborlake.llm.vectors import lists, pack, quantized, unpack, usable
from arborlake.runtime import drop_written, materialize

#: Bounds are floating-point numbers; by this share they are widened, so that rounding can't skip a centroid.
SLACK = 1e-9


def _geometry(centres, moved=None):
    """What a pass needs of the centroids: their distances, neighbours in order, half the least one, and movements."""
    import numpy as np

    k = len(centres)
    apart = np.sqrt(np.array([((centres - c) ** 2).sum(axis=1) for c in centres], float).reshape(k, k))
    order = np.argsort(apart + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
    half = np.take_along_axis(apart, order, 1)[:, 1] / 2 * (1 - SLACK) if k > 1 else np.full(k, np.inf)
    return {"centres": centres, "order": order, "apart": np.take_along_axis(apart, order, 1) * (1 - SLACK), "half": half,
            "moved": np.zeros(k) if moved is None else moved}


def nearest(x, geo, first, second, upper, lower, stats=None):
    """Nearest and second nearest centroid of each row of ``x`` and new bounds, from those before the movement.

    Equal distances go to the smaller number. ``stats`` (a dict) counts rows skipped and distances taken.
    """
    import numpy as np

    centres, k = geo["centres"], len(geo["centres"])
    first, second = first.copy(), second.copy()
    moved = geo["moved"]
    upper = (upper + moved[first]) * (1 + SLACK)
    # All others moved by the largest movement at most; if the own centroid moved most, by the second largest.
    top = np.argsort(-moved, kind="stable")[:2]
    lower = np.maximum(lower - np.where(first == top[0], moved[top[-1]] if k > 1 else 0.0, moved[top[0]]), 0) * (1 - SLACK)
    taken = 0

    def squared(rows, numbers):
        nonlocal taken
        taken += len(rows)
        return ((x[rows] - centres[numbers]) ** 2).sum(axis=1)

    rows = np.flatnonzero(upper >= np.maximum(lower, geo["half"][first]))
    a = squared(rows, first[rows])
    upper[rows] = np.sqrt(a) * (1 + SLACK)
    still = upper[rows] >= np.maximum(lower[rows], geo["half"][first[rows]])
    rows, a = rows[still], a[still]
    if k == 1:
        lower[rows] = np.inf
        rows, a = rows[:0], a[:0]
    if len(rows):
        best, other = first[rows], second[rows]
        b = squared(rows, other)
        swap = (b < a) | ((b == a) & (other < best))
        best, other = np.where(swap, other, best), np.where(swap, best, other)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        origin, reach = best.copy(), np.sqrt(a)
        order, apart = geo["order"][origin], geo["apart"][origin]
        known = other.copy()
        active = np.arange(len(rows))
        for j in range(1, k):
            active = active[apart[active, j] <= (reach[active] + np.sqrt(b[active])) * (1 + SLACK)]
            if not len(active):
                break
            at = active[order[active, j] != known[active]]
            c = order[at, j]
            d = squared(rows[at], c)
            closer = (d < a[at]) | ((d == a[at]) & (c < best[at]))
            next_best = ~closer & ((d < b[at]) | ((d == b[at]) & (c < other[at])))
            i = at[closer]
            other[i], b[i] = best[i], a[i]
            best[i], a[i] = c[closer], d[closer]
            i = at[next_best]
            other[i], b[i] = c[next_best], d[next_best]
        first[rows], second[rows] = best, other
        upper[rows], lower[rows] = np.sqrt(a) * (1 + SLACK), np.sqrt(b) * (1 - SLACK)
    if stats is not None:
        stats["rows"] = stats.get("rows", 0) + len(x)
        stats["skipped"] = stats.get("skipped", 0) + len(x) - len(rows)
        stats["distances"] = stats.get("distances", 0) + taken
    return first, second, upper, lower


_STATE = "row long, v binary, first int, second int, upper double, lower double"


def _start(dims: int, geo):
    """First assignment of rows (row, v array)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        k = len(geo["centres"])
        for batch in batches:
            x = lists(batch.column("v"), dims)
            n = len(x)
            zero = np.zeros(n, np.int64)
            out = nearest(x, geo, zero, zero + min(1, k - 1), np.full(n, np.inf), np.zeros(n))
            yield _state(batch.column("row"), pack(x), out)

    return run


def _state(row, packed, out):
    import numpy as np
    import pyarrow as pa

    cols = [pa.array(c.astype(np.int32)) for c in out[:2]] + [pa.array(c) for c in out[2:]]
    return pa.RecordBatch.from_arrays([row, packed, *cols], names=["row", "v", "first", "second", "upper", "lower"])


def _again(dims: int, geo):
    """Assignment of rows that carry their state from the pass before."""
    def run(batches):
        import numpy as np

        for batch in batches:
            first, second, upper, lower = (np.asarray(batch.column(c)) for c in ("first", "second", "upper", "lower"))
            out = nearest(unpack(batch.column("v"), dims), geo, first.astype(np.int64), second.astype(np.int64), upper, lower)
            yield _state(batch.column("row"), batch.column("v"), out)

    return run


def _sums(dims: int, k: int):
    """One row (cluster, n, sums) of each cluster in a task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x, first = unpack(batch.column("v"), dims), np.asarray(batch.column("first"))
            n += np.bincount(first, minlength=k)
            order = np.argsort(first, kind="stable")
            at = np.flatnonzero(np.diff(first[order], prepend=-1))
            if len(at):
                sums[first[order][at]] += np.add.reduceat(x[order], at, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]),
                                          pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _means(state: DataFrame, centres, dims: int):
    """Centroids of the next round: floor(sum / count) of each component, exactly; k * dims numbers reach the driver."""
    import numpy as np

    k = len(centres)
    each = (state.select("v", "first").mapInArrow(_sums(dims, k), "cluster int, n long, sums array<long>")
            .select("cluster", "n", F.posexplode("sums").alias("pos", "part"))
            .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")))
    out = centres.copy()
    for r in each.collect():
        out[r.cluster, r.pos] = int(r.total) // r.n
    return out, np.sqrt(((out - centres) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)


def _placed(dims: int, geo):
    """Rows (row, cluster, distance) after a last assignment."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        centres = geo["centres"]
        for batch in batches:
            first, second, upper, lower = (np.asarray(batch.column(c)) for c in ("first", "second", "upper", "lower"))
            x = unpack(batch.column("v"), dims)
            found = nearest(x, geo, first.astype(np.int64), second.astype(np.int64), upper, lower)[0]
            d = ((x - centres[found]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found.astype(np.int32)), pa.array(d)],
                                             names=["row", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, scale: int = 256,
             id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id_col, cluster, distance, cluster_inertia, inertia, centroid) of all usable vectors.

    Vectors that are null, have other than ``dims`` components, or a null or non-finite one, are left out. The others
    become integers, floor(scale * x). The first centroids are the ``k`` vectors (all, if fewer) with the least
    SHA-256 of "seed:id", rows without an id last and equal ids by their components; after ``rounds`` rounds
    the rows are assigned once more. ``distance`` is squared, ``centroid`` lists the components of the final centroid.
    Repeated rows and rows with a null id each have their own row in the result. An empty table gives no rows. Of other columns
    none is read, whatever their names.

    Only the centroids (k * dims numbers) are sent to tasks and driver. Each pass writes the packed vectors with
    their bounds, and the pass before is deleted once the next is written.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("row"), F.col(vector_col).alias("_v"))
            .filter(usable("_v") & (F.size("_v") == dims)).select("row", quantized("_v", scale).alias("v")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row").cast("string")), 256)
    start = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    if not start:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centres = np.array([r.v for r in start], np.int64).reshape(len(start), dims)
    geo = _geometry(centres)
    state = materialize(rows.mapInArrow(_start(dims, geo), _STATE), "state")
    for number in range(rounds):
        centres, moved = _means(state, centres, dims)
        geo = _geometry(centres, moved)
        if number < rounds - 1:
            before, state = state, materialize(state.mapInArrow(_again(dims, geo), _STATE), "state")
            drop_written(before)
    placed = materialize(state.mapInArrow(_placed(dims, geo), "row long, cluster int, distance long"), "placed")
    drop_written(state)
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda n: min(n, (1 << 63) - 1)
    about = [(c, held(s), held(sum(sums.values())), [int(v) for v in centres[c]]) for c, s in sorted(sums.items())]
    # One row per centroid, k at most.
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return (placed.join(F.broadcast(about), "cluster")
            .select(F.col("row").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid"))


def centroid_digest(centroid: str) -> "F.Column":
    """Lower-case hexadecimal SHA-256 of a centroid's components, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)


def reference_sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, scale: int = 256) -> str:
    """DuckDB SQL for the rows of the query, each round written out."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims}
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM
  (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM
  (SELECT r, c, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(kept.v, c{i}.v)]) AS BIGINT) AS d
   FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (SELECT c, list(CAST(floor(s / n) AS BIGINT) - CASE WHEN CAST(floor(s / n) AS BIGINT) * n > s THEN 1 ELSE 0 END ORDER BY p) AS v FROM
  (SELECT c, p, CAST(sum(v[p]) AS BIGINT) AS s, count(*) AS n FROM
   (SELECT a{i}.c, v, unnest(range(1, {dims + 1})) AS p FROM kept JOIN a{i} USING (r)) GROUP BY c, p) GROUP BY c)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""
