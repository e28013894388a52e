"""Several aggregations of one catalog from one scan.

Rows are grouped once by the keys of all aggregations (or by a few sets of them, where their values would multiply too much),
and each result is merged from those partial sums, counts, minima and maxima.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import derive
from arborlake.operators import aggregate as agg
from arborlake.runtime import materialize
from arborlake.schema import field

#: Groups that the keys of one set may have together, by the weights below.
MOST_GROUPS = 1 << 20
# Values a key is taken to have; it decides about the sets, not about results.
_MANY, _MONTHS = 1 << 16, 1 << 10
_VALUES = {"drive": 26, "type": 32}


@dataclass(frozen=True)
class Spec:
    """One aggregation: kind, field and what the kind needs."""

    kind: str
    name: str | None = None
    metrics: tuple[str, ...] | None = None
    top: int | None = None
    bounds: tuple[int, ...] = dc_field(default=())
    calendar: str = "month"

    @property
    def key_name(self) -> str | None:
        if self.kind in ("count", "stats") or (self.kind == "missing" and self.name == "size"):
            return None
        if self.kind in ("missing", "distinct"):
            return f"raw_{self.name}"
        return f"{self.kind}_{self.name}" + (f"_{self.calendar}" if self.kind == "date" else "")

    def key(self, df: DataFrame) -> Column:
        if self.kind == "terms":
            return agg.group_key(df, self.name)
        value = derive.field_column(df, field(self.name).name)
        if self.kind == "range":
            return agg.range_key(value, sorted(self.bounds))
        return agg.date_key(value, self.calendar) if self.kind == "date" else value

    @property
    def values(self) -> int:
        if self.kind == "range":
            return len(self.bounds) + 2
        if self.kind == "date":
            return _MONTHS
        return 3 if field(self.name).kind == "bool" else _VALUES.get(field(self.name).name, _MANY)


def key_sets(specs: list[Spec]) -> list[list[str]]:
    """Keys that are grouped together: few-valued ones first, a new set where the product would grow too large."""
    keys = {s.key_name: s.values for s in specs if s.key_name}
    sets: list[list[str]] = []
    sizes: list[int] = []
    for key, n in sorted(keys.items(), key=lambda kv: (kv[1], kv[0])):
        at = next((i for i, size in enumerate(sizes) if size * n <= MOST_GROUPS), None)
        if at is None:
            sets.append([])
            sizes.append(1)
            at = -1
        sets[at].append(key)
        sizes[at] *= n
    return sets or [[]]


def fold(df: DataFrame, specs: dict[str, Spec]) -> dict[str, DataFrame]:
    """Results of the aggregations by label; the partial table they share is written to the shared folder by this call."""
    for s in specs.values():
        if s.kind == "stats" and s.name not in ("size", "size_on_disk"):
            raise ValueError(f"no partial sums of {s.name!r}")
    sets = key_sets(list(specs.values()))
    keys = {s.key_name: s.key(df) for s in specs.values() if s.key_name}
    order = list(keys)
    partials = [*agg._partials(), F.count("size").alias("sized"), F.count_if(F.col("size").isNull() | (F.col("size") == 0)).alias("zeros"),
                F.min("allocated_size").alias("min_allocated"), F.max("allocated_size").alias("max_allocated"),
                F.count("allocated_size").alias("allocated")]
    keyed = df.select(*[c.alias(k) for k, c in keys.items()], "size", "allocated_size")
    if len(sets) == 1:
        base = keyed.groupBy(*order).agg(*partials, F.lit(0).cast("bigint").alias("set"))
        number = [0]
    else:
        base = keyed.groupingSets([[F.col(k) for k in one] for one in sets], *[F.col(k) for k in order]).agg(
            *partials, F.grouping_id().cast("bigint").alias("set"))
        number = [sum(1 << (len(order) - 1 - i) for i, k in enumerate(order) if k not in one) for one in sets]
    base = materialize(base, "fold")
    return {label: _result(s, base, sets, number) for label, s in specs.items()}


def _result(s: Spec, base: DataFrame, sets: list[list[str]], number: list[int]) -> DataFrame:
    at = next(i for i, one in enumerate(sets) if s.key_name is None or s.key_name in one)
    rows = base.filter(F.col("set") == number[at])
    total = F.coalesce(F.sum("count"), F.lit(0))
    if s.kind == "count":
        return rows.agg(total.alias("count"))
    if s.kind == "stats":
        bytes_, least, most, n = (("total_bytes", "min_size", "max_size", "sized") if s.name == "size" else
                                  ("total_allocated", "min_allocated", "max_allocated", "allocated"))
        some = F.sum(n) > 0
        summed = F.coalesce(F.sum(bytes_), F.lit(0))
        forms = {"sum": summed, "min": F.coalesce(F.min(F.when(F.col(n) > 0, F.col(least))), F.lit(0)),
                 "max": F.coalesce(F.max(F.when(F.col(n) > 0, F.col(most))), F.lit(0)),
                 "avg": F.when(some, F.sum(bytes_) / F.sum(n)).otherwise(F.lit(0.0)), "count": total}
        return rows.agg(*[forms[m].alias(m) for m in s.metrics])
    if s.kind == "missing" and s.name == "size":
        return rows.agg(F.coalesce(F.sum("zeros"), F.lit(0)).alias("missing"))
    key = F.col(s.key_name)
    if s.kind == "missing":
        return rows.agg(F.coalesce(F.sum(F.when(key.isNull() | (key == ""), F.col("count"))), F.lit(0)).alias("missing"))
    if s.kind == "distinct":
        return rows.agg(F.count_distinct(key).alias("distinct"))
    grouped = rows.groupBy(key.alias("key")).agg(*agg._merged())
    if s.kind == "terms":
        return agg.top_terms(grouped, s.name, s.top, s.metrics)
    return agg._with_metrics(grouped, s.metrics, *agg._group_totals(grouped, s.metrics)[:2])
