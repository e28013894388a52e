"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``catalog_build`` and ``index_build`` are the cold costs; every other entry is the
median of three runs over the written catalog, result rows fully produced.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, functions as F

from arborlake import Catalog, Filters, build_session
from arborlake.operators import aggregate as agg, duplicates as dup, hierarchy as h, ngrams
from arborlake.runtime import materialize, scratch_path
from arborlake.sources import binding, sinks
from arborlake.streaming import changes as ch, upkeep
from checks.base import AS_OF

RUNS = 3


def produce(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        # Small tables: one task per file and core instead of a few packed tasks.
        "spark.sql.files.minPartitionNum": str(2 * int(cpus)) if cpus.isdigit() else "16"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    # Start the executor threads and load the classes before the clock runs.
    produce(binding.table(spark, sf_dir, "nation").groupBy("n_regionkey").count())

    cat: Catalog | None = None

    def build():
        nonlocal cat
        cat = Catalog.prepare(binding.catalog(spark, sf_dir), AS_OF)

    seconds["catalog_build"] = timed(build)
    records = cat.rows.count()
    seconds["index_build"] = timed(lambda: (cat.dirs.numbers, cat.sums.count()))
    grams = []
    seconds["ngram_build"] = timed(lambda: (grams.append(cat.grams), cat.gram_counts))
    docs = binding.documents(spark, sf_dir)

    def search(pattern, filters=None, **options):
        return lambda: produce(cat.search(pattern, filters, paths=True, **options))

    def verify():
        groups = dup.groups(docs, ("size",))
        groups = materialize(groups, "groups")
        produce(dup.verify(groups, dup.members(docs, groups, ("size",)), docs, ("size",)))

    net = materialize(ch.net_changes(binding.changes(spark, sf_dir)), "net")

    def apply_batch():
        produce(upkeep.apply_changes(cat.rows, net)[0])

    def refresh():
        after = cat.rows.withColumn("name", F.when(renamed_key, F.concat(F.lit("x_"), "name")).otherwise(F.col("name")))
        h.refresh_directories(cat.dirs, after, cat.rows.filter(renamed_key)).table.count()

    renamed_key = F.col("is_directory") & F.col("frs").between(1_000_000, 99_999_999) & (F.col("frs") % 50 == 0)

    def overview():
        spark.catalog.clearCache()   # each run scans the catalog anew
        for d in cat.preset("overview").values():
            produce(d)

    def export_csv():
        cat.export(scratch_path(spark, "bench"), fmt="csv", columns="all")

    actions = {
        "scan_count": lambda: cat.rows.count(),
        "export_csv_all": export_csv,
        "export_paths": lambda: produce(sinks.listing(cat.with_paths(cat.tree_rows))),
        "exact_name": search("old_ring_3.pdf", whole_word=True),
        "prefix": search("cold_*"),
        "rare_extension": search("*.xyz"),
        "common_extension": search("*.dll"),
        "regex": search(">^(hot|cold)_.*\\.(pdf|jpg)$"),
        "regex_indexed": lambda: produce(cat.with_paths(cat.regex("^(hot|cold)_.*_3\\.(pdf|jpg)$"))),
        "substring": search("ring"),
        "ngram_substring": lambda: produce(ngrams.ngram_search(cat.rows, grams[0], "d_ring_3")),
        "path_pattern": search("\\nation_1\\**\\*.pdf"),
        "top100_modified": search("*", sort="-modified", limit=100),
        "top100_path": search("*", sort="path", limit=100),
        "filtered_search": search("*", Filters(mode="files", min_size="10MB", newer="2000-01-01", type="document")),
        "overview": overview,
        "by_extension": lambda: produce(cat.preset("by_extension")["by_extension"]),
        "by_type": lambda: produce(cat.preset("by_type")["by_type"]),
        "date_histogram": lambda: produce(agg.date_histogram(cat.rows, "modified", "month")),
        "duplicates": lambda: produce(dup.duplicates(cat.rows, ("name",), 100, 2)),
        "duplicates_sha256": verify,
        "rollup_depth3": lambda: produce(agg.rollup_path(cat.rows, cat.dirs, 3, 30)),
        "tree_metrics": lambda: produce(h.tree_sums(cat.rows, cat.dirs)),
        "expand_descendants": lambda: produce(h.expand_descendants(
            cat.rows, cat.dirs, cat.rows.filter(F.col("is_directory") & F.col("name").endswith("7")))),
        "apply_changes": apply_batch,
        "refresh_directories": refresh,
    }
    only = sys.argv[1:]
    for name, action in actions.items():
        if only and name not in only:
            continue
        seconds[name] = statistics.median(timed(action) for _ in range(RUNS))
        print(f"{name}: {seconds[name]:.3f}", file=sys.stderr, flush=True)

    rate = {n: round(records / seconds[n]) for n in (
        "scan_count", "export_csv_all", "export_paths", "tree_metrics", "catalog_build") if n in seconds}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {n: round(s, 3) for n, s in seconds.items()}, "sf": sf_dir.rstrip("/").split("sf")[-1],
        "records": records, "rows_per_sec": rate}))
    spark.stop()


if __name__ == "__main__":
    main()
