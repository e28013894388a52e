"""The catalog is written from the partitions its rows come in."""

from pyspark.sql import functions as F

from arborlake.catalog import Catalog
from arborlake.sources import binding
from conftest import frame, record

ROWS = [record(5, 5, ".", is_dir=True)] + [record(100 + i, 5, f"f{i % 17}.{'abc'[i % 3]}", i) for i in range(300)]


def test_rows_are_not_exchanged_for_the_layout(spark, capsys):
    binding.prepared(frame(spark, ROWS)).explain()
    assert "Exchange" not in capsys.readouterr().out
    written = Catalog.prepare(frame(spark, ROWS).repartition(3)).rows
    assert sorted((r.frs, r.name, r.ext) for r in written.collect()) == sorted((r[1], r[3], r[3].rpartition(".")[2] if not r[4] else "") for r in ROWS)
    files = written.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).collect()
    for name in {r.file for r in files}:
        rows = [(r.ext, r.name) for r in sorted((r for r in files if r.file == name), key=lambda r: r.at)]
        assert rows == sorted(rows)
