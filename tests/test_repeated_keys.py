"""A base may hold a key more than once; a change of the key then meets each of its rows."""

from pyspark.sql import functions as F

from arborlake.operators import overlay as ov
from arborlake.runtime import scratch_path
from arborlake.streaming import upkeep
from conftest import frame, record

JOURNAL = "drive string, usn long, frs long, parent_frs long, reason long, name string"
BASE = [record(5, 5, ".", is_dir=True), record(100, 5, "a.txt", 10), record(100, 5, "b.log", 20), record(101, 5, "c.txt", 30),
        record(101, 5, "d.txt", 40), record(102, 5, "e.txt", 50)]


def state(df):
    return sorted((r.frs, r.name, r.size) for r in df.select("frs", "name", "size").collect())


def test_store_keeps_every_row_of_a_renamed_key(spark):
    store = upkeep.CatalogStore(spark, scratch_path(spark, "repeated"))
    store.create(frame(spark, BASE).withColumn("ext", F.lit("")), {"C": 1})
    renamed = [("C", 1, 100, 5, 0x2000, "n.txt"), ("C", 2, 101, 5, 0x200, "c.txt")]
    store.apply_batch(spark.createDataFrame(renamed, JOURNAL), 0)
    expected = [(5, ".", 0), (100, "n.txt", 10), (100, "n.txt", 20), (102, "e.txt", 50)]
    assert state(store.read()) == expected
    store.apply_batch(spark.createDataFrame([("C", 3, 100, 5, 0x2000, "m.txt")], JOURNAL), 1)
    expected = [(5, ".", 0), (100, "m.txt", 10), (100, "m.txt", 20), (102, "e.txt", 50)]
    assert state(store.read()) == expected
    store.compact()
    assert state(store.read()) == expected


def test_overlay_keeps_every_row_of_the_last_batch(spark):
    base = frame(spark, BASE)
    one = base.filter("frs = 100").withColumns({"name": F.lit("x"), "batch": F.lit(1), "tombstone": F.lit(False)})
    two = one.withColumns({"name": F.lit("y"), "batch": F.lit(2)})
    gone = base.filter("frs = 101").withColumns({"batch": F.lit(2), "tombstone": F.lit(True)})
    got = state(ov.overlay(base, one.unionByName(two).unionByName(gone)))
    assert got == [(5, ".", 0), (100, "y", 10), (100, "y", 20), (102, "e.txt", 50)]
