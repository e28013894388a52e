import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import overlay as ov
from arborlake.runtime import scratch_path
from arborlake.streaming import changes as ch, upkeep
from conftest import frame, record

SCHEMA = "drive string, usn long, frs long, parent_frs long, reason long, name string"
CREATE, DELETE, RENAME, SIZE, META, OTHER = 0x100, 0x200, 0x2000, 0x2, 0x8000, 0x400


def fold(rows):
    """Net changes one record at a time."""
    out = {}
    for drive, _, frs, parent, reason, name in sorted(rows, key=lambda r: r[1]):
        e = out.setdefault((drive, frs), dict(parent=0, name="", c=False, d=False, r=False, s=False, m=False))
        e["parent"] = parent
        e["name"] = name or e["name"]
        if reason & DELETE:
            e.update(d=True, c=False, r=False)
        elif reason & CREATE:
            e.update(c=True, d=False, r=False)
        elif reason & RENAME:
            e.update(r=True, d=False)
        elif reason & 6:
            e["s"] = True
        elif reason & META:
            e["m"] = True
    return out


def journal(seed, n=400, ids=40):
    rng = random.Random(seed)
    return [("C", i, rng.randrange(100, 100 + ids), rng.choice([5, 20]),
             rng.choice([CREATE, DELETE, RENAME, SIZE, META, OTHER, CREATE | DELETE]),
             rng.choice(["", f"n{i}.txt"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_net_changes_match_the_fold(spark, seed):
    rows = journal(seed)
    got = {(r["drive"], r["frs"]): dict(
        parent=r["parent_frs"], name=r["name"], c=r["is_created"], d=r["is_deleted"], r=r["is_renamed"],
        s=r["size_changed"], m=r["metadata_changed"])
        for r in ch.net_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == fold(rows)


def apply_by_hand(catalog, rows):
    """Catalog {key: (parent, name, size)} after one batch."""
    out, counts = dict(catalog), {}
    for key, e in fold(rows).items():
        if e["d"]:
            action = "deleted" if out.pop(key, None) else "skipped"
        elif e["c"]:
            action = "created" if e["name"] else "skipped"
            if e["name"]:
                out[key] = (e["parent"], e["name"], 0)
        elif e["r"] and key in out and e["name"]:
            action = "renamed"
            out[key] = (e["parent"], e["name"], out[key][2])
        else:
            action = "skipped"
        counts[action] = counts.get(action, 0) + 1
    return out, counts


def start(spark):
    return frame(spark, [record(5, 5, ".", is_dir=True), record(20, 5, "d", is_dir=True)] + [
        record(i, 20, f"old{i}.log", i) for i in range(100, 140, 2)]).withColumn("ext", F.lit("log"))


def state(df):
    return {(r["drive"], r["frs"]): (r["parent_frs"], r["name"], r["size"]) for r in df.collect()}


def test_apply_matches_one_by_one(spark):
    rows = journal(3)
    base = start(spark)
    after, counts = upkeep.apply_changes(base, ch.net_changes(spark.createDataFrame(rows, SCHEMA)))
    expected, actions = apply_by_hand(state(base), rows)
    assert state(after) == expected
    assert {r["action"]: r["files"] for r in counts.collect()} == actions
    created = after.filter("size = 0 and name like 'n%'").first()
    assert created["ext"] == "txt" and created["modified"] is None


def test_attached_metadata_is_used(spark):
    rows = [("C", 1, 300, 5, CREATE, "a.bin", 77, 16), ("C", 2, 100, 5, RENAME, "b.bin", 55, 34), ("C", 3, 102, 5, RENAME, "c", None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", size long, flags int")
    after, _ = upkeep.apply_changes(start(spark), ch.net_changes(df))
    got = {r["frs"]: r for r in after.filter("frs in (300, 100, 102)").collect()}
    assert got[300]["size"] == 77 and got[300]["is_directory"] is True
    assert got[100]["size"] == 55 and got[100]["flags"] == 34
    assert got[102]["size"] == 102 and got[102]["ext"] == ""


def test_store_replay_compaction_and_incremental_equality(spark):
    store = upkeep.CatalogStore(spark, scratch_path(spark, "store"))
    base = start(spark)
    store.create(base, {"C": 1})
    expected = state(base)
    for batch in range(4):
        rows = journal(10 + batch, 120)
        expected, actions = apply_by_hand(expected, rows)
        counts = store.apply_batch(spark.createDataFrame(rows, SCHEMA), batch)
        assert {r["action"]: r["files"] for r in counts.collect()} == actions
        assert store.apply_batch(spark.createDataFrame(rows, SCHEMA), batch) is None    # replay
        assert state(store.read()) == expected
        if batch == 2:
            store.compact()
            assert not store.manifest().deltas
            assert state(store.read()) == expected
    assert state(store.read(["C"])) == expected and store.read(["D"]).count() == 0


def test_journal_reset_replaces_the_volume(spark):
    store = upkeep.CatalogStore(spark, scratch_path(spark, "store"))
    both = start(spark).unionByName(start(spark).withColumn("drive", F.lit("D")))
    store.create(both, {"C": 1, "D": 9})
    first = [(*r, 1) for r in journal(5, 50)]
    store.apply_batch(spark.createDataFrame(first, SCHEMA + ", journal_id long"), 0)
    snapshot = start(spark).filter("frs < 110").drop("drive")
    changed = [(*r, 2) for r in journal(6, 50)]
    store.apply_batch(spark.createDataFrame(changed, SCHEMA + ", journal_id long"), 1, lambda d: snapshot)
    rows = store.read()
    assert {r["frs"] for r in rows.filter("drive = 'C'").collect()} == {5, 20, 100, 102, 104, 106, 108}
    assert rows.filter("drive = 'D'").count() == both.count() // 2
    with pytest.raises(RuntimeError):
        store.apply_batch(spark.createDataFrame([(*r, 3) for r in journal(7, 5)], SCHEMA + ", journal_id long"), 2)


def test_two_volumes_may_be_reset_in_one_batch(spark):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        store = upkeep.CatalogStore(spark, scratch_path(spark, "store"))
        store.create(start(spark).unionByName(start(spark).withColumn("drive", F.lit("D"))), {"C": 1, "D": 1})
        rows = [(*r, 2) for r in journal(6, 20)]
        rows += [("D", *r[1:]) for r in rows]
        store.apply_batch(spark.createDataFrame(rows, SCHEMA + ", journal_id long"), 0,
                          lambda d: start(spark).filter("frs < 110" if d == "C" else "frs < 106").drop("drive"))
        got = {d: {r["frs"] for r in store.read([d]).collect()} for d in "CD"}
        assert got == {"C": {5, 20, 100, 102, 104, 106, 108}, "D": {5, 20, 100, 102, 104}}
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_overlay_takes_the_last_row(spark):
    base = start(spark)
    one = base.filter("frs = 100").withColumns({"name": F.lit("x"), "batch": F.lit(1), "tombstone": F.lit(False)})
    two = one.withColumns({"name": F.lit("y"), "batch": F.lit(2)})
    gone = base.filter("frs = 102").withColumns({"batch": F.lit(2), "tombstone": F.lit(True)})
    got = state(ov.overlay(base, one.unionByName(two).unionByName(gone)))
    assert got[("C", 100)][1] == "y" and ("C", 102) not in got and len(got) == base.count() - 1


def test_stream_into_store(spark):
    rows = journal(20, 200)
    path = scratch_path(spark, "journal")
    df = spark.createDataFrame([(*r, 1, None) for r in rows], SCHEMA + ", journal_id long, ts timestamp")
    wanted = [f.name for f in ch.CHANGE_SCHEMA]
    for i in range(3):
        part = df.filter((F.col("usn") >= i * 70) & (F.col("usn") < (i + 1) * 70)).select(*wanted)
        part.coalesce(1).write.mode("append").parquet(path)
    store = upkeep.CatalogStore(spark, scratch_path(spark, "store"))
    base = start(spark)
    store.create(base)
    seen = []
    upkeep.start_upkeep(ch.read_changes(spark, path, max_files=1), store, scratch_path(spark, "points"), trigger=None,
                        compact_every=2, on_batch=lambda b, counts: seen.append(b)).awaitTermination()
    assert seen == [0, 1, 2]
    expected = state(base)
    for i in range(3):
        expected, _ = apply_by_hand(expected, [r for r in rows if i * 70 <= r[1] < (i + 1) * 70])
    assert state(store.read()) == expected


def test_streaming_rates_with_watermark(spark):
    path = scratch_path(spark, "events")
    spark.sql("""select 'C' drive, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int),0) ts
                 from range(120)""").write.parquet(path)
    stream = spark.readStream.schema("drive string, ts timestamp").parquet(path)
    query = (ch.change_rates(stream, "tumbling", "1 hour", watermark="10 minutes").writeStream.format("memory")
             .queryName("rates").outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination()
    assert [r["changes"] for r in spark.table("rates").collect()] == [60, 60]
    with pytest.raises(ValueError):
        ch.change_rates(stream, "daily")
    with pytest.raises(ValueError):
        ch.change_rates(stream)


@pytest.mark.parametrize("mode", ["append", "update"])
def test_parts_of_a_stream_expire_and_add_up(spark, mode):
    """Ten hours of changes, an hour a file; the last file closes the windows and brings rows that are too late."""
    rows = [(d, i, f, p, r, n, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00") for d, i, f, p, r, n in journal(7, n=600)]
    late = [("C", 600 + i, 100 + i, 5, DELETE, "", "2024-01-01 00:30:00") for i in range(5)]
    last = [("C", 700, 999, 5, CREATE, "end", "2024-01-03 00:00:00")]
    path, out = scratch_path(spark, "journal"), scratch_path(spark, "parts")
    schema = SCHEMA + ", ts string"
    for at in range(0, 600, 60):
        part = rows[at:at + 60] + (late if at == 540 else [])
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(last, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    source = ch.read_changes(spark, path, max_files=1)
    query = (ch.change_parts(source, "1 hour", "30 minutes").writeStream.outputMode(mode)
             .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out))
             .option("checkpointLocation", scratch_path(spark, "points")).trigger(availableNow=True).start())
    query.awaitTermination()
    states = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert sum(s.numRowsDroppedByWatermark for s in states) == len({r[2] for r in late})
    assert max(s.numRowsTotal for s in states) <= 3 * 40 and states[-1].numRowsTotal == 1
    expected = rows + (last if mode == "update" else [])
    want = ch.net_changes(spark.createDataFrame(expected, schema).withColumn("ts", F.to_timestamp("ts")))
    got = ch.merge_parts(ch.latest_parts(spark.read.parquet(out)))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        ch.net_changes(source)
