"""The catalog of the order tables is built with one exchange by order."""

from datetime import datetime

from arborlake.sources import binding

DAY = datetime(1998, 1, 1)
TABLES = {
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "NOWHERE", 0), (1, "ELSEWHERE", 1)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int", [(1, "Customer#1", 0), (2, "Customer#2", 1)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp", [(1, 1, DAY), (2, 2, DAY), (3, 2, DAY)]),
    "part": ("p_partkey long, p_name string, p_type string", [(1, "old ring", "SMALL"), (2, "hot bolt", "PROMO")]),
    "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_returnflag string, l_shipdate timestamp",
                 [(1, 1, 1, 7.0, 10.5, "N", DAY), (1, 2, 1, 4.0, 1.25, "R", DAY), (2, 1, 1, 5.0, 3.0, "A", DAY),
                  (2, 2, 2, 5.0, 2.0, "A", DAY), (2, 2, 2, 5.0, 2.0, "N", DAY), (9, 1, 1, 1.0, 1.0, "A", DAY)]),
}


def test_lines_of_an_order_are_exchanged_once(spark, tmp_path, capsys):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = binding.catalog(spark, str(tmp_path)).filter("not is_directory")
        files.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
        got = {(r.drive, r.frs): (r.name, r.size, r.link_count, r.flags) for r in files.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {("C", 1_000_000_009): ("hot_bolt_1.JPG", 1175, 2, 34), ("D", 1_000_000_017): ("old_ring_1.txt", 300, 1, 32),
                   ("D", 1_000_000_018): ("hot_bolt_2.JPG", 0, 2, 33)}
