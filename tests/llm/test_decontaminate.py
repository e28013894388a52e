import random
import re

import duckdb

from arborlake.llm import decontaminate, queries
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(doc, items, length):
    """(n_hit, item ids) by looking at every position of every window."""
    d, hit, found = words(doc), set(), set()
    for item, text in items:
        w = words(text)
        size = min(length, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            for p in range(len(d) - size + 1):
                if d[p:p + size] == w[a:a + size]:
                    hit |= set(range(p, p + size))
                    found.add(str(item))
    return len(d), len(hit), sorted(found)


def rows(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in frame.collect())


def test_random_texts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a b c D e-f g, 中 é".split()) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(3, "a b c"), (None, "a b c d e"), (99, None)]
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(4, "a b c"), (None, "c c c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    expected = sorted((i is None, i or 0, *slow(t, named, 4)) for i, t in docs)
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 50)
    assert rows(decontaminate.contamination(frame, bench, 4)) == expected
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 15)  # several passes over the index
    assert rows(decontaminate.contamination(frame, bench, 4)) == expected


def test_proximity_finds_reordered_words(spark):
    docs = spark.createDataFrame([(1, "x x gamma beta alpha x"), (2, "alpha x x x x x x x beta gamma"), (3, "alpha beta gamma")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.contamination(docs, bench, 3, slop=4).collect()}
    assert got == {1: ([], ["7"]), 2: ([], []), 3: (["7"], ["7"])}


def test_full_index_keeps_every_posting(spark):
    docs = spark.createDataFrame([(1, "B a b"), (2, "b")], "doc_id long, text string")
    index = decontaminate.build_index(docs.coalesce(1)).collect()
    lists = {r.term: decontaminate._unpack(r.positions).tolist() for r in index if r.term}
    assert lists == {"a": [1], "b": [0, 2, 4]}


def test_query_equals_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = sorted(con.execute(queries.OP8_SQL).fetchall())
    assert sorted(map(tuple, queries.QUERIES["op8_benchmark_decontamination"](spark, SF).collect())) == expected


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "b c d"), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.contamination(odd, bench, 3)
    assert got.count() == len(ODD)
    assert {r.doc_id for r in got.filter("contaminated").collect()} == {1, 2, None}
    assert got.filter("doc_id = 3").first().n_words == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0
