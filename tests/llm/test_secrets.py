import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from arborlake.llm import queries, secrets
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
KEYED = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    out = [(m.start(), 0, m.end(), m.group(2)) for m in KEYED.finditer(text or "") if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end(), m.group()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end(), m.group()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m.group()) >= 32]
    return sorted(out)


def slow_scan(rows):
    """rows: (doc_id, text, source)."""
    base = [slow_base(t) for _, t, _ in rows]
    owners, repos = {}, {}
    for (doc_id, _, source), spans in zip(rows, base):
        for s in spans:
            owners.setdefault(s[3], set()).add(source or "")
            repos.setdefault(s[3], set()).add((source or "", doc_id))
    out = []
    for (doc_id, _, _), spans in zip(rows, base):
        added = set()
        for _, _, end, v in spans:
            odd = len(set(v)) >= 8 and not re.search(secrets.PLACEHOLDER, v)
            copied = len(owners[v]) >= 3 or len(repos[v]) >= 20
            if copied or len(owners[v]) == 1 and len(repos[v]) <= 5 and odd:
                added.add((end - len(v), 4 if copied else 3, end))
        names = [*secrets.KINDS, *secrets.ADDED]
        text = lambda some: ",".join(f"{names[k]}:{b}:{e}" for b, k, e in some)
        plain = [s[:3] for s in spans]
        out.append((doc_id, *[sum(s[1] == k for s in spans) for k in range(3)],
                    hashlib.sha256(text(plain).encode()).hexdigest(), text(sorted([*plain, *added]))))
    return sorted(map(repr, out))


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(8)
    bits = ["token", "Secret", "api_key", "APIKEY", "=", ":", " = ", "\"", "'", " ", "é😀", "\n", "AKIA", "AKIAABCDEFGHIJKL", "abcdef0123456789" * 2,
            "a1b2c3d4", "hunter2hunter2", "xxxxxxxxxxxx", "Qw9/Zx8+Lm7=", "secret:abcdefgh", "token=short", "."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), rng.choice(["s1", "s2", "s3", None])) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(repr(tuple(r)) for r in secrets.digest(secrets.scan(frame)).collect()) == slow_scan(rows)


def test_copied_and_live(spark):
    value = "f3Kq9ZtW1pLm"
    rows = [(i, f"password={value}", f"s{i}") for i in range(3)] + [(9, "token: Zx81mmQpTr77", "s1"), (10, "token: aaaaaaaaaaaa", "s1")]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[0] == "assign:0:21,copied:9:21" and got[9] == "assign:0:19,live:7:19" and got[10] == "assign:0:19"


def test_many_repositories_of_one_owner_are_copies(spark):
    """A hot owner's example is no live secret; between the two bounds nothing is decided."""
    rows = [(i, "token=Zx81mmQpTr77", "hot") for i in range(40)] + [(100 + i, "token=Qw52nnVbYu09", "hot") for i in range(5)]
    rows += [(200 + i, "token=Lk33ppXcWe41", "hot") for i in range(12)] + [(300 + i, "token=Gh64ssDfRt28", f"s{i % 2}") for i in range(22)]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[0] == got[300] == "assign:0:18,copied:6:18" and got[100] == "assign:0:18,live:6:18" and got[200] == "assign:0:18"


def test_query_equals_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op5_secret_scan"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.OP5_SQL).fetchall())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark, odd, none):
    secret = odd.withColumn("text", F.when(F.col("doc_id") == 1, "😀 token=Zx81mmQpTr77").otherwise(F.col("text")))
    rows = secrets.digest(secrets.scan(secret)).collect()
    assert len(rows) == len(ODD)
    assert {r.spans for r in rows if r.doc_id == 1} == {"assign:2:20,live:8:20"}
    assert {r.spans for r in rows if r.doc_id != 1} == {""}
    assert secrets.digest(secrets.scan(none)).count() == 0
