import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from arborlake.llm import queries, winnow
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def slow_kept(text, k=winnow.K, window=winnow.WINDOW):
    """(position, hash) of kept grams, one window after the other."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = []
    for i in range(max(1, len(words) - k + 1) if words else 0):
        seed = 42
        for h in words[i:i + k]:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        grams.append(seed & 0xFFFFFFFF)
    kept = []
    for a in range(max(1, len(grams) - window + 1) if grams else 0):
        at = min(range(a, min(a + window, len(grams))), key=lambda i: (grams[i], -i))
        if (at, grams[at]) not in kept:
            kept.append((at, grams[at]))
    return kept


def slow_like(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def expected(rows):
    """rows: (doc_id, text) in order of descending id."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + nxt[:third]
        a, e, b = slow_kept(text), slow_kept(edited), slow_kept(nxt)
        string = lambda kept: "".join(f"{h:08x}" for _, h in kept)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), string(a), string(e),
                    slow_like(a, e), slow_like(a, b)))
    return out


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_CHARS", 20_000)
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = queries.QUERIES["op7_document_fingerprints"](spark, SF)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(docs))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ties_take_the_rightmost(spark):
    text = "a b c d e " * 12
    df = winnow.with_fingerprint(spark.createDataFrame([(text,)], "t string"), F.col("t"), "kept")
    row = df.select(winnow.positions(F.col("kept")), winnow.hashes(F.col("kept"))).first()
    assert list(zip(*row)) == slow_kept(text)


def test_shared_passages_share_a_hash(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(40):
        passage = [word() for _ in range(winnow.K + winnow.WINDOW - 1)]
        around = [[word() for _ in range(rng.randint(0, 30))] for _ in range(4)]
        rows.append((" ".join(around[0] + passage + around[1]), " ".join(around[2] + passage + around[3])))
    df = winnow.with_fingerprint(winnow.with_fingerprint(spark.createDataFrame(rows, "a string, b string"), F.col("a"), "x"), F.col("b"), "y")
    assert df.filter(winnow.likeness(F.col("x"), F.col("y")) == 0).count() == 0


def test_odd_rows(spark, odd, none):
    got = winnow.beside_next(odd).collect()
    assert len(got) == len(ODD) and winnow.beside_next(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[3].kept == by[4].kept == by[7].kept == [] and by[5].n_chars == 3
    assert by[8].edited == ODD[8][1][:11] + "  \n\t "
    assert [len(r.kept) for r in got if r.doc_id == 1] == [1, 1]
    one = odd.filter("doc_id = 5")
    assert winnow.beside_next(one).first().edited == "ono"
    nulls = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert winnow.beside_next(nulls).count() == len(ODD)
    assert all(r.next_kept is not None for r in winnow.beside_next(nulls).collect() + got)
