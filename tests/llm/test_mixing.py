from collections import defaultdict

import pytest

from arborlake.llm import mixing, queries
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    """Sizes in order of the sources; shares the excess again until no target is over its cap."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full, left = set(), sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            return [most * s if i in full else share[i] for i, s in enumerate(sizes)]
        for i in over:
            full.add(i)
            left -= most * sizes[i]


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 0, 1000, 7], [0, 0], [10], [1, 2, 3, 400, 5, 6, 7], [9, 1, 1, 1, 1, 1]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "key string, size long")
    got = [r.target for r in mixing.targets(rows).orderBy("key").collect()]
    assert got == pytest.approx(slow_targets(sizes))


def test_shards_share_the_quotas_exactly():
    quotas, depth = [100, 0, 7, 513], 4
    dealt = [mixing.shard_quotas(quotas, s, depth, 9) for s in range(1 << depth)]
    for source, q in enumerate(quotas):
        spans = sorted((first, first + n) for first, n in (d[source] for d in dealt) if n)
        assert sum(b - a for a, b in spans) == q
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and (not spans or spans[0][0] == 0)
    totals = [sum(n for _, n in d) for d in dealt]
    assert max(totals) - min(totals) <= 1
    assert dealt == [mixing.shard_quotas(quotas, s, depth, 9) for s in range(1 << depth)]


def totals(rows):
    out = defaultdict(lambda: [0, 0.0, 0, 0])
    for source, size, target, taken in rows:
        o = out[source]
        o[0], o[1], o[2], o[3] = o[0] + size, target, o[2] + taken, max(o[3], size)
    return out


def test_query(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 1000)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_mix_to_target_weights"](spark, SF).collect()
    again = queries.QUERIES["op3_mix_to_target_weights"](spark, SF).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    by = totals((docs[r.doc_id].source, r["size"], r.target, r.taken) for r in rows)
    order = sorted(by)
    assert [by[s][1] for s in order] == pytest.approx(slow_targets([by[s][0] for s in order]))
    for size, target, taken, longest in by.values():
        assert abs(taken - target) <= longest / 2
    assert all(r["size"] == len(docs[r.doc_id].text.split()) and r.taken in (0, *(r["size"] * k for k in (1, 2, 3))) for r in rows)


def test_mixed_rows_are_the_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    monkeypatch.setattr(mixing, "SHARD_DRAWS", 8)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = {r.doc_id: len(r.mix.draws) for r in mixing.plan(docs).collect()}
    rows = mixing.mix(docs).collect()
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += 1
    assert {k: v for k, v in wanted.items() if v} == dict(got)
    shards = defaultdict(int)
    for r in rows:
        shards[r.mix["shard"]] += 1
    assert len(shards) > 8 and max(shards.values()) < 4 * len(rows) / len(shards)
    assert rows[0].asDict().keys() == {*docs.columns, "mix"}


def test_odd_rows(spark, odd, none):
    got = mixing.plan(odd)
    assert got.columns == [*odd.columns, "mix"]
    rows = got.collect()
    assert len(rows) == len(ODD) and mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    assert {r.mix["size"] for r in rows if r.text is None} == {0}
    by = {r.source: r.mix.target for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.mix["size"]
    order = ["s1", "s2", "s3", None]
    assert [by[s] for s in order] == pytest.approx(slow_targets([sizes[s] for s in order]))
    assert len({tuple(r.mix.draws) for r in rows if r.doc_id == 1}) == 1
