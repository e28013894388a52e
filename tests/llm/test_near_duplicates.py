import itertools
import random
import re

import corpus_pipeline
import numpy as np
from arborlake.llm import shinglesets, simhash

SF = "/root/testdata/sf0.001"


def slow_shingles(text, words=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def slow_kept(rows):
    """rows: (id, text); the smallest id of each group that brute force links at four fifths."""
    sets = [slow_shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            group[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(least.values())


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_and_thresholds(spark):
    """Edits of few texts at all distances around four fifths, with a passage that all share."""
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for base in range(4):
        words = [f"w{base}x{i}" for i in range(60 if base else 8)]
        for _ in range(60):
            text = list(words)
            for _ in range(draw.randrange(4)):
                text[draw.randrange(len(text))] = f"e{draw.randrange(50)}"
            rows.append((len(rows), " ".join(text + (passage if base % 2 else []))))
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = slow_kept(rows)
    assert 4 < len(expected) < 200
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == expected


def edited(draw, words, edits):
    out = list(words)
    for at in draw.sample(range(len(out)), edits):
        out[at] = f"e{draw.randrange(10 ** 9)}"
    return " ".join(out)


def test_candidates_grow_with_the_texts_not_their_pairs(spark):
    """Near copies whose neighbours are just under four fifths, and near copies that are all linked."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    for edits in (4, 1):
        counts = []
        for n in (100, 400):
            rows = [(i, edited(draw, words, edits)) for i in range(n)]
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            prints = simhash._wide_prints(docs, 5, "doc_id", "text").withColumnRenamed("id", "node")
            counts.append(simhash._wide_candidates(prints, 22, (4, 5), n).count())
            assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == slow_kept(rows)
        assert counts[0] <= 40 * 100 and counts[1] <= 40 * 400


def test_links_at_four_fifths_are_near():
    """Pairs that share exactly four fifths, from short to long texts: at most one in a thousand is beyond the radius."""
    draw = np.random.default_rng(3)
    lost = total = 0
    for size in (9, 18, 90, 450, 1800):
        for _ in range(400):
            pool = draw.integers(0, 1 << 63, size + size // 9, dtype=np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[size // 9:])  # 8/9 of each, 4/5 of both
            s = np.stack([simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)])
            n = np.array([len(a), len(b)])
            test = simhash.near_wide(n, *s.T, radius=22, share=(4, 5))
            lost += not test(np.array([0]), np.array([1]))[0, 0]
            total += 1
    assert lost <= total / 1000


def test_odd_rows(spark, odd, none):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 8]
    assert all(r.kept_key == 1 and r.mix == "m" for r in kept.collect())
    assert simhash.deduplicated(none).count() == 0
    lonely = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicated(lonely).collect()), key=str) == [(None, "a b c d e f"), (None, None)]


def test_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 7)
    monkeypatch.setattr(simhash, "max", lambda *a: a[0], raising=False)
    monkeypatch.setattr(shinglesets, "WEIGHT", 3000)
    draw = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(draw, words, draw.randrange(4))) for i in range(150)]
    assert sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == slow_kept(rows)
