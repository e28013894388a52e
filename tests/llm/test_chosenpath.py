import itertools
import random
import re

import numpy as np
from arborlake.llm import chosenpath, shinglesets

SF = "/root/testdata/sf0.001"


def slow_set(text, words=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def slow_rows(rows, up=85, down=100):
    """rows: (id, text) -> (id, size, component) by comparing all pairs."""
    sets = [slow_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and down * len(sets[a] & sets[b]) >= up * len(sets[a] | sets[b]):
            group[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        held = least.get(root(i))
        least[root(i)] = doc if held is None else held if doc is None else min(doc, held)
    return sorted(((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10 ** 6)}"
    return " ".join(out)


def families(seed, n, lengths=(8, 40, 120, 300), copies=12):
    """Texts around the threshold: few, some and many edits of each base, and a passage that many share."""
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for base in range(n):
        words = [f"w{base}x{i}" for i in range(draw.choice(lengths))] + (passage if base % 3 == 0 else [])
        for c in range(copies):
            rows.append((len(rows), edited(draw, words, draw.randrange(0, 2 + len(words) // 25))))
    draw.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(chosenpath.near_duplicates(docs)) == slow_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_families_at_the_threshold(spark):
    rows = families(1, 30)
    want = slow_rows(rows)
    assert 30 < len({c for *_, c in want}) < len(rows)
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_large_nodes_branch_and_tiles_meet(spark, monkeypatch):
    """With small limits nodes branch over several levels, groups fill many tiles and blocks."""
    monkeypatch.setattr(chosenpath, "SMALL", 6)
    monkeypatch.setattr(chosenpath, "TILE", 10)
    monkeypatch.setattr(shinglesets, "WEIGHT", 4000)
    rows = families(2, 6, lengths=(100,), copies=60)
    assert found(chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_rows(rows)


def test_candidates_grow_with_the_texts_not_their_pairs(spark):
    """Texts of one base, none of which are near enough to be linked, and one group in which all are."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    for edits, groups in ((12, None), (2, 1)):
        counts = []
        for n in (100, 400):
            docs = spark.createDataFrame([(i, edited(draw, words, edits)) for i in range(n)], "doc_id long, text string")
            rows = chosenpath._prints(docs, 3, "doc_id", "text").withColumnRenamed("id", "node")
            counts.append(chosenpath._candidates(rows, (85, 100), 1 - 1e-6).count() / n)
            if groups:
                assert len({c for *_, c in found(chosenpath.near_duplicates(docs))}) == groups
        assert counts[1] <= 1.5 * max(counts[0], 1) and max(counts) <= chosenpath.trees_needed(0.85, 1 - 1e-6) * 2 ** 3


def test_recall_of_the_trees():
    """Share of pairs at the threshold that meet in trees of any depth is what ``trees_needed`` says."""
    assert chosenpath.trees_needed(0.85, 0.9) == 1 and chosenpath.trees_needed(0.85, 1 - 1e-6) == 4
    draw = np.random.default_rng(1)
    both = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    agree = []
    for i in range(300):
        one, two = both.copy(), both.copy()
        own = draw.choice(400, 32, replace=False)  # 368 of 432 in common
        two[own] = draw.integers(0, 1 << 63, 32, dtype=np.uint64)
        a, b = chosenpath.minwise(one), chosenpath.minwise(two)
        agree.append((a == b).mean())
        differ = chosenpath.sketch(a) ^ chosenpath.sketch(b)
        x = differ.view(np.uint64)
        assert np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(chosenpath._LOW_BITS)).sum() <= chosenpath.most_mismatches(0.85)
    assert abs(np.mean(agree) - 368 / 432) < 0.01


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = chosenpath.near_duplicates(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got) == slow_rows(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got.collect())
    assert chosenpath.near_duplicates(none).count() == 0
    assert chosenpath.near_duplicates(odd.filter("doc_id = 4")).collect()[0].component_id == 4


def test_exact_check_of_groups():
    draw = random.Random(9)
    sets = [np.unique(np.array([draw.randrange(60) for _ in range(draw.choice((0, 3, 20, 50)))], np.uint64)) for _ in range(90)]
    blocks = [draw.randrange(2) for _ in sets]
    for within in (True, False):
        first = shinglesets.linked_groups(sets, (1, 2), None if within else blocks)
        group = list(range(90))
        for _ in range(90):
            for a, b in itertools.combinations(range(90), 2):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if (within or blocks[a] != blocks[b]) and 2 * len(x & y) >= len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
        assert first.tolist() == group


def test_bitmap_loses_no_wanted_row(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) AS key1", "id")
    wanted = rows.filter("id % 40 = 7").select("key1")
    kept = shinglesets.likely(rows, wanted, "key1")
    assert kept.columns == rows.columns
    ids = {r.id for r in kept.collect()}
    assert {i for i in range(5000) if i % 40 == 7} <= ids and len(ids) < 200
