import re

import xxhash
from hypothesis import given, settings, strategies as st

from arborlake.llm import queries, simhash
from arborlake.llm.components import components
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def slow_print(text, words=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, radius=3):
    """prints: (id, fingerprint); the smallest id reachable for each row."""
    ids = [None] * len(prints)
    for i in range(len(prints)):
        if ids[i] is None:
            group, todo = {i}, [i]
            while todo:
                a = todo.pop()
                for b in range(len(prints)):
                    if b not in group and (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                        group.add(b)
                        todo.append(b)
            least = min(prints[x][0] for x in group if prints[x][0] is not None)
            for x in group:
                ids[x] = least
    return ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n\x0b .1", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == slow_print(text)


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    before = simhash.fingerprint(ODD[6][1].encode())
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(ODD[6][1].encode()) == before


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [(i, slow_print(t)) for i, t in docs]
    expected = {(i, f"{p:016x}", c) for (i, p), c in zip(prints, slow_components(prints))}
    got = queries.QUERIES["op1_simhash_near_dedup"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(docs)


def test_tiles_find_every_link_at_any_radius(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "TILE_ROWS", 3)
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 5))) for b in base for _ in range(25)}
    rows = list(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(p, i) for i, p in rows], "fingerprint long, node long")
    for radius in (0, 2, 3, 5, 8):
        wanted = {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= radius}
        pairs = [tuple(sorted(r)) for r in simhash.links(frame, radius, every_pair=True).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == wanted
        found = {r.node: r.component for r in components(simhash.links(frame, radius), "a", "b").collect()}
        slow = dict(zip([i for i, _ in rows], slow_components(rows, radius)))
        assert all(found.get(i, i) == c for i, c in slow.items())


def test_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == len(ODD) and got.columns == ["doc_id", "fingerprint", "component_id"]
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[7].fingerprint == "0" * 16
    assert by_id[4].component_id == by_id[7].component_id == 3
    assert by_id[2].component_id == by_id[1].component_id == by_id[None].component_id == 1
    assert simhash.near_duplicates(none).count() == 0


def test_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, None), (9, 9)], "a long, b long")
    assert {tuple(r) for r in components(edges, "a", "b").collect()} == {(i, 0) for i in range(n + 1)}


def test_a_row_without_id_still_links(spark):
    """Two documents that only a text with a null id connects, and a text that only such rows have."""
    a = " ".join(f"w{i}" for i in range(400))
    middle, end = (a.replace(" w200 ", f" {x} ") for x in ("x", "y"))
    rows, prints = [], {}
    for i, text in ((7, a), (None, middle), (9, end), (None, "alone with its text"), (3, "something else here")):
        rows.append((i, text))
        prints[text] = slow_print(text)
    near = lambda x, y: (prints[x] ^ prints[y]).bit_count()
    radius = max(near(a, middle), near(middle, end))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in
           simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=radius).collect()}
    name = lambda i, text: got[i, f"{prints[text]:016x}"]
    assert name(7, a) == name(None, middle) == name(9, end) == 7
    assert name(None, rows[3][1]) is None and name(3, rows[4][1]) == 3
