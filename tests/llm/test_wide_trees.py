import random

from arborlake.llm import chosenpath, shinglesets, simhash
from tests.llm.test_near_duplicates import edited, slow_kept


def counted(near, key, columns):
    """In place of the comparison: a row with the number of rows that reach it."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([0])], names=["a", "b"])

    return run


def test_unrelated_texts_do_not_meet(spark, monkeypatch):
    """Of many texts only near copies are compared; before, each text met all others."""
    draw = random.Random(11)
    rows = [(i, " ".join(str(draw.randrange(10 ** 12)) for _ in range(20))) for i in range(20_000)]
    copies = [(i + 100_000, f"{text} more") for i, text in rows[::100]]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(8)
    kept = {r.doc_id for r in simhash.deduplicated(docs).select("doc_id").collect()}
    assert kept == {i for i, _ in rows}
    prints = simhash._wide_prints(docs, 5, "doc_id", "text").withColumnRenamed("id", "node")
    for module in (simhash, chosenpath):
        monkeypatch.setattr(module, "tile_forests", counted)
    compared = simhash._wide_candidates(prints, 22, (4, 5), len(rows) + len(copies)).groupBy().sum("a").first()[0]
    assert 2 * len(copies) <= compared <= 40 * len(copies)


def test_deep_trees_equal_brute_force(spark, monkeypatch):
    """Groups around four fifths with a passage that all share, in nodes that branch over several levels and fill many tiles."""
    monkeypatch.setattr(simhash, "ALL_PAIRS", 0)
    monkeypatch.setattr(chosenpath, "SMALL", 6)
    monkeypatch.setattr(chosenpath, "TILE", 10)
    monkeypatch.setattr(shinglesets, "WEIGHT", 4000)
    draw = random.Random(12)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for base in range(5):
        words = [f"w{base}x{i}" for i in range(80)] + (passage if base else [])
        rows += [(len(rows) + i, edited(draw, words, draw.randrange(4))) for i in range(40)]
    expected = slow_kept(rows)
    assert 5 < len(expected) < 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == expected


def test_functions_of_a_path_differ(spark):
    """A branch takes no function that the path took, as all sets of the node would go to one child."""
    paths = spark.range(3000).selectExpr("xxhash64(id) AS path", f"sequence(0, {chosenpath.FUNCTIONS // 2 - 1}) AS used")
    drawn = [r[0] for b in (0, 1) for r in paths.select(chosenpath._unused(paths.used, b)).collect()]
    assert sum(x is None for x in drawn) < 60 and min(x for x in drawn if x is not None) >= chosenpath.FUNCTIONS // 2
