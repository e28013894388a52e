"""Index of 3-character pieces: rows of one name share a list."""

from pyspark.sql import functions as F

from arborlake.operators import ngrams
from conftest import frame, record

ROWS = ([record(100 + i, 5, "same_name.txt", i) for i in range(300)] + [record(1000 + i, 5, f"own{i}.txt", i) for i in range(20)]
        + [record(2000, 5, "banana"), record(2001, 5, "ab"), record(2002, 5, None), record(100, 5, "same_name.txt", drive="D"),
           record((1 << 20) + 7, 5, "same_name.txt")])


def pieces(name):
    folded = (name or "").upper()
    return {folded[i:i + 3] for i in range(len(folded) - 2)}


def test_lists_hold_every_posting_once(spark):
    df = frame(spark, ROWS)
    lists = ngrams.posting_lists(df)
    # One list for a piece of the common name in a block of ids of a volume.
    assert lists.filter("gram = 'SAM' and drive = 'C'").count() == 2
    assert lists.filter("gram = 'SAM' and drive = 'D'").count() == 1
    got = sorted((r.gram, r.drive, r.frs) for r in ngrams.postings(lists).collect())
    assert got == sorted((g, r[0], r[1]) for r in ROWS for g in pieces(r[3]))
    assert got == sorted((r.gram, r.drive, r.frs) for r in ngrams.build_ngrams(df).select("gram", "drive", "frs").collect())


def test_filter_on_the_piece_reaches_the_scan(spark, tmp_path, capsys):
    ngrams.posting_lists(frame(spark, ROWS)).write.parquet(f"{tmp_path}/grams")
    found = ngrams.postings(spark.read.parquet(f"{tmp_path}/grams")).filter(F.col("gram").isin("BAN", "SAM"))
    found.explain()
    assert "In(gram, [BAN,SAM])" in capsys.readouterr().out
    assert found.count() == 303
