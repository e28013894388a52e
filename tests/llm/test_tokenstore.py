import random
import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from arborlake.llm import queries, tokenstore
from arborlake.llm.common import range_bounds, range_bucket
from arborlake.runtime import scratch_path
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow(text, coder=tokenstore.encoder(PATH)):
    return [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é1!'s \n\t \x1c中😀<|>", max_size=25), max_size=4))
def test_units_encode_like_whole_texts(texts):
    coder = tokenstore.encoder(PATH)
    texts = [*texts, "x <|endoftext|> y", "a\n \nb  c", " \nb", "don't  it's"]
    assert [array("I", coder.encode(t)).tolist() for t in texts] == [slow(t)[:-1] for t in texts]


def test_other_vocabularies_are_encoded_whole():
    coder = tokenstore.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "Hello  there, it's fine"
    assert array("I", coder.encode(text)).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_memory_of_units_may_be_emptied(monkeypatch):
    monkeypatch.setattr(tokenstore, "CACHE_UNITS", 5)
    coder = tokenstore.Encoder(PATH)
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join(rng.choice(["ab", "cd,", "é.", "x\n", "中"]) for _ in range(9)) for _ in range(3)]
        assert [array("I", coder.encode(t)).tolist() for t in texts] == [slow(t)[:-1] for t in texts]


def check(spark, docs, rows):
    path = scratch_path(spark, "test")
    tokenstore.write(docs, path, PATH)
    got = sorted(tokenstore.read(spark, path).collect(), key=lambda r: r.start)
    expected = [(i, slow(t)) for i, t in rows]
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert [r.doc_id for r in got] == [i for i, _ in sorted(expected, key=key)]
    assert sorted(map(repr, [(r.doc_id, array("I", r.ids).tolist()) for r in got])) == sorted(map(repr, expected))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    return path


def test_round_trip_of_odd_rows(spark, odd, none):
    check(spark, odd, [(r[0], r[1]) for r in ODD])
    check(spark, none, [])


def test_files_and_short_reads(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "FILE_BYTES", 50_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    path = check(spark, docs.repartition(3), rows)
    assert spark.read.parquet(f"{path}/index").select("file").distinct().count() > 5
    some = {i: slow(t) for i, t in rows[:3]}
    assert tokenstore.documents(spark, path, list(some)) == some
    with open(f"{path.removeprefix('file:')}/dictionary.zdict", "r+b") as f:
        f.write(b"other")
    with pytest.raises(ValueError, match="dictionary"):
        tokenstore.documents(spark, path, [0])


def test_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op6_token_id_binary_output"](spark, SF).collect()}
    at = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = array("I", slow(r.text))
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_ranges(spark):
    values = [None, -5, -5, -5, 0, 1, 1, 2, 10**15, 10**15 + 1] + list(range(100, 130))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    bounds = range_bounds(df, "v", 7)
    assert bounds == sorted(set(bounds)) and bounds[0] == -5
    for v, b in df.select("v", range_bucket(F.col("v"), bounds)).collect():
        assert b == (0 if v is None else max(i for i, low in enumerate(bounds) if low <= v))
