import zlib

import numpy as np
import pytest

from arborlake.llm import cotraining, queries
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_query_is_right_about_held_out_rows(spark):
    got = queries.QUERIES["op4_quality_cotraining"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "text_score", "page_score"]
    rows = got.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) == 1000 and len(held) > 50
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95
    good, bad = ([r.score for r in held if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(0 <= s <= 1 for r in rows for s in (r.score, r.text_score, r.page_score))


def test_views_teach_each_other():
    """With few labels a view that can't tell by itself learns from the other."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000).astype(float)
    text = (rng.normal(size=(3000, 3)) * 0.3 + np.array([1.0, 0, 0]) * (2 * y[:, None] - 1)).astype(np.float32)
    page = (rng.normal(size=(3000, 40)) + 0.5 * (2 * y[:, None] - 1)).astype(np.float32)
    few = slice(0, 20)
    right = lambda m: ((m.scores(text[2000:], page[2000:])[2] >= 0.5) == (y[2000:] > 0)).mean()
    alone = right(cotraining.cotrain(text[few], page[few], y[few], text[20:2000], page[20:2000], rounds=0))
    taught = right(cotraining.cotrain(text[few], page[few], y[few], text[20:2000], page[20:2000]))
    assert taught > alone and taught > 0.97


@pytest.mark.parametrize("labels", ["toxic", "none", "one kind"])
def test_odd_rows(spark, odd, none, labels):
    rows = {"toxic": [(1, 1), (1, 0), (5, 0), (6, 1), (2, 0), (None, 1), (7, None)], "none": [], "one kind": [(1, 1), (5, 1)]}[labels]
    known = spark.createDataFrame(rows, "doc_id long, quality int")
    got = cotraining.score(odd, cotraining.fit(odd, known)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    if labels == "one kind":
        assert {r.score for r in got} == {1.0}
    assert cotraining.score(none, cotraining.fit(none, known)).count() == 0
