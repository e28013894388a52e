import duckdb
import pytest

import corpus_pipeline
from arborlake.llm import decontaminate
from tests.llm.conftest import ODD
from tests.llm.test_decontaminate import slow
from tests.llm.test_near_duplicates import slow_kept

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_names():
    assert list(STAGES) == ["toxicity", "near_duplicates", "benchmark", "mixing", "tokens"]


def test_toxic_documents_go_and_clean_ones_stay(spark, docs):
    kept = STAGES["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in ids for i in clean) / len(clean) > 0.98


def test_one_of_each_group_stays(spark, docs):
    kept = STAGES["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_contaminated_documents_go(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted(r.doc_id for r in docs.collect() if not slow(r.text, items, 10)[1])
    assert sorted(r.doc_id for r in STAGES["benchmark"](spark, docs, SF).collect()) == clean


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


def test_odd_rows_pass_every_stage(spark, odd, none):
    for table in (odd, none):
        for name, stage in STAGES.items():
            got = stage(spark, table, SF)
            if name != "tokens":
                assert got.columns == table.columns
            got.collect()
    kept = [r.doc_id for r in STAGES["near_duplicates"](spark, odd, SF).collect()]
    assert sorted(kept) == [1, 3, 5, 6, 8]
