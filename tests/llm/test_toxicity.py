import zlib

import numpy as np
import pytest

from arborlake.llm import queries, toxicity
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def slow_costs(texts):
    """The language model by one loop over every byte."""
    counts = np.zeros((32**3, 32))
    table = toxicity.symbol_table()
    for t in texts:
        s = [0, *(int(table[b]) for b in (t or "").encode()), 0]
        for a, b, c, d in zip(s, s[1:], s[2:], s[3:]):
            counts[(a * 32 + b) * 32 + c, d] += 1
    base = (counts.sum(axis=0) + 1) / (counts.sum() + 32)
    return -np.log((counts + 2 * base) / (counts.sum(axis=1, keepdims=True) + 2)).ravel()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))


def test_language_model_counts_every_text(spark, odd):
    assert np.allclose(toxicity.language_model(odd), slow_costs([r[1] for r in ODD]), atol=1e-4)


def test_decoding(model):
    read = lambda t: toxicity.restore(t, model.costs)
    for disguised in ("1d10t", "!d!ot", "idi0t", "iiidiooot", "i.d.i.o.t", "i-d-i-o-t", "\"idiot,\"", "idiot!!!", "***1diot###"):
        assert read(disguised) == ["idiot"], disguised
    assert read("st00000pid") and read("$tupid") == ["stupid"] and read("p4th3tic") == ["pathetic"]
    assert read("that's") == ["that", "s"] and read("12345") == [] and read("%%%") in ([], ["%%%"]) and read("éèouç") == ["éèouç"]


def test_spacing_is_part_of_the_lattice(model):
    read = lambda t: {w for x in toxicity.spaced(t.split()) for w in toxicity.restore(x, model.costs)}
    for text in ("you are a i d i o t", "i d i o t then the", "so i d i ot of", "and i d io t", "you 1 d 1 0 t then a b"):
        assert "idiot" in read(text), (text, read(text))
    assert {"idiot", "moron"} <= read("the i d i o t m o r o n of")
    for token in ("id-iot", "i-d-i-ot", "i.d.io.t", "1d_i0t"):
        assert "idiot" in toxicity.restore(token, model.costs), token
    assert toxicity.spaced("it is a good day in b or c".split()) == [] and toxicity.spaced([]) == []
    assert len("".join(read("a b " * 20_000))) > 0


def test_spacing_equals_brute_force(model):
    import itertools

    pieces = ["a", "i", "d", "i", "ot"]
    token = toxicity._laced(pieces, toxicity.TOKENS)
    cost = lambda s: sum(float(model.costs[((a * 32 + b) * 32 + c) * 32 + d]) for a, b, c, d in zip(s, s[1:], s[2:], s[3:]))
    every = []
    for cuts in itertools.product((0, 1), repeat=4):
        text = pieces[0] + "".join(" " * cut + p for cut, p in zip(cuts, pieces[1:]))
        marks = [toxicity.LETTERS] * 3 + [toxicity.TOKENS]
        every.append((sum(toxicity.SPACING[m][cut] for m, cut in zip(marks, cuts)) + cost([0, 0, 0, *toxicity._symbols(text), 0]), text))
    assert toxicity.decode(token, model.costs) == min(every)[1]


def test_viterbi_equals_brute_force(model):
    import itertools

    token = "m0r0n1"
    cost = lambda s: sum(float(model.costs[((a * 32 + b) * 32 + c) * 32 + d]) for a, b, c, d in zip(s, s[1:], s[2:], s[3:]))
    options = [[(c, 0.0)] if c.isalpha() else [(x, 1.0) for x in toxicity.LEET[c]] + [(c, 6.0), ("", 4.0)] for c in token]
    best = min((sum(o[1] for o in path) + cost([0, 0, 0, *toxicity._symbols("".join(o[0] for o in path)), 0]), "".join(o[0] for o in path))
               for path in itertools.product(*options))
    assert toxicity.decode(token, model.costs) == best[1]


def test_held_out_rows(spark, model):
    rows = (spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id"))
    got = [r for r in toxicity.score(rows, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) > 50
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) / len(got) > 0.97
    toxic = [r.score for r in got if r.toxic]
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.8


def test_disguised_words_score_like_plain_ones(model):
    for text in ("the of and 1d10t er the", "the m o r o n of", "ths$ the sc(um loooser the"):
        assert model.score(text) >= 0.5, text
    assert model.score("") < 0.5 and model.score(None) < 0.5 and model.score("the of and this with") < 0.5


def test_query(spark):
    got = queries.QUERIES["op9_toxicity"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows} == {0, 1}


def test_odd_rows(spark, odd, none, model):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 0")):
        m = toxicity.fit(odd, known)
        got = toxicity.score(odd, m)
        assert got.count() == len(ODD) and set(got.columns) == set(odd.columns)
        assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
