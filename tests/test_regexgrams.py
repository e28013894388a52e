import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from arborlake.functions import regexgrams as rg
from arborlake.operators import ngrams
from arborlake.runtime import materialize
from conftest import frame, record

LETTERS = "abcAB1_."


def pieces(text, n=3):
    low = text.upper()
    return {low[i:i + n] for i in range(len(low) - n + 1)}


def expressions():
    quoted = st.text(LETTERS, min_size=1, max_size=4).map(re.escape)
    classes = st.sampled_from(["[ab]", "[^a]", "[a-c1]", "[_.]", ".", r"\w", r"\d", "^", "$", r"\b"])

    def more(inner):
        quantifier = st.sampled_from(["", "*", "+", "?", "{2}", "{1,3}", "{2,}", "+?", "{0,2}"])
        return st.one_of(
            st.lists(inner, min_size=1, max_size=4).map("".join),
            st.lists(inner, min_size=1, max_size=3).map(lambda p: f"(?:{'|'.join(p)})"),
            st.tuples(inner, quantifier).map(lambda p: f"({p[0]}){p[1]}"))

    return st.recursive(st.one_of(quoted, classes), more, max_leaves=12)


@settings(max_examples=500, deadline=None)
@given(expressions(), st.lists(st.text(LETTERS, max_size=14), min_size=1, max_size=20))
def test_every_match_satisfies_the_formula(expression, texts):
    wanted = rg.formula(expression)
    weaker = rg.cheapest(wanted, lambda g: hash(g) % 7)
    for text in texts:
        if re.search(expression, text, re.IGNORECASE | re.ASCII):
            assert rg.holds(wanted, pieces(text)) and rg.holds(weaker, pieces(text))


@pytest.mark.parametrize("expression, text, possible", [
    ("hello", "say HELLO", True), ("hello", "help low", False), ("(hot|cold)_x", "a cold_x", True), ("(hot|cold)_x", "old hat_x", False),
    ("ab[cd]ef", "xabdefx", True), ("ab[cd]ef", "abxef", False), ("a.*bcd", "bcd", True), ("a.*bcd", "abc", False),
    ("(abc){2}", "abcabc", True), ("(abc){2}", "abcxab", False), ("x?yzw", "yzw", True), ("abc|def|ghi", "dfe", False)])
def test_formulas_decide(expression, text, possible):
    assert rg.holds(rg.formula(expression), pieces(text)) is possible


@pytest.mark.parametrize("expression", ["a", ".*", "ab|cde", "(?i)abcd", r"\Qabcd\E", "(?=abcd)", r"(abc)\1def", "[abcd", "abc(", r"\p{L}abc", "äöüß",
                                        "a{x}bcd", "[]abc]def", "[a&&[b]]cde"])
def test_unclear_expressions_say_nothing(expression):
    assert rg.formula(expression) == rg.NOTHING_SURE


def test_cheapest_takes_the_rarest():
    wanted = rg.formula("abcdef(xyz|uvw)")
    cost = {"ABC": 9, "BCD": 5, "CDE": 1, "DEF": 7}
    chosen = rg.cheapest(wanted, lambda g: cost.get(g, 100), 1)
    assert rg.grams(chosen) == {"CDE"} and rg.expense(chosen, lambda g: cost.get(g, 100)) == 1


@pytest.fixture(scope="module")
def names(spark):
    draw = random.Random(3)
    rows = [record(5, 5, ".", is_dir=True)]
    for i in range(600):
        word = "".join(draw.choice("abcd_1") for _ in range(draw.randrange(1, 12)))
        rows.append(record(100 + i, 5, word + draw.choice([".pdf", ".txt", ""]), drive=draw.choice("CD")))
    df = frame(spark, rows).withColumn("ext", F.regexp_extract("name", r"\.([^.]+)$", 1))
    stored = materialize(df.repartitionByRange(8, "drive", "ext", "frs").sortWithinPartitions("frs"), "names", "drive")
    return stored, materialize(ngrams.build_ngrams(stored), "grams"), [(r[0], r[3]) for r in rows]


@pytest.mark.parametrize("expression", ["abc", "^a[bc]+d.*pdf$", "(ab|cd){2}", "dd1?d|a_a_", "zzz", "a", "b[^a]c.*txt"])
def test_search_equals_a_scan(names, expression):
    stored, grams, rows = names
    got = sorted((r.drive, r.name) for r in ngrams.regex_search(stored, grams, expression).collect())
    assert got == sorted(r for r in rows if r[1] != "." and re.search(expression, r[1], re.IGNORECASE))


def test_survivors_narrow_the_scan(names):
    stored, grams, rows = names
    counts = ngrams.gram_counts(grams)
    found = ngrams.regex_search(stored, grams, r"^ab.*_1.*\.pdf$", counts=counts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "name#" in line)
    assert "GreaterThanOrEqual(frs" in scan and "EqualTo(ext,pdf)" in scan and "EqualTo(ext,txt)" not in scan
