import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arborlake.functions import arguments as args, derive as d, patterns as p
from arborlake.functions.categories import TYPE_EXTENSIONS, expand_extensions
from arborlake.schema import FIELDS, find_field

AS_OF = datetime(2024, 3, 15, 10, 30)   # a Friday


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression.alias("o")).orderBy("i").collect()]


def test_extension_of_odd_names(spark):
    cases = {".gitignore": "", "README": "", "foo.": "", "a..b": "b", "x.tar.gz": "gz", "$MFT": "",
             "$Recycle.Bin": "bin", "A.TXT": "txt", "..b": "b", ".": "", "": "", "a.b.": "", "100%.log": "log"}
    assert column(spark, list(cases), d.ext("v")) == list(cases.values())


def test_first_category_wins(spark):
    names = [f"f.{e}" for members in TYPE_EXTENSIONS.values() for e in members]
    expected = []
    for name in names:
        extension = name[2:]
        expected.append(next(t for t, m in TYPE_EXTENSIONS.items() if extension in m))
    got = column(spark, names, d.semantic_type(d.ext("v"), F.lit(False)))
    assert got == expected
    assert column(spark, ["a.zzz", "a", "d.pdf"], d.semantic_type(d.ext("v"), F.col("i") == 2)) == [
        "other", "file", "directory"]


def test_bulkiness_is_exact_for_huge_sizes(spark):
    pairs = [(3, 4096), (0, 10), (2**61, 2**62), (7, 9_000_000_000_001), (10**13 + 1, 10**13 + 7)]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(pairs)], "i int, l long, a long")
    got = [r["b"] for r in df.select("i", d.bulkiness("l", "a").alias("b")).orderBy("i").collect()]
    assert got == [a * 10**6 // size if size else 0 for size, a in pairs]


def test_link_shares_add_up(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2**62), n, i) for n in (1, 2, 3, 7) for i in range(n)]
    df = spark.createDataFrame(rows, "v long, n int, i int")
    got = df.select("v", "n", "i", d.link_share("v", F.col("i"), F.col("n")).alias("s")).collect()
    for r in got:
        assert r["s"] == (r["v"] if r["n"] == 1 else r["v"] * (r["i"] + 1) // r["n"] - r["v"] * r["i"] // r["n"])


def test_malformed_names(spark):
    values = [b"plain", b"a\xed\xb3\xbfb", b"\xff\xc3\xa9", "é�".encode(), b"\xed\xa0\x80\xed\xb0\x80"]
    assert column(spark, values, d.is_malformed("v"), "binary") == [False, True, True, False, True]
    assert column(spark, values, d.render_name("v"), "binary") == ["plain", "a�b", "�é", "é�", "��"]
    assert column(spark, values, d.render_name("v", True), "binary") == [
        "plain", "a<BAD:DCFF>b", "<BAD>é", "é�", "<BAD:D800><BAD:DC00>"]
    assert column(spark, values, d.name_hex("v"), "binary")[:2] == [None, "61edb3bf62"]


def test_class_bounds(spark):
    sizes = [0, 1023, 1024, 102_399, 102_400, 10 * 2**30 - 1, 10 * 2**30]
    assert column(spark, sizes, d.size_bucket("v"), "long") == [
        d.SIZE_LABELS[i] for i in (0, 0, 1, 1, 2, 5, 6)]
    assert column(spark, [0, 1024, 2**30 - 1, 2**30], d.size_bucket8("v"), "long") == [0, 1, 6, 7]
    assert column(spark, [127, 128, 199, 200, 259, 260], d.path_risk("v"), "int") == [
        d.PATH_RISK_LABELS[i] for i in (0, 1, 1, 2, 2, 3)]
    ages = [timedelta(hours=23), timedelta(days=1), timedelta(days=3650)]
    assert column(spark, [AS_OF - a for a in ages], d.age_bucket(F.col("v").cast("timestamp_ntz"), AS_OF),
                  "timestamp") == ["Today", "This week", "> 10 years"]


def test_human_sizes(spark):
    values = [0, 1023, 1024, 801_024, 5 * 2**20, 3 * 2**30 // 2, 2**40]
    assert column(spark, values, d.human_size("v"), "long") == [
        "0 B", "1023 B", "1.0 KB", "782.2 KB", "5.0 MB", "1.50 GB", "1.00 TB"]
    assert column(spark, [1_234_567], d.grouped_digits("v"), "long") == ["1,234,567"]


def test_filetime(spark):
    ticks = [0, 116_444_736_000_000_000, 133_549_470_000_000_000]
    got = column(spark, ticks, d.filetime_to_timestamp("v"), "long")
    assert got == [None, datetime(1970, 1, 1), datetime(2024, 3, 15, 3, 30)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert column(spark, ticks, d.filetime_to_timestamp("v"), "long") == got
        back = d.micros(d.filetime_to_timestamp("v")) * 10 + 116_444_736_000_000_000
        assert column(spark, ticks[1:], back, "long") == ticks[1:]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_paths_text(spark):
    paths = ["C:\\a\\b.txt", "C:\\", "x"]
    assert column(spark, paths, d.path_only("v")) == ["C:\\a\\", "C:\\", ""]
    assert column(spark, ["C:\\A\\B\\\\", "c:/x"], d.normalize_path("v")) == ["c:/a/b", "c:/x"]
    assert column(spark, ["C:\\a:s", "C:\\a"], d.is_ads_path("v")) == [True, False]


@pytest.mark.parametrize("text,expected", [
    ("1024", 1024), ("1KB", 1024), ("10mb", 10 * 2**20), (" 2 TB ", 2 * 2**40), ("0", 0), ("7B", 7)])
def test_sizes(text, expected):
    assert args.size_bytes(text) == expected


@pytest.mark.parametrize("text", ["", "abc", "1.5MB", "-1"])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        args.size_bytes(text)


@pytest.mark.parametrize("spec,lower,upper", [
    ("today", "2024-03-15", "2024-03-15"), ("yesterday", "2024-03-14", "2024-03-15"),
    ("this_week", "2024-03-11", "2024-03-11"), ("lastweek", "2024-03-04", "2024-03-11"),
    ("last_month", "2024-02-01", "2024-03-01"), ("last_year", "2023-01-01", "2024-01-01"),
    ("ytd", "2024-01-01", "2024-01-01"), ("tomorrow", "2024-03-16", "2024-03-17"),
    ("next_month", "2024-04-01", "2024-05-01"), ("next_year", "2025-01-01", "2026-01-01"),
    ("2024-01-15", "2024-01-15", "2024-01-15")])
def test_named_times(spec, lower, upper):
    assert args.time_bound(spec, AS_OF, True) == datetime.fromisoformat(lower)
    assert args.time_bound(spec, AS_OF, False) == datetime.fromisoformat(upper)


def test_relative_times():
    assert args.time_bound("7d", AS_OF, True) == AS_OF - timedelta(days=7)
    assert args.time_bound("90s", AS_OF, False) == AS_OF - timedelta(seconds=90)
    with pytest.raises(ValueError):
        args.time_bound("soon", AS_OF, True)


def test_months_and_attributes():
    assert args.months("Q2,october") == [4, 5, 6, 10]
    assert args.months("jan,feb,huh") == [1, 2]
    assert args.attribute_masks("hidden,!system") == (2, 4)
    assert args.attribute_masks("user-files") == (0, 6)
    assert args.attribute_masks("compressed-encrypted,readonly") == (0x4801, 0)
    assert args.attribute_masks("!user-files") == (0, 6)


def test_extension_lists():
    assert expand_extensions("executables")[-2:] == ["dll", "sys"]
    assert expand_extensions(".RS, documents")[:2] == ["rs", "doc"]


def test_fields():
    assert len(FIELDS) == 42
    assert find_field("SizeOnDisk").name == "size_on_disk" and find_field("DIR").name == "directory_flag"
    assert find_field("nope") is None
    assert sum(f.aggregatable for f in FIELDS.values()) == 11


def simple_match(text, pattern):
    """Wildcard match by definition."""
    if not pattern:
        return not text
    if pattern[0] == "*":
        return simple_match(text, pattern[1:]) or (bool(text) and simple_match(text[1:], pattern))
    return bool(text) and pattern[0] in ("?", text[0]) and simple_match(text[1:], pattern[1:])


def test_globs_against_definition(spark):
    rng = random.Random(7)
    texts = ["", "a", "ab.c", "[x].txt", "100%.log", "a+b", "(a)", "a\\b", "x$y^z", "dbt", "aab", "a.a.a"]
    texts += ["".join(rng.choice("ab.*?[$") for _ in range(rng.randrange(7))) for _ in range(40)]
    shapes = ["*", "a*", "*a", "*a*", "a*b", "?", "a?b", "*.c", "[x]*", "a+b", "*%*", "**a", "a**", "*\\*", "?*", "*a*b*"]
    shapes += ["".join(rng.choice("ab.*?[$") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for start in range(0, len(shapes), 20):
        part = shapes[start:start + 20]
        rows = df.select("v", *[p.glob(F.col("v"), s).alias(f"m{i}") for i, s in enumerate(part)]).collect()
        for r in rows:
            for i, s in enumerate(part):
                assert r[f"m{i}"] == simple_match(r["v"], s), (r["v"], s)


@pytest.mark.parametrize("pattern,expected", [
    ("*.t[xy]t", ["a.txt", "a.tyt", "b.txt"]), ("[!a]*", ["b.txt"]), ("**x**", ["a.txt", "b.txt", "a/x/b"]),
    ("a?x", []), ("*/x/*", ["a/x/b"]), ("a*", ["a.txt", "a.tyt"])])
def test_class_globs(spark, pattern, expected):
    texts = ["a.txt", "a.tyt", "b.txt", "a/x/b"]
    got = column(spark, texts, p.class_glob(F.col("v"), pattern))
    assert [t for t, g in zip(texts, got) if g] == expected


def test_unclosed_class():
    with pytest.raises(ValueError):
        p.class_glob_regex("[abc")


def test_name_search(spark):
    names = ["Ring.TXT", "spring", ".", "", "ring"]
    assert column(spark, names, p.name_matches(F.col("v"), "RING")) == [True, True, False, False, True]
    assert column(spark, names, p.name_matches(F.col("v"), "ring", whole=True)) == [False] * 4 + [True]
    assert column(spark, names, p.name_matches(F.col("v"), "*.txt|sp*")) == [True, True, False, False, False]
    assert column(spark, names, p.name_matches(F.col("v"), "Ring", case_sensitive=True)) == [True] + [False] * 4


def test_directory_regex():
    def hits(segments, path, leaf=False):
        return re.search(p.directory_regex(segments, leaf).replace("(?s)", ""), path) is not None

    assert hits(["a", "*"], "C:\\X\\A\\B\\") and not hits(["a", "*"], "C:\\A\\")
    assert hits(["a", "**"], "C:\\A\\B\\C\\") and not hits(["a", "**"], "C:\\A\\")
    assert hits(["**", "b"], "C:\\A\\B\\") and hits(["**"], "C:\\")
    assert hits(["a"], "C:\\A\\B\\", leaf=True) and hits(["a"], "C:\\A\\", leaf=True)


def test_reasons(spark):
    got = column(spark, [0x100, 0x80000202, 0], d.reason_names("v"), "long")
    assert got == ["CREATE", "DELETE+SIZE+CLOSE", "0x00000000"]


def test_bulkiness_saturates(spark):
    top = (1 << 63) - 1
    rows = [(1, 10**13), (3, 10**13 + 1), (7, 9), (0, 5), (top, top), (1, top), (top, 1), (10**6, top), (10**6 + 1, top)]
    got = spark.createDataFrame(rows, "l long, a long").select("l", "a", d.bulkiness("l", "a").alias("b")).collect()
    assert [r.b for r in got] == [min(top, a * 10**6 // l) if l else 0 for l, a in rows]


def test_long_paths_keep_their_length(spark):
    df = spark.createDataFrame([("x" * 70_000,)], "p string")
    assert df.select(d.path_length("p"), d.path_length("p", legacy_cut=True)).first() == (70_000, 65_535)
