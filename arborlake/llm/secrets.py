"""Secret scan whose candidates are judged by how many owners share them across the corpus.

Everything is DataFrame code. Positions come from the pieces between the matches, as Spark has no function for
the places of all matches. A candidate's value is hashed, and distinct repositories and owners are counted for
each hash: a value that many owners have, or many repositories even of one owner, is a copied example; one that a
single owner has in few repositories and that looks random is taken for live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.runtime import materialize

# The patterns of the base kinds, in the order of their kinds, and the least length of a value.
KEYED = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (KEYED, 2, 8), "access": (r"AKIA[A-Z0-9]{12,}", 0, 16), "hex": (r"[0-9a-f]{32,}", 0, 32)}
#: Kinds that the method adds, after the base kinds in order.
ADDED = ("live", "copied")
#: Owners, and repositories of whatever owners, from which on a value is a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 20
#: Repositories that a live value has at most, and its least number of distinct characters.
LIVE_REPOS, LIVE_SIGNS = 5, 8
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx"

SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: the n-th match begins after n + 1 pieces and n matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    lengths = F.zip_with(F.split(text, pattern, -1), F.concat(matches, F.array(F.lit(""))), lambda g, m: F.struct(
        F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))
    placed = F.aggregate(lengths, start, lambda a, x: F.struct(
        (a["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end")))).alias("out")))["out"]
    spans = F.zip_with(F.slice(placed, 1, F.size(matches)), values, lambda p, v: F.struct(
        p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), v.alias("value")))
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)), kept).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """Rows (doc_id, repo, owner, found), one for each row of ``docs``; ``found`` has the base spans by kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[_found(text, k, *spec) for k, spec in enumerate(KINDS.values())])
    same = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select("doc_id", same(repo_col).alias("repo"), same(owner_col).alias("owner"), F.array_sort(found).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """Rows (hash, repos, owners, live, copied) for each distinct value.

    Counts are summed up in two steps, so a value that a third of all rows have is combined before it is sent.
    """
    each = found.select("repo", "owner", F.explode("found").alias("s")).select(
        "repo", "owner", F.sha2("s.value", 256).alias("hash"), _random("s.value").alias("random"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.max("random").alias("random"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("random").alias("random"))
    counts = by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.max("random").alias("random"))
    return counts.select("hash", "repos", "owners", ((F.col("owners") == 1) & (F.col("repos") <= LIVE_REPOS) & F.col("random")).alias("live"),
                         ((F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS)).alias("copied"))


def _random(value: str) -> Column:
    signs = F.size(F.array_distinct(F.split(F.col(value), "")))
    return (signs >= LIVE_SIGNS) & ~F.regexp_like(F.col(value), F.lit(PLACEHOLDER))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, *ADDED)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, **columns) -> DataFrame:
    """Rows (doc_id, found, added), one for each row of ``docs``.

    ``found`` has the base spans (start, kind, end, value) by start and kind, positions in code points and ends
    exclusive; ``added`` has spans of kind live or copied over the values that the corpus-wide counts decide
    about. An empty table gives no rows. A null text is empty; a null repository or owner counts as one of that name; repeated rows have the
    same spans and count as one repository.
    """
    base = materialize(candidates(docs, **columns).withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = base.filter(F.size("found") > 0)
    judged = materialize(ownership(some).filter("live or copied").select("hash", "live"), "ownership")
    spans = some.select("row", F.explode("found").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    kind = F.when(F.col("live"), len(KINDS)).otherwise(len(KINDS) + 1)
    added = (spans.join(judged, "hash").groupBy("row").agg(F.array_sort(F.collect_set(F.struct(
        (F.col("s.end") - F.length("s.value")).alias("start"), kind.alias("kind"), F.col("s.end").alias("end"),
        F.col("s.value").alias("value")))).alias("added")))
    return (base.join(added, "row", "left")
            .select("doc_id", "found", F.coalesce("added", F.array().cast(SPAN)).alias("added")))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, hash and text of the spans of ``scan``."""
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_text(F.col("found")), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("found", "added"))).alias("spans"))
