"""URL filter: host and path rules, and a tree of path templates for what no rule decides.

A host's paths form a tree of segments. Going down level by level, segments that vary (they hold digits, or are one
of many rare children) become wildcards, and children whose own children and labels look like those of all siblings
together merge into one wildcard. A template is rejected if the smoothed share of blocked urls among its labelled
ones is high. Paths are counted by their generalised form before anything else, so a large host is a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.llm.common import ascii_lower
from arborlake.runtime import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Tree:
    """Parameters of the tree."""

    depth: int = 8             # segments that are told apart; the rest of a path is one wildcard
    children: int = 20         # a node with more children ...
    share: float = 0.01        # ... generalises those with less than this share of its urls
    distance: float = 0.2      # largest total variation between a child's profile and that of all siblings
    deviation: float = 2.0     # largest difference of label rates, in standard errors
    labels: int = 5            # labels from which on a rate counts as known
    weight: float = 5.0        # labels that the corpus-wide rate counts as
    purity: float = 0.8        # smoothed share of blocked urls from which on a template is rejected


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return (ascii_lower(part(r"(?s)^.*?://([^/?#]*)")), part(r"(?s)^.*?://[^/?#]*([^?#]*)"))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(text, verdict) of the longest rule for the host or a domain above it whose path the path begins with."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def general_path(path: Column, depth: int) -> Column:
    """Segments with # for each run of digits; those beyond the depth are one ``**``."""
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)


def _level(paths: DataFrame, at: int, t: Tree) -> DataFrame:
    """Paths with the name of segment ``at`` added to their template."""
    part, below = F.get("parts", F.lit(at)), F.get("parts", F.lit(at + 1))
    kind = F.when(below.isNull(), "end").when(below.contains("#"), "number").otherwise("word")
    kinds = ("end", "number", "word")
    sums = lambda c: F.sum(c).alias(c)
    cur = paths.withColumn("part", part)
    child = (cur.filter("part is not null").withColumn("kind", kind).groupBy("host", "template", "part")
             .agg(sums("n"), sums("bad"), sums("known"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds]))
    node = child.groupBy("host", "template").agg(
        F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "known", *kinds)])
    away = sum((F.abs(F.col(k) / F.col("n") - F.col(f"all_{k}") / F.col("all_n")) for k in kinds), F.lit(0.0)) / 2
    rate = F.col("all_bad") / F.greatest("all_known", F.lit(1))
    error = F.sqrt(rate * (1 - rate) / F.greatest("known", F.lit(1))) + 1e-9
    told, siblings = F.col("known") >= t.labels, F.col("all_known") - F.col("known") >= t.labels
    alike = F.when(told & siblings, F.abs(F.col("bad") / F.greatest("known", F.lit(1)) - rate) <= t.deviation * error).otherwise(~told & ~siblings)
    child = (child.join(node, ["host", "template"])
             .withColumn("varies", F.col("part").contains("#"))
             .withColumn("rare", (F.col("children") > t.children) & (F.col("n") < t.share * F.col("all_n")))
             .withColumn("like", ~F.col("varies") & ~F.col("rare") & (away <= t.distance) & alike)
             .select("host", "template", "part", "varies", "rare", "like"))
    alikes = child.groupBy("host", "template").agg(F.sum(F.col("like").cast("int")).alias("alikes"))
    named = child.join(alikes, ["host", "template"]).select("host", "template", "part", F.when(
        F.col("varies"), F.regexp_replace("part", "#", "*")).when(
        F.col("rare") | F.col("like") & (F.col("alikes") > 1), F.lit("*")).otherwise(F.col("part")).alias("name"))
    out = cur.join(named, ["host", "template", "part"], "left")
    return materialize(out.withColumn("template", F.concat("template", F.when(
        F.col("part").isNull(), "").otherwise(F.concat(F.lit("/"), F.col("name"))))).drop("part", "name"), "templates")


def templates(urls: DataFrame, t: Tree = Tree()) -> DataFrame:
    """Rows (host, parts, template, purity, rejected) for each generalised path of rows (host, parts, bad).

    ``bad`` is true for a blocked url, false for an allowed one and null for one without label. Without any labels
    the corpus-wide rate is one half.
    """
    paths = (urls.groupBy("host", "parts").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("bad"), F.count("bad").alias("known"))
        .withColumn("template", F.lit("")))
    paths = materialize(paths, "paths")
    bad, known, deep = paths.agg(F.sum("bad"), F.sum("known"), F.max(F.size("parts"))).first()
    for at in range(deep or 0):
        paths = _level(paths, at, t)
    rate = bad / known if known else 0.5
    stats = paths.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("known").alias("k"))
    stats = stats.withColumn("purity", (F.col("b") + t.weight * rate) / (F.col("k") + t.weight))
    # Purity is known for labelled templates only; the corpus-wide rate alone rejects none.
    stats = stats.withColumn("rejected", (F.col("purity") >= t.purity) & (F.col("k") >= t.labels)).drop("b", "k")
    return materialize(paths.select("host", "parts", "template").join(stats, ["host", "template"]), "judged")


def judge(pages: DataFrame, rules: tuple[Rule, ...], labels: DataFrame | None = None, t: Tree = Tree(),
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, template, purity, verdict), one for each row of ``pages``.

    The rules' verdicts are the labels of the tree; ``labels`` (host, path, bad) adds more. A null url or one
    without ``://`` has an empty host and path and is judged with the others of that kind. Repeated rows count each.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("parts", general_path(F.col("path"), t.depth))
    known = rows.select("host", "parts", (F.col("fits.verdict") == "block").alias("bad"))
    if labels is not None:
        known = known.union(labels.select("host", general_path(F.col("path"), t.depth), "bad"))
    found = templates(known, t)
    return (rows.join(found, ["host", "parts"], "left")
            .select("page_id", "host", "path", F.col("fits.text").alias("rule"), "template", "purity",
                    F.coalesce("fits.verdict", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict")))
