"""Checked queries: paths, closures, subtree sums, links, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake import Catalog
from arborlake.operators import diff as df_, hierarchy as h, links
from arborlake.runtime import materialize
from arborlake.sources import binding

from checks.base import cat, query
from checks.rows import linked


@query("e01_with_paths", "SELECT drive, frs, path FROM paths")
def _(spark, sf):
    return cat(spark, sf).with_paths().select("drive", "frs", "path")


@query("e01_null_parent", r"""
SELECT drive, frs, CASE WHEN NOT is_directory AND frs % 1000 = 1 THEN '<unknown:>\' || name ELSE path END AS path FROM paths""")
def _(spark, sf):
    """Rows without a parent keep their place in every result with paths."""
    rows = cat(spark, sf).rows
    lost = ~F.col("is_directory") & (F.col("frs") % 1000 == 1)
    rows = rows.withColumn("parent_frs", F.when(~lost, F.col("parent_frs")))
    return Catalog(rows).with_paths().select("drive", "frs", "path")


@query("e02_with_paths_suffix", r"""
SELECT drive, frs, CASE WHEN frs % 9 = 4 THEN path || ':zone' WHEN is_directory AND frs <> 5 THEN path || '\'
                        ELSE path END AS path FROM paths""")
def _(spark, sf):
    c = cat(spark, sf)
    df = c.rows.withColumn("stream_name", F.when(F.col("frs") % 9 == 4, F.lit("zone")).otherwise(F.lit("")))
    return h.with_paths(df, c.dirs, dir_suffix=True).select("drive", "frs", "path")


@query("e03_paths_for_filtered", "SELECT drive, frs, path FROM paths WHERE ext = 'mp4' AND size > 5000000")
def _(spark, sf):
    c = cat(spark, sf)
    part = c.rows.filter((F.col("ext") == "mp4") & (F.col("size") > 5_000_000))
    return c.with_paths(part).select("drive", "frs", "path")


@query("e04_expand_descendants", """
SELECT drive, frs FROM paths WHERE (is_directory AND name LIKE 'Customer#%7')
  OR len([x FOR x IN above IF x >= 1000000 AND x < 100000000 AND x % 10 = 7]) > 0""")
def _(spark, sf):
    return cat(spark, sf).search("dir:Customer#*7", expand=False).transform(
        lambda roots: h.expand_descendants(cat(spark, sf).rows, cat(spark, sf).dirs, roots)).select("drive", "frs")


@query("e05_tree_metrics", "SELECT drive, frs, descendants, treesize, tree_allocated FROM tree")
def _(spark, sf):
    return cat(spark, sf).tree_rows.select("drive", "frs", "descendants", "treesize", "tree_allocated")


@query("e06_tree_bulkiness_sum", """
WITH lim AS (SELECT drive, frs, tree_allocated // 100 AS cut FROM tree WHERE is_directory),
f3 AS (SELECT t.drive, t.parent_frs AS frs, sum(CASE WHEN l.cut = 0 OR t.allocated_size < l.cut THEN t.allocated_size ELSE 0 END) AS v
       FROM catalog t JOIN lim l ON l.drive = t.drive AND l.frs = t.parent_frs WHERE NOT t.is_directory GROUP BY 1, 2),
b4 AS (SELECT c.drive, c.frs, c.parent_frs, coalesce(f3.v, 0) AS v FROM catalog c LEFT JOIN f3 USING (drive, frs)
       WHERE c.is_directory AND c.frs >= 100000000),
b3 AS (SELECT c.drive, c.frs, c.parent_frs, coalesce(sum(CASE WHEN l.cut = 0 OR b.v < l.cut THEN b.v ELSE 0 END), 0) AS v
       FROM catalog c JOIN lim l USING (drive, frs) LEFT JOIN b4 b ON b.drive = c.drive AND b.parent_frs = c.frs
       WHERE c.is_directory AND c.frs >= 1000000 AND c.frs < 100000000 GROUP BY 1, 2, 3),
b2 AS (SELECT c.drive, c.frs, c.parent_frs, coalesce(sum(CASE WHEN l.cut = 0 OR b.v < l.cut THEN b.v ELSE 0 END), 0) AS v
       FROM catalog c JOIN lim l USING (drive, frs) LEFT JOIN b3 b ON b.drive = c.drive AND b.parent_frs = c.frs
       WHERE c.is_directory AND c.frs >= 1000 AND c.frs < 1000000 GROUP BY 1, 2, 3),
b1 AS (SELECT c.drive, c.frs, c.parent_frs, coalesce(sum(CASE WHEN l.cut = 0 OR b.v < l.cut THEN b.v ELSE 0 END), 0) AS v
       FROM catalog c JOIN lim l USING (drive, frs) LEFT JOIN b2 b ON b.drive = c.drive AND b.parent_frs = c.frs
       WHERE c.frs = 5 GROUP BY 1, 2, 3)
SELECT drive, frs, CAST(v AS BIGINT) AS bulkiness_sum FROM
  (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4)""")
def _(spark, sf):
    c = cat(spark, sf)
    return h.bulkiness_sums(c.rows, c.dirs, c.sums)


_EXTRA = "CASE st_kind WHEN 0 THEN 0 WHEN 1 THEN 26 + frs % 7 ELSE 42 + frs % 7 END"


@query("e07_tree_metrics_streams", f"""
WITH shares AS (
  SELECT drive, parent_frs, CASE st_kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS cnt,
    size * (k + 1) // n - size * k // n
      + CASE WHEN st_kind > 0 THEN (26 + frs % 7) * (k + 1) // n - (26 + frs % 7) * k // n ELSE 0 END
      + CASE WHEN st_kind = 2 THEN 16 * (k + 1) // n - 16 * k // n ELSE 0 END AS bytes,
    allocated_size * (k + 1) // n - allocated_size * k // n AS alloc
  FROM (SELECT *, link_total AS n, link_total - 1 - link_index AS k FROM links WHERE NOT is_directory)),
items AS (SELECT s.drive, unnest(p.chain) AS frs, cnt, bytes, alloc FROM shares s
          JOIN dirp p ON p.drive = s.drive AND p.frs = s.parent_frs
          UNION ALL SELECT drive, unnest(above), 1, 0, 0 FROM paths WHERE is_directory AND frs <> 5),
agg AS (SELECT drive, frs, sum(cnt) AS cnt, sum(bytes) AS bytes, sum(alloc) AS alloc FROM items GROUP BY 1, 2)
SELECT c.drive, c.frs, CAST(coalesce(a.cnt, 0) + 1 AS BIGINT) AS descendants,
  CAST(coalesce(a.bytes, 0) AS BIGINT) AS treesize, CAST(coalesce(a.alloc, 0) AS BIGINT) AS tree_allocated
FROM catalog c LEFT JOIN agg a USING (drive, frs) WHERE c.is_directory""")
def _(spark, sf):
    return links.tree_sums_by_stream(linked(spark, sf), cat(spark, sf).dirs)


@query("e08_hardlink_share", """
SELECT drive, frs, link_index AS i, size * (link_index + 1) // link_total - size * link_index // link_total AS share
FROM links WHERE NOT is_directory""")
def _(spark, sf):
    files = linked(spark, sf).filter(~F.col("is_directory")).select(
        "drive", "frs", "size", F.size("names").alias("n"), F.posexplode("names").alias("p", "link"))
    return files.select("drive", "frs", F.col("p").cast("bigint").alias("i"),
                        links.link_share("size", F.col("p"), F.col("n")).alias("share"))


def thinned(spark, sf):
    """Catalog without the directories whose id is divisible by 17."""
    return cat(spark, sf).rows.filter(~F.col("is_directory") | (F.col("frs") % 17 != 0))


_THIN = "(NOT is_directory OR frs % 17 <> 0)"


@query("e09_orphan_sweep", f"""
SELECT drive, frs FROM paths WHERE {_THIN} AND len([x FOR x IN above IF x % 17 = 0]) > 0""")
def _(spark, sf):
    df = thinned(spark, sf)
    return h.orphans(df, h.build_directories(df)).select("drive", "frs")


@query("e09_skip_orphans", f"""
SELECT drive, anc AS frs, count(*) AS descendants FROM (
  SELECT drive, unnest(above) AS anc FROM paths WHERE {_THIN} AND len([x FOR x IN above IF x % 17 = 0]) = 0)
GROUP BY 1, 2""")
def _(spark, sf):
    df = thinned(spark, sf)
    sums = h.tree_sums(df, h.build_directories(df), skip_orphans=True)
    return sums.filter("descendants > 0").select("drive", "frs", "descendants")


@query("e09_broken_paths", f"""
SELECT drive, frs, CASE WHEN cut = 0 THEN path ELSE '<unknown:' || above[cut] || '>\\'
    || array_to_string(string_split(path, '\\')[cut + 1:], '\\') END AS path
FROM (SELECT *, coalesce(list_last([i FOR x, i IN above IF x % 17 = 0]), 0) AS cut FROM paths WHERE {_THIN})""")
def _(spark, sf):
    df = thinned(spark, sf)
    return h.with_paths(df, h.build_directories(df)).select("drive", "frs", "path")


@query("e10_missing_parents", f"""
SELECT drive, parent_frs, count(*) AS children FROM catalog WHERE {_THIN} AND parent_frs % 17 = 0 GROUP BY 1, 2""")
def _(spark, sf):
    return h.missing_parents(thinned(spark, sf))


@query("e11_parent_placeholders", f"""
SELECT drive, frs, parent_frs, is_directory FROM catalog WHERE {_THIN}
UNION ALL SELECT DISTINCT drive, parent_frs, CAST(5 AS BIGINT), TRUE FROM catalog WHERE {_THIN} AND parent_frs % 17 = 0""")
def _(spark, sf):
    return h.with_placeholders(thinned(spark, sf)).select("drive", "frs", "parent_frs", "is_directory")


@query("e12_ancestor_at_depth", """
SELECT drive, frs, CASE WHEN frs = 5 THEN frs ELSE coalesce(list_append(above, frs)[3], frs) END AS ancestor_frs FROM paths""")
def _(spark, sf):
    c = cat(spark, sf)
    return h.with_ancestor(c.rows, c.dirs, 2).select("drive", "frs", "ancestor_frs")


@query("e13_child_of_ancestor", """
SELECT drive, frs, CAST(1000 AS BIGINT) AS root, coalesce(above[3], frs) AS first_step
FROM paths WHERE drive = 'C' AND above[2] = 1000 UNION ALL
SELECT drive, frs, CAST(1001 AS BIGINT), coalesce(above[3], frs) FROM paths WHERE above[2] = 1001""")
def _(spark, sf):
    c = cat(spark, sf)
    return h.descendants_of(c.rows, c.dirs, c.rows.filter(F.col("frs").isin(1000, 1001)))


def listings(spark, sf):
    """All files, and a copy with rows left out, changed and added."""
    c = cat(spark, sf)
    left = c.with_paths(c.rows.filter(~F.col("is_directory"))).select(
        "frs", "path", "size", "allocated_size", "is_directory",
        ((F.col("flags").bitwiseAND(F.lit(2))) != 0).alias("is_hidden"))
    kept = left.filter(F.col("frs") % 7 != 0).withColumns({
        "size": F.when(F.col("frs") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")),
        "is_hidden": F.when(F.col("frs") % 23 == 0, ~F.col("is_hidden")).otherwise(F.col("is_hidden"))})
    added = left.filter(F.col("frs") % 13 == 0).withColumn(
        "path", F.concat(F.lit("Z"), F.substring("path", F.lit(2), F.char_length("path"))))
    return left, kept.unionByName(added)


_LISTINGS = r"""
lft AS (SELECT frs, rtrim(replace(lower(path), '\', '/'), '/') AS pn, size, allocated_size, flags & 2 <> 0 AS hid
        FROM paths WHERE NOT is_directory),
rgt AS (SELECT frs, pn, CASE WHEN frs % 11 = 0 THEN size + 1 ELSE size END AS size, allocated_size,
               CASE WHEN frs % 23 = 0 THEN NOT hid ELSE hid END AS hid FROM lft WHERE frs % 7 <> 0
        UNION ALL SELECT frs, 'z' || substr(pn, 2), size, allocated_size, hid FROM lft WHERE frs % 13 = 0)"""


@query("e14_diff_summary", f"""WITH {_LISTINGS}
SELECT count(*) FILTER (WHERE l.pn IS NOT NULL AND r.pn IS NOT NULL) AS common_paths,
  count(*) FILTER (WHERE r.pn IS NULL) AS left_only, count(*) FILTER (WHERE l.pn IS NULL) AS right_only,
  round(count(*) FILTER (WHERE l.pn IS NOT NULL AND r.pn IS NOT NULL) * 100.0::DOUBLE / count(l.pn), 6) AS match_rate,
  CAST(0 AS BIGINT) AS left_ads, CAST(0 AS BIGINT) AS right_ads
FROM lft l FULL JOIN rgt r ON l.pn = r.pn""")
def _(spark, sf):
    pairs = df_.matched(*listings(spark, sf))
    return df_.summary(pairs).withColumn("match_rate", F.round("match_rate", 6))


@query("e14_diff_fields", f"""WITH {_LISTINGS}, both_ AS (
  SELECT l.size AS a, r.size AS b, l.allocated_size AS c, r.allocated_size AS d, l.hid AS e, r.hid AS f
  FROM lft l JOIN rgt r ON l.pn = r.pn)
SELECT 'size' AS field, count(*) AS total_compared, count(*) FILTER (WHERE a = b) AS exact_matches,
  count(*) FILTER (WHERE a <> b) AS mismatches, CAST(sum(abs(a - b)) AS BIGINT) AS sum_abs_diff, max(abs(a - b)) AS max_abs_diff FROM both_
UNION ALL SELECT 'allocated_size', count(*), count(*) FILTER (WHERE c = d), count(*) FILTER (WHERE c <> d), 0, 0 FROM both_
UNION ALL SELECT 'is_hidden', count(*), count(*) FILTER (WHERE e = f), count(*) FILTER (WHERE e <> f), 0, 0 FROM both_
UNION ALL SELECT 'is_directory', count(*), count(*), 0, 0, 0 FROM both_""")
def _(spark, sf):
    pairs = df_.matched(*listings(spark, sf))
    return df_.field_stats(pairs).select("field", "total_compared", "exact_matches", "mismatches",
                                         "sum_abs_diff", "max_abs_diff")


@query("e14_diff_samples", f"""WITH {_LISTINGS}, d AS (
  SELECT 'size' AS field, l.pn AS path_norm, CAST(l.size AS VARCHAR) AS left_value, CAST(r.size AS VARCHAR) AS right_value
  FROM lft l JOIN rgt r ON l.pn = r.pn WHERE l.size <> r.size
  UNION ALL SELECT 'is_hidden', l.pn, CAST(l.hid AS VARCHAR), CAST(r.hid AS VARCHAR)
  FROM lft l JOIN rgt r ON l.pn = r.pn WHERE l.hid <> r.hid)
SELECT field, path_norm, left_value, right_value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY path_norm) AS rank FROM d) WHERE rank <= 10""")
def _(spark, sf):
    return df_.field_samples(df_.matched(*listings(spark, sf)))


@query("e15_breakdown", f"""WITH {_LISTINGS}, s AS (
  SELECT coalesce(l.pn, r.pn) AS pn, l.pn IS NOT NULL AS a, r.pn IS NOT NULL AS b FROM lft l FULL JOIN rgt r ON l.pn = r.pn)
SELECT CAST(0 AS BIGINT) AS missing_system, CAST(0 AS BIGINT) AS right_unknown,
  count(*) FILTER (WHERE a AND strlen(pn) < 10) AS left_short, count(*) FILTER (WHERE b AND strlen(pn) < 10) AS right_short,
  CAST(0 AS BIGINT) AS left_dot, CAST(0 AS BIGINT) AS right_dot, CAST(0 AS BIGINT) AS left_ads, CAST(0 AS BIGINT) AS right_ads,
  CAST(0 AS BIGINT) AS left_only_ads, CAST(0 AS BIGINT) AS right_only_ads FROM s""")
def _(spark, sf):
    return df_.diff_breakdown(*listings(spark, sf))


@query("e15_missing_by_drive", """
SELECT lower(drive) AS drive, count(*) AS missing FROM catalog WHERE NOT is_directory AND frs % 7 = 0 GROUP BY 1""")
def _(spark, sf):
    return df_.missing_by_drive(*listings(spark, sf))


@query("e15_missing_by_parent", r"""
SELECT replace(lower(parent_path), '\', '/') AS parent, count(*) AS missing FROM paths
WHERE NOT is_directory AND frs % 7 = 0 GROUP BY 1 ORDER BY missing DESC, parent LIMIT 20""")
def _(spark, sf):
    return df_.missing_by_parent(*listings(spark, sf))


@query("h02_common_paths", f"WITH {_LISTINGS} SELECT pn AS path_norm FROM lft INTERSECT SELECT pn FROM rgt")
def _(spark, sf):
    return df_.common_paths(*listings(spark, sf))


@query("h02_only_left", f"WITH {_LISTINGS} SELECT pn AS path_norm FROM lft EXCEPT SELECT pn FROM rgt")
def _(spark, sf):
    return df_.only_in(*listings(spark, sf))


@query("h02_only_right", f"WITH {_LISTINGS} SELECT pn AS path_norm FROM rgt EXCEPT SELECT pn FROM lft")
def _(spark, sf):
    left, right = listings(spark, sf)
    return df_.only_in(right, left)


@query("e16_record_crosscheck", """
SELECT 'quality' AS flag, quality = 1 AS left_value, n_chars > 500 AS right_value, count(*) AS rows
FROM labels JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en') GROUP BY 2, 3
UNION ALL SELECT 'toxic', toxic = 1, n_chars > 2000, count(*)
FROM labels JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en') GROUP BY 2, 3""")
def _(spark, sf):
    docs = binding.table(spark, sf, "documents")
    left = binding.table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    right = docs.select("doc_id", (F.col("n_chars") > 500).alias("q"), (F.col("n_chars") > 2000).alias("t"))
    focus = docs.filter(F.col("lang") != "en").select("doc_id")
    return df_.crosscheck(left, right, ["doc_id"], {"quality": ("q", "q"), "toxic": ("t", "t")}, focus)


@query("e18_merge_continuations", """
SELECT drive, frs, name, parent_frs, size, allocated_size,
  CAST(CASE WHEN is_directory THEN -1 ELSE link_count END AS INT) AS n_names,
  CAST(CASE WHEN is_directory OR frs % 3 = 0 THEN 0 WHEN frs % 3 = 1 THEN 2 ELSE 3 END AS INT) AS n_streams FROM catalog""")
def _(spark, sf):
    df = linked(spark, sf).drop("name_bytes", "stream_count")
    split = ~F.col("is_directory") & (F.col("frs") % 4 == 1) & (F.size("streams") > 0)
    whole = df.filter(~split)
    cut = df.filter(split)
    half = F.call_function("div", F.col("size"), F.lit(2))
    all_names = F.col("frs") % 8 == 1

    def first_part(size, allocated):
        return F.array(F.struct(
            F.lit("").alias("name"), size.alias("size"), allocated.alias("allocated_size"),
            F.lit(False).alias("is_sparse"), F.lit(False).alias("is_compressed"), F.lit(True).alias("is_resident")))

    base = cut.withColumns({
        "name": F.when(all_names, F.lit("")).otherwise(F.col("name")),
        "names": F.when(all_names, F.slice("names", 1, 0)).otherwise(F.slice("names", 1, 1)),
        "streams": first_part(half, F.lit(0).cast("bigint")), "size": half})
    ext = cut.select(
        "drive", (F.col("frs") + 5_000_000_000).alias("frs"), F.col("frs").alias("base_frs"),
        F.when(all_names, F.reverse("names")).otherwise(F.slice("names", F.lit(2), F.size("names"))).alias("names"),
        F.concat(first_part(F.col("size") - half, F.col("allocated_size")),
                 F.slice("streams", F.lit(2), F.size("streams"))).alias("streams"))
    merged = links.merge_continuations(whole.unionByName(base), ext)
    return merged.select("drive", "frs", "name", "parent_frs", "size", "allocated_size",
                         F.coalesce(F.size("names"), F.lit(-1)).alias("n_names"),
                         F.size("streams").alias("n_streams"))


@query("e19_visible_rows", """
SELECT drive, frs FROM paths WHERE is_directory = is_directory
  AND NOT (frs >= 1000000 AND frs < 100000000 AND frs % 10 = 0)
  AND len([x FOR x IN above IF x >= 1000000 AND x < 100000000 AND x % 10 = 0]) = 0
  AND (NOT is_directory OR frs % 17 <> 0) AND len([x FOR x IN above IF x % 17 = 0]) = 0""")
def _(spark, sf):
    # Customers ending in 0 hang below a reserved record; other chains are broken.
    df = thinned(spark, sf)
    hidden = F.col("is_directory") & F.col("frs").between(1_000_000, 99_999_999) & (F.col("frs") % 10 == 0)
    moved = df.withColumn("parent_frs", F.when(hidden, F.lit(11).cast("bigint")).otherwise(F.col("parent_frs")))
    reserved = df.filter("frs = 5").withColumns({"frs": F.lit(11).cast("bigint"), "name": F.lit("$Extend")})
    every = moved.unionByName(reserved)
    return h.visible_rows(every, h.build_directories(every)).select("drive", "frs")


@query("expand_links", """
SELECT drive, frs, parent_frs, name, stream_name, shown_size AS size, shown_allocated AS allocated_size FROM expanded""")
def _(spark, sf):
    return links.expand_links(linked(spark, sf)).select(
        "drive", "frs", "parent_frs", "name", "stream_name", "size", F.col("allocated_size").cast("bigint"))


@query("e20_paths_per_link", r"""
SELECT e.drive, e.frs, CASE WHEN e.frs = 5 THEN e.drive || ':\' WHEN p.frs = 5 THEN p.path || e.name
                            ELSE p.path || '\' || e.name END
  || CASE WHEN stream_name = '' THEN '' ELSE ':' || stream_name END AS path
FROM expanded e JOIN dirp p ON p.drive = e.drive AND p.frs = e.parent_frs""")
def _(spark, sf):
    return links.paths_per_link(linked(spark, sf), cat(spark, sf).dirs).select("drive", "frs", "path")


@query("j06_refreshed_paths", r"""
SELECT drive, frs, CASE WHEN len([x FOR x IN above IF x >= 1000000 AND x < 100000000 AND x % 50 = 0]) > 0
      OR (frs >= 1000000 AND frs < 100000000 AND frs % 50 = 0)
  THEN regexp_replace(path, '\\Customer#', '\\moved_Customer#') ELSE path END AS path FROM paths""")
def _(spark, sf):
    c = cat(spark, sf)
    renamed = F.col("is_directory") & F.col("frs").between(1_000_000, 99_999_999) & (F.col("frs") % 50 == 0)
    after = c.rows.withColumn("name", F.when(renamed, F.concat(F.lit("moved_"), "name")).otherwise(F.col("name")))
    changed = materialize(c.rows.filter(renamed).select("drive", "frs"), "renamed")
    dirs = h.refresh_directories(c.dirs, after, changed)
    return h.with_paths(after, dirs).select("drive", "frs", "path")
