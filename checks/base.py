"""Registry of checked queries: a Spark callable and, where SQL can say it, an oracle.

The SQL side rebuilds the catalog from the raw tables with its own formulas.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake import Catalog, Filters
from arborlake.functions.categories import TYPE_EXTENSIONS
from arborlake.runtime import scratch_path
from arborlake.sources import binding

AS_OF = datetime(2001, 6, 15, 12, 0, 0)
AS_OF_SQL = "TIMESTAMP '2001-06-15 12:00:00'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CATALOGS: dict[tuple[str, str], Catalog] = {}


def cat(spark: SparkSession, sf_dir: str) -> Catalog:
    """Catalog of the tables, built once per session like a resident index."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        _CATALOGS[key] = Catalog.prepare(binding.catalog(spark, sf_dir), AS_OF)
    return _CATALOGS[key]


def query(key: str, sql: str | None = None):
    """Register a query; ``sql`` is the text after the shared CTEs it names."""
    def register(fn):
        if key in QUERIES:
            raise KeyError(f"registered twice: {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = compose(sql)
        return fn
    return register


def rows(key: str, where: str, pattern: str = "*", columns=("drive", "frs", "name"),
         source: str = "catalog", filters: dict | None = None, **options):
    """A search whose result is a set of rows, checked by a WHERE clause."""
    def run(spark, sf_dir):
        c = cat(spark, sf_dir)
        needs_path = "path" in columns
        found = c.search(pattern, Filters(**(filters or {})), paths=needs_path, **options)
        return found.select(*columns)

    QUERIES[key] = run
    ORACLES[key] = compose(f"SELECT {', '.join(columns)} FROM {source} WHERE {where}")


def ordered(key: str, order: str, limit: int, where: str = "TRUE", source: str = "catalog",
            columns=("drive", "frs", "name"), **options):
    """A sorted and limited search."""
    rows(key, where, columns=columns, source=source, limit=limit, **options)
    offset = options.get("offset", 0)
    ORACLES[key] = compose(f"SELECT {', '.join(columns)} FROM {source} WHERE {where} "
                           f"ORDER BY {order} LIMIT {limit} OFFSET {offset}")


def out_path(spark: SparkSession, tag: str) -> str:
    return scratch_path(spark, tag)


# ---------------------------------------------------------------- SQL side

def type_sql(ext: str = "ext", is_dir: str = "is_directory") -> str:
    cases = "".join(
        f" WHEN {ext} IN ({', '.join(repr(e) for e in members)}) THEN '{name}'"
        for name, members in TYPE_EXTENSIONS.items())
    return f"CASE WHEN {is_dir} THEN 'directory' WHEN {ext} = '' THEN 'file'{cases} ELSE 'other' END"


_CTES = {
    "nat": """
  SELECT n_nationkey, n_name, substr('CDEFG', CAST(n_regionkey AS INT) + 1, 1) AS drive FROM nation""",
    "leaf": """
  SELECT l_orderkey, l_linenumber, count(*) AS link_count,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(sum(l_quantity) AS BIGINT) AS qty, max(l_shipdate) AS modified,
         max(l_returnflag) AS rf, min(p_name) AS p_name, min(p_type) AS p_type
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber""",
    "file_rows": """
  SELECT n.drive, CAST(1000000000 + l.l_orderkey * 8 + l.l_linenumber AS BIGINT) AS frs,
         CAST(100000000 + l.l_orderkey AS BIGINT) AS parent_frs,
         concat(replace(l.p_name, ' ', '_'), '_', CAST(l.l_linenumber AS VARCHAR(10)),
                CASE l.p_type WHEN 'ECONOMY' THEN '.pdf' WHEN 'SMALL' THEN '.txt' WHEN 'PROMO' THEN '.JPG'
                              WHEN 'MEDIUM' THEN '.dll' WHEN 'LARGE' THEN '.mp4' ELSE '' END) AS name,
         CASE WHEN mod(l.qty, 10) = 0 THEN CAST(0 AS BIGINT) ELSE l.cents END AS size,
         o.o_orderdate AS created, l.modified, l.link_count,
         CASE WHEN l.rf = 'R' THEN 34 WHEN l.rf = 'N' THEN 33 ELSE 32 END AS flags
  FROM leaf l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nat n ON c.c_nationkey = n.n_nationkey""",
    "dir_rows": r"""
  SELECT DISTINCT drive, CAST(5 AS BIGINT) AS frs, CAST(5 AS BIGINT) AS parent_frs, '.' AS name FROM nat
  UNION ALL SELECT drive, CAST(1000 + n_nationkey AS BIGINT), CAST(5 AS BIGINT), n_name FROM nat
  UNION ALL SELECT n.drive, CAST(1000000 + c_custkey AS BIGINT), CAST(1000 + c_nationkey AS BIGINT), c_name
    FROM customer c JOIN nat n ON c.c_nationkey = n.n_nationkey
  UNION ALL SELECT n.drive, CAST(100000000 + o_orderkey AS BIGINT), CAST(1000000 + o_custkey AS BIGINT),
         concat('order_', CAST(o_orderkey AS VARCHAR(20)))
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nat n ON c.c_nationkey = n.n_nationkey""",
    "raw_catalog": """
  SELECT drive, frs, parent_frs, name, FALSE AS is_directory, size,
         size + mod(4096 - mod(size, 4096), 4096) AS allocated_size,
         created, modified, modified AS accessed, CAST(link_count AS INT) AS link_count,
         CAST(flags AS INT) AS flags FROM file_rows
  UNION ALL
  SELECT drive, frs, parent_frs, name, TRUE, CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP),
         CAST(1 AS INT), CAST(16 AS INT) FROM dir_rows""",
    "catalog": f"""
  SELECT *, {type_sql()} AS type FROM (
    SELECT *, regexp_extract(lower(name), '(?s)^.+\\.([^.]+)$', 1) AS ext FROM raw_catalog)""",
    "dirp": r"""
  SELECT drive, frs, parent_frs, drive || ':\' AS path, [frs] AS chain FROM catalog WHERE frs = 5
  UNION ALL
  SELECT d.drive, d.frs, d.parent_frs,
         CASE WHEN p.frs = 5 THEN p.path || d.name ELSE p.path || '\' || d.name END,
         list_append(p.chain, d.frs)
  FROM catalog d JOIN dirp p ON d.drive = p.drive AND d.parent_frs = p.frs
  WHERE d.is_directory AND d.frs <> 5""",
    "paths": r"""
  SELECT c.*, CASE WHEN c.frs = 5 THEN c.drive || ':\' WHEN p.frs = 5 THEN p.path || c.name
                   ELSE p.path || '\' || c.name END AS path,
         p.path AS parent_path, CASE WHEN c.frs = 5 THEN [] ELSE p.chain END AS above
  FROM catalog c JOIN dirp p ON p.drive = c.drive AND p.frs = c.parent_frs""",
    "sums": """
  SELECT drive, anc AS frs, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes,
         CAST(sum(allocated_size) AS BIGINT) AS alloc
  FROM (SELECT drive, unnest(above) AS anc, size, allocated_size FROM paths) GROUP BY drive, anc""",
    "tree": """
  SELECT p.*, CASE WHEN is_directory THEN coalesce(s.n, 0) ELSE 0 END AS descendants,
         CASE WHEN is_directory THEN coalesce(s.bytes, 0) + size ELSE size END AS treesize,
         CASE WHEN is_directory THEN coalesce(s.alloc, 0) + allocated_size ELSE allocated_size END
           AS tree_allocated
  FROM paths p LEFT JOIN sums s ON p.drive = s.drive AND p.frs = s.frs""",
    "links": """
  SELECT drive, frs, i AS link_index, n AS link_total, is_directory, size, allocated_size, flags, st_kind,
         CASE WHEN i % 2 = 1 THEN CAST(5 AS BIGINT) ELSE parent_frs END AS parent_frs,
         CASE WHEN i = 0 THEN name ELSE 'link' || i || '_' || name END AS name
  FROM (SELECT *, CASE WHEN is_directory THEN 0 ELSE frs % 3 END AS st_kind,
               CASE WHEN is_directory THEN 1 ELSE link_count END AS n,
               unnest(range(0, CASE WHEN is_directory THEN 1 ELSE link_count END)) AS i
        FROM catalog)""",
    "streams": """
  SELECT *, unnest(CASE WHEN st_kind = 0 THEN [''] ELSE ['', 'Zone.Identifier'] END) AS stream_name
  FROM links""",
    "expanded": """
  SELECT drive, frs, parent_frs, name, stream_name, link_index,
         CASE WHEN stream_name = '' THEN size ELSE 26 + frs % 7 END AS shown_size,
         CASE WHEN stream_name = '' THEN allocated_size ELSE 0 END AS shown_allocated
  FROM streams""",
    "changes": """
  SELECT 'C' AS drive, event_id AS usn, user_id AS frs, 5 + user_id % 3 AS parent_frs,
         CASE event_type WHEN 'signup' THEN 256 WHEN 'purchase' THEN 8192 WHEN 'error' THEN 512
                         WHEN 'click' THEN 2 WHEN 'view' THEN 32768 ELSE 0 END AS reason,
         CASE WHEN event_type = 'view' THEN '' ELSE 'f_' || user_id || '_' || (event_id % 7) || '.txt' END AS name,
         ts
  FROM events""",
    "classified": """
  SELECT *, CASE WHEN reason & 512 <> 0 THEN 'deleted' WHEN reason & 256 <> 0 THEN 'created'
                 WHEN reason & 8192 <> 0 THEN 'renamed' WHEN reason & 6 <> 0 THEN 'size_changed'
                 WHEN reason & 32768 <> 0 THEN 'metadata_changed' ELSE 'other' END AS kind
  FROM changes""",
    "net": """
  SELECT drive, frs, arg_max(parent_frs, usn) AS parent_frs,
         coalesce(arg_max(name, usn) FILTER (WHERE name <> ''), '') AS name,
         coalesce(max(usn) FILTER (WHERE kind = 'created'), -1) > coalesce(max(usn) FILTER (WHERE kind = 'deleted'), -1) AS is_created,
         coalesce(arg_max(kind, usn) FILTER (WHERE kind IN ('created', 'deleted', 'renamed')), '') = 'deleted' AS is_deleted,
         coalesce(arg_max(kind, usn) FILTER (WHERE kind IN ('created', 'deleted', 'renamed')), '') = 'renamed' AS is_renamed,
         bool_or(kind = 'size_changed') AS size_changed,
         bool_or(kind = 'metadata_changed') AS metadata_changed, max(usn) AS last_usn
  FROM classified GROUP BY drive, frs""",
    "docs": """
  SELECT source AS drive, doc_id AS frs, lang AS ext, n_chars AS size, text FROM documents""",
}


def compose(body: str) -> str:
    """Prefix the body with the shared CTEs that it and they refer to."""
    wanted: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in _CTES:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                need(_CTES[name])
                wanted.append(name)

    own = set(re.findall(r"(\w+) AS (?:MATERIALIZED )?\(", body))
    need(body)
    wanted = [w for w in wanted if w not in own]
    if not wanted:
        return body
    kept = ("catalog", "paths", "sums", "tree", "net")
    parts = [f"{n} AS {'MATERIALIZED ' if n in kept else ''}({_CTES[n]}\n)" for n in wanted]
    text = body.strip()
    if text.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + text[5:].replace("RECURSIVE ", "", 1)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + text
