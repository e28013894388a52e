"""The registered queries of this package and their oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm import chosenpath, cotraining, covertree, decontaminate, htmltext, mixing, secrets, shallot, simhash, tokenstore, toxicity, urltree, winnow
from arborlake.llm.common import ship, table
from arborlake.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_html_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_mix_to_target_weights")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "mix.size", "mix.source_size", "mix.target",
                          (F.col("mix.size") * F.size("mix.draws")).alias("taken"))


#: Vocabulary of the token files; its place is a parameter.
TOKENIZER = "byte_bpe_50k.json"


def token_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder, and what is read back from them."""
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    path = scratch_path(spark, "tokens")
    tokenstore.write(docs, path, tokenizer)
    return tokenstore.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_token_id_binary_output")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))


@query("op7_document_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.beside_next(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       winnow.as_text(F.col("kept")).alias("fingerprint"),
                       winnow.as_text(F.col("edited_kept")).alias("edited_fingerprint"),
                       winnow.likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
                       winnow.likeness(F.col("kept"), F.col("next_kept")).alias("near_next"))


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
           FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, coalesce(regexp_extract_all(translate(text,
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
           FROM benchmark),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram
            FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
                  FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
          FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, grams.size, item_id FROM grams JOIN windows ON grams.size = windows.size AND grams.gram = windows.gram),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query("op8_benchmark_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_quality_cotraining")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return cotraining.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score",
                                                cotraining.predicted().alias("predicted"), "text_score", "page_score")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS repo,
                  coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, 0 AS k, 8 AS least, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
             regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
             string_split_regex(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g
      FROM d
      UNION ALL SELECT r, 1, 16, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0),
             string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL SELECT r, 2, 32, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0),
             string_split_regex(t, '[0-9a-f]+') FROM d),
every AS (SELECT r, k, least, v, [len(x) FOR x IN m] AS n, [len(x) FOR x IN g] AS g,
                 unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
base AS (SELECT r, k, v[i] AS v, list_sum(g[1:i]) + coalesce(list_sum(n[1:i - 1]), 0) AS b,
                list_sum(g[1:i]) + list_sum(n[1:i]) AS e FROM every WHERE len(v[i]) >= least),
judged AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos,
                  len(list_distinct(string_split(v, ''))) >= 8
                  AND NOT regexp_matches(v, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx') AS random
           FROM base JOIN d USING (r) GROUP BY v),
added AS (SELECT DISTINCT r, CASE WHEN owners = 1 AND repos <= 5 THEN 3 ELSE 4 END AS k, e - len(v) AS b, e
          FROM base JOIN judged USING (v) WHERE owners >= 3 OR repos >= 20 OR owners = 1 AND repos <= 5 AND random),
named AS (SELECT r, b, k, e, ['assign', 'access', 'hex', 'live', 'copied'][k + 1] || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT) AS s
          FROM (SELECT r, b, k, e FROM base UNION ALL SELECT r, b, k, e FROM added)),
per AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
               string_agg(s, ',' ORDER BY b, k) FILTER (k < 3) AS base_spans, string_agg(s, ',' ORDER BY b, k, e) AS spans
        FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""


@query("op5_secret_scan", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


#: Rules of the query: verdict, host and path.
RULES = (urltree.Rule("block", "com", "/en/"), urltree.Rule("allow", "example.com", "/en/7"), urltree.Rule("allow", "net", "/de/"),
         urltree.Rule("block", "example.net", "/de/8"), urltree.Rule("block", "org", "/es/"))


@query("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urltree.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op13_centroid_clustering", shallot.reference_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shallot.clusters(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        shallot.centroid_digest("centroid").alias("centroid_sha256"))


@query("op12_hard_negative_mining", covertree.REFERENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return covertree.hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


OP11_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(trim(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E'\\x20\\x09\\x0A\\x0B\\x0C\\x0D'), '[\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN w = [''] THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS g FROM d),
k AS MATERIALIZED (SELECT r, doc_id, g, len(g) AS n, CASE WHEN len(g) = 0 THEN 'none ' || r ELSE md5(array_to_string(g, chr(10))) END AS k FROM s),
u AS MATERIALIZED (SELECT k, min(r) AS r, any_value(n) AS n FROM k WHERE n > 0 GROUP BY k),
p AS (SELECT u.r, u.n, unnest(k.g) AS g FROM u JOIN k USING (r)),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM p a JOIN p b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, a FROM (SELECT DISTINCT a FROM e) UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT u.k, coalesce(min(reach.b), u.r) AS c FROM u LEFT JOIN reach ON u.r = reach.a GROUP BY u.k, u.r),
m AS (SELECT c.c, min(doc_id) AS component_id FROM k JOIN c USING (k) GROUP BY c.c)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id,
       coalesce(k.doc_id = coalesce(m.component_id, k.doc_id), FALSE) AS kept
FROM k LEFT JOIN c USING (k) LEFT JOIN m USING (c)
"""


@query("op11_minhash_near_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"))
