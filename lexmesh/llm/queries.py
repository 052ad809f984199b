"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql:
        ORACLE[fn.__name__] = sql
    return fn


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.exact_dedup import duplicate_classes
    return duplicate_classes(table(spark, sf_dir, "documents"))


query(op1_exact_dedup, """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
""")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.simhash import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


query(op3_simhash_near_dedup)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.mixing import copies
    found = copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


query(op6_source_mixing, r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS slice
  FROM documents),
sources AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key, source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w,
         source_size * 3 AS most FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, key
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER (ORDER BY most / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
         AS level FROM weighed),
targets AS (
  SELECT key, source_size, least(CAST(most AS DOUBLE), coalesce(max(CASE WHEN most > level * w THEN level END)
         OVER () * w, CAST(most AS DOUBLE))) AS target FROM levels),
ranked AS (
  SELECT doc_id, key, size, CAST(row_number() OVER (PARTITION BY key ORDER BY size, slice, doc_id NULLS FIRST)
         AS DOUBLE) AS rnk, CAST(('0x' || substr(md5('mix|' || key), 1, 4))::INTEGER AS DOUBLE) / 65536 AS u
  FROM sized),
rated AS (
  SELECT r.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM ranked r JOIN targets t ON t.key = r.key)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(u + rate * rnk) - floor(u + rate * (rnk - 1))) AS BIGINT) AS taken
FROM rated
""")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.langid import identify
    return identify(table(spark, sf_dir, "documents"))


query(op7_language_id)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.packing import pack, pieces
    return pack(pieces(table(spark, sf_dir, "documents")))


query(op2_best_fit_packing)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.secrets import KINDS, scan
    found = scan(table(spark, sf_dir, "documents"))

    def of(kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
                        F.sha2(text(of(KINDS[:3])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


query(op4_secret_scan)


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.warc import archive_and_read
    return archive_and_read(table(spark, sf_dir, "pages", "page_id", "url", "html"))


query(op9_warc_index, """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first_id END AS refers_to
FROM (SELECT *, n >= 100 AND first_id IS NOT NULL AND (page_id IS NULL OR page_id > first_id) AS revisit
      FROM (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest,
                   min(page_id) OVER (PARTITION BY h) AS first_id
            FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)))
""")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.html_text import extract
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


query(op10_html_main_text)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.ann import neighbours
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


query(op8_nearest_neighbours)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.line_dedup import drop_repeats
    found = drop_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0), lambda n, r: n + r["b"] - r["a"]).cast("long")
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["a"], r["b"])), ",")
    return found.select("doc_id", "n_lines", n_removed.alias("n_removed"), spans.alias("removed"),
                        F.sha2("text", 256).alias("text_sha256"))


query(op5_line_dedup)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.divergence import divergences
    return divergences(table(spark, sf_dir, "documents", "text", "lang", "source"))


query(op13_source_divergence, r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs
  FROM (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs)
  GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM counts GROUP BY lang, term HAVING sum(docs) >= 10),
langs AS (SELECT lang, sum(lang_n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS lang_total,
         coalesce((SELECT sum(c.n) FROM counts c JOIN kept k ON k.lang = c.lang AND k.term = c.term
                   WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l ON l.lang = g.lang),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS HUGEINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (g.lang_total + 2 * g.v) AS HUGEINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY a.lang, a.source, b.source),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 10
""")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.spelling import variants
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))


query(op11_spelling_variants)


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmesh.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, share=(85, 100))


query(op12_minhash_near_dedup)
