"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, divergence_rules, extendible, host_reputation, jaccard_join, mixing, quality_nbsvm, token_spans, toxicity_fm, wrappers
from lexloom.llm.store import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_nbsvm.train(docs, labels, fold("doc_id", 5) != 0)
    return quality_nbsvm.score(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return divergence_rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.shard(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_fm.train(docs, labels, fold("doc_id", 3) != 1)
    return toxicity_fm.score(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.count_sections(table(spark, sf_dir, "documents"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_ids(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_nbsvm, op2_divergence_rules, op3_extendible_shards, op4_host_reputation, op5_toxicity_fm, op6_decontaminate, op7_token_spans, op8_soft_mixing, op9_wrapper_text, op10_jaccard_components]
    return {f.__name__: f for f in found}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), il AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM iw WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM il)
), dw AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents
), doc_windows AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM dw, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, p, d.k, item_id FROM doc_windows d JOIN item_windows i ON d.k = i.k AND d.win = i.win
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SHINGLES = rf"""
w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') END AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)"""

OP10_SQL = f"""
WITH RECURSIVE {_SHINGLES}
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

_RULES = host_reputation.RULES


def _rule_sql(column: str) -> str:
    out = "NULL"
    for text, verdict in sorted(_RULES, key=lambda r: (len(r[0]), r[0])):
        own, _, begins = text.partition("/")
        out = f"CASE WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{begins}') THEN '{text if column == 'rule' else verdict}' ELSE {out} END"
    return out


def _level_sql(name: str, units: str, parents: str, unit: str, parent: str) -> str:
    return f"""
{name}_met AS (SELECT u.*, p.mean AS up FROM {units} u JOIN {parents} p USING ({parent})),
{name}_fit AS (SELECT sum(n * pow(good * 1.0 / n - up, 2)) AS q, sum(up * (1 - up)) AS b, sum((n - 1) * up * (1 - up)) AS d FROM {name}_met),
{name}_rho AS (SELECT CASE WHEN d > 0 THEN (q - b) / d ELSE 0.0 END AS rho FROM {name}_fit),
{name}_strength AS (SELECT least({host_reputation.MOST_STRENGTH}, greatest({host_reputation.LEAST_STRENGTH}, CASE WHEN rho > 1e-6 THEN 1 / rho - 1 ELSE {host_reputation.MOST_STRENGTH} END)) AS s FROM {name}_rho),
{name} AS (SELECT {unit}, {parent}, n, good, (good + s * up) / (n + s) AS mean, sqrt((good + s * up) / (n + s) * (1 - (good + s * up) / (n + s)) / (n + s + 1)) AS sd FROM {name}_met, {name}_strength)"""


OP4_SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path FROM pages
), v AS (
  SELECT *, array_to_string(l[greatest(1, len(l) - k + 1):], '.') AS suffix, array_to_string(l[greatest(1, len(l) - k):], '.') AS domain FROM (
    SELECT *, CASE WHEN len(l) > 1 AND l[-2] || '.' || l[-1] IN ({", ".join(f"'{x}'" for x in host_reputation.SUFFIXES)}) THEN 2 ELSE 1 END AS k FROM (SELECT *, string_split(host, '.') AS l FROM u))
), known AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), o AS (
  SELECT host, domain, suffix, good FROM v JOIN known ON known.doc_id = try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT) WHERE host <> ''
), hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS good FROM o GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 0 AS every, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
overall AS (SELECT 0 AS every, (g + 1) / (n + 2) AS mean, sqrt((g + 1) / (n + 2) * (n - g + 1) / (n + 2) / (n + 3)) AS sd FROM (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS g FROM suffixes)),
{_level_sql("s", "suffixes", "overall", "suffix", "every")},
{_level_sql("d", "domains", "s", "domain", "suffix")},
{_level_sql("h", "hosts", "d", "host", "domain")},
best AS (
  SELECT page_id, v.host, path, coalesce(h.mean, d.mean, s.mean, overall.mean) AS mean, coalesce(h.sd, d.sd, s.sd, overall.sd) AS sd
  FROM v LEFT JOIN h ON h.host = v.host LEFT JOIN d ON d.domain = v.domain LEFT JOIN s ON s.suffix = v.suffix, overall
)
SELECT page_id, host, path, {_rule_sql("rule")} AS rule, coalesce({_rule_sql("verdict")}, CASE WHEN least(1.0, mean + {host_reputation.Z} * sd) < {host_reputation.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM best
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_host_reputation": OP4_SQL, "op6_decontaminate": OP6_SQL, "op10_jaccard_components": OP10_SQL}
