"""The registered queries of the retrieval engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import chunk, chunker, classify, evaluate, evidence, gather, reports, search, text
from lexloom.plans import loop  # noqa: F401  its queries are registered as well
from lexloom.plans.registered import QUERIES, SQL, load, query
from lexloom.sources import html, tables
from lexloom.sources.store import ChunkStore

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- retrieval

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _bm25_sql(where: str, top: int, name: str = "ranked") -> str:
    return f"""
asked AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark),
w AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE {where}),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_length FROM w),
tf AS (SELECT term, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
  FROM tf JOIN asked USING (term) JOIN df USING (term), stats GROUP BY ALL
),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {top})"""


@query(f"WITH {_bm25_sql("true", 5)} SELECT item_id, ranked.doc_id, CAST(rank AS INTEGER) AS rank, score, source || ', p.' || CAST(ranked.doc_id AS VARCHAR) AS citation FROM ranked JOIN documents USING (doc_id)")
def bm25_topk(spark, sf_dir):
    """The five best documents for each benchmark item, with citations."""
    docs = load(spark, sf_dir, "documents")
    best = search.bm25(load(spark, sf_dir, "benchmark"), docs, "item_id", "doc_id", 5)
    return best.join(docs.select("doc_id", "source"), "doc_id").select("item_id", "doc_id", "rank", "score", search.citation(F.col("source"), F.col("doc_id")).alias("citation"))


@query(f"WITH {_bm25_sql("lang IN ('fr', 'de') AND source = 'src3'", 3)} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM ranked")
def filtered_search(spark, sf_dir):
    """Filters stand below the ranking: IN, equality, and a condition of None that says nothing."""
    docs = load(spark, sf_dir, "documents").where(search.predicate(lang=["fr", "de"], source="src3", doc_id=None))
    return search.bm25(load(spark, sf_dir, "benchmark"), docs, "item_id", "doc_id", 3).select("item_id", "doc_id", "rank", "score")


_DENSE = """
dense_scored AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense_scored) WHERE rank <= {top})"""


def _vectors(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v


@query(f"WITH {_DENSE.format(top=5)} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score FROM dense")
def dense_topk(spark, sf_dir):
    """Every 20th vector as a query against all vectors, by cosine."""
    q, v = _vectors(spark, sf_dir)
    return search.dense(q, v, "query_id", "vec_id", 5).select("query_id", "vec_id", "rank", "score")


def _lists(spark, sf_dir, n=10):
    """Two ranked lists of documents for each item: BM25 over texts, and the same documents by the share of the item's terms."""
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    first = search.bm25(items, docs, "item_id", "doc_id", n)
    again = first.join(items.withColumnRenamed("text", "_q"), "item_id").join(docs.select("doc_id", F.col("text").alias("_p")), "doc_id")
    second = search.top_k(again.select("item_id", "doc_id", F.round(search.overlap_score(F.col("_q"), F.col("_p")), 6).alias("score")), "item_id", "doc_id", n)
    return first, second


def _fused_sql(weight: float, top: int, n: int = 10) -> str:
    return f"""WITH {_bm25_sql("true", n, "first")},
words AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM w),
shares AS (SELECT first.item_id, first.doc_id, round(count(words.term) * 1.0 / count(*), 6) AS c FROM first JOIN asked USING (item_id) LEFT JOIN words ON words.doc_id = first.doc_id AND words.term = asked.term GROUP BY ALL),
second AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS rank FROM shares),
parts AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s, rank AS r0, NULL AS r1 FROM first UNION ALL SELECT item_id, doc_id, {weight}::DOUBLE / (60 + rank), NULL, rank FROM second),
fused AS (SELECT item_id, doc_id, round(sum(s), 9) AS score, min(r0) AS r0, min(r1) AS r1 FROM parts GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, doc_id) AS rank FROM fused)
SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM placed WHERE rank <= {top}"""


@query(_fused_sql(1.0, 5))
def rrf_fuse(spark, sf_dir):
    return search.fuse(list(_lists(spark, sf_dir)), "item_id", "doc_id", top=5).select("item_id", "doc_id", "rank", "score")


@query(_fused_sql(2.0, 5))
def rrf_weighted(spark, sf_dir):
    return search.fuse(list(_lists(spark, sf_dir)), "item_id", "doc_id", [1.0, 2.0], top=5).select("item_id", "doc_id", "rank", "score")


def _searchable(spark, sf_dir):
    """All documents and items, with vectors where there are any: the embeddings of the same number stand in for a model's."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = load(spark, sf_dir, "documents").join(v, "doc_id", "left")
    items = load(spark, sf_dir, "benchmark").join(v.withColumnRenamed("doc_id", "item_id"), "item_id", "left")
    return items, docs


_HYBRID = f"""WITH {_bm25_sql("true", 30, "first")},
second AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM (SELECT q.vec_id AS item_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS s FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings d JOIN documents ON doc_id = d.vec_id) QUALIFY rank <= 30),
parts AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s, rank AS r0, NULL AS r1 FROM second UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank), NULL, rank FROM first),
fused AS (SELECT item_id, doc_id, round(sum(s), 9) AS score, min(r0) AS r0, min(r1) AS r1 FROM parts GROUP BY ALL),
placed AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, doc_id) AS INTEGER) AS rank FROM fused)"""


@query(f"{_HYBRID} SELECT item_id, doc_id, score, rank FROM placed WHERE rank <= 5")
def hybrid_search(spark, sf_dir):
    items, docs = _searchable(spark, sf_dir)
    return search.search(items, docs, "item_id", "doc_id", mode="hybrid")


@query(f"""{_HYBRID}, words AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM w),
again AS (SELECT placed.item_id, placed.doc_id, round(count(words.term) * 1.0 / count(*), 6) AS score FROM placed JOIN asked USING (item_id) LEFT JOIN words ON words.doc_id = placed.doc_id AND words.term = asked.term WHERE rank <= 30 GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM again QUALIFY rank <= 5""")
def hybrid_rerank(spark, sf_dir):
    items, docs = _searchable(spark, sf_dir)
    return search.search(items, docs, "item_id", "doc_id", mode="hybrid_rerank")


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def postings_df(spark, sf_dir):
    """Collection and document frequency of each term."""
    p = search.postings(load(spark, sf_dir, "documents"), "doc_id")
    return p.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


SYNONYMS = [["the", "der", "le"], ["and", "und", "et"], ["of", "von", "de"]]


def _has(t):
    return rf"regexp_matches(lower(text), '(^|[^a-z0-9]){t}($|[^a-z0-9])')"


@query("SELECT item_id, array_to_string(list_distinct_ordered, ' ') AS expansions FROM (SELECT item_id, list_filter(list_concat(" + ", ".join("CASE WHEN " + " OR ".join(_has(t) for t in g) + " THEN [" + ", ".join(f"CASE WHEN NOT {_has(t)} THEN '{t}' END" for t in g) + "] ELSE [] END" for g in SYNONYMS) + "), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM benchmark)")
def query_expand(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(search.expansions(F.col("text"), SYNONYMS), " ").alias("expansions"))


@query("SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9#][A-Za-z0-9#-]*'), lambda t: len(t) >= 5 AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]'))) AS identifier FROM documents")
def identifiers(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(search.identifiers(F.col("text"))).alias("identifier"))


# --- text

_KEY = r"trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '\s+', ' ', 'g'))"
_LINES = r"SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


@query(f"SELECT key, count(*) AS n FROM (SELECT {_KEY} AS key FROM ({_LINES})) GROUP BY key")
def line_norm_keys(spark, sf_dir):
    return text.lines(load(spark, sf_dir, "documents"), "doc_id").groupBy(text.line_key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_BOILER = f"""full_lines AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
edges AS (SELECT DISTINCT source, doc_id, {_KEY} AS key FROM (SELECT source, doc_id, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2):])) AS line FROM full_lines) WHERE len(trim(line)) <= 120),
boiler AS (SELECT source, key, n_pages FROM (SELECT source, key, count(DISTINCT doc_id) AS n_pages FROM edges GROUP BY ALL) JOIN (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source) USING (source) WHERE pages >= 2 AND n_pages >= greatest(2, ceil(pages * 0.02)))"""


@query(f"WITH {_BOILER} SELECT * FROM boiler")
def boilerplate_lines(spark, sf_dir):
    return text.boilerplate(load(spark, sf_dir, "documents"), "source", "doc_id", 0.02)


@query(f"WITH {_BOILER}, kept AS (SELECT * FROM (SELECT *, {_KEY} AS key FROM ({_LINES})) l WHERE NOT EXISTS (SELECT 1 FROM boiler b WHERE b.source = l.source AND b.key = l.key)) SELECT doc_id, source, coalesce(t, '') AS text FROM documents LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM kept GROUP BY doc_id) USING (doc_id)")
def drop_boilerplate(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return text.drop_lines(docs, "source", "doc_id", text.boilerplate(docs, "source", "doc_id", 0.02))


@query(rf"SELECT doc_id, unnest(regexp_extract_all(text, '{text.EMAIL}')) AS email FROM documents")
def extract_emails(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


@query(rf"SELECT doc_id, unnest(regexp_extract_all(text, '{text.PHONE}')) AS phone FROM documents")
def extract_phones(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(text.phones(F.col("text"))).alias("phone"))


@query("SELECT DISTINCT doc_id, regexp_replace(x, '^0+([0-9])', '\\1') AS number FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS x FROM documents)")
def extract_numbers(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(text.numbers(F.col("text"))).alias("number"))


@query()
def clean_nfkc(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders")
def date_spans(spark, sf_dir):
    """Dates found in notices that name each order's date in four ways, beside one that is none."""
    day = F.col("o_orderdate")
    said = F.concat_ws("; ", F.lit("Not 13/13/2024"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "MMMM d, yyyy"), F.upper(F.date_format(day, "dd-MMM-yyyy")), F.date_format(day, "MMM. d yyyy"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.dates(said)).alias("found")).select("o_orderkey", F.date_format("found", "yyyy-MM-dd").alias("found"))


@query("SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS found FROM events")
def time_spans(spark, sf_dir):
    """Times found in notes that name each event's time in three ways, beside one that is none."""
    said = F.concat_ws(" or ", F.lit("25:70"), F.date_format("ts", "H:mm"), F.date_format("ts", "h:mm a"), F.concat(F.date_format("ts", "h:mm:ss "), F.when(F.hour("ts") < 12, "a.m.").otherwise("p.m.")))
    return load(spark, sf_dir, "events").select("event_id", F.explode(text.times(said)).alias("found"))


# --- sources

@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_sha256(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tables.content_hash(F.col("text")).alias("content_hash"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|footer|head)[^>]*>.*?</(script|style|nav|footer|head)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", html.strip(F.col("html")).alias("text"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("link"))


@query()
def html_parse_fields(spark, sf_dir):
    return html.fields(load(spark, sf_dir, "pages"), "page_id", "html")


# --- chunks

_SHOUT = r"(t = upper(t) AND t <> lower(t) AND len(regexp_split_to_array(t, '\s+')) BETWEEN 2 AND 10 AND len(t) <= 80 AND NOT regexp_matches(t, '[.,;]$') AND len(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 4)"
_CAPITALS = "trim(regexp_extract(t, '" + chunk.LEADING_CAPS.replace("'", "''") + "', 1))"
_HEADING = rf"""CASE WHEN regexp_matches(t, '{chunk.MARKDOWN}') THEN trim(regexp_extract(t, '{chunk.MARKDOWN}', 1)) WHEN contains(t, '   ') THEN NULL
WHEN regexp_matches(t, '{chunk.SECTION_WORD}') AND NOT ends_with(t, '.') THEN t WHEN regexp_matches(t, '{chunk.NUMBERED}') AND NOT contains(t, ':') THEN t WHEN {_SHOUT} THEN t
WHEN len(regexp_split_to_array({_CAPITALS}, '\s+')) >= 3 AND NOT contains({_CAPITALS}, ',') THEN {_CAPITALS} END"""


@query(f"SELECT doc_id, pos, heading, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM (SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_HEADING} AS heading FROM (SELECT *, trim(line) AS t FROM ({_LINES})))")
def section_carry(spark, sf_dir):
    return chunk.carry_sections(text.lines(load(spark, sf_dir, "documents"), "doc_id"), "doc_id", "pos").select("doc_id", "pos", "heading", "section")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) AS BIGINT) AS tokens, true AS fits FROM documents WHERE regexp_matches(text, '\S')")
def chunk_pack(spark, sf_dir):
    """Documents cut into chunks of 500 tokens without overlap: all tokens are there, and each chunk fits."""
    page = F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text"), F.array().cast("array<string>").alias("headings"), F.array().cast("array<string>").alias("tables")))
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("file_name"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("int").alias("addendum_number"), page.alias("pages"))
    made = chunker.chunk_documents(docs, chunker.Sizes(overlap=0))
    return made.groupBy(F.col("file_name").cast("long").alias("doc_id")).agg(F.sum("n_tokens").alias("tokens"), F.bool_and(F.col("n_tokens") <= 500).alias("fits"))


@query(r"""WITH l AS (SELECT source, doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
n AS (SELECT source, doc_id, unnest(list_transform(l, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')))) AS n FROM l)
SELECT source, count(*) AS lines, CAST(floor(avg(n)) AS BIGINT) AS avg_tokens, CAST(max(n) AS BIGINT) AS max_tokens, count(DISTINCT doc_id) AS docs FROM n GROUP BY source""")
def chunk_stats(spark, sf_dir):
    rows = text.lines(load(spark, sf_dir, "documents"), "source", "doc_id").where(F.trim("line") != "").withColumn("n", chunk.count_tokens(F.col("line")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.floor(F.avg("n")).alias("avg_tokens"), F.max("n").cast("long").alias("max_tokens"), F.count_distinct("doc_id").alias("docs"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '/' || CAST(doc_id AS VARCHAR) || '/1/0')) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(hex((('0x' || h[17:18])::INTEGER & 63) | 128)) || h[19:20] || '-' || h[21:32] AS chunk_id FROM h""")
def chunk_uuid(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", chunk.uuid5(F.concat_ws("/", "source", F.col("doc_id").cast("string"), F.lit("1"), F.lit("0"))).alias("chunk_id"))


_SYNONYM_LISTS = "list_filter(list_concat(" + ", ".join("CASE WHEN " + " OR ".join(_has(t) for t in g) + " THEN [" + ", ".join(f"CASE WHEN NOT {_has(t)} THEN '{t}' END" for t in g) + "] ELSE [] END" for g in SYNONYMS) + "), lambda x: x IS NOT NULL)"


@query(f"SELECT item_id, array_to_string(list_concat([text], {_SYNONYM_LISTS}), ' ') AS keywords, CASE WHEN len(list_filter(regexp_extract_all(text, '[A-Za-z0-9#][A-Za-z0-9#-]*'), lambda t: len(t) >= 5 AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]'))) > 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM benchmark")
def query_plan(spark, sf_dir):
    return search.plan(load(spark, sf_dir, "benchmark"), SYNONYMS).select("item_id", "keywords", "weight")


# --- evaluation of the search itself: whole items against the documents that contain them

_BM25_METRICS = f"""WITH {_bm25_sql("true", 10)},
gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
hit AS (SELECT item_id, min(rank) AS f FROM gold LEFT JOIN ranked USING (item_id, doc_id) GROUP BY item_id)
SELECT count(*) AS questions, {", ".join(f"round(avg(CASE WHEN f <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS r{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, round(avg(coalesce(1.0::DOUBLE / log2(f + 1), 0)), 6) AS ndcg FROM hit"""


@query(_BM25_METRICS)
def retrieval_metrics_bm25(spark, sf_dir):
    """Recall, reciprocal rank and nDCG of BM25 over all documents."""
    docs, items = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", "text")
    gold = docs.join(F.broadcast(items.withColumnRenamed("text", "_item")), F.contains("text", "_item")).select("item_id", "doc_id")
    return search.metrics(search.first_hits(gold, search.bm25(items, docs, "item_id", "doc_id", 10), "item_id", "doc_id"))


@query(f"SELECT r5 >= 0.90 AND mrr >= 0.75 AS passed FROM ({_BM25_METRICS}) m")
def quality_gate_bm25(spark, sf_dir):
    """Whether BM25 passes the gate on recall and reciprocal rank."""
    return evaluate.passes(retrieval_metrics_bm25(spark, sf_dir))


@query()
def grounding_check(spark, sf_dir):
    """Values made of each turn's own facts against the turn before it."""
    rows = load(spark, sf_dir, "conversations")
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") == F.col("b.turn") + 1))
    return pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.array_join(text.grounding_problems(F.col("a.text"), F.col("b.text")), "; ").alias("problems"))


@query(rf"SELECT doc_id, CASE WHEN lang = 'fr' THEN 'no date; no time' WHEN lang = 'es' THEN 'no date' WHEN lang = 'de' OR regexp_matches(text, '{text.EMAIL}|{text.PHONE}') THEN '' ELSE 'no e-mail or phone' END AS problems FROM documents WHERE text IS NOT NULL")
def format_check(spark, sf_dir):
    """Documents taken for values of four formats; none of them states a date or time in a known form."""
    kind = F.when(F.col("lang") == "fr", "datetime").when(F.col("lang") == "es", "date").when(F.col("lang") == "de", "text").otherwise("contact")
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(text.format_problems(kind, F.col("text")), "; ").alias("problems"))


@query("SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9#-]+'), lambda t: regexp_matches(t, '[0-9]')))), ' '), '') AS guards FROM conversations")
def guard_tokens(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.guard_tokens(F.col("text")), " ").alias("guards"))


@query(r"SELECT doc_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]+'), lambda t: regexp_full_match(t, '[0-9]{3}-[A-Za-z0-9]{4}')), lambda t: t))) AS identifier FROM documents")
def id_completion(spark, sf_dir):
    """Part-number-like identifiers in documents: three digits, a hyphen, four alphanumerics, not inside a longer token."""
    found = evidence.complete_ids(F.array().cast("array<string>"), F.array("text"), [r"(?<![A-Za-z0-9-])[0-9]{3}-[A-Za-z0-9]{4}(?![A-Za-z0-9-])"])
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(found).alias("identifier"))


@query("SELECT source AS collection, CAST(doc_id AS VARCHAR) AS file_name, sha256(text) AS file_hash FROM documents")
def stream_index(spark, sf_dir):
    """Documents arriving as a stream, indexed batch by batch: the manifest after all that is there."""
    from lexloom.streaming import index

    return index.run_available(spark, sf_dir)


# --- the loop's operators on whole tables

_NAMED = "CASE doc_id % 6 WHEN 0 THEN concat('Addendum No. ', doc_id) WHEN 1 THEN concat('spec ', source) WHEN 2 THEN concat('amendment_', source) WHEN 3 THEN 'RFQ' ELSE source END"


@query(rf"""WITH d AS (SELECT doc_id, {_NAMED} AS name, CASE WHEN lang = 'de' THEN 'html' ELSE 'pdf' END AS kind, substring(text, 1, 400) AS head FROM documents),
t AS (SELECT *, CASE WHEN kind = 'html' THEN 'bid_page' WHEN regexp_matches(name, '(?i)addendum|amendment') THEN 'addendum' WHEN regexp_matches(name, '(?i)affidavit') THEN 'affidavit' WHEN regexp_matches(name, '(?i)spec') THEN 'specs' WHEN regexp_matches(name, '(?i)rfp|rfq|ifb|solicitation') THEN 'rfp'
 WHEN regexp_matches(head, '(?i)(addendum\s*(no\.?|number|#)?|amendment\s*(no\.?|#)?)\s*\d+') THEN 'addendum' WHEN regexp_matches(head, '(?i)affidavit') THEN 'affidavit' WHEN regexp_matches(head, '(?i)(technical|product) specification') THEN 'specs'
 WHEN regexp_matches(head, '(?i)request for proposal|request for quot|invitation (for|to) bid|solicitation') THEN 'rfp' ELSE 'other' END AS doc_type FROM d)
SELECT doc_id, doc_type, CASE WHEN doc_type = 'addendum' THEN coalesce(try_cast(nullif(regexp_extract(name, '(?i)(?:addendum|amendment)\s*(?:no\.?|number|#)?\s*(\d+)', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(head, '(?i)(?:addendum|amendment)\s*(?:no\.?|number|#)?\s*(\d+)', 1), '') AS INTEGER)) END AS addendum_number FROM t""")
def classify_documents(spark, sf_dir):
    """Types and amendment numbers of documents under made-up file names."""
    docs = load(spark, sf_dir, "documents").withColumn("_name", F.expr(_NAMED)).withColumn("_kind", F.when(F.col("lang") == "de", "html").otherwise("pdf"))
    kind = classify.doc_type(F.col("_name"), F.col("_kind"), F.col("text"))
    return docs.withColumn("doc_type", kind).select("doc_id", "doc_type", classify.addendum_number(F.col("_name"), F.col("text"), F.col("doc_type")).alias("addendum_number"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS doc_date FROM orders WHERE o_orderkey % 3 <> 0")
def issue_dates(spark, sf_dir):
    """Issue dates of notices made of orders in three formats; every third states a due date only."""
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(F.col("o_orderkey") % 5 == 0, F.upper(F.date_format("o_orderdate", "d-MMM-yyyy"))).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Notice\nNew due date: "), day)).otherwise(F.concat(F.lit("Notice\nClosing soon.\nIssued by the office on "), day))
    return load(spark, sf_dir, "orders").select("o_orderkey", classify.doc_date(said).alias("doc_date")).where("doc_date IS NOT NULL")


@query("""WITH h AS (SELECT l_suppkey AS record, l_linenumber AS field_pos, l_orderkey % 3 AS query_pos, l_partkey AS chunk_id, min(CAST(l_quantity AS INTEGER)) AS rank FROM lineitem GROUP BY ALL),
s AS (SELECT record, field_pos, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(query_pos * 1000 + rank) AS met FROM h GROUP BY ALL)
SELECT record, field_pos, chunk_id, score, CAST(row_number() OVER (PARTITION BY record, field_pos ORDER BY score DESC, met, chunk_id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY record, field_pos ORDER BY score DESC, met, chunk_id) <= 5""")
def fuse_by_field(spark, sf_dir):
    """The five best parts of each supplier and line number, fused over three lists of orders."""
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("record"), F.col("l_linenumber").alias("field_pos"), (F.col("l_orderkey") % 3).alias("query_pos"), F.col("l_partkey").alias("chunk_id"))
    return gather.fuse_fields(rows.agg(F.min(F.col("l_quantity").cast("int")).alias("rank")))


_CELL = "max(CASE WHEN o_orderstatus = '{s}' THEN CASE WHEN n % 2 = 1 THEN '⚠ ' ELSE '' END || c || ' (' || o_orderstatus || ', p.' || n || ')' END)"


@query(f"""WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(max(o_custkey) AS VARCHAR) AS c FROM orders GROUP BY ALL)
SELECT o_orderpriority AS field, {", ".join(f"coalesce({_CELL.format(s=s)}, 'not stated') AS {s}" for s in "FOPX")} FROM g GROUP BY o_orderpriority""")
def comparison_table(spark, sf_dir):
    """Cells of records (order statuses, one of them unknown) side by side, a row for each field (priority)."""
    orders = load(spark, sf_dir, "orders")
    grouped = orders.groupBy(F.col("o_orderstatus").alias("record"), F.col("o_orderpriority").alias("field")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("o_custkey").cast("string").alias("c"))
    results = grouped.select("record", "field", F.array("c").alias("value"), F.array(F.struct(F.col("record").alias("file"), F.col("n").alias("page"))).alias("sources"), F.lit(0.9).alias("confidence"), F.when(F.col("n") % 2 == 1, reports.FAILED_NOTE).otherwise("").alias("notes"))
    registry = orders.select(F.col("o_orderpriority").alias("field"), F.lit(0).alias("field_pos")).distinct()
    return reports.compare(reports.build_records(orders.select(F.col("o_orderstatus").alias("record")), registry, results), list("FOPX")).drop("field_pos")


@query("""WITH r AS (SELECT doc_id AS record, 'quality' AS field, CAST(quality AS VARCHAR) AS v FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE toxic = 1)
SELECT DISTINCT l.doc_id AS record, g.field_pos, g.field, coalesce(r.v, '') AS value, CASE WHEN r.v IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN r.v IS NULL THEN 'Not found in documents' ELSE 'labelled' END AS notes
FROM labels l CROSS JOIN (VALUES ('quality', 0), ('toxic', 1), ('summary', 2)) g(field, field_pos) LEFT JOIN r ON r.record = l.doc_id AND r.field = g.field""")
def assemble_records(spark, sf_dir):
    """Every registry field of every labelled document, with defaults for what no result holds."""
    labels = load(spark, sf_dir, "labels")
    found = [labels.where(F.col(c) == 1).select(F.col("doc_id").alias("record"), F.lit(c).alias("field"), F.array(F.col(c).cast("string")).alias("value")) for c in ("quality", "toxic")]
    results = found[0].unionByName(found[1]).select("*", F.array().cast("array<struct<file: string, page: int>>").alias("sources"), F.lit(0.9).alias("confidence"), F.lit("labelled").alias("notes")).distinct()
    registry = spark.createDataFrame([("quality", 0), ("toxic", 1), ("summary", 2)], "field string, field_pos int")
    return reports.build_records(labels.select(F.col("doc_id").alias("record")), registry, results).select("record", "field_pos", "field", F.coalesce(F.array_join("value", "; "), F.lit("")).alias("value"), "confidence", "notes")


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, source, doc_id FROM documents WHERE NOT (source = 'src1' AND doc_id % 2 = 0))
SELECT source AS collection, CAST(doc_id AS VARCHAR) AS file_name, CASE WHEN source = 'src1' AND doc_id % 2 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'skipped' END AS state,
 coalesce((SELECT count(*) FROM l WHERE l.doc_id = d.doc_id AND trim(line) <> ''), 0) > 0 AS stored FROM documents d""")
def store_index(spark, sf_dir):
    """Documents indexed twice, every fifth changed and half of a collection gone in between: states, and what is held."""
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("file_name"), "text", "doc_id")
    hashed = lambda rows: rows.withColumn("file_hash", tables.content_hash(F.col("text")))
    held = ChunkStore(spark, f"{tables.shared_folder(spark)}/lexloom-store-{uuid.uuid4().hex}", "collection string, file_name string, chunk_id string, chunk_index int, text string")

    def chunks(rows):
        parts = chunk.chunk_documents(rows.withColumn("_k", F.struct("collection", "file_name")), "_k").select("_k.*", "chunk_index", "text")
        return parts.withColumn("chunk_id", chunk.uuid5(F.concat_ws("/", "collection", "file_name", F.lit("1"), F.col("chunk_index").cast("string"))))

    held.index(hashed(docs), chunks)
    later = docs.where("NOT (collection = 'src1' AND doc_id % 2 = 0)").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    report = held.index(hashed(later), chunks)
    files = held.chunks().select("collection", "file_name").distinct().withColumn("stored", F.lit(True))
    return report.join(files, ["collection", "file_name"], "left").select("collection", "file_name", "state", F.coalesce("stored", F.lit(False)).alias("stored"))
