"""Queries of the extraction loop, answers, decisions and reports: the library's operators on whole tables, each beside SQL that is
written on its own. The tables stand in for the engine's: orders for notices and dated values, lineitem for ranked hits,
labels for judged results, events for traced calls, embeddings for question vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import evaluate, evidence, gather, layout, reports, search
from lexloom.plans.registered import load, query
from lexloom.sources import ingest
from lexloom.streaming import index


def _none():
    return F.array().cast("array<string>")


# --- sources


@query("""SELECT CAST(page_id AS VARCHAR) AS file_name, CASE WHEN page_id % 5 = 0 THEN 'skipped' WHEN page_id % 7 = 0 THEN 'partial' ELSE 'ok' END AS status,
 CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS pages, CASE WHEN page_id % 5 <> 0 AND page_id % 7 = 0 THEN 1 ELSE 0 END AS empty FROM pages""")
def ingest_report(spark, sf_dir):
    """Pages as files, every fifth of no known type and every seventh empty, through the parser: a row of the report each."""
    pages = load(spark, sf_dir, "pages")
    files = pages.select(F.lit("portal").alias("collection"), F.col("page_id").cast("string").alias("file_name"), F.when(F.col("page_id") % 5 != 0, "html").alias("file_type"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("html")).cast("binary").alias("content"), F.lit("").alias("file_hash"))
    return ingest.report(ingest.parse(files)).select("file_name", "status", "pages", "empty")


# --- gathering

_HITS = """h AS (SELECT l_suppkey AS record, l_linenumber AS field_pos, l_orderkey % 3 AS query_pos, l_partkey AS chunk_id, min(CAST(l_quantity AS INTEGER)) AS rank FROM lineitem GROUP BY ALL),
s AS (SELECT record, field_pos, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(query_pos * 1000 + rank) AS met FROM h GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY record, field_pos ORDER BY score DESC, met, chunk_id) AS rank FROM s QUALIFY rank <= 5)"""


def _fused(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("record"), F.col("l_linenumber").alias("field_pos"), (F.col("l_orderkey") % 3).alias("query_pos"), F.col("l_partkey").alias("chunk_id"))
    return gather.fuse_fields(rows.agg(F.min(F.col("l_quantity").cast("int")).alias("rank")))


@query(f"""WITH {_HITS}, f AS (SELECT record, chunk_id, min(field_pos * 10 + rank) AS seen FROM best GROUP BY ALL)
SELECT record, field_pos, chunk_id, 'E' || CAST(1 + (SELECT count(*) FROM f g WHERE g.record = f.record AND g.seen < f.seen) AS VARCHAR) AS evidence_id FROM best JOIN f USING (record, chunk_id)""")
def gather_evidence(spark, sf_dir):
    """The evidence of each supplier's fields, numbered in the order in which a part is first met."""
    return gather.number(_fused(spark, sf_dir)).select("record", "field_pos", "chunk_id", "evidence_id")


_CHUNKS = "c AS (SELECT source AS record, lang AS file_name, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS i, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


@query(f"""WITH {_CHUNKS}, seeds AS (SELECT * FROM c WHERE rank <= 2),
w AS (SELECT c.record, c.file_name, c.i, c.chunk_id, min(s.rank) AS seed FROM c JOIN seeds s ON s.record = c.record AND s.file_name = c.file_name AND abs(s.i - c.i) = 1 WHERE c.rank > 5 GROUP BY ALL),
f AS (SELECT *, min(seed) OVER (PARTITION BY record, file_name) AS least FROM w),
n AS (SELECT record, chunk_id, 0.0::DOUBLE AS score, row_number() OVER (PARTITION BY record ORDER BY least, file_name, i) AS place FROM f)
SELECT record, chunk_id, 1.0::DOUBLE / rank AS score, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 5
UNION ALL SELECT n.record, n.chunk_id, n.score, CAST(place + (SELECT max(rank) FROM c WHERE c.record = n.record AND rank <= 5) AS INTEGER) FROM n""")
def neighbor_expand(spark, sf_dir):
    """The five longest documents of each source, and those beside the first two in their language."""
    from pyspark.sql import Window

    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("record"), F.col("lang").alias("file_name"), F.col("doc_id").alias("chunk_id"), "n_chars")
    placed = docs.withColumn("chunk_index", F.row_number().over(Window.partitionBy("record", "file_name").orderBy("chunk_id")) - 1)
    best = search.top_k(docs.select("record", "chunk_id", F.col("n_chars").alias("score")), "record", "chunk_id", 5).select("record", F.lit(0).alias("field_pos"), "chunk_id", (1.0 / F.col("rank")).alias("score"), "rank")
    return gather.neighbours(best, placed.select("record", "file_name", "chunk_index", "chunk_id")).select("record", "chunk_id", "score", "rank")


# --- drafts to results


@query("""SELECT d.doc_id AS record, f.field, CASE WHEN f.field = 'quality' AND quality = 1 AND (doc_id % 3 = 1 OR (doc_id % 3 = 2 AND doc_id % 2 = 0)) THEN 'good; seen' END AS value,
 CASE WHEN f.field = 'quality' AND quality = 1 AND doc_id % 3 = 1 THEN 'E1' WHEN f.field = 'quality' AND quality = 1 AND doc_id % 3 = 2 AND doc_id % 2 = 0 THEN 'E2' ELSE '' END AS evidence,
 CASE WHEN f.field = 'other' OR (quality = 1 AND NOT (doc_id % 3 = 1 OR (doc_id % 3 = 2 AND doc_id % 2 = 0))) THEN 0.0 ELSE 0.88 END::DOUBLE AS confidence,
 CASE WHEN f.field = 'other' THEN 'Not found in documents (no draft)' WHEN quality = 1 AND NOT (doc_id % 3 = 1 OR (doc_id % 3 = 2 AND doc_id % 2 = 0)) THEN 'Rejected: value had no valid citation' WHEN quality = 1 THEN 'read' ELSE 'Not found in documents. read' END AS notes
FROM labels d, (VALUES ('quality'), ('other')) f(field) WHERE quality IS NOT NULL""")
def finalize_drafts(spark, sf_dir):
    """Drafts on labelled documents whose citations are real for some ids only; the second field has no draft."""
    labels = load(spark, sf_dir, "labels").where("quality is not null")
    value = F.when(F.col("quality") == 1, F.array(F.lit(" good "), F.lit("n/a"), F.lit("seen"), F.lit("good"))).otherwise(F.array(F.lit("Unknown")))
    cited = F.concat(F.lit("E"), (F.col("doc_id") % 3).cast("string"))
    drafts = labels.select(F.col("doc_id").alias("record"), F.lit("quality").alias("field"), value.alias("value"), F.array(cited, F.lit("E9"), cited).alias("evidence_ids"), F.lit(0.876).alias("confidence"), F.lit("read").alias("reasoning"))
    proof = labels.select(F.col("doc_id").alias("record"), F.lit("E1").alias("evidence_id"), F.lit("a.pdf").alias("file_name")).unionByName(labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("record"), F.lit("E2").alias("evidence_id"), F.lit("b.pdf").alias("file_name")))
    specs = spark.createDataFrame([("quality", False), ("other", True)], "field string, is_list boolean")
    return evidence.finalize_drafts(specs, drafts, proof).select("record", "field", F.array_join("value", "; ").alias("value"), F.array_join("evidence_ids", " ").alias("evidence"), "confidence", "notes")


@query("""WITH r AS (SELECT o_custkey AS record, o_orderpriority AS field, CAST(max(CAST(floor(o_totalprice) AS INTEGER)) AS VARCHAR) AS value FROM orders GROUP BY ALL),
f AS (SELECT o_custkey AS record, o_orderpriority AS field, CAST(count(*) AS VARCHAR) AS value, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 + 1 END) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL HAVING max(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) = 1)
SELECT record, field, r.value AS old_value, f.value AS new_value, CAST(n AS INTEGER) AS addendum_number FROM r JOIN f USING (record, field)""")
def reconcile_latest(spark, sf_dir):
    """Changes found in each customer's finished orders, made where an order that is an addendum is cited."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderpriority").alias("field"), "o_orderkey", "o_orderstatus", "o_totalprice")
    results = orders.groupBy("record", "field").agg(F.array(F.max(F.col("o_totalprice").cast("int")).cast("string")).alias("value")).withColumn("confidence", F.lit(0.5))
    findings = orders.where("o_orderstatus = 'F'").groupBy("record", "field").agg(F.array(F.count(F.lit(1)).cast("string")).alias("new_value"), F.collect_list(F.col("o_orderkey").cast("string")).alias("new_evidence_ids")).select("*", F.lit(True).alias("changed"), F.lit(None).cast("int").alias("addendum_number"))
    proof = orders.select("record", F.col("o_orderkey").cast("string").alias("evidence_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5 + 1).cast("int").alias("addendum_number"))
    _, changes = evidence.apply_amendments(results, findings, proof)
    return changes.select("record", "field", F.array_join("old_value", ";").alias("old_value"), F.array_join("new_value", ";").alias("new_value"), "addendum_number")


@query("""SELECT o_custkey AS record, 'Pre Bid Meeting date ' || strftime(a, '%Y-%m-%d') || ' is after Due Date date ' || strftime(b, '%Y-%m-%d') AS problem FROM
 (SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS a, max(CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END) AS b FROM orders GROUP BY o_custkey) WHERE a > b""")
def cross_field_check(spark, sf_dir):
    """Customers whose urgent orders (taken for meetings) all come after their last other order (taken for due dates)."""
    field = F.when(F.col("o_orderpriority") == "1-URGENT", "Pre Bid Meeting").otherwise("Due Date")
    results = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), field.alias("field"), F.array(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("value"))
    return evidence.cross_field_problems(results).select("record", "problem")


def _validations(spark, sf_dir):
    """Labelled documents as checked values: without a value, without a source, or passed."""
    labels = load(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    value = F.when(F.col("quality") == 1, F.array(F.lit("x")))
    return labels.select(F.col("doc_id").alias("record"), F.lit("quality").alias("field"), evidence.status(value, 1 - F.col("toxic"), _none()).alias("status"))


_STATUS = "v AS (SELECT doc_id AS record, CASE WHEN quality = 0 THEN 'not_found' WHEN toxic = 1 THEN 'failed' ELSE 'passed' END AS status FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@query(f"WITH {_STATUS} SELECT source, count_if(status = 'passed')::BIGINT AS passed, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'not_found')::BIGINT AS not_found FROM v JOIN documents ON doc_id = record GROUP BY source")
def validation_counts(spark, sf_dir):
    both = _validations(spark, sf_dir).join(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), "source"), "record")
    return evidence.status_counts(both, "source")


@query(f"WITH {_STATUS} SELECT record, CASE WHEN status = 'passed' AND record % 3 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'passed' AND record % 3 = 0 THEN 'q1 q2 q3' ELSE '' END AS queries FROM v")
def judge_verdicts(spark, sf_dir):
    """A judge who sees every second value and doesn't support every third: passed ones fail, with three queries at most."""
    checked = _validations(spark, sf_dir)
    verdicts = checked.where("record % 2 = 0 or record % 3 = 0").select("record", "field", (F.col("record") % 3 != 0).alias("supported"), F.array(*[F.lit(f"q{i}") for i in (1, 2, 3, 4)]).alias("retry_queries"))
    return evidence.apply_judge(checked, verdicts).select("record", "status", F.array_join("retry_queries", " ").alias("queries"))


@query(f"WITH {_STATUS} SELECT record, CASE WHEN status = 'failed' THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence FROM v")
def apply_validation(spark, sf_dir):
    checked = _validations(spark, sf_dir)
    return evidence.downgrade(checked.select("record", "field", F.lit(0.9).alias("confidence")), checked).select("record", "confidence")


@query(f"WITH {_STATUS} SELECT record FROM v WHERE status = 'failed' AND (record % 4 = 3 OR record % 4 < 2)")
def retry_set(spark, sf_dir):
    """Failed values that were tried again fewer than two times; every fourth was never tried."""
    checked = _validations(spark, sf_dir)
    tries = checked.where("record % 4 <> 3").select("record", "field", (F.col("record") % 4).cast("int").alias("n"))
    return evidence.retryable(checked, tries).select("record")


# --- answers


def _ranked(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_returnflag").alias("collection"), F.col("l_partkey").alias("chunk_id"), F.col("l_quantity").cast("double").alias("score"))
    return gather.best_scores(rows, "q", "collection")


_BEST = "b AS (SELECT l_suppkey AS q, l_returnflag AS collection, l_partkey AS chunk_id, max(CAST(l_quantity AS DOUBLE)) AS score FROM lineitem GROUP BY ALL)"


@query(f"WITH {_BEST} SELECT * FROM b")
def multi_query_max_score(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query(f"WITH {_BEST} SELECT q, chunk_id, collection, CAST(row_number() OVER (PARTITION BY q ORDER BY collection, score DESC, chunk_id) AS INTEGER) AS n FROM b")
def numbered_evidence(spark, sf_dir):
    return evidence.number_evidence(_ranked(spark, sf_dir), "q").select("q", "collection", "chunk_id", "n")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CAST(o_totalprice AS DOUBLE) DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey AS q, o_orderstatus AS collection, CAST(r * 100 AS INTEGER) AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'The due date was to ' || strftime(o_orderdate, '%Y-%m-%d') || '.' ELSE 'Order ' || o_orderkey || ' stands as it is.' END AS query FROM t WHERE r <= 2""")
def two_hop(spark, sf_dir):
    """Second-hop queries from the two dearest orders of each customer and status: what has changed, else the opening."""
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("The due date was changed to "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".  All else stands."))).otherwise(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" stands as it is.")))
    hits = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderstatus").alias("collection"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").cast("double").alias("score"), said.alias("text"))
    return gather.follow_up_queries(hits, "q", "collection").select("q", "collection", F.col("pos").cast("int").alias("pos"), "query")


@query(f"""WITH {_BEST}, f AS (SELECT l_suppkey AS q, l_returnflag AS collection, l_partkey AS chunk_id, min(l_orderkey) AS pos FROM lineitem WHERE l_discount > 0.09 GROUP BY ALL),
once AS (SELECT q, collection, chunk_id, 0 AS part, pos, 0.1::DOUBLE AS score FROM f UNION ALL SELECT b.q, b.collection, b.chunk_id, 1, 0, b.score FROM b ANTI JOIN f USING (q, collection, chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY q, collection ORDER BY part, CASE WHEN part = 1 THEN -score END, pos, chunk_id) AS r, count_if(part = 0) OVER (PARTITION BY q, collection) AS extra FROM once)
SELECT q, collection, chunk_id, score FROM r WHERE r <= 3 + extra""")
def merge_hops(spark, sf_dir):
    """The three best parts of each supplier and flag, after all that were followed up (those at a discount)."""
    follow = load(spark, sf_dir, "lineitem").where("l_discount > 0.09").groupBy(F.col("l_suppkey").alias("q"), F.col("l_returnflag").alias("collection"), F.col("l_partkey").alias("chunk_id")).agg(F.min("l_orderkey").alias("pos")).withColumn("score", F.lit(0.1))
    return gather.merge_hops(_ranked(spark, sf_dir), follow.withColumn("pos", F.col("pos").cast("int")), "q", "collection", 3)


@query(r"""WITH a AS (SELECT conv_id, turn, role <> 'user' AS said, text || ' [1]  [' || turn || '].' AS answer FROM conversations),
m AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[([0-9]+)\]', 1), lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 1 AND 3))) AS used FROM a)
SELECT conv_id, turn, CASE WHEN said THEN array_to_string(used, ' ') ELSE '' END AS cited, said AS found,
 CASE WHEN said THEN trim(regexp_replace(CASE WHEN turn BETWEEN 1 AND 3 THEN answer ELSE replace(answer, '[' || turn || ']', '') END, '\s+', ' ', 'g')) ELSE 'Not found in documents' END AS text FROM m""")
def citation_check(spark, sf_dir):
    """Turns taken for answers that cite passages 1 and their own number, of three passages; a user's turn found nothing."""
    answer = F.concat("text", F.lit(" [1]  ["), F.col("turn").cast("string"), F.lit("]."))
    checked = load(spark, sf_dir, "conversations").withColumn("c", evidence.check_citations(answer, F.col("role") != "user", F.lit(3)))
    return checked.select("conv_id", "turn", F.array_join(F.transform("c.cited", lambda x: x.cast("string")), " ").alias("cited"), "c.found", "c.text")


@query("""WITH s AS (SELECT q.vec_id AS q, c.vec_id AS added, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 20 = 0 AND c.vec_id % 20 <> 0)
SELECT q, CAST(added AS VARCHAR) AS answer, similarity FROM s WHERE similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, added) = 1""")
def semantic_cache_lookup(spark, sf_dir):
    """Every 20th vector as a question to a cache of the others; the label is a number that both must name."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.concat(F.lit("about lot"), F.col("label").cast("string")).alias("text"), F.lit("f").alias("fingerprint"))
    cache = v.where("vec_id % 20 <> 0").select("text", "embedding", "fingerprint", F.col("vec_id").cast("string").alias("answer"), F.col("vec_id").alias("added"))
    return gather.cache_lookup(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q"), cache, "q", 0.1)


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 500")
def cache_evict_fifo(spark, sf_dir):
    """Turns put into the cache of answers one after another: the last 500 stay."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("added"))
    old = F.col("turn") % 2 == 0
    return gather.cache_store(rows.where(old), rows.where(~old)).select("conv_id", "turn")


@query("""WITH known AS (SELECT DISTINCT source AS collection FROM documents WHERE lang = 'es'), asked AS (SELECT doc_id AS q, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'nowhere' END AS collection FROM documents)
SELECT q, collection FROM asked WHERE collection IN (FROM known) UNION ALL SELECT q, known.collection FROM (SELECT q FROM asked GROUP BY q HAVING coalesce(bool_or(collection IN (FROM known)), false) = false), known""")
def resolve_known(spark, sf_dir):
    """Collections asked for that are known (those with Spanish documents), else all known ones."""
    docs = load(spark, sf_dir, "documents")
    asked = docs.select(F.col("doc_id").alias("q"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, "nowhere").alias("collection"))
    return gather.resolve(asked, docs.where("lang = 'es'").select(F.col("source").alias("collection")).distinct(), "q")


# --- reports, costs, decisions


def _events(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    call = F.struct(F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))).alias("model"), F.col("event_id").alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"), F.lit(None).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"))
    calls = F.when(F.col("event_type") == "click", F.array(call, call)).otherwise(F.array().cast(f"array<{e.select(call.alias('c')).schema['c'].dataType.simpleString()}>"))
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("node"), F.col("event_id").alias("latency_ms"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") / 8).alias("cost"), F.when(F.col("event_id") % 100 == 0, F.concat(F.lit("down "), F.col("event_id").cast("string"))).alias("error"), calls.alias("calls"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS node, CAST(sum(event_id) AS BIGINT) AS latency_ms, round(sum(CASE WHEN event_id % 4 <> 0 THEN event_id / 8.0 ELSE 0 END::DOUBLE), 4) AS cost FROM events GROUP BY ALL")
def cost_by_node(spark, sf_dir):
    return reports.trace_by_node(_events(spark, sf_dir))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN user_id % 3 = 0 THEN '?' ELSE 'm' || CAST(user_id % 3 AS VARCHAR) END AS model, 2 * count(*) AS calls, CAST(2 * sum(event_id) AS BIGINT) AS input_tokens, 4 * count(*) AS output_tokens, 0::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_write_tokens FROM events WHERE event_type = 'click' GROUP BY ALL")
def cost_by_model(spark, sf_dir):
    return reports.trace_by_model(_events(spark, sf_dir))


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS steps, 2 * count_if(event_type = 'click')::BIGINT AS llm_calls, CAST(coalesce(2 * sum(event_id) FILTER (event_type = 'click'), 0) AS BIGINT) AS input_tokens, 4 * count_if(event_type = 'click')::BIGINT AS output_tokens,
 round(sum(CASE WHEN event_id % 4 <> 0 THEN event_id / 8.0 ELSE 0 END::DOUBLE), 4) AS cost, coalesce(string_agg('down ' || event_id, ', ' ORDER BY 'down ' || event_id) FILTER (event_id % 100 = 0), '') AS errors FROM events GROUP BY user_id""")
def trace_totals(spark, sf_dir):
    return reports.trace_totals(_events(spark, sf_dir)).withColumn("errors", F.array_join("errors", ", "))


@query("SELECT count(DISTINCT user_id) AS runs, round(sum(CASE WHEN event_id % 4 <> 0 THEN event_id / 8.0 ELSE 0 END::DOUBLE), 4) AS cost, (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING count_if(event_type = 'click') = 0)) AS without_calls FROM events")
def run_history(spark, sf_dir):
    return reports.history_totals(reports.trace_totals(_events(spark, sf_dir)))


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN round((l_partkey * 1.00317::DOUBLE + l_suppkey * 5.00713::DOUBLE + l_orderkey * 0.100317::DOUBLE + l_linenumber * 1.2539625::DOUBLE) / 1000000, 6)
 WHEN 'N' THEN round((l_partkey * 2.00319::DOUBLE + l_suppkey * 10.00717::DOUBLE + l_orderkey * 0.50129::DOUBLE + l_linenumber * 3.01131::DOUBLE) / 1000000, 6) END AS cost FROM lineitem""")
def call_costs(spark, sf_dir):
    """Lines taken for calls of three models, of which one has no price and one no prices of cached tokens."""
    calls = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.col("l_orderkey").alias("cache_read_tokens"), F.col("l_linenumber").alias("cache_write_tokens"))
    prices = spark.createDataFrame([("A", 1.00317, 5.00713, None, None), ("N", 2.00319, 10.00717, 0.50129, 3.01131)], "model string, input double, output double, cache_read double, cache_write double")
    return evidence.call_cost(calls, prices).select("l_orderkey", "l_linenumber", "cost")


@query("SELECT o_custkey, CASE WHEN datediff('day', DATE '1998-06-01', max(o_orderdate)::DATE) < 14 THEN 'fail' ELSE 'pass' END AS status FROM orders GROUP BY o_custkey")
def deadline_check(spark, sf_dir):
    """Whether each customer's last order date leaves two weeks from the first of June 1998."""
    days = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.to_date("o_orderdate")).alias("d"))
    return days.select("o_custkey", evidence.deadline_status(F.col("d"), F.lit("1998-06-01").cast("date")).alias("status"))


@query("""WITH c AS (SELECT * FROM (VALUES ('A', true), ('N', true), ('R', false)) AS c(id, must)),
a AS (SELECT l_orderkey AS record, l_returnflag AS id, max(CASE WHEN l_discount > 0.09 THEN 2 WHEN l_discount > 0.06 THEN 1 ELSE 0 END) AS s FROM lineitem GROUP BY ALL),
met AS (SELECT o.o_orderkey AS record, c.id, c.must, coalesce(a.s, 1) AS s FROM orders o CROSS JOIN c LEFT JOIN a ON a.record = o.o_orderkey AND a.id = c.id)
SELECT record, CASE WHEN max(CASE WHEN must AND s = 2 THEN 1 ELSE 0 END) = 1 THEN 'NO-GO' WHEN max(CASE WHEN must AND s = 1 THEN 1 ELSE 0 END) = 1 THEN 'REVIEW' ELSE 'GO' END AS decision FROM met GROUP BY record""")
def go_no_go_decide(spark, sf_dir):
    """Orders against three criteria, of which two are musts, assessed by their lines' discounts."""
    worst = F.max(F.when(F.col("l_discount") > 0.09, 2).when(F.col("l_discount") > 0.06, 1).otherwise(0))
    told = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("id")).agg(worst.alias("s")).withColumn("status", F.element_at(F.array(F.lit("pass"), F.lit("unknown"), F.lit("fail")), F.col("s") + 1))
    criteria = spark.createDataFrame([("A", True), ("N", True), ("R", False)], "id string, must_have boolean")
    return evidence.decide(criteria, told, load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record")))


@query(r"SELECT doc_id, coalesce(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 2500), 'not stated') AS value FROM documents")
def full_values(spark, sf_dir):
    """Whole documents as values, as a model's input for comparisons has them."""
    return load(spark, sf_dir, "documents").select("doc_id", reports.full_value(F.when(F.col("text").isNotNull(), F.array("text"))).alias("value"))


@query("SELECT source AS record, CASE WHEN count_if(lang = 'es') > 0 THEN 'Bid of ' || source || ' - es' ELSE 'Bid of ' || source END AS name FROM documents GROUP BY source")
def catalog_names(spark, sf_dir):
    """Collections by the title and company of their records, where there are any."""
    docs = load(spark, sf_dir, "documents")
    titles = docs.select(F.col("source").alias("record"), F.lit("Title").alias("field"), F.array(F.concat(F.lit("Bid  of "), "source")).alias("value")).distinct()
    companies = docs.where("lang = 'es'").select(F.col("source").alias("record"), F.lit("company_name").alias("field"), F.array("lang").alias("value")).distinct()
    return reports.catalog(docs.select(F.col("source").alias("collection")), titles.unionByName(companies), "Title", "company_name")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def last_entries(spark, sf_dir):
    return reports.last_rows(load(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 3)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS calls, round(sum(value), 4) AS latency FROM events GROUP BY ALL")
def cost_windows(spark, sf_dir):
    """The streaming aggregate on the table as a batch."""
    return index.cost_windows(load(spark, sf_dir, "events")).withColumn("latency", F.round("latency", 4))


# --- layout


@query("SELECT l_suppkey AS record, max_by(size, (w, -size)) AS body_size FROM (SELECT l_suppkey, round(CAST(l_quantity AS DOUBLE) / 4, 1) AS size, sum(len(l_returnflag || l_linestatus)) AS w FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def body_sizes(spark, sf_dir):
    spans = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("record"), (F.col("l_quantity").cast("double") / 4).alias("size"), F.concat(F.lit(" "), "l_returnflag", "l_linestatus").alias("text"))
    return layout.body_sizes(spans, "record")


@query("SELECT l_suppkey AS page, string_agg(t, chr(10) ORDER BY n) AS text FROM (SELECT l_suppkey, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN string_agg(l_returnflag || l_partkey, ' ' ORDER BY l_orderkey) ELSE string_agg(l_returnflag || l_partkey, '   ' ORDER BY l_orderkey) END AS t FROM (SELECT l_suppkey, l_linenumber, l_orderkey, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY l_suppkey, l_linenumber) GROUP BY l_suppkey")
def page_lines(spark, sf_dir):
    """Words placed on pages (suppliers) by line and order, closely on even lines: lines, column breaks and page texts."""
    width = F.when(F.col("l_linenumber") % 2 == 0, 9.0).otherwise(0.0)
    line = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_orderkey").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag")).withColumn("x", F.col("l_orderkey") * 10.0)
    words = line.select(F.col("l_suppkey").alias("page"), (F.col("l_linenumber") * 11.0 + F.col("l_orderkey") % 5).alias("y"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") / 1e6).otherwise(F.col("x") * 10).alias("x0"), (F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") / 1e6).otherwise(F.col("x") * 10) + width).alias("x1"), F.lit(10.0).alias("height"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    return layout.page_text(layout.visual_lines(words, "page"), "page")


@query("""SELECT r_regionkey, '| ' || r_name || ' | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def table_markdown(spark, sf_dir):
    """Regions' tables of nations, with an empty column and row that go, as Markdown."""
    row = F.array("n_name", F.lit(None).cast("string"), F.col("n_nationkey").cast("string"))
    body = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    head = F.array(F.array("r_name", F.lit(""), F.lit("n")), F.array(F.lit(" "), F.lit(None).cast("string")))
    both = load(spark, sf_dir, "region").join(body, F.col("r_regionkey") == F.col("n_regionkey"))
    return both.select("r_regionkey", layout.tables_text(F.concat(head, F.col("rows")))["markdown"].alias("markdown"))


# --- evaluation


@query("""SELECT lang AS record, count(*) AS fields, count_if(k IN (0, 2) OR (k = 1 AND doc_id % 8 = 1) OR (k = 3 AND source <> 'src1'))::BIGINT AS correct, count_if(k = 1 AND doc_id % 8 <> 1)::BIGINT AS partial, 0::BIGINT AS wrong, count_if(k = 3 AND source = 'src1')::BIGINT AS missed, 0::BIGINT AS false_positive,
 round(avg(CASE WHEN k = 1 AND doc_id % 8 <> 1 THEN 0.5 WHEN k = 3 AND source = 'src1' THEN 0 ELSE 1 END::DOUBLE), 6) AS score FROM (SELECT *, doc_id % 4 AS k FROM documents) GROUP BY ROLLUP (lang)""")
def extraction_score_rollup(spark, sf_dir):
    """Each document's source against gold of four kinds: a word with alternatives, a date and time in another form, none, a text."""
    docs = load(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 4)
    kind = F.when(F.col("k") == 0, "keywords").when(F.col("k") == 1, "datetime").when(F.col("k") == 3, "text")
    expected = F.when(F.col("k") == 0, F.array(F.concat(F.lit("none|"), F.upper("source")))).when(F.col("k") == 1, F.array(F.lit("May 3, 2024 2:30 PM"))).when(F.col("k") == 3, F.array("source"))
    value = F.when(F.col("k") == 0, F.array(F.concat(F.lit("from  "), "source"))).when(F.col("k") == 1, F.array(F.when(F.col("doc_id") % 8 == 1, "05/03/2024 at 14:30").otherwise("on 3-MAY-2024"))).when((F.col("k") == 3) & (F.col("source") != "src1"), F.array("source"))
    gold = docs.select(F.col("doc_id").alias("record"), F.lit("source").alias("field"), kind.alias("kind"), expected.alias("expected"), F.lit(False).alias("accept_null"), F.lit(None).cast("string").alias("source"))
    results = docs.select(F.col("doc_id").alias("record"), F.lit("source").alias("field"), value.alias("value"), _none().alias("files"))
    scores = evaluate.score_fields(gold, results).join(docs.select(F.col("doc_id").alias("record"), "lang"), "record").drop("record")
    return evaluate.report(scores.withColumnRenamed("lang", "record"))


@query("""SELECT source AS record, lang AS field, count(*) AS runs, count_if(quality = 1 AND toxic = 0)::BIGINT AS correct, count_if(quality = 1 AND toxic = 0) < count(*) AS unstable FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def stability(spark, sf_dir):
    """Labelled documents as runs of their source and language, correct where they are good."""
    both = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return evaluate.stability(both.select(F.col("source").alias("record"), F.col("lang").alias("field"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").otherwise("wrong").alias("category")))


@query("""WITH c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, lang FROM documents)
SELECT lang AS id, CAST(min(CASE WHEN (source LIKE '%src3%' OR source LIKE '%src13%') AND doc_id % 2 = 0 THEN rank END) AS INTEGER) AS first FROM c WHERE rank <= 10 GROUP BY lang""")
def first_hits(spark, sf_dir):
    """Languages as questions whose results are their first documents: the first one of a source in part named src3 on an even page."""
    docs = load(spark, sf_dir, "documents")
    gold = F.array(F.struct(F.lit("SRC3").alias("file"), F.lit(0).alias("page"), F.lit("").alias("contains")), F.struct(F.lit("src13").alias("file"), F.lit(0).alias("page"), F.lit("").alias("contains")))
    questions = docs.select(F.col("lang").alias("id"), gold.alias("gold")).distinct()
    ranked = docs.select("lang", "doc_id", "source", (-F.col("doc_id")).alias("score"))
    results = search.top_k(ranked, "lang", "doc_id", 10).select(F.col("lang").alias("id"), "rank", F.col("source").alias("file_name"), (F.col("doc_id") % 2).cast("int").alias("page"), F.lit("x").alias("text"))
    return evaluate.retrieval(questions, results)
