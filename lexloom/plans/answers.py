"""Cited answers to many questions at once: cache, search in every collection asked for, second hop, numbering, citation check.

Models are functions of DataFrames, as in ``extraction``; the defaults are deterministic and offline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import evidence, gather, search
from lexloom.sources import tables

PER_QUERY, PER_COLLECTION, QUERIES = 4, 8, 4


def opening_answer(numbered: DataFrame) -> DataFrame:
    """The offline default: the first sentence of each question's best passage, cited. (q, answer, found)."""
    first = numbered.groupBy("q").agg(F.max_by(F.struct("n", "text"), F.struct("score", -F.col("n"))).alias("b"))
    sentence = F.get(F.split(F.trim("b.text"), r"(?<=[.!?])\s+"), F.lit(0))
    return first.select("q", F.concat(sentence, F.lit(" ["), F.col("b.n").cast("string"), F.lit("]")).alias("answer"), F.lit(True).alias("found"))


def retrieve(questions: DataFrame, chunks: DataFrame, scorer: Callable[[Column, Column], Column] = search.overlap_score) -> DataFrame:
    """(q, collection, chunk_id, score): a chunk's best score over a question's queries, in each collection the best PER_QUERY of a
    query; where a question is about amendments, what they say has changed is searched in the base texts and has a place.

    questions: q, collection, queries ARRAY<STRING>, amended. chunks: collection, chunk_id, doc_type, text.
    """
    asked = questions.select("q", "collection", "amended", F.explode(F.slice("queries", 1, QUERIES + 1)).alias("text")).withColumn("_id", F.concat_ws("\1", F.col("q").cast("string"), "collection", "text"))

    def best(queries: DataFrame, within: DataFrame, top: int) -> DataFrame:
        """The best of each query in its own collection: candidates by BM25, reranked."""
        found = None
        for collection in [r[0] for r in queries.select("collection").distinct().collect()]:
            some = within.where(F.col("collection") == collection)
            part = search.bm25(queries.where(F.col("collection") == collection).select("_id", "text"), some.select("chunk_id", "text"), "_id", "chunk_id", 30)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return queries.sparkSession.createDataFrame([], "_id string, chunk_id string, score double, rank int")
        met = found.select("_id", "chunk_id").join(within.select("chunk_id", F.col("text").alias("_p")), "chunk_id").join(queries.select("_id", F.col("text").alias("_q")).distinct(), "_id")
        return search.top_k(met.select("_id", "chunk_id", F.round(scorer(F.col("_q"), F.col("_p")), 6).alias("score")), "_id", "chunk_id", top)

    asked = tables.written(asked)
    named = asked.select("_id", "q", "collection", "amended").distinct()
    hits = tables.written(best(asked, chunks, PER_QUERY).join(named, "_id"))
    amendments = asked.where("amended").withColumn("_id", F.concat(F.lit("a\1"), "_id"))
    more = tables.written(best(amendments, chunks.where("doc_type = 'addendum'"), PER_QUERY).join(amendments.select("_id", "q", "collection").distinct(), "_id"))
    both = gather.best_scores(hits.select("q", "collection", "chunk_id", "score").unionByName(more.select("q", "collection", "chunk_id", "score")), "q", "collection")
    told = more.join(chunks.select("chunk_id", "text"), "chunk_id")
    second = gather.follow_up_queries(told, "q", "collection").withColumnRenamed("query", "text")
    second = tables.written(second.withColumn("_id", F.concat_ws("\1", F.col("q").cast("string"), "collection", F.col("pos").cast("string"))))
    follow = best(second, chunks.where("doc_type <> 'addendum'"), 2).join(second.select("_id", "q", "collection", "pos"), "_id")
    return gather.merge_hops(both, follow.select("q", "collection", "pos", "chunk_id", "score"), "q", "collection", PER_COLLECTION)


def run(questions: DataFrame, chunks: DataFrame, known: DataFrame, answer: Callable[[DataFrame], DataFrame] = opening_answer, plan: Callable[[DataFrame], DataFrame] | None = None, cache: DataFrame | None = None, fingerprint: str = "") -> tuple[DataFrame, DataFrame | None]:
    """((q, text, cited, found, cached), the cache after it).

    questions: q, text, embedding, added (a number that orders them), collection (null: all known). plan: questions -> q,
    queries, amended; without one a question is its own query, about amendments if it says so. cache: text, embedding,
    fingerprint, answer, added. Answers that found nothing are cached, too.
    """
    asked = tables.written(questions.withColumn("fingerprint", F.lit(fingerprint)))
    held = tables.written(gather.cache_lookup(asked.select("q", "text", "embedding", "fingerprint"), cache, "q").select("q", "answer")) if cache is not None else None
    fresh = asked if held is None else asked.join(held, "q", "left_anti")
    planned = plan(fresh) if plan else fresh.select("q", F.array("text").alias("queries"), F.lower("text").rlike("addend|amend|chang|revis").alias("amended"))
    todo = gather.resolve(fresh.select("q", "collection"), known, "q").join(fresh.select("q", "text"), "q").join(planned, "q")
    todo = todo.withColumn("queries", F.array_distinct(F.concat(F.array("text"), "queries")))
    hits = retrieve(todo, chunks)
    numbered = tables.written(evidence.number_evidence(hits.join(chunks.select("chunk_id", "file_name", "page", "text"), "chunk_id"), "q"))
    drafts = answer(numbered)
    sources = numbered.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", search.citation(F.col("file_name"), F.col("page")).alias("source")))).alias("s"))
    rows = fresh.select("q", "text", "embedding", "fingerprint", "added").withColumnRenamed("text", "_question").join(drafts, "q", "left").join(sources, "q", "left")
    checked = rows.withColumn("c", evidence.check_citations(F.coalesce("answer", F.lit("")), F.coalesce("found", F.lit(False)), F.coalesce(F.size("s"), F.lit(0))))
    cited = F.transform("c.cited", lambda n: F.element_at("s", n)["source"])
    made = tables.written(checked.select("q", "_question", "embedding", "fingerprint", "added", F.col("c.text").alias("text"), F.coalesce(cited, F.array().cast("array<string>")).alias("cited"), F.col("c.found").alias("found")))
    out = made.select("q", "text", "cited", "found", F.lit(False).alias("cached"))
    if held is None:
        return out, cache
    after = gather.cache_store(cache.select("text", "embedding", "fingerprint", "answer", "added"), made.select(F.col("_question").alias("text"), "embedding", "fingerprint", F.col("text").alias("answer"), "added"))
    again = held.select("q", F.col("answer").alias("text"), F.array().cast("array<string>").alias("cited"), (F.col("answer") != evidence.NOT_FOUND).alias("found"), F.lit(True).alias("cached"))
    return out.unionByName(again), after
