"""Batched ranked retrieval: every step takes all queries at once and none runs a loop over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.sources.tables import written

MODES = ("dense", "sparse", "hybrid", "hybrid_rerank")
K1, B = 1.2, 0.75
RRF_K = 60
# Fixed value: what an identifier is made of.
IDENTIFIER = "[A-Za-z0-9#][A-Za-z0-9#-]*"
#: Most bytes of a set of queries (terms or vectors) that is broadcast; a larger set is searched in parts.
QUERY_BYTES = 16 << 20
#: Documents scored at a time, so that scores of a batch stay in memory.
BLOCK = 1024
#: Most cells of the matrix of terms by queries, and of a block of documents by terms.
CELLS = 4 << 20


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def predicate(**conditions) -> Column:
    """AND of equalities and INs; a condition of None says nothing."""
    out = F.lit(True)
    for name, value in conditions.items():
        if value is not None:
            out = out & (F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return out


def postings(docs: DataFrame, key: str) -> DataFrame:
    """(term, key, tf, length)"""
    words = docs.select(key, tokens(F.col("text")).alias("_w"))
    return words.select(key, F.size("_w").alias("length"), F.explode("_w").alias("term")).groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def _parts(queries: DataFrame, size: Column) -> list[DataFrame]:
    """The queries in parts of about QUERY_BYTES each, by a hash of all their columns."""
    n = max(1, -(-int(queries.agg(F.sum(size)).first()[0] or 0) // QUERY_BYTES))
    return [queries if n == 1 else queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(n)) == i) for i in range(n)]


def _best(scores: np.ndarray, keys: np.ndarray, top: int) -> list[tuple[int, np.ndarray]]:
    """For each query (column) the rows of its best scores above 0; ties go to the lower key, as in ``top_k``."""
    out = []
    for q in range(scores.shape[1]):
        x = scores[:, q]
        at = np.flatnonzero(~np.isnan(x))
        if len(at) > top:
            least = np.partition(x[at], len(at) - top)[len(at) - top]
            at = at[x[at] >= least]
        at = at[np.lexsort((keys[at], -x[at]))][:top]
        out.append((q, at))
    return out


def _result(queries: DataFrame, docs: DataFrame, query: str, key: str) -> T.StructType:
    return T.StructType([T.StructField("query", queries.schema[query].dataType), T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])


def _local_top(score: Callable, names: list, top: int, schema: T.StructType, block: int = BLOCK):
    """Rows (query, key, score) of the best of each query in a task: score gives a block's scores, rows by queries."""
    kinds = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in names]
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                keys = np.array(batch.column(0).to_pylist(), object)
                order = np.argsort(keys)
                rank = np.empty(len(keys), np.int64)
                rank[order] = np.arange(len(keys))
                scores = np.round(score(batch), 6)
                for q, at in _best(scores, rank, top):
                    if len(at):
                        held[q] = sorted([*held[q], *((-float(scores[i, q]), keys[i]) for i in at)])[:top]
        rows = [(names[q], k, -s) for q, best in enumerate(held) for s, k in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], names=["query", "key", "score"])

    return run


def bm25(queries: DataFrame, docs: DataFrame, query: str, key: str, top: int) -> DataFrame:
    """(query, key, score, rank): the best top documents of each query, whole texts; ties go to the lower key.

    Two narrow passes. The first counts, in each text, the terms of the queries (broadcast, in parts of a checked size) and writes
    them with the text's length; frequencies and the mean length are sums of that table. The second scores blocks of documents
    against all queries as a product of matrices and keeps each task's best, so pairs of a query and a document are never
    rows, and only tasks' best ones are shuffled.
    """
    out = None
    for part in _parts(queries, F.octet_length("text")):
        found = _bm25_part(part, docs, query, key, top)
        out = found if out is None else out.unionByName(found)
    return out


def _bm25_part(queries: DataFrame, docs: DataFrame, query: str, key: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [(r[0], r[1]) for r in queries.select(query, F.array_distinct(tokens(F.col("text"))).alias("w")).orderBy(query).collect()]
    terms = sorted({w for _, words in asked for w in words or ()})
    place = {w: i for i, w in enumerate(terms)}
    shared = spark.sparkContext.broadcast(terms)
    kinds = f"key {docs.schema[key].dataType.simpleString()}, length int, term array<int>, tf array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.string())
        for batch in batches:
            words = batch.column(1)
            flat = words.flatten()
            length = np.asarray(pc.fill_null(pc.list_value_length(words), 0)).astype(np.int64)
            row = np.repeat(np.arange(len(length)), length)
            at = pc.index_in(flat, value_set=wanted)
            hit = np.asarray(pc.is_valid(at))
            code = row[hit] * max(1, len(shared.value)) + np.asarray(at.drop_null()).astype(np.int64)
            code, tf = np.unique(code, return_counts=True)
            own = code // max(1, len(shared.value))
            offsets = pa.array(np.searchsorted(own, np.arange(len(length) + 1)).astype(np.int32))
            term = pa.array((code % max(1, len(shared.value))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length.astype(np.int32)), pa.ListArray.from_arrays(offsets, term), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=["key", "length", "term", "tf"])

    counted = written(docs.select(F.col(key).alias("key"), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("w")).mapInArrow(count, kinds))
    n_docs, mean = counted.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = np.zeros(max(1, len(terms)))
    for r in counted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r[0]] = r[1]
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    best, schema = None, _result(queries, docs, query, key)
    for group in _groups(asked):
        part = counted.mapInArrow(_scorer(spark, group, place, idf, mean, top, schema), schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = spark.createDataFrame([], schema)
    return top_k(best.select(F.col("query").alias(query), F.col("key").alias(key), "score"), query, key, top)


def _groups(asked: list[tuple]) -> Iterator[list[tuple]]:
    """Queries whose terms by queries make a matrix of at most CELLS cells (or one query alone)."""
    group: list[tuple] = []
    terms: set[str] = set()
    for one in asked:
        more = terms | set(one[1] or ())
        if group and len(more) * (len(group) + 1) > CELLS:
            yield group
            group, more = [], set(one[1] or ())
        group.append(one)
        terms = more
    if group:
        yield group


def _scorer(spark: SparkSession, group: list[tuple], place: dict[str, int], idf: np.ndarray, mean: float, top: int, schema: T.StructType):
    """The pass that scores counted documents against a group of queries."""
    own = np.array(sorted({place[w] for _, words in group for w in words or ()}), np.int64)
    here = {t: i for i, t in enumerate(own.tolist())}
    wanted = np.zeros((max(1, len(own)), len(group)))
    for q, (_, words) in enumerate(group):
        for w in words or ():
            wanted[here[place[w]], q] = idf[place[w]]
    matrix = spark.sparkContext.broadcast((own, wanted))

    def score(batch: pa.RecordBatch) -> np.ndarray:
        own, wanted = matrix.value
        length = batch.column(1).to_numpy()
        n = np.asarray(pc.list_value_length(batch.column(2))).astype(np.int64)
        row, term = np.repeat(np.arange(len(n)), n), batch.column(2).flatten().to_numpy()
        tf = batch.column(3).flatten().to_numpy().astype(float)
        at = np.minimum(np.searchsorted(own, term), max(0, len(own) - 1))
        known = own[at] == term if len(own) else np.zeros(len(term), bool)
        row, at, tf = row[known], at[known], tf[known]
        weight = np.zeros((len(n), wanted.shape[0]))
        weight[row, at] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
        out = weight @ wanted
        out[out == 0] = np.nan  # no term in common
        return out

    return _local_top(score, [a for a, _ in group], top, schema, max(16, min(BLOCK, CELLS // max(1, len(own)))))


def top_k(scored: DataFrame, query: str, key: str, top: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def first_hits(gold: DataFrame, ranked: DataFrame, query: str, key: str) -> DataFrame:
    """(query, first): for each query with gold, the best rank of a gold key, or null if none is ranked."""
    return gold.join(ranked.select(query, key, "rank"), [query, key], "left").groupBy(query).agg(F.min("rank").alias("first"))


def metrics(hits: DataFrame) -> DataFrame:
    """One row: recall at 1, 3, 5 and 10, mean reciprocal rank and nDCG (binary, first hit only) of first hits."""
    first = F.col("first")
    mean = lambda x: F.round(F.avg(F.coalesce(x, F.lit(0.0))), 6)
    recall = [mean((first <= k).cast("double")).alias(f"r{k}") for k in (1, 3, 5, 10)]
    return hits.agg(F.count(F.lit(1)).alias("questions"), *recall, mean(1 / first).alias("mrr"), mean(1 / F.log2(first + 1)).alias("ndcg"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense(queries: DataFrame, vectors: DataFrame, query: str, key: str, top: int) -> DataFrame:
    """(query, key, score, rank) by exact cosine: a stated set of queries (broadcast, in parts of a checked size) against all
    vectors in one narrow pass, as products of matrices of unit vectors; each task keeps its best. A zero vector has no score."""
    out = None
    for part in _parts(queries, F.size("embedding") * 8):
        found = _dense_part(part, vectors, query, key, top)
        out = found if out is None else out.unionByName(found)
    return out


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dense_part(queries: DataFrame, vectors: DataFrame, query: str, key: str, top: int) -> DataFrame:
    asked = queries.select(query, "embedding").where("embedding is not null").orderBy(query).toArrow()
    names = asked.column(0).to_pylist()
    schema = _result(queries, vectors, query, key)
    if not names:
        return top_k(vectors.sparkSession.createDataFrame([], schema).select(F.col("query").alias(query), F.col("key").alias(key), "score"), query, key, top)
    shared = vectors.sparkSession.sparkContext.broadcast(_units(asked.column(1).combine_chunks()).T)
    rows = vectors.where("embedding is not null").select(F.col(key).alias("key"), "embedding")
    best = rows.mapInArrow(_local_top(lambda batch: _units(batch.column(1)) @ shared.value, names, top, schema), schema)
    return top_k(best.select(F.col("query").alias(query), F.col("key").alias(key), "score"), query, key, top)


def fuse(lists: list[DataFrame], query: str, key: str, weights: list[float] | None = None, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (query, key, rank); ties by the ranks in the first lists, then key."""
    weights = weights or [1.0] * len(lists)
    parts = None
    for i, (ranked, w) in enumerate(zip(lists, weights, strict=True)):
        part = ranked.select(query, key, (F.lit(w) / (k + F.col("rank"))).alias("_s"), *[(F.col("rank") if j == i else F.lit(None).cast("int")).alias(f"rank_{j}") for j in range(len(lists))])
        parts = part if parts is None else parts.unionByName(part)
    ranks = [f"rank_{j}" for j in range(len(lists))]
    fused = parts.groupBy(query, key).agg(F.round(F.sum("_s"), 9).alias("score"), *[F.min(r).alias(r) for r in ranks])
    w = Window.partitionBy(query).orderBy(F.desc("score"), *[F.asc_nulls_last(r) for r in ranks], key)
    out = fused.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top) if top else out


def overlap_score(query: Column, passage: Column) -> Column:
    """The default reranker, deterministic and offline: the share of the query's distinct terms in the passage."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(passage))) / F.greatest(F.lit(1), F.size(q))


def search(queries: DataFrame, docs: DataFrame, query: str, key: str, mode: str = "hybrid_rerank", top: int = 5, candidates: int = 30, sparse_weight: float = 1.0, scorer: Callable[[Column, Column], Column] = overlap_score, **conditions) -> DataFrame:
    """Search in one of MODES; docs: key, text, embedding and metadata, queries: query, text, embedding.

    The filter stands below all ranking. Each list gives ``candidates``, the fused list keeps as many, and only those are
    reranked, on the query's own words.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    within = docs.where(predicate(**conditions))
    lists = []
    if mode != "sparse":
        lists.append(dense(queries, within, query, key, candidates))
    if mode != "dense":
        lists.append(bm25(queries, within, query, key, candidates))
    weights = [1.0] * len(lists) if len(lists) == 1 else [1.0, sparse_weight]
    fused = fuse(lists, query, key, weights, top=candidates)
    if mode == "hybrid_rerank":
        met = fused.select(query, key).join(within.select(key, F.col("text").alias("_p")), key).join(queries.select(query, F.col("text").alias("_q")), query)
        return top_k(met.select(query, key, F.round(scorer(F.col("_q"), F.col("_p")), 6).alias("score")), query, key, top)
    return fused.where(F.col("rank") <= top).select(query, key, "score", "rank")


def citation(file: Column, page: Column) -> Column:
    return F.format_string("%s, p.%d", file, page)


def expansions(text: Column, groups: list[list[str]]) -> Column:
    """Synonyms to add: the absent terms of each group of which a term occurs as a whole word."""
    low = F.lower(text)
    has = lambda t: low.rlike(rf"(^|[^a-z0-9]){t}($|[^a-z0-9])")
    parts = []
    for g in groups:
        anyone = F.lit(False)
        for t in g:
            anyone = anyone | has(t)
        parts.append(F.when(anyone, F.filter(F.array(*[F.when(~has(t), F.lit(t)) for t in g]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def identifiers(text: Column) -> Column:
    """Tokens of five characters or more with a letter and a digit."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), 1), lambda t: (F.length(t) >= 5) & t.rlike("[A-Za-z]") & t.rlike("[0-9]"))


def plan(queries: DataFrame, groups: list[list[str]], sparse_weight: float = 1.0, identifier_weight: float = 2.0) -> DataFrame:
    """queries (text) with keywords (the text and its expansions, for the sparse list alone) and weight (of the sparse list: more
    where the text names an identifier)."""
    added = expansions(F.col("text"), groups)
    weight = F.when(F.size(identifiers(F.col("text"))) > 0, F.lit(identifier_weight)).otherwise(F.lit(sparse_weight))
    return queries.withColumn("keywords", F.concat_ws(" ", F.array("text"), added)).withColumn("weight", weight)


def planned_search(queries: DataFrame, docs: DataFrame, query: str, key: str, groups: list[list[str]], top: int = 5, candidates: int = 30, scorer: Callable[[Column, Column], Column] = overlap_score, **conditions) -> DataFrame:
    """Hybrid search with reranking in which each query has the plan of its own text: the dense list and the reranker see the
    text, the sparse list its keywords, weighted query by query. Equal queries are searched once."""
    within = docs.where(predicate(**conditions))
    once = queries.groupBy("text").agg(F.min(query).alias("_one"), F.first("embedding").alias("embedding"))
    planned = written(plan(once, groups).withColumnRenamed("_one", query))
    first = dense(planned, within, query, key, candidates)
    second = bm25(planned.select(query, F.col("keywords").alias("text")), within, query, key, candidates).join(planned.select(query, "weight"), query)
    parts = first.select(query, key, (1.0 / (RRF_K + F.col("rank"))).alias("_s"), F.col("rank").alias("rank_0"), F.lit(None).cast("int").alias("rank_1"))
    parts = parts.unionByName(second.select(query, key, (F.col("weight") / (RRF_K + F.col("rank"))).alias("_s"), F.lit(None).cast("int").alias("rank_0"), F.col("rank").alias("rank_1")))
    fused = parts.groupBy(query, key).agg(F.round(F.sum("_s"), 9).alias("score"), F.min("rank_0").alias("rank_0"), F.min("rank_1").alias("rank_1"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last("rank_0"), F.asc_nulls_last("rank_1"), key)
    fused = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidates)
    met = fused.select(query, key).join(within.select(key, F.col("text").alias("_p")), key).join(planned.select(query, F.col("text").alias("_q")), query)
    best = top_k(met.select(query, key, F.round(scorer(F.col("_q"), F.col("_p")), 6).alias("score")), query, key, top)
    asked = queries.select(F.col(query).alias("_own"), F.col("text").alias("_t")).join(planned.select(query, F.col("text").alias("_t")), "_t")
    return asked.join(best, query).select(F.col("_own").alias(query), key, "score", "rank")


def view(results: DataFrame, chars: int = 220) -> DataFrame:
    """Results (rank, score, text, and the ranks in the lists, rank_0 dense and rank_1 sparse, where known) as they are shown."""
    place = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("-")) if name in results.columns else F.lit("-")
    shown = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, chars)
    return results.withColumn("score", F.format_number("score", 3)).withColumn("ranks", F.concat(place("rank_0"), F.lit("/"), place("rank_1"))).withColumn("text", shown)
