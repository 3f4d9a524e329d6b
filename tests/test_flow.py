"""Document types and dates, the chunk store, gathering, the extraction loop, reports."""

import datetime

from pyspark.sql import functions as F

from lexloom.operators import chunk, classify, gather, reports
from lexloom.plans import extraction
from lexloom.sources import tables
from lexloom.sources.store import ChunkStore


def test_types_by_name_then_by_title(spark):
    rows = [("a.html", "html", "Addendum 1", "bid_page", None), ("Addendum No. 3.pdf", "pdf", "", "addendum", 3), ("x.pdf", "pdf", "AMENDMENT #12 to", "addendum", 12), ("addendum_2.pdf", "pdf", "about an addendum", "addendum", None), ("spec.pdf", "pdf", "Request for Proposals", "specs", None), ("y.pdf", "pdf", "Invitation to Bid 7", "rfp", None), ("y.pdf", "pdf", "z" * 400 + "affidavit", "other", None), ("y.pdf", None, None, "other", None)]
    df = spark.createDataFrame(rows, "name string, kind string, head string, want string, n int")
    got = df.withColumn("got", classify.doc_type(F.col("name"), F.col("kind"), F.col("head"))).withColumn("m", classify.addendum_number(F.col("name"), F.col("head"), F.col("got")))
    assert got.where("got <> want OR NOT (m <=> n)").count() == 0


def test_issue_dates(spark):
    rows = [("Issued: July 9, 2024", "2024-07-09"), ("New due date: 05/29/2024", None), ("Date: due 6/10/2024", None), ("Dated 31/12/2023\nIssued 1/2/2024", "2023-12-31"), ("issued 99/99/2024, published 26-MAY-2024", "2024-05-26"), ("published" + " " * 41 + "1/2/2024", None), ("Publication Sept. 3 2024", "2024-09-03"), ("no", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "text string, want string")
    got = df.withColumn("got", classify.doc_date(F.col("text")).cast("string"))
    assert got.where("NOT (got <=> want)").collect() == []


def _docs(spark, rows):
    return spark.createDataFrame(rows, "collection string, file_name string, text string").withColumn("file_hash", F.sha2("text", 256))


def _chunks(docs):
    rows = chunk.chunk_documents(docs.withColumn("_k", F.struct("collection", "file_name")), "_k", 3)
    return rows.select("_k.*", "chunk_index", "text").withColumn("chunk_id", F.concat_ws("/", "collection", "file_name", F.col("chunk_index").cast("string")))


def test_store_indexes_what_changed(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), "collection string, file_name string, chunk_id string, chunk_index int, text string")
    first = _docs(spark, [("a", "1", "x y\nz w"), ("a", "2", "keep"), ("b", "1", "other")])
    state = lambda r: {(x["collection"], x["file_name"]): x["state"] for x in r.collect()}
    assert set(state(store.index(first, _chunks)).values()) == {"new"}
    second = _docs(spark, [("a", "1", "changed"), ("a", "3", "")])
    assert state(store.index(second, _chunks)) == {("a", "1"): "changed", ("a", "2"): "removed", ("a", "3"): "new"}
    held = lambda: sorted((r["chunk_id"], r["text"]) for r in store.chunks().collect())
    assert held() == [("a/1/0", "changed"), ("b/1/0", "other")]
    assert store.files().count() == 3 and store.count(collection="b") == 1
    assert set(state(store.index(second, _chunks)).values()) == {"skipped"}
    store.compact()
    assert held() == [("a/1/0", "changed"), ("b/1/0", "other")]
    store.upsert(store.chunks(collection="a").withColumn("text", F.lit("again")))
    store._append("chunks", store.chunks().withColumn("chunk_id", F.lit("cut short")), 2**62)  # without its commit
    assert held() == [("a/1/0", "again"), ("b/1/0", "other")]
    assert store.get_texts(spark.createDataFrame([("a/1/0",), ("a/1/0",), ("?",)], "chunk_id string")).count() == 1
    assert store.get_chunks(spark.createDataFrame([("b", "1", 0)], "collection string, file_name string, chunk_index int")).count() == 1
    store.delete_files(second)
    assert held() == [("b/1/0", "other")] and store.files().count() == 1


def test_gather_numbers_neighbours(spark):
    hits = spark.createDataFrame([("r", 0, 0, "c5", 1), ("r", 0, 0, "c1", 2), ("r", 0, 1, "c1", 1), ("r", 1, 0, "c5", 1)], "record string, field_pos int, query_pos int, chunk_id string, rank int")
    chunks = spark.createDataFrame([("r", "f", i, f"c{i}") for i in range(7)], "record string, file_name string, chunk_index int, chunk_id string")
    best = gather.fuse_fields(hits, keep=2)
    both = gather.neighbours(best, chunks)
    got = sorted((r["field_pos"], r["rank"], r["chunk_id"]) for r in both.collect())
    assert got == [(0, 1, "c1"), (0, 2, "c5"), (0, 3, "c0"), (0, 4, "c2"), (0, 5, "c4"), (0, 6, "c6"), (1, 1, "c5"), (1, 2, "c4"), (1, 3, "c6")]
    ids = {(r["field_pos"], r["chunk_id"]): r["evidence_id"] for r in gather.number(both).collect()}
    assert ids[0, "c1"] == "E1" and ids[0, "c5"] == ids[1, "c5"] == "E2" and len(set(ids.values())) == 6


def test_second_hop_and_cache(spark):
    hits = spark.createDataFrame([("q", "a", "n1", 0.9, "The due date has been extended to June 4."), ("q", "a", "n1", 0.9, "The due date has been extended to June 4."), ("q", "a", "n2", 0.5, "plain words")], "q string, collection string, chunk_id string, score double, text string")
    asked = gather.follow_up_queries(hits, "q", "collection").orderBy("pos")
    assert [r["query"] for r in asked.collect()] == ["The due date has been to June 4.", "plain words"]
    follow = spark.createDataFrame([("q", "a", 100, "old", 0.1)], "q string, collection string, pos int, chunk_id string, score double")
    merged = gather.merge_hops(gather.best_scores(hits, "q", "collection"), follow, "q", "collection", keep=1)
    assert {r["chunk_id"] for r in merged.collect()} == {"old", "n1"}
    cache = spark.createDataFrame([("when is 7 due", [1.0, 0.0], "f", "a7", 1), ("when is 8 due", [1.0, 0.0], "f", "a8", 2)], "text string, embedding array<double>, fingerprint string, answer string, added int")
    found = gather.cache_lookup(cache.where("added = 2").withColumn("q", F.lit(1)), cache, "q").collect()
    assert [r["answer"] for r in found] == ["a8"]
    assert [r["added"] for r in gather.cache_store(cache, cache.withColumn("added", F.col("added") + 2), 2).collect()] == [4, 3]
    files = spark.createDataFrame([("a", "1", "h"), ("a", "2", "h")], "collection string, file_name string, file_hash string")
    prints = [gather.fingerprint(x).first()[0] for x in (files, files.orderBy(F.desc("file_name")), files.limit(1), files.limit(0))]
    assert prints[0] == prints[1] and len(set(prints)) == 3 and len(prints[0]) == 16
    known = files.select("collection").union(spark.createDataFrame([("b",)], "collection string"))
    ask = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "q int, collection string")
    assert sorted(map(tuple, gather.resolve(ask, known, "q").collect())) == [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]


SPECS = "field string, field_pos int, is_list boolean, kind string, queries array<string>"


def test_extraction_loop_retries_and_holds_down(spark, tmp_path):
    chunks = spark.createDataFrame([("r", "c1", "f.pdf", 1, "Total 12 units"), ("r", "c2", "f.pdf", 2, "Due May 20, 2024")], "record string, chunk_id string, file_name string, page int, text string")
    specs = spark.createDataFrame([("amount", 0, False, "text", ["units"]), ("due", 1, False, "date", ["due"]), ("none", 2, False, "text", ["zzz"]), ("wrong", 3, False, "text", ["units"])], SPECS)

    def search(queries):
        met = queries.join(chunks, "record").where(F.lower("text").contains(F.lower(F.col("query"))))
        return met.select("record", "field_pos", "query_pos", "chunk_id", F.lit(1).alias("rank"))

    def draft(rows):
        value = F.when(F.col("field") == "amount", F.when(F.col("feedback") == "", "13 units").otherwise("12 units")).when(F.col("field") == "due", "5/20/2024").otherwise("99 units")
        return rows.select("record", "field", F.array(value).alias("value"), F.transform("passages", lambda p: p["evidence_id"]).alias("evidence_ids"), F.lit(0.876).alias("confidence"), F.lit("read").alias("reasoning"))

    got = {r["field"]: r for r in extraction.run(chunks, specs, chunks, extraction.Agents(search, draft)).collect()}
    assert got["amount"]["value"] == ["12 units"] and got["amount"]["tries"] == 1 and got["amount"]["status"] == "passed"
    assert got["due"]["status"] == "passed" and got["due"]["chunk_ids"] == ["c2"] and got["due"]["confidence"] == 0.88
    assert got["none"]["status"] == "not_found" and got["none"]["value"] is None
    assert got["wrong"]["status"] == "failed" and got["wrong"]["tries"] == 2 and got["wrong"]["confidence"] == 0.4 and "number 99" in got["wrong"]["notes"]

    judge = lambda rows: rows.select("record", "field", (F.col("field") != "due").alias("supported"), F.array(F.lit("date")).alias("retry_queries"))
    judged = {r["field"]: r["status"] for r in extraction.run(chunks, specs, chunks, extraction.Agents(search, draft, judge), retries=1).collect()}
    assert judged == {"amount": "passed", "due": "failed", "none": "not_found", "wrong": "failed"}
    nothing = extraction.run(chunks.limit(0), specs, chunks, extraction.Agents(search, draft))
    assert nothing.count() == 0


def test_reports(spark, tmp_path):
    results = spark.createDataFrame([("x", "title", ["A  b"], [("f.pdf", 3)], 0.9, "ok"), ("y", "title", ["q" * 200], [], 0.4, "[Validation failed: number 9]")], "record string, field string, value array<string>, sources array<struct<file: string, page: int>>, confidence double, notes string")
    registry = spark.createDataFrame([("title", 0), ("company", 1)], "field string, field_pos int")
    built = reports.build_records(results, registry, results)
    table = {r["field"]: r for r in reports.compare(built, ["x", "y", "z"]).collect()}
    assert table["title"]["x"] == "A b (f.pdf, p.3)" and table["title"]["y"] == "⚠ " + "q" * 159 + "…" and table["company"]["x"] == table["title"]["z"] == "not stated"
    lines = [r["value"] for r in reports.markdown(reports.compare(built, ["x"]), "field_pos").collect()]
    assert lines == ["| field | x |", "|---|---|", "| title | A b (f.pdf, p.3) |", "| company | not stated |"]
    reports.write_records(built, str(tmp_path / "r"))
    (tmp_path / "r" / "bad.json").write_text('{"record": \n{"other": 1}\n')
    back = {r["record"]: r["fields"] for r in reports.read_records(spark, str(tmp_path / "r")).collect()}
    assert set(back) == {"x", "y"} and [f["field"] for f in back["x"]] == ["title", "company"]
    files = spark.createDataFrame([("x",), ("w",)], "collection string")
    assert dict(map(tuple, reports.catalog(files, built, "title", "company").collect())) == {"x": "A b", "w": "w"}
    assert [len(r["sources"]) for r in reports.summary_sources(built, ["company", "title"]).collect()] == [1]


def test_traces(spark, tmp_path):
    calls = "array<struct<model: string, input_tokens: long, output_tokens: long, cache_read_tokens: long, cache_write_tokens: long>>"
    events = spark.createDataFrame([("r1", "extract", 10, 0.12345, None, [("m", 5, 2, 0, None), (None, 1, 1, 0, 0)]), ("r1", "extract", 5, None, "down", None), ("r2", "report", 1, 0.1, None, [])], f"run_id string, node string, latency_ms long, cost double, error string, calls {calls}")
    totals = {r["run_id"]: r for r in reports.trace_totals(events).collect()}
    assert abs(totals["r1"].asDict().pop("cost") - 0.12345) < 1e-4
    assert [totals["r1"][c] for c in ("steps", "llm_calls", "input_tokens", "output_tokens", "errors")] == [2, 2, 6, 3, ["down"]]
    assert {r["model"]: r["calls"] for r in reports.trace_by_model(events).collect()} == {"m": 1, "?": 1}
    assert reports.trace_by_node(events).where("latency_ms = 15").count() == 1
    reports.write_trace(events, str(tmp_path / "t"))
    history = reports.run_history(spark, str(tmp_path / "t"))
    assert history.count() == 2 and reports.history_totals(history).first()["without_calls"] == 1
    reports.answer_log(spark.createDataFrame([("why", "so [1]", ["f, p.1"], datetime.datetime(2024, 5, 1, 9))], "question string, text string, cited array<string>, asked timestamp"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log"), wholetext=True).first()[0].endswith("Sources: f, p.1\n\n")


def test_scores_roll_up(spark):
    built = spark.createDataFrame([("x", "a", ["Yes"]), ("x", "b", None), ("y", "a", ["no", "q"])], "record string, field string, value array<string>")
    gold = spark.createDataFrame([("x", "a", ["yes"]), ("x", "b", None), ("y", "a", ["no", "maybe"]), ("y", "b", ["z"])], "record string, field string, expected array<string>")
    got = {(r["category"], r["record"]): (r["n"], r["mean"]) for r in reports.score(built, gold).collect()}
    assert got["correct", "x"] == (1, 1.0) and got["correct absent", None] == (1, 1.0) and got["partial", "y"] == (1, 0.5) and got["missed", None] == (1, 0.0)


def test_written_tables_cut_plans(spark):
    df = tables.written(spark.range(3))
    assert df.count() == 3 and "Range" not in df._jdf.queryExecution().toString()
