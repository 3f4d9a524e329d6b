import datetime

from pyspark.sql import functions as F

from lexloom.operators import evidence, layout


def test_words_make_lines_with_column_breaks_and_paragraphs(spark):
    words = [(1, 10.0, 50.0, 80.0, 10.0, "two"), (1, 13.0, 0.0, 45.0, 10.0, "one"), (1, 24.0, 0.0, 10.0, 10.0, "a"), (1, 24.0, 40.0, 50.0, 10.0, "b"), (1, 60.0, 0.0, 9.0, 10.0, "end")]
    lines = layout.visual_lines(spark.createDataFrame(words, "p int, y double, x0 double, x1 double, height double, text string"), "p")
    assert [r["text"] for r in lines.orderBy("line").collect()] == ["one two", "a   b", "end"]
    assert layout.page_text(lines, "p").first()["text"] == "one two\na   b\n\nend"


def test_lines_are_anchored_at_their_first_word(spark):
    drift = spark.range(1).select(layout.anchored_groups(F.array(*[F.lit(x) for x in (0.0, 4.0, 8.0, 12.0)]), F.array(*[F.lit(5.0)] * 4)))
    assert drift.first()[0] == [0, 0, 1, 1]


def test_ocr_boxes_in_reading_order(spark):
    boxes = [(1, 12.0, 60.0, 90.0, 20.0, "right"), (1, 10.0, 0.0, 50.0, 20.0, "left"), (1, 40.0, 0.0, 50.0, 20.0, "below")]
    got = layout.ocr_lines(spark.createDataFrame(boxes, "p int, y double, x0 double, x1 double, height double, text string"), "p")
    assert [r["text"] for r in got.orderBy("line").collect()] == ["left right", "below"]


def test_body_size_and_headings(spark):
    spans = spark.createDataFrame([("d", 10.04, "a long run of body text"), ("d", 14.0, "Title"), ("e", 9.0, "  ")], "doc string, size double, text string")
    sizes = {r["doc"]: r["body_size"] for r in layout.body_sizes(spans, "doc").collect()}
    assert sizes == {"d": 10.0, "e": layout.DEFAULT_SIZE}
    rows = [("Scope of work", 12.0, False, True), ("Scope of work", 10.0, False, False), ("Bold words", 10.0, True, True), ("Bold words,", 10.0, True, False), ("LOUD WORDS", 10.0, False, True), ("Page 3 of 9", 20.0, True, False), ("12345 6", 20.0, False, False)]
    df = spark.createDataFrame(rows, "t string, s double, b boolean, want boolean")
    assert all(r[0] == r[1] for r in df.select(layout.is_heading(F.col("t"), F.col("s"), F.col("b"), F.lit(10.0)), "want").collect())


def test_points_in_boxes(spark):
    box = F.array(F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(5).alias("x1"), F.lit(5).alias("y1")))
    assert list(spark.range(1).select(layout.inside_any(F.lit(2), F.lit(5), box), layout.inside_any(F.lit(6), F.lit(1), box)).first()) == [True, False]


def test_cells_join_without_breaking_addresses(spark):
    cells = [("write to ann@exam\nple.org", "write to ann@example.org"), ("see https://x.org/a\n1. next", "see https://x.org/a 1. next"), ("plain\n text ", "plain text"), (None, ""), (" \n", "")]
    df = spark.createDataFrame(cells, "c string, want string")
    assert all(r[0] == r[1] for r in df.select(layout.join_cell(F.col("c")), "want").collect())


def test_tables(spark):
    rows = [[["a", None, "b"], [], ["c|d"], [None, "", ""]], [["Due", "May 1"], ["Who:", "Ann"]], [["x"]], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, r array<array<string>>").withColumn("n", layout.normalise_rows(F.col("r")))
    got = {r["id"]: r for r in df.select("id", "n", layout.is_layout(F.col("n")).alias("layout"), layout.rows_text(F.col("n")).alias("t"), layout.rows_markdown(F.col("n")).alias("m")).collect()}
    assert got[0]["n"] == [["a", "b"], ["c|d", ""]]
    assert got[0]["m"] == "| a | b |\n|---|---|\n| c\\|d |  |"
    assert got[1]["t"] == "Due: May 1\n\nWho: Ann"
    assert [got[i]["layout"] for i in (0, 1, 2)] == [False, False, True]
    assert got[3]["n"] == [] and got[4]["n"] is None


def test_guardrails_on_drafts(spark):
    specs = spark.createDataFrame([("title", False), ("parts", True), ("due", False), ("fee", False)], "field string, is_list boolean")
    drafts = spark.createDataFrame([(1, "title", [" A ", "n/a"], ["E1", "E1", "E9"], 0.876, "seen"), (1, "parts", ["x", "x", "y"], ["E8"], 0.9, ""), (1, "due", ["Unknown"], ["E1"], 0.5, "no date")], "record int, field string, value array<string>, evidence_ids array<string>, confidence double, reasoning string")
    proof = spark.createDataFrame([(1, "E1", "a.pdf"), (2, "E8", "b.pdf")], "record int, evidence_id string, file_name string")
    got = {r["field"]: r for r in evidence.finalize_drafts(specs, drafts, proof).collect()}
    assert (got["title"]["value"], got["title"]["evidence_ids"], got["title"]["confidence"]) == (["A"], ["E1"], 0.88)
    assert got["parts"]["value"] is None and got["parts"]["confidence"] == 0 and got["parts"]["notes"].startswith("Rejected")
    assert got["due"]["value"] is None and got["due"]["confidence"] == 0.5
    assert got["fee"]["value"] is None and got["fee"]["confidence"] == 0


def test_identifiers_are_completed_from_cited_texts(spark):
    got = spark.range(1).select(evidence.complete_ids(F.array(F.lit("100-AAAA")), F.array(F.lit("100-AAAA and 200-BBBB"), F.lit("none")), ["[0-9]{3}-[A-Z]{4}"])).first()[0]
    assert got == ["100-AAAA", "200-BBBB"]


def test_amendments_need_an_addendum(spark):
    results = spark.createDataFrame([(1, "due", ["May 1"], 0.7), (1, "fee", ["5"], 0.95)], "record int, field string, value array<string>, confidence double")
    findings = spark.createDataFrame([(1, "due", True, None, ["June 1"], ["A1"]), (1, "fee", True, None, ["6"], ["B1"])], "record int, field string, changed boolean, addendum_number int, new_value array<string>, new_evidence_ids array<string>")
    proof = spark.createDataFrame([(1, "A1", 2), (1, "B1", None)], "record int, evidence_id string, addendum_number int")
    after, changes = evidence.apply_amendments(results, findings, proof)
    assert {r["field"]: (r["value"], r["confidence"]) for r in after.collect()} == {"due": (["June 1"], 0.9), "fee": (["5"], 0.95)}
    assert [tuple(r) for r in changes.collect()] == [(1, "due", ["May 1"], ["June 1"], 2)]


def test_statuses_retries_and_downgrades(spark):
    rows = spark.createDataFrame([("a", ["x"], 1, []), ("b", ["x"], 0, []), ("c", None, 0, []), ("d", ["x"], 1, ["number 4"])], "field string, value array<string>, n int, problems array<string>")
    val = rows.select(F.lit(1).alias("record"), "field", evidence.status(F.col("value"), F.col("n"), F.col("problems")).alias("status"))
    assert {r["field"]: r["status"] for r in val.collect()} == {"a": "passed", "b": "failed", "c": "not_found", "d": "failed"}
    verdicts = spark.createDataFrame([(1, "a", False, ["q1", "q2", "q3", "q4"])], "record int, field string, supported boolean, retry_queries array<string>")
    judged = {r["field"]: r for r in evidence.apply_judge(val, verdicts).collect()}
    assert judged["a"]["status"] == "failed" and judged["a"]["retry_queries"] == ["q1", "q2", "q3"]
    tries = spark.createDataFrame([(1, "b", 2)], "record int, field string, n int")
    assert {r["field"] for r in evidence.retryable(val, tries).collect()} == {"d"}
    results = spark.createDataFrame([(1, "a", 0.9), (1, "d", 0.9), (1, "z", 0.9)], "record int, field string, confidence double")
    assert {r["field"]: r["confidence"] for r in evidence.downgrade(results, val).collect()} == {"a": 0.9, "d": 0.4, "z": 0.9}


def test_citations_of_answers(spark):
    rows = [("Yes [1] and [7]  so.", True, "Yes [1] and so."), ("Only [9].", True, evidence.NOT_FOUND), ("Yes [1].", False, evidence.NOT_FOUND), ("[99999999999]", True, evidence.NOT_FOUND)]
    df = spark.createDataFrame(rows, "a string, f boolean, want string").select(evidence.check_citations(F.col("a"), F.col("f"), F.lit(2)).alias("r"), "want")
    assert all(r["r"]["text"] == r["want"] for r in df.collect())
    hits = spark.createDataFrame([(1, "b", "c1", 0.9), (1, "a", "c2", 0.1), (1, "a", "c3", 0.5)], "q int, collection string, chunk_id string, score double")
    assert [r["chunk_id"] for r in evidence.number_evidence(hits, "q").orderBy("n").collect()] == ["c3", "c2", "c1"]


def test_deadlines_and_decisions(spark):
    day = F.lit(datetime.date(2024, 5, 1))
    dated = spark.createDataFrame([([datetime.date(2024, 5, 10), datetime.date(2024, 6, 1)], "pass"), ([datetime.date(2024, 5, 10)], "fail"), ([], "unknown")], "d array<date>, want string")
    assert all(r[0] == r[1] for r in dated.select(evidence.deadline_status(F.col("d"), day), "want").collect())
    criteria = spark.createDataFrame([("m", True), ("n", False)], "id string, must_have boolean")
    told = spark.createDataFrame([(1, "m", "pass"), (1, "n", "fail"), (2, "m", "fail"), (3, "x", "pass")], "record int, id string, status string")
    got = {r["record"]: r["decision"] for r in evidence.decide(criteria, told, told).collect()}
    assert got == {1: "GO", 2: "NO-GO", 3: "REVIEW"}


def test_costs(spark):
    calls = spark.createDataFrame([("fast", 1_000_000, 0, 1_000_000, 0), ("none", 5, 5, 5, 5)], "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    prices = spark.createDataFrame([("fast", 1.0, 5.0, None, None)], "model string, input double, output double, cache_read double, cache_write double")
    assert {r["model"]: r["cost"] for r in evidence.call_cost(calls, prices).collect()} == {"fast": 1.1, "none": None}
