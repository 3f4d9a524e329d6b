"""Clients, evaluation, registry, answers, decisions and the service."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.operators import evaluate, gather, search
from lexloom.plans import answers, client, decisions, extraction, registry
from lexloom.service import Engine, main


def test_clients_ask_again_and_retry():
    said = iter([client.Transient("busy"), client.ToolUnsupported(), client.Reply([{"x": 1}, {"x": 2}], {"input_tokens": 3}), client.Reply([{"x": -1}]), client.Reply([{"x": 5}])])
    seen, waits = [], []

    def send(model, system, messages, schema, forced):
        seen.append((forced, len(messages)))
        r = next(said)
        if isinstance(r, Exception):
            raise r
        return r

    def check(v):
        if v["x"] < 0:
            raise ValueError("negative")
        return v

    c = client.Client(send, {"fast": "m"}, wait=waits.append)
    assert c.structured("a", "s", "u", check) == {"x": 5}
    assert seen == [(True, 1), (True, 1), (False, 1), (False, 4), (False, 6)] and waits == [1] and len(c.calls) == 3
    with pytest.raises(client.ModelError):
        client.Client(lambda *a, **k: client.Reply([]), {"fast": "m"}).structured("a", "s", "u", check)
    with pytest.raises(client.ModelError):
        client.Client(send, {}, key=None)


def test_registry_and_settings(spark, tmp_path):
    fields = registry.registry(spark)
    assert fields.count() == 20 and registry.extractable(fields).count() == 19
    assert {r["grp"]: len(r["fields"]) for r in registry.by_group(fields).collect()} == {"dates_logistics": 5, "commercial_legal": 9, "product_specs": 5}
    with pytest.raises(ValueError):
        registry.registry(spark, [("x", "nowhere", "text", [], {})])
    (tmp_path / "s.json").write_text('{"settings": {"retries": 1}}')
    assert registry.settings(str(tmp_path / "s.json")).retries == 1 and registry.settings().target_tokens == 500
    with pytest.raises(ValueError):
        registry.Settings().with_values({"nothing": 1})
    assert registry.criteria(spark).where("must_have").count() == 6


def test_similarities_and_scores(spark):
    assert evaluate.partial_ratio("abc", "xxabcxx") == 100 and evaluate.partial_ratio("", "x") == 0
    assert evaluate.token_set_ratio("b a", "a b c") == 100 and evaluate.token_set_ratio("a", "z") < 50
    gold = [("r", "k", "keywords", ["net 30|thirty", "invoice"], False, None), ("r", "d", "datetime", ["May 3, 2024 2:30 PM"], False, "rfp|spec"), ("r", "l", "list", ["Form W-9|w9", "bond"], False, None), ("r", "n", None, None, False, None), ("r", "m", "text", ["x"], False, None), ("r", "o", "text", ["x"], True, None), ("r", "t", "text", ["the quick brown fox"], False, None)]
    got = [("r", "k", ["Net  30 days"], []), ("r", "d", ["05/03/2024"], ["the RFP.pdf"]), ("r", "l", ["the form w-9 signed", "Bid Bond"], []), ("r", "n", ["made up"], []), ("r", "t", ["quick brown fox"], [])]
    g = spark.createDataFrame(gold, "record string, field string, kind string, expected array<string>, accept_null boolean, source string")
    r = spark.createDataFrame(got, "record string, field string, value array<string>, files array<string>")
    scores = evaluate.score_fields(g, r)
    rows = {x["field"]: (x["category"], x["score"], x["cited"]) for x in scores.collect()}
    assert rows == {"k": ("partial", 0.5, None), "d": ("partial", 0.5, True), "l": ("correct", 1.0, None), "n": ("false_positive", 0.0, None), "m": ("missed", 0.0, None), "o": ("correct", 1.0, None), "t": ("correct", 1.0, None)}
    total = evaluate.report(scores).where("record is null").first()
    assert (total["fields"], total["correct"], total["false_positive"]) == (7, 3, 1)


def test_configurations_and_gate(spark):
    q = spark.createDataFrame([(1, [("a.pdf", 2, "Fee")]), (2, [("b", 1, "none")])], "id int, gold array<struct<file: string, page: int, contains: string>>")
    res = spark.createDataFrame([(1, 1, "a.pdf", 1, "fee"), (1, 2, "x/A.PDF", 2, "the fee is"), (2, 1, "b", 1, "other")], "id int, rank int, file_name string, page int, text string")
    rows = evaluate.configurations(q, {"one": lambda _: res, "none": lambda _: res.limit(0)})
    got = {r["config"]: (r["questions"], r["r1"], r["r3"], r["mrr"]) for r in rows.collect()}
    assert got == {"one": (2, 0.0, 0.5, 0.25), "none": (2, 0.0, 0.0, 0.0)}
    assert evaluate.passes(rows.where("config = 'one'")).first()[0] is False


def test_answers_from_question_to_cache(spark):
    chunks = spark.createDataFrame([("a", "c1", "rfp", "rfp.pdf", 1, "Proposals are due June 1. Bring forms."), ("a", "c2", "addendum", "add.pdf", 1, "The due date is revised to July 4. All else stands."), ("b", "c3", "rfp", "other.pdf", 2, "Delivery takes 30 days.")], "collection string, chunk_id string, doc_type string, file_name string, page int, text string")
    asked = spark.createDataFrame([(1, "when are proposals due", "a", [1.0, 0.0], 1), (2, "was the due date revised", "a", [0.0, 1.0], 2), (3, "zzz", None, [0.5, 0.5], 3)], "q int, text string, collection string, embedding array<double>, added long")
    cache = spark.createDataFrame([], "text string, embedding array<double>, fingerprint string, answer string, added long")
    out, after = answers.run(asked, chunks, chunks.select("collection"), cache=cache, fingerprint="f")
    got = {r["q"]: r for r in out.collect()}
    assert got[1]["text"].startswith("Proposals are due June 1.") and got[1]["found"] and got[1]["cited"]
    assert got[2]["found"] and not got[3]["found"] and got[3]["text"] == "Not found in documents"
    again, _ = answers.run(asked, chunks, chunks.select("collection"), cache=after, fingerprint="f")
    assert all(r["cached"] for r in again.collect())
    hits = answers.retrieve(spark.createDataFrame([(2, "a", ["was the due date revised"], True)], "q int, collection string, queries array<string>, amended boolean"), chunks)
    assert {r["chunk_id"] for r in hits.collect()} == {"c1", "c2"}


def test_reconciliation_sees_both_sides(spark):
    specs = spark.createDataFrame([("due", 0, True), ("fee", 1, False)], "field string, field_pos int, sensitive boolean")
    hits = spark.createDataFrame([("r", 0, 0, "c1", 1), ("r", 0, 0, "c2", 2), ("r", 1, 0, "c1", 1), ("s", 0, 0, "c9", 1)], "record string, field_pos int, query_pos int, chunk_id string, rank int")
    chunks = spark.createDataFrame([("r", "c1", "rfp", None), ("r", "c2", "addendum", 2), ("s", "c9", "rfp", None)], "record string, chunk_id string, doc_type string, addendum_number int")
    proof = decisions.reconciliation_evidence(specs, hits, chunks)
    assert sorted((r["record"], r["evidence_id"], r["chunk_id"]) for r in proof.collect()) == [("r", "A1", "c2"), ("r", "B1", "c1")]
    results = spark.createDataFrame([("r", "due", ["June 1"], 0.5)], "record string, field string, value array<string>, confidence double")
    model = lambda rows: rows.where("evidence_id = 'A1'").select("record", "field", F.lit(True).alias("changed"), F.lit(None).cast("int").alias("addendum_number"), F.array(F.lit("July 4")).alias("new_value"), F.array("evidence_id").alias("new_evidence_ids"))
    after, changes = decisions.reconcile(results, specs, hits, chunks, model)
    assert after.first()["value"] == ["July 4"] and changes.first()["addendum_number"] == 2


def test_plans_weigh_identifiers_and_search_once(spark):
    docs = spark.createDataFrame([(1, "deadline is near", [1.0, 0.0]), (2, "model AB-1234 ships", [0.0, 1.0])], "doc_id long, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "due date", [1.0, 0.0]), (2, "AB-1234", [1.0, 0.0]), (3, "due date", [1.0, 0.0])], "q int, text string, embedding array<double>")
    plans = {r["q"]: (r["weight"], "deadline" in r["keywords"]) for r in search.plan(asked, registry.SYNONYMS).collect()}
    assert plans == {1: (1.0, True), 2: (2.0, False), 3: (1.0, True)}
    best = {(r["q"], r["rank"]): r["doc_id"] for r in search.planned_search(asked, docs, "q", "doc_id", registry.SYNONYMS).collect()}
    assert best[2, 1] == 2 and best[1, 1] == best[3, 1]


def test_service(spark, tmp_path, capsys):
    folder = tmp_path / "in" / "bid1"
    folder.mkdir(parents=True)
    (folder / "page.html").write_text("<title>Laptops</title><body><p>Proposals are due May 20, 2024 at 2:30 PM.<p>Buyer Ann.</body>")

    def find(queries):
        return queries.select("record", "field_pos", "query_pos", F.lit(chunk_id).alias("chunk_id"), F.lit(1).alias("rank"))

    def draft(rows):
        value = F.when(F.col("field") == "Due Date", F.array(F.lit("May 20, 2024 at 2:30 PM")))
        return rows.select("record", "field", value.alias("value"), F.transform("passages", lambda p: p["evidence_id"]).alias("evidence_ids"), F.lit(0.9).alias("confidence"), F.lit("").alias("reasoning"))

    engine = Engine(spark, str(tmp_path / "home"), str(tmp_path / "in"), extraction.Agents(find, draft))
    assert engine.handle("POST", "/index", {"folder": "../.."})[0] == 400 and engine.handle("POST", "/index", {"folder": "none"})[0] == 404
    assert engine.handle("POST", "/index", {"folder": "."}) == (200, [{"state": "new", "count": 1}])
    chunk_id = engine.store.chunks().first()["chunk_id"]
    assert engine.handle("GET", "/bids") == (200, [{"collection": "bid1", "chunks": 1}])
    status, found = engine.handle("GET", "/search?query=proposals&top_k=3")
    assert status == 200 and found[0]["citation"] == "page.html, p.1"
    assert engine.handle("GET", "/search?query=x&mode=best")[0] == 422 and engine.handle("GET", "/search?query=x&top_k=99")[0] == 422 and engine.handle("GET", "/nothing")[0] == 404 and engine.handle("POST", "/ask", {})[0] == 422
    assert engine.handle("POST", "/extract", {"bid_id": "none"})[0] == 404
    assert engine.handle("POST", "/compare", {})[0] == 404
    engine.extract("bid1")
    assert engine.handle("POST", "/compare", {"bid_ids": ["bid1"]})[0] == 400
    assert engine.handle("POST", "/go-no-go", {"bid_id": "bid1", "as_of": "2024-05-01"}) == (200, [{"record": "bid1", "decision": "REVIEW"}])
    assert engine.handle("POST", "/go-no-go", {"bid_id": "bid1", "as_of": "2024-05-19"})[1] == [{"record": "bid1", "decision": "NO-GO"}]
    assert main(["go-no-go", "bid1", "--as-of", "2024-05-01"], engine) == 0 and "| deadline (must) | pass | by date |" in capsys.readouterr().out
    assert main(["compare"], engine) == 1
    assert gather.fingerprint(engine.store.files()).count() == 1 and datetime.date.today()
