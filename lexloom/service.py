"""The engine behind commands and a small HTTP interface: one object, one folder, plain values in and out.

``Engine.handle(method, path, body)`` answers a request without a socket, so it is tested as a function; ``serve`` puts it behind
the standard library's server. ``main`` is the command line: ``python -m lexloom.service COMMAND``.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import chunker, gather, reports, search
from lexloom.plans import answers, decisions, extraction, registry
from lexloom.sources import ingest
from lexloom.sources.store import ChunkStore

CHUNKS = "collection string, file_name string, page int, chunk_index int, chunk_id string, section string, is_table boolean, text string, header string, n_tokens int, doc_type string, addendum_number int"


class Refused(Exception):
    """A request that can't be met, with its HTTP status."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


class Engine:
    def __init__(self, spark: SparkSession, home: str, inbox: str, agents: extraction.Agents | None = None, settings: registry.Settings | None = None, parsers: dict | None = None):
        self.spark, self.home, self.inbox, self.agents, self.parsers = spark, home.rstrip("/"), inbox, agents, parsers
        self.settings = settings or registry.Settings()
        self.store = ChunkStore(spark, f"{self.home}/store", CHUNKS)
        self.fields = registry.registry(spark)

    # --- commands

    def within(self, folder: str) -> str:
        """A folder of the inbox; others are refused."""
        root, path = os.path.realpath(self.inbox), os.path.realpath(os.path.join(self.inbox, folder))
        if not path.startswith(root + os.sep) and path != root:
            raise Refused(400, "the folder is outside of the inbox")
        if not os.path.isdir(path):
            raise Refused(404, "no such folder")
        return path

    def ingest(self, folder: str) -> DataFrame:
        docs, report = ingest.ingest(self.spark, self.within(folder), self.parsers)
        ingest.save(docs, report, f"{self.home}/parsed")
        return report

    def chunk(self) -> DataFrame:
        return chunker.chunk_documents(ingest.load(self.spark, f"{self.home}/parsed"), self._sizes())

    def _sizes(self) -> chunker.Sizes:
        s = self.settings
        return chunker.Sizes(s.target_tokens, s.max_tokens, s.min_tokens, s.overlap_tokens)

    def index(self, folder: str, force: bool = False) -> DataFrame:
        self.ingest(folder)
        docs = ingest.load(self.spark, f"{self.home}/parsed")
        kinds = docs.select("collection", "file_name", "doc_type", "addendum_number")
        return self.store.index(docs, lambda some: chunker.chunk_documents(some, self._sizes()).join(kinds, ["collection", "file_name"]), force)

    def search(self, query: str, top: int = 5, mode: str = "sparse", **conditions) -> DataFrame:
        if mode not in search.MODES:
            raise Refused(422, f"mode {mode!r} is none of {search.MODES}")
        if mode != "sparse":
            raise Refused(503, "there is no encoder; use sparse")
        chunks = self.store.chunks(**conditions)
        asked = search.plan(self.spark.createDataFrame([(0, query)], "q int, text string"), self.settings.synonyms)
        best = search.bm25(asked.select("q", F.col("keywords").alias("text")), chunks, "q", "chunk_id", top)
        return best.join(chunks, "chunk_id").select("rank", "score", "collection", "file_name", "page", "text", search.citation(F.col("file_name"), F.col("page")).alias("citation")).orderBy("rank")

    def ask(self, question: str, **run) -> dict:
        asked = self.spark.createDataFrame([(0, question, None, [0.0], 0)], "q int, text string, collection string, embedding array<double>, added long")
        known = self.store.files().select("collection").distinct()
        out, _ = answers.run(asked, self.store.chunks(), known, **run)
        row = out.first()
        reports.answer_log(self.spark.createDataFrame([(question, row["text"], row["cited"], datetime.datetime.now(datetime.timezone.utc))], "question string, text string, cited array<string>, asked timestamp"), f"{self.home}/questions")
        return {"text": row["text"], "cited": row["cited"], "found": row["found"]}

    def extract(self, collection: str) -> DataFrame:
        if self.agents is None:
            raise Refused(503, "there is no model")
        if not self.store.count(collection=collection):
            raise Refused(404, f"{collection} is not indexed")
        chunks = self.store.chunks(collection=collection).withColumnRenamed("collection", "record")
        specs = registry.extractable(self.fields).select("field", "field_pos", "is_list", "kind", "queries")
        found = extraction.run(chunks.select("record"), specs, chunks.select("record", "chunk_id", "file_name", "page", "text"), self.agents, self.settings.retries)
        built = reports.build_records(chunks.select("record"), self.fields.select("field", "field_pos"), found)
        reports.write_records(built, f"{self.home}/records")
        return built

    def built(self) -> DataFrame:
        try:
            rows = reports.read_records(self.spark, f"{self.home}/records")
            rows.first()
        except Exception as e:
            raise Refused(404, "there are no records") from e
        each = rows.dropDuplicates(["record"]).select("record", F.posexplode("fields").alias("field_pos", "f"))
        return each.select("record", "field_pos", "f.*")

    def compare(self, names: list[str] | None = None) -> DataFrame:
        try:
            return decisions.compare(self.built(), names)[0]
        except ValueError as e:
            raise Refused(400, str(e)) from e
        except KeyError as e:
            raise Refused(404, str(e)) from e

    def go_no_go(self, record: str, as_of: str | None = None, assess: Callable | None = None) -> tuple[DataFrame, DataFrame]:
        built = self.built().where(F.col("record") == record)
        if built.isEmpty():
            raise Refused(404, f"no record of {record}")
        day = F.lit(as_of or datetime.datetime.now(datetime.timezone.utc).date().isoformat()).cast("date")
        return decisions.go_no_go(built.select("record"), built, registry.criteria(self.spark), day, assess, least_days=self.settings.min_days_to_prepare)

    def runs(self, last: int = 15) -> DataFrame:
        return reports.run_history(self.spark, f"{self.home}/traces", last)

    # --- requests

    def handle(self, method: str, target: str, body: dict | None = None) -> tuple[int, object]:
        """(status, value) of a request."""
        url = urlsplit(target)
        q, body = dict(parse_qsl(url.query)), body or {}
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        routes: dict[tuple[str, str], Callable[[], object]] = {
            ("GET", "/health"): lambda: {"status": "ok", "chunks": self.store.count(), "fingerprint": gather.fingerprint(self.store.files()).first()[0]},
            ("GET", "/bids"): lambda: rows(self.store.chunks().groupBy("collection").agg(F.count(F.lit(1)).alias("chunks")).orderBy("collection")),
            ("POST", "/index"): lambda: rows(self.index(body["folder"], bool(body.get("force"))).groupBy("state").count()),
            ("GET", "/search"): lambda: rows(self.search(q["query"], self._top(q), q.get("mode", "sparse"), collection=q.get("bid_id"), doc_type=q.get("doc_type"))),
            ("POST", "/ask"): lambda: self.ask(self._question(body)),
            ("POST", "/extract"): lambda: rows(self.extract(body["bid_id"])),
            ("POST", "/compare"): lambda: rows(self.compare(body.get("bid_ids"))),
            ("POST", "/go-no-go"): lambda: rows(self.go_no_go(body["bid_id"], body.get("as_of"))[1]),
        }
        try:
            if (method, url.path) not in routes:
                raise Refused(404, "no such place")
            return 200, routes[method, url.path]()
        except Refused as e:
            return e.status, {"detail": str(e)}
        except KeyError as e:
            return 422, {"detail": f"missing {e}"}

    @staticmethod
    def _top(q: dict) -> int:
        if not re.fullmatch("[0-9]+", q.get("top_k", "5")) or not 1 <= int(q.get("top_k", "5")) <= 50:
            raise Refused(422, "top_k must be 1 to 50")
        return int(q.get("top_k", "5"))

    @staticmethod
    def _question(body: dict) -> str:
        if len(body["question"]) < 3:
            raise Refused(422, "the question is too short")
        return body["question"]


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, value = engine.handle(method, self.path, json.loads(self.rfile.read(size) or b"{}") if size else {})
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

    return HTTPServer((host, port), Handler)


def main(arguments: list[str] | None = None, engine: Engine | None = None) -> int:
    """Runs a command; 1 if it can't be met."""
    parser = argparse.ArgumentParser("lexloom")
    parser.add_argument("--home", default="lexloom-home")
    parser.add_argument("--inbox", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, names in {"ingest": ["folder"], "chunk": [], "index": ["folder"], "search": ["query"], "ask": ["question"], "extract": ["collection"], "compare": [], "go-no-go": ["record"], "runs": [], "serve": []}.items():
        sub = commands.add_parser(name)
        for x in names:
            sub.add_argument(x)
        if name == "index":
            sub.add_argument("--force", action="store_true")
        if name == "search":
            sub.add_argument("-k", type=int, default=5)
        if name == "go-no-go":
            sub.add_argument("--as-of")
        if name == "runs":
            sub.add_argument("--limit", type=int, default=15)
        if name == "compare":
            sub.add_argument("records", nargs="*")
    a = parser.parse_args(arguments)
    engine = engine or Engine(SparkSession.builder.getOrCreate(), a.home, a.inbox)
    try:
        if a.command == "ingest":
            engine.ingest(a.folder).show(1000, False)
        elif a.command == "chunk":
            chunker.statistics(engine.chunk()).show(1000, False)
        elif a.command == "index":
            engine.index(a.folder, a.force).groupBy("collection", "state").count().show(1000, False)
        elif a.command == "search":
            search.view(engine.search(a.query, a.k)).show(a.k, False)
        elif a.command == "ask":
            print(engine.ask(a.question)["text"])
        elif a.command == "extract":
            engine.extract(a.collection).select("field", "value", "confidence", "notes").show(100, False)
        elif a.command == "compare":
            for row in reports.markdown(engine.compare(a.records or None), "field_pos").collect():
                print(row[0])
        elif a.command == "go-no-go":
            for row in decisions.decision_lines(*engine.go_no_go(a.record, a.as_of)).collect():
                print(row["value"])
        elif a.command == "runs":
            engine.runs(a.limit).show(a.limit, False)
        else:
            serve(engine).serve_forever()
    except Refused as e:
        print(e)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
