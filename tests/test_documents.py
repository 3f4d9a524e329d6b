"""Chunks, HTML pages and per-file ingestion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import chunk, chunker
from lexloom.sources import html, ingest

SMALL = chunker.Sizes(50, 70, 10, 15)


@pytest.mark.parametrize(
    ("line", "want"),
    [("## Scope ", "Scope"), ("#### Deep", None), ("Section 3 Terms", "Section 3 Terms"), ("section 3 ends.", None), ("SECTION IV", "SECTION IV"), ("1.2 General Rules", "1.2 General Rules"), ("1.2 Memory: 16 GB", None), ("DELIVERY TERMS", "DELIVERY TERMS"), ("DELIVERY TERMS,", None), ("PURPOSE OF THIS BID The buyer wants", "PURPOSE OF THIS BID"), ("NTSC, FHD IPS Screen", None), ("KEY   VALUE", None), ("An ordinary sentence.", None)],
)
def test_headings_are_the_same_in_rows_and_columns(spark, line, want):
    assert chunker.heading_of(line.strip()) == want
    assert spark.createDataFrame([(line,)], "t string").select(chunk.heading(F.col("t"))).first()[0] == want


def test_known_headings(spark):
    assert chunker.heading_of("plain words", {"plain words"}) == "plain words"
    assert spark.range(1).select(chunk.heading(F.lit("plain words"), F.array(F.lit("plain words")))).first()[0] == "plain words"


def test_chunks_hold_every_token_in_order():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lines = []
        for _ in range(int(rng.integers(1, 30))):
            n = int(rng.integers(0, 120))
            lines.append(" ".join(f"w{rng.integers(999)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n)).capitalize() if rng.random() < 0.8 else "BIG WORDS HERE")
        text = "\n".join(lines)
        pages = [{"page": 1, "text": text, "headings": [], "tables": []}]
        plain = chunker.cut(pages, chunker.Sizes(50, 70, 10, 0))
        tokens = lambda t: chunker._TOKEN.findall(t)
        assert [x for c in plain for x in tokens(c[3])] == tokens(text)
        assert all(c[4] <= 50 for c in plain)
        lapped = chunker.cut(pages, SMALL)
        assert all(c[4] <= 50 + 15 for c in lapped)
        sections = [c[1] for c in lapped]
        assert set(sections) <= {None, "BIG WORDS HERE"}


def test_overlap_sections_and_tables():
    sentence = "Alpha beta gamma delta epsilon."
    one = chunker.cut([{"page": 1, "text": " ".join([sentence] * 12), "headings": [], "tables": []}], SMALL)
    assert len(one) == 2 and one[1][3].startswith(f"{sentence} {sentence}")
    text = "TERMS AND RULES\n" + "x " * 20 + "\n\nDELIVERY OF GOODS\n" + "y " * 20
    two = chunker.cut([{"page": 1, "text": text, "headings": [], "tables": []}, {"page": 2, "text": "goes on", "headings": [], "tables": ["| a |\n|---|\n" + "\n".join(f"| {i} |" for i in range(60))]}], SMALL)
    assert [c[1] for c in two][:3] == ["TERMS AND RULES", "DELIVERY OF GOODS", "DELIVERY OF GOODS"]
    pieces = [c for c in two if c[2]]
    assert len(pieces) > 1 and all(c[3].startswith("| a |\n|---|\n") and c[4] <= 70 for c in pieces)
    assert [r for c in pieces for r in c[3].split("\n")[2:]] == [f"| {i} |" for i in range(60)]
    assert chunker.split_long("a" * 10, 3) == [chunker.Piece("a" * 10, 1)]
    assert [p.n for p in chunker.split_long("- " * 10, 4)] == [4, 4, 2]


def test_chunk_documents(spark):
    pages = [(1, "# Scope\n\nwords of it", ["Scope"], None), (2, "", [], []), (3, "end", None, ["| a |\n|---|\n| b |"])]
    df = spark.createDataFrame([("bid", "my_file.v2.pdf", "addendum", 3, pages), ("bid", "empty.pdf", None, None, None)], f"collection string, file_name string, doc_type string, addendum_number int, pages array<{chunker.PAGE}>")
    got = chunker.chunk_documents(df).orderBy("chunk_index").collect()
    assert [(r["page"], r["chunk_index"], r["section"], r["is_table"]) for r in got] == [(1, 0, "Scope", False), (3, 1, "Scope", False), (3, 2, "Scope", True)]
    assert got[0]["header"] == "[Bid: bid | Doc: my file.v2 (addendum #3) | Page 1 | Section: Scope]"
    import uuid

    assert got[2]["chunk_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "bid/my_file.v2.pdf/3/2"))
    assert chunker.statistics(chunker.chunk_documents(df)).first()["tables"] == 1


PORTAL = """<html><head><title>Laptops | Portal</title></head><body><nav>menu</nav><h2 class="content-block-sub-title">Dates</h2>
<div class="mets-field"><div class="mets-field"><span class="mets-field-label">Due:</span><div class="mets-field-body">May 1 See more</div></div></div>
<div class="mets-field"><div class="mets-field-body">loose one</div></div><div class="mets-field"><div class="mets-field-body">loose two</div></div>
<div class="mets-field"><span class="mets-field-label">Items</span><div class="mets-field-body">List: 1. Alpha 2. Beta</div></div>
<table><tr><th>Buyer:</th><td>Ann</td></tr><tr><td>a</td><td></td><td>b</td><td>c</td></tr></table><dl><dt>Phone</dt><dd>5</dd></dl></body></html>"""


def test_portal_pages():
    page = html.read_page(PORTAL)
    assert page["text"] == "# Laptops\n\n## Dates\nDue: May 1 [truncated on portal page]\nDates: loose one | loose two\nItems: List:\n1. Alpha\n2. Beta\nBuyer: Ann\na | b | c\nPhone: 5"
    assert page["headings"] == ["Laptops", "Dates"] and not page["is_empty"]
    plain = html.read_page('<title>T - Bid Information x</title><body><p>one<p>two</p><div class="my-cookie-box">no</div><script>x</script>')
    assert plain["text"] == "# T\n\none\ntwo"
    assert html.read_page("")["is_empty"]


def test_files_fail_one_by_one(spark, tmp_path):
    folder = tmp_path / "bid7"
    folder.mkdir()
    (folder / "page.html").write_text(PORTAL)
    (folder / "addendum no 2.pdf").write_bytes(b"broken")
    (folder / "ok.pdf").write_bytes(b"ok")
    (folder / "notes.txt").write_text("x")
    (folder / ".hidden").write_text("x")

    def pdf(content):
        if content == b"broken":
            raise ValueError("no PDF")
        return [{"page": 1, "text": "Request for Proposals\nIssued May 3, 2024", "headings": ["RFP"], "tables": [], "is_empty": False}, {"page": 2, "text": "", "headings": [], "tables": [], "is_empty": True}], []

    docs, report = ingest.ingest(spark, str(tmp_path), {"pdf": pdf})
    states = {r["file_name"]: (r["status"], r["pages"], r["empty"], list(r["errors"])) for r in report.collect()}
    assert states == {"page.html": ("ok", 1, 0, []), "addendum no 2.pdf": ("failed", 0, 0, ["ValueError: no PDF"]), "ok.pdf": ("partial", 2, 1, []), "notes.txt": ("skipped", 0, 0, [])}
    ingest.save(docs, report, str(tmp_path / "out"))
    back = {r["file_name"]: r for r in ingest.load(spark, str(tmp_path / "out")).collect()}
    assert set(back) == {"page.html", "ok.pdf"} and back["ok.pdf"]["doc_type"] == "rfp" and str(back["ok.pdf"]["doc_date"]) == "2024-05-03"
    assert back["page.html"]["doc_type"] == "bid_page" and back["page.html"]["title"] == "Laptops"
