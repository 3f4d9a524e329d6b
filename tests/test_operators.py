import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from lexloom.operators import chunk, search, text
from lexloom.sources import html


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_line_key_folds_numbers_and_blanks(spark):
    assert one(spark, "  Page 12  of 340 ", text.line_key(F.col("t")))[0] == "page # of #"


def test_boilerplate_needs_half_of_the_pages(spark):
    pages = spark.createDataFrame([("a", i, f"Head {i}\nown words {'xyz'[i]}\nfoot") for i in range(3)], "g string, p int, text string")
    keys = {r["key"] for r in text.boilerplate(pages, "g", "p").collect()}
    assert keys == {"head #", "foot"}
    left = text.drop_lines(pages, "g", "p", text.boilerplate(pages, "g", "p")).orderBy("p").collect()
    assert [r["text"] for r in left] == ["own words x", "own words y", "own words z"]


def test_clean_joins_wrapped_lines_but_not_rows_or_items(spark):
    t = "A line that\ngoes on.\nNext one\nFOO   bar\nbaz   qux\na) item"
    assert one(spark, t, text.clean(F.col("t"), normalise=False))[0] == "A line that goes on.\nNext one\nFOO   bar\nbaz   qux\na) item"


def test_dates_and_times(spark):
    r = one(spark, "05/12/2024 or 29/05/2024, May 3, 2024, 26-MAY-2024 at 2:30 PM and 14:05; 13/13/2024", text.dates(F.col("t")), text.times(F.col("t")))
    assert set(r[0]) == {datetime.date(2024, 5, 12), datetime.date(2024, 5, 29), datetime.date(2024, 5, 3), datetime.date(2024, 5, 26)}
    assert set(r[1]) == {870, 845}


def test_grounding_accepts_other_formats_and_rejects_inventions(spark):
    df = spark.createDataFrame([("May 20, 2024 at 2:30 PM", "due 05/20/2024 14:30"), ("a@x.org, 17 units", "b@x.org, 18 units")], "v string, e string")
    got = [r[0] for r in df.select(text.grounding_problems(F.col("v"), F.col("e"))).collect()]
    assert got == [[], ["email a@x.org", "number 17"]]


def test_uuid5_equals_the_standard_one(spark):
    assert one(spark, "bid/file/1/0", chunk.uuid5(F.col("t")))[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "bid/file/1/0"))


def test_pack_is_greedy(spark):
    assert spark.range(1).select(chunk.pack(F.array(*[F.lit(x) for x in (30, 30, 30, 50, 10)]), 60)).first()[0] == [0, 0, 1, 2, 2]


@pytest.mark.parametrize(("line", "want"), [("# Scope", "Scope"), ("SECTION 3 Terms", "SECTION 3 Terms"), ("1.2 General Rules", "1.2 General Rules"), ("DELIVERY TERMS", "DELIVERY TERMS"), ("An ordinary sentence.", None), ("KEY   VALUE", None)])
def test_headings(spark, line, want):
    assert one(spark, line, chunk.heading(F.col("t")))[0] == want


def test_fusion_orders_and_weights(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "c", 1), (1, "a", 2)], "q int, d string, rank int")
    order = lambda w: [r["d"] for r in search.fuse([a, b], "q", "d", w).orderBy("rank").collect()]
    assert order([1.0, 1.0]) == ["a", "c", "b"]
    assert order([1.0, 3.0])[0] == "c"


def test_search_rejects_an_unknown_mode(spark):
    with pytest.raises(ValueError):
        search.search(None, None, "q", "d", mode="best")


def test_predicate_ignores_none(spark):
    df = spark.range(5)
    assert df.where(search.predicate(id=None)).count() == 5
    assert df.where(search.predicate(id=[1, 2])).count() == 2


def test_expansions_and_identifiers(spark):
    r = one(spark, "the model AB-1234 of", search.expansions(F.col("t"), [["the", "le"], ["und", "et"]]), search.identifiers(F.col("t")))
    assert r[0] == ["le"]
    assert r[1] == ["AB-1234"]


def test_html_fields():
    page = "<h1>Bid</h1><table><tr><th>Due</th><td>May 1</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table><dl><dt>Buyer:</dt><dd>Ann</dd></dl><nav>x</nav>"
    assert html.parse(page) == [("heading", "", "Bid"), ("field", "Due", "May 1"), ("row", "", "a | b | c"), ("field", "Buyer", "Ann")]
