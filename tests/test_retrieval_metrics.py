"""The figures of the search itself, on a case where a prefix match would miss."""

import math

from lexloom.operators import search
from lexloom.plans import catalog


def test_retrieval_is_measured_by_whole_items(spark, tmp_path):
    opening = "an opening that many texts share "
    docs = [(i, f"{opening} filler{i} words{i}") for i in range(12)] + [(50, f"{opening}zebra quartz"), (51, "another opening, then zebra")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, f"{opening}zebra quartz"), (2, "no document has it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert catalog.queries()["retrieval_metrics_bm25"](spark, str(tmp_path)).collect() == [(1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert catalog.queries()["quality_gate_bm25"](spark, str(tmp_path)).collect() == [(True,)]
    missed = search.first_hits(spark.createDataFrame([(1, 7), (2, 8)], "q long, d long"), spark.createDataFrame([(1, 7, 2)], "q long, d long, rank int"), "q", "d")
    assert search.metrics(missed).collect() == [(2, 0.0, 0.5, 0.5, 0.5, 0.25, round(0.5 / math.log2(3), 6))]
