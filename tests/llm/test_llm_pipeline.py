"""The pipeline's stages, one after another, on small tables."""

import numpy as np

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(12)
    common = "the of and to in is that for it as was with be by on".split()
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.45 else f"word{rng.integers(2000)}" for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(14))
    rows = [(i, text(90), "en", "s", 0) for i in range(80)]
    rows += [(200, rows[3][1], "en", "s", 0), (201, f"{text(60)} {item} {text(60)}", "en", "s", 0), (202, "too short", "en", "s", 0), (203, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        gone.append(before - {r["doc_id"] for r in docs.select("doc_id").collect()})
    assert gone[:3] == [{202, 203}, {200}, {201}]
    assert gone[4] == set()
    assert {"doc_id", "shard_id"} <= set(docs.columns)
