import corpus_pipeline as C


def test_null_and_clashing_ids(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(80))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").head().text
    rows = [
        (1, text("a")), (1, text("b")), (1, text("c")), (2, text("c")), (None, text("d")), (None, text("d")), (3, text("e")), (None, text("e")),
        (4, text("f")), (4, f"{text('g')} {bench}"), (None, f"{text('h')} {bench}"),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    clean = C.benchmark_passages(spark, docs, "/root/testdata/sf0.001")
    assert clean.columns == docs.columns
    seen = lambda df: sorted((str(r.doc_id), r.text[0]) for r in df.collect())
    assert seen(kept) == sorted([("1", "a"), ("1", "b"), ("1", "c"), ("None", "d"), ("3", "e"), ("4", "f"), ("4", "g"), ("None", "h")])
    assert seen(clean) == sorted((str(d), t[0]) for d, t in rows if t[0] not in "gh")


def test_the_key_of_rows_does_not_leave_the_pipeline(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text), (None, text), (1, text.replace("word", "other"))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = C.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]
    assert [r.doc_id for r in out.collect()] == [1, 1]
