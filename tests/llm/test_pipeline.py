import os

import corpus_pipeline as C
from galerna.llm import common
from galerna.llm.common import drop_table


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_keep_the_columns_and_take_effect(spark):
    prose = " ".join(f"word{k}" for k in range(80))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").head()
    other = " ".join(f"other{k}" for k in range(80))
    docs = frame(spark, [
        (1, prose, "en", "s", 1), (2, prose, "en", "s", 1), (2, prose, "en", "s", 1), (3, "too short", "en", "s", 1), (4, f"{other} {bench.text}", "en", "s", 1),
        (5, other.replace("other", "third") + " mail me@example.org", "en", "s", 1), (6, None, None, None, None), (7, other.replace("other", "fourth"), "en", "s", 1),
        (7, other.replace("other", "fourth"), "en", "s", 1),
    ])
    sf, kept = "/root/testdata/sf0.001", []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept[0] == [1, 2, 2, 4, 5, 7, 7] and kept[1] == [1, 4, 5, 7] and kept[2] == kept[3] == [1, 5, 7]
    masked = {r.doc_id: r for r in docs.collect()}[5]
    assert masked.text.endswith("mail [EMAIL]") and masked.n_chars == len(masked.text)
    last = C.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == 3 and all(r.exact and r.n_tokens == len(r.ids) for r in last)


def test_empty_documents(spark):
    docs = frame(spark, [])
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() == 0


def test_only_the_output_is_left_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    n = C.run(spark, "/root/testdata/sf0.001").count()
    left = os.listdir(tmp_path / "shared" / "galerna")
    assert n > 50 and len(left) == 1 and left[0].startswith("stage-5")


def test_an_input_is_never_dropped(spark, tmp_path):
    at = str(tmp_path / "galerna" / "documents.parquet")
    spark.range(3).write.parquet(at)
    drop_table(spark.read.parquet(at))
    assert spark.read.parquet(at).count() == 3
