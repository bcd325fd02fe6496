"""Training-corpus pipeline: documents in, token ids out. Each stage is one operator of the library at work.

Every stage works on all that the one before kept; each is written as Parquet in the shared folder and read again.
All stages but the last return the columns of ``documents`` (and any others that the input has).

Edge cases: null and empty texts have too few words and go with the first stage; an empty table gives no rows at every stage; of
copies of equal rank the row of the smallest id stays, then of the smallest key, and ids that are null come last; repeated rows are
copies of each other; a text is masked and encoded whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galerna.llm import bpe, copies, decontaminate, pii, quality
from galerna.llm.common import drop_table, materialize, scratch, ship, spread_join, table

#: The last stage's ids cannot be expressed in SQL.
ORACLE_SQL = None
#: Key of a row, which all stages but the last carry: ids may repeat or be null.
ROW = "__row"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row, written so that it stays the same when the rows are read again.

    The name ``ROW`` is the pipeline's own: a table that has it already comes from an earlier stage, whose keys are one a row.
    """
    return docs if ROW in docs.columns else materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return docs.filter(quality.Cascade.fit(docs).verdict().isNull())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash of 5-word shingles, Jaccard similarity 0.8 or more) the smallest id stays.

    Rows that repeat an id, or have none, count as copies if their groups are the same.
    """
    rows = keyed(docs)
    classes = copies.near_copies(rows, ROW)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    known = rows.select(F.col(ROW).alias("key"), "doc_id").join(classes, "key")
    heads = known.groupBy("component").agg(F.min(rank)["key"].alias("head"))
    gone = spread_join(known, heads, "component", "key").filter("key <> head").select(F.col("key").alias(ROW))
    # only keys are shuffled where Spark finds the removed ones few enough to send; it checks their size
    return rows.join(materialize(gone, "gone"), ROW, "left_anti").select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go."""
    rows = keyed(docs)
    found = decontaminate.contaminated(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = materialize(found.select(F.col("doc_id").alias(ROW)).distinct(), "gone")
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; n_chars is that of the new text."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text back."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.round_trip(docs.select(*kept, "text"), path, pattern).select(
        *kept, F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("byte-level BPE", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table, and all that a stage wrote on its way, goes when the next one is written."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").withColumn(ROW, F.monotonically_increasing_id())  # written with the first stage
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        docs = scratch(spark, f"stage-{k + 1}", lambda s=stage, d=before: s(spark, d, sf_dir))
        drop_table(before)
    return docs
