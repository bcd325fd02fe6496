"""The queries of this subpackage: thin, over whole tables, with the columns that their contracts name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galerna.llm import align, audit, bpe, decontaminate, langid, licenses, lm, oracles, pii, quality, simhash, toxicity, urls, warc
from galerna.llm.common import drop_table, held_out, materialize, ship, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lm.score(documents, ~held_out(F.col("doc_id"), 7, 2), lm.split_block(documents)).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    model = langid.Model.fit(documents.filter(~held).select("text", "lang", F.xxhash64("doc_id", "text").alias("row")))
    return langid.identify(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of the pages' records in which some are damaged and some lost: the status of every record.

    A page is a record of its own, also where its page_id repeats another's or is null.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    size = pages.agg(F.sum(F.octet_length("html"))).head()[0] or 0
    damage = F.when(F.col("page_id") % 97 == 13, F.lit("\x00").cast("binary")).otherwise(F.lit("").cast("binary"))
    good = pages.select("page_id", warc.response_record(F.col("url"), F.col("html")).alias("record")).withColumns({
        "replica": warc.leaf(F.concat("record", damage)), "lost": F.coalesce(F.col("page_id") % 101 == 7, F.lit(False))
    })
    placed = materialize(warc.lay_out(good, "page_id", max(1, -(-size // warc.FILE_BYTES)), ("replica", "lost")), "records")
    replica = placed.filter("not lost").select("file", "offset", F.col("replica").alias("leaf"))
    found = warc.audit(placed.select("file", "offset", "leaf"), replica)
    return placed.join(found, ["file", "offset"], "left").select(
        "page_id", "length", F.col("leaf").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))

    def joined(some):
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii.detect(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


#: The rules.
RULES = [
    urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"),
]
#: A page shouts if its source holds this; a host is listed if half of its pages or more do.
SHOUT = "!!"


def shouting_hosts(pages: DataFrame) -> DataFrame:
    """(key): the listed hosts."""
    hosts = pages.select(urls.host_of(F.col("url")).alias("key"), F.coalesce(F.contains("html", F.lit(SHOUT)), F.lit(False)).alias("shouts"))
    return hosts.groupBy("key").agg(F.count_if("shouts").alias("n"), F.count("*").alias("of")).filter("2 * n >= of").select("key")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = materialize(shouting_hosts(pages), "listed")
    judged = urls.judge(pages.select("page_id", "url"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")
    drop_table(listed)  # the cascade is built
    return judged


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.Cascade.fit(documents).apply(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.base_failed().alias("base_failed"), "kept", "rejected_by",
    ).drop("rejected_by")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

    def digest(groups):
        return F.when(groups == "", "").otherwise(F.sha2(groups, 256))

    return align.statistics(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN, digest).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_best_b"
    )


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 5, 0)
    return toxicity.score(table(spark, sf_dir, "documents"), ~held, table(spark, sf_dir, "labels")).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def queries() -> dict:
    def shipped(q):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return q(spark, sf_dir)

        return run

    return {q.__name__: shipped(q) for q in (
        op1_bpe, op2_licenses, op3_lm, op4_langid, op5_simhash, op6_warc, op7_pii, op8_urls, op9_quality, op10_decontaminate,
        op11_alignment, op12_audit, op13_toxicity,
    )}


def oracle_sql() -> dict[str, str]:
    """Other operators' results (learned scores, hashes and alignments that SQL lacks) are tested by brute force."""
    return {"op2_licenses": oracles.op2(), "op6_warc": oracles.op6(), "op8_urls": oracles.op8(RULES, SHOUT), "op9_quality": oracles.op9(), "op12_audit": oracles.op12()}
