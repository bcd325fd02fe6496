"""Filter interaction audit by direct relational replay: every document under every order of the filters.

Each document is reduced to five flags (whether it fails filter A, B, C, D, E), written once as a narrow table. The replay
crosses these rows with all 120 orders, a broadcast table of fixed size, explodes the five steps, compares each with the
first filter of the order that the document fails, and adds up by part, order and step. Partial sums are made before the
only exchange, so that a task sends 600 rows a part at most, however many documents it has read, and no part is hot.

Filters A to D look at the text alone. E asks for the smallest doc_id of equal texts (by their SHA-256): a minimum with
partial sums, sent back to the rows with the rows of a text dealt to many parts, so that a text with very many copies is
never gathered in one task.

Edge cases: a null text is an empty one and fails A; a null source is the part ''. A null doc_id is neither smaller than
another nor known to be larger, so such a row never fails E and makes no other row fail it; rows that repeat the smallest
id of a text all pass E. Repeated rows count each. A document without labels, or whose labels are null, is neither good
nor toxic; of several label rows of an id one suffices. Very long texts are read whole; an empty table gives no rows;
extra columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galerna.llm.common import WORD, drop_table, materialize, spread_join, whole_text

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 50
#: Percent of distinct words at least, of capitals at most.
MIN_DISTINCT, MAX_CAPITALS = 65, 5
SYMBOLS = r"[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """Whether ``text`` fails A, B, C and D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    return {
        "a": sizes["all"] < MIN_WORDS, "b": 100 * sizes["distinct"] < MIN_DISTINCT * sizes["all"],
        "c": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text), "d": F.rlike(text, F.lit(SYMBOLS)),
    }


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def flags(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) for each row of ``documents``; bit k of fails stands for the k-th filter.

    ``documents``: doc_id, text, source; ``labels``: doc_id, quality, toxic.
    """
    text = F.col("text")
    read = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole_text(text).alias("text"))
    fails = failures(text)
    own = sum((F.when(fails[x.lower()], _bit(x)).otherwise(0) for x in FILTERS[:4]), F.lit(0))
    rows = materialize(read.select("doc_id", "part", own.alias("fails"), F.sha2(text, 256).alias("digest")), "flags")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    known = spread_join(rows, least, "digest", "doc_id")
    known = known.withColumn("fails", F.col("fails") + F.when(F.col("doc_id") > F.col("least"), _bit("E")).otherwise(0))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = known.join(marks, "doc_id", "left")
    out = materialize(marked.select("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))), "flagged")
    drop_table(rows)
    return out


def orders(like: DataFrame) -> DataFrame:
    """(filter_order, at: array of the filters' bits in that order): 120 rows."""
    rows = [(o, [_bit(x) for x in o]) for o in ORDERS]
    return like.sparkSession.createDataFrame(rows, "filter_order string, at array<int>")


def replay(flagged: DataFrame) -> DataFrame:
    """Counts by part, filter_order and step, of rows as ``flags`` returns them."""
    fails, at, step, first = F.col("fails"), F.col("at"), F.col("step"), F.col("first")
    failed = [fails.bitwiseAND(at[k]) != 0 for k in range(len(FILTERS))]
    found = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        found = F.when(failed[k], k + 1).otherwise(found)
    steps = (
        flagged.crossJoin(F.broadcast(orders(flagged))).select("*", found.alias("first"))
        .select("part", "filter_order", "fails", "good", "toxic", "first", F.posexplode("at").alias("k", "bit")).withColumn("step", F.col("k") + 1)
    )
    removed, bit = first == step, F.col("bit")
    counted = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(first > step).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if((first < step) & (fails.bitwiseAND(bit) != 0)).alias("redundant"),
        F.count_if(fails == bit).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # 120 rows for each part and filter, whatever the documents
    own = Window.partitionBy("part", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    return counted.withColumn("shapley", F.sum("removed").over(own))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, each of the 120 orders and each of its five steps. shapley is the filter's removed documents
    over all orders, 120 times its Shapley value.
    """
    flagged = flags(documents, labels)
    out = materialize(replay(flagged), "audit")
    drop_table(flagged)
    return out
