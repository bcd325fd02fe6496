"""Merkle fixity audit of replicated WARC files.

A record's leaf is the SHA-256 of its bytes. Records are laid out in files by offset; a file's tree has a node for
each range of ``RANGE_BYTES`` bytes of offsets, and above it nodes for ``FANOUT`` ranges each, up to the root: a node's
hash is that of its children's names and hashes in order. Roots of two replicas are compared first; a level further
down only nodes whose parents differ are looked at, so that the audit reads little where replicas agree.

A record belongs to the range in which it starts, and offsets come from the replica's index: damaged bytes change a
leaf, a lost or an added record changes its range alone. Edge cases: a null payload has the hash of no bytes, and
differs from a lost record; an offset used twice in a file is a range with both records, ordered by their hashes;
empty replicas have no roots, and against them all records are missing; repeated records have places of their own; very
long records are hashed like any other; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galerna.llm.common import drop_table, materialize

RANGE_BYTES = 64 << 10
FANOUT = 16
LEVELS = 3
FILE_BYTES = 1 << 22


def response_record(url: Column, payload: Column) -> Column:
    """A WARC response record as bytes: header, blank line, payload, two line ends."""
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def lay_out(records: DataFrame, key: str, n_files: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, file, offset, length, leaf, carried) of rows with a key and a record (binary): replace records by their
    hashes and give them places.

    Rows are dealt to files one by one, so that files have like sizes whatever keys repeat or lack; ``n_files`` follows
    the corpus (total bytes / FILE_BYTES), which bounds what one window sorts. Records themselves are not shuffled.
    The places depend on the order in which rows are read: write the result before it is used twice.
    """
    rows = records.select(
        key, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_files)).alias("file"),
        F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("length"), leaf(F.col("record")).alias("leaf"), *carried,
    )
    before = Window.partitionBy("file").orderBy(key, "leaf").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def leaf(record: Column) -> Column:
    return F.sha2(F.coalesce(record, F.lit("").cast("binary")), 256)


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, leaf) of rows with file, offset and record: the audit's view of a replica."""
    return records.select("file", "offset", leaf(F.col("record")).alias("leaf"))


def _digest(name: str, value: str) -> Column:
    """The hash of a node: names and hashes of its children, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("h"))))
    return F.sha2(F.concat_ws("\n", F.transform(pairs, lambda p: F.concat_ws(":", p["n"].cast("string"), p["h"]))), 256)


def tree(own: DataFrame, levels: int = LEVELS, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """(file, node, hash) for each level: ranges first, the root (node 0) last. Each is written, and the next made of it."""
    level = materialize(
        own.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("long"))
        .groupBy("file", "node").agg(_digest("offset", "leaf").alias("hash")),
        "tree",
    )
    out = [level]
    for k in range(1, levels + 1):
        up = F.lit(0).cast("long") if k == levels else F.floor(F.col("node") / fanout).cast("long")
        level = materialize(
            level.select("file", up.alias("parent"), F.col("node").alias("child"), "hash")
            .groupBy("file", F.col("parent").alias("node")).agg(_digest("child", "hash").alias("hash")),
            "tree",
        )
        out.append(level)
    return out


def audit(first: DataFrame, second: DataFrame, levels: int = LEVELS, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, status) of each place where two sets of leaves (file, offset, leaf) differ.

    status: ``changed``, ``missing`` (only in ``first``) or ``added`` (only in ``second``). The differing nodes of each
    level are written before the next one is looked at, so that a level's plan holds no other, and only children of
    differing nodes are compared.
    """
    a, b = (tree(side, levels, range_bytes, fanout) for side in (first, second))

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.withColumnRenamed("hash", "other")
        return x.join(y, ["file", "node"], "full").filter(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")

    wrong = materialize(differing(a[-1], b[-1]), "wrong")
    for k in range(levels - 1, -1, -1):
        parent = F.lit(0).cast("long") if k + 1 == levels else F.floor(F.col("node") / fanout).cast("long")
        above = wrong.withColumnRenamed("node", "parent")
        x, y = (t[k].withColumn("parent", parent).join(above, ["file", "parent"], "left_semi").drop("parent") for t in (a, b))
        below = materialize(differing(x, y), "wrong")
        drop_table(wrong)
        wrong = below
    for t in (*a, *b):
        drop_table(t)

    def of(t: DataFrame, side: str) -> DataFrame:
        inside = t.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("long")).join(wrong, ["file", "node"], "left_semi")
        return inside.groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_list("leaf")), ",").alias(side))

    both = of(first, "a").join(of(second, "b"), ["file", "offset"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise("changed")
    return both.select("file", "offset", status.alias("status"))
