"""SimHash near-duplicates: exact comparison of fingerprints by tiles.

Of two fingerprints of 64 bits within the radius of 3, three of six bands at least are equal, so each distinct
fingerprint goes to twenty blocks, one for each choice of three bands: blocks of about 32 bits stay small whatever the
number of texts. A block of more than ``TILE`` fingerprints is cut into tiles by population count (and by a hash);
two tiles meet only where their counts differ by the radius at most. In a meeting, numpy's exclusive-or and bit counts compare all pairs exactly, and a spanning
forest of the links found leaves the task: components are the same as those of all links, and a group of near copies
never becomes all its pairs. Equal fingerprints are one node. Nothing is dropped or capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galerna.llm.common import drop_table, materialize, spread_join
from galerna.llm.components import connected
from galerna.llm.tiles import bounds, deal, whole_units

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a tile; blocks up to this size are one tile.
TILE = 1024
MAX_TABLES = 100


def fingerprint(words: list[bytes], shingle: int = SHINGLE_WORDS) -> int:
    """A bit is 1 where over half of the hashes of all shingles (repeats included) have it; no words: zero."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)))]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes (uint64) have; none of no hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096].astype("<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""
    name = doc_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # methods of bytes lower-case A-Z alone and split at ASCII white space alone
            fps = [fingerprint((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], [name, "fp"])

    schema = T.StructType([T.StructField(name, df.schema[doc_id].dataType), T.StructField("fp", T.LongType())])
    return df.select(F.col(doc_id).alias(name), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within ``a`` (b is None) or between ``a`` and ``b``; sorted by count.

    Both are cut into strips; strips whose population counts differ by more than the radius are not compared.
    """
    x = a if b is None else np.concatenate([a, b])
    label, near, far, step = np.arange(len(x)), [], [], 512
    count = np.bitwise_count(x).astype(np.int64)
    for i in range(0, len(a), step):
        rows = np.arange(i, min(i + step, len(a)))
        others = range(i, len(a), step) if b is None else range(len(a), len(x), step)
        for j in others:
            columns = np.arange(j, min(j + step, len(a) if b is None else len(x)))
            if count[columns].min() - count[rows].max() > radius or count[rows].min() - count[columns].max() > radius:
                continue
            r, c = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[columns][None, :]) <= radius)
            r, c = rows[r], columns[c]
            while True:  # hook the larger label to the smaller one; an edge that hooks is an edge of the forest
                lr, lc = label[r], label[c]
                apart = lr != lc
                if not apart.any():
                    break
                r, c, lr, lc = r[apart], c[apart], lr[apart], lc[apart]
                low, high = np.minimum(lr, lc), np.maximum(lr, lc)
                order = np.lexsort((low, high))
                first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
                near.append(x[r[first]])
                far.append(x[c[first]])
                label[high[first]] = low[first]
                while True:
                    jumped = label[label]
                    if (jumped == label).all():
                        break
                    label = jumped
    empty = np.array([], x.dtype)
    return (np.concatenate(near), np.concatenate(far)) if near else (empty, empty)


def _tables(radius: int) -> list[int]:
    """Masks such that two values within ``radius`` bits agree on one of them at least.

    Of radius + k bands, k at least are free of differing bits; each choice of k bands is a table. The larger k, the
    wider the masks and the smaller the blocks: k is the radius where that gives a hundred tables at most.
    """
    keep = next((k for k in range(radius, 1, -1) if math.comb(radius + k, k) <= MAX_TABLES), 1)
    edges = [round(64 * k / (radius + keep)) for k in range(radius + keep + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in itertools.combinations(bands, keep)]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): edges between fingerprints (column fp, distinct longs) whose components are those of all links."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _tables(radius)]
    placed = distinct.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)))).alias("block"))
    sizes = placed.groupBy("block").count()
    # most blocks are small: only the large ones need to be known by everyone who deals out fingerprints
    large = sizes.filter(F.col("count") > tile).select("block", F.ceil(F.col("count") / tile).cast("int").alias("salts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            x = table.column("fp").to_numpy().view(np.uint64)
            side, two = table.column("side").to_numpy(), table.column("two").to_numpy()
            starts, ends = bounds(table.column("unit").to_numpy())
            pairs = starts[ends - starts == 2]
            pairs = pairs[np.bitwise_count(x[pairs] ^ x[pairs + 1]) <= radius]
            near, far = [x[pairs]], [x[pairs + 1]]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                cut = s + int(np.count_nonzero(side[s:e] == 0))
                n, f = _forest(x[s:cut], x[cut:e], radius) if two[s:e].all() else _forest(x[s:e], None, radius)
                near.append(n)
                far.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (near, far)], ["a", "b"])

    return deal(placed, large, radius, "fp").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``df``.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id whose fingerprint is reachable by links
    of at most ``radius`` differing bits, the row's own included. Null and empty texts have fingerprint zero and are
    linked like any other; a null doc_id gets the component of its fingerprint; repeated rows each get theirs; an
    empty table gives no rows; very long texts are read whole; other columns of ``df`` are not looked at.
    """
    fps = materialize(fingerprints(df, doc_id, text), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct")
    found = connected(links(distinct.select("fp"), radius).select(F.col("a").alias("u"), F.col("b").alias("v")))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    heads = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(grouped.join(heads, "component").select("fp", "component_id"), "classes")
    drop_table(distinct)
    return spread_join(fps, classes, "fp", doc_id).select(
        doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
