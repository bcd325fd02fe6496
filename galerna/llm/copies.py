"""Near copies by SimHash: texts whose word shingles have a Jaccard similarity of 0.8 or more.

The fingerprint of ``simhash`` is taken over the distinct five-word shingles of a text. Two texts of similarity 0.8
differ in some 10 of 64 bits (15 % each), so the radius is 20: a pair at the threshold exceeds it once in 10,000 cases,
a closer pair hardly ever. Nearly every bucket of so wide a radius would hold all texts; the tiles are therefore cut out of
blocks of texts that can reach the similarity at all: two sets share one of the first n - ceil(0.8 n) + 1 shingles of
either, in any order common to all. Shingles that many texts hold come last, which keeps blocks small: at first those that a bounded
sample finds often, then, in rounds, those whose blocks over the whole corpus are larger than a tile, ordered by their counts. A
text without such a shingle in its prefix keeps it, for what moves to the end was not in it; the others' prefixes are cut anew.

First round: within each block numpy's exclusive-or and bit counts find the pairs within the radius, tile pairs and rows
whose population counts differ beyond it are skipped, and sizes and places of the shared shingle rule out more; a spanning
forest of each block gives families, the components of what may be linked. Second round: in each family tiles are compared
again, with the sets themselves, and a pair within the radius is a link where the similarity of the sets reaches 0.8, in
whole numbers. A spanning forest of the links leaves the task, so that a large group of copies never becomes all its
pairs. Texts of equal sets are one node. Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galerna.llm.common import drop_table, materialize, spread_join
from galerna.llm.components import connected
from galerna.llm.simhash import majority
from galerna.llm.tiles import bounds, deal, row_forest, whole_units

SHINGLE_WORDS = 5
#: Least similarity, as a fraction of whole numbers: comparisons are exact.
SIMILARITY = (4, 5)
RADIUS = 20
#: Texts of fewer shingles are compared whatever their fingerprints.
FEW = 8
SEED = 42
#: Texts (in expectation) whose shingles are counted to find the common ones; this changes the order of shingles only.
SAMPLE_ROWS = 4000
#: Shingles moved to the end of the order at most, and rounds of moving; what stays large is cut into tiles.
MOVED, ROUNDS = 1 << 20, 3
#: Texts of a tile of the first round, shingles of a tile of the second one.
TILE_TEXTS = 1024
TILE_SHINGLES = 1 << 20


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, one without words has none."""
    # methods of bytes lower-case A-Z alone and split at ASCII white space alone
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(size)))], np.uint64))


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three texts or more of a sample hold, sorted, and how many hold each."""
    share = min(1.0, SAMPLE_ROWS / max(texts.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(t, size) for t in batch.slice(at, 256).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["gram"])

    sample = texts.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).select("text")
    rows = sample.mapInArrow(run, "gram long").groupBy("gram").count().filter("count >= 3").toPandas()
    gram, count = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(gram)
    return gram[order], count[order]


def _ordered(grams: np.ndarray, last: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Shingles in the common order: those of ``last`` (sorted) come last, by how many texts hold them."""
    if not len(last) or not len(grams):
        return grams
    place = np.minimum(np.searchsorted(last, grams), len(last) - 1)
    return grams[np.argsort(np.where(last[place] == grams, often[place], 0), kind="stable")]


def _prefix(grams: np.ndarray) -> np.ndarray:
    p, q = SIMILARITY
    return grams[: len(grams) - -(-p * len(grams) // q) + 1].view(np.int64)


def _prefixes(texts: DataFrame, size: int, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, digest, n, fp, prefix): digest stands for the set, n is its size."""
    sent = texts.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                digests, sizes, fps, prefixes = [], [], [], []
                for t in piece.column(1).to_pylist():
                    grams = shingles(t, size)
                    digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    sizes.append(len(grams))
                    fps.append(majority(grams))
                    prefixes.append(_prefix(_ordered(grams, *sent.value)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)),
                     pa.array(prefixes, pa.list_(pa.int64()))],
                    ["key", "digest", "n", "fp", "prefix"],
                )

    return texts.mapInArrow(run, "key long, digest binary, n int, fp long, prefix array<long>")


def _met(nodes: DataFrame) -> DataFrame:
    """(block, count): shingles of the prefixes that several nodes hold, written."""
    return materialize(nodes.select(F.explode("prefix").alias("block")).groupBy("block").count().filter("count > 1"), "shared")


def _balanced(nodes: DataFrame, texts: DataFrame, size: int, last: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with prefixes whose shingles are as rare as the corpus allows, and their blocks (see ``_met``)."""
    order = dict(zip(last[0].tolist(), last[1].tolist()))
    several = _met(nodes)
    for _ in range(ROUNDS):
        hot = several.filter(F.col("count") > TILE_TEXTS).orderBy(F.desc("count"), "block").limit(MOVED).toPandas()
        counts = hot["count"].to_numpy(np.int64)
        grams = hot["block"].to_numpy(np.int64).view(np.uint64)
        fresh = np.array([g not in order or order[g] < c for g, c in zip(grams.tolist(), counts.tolist())], bool)
        if not fresh.any():
            break
        order.update(zip(grams[fresh].tolist(), counts[fresh].tolist()))
        keys = np.array(sorted(order), np.uint64)
        sent = texts.sparkSession.sparkContext.broadcast((keys, np.array([order[k] for k in keys.tolist()], np.int64)))
        moved = texts.sparkSession.createDataFrame(hot[fresh][["block"]], "block long")
        changed = nodes.select("key", F.explode("prefix").alias("block")).join(moved, "block", "left_semi").select("key").distinct()
        changed = materialize(changed, "changed")

        def cut(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    piece = batch.slice(at, 512)
                    own = [_prefix(_ordered(shingles(t, size), *sent.value)) for t in piece.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(own, pa.list_(pa.int64()))], ["key", "new"])

        new = texts.join(changed, "key", "left_semi").mapInArrow(cut, "key long, new array<long>")
        better = materialize(nodes.join(new, "key", "left").withColumn("prefix", F.coalesce("new", "prefix")).drop("new"), "distinct")
        for done in (nodes, several, changed):
            drop_table(done)
        nodes, several = better, _met(better)
    return nodes, several


def _families(nodes: DataFrame, several: DataFrame) -> DataFrame:
    """(node, component): components of the pairs that sizes, places and fingerprints leave. ``nodes``: key, n, fp, prefix."""
    p, q = SIMILARITY
    grams = nodes.select(F.col("key").alias("node"), "n", "fp", F.posexplode("prefix").alias("at", "block"))
    met = materialize(grams.join(several.select("block"), "block"), "met")
    large = several.filter(F.col("count") > TILE_TEXTS).select("block", F.ceil(F.col("count") / TILE_TEXTS).cast("int").alias("salts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            node, n, at, side, two = (table.column(c).to_numpy() for c in ("node", "n", "at", "side", "two"))
            n, at, fp = n.astype(np.int64), at.astype(np.int64), table.column("fp").to_numpy().view(np.uint64)

            def may(i, j) -> np.ndarray:
                least = np.minimum(n[i], n[j])
                most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
                return (q * least >= p * np.maximum(n[i], n[j])) & ((p + q) * most >= p * (n[i] + n[j]))

            starts, ends = bounds(table.column("unit").to_numpy())
            pairs = starts[ends - starts == 2]
            near = (np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= RADIUS) | (np.minimum(n[pairs], n[pairs + 1]) < FEW)
            pairs = pairs[near & may(pairs, pairs + 1)]
            u, v = [pairs], [pairs + 1]
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                split = int(np.count_nonzero(side[s:e] == 0)) if two[s:e].all() else None
                radius = RADIUS if n[s:e].min() >= FEW else 64
                found = np.array(row_forest(fp[s:e], split, radius, lambda i, c, s=s: may(s + i, s + c)), np.int64).reshape(-1, 2) + s
                u.append(found[:, 0])
                v.append(found[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(x)]) for x in (u, v)], ["u", "v"])

    edges = deal(met.select("node", "n", "fp", "at", "block"), large, RADIUS, "node").mapInArrow(run, "u long, v long")
    found = materialize(connected(edges), "families")
    drop_table(several)
    drop_table(met)
    return found


def _links(members: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of the links in each family. ``members``: node, n, fp, grams, block (the family)."""
    p, q = SIMILARITY
    large = (
        # 512 for each text besides, so that a tile of short texts has no more than two thousand
        members.groupBy("block").agg(F.sum(F.col("n") + 512).alias("size")).filter(F.col("size") > TILE_SHINGLES)
        .select("block", F.ceil(F.col("size") / TILE_SHINGLES).cast("int").alias("salts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            node, side, two = (table.column(c).to_numpy() for c in ("node", "side", "two"))
            n, fp = table.column("n").to_numpy().astype(np.int64), table.column("fp").to_numpy().view(np.uint64)
            grams = table.column("grams").combine_chunks()
            at, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)

            def alike(i: int, columns: np.ndarray) -> np.ndarray:
                """Whether the sets of row i and of each of the columns reach the similarity."""
                out = q * np.minimum(n[i], n[columns]) >= p * np.maximum(n[i], n[columns])
                own = flat[at[i] : at[i + 1]]
                for k in np.flatnonzero(out):
                    c = int(columns[k])
                    if not len(own):
                        continue  # no words: alike
                    other = flat[at[c] : at[c + 1]]
                    shared = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                    out[k] = q * shared >= p * (n[i] + n[c] - shared)
                return out

            found = []
            for s, e in zip(*(x.tolist() for x in bounds(table.column("unit").to_numpy()))):
                split = int(np.count_nonzero(side[s:e] == 0)) if two[s:e].all() else None
                radius = RADIUS if n[s:e].min() >= FEW else 64
                found += [(s + i, s + c) for i, c in row_forest(fp[s:e], split, radius, lambda i, c, s=s: alike(s + i, s + c))]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, k]]) for k in (0, 1)], ["u", "v"])

    return deal(members, large, RADIUS, "node").mapInArrow(run, "u long, v long")


def near_copies(df: DataFrame, key: str, text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(key, component), a row for each row of ``df``, whose ``key`` is a long, unique and written to a table.

    component: the smallest key of a text that is reachable by links, the row's own included. A link joins two texts
    whose sets of ``size``-word shingles reach the similarity and whose fingerprints are within the radius (or have
    fewer than ``FEW`` shingles). Texts without words, null or empty, are copies of each other; repeated rows too. A very
    long text is one set like any other. An empty table gives no rows; other columns are not looked at.
    """
    texts = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    last = _common(texts, size)
    rows = materialize(_prefixes(texts, size, last), "prefixes")
    least = rows.groupBy("digest").agg(F.min("key").alias("node"))
    by_digest = materialize(spread_join(rows.select("key", "digest"), least, "digest", "key").select("key", "node"), "nodes")
    nodes = materialize(rows.join(by_digest.filter("key = node").select("key"), "key", "left_semi").select("key", "n", "fp", "prefix"), "distinct")
    nodes, several = _balanced(nodes, texts, size, last)
    families = _families(nodes, several)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                grams = [shingles(t, size).view(np.int64) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"])

    chosen = texts.join(families.select(F.col("node").alias("key")), "key", "left_semi").mapInArrow(sets, "node long, grams array<long>")
    members = materialize(
        nodes.select(F.col("key").alias("node"), "n", "fp").join(families, "node").withColumnRenamed("component", "block").join(chosen, "node")
        .select("node", "n", "fp", "grams", "block"),
        "members",
    )
    found = connected(_links(members))
    out = by_digest.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    for done in (rows, nodes, families, members):
        drop_table(done)
    return out
