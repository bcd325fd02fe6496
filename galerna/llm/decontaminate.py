"""Benchmark decontamination: rare n-gram seeds join training passages to test items, local alignment scores them.

Seeds are all n-grams of the items, of four words, or fewer for short items (``seed_words``): by the pigeonhole
principle a copy with up to a fifth of its words replaced keeps at least one. They are a table, (key, item, place). One pass over the
texts finds the windows whose keys a Bloom filter of the seeds holds, of bounded size however many items there are; Spark joins these
windows with the seeds by key, and a passage is cut around each diagonal that hits of an item share. Smith-Waterman alignment then
scores passage against item.

Seeds are counted over the corpus. A passage is aligned if one of its seeds is rare for its item, or if several agree; one that
has a single common seed is aligned if the words that it shares with the item, each as often as both have it, could reach the least
score at all, which is exact: an alignment scores no more than ``MATCH`` for each shared word.

Edge cases: null and empty texts or items match nothing; items of fewer than four words are one seed; every row of either table
is one of its own, also where its id repeats another's or is null; repeated rows get equal results; very long texts are read
whole; empty tables give no rows; extra columns are not looked at. Windows whose keys collide are told apart by the alignment.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galerna.llm.common import drop_table, map_rows, materialize, spread_join

SEED_WORDS = 4
#: Bits of the filter for each seed, and at most: a filter of 32 MB; with more seeds it passes more windows, never fewer.
BITS_A_SEED, MAX_BITS, PROBES = 24, 1 << 28, 3
#: A seed is rare for its item if it is found in at most so many times the item's median.
RARE_TIMES = 20.0
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score of an alignment, as a share of what the whole item would reach.
MIN_SCORE = 0.5
#: Words whose hashes a task remembers.
WORDS_KEPT = 400_000
_words = re.compile(r"[^\W_]+").findall
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def _hashed(w: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word; ``known`` remembers them."""
    out = []
    for x in w:
        h = known.get(x)
        if h is None:
            h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
            if len(known) < WORDS_KEPT:
                known[x] = h
        out.append(h)
    return np.array(out, np.uint64)


def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each window of n words."""
    key = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for k in range(n):
        key = (key ^ hashes[k : len(hashes) - n + 1 + k]) * _P
        key ^= key >> np.uint64(29)
    return key


def seed_words(n: int) -> int:
    """The words of a seed of an item of ``n`` words: e edits leave a run of (n - e) / (e + 1) words at least."""
    edits = n // 5
    return min(SEED_WORDS, -(-(n - edits) // (edits + 1)))


def _probes(key, bits: int) -> list:
    """Places of a key in the filter, of a numpy array or a column: ``bits`` is a power of two."""
    shifts = [k * 64 // PROBES for k in range(PROBES)]
    if isinstance(key, np.ndarray):
        return [(key >> np.uint64(s) ^ key >> np.uint64(s // 2 + 7)) & np.uint64(bits - 1) for s in shifts]
    return [F.shiftrightunsigned(key, s).bitwiseXOR(F.shiftrightunsigned(key, s // 2 + 7)).bitwiseAND(F.lit(bits - 1)) for s in shifts]


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the keys of ``seeds``, made by Spark word by word: at most MAX_BITS / 64 rows reach the driver."""
    keys = seeds.select("key").distinct()
    bits = 64
    while bits < min(MAX_BITS, BITS_A_SEED * seeds.count()):
        bits *= 2
    places = keys.select(F.explode(F.array(*_probes(F.col("key"), bits))).alias("at"))
    masks = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[masks["word"].to_numpy()] = masks["mask"].to_numpy(np.int64).view(np.uint64)
    return words, bits


def seed_table(items: DataFrame) -> DataFrame:
    """(key, item, place, n): the seeds of ``items`` (item, text), n words long, with the item's length."""
    def make(ids: list, texts: list) -> Iterator[tuple]:
        for i, text in zip(ids, texts):
            w = words(text)
            if w:
                n = seed_words(len(w))
                yield from ((k, i, at, n, len(w)) for at, k in enumerate(_keys(_hashed(w, {}), n).view(np.int64).tolist()))

    return map_rows(items.select("item", "text"), T.StructType.fromDDL("key long, item long, place int, n int, length int"), make)


def _windows(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, doc_id, text, at, key): the texts that hold windows in the filter of the seeds, and these windows."""
    sizes = sorted(r[0] for r in seeds.select("n").distinct().collect())  # SEED_WORDS rows at most
    sent = docs.sparkSession.sparkContext.broadcast(_filter(seeds))
    known: dict[str, int] = {}

    def find(rows: list, doc_ids: list, texts: list) -> Iterator[tuple]:
        held, bits = sent.value
        for r, d, text in zip(rows, doc_ids, texts):
            hashes, at, keys = _hashed(words(text), known), [], []
            for n in sizes:
                own = _keys(hashes, n)
                inside = np.ones(len(own), bool)
                for p in _probes(own, bits):
                    inside &= held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1) == 1
                at.append(np.flatnonzero(inside))
                keys.append(own[inside])
            if any(map(len, at)):
                yield r, d, text, np.concatenate(at).tolist(), np.concatenate(keys).view(np.int64).tolist()

    return map_rows(docs, T.StructType([
        T.StructField("row", T.LongType()), docs.schema["doc_id"], *T.StructType.fromDDL("text string, at array<int>, key array<long>").fields
    ]), find)


def _cut(docs: DataFrame) -> DataFrame:
    """(row, doc_id, item, first, passage, seeds): one passage for each cluster of nearby diagonals of an item in a text.

    ``docs``: row, doc_id, text, hits (array of item, length, diagonal, key).
    """
    def cut(rows: list, doc_ids: list, texts: list, all_hits: list) -> Iterator[tuple]:
        for r, d, text, found in zip(rows, doc_ids, texts, all_hits):
            w = words(text)
            by_item: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for h in found:
                by_item[h["item"], h["length"]].append((h["diagonal"], h["key"]))
            for (item, length), hits in sorted(by_item.items()):
                hits.sort()
                slack = length // 4 + SEED_WORDS
                group: list[tuple[int, int]] = []
                for diagonal, key in [*hits, (None, 0)]:
                    if group and (diagonal is None or diagonal - group[-1][0] > slack):
                        first = max(0, group[0][0] - slack)
                        last = min(len(w), group[-1][0] + length + slack)
                        yield r, d, item, first, " ".join(w[first:last]), sorted({k for _, k in group})
                        group = []
                    group.append((diagonal, key))

    return map_rows(docs, T.StructType([
        T.StructField("row", T.LongType()), docs.schema["doc_id"],
        *T.StructType.fromDDL("item long, first long, passage string, seeds array<long>").fields,
    ]), cut)


def passages(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """The passages of ``docs`` (row, doc_id, text) that share seeds with items, written; see ``_cut``."""
    windows = materialize(_windows(docs, seeds), "windows")
    each = windows.select("row", F.explode(F.arrays_zip("at", "key")).alias("w")).select("row", "w.at", "w.key")
    # a passage that very many texts hold makes its keys hot
    met = spread_join(each, seeds.select("key", "item", "length", "place"), "key", "row")
    hit = F.struct("item", "length", (F.col("at") - F.col("place")).alias("diagonal"), "key")
    hits = met.groupBy("row").agg(F.collect_list(hit).alias("hits"))
    found = materialize(_cut(windows.select("row", "doc_id", "text").join(hits, "row")), "passages")
    drop_table(windows)
    return found


def may_reach(item: list[str], passage: list[str], min_score: float) -> bool:
    """Whether the shared words of item and passage could give ``min_score``."""
    have = Counter(passage)
    shared = sum(min(n, have[w]) for w, n in Counter(item).items())
    return shared >= min_score * len(item)


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Smith-Waterman over words: (share of the score of a whole copy, start, end in the passage)."""
    if not item or not passage:
        return 0.0, 0, 0
    ids: dict[str, int] = {}
    a = [ids.setdefault(x, len(ids)) for x in item]
    b = np.array([ids.setdefault(x, len(ids)) for x in passage])
    columns = np.arange(len(b) + 1)
    score, start = np.zeros(len(b) + 1, np.int64), columns.copy()
    best = (0, 0, 0)
    for x in a:
        step = score[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = score[1:] + GAP
        new = np.concatenate([[0], np.maximum(np.maximum(step, up), 0)])
        came = np.concatenate([[0], np.where(step >= up, start[:-1], start[1:])])
        came = np.where(new == 0, columns, came)
        # gaps in the item: the best cell to the left, less a gap for each column
        lifted = new - GAP * columns
        reach = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted == reach, columns, 0))
        score, start = np.maximum(reach + GAP * columns, 0), came[origin]
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
    return best[0] / (MATCH * len(item)), best[1], best[2]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each pair of rows that reaches ``min_score``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; words are numbered from 0 in the text.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    items = materialize(
        benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")).filter("text is not null"),
        "items",
    )
    seeds = materialize(seed_table(items), "seeds")
    found = passages(docs, seeds)
    # how often each seed of an item is found, and whether that is rare for the item
    counts = found.select("item", F.explode("seeds").alias("seed")).groupBy("item", "seed").count()
    median = counts.groupBy("item").agg(F.percentile_approx("count", 0.5).alias("median"))
    rare = counts.join(median, "item").filter(F.col("count") <= RARE_TIMES * F.col("median")).groupBy("item").agg(F.collect_set("seed").alias("rare"))
    known = items.select("item", F.col("text").alias("item_text")).join(rare, "item")
    sure = F.arrays_overlap("seeds", "rare") | (F.size("seeds") > 1)
    # an item may be found in very many texts
    candidates = spread_join(found, known, "item", "row").select("row", "doc_id", "item", "first", "passage", "item_text", sure.alias("sure"))

    def score(*columns: list) -> Iterator[tuple]:
        for r, d, i, first, passage, item, sure in zip(*columns):
            own, other = words(item), passage.split(" ")
            if sure or may_reach(own, other, min_score):
                s, a, b = align(own, other)
                if s >= min_score:
                    yield r, d, i, s, first + a, first + b

    hits = map_rows(candidates, T.StructType([
        T.StructField("row", T.LongType()), docs.schema["doc_id"], *T.StructType.fromDDL("item long, score double, start_word long, end_word long").fields
    ]), score)
    best = F.max_by(F.struct("doc_id", "score", "start_word", "end_word"), F.struct("score", -F.col("start_word"))).alias("best")
    hits = hits.groupBy("row", "item").agg(best).select("item", "best.*")
    out = materialize(hits.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "score", "start_word", "end_word"), "contaminated")
    for done in (found, seeds, items):
        drop_table(done)
    return out
