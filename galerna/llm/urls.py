"""URL filters: rules on host and path, and exact list membership by a cascade of Bloom filters.

Level 1 of the cascade holds the listed keys. Over the complete universe of keys of the corpus its false positives
are known, and level 2 holds them; level 3 holds the listed keys that level 2 takes by mistake, and so on until a
level makes no mistake. The number of the first level that does not hold a key then tells exactly whether a key of the
universe is listed, without a join.

The universe is cut into shards by hash, of a bounded number of keys, and each shard has a cascade of its own, which one
task builds; the filters are a table. They are sent to all tasks only where their measured size is ``MAX_FILTER_BYTES``
at most; beyond that each shard's rows, cut into parts so that a hot key is spread, meet their own shard's filters.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and is in no list unless the
empty host is listed; a null or unknown host in the list does no harm; keys outside the universe must not be asked for;
an empty list allows everything; repeated rows get equal results; very long urls are read whole; an empty table gives no
rows; keys that share both 64-bit hashes with a key of the other side are listed by name; extra columns stay, and those named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galerna.llm.common import ascii_lower, drop_table, materialize, whole_text

MAX_FILTER_BYTES = 64 << 20
#: Keys of a shard (in expectation), and rows of a part of a shard.
SHARD_KEYS = 1 << 20
PART_ROWS = 1 << 18
BITS_A_KEY = 10.0
HASHES = 5
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        """The host itself and all its subdomains, where the path starts with the rule's."""
        inside = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return inside & F.startswith(path, F.lit(self.path))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.regexp_extract(whole_text(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(whole_text(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        found = F.when(r.fits(host, path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _hashes(key: Column) -> list[Column]:
    """Two hashes of a key. What comes first seeds the rest, so that keys that collide in one differ in the other."""
    return [F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)]


@dataclass
class Level:
    """A Bloom filter; levels draw their places from a key's two hashes in ways of their own."""

    number: int
    bits: int
    words: np.ndarray

    @staticmethod
    def of(number: int, h1: np.ndarray, h2: np.ndarray) -> "Level":
        bits = max(64, math.ceil(len(h1) * BITS_A_KEY / 64) * 64)
        out = Level(number, bits, np.zeros(bits // 64, np.uint64))
        for at in out._places(h1, h2):
            np.bitwise_or.at(out.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return out

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        turn = np.uint64((0x9E3779B97F4A7C15 * (2 * self.number + 1)) & (2**64 - 1))
        a, b = (h1 ^ turn) * np.uint64(0xC2B2AE3D27D4EB4F), (h2 + turn) | np.uint64(1)
        a ^= a >> np.uint64(29)
        for k in range(HASHES):
            yield ((a + np.uint64(k) * b) >> np.uint64(1)) % np.uint64(self.bits)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        held = np.ones(len(h1), bool)
        for at in self._places(h1, h2):
            held &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return held


def levels_of(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[Level]:
    """The cascade of the keys of a shard."""
    out, inside, outside = [], np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(out) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        out.append(Level.of(len(out), h1[inside], h2[inside]))
        inside, outside = outside[out[-1].holds(h1[outside], h2[outside])], inside
    return out


def clashing(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which keys share both hashes with a key of the other side: no filter tells these apart."""
    both = np.rec.fromarrays([h1, h2])
    _, group = np.unique(both, return_inverse=True)
    n, inside = np.bincount(group), np.bincount(group, listed)
    return ((inside > 0) & (inside < n))[group]


def contained(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The number of leading levels that hold a key is odd just for listed keys."""
    going, found = np.ones(len(h1), bool), np.zeros(len(h1), bool)
    for level in levels:
        going &= level.holds(h1, h2)
        found ^= going
    return found


def _unsigned(values) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)


class Shard:
    """The levels of a shard, and the few keys that its hashes do not tell apart, with their sides."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        rows = sorted(rows)
        self.levels = [Level(number, bits, np.frombuffer(words, np.uint64)) for number, bits, words in rows if number >= 0]
        self.named = {k: v for number, _, words in rows if number < 0 for k, v in json.loads(words).items()}

    def holds(self, keys: list, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = contained(self.levels, h1, h2)
        if self.named:
            for at, key in enumerate(keys):
                if key in self.named:
                    found[at] = self.named[key]
        return found


@dataclass
class Cascade:
    """Exact membership of the keys of a universe in a list."""

    #: (shard, number, bits, words), a row for each level; number -1: keys that the hashes do not tell apart.
    filters: DataFrame
    shards: int

    @staticmethod
    def fit(universe: DataFrame, listed: DataFrame) -> "Cascade":
        """``universe`` and ``listed`` have column key; listed keys outside the universe are left out."""
        keys = universe.select("key").distinct().join(listed.select("key", F.lit(True).alias("listed")).distinct(), "key", "left")
        hashed = (h.alias(n) for h, n in zip(_hashes(F.col("key")), ("h1", "h2")))
        keys = materialize(keys.select("key", *hashed, F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
        shards = max(1, math.ceil(keys.count() / SHARD_KEYS))

        def build(table: pa.Table) -> pa.Table:
            h1, h2 = (_unsigned(table.column(c).to_numpy()) for c in ("h1", "h2"))
            listed = table.column("listed").to_numpy()
            clash = clashing(h1, h2, listed)
            rows = [(x.number, x.bits, x.words.tobytes()) for x in levels_of(h1[~clash], h2[~clash], listed[~clash])]
            if clash.any():
                rows.append((-1, 0, json.dumps(dict(zip(table.filter(pa.array(clash)).column("key").to_pylist(), listed[clash].tolist()))).encode()))
            number, bits, words = zip(*rows) if rows else ((), (), ())
            return pa.table({
                "shard": pa.array([table.column("shard")[0].as_py()] * len(rows), pa.int32()), "number": pa.array(number, pa.int32()),
                "bits": pa.array(bits, pa.int64()), "words": pa.array(words, pa.binary()),
            })

        dealt = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
        filters = materialize(dealt.groupBy("shard").applyInArrow(build, "shard int, number int, bits long, words binary"), "filters")
        drop_table(keys)
        return Cascade(filters, shards)

    def size_bytes(self) -> int:
        return self.filters.agg(F.sum(F.octet_length("words"))).head()[0] or 0

    def mark(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with a column ``name``: whether column ``key`` is listed. The order of rows may change."""
        h1, h2 = _hashes(F.col(key))
        if self.size_bytes() <= MAX_FILTER_BYTES:
            made: dict[int, list] = {}
            for r in self.filters.collect():  # of the size just checked
                made.setdefault(r.shard, []).append((r.number, r.bits, bytes(r.words)))
            if not made:
                return rows.withColumn(name, F.lit(False))
            shards = self.shards
            sent = rows.sparkSession.sparkContext.broadcast({s: Shard(x) for s, x in made.items()})

            @F.pandas_udf("boolean")
            def test(k: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
                shard, found = np.mod(a.to_numpy(np.int64), shards), np.zeros(len(a), bool)
                for s in np.unique(shard).tolist():
                    own = shard == s
                    if s in sent.value:
                        found[own] = sent.value[s].holds(k[own].tolist(), _unsigned(a[own]), _unsigned(b[own]))
                return pd.Series(found)

            return rows.withColumn(name, test(F.col(key), h1, h2))
        return self._met(rows.withColumns({"__h1": h1, "__h2": h2, "__shard": F.pmod(h1, F.lit(self.shards)).cast("int")}), key, name)

    def _met(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """Rows and filters meet by shard; a shard of many rows is cut into parts, each of which gets its filters.

        Parts are dealt by chance and written, so that a task that runs again reads the same parts.
        """
        sizes = materialize(rows.groupBy("__shard").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("__parts")), "parts")
        dealt = materialize(rows.join(sizes, "__shard").withColumn("__part", F.floor(F.rand(1) * F.col("__parts")).cast("int")).drop("__parts"), "dealt")
        filters = self.filters.withColumnRenamed("shard", "__shard").join(sizes, "__shard").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        filters = materialize(filters.drop("__parts"), "met-filters")
        drop_table(sizes)
        out = [c for c in rows.columns if c not in ("__h1", "__h2", "__shard")]

        def test(some: pa.Table, levels: pa.Table) -> pa.Table:
            shard = Shard([(r["number"], r["bits"], r["words"]) for r in levels.to_pylist()])
            found = shard.holds(some.column(key).to_pylist(), *(_unsigned(some.column(c).to_numpy()) for c in ("__h1", "__h2")))
            return some.select(out).append_column(name, pa.array(found))

        schema = T.StructType([*(rows.schema[c] for c in out), T.StructField(name, T.BooleanType())])
        keys = ("__shard", "__part")
        return dealt.groupBy(*keys).cogroup(filters.groupBy(*keys)).applyInArrow(test, schema)


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict (allow or block) to ``pages``; columns of these names are replaced.

    ``listed`` is a table of hosts (column key) that are blocked where no rule fits; the cascade is built over all hosts
    of ``pages``.
    """
    with_host = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    cascade = Cascade.fit(with_host.select(F.col("host").alias("key")), listed)
    judged = cascade.mark(with_host, "host", "__in")
    drop_table(cascade.filters)
    found = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("__in"), "block").otherwise("allow")
    return judged.withColumns({"rule": found["rule"], "verdict": F.coalesce(found["verdict"], method)}).drop("__in")
