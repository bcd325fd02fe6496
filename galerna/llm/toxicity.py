"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, votes weighted by distance.

Terms. A text's words are runs of letters, lower-cased; its terms are the words and their pieces of four and five signs, the
word's two ends being signs too. The labelled texts choose the terms that count: those that the toxic ones hold more often than
chance allows. A text is the TF-IDF vector of its chosen terms, (1 + ln tf) ln((1 + N) / (1 + df)), with df and N over all
documents.

Index. Examples are sorted by their heaviest term and cut into blocks. A term's postings list its examples and weights, and
the greatest weight in each block; the sum of a query's weights times these is an upper bound of the cosine of any example of
the block. The blocks of the greatest bounds are read first, and then all whose bound reaches the ``NEIGHBOURS``-th best cosine found,
so that the neighbours are exact; examples as near as the last one all belong to them.

Score. A neighbour votes for its label with weight 1 / (distance + ``NEAR``), times what an example stands for in the
sample, beside a prior of weight ``PRIOR``. A monotone map, fitted to the votes that the examples' other examples give them,
turns the share of votes into the share of toxic texts among those of such a share. The neighbours are the evidence.

Bounds. Examples are at most ``EXAMPLES`` distinct texts of either label (in expectation, by a hash of the text), so that the
index may be sent to all tasks; at most ``TERMS`` terms are chosen, the most telling first. Copies of a text are one example,
toxic if half of its labels are. All documents are counted and scored.

Edge cases: a text without chosen terms (null, empty, no letters) has no neighbours, and its score is the share of toxic texts
among the examples like it; equal texts get equal scores; rows that repeat an id, or have none, are scored each, and take part in
learning with the labels of their id; very long texts are read whole; without labelled rows every score is 0; an empty table
gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galerna.llm.common import drop_table, map_rows, materialize, whole_text

EXAMPLES = 4000
TERMS = 20_000
PIECES = (4, 5)
#: Least log-likelihood ratio of a chosen term (chance alone exceeds it once in 10^7 terms), and the examples that hold it at least.
TELLING, LEAST_HELD = 30.0, 5
#: Examples of a block, and blocks that are read before any is passed over.
BLOCK, FIRST = 32, 8
NEIGHBOURS = 15
NEAR, PRIOR = 0.05, 1.0
SLACK = 1e-9
#: Words and vectors that a task remembers; beyond it the memory starts anew (results do not change).
KEPT = 400_000
#: Texts of a task of the search, which is long where their vectors are short.
TASK_ROWS = 8192

_words = re.compile(r"[^\W\d_]+").findall


def pieces(word: str) -> set[str]:
    """The terms of a word."""
    whole = f"<{word}>"
    return {whole} | {whole[i : i + n] for n in PIECES for i in range(len(whole) - n + 1)}


def terms(text: str | None) -> set[str]:
    return set().union(*map(pieces, set(_words((text or "").lower()))))


class Vocabulary:
    """Numbers of the chosen terms."""

    def __init__(self, chosen: list[str]):
        self.number = {t: k for k, t in enumerate(chosen)}
        self._known: dict[str, list[int]] = {}

    def _of(self, word: str) -> list[int]:
        found = self._known.get(word)
        if found is None:
            found = sorted(self.number[p] for p in pieces(word) if p in self.number)
            if len(word) < 64:
                if len(self._known) >= KEPT:
                    self._known.clear()
                self._known[word] = found
        return found

    def count(self, text: str | None) -> tuple[list[int], list[int]]:
        """The chosen terms of a text, ascending, and how many of its words hold each."""
        found = Counter(t for w in _words((text or "").lower()) for t in self._of(w))
        at = sorted(found)
        return at, [found[t] for t in at]


def vector(at: list[int], tf: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of unit length."""
    at = np.asarray(at, np.int64)
    weight = (1 + np.log(np.asarray(tf, float))) * idf[at]
    length = float(np.sqrt((weight * weight).sum()))
    return (at, weight / length) if length else (at[:0], weight[:0])


class Index:
    """Block-max inverted index of example vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        heaviest = [int(at[np.argmax(w)]) if len(at) else -1 for at, w in vectors]
        self.order = np.array(sorted((k for k, t in enumerate(heaviest) if t >= 0), key=lambda k: (heaviest[k], k)), np.int64)
        self.size = len(self.order)
        blocks = -(-self.size // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[k][0] for k in self.order)])
        self.weight = np.concatenate([np.zeros(0), *(vectors[k][1] for k in self.order)])
        self.example = np.repeat(np.arange(self.size), [len(vectors[k][0]) for k in self.order])
        order = np.lexsort((self.example, term))
        self.example, self.weight, term = self.example[order], self.weight[order], term[order]
        # runs: the postings of a term in a block
        run = term * max(blocks, 1) + self.example // BLOCK
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        self.run_start, self.run_size = starts, np.diff(np.append(starts, len(run)))
        self.run_block = run[starts] % max(blocks, 1)
        self.run_most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.of_term = np.searchsorted(run[starts] // max(blocks, 1), np.arange(n_terms + 1))
        self.blocks = blocks

    def nearest(self, at: np.ndarray, weight: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the greatest cosines above 0, by cosine and number, and these: all that are as near as the last of NEIGHBOURS.

        The blocks of the greatest bounds are read first; their examples give a least cosine, and of the others those
        are read whose bounds reach it.
        """
        first = self.of_term[at]
        n = self.of_term[at + 1] - first
        runs = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if not len(runs):
            return np.zeros(0, np.int64), np.zeros(0)
        query, block = np.repeat(weight, n), self.run_block[runs]
        bound = np.bincount(block, query * self.run_most[runs], minlength=self.blocks)
        first_read = np.zeros(self.blocks, bool)
        first_read[np.argpartition(-bound, FIRST)[:FIRST] if self.blocks > FIRST else slice(None)] = True
        cosine = self._cosines(runs, query, first_read[block])
        least = self._least(cosine, without)
        second = (bound >= least - SLACK) & ~first_read
        if self.blocks > FIRST and second.any():
            cosine += self._cosines(runs, query, second[block])
            least = self._least(cosine, without)
        found = np.flatnonzero((cosine > 0) & (cosine >= least - SLACK) & (self.order != without))
        cosine = np.minimum(cosine[found], 1.0)
        found = self.order[found]
        order = np.lexsort((found, -np.round(cosine, 9)))
        return found[order], cosine[order]

    def _cosines(self, runs: np.ndarray, query: np.ndarray, read: np.ndarray) -> np.ndarray:
        """Cosines with the examples of the runs to be read, 0 elsewhere."""
        runs = runs[read]
        n = self.run_size[runs]
        posts = np.repeat(self.run_start[runs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.example[posts], np.repeat(query[read], n) * self.weight[posts], minlength=self.size)

    def _least(self, cosine: np.ndarray, without: int) -> float:
        """The NEIGHBOURS-th best so far; 0 if there are not so many."""
        known = cosine[(cosine > 0) & (self.order != without)]
        return float(np.partition(known, -NEIGHBOURS)[-NEIGHBOURS]) if len(known) >= NEIGHBOURS else 0.0


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ascending step function of least squares (neighbouring values that descend are pooled)."""
    values, at = np.unique(x, return_inverse=True)
    pools = []
    for v, s, w in zip(values.tolist(), np.bincount(at, y * weight).tolist(), np.bincount(at, weight).tolist()):
        pools.append([s, w, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, w2, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + w2, pools[-1][2], high]
    ends = [(e, s / w) for s, w, low, high in pools for e in dict.fromkeys((low, high))]
    return np.array([e for e, _ in ends]), np.array([v for _, v in ends])


class Model:
    """Vocabulary, document frequencies, examples with their labels, and the map of votes to scores."""

    def __init__(self, chosen: list[str], idf: np.ndarray, counted: list[tuple[list[int], list[int]]], ids: list, toxic: list[float], stands: list[float]):
        self.idf, self.ids, self.toxic, self.stands = idf, ids, np.array(toxic, float), np.array(stands, float)
        self.vocabulary = Vocabulary(chosen)
        self.vectors = [vector(a, tf, idf) for a, tf in counted]
        self.index = Index(self.vectors, len(chosen))
        total = float(self.stands.sum())
        self.share = float((self.toxic * self.stands).sum()) / total if total else 0.0
        none = np.array([not len(a) for a, _ in self.vectors], bool)
        alike = float(self.stands[none].sum())
        # a text without neighbours is like the examples without terms, with one example of the whole sample's share
        self.empty = (float((self.toxic * self.stands)[none].sum()) + self.share) / (alike + 1) if total else 0.0
        self.points = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self._known: dict[bytes, tuple] = {}

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        weight = self.stands[found] / (1 - cosine + NEAR)
        return (float((weight * self.toxic[found]).sum()) + PRIOR * self.share) / (float(weight.sum()) + PRIOR)

    def own_vote(self, k: int) -> float | None:
        """The vote on an example that the others give."""
        found, cosine = self.index.nearest(*self.vectors[k], without=k)
        return self.vote(found, cosine) if len(found) else None

    def score(self, at: list[int], tf: list[int]) -> tuple[float, list[tuple]]:
        """Score and evidence: (id of the example, cosine, its label) of the nearest ones."""
        key = np.array([at, tf], np.int32).tobytes()
        out = self._known.get(key)
        if out is None:
            found, cosine = self.index.nearest(*vector(at, tf, self.idf))
            s = float(np.interp(self.vote(found, cosine), *self.points)) if len(found) else self.empty
            near = [(self.ids[k], round(c, 9), int(self.toxic[k] >= 0.5)) for k, c in zip(found[:NEIGHBOURS].tolist(), cosine.tolist())]
            out = (min(1.0, max(0.0, s)), near)
            if len(self._known) >= KEPT // 10:
                self._known.clear()
            self._known[key] = out
        return out


def telling(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """Log-likelihood ratio of a term that a of n_a toxic texts hold and b of n_b others; below 0 if these hold it more often."""
    held = a + b

    def part(k: Column, n: int, of: Column) -> Column:
        return F.when(k > 0, k * F.log(k * float(n_a + n_b) / (of * float(n)))).otherwise(0.0)

    rest = F.lit(n_a + n_b) - held
    g = 2 * (part(a, n_a, held) + part(b, n_b, held) + part(n_a - a, n_a, rest) + part(n_b - b, n_b, rest))
    return F.when(a * n_b > b * n_a, g).otherwise(-g)


def examples(train: DataFrame, labels: DataFrame) -> DataFrame:
    """(example: smallest doc_id, text, toxic: share of its labels, stands): distinct labelled texts, ``EXAMPLES`` of either label at most."""
    digest = F.sha2(whole_text(F.col("text")), 256).alias("digest")
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("double")).alias("toxic"))
    each = materialize(
        train.select("doc_id", digest).join(known, "doc_id").groupBy("digest").agg(F.avg("toxic").alias("toxic"), F.min("doc_id").alias("example")), "labelled"
    )
    label = F.col("toxic") >= 0.5
    n = {r.label: r.n for r in each.groupBy(label.alias("label")).agg(F.count("*").alias("n")).collect()}
    rate = {k: min(1.0, EXAMPLES / max(n.get(k, 0), 1)) for k in (True, False)}
    chance = F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) / float(1 << 20)
    chosen = each.filter(chance < F.when(label, rate[True]).otherwise(rate[False]))
    chosen = chosen.withColumn("stands", F.when(label, 1 / rate[True]).otherwise(1 / rate[False]))
    # few rows by the rates above; the texts meet their digests where they are
    texts = train.select(digest, whole_text(F.col("text")).alias("text")).join(F.broadcast(chosen.select("digest")), "digest").groupBy("digest")
    out = materialize(chosen.join(texts.agg(F.first("text").alias("text")), "digest").select("example", "text", "toxic", "stands"), "examples")
    drop_table(each)
    return out


def _choose(sample: DataFrame) -> list[str]:
    """The terms that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Counter(), Counter()
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                held[toxic < 0.5].update(terms(text))
            every = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every), *(pa.array([h[t] for t in every], pa.int64()) for h in held)], ["term", "a", "b"])

    n_a, n_b = (sample.filter(c).count() for c in ("toxic >= 0.5", "toxic < 0.5"))
    if not n_a or not n_b:
        return []
    counted = sample.select("text", "toxic").mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g = telling(F.col("a"), F.col("b"), n_a, n_b)
    best = counted.filter(F.col("a") + F.col("b") >= LEAST_HELD).withColumn("g", g).filter(F.col("g") >= TELLING)
    return sorted(r.term for r in best.orderBy(F.desc("g"), "term").limit(TERMS).select("term").collect())


COUNTED = "at array<int>, tf array<int>"


def _counted(df: DataFrame, chosen: list[str], kept: list[str]) -> DataFrame:
    """Columns ``kept`` and the chosen terms of each text."""
    sent = df.sparkSession.sparkContext.broadcast(chosen)
    schema = T.StructType([*(df.schema[c] for c in kept), *T._parse_datatype_string(COUNTED).fields])

    def make(*columns):
        vocabulary = _per_process("vocabulary", sent.value, lambda: Vocabulary(sent.value))
        for *rest, text in zip(*columns):
            yield (*rest, *vocabulary.count(text))

    return map_rows(df.select(*kept, F.col("text").cast("string").alias("text")), schema, make)


_made: dict[str, tuple] = {}


def _per_process(name: str, key, make):
    """One object of a name in a worker process, made anew for another key."""
    if name not in _made or _made[name][0] is not key:
        _made[name] = (key, make())
    return _made[name][1]


def fit(counted: DataFrame, sample: DataFrame, chosen: list[str]) -> Model:
    """``counted``: at and tf of all documents; ``sample``: rows of ``examples``."""
    of = {r.term: r.df for r in counted.select(F.explode("at").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # TERMS rows at most
    n = counted.count()
    idf = np.log((1 + n) / (1 + np.array([of.get(k, 0) for k in range(len(chosen))], float)))
    rows = _counted(sample, chosen, ["example", "toxic", "stands"]).collect()
    # in an order of their own, whatever the tasks' order
    rows.sort(key=lambda r: (r.example is None, r.example if r.example is not None else 0, r.at, r.tf, r.toxic))
    parts = (chosen, idf, [(r["at"], r["tf"]) for r in rows], [r.example for r in rows], [r.toxic for r in rows], [r.stands for r in rows])
    model = Model(*parts)
    if rows:
        sent = counted.sparkSession.sparkContext.broadcast(parts)

        def own(k):
            m = _per_process("fitted", sent.value, lambda: Model(*sent.value))
            return ((x, m.own_vote(x)) for x in k)

        schema = T._parse_datatype_string("k long, vote double")
        votes = map_rows(counted.sparkSession.range(0, len(rows), 1, max(1, len(rows) // 500)), schema, own).filter("vote is not null").toPandas().sort_values("k")
        if len(votes):
            k = votes["k"].to_numpy()
            model.points = monotone(votes["vote"].to_numpy(), model.toxic[k], model.stands[k])
    return model


def score(docs: DataFrame, train: Column, labels: DataFrame) -> DataFrame:
    """(doc_id, score, evidence) for each row of ``docs``; labels are learned from rows of ``train`` only.

    evidence: (example: doc_id, cosine, toxic) of the nearest labelled examples, the nearest first.
    """
    sample = examples(docs.filter(train), labels)
    chosen = _choose(sample)
    counted = materialize(_counted(docs.select("doc_id", "text"), chosen, ["doc_id"]), "counted")
    model = fit(counted, sample, chosen)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("score", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(T.StructType([
            T.StructField("example", docs.schema["doc_id"].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType()),
        ]))),
    ])

    def make(ids, at, tf):
        for i, a, n in zip(ids, at, tf):
            s, near = sent.value.score(a, n)
            yield i, s, [dict(zip(("example", "cosine", "toxic"), x)) for x in near]

    # vectors take few bytes, by which Spark would read very many in one task
    tasks = max(1, -(-counted.count() // TASK_ROWS))
    out = materialize(map_rows(counted.repartition(tasks), schema, make), "toxicity")
    drop_table(counted)
    drop_table(sample)
    return out
