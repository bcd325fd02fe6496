"""Language-model scores by a weighted backoff automaton.

Counting. Texts are dealt into blocks of a few MB, a function of the row alone. A pass over the texts packs each
block's distinct words, bigrams and trigrams (the latter two as 64-bit hashes) into sorted arrays, cut into shards by
ranges of the hash; each shard adds the arrays of all blocks up and answers every block with the corpus counts of its own
n-grams, in its own order, so that keys go one way only. Nothing is pruned and nothing goes to the driver but the totals:
what is gathered grows with the input. No key is hot: a block sends each n-gram once, however often it occurs.

Model. P(w|h) = (c(hw) + K P(w|h')) / (c(h) + K), h' without its first word: counts smoothed by the shorter history with
the strength K of its order (Dirichlet prior). A word alone has the add-one probability of the contract's base, in which
all unseen words are one event. The end token ends every text and is the history of the first word.

Automaton. The root, each word and each bigram of the training texts is a state; the arcs of a state are the n-grams
that prolong it, of weight log10 P, and its failure arc, of weight log10 K / (c(h) + K), leads to the state of the
shorter history. One traversal from left to right carries the state and adds up the weights. The numbers of the n-grams
that end at each place are found beforehand for a whole block, which stands for the search of a state's arcs.

Edge cases: null and empty texts have one token, the end; repeated rows each get their row and count each; very long
texts are read whole; with no training rows every word is unseen, and the score is the base's; an empty table gives no
rows; columns of ``docs`` other than doc_id and text are not looked at. Bigrams and trigrams are known by 64-bit keys alone: two that
collide share their sum of counts, which may raise the probability of either; of 10^10 n-grams some three pairs do. Words that
collide are told apart within a block and share counts over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galerna.llm.common import materialize, whole_text

#: No word holds white space, so this is none.
END = b"\n"
ORDER = 3
#: K of histories of one word and of two words: the best of eleven pairs on a seventh of the training rows of sf0.1 (crc32 modulo
#: 7 equal to 3), the model learning from the other training rows; held-out rows had no part in it.
STRENGTH = (800.0, 10.0)
#: Least bytes of text of a block, and of the text whose n-grams a shard adds up; see ``piece_bytes``.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8: methods of bytes lower-case A-Z alone and split at ASCII white space alone."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams from the keys of what comes before the last word and of the word."""
    key = (before * _A) ^ (word * _B + _A)
    key ^= key >> np.uint64(32)
    key *= _A
    return key ^ (key >> np.uint64(29))


def _packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers in ``width`` bytes each; the few that do not fit are listed with their places."""
    top = np.uint64((1 << (8 * width)) - 1)
    values = values.astype("<u8")
    large = np.flatnonzero(values >= top).astype("<u8")
    low = np.minimum(values, top).view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join([np.array([len(large)], "<u8").tobytes(), large.tobytes(), values[large.astype(np.int64)].tobytes(), low.tobytes()])


def _unpacked(data: bytes, width: int) -> np.ndarray:
    large = int(np.frombuffer(data, "<u8", 1)[0])
    at, values = np.frombuffer(data, "<u8", 2 * large, 8).reshape(2, -1)
    low = np.frombuffer(data, np.uint8, offset=8 + 16 * large).reshape(-1, width)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    out = out.view("<u8").reshape(-1)
    out[at.astype(np.int64)] = values
    return out


#: Bytes of a count, and of the gap between two neighbouring keys.
COUNT, GAP = 1, 6


def piece_bytes(least: int, total: int) -> int:
    """Bytes of a block or shard of a corpus of ``total`` bytes.

    Every block sends a row to every shard that it has n-grams of. Pieces grow with the root of the corpus from some 550 GB of text
    on, so that a row holds a dozen n-grams or more and rows are few beside them; at 100 TB a piece has 113 MB.
    """
    return max(least, math.isqrt(128 * total))


class Block:
    """The n-grams of some texts: distinct ones in order of their keys, and their numbers at each token."""

    def __init__(self, texts: list, order: int):
        ids: dict[bytes, int] = {}
        number, flat, self.sizes = ids.setdefault, [ids.setdefault(END, 0)], []
        for t in texts:
            own = tokens(t)
            flat += [number(w, len(ids)) for w in own]
            self.sizes.append(len(own))
        # the end of each text is the history of the next one's first word
        words = list(ids)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        rank = np.argsort(keys, kind="stable")
        if (keys[rank][1:] == keys[rank][:-1]).any():  # words of one hash: in their own order
            rank = np.array(sorted(range(len(words)), key=lambda k: (int(keys[k]), words[k])))
        place = np.empty(len(words), np.int64)
        place[rank] = np.arange(len(words))
        self.words, self.word_keys = [words[k] for k in rank], keys[rank]
        self.end = int(place[0])
        seen = place[np.array(flat, np.int64)]
        h = self.word_keys[seen]
        self.keys, self.at = [self.word_keys], [seen[1:].astype(np.int32)]
        key, first = h, np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)  # of each text, its first token
        for n in range(2, order + 1):
            key = _joined(key[:-1], h[n - 1 :])
            known = np.ones(len(self.at[0]), bool)  # an n-gram must not reach over the end before its text
            for k in range(n - 2):
                some = first + k
                known[some[some < len(known)]] = False
                # of texts shorter than k + 1 the mark falls into the next text, which marks that place itself
            full = np.zeros(len(known), np.uint64)
            full[n - 2 :] = key
            distinct, inverse = np.unique(full[known], return_inverse=True)
            at = np.full(len(known), -1, np.int32)
            at[known] = inverse
            self.keys.append(distinct)
            self.at.append(at)

    def counts(self, train: list) -> list[np.ndarray]:
        """Occurrences in the training texts, for each order."""
        weight = np.repeat(np.array(train, np.int64), self.sizes)
        return [np.bincount(at[at >= 0], weights=weight[at >= 0], minlength=len(k)) for at, k in zip(self.at, self.keys)]

    def cuts(self, n: int, shards: int) -> np.ndarray:
        """Where the keys of order n are cut into shards, by equal ranges of the key."""
        own = ((self.keys[n - 1] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        return np.searchsorted(own, np.arange(shards + 1, dtype=np.uint64))


#: A block's n-grams of one order in one shard: the gaps of their keys (words: texts, each ended by a line end), counts.
PACKED = "shard int, block long, kind int, keys binary, n binary"
ANSWER = "block long, shard int, kind int, c binary"


def packed(docs: DataFrame, order: int, shards: int, most_bytes: int) -> DataFrame:
    """``PACKED`` rows of ``docs`` (block, text, train), whose rows of a block should stand together; a block is sent in
    parts of ``most_bytes``."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def rows_of(block: int, texts: list, train: list) -> pa.RecordBatch:
        b, rows = Block(texts, order), []
        for k, n in enumerate(b.counts(train), 1):
            cuts = b.cuts(k, shards)
            for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                i, j = int(cuts[s]), int(cuts[s + 1])
                keys = b"".join(w + b"\n" for w in b.words[i:j]) if k == 1 else _packed(np.diff(b.keys[k - 1][i:j], prepend=np.uint64(0)), GAP)
                rows.append((s, block, k, keys, _packed(n[i:j], COUNT)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, texts, train, size = None, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for b, text, learn in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if texts and (b != block or size > most_bytes):  # parts of a block are added up in the shards
                        yield rows_of(block, texts, train)
                        texts, train, size = [], [], 0
                    block = b
                    texts.append(text)
                    train.append(learn)
                    size += len(text)
        if texts:
            yield rows_of(block, texts, train)

    return docs.select("block", "text", "train").mapInArrow(run, PACKED)


def _distinct(values: pa.Array | np.ndarray) -> tuple[object, np.ndarray]:
    """Distinct values and the number of each value among them."""
    if isinstance(values, np.ndarray):
        return np.unique(values, return_inverse=True)
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _words_of(keys: bytes) -> list[bytes]:
    """The packed words; the end token, a line end itself, is packed as two line ends."""
    if keys.startswith(b"\n\n"):
        return [END, *keys[2:].split(b"\n")[:-1]]
    head, sep, tail = keys.partition(b"\n\n\n")
    if not sep:
        return keys.split(b"\n")[:-1]
    return [*head.split(b"\n"), END, *tail.split(b"\n")[:-1]]


def answers(sent: DataFrame) -> DataFrame:
    """``ANSWER`` rows: for each block, shard and order the corpus counts, in the order of the block's keys.

    A row of kind 0 for each shard, without a block, holds the number of training tokens and of distinct words.
    """
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("c", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        shard, out = table.column("shard")[0].as_py(), []
        kinds, blocks = table.column("kind").to_numpy(), table.column("block").to_numpy()
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            at = at[np.argsort(blocks[at], kind="stable")]
            some = table.take(pa.array(at))
            if kind == 1:
                each = [_words_of(k) for k in some.column("keys").to_pylist()]
                values = pa.array([w for part in each for w in part], pa.binary())
                lengths = [len(part) for part in each]
            else:
                each = [np.cumsum(_unpacked(k, GAP), dtype=np.uint64) for k in some.column("keys").to_pylist()]
                values, lengths = np.concatenate(each), [len(part) for part in each]
                del each
            n = np.concatenate([_unpacked(x, COUNT) for x in some.column("n").to_pylist()])
            del some
            distinct, number = _distinct(values)
            total = np.bincount(number, weights=n, minlength=len(distinct)).astype("<u8")
            del values, n
            if kind == 1:
                out.append((None, shard, 0, np.array([total.sum(), np.count_nonzero(total)], "<u8").tobytes()))
            ends = np.cumsum(lengths)
            own = blocks[at]
            start = 0
            while start < len(own):
                stop = start + 1
                while stop < len(own) and own[stop] == own[start]:
                    stop += 1
                numbers = number[ends[start] - lengths[start] : ends[stop - 1]]
                if stop - start > 1:  # parts of a block: their union, in the order of the keys
                    numbers = np.unique(numbers)
                    if kind == 1:
                        words = distinct.take(pa.array(numbers)).to_pylist()
                        numbers = numbers[sorted(range(len(words)), key=lambda k: (xxhash.xxh64_intdigest(words[k]), words[k]))]
                out.append((int(own[start]), shard, kind, _packed(total[numbers], COUNT)))
                start = stop
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return sent.groupBy("shard").applyInArrow(run, ANSWER)


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block, with their counts in the whole corpus.

    State 0 is the root, 1 + w that of word w, 1 + W + b that of bigram b. ``arcs[k]`` holds the weight of the arc
    that the n-gram of each number is, for n = k + 2, or NaN where the training texts do not have it.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, strength: tuple[float, ...] = STRENGTH):
        order = len(counts)
        base = np.log10((counts[0] + 1.0) / (n + v + 1.0))
        known = [c > 0 for c in counts]
        log = np.log10
        # which word or bigram each bigram or trigram starts with, and what the shorter history gives its last word
        arcs, weight = [], [np.zeros(1)]
        shorter = 10.0**base
        for k in range(1, order):
            at, last, before = block.at[k], block.at[k - 1], np.concatenate([[block.end if k == 1 else -1], block.at[k - 1][:-1]])
            some = np.flatnonzero(at >= 0)
            head, tail = np.zeros(len(counts[k]), np.int64), np.zeros(len(counts[k]), np.int64)
            head[at[some]], tail[at[some]] = before[some], last[some]
            c, s = counts[k - 1][head].astype(float), strength[k - 1]
            p = (counts[k] + s * shorter[tail]) / (c + s)
            arcs.append(np.where(known[k], log(p), np.nan))
            weight.append(log(s / (counts[k - 1] + s)))
            # of an unseen n-gram too: what its history leaves to the shorter one
            shorter = np.where(c > 0, p, shorter[tail])
        words, two = len(counts[0]), 1 + len(counts[0])
        fail = np.zeros(sum(map(len, weight)), np.int64)
        state = [np.where(known[0], 1 + np.arange(words), 0) if order > 1 else np.zeros(words, np.int64)]
        if order > 2:
            some = np.flatnonzero(block.at[1] >= 0)
            tail = np.zeros(len(counts[1]), np.int64)
            tail[block.at[1][some]] = block.at[0][some]
            fail[two:] = state[0][tail]
            state.append(np.where(known[1], two + np.arange(len(counts[1])), state[0][tail]))
        self.first_of_two, self.start, self.depth = two, int(state[0][block.end]), len(state)
        # views give plain numbers without an object for each
        self.base, self.weight, self.fail, self.to = map(memoryview, (base, np.concatenate(weight), fail, state[-1]))
        self.arcs = [memoryview(x) for x in arcs]

    def traverse(self, numbers: list[list[int]]) -> float:
        """log10 probability of a text; ``numbers`` are those of its words, bigrams and trigrams at each token."""
        state, total, fail, weight, two = self.start, 0.0, self.fail, self.weight, self.first_of_two
        base, to, arcs, last = self.base, self.to, self.arcs, self.depth - 1
        for at in zip(*numbers):
            arc = math.nan
            if state >= two:
                arc = arcs[1][at[2]]
                if arc != arc:  # no arc: fail to the history of one word
                    total += weight[state]
                    state = fail[state]
            if arc != arc and state:
                arc = arcs[0][at[1]]
                if arc != arc:
                    total += weight[state]
            total += base[at[0]] if arc != arc else arc
            state = to[at[last]]
        return total


def split_block(docs: DataFrame) -> Column:
    """A block for texts read from files: some consecutive rows of a file, of ``piece_bytes`` on average.

    It depends on the row's file and number there alone, however the scan is planned.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    a_block = max(1, int(rows * piece_bytes(BLOCK_BYTES, size) / max(size, 1)))
    return F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / a_block))


def score(docs: DataFrame, train: Column, block: Column | None = None, order: int = ORDER, strength: tuple[float, ...] = STRENGTH) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    ``train`` tells which rows the model learns from. ``block`` must be a function of the row that stays the same
    when the table is read again; texts of a block are scored together, so it should be a few MB. Best is one that
    neighbouring rows share, see ``split_block``; by default it is a hash of the row, by which rows are dealt first.
    """
    text = whole_text(F.col("text"))
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    dealt, block_bytes = block is None, piece_bytes(BLOCK_BYTES, size)
    if dealt:
        block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(size / block_bytes)))).cast("long")
    docs = docs.select("doc_id", text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"), block.alias("block"))
    together = docs.repartition("block").sortWithinPartitions("block") if dealt else docs
    shards = max(1, math.ceil(size / piece_bytes(SHARD_BYTES, size)))
    found = materialize(answers(packed(together, order, shards, 2 * block_bytes)), "counts")
    totals = [np.frombuffer(r[0], "<u8") for r in found.filter("kind = 0").select("c").collect()]  # a row for each shard
    n, v = (int(sum(t[k] for t in totals)) for k in (0, 1))

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        own = Block(texts.column("text").to_pylist(), order)
        counts = counts.take(pc.sort_indices(counts, sort_keys=[("kind", "ascending"), ("shard", "ascending")]))
        kinds, c = counts.column("kind").to_pylist(), counts.column("c").to_pylist()
        found = [np.concatenate([_unpacked(x, COUNT) for k, x in zip(kinds, c) if k == kind] or [np.zeros(0)]).astype(np.int64) for kind in range(1, order + 1)]
        model = Automaton(own, found, n, v, strength)
        base, at = np.array(model.base), 0
        rows = []
        for length in own.sizes:
            numbers = [x[at : at + length] for x in own.at]
            known = found[0][numbers[0]] > 0
            rows.append((length, int(known.sum()), float(base[numbers[0]].sum()), model.traverse([x.tolist() for x in numbers])))
            at += length
        n_tokens, n_known, base_score, total = zip(*rows) if rows else ((), (), (), ())
        return pa.table({
            "doc_id": texts.column("doc_id"), "train": texts.column("train"), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n] * len(rows), pa.int64()),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(total, pa.float64()),
        })

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(
        "train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return docs.groupBy("block").cogroup(found.filter("kind > 0").groupBy("block")).applyInArrow(run, schema)
