"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a byte string ``b`` let ``last[i]`` be the last token of the encoding of ``b[:i]``. That encoding is unique, so
one token a prefix is enough: the encoding of ``b[:i]`` is the encoding of ``b[:i - len(last[i])]`` followed by
``last[i]``. A token ``t`` that ends at ``i`` is the valid one when the pair (``last[i - len(t)]``, ``t``) survives,
that is when merging the joined bytes of the two from scratch gives just these two tokens back. The table makes
appends exact (only new prefixes are computed) and lets a text be encoded again near an edit only.

Edge cases: a null or empty text gives no ids; every byte has a token, so any text is encoded; very long words cost
time linear in their length; repeated rows get equal results; an empty table gives no rows; ids outside the vocabulary make ``decode`` fail with a KeyError.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries that a task keeps of words seen before; beyond it the memory starts anew (results do not change).
WORDS_KEPT = 400_000
PAIRS_KEPT = 400_000
NEVER = 1 << 60


class Vocabulary:
    """Ranks of a byte-level vocabulary and the prefix tables made with them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        # finds all tokens that end at each byte, in one pass; its strings hold a byte a character
        self.longest = max(map(len, ranks), default=1)
        self.finder = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.finder.add_word(b.decode("latin-1"), (len(b), i))
        self.finder.make_automaton()
        self._halves: dict[int, tuple[int, int]] = {}
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def merge(self, b: bytes, down_to: int = 1) -> list[int]:
        """The definition: merge the adjacent parts of lowest rank, the leftmost first, until ``down_to`` are left."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > down_to:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        known = self._halves.get(token)
        if known is None and len(self.bytes_of[token]) > 1:
            known = self._halves[token] = tuple(self.merge(self.bytes_of[token], 2))
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes from scratch ends in just these two tokens.

        Merges happen in order of rank, so undo the later of the two tokens' last merges again and again. At each
        point a merge across the border must not come before the merge that was undone last; of equal ranks the one
        further left comes first.
        """
        known = self._pairs.get(left << 32 | right)
        if known is not None:
            return known
        a, b, before, ranks, bytes_of = left, right, NEVER, self.ranks, self.bytes_of
        while True:
            if ranks.get(bytes_of[a] + bytes_of[b], NEVER) < before:
                known = False
                break
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None and of_b is None:
                known = True
                break
            if of_b is None or of_a is not None and a > b:
                before, a = a, of_a[1]
            else:
                before, b = b + 1, of_b[0]
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        self._pairs[left << 32 | right] = known
        return known

    def extend(self, b: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (its entry 0 is unused) for the prefixes of ``b`` that it does not cover yet."""
        have, known = len(last), self._pairs.get
        skip = max(0, have - self.longest)
        for i, (n, t) in self.finder.iter(b[skip:].decode("latin-1")):
            i += skip + 1
            if i < have:
                continue
            if i > n:
                left = last[i - n]
                ok = known(left << 32 | t)
                if not (self.compatible(left, t) if ok is None else ok):
                    continue
            last.append(t)
            have += 1
        if len(last) != len(b) + 1:
            raise ValueError("a byte is no token of the vocabulary")
        return last

    def read_back(self, last: list[int]) -> list[int]:
        ids, i = [], len(last) - 1
        while i > 0:
            ids.append(last[i])
            i -= len(self.bytes_of[last[i]])
        ids.reverse()
        return ids

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one match of the splitting pattern."""
        ids = self._words.get(word)
        if ids is None:
            if len(self._words) >= WORDS_KEPT:
                self._words.clear()
            b = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            ids = (whole,) if whole is not None else tuple(self.read_back(self.extend(b, [-1])))
            if len(b) <= 64:
                self._words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        found = list(map(self._words.get, words))
        if None in found:
            found = [self.word(w) if f is None else f for f, w in zip(found, words)]
        return list(chain.from_iterable(found))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoded:
    """A text with its matches and prefix tables, for exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.vocabulary, self.text, self.matches = vocabulary, "", []
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        return [t for _, _, last in self.matches for t in self.vocabulary.read_back(last)]

    def append(self, more: str) -> "Encoded":
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> "Encoded":
        """Replace text[start:end] by ``new``; matches away from the edit keep their tables.

        A match depends on its own characters and on two after it at most, so those that end three before the edit
        stay. After the edit, splitting is in step again where a new match starts on an old match's start.
        """
        v, shift = self.vocabulary, len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        keep = 0
        while keep < len(self.matches) and self.matches[keep][1] + 3 <= start:
            keep += 1
        first = self.matches[keep - 1][1] if keep else 0
        old = {m[0] + shift: k for k, m in enumerate(self.matches) if m[0] >= end and k >= keep}
        by_start = {m[0]: m for m in self.matches[keep:]}
        fresh, tail = [], []
        for m in v.spans(text, first):
            if m.start() in old and m.start() >= start + len(new):
                tail = [(a + shift, b + shift, t) for a, b, t in self.matches[old[m.start()] :]]
                break
            b = m.group().encode("utf-8", "surrogatepass")
            last, before = [-1], by_start.get(m.start())
            if before is not None:  # the prefixes that an edit or an append left alone stay valid
                was = self.text[before[0] : before[1]].encode("utf-8", "surrogatepass")
                same = next((i for i, (x, y) in enumerate(zip(was, b)) if x != y), min(len(was), len(b)))
                last = before[2][: same + 1]
            fresh.append((m.start(), m.end(), v.extend(b, list(last))))
        self.matches = self.matches[:keep] + fresh + tail
        self.text = text
        return self


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file (base64 token and rank a line); every task's process reads it once."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return Vocabulary(ranks, pattern)


def _with(df: DataFrame, added: list[tuple[str, T.DataType, Callable]]) -> DataFrame:
    """Add columns (name, type, function of an Arrow batch that has all columns before), in one pass."""
    names = [name for name, _, _ in added]
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(n, k) for n, k, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # small pieces: long texts make many ids
                piece = batch.slice(at, 512)
                for name, _, make in added:
                    column, have = make(piece), piece.schema.names
                    keep = [i for i, n in enumerate(have) if n != name]
                    piece = pa.RecordBatch.from_arrays(
                        [*(piece.column(i) for i in keep), column], [*(have[i] for i in keep), name]
                    )
                yield piece

    return df.mapInArrow(run, schema)


def _encoder(path: str, pattern: str, text: str, ids: str) -> tuple[str, T.DataType, Callable]:
    def make(piece: pa.RecordBatch) -> pa.Array:
        v = vocabulary(path, pattern)
        each = [v.encode(x or "") for x in piece.column(piece.schema.get_field_index(text)).to_pylist()]
        offsets = np.cumsum([0, *map(len, each)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(each), np.int32, int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return ids, T.ArrayType(T.IntegerType()), make


def _decoder(path: str, pattern: str, ids: str, decoded: str) -> tuple[str, T.DataType, Callable]:
    def make(piece: pa.RecordBatch) -> pa.Array:
        v = vocabulary(path, pattern)
        column = piece.column(piece.schema.get_field_index(ids))
        at = column.offsets.to_pylist()
        flat = column.values.slice(at[0], at[-1] - at[0]).to_numpy().tolist()  # a null's range is empty
        return pa.array([v.decode(flat[a - at[0] : b - at[0]]) for a, b in zip(at, at[1:])], pa.binary())

    return decoded, T.BinaryType(), make


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int): the encoding of column ``text`` by the ranks in ``path``, split by ``pattern``.

    All other columns stay; a column named like ``ids`` is replaced. Null texts give an empty array.
    """
    return _with(df, [_encoder(path, pattern, text, ids)])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes that ``ids`` stand for. Null ids give empty bytes."""
    return _with(df, [_decoder(path, pattern, ids, decoded)])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass."""
    return _with(df, [_encoder(path, pattern, text, ids), _decoder(path, pattern, ids, decoded)])


def reencode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode edited texts: columns text, start, end, new give an edit (an append where start = end = length).

    Adds ``edited`` (the new text) and ``ids``; only the matches near the edit are encoded again. A null edit leaves
    the text as it is; positions are clipped to the text.
    """
    schema = T.StructType(
        [*(f for f in df.schema.fields if f.name not in ("edited", "ids")), T.StructField("edited", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for frame in frames:
            edited, ids = [], []
            for text, start, end, new in zip(frame["text"], frame["start"], frame["end"], frame["new"]):
                e = Encoded(v, text or "")
                if not (pd.isna(start) or pd.isna(end) or new is None):
                    a = min(max(int(start), 0), len(e.text))
                    e.edit(a, min(max(int(end), a), len(e.text)), new)
                edited.append(e.text)
                ids.append(e.ids())
            yield frame.drop(columns=[c for c in ("edited", "ids") if c in frame]).assign(edited=edited, ids=ids)

    return df.mapInPandas(run, schema)


def ids_digest(ids: str = "ids"):
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
