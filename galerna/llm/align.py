"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often the corpus pairs them.

Merge. For each text the ends of the tokens of A and of B, in bytes, are two ascending lists; a two-pointer merge finds
the ends that both have, which cut the tokens into groups. ``merge`` does it inside mapInPandas, for many texts at once:
their tokens cover the same bytes one after the other, so that the end of a text always is such a cut, and numpy's stable
sort of two ascending runs is that merge. Within a group every token of A is linked with every token of B.

Counts. A pass over the texts makes blocks of a few MB; a block lists its distinct pairs of ids, with the number of its
documents that hold each, and its documents refer to that list. Spark adds the pairs up over all blocks (partial sums
before the exchange), takes each side's maxima, and joins counts and maxima back to the blocks' lists. A block sends a pair
once, however many documents hold it, so no pair is hot; the maxima have at most one row for each id of a vocabulary, which
bounds what is broadcast. A last pass adds up the links of each document.

Tokenizers. B is sentencepiece's own. A is the byte-level BPE of a ``tokenizers`` file, encoded by ``tiktoken`` with the
ranks and the pattern of that file, which gives the same ids several times faster; a text with a very long run of white
space, which overflows the stack there, goes through ``tokenizers`` itself.

Edge cases: a text that is null or empty, or whose tokens do not give its bytes back (sentencepiece reads U+2581 as a space),
has no tokens, groups or links; very long texts and groups are read whole, links of a large group in pieces; every row is
a document of its own, also where its id repeats or is null; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galerna.llm.common import drop_table, materialize
from galerna.llm.lm import _packed, _unpacked

#: Bytes of text of a block, and of the pieces of it that numpy works on at once.
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 512 << 10
#: Links that are listed at once.
LINKS = 1 << 22
#: White space characters in a run that tiktoken's pattern may overflow at.
LONG_RUN = 50_000

_long_run = re.compile(rf"\s{{{LONG_RUN}}}").search


def _byte_of_sign() -> dict[str, int]:
    """The signs by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Tokenizer A (a byte-level ``tokenizers`` file) and B (a sentencepiece model), with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.slow = Tokenizer.from_file(path_a)
        self.slow.encode_special_tokens = True  # their strings in a text are plain text
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of_sign()
        bytes_a = {i: bytes(byte[c] for c in sign) for sign, i in model["vocab"].items()}
        joined = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = [model["vocab"]["".join(m)] for m in joined]
        if ids != sorted(ids):
            raise ValueError("the merges' order is not that of their ids")  # which tiktoken takes for it
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={b: i for i, b in bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a, self.size_b = max(bytes_a) + 1, self.b.get_piece_size()
        self.bytes_a = [bytes_a.get(i, b"") for i in range(self.size_a)]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace("▁", " ").encode() for p, one in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # how a token is written: first of its group's A, later in A, first of B, later in B
        signs = [[f"{sign}{i}" for i in range(n)] for sign, n in ((";", self.size_a), (",", self.size_a), ("|", self.size_b), (",", self.size_b))]
        self.written = np.array([s for part in signs for s in part], object)
        self.places = np.cumsum([0, *map(len, signs)])[:4]

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B for each text; none for texts whose bytes either does not give back."""
        whole = [" " + (t or "") for t in texts]
        of_b = self.b.encode([t or "" for t in texts], num_threads=1)
        out = []
        for text, b in zip(whole, of_b):
            a = self.slow.encode(text, add_special_tokens=False).ids if _long_run(text) else self.fast.encode_ordinary(text)
            data = text.encode("utf-8")
            same = b"".join(map(self.bytes_a.__getitem__, a)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data
            out.append((a, b) if same and len(text) > 1 else ([], []))
        return out


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str, pattern: str) -> Tokenizers:
    return Tokenizers(path_a, path_b, pattern)


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, counted from 0, given their ends: ascending, the last ones equal."""
    ends = np.concatenate([ends_a, ends_b])
    order = np.argsort(ends, kind="stable")  # two ascending runs: one merge
    ends = ends[order]
    cut = np.concatenate([[False], ends[1:] == ends[:-1]])  # ends of both sides stand beside each other
    group = np.empty(len(ends), np.int64)
    group[order] = np.cumsum(cut) - cut  # the second of a pair of equal ends belongs to the group that it closes
    return group[: len(ends_a)], group[len(ends_a) :]


class Piece:
    """The alignment of some texts."""

    def __init__(self, encoded: list[tuple[list[int], list[int]]], t: Tokenizers):
        self.t, self.docs = t, len(encoded)
        self.n_a, self.n_b = (np.array([len(x[k]) for x in encoded], np.int64) for k in (0, 1))
        self.a, self.b = (np.array([i for x in encoded for i in x[k]], np.int64) for k in (0, 1))
        self.group_a, self.group_b = merge(np.cumsum(t.length_a[self.a]), np.cumsum(t.length_b[self.b]))
        self.doc_a = np.repeat(np.arange(self.docs), self.n_a)
        groups = int(self.group_a[-1]) + 1 if len(self.a) else 0
        self.first_a, self.first_b = (np.diff(g, prepend=-1) > 0 for g in (self.group_a, self.group_b))
        self.n_groups = np.bincount(self.doc_a[self.first_a], minlength=self.docs)
        self.of_b = np.bincount(self.group_b, minlength=groups)  # tokens of B in each group
        self.start_b = np.cumsum(self.of_b) - self.of_b
        self.n_links = np.bincount(self.doc_a, self.of_b[self.group_a], minlength=self.docs).astype(np.int64)

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text: ids of A and B, group after group."""
        at = self.t.places
        written = np.concatenate([np.where(self.first_a, at[0], at[1]) + self.a, np.where(self.first_b, at[2], at[3]) + self.b])
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        signs, ends = self.t.written[written[order]].tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(signs[s:e])[1:] for s, e in zip([0, *ends], ends)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, number) of distinct links, by document and pair; a pair is id of A times size of B plus id of B."""
        size = self.t.size_a * self.t.size_b
        made = np.cumsum(self.of_b[self.group_a])
        cuts = np.unique(np.searchsorted(made, np.arange(LINKS, made[-1] if len(made) else 0, LINKS)))
        found = []
        for tokens in np.split(np.arange(len(self.a)), cuts):
            n = self.of_b[self.group_a[tokens]]
            of = np.repeat(tokens, n)
            b = self.b[np.arange(len(of)) + np.repeat(self.start_b[self.group_a[tokens]] - (np.cumsum(n) - n), n)]
            found.append(np.unique(self.doc_a[of] * size + self.a[of] * self.t.size_b + b, return_counts=True))
        keys, numbers = (np.concatenate(x) for x in zip(*found))
        if len(found) > 1:
            keys, at = np.unique(keys, return_inverse=True)
            numbers = np.bincount(at, numbers).astype(np.int64)
        return keys // size, keys % size, numbers


def _pieces(texts: list, t: Tokenizers) -> Iterator[tuple[int, int, Piece]]:
    """(start, end, alignment) of runs of texts of about PIECE_BYTES."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += 4 + len(text or "")
        if held >= PIECE_BYTES or k + 1 == len(texts):
            yield start, k + 1, Piece(t.encode(texts[start : k + 1]), t)
            start, held = k + 1, 0


def alignments(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """(key, groups, links) for each row of ``docs`` (key: long, text): the groups' ids, and the distinct links with their numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizers(path_a, path_b, pattern)
        for frame in frames:
            for start, end, piece in _pieces(frame["text"].tolist(), t):
                doc, pair, n = piece.links()
                links = [[{"a": int(p) // t.size_b, "b": int(p) % t.size_b, "n": int(c)} for p, c in zip(pair[doc == k], n[doc == k])] for k in range(piece.docs)]
                groups = [
                    [dict(zip("ab", ([int(i) for i in side.split(",")] for side in g.split("|")))) for g in x.split(";") if g] for x in piece.texts()
                ]
                yield pd.DataFrame({"key": frame["key"].iloc[start:end].to_numpy(), "groups": groups, "links": links})

    return docs.select("key", F.col("text").cast("string").alias("text")).mapInPandas(
        run, "key long, groups array<struct<a: array<int>, b: array<int>>>, links array<struct<a: int, b: int, n: int>>"
    )


def _blocks(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """Rows of blocks. pair and docs: the distinct pairs and how many documents of the block hold each; starts, at and n:
    the documents' links as places in that list."""

    def row(key: int, parts: list[tuple[pd.DataFrame, Piece]]) -> pd.DataFrame:
        frames, pieces = zip(*parts)
        sizes, pairs, numbers = [], [], []
        for p in pieces:
            doc, pair, n = p.links()
            sizes.append(np.bincount(doc, minlength=p.docs))
            pairs.append(pair)
            numbers.append(n)
        sizes, numbers = np.concatenate(sizes), np.concatenate(numbers)
        pair, at, held = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        gaps = np.diff(at, prepend=0)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        gaps[first] = at[first]  # each document counts from 0
        columns = {k: np.concatenate([getattr(p, k) for p in pieces]) for k in ("n_a", "n_b", "n_groups", "n_links")}
        return pd.DataFrame({
            "block": [key], "ids": [np.concatenate([f["doc_id"].to_numpy(object) for f in frames])], **{k: [v] for k, v in columns.items()},
            "groups": [[x for p in pieces for x in p.texts()]], "pair": [pair], "docs": [held], "starts": [sizes], "at": [_packed(gaps, 2)],
            "n": [_packed(numbers, 1)],
        })

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, held, size, key = tokenizers(path_a, path_b, pattern), [], 0, 0
        for frame in frames:
            for start, end, piece in _pieces(frame["text"].tolist(), t):
                own = frame.iloc[start:end]
                key = key if held else int(own["key"].iloc[0])
                held.append((own[["doc_id"]], piece))
                size += sum(len(x or "") for x in own["text"])
                if size >= BLOCK_BYTES:
                    yield row(key, held)
                    held, size = [], 0
        if held:
            yield row(key, held)

    numbers = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links", "pair", "docs", "starts"))
    return docs.mapInPandas(run, f"block long, ids array<string>, {numbers}, groups array<string>, at binary, n binary")


def statistics(
    docs: DataFrame, path_a: str, path_b: str, pattern: str, keep: Callable[[Column], Column] = lambda groups: groups
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups.

    The count of a pair of ids is the number of documents that hold it linked. n_best: links whose count is the highest
    of their id of A (n_best_b: of B); count_sum: the sum of the counts of the links. groups: the groups' ids as text
    (``Piece.texts``), or what ``keep`` makes of it before it is written.
    """
    id_type = docs.schema["doc_id"].dataType
    keyed = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")
    )  # ids as strings, for pandas would turn long ones into floating point beside a null
    blocks = materialize(_blocks(keyed, path_a, path_b, pattern).withColumn("groups", F.transform("groups", keep)), "aligned")
    size_b = tokenizers(path_a, path_b, pattern).size_b
    met = blocks.select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "x")).select("block", "at", "x.pair", "x.docs")
    counts = materialize(met.groupBy("pair").agg(F.sum("docs").alias("count")), "counts").withColumns(
        {"a": F.floor(F.col("pair") / size_b), "b": F.col("pair") % size_b}
    )
    most_a, most_b = (F.broadcast(counts.groupBy(s).agg(F.max("count").alias(f"most_{s}"))) for s in "ab")  # a row for each id at most
    best = sum(F.when(F.col("count") == F.col(f"most_{s}"), bit).otherwise(0) for s, bit in (("a", 1), ("b", 2)))
    known = counts.join(most_a, "a").join(most_b, "b").select("pair", (4 * F.col("count") + best).alias("value"))
    lists = met.select("block", "at", "pair").join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "value")).alias("x"))
    lists = lists.select("block", F.col("x.at").alias("place"), F.col("x.value").alias("value"))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                value = np.empty(len(r.place if r.place is not None else []), np.int64)
                if len(value):
                    value[r.place] = r.value
                sizes, n = np.asarray(r.starts), _unpacked(r.n, 1).astype(np.int64)
                ends = np.cumsum(sizes)
                at = np.cumsum(_unpacked(r.at, 2).astype(np.int64))
                # gaps start anew in each document
                at -= np.repeat(np.concatenate([[0], at])[ends - sizes], sizes)
                v = value[at]

                def sums(x: np.ndarray) -> np.ndarray:
                    total = np.concatenate([[0], np.cumsum(x)])
                    return total[ends] - total[ends - sizes]

                yield pd.DataFrame({
                    "doc_id": r.ids, "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": r.n_links, "n_best": sums(n * (v & 1)),
                    "n_best_b": sums(n * (v >> 1 & 1)), "count_sum": sums(n * (v >> 2)), "groups": r.groups,
                })

    numbers = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum"))
    kept = blocks.schema["groups"].dataType.elementType.simpleString()
    scored = blocks.drop("pair", "docs").join(lists, "block", "left").mapInPandas(score, f"doc_id string, {numbers}, groups {kept}")
    out = materialize(scored.withColumn("doc_id", F.col("doc_id").cast(id_type)), "links")
    drop_table(blocks)
    drop_table(counts)
    return out
