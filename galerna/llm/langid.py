"""Language identification of mixed text: script ranges, per-word scores, Viterbi.

``fit`` counts letter n-grams (1 to 3 letters, word ends marked) of each language in a bounded sample of labelled
rows, hashed into a table of fixed size, and the share of each language's letters in each script. A word's score for
a language is the sum of the logarithms of its n-grams' smoothed frequencies; only languages that use the word's
script are candidates. Over the words of a text Viterbi finds the labelling of best total score less a penalty for
each change of language; runs of one label are the spans.

A text has one language all through, as most do, if no stretches of other languages can pay their penalties. Bounds of
what any stretch gains over the best language, of what one at an end of the text gains, and of what a labelling without that
language gains tell so with vectors, and they are safe; other texts take the word-by-word recursion.

Edge cases: a text that is null or has no letter (digits, fractions, superscripts and symbols are none) is ``und``
with score 0; ties go to the language first by name; with no labelled rows every text is ``und``; repeated rows get equal
results; very long texts and words are read whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galerna.llm.common import map_rows

#: Labelled rows of a language that ``fit`` takes at most (in expectation); the bound of the sample.
FIT_ROWS = 3000
BUCKETS = 1 << 16
GRAM_LETTERS = 3
SWITCH_PENALTY = 12.0
#: Least share of a language's letters in a script for the language to be a candidate there.
SCRIPT_SHARE = 0.01
WORDS_KEPT = 300_000
#: Score of a language that does not use the word's script.
NO_CANDIDATE = -1e3

#: First and last code point of ranges, by script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = (*dict.fromkeys(s for s, _, _ in SCRIPTS), "other")

#: Letters are characters of the Unicode categories L; marks after a letter (vowel signs, accents) belong to its word.
_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def _script_table() -> np.ndarray:
    """Number of the script of each code point."""
    out = np.full(0x110000, len(SCRIPT_NAMES) - 1, np.uint8)
    for name, first, last in SCRIPTS:
        out[first : last + 1] = SCRIPT_NAMES.index(name)
    return out


#: A word's script is that of its first letter (words do not mix scripts in practice).
SCRIPT_OF = _script_table()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _letters(unicodedata.normalize("NFC", text or "").lower())


@dataclass
class Grams:
    """The n-grams of words, ends marked, by arithmetic on code points: row n - 1 of ``buckets`` has the bucket of the
    n-gram that starts at each letter, or ``BUCKETS`` where the word ends before it."""

    buckets: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    scripts: np.ndarray

    @staticmethod
    def of(ws: list[str]) -> "Grams":
        code = np.frombuffer("".join([f"<{w}>" for w in ws]).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
        ends = np.cumsum(sizes)
        starts = ends - sizes
        left = np.repeat(ends, sizes) - np.arange(len(code))
        buckets, key = np.full((GRAM_LETTERS, len(code)), BUCKETS, np.int32), np.zeros(len(code), np.uint64)
        for n in range(1, GRAM_LETTERS + 1):
            key = (key[: len(code) - n + 1] + code[n - 1 :] + np.uint64(1)) * _MIX
            key ^= key >> np.uint64(31)
            inside = left[: len(key)] >= n
            buckets[n - 1, : len(key)][inside] = (key[inside] >> np.uint64(7)) % np.uint64(BUCKETS)
        return Grams(buckets, starts, sizes, SCRIPT_OF[code[starts + 1]])


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # BUCKETS x languages
    uses: np.ndarray  # scripts x languages, bool

    def scorer(self) -> "Scorer":
        """One for each process, so that its memory of words serves all tasks there."""
        if "_scorer" not in self.__dict__:
            self._scorer = Scorer(self)
        return self._scorer

    @staticmethod
    def fit(labelled: DataFrame, rows_a_language: int = FIT_ROWS) -> "Model":
        """``labelled`` has text, lang and (where known) row, a number of the row by which it is drawn: of a language with
        more than ``rows_a_language`` rows a sample is taken, the same however the table is laid out, and copies of one text
        do not come all or none. Without row the text itself is its number."""
        labelled = labelled.filter("text is not null and lang is not null")
        row = F.col("row") if "row" in labelled.columns else F.xxhash64("text")
        labelled = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string"), row.alias("row"))
        sizes = dict(labelled.groupBy("lang").count().collect())
        languages = sorted(sizes)
        if not languages:
            return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
        share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, rows_a_language / sizes[k]))))
        chance = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(1 << 30)) / float(1 << 30)
        sample = labelled.filter(chance < share[F.col("lang")])

        def count(langs: list, texts: list) -> Iterator[tuple]:
            found: dict[str, Counter] = {}
            for lang, text in zip(langs, texts):
                found.setdefault(lang, Counter()).update(words(text))
            for lang, c in found.items():
                if not c:
                    continue
                grams, times = Grams.of(list(c)), np.fromiter(c.values(), np.int64, len(c))
                n = sum(np.bincount(row, weights=np.repeat(times, grams.sizes), minlength=BUCKETS + 1) for row in grams.buckets)
                letters = np.bincount(grams.scripts, weights=times * (grams.sizes - 2), minlength=len(SCRIPT_NAMES))
                yield from ((lang, int(g), int(n[g])) for g in np.flatnonzero(n[:BUCKETS]))
                yield from ((lang, -1 - int(k), int(letters[k])) for k in np.flatnonzero(letters))

        counted = (
            map_rows(sample.select("lang", "text"), T.StructType.fromDDL("lang string, gram int, n long"), count)
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows a language at most
        )
        table, letters = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPT_NAMES), len(languages)))
        number = {k: i for i, k in enumerate(languages)}
        for lang, g, n in counted:
            (table if g >= 0 else letters)[g if g >= 0 else -1 - g, number[lang]] += n
        logs = np.log((table + 0.5) / (table.sum(0) + 0.5 * BUCKETS))
        return Model(languages, logs, letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1))


class Scorer:
    """Word scores and Viterbi, in a task."""

    def __init__(self, model: Model):
        self.model = model
        self.logs = np.concatenate([model.logs, np.zeros((1, len(model.languages)))])  # the last row is no n-gram
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def _add(self, fresh: list[str]) -> None:
        """Score new words, all together."""
        n, k, grams = len(self.number), len(fresh), Grams.of(fresh)
        score = sum(np.add.reduceat(self.logs[row], grams.starts, axis=0) for row in grams.buckets)
        score -= score.max(axis=1, keepdims=True)
        uses = self.model.uses[grams.scripts]
        score[~uses & uses.any(axis=1, keepdims=True)] = NO_CANDIDATE
        if n + k > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(k, len(self.table)), score.shape[1]))])
        self.table[n : n + k] = score
        self.number.update(zip(fresh, range(n, n + k)))

    def scores(self, ws: list[str]) -> np.ndarray:
        if len(self.number) > WORDS_KEPT:
            self.number.clear()
        at = list(map(self.number.get, ws))
        if None in at:
            self._add(list(dict.fromkeys(w for w, k in zip(ws, at) if k is None)))
            at = list(map(self.number.__getitem__, ws))
        return self.table[at]

    def labels(self, score: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
        """The best labelling: a language's number for each word."""
        n, k = score.shape
        best = int(score.sum(0).argmax())
        own = score - score[:, best : best + 1]
        gain = np.cumsum(np.concatenate([np.zeros((1, k)), own]), axis=0)
        stretch = np.sort((gain - np.minimum.accumulate(gain, axis=0)).max(axis=0))
        first, second = stretch[-1], stretch[-2] if k > 1 else 0.0
        edge = max(gain.max(), (gain[-1] - gain.min(axis=0)).max())
        # s stretches of other languages between two of the best one pay s + 1 penalties, at an end of the text s, and if
        # they are the whole text s - 1; neighbours differ, so that at most half of them have the language that gains most
        if first + max(second, edge) <= 2 * penalty and edge <= penalty and (k < 2 or np.delete(own, best, axis=1).max(axis=1).sum() <= penalty):
            return np.full(n, best)
        total, back = score[0].tolist(), []
        for row in score[1:].tolist():
            top = max(total)
            at = total.index(top)
            from_ = [j if total[j] >= top - penalty else at for j in range(k)]
            total = [total[j] + x if from_[j] == j else top - penalty + x for j, x in enumerate(row)]
            back.append(from_)
        out = [total.index(max(total))]
        for from_ in reversed(back):
            out.append(from_[out[-1]])
        return np.array(out[::-1])

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """(language of most letters, their share, spans of words: language, start, end)."""
        ws = words(text)
        if not ws or not self.model.languages:
            return "und", 0.0, []
        label = self.labels(self.scores(ws))
        letters = np.bincount(label, weights=[len(w) for w in ws], minlength=len(self.model.languages))
        top = int(letters.argmax())
        cut = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])).tolist()
        names = self.model.languages
        spans = [(names[label[a]], a, b) for a, b in zip(cut, [*cut[1:], len(ws)])]
        return names[top], float(letters[top] / letters.sum()), spans


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())]))


def identify(df: DataFrame, model: Model, key: Column | str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans number the words (runs of letters) of the text from 0."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        scorer = sent.value.scorer()
        for d, t in zip(ids, texts):
            lang, score, spans = scorer.predict(t)
            yield d, lang, score, [dict(zip(("lang", "start_word", "end_word"), s)) for s in spans]

    schema = T.StructType([
        df.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS),
    ])
    return map_rows(df.select(key, F.col(text).cast("string").alias("__text")), schema, rows)
