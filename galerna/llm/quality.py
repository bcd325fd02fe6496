"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a predicate over a ``Source`` of measures, each of them an expression of its own. ``Cascade.fit`` runs every
rule alone on a random sample and takes its cost (seconds) and selectivity (share rejected), and orders the rules by
rejection per cost; ``Cascade.verdict`` is one nested CASE in that order, so that a rule's measures are computed only for
texts that all rules before it passed. The order changes the work, never the verdict.

Edge cases: a null or empty text has no words and fails the rule on the least number of words; equal rows get equal
results; very long texts are read whole; an empty table has rules in their given order and no rows; ``apply`` and
``measures`` keep extra columns and replace those named like a result, ``verdict`` adds no column at all.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galerna.llm.common import WORD, drop_table, materialize, whole_text

SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"

#: Thresholds of the method's own rules, per word or per letter.
MAX_SYMBOLS_PER_WORD = 0.2
MAX_MARKS_PER_WORD = 0.2
MAX_CAPITALS = 0.3
MAX_DUPLICATE_LINES = 0.5
MAX_CHARS_PER_WORD = 40.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows of the sample, in expectation.
SAMPLE_ROWS = 2000


def _of(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of ``value`` as a lambda's variable, which is evaluated once."""
    return F.transform(F.array(value), make)[0]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _windows(words: Column) -> Column:
    """A 64-bit hash of each window of three words; windows are compared within one text only."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )


def _covered_by(hashes: Column) -> Column:
    """Words in the windows whose hash occurs twice or more: these are sorted with their places, and the places of
    equal neighbours are merged as intervals of three."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))

    def length(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    places = _of(placed, lambda s: F.array_sort(F.transform(repeated(s), lambda x: x["i"])))
    return _of(places, length)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more; in most texts all windows differ, and none need sorting."""
    own = _of(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered_by(h)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(own).cast("long")


def _repeats_exceed(words: Column, n_words: Column) -> Column:
    """Whether the words in repeated windows exceed ``MAX_REPEAT_PERCENT``.

    A hash that occurs m times stands for 3 m words at most and leaves m - 1 of the windows out of the distinct
    ones, so that six times the windows left out bound the words; where the bound suffices nothing is sorted.
    """
    most = MAX_REPEAT_PERCENT * n_words
    return F.when(F.size(words) < 3, F.lit(False)).otherwise(_of(
        _windows(words), lambda h: F.when(600 * (F.size(h) - F.size(F.array_distinct(h))) <= most, F.lit(False)).otherwise(100 * _covered_by(h) > most)
    ))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))


def _dup_lines(text: Column) -> Column:
    return _of(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


@dataclass(frozen=True)
class Source:
    """Measures of a text, as expressions that a rule reads or leaves alone."""

    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_lines: Column
    n_marks: Column
    n_capitals: Column
    repeats_exceed: Column

    @staticmethod
    def of_text(text: Column, words: Column) -> "Source":
        n = F.size(words).cast("long")
        return Source(
            n, F.length(F.translate(text, BLANKS, "")).cast("long"), _count(text, SYMBOLS), _dup_lines(text), F.size(_lines(text)),
            _count(text, "[!?]"), _count(text, "[A-Z]"), _repeats_exceed(words, n),
        )

    @staticmethod
    def of_columns(text: Column) -> "Source":
        """Measures that ``measures`` has added are read, the others are computed where a rule asks for them."""
        n = F.col("n_words")
        return Source(
            n, F.col("word_chars"), F.col("n_symbols"), F.col("n_dup_lines"), F.size(_lines(text)), _count(text, "[!?]"), _count(text, "[A-Z]"),
            100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        )


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""

    def row(x: Column) -> Column:
        def bound(w: Column) -> Column:
            m = Source.of_text(x, w)
            return F.struct(
                m.n_words.alias("n_words"), m.word_chars.alias("word_chars"), m.n_symbols.alias("n_symbols"),
                m.n_dup_lines.alias("n_dup_lines"), _repeat_words(w).alias("n_repeat_words"),
            )

        return _of(_words(x), bound)

    out = df.withColumn("__quality", _of(whole_text(F.col(text)), row))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.withColumns({n: F.col(f"__quality.{n}") for n in names}).drop("__quality")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Source], Column]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def default_rules() -> list[Rule]:
    a_word = lambda m: F.greatest(m.n_words, F.lit(1))
    return [
        Rule("few_words", lambda m: m.n_words < MIN_WORDS),
        Rule("repeats", lambda m: m.repeats_exceed),
        Rule("symbols", lambda m: m.n_symbols > MAX_SYMBOLS_PER_WORD * a_word(m)),
        Rule("marks", lambda m: m.n_marks > MAX_MARKS_PER_WORD * a_word(m)),
        Rule("capitals", lambda m: m.n_capitals > MAX_CAPITALS * F.greatest(m.word_chars, F.lit(1))),
        # lines are counted only where some are repeated
        Rule("duplicate_lines", lambda m: F.when(m.n_dup_lines == 0, F.lit(False)).otherwise(m.n_dup_lines > MAX_DUPLICATE_LINES * m.n_lines)),
        Rule("long_words", lambda m: m.word_chars > MAX_CHARS_PER_WORD * a_word(m)),
    ]


@dataclass(frozen=True)
class Cascade:
    rules: list[Rule]
    #: Name, seconds on the sample beyond those of its words alone, and share rejected, of each rule in its order.
    statistics: list[tuple[str, float, float]]

    @staticmethod
    def fit(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> "Cascade":
        """Measure cost and selectivity on a random sample of ``sample_rows`` rows and order by rejection per cost."""
        rules = rules or default_rules()
        share = min(1.0, sample_rows / max(df.count(), 1))
        sample = df.select(text) if share == 1.0 else df.select(text).sample(share, seed=1)
        sample = materialize(sample.repartition(1), "sample")  # of the sampled rows alone
        total, found = max(sample.count(), 1), []

        def took(condition: Callable[[Source], Column]) -> tuple[float, int]:
            began = time.perf_counter()
            n = sample.filter(_over_text(text, condition)).count()
            return time.perf_counter() - began, n

        for rule in rules:  # compiled code and touched memory, for all alike
            took(rule.rejects)
        words_alone, _ = took(lambda m: m.n_words < 0)
        for rule in rules:
            seconds, rejected = took(rule.rejects)
            found.append((rule.name, max(seconds - words_alone, 1e-3), rejected / total))
        drop_table(sample)
        order = sorted(range(len(rules)), key=lambda k: -found[k][2] / found[k][1])
        return Cascade([rules[k] for k in order], [found[k] for k in order])

    def case(self, source: Source) -> Column:
        """The name of the first rule that rejects, else null."""
        verdict = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            verdict = F.when(F.coalesce(rule.rejects(source), F.lit(False)), F.lit(rule.name)).otherwise(verdict)
        return verdict

    def verdict(self, text: str = "text") -> Column:
        """``case`` of a column of texts, with nothing computed that the verdict does not need."""
        return _over_text(text, self.case)

    def apply(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add the measures, ``rejected_by`` and ``kept``."""
        verdict = self.case(Source.of_columns(whole_text(F.col(text))))
        return measures(df, text).withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def _over_text(text: str, make: Callable[[Source], Column]) -> Column:
    return _of(whole_text(F.col(text)), lambda x: _of(_words(x), lambda w: make(Source.of_text(x, w))))
