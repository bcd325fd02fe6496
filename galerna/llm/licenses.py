"""License scan: an exact set-similarity join of text blocks with license notices, in DataFrame expressions only.

Words are lower-cased runs of letters and digits. A block is a window of words, one at each half window; its size follows
the template (``block_words``), so that a whole notice lies in some block. A block matches a template if it holds at
least ``THRESHOLD`` of the template's distinct words; ``matches`` has all such pairs.

The tokens of the templates are ordered by their document frequency in the corpus, rarest first. With ``a`` the least
overlap, a match must share a token of the template's first ``|T| - a + 1`` and of the block's first ``|B| - a + 1``
tokens (prefix filter), the block must have ``a`` tokens (length filter), and after the first shared token enough must
be left on both sides (positional filter). What passes is verified. The filters lose nothing, and the join runs within
the row: its template side is the literal list of templates, so nothing is shuffled whatever the text's skew.

Notices of two versions, or a long notice and a short one, share most words, so that the one's block matches the other's
template as well. Such a match is marked ``explained``, and gives no label, where in the same words (its block, or a larger
block that holds it) a template that alone would make it match scores higher, or as high with more words: a text gets the
version that fits best, and both if they fit alike. No template matches by fewer than ``LEAST_WORDS`` words, which any prose may
hold by chance; shorter notices are phrases.

Edge cases: null texts count as empty; texts without words have no label and score 0; repeated rows get equal results;
very long texts are scanned whole; an empty table gives no rows; extra columns stay, and those named like a result are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galerna.llm.common import ascii_lower, whole_text

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Least overlap of a match in words.
LEAST_WORDS = 8
#: Least block; larger ones for templates of more than half of it.
BLOCK_WORDS = 64

#: Phrases that name a license wherever their words stand in a row.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: Notices in plain words.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
        "a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("gpl", "this work is licensed under the gnu general public license"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2"),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 2 of the license or at your option any later version",
    ),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    Template(
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are "
        "met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
)


def least_of(template: Template, threshold: float = THRESHOLD) -> int:
    """The least number of the template's distinct words in a matching block."""
    return math.ceil(threshold * len(set(template.text.split())) - 1e-9)


def block_words(template: Template) -> int:
    """Twice ``BLOCK_WORDS`` and so on until the template fits into half a block."""
    size = BLOCK_WORDS
    while size // 2 < len(template.text.split()):
        size *= 2
    return size


def rivals(templates: tuple[Template, ...], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(t, u): templates such that u, whole in a block, makes the block match t; u's block is as large as t's, or larger."""
    sets = [set(t.text.split()) for t in templates]
    return [
        (t, u) for t in range(len(sets)) for u in range(len(sets))
        if t != u and block_words(templates[t]) <= block_words(templates[u]) and len(sets[t] & sets[u]) >= least_of(templates[t], threshold)
    ]


def _of(value: Column, make) -> Column:
    """``make`` applied to ``value`` as a lambda's variable, so that it is evaluated once."""
    return F.transform(F.array(value), make)[0]


def normalized(text: Column) -> Column:
    """The words of a text, joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(whole_text(text)), GAPS, " "))


def _words(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _phrases(joined: Column, n_words: Column) -> Column:
    """n_base, first_word, last_word and base_labels, from the pieces between the places of each phrase."""
    padded = F.concat(F.lit(" "), joined, F.lit(" "))

    def one(p: Column, phrase: str) -> Column:
        spaces = lambda piece: F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))
        found = lambda pieces: F.struct(
            (F.size(pieces) - 1).cast("long").alias("n"),
            spaces(pieces[0]).cast("long").alias("first"),
            (n_words - (spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())).cast("long").alias("last"),
        )
        return F.when(F.contains(p, F.lit(f" {phrase} ")), _of(F.split(p, f" {phrase}(?= )"), found))

    def all_of(p: Column) -> Column:
        return F.struct(*(one(p, phrase).alias(f"p{k}") for k, (phrase, _) in enumerate(PHRASES)))

    def result(s: Column) -> Column:
        each = [s[f"p{k}"] for k in range(len(PHRASES))]
        labels = F.array_compact(F.array(*(F.when(e.isNotNull(), F.lit(label)) for e, (_, label) in zip(each, PHRASES))))
        return F.struct(
            sum((F.coalesce(e["n"], F.lit(0).cast("long")) for e in each), F.lit(0).cast("long")).alias("n_base"),
            F.least(*(e["first"] for e in each)).alias("first_word"),
            F.greatest(*(e["last"] for e in each)).alias("last_word"),
            labels.alias("labels"),
        )

    return _of(padded, lambda p: _of(all_of(p), result))


def token_frequencies(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """Document frequency of each token of the templates, over all texts."""
    tokens = sorted({w for t in templates for w in t.text.split()})
    held = F.array_intersect(F.split(normalized(F.col(text)), " "), F.array(*map(F.lit, tokens)))
    counts = df.select(F.explode(held).alias("token")).groupBy("token").count()
    return {w: 0 for w in tokens} | {r[0]: r[1] for r in counts.collect()}  # a row for each token at most


FOUND = "array<struct<t:int,start:bigint,size:int,n:int>>"
MATCHES = "array<struct<label:string,start_word:bigint,score:double,explained:boolean>>"


class Join:
    """Templates with their tokens as ranks in the frequency order (from 1)."""

    def __init__(self, frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.order = sorted(frequencies, key=lambda w: (frequencies[w], w))
        self.labels = [t.label for t in templates]
        if min((least_of(t, threshold) for t in templates), default=LEAST_WORDS) < LEAST_WORDS:
            raise ValueError(f"a template matches by fewer than {LEAST_WORDS} words")
        rank = {w: k + 1 for k, w in enumerate(self.order)}
        self.tokens = [sorted({rank[w] for w in t.text.split()}) for t in templates]
        self.least = [least_of(t, threshold) for t in templates]
        self.rivals = rivals(templates, threshold)
        self.sizes = {size: [k for k, t in enumerate(templates) if block_words(t) == size] for size in sorted(set(map(block_words, templates)))}

    def _ranks(self, some: list[int]) -> Column:
        return F.array(*(F.lit(r).cast("long") for r in some))

    def _prefix(self, k: int) -> list[int]:
        return self.tokens[k][: len(self.tokens[k]) - self.least[k] + 1]

    def _overlap(self, block: Column, k: int) -> Column:
        """How many tokens of template k the block (sorted ranks) holds, null below the least overlap."""
        own, size, least = self._ranks(self.tokens[k]), len(self.tokens[k]), self.least[k]
        shared = F.get(F.array_intersect(self._ranks(self._prefix(k)), F.slice(block, 1, F.greatest(F.size(block) - least + 1, F.lit(0)))), F.lit(0))
        left = lambda t: F.least(F.lit(size) - F.array_position(own, t), F.size(block) - F.array_position(block, t))
        positional = _of(shared, lambda t: t.isNotNull() & (1 + left(t) >= least))
        verified = _of(F.size(F.array_intersect(own, block)), lambda n: F.when(n >= least, n))
        return F.when(F.size(block) >= least, F.when(positional, verified))

    def _match(self, block: Column, start: Column, size: int, some: list[int]) -> Column:
        """The block's matches with the templates ``some``: template, start and size of the block, overlap."""

        def one(n: Column, k: int) -> Column:
            return F.when(n.isNotNull(), F.struct(F.lit(k).alias("t"), start.alias("start"), F.lit(size).alias("size"), n.alias("n")))

        each = lambda found: F.array_compact(F.array(*(one(found[at], k) for at, k in enumerate(some))))
        return _of(F.array(*(self._overlap(block, k) for k in some)), each)

    def _chosen(self, found: Column) -> Column:
        """MATCHES of all that the blocks have: with labels and scores, and whether another match explains it."""
        n_templates = len(self.tokens)
        sizes = F.array(*(F.lit(len(t)) for t in self.tokens))
        labels = F.array(*map(F.lit, self.labels))
        pairs = F.array(*(F.lit(t * n_templates + u) for t, u in self.rivals)) if self.rivals else F.array().cast("array<int>")

        def explains(m: Column, x: Column) -> Column:
            ours, theirs = sizes[m["t"]], sizes[x["t"]]
            holds = (x["start"] <= m["start"]) & (x["start"] + x["size"] >= m["start"] + m["size"])
            better = (x["n"] * ours > m["n"] * theirs) | ((x["n"] * ours == m["n"] * theirs) & (theirs > ours))
            return holds & F.array_contains(pairs, m["t"] * n_templates + x["t"]) & better

        return F.transform(found, lambda m: F.struct(
            labels[m["t"]].alias("label"), m["start"].alias("start_word"), (m["n"] / sizes[m["t"]]).alias("score"), F.exists(found, lambda x: explains(m, x)).alias("explained")
        ))

    def matches(self, words: Column) -> Column:
        """All matches of the blocks of an array of words."""
        order = F.array(*map(F.lit, self.order))
        none = F.array().cast(FOUND)

        def of_size(ws: Column, size: int, some: list[int]) -> Column:
            rarest = F.array(*(F.lit(self.order[r - 1]) for r in sorted({r for k in some for r in self._prefix(k)})))

            def block(start: Column) -> Column:
                def ranked(w: Column) -> Column:
                    ranks = F.filter(F.transform(w, lambda x: F.array_position(order, x)), lambda r: r > 0)
                    return _of(F.array_sort(F.array_distinct(ranks)), lambda b: self._match(b, start, size, some))

                window = F.slice(ws, (start + 1).cast("int"), size)
                return _of(window, lambda w: F.when(F.arrays_overlap(w, rarest), ranked(w)).otherwise(none))

            starts = F.sequence(F.lit(0).cast("long"), F.size(ws).cast("long") - 1, F.lit(size // 2).cast("long"))
            return F.when((F.size(ws) > 0) & F.arrays_overlap(ws, rarest), F.flatten(F.transform(starts, block))).otherwise(none)

        every = _of(words, lambda ws: F.concat(*(of_size(ws, size, some) for size, some in self.sizes.items())))
        return _of(every, lambda found: F.when(F.size(found) > 0, self._chosen(found)).otherwise(F.array().cast(MATCHES)))


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and ``matches`` (see ``MATCHES``).

    base_labels and labels are sorted and comma-joined; explained matches give no label. score is the largest share of
    a template's words in a matching block; a whole phrase counts as 1.
    """
    join = Join(token_frequencies(df, templates, text), templates, threshold)

    def row(joined: Column) -> Column:
        def with_words(words: Column) -> Column:
            n = F.size(words).cast("long")
            return F.struct(n.alias("n_words"), _phrases(joined, n).alias("base"), join.matches(words).alias("matches"))

        return _of(_words(joined), with_words)

    out = df.withColumn("__scan", _of(normalized(F.col(text)), row))
    base, matches = F.col("__scan.base"), F.col("__scan.matches")
    of_method = F.transform(F.filter(matches, lambda m: ~m["explained"]), lambda m: m["label"])
    best = F.when(base["n_base"] > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(matches, lambda m: m["score"])), F.lit(0.0)))
    return out.withColumns({
        "n_words": F.col("__scan.n_words"), "n_base": base["n_base"], "first_word": base["first_word"], "last_word": base["last_word"],
        "base_labels": F.array_join(F.array_sort(F.array_distinct(base["labels"])), ","),
        "labels": F.array_join(F.array_sort(F.array_union(base["labels"], of_method)), ","),
        "score": best, "matches": matches,
    }).drop("__scan")
