"""Licenses and quality rules: plain Python against the DataFrame expressions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from galerna.llm import licenses, quality

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTES = [
    (20, "x Released under the MIT License. And under the mit license; CC BY-NC 4.0"), (21, "Licensed under the Apache License, Version 2.0"),
    (22, "This work is (c), licensed under the GNU Lesser General Public License version 3"), (23, "cc by nc cc by nc"),
    (24, "filler " * 100 + "licensed under something the apache license version 2 and more " + "filler " * 50),
    (25, "released under the terms of the license"), (26, "the gnu general public is not licensed " + "y " * 80 + "version 3"),
]


def brute(text):
    w = WORDS.findall((text or "").translate(LOWER))
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, best = {b for _, b in places}, 1.0 if places else 0.0
    sets = [set(t.text.split()) for t in licenses.TEMPLATES]
    found = []
    for k, t in enumerate(licenses.TEMPLATES):
        size = licenses.block_words(t)
        for s in range(0, len(w), size // 2):
            n = len(sets[k] & set(w[s : s + size]))
            if n / len(sets[k]) >= licenses.THRESHOLD - 1e-9:
                found.append((k, s, s + size, n / len(sets[k])))
    for k, s, e, score in found:
        best = max(best, score)
        # a template that, whole, would make this one match, and that fits better in the same words or in more of them
        better = [u for u, a, b, x in found if u != k and a <= s and b >= e and len(sets[u] & sets[k]) / len(sets[k]) >= licenses.THRESHOLD - 1e-9
                  and (round(x, 12), len(sets[u])) > (round(score, 12), len(sets[k]))]
        if not better:
            labels.add(licenses.TEMPLATES[k].label)
    first, last = (min(i for i, _ in places), max(i for i, _ in places)) if places else (None, None)
    return len(w), len(places), first, last, ",".join(sorted({b for _, b in places})), ",".join(sorted(labels)), round(best, 9)


def test_licenses(spark, edges, nothing):
    df = edges.unionByName(spark.createDataFrame(NOTES, "doc_id long, text string"), allowMissingColumns=True)
    rows = licenses.scan(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == brute(r.text), r.doc_id
    assert {r.doc_id: r.labels for r in rows if r.doc_id and r.doc_id > 20} | {26: ""} == {21: "apache-2", 22: "gpl-3", 23: "cc-by-nc", 24: "apache-2", 25: "", 26: ""}
    assert licenses.scan(nothing).count() == 0


def test_matches_keep_versions_and_labels_choose(spark):
    long = next(t.text for t in licenses.TEMPLATES if t.label == "mit" and len(t.text.split()) > 60)
    texts = [
        (1, "this work is licensed under the gnu general public license version 2"), (2, "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
        (3, "this work is licensed under a creative commons attribution 4 0 international license"),
        (4, "x " * 50 + long.replace("hereby", "") + " y" * 200), (5, "permission is granted free of charge to any person obtaining a copy of this software"),
    ]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {d: r.labels for d, r in rows.items()} == {1: "gpl-2", 2: "cc-by-sa", 3: "cc-by", 4: "mit", 5: "mit"}
    assert {(m.label, m.explained) for m in rows[1].matches} == {("gpl", True), ("gpl-3", True), ("gpl-2", False)}
    assert {m.label for m in rows[2].matches} == {"cc-by", "cc-by-nc", "cc-by-sa"}


def test_a_notice_gets_its_own_label_alone(spark):
    notice = {t.label: t.text for t in licenses.TEMPLATES if "this program" in t.text}
    sale = "under the agreement the seller will release the terms of sale once a driving license of the buyer is shown"
    filler = " ".join(f"w{k}" for k in range(300))
    texts = [(1, notice["gpl-3"]), (2, notice["gpl-2"]), (3, sale), (4, f"{filler} {notice['gpl-3']} {filler}"), (5, f"{notice['gpl-2']} {filler} {notice['gpl-3']}"), (6, "released under the terms of the license")]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {d: r.labels for d, r in rows.items()} == {1: "gpl-3", 2: "gpl-2", 3: "", 4: "gpl-3", 5: "gpl-2,gpl-3", 6: ""}
    assert all(licenses.least_of(t) >= licenses.LEAST_WORDS for t in licenses.TEMPLATES)
    with pytest.raises(ValueError, match="fewer than 8"):
        licenses.Join({"a": 1}, (licenses.Template("x", "a"),))


def measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, edges, nothing):
    more = [(30, "a b c a b c a b d a b c x"), (31, "one two three " * 40), (32, " ".join(f"w{i}" for i in range(60))), (33, " ".join(f"w{i}##" for i in range(60)))]
    df = edges.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    cascade = quality.Cascade.fit(df)
    assert {s[0] for s in cascade.statistics} == {r.name for r in quality.default_rules()}
    ratios = [s[2] / s[1] for s in cascade.statistics]
    assert ratios == sorted(ratios, reverse=True)
    rows = cascade.apply(df).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(r.text), r.doc_id
    kept = {r.doc_id for r in rows if r.kept}
    assert 32 in kept and not kept & {1, 2, 3, 4, 8, 30, 31, 33}
    turned = quality.Cascade(cascade.rules[::-1], []).apply(df).collect()
    assert [r.kept for r in turned] == [r.kept for r in rows]
    assert quality.Cascade.fit(nothing).apply(nothing).count() == 0


def test_a_rejected_text_meets_no_further_rule(spark, edges):
    fails = quality.Rule("fails", lambda m: F.raise_error(F.concat(F.lit("asked for "), m.n_words.cast("string"))).cast("boolean"))
    short = spark.createDataFrame([(1, "a b"), (2, None), (3, "c " * 49)], "doc_id long, text string")
    cascade = quality.Cascade([quality.default_rules()[0], fails], [])
    assert [r.rejected_by for r in cascade.apply(short).collect()] == ["few_words"] * 3
    assert short.filter(cascade.verdict().isNull()).count() == 0
    with pytest.raises(Exception, match="asked for 120"):
        spark.createDataFrame([(1, "a b " * 60)], "doc_id long, text string").filter(cascade.verdict().isNull()).count()


def test_the_verdict_of_a_text_alone_is_that_of_its_columns(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab!", "C##", "DD\n", "x y z\n", "w"][: k % 6 + 1]) + str(rng.randrange(60)) for _ in range(rng.randrange(30, 200))) for k in range(200)]
    texts += [" ".join(f"{k % m}" for k in range(90)) for m in (20, 40, 60, 80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cascade = quality.Cascade(quality.default_rules(), [])
    one = {r.doc_id: r.rejected_by for r in cascade.apply(df).collect()}
    assert {r.doc_id: r.v for r in df.select("doc_id", cascade.verdict().alias("v")).collect()} == one
    assert len(set(one.values())) > 3
