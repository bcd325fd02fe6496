"""The filter audit against a plain replay of each document under each order."""

import re
from collections import Counter
from itertools import permutations

from galerna.llm import audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    marks, least, out = {}, {}, {}
    for d, quality, toxic in labels:
        if d is not None:
            was = marks.get(d, (False, False))
            marks[d] = (was[0] or quality == 1, was[1] or toxic == 1)
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, s in rows:
        t, part = t or "", s or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d,
        }
        good, toxic = marks.get(d, (False, False))
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, f in enumerate(order, 1):
                c = out.setdefault((part, order, k), Counter())
                removed = fails[f] and not gone
                c["redundant"] += fails[f] and gone
                c["unique_fails"] += [x for x in "ABCDE" if fails[x]] == [f]
                c["good_lost"] += removed and good
                c["toxic_lost"] += removed and toxic
                c["removed"] += removed
                gone |= removed
                c["kept"] += not gone
    total = Counter()
    for (part, order, k), c in out.items():
        total[part, order[k - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {key: (*(c[n] for n in names), total[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


def test_audit(spark, edges, nothing):
    long = " ".join(f"word{k}" for k in range(80))
    more = [
        (50, long, "a"), (51, long, "a"), (51, long, None), (40, long, "b"), (None, long, "b"), (40, long, ""), (52, "A B " + long, "b"),
        (53, "x # " * 60, "b"), (54, "UP " * 60, "a"), (55, long + " $", "a"), (56, long + " $", "c"), (57, None, "c"),
    ]
    table = edges.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    marks = [(50, 1, 0), (51, 0, 1), (52, 1, 1), (53, None, 1), (54, 1, None), (56, 0, 0), (56, 1, 0), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, text string")
    rows = audit.audit(table, labels).collect()
    want = brute([(r.doc_id, r.text, r.source) for r in table.collect()], marks)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows} == want
    assert len(rows) == 600 * len({p for p, _, _ in want})
    assert rows[0].asDict().keys() >= {"kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"}
    assert audit.audit(nothing, labels).count() == 0
    assert {r.good_lost for r in audit.audit(table, labels.limit(0)).collect()} == {0}
