"""Toxicity: neighbours, votes and scores against plain dictionaries; held-out accuracy on planted texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galerna.llm import queries, toxicity
from galerna.llm.common import held_out


def brute_choose(sample):
    n = Counter(y >= 0.5 for _, y in sample)
    held = {y: Counter(t for text, z in sample if (z >= 0.5) == y for t in toxicity.terms(text)) for y in (True, False)}
    out = set()
    for t, a in held[True].items():
        b, g = held[False][t], 0.0
        for k, of, total in ((a, a + b, n[True]), (b, a + b, n[False]), (n[True] - a, len(sample) - a - b, n[True]), (n[False] - b, len(sample) - a - b, n[False])):
            g += 2 * k * math.log(k * len(sample) / (of * total)) if k else 0.0
        if a + b >= toxicity.LEAST_HELD and a * n[False] > b * n[True] and g >= toxicity.TELLING:
            out.add(t)
    return out if n[True] and n[False] else set()


def counts(text, chosen):
    return Counter(p for w in toxicity._words((text or "").lower()) for p in toxicity.pieces(w) if p in chosen)


def brute(docs, labels):
    """(score, evidence) for each of ``docs`` (doc_id, text), in their order."""
    known = defaultdict(float)
    for d, y in labels:
        if y is not None and d is not None:
            known[d] = max(known[d], float(y == 1))
    by_text = defaultdict(list)
    for d, t in docs:
        if d in known and zlib.crc32(str(d).encode()) % 5:
            by_text[t or ""].append((d, known[d]))
    examples = sorted((min(d for d, _ in x), t, sum(y for _, y in x) / len(x)) for t, x in by_text.items())
    chosen = brute_choose([(t, y) for _, t, y in examples])
    df = Counter(t for _, text in docs for t in counts(text, chosen))

    def unit(text):
        v = {t: (1 + math.log(n)) * math.log((1 + len(docs)) / (1 + df[t])) for t, n in counts(text, chosen).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else {}

    vectors = [unit(t) for _, t, _ in examples]
    share = sum(y for *_, y in examples) / len(examples) if examples else 0.0

    def near(v, without=None):
        found = [(sum(x * u.get(t, 0.0) for t, x in v.items()), k) for k, u in enumerate(vectors) if k != without]
        found = sorted(((c, k) for c, k in found if c > 1e-12), key=lambda x: (-round(x[0], 9), x[1]))
        return [x for x in found if x[0] >= found[min(len(found), toxicity.NEIGHBOURS) - 1][0] - 2e-9] if found else []

    def vote(found):
        w = [1 / (1 - min(c, 1.0) + toxicity.NEAR) for c, _ in found]
        return (sum(x * examples[k][2] for x, (_, k) in zip(w, found)) + toxicity.PRIOR * share) / (sum(w) + toxicity.PRIOR)

    own = [(round(vote(f), 9), examples[k][2]) for k, v in enumerate(vectors) if (f := near(v, k))]
    values = sorted({v for v, _ in own})
    sums = [(sum(y for w, y in own if w == v), sum(1 for w, _ in own if w == v)) for v in values]

    def fitted(k):
        """Least squares by its formula: the greatest over starts of the least over ends of means."""
        s, n = (np.cumsum([0, *(x[i] for x in sums)]) for i in (0, 1))
        return max(min((s[e] - s[b]) / (n[e] - n[b]) for e in range(k + 1, len(sums) + 1)) for b in range(k + 1))

    steps = [fitted(k) for k in range(len(values))]
    bare = [y for (_, _, y), v in zip(examples, vectors) if not v]
    out = []
    for _, text in docs:
        found = near(unit(text))
        score = (sum(bare) + share) / (len(bare) + 1) if examples else 0.0
        if found:
            score = float(np.interp(vote(found), values, steps)) if own else vote(found)
        out.append((score, [(examples[k][0], c) for c, k in found[: toxicity.NEIGHBOURS]]))
    return out


def compare(rows, docs, labels):
    want = defaultdict(list)
    for (d, t), (s, near) in zip(docs, brute(docs, labels)):
        want[d].append((round(s, 6), [(e, round(c, 6)) for e, c in near]))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((round(r.score, 6), [(e.example, round(e.cosine, 6)) for e in r.evidence]))
    assert got.keys() == want.keys()
    for d in want:
        for (s, near), (s2, near2) in zip(sorted(got[d]), sorted(want[d])):
            assert s == pytest.approx(s2, abs=2e-6), d
            assert [c for _, c in near] == pytest.approx([c for _, c in near2], abs=2e-6), d
            assert sorted(e for e, c in near if c > near[-1][1] + 1e-6) == sorted(e for e, c in near2 if c > near2[-1][1] + 1e-6), d


def planted(rng, n):
    """Texts of invented words; the toxic ones hold an insult or a word of a stem."""
    syllables = ["ta", "ro", "mi", "ne", "lu", "sch", "ka", "po", "ver", "it"]
    rows = []
    for d in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grobian", "Lump!", "qxz" + rng.choice(syllables) + rng.choice(syllables)]))
        rows.append((d, " ".join(w), int(toxic)))
    return rows


def test_scores_and_accuracy(spark, edges, nothing):
    rows = planted(random.Random(2), 900)
    labels = [(d, y) for d, _, y in rows if d % 2] + [(1, None), (3, 1), (3, 0), (99_999, 1), (None, 1)]
    extra = [(8, "the same text here twice over"), (700_000, rows[20][1]), (700_001, rows[21][1]), (5, "again")]
    df = edges.withColumn("doc_id", F.col("doc_id") + 100_000).unionByName(spark.createDataFrame([(d, t) for d, t, _ in rows] + extra, "doc_id long, text string"), allowMissingColumns=True)
    train = ~held_out(F.col("doc_id"), 5, 0)
    marks = spark.createDataFrame([(d, y, "x") for d, y in labels], "doc_id long, toxic int, text string")
    got = toxicity.score(df, train, marks).collect()
    compare(got, [(r.doc_id, r.text) for r in df.collect()], labels)
    truth = {d: y for d, _, y in rows}
    unseen = [(r.score >= 0.5, truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id != 5 and (r.doc_id % 2 == 0 or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)]
    hit = Counter((bool(y), p) for p, y in unseen)
    assert hit[True, True] >= 0.9 * (hit[True, True] + hit[True, False]) and hit[False, True] <= 0.02 * len(unseen), hit
    assert toxicity.score(nothing, train, marks).count() == 0
    assert {r.score for r in toxicity.score(df, train, marks.limit(0)).collect()} == {0.0}


def test_index_is_exact():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 700):
        vectors = []
        for _ in range(n):
            at = np.flatnonzero(rng.random(60) < rng.choice([0.02, 0.1, 0.3]))
            w = rng.integers(1, 4, len(at)).astype(float)
            vectors.append((at, w / np.sqrt((w * w).sum()) if len(at) else w))
        index = toxicity.Index(vectors, 60)
        full = np.zeros((n, 60))
        for k, (at, w) in enumerate(vectors):
            full[k, at] = w
        for _ in range(60):
            at = np.flatnonzero(rng.random(60) < 0.15)
            q = np.zeros(60)
            q[at] = rng.random(len(at)) if rng.random() < 0.5 else 1.0
            q /= max(np.sqrt((q * q).sum()), 1e-9)
            without = int(rng.integers(-1, n))
            every = full @ q
            if without >= 0:
                every[without] = 0
            best = np.sort(every[every > 0])[::-1]
            found, cosine = index.nearest(at, q[at], without)
            if not len(best):
                assert not len(found)
                continue
            least = best[min(len(best), toxicity.NEIGHBOURS) - 1]
            assert set(found.tolist()) == set(np.flatnonzero((every >= least - 1e-9) & (every > 0)).tolist())
            assert np.allclose(cosine, np.minimum(every[found], 1.0))


def test_examples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EXAMPLES", 60)
    rows = planted(random.Random(3), 2000)
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    found = toxicity.examples(df, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")).collect()
    n = Counter(r.toxic >= 0.5 for r in found)
    assert 30 < n[True] < 100 and 30 < n[False] < 100
    assert sum(r.stands for r in found) == pytest.approx(2000, rel=0.3)


def test_query(spark):
    at = "/root/testdata/sf0.01"
    rows = queries.queries()["op13_toxicity"](spark, at).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic").collect()]
    compare(rows, docs, labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
