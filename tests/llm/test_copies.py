import random

import corpus_pipeline as C
from galerna.llm import copies


def jaccard(a, b):
    a, b = (set(copies.shingles(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts with edited copies around the threshold, chains of edits, shared passages, exact copies and empty texts."""
    rng = random.Random(3)
    passage = [f"common{k}" for k in range(40)]
    texts = []
    for t in range(25):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 60, 120, 200]))]
        words = words + passage if t % 3 == 0 else words
        texts.append(" ".join(words))
        for _ in range(6):
            for _ in range(rng.choice([1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return [*texts, *texts[:3], "", None, " \n", " ".join(passage)]


def test_components_are_those_of_all_pairs(spark):
    texts = planted()
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    got = dict(map(tuple, copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key").collect()))
    assert got == dict(enumerate(want))
    assert len(set(want)) < len(texts) / 2


def test_edited_copies_leave_the_stage(spark):
    words = [f"word{k}" for k in range(120)]
    # ten words in a row: 14 of 116 shingles change, similarity 102 / 130; eight: 104 / 128
    edited = [f"new{k}" if 50 <= k < 58 else w for k, w in enumerate(words)]
    further = [f"other{k}" if 20 <= k < 30 else w for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(further)), (4, "something else altogether")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, "").collect()) == [1, 3, 4]


def test_a_passage_in_a_tenth_of_the_texts_keeps_work_linear(spark, monkeypatch):
    """However many texts hold it, it leaves the prefixes of all that have other shingles, and no block is cut into tiles."""
    monkeypatch.setattr(copies, "TILE_TEXTS", 40)
    monkeypatch.setattr(copies, "SAMPLE_ROWS", 20)  # which does not see it often
    made = []
    real = copies._families

    def watched(nodes, several):
        made.append((nodes.selectExpr("max(size(prefix)) AS m").head().m, several.selectExpr("max(count) AS m").head().m or 0))
        return real(nodes, several)

    monkeypatch.setattr(copies, "_families", watched)
    rng = random.Random(5)
    for n in (600, 2400):
        texts = []
        for k in range(n):
            words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
            at = rng.randrange(40)
            texts.append(" ".join(words[:at] + ([f"boiler{j}" for j in range(12)] if k % 10 == 0 else []) + words[at:]))
        texts += [texts[7].replace(" w", " v", 1), texts[10] + " more"]
        got = dict(map(tuple, copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key").collect()))
        assert {k for k, c in got.items() if k != c} == {n, n + 1} and got[n] == 7 and got[n + 1] == 10
    assert all(most <= 40 for _, most in made), made


def test_nothing(spark):
    assert copies.near_copies(spark.createDataFrame([], "key long, text string"), "key").count() == 0
