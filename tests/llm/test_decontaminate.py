import random

import pytest

from galerna.llm import decontaminate as D


def slow_align(item, passage):
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if a == b else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best / (D.MATCH * len(item))


def test_alignment():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.choice("abcde") for _ in range(rng.randrange(1, 15))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(1, 25))]
        score, start, end = D.align(a, b)
        assert score == slow_align(a, b)
        if score:
            assert slow_align(a, b[start:end]) == score
    assert D.align([], ["a"])[0] == D.align(["a"], [])[0] == 0.0


def test_copies_and_edits_are_found_and_others_left(spark, edges, nothing, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(20)] + [["tiny", "item"]]
    noise = lambda n: [word() for _ in range(n)]
    docs, want = [], set()
    for k, item in enumerate(items[:20]):
        edited = list(item)
        for at in rng.sample(range(30), 5):
            edited[at] = word()
        docs += [(100 + k, " ".join(noise(50) + item + noise(50))), (200 + k, " ".join(noise(9) + edited + noise(9))), (300 + k, " ".join(noise(120)))]
        want |= {(100 + k, k), (200 + k, k)}
    docs += [(400, "a Tiny, item!")] + [(500 + j, " ".join(items[0])) for j in range(200)]  # a passage that many documents hold
    want |= {(400, 20)} | {(500 + j, 0) for j in range(200)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(edges.select("doc_id", "text"))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    rows = D.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(r.score == 1.0 and r.end_word - r.start_word == 30 for r in rows if 100 <= r.doc_id < 120)
    assert D.contaminated(nothing, bench).count() == 0 and D.contaminated(frame, bench.limit(0)).count() == 0
    monkeypatch.setattr(D, "MAX_BITS", 64)  # a filter that passes nearly all windows
    assert {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()} == want


def test_seeds_survive_a_fifth_of_edits():
    for n in range(1, 200):
        edits = n // 5
        # edits spread so that the longest run is as short as can be
        runs = [(n - edits + k) // (edits + 1) for k in range(edits + 1)]
        assert sum(runs) == n - edits and max(runs) >= D.seed_words(n)


def test_recall_by_length_and_edits_and_brute_force(spark):
    """All pairs that whole Smith-Waterman finds are found, for items of 5 to 60 words and up to a fifth of edits."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items, docs, planted = [], [], {}
    for n in (5, 6, 8, 10, 12, 15, 20, 40, 60):
        for share in (0.0, 0.1, 0.2):
            for _ in range(6):
                item, k = [word() for _ in range(n)], len(items)
                copy = list(item)
                for at in rng.sample(range(n), int(n * share)):
                    copy[at] = word()
                items.append(item)
                docs.append([word() for _ in range(30)] + copy + [word() for _ in range(30)])
                planted.setdefault((n, share), []).append((k, k))
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()}
    recall = {key: sum(p in got for p in pairs) / len(pairs) for key, pairs in planted.items()}
    assert min(recall.values()) == 1.0, recall
    some = rng.sample(range(len(items)), 25)
    brute = {(d, i) for d in some for i in some if D.align(items[i], docs[d])[0] >= D.MIN_SCORE}
    assert {p for p in got if p[0] in some and p[1] in some} == brute


@pytest.mark.parametrize("vocabulary", [20, 60, 400])
def test_recall_where_seeds_are_common(spark, vocabulary):
    """Items and texts of the same few words, so that most seeds are found everywhere and none is rare."""
    rng = random.Random(vocabulary)
    names = [f"w{k}" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    some = lambda n: rng.choices(names, weights, k=n)
    items, docs, planted = [], [], []
    for n in (9, 12, 16, 25, 40):
        for share in (0.0, 0.1, 0.2):
            for _ in range(4):
                item = some(n)
                copy = list(item)
                for at in rng.sample(range(n), int(n * share)):
                    copy[at] = rng.choice(names)
                planted.append((len(items), len(items)))
                items.append(item)
                docs.append(some(40) + copy + some(40))
    docs += [some(200) for _ in range(100)]
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(frame, bench).collect()}
    assert all(p in got for p in planted)
    pairs = [(d, i) for d in rng.sample(range(len(docs)), 20) for i in range(len(items))]
    brute = {(d, i): s for d, i in pairs if (s := D.align(items[i], docs[d])[0]) >= D.MIN_SCORE}

    def seeded(d, i):
        """Whether the best alignment holds a seed, so that the pair is one that the method promises."""
        _, start, end = D.align(items[i], docs[d])
        n, part = D.seed_words(len(items[i])), docs[d][start:end]
        grams = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
        return any(tuple(items[i][k : k + n]) in grams for k in range(len(items[i]) - n + 1))

    promised = [p for p in brute if seeded(*p)]
    assert promised and all(p in got for p in promised)
    assert all(got[p] <= brute[p] + 1e-9 for p in brute if p in got)


def test_the_bound_is_safe():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(1, 14))] for _ in range(2))
        if D.align(a, b)[0] >= D.MIN_SCORE:
            assert D.may_reach(a, b, D.MIN_SCORE)


def test_rows_of_one_id_or_none(spark):
    text = " ".join(f"word{k}" for k in range(20))
    frame = spark.createDataFrame([(None, text), (None, text), (1, text), (1, "clean text of another kind altogether")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (5, text), (5, "x " + text)], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in D.contaminated(frame, bench).collect())
    assert got == sorted((d, i) for d in ("None", "None", "1") for i in ("None", "5", "5"))
