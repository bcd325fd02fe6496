import numpy as np

from galerna.llm import langid

TEXTS = {
    "en": "the house with the garden that they have and what is there for the people of this town which was not the best",
    "fr": "la maison avec le jardin que nous avons et ce qui est pour les gens de cette ville qui ne sont pas les meilleurs",
    "ru": "дом с садом который у нас есть и что там для людей этого города которые не были лучшими в мире",
}


def fitted(spark):
    rows = [(t, k) for k, t in TEXTS.items() for _ in range(5)] + [(None, "en"), ("no label", None)]
    return langid.Model.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_and_edges(spark, edges, nothing):
    model = fitted(spark)
    s = langid.Scorer(model)
    mixed = f"{TEXTS['en']} {TEXTS['fr']} {TEXTS['ru']}"
    lang, score, spans = s.predict(mixed)
    assert [x[0] for x in spans] == ["en", "fr", "ru"] and spans[0][1] == 0 and 0 < score < 1
    for k, t in TEXTS.items():
        assert s.predict(t)[:2] == (k, 1.0)
    rows = {r.doc_id: r for r in langid.identify(edges, model).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (1, 2, 3, 6))
    assert all(0 <= r.score <= 1 for r in rows.values()) and langid.identify(edges, model).count() == edges.count()
    assert langid.identify(nothing, model).count() == 0
    empty = langid.Model.fit(nothing)
    assert {r.lang_pred for r in langid.identify(edges, empty).collect()} == {"und"}


def plain_scorer(k):
    return langid.Scorer(langid.Model(list("abcd"[:k]), np.zeros((langid.BUCKETS, k)), np.ones((len(langid.SCRIPT_NAMES), k), bool)))


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(0)
    plain = 0
    for k, n, cases in ((3, 7, 16_000), (4, 5, 4_000)):
        s, every = plain_scorer(k), np.stack(np.meshgrid(*[range(k)] * n), -1).reshape(-1, n)
        switches, places = (np.diff(every, axis=1) != 0).sum(axis=1), np.arange(n)
        for t in range(cases):
            penalty = (0.5, 1.5, 4.0, 12.0)[t % 4]
            score = rng.normal(size=(n, k)) * rng.choice([0.5, 2.0, 6.0])
            if t % 2:  # halves of two languages beside a third that is near in both
                score[: n // 2, 0] += 3
                score[n // 2 :, 1] += 3
                score[:, 2] += 1
            got = s.labels(score, penalty)
            value = score[places, got].sum() - penalty * (np.diff(got) != 0).sum()
            assert abs(value - (score[places, every].sum(axis=1) - penalty * switches).max()) < 1e-9
            plain += len(set(got.tolist())) == 1
    assert 2_000 < plain < 18_000


def bucket(gram):
    key, mask = 0, (1 << 64) - 1
    for c in gram:
        key = (key + ord(c) + 1) * 0x9E3779B97F4A7C15 & mask
        key ^= key >> 31
    return (key >> 7) % langid.BUCKETS


def test_word_scores_by_their_definition(spark):
    model = fitted(spark)
    s = langid.Scorer(model)
    ws = ["house", "été", "дом", "z", "किताब", "😀x", "a" * 5000]
    for w, got in zip(ws, s.scores(ws)):
        parts = [f"<{w}>"[i : i + n] for n in (1, 2, 3) for i in range(len(w) + 3 - n)]
        want = sum(model.logs[bucket(g)] for g in parts)
        want = want - want.max()
        uses = model.uses[langid.SCRIPT_OF[ord(w[0])]]
        want = np.where(uses | ~uses.any(), want, langid.NO_CANDIDATE)
        assert np.allclose(got, want)


def test_counts_of_the_fit(spark):
    model = fitted(spark)
    table = np.zeros((langid.BUCKETS, 3))
    for k, lang in enumerate(model.languages):
        for w in langid.words(TEXTS[lang]):
            for n in (1, 2, 3):
                for i in range(len(w) + 3 - n):
                    table[bucket(f"<{w}>"[i : i + n]), k] += 5
    assert np.allclose(model.logs, np.log((table + 0.5) / (table.sum(0) + 0.5 * langid.BUCKETS)))


def test_letters():
    assert langid.words("½ ² ① 12 _ — ☃ ١٢") == []
    assert langid.words("हिन्दी भाषा l'été x²y") == ["हिन्दी", "भाषा", "l", "été", "x", "y"]
    assert plain_scorer(3).predict("½ ² ① ٣")[:2] == ("und", 0.0)


def test_held_out_accuracy(spark):
    from galerna.llm.queries import op4_langid

    sf = "/root/testdata/sf0.001"
    got = op4_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9
