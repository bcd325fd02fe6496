import numpy as np

from galerna.llm import langid


def labels(score, penalty):
    k = score.shape[1]
    names = [str(j) for j in range(k)]
    return langid.Scorer(langid.Model(names, np.zeros((langid.BUCKETS, k)), np.ones((len(langid.SCRIPT_NAMES), k), bool))).labels(score, penalty)


def value(score, path, penalty):
    return score[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


def test_direct_switch_between_two_other_languages():
    score = np.array([(0.0, -1, -3)] * 10 + [(-3.0, -1, 0)] * 10)
    assert labels(score, 12.0).tolist() == [0] * 10 + [2] * 10


def test_penalties_large_against_the_scores():
    rng, every = np.random.default_rng(1), np.stack(np.meshgrid(*[range(3)] * 8), -1).reshape(-1, 8)
    plain = 0
    for t in range(300):
        # stretches of a language each, with a third one near the best
        score = rng.normal(size=(8, 3)) + np.repeat(rng.normal(size=(2, 3)) * 2, 4, axis=0)
        score -= score.max(axis=1, keepdims=True)
        penalty = (2.0, 4.0, 7.0)[t % 3]
        best = score[np.arange(8), every].sum(axis=1) - penalty * (np.diff(every, axis=1) != 0).sum(axis=1)
        got = labels(score, penalty)
        plain += len(set(got.tolist())) == 1
        assert abs(value(score, got, penalty) - best.max()) < 1e-9
    assert 0 < plain < 300
