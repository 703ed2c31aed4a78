"""The language model's word contexts: distributions, order of words, copies, and that
words with and without numbers follow one formula."""

import numpy as np
import pytest

from vaultframe.llm import lm_hpyp


def test_predictive_sums_to_one():
    rng = np.random.default_rng(4)
    top = rng.dirichlet(np.ones(30))
    for level in (lm_hpyp.PAIR, lm_hpyp.WORD):
        c = rng.integers(0, 6, 30) * (rng.random(30) < 0.4)
        mean = np.zeros(30)
        for _ in range(3):  # averaged seatings
            some = c > 0
            t = np.zeros(30)
            t[some] = lm_hpyp.seat(rng, c[some].astype(float), np.full(some.sum(), 2.0), top[some], level[0])
            mean += t / 3
        p = lm_hpyp.predictive(c, mean, mean.sum(), c.sum(), top, level)
        assert p.min() > 0 and p.sum() == pytest.approx(1)


def made(spark):
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(80)])
    follow = rng.integers(0, 80, (80, 3))  # each word is followed by one of three
    rows = []
    for i in range(400):
        at, out = int(rng.integers(80)), []
        for _ in range(60):
            out.append(words[at])
            at = int(follow[at, rng.integers(3)])
        rows.append((i, " ".join(out)))
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows[:40]]
    odd = [" ".join(f"x{rng.integers(4000)}" for _ in range(40)) for _ in range(30)]
    copies = [(2000 + 2 * i + j, t) for i, t in enumerate(odd[:10]) for j in range(2)] + [(3000 + i, t) for i, t in enumerate(odd[10:])]
    return spark.createDataFrame(rows + shuffled + copies, "doc_id long, text string")


def test_order_matters_and_copies_stand_out(spark):
    out = lm_hpyp.scored(made(spark)).toPandas().set_index("doc_id")
    out["each"] = out.score / out.n_tokens
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.3 * held.n_tokens[held.index < 400].sum()
    first = out[(out.index < 40) & ~out.held_out]
    assert first.each.mean() > out[(out.index >= 1000) & (out.index < 1040)].each.mean() + 0.1
    learned = out[~out.held_out]
    twice, once = learned[(learned.index >= 2000) & (learned.index < 2020)], learned[learned.index >= 3000]
    both = twice[twice.groupby(twice.index // 2).each.transform("size") == 2]
    assert both.each.min() > once.each.max()


def test_words_without_numbers(spark):
    df = made(spark)
    whole = lm_hpyp.scored(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    for numbered in (0, 30):
        few = lm_hpyp.scored(df.repartition(3), numbered=numbered).toPandas().sort_values("doc_id").reset_index(drop=True)
        assert np.allclose(few.base_score, whole.base_score) and (few.n_known == whole.n_known).all()
        # Pairs without numbers have one table each, the others sampled ones.
        apart = np.abs((few.score - whole.score) / whole.n_tokens)
        assert apart.mean() < 0.03 and apart.max() < 0.2


def test_reruns_agree(spark):
    df = made(spark)
    a, b = (lm_hpyp.scored(df).toPandas().sort_values("doc_id").score.to_numpy() for _ in range(2))
    assert np.allclose(a, b, atol=1e-3)


def test_words_without_numbers_are_seated_by_sampling(spark):
    rng = np.random.default_rng(5)
    p = 1 / np.arange(1, 31)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(30)], 60, p=p / p.sum()))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, other, few = (lm_hpyp.scored(df, **k).toPandas().sort_values("doc_id").score.to_numpy() for k in ({}, {"seed": 2}, {"numbered": 5}))
    # No further apart than two seeds are, and to neither side; with one table a pair 0.75 and 0.25.
    assert np.abs(few - whole).mean() < 0.45 and abs((few - whole).mean()) < 0.15
    assert np.abs(other - whole).mean() < 0.45
