"""Forward-backward over blocks against one line after another."""

import numpy as np

from vaultframe.llm import quality_crf


def by_hand(score, pair, first):
    p, expected = np.zeros(len(score)), np.zeros((2, 2))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        n = hi - lo
        if not n:
            continue
        node = np.stack([np.zeros(n), score[lo:hi]], axis=1)
        ahead, back = node.copy(), np.zeros((n, 2))
        for t in range(1, n):
            ahead[t] += np.logaddexp(*(ahead[t - 1][:, None] + pair))
        for t in range(n - 2, -1, -1):
            back[t] = np.logaddexp(*(pair + node[t + 1] + back[t + 1]).T)
        z = np.logaddexp(*ahead[-1])
        p[lo:hi] = np.exp(ahead[:, 1] + back[:, 1] - z)
        for t in range(1, n):
            expected += np.exp(ahead[t - 1][:, None] + pair + node[t] + back[t] - z)
    return p, expected


def test_long_and_short_chains():
    rng = np.random.default_rng(2)
    for sizes in ([0, 1, 5000, 0, 3, 64, 65, 1], [1], [0, 0], [9000]):
        first = np.concatenate([[0], np.cumsum(sizes)])
        score, pair = rng.normal(0, 4, first[-1]), rng.normal(0, 1.5, (2, 2))
        p, e = quality_crf.marginals(score, pair, first)
        q, f = by_hand(score, pair, first)
        assert np.allclose(p, q, atol=1e-8) and np.allclose(e, f, atol=1e-5)


def test_sample_is_bounded_and_whole(spark, docs, labels):
    known = labels.filter("quality is not null").selectExpr("doc_id", "cast(quality as int) as good").distinct()
    few = quality_crf.sampled(docs, known, "good", 4000, 40_000).collect()
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert 2 <= len(few) < 4000 and all(r.text == whole[r.doc_id] for r in few) and {r.good for r in few} == {0, 1}
    assert quality_crf.sampled(docs, known, "good", 10, 1 << 30).count() == 10
