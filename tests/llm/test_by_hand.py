"""The mix's choice and the quality rules' verdict, computed one document at a time."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultframe.llm import mixing, quality_rules


def divergence(p, q):
    a, b = sum(p), sum(q)
    if not a:
        return 0.0
    out = 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / a, y / max(b, 1)
        m = (x + y) / 2
        out += sum(v * math.log2(v / m) for v in (x, y) if v) / 2
    return math.sqrt(max(0.0, out))


def classes(text):
    out = [0] * 7
    for c in text:
        if "a" <= c <= "z":
            out[0] += 1
        elif "A" <= c <= "Z":
            out[1] += 1
        elif "0" <= c <= "9":
            out[2] += 1
        elif c in " \t\n\r\v\f":
            out[3] += 1
        elif c in ".,;:!?'\"()-":
            out[4] += 1
        elif ord(c) < 128:
            out[5] += 1
        else:
            out[6] += 1
    return out


def test_quality_verdict_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lang, letters in (("aa", "abcde"), ("bb", "vwxyzé")):
        words = ["".join(rng.choice(list(letters), int(rng.integers(2, 9)))) for _ in range(25)]
        for _ in range(25):
            rows.append((" ".join(rng.choice(words, int(rng.integers(5, 120)))).capitalize() + ".", lang))
    rows += [("#$%& 123 " * 40, "aa"), ("AAA BBB " * 5 + " ".join(f"C{i}" for i in range(70)), "bb"), ("", "aa"), (None, None), ("one two", "bb")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    refs = {}
    for lang in {r[1] for r in rows}:
        own = [t or "" for t, x in rows if x == lang]
        low = [t.translate({c: c + 32 for c in range(65, 91)}).split() for t in own]
        counts = collections.Counter(w for x in low for w in x)
        cut = sorted(counts.values(), reverse=True)
        assert len(cut) <= 64 or cut[63] > cut[64] or lang == "bb"
        refs[lang] = ([sum(x) for x in zip(*map(classes, own), strict=True)], counts)
    common = {lang: None for lang in refs}
    # Which words of equal count are common hangs on their hashes; take the operator's number.
    out = {r.doc_id: r for r in quality_rules.judged(df, common=200).collect()}
    for lang, (_, counts) in refs.items():
        common[lang] = list(counts)
    for i, (t, _) in enumerate(rows):
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        own = collections.Counter(w)
        char = min(divergence(classes(t or ""), ref) for ref, counts in refs.values() if counts)
        word = min(divergence([own[x] for x in common[k]] + [len(w) - sum(own[x] for x in common[k])], [refs[k][1][x] for x in common[k]] + [0]) for k in refs if refs[k][1])
        r = out[i]
        assert r.char_distance == pytest.approx(char, abs=1e-9) and r.word_distance == pytest.approx(word, abs=1e-9)
        fine = (len(w) < 20 or char <= quality_rules.MAX_CHAR) and (len(w) < 60 or word <= quality_rules.MAX_WORD)
        assert r.kept == (fine and not r.base_failed)


def test_mix_by_hand(docs, odd):
    for df in (docs, odd.select(docs.columns)):
        order = {}
        for r in df.select("doc_id", "source", "text", F.xxhash64(F.lit(17), "doc_id").alias("o")).collect():
            size = len((r.text or "").encode().split())
            order.setdefault(r.source, []).append((r.o, r.doc_id is not None, r.doc_id, size))
        names = sorted(order, key=lambda s: (s is None, s or ""))
        sizes = [sum(x[3] for x in order[s]) for s in names]
        left, free, target = 1.5 * sum(sizes), dict(enumerate(sizes)), {}
        while free:
            weights = {i: (5, 2, 1)[i % 3] for i in free}
            over = [i for i in free if left * weights[i] / sum(weights.values()) > 2 * sizes[i]]
            if not over:
                target |= {i: left * weights[i] / sum(weights.values()) for i in free}
                break
            for i in over:
                target[i] = 2.0 * sizes[i]
                left -= target[i]
                free.pop(i)
        want = collections.Counter()
        for i, s in enumerate(names):
            give = min(2 * sizes[i], math.floor(target[i] + 0.5))
            full, rest = divmod(give, sizes[i]) if sizes[i] else (0, 0)
            for o, _, d, size in sorted(order[s], key=lambda x: ((x[0] >> 40) % mixing.BUCKETS, x[0], x[1], x[2] or 0, x[3])):
                more = min(size, rest)
                rest -= more
                want[d, size, full * size + more, round(target[i], 6)] += 1
        got = collections.Counter((r.doc_id, r.size, r.taken, round(r.target, 6)) for r in mixing.mixed(df, columns=["doc_id"]).collect())
        assert got == want
