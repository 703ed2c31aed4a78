"""Which licence it is, and alignment against every alignment there is."""

from functools import lru_cache

import numpy as np

from vaultframe.llm import licenses

CASES = {
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0-line",
    "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0-line",
    "This work is licensed under the GNU General Public License, version 2": "GPL-2.0-line",
    "This work is licensed under the GNU General Public License, version 3": "GPL-3.0-line",
    "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0-line",
    "Released under the BSD License": "BSD-line",
    "Released under the MIT License": "MIT-line",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "CC-BY-ND-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0-line",
    "Licensed under the Apache License, Version 1.1": "",
    "Released under the XYZ License": "",
    "under the sea the MIT school holds no License": "",
}


def test_lines(spark):
    texts = [*CASES, *(f"Some words go before. {x}. And others come after it, of no matter." for x in CASES)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scanned(df).collect()}
    assert [got[i] for i in range(len(texts))] == [*CASES.values()] * 2


def test_whole_texts_broken_in_many_ways(spark):
    rows, want = [], []
    for name, text in licenses.TEXTS.items():
        words = text.split()
        numbered = " ".join(f"{w} dnl" if i % 9 == 8 else w for i, w in enumerate(words))  # a word put in after each line
        twice = text + " and then " * 30 + text
        for t in (text.upper(), numbered, twice, " ".join(words[: len(words) // 3])):
            rows.append((len(rows), t))
            want.append((name, t))
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, t) in enumerate(want):
        if i % 4 == 3:
            assert name not in got[i].licenses.split(",")
        else:
            assert name in got[i].licenses.split(","), (name, got[i])
            if i % 4 == 2:
                assert sum(x.split(":")[0] == name for x in got[i].spans.split(";")) == 2


def test_alignment_is_the_best():
    rng = np.random.default_rng(7)
    for _ in range(300):
        doc, template = rng.integers(0, 5, int(rng.integers(0, 9))), rng.integers(0, 5, int(rng.integers(1, 6)))

        @lru_cache(None)
        def best(i, j, begun):  # all ways to go on from template word i and text word j
            out = 0
            if i < len(template):
                out = best(i + 1, j, begun)
                if j < len(doc) and doc[j] == template[i]:
                    out = max(out, licenses.GAIN + best(i + 1, j + 1, True))
                if j < len(doc):
                    out = max(out, best(i, j + 1, begun) - begun)
            return out

        own, of = licenses.aligned(doc, template)
        assert (np.diff(own) > 0).all() and (np.diff(of) > 0).all() and (doc[own] == template[of]).all()
        score = licenses.GAIN * len(own) - (own[-1] - own[0] + 1 - len(own) if len(own) else 0)
        assert score == best(0, 0, False)
