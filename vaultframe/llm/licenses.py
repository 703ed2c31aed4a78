"""License scanning by winnowed fingerprints and banded alignment.

Templates and texts are winnowed alike, so that WINDOW + SHINGLE - 1 words in common share
a fingerprint. The templates' fingerprints are an inverted index, small and the same for
every task; a text's pick templates and places. There, a band of the text as wide as the
template and some slack on both sides is aligned with the whole template: words matched
in order count, words put in between cost. A match must cover enough of the template and
hold every word that tells licences apart, and none of those put in between. Texts never
leave their partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vaultframe.llm.common import LOWER, Texts, Words, batch, chunks, symbols, windows

#: Words of a shingle, shingles of a winnowing window. Share of a template's words that
#: makes a match, words of a template up to which all but fillers are needed, and what a
#: matched word gains for each one put in between that costs 1.
SHINGLE, WINDOW, COVERAGE, SHORT, GAIN = 3, 2, 0.8, 16, 5

#: Permission texts and notices as their licences word them.
TEXTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
#: The GNU licences' names, versions, and the notice that names them.
GNU = {"GPL": ("GNU General Public License", ("2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}
NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
#: Titles of other licences that a line names, and Creative Commons' terms.
TITLES = {"MIT": "MIT License", "BSD": "BSD License", "ISC": "ISC License", "Apache-2.0": "Apache License, Version 2.0", "MPL-2.0": "Mozilla Public License, Version 2.0", "EPL-2.0": "Eclipse Public License, Version 2.0"}
TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Words that tell licences apart, beside all with a digit; and those that don't matter.
TELLING = "mit bsd isc apache gnu gpl lgpl agpl lesser library affero mozilla mpl eclipse epl creative commons cc by nc nd sa attribution noncommercial noderivatives noderivs sharealike".split()
FILLERS = "a an and in is of or the this under work version v".split()


def templates() -> dict[str, str]:
    """Name to text: the texts, the notices, and the lines that name a licence, which in
    a sentence come after "under"."""
    out = dict(TEXTS)
    for short, (name, versions) in GNU.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            out[f"{short}-{full}"] = NOTICE.format(name=name, version=v)
            out[f"{short}-{full}-line"] = f"under the {name}, version {v}"
    out |= {f"{k}-line": f"under the {title}" for k, title in TITLES.items()}
    for short, name in TERMS.items():
        for v in ("3.0", "4.0"):
            out[f"CC-{short}-{v}"] = f"under a Creative Commons {name} {v} " + ("International License" if v == "4.0" else "Unported License")
            out[f"CC-{short}-{v}-line"] = f"under CC {short} {v}"
    return out


TEMPLATES = templates()

_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x41:0x5B] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def winnowed(w: Words) -> np.ndarray:
    """Places of the selected shingles: of each window the least hash, the last of
    equals."""
    g = windows(w.hash, SHINGLE)
    if not len(g):
        return np.zeros(0, np.int64)
    ok = w.doc[SHINGLE - 1 :] == w.doc[: len(g)]
    big = np.where(ok, g, np.uint64(0xFFFFFFFFFFFFFFFF))
    chosen = np.zeros(len(g), bool)
    m = len(g) - WINDOW + 1
    if m > 0:
        stack = np.stack([big[j : j + m] for j in range(WINDOW)])
        pick = WINDOW - 1 - np.argmin(stack[::-1], axis=0)
        chosen[np.arange(m) + pick] = True
    # Texts of fewer shingles than a window select all.
    few = np.diff(w.first) - SHINGLE + 1 < WINDOW
    chosen |= few[w.doc[: len(g)]]
    return np.flatnonzero(chosen & ok)


def _hashed(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return Words(Texts(np.frombuffer(b"".join(raw), np.uint8), offs, 0, len(raw)), _INSIDE, symbols(LOWER, 5))


class Index:
    """Fingerprints of the templates: hash -> (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        w = _hashed(list(templates.values()))
        text = "".join(templates.values()).encode()
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.telling = {int(x) for x in _hashed([" ".join(TELLING)]).hash}
        fillers = {int(x) for x in _hashed([" ".join(FILLERS)]).hash}
        digit = [any(0x30 <= c < 0x3A for c in text[x:y]) for x, y in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
        self.needed = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            h = w.hash[a:b].tolist()
            short = b - a <= SHORT
            self.needed.append(np.array([x in self.telling or (digit[a + i] and short) or (short and x not in fillers) for i, x in enumerate(h)], bool))
        at = winnowed(w)
        g = windows(w.hash, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.hash, self.template, self.place = g[order], w.doc[at][order], (at - w.first[w.doc[at]])[order]


def aligned(doc: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the text's and of the template's words that are matched by the best
    alignment of the whole template with any stretch of the text: GAIN for each matched
    word, less 1 for each of the text's that stand between them unmatched. Of equally
    good ones the first to end."""
    n, m = len(template), len(doc)
    score = np.zeros((n + 1, m + 1), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32)
    for i in range(n):
        here = score[i].copy()
        here[1:] = np.maximum(here[1:], np.where(doc == template[i], score[i, :-1] + GAIN, -1))
        score[i + 1] = np.maximum.accumulate(here + ramp) - ramp
    i, j = n, int(np.argmax(score[n]))
    pairs = []
    while i and j:
        if doc[j - 1] == template[i - 1] and score[i, j] == score[i - 1, j - 1] + GAIN:
            i, j = i - 1, j - 1
            pairs.append((j, i))
        elif score[i, j] == score[i - 1, j]:
            i -= 1
        else:
            j -= 1
    own = np.array(pairs[::-1], np.int64).reshape(-1, 2)
    return own[:, 0], own[:, 1]


SCANNED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_licenses", pa.int64()), ("licenses", pa.string()), ("best_coverage", pa.float64()), ("spans", pa.string())])


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_licenses, licenses (names, sorted,
    comma-joined), best_coverage, spans ("name:first byte-end byte:coverage" of each
    match in order, semicolon-joined).

    A row for each row, repeated ones too, of whole texts however long. Null and empty
    texts match nothing; an empty table gives an empty result. Of matches that overlap,
    the one of more matched words stands, of equal ones the first, then the first by
    name. Other columns, of any name, are ignored."""
    index = Index(TEMPLATES if templates is None else templates)

    def matches(t: Texts, w: Words, i: int, hits: list[tuple[int, int]]) -> list[tuple[int, int, float, str, int]]:
        """hits: (template, diagonal) of text i."""
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        found = set()
        tried: dict[int, int] = {}
        for k, d in sorted(set(hits)):
            template = index.words[k]
            n = len(template)
            slack = max(2, n // 2)
            if k in tried and d - tried[k] <= slack // 2:
                continue  # the band around the one before holds whatever is here
            tried[k] = d
            a, z = lo + max(0, d - slack), min(hi, lo + d + n + slack)
            own, of = aligned(w.hash[a:z], template)
            if len(own) < coverage * n or index.needed[k][np.setdiff1d(np.arange(n), of)].any():
                continue
            between = np.setdiff1d(np.arange(own[0], own[-1] + 1), own) + a
            if len(between) > n // 2 or (n <= SHORT and any(int(w.hash[x]) in index.telling or any(0x30 <= c < 0x3A for c in t.data[w.starts[x] : w.ends[x]]) for x in between.tolist())):
                continue
            found.add((len(own), int(w.starts[a + own[0]] - t.offs[i]), int(w.ends[a + own[-1]] - t.offs[i]), len(own) / n, index.names[k]))
        kept: list[tuple[int, int, float, str, int]] = []
        for n, a, z, c, name in sorted(found, key=lambda x: (-x[0], x[1], x[4])):
            if all(z <= x[0] or a >= x[1] for x in kept):
                kept.append((a, z, c, name, n))
        return sorted(kept)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column("text")):
                w = Words(t, _INSIDE, symbols(LOWER, 5))
                at = winnowed(w)
                g = windows(w.hash, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
                lo, hi = np.searchsorted(index.hash, g), np.searchsorted(index.hash, g, "right")
                hits: dict[int, list[tuple[int, int]]] = {}
                for x in np.flatnonzero(hi > lo).tolist():
                    i = int(w.doc[at[x]])
                    place = int(at[x] - w.first[i])
                    for y in range(lo[x], hi[x]):
                        hits.setdefault(i, []).append((int(index.template[y]), place - int(index.place[y])))
                rows = []
                for i in range(len(t)):
                    m = matches(t, w, i, hits[i]) if i in hits else []
                    rows.append((len({x[3] for x in m}), ",".join(sorted({x[3] for x in m})), max((x[2] for x in m), default=0.0), ";".join(f"{x[3]}:{x[0]}-{x[1]}:{x[2]:.3f}" for x in m)))
                yield batch(SCANNED, b.column("doc_id").slice(t.lo, len(t)), np.diff(w.first).astype(np.int64), *map(list, zip(*rows, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(step, "doc_id long, n_words long, n_licenses long, licenses string, best_coverage double, spans string")
