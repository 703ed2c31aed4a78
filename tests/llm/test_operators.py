"""The ten operators against brute force on small tables, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from vaultframe.llm import components, decontam, licenses, lm_hpyp, mixing, near_dedup, quality_crf, quality_rules, suffix_dedup, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def raw(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def result(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


# 1


def removed_by_hand(rows, n=200):
    counts = collections.Counter(b[i : i + n] for _, b in rows for i in range(len(b) - n + 1))
    out = []
    for d, b in rows:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if counts[b[i : i + n]] > 1:
                cover[i] += 1
                cover[i + n] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_suffix_dedup(request, name):
    df = request.getfixturevalue(name)
    want = removed_by_hand(raw(df))
    for limit in (suffix_dedup.TASK_BYTES, 3000) if name == "docs" else (suffix_dedup.TASK_BYTES,):
        assert result(suffix_dedup.removed(df, limit), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_one_gram_over_many_tasks(spark):
    """A passage in many texts, each with others around it, of which some repeat too."""
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdefgh "), 260))
    around = ["".join(rng.choice(list("ijklmnop "), 150)) for _ in range(150)]
    rows = [(i, around[i] + passage + around[(i * 7 + 3) % 150]) for i in range(150)] + [(200 + i, around[i] + passage) for i in range(0, 150, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = removed_by_hand(raw(df))
    for limit in (suffix_dedup.TASK_BYTES, 4000, 700):
        assert result(suffix_dedup.removed(df, limit), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup_empty_and_texts(none, odd):
    assert suffix_dedup.removed(none).count() == 0
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_segments_over_several_shards():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 320, np.uint8)
    segments = []
    for i in range(60):
        x = base.copy()
        x[rng.integers(0, 320)] = 65 + i % 26
        segments.append(x.tobytes())
    segments = list(dict.fromkeys(segments))
    starts = np.full(len(segments), 121)
    want = collections.Counter(s[i : i + 200] for s in segments for i in range(121))
    for limit in (1 << 20, 2000):
        got = suffix_dedup.repeated(segments, starts, limit=limit)
        assert [f.tolist() for f in got] == [[want[s[i : i + 200]] > 1 for i in range(121)] for s in segments]


# 2


def test_token_counts(odd, none, docs):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(path)
    for df in (odd, docs, none):
        want = sorted(((d, len(b), n := len(lib.encode(b.decode(), add_special_tokens=False).ids), n > 512) for d, b in raw(df)), key=key)
        assert result(token_counts.token_counts(df, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_every_prefix():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    lib, own = Tokenizer.from_file(path), token_counts.loaded(path)
    for text in ("it's  we'll\n\n go!! 123 <|endoftext|> Ünïcödé 中文 \U0001f600  end ", "!!<|endoftext|>", "<|endoftext|><|endof", "  '' 're x  y", "՘a1࢏"):
        want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert own.prefixes(text).tolist() == want


# 3 and 6


def test_quality_classifier(docs, labels, odd, none):
    out = quality_crf.scored(docs, labels).toPandas()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()
    m = out.merge(labels.toPandas(), on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.9 and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.3)).all()
    assert quality_crf.scored(odd, labels).filter("score is not null").count() == odd.count()
    assert quality_crf.scored(none, labels).count() == 0
    assert quality_crf.scored(docs, labels.filter("quality = 1")).select("score").distinct().count() == 1
    kept = quality_crf.accepted(odd, labels)
    assert kept.columns == odd.columns


def test_chain_marginals():
    score, pair = np.array([0.5, -1.0, 2.0, 0.3]), np.array([[0.2, -0.4], [0.1, 0.7]])
    p, expected = quality_crf.marginals(score, pair, np.array([0, 3, 3, 4]))
    weight = {}
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                weight[a, b, c] = math.exp(score[0] * a + score[1] * b + score[2] * c + pair[a, b] + pair[b, c])
    z = sum(weight.values())
    assert np.allclose(p[:3], [sum(v for k, v in weight.items() if k[i]) / z for i in range(3)])
    assert np.isclose(p[3], 1 / (1 + math.exp(-0.3)))
    assert np.isclose(expected[1, 1], sum(v * (k[0] * k[1] + k[1] * k[2]) for k, v in weight.items()) / z)


def test_toxicity(docs, labels, odd, none):
    out = toxicity.scored(docs, labels).toPandas()
    m = out.merge(labels.toPandas(), on="doc_id")
    assert (m.predicted == m.toxic).mean() > 0.85
    assert toxicity.scored(odd, labels).filter("score is not null").count() == odd.count()
    assert toxicity.scored(none, labels).count() == 0


def test_lexicon_automaton():
    lex = toxicity.Lexicon([("stupid", False), ("worthless", False), ("bad", False), ("lowei", True)])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = np.random.default_rng(5)
    words = ["stupid", "stupd", "stuppid", "stupix", "xstupid", "worthles", "worthlss", "wrthls", "bad", "badd", "loweix", "lowei", "lowe"]
    words += ["".join(rng.choice(list("stupid"), rng.integers(4, 8))) for _ in range(300)]
    for w in words:
        want = [(d, i) for i, (t, s) in enumerate(lex.terms) if not s and (d := distance(w, t)) <= lex.edits(t, s)]
        got = lex.match(w)
        if w.startswith("lowei") and len(w) > 5:
            assert got == (3, 0)
        else:
            assert (got[1], got[0]) == min(want) if want else got is None


def test_quotation_counts_less():
    s = toxicity.Scorer([("stupid", False)])
    plain, quoted = s.counts(b"you are stupid indeed"), s.counts(b'he said "stupid" once')
    assert plain[0] == 1 and quoted[0] == toxicity.QUOTED and quoted[3] == 1


# 4


def test_mixing(docs, odd, none):
    out = mixing.mixed(docs, columns=["doc_id"]).toPandas()
    again = mixing.mixed(docs.repartition(7), columns=["doc_id"]).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    m = out.merge(docs.toPandas(), on="doc_id")
    assert (m["size"] == [len(t.encode().split()) for t in m.text]).all() and (m.taken <= 2 * m["size"]).all()
    g = m.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (g["size"] == g.own).all() and ((g.taken - g.target).abs() <= 1).all()
    assert g.target.sum() == pytest.approx(1.5 * g["size"].sum())
    few = mixing.mixed(odd)
    assert few.count() == odd.count() and few.filter("taken > 2 * size").count() == 0
    assert mixing.mixed(none).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_overlapping_sources_route():
    flow = mixing.route([10, 10, 10], [(0,), (0, 1), (1,)], [25.0, 15.0])
    assert [sum(f[s] for f in flow) for s in (0, 1)] == [25.0, 15.0]
    assert sorted(sum(f) for f in flow)[0] >= 10  # everything once before anything twice


# 5


def test_language_model(docs, odd, none):
    for df in (docs, odd):
        out = lm_hpyp.scored(df, numbered=500)
        rows = raw(df)
        train = [lm_hpyp.words(b) + [b"\n"] for d, b in rows if d is None or zlib.crc32(str(d).encode()) % 10]
        c = collections.Counter(w for x in train for w in x)
        n, v = sum(c.values()), len(c)
        want = []
        for d, b in rows:
            w = lm_hpyp.words(b) + [b"\n"]
            want.append((d, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)))
        got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out.collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        assert out.filter("score >= 0 or score is null").count() == 0
    assert lm_hpyp.scored(none).count() == 0


def test_seating():
    rng = np.random.default_rng(1)
    n = np.full(4000, 30.0)
    t = lm_hpyp.seat(rng, n, np.full(4000, 5.0), np.full(4000, 0.2), 0.5)
    total = 0.0  # one customer at a time
    for _ in range(2000):
        tables = 1
        for k in range(1, 30):
            new = (5.0 + 0.5 * tables) * 0.2
            tables += rng.random() < new / (new + k - 0.5 * tables)
        total += tables / 2000
    assert abs(t.mean() - total) < 0.4 and t.min() >= 1


def test_spelling_sums_to_one():
    pairs = {b"": {97: 5.0, 98: 2.0}, b"a": {98: 3.0, 255: 1.0}, b"ba": {255: 4.0}}
    s = lm_hpyp.Spelling(pairs)
    seen, share = s.run(6, 2)
    speller = lm_hpyp.Speller(s.contexts, seen, share)
    every = np.arange(257)
    for context in (b"", b"a", b"ba", b"zz"):
        code = np.full(257, int.from_bytes(context, "big"))
        assert np.exp(speller.letters(every, code, np.full(257, len(context)))).sum() == pytest.approx(1, abs=0.05)
    each = sum(speller.letters(np.array([w]), np.array([c]), np.array([n]))[0] for w, c, n in ((98, 0xFE, 1), (97, 0xFE62, 2), (255, 0xFE6261, 3)))
    assert speller.logs([b"ba", b""])[0] == pytest.approx(each)


# 7


def contaminated_by_hand(rows, bench, k=10):
    cut = lambda b: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b.translate(LOWER))
    grams = collections.defaultdict(set)
    for item, text in bench:
        w = cut(text)
        if w:
            n = min(k, len(w))
            for i in range(len(w) - n + 1):
                grams[tuple(w[i : i + n])].add(None if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = []
    for d, b in rows:
        w, hit, items = cut(b), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    items |= grams[g]
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    short = spark.createDataFrame([(1, "Customs HOUSE while rain"), (10, "x y"), (2, ""), (3, None), (None, "runs five runs rain fell softly"), (None, "and only one lamp burned near the old customs house while"), (7, "near the old customs house while rain fell softly on the boats that nobody")], "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for df, b in ((docs, bench), (odd, short), (none, bench), (odd, short.limit(0))):
        items = [(r.item_id, (r.text or "").encode()) for r in b.collect()]
        want = contaminated_by_hand(raw(df), items)
        assert result(decontam.contamination(df, b), *names) == want
        assert decontam.decontaminated(df, b).count() == sum(not w[-1] for w in want)
    assert decontam.decontaminated(odd, short, max_windows=2).count() == decontam.decontaminated(odd, short).count()
    assert result(decontam.contamination(odd, short, max_windows=2), *names) == contaminated_by_hand(raw(odd), [(r.item_id, (r.text or "").encode()) for r in short.collect()])


# 8


def test_license_scan(spark, odd, none):
    mit = licenses.TEMPLATES["MIT"]
    broken = mit.replace("free of charge", "free of any charge").replace("sublicense", "lease")
    df = spark.createDataFrame([(1, "Some text.\n" + mit + "\nmore"), (2, broken), (3, "Released under the MIT License."), (4, "Released under a new roof"), (5, mit[: len(mit) // 3])], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(df).collect()}
    assert [got[i].licenses for i in range(1, 6)] == ["MIT", "MIT", "MIT-line", "", ""]
    assert got[1].best_coverage == 1.0 and 0.8 <= got[2].best_coverage < 1
    start, end = map(int, got[1].spans.split(":")[1].split("-"))
    assert ("Some text.\n" + mit)[start:end] == mit.rstrip(".")
    assert licenses.scanned(odd).count() == odd.count() and licenses.scanned(none).count() == 0


# 9


def grouped_by_hand(rows, percent=85):
    sets = []
    for d, b in rows:
        w = b.translate(LOWER).split()
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=key)


@pytest.mark.parametrize("limit", [near_dedup.MAX_ELEMENTS, 50])
def test_near_dedup(docs, odd, none, limit):
    names = ("doc_id", "n_shingles", "component_id", "kept")
    for df in (docs, odd, none):
        assert result(near_dedup.near_duplicates(df, max_elements=limit), *names) == grouped_by_hand(raw(df))


def test_superminhash_estimates():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 1 << 63, 3000, np.uint64)
    sets = [np.sort(h[:1000]), np.sort(h[100:1100]), np.sort(h[:3]), np.sort(h[1:4])]
    sig = near_dedup.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 512)
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.06
    assert abs((sig[2] == sig[3]).mean() - 0.5) < 0.1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


# 10


def test_quality_rules(docs, odd, none):
    for df in (docs, odd):
        want = []
        for d, b in raw(df):
            w = b.split()
            c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            again = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            lines, seen = 0, set()
            for line in b.split(b"\n"):
                if line.split():
                    lines += line in seen
                    seen.add(line)
            want.append((d, len(w), sum(len(x.decode()) for x in w), sum(b.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), lines, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
        out = quality_rules.judged(df)
        assert result(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=key)
        assert out.filter("base_failed and kept").count() == 0
    assert quality_rules.judged(none).count() == 0


def test_jensen_shannon():
    assert quality_rules.distance(np.array([1.0, 0.0]), np.array([0.0, 1.0])) == pytest.approx(1)
    assert quality_rules.distance(np.array([2.0, 2.0]), np.array([1.0, 1.0])) == pytest.approx(0)
