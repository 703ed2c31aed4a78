"""Budgets and prefix tables against the library, prefix by prefix."""

import numpy as np
import pyarrow as pa
import pytest

from vaultframe.llm import token_counts
from vaultframe.llm.common import chunks

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def random_texts(n=1500):
    rng = np.random.default_rng(8)
    bits = [*"abst'  \n\t.,!1é½ÿ中 \x1f\x85\xa0　", "'s", "'re", "'ll", " 've", "  ", " \n", "don't", "ing", "Über ", "123", "''", "<|endoftext|>", "word "]
    return ["".join(rng.choice(bits, int(rng.integers(0, 25)))) for _ in range(n)]


def test_pieces_and_counts(lib):
    own = token_counts.loaded(PATH)
    texts = random_texts()
    for t in chunks(pa.array(texts), 4000):
        n, pieces, _ = own.measured(t, 5)
        for i in range(len(t)):
            got = lib.encode(t.text(i).decode(), add_special_tokens=False)
            assert n[i] == len(got.ids), repr(t.text(i))
            assert pieces[i] == len(own.ends(t.text(i).decode())[0])


def test_budget(lib):
    own = token_counts.loaded(PATH)
    texts = [*random_texts(250), "internationalization " * 6, "x" * 60, "a\n\n\n\n\nb", ""]
    for limit in (0, 3, 7):
        for t in chunks(pa.array(texts)):
            fit = own.measured(t, limit)[2]
            for text, got in zip(texts, fit.tolist(), strict=True):
                want = max(i for i in range(len(text) + 1) if len(lib.encode(text[:i], add_special_tokens=False).ids) <= limit)
                assert got == want == own.fitting(text, limit), (text, limit)


def test_one_piece_without_end(lib):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 4800))
    own = token_counts.loaded(PATH)
    assert own.fitting(text, 512) == int(np.flatnonzero(own.prefixes(text) <= 512)[-1]) > 500


def test_long_text(lib):
    rng = np.random.default_rng(6)
    text = " ".join(rng.choice(["harbour", "it's", "über", "x1", "\n\n", "--"], 600_000))
    own = token_counts.loaded(PATH)
    (t,) = chunks(pa.array([text]))
    n, pieces, fit = own.measured(t, 512)
    names, c = own.ends(text)
    assert (n[0], pieces[0], fit[0]) == (c[-1], len(names), own.fitting(text, 512))


def test_prefix_table(spark, lib):
    df = spark.createDataFrame([(1, "it's  we'll\n\nend"), (2, None), (3, "")], "doc_id long, text string")
    for r in token_counts.prefix_table(df, PATH).collect():
        text = {1: "it's  we'll\n\nend"}.get(r.doc_id, "")
        assert r.counts == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
