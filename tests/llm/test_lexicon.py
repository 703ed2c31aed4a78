"""Stems beside words, quote marks beside letters, and what the labels prove."""

from vaultframe.llm import toxicity


def test_stem_and_word_of_one_spelling():
    both = toxicity.Lexicon([("abc", True), ("abc", False)])
    assert both.match("abcdef") == (0, 0) and both.match("abc") == (1, 0)
    stem = toxicity.Lexicon([("lowei", True), ("loweiheit", False)])
    assert stem.match("loweihiet") == (0, 0) and stem.match("loweiheit") == (1, 0)
    assert stem.match("loveiheit") == (1, 1)  # a misspelling within the stem


def test_marks_are_no_letters():
    s = toxicity.Scorer([("stupid", False)])
    assert s.counts("so “stupid” he".encode())[:4] == (0.25, 0, 0, 1)
    assert s.counts("«stupid» — stupid… très stupide".encode())[0] == 1.25
    assert s.counts(b"") == (0, 0, 0, 0, 0)


def test_rare_words_prove_nothing(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 2
        rows.append((i, f"plain words of a text number{i % 200} rare{i % 41} " + ("vile " if bad and i % 4 == 1 else "")))
        marks.append((i, bad))
    scorer = toxicity.fitted(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert [t for t, stem in scorer.terms if not stem] == ["vile"]


def test_all_proven_terms_are_taken(spark):
    rows, marks = [], []
    for i in range(3000):
        bad = i % 2
        rows.append((i, " ".join(f"vile{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(650) if (j + i // 2) % 20 == 0) if bad else "a plain text"))
        marks.append((i, bad))
    scorer = toxicity.fitted(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert sum(not stem for _, stem in scorer.terms) == 650
