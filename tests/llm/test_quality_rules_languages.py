"""Every language has a reference, however many there are."""

from vaultframe.llm import quality_rules


def test_more_than_a_thousand_languages(spark):
    rows = [(i, " ".join(f"w{i}x{j % 30}" for j in range(2000 if i else 60)), f"l{i}") for i in range(1010)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(quality_rules.references(df)) == 1010
    rare = quality_rules.judged(df).filter("doc_id = 0").first()
    assert rare.word_distance < 1e-6 and rare.char_distance < 1e-6
