"""The toxicity model learns from every gram of its sample."""

from touchline.llm import toxicity


def test_no_gram_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 5, raising=False)
    texts = ["one two three", "vier fünf sechs", "семь восемь"]
    sample = spark.createDataFrame([(t, i % 2, i % toxicity.FOLDS) for i, t in enumerate(texts)], "text string, label int, fold int")
    want = {g for t in texts for part in toxicity.words(t) for w in part for g in toxicity.grams(w)}
    assert {r.gram for r in toxicity.counts(sample).collect()} == want
