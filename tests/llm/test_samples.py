"""Models fitted on samples: every class and language is in them, whatever the size of its texts."""

import random

import pytest

from slotframe.llm import langid, quality

GOOD, BAD = "orchard gentle harvest lantern meadow careful window candle".split(), "xx99 zzz buy!!! click$$ qq11 win%% 000 ###".split()


def long_text(words, seed, size=35_000):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(size // 8))


@pytest.mark.parametrize("sample_bytes", [1, 20_000, 60_000, 24_000_000])
def test_few_long_texts_of_each_class(spark, make_docs, sample_bytes):
    docs = make_docs([(i, long_text(GOOD if i % 2 else BAD, i), "en", "a") for i in range(6)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(i, i % 2) for i in range(1000, 1400)], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample_bytes=sample_bytes)
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all(0 < s < 1 for s in scores.values()) and model.weights[1] > 0
    assert min(scores[i] for i in (1, 3, 5)) > 0.5 > max(scores[i] for i in (0, 2, 4))


def test_one_class_or_none(spark, make_docs):
    docs = make_docs([(i, long_text(GOOD, i, 300), "en", "a") for i in range(5)])
    kinds = "doc_id long, quality int"
    for rows, want in (([(0, 1), (3, 1)], 1.0), ([(0, 0)], 0.0), ([], 0.5), ([(77, 1), (78, 0)], 0.5)):
        model = quality.fit(docs, spark.createDataFrame(rows, kinds))
        assert {r.score for r in quality.score_quality(docs, model).collect()} == {want}


def test_many_rows_of_one_labelled_id(spark, make_docs):
    docs = make_docs([(1, long_text(GOOD, i % 3, 200), "en", "a") for i in range(400)] + [(2, long_text(BAD, 5, 200), "en", "a"), (3, long_text(GOOD, 6, 200), "en", "a")])
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"))
    assert len(model.weights) == 2


def test_a_language_of_one_long_text_is_learnt(make_docs):
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs away", "en", "a") for i in range(50)]
    rows.append((99, "der schnelle braune fuchs springt ueber den faulen hund " * 20_000, "de", "a"))
    model = langid.fit(make_docs(rows), sample_bytes=20_000)
    assert model.languages == ("de", "en")
    found = langid.identify(make_docs([(1, "der faule hund und der braune fuchs", "xx", "a"), (2, "the lazy dog and the brown fox", "xx", "a")]), model)
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "de", 2: "en"}
