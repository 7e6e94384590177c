"""URL rules, leaks, languages, quality and the pipeline."""

import random
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline

from slotframe.llm import decontam, langid, quality, urlfilter
from slotframe.llm.common import join_counted


def urls(spark, rows):
    return spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, weight int")


def test_rules(spark):
    rules = urlfilter.rules_frame(spark, [
        urlfilter.host_rule("block", "net"), urlfilter.host_rule("allow", "example.net", "/en/"), urlfilter.host_rule("block", "a.b-c.org", "/x.y"),
        urlfilter.pattern_rule("block", "ads", r"/ad[0-9]+/", []), urlfilter.pattern_rule("block", "track", r"/track/", ["track"], 3)])
    cases = {
        "http://EXAMPLE.net/en/": ("example.net/en/", "allow"), "http://www.example.net/en/x?y": ("example.net/en/", "allow"),
        "http://example.net/de": ("net/", "block"), "http://notexample.net/en/": ("net/", "block"), "http://net/": ("net/", "block"),
        "http://example.net": (None, "allow"), "http://a.b-c.org/x.yz": ("a.b-c.org/x.y", "block"), "http://a.b-c.org/xxy": (None, "allow"),
        "http://q.org/ad12/": ("ads", "block"), "http://q.org/track/1": ("track", "block"), "example.net/en/": (None, "allow"),
        "http://u@example.net:80/en/": (None, "allow"), "http://x.net?/en/": (None, "allow"), "x://y://z.net/": (None, "allow"), "": (None, "allow"), None: (None, "allow"),
        "http://İ.NET/a\nb#c": ("net/", "block")}
    rows = [*enumerate(cases), (None, "http://net/"), (0, "http://EXAMPLE.net/en/")]
    got = urlfilter.judge_urls(urls(spark, rows), rules).collect()
    assert len(got) == len(rows)
    assert {(r.url, r.rule, r.verdict) for r in got} == {(u, *v) for u, v in cases.items()}
    odd = {r.url: (r.host, r.path) for r in got}
    assert odd["http://İ.NET/a\nb#c"] == ("İ.net", "/a\nb") and odd[None] == odd["example.net/en/"] == ("", "")


def test_rules_without_rows(spark):
    rules = urlfilter.rules_frame(spark, [urlfilter.host_rule("block", "net")])
    assert urlfilter.judge_urls(urls(spark, []), rules).collect() == []
    assert [r.verdict for r in urlfilter.judge_urls(urls(spark, [(1, "http://a.net/")]), rules.limit(0)).collect()] == ["allow"]


def test_hot_keys_join_like_others(spark):
    left = spark.createDataFrame([(k, i) for i in range(3000) for k in (("hot", "hot", f"k{i}") if i % 9 else (None, "no", "hot"))], "k string, i int")
    right = left.where("k is not null and k <> 'no'").groupBy("k").count().selectExpr("k", "count as n", "concat(k, '!') as v")
    got = join_counted(left, right, "k", "n", left.count(), left["i"]).collect()
    assert len(got) == left.count() and all(r.v == (None if r.k in (None, "no") else r.k + "!") for r in got)


ITEMS = [(1, "Which river runs through the old town of Arnsfeld near the mill? It is the Lower Wende."),
         (2, "Name the three metals that a brazier of the ninth guild must never mix together"), (3, ""), (4, None), (None, "no id here at all")]


def leaks(spark, docs, items=ITEMS):
    found = decontam.find_leaks(docs, spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string"))
    return {(r.doc_id, r.item_id) for r in found.collect()}


def test_leaks(spark, make_docs):
    filler = " ".join(f"filler{i % 83} word{i % 7}" for i in range(400))
    q = ITEMS[0][1]
    edited = q.replace("old", "new").upper().replace("?", " ?!")
    docs = make_docs([
        (1, filler + " " + q + " " + filler, "en", "a"), (2, edited, "en", "a"), (3, q.split("?")[0] + " " + filler, "en", "a"),
        (4, filler, "en", "a"), (5, None, "en", "a"), (6, "", "en", "a"), (7, q + "\n" + filler + ITEMS[1][1], "en", "a"), (None, q, "en", "a"),
        (8, " ".join(sorted(q.split())), "en", "a"), (1, filler, "en", "a")])
    assert leaks(spark, docs) == {(1, 1), (2, 1), (7, 1), (7, 2), (None, 1)}
    kept = decontam.drop_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 8] and kept.columns == docs.columns
    assert leaks(spark, make_docs([])) == set() and leaks(spark, docs, []) == set()


def test_leaks_with_answers_and_shards(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 10)
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randint(6, 120))), f"answer{i}") for i in range(60)]
    docs = make_docs([(i, f"noise t1 t2 {q} so {a}" if i % 2 else f"{q} so nothing", "en", "a") for i, q, a in items])
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    found = decontam.find_leaks(docs, table, question_col="question", answer_col="answer")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(1, 60, 2)}


def test_scores_do_not_depend_on_how_items_are_dealt(spark, make_docs, monkeypatch):
    """Items of several window lengths, repeated rows and an item without words among them; one shard and many."""
    rng = random.Random(11)
    items = [(i, " ".join(f"t{int(rng.expovariate(0.02))}" for _ in range(rng.randint(6, 90)))) for i in range(80)]
    docs = make_docs([(i, "before " + " ".join(w for w in q.split() if rng.random() > 0.08) + " after", "en", "a") for i, q in items])
    table = spark.createDataFrame(items + items[:5] + [(900, "?!"), (901, "")], "item_id long, text string")
    found = []
    for shard in (1024, 7):
        monkeypatch.setattr(decontam, "SHARD_ITEMS", shard)
        found.append(sorted(tuple(r) for r in decontam.find_leaks(docs, table).collect()))
    assert found[0] == found[1] and len(found[0]) >= 40
    monkeypatch.setattr(decontam, "CELLS", 50)
    assert sorted(tuple(r) for r in decontam.find_leaks(docs, table).collect()) == found[0]


def test_words_in_order_equal_the_table_of_all_places():
    rng = random.Random(3)
    for _ in range(200):
        part, passage = ([bytes([rng.randrange(97, 103)]) for _ in range(rng.randint(1, 20))] for _ in range(2))
        table = [[0] * (len(passage) + 1) for _ in range(len(part) + 1)]
        for i, w in enumerate(part):
            for k, v in enumerate(passage):
                table[i + 1][k + 1] = table[i][k] + 1 if v == w else max(table[i][k + 1], table[i + 1][k])
        assert decontam.common_in_order(part, passage) == table[-1][-1] / len(part)


def test_very_long_item(spark, make_docs):
    text = " ".join(f"w{i * 7919 % 30011}" for i in range(30000))
    docs = make_docs([(1, "so " + text + " it is", "en", "a"), (2, text[:40000], "en", "a")])
    assert leaks(spark, docs, [(1, text)]) == {(1, 1)}


def test_retrieval_equals_scoring_all_items(spark):
    """Pruned retrieval finds what full scoring of every passage finds."""
    rng = random.Random(8)
    vocabulary = [f"v{int(rng.expovariate(0.05))}" for _ in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))), None) for i in range(70)]
    text = " ".join(rng.choice(vocabulary) for _ in range(2000)) + " " + " ".join(t for _, t, _ in items[::5])
    held = [set(decontam.words_of(t)) for _, t, _ in items]
    terms = decontam.Terms(len(items), sum(len(t.split()) for _, t, _ in items) / len(items), Counter(w for h in held for w in h))
    for index in decontam.indexes(items, False, terms):
        words = decontam.words_of(text)
        none = len(index.vocabulary)
        ids = [index.vocabulary.get(w, none) for w in words]
        import numpy as np
        got = {(first, at): score for _, first, at, score in index.candidates(np.array(ids), np.array([0]), np.array([len(ids)]), 0.5)}
        want = {}
        step = index.window // 2
        for first in range(0, max(1, len(words)), step):
            if first and first - step + index.window >= len(words):
                break
            terms = set(ids[first: first + index.window])
            for block in index.postings:
                sums = {}
                for t in terms:
                    for at, w in block.get(t, ()):
                        sums[at] = sums.get(at, 0) + w
                want.update({(first, at): s for at, s in sums.items() if s >= 0.5})
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


SENTENCES = {
    "en": "the of and to in that with was this from they have been which their there would about other into",
    "de": "der die und den von mit das nicht eine auch werden über durch zwischen können müssen größe für noch",
    "fr": "le les des une dans que pour qui avec était être plus cette mais leur même après très où été"}


def sample(rng, lang, n):
    return " ".join(rng.choice(SENTENCES[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def language_model(make_docs):
    rng = random.Random(3)
    return langid.fit(make_docs([(i, sample(rng, lang, 60), lang, "a") for i in range(60) for lang in SENTENCES] + [(99, "12", None, "a"), (98, None, "en", "a")]))


def test_languages_and_mixtures(make_docs, language_model):
    rng = random.Random(9)
    rows = [(i, sample(rng, lang, 80), lang, "a") for i, lang in enumerate(list(SENTENCES) * 10)]
    rows += [(100 + i, sample(rng, "en", 120) + ". " + sample(rng, "de", 60), "both", "a") for i in range(10)]
    got = {r.doc_id: r for r in langid.identify(make_docs(rows), language_model).collect()}
    assert all(got[i].lang_pred == lang and got[i].languages == [lang] for i, _, lang, _ in rows if lang != "both")
    for i in range(100, 110):
        assert got[i].languages == ["en", "de"] and abs(got[i].proportions[0] - 2 / 3) < 0.1 and got[i].gain > 0


def test_language_of_odd_rows(odd_docs, make_docs, language_model):
    got = langid.identify(odd_docs, language_model, keep=("doc_id", "n")).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 7, 9)} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit(make_docs([]))).collect()} == {"und"}
    assert langid.identify(make_docs([]), language_model).collect() == []


def test_kept_text_goes_to_python_once(make_docs, language_model):
    """A batch holds a text that is kept once, and results are those of a text that is not kept."""
    docs = make_docs([(i, f"the lazy dog {i} and the brown fox", "en", "a") for i in range(5)])
    kept = langid.identify(docs, language_model, keep=("doc_id", "text", "lang"))
    assert " AS _text" not in kept._jdf.queryExecution().optimizedPlan().toString()
    alone = langid.identify(docs, language_model)
    assert kept.columns == ["doc_id", "text", "lang", *alone.columns[1:]]
    assert sorted(kept.drop("text", "lang").collect()) == sorted(alone.collect())
    assert sorted(kept.select(*docs.columns[:3]).collect()) == sorted(docs.select(*docs.columns[:3]).collect())


def test_few_texts_are_weighed_together(language_model):
    """A large batch comes back in parts of about SLICE bytes, all rows in their order."""
    texts = [f"the lazy dog {i} " * 4000 for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "doc_id": list(range(60))})
    parts = list(langid.identify_batches(language_model, 0, 2)(iter([batch])))
    assert [i for p in parts for i in p.column(1).to_pylist()] == list(range(60))
    assert all(sum(map(len, p.column(0).to_pylist())) < 2 * langid.SLICE for p in parts)


def test_quality(make_docs, spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        text = sample(rng, "en", rng.randint(20, 200))
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", "a"))
        labels.append((i, int(i % 4 != 0), 0))
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, score int")
    out = langid.held_out("doc_id", 4, 2)
    model = quality.fit(docs.where(~out), marks)
    scored = quality.score_quality(docs.where(out), model).collect()
    assert len(scored) > 50 and sum((r.score >= 0.7) == (r.doc_id % 4 != 0) for r in scored) >= 0.97 * len(scored)


def test_quality_of_odd_rows(odd_docs, make_docs, spark):
    marks = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (8, 1), (9, None), (None, 1), (1, 0)], "doc_id long, quality int")
    for model in (quality.fit(odd_docs, marks), quality.fit(odd_docs, marks.limit(0)), quality.fit(odd_docs, marks.where("quality = 1"))):
        got = quality.score_quality(odd_docs, model, keep=("doc_id", "size")).collect()
        assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(make_docs([]), model).collect() == []


def test_pipeline_stages(spark, make_docs, tmp_path):
    rng = random.Random(6)
    rows = [(i, sample(rng, lang, 60) + f" mark{i} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)), lang, f"s{i % 4}")
            for i, lang in enumerate(list(SENTENCES) * 20)]
    rows += [(200, rows[0][1], "en", "s0"), (201, "1 2 3", "en", "s1"), (202, sample(rng, "de", 80) + " " + ITEMS[0][1], "de", "s2"), (203, None, "en", "s1"),
             (204, rows[5][1] + " tail", "fr", "s1"), (None, rows[9][1] + " other words", None, None), (7, rows[7][1], "de", "s3")]
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, str(tmp_path))
        if at < 4:
            assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / f"stage{at}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{at}"))
        seen.append(sorted(r[0] if r[0] is not None else -1 for r in docs.select("doc_id").collect()))
    assert seen[0] == sorted([*range(60), 7, 200, 202, 204, -1])
    assert seen[1] == sorted([*range(60), 202, -1])
    assert seen[2] == sorted([*range(60), -1])
    assert set(seen[3]) <= set(seen[2]) and len(seen[4]) == len(seen[3]) > 30
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_pipeline_without_rows(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
