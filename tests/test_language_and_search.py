"""The trained language model and the search index against plain versions."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voicegrain.operators import language
from voicegrain.operators.search_index import SearchIndex

TEXTS = [
    ("en", "The quick brown fox jumps over the lazy dog."), ("en", "These are the words that we use."), ("fr", "Les mots que nous écrivons ici."),
    ("fr", "Où est la bibliothèque ?"), ("de", "Wir schreiben über schöne Wörter."), ("es", "¿Dónde está la casa del señor?"), ("nl", "Dat is niet bekend"), (None, "The unknown"),
]


def plain_grams(text):
    s = re.sub("[^a-zà-ÿ]+", "_", f" {text or ''} ".lower())
    return [s[i : i + 3] for i in range(len(s) - 2)]


def plain_detect(text, texts):
    counted = {lang: Counter() for lang in ("en", "fr", "de", "es")}
    for lang, t in texts:
        if lang in counted:
            counted[lang].update(plain_grams(t))
    weight = lambda c, g: math.floor(1000 * math.log((c[g] + 1) / (sum(c.values()) + 59**3)))
    scores = sorted(((-sum(weight(c, g) for g in plain_grams(text)), lang) for lang, c in counted.items()))
    return (scores[0][1] if plain_grams(text) else "unknown"), scores[1][0] - scores[0][0]


def test_language_model_equals_a_plain_one(spark):
    trained = language.train(spark.createDataFrame(TEXTS, "lang string, text string"))
    asked = ["the words", "mots écrits où", "schöne Wörter über", "señor y señora", "", None, "123 !?", "é", "x", "the\n\nword's", "wörter " * 3000, "ÀÉ_ÿ a😀b"]
    rows = spark.createDataFrame(list(enumerate(asked)), "id long, text string").withColumn("margin", F.lit("old")).withColumn("__found", F.lit(7))
    got = {r.id: r for r in language.detect(rows, trained).collect()}
    assert len(got) == len(asked) and all(r["__found"] == 7 for r in got.values())
    for i, text in enumerate(asked):
        assert (got[i].guessed, got[i].margin) == plain_detect(text, TEXTS), text


def test_language_model_of_parts_of_a_corpus_and_of_none(spark):
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    parts = language.merge_counts(language.counts(df.limit(3)), language.counts(df.offset(3)))
    assert language.model(parts).collect() == language.train(df).collect()
    empty = language.train(df.where("false"))
    got = language.detect(spark.createDataFrame([("abc",), (None,)], "text string"), empty).collect()
    assert [(r.guessed, r.margin) for r in got] == [("de", 0), ("unknown", 0)]


ROWS = [
    (1, "One day ON the moon"), (2, "on"), (3, "o"), (4, ""), (5, None), (4095, "moon\u0000 on"), (4096, "MOON one on on"), (9_000, "the moO"), (9_000, "noon"), (None, "on"),
    (-7, "Éon 😀 on"), (10_000, "aaaa"), (10_001, "abcd bcde cdef"), (10_002, "a% _on"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "id long, label string").withColumn("gram", F.lit("clash"))
    found = SearchIndex(spark, str(tmp_path_factory.mktemp("search") / "index"))
    return found.add(df.where("id < 9000 OR id IS NULL")).add(df.where("id >= 9000"))


@pytest.mark.parametrize("needle", ["on", "On", "moon", "oon", "MOO", "😀 o", "aa", "aaa", "abcdef", "abcd bcde", "% _", "n", "", "zz", "no such", "\u0000 "])
def test_search_equals_a_scan(index, needle):
    low = needle.lower()
    want = sorted((i, t, t.lower().count(low)) for i, t in ROWS if i is not None and t is not None and len(low) > 1 and low in t.lower())
    assert sorted(tuple(r) for r in index.find(needle).collect()) == want
    first = [r.id for r in index.first(needle, 3).collect()]
    assert first == [i for i, _, _ in want][:3]
    ranked = [(r.id, r.hits) for r in index.ranked(needle, 3).collect()]
    assert ranked == [(i, n) for i, _, n in sorted(want, key=lambda r: (-r[2], r[0]))][:3]


def test_pages_end_in_the_whole_search(spark, tmp_path, monkeypatch):
    from voicegrain.operators import search_index

    monkeypatch.setattr(search_index, "PAGE", 2)
    rows = [(i, "abc bcd" if i < 20 else "abcd") for i in range(23)]  # candidates of 'abcd' that do not hold it come first
    found = SearchIndex(spark, str(tmp_path / "index")).add(spark.createDataFrame(rows, "id long, label string"))
    assert [r.id for r in found.first("abcd", 2).collect()] == [20, 21]
    assert "folder" in found.postings("abcd")._jdf.queryExecution().toString()


def test_postings_are_put_together_before_they_are_shuffled(spark, monkeypatch):
    from voicegrain.operators import search_index

    monkeypatch.setattr(search_index, "CHUNK", 20)
    rows = spark.createDataFrame([r for r in ROWS if None not in r], "id long, label string")
    found = search_index.posted(rows)
    want = {}
    for i, t in ROWS:
        if i is not None and t is not None:
            low = t.lower() + "\u0000"
            for k in range(len(low) - 2):
                want.setdefault((low[k : k + 3], i // 4096), set()).add(i)
    assert {(r.gram, r.block): r.ids for r in found.collect()} == {k: sorted(v) for k, v in want.items()}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_empty_index(spark, tmp_path):
    found = SearchIndex(spark, str(tmp_path / "index")).add(spark.createDataFrame([], "id long, label string"))
    assert found.find("on").count() == found.first("moon").count() == 0


def test_scores_and_counts_go_through_arrays(spark, monkeypatch):
    """Parts of some characters give what whole columns give, and no plan makes a row or a lambda of each trigram."""
    monkeypatch.setattr(language, "CHUNK", 7)
    rows = [(1, "en", "the cat, the dog"), (2, "fr", "été où ça ÷ x"), (3, "en", None), (4, "en", ""), (5, "de", "straße ß"), (6, "xx", "the"), (7, "fr", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    known = docs.where("lang <> 'xx'")
    plain = known.select("lang", F.explode(language.trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").count()
    got = language.counts(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    found = language.detect(docs, language.train(docs))
    weights = {x["lang"]: x["w"] for x in language.train(docs).head()["weights"]}
    for r in found.join(docs.select("doc_id", language.trigrams(F.col("text")).alias("g")), "doc_id").collect():
        order = sorted(((-sum(w[g] for g in r.g), name) for name, w in weights.items()))
        assert (r.guessed, r.margin) == ((order[0][1], order[1][0] - order[0][0]) if r.g else ("unknown", 0))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
