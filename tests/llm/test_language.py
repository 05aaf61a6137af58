"""Language identification: automata against plain search, accuracy on documents held out."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import language

TRAIN = "/root/testdata/sf0.01/documents.parquet"


def plain_phrases(text, token):
    """Longest matches by searching the text itself."""
    phrases, at = 0, 0
    while at < len(token):
        size = 1
        while at + size < len(token) and token[at : at + size + 1] in text:
            size += 1
        phrases, at = phrases + 1, at + size
    return phrases


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=60), st.text("abcx", min_size=1, max_size=12))
def test_phrases_equal_plain_search(text, word):
    text = f" {text} "
    keys, targets = language.suffix_automaton(text)
    edges = dict(zip(keys.tolist(), targets.tolist()))
    token = f" {word} "
    assert language._phrases(edges, [ord(c) for c in token]) == plain_phrases(text, token)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(TRAIN)
    found = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.count() == docs.count()
    out = found.filter("held_out")
    assert 0.15 < out.count() / docs.count() < 0.35
    assert out.filter("lang_pred = lang").count() >= 0.98 * out.count()
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_only_documents_not_held_out_are_learned(spark):
    rows = [(k, "aaa bbb" if k % 2 else "xxx yyy", "left" if k % 2 else "right", "s") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    before = {r.doc_id: r.lang_pred for r in language.predictions(docs).collect()}
    out = language.held_out(docs.doc_id)
    from pyspark.sql import functions as F

    lied = docs.withColumn("lang", F.when(out, F.lit("lie")).otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in language.predictions(lied).collect()} == before
    assert before == {k: "left" if k % 2 else "right" for k in range(80)}


def test_restarts_of_the_word_table_change_nothing(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(50)]
    models = [(name, 30, *(part.tobytes() for part in language.suffix_automaton(f" {' '.join(words[k::2])} "))) for k, name in enumerate("ab")]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(30)]
    plain = language.WordCosts(models)
    expected = [plain.of_text(text).tolist() for text in texts]
    monkeypatch.setattr(language, "CACHED_WORDS", 3)
    small = language.WordCosts(models)
    assert [small.of_text(text).tolist() for text in texts] == expected


def test_edge_cases(spark):
    rows = [(k, "uno dos tres", "es", 0.5) for k in range(20)]
    rows += [(100, None, "es", 1.0), (101, "", None, 1.0), (102, "123 ²½ _!", "es", 1.0), (None, "uno dos", "es", 1.0), (103, "uno " * 50_000, None, 1.0)]
    rows += [(5, "uno dos tres", "es", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.predictions(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "es", "es"]
    assert not by_id[None].held_out and by_id[100].score == 0.0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language.predictions(unlabelled).collect()} == {"und"}
    assert language.predictions(docs.limit(0)).count() == 0
