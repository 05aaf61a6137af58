"""Token counts against an independent unigram segmenter."""

import random

import pytest
from tokenizers import Tokenizer, models

from tillwise.llm import token_counts
from tillwise.llm.registry import VOCABULARY


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary(VOCABULARY)


@pytest.fixture(scope="module")
def reference(vocabulary):
    worst = min(vocabulary.values())
    pieces = [("<unk>", worst), *vocabulary.items(), *[(f"<0x{b:02X}>", worst - 50) for b in range(256)]]
    model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    return lambda text: sum(len(model.encode(p.replace(" ", "▁")).ids) for p in token_counts.pre_tokens(text))


TEXTS = [
    "Hello world, this is a test of 12345 numbers.",
    "éèê Ünïcödé  double  spaces\n\nlines\ttabs\r\n",
    "日本語のテキスト 😀😀 mixed 𝔘𝔫𝔦",
    " leading and trailing ",
    "a" * 300 + " " + "internationalisation" * 40,
    "\n",
]


def test_counts_equal_an_independent_segmenter(spark, vocabulary, reference):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdeé \n😀z") for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in token_counts.document_tokens(docs, vocabulary).collect()}
    assert {k: got[k].n_tokens for k in got} == {k: reference(text) for k, text in enumerate(texts)}
    assert {k: got[k].n_pretokens for k in got} == {k: len(token_counts.pre_tokens(t)) for k, t in enumerate(texts)}


def test_restart_and_rolling_change_nothing(vocabulary, monkeypatch):
    plain = token_counts.PrefixTrie(vocabulary)
    expected = [plain.of_text(text) for text in TEXTS * 2]
    monkeypatch.setattr(token_counts, "MAX_NODES", 5)
    monkeypatch.setattr(token_counts, "LONGEST_SHARED", 3)
    small = token_counts.PrefixTrie(vocabulary)
    assert [small.of_text(text) for text in TEXTS * 2] == expected


def test_shared_prefixes_are_scored_once(vocabulary, monkeypatch):
    scored = []
    best = token_counts.PrefixTrie._best
    monkeypatch.setattr(token_counts.PrefixTrie, "_best", lambda self, word, end, *rest: scored.append(word[:end]) or best(self, word, end, *rest))
    token_counts.PrefixTrie(vocabulary).of_text("walk walking walked walker walking")
    assert len(scored) == len(set(scored))


def test_edge_cases(spark, vocabulary):
    rows = [(1, None, 5), (None, "", 6), (2, "x", 7), (2, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.document_tokens(docs, vocabulary).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert token_counts.document_tokens(docs.limit(0), vocabulary).count() == 0
    assert [r.n_tokens for r in token_counts.document_tokens(docs.filter("text = 'x'").limit(1), {}).collect()] == [1 + 3]
