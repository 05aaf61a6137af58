"""Language-model scores: counts and base scores against plain ones, sums of probabilities, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tillwise.llm import neural_scores as neural

SCHEMA = "doc_id long, text string, word string, row long, c0 int"


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens_of(text):
    return [*(text or "").encode().lower().split(), neural.END]


@pytest.fixture(scope="module")
def rows():
    """Two invented languages; the words before a word tell which one it is from."""
    rng = random.Random(5)
    words = [[f"{a}{b}{c}" for a in first for b in "aeiou" for c in last] for first, last in (("bdg", "lmn"), ("ptk", "rsz"))]
    rows = []
    for k in range(900):
        own = words[k % 2]
        rows.append((k, " ".join(rng.choice(own[: rng.choice([5, 20, 45])]).title() for _ in range(rng.randint(1, 60)))))
    rows += [(2000, None), (2001, ""), (2002, " \t\n\x0b\x0c\r "), (None, "bal BAL ÉtÉ"), (None, None), (3, rows[3][1])]
    rows += [(3000 + k, f"rare{k} rare{k} unseen") for k in range(20)] + [(4000, "long " * 50_000 + "tail" * 1000)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, None) for row in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def found(spark, rows):
    return neural.scores(table(spark, rows)).collect()


def check_base(rows, found):
    counts = Counter(t for doc_id, text in rows if not is_held_out(doc_id) for t in tokens_of(text))
    total = sum(counts.values())
    expected = Counter()
    for doc_id, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in tokens)
        known = sum(counts[t] > 0 for t in tokens)
        expected[doc_id, is_held_out(doc_id), len(tokens), known, total, f"{base:.6e}"] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6e}") for r in found)
    assert got == expected


def test_base_scores(rows, found):
    check_base(rows, found)


def test_words_beyond_the_frequent_ones_are_joined(spark, rows, found, monkeypatch):
    monkeypatch.setattr(neural, "HEAD", 400)
    few = neural.scores(table(spark, rows)).collect()
    check_base(rows, few)
    whole = {(r.doc_id, r.n_tokens): r.score for r in found}
    # The parts of the training differ from run to run only by the order of the rows.
    assert np.mean([abs(r.score - whole[r.doc_id, r.n_tokens]) / r.n_tokens for r in few]) < 0.05


def test_held_out_texts_gain(found):
    gain = {kind: [(r.score - r.base_score) / r.n_tokens for r in found if r.held_out is kind and r.n_tokens > 10] for kind in (True, False)}
    assert len(gain[True]) > 50
    assert np.mean(gain[True]) > 0.1 and abs(np.mean(gain[True]) - np.mean(gain[False])) < 0.1


def learned(spark, rows):
    docs = table(spark, rows)
    training = docs.filter(~neural.held_out(docs.doc_id))
    counts = neural.session.stored(neural.word_counts(training), "test-counts")
    vocabulary = neural.learn_vocabulary(counts)
    return docs, counts, vocabulary, neural.train(training, spark.sparkContext.broadcast(vocabulary))


def test_scores_are_those_of_the_model_and_probabilities_add_up(spark, rows):
    docs, counts, vocabulary, model = learned(spark, rows)
    n = {row.word.encode(): row.n for row in counts.collect()}
    own = {word: k + 1 for k, (word, _) in enumerate(vocabulary.words[: neural.FREQUENT])} | {neural.END: 0}
    class_of = {word: own.get(word, None) or (0 if word == neural.END else neural.spelling(word)) for word in n}
    given, predicted, places = (getattr(model, k).astype(np.float64) for k in ("given", "predicted", "places"))

    def log_classes(context):
        weights = predicted @ sum(given[c] * places[j] for j, c in enumerate(context)) + model.bias
        return weights - np.logaddexp.reduce(weights)

    def log_word(word, logs):
        k = class_of.get(word, None)
        if k is None:
            k = neural.spelling(word)
        if k <= neural.FREQUENT:
            return logs[k]
        inside = [n[w] for w in n if class_of[w] == k]
        return logs[k] + math.log((n.get(word, 0) + 1) / (sum(inside) + len(inside) + 1))

    scored = neural._scored(docs, spark.sparkContext.broadcast(vocabulary), model).collect()
    chosen = [r for r in scored if r.n_tokens < 70][:25]
    texts = {(doc_id, len(tokens_of(text))): text for doc_id, text in rows}
    for r in chosen:
        before, total = [neural.START] * neural.CONTEXT, 0.0
        for token in tokens_of(texts[r.c0, r.n_tokens]):
            total += log_word(token, log_classes(before))
            before = [class_of.get(token, None) if token in class_of else neural.spelling(token), *before[:-1]]
        assert r.score == pytest.approx(total / math.log(10), abs=1e-3)
    # All known words and one unknown word for each class of spellings.
    logs = log_classes([5, 400, neural.START, neural.START])
    mass = sum(math.exp(log_word(word, logs)) for word in n)
    for k in range(neural.FREQUENT + 1, neural.CLASSES):
        inside = [n[w] for w in n if class_of[w] == k]
        mass += math.exp(logs[k]) / (sum(inside) + len(inside) + 1)
    mass += sum(math.exp(logs[k]) for k in range(len(vocabulary.words) + 1, neural.FREQUENT + 1))
    assert mass == pytest.approx(1, abs=1e-9)


def test_empty_and_all_held_out(spark):
    assert neural.scores(spark.createDataFrame([], SCHEMA)).collect() == []
    doc_id = next(k for k in range(100) if is_held_out(k))
    only = neural.scores(spark.createDataFrame([(doc_id, "a b", None, None, None)], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in only] == [(3, 0, 0, 0.0)]
    assert only[0].score < 0


def test_pieces_keep_words_whole(monkeypatch):
    monkeypatch.setattr(neural, "PIECE_BYTES", 7)
    text = "ab cdefghijklmnop  q r ÉÉÉÉÉÉ x" * 3
    assert [w for words in neural.pieces(text.encode()) for w in words] == text.encode().lower().split()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_in_a_row_are_those_of_the_texts(monkeypatch, kind):
    monkeypatch.setattr(neural, "PIECE_BYTES", 60)
    monkeypatch.setattr(neural, "BYTES_AT_ONCE", 100)
    every_sign = "A" + "".join(f"{chr(k)}b" for k in range(128))
    texts = [None, "", "x Y  z", " \t\n\x0b\x0c\r ", every_sign, " long ÉA" * 40, None, "x", "LONG" * 50, "", "a b", None, "", " A"] * 3
    column = pa.array(["cut off", *texts], kind)[1:]
    found = [[] for _ in texts]
    wholes = []
    for words in neural.words_of(column):
        distinct = words.distinct.to_pylist()
        assert len(set(distinct)) == len(distinct)
        for row, own, is_whole in words.texts():
            found[row] += [distinct[k] for k in words.codes[own]]
            assert (words.rows()[own] == row).all()
            wholes += [row] * is_whole
    assert found == [(text or "").encode().lower().split() for text in texts]
    assert wholes == list(range(len(texts)))


def test_a_word_is_looked_up_once_for_many_texts(monkeypatch):
    looked_up = []
    vocabulary = neural.Vocabulary([(b"a", 2), (b"b", 1)], np.ones(neural.CLASSES, np.int64), np.ones(neural.CLASSES, np.int64))
    places = neural.Places(vocabulary)
    monkeypatch.setattr(neural.Places, "of", lambda self, words, of=neural.Places.of: looked_up.append(len(words)) or of(self, words))
    column = pa.array(["a b other " * 50] * 1000)
    at = np.concatenate([places.of(words.distinct)[words.codes] for words in neural.words_of(column)])
    assert at.tolist() == [0, 1, 2 + neural.spelling(b"other")] * 50_000
    assert sum(looked_up) == 3


def a_stream(rng, sizes):
    stream = neural.Stream()
    for row, size in enumerate(sizes):
        stream.add(row, neural.STARTS, rng.integers(0, neural.CLASSES, size).astype(np.int32), True)
    return stream.taken()


def test_a_step_is_that_of_each_token_and_place():
    rng = np.random.default_rng(3)
    noise_of = rng.random(neural.CLASSES) + 0.1
    noise_of /= noise_of.sum()
    log_noise = np.log(noise_of * neural.NOISE).astype(np.float32)
    for sizes in ([2000], [5, 0, 40, 1, 900, 30]):
        classes, at, owners = a_stream(rng, sizes)
        assert np.bincount(owners).tolist() == [size + 1 for size in sizes]
        at, drawn = at[7:907], rng.integers(0, neural.CLASSES, neural.NOISE)
        model = neural.Model.first(noise_of)
        model.places[:] = rng.random(model.places.shape)
        first, seen = neural.Model(model.flat.astype(np.float64)), neural.Model(np.zeros(model.flat.size, np.float32))
        model.train(classes, at, drawn, log_noise, seen)

        slopes = neural.Model(np.zeros(first.flat.size))
        for place in at:
            context = classes[place - 1 - np.arange(neural.CONTEXT)]
            query = (first.given[context] * first.places).sum(axis=0)
            of_query = 0
            for k, is_data in [(classes[place], 1), *((k, 0) for k in drawn)]:
                of = 1 / (1 + np.exp(-(first.predicted[k] @ query + first.bias[k] - log_noise[k]))) - is_data
                slopes.predicted[k] += of * query
                slopes.bias[k] += of
                of_query = of_query + of * first.predicted[k]
            for j, k in enumerate(context):
                slopes.given[k] += first.places[j] * of_query
                slopes.places[j] += first.given[k] * of_query
        assert np.sqrt(seen.flat) == pytest.approx(np.abs(slopes.flat), rel=1e-3, abs=1e-3)
        moved = first.flat - neural.RATE * slopes.flat / np.sqrt(slopes.flat**2 + 1e-6)
        assert model.flat == pytest.approx(moved, abs=2e-3)


@pytest.mark.parametrize("scale", [0.1, 30.0])
def test_probabilities_are_normalised_however_large_the_weights(scale):
    rng = np.random.default_rng(4)
    classes, at, _ = a_stream(rng, [0, 3, 1500, 7, 0, 0, 400])
    model = neural.Model((rng.normal(0, scale, neural.Model.size())).astype(np.float32))
    exact = neural.Model(model.flat.astype(np.float64))
    contexts = classes[at[:, None] - np.arange(1, neural.CONTEXT + 1)]
    weights = (exact.given[contexts] * exact.places).sum(axis=1) @ exact.predicted.T + exact.bias
    expected = weights[np.arange(len(at)), classes[at]] - np.logaddexp.reduce(weights, axis=1)
    assert model.log_probabilities(classes, at) == pytest.approx(expected, rel=1e-4, abs=1e-3)
