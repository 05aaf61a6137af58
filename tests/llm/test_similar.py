"""Near duplicates by similarity against brute force, and how many pairs they compare."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_simhash import text_of
from tillwise import session
from tillwise.llm import similar


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_documents_leave_one_and_others_stay(spark):
    rng = random.Random(8)
    rows, partners = [], []
    for _ in range(120):
        base = text_of(rng, rng.randint(80, 400)).split()
        copy = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 60))):
            copy[rng.randrange(len(copy))] = "changed"
        partners.append((len(rows), len(rows) + 1, jaccard(" ".join(base), " ".join(copy))))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    passage = text_of(rng, 60)
    rows += [(len(rows) + k, f"{text_of(rng, 200)} {passage}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in similar.keep_representatives(docs, 5).collect()}
    near = [(a, b) for a, b, j in partners if j >= 0.85]
    assert len(near) > 30 and sum(b not in kept for _, b in near) >= 0.95 * len(near)
    assert {a for a, _, _ in partners} <= kept
    assert set(range(240, 280)) <= kept
    assert all(b in kept for _, b, j in partners if j < 0.6)


def brute_kept(rows, least=0.8):
    """Smallest doc_id of each component of links at exactly the least similarity."""
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for d, w in ((d, t.split()) for d, t in rows)}
    root = {d: d for d in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in shingles:
        for b in shingles:
            if a < b and len(shingles[a] & shingles[b]) >= least * len(shingles[a] | shingles[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d for d in shingles if find(d) == d}


def test_stage_equals_brute_force_at_the_threshold(spark):
    """Pairs around 0.8, and families of a template whose members link in part."""
    rng, rows = random.Random(11), []

    def changed(words, n):
        words = list(words)
        for place in rng.sample(range(len(words)), n):
            words[place] = text_of(rng, 1) + str(rng.randrange(10**6))
        return words

    for _ in range(150):
        base = text_of(rng, rng.randint(60, 300)).split()
        rows += [base, changed(base, rng.randint(1, max(2, len(base) // 30)))]
    for _ in range(3):
        base = text_of(rng, 200).split()
        rows += [changed(base, rng.randint(1, 5)) for _ in range(60)]
    rng.shuffle(rows)
    rows = [(k, " ".join(words)) for k, words in enumerate(rows)]
    expected = brute_kept(rows)
    assert 150 < len(expected) < len(rows) - 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in similar.keep_representatives(docs, 5).collect()} == expected


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(0, 20), st.integers(0, 20), st.integers(0, 10**6))
def test_similar_sets_meet_in_their_prefixes(common, own_a, own_b, seed):
    values = np.random.default_rng(seed).integers(0, 2**64, common + own_a + own_b, np.uint64)
    counts = np.random.default_rng(own_a).integers(0, own_b + 1, similar.BUCKETS)
    a, b = np.sort(values[: common + own_a]), np.sort(np.r_[values[:common], values[common + own_a :]])
    is_similar = Fraction(common, common + own_a + own_b) >= similar.SIMILARITY
    first = [similar.ordered_prefix(side, counts).tolist() for side in (a, b)]
    met = [k for k in first[0] if k in first[1]]
    if is_similar:
        rows = [np.array([len(side), keys.index(met[0])]) for side, keys in zip((a, b), first)]
        assert similar.may_be_similar(*rows)


def test_every_pair_of_a_key_is_compared_once():
    """In growing rounds, over several batches, with copies of a row."""
    rows, met, centers = [(7, k, k, 100, k % 3) for k in range(30) for _ in range(2)] + [(8, 1, 1, 100, 0)], set(), 1
    while rows:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        batch = pa.RecordBatch.from_arrays(columns, ["key", "s1", "s2", "size", "place"])
        found = [r for out in similar.compared(centers)(iter([batch[:9], batch[9:9], batch[9:10], batch[10:]])) for r in out.to_pylist()]
        pairs = [(r["o1"], r["s1"]) for r in found if r["o1"] is not None]
        assert len(pairs) == len(set(pairs)) and not met & set(pairs)
        met |= set(pairs)
        rows = [(r["key"], r["s1"], r["s2"], r["size"], r["place"]) for r in found if r["o1"] is None]
        centers *= similar.CENTERS_GROWTH
    assert met == {(a, b) for b in range(30) for a in range(b)}


def test_members_of_a_group_are_not_compared():
    rows = [(1, k, k, 50, 0, k // 10, 0) for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*("key", "s1", "s2", "size", "place"), "r1", "r2"])
    found = [r for out in similar.compared(5)(iter([batch])) for r in out.to_pylist() if r["o1"] is not None]
    assert {(r["o1"], r["s1"]) for r in found} == {(a, b) for a in range(5) for b in range(10, 20)}


def pairs_compared(spark, monkeypatch, rows):
    counted = []
    plain = session.stored

    def stored(df, purpose):
        result = plain(df, purpose)
        if purpose == "similar-pairs":
            counted.append(result.count())
        return result

    with monkeypatch.context() as patch:
        patch.setattr(session, "stored", stored)
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
        kept = similar.keep_representatives(docs, 5).count()
    return sum(counted), kept


def test_compared_pairs_grow_with_the_texts(spark, monkeypatch):
    rng = random.Random(9)
    passage = text_of(rng, 300)
    sharing = [f"{text_of(rng, 60)} {passage} {text_of(rng, 50)}" for _ in range(300)]
    few, kept = pairs_compared(spark, monkeypatch, sharing[:150])
    assert few < 150 and kept == 150
    many, kept = pairs_compared(spark, monkeypatch, sharing)
    assert many <= 2 * few + 20 and kept == 300


def test_near_copies_cost_a_few_comparisons_each(spark, monkeypatch):
    rng, base = random.Random(10), text_of(random.Random(12), 250).split()
    copies = []
    for _ in range(400):
        words = list(base)
        words[rng.randrange(len(words))] = f"own{rng.randrange(10**9)}"
        copies.append(" ".join(words))
    compared, kept = pairs_compared(spark, monkeypatch, copies)
    assert kept == 1 and compared <= 6 * len(copies)


def test_a_repeated_word_counts_once():
    rng = random.Random(4)
    sets = [similar.shingle_set(("the " * 300 + text_of(rng, 150)).encode(), 5) for _ in range(100)]
    assert all(len(found) <= 151 for found in sets)


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e", 1), (4, "a b c d e", 2), (4, "a b c d e", 3), (None, "alone", 4), (None, "alone", 5), (7, None, 6)]
    docs = spark.createDataFrame([(*r, 1, None) for r in rows], "doc_id long, text string, fp long, s1 int, root string")
    kept = similar.keep_representatives(docs, 5)
    assert kept.columns == ["doc_id", "text", "fp", "s1", "root"]
    left = [(r.doc_id is None, r.text) for r in kept.collect()]
    assert sorted(left, key=str) == sorted([(False, "a b c d e"), (False, None), (True, "alone")], key=str)


def test_text_ids_and_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(80_000))
    docs = spark.createDataFrame([("b", long), ("a", f"{long} more"), ("c", "x")], "doc_id string, text string")
    assert {r.doc_id for r in similar.keep_representatives(docs, 5).collect()} == {"a", "c"}


def test_empty_table(spark):
    assert similar.keep_representatives(spark.createDataFrame([], "doc_id long, text string"), 5).count() == 0
