"""SimHash groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import golay, simhash


def brute_fingerprint(text, size=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """doc_id -> smallest reachable doc_id."""
    fps = {}
    for doc_id, text in rows:
        fps.setdefault(brute_fingerprint(text), []).append(doc_id)
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    smallest = {}
    for fp, ids in fps.items():
        smallest[find(fp)] = min(ids + [smallest.get(find(fp), ids[0])])
    return {doc_id: smallest[find(fp)] for fp, ids in fps.items() for doc_id in ids}


def text_of(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "two words"), (6, "É é"), (7, "é é")]
    for group in range(12):
        base = text_of(rng, 60 + 40 * group).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "third"])
            rows.append((len(rows), " ".join(copy).replace(" ", rng.choice([" ", "  ", "\n"]))))
    rows.append((len(rows), "long " * 70_000 + "end"))
    return rows


def test_components_equal_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: r.component_id for d, r in got.items()} == brute_components(corpus)
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{brute_fingerprint(t):016x}" for d, t in corpus}
    assert len({r.component_id for r in got.values()}) < len(corpus) - 40


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_any_four_flips_share_a_key(fp, flips):
    other = fp
    for bit in flips:
        other ^= 1 << bit
    rows, keys = simhash.keys_of(np.array([fp, other], np.uint64).view(np.int64))
    assert set(keys[rows == 0]) & set(keys[rows == 1])
    for row in (0, 1):
        assert len(set(keys[rows == row])) == (rows == row).sum()


def test_code_is_perfect():
    assert len(set(golay.ERROR_OF_REMAINDER.tolist())) == 2048
    rng = np.random.default_rng(1)
    rows, _ = golay.near_indices(rng.integers(0, 1 << 23, 2000), 23)
    assert np.bincount(rows).max() == 6


def test_trees_connect_without_all_pairs():
    rng = np.random.default_rng(2)
    members = np.unique([np.uint64(1 << int(a) | 1 << int(b)) for a, b in rng.integers(0, 64, (500, 2))]).reshape(-1, 1)
    links = simhash.spanning_links(members, 4)
    assert sum(len(a) for a, _ in links) == len(members) - 1


def test_a_key_may_span_batches(spark):
    fps = spark.range(3000).selectExpr("shiftleft(1L, cast(id % 60 as int)) + shiftleft(1L, cast((id * 7) % 59 as int)) as fp").distinct()
    found = simhash.links(fps).count()
    assert fps.count() - 1 <= found < 50 * fps.count()


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e", 1), (4, "a b c d e", 2), (4, "a b c d e", 3), (None, "alone", 4), (None, "alone", 5), (7, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(4, 4), (4, 4), (7, 7), (None, None), (None, None), (None, 4)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
