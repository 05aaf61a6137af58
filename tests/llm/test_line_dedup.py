"""Line deduplication: properties that any right result has, and exact small cases."""

import random

import numpy as np
import pytest
import xxhash

from tillwise.llm import line_dedup

MIN = 6


def line(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))


def runs(lines):
    found = set()
    for start in range(len(lines)):
        words, end = 0, start
        while end < len(lines) and words < MIN:
            words += len(lines[end].split())
            end += 1
        if words >= MIN:
            found.add("\n".join(lines[start:end]))
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passages = [[line(rng, rng.randint(1, 5)) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    docs = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += rng.choice(passages) if rng.random() < 0.6 else [line(rng, rng.randint(0, 4)) for _ in range(3)]
        docs.append("\n".join(lines))
    docs += [docs[0]] * 10 + [None, "", "\n\n", "short", "\n".join(line(rng, 7) for _ in range(3000))]
    return list(enumerate(docs))


def test_every_common_run_stays_once_and_nothing_unique_goes(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    got = {r.c0: r for r in line_dedup.remove_repeats(docs, ["doc_id"], MIN).collect()}
    assert len(got) == len(corpus)
    earlier_lines, earlier_runs = set(), set()
    for doc_id, text in corpus:
        before = text.split("\n") if text else []
        row = got[doc_id]
        after = row.kept_text.split("\n") if row.n_removed and row.kept_text else (before if not row.n_removed else [])
        assert row.n_lines == len(before)
        if row.n_removed < row.n_lines:
            assert len(after) == len(before) - row.n_removed
        # What goes stands in an earlier document; a document without a common run keeps everything.
        for gone in set(before) - set(after):
            assert gone in earlier_lines
        if not runs(before) & earlier_runs:
            assert row.n_removed == 0 and row.kept_text == text
        kept = iter(after)
        assert not [run for run in _untouched_runs(before, kept) if run in earlier_runs]
        earlier_lines |= set(before)
        earlier_runs |= runs(before)


def _untouched_runs(before, kept):
    """Runs of the original that are still whole, by matching the kept lines to the original in order."""
    kept = list(kept)
    stands, k = [], 0
    for text in before:
        stays = k < len(kept) and kept[k] == text
        stands.append(stays)
        k += stays
    whole = set()
    for start in range(len(before)):
        words, end = 0, start
        while end < len(before) and words < MIN and stands[end]:
            words += len(before[end].split())
            end += 1
        if words >= MIN:
            whole.add("\n".join(before[start:end]))
    return whole


def pack(lines):
    return (
        b"".join(xxhash.xxh3_128_digest(text.encode()) for text in lines),
        np.array([len(text.split()) for text in lines], "<i4").tobytes(),
    )


def test_blocks_moved_and_repeated():
    one, two = [f"one {k} w w" for k in range(3)], [f"two {k} w w" for k in range(3)]
    first = [*one, "middle", *two]
    later = ["own", *two, "between", *one, *two, "end"]
    assert line_dedup.removed_lines(pack(later), pack(first), MIN) == [1, 2, 3, 5, 6, 7, 8, 9, 10]


def test_short_blocks_stay():
    assert line_dedup.removed_lines(pack(["a b", "c d", "x"]), pack(["a b", "y", "c d"]), MIN) == []


def test_short_repeated_lines_go_by_default(spark):
    rows = [(k, f"own {k} a\n\n  Subscribe to our newsletter \nown {k} b\nAgree") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.c0: r.kept_text for r in line_dedup.remove_repeats(docs, ["doc_id"]).collect()}
    assert got.pop(0) == rows[0][1]
    for k, text in got.items():
        assert [line for line in text.split("\n") if line] == [f"own {k} a", f"own {k} b"]


def test_patience_prefers_unique_lines():
    a = [b"{", b"f", b"}", b"{", b"g", b"}"]
    b = [b"{", b"g", b"}"]
    assert line_dedup.patience_matches(a, b) == [(0, 0), (4, 1), (5, 2)]


def test_stage_follows_n_chars_and_drops_what_is_left_empty(spark):
    text = "one two three four five six seven"
    rows = [(2, text, 33, "x"), (1, text, 33, "y"), (3, text + "\nrest", 38, "z"), (4, None, None, None), (None, text, 33, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, late string")
    got = line_dedup.without_repeats(docs, MIN)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, text, 33, "y"), (3, "rest", 4, "z"), (4, None, None, None)], key=str
    )


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.without_repeats(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f g")] * 3, "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.remove_repeats(rows, ["doc_id"], MIN).collect()] == [0, 0, 0]
