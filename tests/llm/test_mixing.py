"""Mixing: targets against plain water filling, words taken against the targets."""

import random
from fractions import Fraction

import pytest

from tillwise.llm import mixing


def plain_targets(sizes):
    """source -> target by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: Fraction(3 * sizes[s]) if s in full else Fraction(weight[s] * rest, free) for s in order}
        above = {s for s in order if target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    rows = []
    for source, n, longest in [("a", 300, 400), ("b", 40, 50), ("B", 200, 30), (None, 60, 300), ("é", 1, 90), ("z", 5, 5), ("y", 30, 40)]:
        rows += [(source, " ".join("w" * 1 for _ in range(rng.randint(0, longest)))) for _ in range(n)]
    rows += [("a", None), ("a", " \t\n"), ("z", "x " * 3000)]
    rng.shuffle(rows)
    return [(k, source, text) for k, (source, text) in enumerate(rows)]


def test_targets_and_words_taken(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    sizes, taken = {}, {}
    for doc_id, source, text in rows:
        row = got[doc_id]
        assert row.size == len((text or "").split())
        assert row.taken == row.copies * row.size and 0 <= row.copies <= 3
        sizes[source] = sizes.get(source, 0) + row.size
        taken[source] = taken.get(source, 0) + row.taken
    expected = plain_targets(sizes)
    for doc_id, source, _ in rows:
        assert got[doc_id].source_size == sizes[source]
        assert got[doc_id].target == pytest.approx(float(expected[source]), rel=1e-12)
    for source, target in expected.items():
        # One document cannot be divided; elsewhere little is missing.
        assert taken[source] == pytest.approx(float(target), abs=max(3, 0.002 * float(target)) + (45 if source == "é" else 0))
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {doc_id: row.taken for doc_id, row in got.items()}


def test_many_slices_meet_the_target_as_well(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 50)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(docs).join(docs, "doc_id").filter("source = 'a'").selectExpr("sum(taken)", "max(target)").first()
    assert found[0] == pytest.approx(found[1], rel=0.01)


def test_rates_solve_the_dual(spark):
    histogram = spark.createDataFrame([("a", 1, 10), ("a", 100, 5), ("b", 7, 3)], "source string, size long, n long")
    goals = spark.createDataFrame(
        [("a", 510, 1200.0, False), ("b", 21, 2.0, False)], "source string, source_size long, target double, full boolean"
    )
    solved = {r.source: r for r in mixing.solve(histogram, goals).collect()}
    import math

    def words(source):
        row = solved[source]
        return sum(
            n * s * 3 / (1 + 2 * math.exp(-row.tilt * s / row.scale))
            for of, s, n in [("a", 1, 10), ("a", 100, 5), ("b", 7, 3)]
            if of == source
        )

    assert words("a") == pytest.approx(1200, abs=0.6) and words("b") == pytest.approx(2, abs=0.6)


def test_stage_keeps_columns_and_edge_cases(spark):
    rows = [(1, "s", "a b c", 1), (None, None, None, 2), (1, "s", "a b c", 3), (2, None, "d e", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "source", "text", "size", "copies"]
    kept = mixed.collect()
    assert len(kept) == len({r["size"] for r in kept}) and all(r.copies > 0 for r in kept)
    assert mixing.mix(docs).count() == 4
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, "b", None)], "doc_id long, source string, text string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_large_ids_beside_a_null_one(spark):
    ids = [2**53 + 1, 2**53 + 3, None]
    docs = spark.createDataFrame([(i, "s", f"a b {k}") for k, i in enumerate(ids)], "doc_id long, source string, text string")
    assert {r.doc_id for r in mixing.mix(docs).collect()} == set(ids)
    mixed = mixing.mixed_documents(docs).collect()
    assert {r.doc_id: r.copies for r in mixed} == {i: 1 for i in ids}
