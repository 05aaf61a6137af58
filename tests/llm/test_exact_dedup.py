"""Exact groups against a plain grouping."""

import hashlib
import random

import pytest

from tillwise.llm import exact_dedup


@pytest.mark.parametrize("runs, fan_in", [(64, 4), (1, 2), (7, 2)])
def test_groups_equal_plain_grouping(spark, runs, fan_in):
    rng = random.Random(2)
    rows = [(k, rng.choice(["x", "y", "é", "", None, f"own {k}", "long " * 30_000])) for k in range(120)]
    rows += [(500, "x"), (500, "x"), (None, "only"), (None, "only"), (None, "y")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, group_size int").repartition(6)
    got = exact_dedup.exact_duplicates(docs, runs, fan_in).collect()
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    expected = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for doc_id in ids:
            stays = doc_id == keep and not kept
            kept |= stays
            expected.append((doc_id, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    plain = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got]
    assert sorted(plain, key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_round_sorts_its_runs(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, text string")
    merged = exact_dedup.merge_runs(exact_dedup.text_entries(docs), 64, 4)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Initial Plan")[-1]
    sorts = [line for line in first.splitlines() if "Sort [run" in line and "digest" in line and "keep_id" in line]
    assert len(sorts) == 3 and first.count("Window ") >= 3
