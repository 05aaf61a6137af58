"""The pipeline on the smallest data, stage by stage."""

import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tillwise import session


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(session.stored(stage(spark, results[-1], SMALL), name))
    return results


def test_order_and_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    for result in stages[:-1]:
        assert result.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "copies"]


def test_each_stage_only_takes_away(stages):
    ids = [{r.doc_id for r in result.select("doc_id").collect()} for result in stages]
    for before, after in zip(ids, ids[1:]):
        assert after <= before and after


def test_last_two_stages_against_plain_versions(stages):
    from tests.llm.test_decontamination import plain

    items = [(r.item_id, r.text) for r in stages[0].sparkSession.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = stages[3].collect()
    clean = {r.doc_id for r in before if not plain(r.text, items, 13)[4]}
    assert {r.doc_id for r in stages[4].collect()} == clean
    taken, sizes = {}, {}
    for r in stages[4].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    for r in stages[5].collect():
        taken[r.source] = taken.get(r.source, 0) + r.copies * len(r.text.encode().split())
    from tests.llm.test_mixing import plain_targets

    for source, target in plain_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 0.25 * target + 50


def test_near_duplicates_leave_one_of_each_group(stages):
    """Similar by sets of shingles: gone; what goes has a similar document before it."""
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    before = {r.doc_id: shingles(r.text) for r in stages[2].collect()}
    kept = {r.doc_id for r in stages[3].collect()}
    root = {doc_id: doc_id for doc_id in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in before:
        for b in before:
            if a < b and 5 * len(before[a] & before[b]) >= 4 * len(before[a] | before[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert kept == {doc_id for doc_id in before if find(doc_id) == doc_id}


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[-1].collect()))
