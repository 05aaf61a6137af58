"""Windows found against a plain search."""

import hashlib
import random
import re

import pytest

from tillwise.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(lowered)


def plain(doc, items, window):
    w = words(doc)
    hit, found = set(), set()
    for item, text in items:
        v = words(text)
        n = min(window, len(v))
        for at in range(len(v) - n + 1 if n else 0):
            for start in range(len(w) - n + 1):
                if w[start : start + n] == v[at : at + n]:
                    hit |= set(range(start, start + n))
                    found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdÉé") + rng.choice("xy") for _ in range(n))
    items = [(k, text(rng.randint(1, 12))) for k in range(25)] + [(100, None), (101, ""), (102, "the the the the the")]
    items += [(3, "Second, PART of three"), (None, "no id here")]
    docs = [text(rng.randint(0, 80)) for _ in range(60)]
    for _ in range(40):
        a, b = rng.choice(items)[1] or "", rng.choice(items)[1] or ""
        docs.append(f"{text(rng.randint(0, 9))}. {a.upper()}-{b}! {text(rng.randint(0, 200))}")
    docs += [None, "", "second part of three", "no id here", "the " * 3000, "a\x7fb É_é ab"]
    return list(enumerate(docs)), items


@pytest.mark.parametrize("block, segment", [(2_000_000, 4096), (150, 3)])
def test_windows_equal_plain_search(spark, data, monkeypatch, block, segment):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", segment)
    docs, items = data
    if block < 1000:
        docs = docs[::4]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(table, benchmark, ["doc_id"], window=6).collect()
    found = {r.c0: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got}
    assert found == {doc_id: plain(text, items, 6) for doc_id, text in docs}


def test_stage_keeps_clean_rows_and_columns(spark, data):
    passage = " ".join(f"w{k}" for k in range(13))
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, passage, 9, "x"), (2, f"{passage} " + "clean " * 300, 9, "y"), (None, None, None, None), (3, "clean", 1, "z"), (3, "clean", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, items string")
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "3", "None"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == 1
    assert decontamination.decontaminate(docs.limit(0), benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark).count() == 0
