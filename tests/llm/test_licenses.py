"""License scans against plain TF-IDF and a walk up the directories."""

import math
import re
from collections import Counter

import pytest

from tillwise.llm import licenses, registry

APACHE, MIT, GPL = licenses.TEMPLATES["Apache-2.0"][0], licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
FILES = [
    (1, "p/LICENSE", "Some project\n\n" + licenses.TEMPLATES["MIT"][1]),
    (2, "p/src/a.c", "// " + APACHE + "\nint main;"),
    (3, "p/src/b.c", "int main;"),
    (4, "p/src/deep/er/c.c", None),
    (5, "p/src/deep/COPYING.txt", GPL),
    (6, "q/d.c", "text\n" * 2000 + MIT + "\n" + "more\n" * 2000),
    (7, "q/e.c", ""),
    (8, None, GPL),
    (9, None, "nothing"),
    (10, "LICENSE", "licensed to somebody else altogether"),
    (11, "p/src/f.c", GPL + "\n" + APACHE),
    (12, "p/src/b.c", "int main;"),
]


def plain_scores():
    """statement -> (license, cosine)."""
    found = set()
    for doc_id, path, text in FILES:
        if text and re.search(licenses.CUE, text):
            lines = [line for line in text.split("\n") if re.search(licenses.CUE, line)]
            if path and re.search(licenses.LICENSE_FILE, path.split("/")[-1]):
                lines.append(text)
            found |= {(doc_id, line) for line in lines}
    terms = lambda text: Counter(re.findall(licenses.TERM, text.lower()))
    templates = [(name, terms(text)) for name, texts in licenses.TEMPLATES.items() for text in texts]
    with_term = Counter()
    for _, line in found:
        with_term.update(terms(line).keys())
    for _, template in templates:
        with_term.update(template.keys())
    total = len(found) + len(templates)
    vector = lambda bag: {t: n * (1 + math.log(total / with_term[t])) for t, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    scores = {}
    for _, line in found:
        v = vector(terms(line))
        cosines = []
        for name, template in templates:
            t = vector(template)
            dot = sum(x * t.get(term, 0) for term, x in v.items())
            cosines.append((-round(dot / (norm(v) * norm(t)), 6) if v else 0, name))
        scores[line] = (min(cosines)[1], -min(cosines)[0])
    return found, scores


def test_scan_equals_plain_version(spark):
    found, scores = plain_scores()
    own = {}
    for doc_id, line in found:
        name, cosine = scores[line]
        if cosine >= licenses.MIN_COSINE:
            own[doc_id] = min(own.get(doc_id, (1, "")), (-cosine, name))
    at = {}
    for doc_id, path, _ in FILES:
        if path and doc_id in own and re.search(licenses.LICENSE_FILE, path.split("/")[-1]):
            at[path.rpartition("/")[0]] = own[doc_id]
    expected = {}
    for doc_id, path, _ in FILES:
        answer = (own[doc_id], "own") if doc_id in own else (None, "none")
        directory = path.rpartition("/")[0] if path else None
        while doc_id not in own and directory is not None:
            if directory in at:
                answer = (at[directory], "inherited")
                break
            directory = directory.rpartition("/")[0] if directory else None
        expected[doc_id] = answer
    docs = spark.createDataFrame(FILES, "doc_id long, path string, text string").repartition(4)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(FILES)
    for doc_id, (best, origin) in expected.items():
        assert got[doc_id].origin == origin
        assert got[doc_id].license == (best[1] if best else None)
        assert got[doc_id].cosine == (pytest.approx(-best[0], abs=2e-6) if best else None)
    assert {d: r.license for d, r in got.items()} == {
        1: "MIT", 2: "Apache-2.0", 3: "MIT", 4: "GPL-3.0", 5: "GPL-3.0", 6: "MIT", 7: None, 8: "GPL-3.0", 9: None,
        10: None, 11: got[11].license, 12: "MIT",
    }


def test_every_template_is_found_as_itself(spark):
    rows = [(name, None, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
    docs = spark.createDataFrame(rows, "doc_id string, path string, text string")
    assert all(r.license == r.doc_id and r.cosine > 0.999 for r in licenses.scan(docs).collect())


def test_null_ids_repeats_empty(spark):
    rows = [(None, None, MIT, 1), (None, None, MIT, 2), (None, "x/y", None, 3), (3, None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string, license int")
    got = sorted((r.doc_id or 0, r.license or "", r.origin) for r in licenses.scan(docs).collect())
    assert got == [(0, "", "none"), (0, "MIT", "own"), (0, "MIT", "own"), (3, "", "none")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_documents_inherit_from_a_text_that_is_mostly_a_license(spark, tmp_path):
    rows = [
        (1, "Some words.\n" + MIT, "en", "a"),
        (2, "nothing of the kind", "en", "a"),
        (3, "nothing of the kind", "fr", "a"),
        (4, "word " * 200 + "\n" + GPL, "en", "b"),
        (5, None, "en", "b"),
        (6, APACHE + "\n" + "word " * 200, "en", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.origin) for r in registry._licenses(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: (None, "none"),
        4: ("GPL-3.0", "own"), 5: (None, "none"), 6: ("Apache-2.0", "own"),
    }
