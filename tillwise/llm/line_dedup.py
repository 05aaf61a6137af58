"""Line deduplication by pairwise alignment.

Lines are compared without the white space at their ends. From every line of a document
starts a run: the line and as many after it as make ``min_words`` words. Two documents
have a common block of that many words just if they share a run. A document is paired with
the *first* holder of each of its runs (smallest doc_id), so a run that n documents share
gives n - 1 pairs, and no bound on partners or on the frequency of lines is needed. By
default (``MIN_WORDS`` = 1) every line with a word is a run, so that each repeated line goes;
a higher number is an option that leaves shorter blocks in.

A pair is aligned with patience diff: lines that are unique in both, in their longest common
order, split the documents, and the parts between them are aligned the same way. Runs that
it leaves (moved or repeated passages) are looked up directly. Aligned blocks of at least
``min_words`` words are deleted from the later document. The first holder of a passage
keeps it, so every deleted line still stands in an earlier document.

Only hashes of lines (128 bits) and word counts are joined; texts are read when lines are
counted and when they are deleted.

Defined cases: a null or empty text has no lines and stays as it is; documents with fewer
words than ``min_words`` stay; documents are ordered by doc_id, null ids last, then by a
hash of the text; rows that agree in both are one document and lose the same lines; an
empty table gives no rows; carried columns have neutral names, so any others may clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import session
from tillwise.llm.tables import Batches, ddl, map_batches, named, neutral, restored, utf8

MIN_WORDS = 1

KEY = ["late", "id", "text_hash"]
KEY_TYPES = "late int, id long, text_hash long"
HASH_BYTES = 16


def _key(doc_id: Column, text: Column) -> list[Column]:
    """Order and identity of a document."""
    return [
        doc_id.isNull().cast("int").alias("late"),
        F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("text_hash"),
    ]


def document_lines(docs: DataFrame) -> DataFrame:
    """One row per document with the hashes of its lines and their numbers of words."""

    def split(batches: Batches) -> Batches:
        for batch in batches:
            hashes, words = [], []
            for text in utf8(batch.column(3)):
                lines = [line.strip() for line in text.split(b"\n")] if text else []
                hashes.append(b"".join([xxhash.xxh3_128_digest(line) for line in lines]))
                words.append(np.array([len(line.split()) for line in lines], "<i4").tobytes())
            added = [pa.array(hashes, pa.binary()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], [*KEY, "hashes", "words"])

    given = docs.select(*_key(named("doc_id"), named("text")), named("text"))
    return map_batches(given, split, f"{KEY_TYPES}, hashes binary, words binary").dropDuplicates(KEY)


def run_ends(words: np.ndarray, min_words: int) -> np.ndarray:
    """End of the run from each line; beyond the number of lines where words do not suffice."""
    total = np.cumsum(words)
    before = total - words
    return np.searchsorted(total, before + min_words) + 1


def run_keys(hashes: bytes, words: bytes, min_words: int) -> list[bytes]:
    """Key of the run from each line that has one, in order."""
    ends = run_ends(np.frombuffer(words, "<i4"), min_words)
    n = len(hashes) // HASH_BYTES
    return [
        xxhash.xxh3_128_digest(hashes[start * HASH_BYTES : end * HASH_BYTES])
        for start, end in enumerate(ends.tolist())
        if end <= n
    ]


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(key, run) of all different runs of each document."""

    def emit(batches: Batches) -> Batches:
        for batch in batches:
            found = [
                list(set(run_keys(hashes, words, min_words)))
                for hashes, words in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(runs) for runs in found]))
            runs = pa.array([run for runs in found for run in runs], pa.binary())
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[:3]], runs], [*KEY, "run"])

    return map_batches(lines, emit, f"{KEY_TYPES}, run binary")


def overlapping(lines: DataFrame, min_words: int) -> DataFrame:
    """Pairs of a document and the first holder of one of its runs (first_late, first_id, first_text_hash)."""
    runs = _runs(lines, min_words)
    shared = runs.groupBy("run").agg(F.min(F.struct(*KEY)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = session.stored(shared.select("run", "first"), "shared-runs")
    return (
        runs.join(shared, "run")
        .filter(F.struct(*KEY) != F.col("first"))
        .select(*KEY, *[F.col(f"first.{part}").alias(f"first_{part}") for part in KEY])
        .distinct()
    )


def patience_matches(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (i, j) of two lists of lines, in order."""
    matches, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        a_low, a_high, b_low, b_high = parts.pop()
        while a_low < a_high and b_low < b_high and a[a_low] == b[b_low]:
            matches.append((a_low, b_low))
            a_low, b_low = a_low + 1, b_low + 1
        while a_low < a_high and b_low < b_high and a[a_high - 1] == b[b_high - 1]:
            a_high, b_high = a_high - 1, b_high - 1
            matches.append((a_high, b_high))
        anchors = _increasing(_unique_common(a, a_low, a_high, b, b_low, b_high))
        if not anchors:
            continue
        # Parts begin at an anchor, which their common start then matches.
        bounds = [(a_low, b_low), *anchors, (a_high, b_high)]
        for (i, j), (next_i, next_j) in zip(bounds, bounds[1:]):
            if i < next_i and j < next_j:
                parts.append((i, next_i, j, next_j))
    return sorted(matches)


def _unique_common(a, a_low, a_high, b, b_low, b_high) -> list[tuple[int, int]]:
    in_a, in_b = Counter(a[a_low:a_high]), Counter(b[b_low:b_high])
    place = {line: j for j, line in enumerate(b[b_low:b_high], b_low) if in_b[line] == 1}
    return [(i, place[line]) for i, line in enumerate(a[a_low:a_high], a_low) if in_a[line] == 1 and line in place]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing second places (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before[k] = piles[pile - 1] if pile else -1
        tops[pile:pile + 1] = [j]
        piles[pile:pile + 1] = [k]
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def removed_lines(later: tuple[bytes, bytes], first: tuple[bytes, bytes], min_words: int) -> list[int]:
    """Lines of the later document, given as hashes and word counts, in blocks that the first one has."""
    a, b = ([h[k : k + HASH_BYTES] for k in range(0, len(h), HASH_BYTES)] for h in (later[0], first[0]))
    words = np.frombuffer(later[1], "<i4").tolist()
    removed: set[int] = set()
    block: list[int] = []
    past = (-2, -2)
    for i, j in [*patience_matches(a, b), (-2, -2)]:
        if block and (i, j) != (past[0] + 1, past[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                removed.update(block)
            block = []
        block.append(i)
        past = (i, j)
    places: dict[bytes, int] = {}
    for j, run in enumerate(run_keys(*first, min_words)):
        places.setdefault(run, j)
    ends = run_ends(np.array(words), min_words)
    for i, run in enumerate(run_keys(*later, min_words)):
        j = places.get(run)
        if j is not None and not removed.issuperset(range(i, ends[i])):
            while i < len(a) and j < len(b) and a[i] == b[j]:
                removed.add(i)
                i, j = i + 1, j + 1
    return sorted(removed)


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, removed): for each document that loses lines, lists of their places."""
    lines = session.stored(document_lines(docs), "document-lines")
    first = lines.select(
        *[F.col(part).alias(f"first_{part}") for part in KEY],
        F.col("hashes").alias("first_hashes"),
        F.col("words").alias("first_words"),
    )
    pairs = (
        overlapping(lines, min_words)
        .join(lines, KEY)
        .join(first, [f"first_{part}" for part in KEY])
        .select(*KEY, "hashes", "words", "first_hashes", "first_words")
    )

    def align(batches: Batches) -> Batches:
        for batch in batches:
            a, wa, b, wb = (column.to_pylist() for column in batch.columns[3:])
            found = [removed_lines((p, q), (r, s), min_words) for p, q, r, s in zip(a, wa, b, wb)]
            removed = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], removed], [*KEY, "removed"])

    aligned = map_batches(pairs, align, f"{KEY_TYPES}, removed array<int>")
    return aligned.groupBy(*KEY).agg(F.collect_list("removed").alias("removed"))


def remove_repeats(docs: DataFrame, carry: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    """The carried columns c0, c1, ... of every document, with kept_text, n_lines and n_removed."""
    columns = [*carry, *(c for c in ("doc_id", "text") if c not in carry)]
    text_at, keep = columns.index("text"), len(carry)
    doc_id, text = (named(f"c{columns.index(c)}") for c in ("doc_id", "text"))
    given = neutral(docs, columns).select("*", *_key(doc_id, text))
    joined = given.join(removals(docs, min_words), KEY, "left").drop(*KEY)

    def delete(batches: Batches) -> Batches:
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, places in zip(batch.column(text_at).to_pylist(), batch.column(len(columns)).to_pylist()):
                split = text.split("\n") if text else []
                gone = set().union(*places) if places else ()
                texts.append("\n".join([line for k, line in enumerate(split) if k not in gone]) if gone else text)
                lines.append(len(split))
                removed.append(len(gone))
            added = [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]
            names = [*batch.schema.names[:keep], "kept_text", "n_lines", "n_removed"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *added], names)

    kept = given.select(*[f"c{i}" for i in range(keep)])
    return map_batches(joined, delete, ddl(kept, "kept_text string, n_lines long, n_removed long"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the blocks that earlier ones have, with all their columns.

    ``n_chars``, where there is such a column, follows the text of a document that lost
    lines. Documents that lost all of their lines go.
    """
    columns = docs.columns
    changed = F.col("n_removed") > 0
    new = dict(zip(columns, restored(columns)))
    new["text"] = F.col("kept_text").alias("text")
    if "n_chars" in columns:
        old = F.col(f"c{columns.index('n_chars')}")
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(old).alias("n_chars")
    carry = [column if column != "text" else "doc_id" for column in columns]
    left = remove_repeats(docs, carry, min_words).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.select(*[new[column] for column in columns])
