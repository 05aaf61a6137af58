"""Benchmark decontamination: prefix-filtered set join with exact verification.

A window is a run of ``window`` consecutive words of a benchmark item, or all words of a
shorter item. A document holds a window only if it holds all of its words, so for a
containment of 1 the necessary prefix of the window, its words ordered by rarity, is the
rarest one alone. Rarity is the number of documents with the word, counted over all
documents.

Join: document words meet the windows at their prefix word. The offset of that word gives
the only place where the window can lie; it has to lie inside the document (length and
positional bounds), and the words there are compared with the window exactly.

The benchmark is cut into segments of at most ``SEGMENT_WORDS`` windows, and these are dealt
into blocks of about ``BLOCK_BYTES``. Only one block is sent to the tasks at a time,
whatever the size of the benchmark; documents pass all blocks and gather their hits. No
text is shuffled, and a word, passage or item that is found everywhere costs no join.

Defined cases: a null or empty text has no words and is never contaminated; rows of the
benchmark with one item_id are one item; a null item_id counts as an item with an empty id;
items without words have no windows; rows are judged independently, so repeated rows and
null doc_ids need no rule; empty tables give no rows or no hits; the columns asked for are
carried along under neutral names, so any others may clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise import session
from tillwise.llm.tables import Batches, ddl, map_batches, named, neutral, restored, utf8

WINDOW = 13
MIN_SHARE = 20  # contaminated: at least one in so many words is hit
SEGMENT_WORDS = 4096
BLOCK_BYTES = 2_000_000

# The words of the contract: after lower-casing, digits, a to z and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

STATE = "n_words long, hits binary, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


def benchmark_segments(benchmark: DataFrame, window: int) -> DataFrame:
    """Items as segments (item, words): each window lies in one segment."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = words_of(text)
                for start in range(0, max(len(words) - window + 1, min(len(words), 1)), SEGMENT_WORDS):
                    items.append(item or "")
                    texts.append(b" ".join(words[start : start + SEGMENT_WORDS + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], ["item", "words"])

    given = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return map_batches(given, cut, "item string, words string")


class WindowIndex:
    """Windows of one block under their prefix word."""

    def __init__(self, segments: Iterable[tuple[str, str]], window: int):
        self.windows: dict[bytes, list[str]] = defaultdict(list)
        for item, text in segments:
            words = text.encode().split(b" ")
            for start in range(max(len(words) - window, 0) + 1):
                holders = self.windows[b" ".join(words[start : start + window])]
                if item not in holders[-1:]:
                    holders.append(item)
        self.places: dict[bytes, set[tuple[int, int]]] = {}

    def vocabulary(self) -> frozenset[bytes]:
        return frozenset(word for key in self.windows for word in key.split(b" "))

    def order_by(self, documents_with: dict[bytes, int]) -> None:
        """Choose each window's prefix word: the rarest, then the first in byte order."""
        places = defaultdict(set)
        for key in self.windows:
            words = key.split(b" ")
            rarest = min(words, key=lambda word: (documents_with.get(word, 0), word))
            # A word that no document has cannot be met; its windows need no place.
            if documents_with.get(rarest, 0):
                places[rarest].add((words.index(rarest), len(words)))
        self.places = dict(places)

    def find(self, words: list[bytes], hit: bytearray, items: set[str]) -> None:
        """Mark the words of ``words`` inside windows and add the items of these windows."""
        met = self.places.keys() & words
        if not met:
            return
        for at, word in enumerate(words):
            if word in met:
                for offset, length in self.places[word]:
                    start = at - offset
                    if start < 0 or start + length > len(words):
                        continue
                    holders = self.windows.get(b" ".join(words[start : start + length]))
                    if holders:
                        hit[start : start + length] = b"\1" * length
                        items.update(holders)


def _count_words(documents: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents with each word of the vocabulary, over all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Batches) -> Batches:
        known, seen = shared.value, Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                seen.update(known.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    counted = map_batches(documents, count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(row.word): row.n for row in counted.collect()}


def _intervals(hit: bytearray) -> bytes:
    """Starts and ends of the marked runs."""
    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + hit + b"\0", np.int8)))
    return edges.astype("<i8").tobytes()


def _marked(n: int, intervals: bytes | None) -> bytearray:
    hit = bytearray(n)
    edges = np.frombuffer(intervals or b"", "<i8")
    for start, end in zip(edges[::2], edges[1::2]):
        hit[start:end] = b"\1" * int(end - start)
    return hit


def _search(index: WindowIndex, carried: int, text_at: int, keep: int) -> Callable[[Batches], Batches]:
    """Batches of ``carried`` columns, then the state; the first ``keep`` go on with a new state."""

    def search(batches: Batches) -> Batches:
        found = index.value
        for batch in batches:
            states = zip(batch.column(carried + 1).to_pylist(), batch.column(carried + 2).to_pylist())
            counts, hits, items = [], [], []
            for text, (intervals, known) in zip(utf8(batch.column(text_at)), states):
                words = words_of(text)
                hit, names = _marked(len(words), intervals), set(known or ())
                found.find(words, hit, names)
                counts.append(len(words))
                hits.append(_intervals(hit))
                items.append(list(names))
            state = [pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            names = [*batch.schema.names[:keep], "n_words", "hits", "items"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *state], names)

    return search


def _judged(batches: Batches) -> Batches:
    """The state as counts and a digest."""
    for batch in batches:
        at = batch.num_columns - 3
        edges = [np.frombuffer(e, "<i8") for e in batch.column(at + 1).to_pylist()]
        items = batch.column(at + 2).to_pylist()
        digests = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
        added = [
            pa.array([int((e[1::2] - e[::2]).sum()) for e in edges], pa.int64()),
            pa.array([len(i) for i in items], pa.int64()),
            pa.array(digests, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[: at + 1], *added], [*batch.schema.names[: at + 1], "n_hit", "n_items", "items_sha256"]
        )


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW) -> DataFrame:
    """The carried columns c0, c1, ... of every document, with n_words, n_hit, n_items,
    items_sha256 and contaminated."""
    columns = [*carry, *([] if "text" in carry else ["text"])]
    text_at = columns.index("text")
    spark = docs.sparkSession
    segments = session.stored(benchmark_segments(benchmark, window), "benchmark-segments")
    size = segments.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item", "words"), F.lit(max(blocks, 1)))
    state = neutral(docs, columns)
    empty = {"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")}
    state = state.withColumns(empty)
    for k in range(max(blocks, 1)):
        index = WindowIndex(((row.item, row.words) for row in segments.filter(block == k).collect()), window)
        if index.windows:
            index.order_by(_count_words(docs.select(named("text").cast("string")), index.vocabulary()))
        is_last = k == max(blocks, 1) - 1
        keep = len(carry) if is_last else len(columns)
        search = _search(spark.sparkContext.broadcast(index), len(columns), text_at, keep)
        kept = neutral(docs, columns).select(*[f"c{i}" for i in range(keep)])
        state = map_batches(state, search, ddl(kept, STATE))
        state = state if is_last else session.stored(state, "decontamination")
    judged = map_batches(
        state,
        _judged,
        ddl(state.drop("n_words", "hits", "items"), "n_words long, n_hit long, n_items long, items_sha256 string"),
    )
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * MIN_SHARE >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    judged = contamination(docs, benchmark, docs.columns, window)
    return judged.filter(~F.col("contaminated")).select(*restored(docs.columns))
