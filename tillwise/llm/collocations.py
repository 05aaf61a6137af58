"""Phrase collocations: direct-address tiles of frequency-ranked ids, re-ranked recursively.

**Words.** Texts in lower case (A-Z) fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into
words at spaces and tabs. Words are counted per language in the tasks and added up by Spark.
Those with ``MIN_COUNT`` = 100 occurrences get ids by falling count; no other word can be part
of a candidate. The documents are stored once as ids, other words and the ends of pieces as
gaps.

**Pairs.** A phrase of m + 1 words is a pair: the id of its first m words and the id of the
last one. Pairs of ids fall into tiles of ``TILE`` x ``TILE``; as ids follow the counts, the
pairs crowd into few tiles. A task counts a crowded tile by bincount into one dense array and
all pairs of sparse tiles in sorted coordinates. Spark adds up the counts of the tasks, the
pairs with ``MIN_COUNT`` occurrences are ranked by count, and their ranks are the ids of the
next round, up to ``LONGEST`` words. A pair is counted only where its first and its last m
words are frequent themselves, which no candidate's can fail to be.

**Whole results at every size.** The ``HEAD`` = 262,144 most frequent words and phrases of
each length are known to every task. Where there are more, the tasks pass on the words or
pairs they do not know, a join finds the ids of the rest, and they are filled in: nothing
grows with the table but the joins.

**Scores.** Every cut of a candidate takes the counts of both sides from the table of frequent
phrases by joins; products are decimals of 38 digits. A candidate goes if one that is a word
longer occurs as often: one that is longer still can occur as often only if that one does.

Defined cases: null and empty texts have no words; a null language is ``und``; rows that
repeat count each; doc_ids are not read; a document's words stay together, so a very long text
takes memory in proportion to itself; equal scores are ordered by count, then by the bytes of
the phrase; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise import session
from tillwise.llm.tables import ROWS_AT_ONCE, Batches, kept_between_tasks, map_batches, named, utf8, values

MIN_COUNT, LONGEST, TOP = 100, 5, 2_000
PER_SCORE = 1_000
HEAD = 1 << 18
TILE = 1_024
# Pairs in a tile from which on it is counted in a dense array.
CROWDED = TILE * TILE // 32
COUNTED_AT_ONCE, ENCODED_AT_ONCE, PAIRED_AT_ONCE = 200_000, 1 << 13, 1 << 19
# Row groups of the documents as ids: a task holds one of its column's parts whole, on the heap and outside it.
BLOCK_BYTES = 8 << 20

UNDETERMINED = "und"
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
# No word is a full stop: it stands for every end of a piece, and in the counts for all words.
BREAK = b"."
PLAIN = bytes.maketrans(
    bytes(range(65, 91)) + SEPARATORS + b"\t", bytes(range(97, 123)) + BREAK * len(SEPARATORS) + b" "
)
GAP = -1


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, with breaks between its pieces."""
    return text.translate(PLAIN).replace(BREAK, b" . ").split() if text else []


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(named("lang"), F.lit(UNDETERMINED)).alias("lang"), named("text").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of every word, and of all words of a language as the word ``.``."""

    def count(batches: Batches) -> Batches:
        found: defaultdict[str, Counter[bytes]] = defaultdict(Counter)
        held = 0
        for batch in batches:
            for lang, text in zip(values(batch.column(0)), utf8(batch.column(1))):
                words = tokens(text)
                own = found[lang]
                breaks, before = own[BREAK], len(own)
                own.update(words)
                own[BREAK] = breaks + len(words) - words.count(BREAK)
                held += len(own) - before
                if held >= COUNTED_AT_ONCE:
                    yield from (_counted(lang, own) for lang, own in found.items())
                    found.clear()
                    held = 0
        yield from (_counted(lang, own) for lang, own in found.items())

    counted = map_batches(_given(docs), count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(lang: str, found: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array(found.keys(), pa.binary()).cast(pa.string())
    langs = pa.array([lang] * len(found), pa.string())
    return pa.RecordBatch.from_arrays([langs, words, pa.array(found.values(), pa.int64())], ["lang", "word", "n"])


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows``, stored, with ``id`` = 0, 1, ... in an order that has no ties.

    Ranges are ranked side by side; only their numbers of rows come to the driver.
    """
    ranges = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranges = session.stored(ranges, "phrase-ranges")
    before, offsets = 0, []
    for row in ranges.groupBy("part").count().orderBy("part").collect():
        offsets += [F.lit(row["part"]), F.lit(before).cast("long")]
        before += row["count"]
    offset = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0).cast("long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return session.stored(ranges.withColumn("id", place + offset).drop("part"), "phrase-ids")


class Words(dict):
    """(lang, word) -> id as one dictionary per language."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        super().__init__()
        for place, (lang, word) in enumerate(rows):
            self.setdefault(lang, {})[word] = place


def encode(docs: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """(key, ids): the documents as ids, some thousand words a row, stored."""
    head = words.filter(F.col("id") < HEAD).orderBy("id").select("lang", "word").toArrow()
    rows = list(zip(head.column("lang").to_pylist(), head.column("word").cast(pa.binary()).to_pylist()))
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    is_whole = n_words <= HEAD

    def work(batches: Batches) -> Batches:
        known, held, unknown, size = kept_between_tasks("phrase-words", shared.value, Words), [], {}, 0
        for batch in batches:
            for lang, text in zip(values(batch.column(0)), utf8(batch.column(1))):
                words, own = tokens(text), known.get(lang, {})
                if is_whole:
                    ids = np.array([own.get(word, GAP) for word in words], np.int64)
                else:
                    # Words that the task does not know: -2, -3, ... until the join has found them.
                    ids = [own.get(word) for word in words]
                    for k, word in enumerate(words):
                        if ids[k] is None:
                            ids[k] = GAP if word == BREAK else -2 - unknown.setdefault((lang, word), len(unknown))
                    ids = np.array(ids, np.int64)
                # One gap is as good as many.
                is_gap = ids == GAP
                held += [ids[~is_gap | ~np.roll(is_gap, 1)], np.array([GAP])]
                size += len(held[-2]) + 1
                if size >= ENCODED_AT_ONCE:
                    yield _encoded(held, unknown)
                    held, unknown, size = [], {}, 0
        if held:
            yield _encoded(held, unknown)

    schema = "ids binary, unknown array<struct<lang:string,word:string>>"
    encoded = map_batches(_given(docs), work, schema).withColumn("key", F.monotonically_increasing_id())
    encoded = session.stored(encoded, "phrase-documents", BLOCK_BYTES)
    if is_whole:
        return encoded.select("key", "ids")
    asked = encoded.select("key", F.posexplode("unknown").alias("place", "of")).select("key", "place", "of.*")
    found = asked.join(words.filter(F.col("id") >= HEAD).select("lang", "word", "id"), ["lang", "word"])
    return _filled(encoded.select("key", "ids"), found.select("key", "place", "id"), _fill_words)


def _encoded(held: list[np.ndarray], unknown: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
    ids = np.concatenate(held).astype(np.int64)
    asked = [{"lang": lang, "word": word.decode()} for lang, word in unknown]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([asked], kind)], ["ids", "unknown"])


def _fill_words(ids: np.ndarray, places: np.ndarray, found: np.ndarray) -> np.ndarray:
    """References -2, -3, ... replaced by what was found for their places, or gaps."""
    of = np.full(int(-2 - ids.min(initial=GAP)) + 1, GAP)
    of[places] = found
    return np.where(ids < GAP, of[np.maximum(-2 - ids, 0)] if len(of) else GAP, ids)


def _fill_phrases(ids: np.ndarray, places: np.ndarray, found: np.ndarray) -> np.ndarray:
    ids[places] = found
    return ids


def _filled(encoded: DataFrame, found: DataFrame, fill) -> DataFrame:
    """The last column of ``encoded`` with the ids (key, place, id) filled in, stored."""
    names = encoded.columns
    lists = found.groupBy("key").agg(F.collect_list(F.struct("place", "id")).alias("of"))
    lists = lists.select("key", F.col("of.place").alias("places"), F.col("of.id").alias("found"))
    met = encoded.join(lists, "key", "left")
    given = met.select("places", "found", *encoded.columns)

    def work(batches: Batches) -> Batches:
        for batch in batches:
            new = []
            for places, ids, old in zip(batch.column(0), batch.column(1), values(batch.column(batch.num_columns - 1))):
                sides = [np.array(side.as_py() or [], np.int64) for side in (places, ids)]
                new.append(fill(np.frombuffer(old, np.int64).copy(), *sides).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:-1], pa.array(new, pa.binary())], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)
    return session.stored(map_batches(given, work, kinds), f"phrase-{names[-1]}", BLOCK_BYTES)


# The largest products, of three counts, have some 35 digits.
SCORE = (
    f"(CAST({PER_SCORE} AS DECIMAL(5,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)))"
    " div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
)

Level = tuple[int, np.ndarray, np.ndarray]


def _pairs(phrases: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Places whose phrase of ``length`` words goes on with a word, both ends being frequent."""
    if len(words) <= length:
        return np.empty(0, np.int64)
    goes_on = (phrases[:-length] >= 0) & (phrases[1 : len(phrases) - length + 1] >= 0) & (words[length:] >= 0)
    return np.flatnonzero(goes_on)


def next_phrases(phrases: np.ndarray, words: np.ndarray, n_words: int, level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the phrases that are a word longer, and the places and codes of pairs not known."""
    length, codes, ids = level
    at = _pairs(phrases, words, length - 1)
    code = phrases[at] * n_words + words[at + length - 1]
    longer = np.full(len(words), GAP)
    if not len(codes):
        return longer, at, code
    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    is_known = codes[place] == code
    longer[at[is_known]] = ids[place[is_known]]
    return longer, at[~is_known], code[~is_known]


def pair_counts(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, n) of all pairs: crowded tiles in dense arrays, others in sorted coordinates."""
    wide = int(last.max(initial=0)) // TILE + 1
    tile = first // TILE * wide + last // TILE
    tiles, of, sizes = np.unique(tile, return_inverse=True, return_counts=True)
    for k in np.flatnonzero(sizes >= CROWDED):
        row, column = divmod(int(tiles[k]), wide)
        inside = of == k
        dense = np.bincount((first[inside] - row * TILE) * TILE + last[inside] - column * TILE, minlength=TILE * TILE)
        code = np.flatnonzero(dense)
        yield code // TILE + row * TILE, code % TILE + column * TILE, dense[code]
    sparse = (sizes < CROWDED)[of]
    width = int(last.max(initial=0)) + 1
    code, n = np.unique(first[sparse] * width + last[sparse], return_counts=True)
    yield code // width, code % width, n


def count_pairs(encoded: DataFrame, shared: Broadcast[tuple[int, list[Level]]], length: int) -> DataFrame:
    """(first, last, n) of all phrases of ``length`` words; ``first`` has one word less.

    ``encoded`` has (key, ids), or (key, ids, phrases) where phrases were filled in.
    """
    columns = encoded.columns[1:]

    def work(batches: Batches) -> Batches:
        n_words, levels = shared.value
        firsts, lasts, size = [], [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            for sides in pair_counts(np.concatenate(firsts), np.concatenate(lasts)):
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in sides], ["first", "last", "n"])

        for batch in batches:
            for row in zip(*(values(column) for column in batch.columns)):
                words, phrases = np.frombuffer(row[0], np.int64), np.frombuffer(row[-1], np.int64)
                for level in levels:
                    phrases, _, _ = next_phrases(phrases, words, n_words, level)
                at = _pairs(phrases, words, length - 1)
                firsts.append(phrases[at])
                lasts.append(words[at + length - 1])
                size += len(at)
                if size >= PAIRED_AT_ONCE:
                    yield from counted()
                    firsts, lasts, size = [], [], 0
        if size:
            yield from counted()

    counted = map_batches(encoded.select(*columns), work, "first long, last long, n long")
    return counted.groupBy("first", "last").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _fill_level(
    encoded: DataFrame, table: DataFrame, shared: Broadcast[tuple[int, list[Level]]]
) -> DataFrame:
    """(key, ids, phrases) with the phrases of the last level, those beyond ``HEAD`` by a join."""

    def work(batches: Batches) -> Batches:
        n_words, levels = shared.value
        for batch in batches:
            for row in zip(*(values(column) for column in batch.columns)):
                words, phrases = np.frombuffer(row[1], np.int64), np.frombuffer(row[-1], np.int64)
                for level in levels:
                    phrases, at, code = next_phrases(phrases, words, n_words, level)
                asked = [{"place": int(p), "first": int(c) // n_words, "last": int(c) % n_words} for p, c in zip(at, code)]
                kind = pa.list_(pa.struct([("place", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[:1], pa.int64()), pa.array(row[1:2], pa.binary()), pa.array([phrases.tobytes()], pa.binary()), pa.array([asked], kind)],
                    ["key", "ids", "phrases", "unknown"],
                )

    schema = "key long, ids binary, phrases binary, unknown array<struct<place:long,first:long,last:long>>"
    known = session.stored(map_batches(encoded, work, schema), "phrase-asked", BLOCK_BYTES)
    asked = known.select("key", F.explode("unknown").alias("of")).select("key", "of.*")
    found = asked.join(table.filter(F.col("id") >= HEAD).select("first", "last", "id"), ["first", "last"])
    return _filled(known.select("key", "ids", "phrases"), found.select("key", "place", "id"), _fill_phrases)


def frequent_phrases(docs: DataFrame, words: DataFrame, longest: int = LONGEST) -> list[DataFrame]:
    """Tables (id, lang, phrase, n) of the frequent phrases of 1, 2, ... words, stored."""
    spark = docs.sparkSession
    n_words = words.count()
    named_words = words.select("id", "lang", F.col("word").alias("phrase"), "n")
    tables, levels = [named_words], []
    if not n_words:
        return tables
    encoded = encode(docs, words, n_words)
    last_word = words.select(F.col("id").alias("last"), "word")
    for length in range(2, longest + 1):
        shared = spark.sparkContext.broadcast((n_words, levels))
        found = ranked(count_pairs(encoded, shared, length), F.desc("n"), F.col("first"), F.col("last"))
        before = tables[-1].select(F.col("id").alias("first"), "lang", F.col("phrase").alias("before"))
        joined = found.join(before, "first").join(last_word, "last")
        phrase = F.concat_ws(" ", "before", "word").alias("phrase")
        tables.append(session.stored(joined.select("id", "lang", phrase, "n"), "phrase-texts"))
        size = found.count()
        if not size:
            break
        head = found.filter(F.col("id") < HEAD).select("first", "last", "id").toArrow()
        first, last, ids = (head.column(c).to_numpy() for c in ("first", "last", "id"))
        code = first * n_words + last
        order = np.argsort(code)
        levels = [*levels, (length, code[order], ids[order])]
        if size > HEAD and length < longest:
            encoded = _fill_level(encoded, found, spark.sparkContext.broadcast((n_words, levels)))
            levels = []
    return tables


def scored(tables: list[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one covers; (lang, n) has all words."""
    known = tables[0].select("lang", "phrase", "n", F.lit(1).alias("words"))
    for words, table in enumerate(tables[1:], start=2):
        known = known.union(table.select("lang", "phrase", "n", F.lit(words).alias("words")))
    candidates = known.filter("words > 1").withColumnRenamed("n", "a")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).selectExpr(
        "*", "substring_index(phrase, ' ', k) AS first_words", "substring_index(phrase, ' ', k - words) AS other_words"
    )
    left = known.select("lang", F.col("phrase").alias("first_words"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("other_words"), F.col("n").alias("r"))
    cut = cut.join(left, ["lang", "first_words"]).join(right, ["lang", "other_words"])
    worst = cut.join(totals, "lang").withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a", "n")
    worst = worst.agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.filter("words > 2").selectExpr(
        "lang", "a", "explode(array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words))) AS phrase"
    )
    left_over = worst.join(longer, ["lang", "phrase", "a"], "left_anti")
    return left_over.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _few_rows_at_once(spark: SparkSession) -> ExitStack:
    """Some hundred rows in a batch, for rows with thousands of words: a batch of the usual number of rows is
    64 MB and more of each task's memory, held by the reader, outside the heap on its way to Python, and there.
    """
    settings = ExitStack()
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        settings.enter_context(session.setting(spark, name, str(ROWS_AT_ONCE)))
    return settings


def collocations(docs: DataFrame, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` candidates of each language."""
    with _few_rows_at_once(docs.sparkSession):
        counts = session.stored(
            word_counts(docs).filter((F.col("n") >= MIN_COUNT) | (F.col("word") == BREAK.decode())), "phrase-words"
        )
        is_total = F.col("word") == BREAK.decode()
        totals = counts.filter(is_total).select("lang", "n")
        words = ranked(counts.filter(~is_total), F.desc("n"), F.col("lang"), F.col("word"))
        tables = frequent_phrases(docs, words, longest)
    found = scored(tables, totals)
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
