"""Language-model scores: a log-bilinear model, trained by noise-contrastive estimation.

**Tokens.** Texts in lower case (A-Z), split at ASCII whitespace, each followed by one end.
Counts of the training tokens are taken in the tasks and added up by Spark. Up to ``HEAD`` =
262,144 of the most frequent words go to every task; all others get their counts by a join.

**Model.** Every token has a class: the end and the ``FREQUENT`` most frequent words one
each, other words one of ``SPELLINGS`` by their first and last letters. The vector predicted
from the ``CONTEXT`` classes before a token is the sum of their vectors, each multiplied by
weights of its place; its product with the vector of a class plus a bias is the logarithm of
that class's weight. Weights are divided by their sum over all classes (one matrix product
for a batch of tokens), and a class passes its probability on to its words by count plus one
and to one unknown word. So the probabilities of all words add up to one after any context.

**Training.** Each document trains in one of ``ROUNDS`` rounds. A round sends the parameters
to the tasks; each one goes through its documents in batches of ``BATCH`` tokens, separating
them from ``NOISE`` classes drawn by frequency, with steps scaled per parameter. The
changes, weighted by tokens and as whole numbers, are added up by Spark; what the driver
gets is the size of the model, some 15,000 numbers. The model starts as the class frequencies, so a small
table gives scores near those, never a failure.

Defined cases: a null or empty text is one end; a null doc_id is not held out; rows with equal
doc_id and text are rows of their own; without training documents every count is 0 and all
classes are as likely; texts are read in pieces of a megabyte, so a very long one takes no more
memory than its own bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import session
from tillwise.llm.tables import Batches, kept_between_tasks, map_batches, named, utf8

HELD_OUT_OF, HELD_OUT = 7, 2
HEAD = 1 << 18
FREQUENT, SPELLINGS = 351, 96
DIMENSIONS, CONTEXT = 16, 4
ROUNDS, BATCH, NOISE, RATE = 4, 1_024, 64, 0.1
SCORED_AT_ONCE = 128
# Powers of two with exponents up to this one, and sums over the classes, are single-precision numbers.
LARGEST_EXPONENT = 112.0
SEED = 11

# Longer texts are read in pieces of this size, others together up to so many bytes.
PIECE_BYTES, BYTES_AT_ONCE = 1 << 20, 1 << 23
# Different words a task counts, and tokens it gathers, before it passes them on.
COUNTED_AT_ONCE, GATHERED_TOKENS = 400_000, 1 << 16
COUNT_STEPS = 8
# Changes are added up in units of 2^-24.
FIXED_POINT = 24

# The end is the first class; no word is a newline.
END = b"\n"
CLASSES = 1 + FREQUENT + SPELLINGS
START = CLASSES


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text, about a megabyte at a time; a word is never cut."""
    text = text or b""
    if len(text) <= PIECE_BYTES:
        yield text.lower().split()
        return
    start = 0
    while start < len(text):
        stop = start + PIECE_BYTES
        while stop < len(text) and not text[stop : stop + 1].isspace():
            stop += 1
        yield text[start:stop].lower().split()
        start = stop


class Words:
    """Words of texts, or of a piece of one, in a row: the distinct ones, and which each word is."""

    def __init__(self, words: pa.Array, first: int, ends: list[int], is_last: bool):
        encoded = words.dictionary_encode()
        self.distinct, self.codes = encoded.dictionary, encoded.indices.to_numpy()
        # The row of the first text, where the words of each end, and whether the last is whole.
        self.first, self.ends, self.is_last = first, ends, is_last

    def texts(self) -> Iterator[tuple[int, slice, bool]]:
        """(row, its words, whether the text ends here)."""
        start = 0
        for k, stop in enumerate(self.ends):
            yield self.first + k, slice(start, stop), self.is_last or k + 1 < len(self.ends)
            start = stop

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return self.first + np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))


def words_of(column: pa.Array) -> Iterator[Words]:
    """The words of all texts of a column, some megabytes at a time."""
    is_large = pa.types.is_large_string(column.type)
    column = column.cast(pa.large_binary() if is_large else pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before, long_ones = np.cumsum(sizes) - sizes, np.append(np.flatnonzero(sizes > PIECE_BYTES), len(sizes))
    first = 0
    while first < len(sizes):
        if sizes[first] > PIECE_BYTES:
            for words in pieces(next(utf8(column.slice(first, 1)))):
                yield Words(pa.array(words, pa.binary()), first, [len(words)], False)
            yield Words(pa.array([], pa.binary()), first, [0], True)
            first += 1
            continue
        stop = min(np.searchsorted(before, before[first] + BYTES_AT_ONCE), long_ones[np.searchsorted(long_ones, first)])
        texts = column.slice(first, stop - first).view(pa.large_string() if is_large else pa.string())
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, pa.scalar("", texts.type))))
        # Whitespace at the start or end of a text leaves an empty part.
        words = parts.flatten()
        is_word = np.append(0, np.cumsum(pc.binary_length(words).to_numpy() > 0))
        ends = is_word[np.cumsum(pc.list_value_length(parts).to_numpy())].tolist()
        yield Words(words.filter(pc.greater(pc.binary_length(words), 0)).cast(pa.binary()), first, ends, True)
        first = stop


def spelling(word: bytes) -> int:
    """The class of a word without one of its own."""
    return int(spellings(pa.array([word], pa.binary()))[0])


def spellings(words: pa.Array) -> np.ndarray:
    """The classes of words without ones of their own, by their first, last and a middle letter and their lengths."""
    _, bounds, data = words.buffers()
    bounds = np.frombuffer(bounds, np.int32)[words.offset :][: len(words) + 1]
    letters, starts, sizes = np.frombuffer(data, np.uint8), bounds[:-1], np.diff(bounds)
    first, last, middle = (letters[at].astype(np.int32) for at in (starts, bounds[1:] - 1, starts + np.maximum((sizes - 1) // 2 - 1, 0)))
    return 1 + FREQUENT + (first * 31 + last * 7 + middle + sizes * 3) % SPELLINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the texts; the end counts once a document."""

    def count(batches: Batches) -> Batches:
        found, added, ends = _summed([]), [], 0
        for batch in batches:
            ends += len(batch)
            for words in words_of(batch.column(0)):
                n = np.bincount(words.codes, minlength=len(words.distinct))
                added.append(pa.table([words.distinct, n], COUNTED))
                if sum(map(len, added)) >= COUNTED_AT_ONCE:
                    found, added = _summed([found, *added]), []
                if len(found) >= COUNTED_AT_ONCE:
                    yield from _counted(found)
                    found = _summed([])
        if ends:
            yield from _counted(_summed([found, *added, pa.table([[END], [ends]], COUNTED)]))

    counted = map_batches(docs.select(named("text").alias("text")), count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


COUNTED = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _summed(parts: list[pa.Table]) -> pa.Table:
    """One row for each word."""
    together = pa.concat_tables([COUNTED.empty_table(), *parts])
    return together.group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def _counted(found: pa.Table) -> list[pa.RecordBatch]:
    return found.set_column(0, "word", found.column("word").cast(pa.string())).to_batches()


class Vocabulary:
    """Classes and counts of the frequent words, and the size of every class."""

    def __init__(self, words: list[tuple[bytes, int]], class_tokens: np.ndarray, class_words: np.ndarray):
        self.words = words  # by falling count, then by code point; without the end
        self.class_tokens, self.class_words = class_tokens, class_words
        self.n_tokens, self.n_words = int(class_tokens.sum()), int(class_words.sum())

    def noise(self) -> np.ndarray:
        """Probabilities of the classes, none of them zero."""
        return (self.class_tokens + 1) / (self.n_tokens + CLASSES)

    def ends(self) -> int:
        return int(self.class_tokens[0])


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """From the stored (word, n) of all training tokens.

    The driver gets up to ``HEAD`` words and one row per class. Words are chosen from a
    count on: the smallest step of ``COUNT_STEPS`` per doubling that leaves no more.
    """
    own_words = counts.filter(F.col("word") != END.decode())
    step = F.floor(F.log2("n") * COUNT_STEPS)
    sizes = {row.step: row["count"] for row in own_words.groupBy(step.alias("step")).count().collect()}
    total, least = 0, max(sizes, default=0) + 1
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > HEAD:
            break
        least = at
    found = own_words.filter(step >= least).select("word", "n").toArrow()
    words = list(zip(found.column("word").cast(pa.binary()).to_pylist(), found.column("n").to_pylist()))
    words.sort(key=lambda row: (-row[1], row[0]))
    own = [END, *(word for word, _ in words[:FREQUENT])]

    def classified(batches: Batches) -> Batches:
        for batch in batches:
            words = batch.column(0).cast(pa.binary())
            place = pc.fill_null(pc.index_in(words, value_set=pa.array(own, pa.binary())), -1).to_numpy()
            of = np.where(place < 0, spellings(words), place)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), batch.column(1)], ["class", "n"])

    sizes = map_batches(counts, classified, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in sizes.collect():
        class_tokens[row["class"]], class_words[row["class"]] = row.n, row.words
    return Vocabulary(words, class_tokens, class_words)


class Places(dict):
    """Word -> its place among the frequent words; behind them come the classes, for other words."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((word, place) for place, (word, _) in enumerate(vocabulary.words))
        self.head = len(vocabulary.words)
        others = spellings(pa.array([word for word, _ in vocabulary.words[FREQUENT:]], pa.binary()))
        self.classes = np.concatenate([np.arange(1, min(self.head, FREQUENT) + 1), others, np.arange(CLASSES)]).astype(np.int32)
        counts = np.array([n for _, n in vocabulary.words] + [0] * CLASSES, np.float64)
        self.log_counts = np.log10(counts + 1)

    def of(self, words: pa.Array) -> np.ndarray:
        at = np.fromiter(map(self.get, words.to_numpy(zero_copy_only=False), repeat(-1)), np.int64, len(words))
        beyond = np.flatnonzero(at < 0)
        at[beyond] = self.head + spellings(words.take(pa.array(beyond)))
        return at


class Model:
    """The parameters, and what follows from them."""

    SIZES = {"given": (CLASSES + 1, DIMENSIONS), "predicted": (CLASSES, DIMENSIONS), "places": (CONTEXT, DIMENSIONS), "bias": (CLASSES,)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SIZES.items():
            size = math.prod(shape)
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(map(math.prod, cls.SIZES.values()))

    @classmethod
    def first(cls, noise: np.ndarray) -> Model:
        rng = np.random.Generator(np.random.PCG64(SEED))
        model = cls(rng.normal(0, 0.1, cls.size()).astype(np.float32))
        model.places[:] = 1 / CONTEXT
        model.bias[:] = np.log(noise)
        return model

    def query(self, vectors: np.ndarray) -> np.ndarray:
        """What is predicted behind each ``CONTEXT`` of the vectors in a row, but the last ones."""
        n = len(vectors) - CONTEXT
        query = vectors[CONTEXT - 1 :][:n] * self.places[0]
        for k in range(1, CONTEXT):
            query += vectors[CONTEXT - 1 - k :][:n] * self.places[k]
        return query

    def log_probabilities(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of the classes at these places of a stream."""
        ones = np.ones(CLASSES, np.float32)
        # The bias is one more dimension, in which every query is 1. Weights are powers of two, which take half the time.
        predicted = np.append(self.predicted, self.bias[:, None], axis=1) * np.float32(1 / math.log(2))
        columns, reach = predicted.T.copy(), _longest(predicted)
        weights, found = np.empty((SCORED_AT_ONCE, CLASSES), np.float32), np.empty(len(at))
        for first in range(0, len(at), BATCH):
            here = at[first : first + BATCH]
            part = stream[here[0] - CONTEXT : here[-1] + 1]
            query = self.query(self.given.take(part, axis=0)).take(here - here[0], axis=0)
            query = np.append(query, ones[:1].repeat(len(here))[:, None], axis=1)
            targets = stream[here]
            own, sums, most = (np.zeros(len(here), np.float32) for _ in range(3))
            is_near = _longest(query) * reach <= LARGEST_EXPONENT
            for start in range(0, len(here), SCORED_AT_ONCE):
                rows = slice(start, start + SCORED_AT_ONCE)
                some = np.matmul(query[rows], columns, out=weights[: len(query[rows])])
                own[rows] = some[np.arange(len(some)), targets[rows]]
                if not is_near and some.max() > LARGEST_EXPONENT:
                    most[rows] = some.max(axis=1)
                    some -= most[rows, None]
                np.matmul(np.exp2(some, out=some), ones, out=sums[rows])
            found[first : first + BATCH] = own.astype(np.float64) - most - np.log2(sums.astype(np.float64))
        return found * math.log(2)

    def train(self, stream: np.ndarray, at: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, seen: Model) -> None:
        """One noise-contrastive step over these places of a stream; ``seen`` adds up the squared slopes of every parameter."""
        part, at = stream[at[0] - CONTEXT : at[-1] + 1], at - at[0]
        n, targets = len(part) - CONTEXT, part[CONTEXT:].take(at)
        # Starts of texts stand between the tokens; nothing is predicted there.
        query = self.query(self.given.take(part, axis=0)).take(at, axis=0)
        own, drawn = self.predicted.take(targets, axis=0), self.predicted[noise]
        of_data = _logistic((query * own).sum(axis=1) + self.bias[targets] - log_noise[targets])
        of_data -= 1
        of_noise = query @ drawn.T
        of_noise += (self.bias - log_noise)[noise]
        _logistic(of_noise)

        of_query = of_noise @ drawn
        of_query += of_data[:, None] * own
        slopes = Model(np.zeros(self.flat.size, np.float32))
        slopes.predicted[:] = _added(_cells(targets), of_data[:, None] * query, CLASSES)
        slopes.predicted += _added(_cells(noise), of_noise.T @ query, CLASSES)
        slopes.bias[:] = np.bincount(targets, of_data, CLASSES) + np.bincount(noise, of_noise.sum(axis=0), CLASSES)
        spread, cells = np.zeros((n, DIMENSIONS)), _cells(part)
        spread[at] = of_query
        for k in range(CONTEXT):
            before = slice(CONTEXT - 1 - k, CONTEXT - 1 - k + n)
            of_class = _added(cells[before], spread, CLASSES + 1)
            slopes.places[k] = (self.given * of_class).sum(axis=0)
            slopes.given += self.places[k] * of_class
        seen.flat += slopes.flat**2
        self.flat -= RATE * slopes.flat / np.sqrt(seen.flat + 1e-6)


def _longest(rows: np.ndarray) -> float:
    """The length of the longest row."""
    return math.sqrt(np.einsum("ij,ij->i", rows, rows).max())


def _logistic(x: np.ndarray) -> np.ndarray:
    """In place."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
        x += 1
        return np.reciprocal(x, out=x)


def _cells(rows: np.ndarray) -> np.ndarray:
    """Where the dimensions of the rows are in a matrix without lines."""
    return rows[:, None] * DIMENSIONS + np.arange(DIMENSIONS)


def _added(cells: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by row."""
    return np.bincount(cells.ravel(), values.ravel(), n * DIMENSIONS).reshape(n, DIMENSIONS)


class Stream:
    """Classes of many texts in a row, each text behind ``CONTEXT`` starts."""

    def __init__(self):
        self.parts, self.owners, self.tokens = [], [], 0

    def add(self, owner: int, before: np.ndarray, classes: np.ndarray, is_whole: bool) -> np.ndarray:
        """Add tokens of a text after the classes before them, and its end; returns what is before the next ones."""
        part = np.concatenate([before, classes, ENDS[: int(is_whole)]])
        self.parts.append(part)
        self.owners.append((owner, len(part) - CONTEXT))
        self.tokens += len(part) - CONTEXT
        return STARTS if is_whole else part[-CONTEXT:]

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(classes, places of the tokens among them, owners of the tokens)."""
        stream = np.concatenate(self.parts)
        is_token = np.ones(len(stream), bool)
        starts = np.cumsum([0, *(len(part) for part in self.parts[:-1])])
        is_token[(starts[:, None] + np.arange(CONTEXT)).ravel()] = False
        at = np.flatnonzero(is_token)
        owners = np.repeat(*(np.array(side) for side in zip(*self.owners)))
        return stream, at, owners


STARTS = np.full(CONTEXT, START, np.int32)
ENDS = np.zeros(1, np.int32)


def _trained(docs: DataFrame, shared: Broadcast[Vocabulary], model: Model) -> Model:
    """The model after one round over the documents."""
    start = model.flat

    def work(batches: Batches) -> Batches:
        places = kept_between_tasks("neural-places", shared.value, Places)
        noise = shared.value.noise()
        log_noise = np.log(noise * NOISE).astype(np.float32)
        sums = np.cumsum(noise)
        rng = np.random.Generator(np.random.PCG64(SEED))
        own, seen, stream, trained = Model(start.copy()), Model(np.zeros(start.size, np.float32)), Stream(), 0

        def go(stream: Stream) -> None:
            classes, at, _ = stream.taken()
            for first in range(0, len(at), BATCH):
                drawn = np.minimum(np.searchsorted(sums, rng.random(NOISE) * sums[-1]), CLASSES - 1)
                own.train(classes, at[first : first + BATCH], drawn, log_noise, seen)

        before = STARTS
        for batch in batches:
            for words in words_of(batch.column(0)):
                classes = places.classes[places.of(words.distinct)][words.codes]
                for _, own_words, is_whole in words.texts():
                    before = stream.add(0, before, classes[own_words], is_whole)
                    if is_whole and stream.tokens >= GATHERED_TOKENS:
                        go(stream)
                        trained += stream.tokens
                        stream = Stream()
        if stream.tokens:
            go(stream)
            trained += stream.tokens
        if trained:
            change = np.rint((own.flat - start).astype(np.float64) * (1 << FIXED_POINT)).astype(np.int64)
            change = np.append(change, np.zeros(-len(change) % DIMENSIONS, np.int64)).reshape(-1, DIMENSIONS)
            columns = [pa.array(change[:, d]) for d in range(DIMENSIONS)]
            ids, weight = pa.array(np.arange(len(change), dtype=np.int32)), pa.array(np.full(len(change), trained))
            yield pa.RecordBatch.from_arrays([ids, weight, *columns], ["id", "weight", *(f"v{d}" for d in range(DIMENSIONS))])

    schema = "id int, weight long, " + ", ".join(f"v{d} long" for d in range(DIMENSIONS))
    changes = map_batches(docs.select(named("text").alias("text")), work, schema)
    weight = F.col("weight").cast("decimal(19,0)")
    weighted = [F.sum(F.col(f"v{d}") * weight).alias(f"v{d}") for d in range(DIMENSIONS)]
    moved = start.astype(np.float64)
    for row in changes.groupBy("id").agg(F.sum(weight).alias("weight"), *weighted).collect():
        at = row["id"] * DIMENSIONS
        change = np.array([int(row[f"v{d}"]) / int(row["weight"]) for d in range(DIMENSIONS)]) / (1 << FIXED_POINT)
        moved[at : at + DIMENSIONS] += change[: len(moved) - at]
    return Model(moved.astype(np.float32))


def train(docs: DataFrame, shared: Broadcast[Vocabulary]) -> Model:
    """The model after all rounds over the training documents."""
    model = Model.first(shared.value.noise())
    turn = F.pmod(F.xxhash64(named("doc_id"), named("text")), F.lit(ROUNDS))
    for k in range(ROUNDS):
        model = _trained(docs.filter(turn == k), shared, model)
    return model


TAIL = pa.schema([("row", pa.int64()), ("tail", pa.binary()), ("times", pa.int32())])


def _by_row(rows: np.ndarray, codes: np.ndarray, is_counted: np.ndarray, distinct: pa.Array) -> pa.Table:
    """The counted words of each row and how often they are there, in the order of the rows."""
    pairs, times = np.unique(rows[is_counted] * len(distinct) + codes[is_counted], return_counts=True)
    row, code = np.divmod(pairs, max(len(distinct), 1))
    return pa.table([row, distinct.take(pa.array(code)), times.astype(np.int32)], TAIL)


SCORED = "n_tokens long, n_known long, base_score double, score double, tail array<string>, times array<int>"


def _scored(docs: DataFrame, shared: Broadcast[Vocabulary], model: Model) -> DataFrame:
    """doc_id and, of every document, its scores as far as the frequent words go, and its other words."""
    flat, vocabulary = model.flat, shared.value
    per_token = math.log10(vocabulary.n_tokens + vocabulary.n_words + 1)
    # What a class leaves to one of its words, besides the word's count plus one.
    is_shared = np.arange(CLASSES) > FREQUENT
    per_class = np.where(is_shared, -np.log10(vocabulary.class_tokens + vocabulary.class_words + 1.0), 0.0)

    def work(batches: Batches) -> Batches:
        places, own = kept_between_tasks("neural-places", shared.value, Places), Model(flat)
        known, log_ends = shared.value.ends() > 0, math.log10(shared.value.ends() + 1)
        for batch in batches:
            n = len(batch)
            tokens, hits, base, score = (np.zeros(n) for _ in range(4))
            tails, stream, before = [], Stream(), STARTS

            def go(stream: Stream) -> None:
                classes, at, owners = stream.taken()
                logs = own.log_probabilities(classes, at) / math.log(10) + per_class[classes[at]]
                score[:] += np.bincount(owners, logs, n)

            for words in words_of(batch.column(1)):
                at, rows, codes = places.of(words.distinct), words.rows(), words.codes
                classes, logs, is_beyond = places.classes[at], places.log_counts[at], at >= places.head
                tokens += np.bincount(rows, minlength=n)
                hits += np.bincount(rows, ~is_beyond[codes], n)
                base += np.bincount(rows, logs[codes], n)
                score += np.bincount(rows, np.where(classes > FREQUENT, logs, 0.0)[codes], n)
                tails.append(_by_row(rows, codes, is_beyond[codes], words.distinct))
                of_words = classes[codes]
                for row, own_words, is_whole in words.texts():
                    before = stream.add(row, before, of_words[own_words], is_whole)
                    if is_whole and stream.tokens >= GATHERED_TOKENS:
                        go(stream)
                        stream = Stream()
            if stream.tokens:
                go(stream)
            tokens += 1
            hits += known
            base += log_ends
            tail = pa.concat_tables([TAIL.empty_table(), *tails]).combine_chunks()
            bounds = pa.array(np.searchsorted(tail.column("row").to_numpy(), np.arange(n + 1)), pa.int32())
            tail_words, times = (pa.concat_arrays(tail.column(name).chunks) for name in ("tail", "times"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(tokens.astype(np.int64)),
                    pa.array(hits.astype(np.int64)),
                    pa.array(base - tokens * per_token),
                    pa.array(score),
                    pa.ListArray.from_arrays(bounds, tail_words.cast(pa.string())),
                    pa.ListArray.from_arrays(bounds, times),
                ],
                ["c0", "n_tokens", "n_known", "base_score", "score", "tail", "times"],
            )

    given = docs.select(named("doc_id").alias("c0"), named("text").alias("text"))
    return map_batches(given, work, f"c0 {given.schema['c0'].dataType.simpleString()}, {SCORED}")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    training = docs.filter(~held_out(named("doc_id")))
    counts = session.stored(word_counts(training), "neural-counts")
    vocabulary = learn_vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    model = train(training, shared)
    scored = _scored(docs, shared, model).withColumn("row", F.monotonically_increasing_id())
    scored = session.stored(scored, "neural-scored")
    others = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("of"))
    others = others.select("row", F.col("of.tail").alias("word"), F.col("of.times").alias("times"))
    known = others.join(counts, "word")
    added = known.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("times").alias("known")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("tail", "times").join(added, "row", "left").select(
        F.col("c0").alias("doc_id"),
        held_out(F.col("c0")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
