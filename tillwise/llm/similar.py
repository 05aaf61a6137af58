"""Near duplicates by similarity: SimHash keys first, then an exact join of shingle sets.

Two texts link if the Jaccard similarity of their sets of shingle hashes is at least 0.8;
one document of each group that links connect stays.

1. **Golay keys.** Fingerprints of the sets (a bit is set if over half of the different
   hashes have it) link at 4 of 64 bits as in :mod:`tillwise.llm.simhash`. Of the links of a
   fingerprint one is looked at, so a group costs no more comparisons than it has members.
   A comparison is always that of the whole sets.
2. **What stays apart.** Four bits are far nearer than 0.8, so an exact join of the sets
   finds the other links: with the hashes of every set in one common order, two similar
   sets share one of their first |S| - ceil(0.8 |S|) + 1 hashes. The order is by rarity, as
   counted for ``BUCKETS`` ranges of hashes over all documents: a passage that many texts
   share comes last and makes no candidates, unless it is most of the text. Lengths, and how
   much can still be shared behind the common hash, rule out further pairs.
3. **Rounds.** Sets that share a hash meet sorted in one place, where the first is compared
   with all others; whoever is then connected needs no comparison with each other. Where
   some are not, the next 16, 256 and so on are compared with those after them. A pair is
   compared once, and never inside a group.

No step guesses: every pair at 0.8 or more is compared or already connected.

Defined cases: null and empty texts have the empty set and are one group; fewer words than a
shingle are one shingle; a repeated word or line counts once; a very long text is hashed 65,536
shingles at a time; null doc_ids stay only where a group has no other; of equal rows one
stays; of equally small ids the smallest hash of the text stays; an empty table gives no rows;
carried columns have neutral names, so any others may clash.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import session
from tillwise.llm.components import components
from tillwise.llm.simhash import bit_counts, links, shingle_hashes
from tillwise.llm.tables import Batches, map_batches, named, neutral, restored, utf8

SIMILARITY = Fraction(4, 5)
# Ranges of hashes whose occurrences are counted to order them by rarity.
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
# First members of a hash that a round compares with the rest, and how many more the next one does.
CENTERS, CENTERS_GROWTH = 1, 16
EMITTED_AT_ONCE, REMEMBERED_SETS = 50_000, 20_000


def shingle_set(text: bytes | None, shingle_words: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    found = [np.unique(hashes.astype(np.uint64)) for hashes in shingle_hashes(text, shingle_words)]
    if len(found) < 2:
        return found[0] if found else np.empty(0, np.uint64)
    return np.unique(np.concatenate(found))


def set_id(hashes: np.ndarray) -> tuple[int, int]:
    """Two numbers that are equal for equal sets."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist())


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def set_fingerprint(hashes: np.ndarray) -> int:
    return int(np.packbits(bit_counts(hashes.astype(">u8")) * 2 > len(hashes)).view(">i8")[0])


def prefix_size(size: int, similarity: Fraction = SIMILARITY) -> int:
    """How many of a set's first hashes meet those of every similar set."""
    return size - -(-size * similarity.numerator // similarity.denominator) + 1 if size else 0


def node(first: str, second: str) -> Column:
    return F.struct(F.col(first).alias("s1"), F.col(second).alias("s2"))


def _described(docs: DataFrame, shingle_words: int) -> DataFrame:
    """A row per document, and a row per task with the shingles it has seen by bucket."""

    def work(batches: Batches) -> Batches:
        seen, id_kind = np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            rows, id_kind = [], batch.schema.types[0]
            for text in utf8(batch.column(2)):
                hashes = shingle_set(text, shingle_words)
                np.add.at(seen, buckets_of(hashes), 1)
                rows.append((*set_id(hashes), set_fingerprint(hashes), len(hashes)))
            n = len(batch)
            of_set = [pa.array([row[k] for row in rows], pa.int64()) for k in range(len(DESCRIBED))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *of_set, pa.nulls(n, LIST), pa.nulls(n, LIST)],
                [*batch.schema.names[:2], *DESCRIBED, "buckets", "counts"],
            )
        met = np.flatnonzero(seen)
        if len(met):
            lists = [pa.array([side.tolist()], LIST) for side in (met, seen[met])]
            nothing = [pa.nulls(1, kind) for kind in (id_kind, *[pa.int64()] * 5)]
            yield pa.RecordBatch.from_arrays([*nothing, *lists], ["doc_id", "text_hash", *DESCRIBED, "buckets", "counts"])

    given = docs.select(named("doc_id").alias("doc_id"), F.xxhash64(named("text")).alias("text_hash"), named("text").alias("text"))
    kind = given.schema["doc_id"].dataType
    added = ", ".join(f"{name} long" for name in DESCRIBED)
    schema = f"doc_id {kind.simpleString()}, text_hash long, {added}, buckets array<long>, counts array<long>"
    return map_batches(given, work, schema)


LIST = pa.list_(pa.int64())
DESCRIBED = ["s1", "s2", "fp", "size"]


def _rarity(described: DataFrame) -> np.ndarray:
    """Occurrences by bucket; the driver gets one row for each of the ``BUCKETS``."""
    each = described.filter("buckets is not null").select(F.explode(F.arrays_zip("buckets", "counts")).alias("of"))
    sums = each.groupBy(F.col("of.buckets").alias("bucket")).agg(F.sum("of.counts").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return counts


def ordered_prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes of a sorted set in the order of rarity."""
    order = np.argsort(counts[buckets_of(hashes)], kind="stable")
    return hashes[order[: prefix_size(len(hashes))]]


def _prefixes(docs: DataFrame, counts: np.ndarray, shingle_words: int) -> DataFrame:
    """(key, s1, s2, size, place) of the first hashes of every set; copies may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Batches) -> Batches:
        done: set[tuple[int, int]] = set()
        parts, rows = [], 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                hashes = shingle_set(text, shingle_words)
                own = set_id(hashes)
                if not len(hashes) or own in done:
                    continue
                if len(done) >= REMEMBERED_SETS:
                    done.clear()
                done.add(own)
                keys = ordered_prefix(hashes, shared.value).view(np.int64)
                parts.append((keys, *own, len(hashes)))
                rows += len(keys)
                if rows >= EMITTED_AT_ONCE:
                    yield _prefix_rows(parts)
                    parts, rows = [], 0
        if parts:
            yield _prefix_rows(parts)

    return map_batches(docs.select(named("text").alias("text")), work, "key long, s1 long, s2 long, size long, place long")


def _prefix_rows(parts: list[tuple]) -> pa.RecordBatch:
    keys, *of_set = zip(*parts)
    times = [len(k) for k in keys]
    places = np.concatenate([np.arange(n) for n in times])
    columns = [np.concatenate(keys), *(np.repeat(np.array(side, np.int64), times) for side in of_set), places]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "s1", "s2", "size", "place"])


def may_be_similar(a: np.ndarray, b: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    """Which pairs (rows of size, place of the common hash) can reach the similarity."""
    p, q = similarity.numerator, similarity.denominator
    small, large = np.minimum(a[..., 0], b[..., 0]), np.maximum(a[..., 0], b[..., 0])
    # The common hash and what is left behind it.
    most = np.minimum(a[..., 0] - a[..., 1], b[..., 0] - b[..., 1])
    return (small * q >= large * p) & (most * (p + q) >= p * (small + large))


def compared(centers: int) -> Callable[[Batches], Batches]:
    """Pairs of each key's first members with those after them, and what is left to compare.

    The rows (key, s1, s2, size, place and perhaps the root r1, r2) come sorted. A pair is a row
    with the other set in o1, o2. Where two or more members come after the first ones, these
    members are rows with o1, o2 null. Only first members are held.
    """

    def work(batches: Batches) -> Batches:
        key, firsts, pending, last = None, None, None, None
        pairs, left, held = [], [], 0
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(batch.num_columns)], axis=1)
            if not len(rows):
                continue
            if rows.shape[1] == 5:
                rows = np.concatenate([rows, rows[:, 1:3]], axis=1)
            # Copies of a set from several tasks.
            before = np.concatenate([rows[:1] - 1 if last is None else last, rows[:-1]])
            last = rows[-1:]
            rows = rows[(rows[:, :3] != before[:, :3]).any(axis=1)]
            if not len(rows):
                continue
            starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            ends = np.r_[starts[1:], len(rows)]
            # A key goes on from the last batch, or may go on in the next one.
            is_many = (ends - starts > 1) | (rows[starts, 0] == key) | (ends == len(rows))
            for start, end in zip(starts[is_many], ends[is_many]):
                run = rows[start:end]
                if run[0, 0] != key:
                    key, firsts, pending = run[0, 0], run[:0], None
                room = centers - len(firsts)
                new, rest = run[:room], run[max(room, 0) :]
                for k, first in enumerate(np.concatenate([firsts, new])):
                    pairs.append(_with(first, run[max(k - len(firsts) + 1, 0) :]))
                    held += len(pairs[-1])
                    if held >= EMITTED_AT_ONCE:
                        yield _compared_rows(pairs, left)
                        pairs, left, held = [], [], 0
                firsts = np.concatenate([firsts, new])
                if pending is None and len(rest) == 1:
                    pending = rest  # waits for a second one
                elif len(rest):
                    left += [rest] if pending is None else [pending, rest]
                    pending = rest[:0]
                    held += len(rest)
        if held:
            yield _compared_rows(pairs, left)

    return work


def _with(first: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rows of the pairs of one member with others that can be similar and have another root."""
    can = may_be_similar(first[3:5], others[:, 3:5]) & (first[5:7] != others[:, 5:7]).any(axis=1)
    return np.concatenate([others[can, :5], np.broadcast_to(first[1:3], (int(can.sum()), 2))], axis=1)


def _compared_rows(pairs: list[np.ndarray], left: list[np.ndarray]) -> pa.RecordBatch:
    paired, rest = (np.concatenate([np.empty((0, 7), np.int64), *rows]) for rows in (pairs, left))
    whole = np.concatenate([paired[:, :5], rest[:, :5]])
    columns = [pa.array(whole[:, k]) for k in range(5)]
    columns += [pa.concat_arrays([pa.array(paired[:, k]), pa.nulls(len(rest), pa.int64())]) for k in (5, 6)]
    return pa.RecordBatch.from_arrays(columns, ["key", "s1", "s2", "size", "place", "o1", "o2"])


def _sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """(node, hashes) of the sets with one of the wanted text hashes."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            for text in utf8(batch.column(0)):
                hashes = shingle_set(text, shingle_words)
                columns = [pa.array([n]) for n in set_id(hashes)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([hashes.view(np.int64)], LIST)], ["s1", "s2", "hashes"])

    texts = docs.select(named("text").alias("text"), F.xxhash64(named("text")).alias("text_hash"))
    met = texts.join(wanted, "text_hash").dropDuplicates(["text_hash"])
    found = map_batches(met.select("text"), work, "s1 long, s2 long, hashes array<long>")
    return found.dropDuplicates(["s1", "s2"]).select(node("s1", "s2").alias("node"), "hashes")


class Links:
    """Verified links (a, b), a > b, of one table, gathered round by round."""

    def __init__(self, docs: DataFrame, by_set: DataFrame, shingle_words: int):
        self.docs, self.by_set, self.shingle_words = docs, by_set, shingle_words
        self.found, self.tested, self._roots = None, None, None

    def roots(self) -> DataFrame:
        """(node, root) of what the links so far connect, made once for them."""
        if self._roots is None:
            with session.cleared(self.docs.sparkSession, "component-edges"):
                self._roots = session.stored(components(self.found), "similar-roots")
        return self._roots

    def verify(self, pairs: DataFrame) -> None:
        """Compare the whole sets of pairs that are neither connected nor compared yet."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        if self.found is not None:
            for side in ("a", "b"):
                of = self.roots().select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
                pairs = pairs.join(of, side, "left")
            apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
            pairs = pairs.filter(apart).select("a", "b").join(self.tested, ["a", "b"], "left_anti")
        pairs = whole = session.stored(pairs, "similar-pairs")
        if self.found is not None and pairs.isEmpty():
            return
        with session.cleared(self.docs.sparkSession, "similar-wanted", "similar-sets"):
            ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            wanted = session.stored(self.by_set.join(ids, "node").select("text_hash").distinct(), "similar-wanted")
            sets = session.stored(_sets(self.docs, wanted, self.shingle_words), "similar-sets")
            for side in ("a", "b"):
                whole = whole.join(sets.select(F.col("node").alias(side), F.col("hashes").alias(f"of_{side}")), side)
            common = F.size(F.array_intersect("of_a", "of_b"))
            union = F.size("of_a") + F.size("of_b") - common
            p, q = SIMILARITY.numerator, SIMILARITY.denominator
            near = session.stored(whole.filter(common * q >= union * p).select("a", "b"), "similar-links")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        if self.found is None:
            self.found = near
        elif not near.isEmpty():
            # What is connected goes on as links to roots.
            stars = self.roots().filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            self.found, self._roots = stars.union(near), None


def similar_roots(docs: DataFrame, by_set: DataFrame, counts: np.ndarray, shingle_words: int) -> DataFrame:
    """(node, root) of every set that is similar to another one.

    ``by_set`` has node, fp, size and the text_hash of one document with the set.
    """
    gathered = Links(docs, by_set, shingle_words)
    of_fp = session.stored(by_set.groupBy("fp").agg(F.min("node").alias("smallest")), "similar-fingerprints")
    same = by_set.join(of_fp, "fp").select(F.col("node").alias("a"), F.col("smallest").alias("b"))
    nearest = links(of_fp.select("fp")).groupBy("a").agg(F.min("b").alias("b"))
    for side in ("a", "b"):
        of = of_fp.select(F.col("fp").alias(side), F.col("smallest").alias(f"smallest_{side}"))
        nearest = nearest.join(of, side)
    gathered.verify(same.union(nearest.select("smallest_a", "smallest_b")))

    centers, met = CENTERS, _prefixes(docs, counts, shingle_words)
    while True:
        order = ["key", "s1", "s2", "size", "place"]
        roots = [F.col("root.s1").alias("r1"), F.col("root.s2").alias("r2")] if "root" in met.columns else []
        rows = met.repartition("key").sortWithinPartitions(*order).select(*order, *roots)
        schema = "key long, s1 long, s2 long, size long, place long, o1 long, o2 long"
        with session.cleared(docs.sparkSession, "similar-compared"):
            out = session.stored(map_batches(rows, compared(centers), schema), "similar-compared")
            gathered.verify(out.filter("o1 is not null").select(node("s1", "s2").alias("a"), node("o1", "o2").alias("b")))
            left = out.filter("o1 is null").drop("o1", "o2").withColumn("node", node("s1", "s2"))
            left = left.join(gathered.roots(), "node", "left").withColumn("root", F.coalesce("root", "node"))
            left = session.stored(left, "similar-left")
        apart = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        apart = session.stored(apart.select("key"), "similar-apart")
        if apart.isEmpty():
            return gathered.roots()
        met = left.join(apart, "key")
        centers *= CENTERS_GROWTH


def similar_members(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, text_hash, copies, component) of every different row.

    ``component`` is the smallest (last, doc_id, text_hash) of the group; ``last`` puts null
    ids last.
    """
    described = session.stored(_described(docs, shingle_words), "similar-described")
    counts = _rarity(described)
    rows = described.filter("buckets is null").groupBy("doc_id", "text_hash", *DESCRIBED).agg(F.count("*").alias("copies"))
    members = session.stored(rows, "similar-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    by_set = members.groupBy("s1", "s2", "fp", "size").agg(first)
    by_set = session.stored(by_set.select(node("s1", "s2").alias("node"), "fp", "size", "first"), "similar-by-set")
    roots = similar_roots(docs, by_set.withColumn("text_hash", F.col("first.text_hash")), counts, shingle_words)
    rooted = by_set.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    groups = rooted.select("node", "root").join(smallest, "root").select("node.s1", "node.s2", "component")
    return members.join(groups, ["s1", "s2"]).select("doc_id", "text_hash", "copies", "component")


def keep_representatives(docs: DataFrame, shingle_words: int) -> DataFrame:
    """One document of each group of similar ones, the one with the smallest id, with all its columns.

    Should the row that stays be repeated, one of the repeats stays.
    """
    members = similar_members(docs, shingle_words)
    is_first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash") == F.col("component")
    stays = session.stored(members.filter(is_first).select("doc_id", "text_hash", "copies"), "representatives")
    columns = docs.columns
    given = neutral(docs, columns).withColumn("text_hash", F.xxhash64(named(f"c{columns.index('text')}")))
    doc_id = F.col(f"c{columns.index('doc_id')}")
    kept = given.join(
        stays.withColumnRenamed("text_hash", "stays_hash").withColumnRenamed("doc_id", "stays_id"),
        doc_id.eqNullSafe(F.col("stays_id")) & (F.col("text_hash") == F.col("stays_hash")),
    )
    single = kept.filter("copies = 1")
    if stays.filter("copies > 1").isEmpty():
        return single.select(*restored(columns))
    repeated = kept.filter("copies > 1").dropDuplicates(["stays_id", "stays_hash"])
    return single.union(repeated).select(*restored(columns))
