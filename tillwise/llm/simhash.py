"""SimHash near-duplicates: Golay-code fuzzy hashing, join and verification.

A fingerprint has 64 bits; two link when at most ``MAX_BITS`` = 4 differ. It is cut into three segments of 22, 21 and 21 bits. Of four
differing bits at most two fall into the two segments with the fewest, so some pair of
segments has (0 or 1, 0 or 1) or, failing that, one segment has none and each other one two:

* one each: both fingerprints carry, for each pair of segments, the codeword of one segment
  together with every codeword near the other one, both ways round. A vector one flip away
  decodes to a codeword near the other, so they share a key of 24 bits;
* none and two: they carry one segment as it is with every codeword near the next one. Two
  vectors two flips apart have a near codeword in common, a key of 33 or more bits.

That is about 45 keys for each *different* fingerprint, and no link is missed.

Fingerprints that share a key meet in one place, where a search visits only unvisited members and
reports the tree it walks: a group of n near copies gives at most n - 1 links per key and
close to n comparisons per level, never all pairs. Every reported link is verified on all
bits; the links of the trees connect exactly what all links would. Components follow from
large-star and small-star rounds.

Texts that are similar without being as near as that are the matter of
:mod:`tillwise.llm.similar`, which starts from the same keys.

Defined cases: a very long text is hashed 65,536 shingles at a time; null and empty texts
have fingerprint zero and link like any other; fewer words than a shingle are one shingle; null doc_ids never name a component unless it has no
other, and stay only then; rows with equal doc_id and text are one member; an empty table
gives no rows; carried columns have neutral names, so any others may clash.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise import session
from tillwise.llm import golay
from tillwise.llm.components import components
from tillwise.llm.tables import Batches, map_batches, utf8

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
HASHED_AT_ONCE = 65_536
KEYED_AT_ONCE = 1_000

SEGMENT_SHIFTS, SEGMENT_BITS = (0, 22, 43), (22, 21, 21)


def shingle_hashes(text: bytes | None, shingle_words: int):
    """Arrays of the 64-bit hashes of all shingles, big-endian bytes, a bounded number at once."""
    words = text.lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    starts = [0, *ends]
    size = min(shingle_words, len(words))
    digest = xxhash.xxh64_digest
    total = len(words) - size + 1
    for first in range(0, total, HASHED_AT_ONCE):
        last = min(first + HASHED_AT_ONCE, total)
        spans = zip(starts[first:last], ends[first + size - 1 : last + size - 1])
        yield np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in spans]), ">u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (big-endian) have each bit."""
    count = np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    for part in range(0, len(bits), 255):
        count += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return count


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bits set in more than half of the hashes of all shingles, as a signed number."""
    count, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle_words):
        count += bit_counts(hashes)
        total += len(hashes)
    return int(np.packbits(count * 2 > total).view(">i8")[0])


def _described(docs: DataFrame, describe: Callable[[bytes | None], tuple], added: str) -> DataFrame:
    """doc_id, text_hash and the described columns of every document."""
    names = [column.split()[0] for column in added.split(", ")]
    kinds = [pa.int64() if column.endswith("long") else pa.binary() for column in added.split(", ")]

    def compute(batches: Batches) -> Batches:
        for batch in batches:
            found = [describe(text) for text in utf8(batch.column(2))]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "text_hash", *names])

    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    return map_batches(given, compute, f"doc_id {kind}, text_hash long, {added}")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the join keys of fingerprints."""
    bits = fps.view(np.uint64)
    parts = [
        (bits >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        for shift, width in zip(SEGMENT_SHIFTS, SEGMENT_BITS)
    ]
    own = [golay.index(part) for part in parts]
    near = [golay.near_indices(part, width) for part, width in zip(parts, SEGMENT_BITS)]
    rows, keys = [], []
    for kind, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)]):
        (rows_i, near_i), (rows_j, near_j) = near[i], near[j]
        other = near_j != own[j][rows_j]  # the key with both own codewords is made once
        rows += [rows_i, rows_j[other]]
        keys += [kind << 60 | near_i << 12 | own[j][rows_i], (kind << 60 | own[i][rows_j] << 12 | near_j)[other]]
    for kind, (i, j) in enumerate([(0, 1), (1, 2), (2, 0)], start=3):
        rows_j, near_j = near[j]
        rows.append(rows_j)
        keys.append(kind << 60 | parts[i][rows_j] << 12 | near_j)
    return np.concatenate(rows), np.concatenate(keys)


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints (numbers or bytes) as rows of 64-bit words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    texts = column.to_pylist()
    return np.frombuffer(b"".join(texts), "<u8").reshape(len(texts), -1)


def _column(words: np.ndarray, is_number: bool) -> pa.Array:
    if is_number:
        return pa.array(words[:, 0].view(np.int64))
    return pa.array([row.tobytes() for row in words], pa.binary())


def _keyed_by_bits(batches: Batches) -> Batches:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for first in range(0, len(fps), KEYED_AT_ONCE):
            part = fps[first : first + KEYED_AT_ONCE]
            rows, keys = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


def spanning_links(members: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (from, to) of trees that span what links of up to ``max_bits`` connect."""
    links, left = [], members
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            near = np.bitwise_count(left ^ here).sum(axis=1) <= max_bits
            if near.any():
                reached, left = left[near], left[~near]
                links.append((np.broadcast_to(here, reached.shape), reached))
                frontier.extend(reached)
    return links


def _linked(max_bits: int) -> Callable[[Batches], Batches]:
    """Links among the members of each key; the rows come sorted by key."""

    def link(batches: Batches) -> Batches:
        kept_keys, kept_fps, is_number = np.empty(0, np.int64), None, True
        for batch in batches:
            is_number = pa.types.is_integer(batch.column(1).type)
            keys, fps = batch.column(0).to_numpy(zero_copy_only=False), _words(batch.column(1))
            if kept_fps is not None:
                keys, fps = np.concatenate([kept_keys, keys]), np.concatenate([kept_fps, fps])
            if not len(keys):
                continue
            # The last key may go on in the next batch.
            done = np.searchsorted(keys, keys[-1])
            kept_keys, kept_fps = keys[done:], fps[done:]
            yield from _links_of_keys(keys[:done], fps[:done], max_bits, is_number)
        if kept_fps is not None:
            yield from _links_of_keys(kept_keys, kept_fps, max_bits, is_number)

    return link


def _links_of_keys(keys: np.ndarray, fps: np.ndarray, max_bits: int, is_number: bool) -> Batches:
    if not len(keys):
        return
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    of_two = starts[sizes == 2]
    close = np.bitwise_count(fps[of_two] ^ fps[of_two + 1]).sum(axis=1) <= max_bits
    links = [(fps[of_two][close], fps[of_two + 1][close])]
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        links += spanning_links(fps[start : start + size], max_bits)
    sides = [_column(np.concatenate(side), is_number) for side in zip(*links)]
    yield pa.RecordBatch.from_arrays(sides, ["a", "b"])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links (a, b), a > b, that connect all different fingerprints (``fp``) within reach."""
    met = map_batches(fps, _keyed_by_bits, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = map_batches(met, _linked(max_bits), "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _grouped(members: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Members with ``component``: the smallest member (last, doc_id, text_hash) it is connected with.

    ``last`` puts null ids last. Members have doc_id, text_hash, copies and fp.
    """
    members = session.stored(members, "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    by_fp = session.stored(members.groupBy("fp").agg(first), "fingerprints")
    roots = session.stored(components(link(by_fp.select("fp"))), "components").withColumnRenamed("node", "fp")
    linked = by_fp.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    of_linked = linked.join(smallest, "root").select("fp", "component")
    alone = by_fp.join(roots, "fp", "left_anti").select("fp", F.col("first").alias("component"))
    groups = session.stored(of_linked.union(alone), "fingerprint-groups")
    return members.join(groups, "fp")


def _counted(described: DataFrame) -> DataFrame:
    """Different rows with how often they repeat."""
    return described.groupBy(*described.columns).agg(F.count("*").alias("copies"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    described = _described(docs, lambda text: (fingerprint(text, shingle_words),), "fp long")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return (
        _grouped(_counted(described), links)
        .withColumn("copy", each)
        .select(
            "doc_id",
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            F.col("component.doc_id").alias("component_id"),
        )
    )
