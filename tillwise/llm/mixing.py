"""Mixing sources to target weights by entropy balancing.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a
target stops at three times its source, and the excess is shared among the others by weight
until none is above (water filling, all in integers).

Rates: every document gets a rate between 0 and ``LIMIT`` = 3, the rates nearest to 1 in
entropy for which the words of each source meet its target. They are exponentially tilted,
rate / (LIMIT - rate) = exp(lambda * size / scale) / (LIMIT - 1), with one dual variable per
source, and the convex dual is solved by Newton steps: one Spark job per step sums words and
slopes over the different sizes of every source and moves all dual variables, inside a
bracket that halves where a step would leave it. Sums are decimal, so reruns agree whatever
the order of tasks.

Copies: in slices of a source with about ``SLICE_ROWS`` documents, from the largest on, each
document gets its rate rounded to the side that brings the words so far nearest to what
they should be. What is missing at the end of a slice is about half its smallest document.

Defined cases: null and empty texts have size 0, are taken at the rate 1 and count nothing;
rows that agree in doc_id, source, size and text get the same copies; null doc_ids and
sources are values like others; with no words at all every target is 0; an empty table
gives no rows; carried columns have neutral names, so any others may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise import session
from tillwise.llm.tables import named, neutral, restored

WEIGHTS = (5, 2, 1)
LIMIT = 3
SLICE_ROWS = 2_000
TOLERANCE = 1e-7
MAX_STEPS = 200
WIDEST = 1e9

WORD = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,6)"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, source: Column, text: Column) -> list[Column]:
    return [doc_id.alias("doc_id"), source.alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash")]


def _positions(sources: DataFrame) -> DataFrame:
    """Place of each source by code point, null last, counted per sorted partition.

    Only the numbers of rows of the partitions come to the driver.
    """
    ordered = sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
    parted = session.stored(ordered.withColumn("part", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, []
    for row in parted.groupBy("part").count().orderBy("part").collect():
        offsets += [F.lit(row["part"]), F.lit(before)]
        before += row["count"]
    inside = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    offset = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    return parted.withColumn("position", F.row_number().over(inside) - 1 + offset).drop("part")


def targets(sources: DataFrame) -> DataFrame:
    """Sources (source, source_size) with weight and target."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("position") % len(WEIGHTS) + 1).cast("int"))
    weighed = session.stored(_positions(sources).withColumn("weight", weight), "mix-weights")
    whole = weighed.agg(F.sum("weight"), F.sum("source_size")).first()
    weights, total = whole[0] or 0, whole[1] or 0
    limit = F.col("source_size") * LIMIT
    free, rest = weights, total
    while True:
        above = limit.cast("decimal(38,0)") * F.lit(free) < F.col("weight").cast("decimal(38,0)") * F.lit(rest)
        row = weighed.filter(above).agg(F.sum("weight"), F.sum(limit)).first()
        now_free, now_rest = weights - (row[0] or 0), total - (row[1] or 0)
        if (now_free, now_rest) == (free, rest):
            break
        free, rest = now_free, now_rest
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(max(free, 1)))
    return weighed.withColumn("target", F.when(above, limit.cast("double")).otherwise(share)).withColumn("full", above)


def _rate(tilt: Column, size: Column, scale: Column) -> Column:
    exponent = F.greatest(F.least(-tilt * size / scale, F.lit(700.0)), F.lit(-700.0))
    return LIMIT / (1 + (LIMIT - 1) * F.exp(exponent))


def solve(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """The sources of ``goals`` with the dual variable ``tilt`` and the ``scale`` of sizes.

    ``histogram`` has (source, size, n): documents with the same source and size have the
    same rate. A source at its limit needs no steps.
    """
    scale = F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))
    scales = histogram.groupBy(F.col("source").alias("scaled")).agg(scale.cast("double").alias("scale"))
    state = (
        goals.join(scales, F.col("source").eqNullSafe(F.col("scaled")), "left")
        .drop("scaled")
        .withColumns(
            {
                "scale": F.coalesce("scale", F.lit(1.0)),
                "tilt": F.when(F.col("full"), WIDEST).otherwise(0.0),
                "low": F.lit(-WIDEST),
                "high": F.lit(WIDEST),
                "open": ~F.col("full") & (F.col("source_size") > 0),
            }
        )
    )
    state = session.stored(state, "mix-state")
    for _ in range(MAX_STEPS):
        if state.filter("open").isEmpty():
            break
        state = session.stored(_step(histogram, state), "mix-state")
    return state


def _step(histogram: DataFrame, state: DataFrame) -> DataFrame:
    """One Newton step of every open source."""
    moving = state.filter("open").select(F.col("source").alias("moved"), "tilt", "scale")
    rate = _rate(F.col("tilt"), F.col("size"), F.col("scale"))
    mass = F.col("n") * F.col("size")
    slope = mass * F.col("size") / F.col("scale") * rate * (1 - rate / LIMIT)
    sums = (
        histogram.join(moving, F.col("source").eqNullSafe(F.col("moved")))
        .groupBy("moved")
        .agg(F.sum((mass * rate).cast(EXACT)).cast("double").alias("words"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
    )
    excess = F.col("words") - F.col("target")
    low = F.when(excess < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
    high = F.when(excess > 0, F.least("high", "tilt")).otherwise(F.col("high"))
    newton = F.col("tilt") - F.try_divide(excess, F.col("slope"))
    middle = (F.col("low") + F.col("high")) / 2
    done = (F.abs(excess) <= F.col("target") * TOLERANCE + 0.5) | (F.col("high") - F.col("low") <= 1e-12)
    kept = [column for column in state.columns if column not in ("tilt", "low", "high", "open")]
    return (
        state.join(sums, F.col("source").eqNullSafe(F.col("moved")), "left")
        .withColumns({"low": low, "high": high})
        .withColumn("next", F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle))
        .withColumn("stays", ~F.col("open") | F.coalesce(done, F.lit(True)))
        .select(
            *kept,
            F.when(F.col("stays"), F.col("tilt")).otherwise(F.col("next")).alias("tilt"),
            "low",
            "high",
            (~F.col("stays")).alias("open"),
        )
    )


def _round(rows: pa.Table) -> pa.Table:
    """Whole copies of one slice, largest documents first, following the words owed.

    Rows stay in Arrow columns, where a null leaves the ids beside it as they are.
    """
    order = [("size", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=order))
    weight = pc.multiply(rows["size"], rows["n"]).to_numpy().astype(np.float64)
    rate = rows["rate"].to_numpy()
    least, most = np.floor(rate), np.ceil(rate)
    copies = np.ones(len(rate), np.int64)
    owed = 0.0
    for k, w in enumerate(weight):
        if w:
            owed += rate[k] * w
            copies[k] = min(max(np.floor(owed / w + 0.5), least[k]), most[k])
            owed -= copies[k] * w
    return rows.drop_columns(["rate", "slice"]).append_column("copies", pa.array(copies))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash, n, source_size, target, copies) of every different row."""
    rows = docs.select(*_key(named("doc_id"), named("source"), named("text"))).groupBy("doc_id", "source", "size", "text_hash")
    rows = session.stored(rows.agg(F.count("*").alias("n")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_rows"))
    histogram = rows.filter("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
    histogram = session.stored(histogram, "mix-histogram")
    solved = solve(histogram, targets(sources)).select(
        F.col("source").alias("of_source"), "source_size", "target", "tilt", "scale", F.ceil(F.col("n_rows") / SLICE_ROWS).alias("slices")
    )
    rated = (
        rows.join(solved, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", _rate(F.col("tilt"), F.col("size"), F.col("scale")))
        .withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("slices")))
        .drop("of_source", "tilt", "scale", "slices")
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rated.schema if f.name not in ("rate", "slice"))
    return rated.groupBy("source", "slice").applyInArrow(_round, f"{kept}, copies long")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return copies(docs).withColumn("row", each).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns and then their ``copies``."""
    columns = docs.columns
    doc_id, source, text = (named(f"c{columns.index(name)}") for name in ("doc_id", "source", "text"))
    key = [column.alias(f"k{i}") for i, column in enumerate(_key(doc_id, source, text))]
    taken = copies(docs).filter("copies > 0").select(
        *[F.col(name).alias(f"t{i}") for i, name in enumerate(["doc_id", "source", "size", "text_hash"])], "copies"
    )
    same = [F.col(f"k{i}").eqNullSafe(F.col(f"t{i}")) for i in range(4)]
    return neutral(docs, columns).select("*", *key).join(taken, same).select(*restored(columns), "copies")
