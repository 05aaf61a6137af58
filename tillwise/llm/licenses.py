"""License scans: TF-IDF cosine of statements to templates, and inheritance by directory.

Statements are the lines of a text that have a cue of a license (wherever in the text they
stand), and whole texts of files whose name says that they are license files. Different
statements are scored once, however many documents have them: terms, document frequencies
and norms come from the table of different statements, weighted by their documents, and the
cosine is a sparse join of terms with those of the templates. Both statements and their
terms are far smaller than the texts; only they are shuffled.

A document has the license of its best statement, if that reaches ``MIN_COSINE``. A document
without one inherits that of a license file in its own directory, or else in the nearest
directory above. Directories are joined with their ancestors, not documents, so a directory
with most of the documents counts once.

Defined cases: a null or empty text has no statement; a null path is in no directory and
inherits nothing; ties go to the first template by name, between license files of one
directory to the higher cosine, then the first name; repeated rows get equal answers;
null doc_ids are carried like others; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise import session

MIN_COSINE = 0.5

# Opening statements of well-known licenses, and the cues of a statement.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Released under the ISC License."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
CUE = r"(?i)licen[cs]e|spdx-|public domain|permission is hereby|redistribution and use|creative commons"
LICENSE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[-._].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _best(license: str, cosine: str) -> Column:
    """The license with the highest cosine, then the first by name."""
    return F.min_by(F.struct(license, cosine), F.struct(-F.col(cosine), license))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_mostly_statements(text: Column) -> Column:
    """Whether lines with a cue are half of the text or more, as in a license file."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(CUE))
    share = F.length(F.array_join(lines, "")) * 2 >= F.length(text)
    return F.coalesce(F.when(text.rlike(CUE), share), F.lit(False))


def _statements(docs: DataFrame) -> DataFrame:
    """Different (doc_id, path, text_hash, statement) of all documents."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(CUE))
    is_file = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    whole = F.when(is_file, F.array("text")).otherwise(F.array().cast("array<string>"))
    found = F.when(F.coalesce(F.col("text").rlike(CUE), F.lit(False)), F.array_union(lines, whole))
    return docs.select("doc_id", "path", "text_hash", F.explode(found).alias("statement")).distinct()


def _vectors(spark: SparkSession, statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted terms of the statements (statement, term, weight), and of the templates
    (license, template, term, weight), both of length 1.

    A term's weight is its count times 1 + log of the statements, counted by document, over
    those with the term; templates count as one document each.
    """
    rows = [(name, place, text) for name, texts in TEMPLATES.items() for place, text in enumerate(texts)]
    templates = spark.createDataFrame(rows, "license string, template int, text string")
    of_templates = (
        templates.select("license", "template", F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("license", "template", "term")
        .agg(F.count("*").alias("n"))
    )
    of_statements = (
        statements.select("statement", "n_docs", F.explode(_terms(F.col("statement"))).alias("term"))
        .groupBy("statement", "n_docs", "term")
        .agg(F.count("*").alias("n"))
    )
    of_statements = session.stored(of_statements, "license-terms")
    total = (statements.agg(F.sum("n_docs")).first()[0] or 0) + len(rows)
    with_term = (
        of_statements.select("term", "n_docs")
        .union(of_templates.select("term", F.lit(1).cast("long")))
        .groupBy("term")
        .agg(F.sum("n_docs").alias("with_term"))
    )
    with_term = session.stored(with_term, "license-term-counts")
    weight = F.col("n") * (1 + F.log(F.lit(float(total)) / F.col("with_term")))

    def weighted(terms: DataFrame, key: list[str]) -> DataFrame:
        raw = terms.join(with_term, "term").withColumn("weight", weight)
        norms = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        return raw.join(norms, key).select(*key, "term", (F.col("weight") / F.col("norm")).alias("weight"))

    return weighted(of_statements, ["statement"]), weighted(of_templates, ["license", "template"])


def score_statements(spark: SparkSession, statements: DataFrame) -> DataFrame:
    """(statement, license, cosine) of every different statement (statement, n_docs) with a template near enough."""
    terms, templates = _vectors(spark, statements)
    # The templates are the fixed list above.
    near = terms.join(F.broadcast(templates.withColumnRenamed("weight", "template_weight")), "term")
    cosines = near.groupBy("statement", "license", "template").agg(
        F.round(F.sum(F.col("weight") * F.col("template_weight")), 6).alias("cosine")
    )
    best = cosines.groupBy("statement").agg(_best("license", "cosine").alias("best"))
    return best.select("statement", "best.*").filter(F.col("cosine") >= MIN_COSINE)


def _inherited(own: DataFrame, directories: DataFrame) -> DataFrame:
    """(directory, near_license, near_cosine): the license file nearest to each directory."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    at = (
        own.filter(name.rlike(LICENSE_FILE))
        .groupBy(_directory(F.col("path")).alias("above"))
        .agg(_best("license", "cosine").alias("found"))
    )
    parts = F.split("directory", "/", -1)
    depth = F.explode(F.sequence(F.lit(0), F.size(parts)))
    lineage = directories.withColumn("depth", depth).select(
        "directory", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("above")
    )
    nearest = lineage.join(at, "above").groupBy("directory").agg(F.max_by("found", "depth").alias("found"))
    return nearest.select("directory", F.col("found.license").alias("near_license"), F.col("found.cosine").alias("near_cosine"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, path, text): doc_id, license, cosine and origin.

    ``origin`` is ``own``, ``inherited`` or ``none``.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", "path", F.xxhash64("text").alias("text_hash"), "text")
    found = session.stored(_statements(given), "license-statements")
    different = session.stored(found.groupBy("statement").agg(F.count("*").alias("n_docs")), "license-different")
    scored = session.stored(score_statements(spark, different), "license-scored")
    statements = found.join(scored, "statement").groupBy("doc_id", "path", "text_hash")
    statements = statements.agg(_best("license", "cosine").alias("best")).select("doc_id", "path", "text_hash", "best.*")
    statements = session.stored(statements, "license-own")
    directories = given.filter(F.col("path").isNotNull()).select(_directory(F.col("path")).alias("directory")).distinct()
    nearest = session.stored(_inherited(statements, directories), "license-inherited")
    own = statements.select(
        F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), F.col("text_hash").alias("own_hash"), "license", "cosine"
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("own_id"))
        & F.col("path").eqNullSafe(F.col("own_path"))
        & (F.col("text_hash") == F.col("own_hash"))
    )
    return (
        given.select("doc_id", "path", "text_hash", _directory(F.col("path")).alias("directory"))
        .join(own, same, "left")
        .join(nearest, "directory", "left")
        .select(
            "doc_id",
            F.coalesce("license", "near_license").alias("license"),
            F.coalesce("cosine", "near_cosine").alias("cosine"),
            F.when(F.col("license").isNotNull(), "own").when(F.col("near_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        )
    )
