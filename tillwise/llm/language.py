"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built from labelled text. A text is parsed with
each of them into the longest matches (phrases) that the labelled text has; a language
costs its number of phrases times the bits to point into its labelled text, per letter.
The language with the lowest cost wins, ties by name. The score is its probability if each
language is as likely as its code is short.

Phrases end at the ends of words (a word is parsed with the space before and after it), so
a word costs the same wherever it stands and each task parses it once; the costs of a text
are sums over all of its words. The table of parsed words is emptied whenever it has
``CACHED_WORDS`` entries, which changes nothing but the work.

Training uses a bounded sample, stated by three parameters: up to ``SAMPLE_DOCS`` documents
per language (by hash of the id), up to ``SAMPLE_CHARS_PER_DOC`` characters of each and up to
``SAMPLE_CHARS`` in all. The model takes about ``SAMPLE_CHARS`` x 0.5 KB per language in a
task.

Defined cases: a null text or one without letters is ``und`` with score 0; a null doc_id is
neither held out nor learned from; a null lang is not learned from; rows are judged
independently; without any labelled text every document is ``und``; carried columns have
neutral names, so any others may clash.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise import session
from tillwise.llm.tables import Batches, ddl, map_batches, named, neutral, restored, values

SAMPLE_DOCS = 128
SAMPLE_CHARS_PER_DOC = 2048
SAMPLE_CHARS = 32_768
SAMPLE_SLICES = (256, 8, 1)
CACHED_WORDS = 200_000
MIN_SCORE = 0.4
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL_BITS = 21


def held_out(doc_id: Column) -> Column:
    """One document in four, by the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def suffix_automaton(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the smallest automaton of all substrings: (state, symbol) keys, target states."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in map(ord, text):
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in nexts[state]:
            nexts[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = nexts[state][symbol]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                link[target] = link[new] = copy
                while state >= 0 and nexts[state].get(symbol) == target:
                    nexts[state][symbol] = copy
                    state = link[state]
        last = new
    keys = [state << _SYMBOL_BITS | symbol for state, edges in enumerate(nexts) for symbol in edges]
    targets = [target for edges in nexts for target in edges.values()]
    return np.array(keys, np.int64), np.array(targets, np.int32)


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    """The automaton of one language from its sampled documents."""
    words, chars = [], 0
    for text in rows.sort_values(["doc_id", "text"])["text"]:
        taken = 0
        for word in _WORD.findall((text or "").lower()):
            if taken >= SAMPLE_CHARS_PER_DOC or chars >= SAMPLE_CHARS:
                break
            words.append(word)
            taken += len(word) + 1
            chars += len(word) + 1
    keys, targets = suffix_automaton(f" {' '.join(words)} " if words else "")
    return pd.DataFrame(
        {"lang": [rows["lang"].iloc[0]], "chars": [chars], "keys": [keys.tobytes()], "targets": [targets.tobytes()]}
    )


def learn(labelled: DataFrame) -> list[tuple[str, int, bytes, bytes]]:
    """Models (lang, characters, edge keys, edge targets) from doc_id, lang and text.

    The sample is chosen without reading texts: first within slices of a language, so that
    no task ranks a language with most of the documents, then among the chosen of ever
    fewer slices.
    """
    chosen = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
    for slices in SAMPLE_SLICES:
        slice_of = F.pmod(F.hash(F.col("doc_id"), F.lit(1)), F.lit(slices))
        ranked = Window.partitionBy("lang", slice_of).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= SAMPLE_DOCS).drop("place")
    chosen = session.stored(chosen, "language-sample")
    sample = labelled.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")
    models = sample.groupBy("lang").applyInPandas(_learn, "lang string, chars long, keys binary, targets binary")
    learned = [(row.lang, row.chars, bytes(row.keys), bytes(row.targets)) for row in models.collect() if row.chars]
    return sorted(learned)


class WordCosts(dict):
    """Places of words in a table of letters and costs in each language."""

    def __init__(self, models: list[tuple[str, int, bytes, bytes]]):
        super().__init__()
        self.edges = [
            dict(zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(targets, np.int32).tolist()))
            for _, _, keys, targets in models
        ]
        self.bits = [math.log2(chars + 1) for _, chars, _, _ in models]
        self.table = np.zeros((4096, len(models) + 1))

    def __missing__(self, word: str) -> int:
        place = len(self)
        if place == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        symbols = [ord(c) for c in f" {word} "]
        row = [sum(map(str.isalpha, word))]
        for edges, bits in zip(self.edges, self.bits):
            row.append(_phrases(edges, symbols) * bits)
        self.table[place] = row
        self[word] = place
        return place

    def of_text(self, text: str | None) -> np.ndarray:
        """Letters of the text, then its costs."""
        if len(self) > CACHED_WORDS:
            self.clear()
        words = _WORD.findall(text.lower()) if text else []
        places = list(map(self.__getitem__, words))
        return self.table[places].sum(axis=0)


def _phrases(edges: dict[int, int], symbols: list[int]) -> int:
    """Longest matches that the symbols fall into; a symbol of no match is one by itself."""
    phrases, state = 1, 0
    get = edges.get
    for symbol in symbols:
        following = get(state << _SYMBOL_BITS | symbol)
        if following is None:
            phrases += state > 0
            following = get(symbol, 0)
            phrases += following == 0
        state = following
    return phrases


def identify(docs: DataFrame, models: list[tuple[str, int, bytes, bytes]], carry: list[str]) -> DataFrame:
    """The carried columns c0, c1, ... of every document, with lang_pred and score."""
    columns = [*carry, *([] if "text" in carry else ["text"])]
    text_at, keep = columns.index("text"), len(carry)
    names = [lang for lang, *_ in models]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Batches) -> Batches:
        costs = WordCosts(shared.value)
        for batch in batches:
            found, scores = [], []
            for text in values(batch.column(text_at)):
                letters, *cost = costs.of_text(text)
                if letters == 0 or not names:
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                best = int(np.argmin(cost))
                found.append(names[best])
                scores.append(float(1 / np.exp2(np.maximum(cost[best] - np.array(cost), -1000)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:keep], "lang_pred", "score"],
            )

    given = neutral(docs, columns)
    kept = given.select(*[f"c{i}" for i in range(keep)])
    return map_batches(given, predict, ddl(kept, "lang_pred string, score double"))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    models = learn(docs.filter(~held_out(named("doc_id"))))
    found = identify(docs, models, ["doc_id"])
    return found.select(F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is found with at least ``min_score``, with all their columns."""
    models = learn(docs.filter(~held_out(named("doc_id"))))
    found = identify(docs, models, docs.columns)
    accepted = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)
    return found.filter(accepted).select(*restored(docs.columns))
