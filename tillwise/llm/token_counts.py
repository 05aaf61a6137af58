"""Token counts: a unigram segmentation by dynamic programming in a trie of pre-tokens.

A text is cut at white space into pre-tokens. The tokens of a pre-token are those of its best
segmentation into vocabulary pieces (highest sum of log probabilities), and the forward
scores of the program depend only on the prefix read so far. Different pre-tokens are
inserted in a trie whose nodes hold the forward score and the number of tokens, so a prefix
that many pre-tokens share is scored once; the count at the end of a pre-token is kept with
it. Each task has a trie of its own and needs no exchange; it starts anew at ``MAX_NODES``
nodes, which changes nothing but the work. Pre-tokens beyond ``LONGEST_SHARED`` characters
are scored outside the trie in constant memory. Suffixes that no piece ends with stop the search
for the pieces that end at a place.

The vocabulary file is a parameter. Its pieces come in order of rank; the probability of
rank r is 1 / ((r + 1) H), Zipf's law. A character of no piece counts as its bytes.

Defined cases: null and empty texts have 0 tokens; rows are counted independently, so
repeated rows and null ids need no rule; an empty table gives no rows; carried columns have
neutral names, so any others may clash.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.tables import Batches, ddl, kept_between_tasks, map_batches, neutral

MAX_NODES = 800_000
LONGEST_SHARED = 256
UNKNOWN_PENALTY = 10.0
SPACE = "▁"

_PRE_TOKEN = re.compile(r" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")


def read_vocabulary(path: str) -> dict[str, float]:
    """Log probabilities of the pieces of a sentence-piece file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    # Scores of pieces are their negative ranks; others mark pieces that are never found.
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ranks = {model.id_to_piece(i): -model.get_score(i) for i in plain if model.get_score(i) > -1e8}
    harmonic = sum(1 / (rank + 1) for rank in ranks.values())
    return {piece: -math.log((rank + 1) * harmonic) for piece, rank in ranks.items()}


def pre_tokens(text: str | None) -> list[str]:
    """Words with the space before them, and other white space; a text starts as after a space."""
    if not text:
        return []
    found = _PRE_TOKEN.findall(text)
    if not text[0].isspace():
        found[0] = " " + found[0]
    return found


class PrefixTrie(dict):
    """Token counts of pre-tokens, and the trie of their prefixes."""

    def __init__(self, vocabulary: dict[str, float]):
        super().__init__()
        # Ends of pieces: the piece's own score, or None for an end that is no piece itself.
        self.endings: dict[str, float | None] = {piece[k:]: None for piece in vocabulary for k in range(len(piece))}
        self.endings.update(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}
        self.scores, self.counts = [0.0], [0]

    def __missing__(self, pre_token: str) -> int:
        word = pre_token.replace(" ", SPACE)
        count = self._walk(word) if len(word) <= LONGEST_SHARED else self._roll(word)
        self[pre_token] = count
        return count

    def _best(self, word: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score and count up to ``end``, given those of all earlier ends (the last is last in the lists)."""
        endings, best, count = self.endings, -math.inf, 0
        last = len(scores)
        for size in range(1, min(end, self.longest) + 1):
            ending = word[end - size : end]
            score = endings.get(ending)
            if score is not None:
                score += scores[last - size]
                if score > best:
                    best, count = score, counts[last - size] + 1
            elif size == 1:
                best, count = scores[last - 1] + self.unknown, counts[last - 1] + len(ending.encode())
            if score is None and ending not in endings:
                break
        return best, count

    def _walk(self, word: str) -> int:
        """Follow the word from the root, adding and scoring the nodes that are not there."""
        node, scores, counts = 0, [0.0], [0]
        for end, symbol in enumerate(word, 1):
            edge = node << 21 | ord(symbol)
            node = self.children.get(edge, -1)
            if node < 0:
                best, count = self._best(word, end, scores, counts)
                node = self.children[edge] = len(self.scores)
                self.scores.append(best)
                self.counts.append(count)
            scores.append(self.scores[node])
            counts.append(self.counts[node])
        return counts[-1]

    def _roll(self, word: str) -> int:
        """The same program over a window as long as the longest piece."""
        scores, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            best, count = self._best(word, end, scores, counts)
            scores = [*scores[-self.longest + 1 :], best] if self.longest > 1 else [best]
            counts = [*counts[-self.longest + 1 :], count] if self.longest > 1 else [count]
        return counts[-1]

    def of_text(self, text: str | None) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        if len(self.scores) > MAX_NODES or len(self) > MAX_NODES:
            self.restart()
        found = pre_tokens(text)
        return len(found), sum(map(self.__getitem__, found))


def count_tokens(docs: DataFrame, vocabulary: dict[str, float], carry: list[str]) -> DataFrame:
    """The carried columns c0, c1, ... of every document, with n_pretokens and n_tokens."""
    columns = [*carry, *([] if "text" in carry else ["text"])]
    text_at, keep = columns.index("text"), len(carry)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Batches) -> Batches:
        trie = kept_between_tasks("trie", shared.value, PrefixTrie)
        for batch in batches:
            found = [trie.of_text(text) for text in batch.column(text_at).to_pylist()]
            added = [pa.array([f[part] for f in found], pa.int64()) for part in (0, 1)]
            names = [*batch.schema.names[:keep], "n_pretokens", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *added], names)

    given = neutral(docs, columns)
    kept = given.select(*[f"c{i}" for i in range(keep)])
    return map_batches(given, count, ddl(kept, "n_pretokens long, n_tokens long"))


def document_tokens(docs: DataFrame, vocabulary: dict[str, float]) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document."""
    return count_tokens(docs, vocabulary, ["doc_id"]).select(F.col("c0").alias("doc_id"), "n_pretokens", "n_tokens")
