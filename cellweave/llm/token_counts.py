"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words, each with the word mark in front. The distinct
pre-tokens of a block are put in a trie; the walk keeps, for every node, the best
unigram score of the prefix that ends there and the tokens it takes, so a shared
prefix is scored once. What stands at a pre-token's last node, its terminal count, is
added up for each text.

A piece's unigram score falls with its place in the vocabulary, as for words ranked by
frequency: minus the logarithm of the rank. A character that no piece covers costs one
token for each of its UTF-8 bytes. Of equal scores the one with fewer tokens wins.

Defined cases: null and empty texts have no tokens; white space only separates; very
long words are scored piece by piece in time linear in their length; repeated rows and
ids are kept; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import blocks

MARK = "▁"

#: Terminal counts a task keeps for the following blocks.
STORED_WORDS = 600_000


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    longest: int
    per_byte: float


def read_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a SentencePiece model, scored by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return vocabulary(ordinary)


def vocabulary(pieces: list[str]) -> Vocabulary:
    scores = {p: -math.log(rank) for rank, p in enumerate(pieces, start=1)}
    return Vocabulary(scores, max(map(len, pieces), default=1), -2 * math.log(len(pieces) + 2))


def terminal_counts(words: list[str], vocab: Vocabulary) -> dict[str, int]:
    """Tokens of each distinct pre-token.

    Words in sorted order are a depth-first walk of their trie: ``path`` holds the
    forward scores of the current branch, and a word goes on from the node it shares
    with the word before it.
    """
    scores, longest, per_byte = vocab.scores, vocab.longest, vocab.per_byte
    counts: dict[str, int] = {}
    path: list[tuple[float, int]] = [(0.0, 0)]
    before = ""
    for word in sorted(words):
        shared = 0
        for x, y in zip(before, word):
            if x != y:
                break
            shared += 1
        del path[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "replace"))
            best = (path[end - 1][0] + per_byte * size, -(path[end - 1][1] + size))
            for begin in range(max(0, end - longest), end):
                score = scores.get(word[begin:end])
                if score is not None:
                    found = (path[begin][0] + score, -(path[begin][1] + 1))
                    if found > best:
                        best = found
            path.append((best[0], -best[1]))
        counts[word] = path[-1][1]
        before = word
    return counts


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``n_words`` and ``n_tokens``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        known: dict[bytes, int] = {}
        for rows, texts in blocks(batches):
            split = [t.split() for t in texts]
            new = set().union(*split) - known.keys()
            if len(known) + len(new) > STORED_WORDS:
                known.clear()
                new = set().union(*split)
            named = {MARK + w.decode(): w for w in new}
            for word, n in terminal_counts(list(named), vocab).items():
                known[named[word]] = n
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(ws) for ws in split], pa.int64()),
                    pa.array([sum(map(known.__getitem__, ws)) for ws in split], pa.int64()),
                ],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return read.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_tokens long")
