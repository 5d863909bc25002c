"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie; every node has a failure link and the number of tokens popped on
the way there, so a word is read once, character by character, and its greedy longest-match
length comes out without a piece being built. A word is a run of characters other than
space and \\t..\\r, read with the vocabulary's word-start mark before it. A character that
no piece covers counts as one token for each of its UTF-8 bytes (byte fallback).

Defined cases: a null or empty text has 0 words and 0 tokens; texts and words of any length
are read whole; repeated rows are counted each; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"
#: Distinct words whose length a task remembers; the memory starts afresh when it is full.
REMEMBERED = 200_000


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file: not its control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@dataclass
class LongestMatch:
    """goto: (node << 21 | code point) -> node; node 0 is the root. A node's popped tokens are
    those that greedy matching settles when it can't go on from there; what then remains to
    be matched is the string of the failure node. total: tokens if the word ends there."""

    goto: dict[int, int]
    fail: list[int]
    popped: list[int]
    total: list[int]

    @classmethod
    def of(cls, pieces: list[str]) -> LongestMatch:
        goto: dict[int, int] = {}
        cost: dict[int, int] = {}  # of nodes that are a token
        order = [(0, 0, 0)]  # node, parent, character; parents first
        for piece in sorted(set(pieces), key=len):
            node = 0
            for ch in piece:
                key = node << 21 | ord(ch)
                if key not in goto:
                    goto[key] = len(order)
                    order.append((len(order), node, ord(ch)))
                node = goto[key]
            if node:
                cost[node] = 1
        # Every character of the vocabulary gets a node, so that matching can always go on:
        # one that is no piece itself costs its bytes.
        for code in sorted({c for _, _, c in order[1:]}):
            if code not in goto:
                goto[code] = len(order)
                order.append((len(order), 0, code))
            cost.setdefault(goto[code], len(chr(code).encode("utf-8", "surrogatepass")))
        depth = [0] * len(order)
        for node, parent, _ in order[1:]:
            depth[node] = depth[parent] + 1
        fail, popped, total = [0] * len(order), [0] * len(order), [0] * len(order)
        for node, parent, code in sorted(order[1:], key=lambda x: depth[x[0]]):
            if node in cost:
                fail[node], popped[node] = 0, cost[node]
            else:
                at, n = fail[parent], popped[parent]
                while (at << 21 | code) not in goto:
                    n += popped[at]
                    at = fail[at]
                fail[node], popped[node] = goto[at << 21 | code], n
            total[node] = popped[node] + total[fail[node]]
        return cls(goto, fail, popped, total)

    def length(self, word: str) -> int:
        """Tokens of the greedy longest-match segmentation of a word, mark included."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node = n = 0
        for ch in word:
            code = ord(ch)
            after = goto.get(node << 21 | code)
            while after is None and node:
                n += popped[node]
                node = fail[node]
                after = goto.get(node << 21 | code)
            if after is None:
                n += len(ch.encode("utf-8", "surrogatepass"))
            else:
                node = after
        return n + self.total[node]


class _Lengths(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.length(MARK + word)
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document, in one pass without a shuffle.

    vocabulary: path of a sentencepiece model on the driver, whose pieces are broadcast as
    an automaton (its size is the vocabulary's, not the data's).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(LongestMatch.of(pieces_of(vocabulary)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(shipped.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                own = WORD.findall(text.as_py() or "")
                words.append(len(own))
                tokens.append(sum(map(lengths.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
