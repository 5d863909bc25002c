"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A piece's bytes are read as Latin-1 characters by an Aho-Corasick automaton, which yields
the longest vocabulary entry that starts at each byte. Encoding takes longest matches from
left to right; an entry may follow another only if the merges of the two side by side would
leave their border alone (a compatibility found by undoing merges, and remembered). If no
entry fits, the last one is taken back and shortened, and a border that led nowhere is never
tried again, which keeps the work linear. The result is exactly that of the merges.

Defined cases: a null text counts as empty; an empty text has 0 tokens; texts are split by
the given pattern whole, whatever their length; repeated rows are encoded each; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

#: Distinct pieces, and pairs of entries, that a task remembers (about 250 and 80 bytes each). Of the pieces the older
#: half goes when it is full, but for those met again since; the pairs start afresh.
PIECES, PAIRS = 260_000, 150_000
#: Texts that a task holds at a time, at most, in the JVM's buffers and in Python's.
ROWS = 1_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bits of the right one of two ranks in a number that stands for both.
PAIR = 32
ENCODED = "doc_id long, ids array<int>, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks and what follows from them; the same tables for any text.

    ranks: by entry, read as Latin-1; bytes_of, length: by rank; left, right: the two entries whose
    merge makes an entry (itself twice for a single byte or an entry that merges never reach); pairs:
    an entry by its halves (see PAIR); shorter: the longest entry that is a proper prefix, or -1.
    """

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.left, self.right, self.shorter = list(range(size)), list(range(size)), [-1] * size
        self.pairs: dict[int, int] = {}
        self.reached: set[int] = set()
        for text, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.bytes_of[rank] = text
            halves = self._halves(ranks, text, rank) if len(text) > 1 else None
            if halves:
                self.left[rank], self.right[rank] = halves
                self.pairs[halves[0] << PAIR | halves[1]] = rank
            if halves or len(text) == 1:
                self.reached.add(rank)
        for rank in self.reached:
            text = self.bytes_of[rank]
            for n in range(len(text) - 1, 0, -1):
                if (own := ranks.get(text[:n])) is not None and own in self.reached:
                    self.shorter[rank] = own
                    break
        self.length = [len(b) for b in self.bytes_of]
        self.ranks = {text.decode("latin-1"): rank for text, rank in ranks.items()}

    @staticmethod
    def _halves(ranks: dict[bytes, int], text: bytes, rank: int) -> tuple[int, int] | None:
        """The last two parts of merging text by the ranks below its own; None if more are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            own = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            if (least := min(own)) >= rank:
                return None
            i = own.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        a, b = (ranks.get(p) for p in parts)
        return None if a is None or b is None or max(a, b) >= rank else (a, b)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.single = {text: rank for text, rank in vocabulary.ranks.items() if len(text) == 1}
        self.automaton = ahocorasick.Automaton()
        for rank in vocabulary.reached:
            if vocabulary.length[rank] > 1:
                self.automaton.add_word(vocabulary.bytes_of[rank].decode("latin-1"), rank)
        self.longer = len(self.automaton) > 0
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two; remembered in fits."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        known = self.fits[left << PAIR | right] = self._border_stays(left, right)
        return known

    def _border_stays(self, left: int, right: int) -> bool:
        """Undo the later merge of the two sides step by step; the border goes if, at some
        step, the entries beside it merge before that step's merge happens."""
        first, second, pairs, before = self.v.left, self.v.right, self.v.pairs, 1 << 62
        while True:
            joined = pairs.get(left << PAIR | right)
            if joined is not None and joined < before:
                return False
            if left > right and second[left] != left:
                before, left = left, second[left]
            elif first[right] != right and right >= left:
                before, right = right + 1, first[right]
            elif second[left] != left:
                before, left = left, second[left]
            elif first[right] != right:
                before, right = right + 1, first[right]
            else:
                return True

    def bytes(self, text: str) -> tuple[int, ...]:
        """Token ids of one piece, its bytes read as Latin-1."""
        if (whole := self.v.ranks.get(text)) is not None:
            return (whole,)
        if not text:
            return ()
        size, length, shorter, single, fits = len(text), self.v.length, self.v.shorter, self.single, self.fits.get
        longest = [-1] * (size + 1)
        for end, rank in self.automaton.iter(text) if self.longer else ():
            longest[end - length[rank] + 1] = rank  # ends rise, so the longest stays
        out: list[int] = []
        open_ = bytearray(b"\x01") * (size + 1)
        at, last = 0, -1
        token = longest[0] if longest[0] >= 0 else single[text[0]]
        while True:
            end = at + length[token]
            if open_[end] and (last < 0 or (fit := fits(last << PAIR | token)) or (fit is None and self._compatible(last, token))):
                out.append(token)
                if end == size:
                    return tuple(out)
                at, last, token = end, token, longest[end]
                if token < 0:
                    token = single[text[at]]
            elif (less := shorter[token]) >= 0:
                token = less
            else:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def piece(self, piece: str) -> tuple[int, ...]:
        """Token ids of one piece that isn't among those known."""
        if (ids := self.older.get(piece)) is None:
            ids = self.bytes(piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1"))
        if len(piece) <= 64:
            known = self.known
            if len(known) >= PIECES // 2:
                self.older = known
                known = self.known = {}
            known[piece] = ids
        return ids


def _encoded(batches: Iterator[pa.RecordBatch], shipped, pattern: str, digest: bool) -> Iterator[pa.RecordBatch]:
    import regex

    encoder, split = Encoder(shipped.value), regex.compile(pattern)
    piece = encoder.piece
    texts_of = encoder.v.bytes_of
    names = [str(r) for r in range(len(texts_of))]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            known = encoder.known.get
            ids = list(chain.from_iterable([known(p) or piece(p) for p in split.findall(text.as_py() or "")]))
            rows.append((ids, b"".join([texts_of[i] for i in ids])) if not digest else (len(ids), hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(b"".join([texts_of[i] for i in ids])).hexdigest()))
        a, *rest = zip(*rows, strict=True) if rows else ((), (), ()) if digest else ((), ())
        if digest:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(rest[0], pa.string()), pa.array(rest[1], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.list_(pa.int32())), pa.array(rest[0], pa.binary())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, ranks: str, pattern: str, digest: bool = False) -> DataFrame:
    """Encode every text and decode the ids again, in one pass without a shuffle.

    Rows: ENCODED, or with digest=True doc_id, n_tokens, ids_sha256, decoded_sha256 (the
    same ids and bytes, hashed in the task that made them). ranks: path of the rank file on
    the driver; its tables are broadcast (their size is the vocabulary's, not the data's).
    The session's Arrow batches are held to ROWS rows from here on, as the batch size is read when a plan runs.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= ROWS:
        conf.set(BATCH, ROWS)
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks)))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else ENCODED
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _encoded(batches, shipped, pattern, digest), kind)


def decode(rows: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids); unknown ids are an error, null ids decode to nothing."""
    shipped = rows.sparkSession.sparkContext.broadcast({r: b for b, r in read_ranks(ranks).items()})

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b"".join(map(shipped.value.__getitem__, ids.as_py() or [])) for ids in batch.column("ids")], pa.binary())], names=["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(back, "doc_id long, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
