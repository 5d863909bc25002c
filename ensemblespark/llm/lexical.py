"""Ranked lexical search, hybrid of term at a time and document at a time, over an inverted index.

build() writes an index of segments: the documents of about 16 MB of text each, their lengths,
and for every term its postings (document and occurrences) in order of documents. search()
first asks the segments in how many documents each query term occurs, then scores. In a
segment a query's lists are of two kinds. Short ones are taken term at a time: their scores are
summed into accumulators, and those of all short lists together become one iterator over
documents, bounded by its largest sum. It and the long lists, each bounded by its largest
score, are then gone through document at a time: the iterators of least bound, which together
can't reach the worst of the k best scores so far, don't bring up documents; documents that the
others bring up are looked up in them by search, which skips the rest of the list, and only
while what they can still add might suffice. Documents are taken in steps of STEP, between
which the worst of the best rises. The k best of a query are carried from segment to segment of
a task, and a task returns k rows a query.

Every document is in the index and every posting counts; bounds only leave out what can't be
among the k best, ties included. Terms are known by 64-bit hashes. Queries are a table that may
grow: they are dealt into goes of a bounded number of terms, counted before, and only a go's
terms are broadcast.

Defined cases: a null text has no terms; documents without terms aren't counted and never
found; query rows equal in item_id and text are one item, others with the same item_id are each
ranked on their own; ties go to the smaller doc_id, null last; rows with the same doc_id are
each a document; texts of any length are read whole (a longer one than a segment is one by
itself); items without a known term give no rows; columns besides ids and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing as H
from .packing import pack, unpack
from .store import keep, table

TOP = 20
#: Bytes of text in a segment, documents that are gone through in a step, query terms broadcast at a time.
SEGMENT, STEP, TERMS = 16 << 20, 1024, 500_000
#: Lists are short while their postings together are at most this share of a segment's documents.
SHORT = 0.5
INDEX = "n_docs long, n_terms long, docs binary, known binary, n binary, terms binary, ends binary, at binary, tf binary"
FOUND = "query long, item_id long, doc_id long, score long"


def _names(kind: str) -> list[str]:
    return [x.split()[0] for x in kind.split(", ")]


def _runs(key: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    for x in others:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each text; term, text and occurrences of each distinct pair, by term and text)."""
    words = H.words_of(H.texts_of(texts), H.NOT_ALNUM, H.LOWER_CODES)
    order = np.argsort(words.hashes, kind="stable")
    key, owner = words.hashes[order], words.owner()[order]
    at = _runs(key, owner)
    return np.diff(words.offsets), key[at], owner[at], np.diff(np.append(at, len(key)))


def _segment(parts: list) -> pa.RecordBatch:
    ids, lengths = pa.concat_arrays([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    base = np.cumsum([0, *(len(x[1]) for x in parts)])
    key = np.concatenate([x[2] for x in parts])
    doc, tf = np.concatenate([x[3] + b for x, b in zip(parts, base, strict=False)]), np.concatenate([x[4] for x in parts])
    order = np.argsort(key, kind="stable")
    key, doc, tf = key[order], doc[order], tf[order]
    worded = np.flatnonzero(lengths)
    doc = (np.cumsum(lengths > 0) - 1)[doc]
    starts = _runs(key)
    ids, lengths = ids.take(pa.array(worded)), lengths[worded]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = [ids.fill_null(0).to_numpy(zero_copy_only=False), known, lengths, key[starts], np.append(starts[1:], len(key)) if len(key) else np.zeros(0, np.int64), doc.astype(np.int32), tf.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([len(worded)]), pa.array([int(lengths.sum())]), *(pa.array([pack(x)]) for x in values)], names=_names(INDEX))


def _indexing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in H.slices(batches):
        text = batch.column("text")
        if parts and size + text.nbytes > SEGMENT:
            yield _segment(parts)
            parts, size = [], 0
        parts.append((batch.column("doc_id"), *_counted(text)))
        size += text.nbytes
    if parts:
        yield _segment(parts)


def build(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), INDEX, one row a segment, written once."""
    return keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_indexing, INDEX))


@dataclass
class Queries:
    """Query i asks for terms[at[i]:at[i + 1]] (places in hashes), each times[...] times."""

    query: np.ndarray
    item_id: list
    at: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        rows = rows.sort_by("query")
        query, h = (rows.column(c).to_numpy() for c in ("query", "h"))
        hashes, terms = np.unique(h.view(np.uint64), return_inverse=True)
        first = _runs(query)
        return cls(query[first], rows.column("item_id").take(pa.array(first)).to_pylist(), np.append(first, len(query)), terms, rows.column("times").to_numpy(), hashes)


@dataclass
class List:
    """A term's documents in a segment, rising, what each is worth to a query, and the most of it."""

    docs: np.ndarray
    scores: np.ndarray
    bound: int

    @classmethod
    def of(cls, docs: np.ndarray, scores: np.ndarray) -> List:
        return cls(docs, scores, int(scores.max()) if len(scores) else 0)

    def within(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.searchsorted(self.docs, (lo, hi))
        return self.docs[i:j], self.scores[i:j]

    def lookup(self, wanted: np.ndarray) -> np.ndarray:
        """The score of each wanted document, 0 where the list doesn't hold it."""
        at = np.minimum(np.searchsorted(self.docs, wanted), len(self.docs) - 1)
        return np.where(self.docs[at] == wanted, self.scores[at], 0)


class Best:
    """The k best documents so far: score, whether the id is null, id."""

    def __init__(self, top: int):
        self.top, self.rows = top, np.zeros((3, 0), np.int64)

    def least(self) -> int:
        """A score below this is not among the best, one equal may be."""
        return max(1, int(self.rows[0, -1])) if self.rows.shape[1] == self.top else 1

    def add(self, scores: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            new = np.concatenate([self.rows, np.stack([scores, unknown.astype(np.int64), ids])], axis=1)
            self.rows = new[:, np.lexsort((new[2], new[1], -new[0]))[: self.top]]


class Segment:
    def __init__(self, row: dict):
        self.n_docs = row["n_docs"]
        get = lambda c, kind: unpack(row[c], kind)
        self.terms, self.ends = get("terms", np.uint64), get("ends", np.int64)
        if "docs" in row:
            self.docs, self.known, self.n = get("docs", np.int64), get("known", bool), get("n", np.int64)
            self.at, self.tf = get("at", np.int32), get("tf", np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the segment has each term, -1 if it doesn't."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def worth(self, places: np.ndarray, n_all: int, terms_all: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By place: the term's documents, and for each the share of the term's weight that it scores, as integers."""
        m = 75 + (25 * self.n * n_all) // terms_all
        out = {}
        for p in places.tolist():
            i, j = int(self.ends[p - 1]) if p else 0, int(self.ends[p])
            docs, tf = self.at[i:j], self.tf[i:j].astype(np.int64)
            out[p] = docs, (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
        return out


def hybrid(lists: list[List], segment: Segment, best: Best) -> None:
    """Merge a segment's best documents for one query; see the module's description."""
    lists.sort(key=lambda x: len(x.docs))
    summed = np.cumsum([len(x.docs) for x in lists])
    n_short = int(np.searchsorted(summed, SHORT * segment.n_docs, "right"))
    iterators = lists[n_short:]
    if n_short:
        accumulators = np.zeros(segment.n_docs, np.int64)
        for x in lists[:n_short]:
            accumulators[x.docs] += x.scores
        touched = np.flatnonzero(accumulators)
        iterators.append(List.of(touched, accumulators[touched]))
    iterators = sorted((x for x in iterators if x.bound > 0), key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in iterators])
    for lo in range(0, segment.n_docs, STEP):
        least = best.least()
        optional = int(np.searchsorted(reach, least))  # so many of the first together stay below
        if optional == len(iterators):
            return
        score = np.zeros(min(STEP, segment.n_docs - lo), np.int64)
        for x in iterators[optional:]:
            docs, worth = x.within(lo, lo + STEP)
            score[docs - lo] += worth
        found = np.flatnonzero(score)
        score, found = score[found], found + lo
        for k in range(optional - 1, -1, -1):
            enough = score + reach[k] >= least
            score, found = score[enough], found[enough]
            if not len(found):
                break
            score = score + iterators[k].lookup(found)
        enough = score >= least
        found = found[enough]
        best.add(score[enough], ~segment.known[found], segment.docs[found])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(len(batch)):
            yield Segment({c: batch.column(c)[i].as_py() for c in batch.schema.names})


def _document_counts(shipped):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shipped.value.hashes
        df = np.zeros(len(hashes), np.int64)
        for segment in _rows(batches):
            at = segment.places(hashes)
            df[at >= 0] += segment.sizes()[at[at >= 0]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return count


def _searching(shipped, weights, n_all: int, terms_all: int, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shipped.value, weights.value
        best = [Best(top) for _ in queries.query]
        for segment in _rows(batches):
            place = segment.places(queries.hashes)
            worth = segment.worth(place[place >= 0], n_all, terms_all)
            for q, mine in enumerate(best):
                lists = []
                for k in range(queries.at[q], queries.at[q + 1]):
                    if (p := int(place[queries.terms[k]])) >= 0:
                        docs, share = worth[p]
                        lists.append(List.of(docs, share * (weight[queries.terms[k]] * queries.times[k])))
                if lists:
                    hybrid(lists, segment, mine)
        n = [x.rows.shape[1] for x in best]
        score, unknown, ids = np.concatenate([x.rows for x in best], axis=1) if best else np.zeros((3, 0), np.int64)
        item = list(itertools.chain.from_iterable([i] * k for i, k in zip(queries.item_id, n, strict=True)))
        columns = [pa.array(np.repeat(queries.query, n)), pa.array(item, pa.int64()), pa.array(ids, mask=unknown.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=_names(FOUND))

    return search


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in H.slices(batches):
        _, key, owner, times = _counted(batch.column("text"))
        at = pa.array(owner)
        yield pa.RecordBatch.from_arrays([batch.column("query").take(at), batch.column("item_id").take(at), pa.array(key.view(np.int64)), pa.array(times)], names=["query", "item_id", "h", "times"])


def search(index: DataFrame, queries: DataFrame, top: int = TOP, terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of an index for each of queries (item_id, text)."""
    context = index.sparkSession.sparkContext
    n_all, terms_all = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    own = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates().withColumn("query", F.monotonically_increasing_id())
    asked = keep(own.mapInArrow(_query_terms, "query long, item_id long, h long, times long"))
    goes = asked.count() // terms + 1
    found = None
    for go in range(goes):
        mine = Queries.of(asked.where(F.pmod(F.xxhash64("query"), F.lit(goes)) == go).toArrow())
        shipped = context.broadcast(mine)
        held = index.select("n_docs", "terms", "ends").mapInArrow(_document_counts(shipped), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weight = np.zeros(len(mine.hashes), np.int64)
        for row in held.collect():  # at most one row per term of the go
            weight[row.term] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * row.df + 1)))
        part = index.mapInArrow(_searching(shipped, context.broadcast(weight), n_all, max(terms_all, 1), top), FOUND)
        part = keep(part) if goes > 1 else part
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), docs AS (SELECT doc, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM terms WHERE len(t) > 0
), whole AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(n) AS BIGINT) AS terms_all FROM docs
), asked AS (
  SELECT query, item_id, term, count(*) AS times FROM (
    SELECT query, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS query, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))
  ) GROUP BY ALL
), postings AS (
  SELECT doc, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, doc_id, n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_all) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term
), scores AS (
  SELECT query, item_id, doc, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_all) // terms_all))))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), whole GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
