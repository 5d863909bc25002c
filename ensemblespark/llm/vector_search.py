"""Exact inner-product search by exhaustive term-at-a-time accumulation.

Vectors are read as sparse integer rows: component x becomes floor(256 * x), and dimensions
at 0 are left out. Candidates are taken in blocks; a block is turned into postings, for each
dimension the rows that hold it and their weights. Queries, in groups, go through a block
dimension by dimension: the weights of a query's dimension, times its own, are scattered into
a dense array of scores over the block. A partition then selects the best of the block, which
are merged with the best that the task has seen so far; a task returns k rows a query, and one
grouping merges the tasks.

Queries are a share of the rows, so they grow too. They are dealt into goes of a bounded
number of components, counted before, and only a go's queries are broadcast; each go scans the
candidates once, without a shuffle of vectors. The work is a product for each query and row,
which an exhaustive search is by definition; no pair is ever a row.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a
vector shorter than another counts as followed by zeros, an empty one scores 0 with all;
numbers are taken to 64 bits (components beyond stay at the limit, sums wrap); a query's own
row is left out, another row of the same vec_id isn't; each of several query rows with one
vec_id has its ranks; ties go to the smaller vec_id, null last; rows with a null vec_id are
candidates only; columns besides vec_id and embedding are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep, table

TOP = 5
#: Rows with an id divisible by this are queries.
EVERY = 50
#: Candidates of a block, queries that go through it together, and components of queries broadcast at a time.
BLOCK, GROUP, COMPONENTS = 4096, 64, 8_000_000
ROWS = "uid long, vec_id long, v array<long>"
FOUND = "query long, query_id long, vec_id long, score long"


@dataclass
class Sparse:
    """Integer rows; the dimensions of row i that aren't 0 are dims[at[i]:at[i + 1]], in rising order."""

    uid: np.ndarray
    vec_id: np.ndarray
    known: np.ndarray  # whether vec_id is not null
    at: np.ndarray
    dims: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Sparse:
        """Rows of ROWS, by vec_id (null last)."""
        rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        v = rows.column("v").combine_chunks()
        at, flat = v.offsets.to_numpy().astype(np.int64), v.values.to_numpy(zero_copy_only=False)
        flat, at = flat[at[0] : at[-1]], at - at[0]
        held = np.flatnonzero(flat)
        row = np.repeat(np.arange(len(v)), np.diff(at))[held]
        vec_id = rows.column("vec_id").combine_chunks()
        return cls(
            rows.column("uid").to_numpy(), vec_id.fill_null(0).to_numpy(zero_copy_only=False), vec_id.is_valid().to_numpy(zero_copy_only=False),
            np.searchsorted(row, np.arange(len(v) + 1)), held - at[row], flat[held],
        )

    def __len__(self) -> int:
        return len(self.uid)

    def postings(self, a: int = 0, b: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each dimension the rows from a to b that hold it, counted from a, and their weights."""
        b = len(self) if b is None else b
        i, j = self.at[a], self.at[b]
        row = np.repeat(np.arange(b - a), np.diff(self.at[a : b + 1]))
        order = np.argsort(self.dims[i:j], kind="stable")
        dims = self.dims[i:j][order]
        cut = np.flatnonzero(np.diff(dims, prepend=-1))
        ends = np.append(cut, len(dims))
        return {int(dims[x]): (row[order[x:y]], self.weights[i:j][order[x:y]]) for x, y in zip(ends[:-1], ends[1:], strict=True)}


def accumulate(block: dict, queries: dict, n_rows: int, n_queries: int) -> np.ndarray:
    """(rows, queries): all inner products, one dimension of the queries at a time."""
    scores = np.zeros((n_rows, n_queries), np.int64)
    for dim, (columns, theirs) in queries.items():
        if (posting := block.get(dim)) is None:
            continue
        rows, weights = posting
        added = np.multiply.outer(weights, theirs)
        if len(rows) == n_rows and len(columns) == n_queries:  # every row and query holds the dimension
            scores += added
        elif len(columns) == n_queries:
            scores[rows] += added
        else:
            scores[np.ix_(rows, columns)] += added
    return scores


@dataclass
class Best:
    """The best candidates of each query so far: score, whether vec_id is null, vec_id."""

    top: int
    held: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, query: int, scores: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        new = np.stack([scores, unknown.astype(np.int64), ids])
        if (old := self.held.get(query)) is not None:
            new = np.concatenate([old, new], axis=1)
        # ~score falls as score rises, and has no overflow
        self.held[query] = new[:, np.lexsort((new[2], new[1], ~new[0]))[: self.top]]


def select(scores: np.ndarray, block: Sparse, queries: Sparse, first: int, best: Best) -> None:
    """Merge a block's best rows for the queries from first on; a query's own row is none of them."""
    n, top = len(block), best.top
    place = {int(u): i for i, u in enumerate(block.uid)}
    least = np.partition(scores, n - top - 1, axis=0)[n - top - 1] if n > top + 1 else None  # one more, should the own row be among them
    for j in range(scores.shape[1]):
        column = scores[:, j]
        rows = np.flatnonzero(column >= least[j]) if least is not None else np.arange(n)
        if (own := place.get(int(queries.uid[first + j]))) is not None:
            rows = rows[rows != own]
        rows = rows[np.argsort(~column[rows], kind="stable")[:top]]  # the block is in order of vec_id
        if len(rows):
            best.add(first + j, column[rows], ~block.known[rows], block.vec_id[rows])


def _searching(shipped, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Sparse = shipped.value
        groups = [(a, queries.postings(a, min(a + GROUP, len(queries)))) for a in range(0, len(queries), GROUP)]
        best, waiting, size = Best(top), [], 0

        def settle() -> None:
            block = Sparse.of(pa.Table.from_batches(waiting))
            postings = block.postings()
            for a, terms in groups:
                select(accumulate(postings, terms, len(block), min(GROUP, len(queries) - a)), block, queries, a, best)
            waiting.clear()

        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                if size + len(part) > BLOCK:
                    settle()
                    size = 0
                waiting.append(part)
                size += len(part)
        if waiting:
            settle()
        if best.held:
            q = np.repeat(list(best.held), [x.shape[1] for x in best.held.values()])
            score, unknown, ids = np.concatenate(list(best.held.values()), axis=1)
            columns = [pa.array(queries.uid[q]), pa.array(queries.vec_id[q]), pa.array(ids, mask=unknown.astype(bool)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    return search


def integer_rows(vectors: DataFrame) -> DataFrame:
    """ROWS of vectors (vec_id, embedding) that take part, numbered and written once."""
    v = F.col("embedding")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), v)
    return keep(own.where(usable).select("uid", "vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("v")))


def top_k(rows: DataFrame, queries: DataFrame, top: int = TOP, components: int = COMPONENTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the top best of rows (ROWS) for each of queries (ROWS, a subset of rows)."""
    spark = rows.sparkSession
    goes = int((queries.agg(F.sum(F.size("v") + 1)).first()[0] or 0) // components) + 1
    found = None
    for go in range(goes):
        mine = Sparse.of(queries.where(F.pmod(F.xxhash64("uid"), F.lit(goes)) == go).select(*[x.split()[0] for x in ROWS.split(", ")]).toArrow())
        part = rows.mapInArrow(_searching(spark.sparkContext.broadcast(mine), top), FOUND)
        part = keep(part) if goes > 1 else part
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP13_SQL = """
WITH own AS (
  SELECT row_number() OVER () AS uid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), paired AS (
  SELECT q.uid AS query, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([coalesce(x[1] * x[2], 0) FOR x IN list_zip(q.v, c.v)]), 0) AS BIGINT) AS score
  FROM own q JOIN own c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM paired
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
