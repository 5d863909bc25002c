"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random hashes (the
signs of random projections) and compares every vector with the next `window` ones, by
cosine in double precision. The verified pairs of all passes are united into components.
Passes differ in their projections, so a pair that one order tears apart is near in another;
all passes are one range-partitioned sort, and the ends of neighbouring partitions are
compared too. Equal vectors are one, whatever their number.

A bounded window can't see all links within a large component, so links are then counted
exactly there: a component's vectors are cut into blocks, and each pair of blocks is compared
by one matrix product that yields counts, not pairs.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component,
or whose label is null, links with nothing and is kept; vectors of different length never
link; repeated rows link with each other; a row whose vec_id is null has a component_id if
linked with others that have ids, else null, and is kept only in the latter case; columns
besides vec_id, embedding and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from ..operators.components import components
from .store import keep, table

LEAST = 0.93
PASSES = 24
WINDOW = 40
#: Random hashes concatenated into a sort key (bits of a 64-bit integer).
BITS = 62
BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # so that no square overflows or vanishes
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def _planes(length: int) -> np.ndarray:
    return np.random.default_rng(length).normal(size=(length, PASSES * BITS))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector and pass with its sort key; vectors stay as they are."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        length = batch.column("length").to_numpy()
        for d in np.unique(length):
            part = batch.take(pa.array(np.flatnonzero(length == d)))
            x = _matrix(part.column("v"))
            if d not in planes:
                planes[d] = _planes(int(d))
            for at in range(0, len(x), 256):
                own = part.slice(at, 256)
                bits = (x[at : at + 256] @ planes[d] > 0).reshape(-1, PASSES, BITS).astype(np.int64)
                keys = (bits << np.arange(BITS - 1, -1, -1)).sum(2)
                for p in range(PASSES):
                    yield pa.RecordBatch.from_arrays([own.column("space"), pa.array(np.full(len(own), p, np.int32)), pa.array(keys[:, p]), own.column("node"), own.column("v")], names=["space", "pass", "key", "node", "v"])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs (u, v): each node with its tree's least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def _near(rows: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among sorted rows, each compared with the next `window` of its pass and space."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    node, space = rows.column("node").to_numpy(), rows.column("space").to_numpy()
    run = np.r_[0, np.flatnonzero((np.diff(space) != 0) | (np.diff(rows.column("pass").to_numpy()) != 0)) + 1, len(node)]
    column = rows.column("v").combine_chunks()
    for a, b in zip(run[:-1], run[1:], strict=True):
        if b - a < 2:
            continue
        for at in range(a, b, 4096):  # a block of rows and the window after it
            stop = min(b, at + 4096 + window)
            x, own = _matrix(column.slice(at, stop - at)), node[at:stop]
            for k in range(1, min(window, len(own) - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", x[:-k], x[k:]) >= LEAST)
                near = near[own[near] != own[near + k]]
                u.append(own[near])
                v.append(own[near + k])
    return np.concatenate(u), np.concatenate(v)


#: Sorted rows compared at a time by a task.
RUN = 20_000


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a sorted partition: a forest of the links found; and the first and last rows,
    for the comparison with the partitions beside it (part = this partition or the one before)."""
    from pyspark import TaskContext

    me = TaskContext.get().partitionId()
    kind = pa.list_(pa.float64())
    names = ["u", "w", "part", "head", "space", "pass", "key", "node", "v"]

    def edges(u, w):
        n = len(u)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), *[pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind)]], names=names)

    def ends(rows: pa.Table, head: bool):
        n = len(rows)
        own = [rows.column(c).combine_chunks() for c in ("space", "pass", "key", "node", "v")]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, me - head, np.int32)), pa.array(np.full(n, head)), *own], names=names)

    held: pa.Table | None = None
    seen = 0
    head: pa.Table | None = None

    def compared(rows: pa.Table):
        u, w = _near(rows, WINDOW)
        return edges(*_forest(u, w))

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        kind = batch.schema.field("v").type
        if seen < WINDOW:
            more = rows.slice(0, WINDOW - seen)
            head = more if head is None else pa.concat_tables([head, more])
        seen += len(rows)
        held = rows if held is None else pa.concat_tables([held, rows])
        if len(held) >= RUN:
            yield compared(held)
            held = held.slice(len(held) - WINDOW)
    if held is not None and len(held):
        yield compared(held)
        yield ends(head, True)
        yield ends(held.slice(max(0, len(held) - WINDOW)), False)


def _borders(rows: pa.Table) -> pa.Table:
    """The last rows of a partition against the first of the next."""
    rows = rows.sort_by([("space", "ascending"), ("pass", "ascending"), ("key", "ascending"), ("node", "ascending")])
    u, w = _forest(*_near(rows, WINDOW))
    return pa.table({"u": u, "w": w})


def _blocks_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, b1, b2, block, node, v, n) sorted by the first three: links of each vector of
    the two blocks into the other one (into its own, if they are the same)."""
    held: pa.Table | None = None

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        where = [rows.column(c).to_numpy() for c in ("component", "b1", "b2")]
        cut = np.flatnonzero(np.any([np.diff(w) != 0 for w in where], axis=0)) + 1
        block, node, n, v = (*(rows.column(c).to_numpy() for c in ("block", "node", "n")), rows.column("v").combine_chunks())
        for i, j in zip([0, *cut], [*cut, len(rows)], strict=True):
            one = i + np.flatnonzero(block[i:j] == where[1][i])
            two = i + np.flatnonzero(block[i:j] == where[2][i])
            if not len(one) or not len(two):
                continue
            x, y = _matrix(v.take(pa.array(one))), _matrix(v.take(pa.array(two)))
            hit = (x @ y.T >= LEAST) & (node[one][:, None] != node[two][None, :])
            sides = [(one, hit @ n[two])] + ([(two, n[one] @ hit)] if where[1][i] != where[2][i] else [])
            for rows_, many in sides:
                some = many > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[rows_][some]), pa.array(many[some].astype(np.int64))], names=["node", "n"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        keys = [held.column(c).to_numpy() for c in ("component", "b1", "b2")]
        last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        if len(last):  # all but the group that may go on
            yield from counted(held.slice(0, last[-1] + 1))
            held = held.slice(last[-1] + 1).combine_chunks()
    if held is not None and len(held):
        yield from counted(held)


def links(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label).
    uid numbers the rows; it is written once with them, so later scans can't number them anew."""
    spark = vectors.sparkSession
    usable = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    from pyspark.sql.types import ArrayType, FloatType

    exact = vectors.schema["embedding"].dataType
    kind = "array<float>" if isinstance(exact, ArrayType) and isinstance(exact.elementType, FloatType) else "array<double>"
    own = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    own = own.select("uid", "vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("ok"))
    own = own.withColumn("mark", F.when(F.col("ok"), F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))))))
    rows = keep(own.select("uid", "vec_id", "label", "mark", F.when(F.col("ok"), F.col("embedding")).alias("v")))
    usable_rows = rows.where("mark is not null")
    classes = keep(usable_rows.groupBy("label", "mark").agg(F.min("uid").alias("node"), F.min("vec_id").alias("least_id"), F.count("*").alias("same")))
    nodes = keep(rows.select(F.col("uid").alias("node"), "v").join(classes, "node").select("node", F.col("label").alias("space"), F.size("v").alias("length"), "v", F.col("same").alias("n")))
    count = nodes.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count * PASSES // (8 * WINDOW)))
    keyed = nodes.select("node", F.xxhash64("space", "length").alias("space"), "length", "v").mapInArrow(_keyed, f"space long, pass int, key long, node long, v {kind}")
    order = ["space", "pass", "key", "node"]
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = keep(sorted_.mapInArrow(_windows, f"u long, w long, part int, head boolean, space long, pass int, key long, node long, v {kind}"))
    border = found.where("part is not null").select("part", "space", "pass", "key", "node", "v").groupBy("part").applyInArrow(_borders, "u long, w long")
    label = components(found.where("u is not null").select("u", "w").union(border), "u", "w")
    # Exact counts within components of two nodes or more.
    placed = keep(nodes.join(label.select("node", "component"), "node").select("component", "node", "v", "n"))
    sizes = placed.groupBy("component").count()
    dealt = placed.join(sizes, "component").withColumn("of", F.ceil(F.col("count") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("component", F.least("block", "with").alias("b1"), F.greatest("block", "with").alias("b2"), "block", "node", "v", F.col("n").cast("long").alias("n"))
    pairs = ["component", "b1", "b2"]  # each pair of blocks is a group of its own, of about 2 * BLOCK vectors
    counted = dealt.repartition(*pairs).sortWithinPartitions(*pairs).mapInArrow(_blocks_linked, "node long, n long").groupBy("node").agg(F.sum("n").alias("others"))
    placed = classes.join(label, "node", "left").join(counted, "node", "left")
    placed = keep(placed.select("label", "mark", "least_id", F.coalesce("component", "node").alias("group"), (F.coalesce("others", F.lit(0)) + F.col("same") - 1).alias("n_links")))
    least = placed.groupBy("group").agg(F.min("least_id").alias("component_id"))
    known = placed.join(least, "group").select("label", "mark", "n_links", "component_id")
    out = rows.select("uid", "vec_id", "label", "mark").join(known, ["label", "mark"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("uid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("uid")
