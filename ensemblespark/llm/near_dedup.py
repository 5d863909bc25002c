"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A text's shingles are its distinct windows of five words (A-Z folded; a shorter text is one
window), each weighted by how many different words it has. Each weighted shingle sends a Poisson process of
arrivals, of its weight as rate, to random registers; a register keeps the shingle that came
first, and a shingle stops as soon as its next arrival is later than all registers, so the
expected work is about that of the shingles plus m log m. Two texts agree in a register with
the probability Jaccard similarity of their weighted shingles, which for weights that belong to
the shingle, not to the text, is the weight of the shingles in both over that of those in either.
Bands of registers give candidates; a pair is linked if that same similarity, summed exactly, is
at least 0.8, so what is hashed is what is verified, however often passages repeat; documents
reached by links are one group. A pair at 0.8 shares a band with a probability of
1 - (1 - 0.8 ** ROWS) ** BANDS, 0.998.

No candidate pair is ever a row of its own beyond one per node and bucket. Texts with the same
words are one node. In a bucket every node is compared with the bucket's head, the node that
shares most slots overall, which connects large families of alike texts and gives every node
its distance from the head. One less the weighted similarity is a metric: two nodes whose distances from their
head differ by more than 0.2 can't be linked. What that leaves of buckets that still hold
several groups is compared pair by pair within tasks, in blocks, and tasks return only links
between different groups. So every candidate pair is compared, ruled out by the metric, or
already in one group, and no cap is set.

Rows are known by their id and a 128-bit hash of their text, so nothing depends on the order
in which files are read.

Defined cases: texts without a word (null, empty, blank) are alike to nothing, themselves
kept; texts of any length are read whole; equal rows are one group; null ids come after all
others when the kept row (least doc_id, then first row) is chosen; component_id is the least
id of the group, null if all are null; columns besides doc_id and text are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from ..operators.components import components
from .store import forget, keep, small, table

WIDTH = 5
#: Similarity as a fraction: at least LINK[0] / LINK[1].
LINK = (4, 5)
BANDS, ROWS = 20, 6
#: Distance beyond which nothing is linked, with room for rounding.
FAR = 1 - LINK[0] / LINK[1] + 1e-9
#: Members compared with their head, and nodes or shingles of a block, in one run of a task.
MEMBERS, BLOCK_NODES, BLOCK_SHINGLES = 1_000, 256, 400_000
#: From so many nodes on a block is compared by matrix products.
DENSE = 48
_ID_BITS = np.uint64((1 << 22) - 1)
_NEVER = np.uint64((1 << 64) - 1)
#: Words signed at a time; bounds the temporary arrays (a longer text is signed alone).
CHUNK = 200_000


def shingles(words: H.Words) -> tuple[np.ndarray, np.ndarray]:
    """(owner, shingle): the distinct shingles of each text, sorted; a shingle's last three bits are its weight."""
    owner, n = words.owner(), len(words.hashes)
    left = words.offsets[1:][owner] - np.arange(n)  # words from here to the text's end
    size = np.diff(words.offsets)[owner]
    start = (left >= WIDTH) | ((size < WIDTH) & (left == size))
    key, weight = words.hashes.copy(), np.ones(n, np.uint64)
    for k in range(1, WIDTH):
        use = np.flatnonzero(left > k)
        new = words.hashes[use + k]
        key[use] = H.chain(key[use], new)
        seen = np.zeros(len(use), bool)
        for j in range(k):
            seen |= words.hashes[use + j] == new
        weight[use] += ~seen
    key, owner = (key[start] >> np.uint64(1)) & ~np.uint64(7) | weight[start], owner[start]  # without the top bit they sort alike as signed numbers
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], key[first]


def weights(keys: np.ndarray) -> np.ndarray:
    return (keys & keys.dtype.type(7)).astype(np.int64)


def prob_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) registers; a register holds 22 bits of the element that reached it first."""
    first = np.full(n * m, _NEVER)
    time = np.zeros(len(element))
    own, x, w, step = owner, element, weight, 0
    while len(own):
        step += 1
        r = H.mix(x + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / w
        register = (H.mix(r ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        arrival = (time.view(np.uint64) & ~_ID_BITS) | (x & _ID_BITS)
        np.minimum.at(first, own * m + register, arrival)
        some = np.unique(own) if step > 8 else None
        if some is None:
            last = first.reshape(n, m).max(1)
        else:
            last = np.zeros(n, np.uint64)
            last[some] = first.reshape(n, m)[some].max(1)
        on = arrival < last[own]
        own, x, w, time = own[on], x[on], w[on], time[on]
    return first.reshape(n, m) & _ID_BITS


def _chunks(words: H.Words) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK words."""
    i, n = 0, len(words.offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(words.offsets, words.offsets[i] + CHUNK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _part(words: H.Words, i: int, j: int) -> H.Words:
    a, b = words.offsets[i], words.offsets[j]
    return H.Words(words.starts[a:b], words.ends[a:b], words.hashes[a:b], words.offsets[i : j + 1] - a)


def band_keys(words: H.Words) -> np.ndarray:
    """(texts, BANDS): a key for each band."""
    out = np.zeros((len(words.offsets) - 1, BANDS), np.uint64)
    for i, j in _chunks(words):
        owner, key = shingles(_part(words, i, j))
        got = prob_minhash(owner, H.mix(key), weights(key).astype(np.float64), j - i, BANDS * ROWS).reshape(j - i, BANDS, ROWS)
        own = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (j - i, 1))
        for k in range(ROWS):
            own = H.chain(own, got[:, :, k])
        out[i:j] = own
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in H.slices(batches):
        words = H.words_of(H.texts_of(batch.column("text")), H.WHITE, H.LOWER_CODES)
        n = np.diff(words.offsets)
        place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], n)
        spread = H.mix(words.hashes + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        same = [H.segment_sum(x, words.offsets, np.uint64) for x in (spread, H.mix(spread ^ np.uint64(0x2545F4914F6CDD1D)))]
        keys = band_keys(words)
        cuts = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("uid", "doc_id", "t1", "t2")), pa.array(n), *[pa.array(x.view(np.int64)) for x in same], pa.ListArray.from_arrays(cuts, pa.array(keys.ravel().view(np.int64)))],
            names=["uid", "doc_id", "t1", "t2", "n_words", "k1", "k2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in H.slices(batches):
        words = H.words_of(H.texts_of(batch.column("text")), H.WHITE, H.LOWER_CODES)
        owner, key = shingles(words)
        cuts = np.searchsorted(owner, np.arange(len(words.offsets))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(key.view(np.int64)))], names=["node", "s"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the batches, lists as arrays."""
    for batch in batches:
        columns = []
        for c in batch.columns:
            if pa.types.is_list(c.type):
                at, flat = c.offsets.to_numpy(), c.values.to_numpy()
                columns.append([flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
            else:
                columns.append(c.to_pylist())
        yield from zip(*columns, strict=True)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Weight of the elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int(weights(a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a]).sum())


def _against_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (head, part, node, s), each part's head first: every other node's likeness to its head."""
    own, at, out = None, None, ([], [], [], [])

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "head", "common", "sum"])

    for head, part, node, s in _rows(batches):
        if node == head:
            own, at = s.copy(), (head, part)
            continue
        assert at == (head, part), "a part starts with its head"
        for x, v in zip(out, (node, head, _common(own, s), int(weights(own).sum() + weights(s).sum())), strict=True):
            x.append(v)
        if len(out[0]) >= 10_000:
            yield batch()
            out = ([], [], [], [])
    yield batch()


def _dense_common(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Weight shared by every two of the sets, by products of matrices, some columns at a time."""
    n = len(sets)
    keys, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    shared = np.flatnonzero(times > 1)
    weight = weights(keys[shared]).astype(np.float32)
    place = np.full(len(keys), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column, out = row[order], column[order], np.zeros((n, n), np.float64)
    for at in range(0, len(shared), width):
        i, j = np.searchsorted(column, (at, at + width))
        x = np.zeros((n, min(width, len(shared) - at)), np.float32)
        x[row[i:j], column[i:j] - at] = 1
        out += (x * weight[at : at + width]) @ x.T
    return out


def links_within(group: list[int], distance: list[float], block: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (i, j) that join different groups into one, over all nodes of a bucket, or of two blocks of it."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            x = up
        return x

    size, d = np.array([weights(s).sum() for s in sets]), np.array(distance)
    ok = np.triu(np.minimum.outer(size, size) * LINK[1] >= np.maximum.outer(size, size) * LINK[0], 1) & (np.abs(d[:, None] - d[None, :]) <= FAR)
    names, g, b = *np.unique(np.array(group), return_inverse=True), np.array(block)
    ok &= g[:, None] != g[None, :]
    if b.min() != b.max():  # blocks are compared within themselves elsewhere
        ok &= b[:, None] != b[None, :]
    if len(sets) >= DENSE and ok.sum() > 4 * len(sets):
        common = _dense_common(sets)
        ok &= common * (LINK[0] + LINK[1]) >= (size[:, None] + size[None, :]) * LINK[0]
        alike = lambda i, j: True
    else:
        alike = lambda i, j: _common(sets[i], sets[j]) * (LINK[0] + LINK[1]) >= (size[i] + size[j]) * LINK[0]
    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
        a, c = root(int(g[i])), root(int(g[j]))
        if a != c and alike(i, j):
            parent[max(a, c)] = min(a, c)
            found.append((i, j))
    return found


def _within_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, b1, b2, node, group, d, block, s), sorted by the first three: links between groups."""
    held: list[tuple] = []
    at, u, v = None, [], []

    def settle():
        if len(held) > 1:
            nodes, group, d, block, sets = zip(*held, strict=True)
            for i, j in links_within(list(group), list(d), list(block), list(sets)):
                u.append(nodes[i])
                v.append(nodes[j])
        held.clear()

    for key, b1, b2, node, group, d, block, s in _rows(batches):
        if at != (key, b1, b2):
            settle()
            at = (key, b1, b2)
        held.append((node, group, d, block, s.copy()))
    settle()
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["a", "b"])


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, head, common, sum) of pairs (node, head). A head's members are dealt out in parts, and
    each part gets the head's set once."""
    parts = pairs.groupBy("head").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    heads = keep(parts.join(sets.select(F.col("node").alias("head"), "s"), "head"))
    members = pairs.join(parts, "head").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).join(sets, "node").select("head", "part", "node", "s")
    own = heads.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("head").alias("node"), "s")
    rows = members.unionByName(own).repartition("head", "part").sortWithinPartitions("head", "part", F.col("node") != F.col("head"))
    return rows.mapInArrow(_against_heads, "node long, head long, common long, sum long")


def _blocks(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different groups in the buckets of open_ (key, node, group, d)."""
    sized = open_.join(sets.select("node", F.size("s").alias("size")), "node")
    of = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("of"))
    dealt = open_.join(of, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("b1"), F.greatest("block", "with").alias("b2"), "node", "group", "d", "block")
    rows = dealt.join(sets, "node").select("key", "b1", "b2", "node", "group", "d", "block", "s")
    return rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(_within_blocks, "a long, b long")


def text_key() -> list:
    """Two columns that name a text by 128 bits of hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _node_links(texts: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, component) of all nodes linked with another one; nodes is (node, doc_id, t1, t2), shared
    (key, node, n) has the buckets of two nodes or more."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    heads = keep(shared.select("key", "node").join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("last"))).alias("h")).select("key", (-F.col("h.last")).alias("head")))
    placed = keep(shared.select("key", "node").join(heads, "key"))
    first = keep(placed.where("node <> head").select("node", "head").distinct())
    wanted = keep(nodes.join(shared.select("node").distinct(), "node", "left_semi"))
    same = [texts[c].eqNullSafe(wanted[c]) for c in ("doc_id", "t1", "t2")]
    n = wanted.count()
    chosen = texts.join(small(wanted, n), same[0] & same[1] & same[2]).select("node", "text")
    sets = keep(chosen.mapInArrow(_sets, "node long, s array<long>"))
    if sets.count() > n:  # rows equal in id and text
        sets = keep(sets.dropDuplicates(["node"]))
    tested = keep(_tested(first, sets))
    alike = (F.col("common") * (LINK[0] + LINK[1]) >= F.col("sum") * LINK[0])
    links = tested.where(alike).select(F.col("node").alias("a"), F.col("head").alias("b"))
    label = keep(components(links, "a", "b"))
    # Buckets that still hold several groups, and in them the nodes that the metric doesn't rule out.
    near = tested.select("node", "head", (1 - F.col("common") / (F.col("sum") - F.col("common"))).alias("d"))
    main = label.select(F.col("node").alias("head"), F.col("component").alias("main"))
    rows = (
        placed.join(near, ["node", "head"], "left").join(label.select("node", "component"), "node", "left").join(main, "head", "left")
        .select("key", "node", F.coalesce("component", "node").alias("group"), F.coalesce("main", "head").alias("main"), F.coalesce("d", F.lit(0.0)).alias("d"))
    )
    rows = keep(rows)
    stray = F.col("group") != F.col("main")
    mixed = rows.where(stray).groupBy("key").agg(F.min("d").alias("lo"), (F.min("group") < F.max("group")).alias("several"))
    open_ = rows.join(mixed, "key").where(stray | (F.col("d") >= F.col("lo") - FAR))
    left = open_.groupBy("key").agg((F.min("group") < F.max("group")).alias("open")).where("open").select("key")
    open_ = keep(open_.join(left, "key", "left_semi").select("key", "node", "group", "d"))
    more = keep(_blocks(open_, sets))
    if more.take(1):
        label = keep(components(links.union(more), "a", "b"))
    forget(heads, placed, first, wanted, sets, rows, open_)
    return label


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, component_id, n_same, kept): one row per document of docs (doc_id, text);
    n_same counts the rows with the same words, t1 and t2 name the text (text_key)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    signed = keep(texts.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_signed, "uid long, doc_id long, t1 long, t2 long, n_words long, k1 long, k2 long, bands array<long>"))
    classes = keep(signed.where("n_words > 0").groupBy("k1", "k2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("n_same")))
    nodes = signed.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi")
    slots = keep(nodes.select(F.col("uid").alias("node"), F.explode("bands").alias("key")))
    sizes = slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep(slots.join(sizes, "key"))  # slots of buckets with two nodes or more
    forget(slots)
    label = _node_links(texts, nodes.select(F.col("uid").alias("node"), "doc_id", "t1", "t2"), shared)
    placed = keep(classes.join(label, "node", "left").select("k1", "k2", "node", "least_id", "n_same", F.coalesce("component", "node").alias("group")))
    # Only groups of several nodes need their least id from other classes.
    wide = placed.join(label.select("node"), "node", "left_semi").groupBy("group").agg(F.min("least_id").alias("group_id"))
    known = placed.join(wide, "group", "left").select("k1", "k2", "n_same", "group", F.coalesce("group_id", "least_id").alias("component_id"))
    worded = F.col("n_words") > 0
    rows = keep(signed.drop("bands").join(known, ["k1", "k2"], "left").select(
        "uid", "doc_id", "t1", "t2", F.when(worded, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(worded, F.col("n_same")).otherwise(1).alias("n_same"), F.when(worded, F.col("group")).otherwise(F.col("uid")).alias("group"),
    ))
    forget(signed, classes, shared, placed)
    # The kept row: the least uid among a group's rows with its least id.
    first_row = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keepers = first_row.groupBy("group").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("kept"))
    return rows.join(keepers, "uid", "left").select("doc_id", "t1", "t2", "component_id", "n_same", F.coalesce("kept", F.lit(False)).alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("t1", "t2")
