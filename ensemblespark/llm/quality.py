"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

A text's inputs are its words (A-Z folded, hashed to BUCKETS columns, value log(1 + count)
scaled to unit length), statistics of its structure (shares of character classes, of
repeated words, word windows and lines, word and line lengths) and the metadata column
n_chars. The model is a constant, a weight per column and low-rank factors for every pair
of columns, scored in time linear in the inputs: half of the square of the sum less the
sum of the squares, for each factor. labels, lang, source and doc_id are not inputs.

Fitted by Adagrad on a bounded sample of labelled documents (folds 0 and 1), calibrated by
a logistic curve on others (fold 3).

Defined cases: a null or empty text has zero statistics and no words and gets the score of
that; a null n_chars counts as the text's own length; texts of any length are read whole;
repeated rows are scored each; columns besides doc_id, text and n_chars are ignored; if a
class has no labelled row, every score is the share of good labels (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .logistic import fit_logistic
from .sampling import labelled_sample
from .store import id_fold, keep, table

#: Labelled documents fitted or calibrated on, of each class.
SAMPLE_PER_CLASS = 4_000
BUCKETS = 1 << 15
FACTORS = 8
EPOCHS = 12
SCORES = "doc_id long, held_out boolean, score double, predicted int, raw double"


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


CLASSES = [
    np.array([chr(b).isupper() and b < 128 for b in range(256)]),
    np.array([chr(b).islower() and b < 128 for b in range(256)]),
    np.array([chr(b).isdigit() and b < 128 for b in range(256)]),
    np.arange(256) >= 128,
    H.WHITE,
    _class("\n"), _class(".,;:"), _class("!"), _class("?"), _class("#*$%&|<>"), _class("|"), _class("/@\\"),
]


def statistics(texts: H.Texts, words: H.Words, n_chars: np.ndarray) -> np.ndarray:
    """Structure statistics, one row per text; finite for every text."""
    size, n, owner = np.diff(texts.offsets), np.diff(words.offsets), words.owner()
    some, word = np.maximum(size, 1), np.maximum(n, 1)
    share = [texts.count(c) / some for c in CLASSES]
    length = words.ends - words.starts
    mean = H.segment_sum(length, words.offsets) / word
    spread = np.sqrt(np.maximum(H.segment_sum(length * length, words.offsets) / word - mean**2, 0))

    def repeats(key: np.ndarray, own: np.ndarray) -> np.ndarray:
        pair = H.chain(key, own.astype(np.uint64))
        order = np.argsort(pair)
        again = np.zeros(len(pair), bool)
        again[order[1:]] = pair[order[1:]] == pair[order[:-1]]
        return np.bincount(own, weights=again, minlength=len(n))

    same = np.zeros(len(owner), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    inside = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    windows = H.chain(H.chain(words.hashes[inside], words.hashes[inside + 1]), words.hashes[inside + 2])
    first = texts.data[words.starts]
    last = texts.data[words.ends - 1]
    upper = (first >= 65) & (first <= 90)
    shout = upper & (length > 1) & (texts.data[np.minimum(words.starts + 1, len(texts.data) - 1)] >= 65) & (texts.data[np.minimum(words.starts + 1, len(texts.data) - 1)] <= 90)
    per_word = lambda flag: np.bincount(owner, weights=flag, minlength=len(n)) / word
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
    odd = ~H.NOT_ALNUM[last] | np.isin(last, np.frombuffer(b".,;:!?", np.uint8))
    return np.column_stack([
        *share, np.log1p(size), np.log1p(n), np.log1p(np.maximum(n_chars, 0)), mean, spread,
        repeats(words.hashes, owner) / word, per_word(same), repeats(windows, owner[inside]) / word,
        per_word(upper), per_word(shout), per_word(stop), per_word(~odd), np.log1p(texts.count(CLASSES[5])),
        n / (1 + texts.count(CLASSES[5])) / (1 + word), (n == 0).astype(float),
    ])


@dataclass
class Inputs:
    """Sparse words (row, column, value, sorted by row) and dense statistics."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def inputs(column: pa.Array, n_chars: pa.Array) -> Inputs:
    texts = H.texts_of(column)
    words = H.words_of(texts, H.WHITE, H.LOWER_CODES)
    size = np.diff(texts.offsets)
    given = n_chars.to_numpy(zero_copy_only=False).astype(float)
    dense = statistics(texts, words, np.where(np.isnan(given), size, given))
    key, count = np.unique(words.owner() * BUCKETS + (words.hashes >> np.uint64(49)).astype(np.int64), return_counts=True)
    row, value = key // BUCKETS, np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(size)))
    return Inputs(row, key % BUCKETS, value / norm[row], dense)


@dataclass
class Machine:
    """Weights: constant, words w and factors v, statistics u and factors z (rows: columns)."""

    shift: np.ndarray
    scale: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    z: np.ndarray
    curve: np.ndarray

    def raw(self, x: Inputs, also: bool = False):
        d = np.clip((x.dense - self.shift) / self.scale, -6, 6)
        n = len(d)
        part = self.v[x.column] * x.value[:, None]
        total = np.column_stack([np.bincount(x.row, weights=part[:, f], minlength=n) for f in range(part.shape[1])]) + d @ self.z
        square = np.bincount(x.row, weights=(part**2).sum(1), minlength=n) + (d**2) @ (self.z**2).sum(1)
        y = self.bias + np.bincount(x.row, weights=self.w[x.column] * x.value, minlength=n) + d @ self.u + 0.5 * ((total**2).sum(1) - square)
        return (y, d, total) if also else y

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * raw, -30, 30)))


def fit(x: Inputs, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, shrink: float = 2e-3, batch: int = 64, seed: int = 11) -> Machine:
    """Adagrad on the weighted log-loss, over the bounded sample."""
    rng = np.random.default_rng(seed)
    k = x.dense.shape[1]
    scale = x.dense.std(0)
    m = Machine(x.dense.mean(0), np.where(scale > 1e-9, scale, 1.0), 0.0, np.zeros(BUCKETS), rng.normal(0, 0.01, (BUCKETS, FACTORS)), np.zeros(k), rng.normal(0, 0.01, (k, FACTORS)), np.array([0.0, 1.0]))
    past = {"w": np.full(BUCKETS, 1e-2), "v": np.full((BUCKETS, FACTORS), 1e-2), "u": np.full(k, 1e-2), "z": np.full((k, FACTORS), 1e-2)}
    ends = np.searchsorted(x.row, np.arange(len(y) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i : i + batch]
            take = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])
            own = Inputs(np.repeat(np.arange(len(rows)), ends[rows + 1] - ends[rows]), x.column[take], x.value[take], x.dense[rows])
            raw, d, total = m.raw(own, also=True)
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            m.bias -= rate * g.sum()
            cols, back = np.unique(own.column, return_inverse=True)
            gx = g[own.row] * own.value
            gw = np.bincount(back, weights=gx, minlength=len(cols)) + shrink * m.w[cols] / len(rows)
            pull = gx[:, None] * (total[own.row] - m.v[own.column] * own.value[:, None])
            gv = np.column_stack([np.bincount(back, weights=pull[:, f], minlength=len(cols)) for f in range(FACTORS)]) + shrink * m.v[cols] / len(rows)
            gu = d.T @ g + shrink * m.u
            gz = d.T @ (g[:, None] * total) - m.z * ((d**2).T @ g)[:, None] + shrink * m.z
            past["w"][cols] += gw**2
            past["v"][cols] += gv**2
            past["u"] += gu**2
            past["z"] += gz**2
            m.w[cols] -= rate * gw / np.sqrt(past["w"][cols])
            m.v[cols] -= rate * gv / np.sqrt(past["v"][cols])
            m.u -= rate * gu / np.sqrt(past["u"])
            m.z -= rate * gz / np.sqrt(past["z"])
    return m


def _inputs_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in H.slices(batches):
        x = inputs(batch.column("text"), batch.column("n_chars"))
        cuts = np.searchsorted(x.row, np.arange(len(x.dense) + 1)).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(kind)))
        wide = x.dense.shape[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("fold"), lists(x.column, np.int32), lists(x.value, np.float32), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x.dense) * wide + 1, wide, dtype=np.int32)), pa.array(x.dense.ravel()))],
            names=["label", "fold", "cols", "vals", "dense"],
        )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Fit and calibrate. What comes to the driver: inputs of at most 2 * per_class documents (one row
    of each sampled id), each of at most BUCKETS words."""
    sample, counts = labelled_sample(docs, labels, label, per_class, ["text", "n_chars"])
    prior = min(max(counts.get(1, 0) / sum(counts.values()), 1e-6), 1 - 1e-6) if counts else 0.5
    got = sample.select("label", "fold", "text", F.col("n_chars").cast("double").alias("n_chars")).mapInArrow(_inputs_rows, "label int, fold int, cols array<int>, vals array<float>, dense array<double>").toArrow().combine_chunks()
    y, fold = got.column("label").to_numpy().astype(float), got.column("fold").to_numpy()
    if not len(y) or not 0 < y.mean() < 1:
        return Machine(np.zeros(1), np.ones(1), 0.0, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)), np.zeros(1), np.zeros((1, FACTORS)), np.array([np.log(prior / (1 - prior)), 0.0]))

    def part(rows: np.ndarray) -> Inputs:
        own = got.take(pa.array(rows)).combine_chunks()
        flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in own.column(name).chunks])
        length = own.column("cols").combine_chunks().value_lengths().to_numpy()
        return Inputs(np.repeat(np.arange(len(rows)), length), flat("cols"), flat("vals").astype(float), flat("dense").reshape(len(rows), -1))

    def natural(of: np.ndarray) -> np.ndarray:
        """Weights that give the classes their share among all labels."""
        return np.where(of == 1, prior / max(of.mean(), 1e-9), (1 - prior) / max(1 - of.mean(), 1e-9))

    # The arrival order of rows may differ between runs; the fit must not.
    content = got.column("dense").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((content[:, -1], *content.T[::-1], y))
    seen, rest = order[fold[order] != 3], order[fold[order] == 3]
    if not len(seen) or not 0 < y[seen].mean() < 1:
        seen = rest = order
    m = fit(part(seen), y[seen], np.where(y[seen] == 1, 0.5 / y[seen].mean(), 0.5 / (1 - y[seen].mean())))
    if len(rest) and 0 < y[rest].mean() < 1:
        m.curve = fit_logistic(np.column_stack([np.ones(len(rest)), m.raw(part(rest))]), y[rest], natural(y[rest]))
    return m


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document, scored in one pass without a shuffle: SCORES, and the columns named in
    `also` as they are (the text itself goes to Python once, so don't name it there)."""
    from pyspark.sql.types import StructType

    shipped = docs.sparkSession.sparkContext.broadcast(machine)
    carried = [F.col(f"`{c}`") for c in also]
    kind = StructType([*StructType.fromDDL(SCORES), *docs.select(*carried).schema])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in H.slices(batches, "_text"):
            x = inputs(batch.column("_text"), batch.column("_chars"))
            raw = m.raw(x) if len(m.shift) == x.dense.shape[1] else np.zeros(len(x.dense))
            p = m.scores(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(raw), *batch.columns[4:]],
                names=kind.names,
            )

    own = docs.select(F.col("doc_id").cast("long").alias("_id"), (id_fold("doc_id", 4) == 2).alias("_held"), F.col("text").alias("_text"), F.col("n_chars").cast("double").alias("_chars"), *carried)
    return own.mapInArrow(scored, kind)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
