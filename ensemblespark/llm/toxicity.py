"""Toxicity by two class-conditional Kneser-Ney models of pairs of words and their spelling.

A toxic and an ordinary model are counted from labelled documents. A word's probability after
the one before it is the discounted count of the pair in the class; what the discounts leave
goes to the pair's discounted count in both classes together, and what those leave to the
word's own probability. That is its spelling's, by Kneser-Ney models of the bytes within words,
which interpolate discounted counts of ever shorter byte n-grams; the shortest two orders are
again counted over both classes. So an expression that one class has often seen gets its own
probability there, and one that is rare gets nearly the same from both.

A text's log-likelihood under a class is the sum over its words. What is compared is
normalised by length: the difference a word over the whole text, and over the WINDOW
consecutive words where it is largest; both of the pairs' models and of the words' own. They
enter a logistic calibration fitted on labelled documents that the counts did not see.

Words are runs of letters and digits (any non-ASCII character counts as a letter), A-Z folded.
Nothing but the text is an input of the score. Byte n-grams are packed into 64-bit integers,
exactly; words are known by 64-bit hashes. All n-grams of the sample count, so the models are
bounded by the sample.

Defined cases: a null or empty text has no word, a difference of 0, and gets the calibrated
score of that; texts of any length are scored whole; repeated rows are scored each; columns
besides doc_id and text are ignored whatever their names; if a class has no labelled row,
every score is the share of toxic labels (0.5 without any label); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .logistic import fit_logistic
from .sampling import labelled_sample
from .store import id_fold, keep, table

#: Labelled documents counted or calibrated on, of each class.
SAMPLE_PER_CLASS = 3_000
ORDER = 6
#: Orders up to this one are counted over both classes together.
SHARED_ORDER = 2
DISCOUNT = 0.75
#: Discount of pairs: what was seen once is hardly evidence of an expression.
PAIR_DISCOUNT = 0.95
#: Consecutive words over which a passage's difference is taken.
WINDOW = 2
SCORES = "doc_id long, held_out boolean, score double, predicted int, n_words long, mean_difference double, passage_difference double"
EDGE = 0x20


@dataclass
class Spelling:
    """Distinct words of a batch written one after the other, each with an edge byte on either side."""

    packed: list[np.ndarray]  # for each order k: the k bytes that end at each position
    fits: list[np.ndarray]  # whether they lie in one word
    scored: np.ndarray  # positions that are predicted: all but the first edge of each word
    word: np.ndarray  # for each position


def distinct(words: H.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position of each distinct word, index of each word's distinct one, and counts."""
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    return first, inverse, np.bincount(inverse, minlength=len(first))


def spell(texts: H.Texts, starts: np.ndarray, ends: np.ndarray, order: int) -> Spelling:
    length = ends - starts
    at = np.concatenate([[0], np.cumsum(length + 2)])
    word = np.repeat(np.arange(len(starts)), length + 2)
    place = np.arange(at[-1]) - at[:-1][word]
    inner = (place > 0) & (place <= length[word])
    out = np.full(at[-1], EDGE, np.uint64)
    raw = texts.data[(starts[word] + place - 1)[inner]]
    out[inner] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    packed, fits = [out], [np.ones(len(out), bool)]
    for k in range(2, order + 1):
        longer = packed[-1].copy()
        longer[k - 1 :] |= out[: len(out) - k + 1] << np.uint64(8 * (k - 1))
        packed.append(longer)
        fits.append(place >= k - 1)
    return Spelling(packed, fits, place > 0, word)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, gram, n0, n1): how often each n-gram ends at a predicted position, by class."""
    for batch in H.slices(batches):
        texts = H.texts_of(batch.column("text"))
        words = H.words_of(texts, H.NOT_ALNUM, H.LOWER_CODES)
        if not len(words.hashes):
            continue
        first, inverse, _ = distinct(words)
        label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), np.diff(words.offsets))
        times = [np.bincount(inverse, weights=label == c, minlength=len(first)) for c in (0, 1)]
        s = spell(texts, words.starts[first], words.ends[first], ORDER)
        for k in range(1, ORDER + 1):
            use = s.scored & s.fits[k - 1]
            gram, back = np.unique(s.packed[k - 1][use], return_inverse=True)
            n = [np.bincount(back, weights=t[s.word[use]], minlength=len(gram)).astype(np.int64) for t in times]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["k", "gram", "n0", "n1"])


def _before(words: H.Words) -> np.ndarray:
    """The hash of the word before each word; END's before the first of a text."""
    out = np.empty_like(words.hashes)
    out[1:] = words.hashes[:-1]
    out[words.offsets[:-1][words.offsets[1:] > words.offsets[:-1]]] = H.END
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, first, n0, n1): how often each pair of words occurs, by class, and the hash of its first word."""
    for batch in H.slices(batches):
        words = H.words_of(H.texts_of(batch.column("text")), H.NOT_ALNUM, H.LOWER_CODES)
        before = _before(words)
        label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), np.diff(words.offsets))
        pair, at, back = np.unique(H.chain(before, words.hashes), return_index=True, return_inverse=True)
        n = [np.bincount(back, weights=label == c, minlength=len(pair)).astype(np.int64) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(before[at].view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["pair", "first", "n0", "n1"])


class Pairs:
    """Discounted probabilities of pairs of words in each class (rows 0 and 1) and in both together (row 2),
    and what they leave of a first word."""

    def __init__(self, pairs: np.ndarray, first: np.ndarray, counts: np.ndarray):
        counts = np.vstack([counts, counts.sum(0)])
        heads, of = np.unique(first, return_inverse=True)
        n = np.stack([np.bincount(of, weights=c, minlength=len(heads)) for c in counts])
        kinds = np.stack([np.bincount(of, weights=c > 0, minlength=len(heads)) for c in counts])
        self.pairs, self.heads = H.Table(pairs), H.Table(heads)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(n > 0, PAIR_DISCOUNT * kinds / n, 1.0)
            seen = np.where(n[:, of] > 0, np.maximum(counts - PAIR_DISCOUNT, 0) / n[:, of], 0.0)
            # A last column for what isn't there: no probability of its own, all of it left to the next shorter order.
            self.seen, self.rest = np.log(np.hstack([seen, np.zeros((3, 1))])).astype(np.float32), np.log(np.hstack([rest, np.ones((3, 1))])).astype(np.float32)

    def log(self, words: H.Words, inverse: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(2, words): log-probability of each word after the one before it in either class, given those of the
        distinct words themselves, own (2, distinct)."""
        at = self.pairs.find(H.chain(_before(words), words.hashes))
        head = np.append(self.heads.find(words.hashes[first]), self.heads.find(np.array([H.END])))
        before = np.empty_like(inverse)
        before[1:] = inverse[:-1]
        before[words.offsets[:-1][words.offsets[1:] > words.offsets[:-1]]] = len(first)
        rest = self.rest[:, head[before]]
        both = np.logaddexp(self.seen[2, at], rest[2] + own[:, inverse])
        return np.logaddexp(self.seen[:2, at], rest[:2] + both)


@dataclass
class KneserNey:
    """grams[k - 1]: sorted n-grams of order k; counts[k - 1]: their counts as (2, n), row 1 for
    the toxic class. prior: share of toxic labels."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    prior: float
    pairs: Pairs | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def __post_init__(self):
        p = min(max(self.prior, 1e-6), 1 - 1e-6)
        self.weights = np.array([np.log(p / (1 - p)), 0.0, 0.0, 0.0, 0.0])
        self.tables = [H.Table(g) for g in self.grams]
        order = len(self.grams)
        kept: list[np.ndarray] = []
        for k in range(1, order + 1):
            c = self.counts[k - 1]
            if k < order:  # continuation counts, but raw ones for n-grams that start a word
                longer = self.grams[k]
                own = self.tables[k - 1].find(longer & np.uint64((1 << 8 * k) - 1))
                more = np.stack([np.bincount(own[own >= 0], weights=(self.counts[k][i] > 0)[own >= 0], minlength=len(c[0])) for i in (0, 1)])
                c = np.where((self.grams[k - 1] >> np.uint64(8 * (k - 1))) == EDGE, c, more) if k > 1 else more
            kept.append(np.broadcast_to(c.sum(0), c.shape) if k <= SHARED_ORDER else c)
        self.seen, self.rest = [], [np.zeros((2, 1))]
        base = kept[0] if order else np.zeros((2, 0))
        total = np.maximum(base.sum(1, keepdims=True), 1)
        left = 1 - (np.maximum(base - DISCOUNT, 0) / total).sum(1, keepdims=True)
        self.seen.append(np.hstack([np.maximum(base - DISCOUNT, 0) / total + left / 256, left / 256]))
        for k in range(2, order + 1):
            c, context = kept[k - 1], self.tables[k - 2].find(self.grams[k - 1] >> np.uint64(8))
            found, size = context >= 0, len(self.grams[k - 2])
            n = np.stack([np.bincount(context[found], weights=c[i][found], minlength=size) for i in (0, 1)])
            kinds = np.stack([np.bincount(context[found], weights=(c[i] > 0)[found], minlength=size) for i in (0, 1)])
            with np.errstate(divide="ignore", invalid="ignore"):
                self.rest.append(np.hstack([np.where(n > 0, DISCOUNT * kinds / n, 1.0), np.ones((2, 1))]).astype(np.float32))
                total = np.append(n, np.zeros((2, 1)), axis=1)[:, context]
                seen = np.where(total > 0, np.maximum(c - DISCOUNT, 0) / total, 0.0)
            self.seen.append(np.hstack([seen, np.zeros((2, 1))]).astype(np.float32))
        self.counts = []

    def words(self, s: Spelling, n: int) -> np.ndarray:
        """(2, n): log-probability of each of n spelt words in either class."""
        row = self.tables[0].find(s.packed[0])
        p = [self.seen[0][c][row] for c in (0, 1)]
        for k in range(2, len(self.grams) + 1):
            context = np.full(len(row), -1)
            context[1:] = row[:-1]
            context[~s.fits[k - 1]] = -1
            # The context's row counts only if the n-gram fits; unseen contexts pass the shorter order on.
            row = np.full(len(row), -1)
            ask = np.flatnonzero(context >= 0)
            row[ask] = self.tables[k - 1].find(s.packed[k - 1][ask])
            for c in (0, 1):
                p[c] = self.seen[k - 1][c][row] + self.rest[k - 1][c][context] * p[c]
        return np.stack([np.bincount(s.word, weights=np.where(s.scored, np.log(x), 0.0), minlength=n) for x in p])

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(1, difference per word, largest difference per word of a passage; the same two by the words' own
        probabilities) of each text, and its words."""
        texts = H.texts_of(column)
        words = H.words_of(texts, H.NOT_ALNUM, H.LOWER_CODES)
        n = np.diff(words.offsets)
        out = np.zeros((len(texts), 5))
        out[:, 0] = 1
        if len(words.hashes) and self.grams:
            first, inverse, _ = distinct(words)
            own = np.hstack([
                self.words(spell(texts, words.starts[part], words.ends[part], len(self.grams)), len(part))
                for part in np.array_split(first, 1 + len(first) // 50_000)
            ])
            end = np.minimum(np.arange(len(inverse)) + WINDOW, words.offsets[1:][words.owner()])
            some = n > 0
            for k, log in enumerate((self.pairs.log(words, inverse, first, own) if self.pairs else own[:, inverse], own[:, inverse])):
                sums = np.concatenate([[0.0], np.cumsum(log[1] - log[0])])
                out[some, 1 + 2 * k] = ((sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / np.maximum(n, 1))[some]
                out[some, 2 + 2 * k] = np.maximum.reduceat((sums[end] - sums[:-1]) / WINDOW, words.offsets[:-1][some])
        return out, n

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> KneserNey:
    """Count both models on folds 0 and 1 of the labelled sample, calibrate on fold 3.

    What comes to the driver is counts of the sample's n-grams and pairs, bounded by per_class.
    """
    sample, counts = labelled_sample(docs, labels, label, per_class, ["text"])
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return KneserNey([], [], prior)
    sample = keep(sample.select("label", "fold", "text"))
    seen = sample.where("fold <> 3").select("label", "text")
    fetch = lambda df, *by: df.groupBy(*by).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    grams = fetch(seen.mapInArrow(_grams, "k int, gram long, n0 long, n1 long"), "k", "gram").sort_by([("k", "ascending"), ("gram", "ascending")])
    pairs = fetch(seen.mapInArrow(_pairs, "pair long, first long, n0 long, n1 long"), "pair", "first").sort_by("pair")
    both = lambda t, at=slice(None): np.stack([t.column(f"n{c}").to_numpy().astype(float)[at] for c in (0, 1)])
    order, levels, tallies = grams.column("k").to_numpy(), [], []
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(order == k)
        gram = grams.column("gram").to_numpy()[at].view(np.uint64)
        place = np.argsort(gram)
        levels.append(gram[place])
        tallies.append(both(grams, at)[:, place])
    if not len(levels[0]):
        return KneserNey([], [], prior)
    hashes = lambda name: pairs.column(name).to_numpy().view(np.uint64)
    model = KneserNey(levels, tallies, prior, Pairs(hashes("pair"), hashes("first"), both(pairs)))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            x, _ = shipped.value.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *map(pa.array, x[:, 1:].T)], names=["label", *"abcd"])

    rest = sample.where("fold = 3").select("label", "text").mapInArrow(held, "label int, a double, b double, c double, d double").toArrow()
    y = rest.column("label").to_numpy().astype(float)
    if len(y) and 0 < y.mean() < 1:
        share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        model.weights = fit_logistic(np.column_stack([np.ones(len(y)), *[rest.column(c).to_numpy() for c in "abcd"]]), y, share)
    shipped.unpersist()
    return model


def score(docs: DataFrame, model: KneserNey, threshold: float = 0.3) -> DataFrame:
    """One row per document, scored in one pass without a shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            x, n = shipped.value.features(batch.column("text"))
            p = shipped.value.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(n), pa.array(x[:, 1]), pa.array(x[:, 2])],
                names=["doc_id", "held_out", "score", "predicted", "n_words", "mean_difference", "passage_difference"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_fold("doc_id", 4) == 2).alias("held_out")).mapInArrow(scored, SCORES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
