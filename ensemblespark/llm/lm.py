"""Language-model scoring by a weighted backoff automaton over trigrams.

States are the last two tokens, the last one and the root. A state's arcs carry the smoothed
log-probabilities of the words seen after it, its failure arc what it leaves to the next
shorter state: with c counts of an n-gram in n occurrences of its context, an arc weighs
(c + mu * p) / (n + mu), where p is the next shorter state's probability, and the failure arc
mu / (n + mu) (Dirichlet smoothing, order by order). The root has discounted single words, and
what they leave goes to words never seen. A text is walked from left to right, carrying its state;
where a state has no arc for the next word the failure arc is followed until one has, and the
score is the sum of the weights on the way.

The arcs and failure arcs that a text meets follow from the counts of its n-grams. The automaton of the whole corpus is never in one place. Texts are cut
into slices of a bounded size, written once as codes of their distinct words. Each slice asks
for the counts of its own distinct n-grams; the questions, which hold the slice's own training
counts, are dealt out by hash of the n-gram, summed there, and answered; with the answers a
slice has the part of the automaton that its texts walk through. Every n-gram counts, whatever
its count or the corpus' size. All n-grams are spread by hash, and a slice asks once for each,
so no frequent word or pair gathers its occurrences in one task. The questions of an order are
asked in several goes, PHASES, which divides what lies on disk at a time.

Defined cases: a null text counts as empty; an empty text is one end token; ids may be null
(training rows then) or repeated (each row is scored); without training rows every token is
unseen with probability 1; columns besides doc_id and text are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .packing import pack, unpack
from .store import id_fold, keep, table

#: Weight of the next shorter state: after one word, and after two.
MU = (1_000.0, 10.0)
#: In how many goes words, pairs and trigrams are asked for.
PHASES = (1, 2, 4)
#: N-grams that a task counts at a time, about.
BUCKET = 1_500_000


def _ends(words: H.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with END after each text's words, and the new offsets."""
    out = np.insert(words.hashes, words.offsets[1:], H.END)
    return out, words.offsets + np.arange(len(words.offsets))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _ends(H.words_of(H.texts_of(column), H.WHITE, H.LOWER_CODES))


@dataclass
class Root:
    """Training tokens, distinct ones, and the discount of single words."""

    total: float
    kinds: float
    discount: float

    @classmethod
    def of(cls, counts: DataFrame) -> Root:
        all_ = counts.agg(F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
        total, kinds, ones, twos = (float(x or 0) for x in all_)
        return cls(total, kinds, min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5)

    def probability(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, c - self.discount, self.discount * self.kinds) / self.total


@dataclass
class Slice:
    """Texts as codes of distinct words; codes[at[i]:at[i + 1]] are the tokens of text i."""

    words: np.ndarray
    codes: np.ndarray
    at: np.ndarray

    def __post_init__(self):
        self.first = self.at[:-1]  # no text is without its end token
        self.middle = np.empty_like(self.codes)  # the token before; before a text stands the end token
        self.middle[1:] = self.codes[:-1]
        self.middle[self.first] = np.searchsorted(self.words, H.END)
        self.whole = np.ones(len(self.codes), bool)  # places that end a trigram
        self.whole[self.first] = False
        self._hashes: list[np.ndarray] = []

    def hashes(self, order: int) -> np.ndarray:
        """The n-gram that ends at each place."""
        if not self._hashes:
            last = self.words[self.codes]
            pair = H.chain(self.words[self.middle], last)
            before = np.zeros_like(pair)
            before[1:] = pair[:-1]
            self._hashes = [last, pair, H.chain(before, last)]
        return self._hashes[order - 1]

    def asked(self, order: int, phase: int, phases: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams of a phase, the places they end at, and which of them does there."""
        h = self.hashes(order)
        mine = (h >> np.uint64(9)) % np.uint64(phases) == phase
        places = np.flatnonzero(mine & self.whole if order == 3 else mine)
        keys, which = np.unique(h[places], return_inverse=True)
        return keys, places, which

    def questions(self, order: int, phase: int, phases: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams and how often they occur in the slice's training texts (seen: by place)."""
        keys, places, which = self.asked(order, phase, phases)
        return keys, np.bincount(which, weights=seen[places], minlength=len(keys)).astype(np.int64)

    def walk(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, root: Root, mu: tuple[float, float] = MU) -> np.ndarray:
        """Each text's log10 probability, given the training counts of the n-grams that end at each place."""
        machine = Automaton.of(self, c1, c2, c3, root, mu)
        self._hashes.clear()
        return machine.traverse(self)


#: Tokens of a lane: a longer text is walked in lanes side by side, each of which reads the two tokens before it first.
LANE = 256


@dataclass
class Automaton:
    """The part of the corpus' automaton that a slice's texts walk through.

    State 0 is the root, 1 + w the state after word w, and the states from 1 + words on stand for the slice's pairs of
    words that training has. An arc (key: state * words + word) has a weight and the state it leads to, the
    longest that stands for the last words; a state without an arc for a word has its failure arc, with its
    weight, to the state of one word less. All weights are log10 probabilities."""

    words: int
    start: int  # the state before a text
    keys: np.ndarray
    weights: np.ndarray
    to: np.ndarray
    fail_to: np.ndarray
    fail_weight: np.ndarray

    @classmethod
    def of(cls, own: Slice, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, root: Root, mu: tuple[float, float]) -> Automaton:
        v, codes = len(own.words), own.codes.astype(np.int64)
        n_word = np.zeros(v)
        n_word[codes] = c1
        single = root.probability(n_word)
        # Pairs that training has: arcs of their first word, and states.
        pair_key = own.middle.astype(np.int64) * v + codes
        pairs, place = np.unique(pair_key[c2 > 0], return_index=True)
        n_pair = c2[c2 > 0][place]
        left, last = pairs // v, pairs % v
        p_pair = (n_pair + mu[0] * single[last]) / (n_word[left] + mu[0])
        state_of_pair = 1 + v + np.arange(len(pairs))
        # Trigrams that training has: arcs of their first two words' state, which training has then too.
        at = np.flatnonzero(own.whole & (c3 > 0))
        context = np.searchsorted(pairs, pair_key[at - 1])
        tri, place = np.unique(context * v + codes[at], return_index=True)
        n_tri, context, word = c3[at][place], tri // v, tri % v
        inner = np.searchsorted(pairs, (pairs[context] % v) * v + word)  # the trigram's last two words
        p_tri = (n_tri + mu[1] * p_pair[inner]) / (n_pair[context] + mu[1])
        every = np.arange(v)
        return cls(
            v, 1 + int(np.searchsorted(own.words, H.END)), np.concatenate([every, (1 + left) * v + last, (1 + v + context) * v + word]), np.log10(np.concatenate([single, p_pair, p_tri])),
            np.concatenate([1 + every, state_of_pair, state_of_pair[inner]]), np.concatenate([np.zeros(1 + v, np.int64), 1 + last]), np.log10(np.concatenate([[1.0], mu[0] / (n_word + mu[0]), mu[1] / (n_pair + mu[1])])),
        )

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one word each, and the weights on the way: failure arcs until there is an arc, then that arc."""
        weight, state, after, open_ = np.zeros(len(states)), states.copy(), np.empty_like(states), np.arange(len(states))
        while len(open_):
            key = state[open_] * self.words + words[open_]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            has = self.keys[found] == key
            hit, miss = open_[has], open_[~has]
            weight[hit] += self.weights[found[has]]
            after[hit] = self.to[found[has]]
            weight[miss] += self.fail_weight[state[miss]]
            state[miss] = self.fail_to[state[miss]]
            open_ = miss
        return after, weight

    def traverse(self, own: Slice) -> np.ndarray:
        """The weights along each text, from left to right; all texts, or lanes of them, move on a word at a time."""
        size = np.diff(own.at)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        begin = own.at[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        end = np.minimum(begin + LANE, own.at[1:][text])
        codes, state = own.codes.astype(np.int64), np.full(len(text), self.start)
        later = np.flatnonzero(begin > own.at[:-1][text])
        state[later] = 0
        for back in (2, 1):  # the last two words are all that a state knows
            state[later], _ = self.step(state[later], codes[begin[later] - back])
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still going are the first ones
        begin, text, state, left = begin[order], text[order], state[order], (end - begin)[order]
        total = np.zeros(len(text))
        for k in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -k, "left"))
            state[:n], weight = self.step(state[:n], codes[begin[:n] + k])
            total[:n] += weight
        return np.bincount(text, weights=total, minlength=len(size))


SLICES = "slice long, d binary, x binary, at binary, ids array<long>, held array<boolean>"
def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _slicing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = itertools.count(TaskContext.get().partitionId() << 32)
    for batch in H.slices(batches):
        if len(batch):
            tokens, at = _tokens(batch.column("text"))
            words, codes = np.unique(tokens, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(number)]), pa.array([words.tobytes()]), pa.array([pack(codes.astype(np.int32))]), pa.array([pack(at)]), *(_list(batch.column(c)) for c in ("doc_id", "held_out"))],
                names=[x.split()[0] for x in SLICES.split(", ")],
            )


def _opened(d: bytes, x: bytes, at: bytes) -> Slice:
    return Slice(np.frombuffer(d, np.uint64), unpack(x, np.int32), unpack(at, np.int64))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, Slice, np.ndarray]]:
    """Each slice of a batch: its number, itself, and by place whether the text is one of training."""
    for i in range(len(batch)):
        get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
        own = _opened(get("d"), get("x"), get("at"))
        held = batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
        yield get("slice"), own, np.repeat(~held, np.diff(own.at))


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys by bucket, and the buckets' bounds in it."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def word_counts(slices: DataFrame) -> DataFrame:
    """(h, c): how often every word, and the end token, occurs in training texts; words of other texts have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own, seen in _rows(batch):
                keys, c = own.questions(1, 0, 1, seen)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c)], names=["h", "c"])

    return slices.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


ASKED = "g long, slice long, h array<long>, c array<long>"
COUNTED = "slice long, g long, c array<long>"


def _asking(order: int, phase: int, phases: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for me, own, seen in _rows(batch):
                keys, c = own.questions(order, phase, phases, seen)
                by, cut = _split(keys, buckets)
                g = np.flatnonzero(np.diff(cut))
                ends = pa.array(np.append(cut[g], cut[-1:] if len(g) else [0]).astype(np.int32))
                lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), me)), lists(keys[by].view(np.int64)), lists(c[by])], names=["g", "slice", "h", "c"])

    return ask


def _arrays(column: pa.Array) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket: every n-gram's count over all slices, to each slice that asked."""
    held: list[tuple] = []
    at = None

    def settle():
        if held:
            keys, back = np.unique(np.concatenate([h for _, h, _ in held]), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([c for _, _, c in held]), minlength=len(keys))[back].astype(np.int64)
            ends = np.cumsum([0, *(len(h) for _, h, _ in held)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([me for me, _, _ in held]), pa.array(np.full(len(held), at)), pa.ListArray.from_arrays(pa.array(ends), pa.array(total))], names=["slice", "g", "c"])
        held.clear()

    for batch in batches:
        for g, me, h, c in zip(batch.column("g").to_pylist(), batch.column("slice").to_pylist(), _arrays(batch.column("h")), _arrays(batch.column("c")), strict=True):
            if g != at:
                yield from settle()
                at = g
            held.append((me, h.copy(), c.copy()))
    yield from settle()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by slice and bucket: a slice's answers in one packed row."""
    at, held = None, []
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pack(np.concatenate(held))])], names=["slice", "c"])
    for batch in batches:
        for me, c in zip(batch.column("slice").to_pylist(), _arrays(batch.column("c")), strict=True):
            if me != at:
                if held:
                    yield row()
                at, held = me, []
            held.append(c.copy())
    if held:
        yield row()


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _walking(phases: tuple[int, ...], buckets: int, root: Root, mu: tuple[float, float]):
    names = [x.split()[0] for x in SCORES.split(", ")]

    def settle(row: dict, answers: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
        own = _opened(row["d"], row["x"], row["at"])
        counts = []
        for order, n in enumerate(phases, 1):
            here = np.zeros(len(own.codes))
            for phase in range(n):
                keys, places, which = own.asked(order, phase, n)
                if len(keys):
                    c = np.empty(len(keys), np.int64)
                    c[_split(keys, buckets)[0]] = unpack(answers[order, phase], np.int64)
                    here[places] = c[which]
            counts.append(here)
        base = np.log10((counts[0] + 1) / (root.total + root.kinds + 1))
        sums = [*(H.segment_sum(x, own.at, kind) for x, kind in (((counts[0] > 0).view(np.uint8), np.int64), (base, np.float64))), own.walk(*counts, root, mu)]
        return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["held"]), pa.array(np.diff(own.at)), *map(pa.array, sums)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, answers = None, {}
        for batch in batches:
            for i in range(len(batch)):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                if get("o") == 0:  # a slice's texts come before the answers
                    if row is not None:
                        yield settle(row, answers)
                    row, answers = {c: get(c) for c in ("d", "x", "at", "ids", "held")}, {}
                else:
                    answers[get("o"), get("k")] = get("c")
        if row is not None:
            yield settle(row, answers)

    return walk


def score(docs: DataFrame, phases: tuple[int, ...] = PHASES, mu: tuple[float, float] = MU) -> DataFrame:
    """docs (doc_id, held_out, text) scored, learning from those not held out; see the module's description."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out").cast("boolean").alias("held_out"), "text")
    slices = keep(own.mapInArrow(_slicing, SLICES))
    root = Root.of(word_counts(slices).where("c > 0"))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(root.total // BUCKET) + 1)
    parts = slices.select("slice", F.lit(0).alias("o"), F.lit(0).alias("k"), "d", "x", "at", "ids", "held", F.lit(None).cast("binary").alias("c"))
    for order, n in enumerate(phases, 1):
        for phase in range(n):
            asked = slices.select("slice", "d", "x", "at", "held").mapInArrow(_asking(order, phase, n, buckets), ASKED)
            answered = asked.repartition("g").sortWithinPartitions("g").mapInArrow(_answer, COUNTED)
            counts = keep(answered.repartition("slice").sortWithinPartitions("slice", "g").mapInArrow(_gathered, "slice long, c binary"))
            parts = parts.unionByName(counts.select("slice", F.lit(order).alias("o"), F.lit(phase).alias("k"), "c"), allowMissingColumns=True)
    out = keep(parts.repartition("slice").sortWithinPartitions("slice", "o", "k").mapInArrow(_walking(phases, buckets, root, mu), SCORES))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(root.total)).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_fold("doc_id", 7) == 2))
