"""Vectorised word hashing shared by the Python-side operators of this subpackage.

Works on the raw UTF-8 buffer of an Arrow string column, so that no Python object
is made for a word. A word is a maximal run of bytes that are not separators; its
hash is a 64-bit polynomial hash over a table of random odd-spread byte codes with
a final avalanche. Two different words share a hash with a chance of about 2**-64;
the operators treat equal hashes as equal words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
#: Bytes of words hashed at a time; bounds the temporary arrays whatever a text's length.
SEGMENT = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

LOWER_CODES = _CODES.copy()
LOWER_CODES[65:91] = _CODES[97:123]

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of pairs of hashes."""
    return mix(left * np.uint64(0x9DDFEA08EB382D69) + (right ^ np.uint64(0xC2B2AE3D27D4EB4F)))


#: Hashes that stand for no word.
END = np.uint64(0x5BD1E995C0FFEE01)


@dataclass
class Texts:
    """A batch of texts as bytes; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def count(self, byte_class: np.ndarray) -> np.ndarray:
        """Bytes of a class (a boolean table over 256) in each text."""
        return segment_sum(byte_class[self.data].view(np.uint8), self.offsets)


def texts_of(column: pa.Array) -> Texts:
    """The bytes of an Arrow string array; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def segment_sum(values: np.ndarray, offsets: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i, empty ranges giving 0."""
    out = np.zeros(len(offsets) - 1, dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=dtype)
    return out


@dataclass
class Words:
    """Words of a batch: starts and ends in bytes, hashes, and offsets[i]:offsets[i + 1] of text i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words_of(texts: Texts, separators: np.ndarray = WHITE, codes: np.ndarray = LOWER_CODES) -> Words:
    """All words of the texts. codes=LOWER_CODES folds A-Z to a-z."""
    data, offsets = texts.data, texts.offsets
    inside = ~separators[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = _powers(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[data[lo:hi]] * up[: hi - lo], dtype=np.uint64, out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        hashes[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


class Table:
    """A sorted key -> row lookup on uint64 hashes."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each wanted key in the array given to the constructor, -1 if absent."""
        if not len(self.keys) or not len(wanted):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], -1)


#: Bytes of text worked on at a time; bounds a task's temporary arrays (a longer text is taken alone).
SLICE = 4 << 20


def slices(batches, column: str = "text"):
    """Arrow batches cut so that each holds about SLICE bytes of text."""
    for batch in batches:
        texts = batch.column(column)
        if texts.nbytes <= SLICE:
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to
