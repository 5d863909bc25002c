"""Arrays as bytes of a column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd")


def pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), kind)
