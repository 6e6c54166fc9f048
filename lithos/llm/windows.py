"""Fixed-length byte windows over batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = 32


def windows(texts: pa.Array, length: int, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, windows, window's row) of a column of texts, piece by piece.

    Every byte of every text is in exactly one window; a text's last window is
    filled with blanks and a null or empty text has one blank window. A piece is
    a run of whole texts of about ``most_bytes``.
    """
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends) * ~np.asarray(texts.is_null())
    count = np.maximum(1, -(-sizes // length))
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]) * length, most_bytes, "right")) + at)
        own = count[at:upto]
        out = np.full(int(own.sum()) * length, BLANK, np.uint8)
        first = np.concatenate([[0], np.cumsum(own)[:-1]]) * length
        for k in range(at, upto):
            out[first[k - at] : first[k - at] + sizes[k]] = data[ends[k] : ends[k] + sizes[k]]
        yield at, upto - at, out.reshape(-1, length), np.repeat(np.arange(upto - at), own)
        at = upto


def adam(params: dict[str, np.ndarray], rate: float, a: float = 0.9, b: float = 0.999):
    """A step function of Adam over named arrays, changed in place."""
    m, v, t = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2)), None, 0
    m, v = list(m)

    def step(grads: dict[str, np.ndarray]) -> None:
        nonlocal t
        t += 1
        for k, g in grads.items():
            m[k] += (1 - a) * (g - m[k])
            v[k] += (1 - b) * (g * g - v[k])
            params[k] -= rate * (m[k] / (1 - a**t)) / (np.sqrt(v[k] / (1 - b**t)) + 1e-8)

    return step
