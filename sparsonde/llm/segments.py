"""Texts cut where a tokenizer cuts anyway, so that each distinct piece of text is tokenized once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textblock import span_hashes

#: Bytes of distinct segments held by a worker, with OVERHEAD for each; beyond that it starts afresh, which costs time only.
HELD, OVERHEAD = 1 << 26, 150


def space_cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte offsets at which segments begin: at each space and each text."""
    cut = data == 0x20
    cut[ends[:-1][ends[:-1] < ends[1:]]] = True
    return np.flatnonzero(cut)


class Memo:
    """Values of segments by their bytes; ``make`` gets a list of new segments and returns their values."""

    def __init__(self, make: Callable[[list[bytes]], list]) -> None:
        self.make, self.held, self.size = make, {}, 0

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, np.ndarray]:
        """The values of the distinct segments, and for each segment the index of its value."""
        _, at, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        held = self.held
        values = [held.get(k) for k in keys]
        new = [i for i, v in enumerate(values) if v is None]
        if new:
            for i, v in zip(new, self.make([keys[i] for i in new]), strict=True):
                values[i] = v
                more = len(keys[i]) + OVERHEAD
                if self.size + more > HELD:
                    held.clear()
                    self.size = 0
                if more <= HELD:
                    held[keys[i]] = v
                    self.size += more
        return values, back
