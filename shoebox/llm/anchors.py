"""Anchors of a text: positions that equal stretches of bytes choose alike.

Every string of LENGTH bytes names one of its GRAM-byte grams, the one with the least hash
(of equal ones the last). Equal strings name the same place in themselves, so occurrences of
a repeated string meet at an equal anchor gram. The strings that name one anchor start at
consecutive places; together they cover the anchor's context.
"""

from __future__ import annotations

import numpy as np

from shoebox.llm.common import _BYTE_VALUE, _powers

LENGTH, GRAM = 200, 40
#: String starts that are looked at together; in a longer text an anchor may be named in two pieces.
PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Arrays first, last (starts of the strings that name the anchor), at (the gram), its hash, and a hash of the context."""
    parts = [_piece(data[k : k + PIECE + length - 1], k, length, gram) for k in range(0, max(1, len(data) - length + 1), PIECE)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _piece(data: np.ndarray, offset: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    if n < length:
        return (*(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(2)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _powers(n, True)[:n], out=sums[1:])
    back = _powers(n, False)
    grams = _mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    # the hash's high bits, then the place from the end, so the least is unique and the last of equals
    least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = (_LOW - (least[edge] & _LOW)).astype(np.int64)
    first, last = edge, np.concatenate([edge[1:], [len(least)]]) - 1
    context = (sums[last + length] - sums[first]) * back[first]
    context = _mixed(context + _mixed((at - first).astype(np.uint64) * np.uint64(1024) + (last - first).astype(np.uint64)))
    return first + offset, last + offset, at + offset, grams[at], context
