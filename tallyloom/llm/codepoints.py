"""Code points of text columns as arrays, with tables of their kinds."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

_ALL = 0x110000


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of concatenated UTF-8 rows and the rows' offsets among them."""
    if not len(data):
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, before[offsets]


@functools.cache
def categories() -> np.ndarray:
    """The general category's first letter of every code point."""
    return np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(_ALL)).encode(), np.uint8)


@functools.cache
def lower_letters() -> np.ndarray:
    """Every letter in lower case where that is one code point, every other code point as a space."""
    table = np.full(_ALL, 32, np.uint32)
    letters = np.flatnonzero(categories() == ord("L"))
    table[letters] = letters
    for i in letters.tolist():
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table
