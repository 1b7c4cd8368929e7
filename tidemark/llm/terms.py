"""Terms of whole texts as bytes: runs of digits, ASCII letters (lower-cased) and everything beyond ASCII."""

from __future__ import annotations

import numpy as np

#: For bytes.translate: A-Z become a-z, what parts terms becomes a space. UTF-8 keeps every byte of a character beyond ASCII.
PARTED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PARTED = np.frombuffer(PARTED, np.uint8)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in their order; none for null."""
    return text.translate(PARTED).split() if text else []


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, starts and ends of their terms, and for each row the index of its first term (one more at the end).

    `data` holds the rows' texts one after another, row i from offsets[i] to offsets[i + 1]; a row's end parts terms too.
    """
    data = _PARTED[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    solid = data != 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]]))
    ends = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)
