"""Simple-8b: a selector in the top 4 bits of a 64-bit word says how many ids share its 60 bits.

Blocks of BLOCK ids start on a word of their own; the offsets of their first words come before the
words, so all words decode in one vectorised pass and any block decodes alone. A value of 2^60 or
more is an escape: its word holds an index into a list of whole 64-bit values after the words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
MAGIC = 0x3842_534A
#: Ids in a word and bits of each, by selector; 15 is the escape.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.uint64)
ESCAPE = 15
_MASKS = (np.uint64(1) << BITS) - np.uint64(1)
_LIMITS = (np.uint64(1) << BITS[:ESCAPE]).astype(np.uint64)


def _window_max(classes: np.ndarray, count: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Largest class of each run of `count` positions; runs end with their block."""
    if count not in known:
        half = max(c for c in known if c < count)
        while half * 2 < count:
            half = min(half * 2, count)
            _window_max(classes, half, known)
        rest = known[half]
        out = rest.copy()
        shift = count - half
        np.maximum(out[:, :-shift], rest[:, shift:], out=out[:, :-shift])
        known[count] = out
    return known[count]


def encode(ids: np.ndarray) -> bytes:
    """The coded form of unsigned ids: header, block offsets, words, escaped values."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    most = int(ids.max(initial=0))
    small = padded.astype(np.uint32) if most < 1 << 32 else padded
    classes = np.zeros(blocks * BLOCK, np.uint8)
    for limit in (int(x) for x in _LIMITS):
        if limit <= most:
            classes += small >= small.dtype.type(limit)
    classes = classes.reshape(blocks, BLOCK)
    known = {1: classes}
    saved = np.zeros(classes.shape, np.uint8)  # ESCAPE less the smallest selector that fits
    for selector in range(ESCAPE):
        fits = _window_max(classes, int(COUNTS[selector]), known) <= selector
        np.maximum(saved, fits.view(np.uint8) * np.uint8(ESCAPE - selector), out=saved)
    choice = (ESCAPE - saved).reshape(-1)
    begins = np.zeros(blocks * BLOCK + 1, bool)
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        begins[at] = True
        at = at + COUNTS[choice[at]]
        going = at < ends
        at, ends = at[going], ends[going]
    first = np.flatnonzero(begins)
    selectors = choice[first].astype(np.int64)
    counts = np.minimum(COUNTS[selectors], np.minimum((first // BLOCK + 1) * BLOCK, n) - first)
    words = selectors.astype(np.uint64) << np.uint64(60)
    escaped = np.flatnonzero(selectors == ESCAPE)
    values = padded[first[escaped]]
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    rows = np.flatnonzero((selectors != ESCAPE) & (selectors != 0))
    k = 0
    while len(rows):
        words[rows] |= padded[first[rows] + k] << (BITS[selectors[rows]] * np.uint64(k))
        k += 1
        rows = rows[counts[rows] > k]
    offsets = np.searchsorted(first, np.arange(blocks + 1, dtype=np.int64) * BLOCK).astype("<u4")
    header = np.array([MAGIC, n, blocks, len(words), len(values)], "<u8")
    return b"".join(x.tobytes() for x in (header, offsets, words.astype("<u8"), values.astype("<u8")))


def decode(data: bytes) -> np.ndarray:
    """All ids of encode()'s bytes."""
    magic, n, blocks, n_words, n_values = (int(x) for x in np.frombuffer(data, "<u8", 5))
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    place = 40
    offsets = np.frombuffer(data, "<u4", blocks + 1, place).astype(np.int64)
    place += 4 * (blocks + 1)
    words = np.frombuffer(data, "<u8", n_words, place)
    values = np.frombuffer(data, "<u8", n_values, place + 8 * n_words)
    return _unpack(words, offsets, values, n)


def _unpack(words: np.ndarray, offsets: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors].copy()
    if len(words):
        last = offsets[1:] - 1  # only a block's last word can hold fewer ids than its selector says
        sums = np.add.reduceat(counts, offsets[:-1])
        sizes = np.full(len(last), BLOCK, np.int64)
        sizes[-1] = n - BLOCK * (len(last) - 1)
        counts[last] -= sums - sizes
    k = np.arange(n, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    shifts = np.repeat(BITS[selectors], counts) * k.astype(np.uint64)
    out = (np.repeat(words, counts) >> shifts) & np.repeat(_MASKS[selectors], counts)
    escaped = np.repeat(selectors == ESCAPE, counts)
    if escaped.any():
        out[escaped] = values[out[escaped].astype(np.int64)]
    return out


def decode_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by its offset."""
    _, n, blocks, n_words, n_values = (int(x) for x in np.frombuffer(data, "<u8", 5))
    offsets = np.frombuffer(data, "<u4", blocks + 1, 40).astype(np.int64)
    place = 40 + 4 * (blocks + 1)
    begin, end = offsets[block], offsets[block + 1]
    words = np.frombuffer(data, "<u8", int(end - begin), place + 8 * int(begin))
    values = np.frombuffer(data, "<u8", n_values, place + 8 * n_words)
    return _unpack(words, np.array([0, end - begin]), values, min(BLOCK, n - BLOCK * block))
