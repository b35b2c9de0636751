"""Words of lower-cased texts: runs of digits, a-z and all that is not ASCII."""

from __future__ import annotations

from collections.abc import Iterator

#: A-Z fold to a-z; every other byte that no word holds becomes a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Bytes of a text whose words are held at a time.
SLICE_BYTES = 1 << 20


def word_slices(text: str | None, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in slices of about `most` bytes that end between words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def overlapping_slices(text: str | None, ahead: int, most: int = SLICE_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """Slices of the words of a text, and how many of each one's words are its own; the others, at most `ahead`, are the next slice's first."""
    held: list[bytes] = []
    for words in word_slices(text, most):
        held += words
        own = len(held) - ahead
        if own > 0:
            yield held, own
            held = held[own:]
    yield held, len(held)
