"""Words and lines of Arrow text columns as 64-bit hashes, computed with NumPy on the raw UTF-8 bytes.

A span is cut into pieces of eight bytes.  Each piece is mixed with its place in a
way that is not linear, and the sum over the pieces, mixed once more with the length, is the
hash; so no strings collide whatever the seed, as those of a polynomial modulo a power of two do.
All spans of a block take a few passes over their pieces, whatever their number.
Upper-case A-Z count as lower case.  Work goes by blocks of about a megabyte
that end at white space (lines: at line breaks), which bounds the memory whatever the
length of a text; only the bytes of one word or line longer than a block stay together,
and its pieces are still taken ``PIECES`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: By the number of bytes left of a span: the bits of a piece that belong to it.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
PIECES = 1 << 17


class Hasher:
    """Hashes of byte spans; ``seed`` chooses one of many independent functions, ``fold`` takes A-Z as lower case."""

    def __init__(self, seed: int = 1, fold: bool = True):
        self.fold = fold
        self.first, self.last = mix(np.array([2 * seed, 2 * seed + 1], dtype=np.uint64) * _STEP + np.uint64(seed))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per span ``data[starts:ends]``; empty spans share one value."""
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = _LOWER[data] if self.fold else data
        at = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        size = ends - starts
        count = (size + 7) >> 3
        until = np.cumsum(count)
        sums = np.zeros(len(starts), dtype=np.uint64)
        total = int(until[-1]) if len(until) else 0
        for low in range(0, total, PIECES):
            high = min(low + PIECES, total)
            a, b = np.searchsorted(until, (low, high - 1), side="right")
            here = np.arange(a, b + 1)
            begin = np.maximum(until[here] - count[here], low)
            owner = np.repeat(here, np.minimum(until[here], high) - begin)
            place = np.arange(low, high) - (until[owner] - count[owner])
            piece = at[starts[owner] + 8 * place] & _MASKS[np.minimum(size[owner] - 8 * place, 8)]
            piece = mix((piece ^ self.first) + mix(place.astype(np.uint64) * _STEP + self.last))
            some = begin < np.minimum(until[here], high)
            sums[here[some]] += np.add.reduceat(piece, begin[some] - low)
        return mix(sums + size.astype(np.uint64) * _STEP + self.last)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``len + 1`` offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def pieces(column: pa.Array, size: int = 4 * BLOCK) -> Iterator[pa.Array]:
    """The column in slices of about ``size`` bytes; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield column.slice(at, to - at)
        at = to


def _cuts(space: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about ``BLOCK`` bytes that end before white space or at the end of a text."""
    at, end = 0, len(space)
    while at < end:
        to = at + BLOCK
        if to >= end:
            yield at, end
            return
        edge = offsets[np.searchsorted(offsets, to)]
        while to < edge:
            hit = np.flatnonzero(space[to : min(edge, to + BLOCK)])
            if len(hit):
                to += int(hit[0])
                break
            to = min(edge, to + BLOCK)
        yield at, to
        at = to


def word_blocks(
    column: pa.Array, hasher: Hasher, kinds: np.ndarray = ~_SPACE,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of all texts in order, about ``BLOCK`` bytes at a time: their hashes and first bytes.

    A word is a longest run of bytes of one kind; ``kinds`` gives the kind of each byte, 0 for white space alone.
    """
    data, offsets = text_bytes(column)
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    for at, to in _cuts(space, offsets):
        kind = kinds[data[at:to]]
        other = begins[at : to + 1].copy()
        other[1:-1] |= kind[1:] != kind[:-1]
        other[0] = other[-1] = True
        starts = np.flatnonzero(other[:-1] & (kind != 0))
        ends = np.flatnonzero(other[1:] & (kind != 0)) + 1
        yield hasher.spans(data[at:to], starts, ends), starts + at


def word_hashes(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts in order, and the ``len + 1`` offsets of each text's words."""
    found = list(word_blocks(column, hasher))
    place = np.concatenate([np.zeros(0, dtype=np.int64), *[p for _, p in found]])
    return np.concatenate([np.zeros(0, dtype=np.uint64), *[h for h, _ in found]]), np.searchsorted(place, text_bytes(column)[1])


def _line_blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Blocks of about ``BLOCK`` bytes: first text, first byte, offsets of its texts, and the first text's lines before.

    A block ends with a text or, inside a longer one, before a line break, so that the
    break opens the next block.
    """
    texts, at = len(offsets) - 1, 0
    while at < texts:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1
        if to > at:
            yield at, offsets[at], offsets[at : to + 1] - offsets[at], 0
            at = to
            continue
        start, end, before = int(offsets[at]), int(offsets[at + 1]), 0
        while start < end:
            stop = start + BLOCK
            while stop < end:
                hit = np.flatnonzero(data[stop : min(end, stop + BLOCK)] == 10)
                if len(hit):
                    stop += int(hit[0])
                    break
                stop += BLOCK
            stop = min(stop, end)
            yield at, start, np.array([0, stop - start]), before
            before += int(np.count_nonzero(data[start:stop] == 10))
            start = stop
        at += 1


def line_keys(column: pa.Array, hashers: list[Hasher]) -> dict[str, np.ndarray]:
    """Every line of every text: ``text`` (index), ``line`` (index), ``chars`` of its key, one ``h<i>`` per hasher.

    Lines end at newlines; a key is the line without white space at its ends, in lower case.
    """
    data, offsets = text_bytes(column)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "line", "chars", *[f"h{i}" for i in range(len(hashers))])}
    for at, start, base, before in _line_blocks(data, offsets):
        part, texts = data[start : start + base[-1]], len(base) - 1
        breaks = np.flatnonzero(part == 10)
        # A text with n line breaks has n + 1 lines, the empty text one.
        owner = np.searchsorted(base, breaks, side="right") - 1
        counts = np.bincount(owner, minlength=texts) + 1
        text = np.repeat(np.arange(texts), counts)
        first = np.cumsum(counts) - counts
        line = np.arange(len(text)) - first[text] + before
        starts, ends = np.empty(len(text), dtype=np.int64), np.empty(len(text), dtype=np.int64)
        starts[first], ends[first + counts - 1] = base[:-1], base[1:]
        starts[np.delete(np.arange(len(text)), first)] = breaks + 1
        ends[np.delete(np.arange(len(text)), first + counts - 1)] = breaks
        solid = np.flatnonzero(~_SPACE[part])
        if len(solid):
            low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
            some = high > low
            starts = np.where(some, solid[np.minimum(low, len(solid) - 1)], starts)
            ends = np.where(some, solid[np.maximum(high - 1, 0)] + 1, starts)
        else:
            ends = starts
        chars = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
        # A block that goes on with a text begins at the break that ended the line before.
        new = slice(int(start > offsets[at]), None)
        out["text"].append((text + at)[new])
        out["line"].append(line[new])
        out["chars"].append((chars[ends] - chars[starts])[new])
        for i, hasher in enumerate(hashers):
            out[f"h{i}"].append(hasher.spans(part, starts[new], ends[new]))
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in out.items()}
