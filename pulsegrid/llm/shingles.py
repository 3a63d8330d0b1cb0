"""Word shingles of whole texts as 64-bit hashes, computed on the texts' UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; longer texts are read block by block, so that memory stays bounded.
BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240501)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]  # only A-Z are folded
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_R), _powers(pow(_R, -1, 1 << 64))


def _fragments(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one block: first byte, length, and polynomial hash. ``breaks``: where a new text begins."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if len(breaks):
        first[breaks] = inside[breaks]
        cut = breaks[breaks > 0] - 1
        last[cut] = inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _POW[: len(data)], out=total[1:])
    return starts, ends + 1 - starts, (total[ends + 1] - total[starts]) * _INV[starts]


def _long_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one text of any length, as from _fragments; a word cut by a block's end is put together again."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: tuple[int, int, int] | None = None  # place, length and hash of a word that may go on

    def close() -> None:
        nonlocal held
        if held:
            out.append((np.array([held[0]]), np.array([held[1]]), np.array([held[2]], np.uint64)))
            held = None

    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        starts, lengths, hashes = _fragments(part, np.zeros(0, np.int64))
        starts = starts + at
        if held and len(starts) and starts[0] == at:
            place, length, value = held
            hashes[0] = np.uint64((value + int(hashes[0]) * pow(_R, length, 1 << 64)) % (1 << 64))
            starts[0], lengths[0] = place, lengths[0] + length
            held = None
        close()
        if len(starts) and not _SPACE[part[-1]]:
            held = int(starts[-1]), int(lengths[-1]), int(hashes[-1])
            starts, lengths, hashes = starts[:-1], lengths[:-1], hashes[:-1]
        out.append((starts, lengths, hashes))
    close()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def words_in(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (null as empty) its bytes and, in order, its words' first bytes, lengths and hashes.

    Words: runs of bytes other than 0x20 and 0x09-0x0D, with A-Z folded.
    """
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets is not None else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        if offsets[at + 1] - offsets[at] > BLOCK:
            own = data[offsets[at] : offsets[at + 1]]
            starts, lengths, hashes = _long_words(own)
            yield own, starts, lengths, mix(hashes + lengths.astype(np.uint64))
            at += 1
            continue
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1), len(texts))
        base = offsets[at]
        breaks = offsets[at:to] - base
        part = data[base : offsets[to]]
        starts, lengths, hashes = _fragments(part, breaks[breaks < len(part)])
        hashes = mix(hashes + lengths.astype(np.uint64))
        bounds = np.searchsorted(starts, np.append(breaks, len(part)))
        for k in range(to - at):
            i, j = bounds[k], bounds[k + 1]
            yield part[breaks[k] : offsets[at + k + 1] - base], starts[i:j] - breaks[k], lengths[i:j], hashes[i:j]
        at = to


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, null as empty, its words' hashes in order."""
    for _, _, _, hashes in words_in(texts):
        yield hashes


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order; a shorter text is one shingle of all its words; no words, none."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    total = words[: n - size + 1] * _MIX[0]
    for j in range(1, size):
        total = total + words[j : n - size + 1 + j] * _MIX[j]
    return mix(total + np.uint64(size))
