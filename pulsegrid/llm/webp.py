"""Lossless WebP: a decoder for whole VP8L bitstreams, and grey media columns made of texts' bytes (operator 6).

``decode`` reads any lossless WebP: prefix codes (simple and normal, in one or many groups), back-references,
colour cache, and the predictor, cross-colour, subtract-green and palette transforms, which it inverts in reverse order;
the result is a pixel array (height, width, 4) of ARGB.

A media column stores a payload as grey samples, 64 to a row: a still image, or an animation of
frames of at most ``FRAME`` samples for a longer payload. Every frame has a prefix code of its own and the subtract-green
transform; repeats of ``MATCH`` samples and more become back-references where a frame has ``WORTH`` of them, and a
frame of at most 16 levels is stored by palette, several samples to a pixel, where that is smaller. The other tools can't make
grey text smaller and are only read: red and blue are constant after subtract-green, so that a colour cache replaces a
symbol by a symbol, and cross-colour has nothing to turn. ``decode_grey`` decodes the frames of many rows side by side: each frame is a
lane, and one numpy step reads a symbol in every lane (back-references included), so that a column's decoding costs no
Python step per pixel. Frames that use more than this (other transforms, colour cache, code groups) go through ``decode``.

Defined cases: a null text is the empty text, whose payload is 64 zero bytes; texts of any length are
stored whole; equal texts have equal media and features; null ids pass; an empty table gives no rows; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import materialise

WIDTH, FRAME, LIMIT = 64, 4096, 10
MATCH, WORTH = 16, 128  # samples of a back-reference, and all of a frame's, at least
# Fixed values of the format: order of code length codes; palette sizes by packed bits.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


def near_places() -> list[tuple[int, int]]:
    """(x, y) of the 120 short distance codes: places to the left and above, by their distance, then by |x|, right of it first."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


NEAR = near_places()


class Bits:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self._low, self._window = -1, 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        if byte != self._low:
            self._window, self._low = int.from_bytes(self.data[byte : byte + 8], "little"), byte
        return self._window >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


def reversed_bits(bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for k in range(bits):
        out |= (np.arange(1 << bits) >> k & 1) << (bits - 1 - k)
    return out


_REVERSED = [reversed_bits(b) for b in range(16)]


def code_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Table of (symbol | length << 12) for the next bits, and how many bits it takes; a lone symbol takes none."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.array([used[0]], np.int64), 0
    bits = int(lengths.max(initial=0))
    order = used[np.lexsort((used, lengths[used]))]
    entries = np.repeat(order | lengths[order] << 12, 1 << (bits - lengths[order]))
    if bits == 0 or len(entries) != 1 << bits:
        raise ValueError("prefix code isn't complete")
    return entries[_REVERSED[bits]], bits


def read_lengths(b: Bits, alphabet: int) -> np.ndarray:
    """Code lengths of one prefix code."""
    lengths = np.zeros(alphabet, np.int64)
    if b.read(1):
        two = b.read(1)
        lengths[b.read(8 if b.read(1) else 1)] = 1
        if two:
            lengths[b.read(8)] = 1
        return lengths
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + b.read(4)]:
        own[k] = b.read(3)
    table, bits = code_table(own)
    table = table.tolist()
    most = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else alphabet
    at, before, found = 0, 8, [0] * alphabet
    while at < alphabet and most:
        most -= 1
        entry = table[b.peek(bits)] if bits else table[0]
        b.at += entry >> 12
        symbol = entry & 4095
        if symbol < 16:
            found[at] = symbol
            before = symbol or before
            at += 1
        elif symbol == 16:
            n = 3 + b.read(2)
            found[at : at + n] = [before] * n
            at += n
        else:
            at += 3 + b.read(3) if symbol == 17 else 11 + b.read(7)
    if at > alphabet or len(found) != alphabet:
        raise ValueError("too many code lengths")
    lengths[:] = found
    return lengths


class Code:
    """One prefix code for reading symbol by symbol."""

    def __init__(self, lengths: np.ndarray):
        table, self.bits = code_table(lengths)
        self.table = table.tolist()

    def read(self, b: Bits) -> int:
        entry = self.table[b.peek(self.bits)] if self.bits else self.table[0]
        b.at += entry >> 12
        return entry & 4095


def _value(b: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + b.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _pixels(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded ARGB values of an image or of a transform's data, as a flat array."""
    cache_bits = b.read(4) if b.read(1) else 0
    groups, meta, block = 1, None, 0
    if main and b.read(1):
        block = b.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        meta = (_pixels(b, across, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(meta.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[Code(read_lengths(b, n)) for n in (280 + cached, 256, 256, 256, 40)] for _ in range(groups)]
    cache, shift = [0] * cached, 32 - cache_bits
    out: list[int] = []
    total = width * height
    green, red, blue, alpha, far = codes[0]
    while (at := len(out)) < total:
        if meta is not None:
            green, red, blue, alpha, far = codes[meta[at // width >> block, at % width >> block]]
        symbol = green.read(b)
        if symbol < 256:
            r = red.read(b)
            bl = blue.read(b)
            new = [alpha.read(b) << 24 | r << 16 | symbol << 8 | bl]
        elif symbol < 280:
            n = _value(b, symbol - 256)
            d = _distance(_value(b, far.read(b)), width)
            if d > at:
                raise ValueError("back-reference before the first pixel")
            new = [out[at - d + k % d] for k in range(min(n, total - at))]
        else:
            new = [cache[symbol - 280]]
        if cached:
            for p in new:
                cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = p
        out += new
    return np.array(out, np.int64)


def _planes(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], -1)


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, top_left, top_right):
    """One pixel's prediction; arrays of four channels."""
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode in (6, 7):
        return _average(left, top_left if mode == 6 else top)
    if mode in (8, 9):
        return _average(top, top_left if mode == 8 else top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = _average(left, top)
        return np.clip(half + ((half - top_left) / 2).astype(np.int64), 0, 255)
    return np.array([255, 0, 0, 0])


def _undo_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = image.shape[:2]
    flat = image.reshape(-1, 4)
    for at in range(len(flat)):
        y, x = divmod(at, width)
        if at == 0:
            guess = np.array([255, 0, 0, 0])
        elif y == 0:
            guess = flat[at - 1]
        elif x == 0:
            guess = flat[at - width]
        else:  # at the right border, the pixel above to the right is this row's first
            guess = _predict(int(modes[y >> bits, x >> bits]), flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1])
        flat[at] = (flat[at] + guess) & 255
    return flat.reshape(height, width, 4)


def _undo_cross_colour(image: np.ndarray, data: np.ndarray, bits: int) -> np.ndarray:
    height, width = image.shape[:2]
    y, x = np.indices((height, width))
    parts = data[y >> bits, x >> bits]
    signed = lambda v: (v + 128 & 255) - 128
    change = lambda t, c: signed(t) * signed(c) >> 5
    red = (image[..., 1] + change(parts[..., 3], image[..., 2])) & 255
    blue = image[..., 3] + change(parts[..., 2], image[..., 2]) + change(parts[..., 1], red)
    return np.stack([image[..., 0], red, image[..., 2], blue & 255], -1)


def decode_vp8l(data: bytes) -> np.ndarray:
    """A VP8L bitstream's pixels, (height, width, 4) as ARGB."""
    b = Bits(data)
    if b.read(8) != 0x2F:
        raise ValueError("not a VP8L bitstream")
    full = width = b.read(14) + 1
    height = b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown VP8L version")
    undo = []
    while b.read(1):
        kind = b.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = b.read(3) + 2
            size = [(n + (1 << bits) - 1) >> bits for n in (width, height)]
            undo.append((kind, bits, _planes(_pixels(b, size[0], size[1], False)).reshape(size[1], size[0], 4)))
        elif kind == PALETTE:
            n = b.read(8) + 1
            colours = np.cumsum(_planes(_pixels(b, n, 1, False)), 0) & 255
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, bits, (colours, width)))
            width = (width + (1 << bits) - 1) >> bits
        else:
            undo.append((kind, 0, None))
    image = _planes(_pixels(b, width, height, True)).reshape(height, width, 4)
    for kind, bits, extra in reversed(undo):
        if kind == PREDICTOR:
            image = _undo_predictor(image.copy(), extra[..., 2], bits)
        elif kind == CROSS_COLOUR:
            image = _undo_cross_colour(image, extra, bits)
        elif kind == SUBTRACT_GREEN:
            image = np.stack([image[..., 0], image[..., 1] + image[..., 2] & 255, image[..., 2], image[..., 3] + image[..., 2] & 255], -1)
        else:
            colours, width = extra
            per, depth = 1 << bits, 8 >> bits
            x = np.arange(width)
            index = image[:, x // per, 2] >> (x % per * depth) & ((1 << depth) - 1)
            table = np.zeros((256, 4), np.int64)  # an index past the palette is transparent black
            table[: len(colours)] = colours
            image = table[index]
    return image.reshape(height, full, 4).astype(np.uint8)


def frames_of(media: bytes) -> list[tuple[int, int]]:
    """Start and end of each VP8L bitstream of a WebP file, in order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out = []

    def chunks(at: int, end: int) -> None:
        while at + 8 <= end:
            kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if kind == b"VP8L":
                out.append((at + 8, at + 8 + size))
            elif kind == b"ANMF":
                chunks(at + 8 + 16, at + 8 + size)
            at += 8 + size + (size & 1)

    chunks(12, len(media))
    return out


def decode(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of a WebP file's frames."""
    return [decode_vp8l(media[i:j]) for i, j in frames_of(media)]


# ---- grey media columns ----


def limited_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Complete code lengths of at most ``limit`` for at least two symbols, by merging the rarest (ties by symbol)."""
    used = np.flatnonzero(counts).tolist()
    while len(used) < 2:
        used.append(next(s for s in (0, 1) if s not in used))
    weight = {s: int(counts[s]) or 1 for s in used}
    while True:
        heap = [(w, s, None) for s, w in weight.items()]
        heapq.heapify(heap)
        name = 1 << 16
        while len(heap) > 1:
            a, c = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + c[0], name, (a, c)))
            name += 1
        lengths = np.zeros(len(counts), np.int64)
        stack, deepest = [(heap[0], 0)], 0
        while stack:
            (_, s, pair), depth = stack.pop()
            if pair is None:
                lengths[s] = depth
                deepest = max(deepest, depth)
            else:
                stack += [(pair[0], depth + 1), (pair[1], depth + 1)]
        if deepest <= limit:
            return lengths
        weight = {s: (w >> 1) + 1 for s, w in weight.items()}


def _bits_of(fields: list[tuple[int, int]]) -> tuple[int, int]:
    value = at = 0
    for v, n in fields:
        value |= v << at
        at += n
    return value, at


#: Each length of the samples' code takes four bits: a complete code over lengths 0 to 13 and the two zero runs.
_LENGTH_CODE = sorted([*range(14), 17, 18])
_LENGTH_BITS = {s: int(_REVERSED[4][k]) for k, s in enumerate(_LENGTH_CODE)}
_LENGTH_VALUE = np.array([_LENGTH_BITS[s] for s in range(14)], np.uint64)


_LENGTH_FIELDS = [(15, 4), *((4 if k in _LENGTH_BITS else 0, 3) for k in LENGTH_ORDER)]
#: Lone symbols for red and blue (0) and alpha (255), and for distance (0).
_CHANNELS = [(1, 1), (0, 1), (0, 1), (0, 1)] * 2 + [(1, 1), (0, 1), (1, 1), (255, 8)]
_NO_DISTANCE = [(1, 1), (0, 1), (0, 1), (0, 1)]
GREEN = 280
#: The smallest code of each distance.
_NEAR_CODES = {max(1, x + y * WIDTH): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _begin(width: int, height: int) -> list[tuple[int, int]]:
    """A frame's fields up to its first transform, which is subtract-green."""
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2)]


def _head(width: int, height: int) -> tuple[int, int]:
    """A plain frame's bits before the samples' code lengths."""
    return _bits_of([*_begin(width, height), (0, 1), (0, 1), (0, 1), (0, 1), *_LENGTH_FIELDS, (1, 1), (3, 3), (256 - 2, 8)])


_TAIL = _bits_of(_CHANNELS + _NO_DISTANCE)


def _all_lengths(lengths: np.ndarray) -> list[tuple[int, int]]:
    """A prefix code by the lengths of its whole alphabet."""
    return [(0, 1), *_LENGTH_FIELDS, (0, 1), *((v, 4) for v in _LENGTH_VALUE[lengths].tolist())]


def _short_code(counts: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Fields of a prefix code, cut after its last symbol, and each symbol's bits."""
    used = np.flatnonzero(counts)
    if len(used) == 1:
        return [(1, 1), (0, 1), (1, 1), (int(used[0]), 8)], {int(used[0]): (0, 0)}
    lengths = limited_lengths(counts)
    most = int(np.flatnonzero(lengths)[-1]) + 1
    codes = canonical(lengths[None])[0]
    return [(0, 1), *_LENGTH_FIELDS, (1, 1), (3, 3), (most - 2, 8), *((v, 4) for v in _LENGTH_VALUE[lengths[:most]].tolist())], {int(k): (int(codes[k]), int(lengths[k])) for k in np.flatnonzero(lengths)}


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes, first bit lowest, of rows of code lengths."""
    codes, first = np.zeros(lengths.shape, np.int64), np.zeros(len(lengths), np.int64)
    for bits in range(1, LIMIT + 1):
        first <<= 1
        here = lengths == bits
        value = first[:, None] + np.cumsum(here, 1) - 1
        codes[here] = _REVERSED[bits][value[here]]
        first += here.sum(1)
    return codes


def palette_frame(frame: np.ndarray) -> tuple[int, int]:
    """The bits of a frame of at most 16 levels: subtract-green over a palette of (255, 0, level, 0)."""
    levels, index = np.unique(frame, return_inverse=True)
    n = len(levels)
    bits = 3 if n <= 2 else 2 if n <= 4 else 1
    packed = (index.reshape(-1, 1 << bits) << np.arange(1 << bits) * (8 >> bits)).sum(1)
    steps = np.diff(levels.astype(np.int64), prepend=0)
    fields = [*_begin(WIDTH, len(frame) // WIDTH), (1, 1), (PALETTE, 2), (n - 1, 8), (0, 1)]
    code, own = _short_code(np.bincount(steps, minlength=256))
    # alpha begins with 255 and doesn't change any more
    alpha = [(1, 1), (1, 1), (1, 1), (0, 8), (255, 8)] if n > 1 else [(1, 1), (0, 1), (1, 1), (255, 8)]
    fields += [*code, *_CHANNELS[:8], *alpha, *_NO_DISTANCE]
    for k, step in enumerate(steps.tolist()):
        fields += [own[step], *([(int(k == 0), 1)] if n > 1 else [])]
    code, own = _short_code(np.bincount(packed, minlength=256))
    fields += [(0, 1), (0, 1), (0, 1), *code, *_CHANNELS, *_NO_DISTANCE, *(own[v] for v in packed.tolist())]
    return _bits_of(fields)


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance code; the inverse of ``_value``."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), value & ((1 << extra) - 1), extra


def repeats(frame: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of repeats of at least ``MATCH`` samples, none overlapping, from the left."""
    n = len(frame)
    if n <= MATCH:
        return []
    eight = np.ndarray(n - 7, "<u8", frame.tobytes(), strides=(1,))
    key = eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    short = (key >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    places, before = order[1:][same], order[:-1][same]
    by_place = np.argsort(places)
    out, at = [], 0
    for i, j in zip(places[by_place].tolist(), before[by_place].tolist()):
        if i < at:
            continue
        differs = frame[i:] != frame[j : n - i + j]
        length = int(differs.argmax()) if differs.any() else n - i
        if length >= MATCH:
            out.append((i, length, i - j))
            at = i + length
    return out if sum(r[1] for r in out) >= WORTH else []


def encode_frames(frames: list[np.ndarray]) -> list[bytes]:
    """VP8L bitstreams of grey frames (flat samples, a multiple of WIDTH each)."""
    n = len(frames)
    symbols, extras, linked = [], [], np.zeros(n, bool)  # distances are symbols from GREEN on
    base = 0
    for k, f in enumerate(frames):
        found = repeats(f)
        own = f.astype(np.int64)
        if found:
            linked[k] = True
            parts, at, size = [], 0, 0
            for i, length, back in found:
                long, far = _prefix(length), _prefix(_NEAR_CODES.get(back, back + 120))
                size += i - at
                parts += [own[at:i], np.array([256 + long[0], GREEN + far[0]])]
                extras += [(base + size, *long[1:]), (base + size + 1, *far[1:])]
                size += 2
                at = i + length
            own = np.concatenate([*parts, own[at:]])
        symbols.append(own)
        base += len(own)
    sizes = np.array([len(x) for x in symbols])
    symbol = np.concatenate(symbols)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * (GREEN + 40) + symbol, minlength=n * (GREEN + 40)).reshape(n, GREEN + 40)
    lengths = np.zeros_like(counts)
    for k in range(n):
        lengths[k, :GREEN] = limited_lengths(counts[k, :GREEN])
        if linked[k]:
            lengths[k, GREEN:] = limited_lengths(counts[k, GREEN:])
    codes = np.concatenate([canonical(lengths[:, :GREEN]), canonical(lengths[:, GREEN:])], 1)
    heads = []
    for k, f in enumerate(frames):
        if linked[k]:
            fields = [*_begin(WIDTH, len(f) // WIDTH), (0, 1), (0, 1), (0, 1)]
            heads.append(_bits_of([*fields, *_all_lengths(lengths[k, :GREEN]), *_CHANNELS, *_all_lengths(lengths[k, GREEN:])]))
        else:
            heads.append(_head(WIDTH, len(f) // WIDTH))
    head_bits = np.array([h[1] for h in heads])
    before = head_bits + np.where(linked, 0, 256 * 4 + _TAIL[1])
    value, bits = codes[owner, symbol], lengths[owner, symbol]
    if extras:
        where, extra, more = np.array(extras).T
        value[where] |= extra << bits[where]
        bits[where] += more
    total = np.bincount(owner, bits, minlength=n).astype(np.int64) + before
    words = (total + 31) // 32 + 1
    base = np.concatenate([[0], np.cumsum(words)])[:-1] * 32
    ends = np.cumsum(bits)
    starts = ends - bits
    place = starts - np.repeat(starts[np.cumsum(sizes) - sizes], sizes) + np.repeat(base + before, sizes)

    def put(place: np.ndarray, value: np.ndarray, into: np.ndarray) -> None:
        shifted = value.astype(np.uint64) << (place & 31).astype(np.uint64)
        low, high = shifted & np.uint64(0xFFFFFFFF), shifted >> np.uint64(32)
        into += np.bincount(place >> 5, low, minlength=len(into)).astype(np.uint64)
        into += np.bincount((place >> 5) + 1, high, minlength=len(into) + 1).astype(np.uint64)[: len(into)]

    out = np.zeros(int(words.sum()), np.uint64)
    put(place, value, out)
    plain = np.flatnonzero(~linked)
    at = (base + head_bits)[plain, None] + np.arange(256) * 4
    put(at.ravel(), _LENGTH_VALUE[lengths[plain, :256].ravel()], out)
    for shift in range(0, _TAIL[1], 16):
        put((base + head_bits)[plain] + 1024 + shift, np.full(len(plain), _TAIL[0] >> shift & 0xFFFF), out)
    for shift in range(0, int(head_bits.max()), 16):
        some = np.flatnonzero(head_bits > shift)
        put(base[some] + shift, np.array([heads[k][0] >> shift & 0xFFFF for k in some]), out)
    raw = out.astype("<u4").tobytes()
    streams = [raw[(i := int(o) // 8) : i + (int(t) + 7) // 8] for o, t in zip(base, total, strict=True)]
    for k in np.flatnonzero(np.count_nonzero(counts[:, :256], axis=1) <= 16).tolist():
        if len(np.unique(frames[k])) > 16:
            continue
        bits_of, size = palette_frame(frames[k])
        if size < total[k]:
            streams[k] = bits_of.to_bytes((size + 7) // 8, "little")
    return streams


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def container(streams: list[bytes], heights: list[int]) -> bytes:
    """A WebP file: a still image of one bitstream, an animation of more."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        size = (WIDTH - 1).to_bytes(3, "little") + (max(heights) - 1).to_bytes(3, "little")
        body = _chunk(b"VP8X", bytes([2, 0, 0, 0]) + size) + _chunk(b"ANIM", bytes(6))
        for s, h in zip(streams, heights, strict=True):
            body += _chunk(b"ANMF", bytes(6) + (WIDTH - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little") + (100).to_bytes(3, "little") + bytes([2]) + _chunk(b"VP8L", s))
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def encode_grey(payloads: list[bytes]) -> list[bytes]:
    """Media of payloads whose sizes are positive multiples of WIDTH."""
    frames, of = [], []
    for p in payloads:
        data = np.frombuffer(p, np.uint8)
        own = [data[i : i + FRAME] for i in range(0, len(data), FRAME)]
        of.append(range(len(frames), len(frames) + len(own)))
        frames += own
    streams = encode_frames(frames) if frames else []
    return [container([streams[i] for i in r], [len(frames[i]) // WIDTH for i in r]) for r in of]


def _plain_head(data: bytes) -> tuple[int, int, int, np.ndarray, int, Code] | None:
    """Width, height, first data bit, sample code lengths, offset to grey, and distance code of a frame whose only
    varying channel is green and whose only transform is subtract-green (or none); None for other frames."""
    b = Bits(data)
    if b.read(8) != 0x2F:
        raise ValueError("not a VP8L bitstream")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(4)
    if b.read(1) and (b.read(2) != SUBTRACT_GREEN or b.read(1)):
        return None
    if b.read(1) or b.read(1):  # colour cache, code groups
        return None
    lengths = read_lengths(b, 280)
    for _ in range(3):
        if np.count_nonzero(read_lengths(b, 256)) != 1:
            return None
    far = read_lengths(b, 40)
    return width, height, b.at, lengths, 0, Code(far)


def decode_grey(streams: list[bytes]) -> list[np.ndarray]:
    """Green samples (flat uint8) of many bitstreams, one lane each."""
    out: list[np.ndarray | None] = [None] * len(streams)
    heads = {}
    for i, s in enumerate(streams):
        head = _plain_head(s)
        if head is None or np.count_nonzero(head[3]) < 2:
            out[i] = decode_vp8l(s)[..., 2].ravel()
        else:
            heads[i] = head
    by_bits: dict[bool, list[int]] = {}
    for i, h in heads.items():
        by_bits.setdefault(bool(h[3].max() > LIMIT), []).append(i)
    for wide, lanes in by_bits.items():
        step = 256 if wide else 4096
        for at in range(0, len(lanes), step):
            own = lanes[at : at + step]
            for i, plane in zip(own, _decode_lanes([streams[i] for i in own], [heads[i] for i in own], 15 if wide else LIMIT), strict=True):
                out[i] = plane
    return out


def _decode_lanes(streams: list[bytes], heads: list[tuple], bits: int) -> list[np.ndarray]:
    n = len(streams)
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    # the 32 bits that begin at each byte
    ahead = data[:-4].astype(np.uint32)
    for k in (1, 2, 3):
        ahead |= data[k : k - 4].astype(np.uint32) << np.uint32(8 * k)
    lengths = np.stack([h[3] for h in heads])
    lane, symbol = np.nonzero(lengths)
    size = lengths[lane, symbol]
    order = np.lexsort((symbol, size, lane))
    entries = np.repeat((symbol | size << 12)[order], (1 << (bits - size))[order])
    if len(entries) != n << bits:
        raise ValueError("prefix code isn't complete")
    table = entries.astype(np.uint16).reshape(n, 1 << bits)[:, _REVERSED[bits]].ravel()
    sizes = np.array([h[0] * h[1] for h in heads])
    base = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(base[-1]), np.uint8)
    at, stop = base[:-1].copy(), base[1:]
    place = offsets[:-1] * 8 + np.array([h[2] for h in heads])
    live = np.argsort(-sizes, kind="stable")
    row, at, stop, place = live << bits, at[live], stop[live], place[live]
    mask = np.uint32((1 << bits) - 1)
    while len(live):
        ready = ahead[place >> 3] >> (place & 7).astype(np.uint32) & mask
        entry = table[row + ready]
        place += entry >> 12
        value = entry & 4095
        if value.max() < 256:
            out[at] = value
            at += 1
        else:
            plain = value < 256
            out[at[plain]] = value[plain]
            at[plain] += 1
            for k in np.flatnonzero(~plain).tolist():
                i = int(live[k])
                b = Bits(streams[i], int(place[k]) - int(offsets[i]) * 8)
                run = _value(b, int(value[k]) - 256)
                back = _distance(_value(b, heads[i][5].read(b)), heads[i][0])
                a = int(at[k])
                run = min(run, int(stop[k]) - a)
                if back > a - int(base[i]):
                    raise ValueError("back-reference before the first pixel")
                out[a : a + run] = np.resize(out[a - back : a][: max(run, 0)] if back >= run else out[a - back : a], run)
                at[k] += run
                place[k] = b.at + int(offsets[i]) * 8
        rest = at < stop
        if not rest.all():
            live, row, at, stop, place = live[rest], row[rest], at[rest], stop[rest], place[rest]
    return [out[i:j] for i, j in zip(base[:-1], base[1:], strict=True)]


def read_grey(media: list[bytes]) -> list[bytes]:
    """The payloads of media."""
    streams, of = [], []
    for m in media:
        own = frames_of(m)
        of.append(range(len(streams), len(streams) + len(own)))
        streams += [m[i:j] for i, j in own]
    planes = decode_grey(streams)
    return [b"".join(planes[i].tobytes() for i in r) for r in of]


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean change from sample to sample."""
    data = np.frombuffer(payload, np.uint8)
    share = np.bincount(data, minlength=256) / len(data)
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(np.sqrt(max(share @ (levels - mean) ** 2, 0.0)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    change = float(np.abs(np.diff(data.astype(np.int16))).mean())
    return f"{mean:.3f}|{deviation:.3f}|{entropy:.4f}|{change:.3f}"


def _batches(batch: pa.RecordBatch, column: int, room: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``room`` bytes in one column, at least a row."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy()
    at = 0
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")))
        yield batch.slice(at, to - at)
        at = to


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (unpadded) and ``media`` of every whole text."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, 1):
                raw = [v.as_buffer().to_pybytes() for v in part.column(1)]
                media = encode_grey([r + bytes(max(WIDTH, -(-len(r) // WIDTH) * WIDTH) - len(r)) for r in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return base.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Payloads of a media column read back, with digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, 2, 2 << 20):
                media = part.column(2).to_pylist()
                payloads = read_grey(media)
                columns = [
                    part.column(0), part.column(1), pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-WIDTH:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([feature(p) for p in payloads]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the media column of all texts as a table in the shared folder, and reads it back."""
    return read_back(materialise(store(docs), "media"))
