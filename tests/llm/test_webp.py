"""The lossless WebP decoder on streams made here with every feature, and the media column's round trip."""

import hashlib
import zlib

import numpy as np
import pytest

from pulsegrid.llm import queries, webp
from tests.conftest import SF
from tests.llm.test_operators import EDGE, docs


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v, bits):
        self.value |= int(v) << self.n
        self.n += bits

    def bytes(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def write_code(w, lengths):
    """A prefix code by its lengths: simple where it can be, else normal with four-bit lengths."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and all(u < 256 for u in used):
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for u in used:
            w.put(u, 8)
        return
    w.put(0, 1)
    w.put(15, 4)
    for k in webp.LENGTH_ORDER:
        w.put(4 if k < 16 else 0, 3)
    w.put(0, 1)
    for n in lengths:
        w.put(webp._REVERSED[4][n], 4)


def codes_of(lengths):
    """Bit-reversed canonical codes."""
    out, code = {}, 0
    for bits in range(1, 16):
        code <<= 1
        for s in np.flatnonzero(lengths == bits):
            out[int(s)] = (int(webp._REVERSED[bits][code]), bits)
            code += 1
    if len(np.flatnonzero(lengths)) == 1:
        return {int(np.flatnonzero(lengths)[0]): (0, 0)}
    return out


def lengths_for(symbols, alphabet):
    counts = np.bincount(symbols, minlength=alphabet) if len(symbols) else np.bincount([0], minlength=alphabet)
    used = np.flatnonzero(counts)
    lengths = np.zeros(alphabet, int)
    depth = max(1, int(np.ceil(np.log2(len(used))))) if len(used) > 1 else 1
    lengths[used] = depth
    spare = (1 << depth) - len(used)
    for s in used[:spare] if len(used) > 1 else []:
        lengths[s] = depth - 1
    if len(used) > 1:
        assert (2.0 ** -lengths[used]).sum() == 1.0
    return lengths


def prefix(value):
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def write_pixels(w, ops, cache_bits, main, groups=None, width=1):
    """ops: ('lit', argb), ('ref', length, distance code), ('hit', index). groups: (block bits, across, codes per block)."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(1 if groups else 0, 1)
        if groups:
            bits, across, table = groups
            w.put(bits - 2, 3)
            write_pixels(w, [("lit", 0xFF000000 | g << 8) for g in table], 0, False)
    n = max(groups[2]) + 1 if groups else 1
    syms = [[[], [], [], [], []] for _ in range(n)]
    plan, at = [], 0
    for op in ops:
        g = 0
        if groups:
            bits, across, table = groups
            g = table[(at // width >> bits) * across + (at % width >> bits)]
        if op[0] == "lit":
            p = op[1]
            parts = [(0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24 & 255)]
            at += 1
        elif op[0] == "hit":
            parts = [(0, 280 + op[1])]
            at += 1
        else:
            (a, ax, ab), (b, bx, bb) = prefix(op[1]), prefix(op[2])
            parts = [(0, 256 + a), (None, ax, ab), (4, b), (None, bx, bb)]
            at += op[1]
        plan.append((g, parts))
        for x in parts:
            if x[0] is not None:
                syms[g][x[0]].append(x[1])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for own in syms:
        lengths = [lengths_for(s, a) for s, a in zip(own, sizes, strict=True)]
        for x in lengths:
            write_code(w, x)
        codes.append([codes_of(x) for x in lengths])
    for g, parts in plan:
        for x in parts:
            w.put(*(x[1:] if x[0] is None else codes[g][x[0]][x[1]]))


def header(w, width, height):
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def argb(image):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for a, r, g, b in image.reshape(-1, 4)]


def picture(h=9, w=11, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)


def plain_stream(pixels, width, height, **more):
    w = Writer()
    header(w, width, height)
    w.put(0, 1)
    write_pixels(w, pixels, more.pop("cache_bits", 0), True, width=width, **more)
    return w.bytes()


def test_literals_and_many_code_groups():
    image = picture()
    ops = [("lit", p) for p in argb(image)]
    assert (webp.decode_vp8l(plain_stream(ops, 11, 9)) == image).all()
    table = [0, 1, 2, 1, 0, 2, 2, 1, 0]
    assert (webp.decode_vp8l(plain_stream(ops, 11, 9, groups=(2, 3, table))) == image).all()


def test_back_references_and_colour_cache():
    rng = np.random.default_rng(3)
    ops, out, cache, width = [], [], {}, 16

    def keep(p):
        out.append(p)
        cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> 28] = p

    while len(out) < 16 * 20:
        kind = rng.integers(4)
        hits = [k for k, v in cache.items() if v]
        if kind == 0 and len(out) > 40 and len(out) < 300:
            n, code = int(rng.integers(1, 18)), int(rng.choice([1, 2, 3, 4, 9, 120, 121, 150]))
            d = webp._distance(code, width)
            if d <= len(out):
                ops.append(("ref", n, code))
                for _ in range(n):
                    keep(out[-d])
                continue
        if kind == 1 and hits:
            k = int(rng.choice(hits))
            ops.append(("hit", k))
            keep(cache[k])
            continue
        p = int(rng.integers(0, 6)) * 0x01020304 | 0xFF000000
        ops.append(("lit", p))
        keep(p)
    got = webp.decode_vp8l(plain_stream(ops, width, 20, cache_bits=4))
    assert argb(got) == out[:320]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    image = picture(seed=mode).astype(int)
    h, wd = image.shape[:2]
    rest = image.copy()
    for y in range(h):
        for x in range(wd):
            left, top = image[y, x - 1], image[y - 1, x]
            if y == 0 and x == 0:
                guess = np.array([255, 0, 0, 0])
            elif y == 0:
                guess = left
            elif x == 0:
                guess = top
            else:
                guess = webp._predict(mode, left, top, image[y - 1, x - 1], image[y - 1, x + 1] if x + 1 < wd else image[y, 0])
            rest[y, x] = (image[y, x] - guess) & 255
    w = Writer()
    header(w, wd, h)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(2, 3)  # blocks of 16
    write_pixels(w, [("lit", 0xFF000000 | mode << 8)], 0, False)
    w.put(0, 1)
    write_pixels(w, [("lit", p) for p in argb(rest)], 0, True)
    assert (webp.decode_vp8l(w.bytes()) == image).all()


def test_predictions_by_hand():
    a = lambda *v: np.array(v)
    left, top, tl, tr = a(10, 20, 30, 40), a(50, 60, 70, 81), a(5, 90, 30, 0), a(1, 2, 3, 4)
    assert webp._predict(5, left, top, tl, tr).tolist() == [27, 35, 43, 51]
    assert webp._predict(12, left, top, tl, tr).tolist() == [55, 0, 70, 121]
    assert webp._predict(13, left, top, tl, tr).tolist() == [42, 15, 60, 90]
    assert webp._predict(11, left, top, tl, tr).tolist() == (left if np.abs(top - tl).sum() < np.abs(left - tl).sum() else top).tolist()


def test_cross_colour_and_subtract_green():
    image = picture(seed=5).astype(int)
    signed = lambda v: (v + 128 & 255) - 128
    g2r, g2b, r2b = 40, 200, 90
    alpha, r, g, b = (image[..., k] for k in range(4))
    flat = np.stack([alpha, (r - g) & 255, g, (b - g) & 255], -1)  # subtract-green last, so undone first ... order below
    crossed = flat.copy()
    crossed[..., 3] = (flat[..., 3] - (signed(g2b) * signed(g) >> 5) - (signed(r2b) * signed(flat[..., 1]) >> 5)) & 255
    crossed[..., 1] = (flat[..., 1] - (signed(g2r) * signed(g) >> 5)) & 255
    w = Writer()
    header(w, 11, 9)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(2, 3)
    write_pixels(w, [("lit", 0xFF000000 | r2b << 16 | g2b << 8 | g2r)], 0, False)
    w.put(0, 1)
    write_pixels(w, [("lit", p) for p in argb(crossed)], 0, True)
    assert (webp.decode_vp8l(w.bytes()) == image).all()


@pytest.mark.parametrize("n", [2, 3, 13, 40])
def test_palette(n):
    rng = np.random.default_rng(n)
    colours = rng.integers(0, 256, (n, 4))
    index = rng.integers(0, n, (9, 11))
    bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    per, depth = 1 << bits, 8 >> bits
    packed = np.zeros((9, -(-11 // per)), int)
    for x in range(11):
        packed[:, x // per] |= index[:, x] << (x % per * depth)
    delta = np.diff(colours, axis=0, prepend=np.zeros((1, 4), int)) & 255
    w = Writer()
    header(w, 11, 9)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(n - 1, 8)
    write_pixels(w, [("lit", p) for p in argb(delta)], 0, False)
    w.put(0, 1)
    write_pixels(w, [("lit", 0xFF000000 | int(p) << 8) for p in packed.ravel()], 0, True)
    assert (webp.decode_vp8l(w.bytes()) == colours[index]).all()


def test_lanes_take_back_references_and_leave_other_frames_to_the_full_decoder():
    rng = np.random.default_rng(0)
    streams, want = [], []
    for k in range(6):
        ops, out = [], []
        while len(out) < 64 * 4:
            if len(out) > 70 and len(out) < 230 and rng.random() < 0.2:
                ops.append(("ref", 9, 1))
                out += [out[-64 + i] for i in range(9)] if False else []
                for _ in range(9):
                    out.append(out[-64])
            else:
                out.append(int(rng.integers(0, 30)))
                ops.append(("lit", 0xFF000000 | out[-1] << 8))
        w = Writer()
        header(w, 64, 4)
        w.put(0, 1)
        write_pixels(w, ops, 3 if k == 5 else 0, True)
        streams.append(w.bytes())
        want.append(bytes(out[:256]))
    assert [p.tobytes() for p in webp.decode_grey(streams)] == want


def test_grey_media_round_trip_in_both_decoders():
    payloads = [bytes(64), bytes(64 * 200), bytes(range(256)) * 64, b"text " * 64, b"ab" * 32, zlib.compress(b"x" * 9)[:1] * 128]
    media = webp.encode_grey(payloads)
    assert webp.read_grey(media) == payloads
    for m, p in zip(media, payloads, strict=True):
        frames = webp.decode(m)
        assert b"".join(f[..., 2].tobytes() for f in frames) == p
        assert all((f[..., 1] == f[..., 2]).all() and (f[..., 3] == f[..., 2]).all() and (f[..., 0] == 255).all() for f in frames)
    lengths = webp.limited_lengths(np.array([1 << min(k, 40) for k in range(60)] + [0] * 196))
    assert lengths.max() <= webp.LIMIT and (2.0 ** -lengths[lengths > 0]).sum() == 1.0


def test_broken_media_are_refused():
    with pytest.raises(ValueError):
        webp.frames_of(b"RIFFxxxxJPEG")
    with pytest.raises(ValueError):
        webp.decode_vp8l(b"\x00" * 20)


def test_media_query_contract(spark):
    def check(rows, texts):
        assert len(rows) == len(texts)
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert r.feature and r.media_bytes > 0

    check(webp.round_trip(docs(spark, EDGE)).collect(), dict(enumerate(EDGE)))
    rows = webp.round_trip(docs(spark, ["same", "same"])).collect()
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[0].feature == rows[1].feature
    check(queries.op6_webp_media(spark, SF).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


def test_near_places():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7)
