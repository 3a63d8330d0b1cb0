"""What the media column's encoder writes: back-references and palettes, read back by both decoders."""

import random

import numpy as np
import pytest

from pulsegrid.llm import minhash, webp


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def kinds(payload: bytes) -> list[str]:
    """How each frame of a payload is stored."""
    out = []
    for i, j in webp.frames_of(media := webp.encode_grey([payload])[0]):
        head = webp._plain_head(media[i:j])
        out.append("palette" if head is None else "repeats" if head[3][256:].any() else "plain")
    return out


def test_every_form_round_trips_through_both_decoders():
    rng = random.Random(1)
    word = lambda k: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=k))
    line = word(90)
    payloads = [
        b"", b"x" * 5000, bytes(range(256)) * 40, line * 100, word(3000), word(700) + line + word(700) + line + line, b"01" * 3000, b"0123456789abcdef" * 7,
        word(50) + b"-" * 9000 + word(50), *(bytes(rng.choices(b"ab cd"[: rng.randint(1, 5)], k=rng.randint(0, 6000))) for _ in range(40)),
        *(b"".join(rng.choice([line[rng.randint(0, 40) :], word(rng.randint(1, 200))]) for _ in range(rng.randint(1, 60))) for _ in range(40)),
    ]
    payloads = [padded(p) for p in payloads]
    media = webp.encode_grey(payloads)
    assert webp.read_grey(media) == payloads
    assert [b"".join(f[..., 2].tobytes() for f in webp.decode(m)) for m in media] == payloads
    for m in media:
        assert all((f[..., 0] == 255).all() and (f[..., 1] == f[..., 2]).all() and (f[..., 3] == f[..., 2]).all() for f in webp.decode(m))
    assert media == [webp.encode_grey([p])[0] for p in payloads]


def test_forms_are_used_where_they_are_smaller():
    rng = random.Random(2)
    text = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=2000))
    assert kinds(padded(text)) == ["plain"] and kinds(padded(text + text)) == ["repeats"]
    assert kinds(padded(b"")) == ["palette"] and kinds(padded(bytes(rng.choices(b"0123", k=3000)))) == ["palette"]
    assert len(webp.encode_grey([padded(text + text)])[0]) < 0.6 * 2 * len(webp.encode_grey([padded(text)])[0])


@pytest.mark.parametrize("value", [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 121, 4095, 4096, 4216])
def test_prefix_is_the_inverse_of_value(value):
    symbol, extra, bits = webp._prefix(value)
    assert webp._value(webp.Bits(extra.to_bytes(8, "little")), symbol) == value and bits == max(0, symbol - 2 >> 1)


def test_repeats_are_true_and_do_not_overlap():
    rng = np.random.default_rng(4)
    for _ in range(200):
        frame = rng.integers(0, rng.integers(1, 4), 64 * rng.integers(1, 20)).astype(np.uint8)
        end = 0
        for at, length, back in webp.repeats(frame):
            assert at >= end and length >= webp.MATCH and 0 < back <= at
            assert (frame[at : at + length] == frame[at - back : at - back + length]).all()
            end = at + length


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, media int, `a.b` int")
    assert webp.round_trip(none).collect() == [] and minhash.fingerprints(none).collect() == []
