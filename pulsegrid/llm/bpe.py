"""BPE encoding and decoding by a bounded-lookahead streaming transducer (operator 10).

A byte-pair encoding of a pretoken is the only way to write it as tokens in which every
two neighbours are *compatible*, that is, encoding the two together gives just the two
back. Hence the last token of every prefix follows from the last tokens of
shorter prefixes, and a pretoken is read left to right in one pass by ``Transducer``. The encoding of
whatever comes later passes through one of the last ``window`` places (the longest
token's length), so all tokens before the point where those places' back pointers
meet are stable and are emitted. ``Merges.lookahead`` is the number of symbols
that the merge list can need at most before they meet: each time so many are
waiting the pass settles, so what it holds doesn't grow. Every pretoken takes this way; a worker
remembers what came out for short ones. Texts are read in blocks, and ids go to
the digests and through ``Decoder`` (an incremental state machine) as they come.

Defined cases: a null text is the empty text and has no ids; strings of added tokens in
a text become their ids, as the library does by default; texts of any length are read
block by block, with or without spaces, in constant memory beside the text; an empty table gives no rows; rows
without doc_id keep their row; equal texts give equal rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker remembers; the memory is emptied when full, which changes no result.
CACHE_WORDS = 1_000_000
#: Characters of a text that are read at once.
BLOCK = 1 << 16
#: Control characters that str.split() takes as white space and Unicode's White_Space does not.
ODD_SPACES = regex.compile(r"[\x1c-\x1f]")
SPACE, LETTERS, OTHERS, NUMBER = regex.compile(r"\s"), regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+"), regex.compile(r"\p{N}")


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: printable ones stay, others count up from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)}


class Merges:
    """A merge list with what its transducer needs: how tokens came about, and which two may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, the merge's rank
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((i, j), r)
            self.parts.setdefault(k, (i, j, r))
        length = {i: len(s.removesuffix(end)) if end and s != end else len(s) for s, i in vocab.items()}
        made = [length[k] for k in self.parts] or [1]
        #: Longest token in symbols: what comes next passes through one of so many last positions.
        self.window = max(made)
        #: Every beginning of a token, without the end mark: a pass stops where no token goes on.
        self.heads = {s[:k] for s in (x.removesuffix(end) if end else x for x in vocab) for k in range(1, len(s) + 1)}
        depth: dict[int, int] = {}
        for k, (i, j, _) in sorted(self.parts.items(), key=lambda x: x[1][2]):
            depth[k] = 1 + max(depth.get(i, 0), depth.get(j, 0))
        #: Sufficient lookahead: a boundary's token can be undone by merges on its right spine alone, each of
        #: which reaches at most one token further.
        self.lookahead = self.window * (1 + max(depth.values(), default=0))
        self._spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The pieces at a token's right (or left) edge in time's order, each with the rank of the merge that ends it."""
        found = self._spines.get((token, right))
        if found is None:
            found, death, t = [], float("inf"), token
            while True:
                found.append((t, death))
                if t not in self.parts:
                    break
                left, last, death = self.parts[t]
                t = last if right else left
            found.reverse()
            self._spines[token, right] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge joins the edges of ``a`` and ``b`` before both are complete."""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            left, right, i, j, known = self._spine(a, True), self._spine(b, False), 0, 0, True
            while i < len(left) and j < len(right):
                (x, ends_x), (y, ends_y) = left[i], right[j]
                r = self.rank.get((x, y))
                if r is not None and r < ends_x and r <= ends_y:  # of equal ranks the leftmost pair is merged first
                    known = False
                    break
                if ends_x <= ends_y:
                    i += 1
                else:
                    j += 1
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether the token's own string is encoded as just this token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = token not in self.parts or (self.whole(self.parts[token][0]) and self.whole(self.parts[token][1]) and self._meets(token))
        return known

    def _meets(self, token: int) -> bool:
        """Whether, within the token's string, nothing crosses its last split before that split's own merge."""
        a, b, r = self.parts[token]
        left, right, i, j = self._spine(a, True), self._spine(b, False), 0, 0
        while i < len(left) and j < len(right):
            (x, ends_x), (y, ends_y) = left[i], right[j]
            if (x, y) != (a, b) and (q := self.rank.get((x, y))) is not None and q < ends_x and q <= ends_y:
                return False
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1
        return True

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """The ids of one pretoken, emitted as soon as they are stable; ``symbols`` are its stand-in characters, in pieces of any size."""
        run = Transducer(self)
        for piece in symbols:
            yield from run.feed(piece)
        yield from run.feed("", True)


class Transducer:
    """The left-to-right pass over one pretoken. Keeps at most the symbols and back pointers of three lookaheads."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.text = ""  # symbols from the first unstable place on
        self.last, self.start = [0], [0]  # per place: the token that ends there and where it began, -1 where none does
        self.at = 0  # the next place whose tokens are to be found
        self.whole = True  # nothing has been emitted

    def feed(self, symbols: str, final: bool = False) -> list[int]:
        """Reads more symbols; gives the ids that no later symbol can change, at the end all that are left."""
        m = self.merges
        text = self.text = self.text + symbols if self.text else symbols
        n, window, vocab, known, heads, end = len(text), m.window, m.vocab, m._fits, m.heads, m.end
        if final and self.whole and not self.at:
            t = vocab.get(text + end)
            if t is not None and m.whole(t):
                return [t]
        last, start = self.last, self.start
        grown = n + 1 - len(last)
        last.extend([0] * grown)
        start.extend([-1] * grown)
        out: list[int] = []
        s, stop = self.at, n if final else n - window  # the last symbol of a pretoken carries the end mark: tokens are found a window behind
        while s < stop:
            if start[s] >= 0:
                before = last[s]
                for e in range(s + 1, min(n, s + window) + 1):
                    piece = text[s:e]
                    if piece not in heads:
                        break
                    if start[e] < 0 and (t := vocab.get(piece if e < n or not final else piece + end)) is not None:
                        if s or not self.whole:
                            fit = known.get(before << 20 | t)
                            if fit is None:
                                fit = m.fits(before, t)
                            if not fit:
                                continue
                        if m._whole.get(t) or m.whole(t):
                            last[e], start[e] = t, s
            s += 1
        self.at = s
        if final:
            return self._path(n)
        if s > 2 * m.lookahead:
            out = self._settle()
        return out

    def _path(self, e: int) -> list[int]:
        path = []
        while e > 0:
            path.append(self.last[e])
            e = self.start[e]
        return path[::-1]

    def _settle(self) -> list[int]:
        """Tokens before the place where the back pointers of all live places meet; by the lookahead it lies at most that far back."""
        live = {e for e in range(self.at, min(self.at + self.merges.window, len(self.last))) if self.start[e] >= 0}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(self.start[top])
        meet = live.pop()
        path = self._path(meet)
        if meet:
            self.whole = False
            self.text = self.text[meet:]
            self.last = self.last[meet:]
            self.start = [x - meet if x >= meet else -1 for x in self.start[meet:]]
            self.start[0] = 0
            self.at -= meet
        return path


class Encoder(dict):
    """Ids of white-space-separated words as packed little-endian 32-bit integers, remembered per word.

    Follows the tokenizer file: added tokens are cut out first, then NFC, lower case per character, the split
    pattern, and byte-level BPE with an end-of-word mark.
    """

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._rules = model["vocab"], merges, model.get("end_of_word_suffix") or ""
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.tokens = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.added.items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.stand_in = byte_alphabet()
        self.byte_of = {c: b for b, c in self.stand_in.items()}
        self.table = {b: c for b, c in self.stand_in.items()}
        self.longest = max(map(len, self.added), default=0)

    @cached_property
    def merges(self) -> Merges:
        return Merges(*self._rules)

    def _marks(self, word: str) -> str:
        """A word's bytes as stand-in characters; ASCII letters stand for themselves."""
        return word if word.isascii() and word.isalpha() else "".join([self.stand_in[b] for b in word.encode()])

    def _ids(self, marks: str) -> list[int]:
        return Transducer(self.merges).feed(marks, True)

    def _pretoken(self, word: str) -> bytes:
        """Packed ids of one pretoken; each is remembered like the word that consists of it alone."""
        packed = self.get(word)
        if packed is None:
            packed = self._keep(word, pack("<%dI" % len(ids := self._ids(self._marks(word))), *ids))
        return packed

    def _keep(self, word: str, packed: bytes) -> bytes:
        if len(word) <= 64:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def __missing__(self, word: str) -> bytes:
        # letters below U+0130: such a word is one pretoken, a last stop or comma another
        stem = word[:-1] if word[-1] in ".," else word
        parts = ([word] if stem is word else [stem, word[-1]]) if stem.isalpha() and max(stem) < "\u0130" else self.pattern.findall(word)
        if len(parts) == 1 and parts[0] == word:
            return self._pretoken(word)
        return self._keep(word, b"".join(map(self._pretoken, parts)))

    @staticmethod
    def _normal(text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _plain(self, text: str) -> bytes:
        """Packed ids of a piece without added tokens that no pretoken crosses the edges of."""
        text = self._normal(text)
        if ODD_SPACES.search(text):
            return b"".join(map(self._pretoken, self.pattern.findall(text)))
        return b"".join(map(self.__getitem__, text.split()))

    def _piece(self, text: str) -> bytes:
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        return b"".join(np.uint32(self.added[s]).tobytes() if k % 2 else self._plain(s) for k, s in enumerate(self.cut.split(text)))

    def encode(self, text: str | None) -> bytes:
        """A whole text's ids, packed."""
        return b"".join(self.pieces([text])) if text else b""

    def pieces(self, text: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text that comes in blocks, as they get stable; what is held back has a fixed bound.

        Blocks are put together up to a white space. Where none comes for ``BLOCK`` characters, one is read
        by :class:`_Run`, pretoken by pretoken.
        """
        held, run = "", None
        for block in text:
            held = held + block if held else block
            while run is not None or len(held) > BLOCK:
                if run is None:
                    at = max((m.end() for m in SPACE.finditer(held)), default=0)
                    if at:
                        yield self._piece(held[:at])
                        held = held[at:]
                        if len(held) <= BLOCK:
                            break
                        continue
                    run = _Run(self)
                space = SPACE.search(held)
                if space is None:
                    if len(held) < 256:
                        break
                    at = run.edge(held)
                    yield run.feed(held[:at])
                    held = held[at:]
                    break
                yield run.feed(held[: space.start()]) + run.finish()
                held, run = held[space.end() :], None
        if run is not None:
            yield run.feed(held) + run.finish()
        elif held:
            yield self._piece(held)

    def decode(self, packed: bytes) -> str:
        """As the library with no decoder in the tokenizer file: the tokens' own strings with spaces between."""
        state = Decoder(self)
        return state.feed(packed) + state.finish()

    def decode_text(self, packed: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece."""
        state = Decoder(self, readable=True)
        for i in packed:
            if out := state.feed(pack("<I", i)):
                yield out
        if rest := state.finish():
            yield rest


class _Run:
    """A stretch without white space that is too long to hold: its pretokens are fed to the transducer as they come."""

    def __init__(self, enc: Encoder):
        self.enc, self.kind, self.open, self.rest = enc, "", None, ""

    def edge(self, text: str) -> int:
        """The last place where the text can be cut: no added token crosses it, and normal forms don't depend on what follows."""
        at = len(text) - self.enc.longest
        while at > 1 and (unicodedata.combining(text[at]) or text[at] in joining()):
            at -= 1
        if self.enc.cut is not None:
            for m in self.enc.cut.finditer(text, max(0, at - self.enc.longest)):
                if m.start() < at < m.end():
                    at = m.start()
        return at

    def feed(self, text: str) -> bytes:
        enc, out = self.enc, []
        for k, s in enumerate(enc.cut.split(text) if enc.cut is not None and "<|" in text else [text]):
            if k % 2:
                out += [self.finish(), np.uint32(enc.added[s]).tobytes()]
            else:
                out.append(self._letters(enc._normal(s)))
        return b"".join(out)

    def _letters(self, text: str) -> bytes:
        """Pretokens of a normal form that goes on where the last one ended."""
        enc, out, at = self.enc, [], 0
        text = self.rest + text
        self.rest = ""
        if self.open is not None:
            m = (LETTERS if self.kind == "letters" else OTHERS).match(text)
            at = m.end() if m else 0
            out.append(self._step(text[:at], at < len(text)))
        hold = len(text)
        if (quote := text.rfind("'", max(at, len(text) - 2))) >= 0:
            hold = quote  # the letters of a short form may still come
        while at < len(text):
            m = enc.pattern.match(text, at)
            if m is None:  # an odd space of Python's
                at += 1
                continue
            if m.start() >= hold:
                self.rest = text[at:]
                break
            if m.end() < len(text):
                out.append(enc._pretoken(m[0]) if len(m[0]) <= 64 else pack("<%dI" % len(ids := enc._ids(enc._marks(m[0]))), *ids))
                at = m.end()
                continue
            if NUMBER.match(m[0]) or len(m[0]) > 1 and m[0][0] == "'" and m[0][1].isalpha():  # whole, whatever comes: a digit, or a short form
                out.append(enc._pretoken(m[0]))
            else:
                self.kind, self.open = "letters" if LETTERS.match(m[0]) else "others", Transducer(enc.merges)
                out.append(self._step(m[0], False))
            break
        return b"".join(out)

    def _step(self, part: str, final: bool) -> bytes:
        ids = self.open.feed(self.enc._marks(part), final)
        if final:
            self.open = None
        return pack("<%dI" % len(ids), *ids)

    def finish(self) -> bytes:
        """What is left at a white space, an added token or the end."""
        out = b""
        if self.open is not None:
            out = self._step("", True)
        if self.rest:
            out += b"".join(map(self.enc._pretoken, self.enc.pattern.findall(self.rest)))
            self.rest = ""
        return out


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that a canonical composition can take as its second: a text isn't cut before them."""
    pairs = (unicodedata.decomposition(chr(c)) for c in range(0x80, 0x20000))
    return frozenset(chr(int(d.split()[1], 16)) for d in pairs if d and d[0] != "<" and " " in d) | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


class Decoder:
    """Ids to text, incrementally, in one of two forms.

    The library's own (no decoder in the file): token strings, a space between two. Readable: stand-ins become
    bytes, and an incremental UTF-8 decoder holds back characters whose bytes haven't all come; an end-of-word mark
    becomes a space, an added token its own string.
    """

    def __init__(self, enc: Encoder, *, readable: bool = False):
        self.enc, self.readable, self.begun = enc, readable, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        """The text that these ids make certain."""
        if not packed:
            return ""
        ids = np.frombuffer(packed, "<u4").tolist()
        if not self.readable:
            text = " ".join(map(self.enc.names.__getitem__, ids))
            if self.begun:
                text = " " + text
            self.begun = True
            return text
        out, end, added = [], self.enc.merges.end, self.enc.added.values()
        for i in ids:
            name = self.enc.names[i]
            if i in added:
                out += [self.state.decode(b"", True), name]
                continue
            ends = bool(end) and name.endswith(end)
            out += [self.state.decode(bytes([self.enc.byte_of[c] for c in (name[: -len(end)] if ends else name)]), ends), " " * ends]
        return "".join(out)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def blocks_of(value: pa.StringScalar) -> Iterator[str]:
    """A text's characters in blocks, read from its UTF-8 bytes where they lie."""
    data = value.as_buffer()
    if data is None:
        return
    if data.size <= 4 * BLOCK:
        yield value.as_py()
        return
    state, view = codecs.getincrementaldecoder("utf-8")(), memoryview(data)
    for at in range(0, len(view), BLOCK):
        yield state.decode(view[at : at + BLOCK], at + BLOCK >= len(view))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    return Encoder(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``with_ids``, ``ids``
    (array of int) and ``decoded``. The path must be readable on the executors.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, ids_hash, text_hash, ids, decoded = [], [], [], [], []
                for value in part.column(1):
                    n, of_ids, of_text, state, kept = 0, hashlib.sha256(), hashlib.sha256(), Decoder(enc), []
                    for packed in enc.pieces(blocks_of(value)):
                        text = state.feed(packed)
                        n += len(packed) // 4
                        of_ids.update(packed)
                        of_text.update(text.encode())
                        if with_ids:
                            kept.append((packed, text))
                    counts.append(n)
                    ids_hash.append(of_ids.hexdigest())
                    text_hash.append(of_text.hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(b"".join(p for p, _ in kept), "<u4").astype("i4"))
                        decoded.append("".join(t for _, t in kept))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return base.mapInArrow(run, schema)
