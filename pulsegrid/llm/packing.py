"""Packing of documents into token sequences by lexical retrieval (operator 7).

A document is its token ids and an end id. Whole windows of a document are sequences of
their own; what remains of each is packed. Document frequencies, number and mean length are counted
over the whole table. The remainders are dealt by content into shards of ``shard_rows`` to twice as many
documents: each has keys of ``PARTS`` terms, drawn with its BM25 weights as odds by hashes that all documents share
(so two documents draw alike the more alike they are), and a shard is a run of neighbours in the order of one key;
where many documents have one key, its later terms and then a hash divide them (of repeated rows: of their places). Each shard holds a BM25 inverted
index over its documents' token ids. The longest unused remainder seeds a sequence; the index returns its best-scoring
unused neighbours for all its terms, which fill the window greedily. A neighbour that doesn't fit is cut at a multiple of ``GRID`` ids and its rest stays
in the index; the last room goes to the longest remainder that fits. There is a round for each entry of ``LEAST``:
a sequence is made where neighbours with that share of the seed's own score fill it, and what stays unused is dealt
again under another key; the last round packs everything. Neighbours are found by keys, so not all are: the README has
the measured share. Only counts, checksums and term frequencies travel
to the shards, never the ids: checksums of cut pieces follow from running ones, as CRCs are linear.

Defined cases: a null text is the empty text (its only id is the end id); repeated rows are packed
as rows of their own; a null doc_id is packed too; texts of any length are encoded whole; ties of length and of score
go by the order within the shard; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain
from struct import Struct
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm.bpe import Encoder
from pulsegrid.llm.shingles import mix
from pulsegrid.llm.storage import drop_files, materialise, slices

WINDOW, END_ID, GRID, SHARD_ROWS = 4096, 2, 32, 1024
#: Terms in more than this share of a shard's documents are scored by a matrix product (of the most frequent so many), all others by their lists; seeds and postings read at once.
DENSE_SHARE, DENSE_TERMS, SEEDS, POSTINGS = 1 / 16, 2048, 32, 1 << 19
K1, B = 1.2, 0.75
LEAST, PARTS = (0.7, 0.5, 0.0), 3
_KEYS = [f"key{k}" for k in range(len(LEAST) * PARTS)]
_POLY = 0xEDB88320
#: Bytes of text whose words are looked up at once, and of those whose ids are held at once; words a worker remembers between.
SLICE, ROOM, WORDS = 8 << 20, 2 << 20, 500_000
_WRITERS = [Struct(f"<{n}I").pack for n in range(64)]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, both bit-reversed."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


@lru_cache(maxsize=8192)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes, modulo the polynomial."""
    out, base = 1 << 31, 1 << 23  # 1 and x^8
    while n_bytes:
        if n_bytes & 1:
            out = _times(out, base)
        base = _times(base, base)
        n_bytes >>= 1
    return out


def crc_of_rest(whole: int, head: int, rest_bytes: int) -> int:
    """CRC-32 of a text's rest, from those of the whole text and of its head."""
    return whole ^ _times(_shift(rest_bytes), head)


class LibraryEncoder(Encoder):
    """The encoder's word memory over the tokenizers library: unseen words are tokenised by its BPE model."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        if len(self.names) > 1 << 16:
            raise ValueError("the index keeps terms of 16 bits: a vocabulary of at most 65,536 ids")
        del self._rules, self.tokens  # the library's model does the merges

    def _ids(self, marks: str) -> list[int]:
        return [t.id for t in self.model.tokenize(marks)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words; one that ends with a stop or comma after letters isn't remembered itself."""
        get, tokens, ends = self.get, self.model.tokenize, {c: self._pretoken(c) for c in ".,"}
        if len(self) > WORDS:
            self.clear()
        out = list(map(get, words))
        for at in [i for i, packed in enumerate(out) if packed is None]:
            word = words[at]
            last = ends.get(word[-1])
            stem = word if last is None else word[:-1]
            if not (stem.isascii() and stem.isalpha()):
                out[at] = self[word]
                continue
            packed = None if last is None else get(stem)
            if packed is None:  # letters: one pretoken, and its own stand-in
                ids = [t.id for t in tokens(stem)]
                packed = _WRITERS[n](*ids) if (n := len(ids)) < 64 else pack_ids(f"<{n}I", *ids)
                if len(stem) <= 64:
                    self[stem] = packed
            out[at] = packed if last is None else packed + last
        return out

    def encode_all(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """Ids of texts, each different word of them looked up once; they come in groups of about ``ROOM`` bytes of text.

        Cut at ASCII white space only; what other space a word holds is left to the pattern.
        """
        texts = [t or "" for t in texts.to_pylist()]
        plain = [None if "<|" in t else self._normal(t) for t in texts]
        lists = pa.compute.ascii_split_whitespace(pa.array(["" if t is None else t for t in plain], pa.string()))
        bounds, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        del lists
        packed = self._words([w or " " for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()])
        of_word = np.fromiter(map(len, packed), np.int32, len(packed)) >> 2
        first = np.cumsum(of_word, dtype=np.int32) - of_word
        ids, indices = np.frombuffer(b"".join(packed), "<u4"), words.indices.to_numpy()
        del packed
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(ROOM, ends[-1], ROOM)) + 1 if len(ends) else [], len(texts)].astype(int)).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at = indices[bounds[i] : bounds[j]]
            sizes = of_word[at]
            ends = np.cumsum(sizes, dtype=np.int64)
            place = np.repeat((first[at] - ends + sizes).astype(np.int32), sizes)
            place += np.arange(len(place), dtype=np.int32)
            own = ids[place]
            of_text = np.r_[0, ends][bounds[i : j + 1] - bounds[i]].tolist()
            yield [np.frombuffer(self.encode(t), "<u4") if p is None else own[x:y] for t, p, x, y in zip(texts[i:j], plain[i:j], of_text[:-1], of_text[1:], strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _forget() -> None:
    """Gives back a worker's encoder, which rounds don't need."""
    _encoder.cache_clear()
    pa.default_memory_pool().release_unused()


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document what packing needs: ids in all, CRCs of whole windows, running CRCs of the remainder, term counts."""
    schema = "doc_id long, doc_tokens long, windows binary, running binary, terms binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = _encoder(tokenizer_path), np.uint32(END_ID).tobytes()
        step, wide = 4 * GRID, 4 * WINDOW
        for batch in batches:
            for part in slices(batch, 1, 8192, SLICE):
                n, windows, running, terms, counts = [], [], [], [], []
                for own_ids in chain.from_iterable(enc.encode_all(part.column(1))):
                    packed = own_ids.tobytes() + end
                    n.append(len(packed) // 4)
                    whole = len(packed) // wide * wide
                    windows.append(np.array([zlib.crc32(packed[i : i + wide]) for i in range(0, whole, wide)], "<u4").tobytes())
                    view, crc, own = memoryview(packed)[whole:], 0, []
                    for i in range(0, len(view), step):
                        crc = zlib.crc32(view[i : i + step], crc)
                        own.append(crc)
                    running.append(np.array(own, "<u4").tobytes())
                    ids = np.sort(np.frombuffer(packed, "<u4").astype(np.uint16), kind="stable")  # a radix sort
                    heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                    terms.append(ids[heads].tobytes())
                    counts.append(np.diff(np.append(heads, len(ids))).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (windows, running, terms, counts))], ["doc_id", "doc_tokens", "windows", "running", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@dataclass
class Corpus:
    """What BM25 needs of all documents; bounded by the vocabulary."""

    n: int
    df: np.ndarray
    mean_length: float

    def idf(self) -> np.ndarray:
        """A term in more than half of the documents says nothing: its weight is 0."""
        return np.maximum(0.0, np.log((self.n - self.df + 0.5) / (self.df + 0.5)))

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf()[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.mean_length, 1.0)))


def _flat(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and frequency of every posting."""
    term = np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    return term, doc, np.concatenate(counts).astype(np.float32) if terms else np.zeros(0, np.float32)


def _binary(column: pa.ChunkedArray | pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def corpus_of(rows: DataFrame) -> Corpus:
    """Counts over all digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        df, n, ids = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            n, ids = n + batch.num_rows, ids + (pa.compute.sum(batch.column(0)).as_py() or 0)
            df += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2"), minlength=1 << 16)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, term]), pa.array(np.r_[n, ids, df[term]])], ["term", "count"])

    got = dict(rows.select("doc_tokens", "terms").mapInArrow(run, "term long, count long").groupBy("term").agg(F.sum("count")).collect())
    n, ids, df = got.pop(-2, 0), got.pop(-1, 0), np.zeros(1 << 16, np.int64)
    df[list(got)] = list(got.values())
    return Corpus(n, df, ids / max(n, 1))


@lru_cache(maxsize=1)
def _odds() -> np.ndarray:
    """For each part of a key and each term an exponential variate that all documents share."""
    h = mix(np.arange(len(_KEYS) << 16, dtype=np.uint64) + np.uint64(1))
    return -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)).reshape(len(_KEYS), 1 << 16)


def keys_of(corpus: Corpus, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """A row of term ids per part of a key: the term with the least variate for its weight (-1: no term has weight)."""
    out = np.full((len(_KEYS), len(terms)), -1, np.int32)
    term, doc, tf = _flat(terms, counts)
    weight = corpus.weights(term, tf, lengths[doc])
    term, doc, weight = term[weight > 0], doc[weight > 0], weight[weight > 0]
    if len(term):
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sizes = np.diff(np.r_[heads, len(doc)])
        for part, own in enumerate(_odds()):
            x = own[term] / weight
            at = np.flatnonzero(x == np.repeat(np.minimum.reduceat(x, heads), sizes))
            out[part, doc[at]] = term[at]
    return out


class Index:
    """BM25 over one shard; what is known of all documents comes from ``corpus`` (by default the shard is all there is).

    Weights are multiples of 2^-20, so sums are exact in any order and equal texts have equal scores. Long lists are columns
    of a matrix, the others are added as lists; several seeds are scored at once. Every term of a seed counts.
    """

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, corpus: Corpus | None = None):
        n = len(terms)
        term, doc, tf = _flat(terms, counts)
        corpus = corpus or Corpus(n, np.bincount(term, minlength=1 << 16), float(lengths.mean()) if n else 0.0)
        weight = np.rint(np.ldexp(corpus.weights(term, tf, lengths[doc]), 20))
        keep = weight > 0
        term, doc, weight = term[keep], doc[keep], np.ldexp(weight[keep], -20)
        sizes = np.bincount(term, minlength=1 << 16)
        often = np.flatnonzero(sizes > n * DENSE_SHARE)
        often = often[np.argsort(-sizes[often], kind="stable")[:DENSE_TERMS]]
        column = np.full(1 << 16, -1, np.int32)
        column[often] = np.arange(len(often))
        dense = column[term] >= 0
        self.n, self.matrix, self.held = n, np.zeros((n, len(often))), {}
        self.matrix[doc[dense], column[term[dense]]] = weight[dense]
        term, doc, weight = term[~dense], doc[~dense], weight[~dense]
        self.term, self.heads = term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term.astype(np.uint16), kind="stable")  # a radix sort
        self.doc, self.weight = doc[order], weight[order]
        sizes = np.bincount(term, minlength=1 << 16)
        self.bounds = np.r_[0, np.cumsum(sizes)]
        self.postings = np.diff(np.r_[0, np.cumsum(sizes[term])][self.heads])  # on the lists of each document's terms

    def scores(self, seed: int, later: Sequence[int] = ()) -> np.ndarray:
        """Each document's score for the seed's terms; ``later``: seeds that will likely be asked for next."""
        if seed not in self.held:
            asked = np.array(list(dict.fromkeys([seed, *later])))
            asked = asked[: max(1, int(np.searchsorted(np.cumsum(self.postings[asked]), POSTINGS)))]
            sizes = self.heads[asked + 1] - self.heads[asked]
            query = np.concatenate([self.term[self.heads[d] : self.heads[d + 1]] for d in asked.tolist()])
            runs = self.bounds[query + 1] - self.bounds[query]
            at = np.repeat(self.bounds[query] - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
            cell = np.repeat(np.repeat(np.arange(len(asked)) * self.n, sizes), runs) + self.doc[at]
            both = np.bincount(cell, self.weight[at], minlength=len(asked) * self.n).reshape(-1, self.n)
            both = both + (self.matrix[asked] > 0).astype(float) @ self.matrix.T
            self.held = dict(zip(asked.tolist(), both, strict=True))
        return self.held[seed]


def pack_shard(doc_tokens: np.ndarray, windows: list[np.ndarray], running: list[np.ndarray], terms: list[np.ndarray], counts: list[np.ndarray], corpus: Corpus | None = None, done: np.ndarray | None = None, least: float = 0.0) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (row, start, length, crc, sequence, offset) of one shard's documents; ``done`` (ids of each remainder that are packed) is kept up to date."""
    pieces, sequence = [], 0
    for row, own in enumerate(windows):
        for k, crc in enumerate(own.tolist()):
            pieces.append((row, k * WINDOW, WINDOW, crc, sequence, 0))
            sequence += 1
    index = Index(terms, counts, doc_tokens.astype(np.float64), corpus)
    base = doc_tokens // WINDOW * WINDOW
    full = doc_tokens - base
    done = np.zeros(len(full), np.int64) if done is None else done
    left = full - done
    crcs = [r.tolist() for r in running]

    def take(row: int, ids: int, offset: int) -> None:
        a, b = int(done[row]), int(done[row]) + ids
        crc = crcs[row][-(-b // GRID) - 1]
        if a:
            crc = crc_of_rest(crc, crcs[row][a // GRID - 1], 4 * ids)
        pieces.append((row, int(base[row]) + a, ids, crc, sequence, offset))
        done[row] += ids
        left[row] -= ids

    order = np.argsort(-left, kind="stable").tolist()
    for turn, seed in enumerate(order):
        while left[seed] > 0:
            if left[seed] < WINDOW - GRID:
                later = [r for r in order[turn + 1 : turn + 8 * SEEDS] if 0 < left[r]][: SEEDS - 1] if seed not in index.held else ()
                scores = index.scores(seed, later)
            else:
                scores = np.zeros(index.n)
            ranked = np.flatnonzero((scores > 0) & (scores >= least * scores[seed]) & (left > 0))
            ranked = ranked[ranked != seed]
            if least and left[seed] + left[ranked].sum() <= WINDOW - GRID:
                break  # left for another round
            ranked = ranked[np.argsort(-scores[ranked], kind="stable")]
            take(seed, int(left[seed]), 0)
            used = int(pieces[-1][2])
            for row in ranked.tolist():
                if WINDOW - used < GRID:
                    break
                ids = int(left[row]) if left[row] <= WINDOW - used else (WINDOW - used) // GRID * GRID
                take(row, ids, used)
                used += ids
            while used < WINDOW:  # no neighbours are left: what fits best, or a part of the longest
                fits = np.where(left <= WINDOW - used, left, 0)
                row = int(fits.argmax())
                if WINDOW - used >= GRID and left.max() > WINDOW - used:
                    row = int(left.argmax())
                    ids = (WINDOW - used) // GRID * GRID
                elif fits[row] > 0:
                    ids = int(fits[row])
                else:
                    break
                take(row, ids, used)
                used += ids
            sequence += 1
    return pieces


def _with_keys(rows: DataFrame, corpus) -> DataFrame:
    names = [*rows.columns, *_KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = keys_of(corpus.value, _binary(part.column("terms"), "<u2"), _binary(part.column("counts"), "<u4"), part.column("doc_tokens").to_numpy().astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, keys)], names)

    return rows.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields], *[f"{k} int" for k in _KEYS]]))


def _dealt(rows: DataFrame, turn: int, partitions: int) -> DataFrame:
    """Rows of a written table in the order of the key of a round, by ranges; equal keys are divided by a hash, repeated rows by their places in the table."""
    order = [*_KEYS[turn * PARTS : (turn + 1) * PARTS], "_salt"]
    ranged = rows.withColumn("_salt", F.xxhash64("doc_id", "running", "_metadata.row_index")).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return ranged.drop("_salt").withColumn("_part", F.spark_partition_id().cast("long"))


def _shards(batches: Iterator[pa.RecordBatch], shard_rows: int) -> Iterator[pa.Table]:
    """Runs of ``shard_rows`` rows; the last of a partition has up to twice as many, so none is small."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= 2 * shard_rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, shard_rows)
            held = table.slice(shard_rows).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, tokenizer_path: str, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    digest = materialise(digests(docs, tokenizer_path), "digests")
    counted = corpus_of(digest)
    corpus = docs.sparkSession.sparkContext.broadcast(counted)
    partitions = max(1, counted.n // (4 * shard_rows))
    rows = materialise(_with_keys(digest, corpus).withColumn("done", F.lit(0).cast("long")), "keyed")
    drop_files(digest)
    piece = "start long, length long, ids_crc32 long, sequence_id long, offset long"

    def pieces_of(turn: int, rows: DataFrame) -> DataFrame:
        names, last = rows.columns, turn == len(LEAST) - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = 0
            _forget()
            for table in _shards(batches, shard_rows):
                tokens, done = table.column("doc_tokens").to_numpy(), table.column("done").to_numpy().copy()
                windows, running, terms, counts = (_binary(table.column(n), k) for n, k in (("windows", "<u4"), ("running", "<u4"), ("terms", "<u2"), ("counts", "<u4")))
                pieces = pack_shard(tokens, [] if turn else windows, running, terms, counts, corpus.value, done, LEAST[turn])
                base = (turn << 56) + (table.column("_part")[0].as_py() << 32) + first
                first += max((p[4] for p in pieces), default=-1) + 1
                p = np.array(pieces, np.int64).reshape(-1, 6)
                p = p[np.argsort(p[:, 0], kind="stable")]
                p[:, 4] += base
                fields = pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(1, 6)], [f.split()[0] for f in piece.split(", ")])
                own = pa.ListArray.from_arrays(pa.array(np.searchsorted(p[:, 0], np.arange(len(tokens) + 1)), pa.int32()), fields)
                out = {n: table.column(n) for n in names} | {"done": pa.array(done), "pieces": own}
                kept = pa.array(np.arange(len(done)), mask=(done == tokens % WINDOW) | last)
                for n in ("windows", "running", "terms", "counts"):  # not needed any more
                    out[n] = out[n].take(kept)
                yield from pa.table(out).to_batches()

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return _dealt(rows, turn, partitions).mapInArrow(run, f"{fields}, pieces array<struct<{piece.replace(' long', ':bigint')}>>")

    rounds = []
    for turn in range(len(LEAST)):
        after = pieces_of(turn, rows)
        if turn < len(LEAST) - 1:
            after = materialise(after, "packed")
            if not turn:
                drop_files(rows)
            rows = after.filter(F.col("done") < F.col("doc_tokens") % WINDOW).drop("pieces")
        rounds.append(after.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")))
    out = reduce(DataFrame.unionAll, rounds)
    return out.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")
