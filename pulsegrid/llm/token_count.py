"""Token counts of whole texts, huge ones by overlap resynchronisation (operator 8).

A text of up to ``chunk`` characters is encoded at once. A longer one is encoded in
overlapping chunks with offsets. Two neighbouring encodings are spliced at a *stable*
boundary inside their overlap: a place between two characters that no piece of the vocabulary
holds side by side (read from the model: a space after another character is one in the usual models, and so are many pairs inside of words), so
no merge can cross such a place whatever stands around it. The
splice also needs the two encodings to agree on all tokens from that boundary to the
next stable one; while they don't, the overlap is doubled. If no stable place lies in a chunk, it is taken together
with all up to the next stable places, in one step, so a text is encoded twice at most however few of them it has.

Defined cases: a null text counts as the empty one (no bytes, no tokens); special strings
in a text are ordinary text, the library's default; repeated rows give repeated rows; rows without doc_id keep their row; an empty
table gives no rows; a text without any stable place (one letter repeated) is encoded whole; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 16_384, 256


class Counter:
    """Counts the pieces of a sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i).replace("▁", " ") for i in range(self.model.vocab_size())]
        #: Two characters that some piece holds side by side; places between all others are stable.
        self.joined = frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1))

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of one text, in memory that ``chunk`` bounds as long as boundaries turn up."""
        if len(text) <= chunk:
            return len(self.model.encode(text, num_threads=1))
        total, start, floor = 0, 0, 0  # tokens before ``floor`` are counted; the chunk at hand starts at ``start``
        here = self._offsets(text, 0, chunk)
        end = min(chunk, len(text))
        while end < len(text):
            back = overlap
            while True:
                begin = max(floor, end - back)
                stop = min(len(text), end + chunk)
                after = self._offsets(text, begin, stop)
                cut = self._splice(text, here, after, begin, end)
                if cut is not None or begin <= floor:
                    break
                back *= 2
            if cut is None:  # the whole chunk holds no two stable places: take it together with what comes up to the next ones
                end = min(len(text), self._next_places(text, stop) + overlap)
                here = self._offsets(text, start, end)
                continue
            total += sum(floor <= b < cut for b in here)
            here, start, floor, end = after, begin, cut, stop
        return total + sum(b >= floor for b in here)

    def _stable(self, text: str, p: int) -> bool:
        """Whether no piece can cross the place before ``text[p]``; spaces in a row are left out, for the normaliser's sake."""
        pair = text[p - 1 : p + 1]
        return pair not in self.joined and pair.isascii() and pair[0] != " " and pair.isprintable()

    def _next_places(self, text: str, at: int) -> int:
        """Past the second stable place from ``at`` on."""
        seen = 0
        for p in range(max(at, 1), len(text)):
            if self._stable(text, p):
                seen += 1
                if seen == 2:
                    return p + 1
        return len(text)

    def _offsets(self, text: str, start: int, end: int) -> list[int]:
        """Where in ``text`` each token of text[start:end] begins."""
        found = self.model.encode(text[start:end], return_type="proto", num_threads=1)
        return list(accumulate((len(p.surface) for p in found.pieces), initial=start))[:-1]

    def _splice(self, text: str, left: list[int], right: list[int], begin: int, end: int) -> int | None:
        """A stable place in [begin, end) after which both encodings have the same tokens up to the next stable place."""
        places = [p for p in range(max(begin + 1, 1), end) if self._stable(text, p)]
        ends, starts = set(left), set(right)
        for a, b in zip(places, places[1:], strict=False):
            if a in ends and a in starts and [x for x in left if a <= x < b] == [x for x in right if a <= x < b]:
                return a
        return None


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each worker process and model."""
    return Counter(path)


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Returns ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` for every row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few at a time: a token's number takes more room than its text
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                short = [t for t in texts if len(t) <= chunk]
                counted = iter(list(map(len, c.model.encode(short, num_threads=1))) if short else [])
                n = [next(counted) if len(t) <= chunk else c.count(t, chunk, overlap) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
