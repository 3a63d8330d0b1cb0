"""Toxicity scores: a learned lexicon, misspellings by Levenshtein automata, and context windows (operator 2).

The lexicon is learned from labelled documents: words, and stems that begin words, that
toxic documents hold far more often than clean ones. It is kept as a trie. A Levenshtein
automaton of one edit (two for terms of nine letters or more) is intersected with the trie;
the product is determinised lazily, so a word costs one table step per letter and most
words die after a few. A token is looked up by each of its runs of letters and, where digits or marks
stand amid them, by all its letters in one. Every hit gets a context: hits between quotation marks within a
window of words count as quoted, the others as used, and hits near each other add up to a
window score. A logistic regression on a document's eight figures gives its score.

A quotation runs from a token that begins with a mark to the next that ends with one of its kind (single or
double; a mark after the word or its punctuation ends, one before it begins). A hit inside one whose both marks are within the
window is quoted; an opening mark without an end, or a place between two quotations, quotes nothing.

Lexicon and regression are fitted on at most ``max_rows`` labelled rows (a documented bound;
those with the lowest hash of doc_id), without held-out rows. Neither labels nor lang,
source or doc_id enter a score.

Defined cases: a null text is the empty text and gets the score of a text without hits;
labels other than 0 and 1 are ignored, of several labels for one document the highest counts;
a null doc_id counts as the empty string for the fold; with no labels of one kind all scores
are the share of toxic labels (0 without labels); repeated rows give repeated rows; an empty table gives no rows; time and memory
grow linearly with a text's length; other columns are kept by ``score``, but for ``score`` and ``predicted``, which it replaces.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.llm.storage import materialise, plain_column, slices

FOLDS, WINDOW, CACHE_WORDS = 5, 10, 200_000
#: Trie places in the automaton's known states; beyond, states are found anew, which changes no result.
STATE_PLACES = 1_000_000
LETTERS = regex.compile(r"[^\W\d_]+")
#: Quotation marks before and after a token, with its other punctuation.
OPENS, CLOSES = regex.compile(r"^[(\[{¿¡]*([\"“”„«»‟'‘’‚‹›])"), regex.compile(r"([\"“”„«»‟'‘’‚‹›])[)\]}.,;:!?…]*$")
SINGLE = frozenset("'‘’‚‹›")
FIGURES = 8


def runs_of(token: str) -> list[str]:
    """A token's runs of letters in lower case."""
    return LETTERS.findall(token.lower())


def spellings(token: str) -> tuple[list[str], str]:
    """The words to look up for a token: its runs of letters, and, where digits or marks stand amid them (st*pid, w0rd), the runs in one."""
    runs = runs_of(token)
    return [w for w in runs if len(w) > 2], "".join(runs) if len(runs) > 1 else ""


def terms_of(text: str) -> set[str]:
    """Words and, marked with a trailing ``*``, their beginnings of four to six letters."""
    words = {w for t in set(text.split()) for w in runs_of(t) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}


class Matcher:
    """Lexicon trie and Levenshtein automaton, determinised as words are read."""

    def __init__(self, weights: dict[str, float]):
        self.stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.children: list[dict[str, int]] = [{}]
        self.value: list[tuple[float, int] | None] = [None]  # at a term's end: its weight and allowed edits
        for term, w in weights.items():
            if term.endswith("*"):
                continue
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.value.append(None)
                node = self.children[node][c]
            self.value[node] = (w, 0 if len(term) < 5 else 1 if len(term) < 9 else 2)
        self.edits = max((v[1] for v in self.value if v), default=0)
        self._reset()

    def _reset(self) -> None:
        self.states: list[frozenset[tuple[int, int]]] = [frozenset()]
        self.names = {frozenset(): 0}
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[float, int]] = [(0.0, 0)]
        self.places = 0
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of trie nodes with their fewest edits; skipped lexicon letters are added here."""
        queue = list(nodes)
        while queue:
            n = queue.pop()
            if (e := nodes[n] + 1) <= self.edits:
                for child in self.children[n].values():
                    if e < nodes.get(child, self.edits + 1):
                        nodes[child] = e
                        queue.append(child)
        key = frozenset(nodes.items())
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            self.places += 1 + len(nodes)
            hits = [(v[0], e) for n, e in nodes.items() if (v := self.value[n]) and e <= v[1]]
            self.ends.append(max(((w / (1 + e), e) for w, e in hits), default=(0.0, 0)))
        return self.names[key]

    def _next(self, state: int, c: str) -> int:
        after: dict[int, int] = {}

        def reach(n: int, e: int) -> None:
            if e <= self.edits and e < after.get(n, self.edits + 1):
                after[n] = e

        for n, e in self.states[state]:
            for letter, child in self.children[n].items():
                reach(child, e if letter == c else e + 1)
            reach(n, e + 1)
        found = self.step[state][c] = self._state(after)
        return found

    def match(self, word: str) -> tuple[float, int]:
        """Weight and kind of the best hit: 0 none, 1 exact, 2 stem, 3 misspelt."""
        best = (0.0, 0)
        for n in self.stem_sizes:
            if len(word) > n and (w := self.stems.get(word[:n])) and w > best[0]:
                best = (w, 2)
        if self.places > STATE_PLACES:
            self._reset()
        state, step = self.start, self.step
        for c in word:
            following = step[state].get(c)
            state = self._next(state, c) if following is None else following
            if not state:
                return best
        weight, edits = self.ends[state]
        if weight and (not edits or weight > best[0]):
            best = (weight, 3 if edits else 1)
        return best


@dataclass
class Model:
    """Everything a scorer needs; bounded by the lexicon's size."""

    weights: dict[str, float]
    centre: list[float] = field(default_factory=lambda: [0.0] * FIGURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FIGURES)
    beta: list[float] = field(default_factory=lambda: [0.0] * FIGURES)
    bias: float = 0.0


def largest_window(hits: list[tuple[int, float]]) -> float:
    """The largest sum of weights within ``WINDOW`` words of a hit, for (place, weight) in order; 0 without hits."""
    best = total = 0.0
    low = high = 0
    for i, _ in hits:
        while high < len(hits) and hits[high][0] <= i + WINDOW:
            total += hits[high][1]
            high += 1
        while hits[low][0] < i - WINDOW:
            total -= hits[low][1]
            low += 1
        best = max(best, total)
    return best


def quotations(marks: list[tuple[int, str, str]]) -> dict[bool, tuple[list[int], list[int]]]:
    """First and last tokens of the quotations of each kind (single or not), from (place, opening, closing mark) in order.

    A mark that stands alone (``opening`` of two characters) ends what has begun, or begins.
    """
    spans: dict[bool, tuple[list[int], list[int]]] = {True: ([], []), False: ([], [])}
    begun: dict[bool, int] = {}
    for i, opening, closing in marks:
        if len(opening) > 1 and (opening[0] in SINGLE) in begun:
            opening, closing = "", opening[0]
        if opening:
            begun[opening[0] in SINGLE] = i
        if closing and (kind := closing in SINGLE) in begun:
            spans[kind][0].append(begun.pop(kind))
            spans[kind][1].append(i)
    return spans


class Scorer(dict):
    """Figures of texts; remembers what each token is: None, or weight and kind of its hit, its opening and closing mark."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.matcher = Matcher(weights)

    def __missing__(self, token: str) -> tuple[float, int, str, str] | None:
        words, joined = spellings(token)
        weight, kind = max(map(self.matcher.match, words), default=(0.0, 0))
        if len(joined) > 2 and (other := self.matcher.match(joined)[0]) > weight:
            weight, kind = other, 3
        opens, closes = ("", "") if token.isalnum() else (m[1] if (m := x.search(token)) else "" for x in (OPENS, CLOSES))
        if opens and not LETTERS.search(token):
            opens, closes = opens * 2, ""
        found = (weight, kind, opens, closes) if kind or opens or closes else None
        if len(token) <= 64:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[token] = found
        return found

    def figures(self, text: str | None) -> list[float]:
        tokens = text.split() if text else []
        told = [(i, x) for i, x in enumerate(map(self.__getitem__, tokens)) if x]
        hits = [(i, x[0], x[1]) for i, x in told if x[1]]
        if not hits:
            return [0.0] * FIGURES
        spans = quotations([(i, x[2], x[3]) for i, x in told if x[2] or x[3]])
        sums, used, exact, stems, fuzzy, quoted = 0.0, [], set(), 0, 0, 0
        for i, w, kind in hits:
            if any((at := bisect_right(first, i) - 1) >= 0 and i - WINDOW <= first[at] and i <= last[at] <= i + WINDOW for first, last in spans.values()):
                quoted += 1
                continue
            used.append((i, w))
            sums += w
            if kind == 1:
                exact.add(tokens[i])
            stems += kind == 2
            fuzzy += kind == 3
        near = largest_window(used)
        top = max((w for _, w in used), default=0.0)
        return [float(np.log1p(sums)), float(np.log1p(len(exact))), float(np.log1p(stems)), float(np.log1p(fuzzy)), float(np.log1p(quoted)), min(1.0, 10 * sums / len(tokens)), near, top]


def fold(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled training rows (text, toxic)."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(fold() != 0)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("toxic")).limit(max_rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic")


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms with their log odds, from document counts in both classes; the labelled rows alone bound their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                seen: tuple[Counter, Counter] = Counter(), Counter()
                for text, toxic in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    seen[toxic].update(terms_of(text.as_py() or ""))
                terms = list(seen[0] | seen[1])
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "k1", "k0"])

    n = dict(sample.groupBy("toxic").count().collect())
    if len(n) < 2:
        return {}
    counts = sample.mapInArrow(run, "term string, k1 long, k0 long").groupBy("term").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    # what the share of toxic labels leaves to chance grows with rarity: ask for odds, and for enough documents
    rows = counts.filter("k1 >= 5 AND k1 >= 9 * k0").collect()
    scored = {r.term: float(np.log((r.k1 + 0.5) / (n[1] + 1)) - np.log((r.k0 + 0.5) / (n[0] + 1))) for r in rows}
    return {t: min(s, 8.0) for t, s in sorted(scored.items()) if s >= 3.0}


def _score_rows(docs: DataFrame, model_of, columns: list[str], scored_fields: str) -> DataFrame:
    """Adds what ``model_of(texts)`` gives for the text column to every row."""
    added = [f.split()[0] for f in scored_fields.split(", ")]
    columns = [c for c in columns if c not in added]
    plain, text_at = [f"c{i}" for i in range(len(columns))], columns.index("text")
    base = docs.select(*map(plain_column, columns)).toDF(*plain)  # workers get columns by place, whatever their names
    schema = StructType([*base.schema.fields, *StructType.fromDDL(scored_fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of()
        for batch in batches:
            for part in slices(batch, text_at):
                yield pa.RecordBatch.from_arrays([*part.columns, *own(part.column(text_at))], [*plain, *added])

    return base.mapInArrow(run, schema).toDF(*columns, *added)


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000) -> Model:
    """Fits lexicon and regression on a bounded sample; the driver sees counts of terms and figures of the sample only."""
    sample = materialise(_sample(docs, labels, max_rows), "labelled")
    weights = _lexicon(sample)
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def scorer():
        own = Scorer(shared.value)
        return lambda texts: [pa.array([own.figures(t.as_py()) for t in texts], pa.list_(pa.float64()))]

    rows = _score_rows(sample, scorer, ["text", "toxic"], "figures array<double>").select("figures", "toxic").collect()
    model = Model(weights)
    y = np.array([r.toxic for r in rows], float)
    if not len(y) or y.min() == y.max() or not weights:
        share = y.mean() if len(y) else 0.0
        model.bias = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20))
        return model
    x = np.array([r.figures for r in rows])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    beta, ridge = np.zeros(FIGURES + 1), np.r_[np.full(FIGURES, 1.0), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        beta = beta - np.linalg.solve((z * w[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * beta)
    model.centre, model.scale, model.beta, model.bias = centre.tolist(), scale.tolist(), beta[:-1].tolist(), float(beta[-1])
    return model


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None) -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted``; ``keep`` names the columns to keep (all by default)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = keep or docs.columns

    def scorer():
        m = shared.value
        own, centre, scale, beta = Scorer(m.weights), np.array(m.centre), np.array(m.scale), np.array(m.beta)

        def run(texts: pa.Array) -> list[pa.Array]:
            x = np.array([own.figures(t.as_py()) for t in texts], float).reshape(len(texts), FIGURES)
            p = 1 / (1 + np.exp(-np.clip((x - centre) / scale @ beta + m.bias, -30, 30)))
            return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]

        return run

    return _score_rows(docs, scorer, columns if "text" in columns else [*columns, "text"], "score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **fitting: int) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(base, train(base, labels, **fitting))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
