"""The ten operators against brute force, the libraries and hand-made cases."""

import gzip
import hashlib
import io
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from pulsegrid.llm import bpe, components, html_extract, jaccard_join, minhash, packing, queries, shingles, span_dedup, token_count, toxicity, warc, webp
from tests.conftest import SF

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
LONG = "the cat sat on the mat. " * 60_000  # over a megabyte


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t), 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [None, "", "   \n\t ", "one", "one", "a b c d e f g", "A B C D E F G", "é日 x", LONG]


def words(t):
    t = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    return re.findall(rb"[^\x20\x09-\x0d]+", t)


def shingle_set(t):
    w = words(t)
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


# ---- shared parts ----


def test_words_are_those_of_the_pattern_across_blocks(monkeypatch):
    texts = ["a  bb\tccc", "", None, "x" * 70 + " y", "A é", " lead", "z " * 50]
    want = [words(t) for t in texts]
    whole = list(shingles.words_in(pa.array(texts)))
    monkeypatch.setattr(shingles, "BLOCK", 16)
    small = list(shingles.words_in(pa.array(texts)))
    known = {}
    for expected, full, cut in zip(want, whole, small, strict=True):
        for data, starts, lengths, hashes in (full, cut):
            raw = bytes(data)
            assert [re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw[s : s + n]) for s, n in zip(starts, lengths, strict=True)] == expected
            for w, h in zip(expected, hashes.tolist(), strict=True):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_components_match_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 240)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    reach = {n: {n} for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            reach[a] = reach[b] = reach[a] | reach[b] if reach[a] is not reach[b] else reach[a]
    for a, b in edges:
        if a != b:
            assert got[a] == got[b]
    assert all(got[k] == 200 for k in range(200, 241))


# ---- 1 ----


def test_jaccard_edge_cases(spark):
    out = {r.doc_id: r for r in jaccard_join.near_groups(docs(spark, EDGE)).collect()}
    assert len(out) == len(EDGE)
    sets = [shingle_set(t) for t in EDGE]
    assert [out[i].n_shingles for i in range(len(EDGE))] == [len(s) for s in sets]
    assert [out[i].component_id for i in range(len(EDGE))] == brute_components(sets)


@pytest.mark.parametrize("boundary", [0, 12, 64])
def test_jaccard_matches_brute_force_at_any_boundary(spark, monkeypatch, boundary):
    rng = np.random.default_rng(boundary)
    vocab, texts = [f"w{i}" for i in range(4000)], []
    common = list(rng.choice(vocab, 30))
    for _ in range(25):
        base = list(rng.choice(vocab, int(rng.integers(5, 90))))
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for _ in range(int(rng.integers(0, max(1, len(own) // 8)))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocab))
            texts.append(" ".join(own + (common if rng.random() < 0.3 else [])))
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a: boundary)
    out = {r.doc_id: r.component_id for r in jaccard_join.near_groups(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components([shingle_set(t) for t in texts])


def test_boundary_follows_the_costs():
    t, sizes = jaccard_join.Threshold(), np.full(jaccard_join.MAX_LIGHT + 2, 100)
    low, high = jaccard_join.choose_boundary(sizes, 1.0, t), jaccard_join.choose_boundary(sizes, 500.0, t)
    assert low < high == jaccard_join.MAX_LIGHT


def test_one_of_each_keeps_one_and_all_columns(spark):
    texts = ["a b c d e f g h i j"] * 3 + ["k l m n o p"] * 2 + [None, ""]
    out = jaccard_join.one_of_each(docs(spark, [*texts, texts[0]], [3, 1, 2, 5, 4, 6, 7, 1]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 6, 7]


def test_jaccard_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(tuple(int(v) for v in r) for r in con.execute(queries.OP1_SQL).df().itertuples(index=False))
    assert sorted(tuple(r) for r in queries.op1_jaccard_groups(spark, SF).collect()) == want


# ---- 2 ----


def test_matcher_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    lexicon = {"idiot": 5.0, "worthless": 6.0, "bad": 4.0, "trash": 3.0}
    m = toxicity.Matcher(lexicon | {"lowe*": 2.0})
    rng = np.random.default_rng(0)
    tried = [*lexicon, "idiott", "idot", "worthlss", "wrthlss", "bed", "trsh", "lowender", "lowe"]
    tried += ["".join(rng.choice(list("abdehiorstwl"), int(rng.integers(2, 10)))) for _ in range(300)]
    for w in tried:
        best = 0.0
        for t, v in lexicon.items():
            d, most = distance(w, t), 0 if len(t) < 5 else 1 if len(t) < 9 else 2
            if d <= most:
                best = max(best, v / (1 + d))
        got = m.match(w)
        assert got[0] == (max(best, 2.0) if w.startswith("lowe") and len(w) > 4 else best)
    assert m.match("idiot") == (5.0, 1) and m.match("idiott")[1] == 3 and m.match("lowender")[1] == 2


def test_quoted_hits_count_apart():
    s = toxicity.Scorer({"idiot": 5.0})
    used, quoted = s.figures("you are an idiot today"), s.figures('they said "you idiot" to me')
    assert used[1] > 0 and used[4] == 0 and quoted[1] == 0 and quoted[4] > 0
    assert s.figures(None) == s.figures("") == s.figures("nothing here") == [0.0] * toxicity.FIGURES


def test_window_sums_cover_every_hit():
    s = toxicity.Scorer({"idiot": 5.0, "lowe*": 2.0})
    sparse, dense = ("idiot " + "x " * 30) * 250, "idiot idiot idiot idiot "
    assert s.figures(sparse)[6] == pytest.approx(5.0) and s.figures(sparse + dense)[6] == s.figures(dense + "x " * 30 + sparse)[6] == pytest.approx(20.0)
    assert s.figures("lowe" + "r" * 60)[2] > 0  # long words are matched too
    rng = np.random.default_rng(0)
    for _ in range(50):
        at = np.sort(rng.choice(3000, 400, replace=False)).tolist()
        hits = [(i, float(w)) for i, w in zip(at, rng.random(400), strict=True)]
        want = max(sum(w for j, w in hits if abs(i - j) <= toxicity.WINDOW) for i, _ in hits)
        assert toxicity.largest_window(hits) == pytest.approx(want)


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ('"you idiot" they said', True),
        ('they said "idiot," then', True),
        ("the word ‘idiot’ is old", True),
        ("he wrote 'what an idiot' once", True),
        ("er sagte „du idiot“ leise", True),
        ("« un idiot » dit", True),
        ('" an idiot "', True),
        ('"idiot and then more', False),  # a mark that only opens
        ('an idiot" they', False),
        ('"one thing" you idiot "another thing"', False),  # between two quotations
        ("don't be an idiot, it's bad", False),
        ('"' + "a " * 11 + 'idiot b"', False),  # the marks lie outside of the window
        ('"a idiot b"', True),
    ],
)
def test_quotations_are_pairs_of_marks(text, quoted):
    f = toxicity.Scorer({"idiot": 5.0}).figures(text)
    assert (f[4] > 0) == quoted and (f[0] > 0) != quoted


@pytest.mark.parametrize("token", ["st*pid", "stup1d", "st.u.p.i.d", "w0rthl3ss", "you/absolutely/idiot", "internationally—idiot", "(stupid)", "(id1ot)"])
def test_every_run_and_spellings_over_marks_hit(token):
    f = toxicity.Scorer({"idiot": 5.0, "stupid": 5.0, "worthless": 6.0}).figures(f"and {token} here")
    assert f[7] > 0
    assert not any(toxicity.Scorer({"idiot": 5.0, "stupid": 5.0}).figures("3.14 a-b st. 12:30 e.g. http://x.y/st well-known stop,pid"))


def test_long_texts_take_linear_time():
    s = toxicity.Scorer({"idiot": 5.0})
    text = '"idiot ' * 10_000 + 'idiot" ' * 10_000 + LONG
    s.figures(text)
    begin = time.perf_counter()
    s.figures(text)
    once = time.perf_counter() - begin
    begin = time.perf_counter()
    s.figures(text * 4)
    assert time.perf_counter() - begin < 16 * once + 1


def test_toxicity_figures_match_a_slow_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    weights = toxicity._lexicon(toxicity._sample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), 12_000))
    weights = dict(sorted(weights.items())[:150]) | {"idiot": 5.0, "worthless": 6.0}
    full = {t: w for t, w in weights.items() if not t.endswith("*")}

    def near(a, b, most):
        if abs(len(a) - len(b)) > most:
            return most + 1
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if min(row) > most:
                return most + 1
        return row[-1]

    known = {}

    def best(token):
        if token not in known:
            runs, each = re.findall(r"[^\W\d_]+", token.lower()), [(0.0, False)]
            for w in {*runs, "".join(runs)}:
                if len(w) > 2:
                    found = [(v / (1 + d), d == 0) for t, v in full.items() if (d := near(w, t, most := 0 if len(t) < 5 else 1 if len(t) < 9 else 2)) <= most]
                    found += [(v, False) for t, v in weights.items() if t.endswith("*") and len(w) >= len(t) and w.startswith(t[:-1])]
                    each.append(max(found, default=(0.0, False)) if not any(e for _, e in found) else max(x for x in found if x[1]))
            known[token] = max(each)
        return known[token]

    s, rng = toxicity.Scorer(weights), np.random.default_rng(0)
    spelt = [*full, *(w[:k] + "e" + w[k + 1 :] for w in full for k in range(0, len(w), 2)), *(w[:k] + w[k + 1 :] for w in full for k in range(0, len(w), 2))]
    texts = [r.text for r in rows] + [" ".join(rng.choice([*spelt, *["the", "day,", "Night."] * len(spelt)], 80)) for _ in range(40)]
    checked = 0
    for text in texts:
        if not text or len(text) > 20_000 or any(c in text for c in "\"“”„«»‟'‘’‚‹›"):
            continue
        tokens = text.split()
        hits = [(i, best(t)[0]) for i, t in enumerate(tokens) if best(t)[0]]
        got = s.figures(text)
        checked += bool(hits)
        assert got[0] == pytest.approx(np.log1p(sum(w for _, w in hits)))
        assert got[6] == pytest.approx(max((sum(w for j, w in hits if abs(i - j) <= toxicity.WINDOW) for i, _ in hits), default=0.0))
        assert got[7] == pytest.approx(max((w for _, w in hits), default=0.0))
    assert checked >= 40


def test_toxicity_scores_rows_without_labels_and_ignores_held_out_ones(spark):
    texts = [("you stupid idiot %d go" % i if i % 4 == 0 else "the nice day %d is here" % i) for i in range(200)] + [None, "", LONG]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(out) == 203 and all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].predicted == int(i % 4 == 0) for i in range(200))
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(203))
    flipped = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(d, flipped).collect()} == {i: r.score for i, r in out.items()}


@pytest.mark.parametrize("labelled", [[], [(1, 0)], [(1, 1)]])
def test_toxicity_without_both_labels(spark, labelled):
    out = toxicity.toxicity(docs(spark, ["a b", "c"]), spark.createDataFrame(labelled, "doc_id long, toxic int")).collect()
    assert len(out) == 2 and out[0].score == out[1].score


# ---- 3 ----


def test_fingerprints_follow_the_contract(spark):
    order = [5, 0, 3, 8, 1, 2, 4, 6, 7]
    out = {r.doc_id: r for r in minhash.fingerprints(docs(spark, [EDGE[i] for i in order], order), partitions=4).collect()}
    texts = [t or "" for t in EDGE]
    for i, t in enumerate(texts):
        n = len(t) // 4
        new = t[: len(t) - n] + texts[(i + 1) % len(texts)][:n]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
    assert out[3].fingerprint == out[4].fingerprint and out[3].near_next == 1.0
    assert out[0].fingerprint == out[1].fingerprint == out[2].fingerprint and out[0].near_next == 1.0 and out[2].near_next == 0.0


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for n in (10, 100, 1000):
        for _ in range(60):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = a.copy()
            k = int(rng.integers(0, n))
            b[:k] = rng.integers(0, 1 << 62, k).astype(np.uint64)
            sa, sb = set(shingles.shingle_hashes(a).tolist()), set(shingles.shingle_hashes(b).tolist())
            errors.append(minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - len(sa & sb) / len(sa | sb))
    assert np.sqrt(np.mean(np.square(errors))) < 0.1 and abs(np.mean(errors)) < 0.03
    one, two = (minhash.fingerprint(np.array([x], np.uint64)) for x in (1, 2))
    assert minhash.likeness(one, two) < 0.2 and len(minhash.packed(one)) == minhash.BINS * minhash.BITS // 4


def test_fingerprints_of_repeated_and_null_ids(spark):
    out = minhash.fingerprints(docs(spark, ["a", "b", "b", "c"], [1, 2, 2, None]), partitions=3).collect()
    assert len(out) == 4
    assert minhash.fingerprints(docs(spark, []), partitions=3).collect() == []


# ---- 4 ----


def test_main_text_leaves_out_what_is_not_the_article(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div id="cookie-notice">We use cookies on this site and that is all for now, we hope that you agree to it.</div>
    <article><header><h1>Big &amp; bold</h1><p>by someone</p></header><p>First <b>para</b>graph&nbsp;with\n  spaces &lt;here&gt;<p>Second<br>one<div class="ad-box">Buy!</div>
    <script>var x = "<p>no</p>";</script><ul><li>item one</li><li>item two</li></ul><form>Name</form><section class="comments"><p>I like this article a lot and I will tell all of my friends.</p></section></article>
    <aside>More</aside><div class=sidebar>Side</div><footer>&copy; 2020</footer></body></html>"""
    want = "Big & bold\n\nFirst paragraph with spaces <here>\n\nSecond one\n\nitem one\n\nitem two"
    assert html_extract.main_text(page) == want
    rows = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (None, "x", "", 5), (4, "y", "<p>cut off &am", 5)], "page_id long, url string, html string, text int")
    out = {r.page_id: r for r in html_extract.extract(rows).collect()}
    assert (out[1].text, out[1].n_chars) == (want, len(want)) and out[2].text == "" and out[None].n_chars == 0 and out[4].text == "cut off &am"


def test_blocks_without_article_follow_stop_words_and_neighbours():
    good = "This is the first paragraph of the story and it is long enough to be seen as such by the rules that we have here, so it is good text that stays in."
    page = f"<div><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><p>{good}</p><p>Short one</p><p>{good}</p><div><a href=4>link farm of many words that is all one link and nothing else at all</a></div></div>"
    assert html_extract.main_text(page) == f"{good}\n\nShort one\n\n{good}"


def test_neighbours_decide_inside_an_article_and_text_outside_of_it_counts():
    good = "This is the first paragraph of the story and it is long enough to be seen as such by the rules that we have here, so it is good text that stays in."
    links = "<p><a href=1>one link and nothing else than a link</a></p>"
    inside = f"<article><p>{good}</p><p>Kept one</p><p>{good}</p>{links}<p>Lost one</p>{links}<p>Lost two</p></article>"
    assert html_extract.main_text(inside) == f"{good}\n\nKept one\n\n{good}"
    teaser = f"<div class='post teaser'>{links}<p>Read on</p>{links}</div><div><p>{good}</p><p>Kept one</p><p>{good}</p></div>"
    assert html_extract.main_text(teaser) == f"{good}\n\nKept one\n\n{good}"


def test_main_text_query_on_all_pages(spark):
    for r in queries.op4_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 :]
        body = body[: body.find("</article>")] if "</article>" in body else body.split("<footer")[0]
        import html

        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p)))).strip() for p in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


# ---- 5 ----


def test_repeated_passages_leave_all_but_the_first_place(spark):
    rng = np.random.default_rng(0)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    passage = fresh(60)
    texts = [f"{fresh(40)}. {fresh(9)} {passage} {fresh(30)}." for _ in range(6)] + [f"{fresh(30)}. {fresh(12)}."] + EDGE[:5]
    out = {r.doc_id: r for r in span_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert len(out) == len(texts)
    grams = {tuple(passage.split()[i : i + 40]) for i in range(21)}
    held = [i for i in range(6) if any(tuple(out[i].text.split()[k : k + 40]) in grams for k in range(len(out[i].text.split())))]
    assert held == [0] and out[0].text == texts[0] and out[6].text == texts[6]
    for i in range(1, 6):
        assert out[i].text.startswith(texts[i][:200]) and out[i].n_chars == len(out[i].text) and out[i].extra == 7
    assert out[7].text is None and out[8].text == "" and out[10].text == "one"


def test_repeats_inside_a_text_and_repeated_rows(spark):
    text = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen. "
    twice = docs(spark, [text + text, text + text], [1, 1])
    out = span_dedup.remove_repeats(twice).collect()
    assert [r.text for r in out] == [text.rstrip()] * 2
    copies = {r.doc_id: r.text for r in span_dedup.remove_repeats(docs(spark, [text, text, text], [2, 1, 3])).collect()}
    assert copies == {1: text, 2: "", 3: ""}
    assert span_dedup.remove_repeats(docs(spark, [])).collect() == []


@pytest.mark.parametrize("vocabulary", [4, 40, 100_000])
def test_every_match_of_fifty_words_holds_a_common_span(vocabulary):
    rng = np.random.default_rng(vocabulary)
    fresh = lambda n: [f"w{i}" for i in rng.integers(0, vocabulary, n)]

    def own(ws, low, high):  # hashes of the spans between two words
        text = pa.array([" ".join(ws)])
        data, starts, lengths, hashes = next(shingles.words_in(text))
        heads = span_dedup.sentences(data, starts, lengths, hashes)
        assert np.diff(np.append(heads, len(ws))).max() <= span_dedup.LONGEST
        ends, keys = span_dedup.spans(heads, hashes)
        bounds = np.append(heads, len(ws))
        return {k for k, i, e in zip(keys.tolist(), heads.tolist(), ends.tolist(), strict=False) if i >= low and bounds[e] <= high}

    for trial in range(400):
        passage = fresh(50)
        a, b = int(rng.integers(0, 40)), int(rng.integers(0, 40))
        one = own([*fresh(a), *passage, *fresh(int(rng.integers(0, 40)))], a, a + 50)
        two = own([*fresh(b), *passage, *fresh(trial % 2 * 20)], b, b + 50)
        assert one & two


def test_span_query_matches_a_direct_pass(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    seen, want = set(), {}
    for r in rows:
        data, starts, lengths, hashes = next(shingles.words_in(pa.array([r.text])))
        _, keys = span_dedup.spans(span_dedup.sentences(data, starts, lengths, hashes), hashes)
        drop = []
        for at, k in enumerate(keys.tolist()):
            if k in seen:
                drop.append(at)
            seen.add(k)
        want[r.doc_id] = span_dedup._without(r.text, drop)[0] if drop else r.text
    assert {r.doc_id: r.text for r in queries.op5_span_dedup(spark, SF).collect()} == want


# ---- 7 ----


def test_crc_of_a_rest():
    data = bytes(range(256)) * 3
    for cut in (0, 1, 100, 767):
        assert packing.crc_of_rest(zlib.crc32(data), zlib.crc32(data[:cut]), len(data) - cut) == zlib.crc32(data[cut:])


def check_pieces(rows, texts):
    tk = Tokenizer.from_file(WORDS)
    ids = {i: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return 1 - sum(map(len, ids.values())) / (packing.WINDOW * len(by_seq))


def test_packing_covers_every_id_once(spark):
    assert check_pieces(packing.pack(docs(spark, EDGE), WORDS).collect(), dict(enumerate(EDGE))) < 1
    assert packing.pack(docs(spark, []), WORDS).collect() == []
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_pieces(queries.op7_packing(spark, SF).collect(), texts) < 0.03


def test_index_scores_are_bm25():
    rng = np.random.default_rng(0)
    terms = [np.unique(rng.integers(0, 50, 12)).astype(np.uint16) for _ in range(20)]
    counts = [rng.integers(1, 5, len(t)).astype(np.uint16) for t in terms]
    lengths = np.array([float(c.sum()) for c in counts])
    got = packing.Index(terms, counts, lengths).scores(3)
    df = {t: sum(t in x for x in terms) for t in range(50)}
    for d in range(20):
        want = 0.0
        for t in terms[3].tolist():
            if t in terms[d]:
                tf = float(counts[d][list(terms[d]).index(t)])
                idf = max(0.0, np.log((20 - df[t] + 0.5) / (df[t] + 0.5)))
                want += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / lengths.mean()))
        assert got[d] == pytest.approx(want, rel=1e-5)


def _made_index(rng, n_docs, vocabulary, copies):
    """Documents of terms with Zipf-like odds, some of them copies."""
    odds = 1 / np.arange(1, vocabulary + 1)
    terms = [np.unique(rng.choice(vocabulary, rng.integers(0, 90), p=odds / odds.sum())).astype(np.uint16) for _ in range(n_docs)]
    counts = [rng.integers(1, 9, len(t)).astype(np.uint32) for t in terms]
    for i in range(copies):
        at = int(rng.integers(n_docs))
        terms[i], counts[i] = terms[at], counts[at]
    return terms, counts, np.array([float(c.sum()) for c in counts])


@pytest.mark.parametrize("dense_terms", [0, 3, 2048])
def test_scores_count_every_term_whether_by_lists_or_by_products(monkeypatch, dense_terms):
    """Every pair of documents, all terms asked; copies have exactly equal scores."""
    monkeypatch.setattr(packing, "DENSE_TERMS", dense_terms)
    rng = np.random.default_rng(7)
    for n_docs, vocabulary, copies in [(1, 5, 0), (40, 30, 10), (150, 400, 30)]:
        terms, counts, lengths = _made_index(rng, n_docs, vocabulary, copies)
        index, corpus = packing.Index(terms, counts, lengths), packing.Corpus(n_docs, np.bincount(np.concatenate(terms), minlength=1 << 16), float(lengths.mean()))
        idf = [max(0.0, np.log((n_docs - d + 0.5) / (d + 0.5))) for d in corpus.df]
        weights = [{int(t): idf[t] * int(c) * 2.2 / (int(c) + 1.2 * (0.25 + 0.75 * size / corpus.mean_length)) for t, c in zip(own, counted, strict=True)} for own, counted, size in zip(terms, counts, lengths, strict=True)]
        for seed in range(n_docs):
            got = index.scores(seed, [x for x in (seed + 1, seed + 3) if x < n_docs])
            want = [sum(w.get(int(t), 0.0) for t in terms[seed]) for w in weights]
            np.testing.assert_allclose(got, want, atol=1e-4)
            for a in range(copies):
                assert all(got[a] == got[b] for b in range(n_docs) if terms[b] is terms[a] and counts[b] is counts[a])


def _slow_pieces(tokens, scores):
    """Which documents share a sequence, by the rule alone: the longest seeds, its best unused neighbours fill, the rest goes by length."""
    left, groups = [t % packing.WINDOW for t in tokens], []
    for seed in sorted(range(len(tokens)), key=lambda d: -left[d]):
        while left[seed] > 0:
            room, group = packing.WINDOW - left[seed], {seed: left[seed]}
            ranked = sorted((d for d in range(len(tokens)) if d != seed and left[d] > 0 and scores[seed][d] > 0), key=lambda d: -scores[seed][d]) if room > packing.GRID else []
            left[seed] = 0
            while room:
                whole = ranked.pop(0) if ranked and room >= packing.GRID else None
                if whole is None:
                    longest = max(range(len(left)), key=lambda d: left[d])
                    fitting = max(range(len(left)), key=lambda d: left[d] if left[d] <= room else 0)
                    whole = longest if room >= packing.GRID and left[longest] > room else fitting
                    if not 0 < left[whole] or (left[whole] > room and room < packing.GRID):
                        break
                ids = left[whole] if left[whole] <= room else room // packing.GRID * packing.GRID
                group[whole] = group.get(whole, 0) + ids
                left[whole], room = left[whole] - ids, room - ids
            groups.append(group)
    return groups


def test_packing_of_a_shard_equals_a_slow_version():
    rng = np.random.default_rng(3)
    terms, counts, _ = _made_index(rng, 120, 500, 20)
    tokens = rng.integers(1, 3000, 120)
    running = [np.zeros(-(-int(t % packing.WINDOW) // packing.GRID), "<u4") for t in tokens]
    index = packing.Index(terms, counts, tokens.astype(float))
    want = _slow_pieces(tokens.tolist(), [index.scores(s) for s in range(120)])
    got = {}
    for row, _, length, _, sequence, _ in packing.pack_shard(tokens, [np.zeros(0, "<u4")] * 120, running, terms, counts):
        own = got.setdefault(sequence, {})
        own[row] = own.get(row, 0) + length
    assert [got[k] for k in sorted(got)] == want


def test_packing_repeated_rows_of_one_id(spark):
    text = "one row again and again"
    rows = packing.pack(spark.createDataFrame([(1, text)] * 300, "doc_id long, text string"), WORDS, shard_rows=16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and sum(r.length for r in rows) == 300 * rows[0].doc_tokens


def test_like_documents_are_packed_together_in_small_shards(spark):
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(1200)]
    topics = [" ".join(rng.choice(vocab[30 * t : 30 * t + 30], 300)) for t in range(40)]
    texts = [f"{topics[i % 40]} {vocab[i]}" for i in range(640)]
    out = packing.pack(docs(spark, texts), WORDS, shard_rows=32)
    rows = out.collect()
    check_pieces(rows, dict(enumerate(texts)))
    members = {}
    for r in rows:
        members.setdefault(r.sequence_id, set()).add(r.doc_id % 40)
    assert np.mean([len(m) for m in members.values()]) < 2  # dealt by hash about every document is of another topic


def test_corpus_counts_are_those_of_all_documents(spark):
    texts = ["a b c", "a b", None, "a"] * 5
    got = packing.corpus_of(packing.digests(docs(spark, texts), WORDS).repartition(4))
    ids = [Tokenizer.from_file(WORDS).encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert got.n == 20 and got.mean_length == sum(map(len, ids)) / 20
    assert {t: int(got.df[t]) for t in np.flatnonzero(got.df)} == {t: sum(t in i for i in ids) for t in {t for i in ids for t in i}}


# ---- 8 ----


def test_token_counts_match_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = {r.doc_id: r for r in token_count.count_tokens(docs(spark, EDGE), PIECES).collect()}
    for i, t in enumerate(EDGE):
        n = len(sp.encode(t or ""))
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len((t or "").encode()), n > 4096)


def test_texts_without_spaces_are_counted_in_linear_time():
    c, rng = token_count.Counter(PIECES), np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 400_000))
    begin = time.perf_counter()
    for t in (text, "ab" * 200_000):
        assert c.count(t) == len(c.model.encode(t))
    assert time.perf_counter() - begin < 15


def test_chunked_counts_widen_where_nothing_is_stable():
    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_count.Counter(PIECES)
    assert "a " not in c.joined and "th" in c.joined
    rng = np.random.default_rng(0)
    cases = ["x" * 3000 + " " + "y " * 10 + "z" * 2000 + "   " * 500 + "abc def", " " * 5000, "日本" * 900, "a▁b " * 400, "<s> </s> " * 300]
    cases += ["".join(rng.choice(list("abc  \n▁é日x"), int(rng.integers(1, 900)))) for _ in range(60)]
    for t in cases:
        for chunk, overlap in ((50, 4), (300, 16)):
            assert c.count(t, chunk, overlap) == len(sp.encode(t))


# ---- 9 ----


def test_captures_of_all_pages(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted((int(r.page_id), int(r.payload_bytes), r.payload_digest, r.record_type) for r in con.execute(queries.OP9_SQL).df().itertuples())
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in queries.op9_warc_captures(spark, SF).collect()) == want


def test_revisits_nulls_and_repeated_rows(spark, tmp_path):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "u5", big, 1), (2, "u\r\n2", big, 1), (2, "u2b", big, 1), (9, None, big, 1), (None, "n", big, 1), (7, "s", "tiny", 1), (8, "s", "tiny", 1), (1, "e", None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/w"
    out = sorted(((r.metadata.page_id, r.response.record_type, r.refers_to, r.metadata.payload_bytes) for r in warc.round_trip(pages, path=path).collect()), key=repr)
    n = len(big.encode())
    want = [(5, "revisit", 2, n), (2, "response", None, n), (2, "response", None, n), (9, "revisit", 2, n), (None, "revisit", 2, n), (7, "response", None, 4), (8, "response", None, 4), (1, "response", None, 0)]
    assert out == sorted(want, key=repr)
    held = [r.response.payload for r in warc.assemble(warc.read_archives(spark, path)).collect() if r.metadata.page_id == 2]
    assert held == [big, big]
    files = list((tmp_path / "w").glob("part-*"))
    records = [h for f in files for h, _ in warc.parse(io.BufferedReader(gzip.open(f)))]
    assert len(records) == 3 * len(rows) and {h["warc-type"] for h in records} == {"request", "response", "revisit", "metadata"}
    assert warc.round_trip(pages.limit(0)).collect() == []


# ---- 10 ----


def test_encoding_matches_the_library(spark):
    tk, enc = Tokenizer.from_file(WORDS), bpe.Encoder(WORDS)
    rng = np.random.default_rng(0)
    cases = [t or "" for t in EDGE[:-1]] + ["a" * 3000, "!" * 999, "don't <|endoftext|>x<|startoftext|>", "ΑΣ ΣΑΣ İ ﬁ é ẛ̣", "a\x1cb\x85c d", "<|endof", "'S 'LL 12 3x"]
    cases += ["".join(rng.choice(list("abcdst' 0é́Σ\x1c.,!<|>日İ\n"), int(rng.integers(0, 70)))) for _ in range(1500)]
    for t in cases:
        want = tk.encode(t, add_special_tokens=False).ids
        packed = enc.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == want, t
        assert enc.decode(packed) == tk.decode(want, skip_special_tokens=False)
    out = {r.doc_id: r for r in bpe.encode_decode(docs(spark, EDGE), WORDS).collect()}
    for i, t in enumerate(EDGE):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def merged_slowly(merges, word):
    """Lowest rank first, leftmost first, one merge at a time."""
    ids = [merges.vocab[c if k < len(word) - 1 else c + merges.end] for k, c in enumerate(word)]
    made = {(i, j): k for k, (i, j, _) in merges.parts.items()}
    while pairs := [(merges.rank[x], k) for k, x in enumerate(zip(ids, ids[1:])) if x in merges.rank]:
        _, k = min(pairs)
        ids[k : k + 2] = [made[ids[k], ids[k + 1]]]
    return ids


def test_streamed_words_are_stable_with_bounded_memory():
    enc = bpe.Encoder(WORDS)
    rng = np.random.default_rng(1)
    for w in ("ab" * 400, "".join(rng.choice(list("etaoinshr"), 1500)), "a" * 700, "the"):
        assert list(enc.merges.stream(w)) == list(enc.merges.stream([w])) == merged_slowly(enc.merges, w)
    out = enc.merges.stream(iter("the" * 400))
    early = next(out)
    assert early == merged_slowly(enc.merges, "the" * 400)[0] and enc.merges.lookahead >= enc.merges.window
    for letters in ("etaoinshr", "ab", "a", "qzx"):
        run = bpe.Transducer(enc.merges)
        for _ in range(300):  # whatever has come, no more than the lookahead is held back
            run.feed("".join(rng.choice(list(letters), 700)))
            assert len(run.text) <= 3 * enc.merges.lookahead


def test_a_text_without_spaces_is_encoded_in_constant_memory():
    enc = bpe.Encoder(WORDS)
    word = "".join(np.random.default_rng(0).choice(list("etaoinshr"), 997))
    enc.encode(word * 200)  # what pairs of tokens tell is remembered

    def peak(times):
        tracemalloc.start()
        n = sum(len(p) for p in enc.pieces(word for _ in range(times)))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, top

    (few, low), (many, high) = peak(300), peak(1500)
    assert many > 4 * few and high < 1.2 * low + 100_000


def test_every_pretoken_takes_the_transducer(monkeypatch):
    enc, fed = bpe.Encoder(WORDS), []
    own = bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, symbols, final=False: fed.append(symbols) or own(self, symbols, final))
    enc.encode("One two, two don't 12")
    assert sorted(fed) == sorted(["one", "two", ",", "don", "'t", "1", "2"])


@pytest.mark.parametrize("block", [32, 300])
def test_blocks_and_edges_change_no_id(monkeypatch, block):
    tk, enc, rng = Tokenizer.from_file(WORDS), bpe.Encoder(WORDS), np.random.default_rng(block)
    monkeypatch.setattr(bpe, "BLOCK", block)
    for k in range(200):
        letters = list("abcdst' 0é́Σ\x1c.,!<|>日İ\n한하" if k % 2 else "abcdet'é́<|>rl日")
        t = "".join(rng.choice(letters, 300)) + "<|endoftext|>" * (k % 3) + "".join(rng.choice(letters, 300))
        got = np.frombuffer(b"".join(enc.pieces(t[i : i + 17] for i in range(0, len(t), 17))), "<u4").tolist()
        assert got == tk.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("block", [32, 33, 47, 64, 100, 128, 300])
def test_short_forms_that_a_block_cuts(monkeypatch, block):
    """Quotes with the letters after them fall on every place of a block's end."""
    tk, enc, rng = Tokenizer.from_file(WORDS), bpe.Encoder(WORDS), np.random.default_rng(block)
    monkeypatch.setattr(bpe, "BLOCK", block)
    for k in range(120):
        parts = ["'ll", "'re", "'ve", "'s", "'t", "'", "''", "'l", "'r", "a", "1", "!", "l", "ab", "é"]
        t = "".join(rng.choice(parts, 200)) if k % 2 else "".join(rng.choice(["a'll", "b're", "1've", "c'l"][k // 2 % 4 :: 4] + ["x"], 120, p=[0.9, 0.1]))
        step = int(rng.integers(5, 90))
        got = np.frombuffer(b"".join(enc.pieces(t[i : i + step] for i in range(0, len(t), step))), "<u4").tolist()
        assert got == tk.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("part", ["a'll", "a're", "1've"])
def test_long_stretches_of_short_forms(part):
    t = part * 50_000 + "xx"
    assert np.frombuffer(bpe.Encoder(WORDS).encode(t), "<u4").tolist() == Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids


def test_text_is_decoded_byte_by_byte():
    enc = bpe.Encoder(WORDS)
    assert "".join(enc.decode_text(np.frombuffer(enc.encode("Héllo wörld 😀!"), "<u4").tolist())) == "héllo wörld 😀! "
    assert "".join(enc.decode_text([enc.merges.vocab[enc.stand_in[0xC3]]])) == "�"


def test_all_ten_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


CLASHING = ["doc", "tag", "_drop", "_removed", "row_key", "spot", "score", "predicted", "name", "keys", "c0", "a.b c", "a`b", "lang", "source", "n_chars"]


def clashing(spark):
    texts = [None, "", "one", "the same long text of a document that is there twice, word by word. " * 4, "the same long text of a document that is there twice, word by word. " * 4, "a b c d e f g h"]
    rows = [(i, t, *([None if i == 2 else k] * len(CLASHING))) for i, (k, t) in enumerate(zip([1, 2, 3, 4, 4, 5], texts, strict=True))]
    rows.append((None, "no id", *([9] * len(CLASHING))))
    return spark.createDataFrame(rows, "doc_id long, Text string, " + ", ".join(f"`{n.replace('`', '``')}` long" for n in CLASHING))


def test_names_of_extra_columns_may_clash(spark):
    d = clashing(spark)
    kept = jaccard_join.one_of_each(d)
    assert kept.columns == d.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 5), (True, None)]
    out = span_dedup.remove_repeats(d)
    assert out.columns == [c for c in d.columns if c != "_removed"] + ["_removed"]
    found = {r.doc_id: r for r in out.collect()}
    assert found[3].Text.startswith("the same") and found[4].Text == "" and found[0].Text is None and found[4].tag == 4
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for part in (toxicity.toxicity(d, labels), minhash.fingerprints(d), packing.pack(d, WORDS), bpe.encode_decode(d, WORDS), token_count.count_tokens(d, PIECES), jaccard_join.near_groups(d), webp.round_trip(d)):
        assert {r.doc_id for r in part.collect()} == {None, 0, 1, 2, 3, 4, 5}
    scored = toxicity.score(d.withColumnRenamed("Text", "text"), toxicity.Model({}))
    assert sorted(scored.columns) == sorted([*(c for c in d.columns if c != "Text"), "text"]) and scored.count() == 7


def test_rows_of_one_id_are_told_apart(spark):
    passage = "these are the words of a passage that comes back, again and again. It has two sentences. And a third one here. "
    d = docs(spark, [passage + "end a", "x. " + passage + "end b", passage], [1, 1, 1])
    out = [r.text for r in span_dedup.remove_repeats(d).collect()]
    assert sum(passage.strip()[:30] in t for t in out) == 1


def family(rng, n, size, changed):
    base = [f"b{rng.integers(1 << 40)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.choice(size, changed, replace=False):
            w[k] = f"x{rng.integers(1 << 40)}"
        out.append(" ".join(w))
    return out


def test_families_about_the_threshold_lose_no_link(spark):
    texts = [t for changed in (3, 4, 6) for t in family(np.random.default_rng(changed), 150, 120, changed)] + family(np.random.default_rng(50), 60, 40, 1)
    want = brute_components([shingle_set(t) for t in texts])
    assert [r.component_id for r in sorted(jaccard_join.near_groups(docs(spark, texts)).collect())] == want


def test_a_large_family_without_links_makes_few_candidates(spark, monkeypatch):
    seen, own = [], jaccard_join._candidates
    monkeypatch.setattr(jaccard_join, "_candidates", lambda *a: seen.append((out := own(*a)).count()) or out)
    texts = family(np.random.default_rng(0), 2000, 120, 8)
    out = jaccard_join.near_groups(docs(spark, texts)).collect()
    assert len({r.component_id for r in out}) > 1900 and sum(seen) < 20_000  # of 2,000,000 pairs


def test_the_pipeline_takes_any_table(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"word{k}" for k in range(60)) + ". Second sentence here. Third sentence there. "
    texts = [None, "", "one", "you stupid idiot go", "you stupid idiot go away", *[passage + f"tail {k} " * 20 for k in range(3)], passage * 3, passage * 3, passage * 3, LONG]
    full = docs(spark, texts, [*range(len(texts) - 2), 8, None]).drop("extra").withColumns({"row_key": F.lit(1), "tag": F.lit("t")})
    labels = spark.createDataFrame([(i, int(i in (3, 4)), 0) for i in range(8)], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (full, full.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert now.columns == corpus_pipeline.COLUMNS
            now = spark.createDataFrame(now.collect(), now.schema)
        assert (now.count() == 0) == (table.count() == 0)


def test_the_pipeline_is_its_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    rows, source = out.collect(), {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), now.schema)
    texts = {r.doc_id: r.text for r in now.collect()}
    check_pieces(rows, texts)
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, SF).filter("predicted = 1").collect()}
    assert not toxic & set(texts) and set(texts) <= set(source)
    ids = sorted(set(source) - toxic)
    groups = brute_components([shingle_set(source[i].text) for i in ids])
    assert set(texts) == {ids[g] for g in groups}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert jaccard_join.near_groups(none).collect() == [] and jaccard_join.one_of_each(none).collect() == []
    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []
    assert token_count.count_tokens(none, PIECES).collect() == [] and bpe.encode_decode(none, WORDS).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).collect() == []


def test_a_family_that_is_alike_but_not_enough_stays_apart(spark):
    rng = np.random.default_rng(5)
    base, texts = [f"b{i}" for i in range(200)], []
    for _ in range(40):  # each pair shares about two thirds
        own = list(base)
        for i in rng.choice(200, 9, replace=False):
            own[i] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    out = {r.doc_id: r.component_id for r in jaccard_join.near_groups(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components([shingle_set(t) for t in texts])
