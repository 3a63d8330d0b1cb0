"""Operators 11 to 13 against slow versions, SQL, held-out labels and hand-made cases."""

import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pulsegrid.llm import centroids, filter_audit, quality, queries
from tests.conftest import SF

DOCS = "doc_id long, text string, source string, mask int, part string, cells string, score int, `a.b c` int"
LABELS = "doc_id long, quality int, toxic int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y", 5, 6) for i, t, s in rows], DOCS)


def compare_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(want[sorted(want.columns)].itertuples(index=False, name=None))


# ---- 11 ----


def slow_audit(rows, labels):
    told = {}
    for i, good, toxic in labels:
        if i is not None:
            a, b = told.get(i, (False, False))
            told[i] = a or good == 1, b or toxic == 1
    parts = {}
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        parts.setdefault(s or "", []).append((fails, *told.get(i, (False, False))))
    out = {}
    for part, held in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = held
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                before = [d for d in held if d[0][f] and any(d[0][g] for g in order[:k])]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(before), sum(d[0][f] and sum(d[0].values()) == 1 for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[f] += len(gone)
        for (p, order, k), values in out.items():
            if p == part:
                values.append(shapley[order[k - 1]])
    return out


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def made_texts():
    rng = np.random.default_rng(11)
    texts = [None, "", "  \n\t ", "$", "ABC def", "É" * 40 + "A A", "a b"]
    for _ in range(60):
        n = int(rng.integers(1, 120))
        words = [f"w{rng.integers(0, max(2, int(n * rng.choice([0.3, 2]))))}" for _ in range(n)]
        words = [w.upper() if rng.random() < 0.04 else w + rng.choice(["", "", "", "#", "."], p=[0.5, 0.2, 0.29, 0.003, 0.007]) for w in words]
        texts.append(str(rng.choice([" ", "\n", "\x0b"])).join(words))
    rows = [(i, t, str(rng.choice(["a", "b", ""]))) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], None) for i in range(0, 40, 3)]  # copies under larger ids
    rows += [(7, texts[9], "b"), (7, texts[9], "b"), (None, texts[9], "a"), (None, None, "a"), (200, "long text " * 200_000, "a"), (201, "long text " * 200_000, "b")]
    labels = [(i, i % 3 and 1, i % 2) for i in range(0, 120, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, None), (8, 5, 7)]
    return rows, labels


def test_audit_equals_applying_every_order(spark):
    rows, labels = made_texts()
    got = audit_rows(filter_audit.audit(documents(spark, rows).repartition(5), spark.createDataFrame(labels, LABELS)))
    assert got == slow_audit(rows, labels)


def test_audit_query_equals_sql(spark):
    compare_with_sql(spark, "op11_filter_audit")


def test_audit_of_an_empty_table(spark):
    df = filter_audit.audit(documents(spark, []), spark.createDataFrame([], LABELS))
    assert df.collect() == [] and [f"{n} {t.replace('bigint', 'long')}" for n, t in df.dtypes] == filter_audit.ROW.split(", ")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_single_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(n)


def test_a_swap_counts_only_two_steps_anew(monkeypatch):
    table = np.random.default_rng(0).integers(0, 9, (3, 32, 3))

    class Counted(np.ndarray):
        looked = 0

        def __getitem__(self, at):
            Counted.looked += 1
            return np.asarray(self)[at]

    orders, counts, shapley = filter_audit.walk(table.view(Counted), 5)
    assert Counted.looked == 5 + 2 * 119 and len(orders) == 120
    assert (shapley.sum(0) == 120 * table[:, 1:, 0].sum(1)).all()  # what filters share adds up to all that goes


# ---- 12 ----


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = queries.op12_quality(spark, "/root/testdata/sf0.01")
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert len(bad) > 10 and np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in held]) > 0.96


def test_quality_ignores_labels_of_held_out_rows_and_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold() == quality.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.quality(docs.repartition(7).withColumn("source", F.lit("q")).withColumn("lang", F.lit("q")), turned.repartition(3)).collect()}
    assert a == b


def direct_features(text):
    """Counts of n-grams by name in the three views, as a plain loop."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    mark = lambda c: 32 < c < 127 and not chr(c).isalnum()
    kind = lambda c: "A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 or c > 127 else "0" if 48 <= c <= 57 else chr(c) if mark(c) else ""
    shape = [(frozenset(map(kind, w)) - {""}, 65 <= w[0] <= 90, mark(w[-1])) for w in words]
    again = [next((k for k in (1, 2, 3) if i >= k and low[i - k] == w), 0) for i, w in enumerate(low)]
    out = []
    for view, largest in ((low, 2), (shape, 3), (again, 3)):
        out.append({})
        for n in range(1, largest + 1):
            for i in range(len(view) - n + 1):
                out[-1][tuple(view[i : i + n])] = out[-1].get(tuple(view[i : i + n]), 0) + 1
    return out


def test_features_are_shares_of_n_grams(monkeypatch):
    texts = ["The cat, the cat THE end### of it it it", "é É9 $", "one", "A b " * 50]
    for chunk, block in ((1 << 17, 1 << 20), (4, 7)):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        monkeypatch.setattr(quality, "BLOCK", block)
        for text, (at, values) in zip(texts, quality.features(pa.array(texts)), strict=True):
            want = sorted(math.sqrt(c / sum(view.values())) for view in direct_features(text) for c in view.values())
            assert len(at) == len(set(at.tolist())) and sorted(values.tolist()) == pytest.approx(want, abs=1e-6)
    assert [len(x[0]) for x in quality.features(pa.array([None, "", " \n"]))] == [0, 0, 0]


def test_updates_follow_the_regularised_leader():
    """Each weight minimises the sum of linearised losses, its strong-convexity terms and both penalties."""
    rng = np.random.default_rng(3)
    leader, grads, terms = quality.Leader(), np.zeros(5), []
    for _ in range(40):
        at = np.sort(rng.choice(5, 3, replace=False))
        x, y = rng.random(3), int(rng.integers(0, 2))
        w, b = leader.weights(at), leader.bias()
        g = (1 / (1 + np.exp(-(w @ x + b))) - y) * x
        before = leader.n[at].copy()
        leader.learn(at, x, y)
        grads[at] += g
        terms.append((at, (np.sqrt(before + g * g) - np.sqrt(before)) / quality.ALPHA, w))
    for k in range(5):
        own = [(s[list(at).index(k)], w[list(at).index(k)]) for at, s, w in terms if k in at]
        grid = np.linspace(-3, 3, 60001)
        loss = grads[k] * grid + sum(s * (grid - w) ** 2 for s, w in own) / 2 + quality.L1 * abs(grid) + (quality.L2 + quality.BETA / quality.ALPHA) / 2 * grid**2
        assert leader.weights(np.array([k]))[0] == pytest.approx(grid[loss.argmin()], abs=2e-4)


def test_quality_of_edge_cases(spark):
    docs = documents(spark, [(0, None, "s"), (1, "", "s"), (2, " \n ", "s"), (3, "word", "s"), (3, "word", "s"), (None, "x y", None), (4, "long text " * 200_000, "s")])
    none = spark.createDataFrame([], LABELS)
    rows = quality.quality(docs, none).collect()
    assert len(rows) == 7 and all(r.predicted == 1 for r in rows)
    one_kind = spark.createDataFrame([(0, 0, 0), (2, 0, 1), (3, None, 1), (None, 1, 1)], LABELS)
    assert {r.predicted for r in quality.quality(docs, one_kind).collect()} == {0}
    mixed = spark.createDataFrame([(i, i % 2, 0) for i in range(5)] + [(3, 7, 0)], LABELS)
    began = time.time()
    rows = quality.quality(docs, mixed).collect()
    assert len(rows) == 7 and len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1 and time.time() - began < 60
    assert quality.quality(documents(spark, []), mixed).collect() == []
    kept = quality.score(docs, quality.Model(np.zeros(quality.BUCKETS, np.float32)))
    assert kept.columns == [*[c for c in docs.columns if c != "score"], "score", "predicted"] and {r.score for r in kept.collect()} == {0.5}


# ---- 13 ----


def slow_clusters(rows, k, size, rounds, seed):
    kept = [(i, [math.floor(256.0 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        now = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else old for n, old in enumerate(now)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = {}
    for _, d, n in last:
        sums[n] = sums.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((-1 if i is None else i), n, d, sums[n], sum(sums.values()), digest[n]) for i, d, n in last)


def clustered(df, **options):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **options).collect())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int")


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_comparing_all(spark, seed):
    rng = np.random.default_rng(seed)
    # few distinct values: many ties of distances and of norms
    rows = [(i, (rng.integers(-2, 3, 4) / 256 * rng.choice([1, 1, 50])).tolist()) for i in range(150)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0]), (903, [1.0, float("nan"), 1.0, 1.0]), (904, [float("-inf"), 1.0, 1.0, 1.0]), (905, [])]
    assert clustered(vectors(spark, rows).repartition(4), k=9, size=4, rounds=5, seed=seed) == slow_clusters(rows, 9, 4, 5, seed)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(-2, 7)).tolist()) for i in range(80)]
    assert clustered(vectors(spark, rows), k=6, size=3, rounds=3, seed=2) == slow_clusters(rows, 6, 3, 3, 2)
    out = clustered(vectors(spark, [(1, [1e300, 0.0, 0.0]), (2, [-1e300, 0.0, 0.0]), (3, [1.0, 1.0, 1.0])]), k=1, size=3, rounds=2, seed=2)
    assert [r[2] for r in out][:2] == [centroids.LARGEST] * 2 and out[0][4] == centroids.LARGEST


def test_few_and_no_vectors(spark):
    rows = [(i, [i / 7, 1.0]) for i in range(5)]
    assert clustered(vectors(spark, rows), k=40, size=2, rounds=5, seed=2) == slow_clusters(rows, 40, 2, 5, 2)
    out = centroids.cluster(vectors(spark, []))
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_the_annulus_leaves_out_centroids_and_never_the_nearest():
    rng = np.random.default_rng(4)
    whole = (rng.normal(size=(40, 8)) * rng.lognormal(5, 1, (40, 1))).astype(int).tolist()
    c = centroids.Centroids(whole)
    x = np.floor(rng.normal(size=(2000, 8)) * rng.lognormal(5, 1, (2000, 1)))
    cluster, distance, compared = c.nearest(x)
    d = ((x[:, None, :] - np.array(whole)[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and distance == d.min(1).astype(int).tolist()
    assert compared < 0.7 * d.size


def test_centroid_query_equals_sql(spark):
    compare_with_sql(spark, "op13_centroids")


def test_new_queries_are_registered():
    assert {"op11_filter_audit", "op12_quality", "op13_centroids"} <= set(__spark_entry__.queries())
