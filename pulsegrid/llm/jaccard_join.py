"""N-gram Jaccard join: a size-aware heavy-light set join (operator 1).

A document's set holds its distinct word shingles. Equal sets are one set, named by a
64-bit hash, so copies never multiply. The join has four steps.

1. *Who can have a partner.* All shingles have one global order: by how far a fixed-size
   count sketch over all documents sees them from the average, then by hash. Of two similar
   sets, prefixes of this order that are ``common`` shingles longer than need be share at least
   ``common``. So each set writes its prefix to inverted lists, and goes on only if enough of
   it is on lists with another set. Shingles that the sketch sees far above the average count
   as shared without a list: no list is hot.
2. *Reduced sets.* Those sets are hashed once more, in full, and lose the shingles that no
   other one of them has. A set that keeps too few can't have a partner.
3. *Leaders.* On each list of a prefix (rarest shingles first) the set with the least
   of its own leads; each set meets the leaders that it shares most lists with. The links that
   hold give first components. Shingles of one component alone are dropped then, and each set
   that is left meets every leader of its lists.
4. *What remains*: pairs of a list that lie in different components. Both have met the list's
   leader, so each is known by its differences to it; similar sets that are far from
   a leader must differ from it in the same shingles, and the number follows from the sizes. So
   the difference sets are joined, heavy-light: light ones (up to ``boundary``
   prefix shingles) enumerate all two-element subsets of a prefix, heavy ones scan the inverted
   lists of single shingles, where light ones meet them. The boundary is the size
   of lowest cost: rows written plus rows met on the lists. Candidates are counted exactly.

Each pair that could join two components is checked, by counts or by the triangle
inequality; a group of thousands of near copies needs no pair for each two of them, nor does a
group of sets that are alike without being similar enough.

Defined cases: null or blank texts have an empty set, n_shingles 0, and are their own
component; rows with a null doc_id are left out of components' ids but keep their row;
repeated rows are equal sets; ties between leaders go by hash; texts of any length are
hashed block by block and their set is one row; an empty table gives no rows; other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.bits import bit_table, spot, unpacked
from pulsegrid.llm.components import connected_components
from pulsegrid.llm.shingles import mix, shingle_hashes, word_hashes
from pulsegrid.llm.storage import drop_files, materialise, plain_column

#: The sketch's counters (a fixed 4 MB of levels goes to the executors) in so many blocks.
SKETCH, BLOCKS = 1 << 22, 64
#: Level of buckets that hold this much above the average (and twelve deviations): their shingles count as shared.
HOT, HOT_ABOVE = 255, 500
#: Leaders that a set meets in the first round; any choice is right there.
LEADERS = 2
#: Prefix sizes up to which difference sets are considered light; above, subsets always cost more than lists.
MAX_LIGHT = 64


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``num`` / ``den``."""

    num: int = 3
    den: int = 4

    def least(self, size: int) -> int:
        """Common shingles that a set of this size needs with any partner."""
        return -(-size * self.num // self.den)

    def least_of(self, size):
        """The same for a column."""
        return F.ceil(F.lit(self.num) * size / self.den)

    def prefix(self, size: int, common: int) -> int:
        """So many first shingles hold ``common`` shared ones with any partner."""
        return min(size, size - self.least(size) + common)

    def holds(self, a, b, common):
        """For columns: |A|, |B| and |A and B|."""
        return F.lit(self.den) * common >= F.lit(self.num) * (a + b - common)

    def sizes_fit(self, a, b):
        return (F.lit(self.den) * F.least(a, b)) >= (F.lit(self.num) * F.greatest(a, b))

    @property
    def unit(self) -> int:
        return 2 * (self.num + self.den)

    def excess(self, size, leader, common):
        """How far a set is from a leader, in 1 / ``unit`` shingles: two sets are similar just if they share as
        many differences to it as both their excesses add up to (``leader``: its shingles that count).
        """
        return F.lit(self.num + self.den) * (leader - F.lit(2) * common) + F.lit(2 * self.num) * size

    def shared_differences(self, a, b):
        """Common differences that two sets of such excesses need; at least one, as fewer are a link without a look."""
        return F.greatest(F.lit(1), F.ceil((a + b) / F.lit(self.unit)).cast("int"))

    def subsets(self, prefix: int) -> int:
        """Two-element subsets of a prefix that holds two common shingles, where one of this size holds one."""
        return comb(prefix + 1, 2)


def common_for(size: int) -> int:
    """Common shingles that prefixes of the first step hold."""
    return 1 + size // 16


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted by hash."""
    for words in word_hashes(texts):
        yield np.unique(shingle_hashes(words, k))


def set_name(tokens: np.ndarray) -> int:
    """A set's 64-bit name as a signed integer."""
    total = mix(tokens + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Levels of the sketch's buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH, np.int64)
        for batch in batches:
            held, room = [], 0
            for tokens in sets_of(batch.column(0), k):
                held.append(tokens)
                room += len(tokens)
                if room > 1 << 19:
                    seen += np.bincount((np.concatenate(held) >> np.uint64(42)).astype(np.int64), minlength=SKETCH)
                    held, room = [], 0
            if held:
                seen += np.bincount((np.concatenate(held) >> np.uint64(42)).astype(np.int64), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(seen, BLOCKS)], pa.binary())], ["block", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // BLOCKS, np.int64)
        for value in parts.column("counts"):
            own = zlib.decompress(value.as_buffer())
            total += np.frombuffer(own, "<i8" if len(own) == 8 * len(total) else "<u4")
        return pa.table({"block": parts.column("block").slice(0, 1), "counts": pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})

    def add_part(parts: pa.Table) -> pa.Table:
        return add(parts)

    partial = docs.select("text").mapInArrow(count, "block int, counts binary").withColumn("part", F.spark_partition_id() % 16)
    partial = partial.groupBy("block", "part").applyInArrow(add_part, "block int, counts binary")
    rows = partial.groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    found = {r.block: np.frombuffer(zlib.decompress(bytes(r.counts)), "<i8") for r in rows}
    if not found:
        return np.zeros(SKETCH, np.uint8)
    seen = np.concatenate([found[b] for b in range(BLOCKS)])
    mean = seen.mean()
    above = (seen - mean) / np.sqrt(max(mean, 1.0))
    # eight steps a deviation up to twelve, then eight a doubling: shared shingles come after nearly all that stand alone
    steps = np.where(above < 12, 64 + 8 * above, 160 + 8 * np.log2(np.maximum(above, 12) / 12))
    levels = np.clip(steps, 0, HOT - 1).astype(np.uint8)
    levels[(above >= 12) & (seen - mean >= HOT_ABOVE)] = HOT
    return levels


def choose_boundary(sizes: np.ndarray, length: float, threshold: Threshold) -> int:
    """The prefix size up to which difference sets are light, by the lowest cost: rows written plus rows met on the lists.

    ``sizes``: sets by prefix size, the last for all larger ones; ``length``: sets on a list of single shingles. Light
    sets meet the heavy ones of a list only, and their subsets have hardly any mates.
    """
    best, cost, p = 0, None, np.arange(len(sizes))
    on_lists = (sizes * p).astype(float)
    for x in range(MAX_LIGHT + 1):
        light = sum(int(sizes[a]) * threshold.subsets(a) for a in range(1, x + 1))
        heavy = on_lists[x + 1 :].sum()
        met = length * (heavy + on_lists[: x + 1].sum() * heavy / max(on_lists.sum(), 1))
        if cost is None or light + met < cost:
            best, cost = x, light + met
    return best


def keys_of(tokens: np.ndarray, levels: np.ndarray, t: Threshold) -> tuple[np.ndarray, int]:
    """A set's index keys, and how many of them must be on lists with other sets for it to have a partner."""
    n = len(tokens)
    if n < 2:  # a partner of a one-shingle set is that set
        return np.zeros(0, np.int64), 1
    level = levels[(tokens >> np.uint64(42)).astype(np.int64)]
    first = np.argsort(level, kind="stable")[: t.prefix(n, common_for(n))]
    listed = first[level[first] < HOT]
    return tokens[listed].view(np.int64), common_for(t.least(n)) - (len(first) - len(listed))


def _indexed(docs: DataFrame, levels: np.ndarray, k: int, t: Threshold) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = shared.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, names, keys, needs = [], [], [], []
                for tokens in sets_of(part.column(1), k):
                    name = set_name(tokens) if len(tokens) else None
                    sizes.append(len(tokens))
                    names.append(name)
                    own, need = None, None
                    if name is not None and name not in sent:  # an equal set's keys are out already
                        if len(sent) < 200_000:
                            sent.add(name)
                        own, need = keys_of(tokens, table, t)
                    keys.append(own)
                    needs.append(need)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(needs, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row_key", "n_shingles", "name", "need", "keys"])

    return docs.select("doc_id", "text", "row_key").mapInArrow(run, "doc_id long, row_key long, n_shingles long, name long, need int, keys array<long>")


def _full_sets(docs: DataFrame, named: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The full sets (name, tokens) of the wanted names, from their documents' texts.

    A bit table of fixed size, filled with those documents' ids, lets other texts pass unhashed.
    """
    ids = named.select("name", "doc_id").join(wanted, "name", "left_semi").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(ids, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = unpacked(shared.value), set()
        for batch in batches:
            some = batch.column(1).filter(pa.array(table[batch.column(0).to_numpy()]))
            for at in range(0, len(some), 512):
                names, held = [], []
                for tokens in sets_of(some.slice(at, 512), k):
                    if len(tokens) and (name := set_name(tokens)) not in sent:
                        if len(sent) < 200_000:
                            sent.add(name)
                        names.append(name)
                        held.append(tokens.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["name", "tokens"])

    found = docs.select(spot("doc_id"), "text").mapInArrow(run, "name long, tokens array<long>")
    return found.join(wanted, "name", "left_semi").groupBy("name").agg(F.first("tokens").alias("tokens"))


def _with_partner(indexed: DataFrame) -> DataFrame:
    """Names of the sets that have enough keys on lists with other sets."""
    sets = indexed.filter("keys IS NOT NULL")
    by_key = Window.partitionBy("key")
    posting = sets.select("name", F.explode("keys").alias("key"))
    several = posting.withColumn("n0", F.min("name").over(by_key)).withColumn("n1", F.max("name").over(by_key)).filter("n0 <> n1")
    counted = several.select("name", "key").distinct().groupBy("name").agg(F.count("*").alias("met"))
    needs = sets.select("name", "need").distinct()
    return needs.join(counted, "name", "left").filter("need <= coalesce(met, 0)").select("name")


def _reduced(full: DataFrame, t: Threshold) -> DataFrame:
    """Sets (name, n, tokens) with the shingles that several of them have, rarest first."""
    occurring = full.select("name", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).repartition("token")  # one shuffle for the counts and the join
    counts = occurring.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1")
    ranked = occurring.join(counts, "token").groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("ranked"))
    return ranked.filter(F.size("ranked") >= t.least_of(F.col("n"))).select("name", "n", F.col("ranked.token").alias("tokens"))


def _prefix_lists(sets: DataFrame, t: Threshold, *more: str) -> DataFrame:
    """One row per set and shingle of its prefix; a set whose shingles are nearly all here is likely near the group's origin."""
    first = F.slice("tokens", F.lit(1), (F.size("tokens") - t.least_of(F.col("n")) + 1).cast("int"))
    return sets.select("name", "n", *more, F.struct((F.size("tokens") / F.col("n")).alias("share"), F.xxhash64("name").alias("h"), "name").alias("as_leader"), F.explode(first).alias("token"))


def _pair_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sizes (na, nb) and token arrays (ta, tb)."""
    left = sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b")


def _links(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by exact counts."""
    both = _pair_sets(pairs, sets).filter(t.sizes_fit(F.col("na"), F.col("nb")))
    return both.filter(t.holds(F.col("na"), F.col("nb"), F.size(F.array_intersect("ta", "tb")))).select("a", "b")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components of known components and new links."""
    return connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))


def _placed(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """Sets with their component, their own name where they are alone."""
    return sets.join(comp.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))


def _first_links(sets: DataFrame, t: Threshold) -> DataFrame:
    """Links to the leaders that a set shares most lists with."""
    lists = _prefix_lists(sets, t)
    leaders = lists.groupBy("token").agg(F.max("as_leader").alias("leader"), F.count("*").alias("sets")).filter("sets > 1")
    met = lists.join(leaders.select("token", F.col("leader.name").alias("leader")), "token").filter("leader <> name").groupBy("name", "leader").agg(F.count("*").alias("met"))
    most = F.slice(F.sort_array(F.collect_list(F.struct("met", "leader")), False), 1, LEADERS)
    pairs = met.groupBy("name").agg(most.alias("most")).select(F.col("name").alias("a"), F.explode("most.leader").alias("b"))
    return _links(pairs, sets, t)


def _across(sets: DataFrame, comp: DataFrame, t: Threshold) -> DataFrame:
    """Sets (name, n, component, tokens) with the shingles that several components have, in their order."""
    placed = _placed(sets, comp).select("name", "n", "component", F.posexplode("tokens").alias("at", "token")).repartition("token")
    spans = placed.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("token")
    kept = placed.join(spans, "token").groupBy("name", "n", "component").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("kept"))
    return kept.filter(F.size("kept") >= t.least_of(F.col("n"))).select("name", "n", "component", F.col("kept.token").alias("tokens"))


def _led(across: DataFrame, t: Threshold) -> DataFrame:
    """Each set with each leader of its lists: ``common`` shingles, ``excess``, and the differences between both."""
    lists = _prefix_lists(across, t, "component")
    leaders = lists.groupBy("token").agg(F.max("as_leader").alias("leader"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    pairs = lists.join(leaders.select("token", F.col("leader.name").alias("b")), "token").filter("name <> b").select(F.col("name").alias("a"), "b").distinct()
    both = _pair_sets(pairs, across).withColumn("common", F.size(F.array_intersect("ta", "tb")))
    differ = F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta"))
    return both.select("a", "na", "b", "nb", "common", t.excess(F.col("na"), F.size("tb"), F.col("common")).alias("excess"), differ.alias("differ"))


def _difference_sets(led: DataFrame, comp: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """Links that follow from the excesses alone, and the difference sets (leader, name, n, component, excess, need, shared).

    ``need``: the common differences that the set's easiest partner of another component asks for.
    """
    sets = _placed(led.select("b", F.col("a").alias("name"), F.col("na").alias("n"), "excess", "differ"), comp).withColumnRenamed("b", "leader")
    nearest = F.min(F.struct("excess", "component", "name"))
    first = sets.groupBy("leader").agg(nearest.alias("first"))
    ranked = sets.join(first, "leader")
    second = ranked.filter("component <> first.component").groupBy("leader").agg(nearest.alias("second"))
    ranked = ranked.join(second, "leader")  # leaders of one component have nothing left to join
    ranked = ranked.withColumn("mate", F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first"))).drop("first", "second")
    ranked = materialise(ranked, "ranked")
    sure = ranked.filter("excess + mate.excess <= 0").select(F.col("name").alias("a"), F.col("mate.name").alias("b"))
    ranked = ranked.withColumn("need", t.shared_differences(F.col("excess"), F.col("mate.excess"))).filter(F.size("differ") >= F.col("need"))
    tokens = ranked.select("leader", "name", "n", "component", "excess", "need", F.explode("differ").alias("token"))
    spans = tokens.groupBy("leader", "token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("sets")).filter("c0 <> c1")
    shared = tokens.join(spans.select("leader", "token", "sets"), ["leader", "token"]).groupBy("leader", "name", "n", "component", "excess", "need").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("shared"))
    return sure, materialise(shared.filter(F.size("shared") >= F.col("need")), "differences")


def _candidates(differences: DataFrame, t: Threshold) -> DataFrame:
    """Pairs of difference sets that share enough, by the heavy-light join."""
    sized = differences.withColumn("prefix", F.size("shared") - F.col("need") + 1)
    rows = sized.groupBy(F.when(F.col("need") < 2, MAX_LIGHT + 1).otherwise(F.least("prefix", F.lit(MAX_LIGHT + 1))).alias("prefix")).agg(F.count("*").alias("sets"), F.avg(F.element_at("shared", 1)["sets"]).alias("length")).collect()
    sizes, length = np.zeros(MAX_LIGHT + 2, np.int64), 1.0
    for r in rows:
        sizes[r.prefix] = r.sets
    if rows:
        length = sum(r.sets * r.length for r in rows) / sum(r.sets for r in rows)
    light = (F.col("need") >= 2) & (F.col("prefix") <= choose_boundary(sizes, length, t))
    base = sized.withColumn("light", light).select("leader", "name", "n", "component", "excess", "light", "prefix", F.col("shared.token").alias("shared"))
    own = ["leader", "name", "n", "component", "excess", "light"]
    one = base.select(*own, F.posexplode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("at", "key"), F.size("shared").alias("size")).select(*own, "key", (F.col("size") - F.col("at")).alias("rest"))
    two = base.filter("light").select(*own, F.slice("shared", F.lit(1), F.col("prefix") + 1).alias("p"), F.size("shared").alias("size"))
    two = two.select(*own, "size", "p", F.posexplode("p").alias("at", "x")).select(*own, (F.col("size") - F.col("at")).alias("rest"), "x", F.explode(F.expr("slice(p, at + 2, size(p))")).alias("y"))
    two = two.select(*own, F.xxhash64("x", "y").alias("key"), "rest")

    def met(rows: DataFrame, of_light: bool) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        need = t.shared_differences(F.col("x.excess"), F.col("y.excess"))
        fits = (F.col("x.name") < F.col("y.name")) & (F.col("x.component") != F.col("y.component")) & t.sizes_fit(F.col("x.n"), F.col("y.n")) & (F.least("x.rest", "y.rest") >= need)
        if not of_light:
            fits = fits & ~(F.col("x.light") & F.col("y.light"))
        return x.join(y, (F.col("x.leader") == F.col("y.leader")) & (F.col("x.key") == F.col("y.key")) & fits).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))

    return met(one, False).union(met(two, True)).distinct()


def row_key() -> F.Column:
    """Tells a document's rows from rows of other ids or texts."""
    return F.xxhash64("doc_id", "text")


def near_groups(docs: DataFrame, *, k: int = 5, threshold: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links), ``row_key``."""
    t = threshold
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_key", row_key())
    indexed = materialise(_indexed(base, _sketch(base, k), k, t), "sets")
    wanted = materialise(_with_partner(indexed), "wanted")
    named = materialise(indexed.select("doc_id", "row_key", "n_shingles", "name"), "names")
    drop_files(indexed)
    full = materialise(_full_sets(base, named, wanted, k), "fullsets")
    sets = materialise(_reduced(full, t), "reduced")
    drop_files(full)

    comp = connected_components(_first_links(sets, t))
    across = materialise(_across(sets, comp, t), "across")
    led = materialise(_led(across, t), "led")
    comp = _joined(comp, led.filter(t.holds(F.col("na"), F.col("nb"), F.col("common"))))
    sure, differences = _difference_sets(led, comp, t)
    last = materialise(sure.union(_links(_candidates(differences, t), across, t)), "links")
    if not last.isEmpty():
        comp = _joined(comp, last)
    for table in (wanted, sets, across, led, differences):
        drop_files(table)

    placed = named.join(comp.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    lowest = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    return placed.join(lowest, "component", "left").select("doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id"), "row_key")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stand for their group, with all columns: those with the group's smallest doc_id, once each.

    Rows without doc_id stay only where their whole group has none; of rows with equal doc_id and text one stays; other columns may have
    any names. Rows that are surely kept, by a bit table
    of the others' keys, don't take part in the shuffle that looks the others up.
    """
    names = docs.columns
    place = {n.lower(): k for k, n in enumerate(names)}
    own = docs.select(*[plain_column(n).alias(f"c{k}") for k, n in enumerate(names)])  # no name can clash with ours
    identity, text = F.col(f"c{place['doc_id']}").cast("long").alias("doc_id"), F.col(f"c{place['text']}").alias("text")
    groups = materialise(near_groups(own.select(identity, text), **options).select("row_key", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")).groupBy("row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "groups")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(groups.filter("NOT kept OR n > 1"), "row_key"))
    keyed = own.select("*", F.xxhash64(identity, text).alias("row_key")).select("*", spot("row_key"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields if f.name != "spot")

    def chosen(listed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = unpacked(table.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(bits[batch.column(batch.num_columns - 1).to_numpy()] == listed))

        return keyed.mapInArrow(run, fields)

    looked_up = chosen(True).dropDuplicates(["row_key"]).join(groups.filter("kept").select("row_key"), "row_key", "left_semi")
    return chosen(False).select(*own.columns).unionByName(looked_up.select(*own.columns)).toDF(*names)
