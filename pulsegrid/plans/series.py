"""Registered queries on gaps, windows, grids and regions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid.operators import combine, gaps, intervals, resampling, windows
from pulsegrid.plans.adapters import EVENTS, SQL_INTERVALS, SQL_REGIONS, SQL_TIMELINE, SQL_WINDOWS, UNIT, fixed_windows, regions, timeline
from pulsegrid.scratch import shared_dir
from pulsegrid.sources import archives, readers

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SQL_TIMELINE} SELECT clip, round(median(dt), 3) AS median_dt FROM (SELECT clip, t - lag(t) OVER (PARTITION BY clip ORDER BY t) AS dt FROM ev) GROUP BY clip")
def w1_median_step(spark, sf_dir):
    return gaps.median_step(timeline(spark, sf_dir), ["clip"]).select("clip", F.round("median_dt", 3).alias("median_dt"))


@query(f"WITH {SQL_REGIONS}, {SQL_INTERVALS} SELECT clip, region, round(start_t, 3) AS start_t, round(end_t, 3) AS end_t FROM iv")
def w2_broken_intervals(spark, sf_dir):
    out = gaps.broken_intervals(regions(spark, sf_dir).select("clip", "region", "t", "valid"), EVENTS)
    return out.select("clip", "region", F.round("start_t", 3).alias("start_t"), F.round("end_t", 3).alias("end_t"))


_GATE = """
ov AS (SELECT win.clip, region, w_start, least(w_end, end_t) - greatest(w_start, start_t) AS d FROM win JOIN iv USING (clip) WHERE least(w_end, end_t) > greatest(w_start, start_t)),
ga AS (SELECT win.clip, k.region, win.w_start, win.w_end, coalesce(max(d), 0.0) AS longest, coalesce(sum(d), 0.0) AS total
  FROM win CROSS JOIN (VALUES ('forehead'), ('lcheek'), ('rcheek')) AS k(region) LEFT JOIN ov ON ov.clip = win.clip AND ov.region = k.region AND ov.w_start = win.w_start GROUP BY ALL)"""


def _gated(spark, sf_dir):
    rows = regions(spark, sf_dir).select("clip", "region", "t", "valid")
    return gaps.gate(fixed_windows(spark, sf_dir), gaps.broken_intervals(rows, EVENTS), rows.select("clip", "region").distinct(), EVENTS)


@query(f"WITH {SQL_REGIONS}, {SQL_INTERVALS}, {SQL_WINDOWS}, {_GATE} SELECT clip, region, w_start, round(longest, 3) AS longest, round(total, 3) AS total, longest <= 86400 AND total <= 172800 AS region_valid FROM ga")
def j7_w4_region_gates(spark, sf_dir):
    return _gated(spark, sf_dir).select("clip", "region", "w_start", F.round("longest", 3).alias("longest"), F.round("total", 3).alias("total"), "region_valid")


@query(f"WITH {SQL_REGIONS}, {SQL_INTERVALS}, {SQL_WINDOWS}, {_GATE} SELECT clip, w_start, w_end, n AS valid_regions, n >= 2 AS accepted FROM (SELECT clip, w_start, w_end, count(*) FILTER (longest <= 86400 AND total <= 172800) AS n FROM ga GROUP BY ALL)")
def w5_accepted_fixed(spark, sf_dir):
    return gaps.accepted(_gated(spark, sf_dir), EVENTS).select("clip", "w_start", "w_end", "valid_regions", "accepted")


# the sweep as recursion: a clip's lists of broken intervals by region, and one window after the other (w_: window, g_: longest gap, t_: total)
_CUT = "list_transform(list_filter({iv}, lambda x: least(x.e, st + 432000.0) > greatest(x.s, st)), lambda x: {{'s': greatest(x.s, st), 'e': least(x.e, st + 432000.0)}})"
_FAILS = "(coalesce(list_max(list_transform({cut}, lambda x: x.e - x.s)), 0) > 86400 OR coalesce(list_sum(list_transform({cut}, lambda x: x.e - x.s)), 0) > 172800)"
_LATE = """list_min(list_transform(list_filter(range(1, len({cut}) + 1), lambda k: coalesce(list_max(list_transform({cut}[k + 1:], lambda x: x.e - x.s)), 0) <= 86400
  AND coalesce(list_sum(list_transform({cut}[k + 1:], lambda x: x.e - x.s)), 0) <= 172800), lambda k: {cut}[k].e))"""


def _for_regions(text: str, **of: str) -> str:
    return ", ".join(f"{text.format(cut=f'c{i}', iv=f'i{i}', **of)} AS {name}{i}" for i, name in ((i, of.get("name", "")) for i in (1, 2, 3)))


_SWEEP = f"""
spn AS (SELECT clip, max(t) AS last_t FROM ev GROUP BY clip HAVING max(t) > 0),
lists AS (SELECT spn.clip, last_t, {", ".join(f"coalesce(list({{'s': start_t, 'e': end_t}} ORDER BY start_t) FILTER (region = '{r}'), []) AS i{i}" for i, r in ((1, "forehead"), (2, "lcheek"), (3, "rcheek")))} FROM spn LEFT JOIN iv USING (clip) GROUP BY spn.clip, last_t),
steps AS (
  SELECT clip, 0.0::DOUBLE AS st, 0 AS n, NULL::DOUBLE AS began, 0 AS valid_regions, [true, true, true] AS mask FROM lists
  UNION ALL
  SELECT clip, CASE WHEN passed >= 2 THEN st + 324000.0 ELSE least(coalesce(r1, 1e300), coalesce(r2, 1e300), coalesce(r3, 1e300)) END, n + (passed >= 2)::INT, CASE WHEN passed >= 2 THEN st END, passed, [NOT f1, NOT f2, NOT f3]
  FROM (SELECT *, (NOT f1)::INT + (NOT f2)::INT + (NOT f3)::INT AS passed, {", ".join(f"CASE WHEN f{i} THEN {_LATE.format(cut=f'c{i}')} END AS r{i}" for i in (1, 2, 3))}
    FROM (SELECT *, {_for_regions(_FAILS, name="f")}
      FROM (SELECT steps.clip, st, n, {_for_regions(_CUT, name="c")} FROM steps JOIN lists USING (clip) WHERE st + 432000.0 <= last_t + 1e-9)))),
acc AS (SELECT clip || '_' || n AS segment, clip, n, began, valid_regions, mask FROM steps WHERE began IS NOT NULL)"""


@query(f"WITH RECURSIVE {SQL_REGIONS}, {SQL_INTERVALS}, {_SWEEP} SELECT segment, clip, CAST(n AS BIGINT) AS index, began AS t_start, began + 432000.0 AS t_end, CAST(valid_regions AS BIGINT) AS valid_regions FROM acc")
def w3_accepted_windows(spark, sf_dir):
    """The greedy search: windows restart at the end of what broke them."""
    found = windows.find_windows(regions(spark, sf_dir).select("clip", "region", "t", "valid"), EVENTS)
    return found.select("segment", "clip", F.col("index").cast("long").alias("index"), "t_start", "t_end", F.size(F.filter("region_mask", lambda x: x)).cast("long").alias("valid_regions"))


@query(f"WITH {SQL_REGIONS}, {SQL_INTERVALS}, {SQL_WINDOWS}, {_GATE}, ac AS (SELECT clip, w_start FROM ga GROUP BY clip, w_start HAVING count(*) FILTER (longest <= 86400 AND total <= 172800) >= 2) SELECT clip, count(*) AS windows FROM ac GROUP BY ROLLUP (clip)")
def g18_windows_per_clip(spark, sf_dir):
    from pulsegrid.operators.metrics import clip_summary

    return clip_summary(gaps.accepted(_gated(spark, sf_dir), EVENTS).filter("accepted"))


@query(f"WITH {SQL_TIMELINE} SELECT clip, frame_idx, round(CASE WHEN n > 1 THEN 180.0::DOUBLE * frame_idx / (n - 1) ELSE 0 END, 6) AS t FROM (SELECT clip, frame_idx, count(*) OVER (PARTITION BY clip) AS n FROM fr)")
def w9_fixed_timeline(spark, sf_dir):
    out = windows.fixed_timeline(timeline(spark, sf_dir))
    return out.select("clip", F.col("frame_idx").cast("long").alias("frame_idx"), F.round("t", 6).alias("t"))


@query(f"WITH {SQL_TIMELINE} SELECT clip, day, CASE WHEN count(*) = count(v) THEN round(avg(v), 7) END AS value FROM (SELECT clip, CAST(floor(t / 86400) AS BIGINT) AS day, CASE WHEN event_type <> 'error' THEN value END AS v FROM ev) GROUP BY clip, day")
def i1_duplicate_times(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("clip", F.floor(F.col("t") / 86400).alias("day"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return resampling.collapse_duplicates(rows, ["clip", "day"], ["value"]).select("clip", "day", F.round("value", 7).alias("value"))


@query(
    f"""WITH {SQL_TIMELINE}, lim AS (SELECT clip, max(t) AS m FROM ev GROUP BY clip),
g AS (SELECT clip, unnest(range(0, CAST(floor(m / 43200) AS BIGINT) + 2)) * 43200.0::DOUBLE AS t FROM lim),
s AS (SELECT clip, t AS at, value FROM ev),
lo AS (SELECT g.clip, g.t, s.at AS t0, s.value AS v0 FROM g ASOF LEFT JOIN s ON g.clip = s.clip AND g.t >= s.at),
hi AS (SELECT g.clip, g.t, s.at AS t1, s.value AS v1 FROM g ASOF LEFT JOIN s ON g.clip = s.clip AND g.t <= s.at)
SELECT clip, t, round(coalesce(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1), 4) AS value FROM lo JOIN hi USING (clip, t)"""
)
def i4_linear_grid(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    grid = rows.groupBy("clip").agg(F.max("t").alias("m")).select("clip", F.explode(F.sequence(F.lit(0), (F.floor(F.col("m") / 43200) + 1).cast("int"))).alias("k")).select("clip", (F.col("k") * F.lit(43200.0)).alias("t"))
    out = resampling.interpolate_linear(rows.select("clip", "t", "value"), grid, ["clip"], "value")
    return out.select("clip", "t", F.round("value", 4).alias("value"))


@query(f"WITH {SQL_TIMELINE}, {SQL_WINDOWS} SELECT clip, w_start, 600 AS n, round(w_start, 4) AS first_t, round(w_start + 599 / 30.0::DOUBLE, 4) AS last_t, round(sum(w_start + k / 30.0::DOUBLE), 2) AS sum_t FROM win, (SELECT unnest(range(600)) AS k) GROUP BY ALL")
def i5_uniform_grid(spark, sf_dir):
    grid = resampling.uniform_grid(fixed_windows(spark, sf_dir).withColumn("abs_start", F.col("w_start")))
    return grid.groupBy("clip", "w_start").agg(F.count("*").cast("int").alias("n"), F.round(F.min("t"), 4).alias("first_t"), F.round(F.max("t"), 4).alias("last_t"), F.round(F.sum("t"), 2).alias("sum_t"))


_SMOOTH = """
sm AS (SELECT *, CAST(CASE WHEN count(*) OVER (PARTITION BY clip, region) >= 30 THEN sum(pixel_count) OVER (PARTITION BY clip, region ORDER BY frame_idx ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) ELSE pixel_count END AS DOUBLE) AS weight FROM rg)"""


@query(f"WITH {SQL_REGIONS}, {_SMOOTH} SELECT clip, region, frame_idx, weight FROM sm")
def f1_smoothed_counts(spark, sf_dir):
    return combine.smooth_counts(regions(spark, sf_dir)).select("clip", "region", F.col("frame_idx").cast("long").alias("frame_idx"), "weight")


@query(
    f"""WITH {SQL_REGIONS}, {_SMOOTH} SELECT clip, frame_idx, round(sum(coalesce(r, 0) * weight) / nullif(sum(weight), 0), 4) AS r, round(sum(coalesce(g, 0) * weight) / nullif(sum(weight), 0), 4) AS g,
round(sum(coalesce(b, 0) * weight) / nullif(sum(weight), 0), 4) AS b, round(sum(CASE WHEN g IS NULL THEN weight ELSE 0 END) / nullif(sum(weight), 0), 4) AS missing_weight FROM sm GROUP BY clip, frame_idx"""
)
def g2_combined_regions(spark, sf_dir):
    out = combine.combine_regions(regions(spark, sf_dir))
    return out.select("clip", F.col("frame_idx").cast("long").alias("frame_idx"), *[F.round(c, 4).alias(c) for c in ("r", "g", "b", "missing_weight")])


@query(f"WITH {SQL_REGIONS} SELECT clip, frame_idx, round(avg(r), 4) AS r, round(avg(g), 4) AS g, round(avg(b), 4) AS b FROM rg GROUP BY clip, frame_idx")
def g3_plain_mean(spark, sf_dir):
    out = combine.combine_regions(regions(spark, sf_dir), weighted=False)
    return out.select("clip", F.col("frame_idx").cast("long").alias("frame_idx"), *[F.round(c, 4).alias(c) for c in ("r", "g", "b")])


@query(f"WITH {SQL_REGIONS} SELECT clip, count(*) AS frames, round(avg(CAST(v AS DOUBLE)), 6) AS valid_share FROM (SELECT clip, frame_idx, max((r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)::INT) AS v FROM rg GROUP BY clip, frame_idx) GROUP BY clip")
def p1_p2_validity(spark, sf_dir):
    out = combine.frame_validity(combine.region_valid(regions(spark, sf_dir).drop("valid")))
    return out.select("clip", "frames", F.round("valid_share", 6).alias("valid_share"))


@query(f"WITH {SQL_REGIONS} SELECT clip, region, count(*) AS frames, count(CASE WHEN pixel_count >= 80 THEN r END) AS coloured, CAST(sum(pixel_count) AS BIGINT) AS pixels FROM rg GROUP BY clip, region")
def p3_pixel_gate(spark, sf_dir):
    out = combine.gate_by_count(regions(spark, sf_dir))
    return out.groupBy("clip", "region").agg(F.count("*").alias("frames"), F.count("r").alias("coloured"), F.sum("pixel_count").cast("long").alias("pixels"))


@query(f"WITH {SQL_TIMELINE}, {SQL_WINDOWS} SELECT win.clip, w_start, count(*) AS n, round(avg(value), 7) AS mean_value FROM win JOIN ev ON ev.clip = win.clip AND t BETWEEN w_start AND w_end GROUP BY ALL")
def j6_samples_in_windows(spark, sf_dir):
    inside = intervals.points_inside(fixed_windows(spark, sf_dir), timeline(spark, sf_dir).select("clip", "t", "value"), ["clip"], start="w_start", end="w_end", at="t", width=EVENTS.step_s)
    return inside.groupBy("clip", "w_start").agg(F.count("*").alias("n"), F.round(F.avg("value"), 7).alias("mean_value"))


@query(
    f"""WITH {SQL_TIMELINE}, {SQL_WINDOWS}, rate AS (SELECT clip, (count(*) - 1) / max(t) AS fs FROM ev GROUP BY clip HAVING max(t) > 0)
SELECT win.clip, w_start, count(*) AS n, round(sum(value), 4) AS total FROM win JOIN rate USING (clip) JOIN fr ON fr.clip = win.clip AND frame_idx >= round_even(w_start * fs, 0) AND frame_idx < round_even(w_end * fs, 0) GROUP BY ALL"""
)
def j5_slices(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    rate = rows.groupBy("clip").agg(F.count("*").alias("n"), F.max("t").alias("m")).filter("m > 0").select("clip", ((F.col("n") - 1) / F.col("m")).alias("fs"))
    cut = fixed_windows(spark, sf_dir).join(rate, "clip").withColumn("lo", F.rint(F.col("w_start") * F.col("fs"))).withColumn("hi", F.rint(F.col("w_end") * F.col("fs")))
    inside = intervals.points_inside(cut, rows.select("clip", "frame_idx", "value"), ["clip"], start="lo", end="hi", at="frame_idx", width=64.0, closed=False)
    return inside.groupBy("clip", "w_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _edge(h0: str, h1: str, m0: str, m1: str) -> str:
    """The end slope of the shape-preserving cubic."""
    edge = f"((2 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1})"
    return f"CASE WHEN sign({edge}) <> sign({m0}) THEN 0 WHEN sign({m0}) <> sign({m1}) AND abs({edge}) > 3 * abs({m0}) THEN 3 * {m0} ELSE {edge} END"


@query(
    f"""WITH RECURSIVE {SQL_REGIONS}, {SQL_INTERVALS}, {_SWEEP},
win AS (SELECT segment, clip, began, region, mask[place] AS valid FROM acc, (VALUES ('forehead', 1), ('lcheek', 2), ('rcheek', 3)) AS k(region, place)),
ins AS (SELECT segment, win.region AS name, win.valid, began, t, g, CAST(pixel_count AS DOUBLE) AS px FROM win JOIN rg ON rg.clip = win.clip AND rg.region = win.region AND t BETWEEN began AND began + 432000.0),
grid AS (SELECT segment, name, valid, began + k * 720.0::DOUBLE AS pt FROM (SELECT DISTINCT segment, name, valid, began FROM ins), (SELECT unnest(range(600)) AS k)),
pn AS (SELECT segment, name, t, px, lead(t) OVER o AS t1, lead(px) OVER o AS px1 FROM ins WINDOW o AS (PARTITION BY segment, name ORDER BY t)),
fst AS (SELECT segment, name, arg_min(px, t) AS px0 FROM ins GROUP BY ALL),
counts AS (SELECT segment, name, count(*) AS n, sum(CASE WHEN valid THEN CAST(coalesce(CASE WHEN t1 IS NULL THEN px ELSE px + (px1 - px) * (pt - t) / (t1 - t) END, px0) AS FLOAT) ELSE 0 END) AS sum_px
  FROM (SELECT grid.segment, grid.name, valid, pt, t, t1, px, px1 FROM grid ASOF LEFT JOIN pn ON grid.segment = pn.segment AND grid.name = pn.name AND pt >= t) JOIN fst USING (segment, name) GROUP BY segment, name),
nd0 AS (SELECT segment, name, began, t, g, row_number() OVER o AS i, count(*) OVER (PARTITION BY segment, name) AS n, lead(t) OVER o - t AS h, (lead(g) OVER o - g) / (lead(t) OVER o - t) AS m FROM ins WHERE valid AND g IS NOT NULL WINDOW o AS (PARTITION BY segment, name ORDER BY t)),
nd1 AS (SELECT *, lag(h) OVER o AS hp, lag(m) OVER o AS mp, lag(h, 2) OVER o AS hp2, lag(m, 2) OVER o AS mp2, lead(h) OVER o AS hn, lead(m) OVER o AS mn FROM nd0 WINDOW o AS (PARTITION BY segment, name ORDER BY t)),
nd AS (SELECT *, CASE WHEN n = 2 THEN coalesce(m, mp) WHEN i = 1 THEN {_edge("h", "hn", "m", "mn")} WHEN i = n THEN {_edge("hp", "hp2", "mp", "mp2")}
  WHEN mp * m > 0 THEN (3 * h + 3 * hp) / ((2 * h + hp) / mp + (h + 2 * hp) / m) ELSE 0 END AS d FROM nd1),
sg AS (SELECT segment, name, t, g, h, d, lead(g) OVER o AS g1, lead(d) OVER o AS d1 FROM nd WINDOW o AS (PARTITION BY segment, name ORDER BY t)),
reach AS (SELECT segment, name, min(t) AS lo, max(t) AS hi FROM nd GROUP BY segment, name HAVING count(*) >= 2 AND min(t) - any_value(began) <= 1.5 * median(h) AND any_value(began) + 599 * 720.0 - max(t) <= 1.5 * median(h)),
pts AS (SELECT segment, name, least(greatest(pt, lo), hi) AS pt FROM grid JOIN reach USING (segment, name)),
colours AS (SELECT segment, name, sum(CAST((1 + 2 * s) * (1 - s) * (1 - s) * g + s * (1 - s) * (1 - s) * h * d + s * s * (3 - 2 * s) * g1 + s * s * (s - 1) * h * d1 AS FLOAT)) AS sum_g
  FROM (SELECT pts.segment, pts.name, (pt - t) / h AS s, g, h, d, g1, d1 FROM pts ASOF JOIN (SELECT * FROM sg WHERE h IS NOT NULL) x ON pts.segment = x.segment AND pts.name = x.name AND pt >= t) GROUP BY segment, name)
SELECT segment, name, valid, CAST(counts.n AS INT) AS n, round(CAST(sum_g AS DOUBLE), 2) AS sum_g, round(CAST(sum_px AS DOUBLE), 2) AS sum_px FROM (SELECT DISTINCT segment, name, valid FROM ins) JOIN counts USING (segment, name) LEFT JOIN colours USING (segment, name)"""
)
def i2_i3_packed_samples(spark, sf_dir):
    """PCHIP-resampled windows of the greedy search, summed up per region."""
    from dataclasses import replace

    config = replace(EVENTS, fps=600 / EVENTS.window_s)
    rows = regions(spark, sf_dir)
    found = windows.find_windows(rows.select("clip", "region", "t", "valid"), config)
    packed = resampling.resample(rows.select("clip", "region", "t", "r", "g", "b", "pixel_count"), found, config)
    each = packed.select("segment", F.explode("regions").alias("x"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double")), 2)
    return each.select("segment", "x.name", "x.valid", F.size("x.px").alias("n"), total("x.g").alias("sum_g"), total("x.px").alias("sum_px"))


@query(f"WITH {SQL_TIMELINE} SELECT clip, count(*) AS n, round(min(t), 3) AS first_t, round(max(t), 3) AS last_t FROM fr WHERE frame_idx < 20 GROUP BY clip")
def o8_prefix(spark, sf_dir):
    return timeline(spark, sf_dir).filter("frame_idx < 20").groupBy("clip").agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("first_t"), F.round(F.max("t"), 3).alias("last_t"))


@query(f"WITH {SQL_TIMELINE} SELECT clip, count(*) AS n, round(max(t) / {UNIT}, 4) AS units FROM ev GROUP BY clip")
def s5_clip_spans(spark, sf_dir):
    return timeline(spark, sf_dir).groupBy("clip").agg(F.count("*").alias("n"), F.round(F.max("t") / UNIT, 4).alias("units"))


@query(f"WITH {SQL_TIMELINE} SELECT clip, count(*) AS frames FROM fr GROUP BY clip")
def s3_frame_counts(spark, sf_dir):
    return readers.frame_counts(timeline(spark, sf_dir))


@query(f"WITH {SQL_REGIONS} SELECT clip, 3 * count(DISTINCT frame_idx) * 3 AS n, round(sum(coalesce(r, 0) + coalesce(g, 0) + coalesce(b, 0)), 4) AS total, 9 * count(DISTINCT frame_idx) - 3 * count(r) AS missing FROM rg GROUP BY clip")
def k3_s8_signal_archives(spark, sf_dir):
    """Every clip's signals written as an archive in the shared folder and read again."""
    path = f"{shared_dir(spark)}/signals-{uuid.uuid4().hex}"
    archives.write(regions(spark, sf_dir).drop("valid"), path, "signals")
    rows = readers.npz(spark, path, ["signals"], "_signals.npz")
    known = F.filter("values", lambda v: ~F.isnan(v))
    return rows.select(F.col("name").alias("clip"), F.size("values").cast("long").alias("n"), F.round(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), 4).alias("total"), (F.size("values") - F.size(known)).cast("long").alias("missing"))
