"""The signal kernels in SQL, for checking: a banded solve and a recursive filter, value by value."""

from __future__ import annotations

from pulsegrid.config import DEFAULT
from pulsegrid.functions.dsp import butterworth

_PAD = 3 * (2 * DEFAULT.filter_order + 1)


def detrended(src: str, out: str, n: int) -> str:
    """Tables that end in ``out`` (key, i, x): ``src`` less its smooth trend, which solves (I + lambda^2 D'D) t = x for second differences D by LDL'."""
    lam = DEFAULT.detrend_lambda**2
    main = f"1 + {lam} * CASE WHEN j IN (0, {n - 1}) THEN 1 WHEN j IN (1, {n - 2}) THEN 5 ELSE 6 END"
    below = f"-{lam} * CASE WHEN j IN (1, {n - 1}) THEN 2 ELSE 4 END"
    return f"""
{out}_f AS (
  SELECT 0 AS i, 0.0::DOUBLE AS l1, 0.0::DOUBLE AS l2, {1 + lam}::DOUBLE AS d, 0.0::DOUBLE AS dp
  UNION ALL
  SELECT j, m1, m2, {main} - m1 * m1 * d - m2 * m2 * dp, d FROM (SELECT *, ({below} - m2 * dp * l1) / d AS m1 FROM (SELECT i + 1 AS j, l1, d, dp, CASE WHEN i >= 1 THEN {lam} / dp ELSE 0 END AS m2 FROM {out}_f WHERE i < {n - 1}))),
{out}_z AS (
  SELECT key, i, CAST(x AS DOUBLE) AS z, 0.0::DOUBLE AS z1 FROM {src} WHERE i = 0
  UNION ALL
  SELECT s.key, s.i, s.x - f.l1 * p.z - f.l2 * p.z1, p.z FROM {out}_z p JOIN {src} s ON s.key = p.key AND s.i = p.i + 1 JOIN {out}_f f ON f.i = s.i),
{out}_t AS (
  SELECT key, i, z / d AS t, 0.0::DOUBLE AS t1 FROM {out}_z JOIN {out}_f USING (i) WHERE i = {n - 1}
  UNION ALL
  SELECT z.key, z.i, z.z / f.d - f1.l1 * p.t - coalesce(f2.l2, 0) * p.t1, p.t FROM {out}_t p JOIN {out}_z z ON z.key = p.key AND z.i = p.i - 1 JOIN {out}_f f ON f.i = z.i JOIN {out}_f f1 ON f1.i = z.i + 1 LEFT JOIN {out}_f f2 ON f2.i = z.i + 2),
{out} AS (SELECT s.key, s.i, s.x - t.t AS x FROM {src} s JOIN {out}_t t ON s.key = t.key AND s.i = t.i)"""


def _one_pass(src: str, out: str, b: list[float], a: list[float], zi: list[float]) -> str:
    """One run of the filter in direct form II transposed over (key, k, x), begun in the state of a constant series."""
    n = len(zi)
    states = ", ".join(f"s{j + 1} + x * {b[j + 1]} - y * ({a[j + 1]}) AS s{j}" if j < n - 1 else f"x * {b[n]} - y * ({a[n]}) AS s{j}" for j in range(n))
    begin = ", ".join(f"x * ({z}) AS s{j}" for j, z in enumerate(zi))
    held = ", ".join(f"p.s{j}" for j in range(n))
    return f"""
{out} AS (
  SELECT key, k, y, {states} FROM (SELECT *, {b[0]} * x + s0 AS y FROM (SELECT key, k, x, {begin} FROM {src} WHERE k = 0))
  UNION ALL
  SELECT key, k, y, {states} FROM (SELECT *, {b[0]} * x + s0 AS y FROM (SELECT s.key, s.k, s.x, {held} FROM {out} p JOIN {src} s ON s.key = p.key AND s.k = p.k + 1)))"""


def bandpassed(src: str, out: str, n: int, fps: float = DEFAULT.fps) -> str:
    """Tables that end in ``out`` (key, i, x): ``src`` without trend, padded by point reflection, filtered forwards and backwards."""
    b, a, zi = (x.tolist() for x in butterworth(DEFAULT.filter_order, DEFAULT.hr_lo_hz, DEFAULT.hr_hi_hz, fps))
    m = n + 2 * _PAD
    return f"""{detrended(src, f"{out}_d", n)},
{out}_e AS (SELECT l.key, l.x AS first, r.x AS last FROM {out}_d l JOIN {out}_d r ON l.key = r.key AND l.i = 0 AND r.i = {n - 1}),
{out}_k AS (SELECT k, CASE WHEN k < {_PAD} THEN {_PAD} - k WHEN k >= {n + _PAD} THEN {2 * (n - 1) + _PAD} - k ELSE k - {_PAD} END AS i FROM (SELECT unnest(range({m})) AS k)),
{out}_p AS (SELECT d.key, k.k, CASE WHEN k.k < {_PAD} THEN 2 * first - d.x WHEN k.k >= {n + _PAD} THEN 2 * last - d.x ELSE d.x END AS x FROM {out}_d d JOIN {out}_k k ON k.i = d.i JOIN {out}_e e ON e.key = d.key),
{_one_pass(f"{out}_p", f"{out}_1", b, a, zi)},
{out}_r AS (SELECT key, {m - 1} - k AS k, y AS x FROM {out}_1),
{_one_pass(f"{out}_r", f"{out}_2", b, a, zi)},
{out} AS (SELECT key, {m - 1 - _PAD} - k AS i, y AS x FROM {out}_2 WHERE k BETWEEN {_PAD} AND {m - 1 - _PAD})"""


def heart_rates(src: str, out: str, n: int, size: int, fps: float = DEFAULT.fps) -> str:
    """Tables that end in ``out`` (key, hr, conf) from (key, i, x); flat series have no rate."""
    band = f"k * {fps} / {float(size)} BETWEEN {DEFAULT.hr_lo_hz} AND {DEFAULT.hr_hi_hz}"
    return f"""
{out}_c AS (SELECT key, i, (x - avg(x) OVER (PARTITION BY key)) * (0.5 - 0.5 * cos(2 * pi() * i / {n - 1})) AS y FROM {src}),
{out}_b AS (SELECT k FROM (SELECT unnest(range({size // 2 + 1})) AS k) WHERE {band}),
{out}_p AS (SELECT key, k, pow(sum(y * cos(2 * pi() * k * i / {size})), 2) + pow(sum(y * sin(2 * pi() * k * i / {size})), 2) AS power FROM {out}_c, {out}_b GROUP BY key, k),
{out}_m AS (SELECT key, max(power) AS top, median(power) AS mid FROM {out}_p GROUP BY key),
{out}_s AS (SELECT key, stddev_pop(x) >= 1e-9 AS lively FROM {src} GROUP BY key),
{out} AS (SELECT key, CASE WHEN lively THEN min(k) * {fps} / {float(size)} * 60 END AS hr, CASE WHEN lively THEN any_value(top / (mid + 1e-12)) ELSE 0 END AS conf FROM {out}_p JOIN {out}_m USING (key) JOIN {out}_s USING (key) WHERE power = top GROUP BY key, lively)"""
