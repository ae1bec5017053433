"""The same results in plain SQL, written independently of the operators.

Windows are counted by ranging over the raw readings, crossings by joining every
threshold, and all partial derivatives are written out by hand.
"""

from __future__ import annotations

import math

import numpy as np

R = "0.00831446"
TC, TW = "293.15", "303.15"
SPAN = f"(1.0/{TW} - 1.0/{TC})"

_READINGS = """
readings AS (
  SELECT l_suppkey AS station, l_shipdate AS t,
         l_quantity - 0.5::DOUBLE * (l_linenumber % 2) AS v
  FROM lineitem),
span AS (
  SELECT date_trunc('month', min(t))::DATE AS first_m, date_trunc('month', max(t))::DATE AS last_m
  FROM readings)"""

_COVERAGE = f"""{_READINGS},
starts AS (
  SELECT station, unnest(generate_series(first_m::TIMESTAMP, last_m::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS start
  FROM (SELECT DISTINCT station FROM readings), span),
cov AS (
  SELECT s.station, s.start, year(s.start)::INT AS year, month(s.start)::INT AS mon,
         count(r.t) AS n,
         date_diff('day', s.start, (s.start + INTERVAL 12 MONTH)::DATE) AS expected,
         count(r.t) / date_diff('day', s.start, (s.start + INTERVAL 12 MONTH)::DATE)::DOUBLE AS pct
  FROM starts s LEFT JOIN readings r
    ON r.station = s.station AND r.t >= s.start AND r.t < s.start + INTERVAL 12 MONTH
  GROUP BY s.station, s.start),
best AS (
  SELECT station, start, year, mon, n, expected, pct FROM (
    SELECT *, row_number() OVER (PARTITION BY station ORDER BY pct DESC, year DESC, mon DESC) AS rn
    FROM cov) WHERE rn = 1),
inside AS (
  SELECT r.station, r.t, r.v, b.start FROM readings r JOIN best b
    ON r.station = b.station AND r.t >= b.start AND r.t < b.start + INTERVAL 12 MONTH),
temps AS (SELECT unnest(range(-5, 51))::INT AS temp_c),
hist AS (
  SELECT b.station, g.temp_c, coalesce(c.n, 0)::BIGINT AS n
  FROM best b CROSS JOIN temps g
  LEFT JOIN (SELECT station, round_even(v, 0)::INT AS temp_c, count(*) AS n FROM inside GROUP BY 1, 2) c
    ON c.station = b.station AND c.temp_c = g.temp_c)"""

_SWEPT = f"""{_READINGS},
swept_starts AS (
  SELECT station, unnest(generate_series(a, z, INTERVAL 7 DAY)) AS start
  FROM (SELECT DISTINCT station FROM readings), (SELECT min(t)::TIMESTAMP AS a, max(t)::TIMESTAMP AS z FROM readings)),
swept AS (
  SELECT s.station, s.start, count(r.t) AS n, 90::BIGINT AS expected, count(r.t) / 90.0::DOUBLE AS pct
  FROM swept_starts s LEFT JOIN readings r
    ON r.station = s.station AND r.t >= s.start AND r.t < s.start + INTERVAL 90 DAY
  GROUP BY s.station, s.start),
swept_best AS (
  SELECT station, start, n, expected, pct FROM (
    SELECT *, row_number() OVER (PARTITION BY station ORDER BY pct DESC, start DESC) AS rn FROM swept) WHERE rn = 1),
swept_inside AS (
  SELECT r.station, r.t, r.v, b.start FROM readings r JOIN swept_best b
    ON r.station = b.station AND r.t >= b.start AND r.t < b.start + INTERVAL 90 DAY)"""


def _ranged(source: str, begin: str, end: str, step: str, length: str) -> str:
    """Readings of ``source`` in windows by a range join; keys without any are left out."""
    return f"""starts AS (
  SELECT station, unnest(generate_series({begin}, {end}, INTERVAL {step})) AS start FROM (SELECT DISTINCT station FROM {source})),
counted AS (
  SELECT s.station, s.start, count(r.t) AS n FROM starts s LEFT JOIN {source} r
    ON r.station IS NOT DISTINCT FROM s.station AND r.t >= s.start AND r.t < s.start + INTERVAL {length}
  GROUP BY s.station, s.start)
SELECT * FROM counted WHERE station IN (SELECT station FROM counted WHERE n > 0)"""


_POOLED = """
months AS (
  SELECT unnest(generate_series(first_m::TIMESTAMP, last_m::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS start FROM span),
pooled AS (
  SELECT m.start, year(m.start)::INT AS year, month(m.start)::INT AS mon, count(r.t) AS n
  FROM months m LEFT JOIN readings r ON r.t >= m.start AND r.t < m.start + INTERVAL 12 MONTH
  GROUP BY m.start),
top10 AS (SELECT * FROM pooled ORDER BY n DESC, start LIMIT 10)"""

_PLACES = """
places AS (
  SELECT n_nationkey AS nationkey, n_name AS state, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
stations AS (
  SELECT s_suppkey AS station, s_name AS name, s_acctbal / 100 AS lat, 0.0::DOUBLE - s_acctbal / 50 AS lon,
         state, region
  FROM supplier JOIN places ON s_nationkey = nationkey),
shore AS (
  SELECT region, state, CASE WHEN state = 'IRAN' THEN 66459.0 ELSE 100.0 * count(*) END::DOUBLE AS length
  FROM customer JOIN places ON c_nationkey = nationkey GROUP BY region, state)"""

_BOTTLES = """
bottles AS (
  SELECT user_id AS bottle, event_id, event_type, value,
         CASE WHEN user_id % 2 = 0 THEN 'IB 20' ELSE 'IB 30' END AS treatment,
         CASE WHEN (user_id // 2) % 2 = 0 THEN 'S' ELSE 'M' END AS depth,
         user_id // 4 AS rep,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0::DOUBLE AS day
  FROM events)"""

_FRACTIONS = f"""{_BOTTLES},
running AS (
  SELECT *,
    round(sum(value) OVER w, 4) AS co2,
    round(sum(round_even(value / 100, 4)) OVER w, 4) AS ch4
  FROM bottles
  WINDOW w AS (PARTITION BY treatment, depth, rep ORDER BY day, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fractions AS (
  SELECT r.*, c_mol, co2 + ch4 AS respired_umol, (co2 + ch4) / c_mol AS respired_per_c,
         c_mol - (co2 + ch4) / 1e6 AS remaining_mol, (co2 + ch4) / (c_mol * 1e6) AS fraction
  FROM running r
  LEFT JOIN (SELECT c_custkey, (20000.0::DOUBLE + c_acctbal) / 1e6 AS c_mol FROM customer) ON c_custkey = bottle),
rates AS (
  SELECT floor(day)::BIGINT AS whole_day, depth, treatment, count(*) AS n,
         avg(fraction / nullif(day, 0)) AS rate, stddev_samp(fraction / nullif(day, 0)) AS sd,
         stddev_samp(fraction / nullif(day, 0)) / sqrt(count(*)) AS se
  FROM fractions GROUP BY 1, 2, 3),
final AS (
  SELECT CASE depth WHEN 'M' THEN 'deep' ELSE 'shallow' END AS depth,
         max(rate) FILTER (treatment = 'IB 20') AS k1, max(sd) FILTER (treatment = 'IB 20') AS dk1,
         max(rate) FILTER (treatment = 'IB 30') AS k2, max(sd) FILTER (treatment = 'IB 30') AS dk2
  FROM rates WHERE whole_day = (SELECT max(whole_day) FROM rates) AND depth IN ('M', 'S') GROUP BY 1)"""

_CURVE = f"""{_FRACTIONS},
energy AS (
  SELECT *, -(ln(k2) - ln(k1)) * {R} / {SPAN} AS ea,
         sqrt(pow(dk2 * {R} / ({SPAN} * k2), 2) + pow(dk1 * {R} / ({SPAN} * k1), 2)) AS dea
  FROM final),
exponent AS (
  SELECT depth, temp_c, temp_c + 273.15::DOUBLE AS temp_k, k1, dk1,
         -(ea / {R}) * (1 / (temp_c + 273.15::DOUBLE) - 1.0 / {TC}) AS x,
         dea * abs(1 / (temp_c + 273.15::DOUBLE) - 1.0 / {TC}) / {R} AS dx
  FROM energy CROSS JOIN (SELECT unnest(range(-5, 51))::INT AS temp_c)),
curve AS (
  SELECT depth, temp_c, temp_k, exp(x + ln(k1)) AS k,
         sqrt(pow(dx * exp(x + ln(k1)), 2) + pow(dk1 * exp(x + ln(k1)) / k1, 2)) AS dk,
         sqrt(pow(dx * exp(exp(x + ln(k1)) + ln(k1)), 2)
            + pow(dk1 * exp(exp(x + ln(k1)) + ln(k1)) / k1, 2)) AS dk_sequential
  FROM exponent)"""

_LOSS = f"""{_COVERAGE}, {_CURVE},
raw_loss AS (
  SELECT h.station,
    sum(n * k) FILTER (depth = 'deep') AS deep, sqrt(sum(pow(n * dk, 2)) FILTER (depth = 'deep')) AS ddeep,
    sum(n * k) FILTER (depth = 'shallow') AS shallow,
    sqrt(sum(pow(n * dk, 2)) FILTER (depth = 'shallow')) AS dshallow
  FROM hist h JOIN curve c ON h.temp_c = c.temp_c GROUP BY h.station),
losses AS (
  SELECT b.station, b.start, b.n, b.expected, b.pct,
    deep / pct * f AS loss_deep, ddeep / pct * f AS dloss_deep,
    shallow / pct * f AS loss_shallow, dshallow / pct * f AS dloss_shallow
  FROM (SELECT *, CASE expected WHEN 366 THEN 365.0 / 366 ELSE 1 END::DOUBLE AS f FROM best) b
  JOIN raw_loss l ON l.station = b.station)"""

_MEANS = f"""{_LOSS}, {_PLACES},
means AS (
  SELECT s.region, s.state, count(*) FILTER (pct >= 0.30) AS n,
    avg(loss_deep) FILTER (pct >= 0.30) AS deep,
    coalesce(sqrt(sum(dloss_deep * dloss_deep) FILTER (pct >= 0.30)), 0)
      / nullif(count(*) FILTER (pct >= 0.30), 0) AS ddeep,
    avg(loss_shallow) FILTER (pct >= 0.30) AS shallow,
    coalesce(sqrt(sum(dloss_shallow * dloss_shallow) FILTER (pct >= 0.30)), 0)
      / nullif(count(*) FILTER (pct >= 0.30), 0) AS dshallow
  FROM stations s LEFT JOIN losses l ON l.station = s.station GROUP BY s.region, s.state)"""

_BUDGET = f"""{_MEANS},
scen AS (
  SELECT * FROM (VALUES ('Large', 0.3::DOUBLE), ('Small', 0.1::DOUBLE)) a(erosion, metres)
  CROSS JOIN (VALUES ('Tall', 0.2::DOUBLE), ('Short', 0.0::DOUBLE)) b(bank, deep_m)),
budget AS (
  SELECT region, state, length, n, erosion, bank, metres * length * 1000 AS area,
    metres * length * 1000 * (0.1 + deep_m) AS volume,
    metres * length * 1000 * (0.1 + deep_m) * 27 AS carbon,
    CASE bank WHEN 'Tall' THEN metres * length * 2700 * shallow + metres * length * 5400 * deep
         ELSE metres * length * 2700 * shallow END AS decomp,
    CASE bank WHEN 'Tall' THEN sqrt(pow(metres * length * 2700 * dshallow, 2) + pow(metres * length * 5400 * ddeep, 2))
         ELSE metres * length * 2700 * dshallow END AS sd
  FROM shore LEFT JOIN means USING (region, state) CROSS JOIN scen),
rolled AS (
  SELECT 'state' AS level, region, state, length AS marsh_shore, n, erosion, bank, volume, carbon, decomp, sd FROM budget
  UNION ALL
  SELECT CASE WHEN region IS NULL THEN 'nation' ELSE 'region' END, coalesce(region, 'National'), NULL,
    sum(length), coalesce(sum(n), 0), erosion, bank, sum(volume), sum(carbon), coalesce(sum(decomp), 0),
    coalesce(sqrt(sum(sd * sd)), 0)
  FROM budget GROUP BY GROUPING SETS ((erosion, bank, region), (erosion, bank)))"""

_TICKS = """
ticks AS (SELECT user_id AS station, ts AS t, value / 10 AS v FROM events),
gaps AS (
  SELECT station, round_even(date_diff('microsecond', prev, t) / 60000000.0::DOUBLE, 0) AS gap, count(*) AS n
  FROM (SELECT station, t, lag(t) OVER (PARTITION BY station ORDER BY t) AS prev FROM ticks)
  WHERE prev IS NOT NULL GROUP BY 1, 2)"""


def _summary(source: str, nominal: str) -> str:
    return f"""
  SELECT station, max(gap) AS largest_gap, arg_max(n, gap)::BIGINT AS largest_gap_count,
    coalesce(sum(n) FILTER (gap = {nominal}), 0)::BIGINT AS nominal_gaps,
    (coalesce(sum(n) FILTER (gap = {nominal}), 0) / sum(n))::DOUBLE AS nominal_share
  FROM {source} GROUP BY station"""


def _daily_gaps(source: str) -> str:
    return f"""
  SELECT station, date_diff('minute', prev, t)::DOUBLE AS gap, count(*) AS n
  FROM (SELECT station, t, lag(t) OVER (PARTITION BY station ORDER BY t) AS prev FROM {source})
  WHERE prev IS NOT NULL GROUP BY 1, 2"""


_PAIRS = f"""{_FRACTIONS},
ks AS (
  SELECT unnest(range(0, (SELECT round(round_even(max(fraction), 2) / 0.01)::BIGINT + 1 FROM fractions)))::INT AS k),
pairs AS (
  SELECT treatment, depth, rep, k,
    max(day) FILTER (fraction <= k * 0.01::DOUBLE) AS x0, max(fraction) FILTER (fraction <= k * 0.01::DOUBLE) AS y0,
    min(day) FILTER (fraction > k * 0.01::DOUBLE) AS x1, min(fraction) FILTER (fraction > k * 0.01::DOUBLE) AS y1
  FROM fractions CROSS JOIN ks GROUP BY 1, 2, 3, 4
  HAVING count(*) FILTER (fraction <= k * 0.01::DOUBLE) > 0),
crossings AS (
  SELECT *, CASE WHEN x1 <> x0 AND y1 <> y0
    THEN x0 + (k * 0.01::DOUBLE - y0) * (x1 - x0) / (y1 - y0) END AS crossing
  FROM pairs),
elapsed AS (
  SELECT *, crossing - lag(crossing, 1, 0.0::DOUBLE) OVER (PARTITION BY treatment, depth, rep ORDER BY k) AS elapsed
  FROM crossings)"""

_RANGES = """
ranges AS (SELECT station, min(t)::DATE AS a, max(t)::DATE AS b FROM readings GROUP BY station)"""


def _plan(step: int) -> str:
    return f"""
points AS (
  SELECT station, a, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL {step} DAY))::DATE AS d FROM ranges
  UNION
  SELECT station, a, b + 1 FROM ranges WHERE date_diff('day', a, b) % {step} <> 0),
pages AS (
  SELECT station, a, d AS page_from, lead(d) OVER (PARTITION BY station ORDER BY d) AS page_to FROM points)"""


def _student_975(df: int) -> float:
    """Point with 2.5 % of Student's distribution above it: Newton steps on the integrated density."""
    nodes, weights = np.polynomial.legendre.leggauss(120)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)
    t = 1.96 + 2.4 / df
    for _ in range(60):
        inside = t / 2 * float((weights * density(t / 2 * (nodes + 1))).sum())
        t = min(t + (0.475 - inside) / density(t), 2 * t)
    return t


def _t_quantile(n: str) -> str:
    """Values up to 200 degrees of freedom, the asymptotic series of the tables beyond."""
    values = ", ".join(repr(_student_975(df)) for df in range(1, 201))
    z, v = "1.959963984540054::DOUBLE", f"({n} - 1)"
    series = (
        f"{z} + (pow({z}, 3) + {z}) / (4 * {v}) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * pow({v}, 2))"
        f" + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow({v}, 3))"
        f" + (79 * pow({z}, 9) + 776 * pow({z}, 7) + 1482 * pow({z}, 5) - 1920 * pow({z}, 3) - 945 * {z}) / (92160 * pow({v}, 4))"
    )
    return f"CASE WHEN {n} < 2 THEN NULL WHEN {n} <= 201 THEN ([{values}])[{n} - 1] ELSE {series} END"


def r(columns: str, digits: int = 6) -> str:
    """Rounded select list: names or ``expression AS name``."""
    parts = []
    for item in columns.split(","):
        expr, _, name = item.strip().partition(" AS ")
        parts.append(f"round({expr}, {digits}) AS {name or expr}")
    return ", ".join(parts)


def signif3(x: str) -> str:
    e = f"(2 - floor(log10(abs({x})))::INT)"
    return (
        f"CASE WHEN {x} = 0 THEN 0.0 WHEN {e} >= 0 THEN round_even({x} * pow(10, {e}), 0) / pow(10, {e}) "
        f"ELSE round_even({x} / pow(10, -{e}), 0) * pow(10, -{e}) END"
    )


def _label(name: str, share: str) -> str:
    text = f"({signif3(f'({share})')})::VARCHAR"
    return f"{name} || ':' || chr(10) || regexp_replace({text}, '\\.0$', '') || '%'"


_CENTROID = """
vertices AS (SELECT c_nationkey AS nationkey, c_custkey AS x, c_acctbal + 20000 AS y FROM customer),
edges AS (
  SELECT nationkey, x, y,
    coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1
  FROM vertices WINDOW w AS (PARTITION BY nationkey ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
centroid AS (
  SELECT nationkey, sum((x + x1) * (x * y1 - x1 * y)) / (3 * sum(x * y1 - x1 * y)) AS x,
    sum((y + y1) * (x * y1 - x1 * y)) / (3 * sum(x * y1 - x1 * y)) AS y
  FROM edges GROUP BY nationkey)"""

_LAYER = f"""{_MEANS},
layer AS (
  SELECT s.station, s.region, lat, lon, loss_shallow * 100 AS pct_shallow, loss_deep * 100 AS pct_deep,
    (loss_shallow * (1.0::DOUBLE / 3) + loss_deep * (1 - 1.0::DOUBLE / 3)) * 100 AS pct_mixed
  FROM stations s JOIN losses l ON l.station = s.station WHERE pct >= 0.30)"""

_GAS = f"""{_BOTTLES},
consts AS (SELECT 0.615::DOUBLE AS hs, 0.35258189116719::DOUBLE AS gga, 0.967581891167191::DOUBLE AS tot,
  0.615::DOUBLE / (300.85::DOUBLE * 0.08206) AS mol),
amounts AS (
  SELECT b.*, mol,
    round_even((value - (gga / tot) * (value / 2)) * (tot / hs) * mol, 2) AS co2_bottle,
    round_even((value / 100 - (gga / tot) * (value / 200)) * (tot / hs) * mol, 4) AS ch4_bottle
  FROM bottles b, consts WHERE event_type <> 'error'),
produced AS (
  SELECT *,
    round_even(CASE WHEN day = 0 THEN 0 ELSE co2_bottle - value / 4 * mol END, 2) AS co2_made,
    round_even(CASE WHEN day = 0 THEN 0 ELSE ch4_bottle - value / 400 * mol END, 4) AS ch4_made
  FROM amounts)"""

_LOSS_COLS = "pct, loss_deep, dloss_deep, loss_shallow, dloss_shallow"
_MEAN_COLS = "deep, ddeep, shallow, dshallow"
_WIDE = ", ".join(
    f"round(max({metric}) FILTER (erosion = '{rate}' AND bank = '{bank}'), 2) AS {prefix}_{rate}{bank}"
    for prefix, metric in (("erodedSedVolume", "volume"), ("erodedSedC", "carbon"), ("Decomp", "decomp"), ("dDecomp", "sd"))
    for rate in ("Large", "Small")
    for bank in ("Tall", "Short")
)

ORACLE: dict[str, str] = {
    "reading_counts": f"""WITH {_READINGS},
months AS (SELECT unnest(generate_series(first_m::TIMESTAMP, last_m::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM span)
SELECT year(m)::INT AS year, month(m)::INT AS mon, count(t) AS n
FROM months LEFT JOIN readings ON date_trunc('month', t)::DATE = m GROUP BY m""",
    "coverage_windows": f"WITH {_COVERAGE} SELECT station, start, year, mon, n, expected, round(pct, 6) AS pct FROM cov",
    "coverage_dirty": f"""WITH {_COVERAGE.replace("FROM lineitem)", "FROM lineitem WHERE l_orderkey % 5 <> 0)")}
SELECT station, start, year, mon, n, expected, round(pct, 6) AS pct FROM cov""",
    "sweep_windows": f"WITH {_SWEPT} SELECT station, start, n, expected, round(pct, 6) AS pct FROM swept",
    "sweep_best": f"WITH {_SWEPT} SELECT station, start, n, expected, round(pct, 6) AS pct FROM swept_best",
    "sweep_readings": f"WITH {_SWEPT} SELECT station, start, count(*) AS n, min(v) AS v_min, max(v) AS v_max FROM swept_inside GROUP BY 1, 2",
    "sweep_histogram": f"""WITH {_SWEPT}
SELECT b.station, b.start, g.temp_c, coalesce(c.n, 0)::BIGINT AS n
FROM swept_best b CROSS JOIN (SELECT unnest(range(-5, 51))::INT AS temp_c) g
LEFT JOIN (SELECT station, round_even(v, 0)::INT AS temp_c, count(*) AS n FROM swept_inside GROUP BY 1, 2) c
  ON c.station = b.station AND c.temp_c = g.temp_c""",
    "sweep_dirty": f"""WITH dirty AS (SELECT l_suppkey AS station, CASE WHEN l_orderkey % 5 <> 0 THEN l_shipdate END AS t FROM lineitem),
{_ranged("dirty", "TIMESTAMP '1993-01-15'", "TIMESTAMP '1997-12-31'", "2 MONTH", "6 MONTH")}""",
    "sweep_hours": f"""WITH ticks AS (SELECT user_id AS station, ts AS t FROM events),
{_ranged("ticks", "(SELECT min(t) FROM ticks)", "(SELECT max(t) FROM ticks)", "13 HOUR", "36 HOUR")}""",
    "window_starts_fortnight": f"""WITH {_READINGS},
own AS (SELECT station, min(t) AS a, max(t) AS b FROM readings GROUP BY station)
SELECT station, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 14 DAY))::DATE AS start FROM own""",
    "gap_dense": f"WITH {_TICKS} SELECT * FROM gaps",
    "outline_parts": """WITH v AS (
  SELECT c_nationkey AS nationkey, c_mktsegment AS part, c_custkey AS x, c_acctbal + 20000 * (1 + ascii(c_mktsegment) % 5) AS y FROM customer),
e AS (
  SELECT nationkey, part, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1
  FROM v WINDOW w AS (PARTITION BY nationkey, part ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
r AS (
  SELECT nationkey, part, sum(x * y1 - x1 * y) / 2 AS a, sum((x + x1) * (x * y1 - x1 * y)) / 6 AS mx, sum((y + y1) * (x * y1 - x1 * y)) / 6 AS my
  FROM e GROUP BY nationkey, part),
s AS (SELECT *, (CASE WHEN a < 0 THEN -1 ELSE 1 END) * (CASE WHEN part = 'BUILDING' THEN -1 ELSE 1 END) AS w FROM r)
SELECT nationkey, round(sum(w * mx) / nullif(sum(w * a), 0), 2) AS x, round(sum(w * my) / nullif(sum(w * a), 0), 2) AS y, round(sum(w * a), 2) AS area, count(*) AS rings
FROM s GROUP BY nationkey""",
    "best_window": f"WITH {_COVERAGE} SELECT station, start, year, mon, n, expected, round(pct, 6) AS pct FROM best",
    "top_windows": f"WITH {_READINGS}, {_POOLED} SELECT *, strftime(start, '%B%Y') AS label FROM top10",
    "temp_histogram": f"WITH {_COVERAGE} SELECT * FROM hist",
    "hist_wide": f"""WITH {_COVERAGE}, {_PLACES}
SELECT temp_c, {", ".join(f"(sum(n) FILTER (region = '{x}'))::BIGINT AS \"{x}\"" for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))}
FROM hist JOIN stations USING (station) GROUP BY temp_c""",
    "hist_cells": f"""WITH {_COVERAGE}, {_PLACES}
SELECT temp_c, state, sum(n)::BIGINT AS n, state IN ('CHINA', 'FRANCE', 'NOWHERE') AS listed
FROM hist JOIN stations USING (station) GROUP BY temp_c, state""",
    "window_readings": f"WITH {_COVERAGE} SELECT station, start, count(*) AS n, min(v) AS v_min, max(v) AS v_max FROM inside GROUP BY 1, 2",
    "expected_slots": f"""WITH {_READINGS},
days AS (SELECT unnest(generate_series(date_trunc('year', first_m)::TIMESTAMP,
  make_date(year(last_m), 12, 31)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM span)
SELECT year(d)::INT AS year, count(*) AS days, count(*) * 24 AS hours, count(*) * 1440 AS minutes, count(*) * 240 AS slots
FROM days GROUP BY 1""",
    "window_starts": f"""WITH {_READINGS},
own AS (SELECT station, date_trunc('month', min(t)) AS a, date_trunc('month', max(t)) AS b FROM readings GROUP BY station)
SELECT station, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS start FROM own""",
    "threshold_grid": f"""WITH {_FRACTIONS},
top AS (SELECT treatment, depth, CAST(round(round_even(max(fraction), 2) / 0.01, 0) AS INT) AS last_k FROM fractions GROUP BY 1, 2)
SELECT treatment, depth, k, round(k * 0.01::DOUBLE, 6) AS portion
FROM (SELECT treatment, depth, unnest(range(0, last_k + 1))::INT AS k FROM top)""",
    "top_and_first": f"""WITH {_COVERAGE}
SELECT station, count(*) FILTER (n > 0) AS windows, count(*) FILTER (pct >= 0.30) AS qualified,
  (array_agg(start ORDER BY n DESC, start))[1] AS start, max(n) AS n
FROM cov GROUP BY station""",
    "gas_production": f"""WITH {_GAS}
SELECT event_id, {r("co2_bottle AS CO2_bottle_umol, co2_made AS CO2_production_umol, ch4_bottle AS CH4_bottle_umol, ch4_made AS CH4_production_umol")},
  round(sum(co2_made) OVER w, 4) AS CO2_cumulative_umol, round(sum(ch4_made) OVER w, 4) AS CH4_cumulative_umol
FROM produced WINDOW w AS (PARTITION BY treatment, depth, rep ORDER BY day, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "respired_fraction": f"""WITH {_FRACTIONS}
SELECT event_id, bottle, {r("respired_umol, fraction")}, {r("remaining_mol", 12)}, {r("respired_per_c", 2)} FROM fractions""",
    "fraction_summary_ci": f"""WITH {_FRACTIONS},
s AS (SELECT floor(day)::BIGINT AS whole_day, depth, treatment, count(*) AS n, avg(fraction) AS fraction,
  stddev_samp(fraction) AS sd, stddev_samp(fraction) / sqrt(count(*)) AS se FROM fractions GROUP BY 1, 2, 3)
SELECT whole_day, depth, treatment, n, {r("fraction, sd, se")}, round(se * ({_t_quantile("n")}), 6) AS ci FROM s""",
    "rate_summary": f"WITH {_FRACTIONS} SELECT whole_day, depth, treatment, n, {r('rate, sd, se')} FROM rates",
    "final_rates": f"WITH {_FRACTIONS} SELECT depth, {r('k1, dk1, k2, dk2', 8)} FROM final",
    "q10": f"""WITH {_FRACTIONS},
w AS (SELECT whole_day, depth,
  max(rate) FILTER (treatment = 'IB 20') AS a, max(sd) FILTER (treatment = 'IB 20') AS da,
  max(rate) FILTER (treatment = 'IB 30') AS b, max(sd) FILTER (treatment = 'IB 30') AS db FROM rates GROUP BY 1, 2),
q AS (SELECT whole_day, depth, b / nullif(a, 0) AS q10,
  sqrt(pow(db / nullif(a, 0), 2) + pow(da * b / nullif(a * a, 0), 2)) AS dq10 FROM w)
SELECT whole_day, depth, {r("q10, dq10, dq10 / sqrt(6.0) AS seq10")} FROM q""",
    "crossing_times": f"WITH {_PAIRS} SELECT treatment, depth, rep, k, {r('x0, y0, x1, y1, crossing')} FROM crossings",
    "crossing_neighbours": f"""WITH {_PAIRS},
nb AS (SELECT *, lead(day) OVER w AS x1, lead(fraction) OVER w AS y1 FROM fractions
  WINDOW w AS (PARTITION BY treatment, depth, rep ORDER BY day, event_id)),
hit AS (SELECT treatment, depth, rep, k, day AS x0, fraction AS y0, x1, y1 FROM nb JOIN ks
  ON fraction <= k * 0.01::DOUBLE AND (y1 > k * 0.01::DOUBLE OR y1 IS NULL))
SELECT treatment, depth, rep, k, {r("x0, y0, x1, y1")},
  round(CASE WHEN x1 <> x0 AND y1 <> y0 THEN x0 + (k * 0.01::DOUBLE - y0) * (x1 - x0) / (y1 - y0) END, 6) AS crossing
FROM hit""",
    "elapsed_by_portion": f"WITH {_PAIRS} SELECT treatment, depth, rep, k, {r('crossing, elapsed')} FROM elapsed",
    "q10q": f"""WITH {_PAIRS},
s AS (SELECT k, depth, treatment, count(*) AS n, avg(elapsed) AS m, stddev_samp(elapsed) AS sd
  FROM elapsed WHERE k <> 0 GROUP BY 1, 2, 3),
q AS (SELECT a.k, a.depth, a.m / nullif(b.m, 0) AS q10q, a.n + b.n AS n,
  sqrt(pow(a.sd / nullif(b.m, 0), 2) + pow(b.sd * a.m / nullif(b.m * b.m, 0), 2)) AS sd
  FROM (SELECT * FROM s WHERE treatment = 'IB 20') a
  LEFT JOIN (SELECT * FROM s WHERE treatment = 'IB 30') b ON a.k = b.k AND a.depth = b.depth)
SELECT k, depth, n, {r("q10q, sd, sd / sqrt(n) AS se")} FROM q""",
    "plot_series": f"""WITH {_FRACTIONS},
s AS (SELECT floor(day)::BIGINT AS whole_day, depth, treatment, count(*) AS n, avg(fraction) AS fraction,
  stddev_samp(fraction) AS sd, stddev_samp(fraction) / sqrt(count(*)) AS se FROM fractions GROUP BY 1, 2, 3)
SELECT whole_day, CASE depth WHEN 'M' THEN 'Deep' ELSE 'Shallow' END AS depth,
  CASE treatment WHEN 'IB 20' THEN '20° C' ELSE '30° C' END AS treatment, n,
  {r("fraction, sd, se, fraction - se AS low, fraction + se AS high")},
  CASE WHEN floor(fraction * 100)::BIGINT % 10 = 0 THEN floor(fraction * 100)::BIGINT::VARCHAR || '%' ELSE '' END AS axis
FROM s""",
    "activation_energy": f"WITH {_CURVE} SELECT depth, {r('ea, dea', 8)} FROM energy",
    "arrhenius_curve": f"WITH {_CURVE} SELECT depth, temp_c, {r('temp_k, k, dk', 8)} FROM curve",
    "arrhenius_curve_sequential": f"WITH {_CURVE} SELECT depth, temp_c, {r('temp_k, k, dk_sequential AS dk', 8)} FROM curve",
    "curve_wide": f"""WITH {_CURVE}
SELECT temp_c, {", ".join(f"round(max({c}) FILTER (depth = '{d}'), 8) AS {c}_{d}" for d in ("deep", "shallow") for c in ("k", "dk"))}
FROM curve GROUP BY temp_c""",
    "annual_loss": f"WITH {_LOSS} SELECT station, start, {r(_LOSS_COLS)} FROM losses",
    "annual_loss_constant": f"""WITH {_COVERAGE}, {_FRACTIONS}
SELECT station, round(sum(n) * 1000.0 * (SELECT k2 FROM final WHERE depth = 'deep'), 6) AS loss_deep,
  round(sum(n) * 1000.0 * (SELECT k2 FROM final WHERE depth = 'shallow'), 6) AS loss_shallow
FROM hist GROUP BY station""",
    "series_loss": f"""WITH {_READINGS}, {_POOLED}, {_CURVE},
h AS (SELECT start, round_even(v, 0)::INT AS temp_c, count(*) * 1000.0::DOUBLE AS days
  FROM top10 JOIN readings ON t >= start AND t < start + INTERVAL 12 MONTH GROUP BY 1, 2)
SELECT start, {", ".join(f"round(sum(days * k) FILTER (depth = '{d}'), 2) AS loss_{d}, round(sqrt(sum(pow(days * dk, 2)) FILTER (depth = '{d}')), 2) AS dloss_{d}" for d in ("deep", "shallow"))}
FROM h JOIN curve USING (temp_c) GROUP BY start""",
    "state_mean_loss": f"WITH {_MEANS} SELECT region, state, n, {r(_MEAN_COLS)} FROM means",
    "erosion_scenarios": f"WITH {_BUDGET} SELECT region, state, n, erosion, bank, {r('length, area, volume, carbon, decomp, sd', 2)} FROM budget",
    "budget_rollup": f"""WITH {_BUDGET} SELECT level, region, state, n::BIGINT AS n, erosion, bank,
  {r('marsh_shore, volume, carbon, decomp, sd', 2)} FROM rolled""",
    "budget_exact": f"""WITH {_BUDGET} SELECT level, region, state, n::BIGINT AS n, erosion, bank,
  {r('marsh_shore, volume, carbon, decomp, sd', 2)} FROM rolled""",
    "price_totals": """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 3) AS total, round(avg(l_discount), 3) AS mean, count(*) AS n
FROM lineitem GROUP BY l_returnflag""",
    "budget_long": f"""WITH {_BUDGET} SELECT level, region, state, n::BIGINT AS n, erosion AS ErosionRate,
  CASE bank WHEN 'Short' THEN 'Shallow' ELSE 'Deep' END AS BankHt,
  {r('marsh_shore, volume AS erodedSedVolume, carbon AS erodedSedCarbon, decomp AS Decomp, sd AS SD', 2)} FROM rolled""",
    "budget_wide": f"""WITH {_BUDGET} SELECT level, region, state, n::BIGINT AS n, round(marsh_shore, 2) AS marsh_shore, {_WIDE}
FROM rolled GROUP BY level, region, state, n, marsh_shore""",
    "gap_histogram": f"WITH {_TICKS} SELECT * FROM gaps",
    "gap_summary": f"WITH {_TICKS}, s AS ({_summary('gaps', '6')}) SELECT station, largest_gap, largest_gap_count, nominal_gaps, round(nominal_share, 6) AS nominal_share FROM s",
    "gap_melt": f"""WITH {_TICKS}, s AS ({_summary('gaps', '6')}),
d AS (SELECT station, largest_gap, largest_gap_count::DOUBLE AS largest_gap_count, nominal_gaps::DOUBLE AS nominal_gaps, nominal_share FROM s)
SELECT station, variable, round(value, 6) AS value
FROM d UNPIVOT INCLUDE NULLS (value FOR variable IN (largest_gap, largest_gap_count, nominal_gaps, nominal_share))
WHERE value IS NOT NULL""",
    "gaps_in_best_window": f"""WITH {_COVERAGE}, g AS ({_daily_gaps('inside')}), s AS ({_summary('g', '1440')})
SELECT station, largest_gap, largest_gap_count, nominal_gaps, round(nominal_share, 6) AS nominal_share FROM s""",
    "request_plan": f"""WITH {_READINGS}, {_RANGES}, {_plan(30)}
SELECT station, strftime(page_from, '%Y%m%d') AS chunk_begin, strftime(page_to, '%Y%m%d') AS chunk_end
FROM pages WHERE page_to IS NOT NULL""",
    "failed_pages": f"""WITH {_READINGS}, {_RANGES}, {_plan(7)}
SELECT station, strftime(page_from, '%Y%m%d') AS chunk_begin, strftime(page_to, '%Y%m%d') AS chunk_end
FROM pages p WHERE page_to IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM readings r WHERE r.station = p.station AND r.t >= page_from AND r.t < page_from + INTERVAL 7 DAY)""",
    "dedupe_trim": f"""WITH {_TICKS} SELECT DISTINCT station, t, v FROM (SELECT * FROM ticks UNION ALL SELECT * FROM ticks)
WHERE t >= TIMESTAMP '2024-01-03' AND t <= TIMESTAMP '2024-01-25' AND v IS NOT NULL""",
    "missing_series": "SELECT c_custkey AS station, c_name FROM customer ANTI JOIN events ON user_id = c_custkey",
    "with_series": "SELECT c_custkey AS station, c_name FROM customer SEMI JOIN events ON user_id = c_custkey",
    "station_key": f"""WITH {_PLACES} SELECT station, name || ', ' || state AS listed,
  replace(replace(name || ', ' || state, ' ', ''), ',', '') || '.' || state AS key FROM stations""",
    "metadata_join": f"""WITH {_LOSS}, {_PLACES}, g AS ({_daily_gaps('readings')}), s AS ({_summary('g', '1440')})
SELECT st.station, st.state, st.region, round(lat, 6) AS lat, round(lon, 6) AS lon, b.start, b.n,
  round(b.pct, 6) AS pct, largest_gap, nominal_gaps, {r("loss_deep * 100 AS loss_deep, loss_shallow * 100 AS loss_shallow")}
FROM stations st LEFT JOIN best b ON b.station = st.station LEFT JOIN s ON s.station = st.station
LEFT JOIN losses l ON l.station = st.station""",
    "response_metadata": """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS lat, TRY_CAST(s_name AS DOUBLE) AS lon,
  n_name AS state, r_name AS region
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "incubation_scan": """WITH e AS (SELECT *, TRY_CAST(translate(props, '{"k: }', '') AS DOUBLE) AS number FROM events)
SELECT event_id, number, TRY_CAST(event_type AS DOUBLE) IS NULL AS was_text, round_even(value, 0) AS result_value,
  CASE WHEN number > 50 THEN 'high' ELSE 'low' END AS result_class, date_trunc('month', ts)::DATE AS result_month
FROM e WHERE number IS NOT NULL AND number NOT IN (0, 50) AND user_id IS NOT NULL""",
    "mixed_layer": f"""WITH {_LAYER} SELECT station, region, {r("pct_shallow, pct_deep, pct_mixed")},
  {", ".join(f"{signif3(c)} AS {c}_3" for c in ("pct_shallow", "pct_deep", "pct_mixed"))} FROM layer""",
    "extent": f"""WITH {_LAYER} SELECT region,
  {", ".join(f"round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, round(abs(max({c}) - min({c})), 6) AS {c}_range" for c in ("lon", "lat", "pct_mixed"))}
FROM layer GROUP BY region""",
    "label_fanout": f"""WITH {_MEANS},
names AS (SELECT state, region FROM places UNION ALL SELECT state, 'GULF' FROM places)
SELECT names.state, names.region, n, {r("deep, shallow")} FROM names LEFT JOIN means ON means.state = names.state""",
    "outline_centroids": f"WITH {_CENTROID} SELECT nationkey, {r('x, y', 3)} FROM centroid",
    "state_labels": f"""WITH {_MEANS}, {_CENTROID},
j AS (SELECT p.state, m.region, m.deep, m.shallow, x, y,
    CASE WHEN p.state = 'IRAN' AND m.region = 'MIDDLE EAST' THEN 'IRAN (East)' ELSE p.state END AS postal
  FROM centroid c JOIN places p ON p.nationkey = c.nationkey LEFT JOIN means m ON m.state = p.state)
SELECT state, region, postal,
  round(CASE WHEN postal = 'IRAN (East)' THEN 25.0 ELSE x END, 3) AS x,
  round(CASE WHEN postal = 'IRAN (East)' THEN 61.5 ELSE y END, 3) AS y,
  {_label("postal", "(shallow * (1.0::DOUBLE / 3) + deep * (1 - 1.0::DOUBLE / 3)) * 100")} AS label_mixed,
  {_label("postal", "shallow * 100")} AS label_shallow, {_label("postal", "deep * 100")} AS label_deep
FROM j""",
}
