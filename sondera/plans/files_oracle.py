"""SQL of the file queries: the same rows straight from the tables, without any file."""

from __future__ import annotations

from sondera.plans.oracle import _BOTTLES, _BUDGET, _COVERAGE, _LOSS, _LOSS_COLS, _MEAN_COLS, _MEANS, _PLACES, _WIDE, r

_SERIES = """series AS (
  SELECT l_suppkey AS station, l_shipdate + to_microseconds(l_orderkey % 1000000) AS t,
    l_quantity - 0.5::DOUBLE * (l_linenumber % 2) AS v, l_linestatus || ',0,' || l_returnflag AS f FROM lineitem),
listed AS (SELECT c_custkey::VARCHAR AS station FROM customer WHERE c_custkey % 3 = 0)"""

_PAGES = """week AS (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) // 7 AS w FROM events),
landed AS (
  SELECT user_id::VARCHAR AS station, w, ts AS t, CASE WHEN event_type <> 'error' THEN value END AS v, event_type AS f
  FROM week WHERE (user_id + w) % 6 <> 0)"""

FILES_SQL: dict[str, str] = {
    "incubation_file": f"""WITH {_BOTTLES}
SELECT event_id, bottle::VARCHAR AS bottle, treatment, depth, rep::VARCHAR AS rep,
  {r("value / 2 AS CO2_air_ppm, value / 200 AS CH4_air_ppm, value AS CO2_sys_ppm, value / 100 AS CH4_sys_ppm")},
  {r("value / 4 AS CO2_prior, value / 400 AS CH4_prior")}, event_type <> 'view' AS timed
FROM bottles WHERE event_type <> 'error'""",
    "carbon_file": """SELECT 'B ' || c_custkey AS bottle, CASE WHEN c_mktsegment <> 'MACHINERY' THEN round(c_acctbal, 6) END AS c_g,
  CASE WHEN c_acctbal >= 0 THEN round(c_acctbal / 1000, 6) END AS c_mol FROM customer""",
    "sensor_file": """SELECT date_trunc('minute', ts) AS t, round_even(value, 0) AS v FROM events
WHERE event_type <> 'error' AND value IS NOT NULL""",
    "station_list_file": f"""WITH {_PLACES}
SELECT station AS "StationID", name || ', ' || state AS "Name", state AS "State", region AS "Region",
  replace(replace(name || ', ' || state, ' ', ''), ',', '') || '.' || state AS station
FROM stations WHERE region IN ('ASIA', 'MIDDLE EAST')""",
    "station_metadata_file": f"""WITH {_PLACES}
SELECT station AS id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, state, region,
  replace(replace(name, ' ', ''), ',', '') || '.' || state AS station
FROM stations WHERE region <> 'EUROPE'""",
    "shoreline_file": f"""WITH {_PLACES}
SELECT region, state, 100.0::DOUBLE * count(*) AS length
FROM customer JOIN places ON c_nationkey = nationkey GROUP BY region, state""",
    "station_files": f"""WITH {_SERIES}
SELECT series.station::VARCHAR AS station, t, v, f FROM series SEMI JOIN listed ON listed.station = series.station::VARCHAR""",
    "station_files_missing": f"""WITH {_SERIES}
SELECT station FROM listed WHERE station NOT IN (SELECT station::VARCHAR FROM series)""",
    "working_copy": f"""WITH {_SERIES}
SELECT station, t, v, f, year(t) AS year FROM series WHERE year(t) IN (1996, 2000)""",
    "working_copy_stations": f"""WITH {_SERIES}
SELECT station, year(t) AS year, count(*) AS n, min(t) AS first, max(t) AS last FROM series GROUP BY 1, 2""",
    "page_files": f"""WITH {_PAGES}
SELECT DISTINCT station, t, v, f FROM landed
WHERE station::BIGINT % 4 <> 0 AND v IS NOT NULL AND t <= TIMESTAMP '2024-01-29'""",
    "page_files_failed": f"""WITH {_PAGES},
pages AS (
  SELECT DISTINCT user_id::VARCHAR AS station, p.w, strftime(DATE '2024-01-01' + 7 * p.w::INT, '%Y%m%d') AS chunk_begin,
    strftime(DATE '2024-01-08' + 7 * p.w::INT, '%Y%m%d') AS chunk_end
  FROM events, (SELECT unnest(range(4)) AS w) p WHERE user_id % 4 <> 0)
SELECT station, chunk_begin, chunk_end FROM pages ANTI JOIN landed USING (station, w)""",
    "page_stream": f"WITH {_PAGES} SELECT DISTINCT station, t, v, f FROM landed WHERE v IS NOT NULL",
    "published_stations": f"""WITH {_LOSS}, {_PLACES}
SELECT s.station, {r("lat, lon")}, state, region, start, {r(_LOSS_COLS)}
FROM stations s LEFT JOIN losses l ON l.station = s.station""",
    "published_temperatures": f"""WITH {_COVERAGE}, {_PLACES}
SELECT temp_c, {", ".join(f"(sum(n) FILTER (region = '{x}'))::BIGINT AS \"{x}\"" for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))}
FROM hist JOIN stations USING (station) GROUP BY temp_c""",
    "published_state_means": f"WITH {_MEANS} SELECT region, state, n, {r(_MEAN_COLS)} FROM means",
    "published_state_budget": f"""WITH {_BUDGET},
wide AS (SELECT region, state, n::BIGINT AS n, round(marsh_shore, 2) AS marsh_shore, {_WIDE}
  FROM rolled WHERE level = 'state' GROUP BY region, state, n, marsh_shore)
SELECT wide.*, {r(_MEAN_COLS)} FROM wide LEFT JOIN means USING (region, state)""",
    "published_region_budget": f"""WITH {_BUDGET} SELECT region, n::BIGINT AS n, round(marsh_shore, 2) AS marsh_shore, {_WIDE}
FROM rolled WHERE level = 'region' GROUP BY region, n, marsh_shore""",
    "published_nation_budget": f"""WITH {_BUDGET} SELECT n::BIGINT AS n, round(marsh_shore, 2) AS marsh_shore, {_WIDE}
FROM rolled WHERE level = 'nation' GROUP BY n, marsh_shore""",
    "published_long_budget": f"""WITH {_BUDGET} SELECT region, state, n::BIGINT AS n, erosion AS ErosionRate,
  CASE bank WHEN 'Short' THEN 'Shallow' ELSE 'Deep' END AS BankHt,
  {r('marsh_shore, volume AS erodedSedVolume, carbon AS erodedSedCarbon, decomp AS Decomp, sd AS SD', 2)} FROM rolled""",
}
