"""The registered queries once more, as DuckDB SQL over the given tables.

Written from the semantics and not from the engine's plans: every step works on single laps, with
DuckDB's own ASOF join, medians and quantiles, where the engine works on counted laps and sums.
"""

import re

from testbed.tables import DUCKDB_WORDS, LAP_KEYS, SQL, TEST_AS_OF, TEST_ERAS, localized

KEYS = ", ".join(LAP_KEYS)
LKEYS = ", ".join(f"l.{k}" for k in LAP_KEYS)
WEATHER = "AirTemp, TrackTemp, Humidity, Rainfall, WindSpeed, WindDirection"


def r6(expression: str) -> str:
    return f"(round_even(round_even(({expression}) * 1e12::DOUBLE, 0) / 1e6::DOUBLE, 0) / 1e6::DOUBLE + 0.0)"


def r3(expression: str) -> str:
    return f"(round_even(round_even(({expression}) * 1e9::DOUBLE, 0) / 1e6::DOUBLE, 0) / 1000::DOUBLE)"


def race_key(name: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({name})), '\\s+grand prix\\s*$', ''))"


CTES = {name: localized(name, DUCKDB_WORDS) for name in SQL}

CTES["dim_team"] = """
SELECT * FROM (VALUES ('Toro Rosso','Racing Bulls'),('RB','Racing Bulls'),
 ('Oracle Red Bull Racing','Red Bull Racing'),('Mercedes','Mercedes'),
 ('Scuderia Ferrari HP','Ferrari'),('McLaren F1 Team','McLaren'),('Kick Sauber','Audi'),
 ('Racing Point','Aston Martin'),('Renault','Alpine')) AS t(alias, team)"""

CTES["eras"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', {start}, {end})" for name, start, end in TEST_ERAS
) + ") AS t(era, start_year, end_year)"

CTES["rounds"] = "SELECT * FROM schedule WHERE RoundNumber > 0"

CTES["clean"] = """
SELECT * FROM laps_raw WHERE IsAccurate AND TrackStatus = '1'
 AND Compound IN ('SOFT', 'MEDIUM', 'HARD', 'INTERMEDIATE', 'WET')"""

CTES["wx"] = """
SELECT * FROM weather
QUALIFY row_number() OVER (PARTITION BY Year, RoundNumber, Time ORDER BY seq DESC) = 1"""

CTES["clean_wx"] = f"""
SELECT l.* REPLACE (coalesce(d.team, l.Team) AS Team), {', '.join('w.' + c for c in WEATHER.split(', '))},
 coalesce(t.track_type, 'Medium') AS TrackType, coalesce(t.length_km, 5.0) AS TrackLengthKM,
 l.TyreLife * coalesce(t.length_km, 5.0) AS TyreLifeKM, w.seq AS sample
FROM clean l ASOF LEFT JOIN wx w
 ON l.Year = w.Year AND l.RoundNumber = w.RoundNumber AND l.Time >= w.Time
LEFT JOIN dim_team d ON l.Team = d.alias LEFT JOIN dim_track t ON l.EventName = t.name"""

CTES["paced"] = """
SELECT l.*, f.fp AS FieldBaselinePace, t.tp AS TeamBaselinePace, t.tp - f.fp AS RelativePace
FROM clean_wx l
JOIN (SELECT Year, RoundNumber, median(LapTimeSeconds) AS fp FROM clean_wx GROUP BY ALL) f
 ON l.Year = f.Year AND l.RoundNumber = f.RoundNumber
LEFT JOIN (SELECT Year, RoundNumber, Team, median(LapTimeSeconds) AS tp FROM clean_wx GROUP BY ALL) t
 ON l.Year = t.Year AND l.RoundNumber = t.RoundNumber AND l.Team = t.Team"""

CTES["features"] = f"""
SELECT Year, RoundNumber, EventName, {KEYS}, Driver, Team, Compound, TrackType, LapNumber, TyreLife,
 TyreLifeKM, Stint, CAST(Compound IN ('INTERMEDIATE', 'WET') OR Rainfall AS INT) AS IsWet,
 AirTemp, TrackTemp, Humidity, CAST(Rainfall AS INT) AS Rainfall,
 TeamBaselinePace, FieldBaselinePace, RelativePace, LapTimeSeconds
FROM paced
WHERE LapNumber IS NOT NULL AND TyreLife IS NOT NULL AND Stint IS NOT NULL AND AirTemp IS NOT NULL
 AND TrackTemp IS NOT NULL AND Humidity IS NOT NULL AND Rainfall IS NOT NULL
 AND TeamBaselinePace IS NOT NULL AND LapTimeSeconds IS NOT NULL"""

CTES["completed"] = f"""
SELECT * FROM schedule WHERE RoundNumber IS NOT NULL AND EventName IS NOT NULL
 AND TRY_CAST(EventDate AS DATE) <= DATE '{TEST_AS_OF}'"""

CTES["era_events"] = """
SELECT era, Year, RoundNumber, EventName FROM completed
JOIN eras ON Year BETWEEN start_year AND end_year"""

CTES["event_status"] = """
SELECT e.*, coalesce(c.n, 0) AS clean_laps, coalesce(c.unmatched, 0) AS unmatched_laps, coalesce(u.n, 0) AS usable_laps,
 CASE WHEN u.n > 0 THEN 'loaded' WHEN c.n > 0 THEN 'empty' ELSE 'no_laps' END AS status
FROM era_events e
LEFT JOIN (SELECT Year, EventName, count(*) AS n, count(*) - count(sample) AS unmatched FROM clean_wx GROUP BY ALL) c
 ON e.Year = c.Year AND e.EventName = c.EventName
LEFT JOIN (SELECT Year, EventName, count(*) AS n FROM features GROUP BY ALL) u
 ON e.Year = u.Year AND e.EventName = u.EventName"""

NUMBER = "CAST('0x' || substr(md5(" + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in LAP_KEYS) + " || '|42'), 1, 8) AS BIGINT)"

CTES["era_laps"] = f"""
SELECT e.era, f.*, {NUMBER} % 100 >= 20 AS fitted
FROM features f JOIN era_events e ON f.Year = e.Year AND f.EventName = e.EventName"""

CTES["hl"] = """
SELECT * REPLACE (CAST(coalesce(Rainfall, false) AS INT) AS Rainfall, coalesce(Driver, 'None') AS Driver),
 CAST(Compound IN ('INTERMEDIATE', 'WET') OR coalesce(Rainfall, false) AS INT) AS IsWet,
 CASE WHEN Stint IS NOT NULL THEN LapTimeSeconds - min(LapTimeSeconds)
  OVER (PARTITION BY Year, EventName, Driver, Team, Stint, Compound) END AS LapDelta
FROM clean_wx WHERE LapTimeSeconds IS NOT NULL AND TyreLifeKM IS NOT NULL AND Team IS NOT NULL"""

CTES["answers"] = f"""
SELECT Year AS year, key, count(DISTINCT RoundNumber) AS n, min(RoundNumber) AS round_number, min(EventName) AS event_name
FROM (SELECT *, {race_key('EventName')} AS key FROM rounds UNION ALL SELECT *, CAST(RoundNumber AS VARCHAR) FROM rounds)
GROUP BY ALL"""

CTES["answered"] = f"""
SELECT t.*, CASE WHEN a.n = 1 THEN a.round_number END AS round_number, CASE WHEN a.n = 1 THEN a.event_name END AS event_name,
 CASE WHEN a.n = 1 THEN 'resolved' WHEN a.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
FROM targets t LEFT JOIN answers a ON t.year = a.year AND {race_key('t.gp')} = a.key"""

CTES["stint_laps"] = """
SELECT l.*, CASE WHEN Stint IS NOT NULL THEN min(LapTimeSeconds)
 OVER (PARTITION BY Year, EventName, Driver, coalesce(d.team, l.Team), Stint, Compound) END AS fastest
FROM clean l LEFT JOIN dim_team d ON l.Team = d.alias
WHERE LapTimeSeconds IS NOT NULL AND TyreLife IS NOT NULL AND Driver IS NOT NULL AND l.Team IS NOT NULL"""

CTES["races"] = """
SELECT DISTINCT year AS target_year, round_number AS target_round, event_name AS target_event FROM answered
WHERE status = 'resolved'"""

CTES["prior"] = """
SELECT target_year, target_round, target_event, Year, RoundNumber, EventName,
 CAST(row_number() OVER (PARTITION BY target_year, target_round ORDER BY RoundNumber DESC) AS INT) AS recency
FROM races JOIN rounds ON Year = target_year AND RoundNumber < target_round"""

CTES["slices"] = """
SELECT target_year, target_round, target_event, Year, EventName,
 CASE recency WHEN 1 THEN 3.0 WHEN 2 THEN 2.5 WHEN 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
 CASE WHEN recency <= 3 THEN 'prev_' || recency || '_race' ELSE 'older_current_season' END AS source
FROM prior
UNION ALL
SELECT *, target_year - 1, target_event, 2.5::DOUBLE, 'same_race_prev_year' FROM races"""

CTES["raced"] = "SELECT DISTINCT Year, EventName FROM hl"

CTES["fallback"] = """
SELECT r.target_year, r.target_round, r.target_event, t.Year, t.EventName, 1.2::DOUBLE AS weight,
 'fallback_prev_season_tail' AS source
FROM races r JOIN (
 SELECT Year, EventName FROM rounds
 QUALIFY row_number() OVER (PARTITION BY Year ORDER BY RoundNumber DESC) <= 5) t
 ON t.Year = r.target_year - 1
WHERE NOT EXISTS (
 SELECT 1 FROM slices s JOIN raced d ON s.Year = d.Year AND s.EventName = d.EventName
 WHERE s.target_year = r.target_year AND s.target_round = r.target_round)"""

CTES["all_slices"] = "SELECT * FROM slices UNION ALL SELECT * FROM fallback"

CTES["wh"] = """
SELECT s.target_year, s.target_round, s.target_event, s.weight, s.source, h.*
FROM all_slices s JOIN hl h ON s.Year = h.Year AND s.EventName = h.EventName"""

CTES["context"] = """
SELECT t.*, coalesce(k.track_type, 'Medium') AS track_type, coalesce(k.length_km, 5.0)::DOUBLE AS track_length_km
FROM answered t LEFT JOIN dim_track k ON t.event_name = k.name"""

CTES["conditions"] = """
SELECT r.target_year, r.target_round, r.target_event, count(h.Year) AS history_rows,
 coalesce(avg(h.IsWet), 0) AS wet_share,
 CASE WHEN coalesce(avg(h.IsWet), 0) >= 0.25 THEN 'wet' ELSE 'dry' END AS inferred_condition
FROM races r LEFT JOIN wh h ON r.target_year = h.target_year AND r.target_round = h.target_round
GROUP BY ALL"""

CTES["entrants"] = """
SELECT target_year, target_round, Driver, Team, count(*) AS n FROM wh GROUP BY ALL"""

CTES["profiles"] = """
SELECT c.target_id, c.year AS target_year, c.round_number AS target_round, c.gp, c.event_name, c.status, c.driver,
 coalesce(d.team, c.team) AS team, c.track_type, c.track_length_km, c.race_laps, c.pit_loss_sec,
 CASE WHEN c.condition <> 'auto' THEN c.condition ELSE coalesce(q.inferred_condition, 'dry') END AS condition,
 coalesce(q.history_rows, 0) AS history_rows,
 CASE
  WHEN EXISTS (SELECT 1 FROM entrants e WHERE e.target_year = c.year AND e.target_round = c.round_number
   AND e.Driver = c.driver AND e.Team = coalesce(d.team, c.team)) THEN 'driver'
  WHEN EXISTS (SELECT 1 FROM entrants e WHERE e.target_year = c.year AND e.target_round = c.round_number
   AND e.Team = coalesce(d.team, c.team)) THEN 'team'
  WHEN q.history_rows > 0 THEN 'all' END AS level
FROM context c LEFT JOIN dim_team d ON c.team = d.alias
LEFT JOIN conditions q ON q.target_year = c.year AND q.target_round = c.round_number"""

CTES["experience"] = """
SELECT p.target_id, coalesce(sum(h.TrackLengthKM), 0)::DOUBLE AS wet_experience_km
FROM profiles p LEFT JOIN wh h ON h.target_year = p.target_year AND h.target_round = p.target_round
 AND h.Year = p.target_year AND h.Driver = p.driver AND h.Team = p.team AND h.IsWet = 1
 AND h.TrackType = p.track_type
GROUP BY ALL"""

CTES["scopes"] = """
SELECT DISTINCT target_year, target_round, track_type, level,
 CASE WHEN level = 'driver' THEN driver ELSE '' END AS scope_driver,
 CASE WHEN level <> 'all' THEN team ELSE '' END AS scope_team
FROM profiles WHERE level IS NOT NULL"""

FIT = "target_year, target_round, level, scope_driver, scope_team, Compound"

CTES["scoped_laps"] = f"""
SELECT s.target_year, s.target_round, s.level, s.scope_driver, s.scope_team, h.Compound, h.TyreLife,
 h.TyreLifeKM, h.LapTimeSeconds, h.LapDelta, h.weight
FROM scopes s JOIN wh h ON h.target_year = s.target_year AND h.target_round = s.target_round
 AND (s.level = 'all' OR (s.level = 'team' AND h.Team = s.scope_team)
  OR (s.level = 'driver' AND h.Team = s.scope_team AND h.Driver = s.scope_driver))
QUALIFY h.TrackType = s.track_type OR
 count(*) FILTER (h.TrackType = s.track_type) OVER (PARTITION BY s.target_year, s.target_round, s.level,
  s.scope_driver, s.scope_team, h.Compound) < 12"""

CTES["moments"] = f"""
SELECT {FIT}, count(*) AS n, max(TyreLifeKM) - min(TyreLifeKM) AS spread,
 sum(weight * weight) FILTER (LapDelta IS NOT NULL) AS s,
 sum(weight * weight * TyreLifeKM) FILTER (LapDelta IS NOT NULL) AS sx,
 sum(weight * weight * LapDelta) AS sy,
 sum(weight * weight * TyreLifeKM * TyreLifeKM) FILTER (LapDelta IS NOT NULL) AS sxx,
 sum(weight * weight * TyreLifeKM * LapDelta) AS sxy,
 quantile_cont(TyreLifeKM, 0.75) AS q75, quantile_cont(TyreLifeKM, 0.9) AS q90
FROM scoped_laps GROUP BY ALL"""

CTES["lines"] = """
SELECT m.*,
 CASE WHEN n >= 6 AND spread > 0 THEN greatest(0, coalesce(b, 0)) ELSE 0.03 END::DOUBLE AS slope,
 CASE WHEN n >= 6 AND spread > 0 THEN greatest(0, coalesce((sy - b * sx) / s, 0)) ELSE 0 END::DOUBLE AS intercept
FROM (SELECT *, (s * sxy - sx * sy) / nullif(s * sxx - sx * sx, 0) AS b FROM moments) m"""

CTES["fresh"] = f"""
SELECT {FIT}, min(LapTimeSeconds) AS fresh_lap_time_sec FROM (
 SELECT *, sum(tenths) OVER (PARTITION BY {FIT} ORDER BY LapTimeSeconds) AS cum,
  sum(tenths) OVER (PARTITION BY {FIT}) AS total
 FROM (SELECT *, CAST(round(weight * 10) AS BIGINT) AS tenths FROM scoped_laps QUALIFY TyreLife <= 2
  OR count(*) FILTER (TyreLife <= 2) OVER (PARTITION BY {FIT}) = 0))
WHERE 2 * cum >= total GROUP BY ALL"""

CTES["models"] = """
SELECT target_id, Compound, slope AS slope_sec_per_km, intercept AS intercept_sec, window_km,
 greatest(1.0, round_even(round_even(window_km / track_length_km * 1e6::DOUBLE, 0) / 1e6::DOUBLE, 0)) AS window_laps, fresh_lap_time_sec,
 n::DOUBLE AS sample_size, track_length_km
FROM (
 SELECT *, least(CASE WHEN slope > 1e-6 THEN 1.2 / slope ELSE q75 END, q90) AS window_km FROM (
  SELECT p.target_id, p.track_length_km, l.Compound, l.intercept, l.q75, l.q90, l.n, f.fresh_lap_time_sec,
   CASE WHEN l.Compound IN ('INTERMEDIATE', 'WET') AND x.wet_experience_km > 0
    THEN l.slope * (1.0 - least(0.2, x.wet_experience_km / 2000.0)) ELSE l.slope END AS slope
  FROM profiles p JOIN experience x ON p.target_id = x.target_id
  JOIN lines l ON l.target_year = p.target_year AND l.target_round = p.target_round AND l.level = p.level
   AND l.scope_driver = CASE WHEN p.level = 'driver' THEN p.driver ELSE '' END
   AND l.scope_team = CASE WHEN p.level <> 'all' THEN p.team ELSE '' END
  JOIN fresh f ON f.target_year = l.target_year AND f.target_round = l.target_round AND f.level = l.level
   AND f.scope_driver = l.scope_driver AND f.scope_team = l.scope_team AND f.Compound = l.Compound))"""

CTES["overstay"] = f"""
SELECT target_id, Compound, extra_lap, {r3('w * extra_lap')} AS incremental_delta_sec,
 {r3("list_reduce(list_transform(range(1, extra_lap + 1), lambda i: w * i), lambda a, b: a + b)")} AS cumulative_delta_sec
FROM (SELECT target_id, Compound, slope_sec_per_km * track_length_km AS w,
 CAST(unnest(range(1, 11)) AS INT) AS extra_lap FROM models)"""

CTES["pools"] = """
SELECT * FROM (VALUES ('dry','SOFT',0),('dry','MEDIUM',1),('dry','HARD',2),
 ('wet','INTERMEDIATE',0),('wet','WET',1),('mixed','SOFT',0),('mixed','MEDIUM',1),('mixed','HARD',2),
 ('mixed','INTERMEDIATE',3),('mixed','WET',4)) AS t(condition, Compound, ord)"""

CTES["choices"] = """
SELECT p.target_id, p.condition, p.race_laps, p.pit_loss_sec, o.ord, m.Compound,
 m.fresh_lap_time_sec AS fresh, m.slope_sec_per_km * p.track_length_km AS wear,
 greatest(5, CAST(m.window_laps AS INT) - 6) AS low,
 greatest(greatest(5, CAST(m.window_laps AS INT) - 6), CAST(m.window_laps AS INT) + 6) AS high
FROM profiles p JOIN models m ON p.target_id = m.target_id
JOIN pools o ON o.condition = p.condition AND o.Compound = m.Compound"""

CTES["two"] = """
SELECT * FROM (
 SELECT a.target_id, a.pit_loss_sec, a.Compound AS c1, b.Compound AS c2, NULL AS c3,
  a.ord AS o1, b.ord AS o2, 0 AS o3, a.fresh AS f1, b.fresh AS f2, 0.0 AS f3, a.wear AS w1, b.wear AS w2, 0.0 AS w3,
  CAST(unnest(range(a.low, a.high + 1, 2)) AS INT) AS n1, a.race_laps, b.low, b.high
 FROM choices a JOIN choices b ON a.target_id = b.target_id
 WHERE a.condition <> 'dry' OR a.Compound <> b.Compound)
WHERE n1 < race_laps AND race_laps - n1 BETWEEN low AND high"""

CTES["three"] = """
SELECT * FROM (SELECT *, CAST(unnest(range(low2, high2 + 1, 2)) AS INT) AS n2 FROM (
 SELECT a.target_id, a.pit_loss_sec, a.Compound AS c1, b.Compound AS c2, c.Compound AS c3,
  a.ord AS o1, b.ord AS o2, c.ord AS o3, a.fresh AS f1, b.fresh AS f2, c.fresh AS f3,
  a.wear AS w1, b.wear AS w2, c.wear AS w3,
  CAST(unnest(range(a.low, a.high + 1, 2)) AS INT) AS n1, b.low AS low2, b.high AS high2, a.race_laps, c.low, c.high
 FROM choices a JOIN choices b ON a.target_id = b.target_id JOIN choices c ON a.target_id = c.target_id
 WHERE a.condition <> 'dry' OR NOT (a.Compound = b.Compound AND b.Compound = c.Compound)))
WHERE n1 < race_laps AND n2 < race_laps - n1 AND race_laps - n1 - n2 BETWEEN low AND high"""

CTES["candidates"] = """
SELECT target_id, pit_loss_sec, 1 AS stops, o1, o2, o3, c1 || '-' || c2 AS compounds,
 n1 || '-' || (race_laps - n1) AS stint_laps, n1, 0 AS n2, race_laps - n1 AS n9,
 f1, 0.0 AS f2, f2 AS f9, w1, 0.0 AS w2, w2 AS w9 FROM two
UNION ALL
SELECT target_id, pit_loss_sec, 2, o1, o2, o3, c1 || '-' || c2 || '-' || c3,
 n1 || '-' || n2 || '-' || (race_laps - n1 - n2), n1, n2, race_laps - n1 - n2,
 f1, f2, f3, w1, w2, w3 FROM three"""

CTES["scored"] = f"""
SELECT *, {r3('''(n1 * f1 + w1 * (n1 * (n1 - 1)) / 2.0::DOUBLE) + (n2 * f2 + w2 * (n2 * (n2 - 1)) / 2.0::DOUBLE)
 + (n9 * f9 + w9 * (n9 * (n9 - 1)) / 2.0::DOUBLE) + pit_loss_sec * stops''')} AS predicted_total_time_sec
FROM candidates"""

CTES["best"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY target_id
 ORDER BY predicted_total_time_sec, stops, o1, o2, o3, n1, n2) AS INT) AS rank
FROM scored QUALIFY rank <= 5"""

CTES["documents"] = f"""
SELECT p.target_id, CASE WHEN p.status <> 'resolved' THEN p.status WHEN p.history_rows = 0 THEN 'no_history' WHEN m.models IS NULL THEN 'no_models' ELSE 'ok' END AS status,
 p.target_year AS year, p.gp AS grand_prix, p.event_name, p.driver, p.team, p.track_type, p.track_length_km,
 p.race_laps, p.condition AS race_condition, p.history_rows, {r3('x.wet_experience_km')} AS wet_experience_km,
 coalesce(m.models, 0) AS models, coalesce(b.plans, '') AS plans, b.best_time_sec,
 coalesce(o.overstay, '') AS overstay, o.last_cumulative_sec
FROM profiles p JOIN experience x ON p.target_id = x.target_id
LEFT JOIN (SELECT target_id, CAST(count(*) AS INT) AS models FROM models GROUP BY ALL) m ON m.target_id = p.target_id
LEFT JOIN (SELECT target_id, string_agg(compounds || ' ' || stint_laps, '; ' ORDER BY rank) AS plans,
 min(predicted_total_time_sec) AS best_time_sec FROM best GROUP BY ALL) b ON b.target_id = p.target_id
LEFT JOIN (SELECT target_id, string_agg(Compound, '; ' ORDER BY Compound) AS overstay,
 max(cumulative_delta_sec) AS last_cumulative_sec FROM overstay WHERE extra_lap = 10 GROUP BY ALL) o
 ON o.target_id = p.target_id"""

PROFILED = [
    ("laps", "laps_raw", [
        ("Year", "int"), ("RoundNumber", "int"), ("EventName", "string"), ("Driver", "string"),
        ("Team", "string"), ("LapNumber", "double"), ("Stint", "int"), ("Compound", "string"),
        ("TyreLife", "double"), ("Time", "double"), ("LapTimeSeconds", "double"),
        ("IsAccurate", "boolean"), ("TrackStatus", "string"),
    ]),
    ("weather", "weather", [
        ("Year", "int"), ("RoundNumber", "int"), ("Time", "double"), ("seq", "bigint"),
        ("AirTemp", "double"), ("TrackTemp", "double"), ("Humidity", "double"), ("Rainfall", "boolean"),
        ("WindSpeed", "double"), ("WindDirection", "double"),
    ]),
    ("schedule", "schedule", [
        ("Year", "int"), ("RoundNumber", "int"), ("EventName", "string"), ("EventDate", "string"),
    ]),
]

FEATURES = (
    f"Year, RoundNumber, EventName, {KEYS}, Driver, Team, Compound, TrackType, LapNumber, TyreLife,"
    f" {r6('TyreLifeKM')} AS TyreLifeKM, Stint, IsWet, AirTemp, TrackTemp, Humidity, Rainfall,"
    f" {r6('TeamBaselinePace')} AS TeamBaselinePace, {r6('FieldBaselinePace')} AS FieldBaselinePace,"
    f" {r6('RelativePace')} AS RelativePace, LapTimeSeconds"
)

FINAL = {
    "clean_laps": f"SELECT Year, RoundNumber, EventName, Driver, Team, LapNumber, Stint, Compound, TyreLife, Time, LapTimeSeconds, {KEYS} FROM clean",
    "asof_stored": f"SELECT {KEYS}, Year, RoundNumber, Time, {WEATHER} FROM clean_wx",
    "asof_weather": f"SELECT {KEYS}, Year, RoundNumber, Time, {WEATHER} FROM clean_wx",
    "normalize_team": f"SELECT {LKEYS}, l.Team AS alias, coalesce(d.team, l.Team) AS Team FROM laps_raw l LEFT JOIN dim_team d ON l.Team = d.alias",
    "track_features": f"SELECT {LKEYS}, l.EventName, coalesce(t.track_type, 'Medium') AS TrackType, coalesce(t.length_km, 5.0)::DOUBLE AS TrackLengthKM, {r6('l.TyreLife * coalesce(t.length_km, 5.0)')} AS TyreLifeKM FROM laps_raw l LEFT JOIN dim_track t ON l.EventName = t.name",
    "refreshed_counts": "SELECT Year, RoundNumber, EventName, Driver, Team, Stint, Compound, TyreLife, LapTimeSeconds, IsWet, count(*) AS n FROM hl GROUP BY ALL",
    "wet_flag": f"SELECT {KEYS}, Compound, Rainfall, IsWet FROM hl",
    "pace_baselines": f"SELECT {KEYS}, Team, {r6('FieldBaselinePace')} AS FieldBaselinePace, {r6('TeamBaselinePace')} AS TeamBaselinePace, {r6('RelativePace')} AS RelativePace FROM paced",
    "lap_features": f"SELECT {FEATURES} FROM features",
    "completed_events": "SELECT Year, RoundNumber, EventName, EventDate FROM completed",
    "era_features": f"SELECT e.era, f.* FROM (SELECT {FEATURES} FROM features) f JOIN era_events e ON f.Year = e.Year AND f.EventName = e.EventName",
    "event_status": "SELECT * FROM event_status",
    "era_coverage": """SELECT e.era, e.start_year, e.end_year,
 CASE WHEN coalesce(sum(s.usable_laps), 0) > 0 THEN 'has_data' ELSE 'no_data' END AS status,
 CAST(coalesce(sum(s.usable_laps), 0) AS BIGINT) AS rows,
 coalesce(string_agg(s.Year || ':' || s.EventName, ';' ORDER BY s.Year, s.RoundNumber) FILTER (s.status = 'loaded'), '') AS loaded_events,
 coalesce(string_agg(s.Year || ':' || s.EventName || ':' || s.status, ';' ORDER BY s.Year, s.RoundNumber) FILTER (s.status <> 'loaded'), '') AS failed_events
FROM eras e LEFT JOIN event_status s ON e.era = s.era GROUP BY ALL""",
    "target_context": "SELECT target_id, year, gp, round_number, event_name, track_type, track_length_km, status FROM context",
    "prior_races": "SELECT target_year, target_round, target_event, Year, RoundNumber, EventName, recency FROM prior",
    "race_slices": "SELECT * FROM slices",
    "weighted_history": f"SELECT target_year, target_round, Year, RoundNumber, EventName, Driver, Team, LapNumber, TyreLife, {r6('TyreLifeKM')} AS TyreLifeKM, TrackLengthKM, Compound, Stint, TrackType, IsWet, AirTemp, TrackTemp, Humidity, Rainfall, LapTimeSeconds, {KEYS}, weight AS DataWeight, source AS DataSource FROM wh",
    "history_fallback": "SELECT * FROM fallback",
    "race_condition": f"SELECT target_year, target_round, target_event, history_rows, {r6('wet_share')} AS wet_share, inferred_condition FROM conditions",
    "wet_experience": f"SELECT target_id, {r6('wet_experience_km')} AS wet_experience_km FROM experience",
    "pace_quantiles": "SELECT Year, Compound, count(pace) AS rows, " + ", ".join(
        f"{r6(f'quantile_cont(pace, {q})')} AS {name}"
        for name, q in [("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99)]
    ) + " FROM (SELECT Year, Compound, LapTimeSeconds / coalesce(t.length_km, 5.0)::DOUBLE AS pace"
    " FROM clean l LEFT JOIN dim_track t ON l.EventName = t.name) WHERE pace IS NOT NULL GROUP BY ALL",
    "lap_delta": f"SELECT {KEYS}, {r6('fastest')} AS StintBaseline, {r6('LapTimeSeconds - fastest')} AS LapDelta FROM stint_laps",
    "scope_level": "SELECT target_id, target_year, target_round, driver, team, level FROM profiles",
    "wls_degradation": f"SELECT {FIT}, {r6('slope')} AS slope, {r6('intercept')} AS intercept, n AS sample_size FROM lines",
    "fresh_lap_weighted_median": f"SELECT {FIT}, {r6('fresh_lap_time_sec')} AS fresh_lap_time_sec FROM fresh",
    "compound_models": f"SELECT target_id, Compound, {r6('slope_sec_per_km')} AS slope_sec_per_km, {r6('intercept_sec')} AS intercept_sec, {r6('window_km')} AS window_km, window_laps, {r6('fresh_lap_time_sec')} AS fresh_lap_time_sec, sample_size FROM models",
    "overstay_table": "SELECT * FROM overstay",
    "candidate_plans": "SELECT target_id, stops, compounds, stint_laps FROM candidates",
    "score_plans": "SELECT target_id, stops, compounds, stint_laps, predicted_total_time_sec FROM scored",
    "best_plans": "SELECT target_id, rank, stops, compounds, stint_laps, predicted_total_time_sec FROM best",
    "plan_document": "SELECT * FROM documents",
    "train_test_split": f"""SELECT {KEYS}, number % 100 < 20 AS is_test, number % 100 >= 20 AND (number // 100) % 10 < 1 AS is_validation
FROM (SELECT *, CAST('0x' || substr(md5({" || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in LAP_KEYS)} || '|42'), 1, 8) AS BIGINT) AS number FROM clean)""",
    "schema_profile": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type, count(*) AS row_count,"
        f" count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_values FROM {source}"
        for table, source, columns in PROFILED for name, kind in columns
    ),
    "merged_profile": " UNION ALL ".join(
        f"SELECT Year, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,"
        f" CASE WHEN count(DISTINCT {c}) <= 500 THEN count(DISTINCT {c}) END AS few_values, true AS is_close FROM laps_raw GROUP BY Year"
        for table, _, columns in PROFILED if table == "laps" for c, _ in columns if c not in ("Year", "RoundNumber")
    ),
    "ingested_laps": """SELECT Year, RoundNumber, EventName, Driver, Team, LapNumber, Stint, Compound,
 CASE WHEN l_partkey % 7 <> 0 THEN TyreLife END AS TyreLife, Time, round(LapTimeSeconds, 3) AS LapTimeSeconds, IsAccurate, TrackStatus FROM laps_raw""",
    "lap_time_model": """SELECT e.era, CASE WHEN f.n > 0 THEN 'trained' ELSE 'no_data' END AS status, start_year, end_year,
 '""" + TEST_AS_OF + """' AS as_of, f.n AS rows, CAST(12 + f.levels AS INT) AS features, CASE WHEN f.n > 0 THEN true END AS better_than_mean
FROM eras e LEFT JOIN (
 SELECT era, count(*) AS n, count(DISTINCT Driver) FILTER (fitted) + count(DISTINCT Team) FILTER (fitted)
  + count(DISTINCT Compound) FILTER (fitted) + count(DISTINCT TrackType) FILTER (fitted) AS levels
 FROM era_laps GROUP BY era) f ON e.era = f.era""",
    "score_laps": f"""SELECT {LKEYS}, l.EventName AS track_name, l.Driver, coalesce(d.team, l.Team) AS Team, l.Compound,
 coalesce(t.track_type, 'Medium') AS TrackType, l.LapNumber, l.TyreLife,
 {r6('l.TyreLife * coalesce(t.length_km, 5.0)')} AS TyreLifeKM, l.Stint,
 CAST(coalesce(l.Compound IN ('INTERMEDIATE', 'WET'), false) AS INT) AS IsWet, 30.0::DOUBLE AS AirTemp, 40.0::DOUBLE AS TrackTemp,
 50.0::DOUBLE AS Humidity, 0 AS Rainfall, 100.0::DOUBLE AS TeamBaselinePace, 100.0::DOUBLE AS FieldBaselinePace,
 0.0::DOUBLE AS RelativePace,
 concat_ws(',', CASE WHEN LapNumber IS NULL THEN 'LapNumber' END, CASE WHEN TyreLife IS NULL THEN 'TyreLife,TyreLifeKM' END,
  CASE WHEN Stint IS NULL THEN 'Stint' END) AS missing,
 true AS has_prediction
FROM laps_raw l LEFT JOIN dim_team d ON l.Team = d.alias LEFT JOIN dim_track t ON l.EventName = t.name""",
    "score_laps_by_era": f"""SELECT {KEYS}, Year AS year,
 CASE WHEN Year <= 1997 THEN 'early' WHEN Year <= 1999 THEN 'middle' END AS era,
 concat_ws(',', CASE WHEN LapNumber IS NULL THEN 'LapNumber' END, CASE WHEN TyreLife IS NULL THEN 'TyreLife,TyreLifeKM' END,
  CASE WHEN Stint IS NULL THEN 'Stint' END) AS missing,
 true AS has_prediction FROM laps_raw""",
    "one_race_model": f"""SELECT 1997 AS Year, 'Event 05' AS EventName, count(*) AS rows,
 CAST(12 + count(DISTINCT Driver) FILTER (fitted) + count(DISTINCT Team) FILTER (fitted)
  + count(DISTINCT Compound) FILTER (fitted) + count(DISTINCT TrackType) FILTER (fitted) AS INT) AS features, true AS has_rmse
FROM (SELECT *, {NUMBER} % 100 >= 20 AS fitted FROM features WHERE Year = 1997 AND EventName = 'Event 05')""",
    "one_driver_model": f"""SELECT 1997 AS Year, 'Event 05' AS EventName, count(*) AS rows,
 CAST(12 + count(DISTINCT Driver) FILTER (fitted) + count(DISTINCT Team) FILTER (fitted)
  + count(DISTINCT Compound) FILTER (fitted) + count(DISTINCT TrackType) FILTER (fitted) AS INT) AS features, count(*) >= 50 AS has_rmse
FROM (SELECT *, count(*) OVER () < 50 OR {NUMBER} % 100 >= 20 AS fitted FROM features
 WHERE Year = 1997 AND EventName = 'Event 05'
 AND Driver = (SELECT min(Driver) FROM laps_raw WHERE Year = 1997 AND EventName = 'Event 05'))""",
    "lap_and_plan": "SELECT *, true AS has_prediction FROM documents",
}


def _uses(text: str) -> set[str]:
    return {name for name in CTES if re.search(rf"\b(?:FROM|JOIN) {name}\b", text)}


def _needed(text: str, found: list[str]) -> list[str]:
    for name in CTES:
        if name not in found and name in _uses(text):
            _needed(CTES[name], found)
            if name not in found:
                found.append(name)
    return found


def sql(name: str) -> str:
    """One statement with the common table expressions it needs, in order."""
    final = FINAL[name]
    steps = ",\n".join(f"{step} AS ({CTES[step]})" for step in _needed(final, []))
    return f"WITH {steps}\n{final}"


def statements() -> dict[str, str]:
    return {name: sql(name) for name in FINAL}
