"""Lap-data tables derived from the given tables, for tests and registered queries.

The same SQL runs in Spark and in DuckDB; ``@secs`` and ``@k`` are the two places where the
dialects differ.  ``FIXTURES.md`` describes the shapes.  Nothing here is part of the engine.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lapwise import schemas
from lapwise.sources import dims
from lapwise.sources.tables import conform

LAP_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Eras that fit the years of the test tables.
TEST_ERAS = [("early", 1995, 1997), ("late", 1998, 2001), ("future", 2002, 2004)]
TEST_AS_OF = "2001-10-15"

SQL = {
    "dim_team_raw": """
SELECT * FROM (VALUES (0,'Toro Rosso'),(1,'Oracle Red Bull Racing'),(2,'Mercedes'),
 (3,'Scuderia Ferrari HP'),(4,'McLaren F1 Team'),(5,'Kick Sauber'),(6,'Racing Point'),(7,'Renault'),
 (8,'RB'),(9,'Privateer X')) AS t(code, alias)""",
    "dim_track": """
SELECT concat('Event ', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS name,
 CASE WHEN n_regionkey = 0 THEN 'Low' WHEN n_regionkey <= 2 THEN 'Medium' ELSE 'High' END AS track_type,
 CAST(4 + n_nationkey * 0.125 AS DOUBLE) AS length_km
FROM nation""",
    "laps_raw": """
SELECT CAST(year(l_shipdate) AS INT) AS Year, CAST(month(l_shipdate) AS INT) AS RoundNumber,
 CASE WHEN month(l_shipdate) = 12 THEN 'Season Finale' ELSE concat('Event ', lpad(CAST(month(l_shipdate) AS STRING), 2, '0')) END AS EventName,
 concat('D', CAST(l_suppkey % 20 AS STRING)) AS Driver, r.alias AS Team,
 CAST(l_quantity AS DOUBLE) AS LapNumber,
 CASE WHEN l_partkey % 1999 = 0 THEN NULL ELSE CAST(1 + l_partkey % 3 AS INT) END AS Stint,
 CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'SOFT' WHEN l_returnflag = 'A' THEN 'MEDIUM'
  WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'HARD'
  WHEN l_returnflag = 'N' THEN CASE WHEN month(l_shipdate) <= 3 THEN 'INTERMEDIATE' ELSE 'SOFT' END
  WHEN l_linestatus = 'F' THEN CASE WHEN month(l_shipdate) <= 3 THEN 'WET' ELSE 'HARD' END
  ELSE 'UNKNOWN' END AS Compound,
 CAST((l_linenumber - 1) * 5 + 1 AS DOUBLE) AS TyreLife,
 CAST((day(l_shipdate) - 1) * 86400 + l_quantity * 1000 AS DOUBLE) AS Time,
 CASE WHEN l_partkey % 1001 = 1000 THEN NULL
  ELSE 90 + CAST(0.0625 AS DOUBLE) * ((l_linenumber - 1) * 5 + 1) + floor(l_tax * 100 + CAST(0.5 AS DOUBLE)) / 10
  END AS LapTimeSeconds,
 l_discount < CAST(0.095 AS DOUBLE) AS IsAccurate,
 CASE WHEN o_orderstatus = 'P' AND l_linenumber = 7 THEN '4' ELSE '1' END AS TrackStatus,
 l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN dim_team_raw r ON l_suppkey % 10 = r.code""",
    "weather": """
SELECT CAST(1995 + event_id % 7 AS INT) AS Year, CAST(1 + event_id % 12 AS INT) AS RoundNumber,
 CAST(@secs AS DOUBLE) AS Time, event_id AS seq,
 CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS AirTemp, value + 10 AS TrackTemp,
 CAST(@k AS DOUBLE) AS Humidity, (event_type = 'error' AND event_id % 12 < 3) AS Rainfall,
 value / 8 AS WindSpeed, CAST(event_id % 360 AS DOUBLE) AS WindDirection FROM events""",
    "schedule": """
SELECT CAST(y AS INT) AS Year, CAST(r AS INT) AS RoundNumber,
 CASE WHEN r = 12 THEN 'Season Finale' ELSE concat('Event ', lpad(CAST(r AS STRING), 2, '0')) END AS EventName,
 CASE WHEN y = 2001 AND r = 11 THEN 'TBC' WHEN y = 2001 AND r = 12 THEN NULL
  ELSE concat(CAST(y AS STRING), '-', lpad(CAST(r AS STRING), 2, '0'), '-28') END AS EventDate
FROM (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem) AS a
 CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS b(r)
UNION ALL SELECT CAST(max(year(l_shipdate)) AS INT), CAST(NULL AS INT), 'Testing', '2001-01-15' FROM lineitem
UNION ALL SELECT CAST(max(year(l_shipdate)) + 1 AS INT), 1, 'Opening Night', '2002-01-28' FROM lineitem
UNION ALL SELECT CAST(max(year(l_shipdate)) + 1 AS INT), 2, 'Twin', '2002-02-28' FROM lineitem
UNION ALL SELECT CAST(max(year(l_shipdate)) + 1 AS INT), 3, 'Twin Grand Prix', '2002-03-28' FROM lineitem""",
    "targets": """
SELECT CAST(s.Year * 10000 + s.RoundNumber * 100 + p.i AS BIGINT) AS target_id, s.Year AS year,
 CASE p.i WHEN 3 THEN concat(' ', lower(s.EventName), ' GRAND PRIX') WHEN 4 THEN CAST(s.RoundNumber AS STRING) ELSE s.EventName END AS gp,
 CASE WHEN p.i < 20 THEN concat('D', CAST(p.i AS STRING)) ELSE 'D99' END AS driver,
 CASE WHEN p.i < 20 THEN r.alias WHEN p.i < 22 THEN 'Kick Sauber' ELSE 'Nobody GP' END AS team,
 40 + (s.Year % 3) * 8 AS race_laps,
 CASE WHEN p.i = 1 AND s.RoundNumber = 6 THEN 'mixed' WHEN p.i = 2 AND s.RoundNumber = 4 THEN 'wet'
  ELSE 'auto' END AS condition,
 CAST(21.0 + p.i % 2 * 0.5 AS DOUBLE) AS pit_loss_sec
FROM schedule s CROSS JOIN (SELECT DISTINCT c_custkey % 24 AS i FROM customer) AS p
 JOIN dim_team_raw r ON p.i % 10 = r.code
WHERE s.RoundNumber IN (1, 4, 6, 10)
UNION ALL SELECT CAST(max(year(l_shipdate)) * 10000 + 9999 AS BIGINT), CAST(max(year(l_shipdate)) AS INT),
 'Event 99', 'D1', 'Renault', 50, 'auto', CAST(21.0 AS DOUBLE) FROM lineitem
UNION ALL SELECT CAST(max(year(l_shipdate)) * 10000 + 19998 AS BIGINT), CAST(max(year(l_shipdate)) + 1 AS INT),
 'twin', 'D1', 'Renault', 50, 'auto', CAST(21.0 AS DOUBLE) FROM lineitem""",
}

GIVEN = {
    "dim_track": ["nation"],
    "laps_raw": ["lineitem", "orders", "dim_team_raw"],
    "weather": ["events"],
    "schedule": ["lineitem"],
    "targets": ["schedule", "customer", "dim_team_raw", "lineitem"],
}

SPARK_WORDS = {
    "@secs": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6D",
    "@k": "get_json_object(props, '$.k')",
}
DUCKDB_WORDS = {
    "@secs": "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6",
    "@k": "json_extract_string(props, '$.k')",
}


def localized(name: str, words: dict[str, str]) -> str:
    text = SQL[name]
    for word, meaning in words.items():
        text = text.replace(word, meaning)
    return text


class Tables:
    """Lazy lap-data tables over the Parquet files in one folder, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name not in SQL:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        inputs = {given: self.table(given) for given in GIVEN.get(name, [])}
        text = localized(name, SPARK_WORDS)
        for given in inputs:
            for before in ("FROM ", "JOIN "):
                text = text.replace(f"{before}{given}", f"{before}{{{given}}}")
        return self.spark.sql(text, **inputs) if inputs else self.spark.sql(text)

    @cached_property
    def teams(self) -> DataFrame:
        return dims.team_names(self.spark)

    @cached_property
    def tracks(self) -> DataFrame:
        return self.table("dim_track")

    @cached_property
    def laps(self) -> DataFrame:
        return self.table("laps_raw").select(*schemas.LAPS.names, *LAP_KEYS)

    @cached_property
    def weather(self) -> DataFrame:
        return conform(self.table("weather"), schemas.WEATHER)

    @cached_property
    def schedule(self) -> DataFrame:
        return conform(self.table("schedule"), schemas.SCHEDULE)

    @cached_property
    def targets(self) -> DataFrame:
        return conform(self.table("targets"), schemas.TARGETS)

    @cached_property
    def eras(self) -> DataFrame:
        return dims.literal_table(self.spark, TEST_ERAS, ["era", "start_year", "end_year"])
