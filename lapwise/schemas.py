"""Table schemas and the column lists the jobs share.

``Time`` restarts in every session, so (Year, RoundNumber) belongs to every
time-based key.  Missing values are NULL; ``sources.tables`` turns NaN into NULL.
"""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


INT, LONG, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
STRING, BOOL = T.StringType(), T.BooleanType()

LAPS = _struct(
    ("Year", INT, False), ("RoundNumber", INT, False), ("EventName", STRING, False),
    ("Driver", STRING, True), ("Team", STRING, True), ("LapNumber", DOUBLE, True),
    ("Stint", INT, True), ("Compound", STRING, True), ("TyreLife", DOUBLE, True),
    ("Time", DOUBLE, False), ("LapTimeSeconds", DOUBLE, True),
    ("IsAccurate", BOOL, False), ("TrackStatus", STRING, False),
)

WEATHER = _struct(
    ("Year", INT, False), ("RoundNumber", INT, False), ("Time", DOUBLE, True), ("seq", LONG, False),
    ("AirTemp", DOUBLE, True), ("TrackTemp", DOUBLE, True), ("Humidity", DOUBLE, True),
    ("Rainfall", BOOL, True), ("WindSpeed", DOUBLE, True), ("WindDirection", DOUBLE, True),
)

SCHEDULE = _struct(
    ("Year", INT, False), ("RoundNumber", INT, True), ("EventName", STRING, True),
    ("EventDate", STRING, True),
)

TARGETS = _struct(
    ("target_id", LONG, False), ("year", INT, False), ("gp", STRING, False),
    ("driver", STRING, False), ("team", STRING, False), ("race_laps", INT, False),
    ("condition", STRING, True), ("pit_loss_sec", DOUBLE, True),
)

TO_SCORE = _struct(
    ("lap_number", DOUBLE, False), ("tyre_life_laps", DOUBLE, False), ("compound", STRING, False),
    ("stint", INT, False), ("team", STRING, False), ("driver", STRING, False),
    ("track_name", STRING, False), ("air_temp", DOUBLE, True), ("track_temp", DOUBLE, True),
    ("humidity", DOUBLE, True), ("rainfall", BOOL, True), ("wind_speed", DOUBLE, True),
    ("team_baseline_pace", DOUBLE, True), ("field_baseline_pace", DOUBLE, True),
)

# Column names.
SESSION = ["Year", "RoundNumber"]
RACE = ["Year", "EventName"]
STINT = ["Year", "EventName", "Driver", "Team", "Stint", "Compound"]
TARGET_RACE = ["target_year", "target_round"]

WEATHER_FIELDS = ["AirTemp", "TrackTemp", "Humidity", "Rainfall", "WindSpeed", "WindDirection"]
WEATHER_FEATURES = ["AirTemp", "TrackTemp", "Humidity", "Rainfall"]

CATEGORICAL = ["Driver", "Team", "Compound", "TrackType"]
NUMERIC = [
    "LapNumber", "TyreLife", "TyreLifeKM", "Stint", "IsWet", "AirTemp", "TrackTemp", "Humidity",
    "Rainfall", "TeamBaselinePace", "FieldBaselinePace", "RelativePace",
]
TARGET = "LapTimeSeconds"

HISTORY_COLUMNS = [
    "Year", "RoundNumber", "EventName", "Driver", "Team", "LapNumber", "TyreLife", "TyreLifeKM",
    "TrackLengthKM", "Compound", "Stint", "TrackType", "IsWet", "AirTemp", "TrackTemp", "Humidity",
    "Rainfall", "LapTimeSeconds",
]
# Tyre age in km is missing exactly when TyreLife is.
HISTORY_REQUIRED = ["LapTimeSeconds", "TyreLife", "Compound", "Driver", "Team"]
