"""Refreshing a derived table by the sessions whose files changed, against a full run."""

import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lapwise.plans import history
from lapwise.sources import dims
from lapwise.sources.incremental import SessionTable, Source, file_digests
from lapwise.sources.tables import read_laps, read_weather, write_sessions

LAP = (
    "Year int, RoundNumber int, EventName string, Driver string, Team string, LapNumber double, Stint int, Compound string,"
    " TyreLife double, Time double, LapTimeSeconds double, IsAccurate boolean, TrackStatus string"
)
SAMPLE = "Year int, RoundNumber int, Time double, seq long, Rainfall boolean"


def session(round_number, laps=4, clean=True, year=2024):
    return [
        (year, round_number, f"E{round_number}", "A", "T", float(k), 1, "SOFT", float(k), 100.0 * k, 90.0 + k % 2, clean, "1")
        for k in range(1, laps + 1)
    ]


@pytest.fixture
def place(spark, tmp_path):
    teams = dims.team_names(spark)
    sources = {"laps": Source(str(tmp_path / "laps"), read_laps), "weather": Source(str(tmp_path / "weather"), read_weather)}
    seen = []

    def build(laps, weather):
        seen.append(sorted({r["RoundNumber"] for r in laps.select("RoundNumber").distinct().collect()}))
        return history.session_lap_counts(laps, weather, teams)

    def put(rows):
        write_sessions(spark.createDataFrame(rows, LAP), sources["laps"].path, only_present=True)

    def full():
        tables = {name: s.read(spark, s.path) for name, s in sources.items()}
        return Counter(map(tuple, history.session_lap_counts(teams=teams, **tables).collect()))

    def got(table):
        columns = history.session_lap_counts(spark.createDataFrame([], LAP), spark.createDataFrame([], SAMPLE), teams).columns
        return Counter(map(tuple, table.read().select(*columns).collect()))

    write_sessions(spark.createDataFrame([(2024, r, 50.0, 1, r == 2) for r in range(1, 6)], SAMPLE), sources["weather"].path)
    put(session(1) + session(2, 6) + session(3))
    table = SessionTable(spark, str(tmp_path / "counts"), build)
    return table, sources, seen, put, full, got


def test_only_changed_sessions_are_built(place):
    table, sources, seen, put, full, got = place
    first = table.refresh(sources)
    # Weather of sessions without laps is a session too, with no rows.
    assert first.built == [(2024, r) for r in range(1, 6)] and got(table) == full()
    put(session(2, 9) + session(4))
    second = table.refresh(sources)
    assert second.built == [(2024, 2), (2024, 4)] and seen[-1] == [2, 4] and got(table) == full()


def test_unchanged_sources_are_not_read(place, spark):
    table, sources, seen, _, full, got = place
    table.refresh(sources)
    n = len(seen)
    assert table.refresh(sources).built == [] and len(seen) == n and got(table) == full()
    listing = file_digests(spark, sources["laps"].path)
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower().replace("*.parquet", "") and "content" not in plan.split("ReadSchema")[1]


def test_a_session_may_lose_all_its_rows_or_go(place):
    table, sources, _, put, full, got = place
    table.refresh(sources)
    put(session(1, clean=False))
    assert table.refresh(sources).built == [(2024, 1)] and got(table) == full()
    for source in sources.values():
        shutil.rmtree(f"{source.path}/Year=2024/RoundNumber=3")
    after = table.refresh(sources)
    assert after.removed == [(2024, 3)] and after.built == [] and got(table) == full()
    assert {s for s, _ in table.manifest().items()} == {(2024, 1), (2024, 2), (2024, 4), (2024, 5)}


def test_weather_alone_or_another_version_rebuilds(place, spark):
    table, sources, seen, _, full, got = place
    table.refresh(sources)
    rain = spark.createDataFrame([(2024, 3, 50.0, 1, True)], SAMPLE)
    write_sessions(rain, sources["weather"].path, only_present=True)
    assert table.refresh(sources).built == [(2024, 3)] and got(table) == full()
    other = SessionTable(spark, table.data.removesuffix("/data"), table.build, "2")
    assert len(other.refresh(sources).built) == 5 and got(other) == full()


def test_a_run_that_stops_before_its_manifest_shows_nothing(place, spark, monkeypatch):
    table, sources, _, put, full, got = place
    table.refresh(sources)
    before = got(table)
    put(session(2, 9))

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(spark, "createDataFrame", lambda rows, kind, f=spark.createDataFrame: stop() if "digest" in kind else f(rows, kind))
        with pytest.raises(RuntimeError):
            table.refresh(sources)
    left = got(table)  # the half-published session is not shown
    assert all(r in before for r in left) and not any(r[0] == 2 for r in left)
    assert table.refresh(sources).built == [(2024, 2)] and got(table) == full()


def test_reading_before_any_run_says_so(place):
    with pytest.raises(FileNotFoundError):
        place[0].read()
