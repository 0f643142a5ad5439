"""From raw tables to documents, on a few hand-made races."""

import json

import pytest
from pyspark.sql import functions as F

from lapwise import schemas
from lapwise.plans import features, history, planner, training
from lapwise.sources import dims, tables
from lapwise.sources.documents import json_lines, write_json
from lapwise.sources.staging import Staging


@pytest.fixture(scope="module")
def plan(spark, tmp_path_factory):
    rows = []
    for year in (2023, 2024):
        for rnd in range(1, 5):
            for i in range(240):
                compound = ["SOFT", "MEDIUM", "HARD"][i // 20 % 3]
                life = float(1 + i % 20)
                rows.append((
                    year, rnd, f"E{rnd}", ["VER", "HAM"][i % 2], ["RB", "Ferrari"][i % 2], float(i % 60),
                    1 + i // 60, compound, life, 100.0 + i,
                    round(90 + 0.05 * life + (i % 7) * 0.01, 3), True, "1",
                ))
    laps = spark.createDataFrame(rows, schemas.LAPS)
    weather = spark.createDataFrame(
        [(y, r, 0.0, 1, 25.0, 35.0, 50.0, False, 1.0, 1.0) for y in (2023, 2024) for r in range(1, 5)],
        schemas.WEATHER,
    )
    schedule = spark.createDataFrame(
        [(y, r, f"E{r}", f"{y}-0{r}-10") for y in (2022, 2023, 2024) for r in range(1, 5)], schemas.SCHEDULE
    )
    targets = spark.createDataFrame(
        [
            (1, 2024, "E4", "VER", "RB", 50, "auto", None),
            (2, 2024, "E4", "NEW", "Scuderia Ferrari", 50, "wet", 21.0),
            (3, 2022, "E2", "VER", "RB", 50, "auto", 21.0),
            (4, 2024, "Nowhere", "VER", "RB", 50, "auto", 21.0),
        ],
        schemas.TARGETS,
    )
    teams, tracks = dims.team_names(spark), dims.circuits(spark)
    staging = Staging(spark, str(tmp_path_factory.mktemp("staging") / "run"))
    counts = staging.table(history.lap_counts(laps, weather, teams), "counts")
    made = planner.plan_targets(counts, schedule, targets, teams, tracks, staging)
    return {"made": made, "staging": staging, "laps": laps, "weather": weather, "schedule": schedule,
            "teams": teams, "tracks": tracks}


def test_documents_hold_every_phase(spark, plan):
    documents = planner.plan_documents(plan["made"])
    rows = {r["target_id"]: r for r in json_lines(documents).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {1: "ok", 2: "ok", 3: "no_history", 4: "unresolved"}
    one = json.loads(rows[1]["json"])
    assert set(one) == {
        "target", "phase_1_history_rows", "phase_2_compound_models", "phase_2_wet_experience_km",
        "phase_3_best_strategies", "phase_3_overstay_delta",
    }
    assert one["target"]["team"] == "Racing Bulls" and one["target"]["race_condition"] == "dry"
    assert one["phase_1_history_rows"] == 4 * 240
    assert set(one["phase_2_compound_models"]) == {"SOFT", "MEDIUM", "HARD"}
    assert len(one["phase_3_best_strategies"]) == 5
    assert all(sum(p["stint_laps"]) == 50 for p in one["phase_3_best_strategies"])
    assert [r["extra_lap"] for r in one["phase_3_overstay_delta"]["SOFT"]] == list(range(1, 11))
    empty = json.loads(rows[3]["json"])
    assert empty["phase_2_compound_models"] == {} and empty["phase_3_best_strategies"] == []
    path = plan["staging"].path("json")
    write_json(documents, path)
    assert spark.read.json(path).count() == 4


def test_scope_and_condition_per_target(plan):
    rows = {r["target_id"]: r for r in plan["made"].profiles.collect()}
    assert [rows[i]["level"] for i in (1, 2, 3)] == ["driver", "team", None]
    assert rows[2]["condition"] == "wet" and rows[1]["pit_loss_sec"] == 21.0


def test_eras_train_save_and_report(spark, plan, tmp_path):
    measured = features.measured_laps(plan["laps"], plan["weather"], plan["teams"], plan["tracks"])
    rows = features.complete_laps(measured)
    eras = dims.eras(spark)
    statuses = features.event_status(measured, plan["schedule"], eras, "2024-03-31")
    coverage = features.era_coverage(statuses, eras)
    taken = features.era_features(rows, plan["schedule"], eras, "2024-03-31")
    runs = training.train_eras(
        spark, taken, coverage, "2024-03-31", str(tmp_path), [*training.NATURAL_KEY, "TyreLife"], iterations=2
    )
    found = {r["era"]: r for r in runs.collect()}
    now, later = found["ground_effect_2022_2025"], found["active_aero_2026_2030"]
    assert now["status"] == "trained" and now["rows"] == 7 * 240 and now["rmse"] > 0
    assert now["loaded_events"][0] == "2023:E1" and len(now["loaded_events"]) == 7
    assert now["failed_events"][0] == "2022:E1:no_laps" and len(now["failed_events"]) == 4
    assert later["status"] == "no_data" and later["model_path"] is None
    assert training.load_model(now["model_path"]).transform(rows).count() == 8 * 240


def test_one_hot_driver_with_a_third_of_all_laps_collapses(spark):
    rows = spark.range(30_000).select(
        F.lit(2024).alias("Year"), F.lit("E1").alias("EventName"), F.lit("VER").alias("Driver"),
        F.lit("T").alias("Team"), F.lit(1.0).alias("Stint"), F.lit("SOFT").alias("Compound"),
        (F.col("id") % 20 + 1.0).alias("TyreLife"), (90 + F.col("id") % 5).cast("double").alias("LapTimeSeconds"),
        F.lit(0).alias("IsWet"),
    )
    counts = history.count_laps(rows)
    assert counts.count() == 20 and counts.agg(F.sum("n")).collect()[0][0] == 30_000


def test_staging_needs_a_shared_folder_and_leaves_nothing(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert Staging(spark).folder.startswith(named.rstrip("/") + "/lapwise-")
    else:
        with pytest.raises(ValueError):
            Staging(spark)
    folder = tmp_path / "run"
    with Staging(spark, str(folder)) as staging:
        assert staging.table(spark.range(5), "five").count() == 5 and folder.exists()
    assert not folder.exists()


def scanned_files(df):
    """Files read by each Parquet scan of the executed plan."""
    df._jdf.queryExecution().toRdd().count()
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif kind == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


def test_history_and_features_read_only_the_sessions_they_need(spark, plan, tmp_path):
    for name in ("laps", "weather"):
        tables.write_sessions(plan[name], str(tmp_path / name))
    laps, weather = tables.read_laps(spark, str(tmp_path / "laps")), tables.read_weather(spark, str(tmp_path / "weather"))
    races = spark.createDataFrame([(2024, 2, "E2")], "target_year int, target_round int, target_event string")
    sessions = history.needed_sessions(races, plan["schedule"])
    wanted = {(2024, 1), *((2023, r) for r in range(1, 5))}
    assert {tuple(r) for r in sessions.collect()} == wanted
    pruned = history.lap_counts(laps, weather, plan["teams"], sessions)
    whole = history.lap_counts(laps, weather, plan["teams"])
    assert pruned.exceptAll(whole.where("Year < 2024 OR EventName = 'E1'")).count() == 0
    assert max(scanned_files(pruned)) == len(wanted) and max(scanned_files(whole)) == 8
    era = features.era_events(plan["schedule"], dims.eras(spark), "2023-02-28")
    of_era = features.lap_features(laps, weather, plan["teams"], plan["tracks"], sessions=era)
    assert max(scanned_files(of_era)) == 2
    assert of_era.count() == 2 * 240
