from itertools import product

import pytest

from lapwise.plans import strategy
from lapwise.sources import dims

MODEL = "target_id long, Compound string, window_laps double, fresh_lap_time_sec double, slope_sec_per_km double"
PROFILE = "target_id long, condition string, race_laps int, track_length_km double, pit_loss_sec double"
DRY = [(1, "SOFT", 14.0, 90.0, 0.02), (1, "MEDIUM", 22.0, 90.6, 0.012), (1, "HARD", 30.0, 91.1, 0.008)]


def search(spark, models, condition="dry", laps=57, max_stops=2):
    found = strategy.candidate_plans(
        spark.createDataFrame(models, MODEL),
        spark.createDataFrame([(1, condition, laps, 5.0, 21.0)], PROFILE),
        dims.stint_sequences(spark, max_stops),
        max_stops,
    )
    return strategy.score_plans(found, max_stops)


def best_columns(rows):
    return [(r["compounds"], r["stint_laps"], r["stops"], r["predicted_total_time_sec"], r["rank"]) for r in rows]


def fastest(spark, models, condition="dry", laps=57, max_stops=2, top_k=5):
    found = strategy.fastest_plans(
        spark.createDataFrame(models, MODEL), spark.createDataFrame([(1, condition, laps, 5.0, 21.0)], PROFILE), max_stops, top_k
    )
    return best_columns(found.orderBy("rank").collect())


def restated(models, condition, laps, max_stops=2):
    """Every plan, lap by lap, in generation order."""
    known = {m[1]: m for m in models}
    pool = [c for c in dims.POOLS[condition] if c in known]
    plans = []
    for stints in range(2, max_stops + 2):
        for seq in product(pool, repeat=stints):
            if condition == "dry" and len(set(seq)) < 2:
                continue
            spans = [range(max(5, round(known[c][2]) - 6), max(5, round(known[c][2]) + 6) + 1) for c in seq]
            for head in product(*[span[::2] for span in spans[:-1]]):
                rest = laps - sum(head)
                if rest in spans[-1]:
                    lengths = [*head, rest]
                    time = 21.0 * (stints - 1)
                    for c, n in zip(seq, lengths):
                        time += sum(known[c][3] + known[c][4] * 5.0 * i for i in range(n))
                    plans.append((list(seq), lengths, round(time, 3)))
    return plans


def test_known_dry_race(spark):
    scored = search(spark, DRY)
    assert scored.count() == 365
    best = strategy.best_plans(scored).orderBy("rank").collect()
    assert [(r["compounds"], r["stint_laps"]) for r in best[:3]] == [
        (["SOFT", "SOFT", "MEDIUM"], [18, 18, 21]),
        (["SOFT", "MEDIUM", "SOFT"], [18, 20, 19]),
        (["MEDIUM", "SOFT", "SOFT"], [20, 18, 19]),
    ]
    assert {r["predicted_total_time_sec"] for r in best[:3]} == {5227.8}


@pytest.mark.parametrize("condition,models,laps,stops", [
    ("dry", DRY, 57, 2),
    ("dry", DRY, 57, 1),
    ("dry", DRY[:2], 70, 3),
    ("wet", [(1, "INTERMEDIATE", 13.0, 100.0, 0.03), (1, "WET", 24.0, 104.0, 0.01)], 40, 2),
    ("mixed", [*DRY[:2], (1, "WET", 2.0, 104.0, 0.01)], 44, 2),
])
def test_agrees_with_enumeration(spark, condition, models, laps, stops):
    scored = search(spark, models, condition, laps, stops)
    wanted = restated(models, condition, laps, stops)
    found = [(r["compounds"], r["stint_laps"], r["predicted_total_time_sec"]) for r in scored.collect()]
    assert sorted((c, l) for c, l, _ in found) == sorted((c, l) for c, l, _ in wanted)
    times = {(tuple(c), tuple(l)): t for c, l, t in wanted}
    assert all(abs(times[tuple(c), tuple(l)] - t) <= 0.001 for c, l, t in found)
    best = strategy.best_plans(scored).orderBy("rank").collect()
    assert fastest(spark, models, condition, laps, stops) == [tuple(r) for r in best_columns(best)]
    ranked = sorted(wanted, key=lambda p: p[2])[:5]
    assert [r["predicted_total_time_sec"] for r in best] == pytest.approx([p[2] for p in ranked], abs=0.001)


def test_plans_fill_the_race(spark):
    for row in search(spark, DRY).collect():
        assert sum(row["stint_laps"]) == 57 and len(set(row["compounds"])) >= 2


def test_one_dry_compound_gives_no_plan_but_one_wet_does(spark):
    assert search(spark, DRY[:1]).count() == 0
    assert search(spark, [(1, "WET", 24.0, 104.0, 0.01)], "wet", 45).count() > 0


def test_sequences_are_the_admissible_orders(spark):
    counts = {r["condition"]: r["count"] for r in dims.stint_sequences(spark).groupBy("condition").count().collect()}
    assert counts == {"dry": 30, "wet": 12, "mixed": 150}


@pytest.mark.parametrize("top_k", [1, 5, 40])
def test_search_keeps_the_order_of_equal_plans(spark, top_k):
    """Alike compounds, some a fraction of a millisecond apart: nearly all plans are ties."""
    models = [(1, c, w, 90.0 + d, 0.01) for c, w, d in (("SOFT", 12.0, 0.0), ("MEDIUM", 12.0, 0.00001), ("HARD", 14.0, 0.0))]
    scored = search(spark, models, "dry", 38)
    best = strategy.best_plans(scored, top_k).orderBy("rank").collect()
    assert len(best) == top_k and fastest(spark, models, "dry", 38, 2, top_k) == best_columns(best)


def test_six_stops_without_listing_sequences(spark, monkeypatch):
    """5^7 orders of compounds: the search never lists them, and agrees with a plain search over its short stints."""
    monkeypatch.setattr(dims, "stint_sequences", None)
    models = [(1, c, 8.0, 90.0 + k / 8, 0.02 + k / 50) for k, c in enumerate(dims.POOLS["mixed"])]
    found = fastest(spark, models, "mixed", 57, 6)
    assert [r[4] for r in found] == [1, 2, 3, 4, 5]
    known = {m[1]: m for m in models}

    def time(compound, n):
        return n * known[compound][3] + known[compound][4] * 5.0 * n * (n - 1) / 2

    best = {0: [(0.0, 0, [], [])]}  # laps used -> plans, all of one length at a time
    ended = []
    for stint in range(7):
        grown = {}
        for used, plans in best.items():
            for total, _, seq, lens in plans:
                for code, c in enumerate(dims.POOLS["mixed"]):
                    for n in range(5, 15, 2):
                        if used + n < 57 and stint < 6:
                            grown.setdefault(used + n, []).append((total + time(c, n), stint + 1, [*seq, code], [*lens, n]))
                    if 5 <= 57 - used <= 14 and stint:
                        n = 57 - used
                        ended.append((round(total + time(c, n) + 21.0 * stint, 3), stint + 1, [*seq, code], [*lens, n]))
        best = {used: sorted(plans)[:60] for used, plans in grown.items()}
    assert [r[3] for r in found] == pytest.approx([p[0] for p in sorted(ended)[:5]], abs=0.001)
    assert all(sum(r[1]) == 57 for r in found)


def test_search_without_targets_or_finish(spark):
    assert fastest(spark, DRY[:1]) == [] == fastest(spark, DRY, laps=400)
    none = spark.createDataFrame([], MODEL)
    assert strategy.fastest_plans(none, spark.createDataFrame([], PROFILE)).count() == 0
