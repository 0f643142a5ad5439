"""Pit-stop strategy search over all targets at once.

``fastest_plans`` is the search that planning uses: k-best dynamic programming, whose work grows with the number of
stops.  ``candidate_plans``, ``score_plans`` and ``best_plans`` list, time and rank every plan, whose number
grows with a power of it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwise.functions.expressions import round_half_even
from lapwise.sources.dims import POOLS

# Fixed values of the search.
SHORTEST_STINT = 5
WINDOW_MARGIN = 6
LENGTH_STEP = 2
TOP_K = 5
MAX_STOPS = 2


def _stint_choices(compounds, models):
    """Per stint of a sequence: shortest and longest length, fresh lap and seconds lost per lap."""

    def choice(compound):
        model = models[compound]
        laps = F.rint(model["window_laps"]).cast("int")
        low = F.greatest(F.lit(SHORTEST_STINT), laps - WINDOW_MARGIN)
        return F.struct(
            low.alias("low"),
            F.greatest(low, laps + WINDOW_MARGIN).alias("high"),
            model["fresh_lap_time_sec"].alias("fresh"),
            (model["slope_sec_per_km"] * F.col("track_length_km")).alias("wear"),
        )

    return F.transform(compounds, choice)


def candidate_plans(
    models: DataFrame, profiles: DataFrame, sequences: DataFrame, max_stops: int = MAX_STOPS
) -> DataFrame:
    """target, seq_no, compounds, stint lengths: every plan within the compounds' windows.

    A target's models (five at most) travel as one map, and the admissible compound orders come
    from a fixed table, ``sources.dims.stint_sequences`` with the same ``max_stops``, so nothing is
    joined with itself.  All stints but the last step through their range; the last takes the
    remaining laps if its own range allows.
    """
    by_compound = F.map_from_entries(
        F.collect_list(
            F.struct("Compound", F.struct("window_laps", "fresh_lap_time_sec", "slope_sec_per_km"))
        )
    )
    # One target yields thousands of plans, so partitions are counted in targets and not in bytes:
    # a fixed number keeps adaptive execution from packing many small targets into few tasks.  The
    # grouping, the generator and the ranking all use this one shuffle.
    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_target = (
        models.repartition(tasks, "target_id").groupBy("target_id").agg(by_compound.alias("_models"))
    )
    plans = (
        per_target.join(
            profiles.select("target_id", "condition", "race_laps", "track_length_km", "pit_loss_sec"),
            "target_id",
        )
        .join(sequences, "condition")
        .where(F.forall("compounds", lambda c: F.map_contains_key("_models", c)))
        .withColumn("stint_models", _stint_choices(F.col("compounds"), F.col("_models")))
        .withColumn("_left", F.col("race_laps"))
    )
    taken = []
    for place in range(max_stops):
        stint = F.get("stint_models", F.lit(place))
        lengths = F.sequence(stint["low"], stint["high"], F.lit(LENGTH_STEP))
        # A sequence with fewer stints takes no laps here.
        chosen = F.when(F.col("stints") > place + 1, lengths).otherwise(F.array(F.lit(0)))
        plans = (
            plans.select("*", F.explode(chosen).alias(f"_laps{place}"))
            .withColumn("_left", F.col("_left") - F.col(f"_laps{place}"))
            .where(F.col("_left") > 0)
        )
        taken.append(f"_laps{place}")
    last = F.element_at("stint_models", -1)
    before_last = F.slice(F.array(*taken), F.lit(1), F.col("stints") - 1)
    return plans.where(F.col("_left").between(last["low"], last["high"])).select(
        "target_id", "seq_no", "stints", "compounds",
        F.concat(before_last, F.array("_left")).alias("stint_laps"),
        "pit_loss_sec", "stint_models",
    )


def score_plans(candidates: DataFrame, max_stops: int = MAX_STOPS) -> DataFrame:
    """Adds the predicted race time, rounded to milliseconds.

    Each stint is n fresh laps plus wear x (0 + 1 + ... + n-1), in closed form.
    """
    driving = F.lit(0.0)
    for place in range(max_stops + 1):
        model, laps = F.get("stint_models", F.lit(place)), F.get("stint_laps", F.lit(place))
        time = laps * model["fresh"] + model["wear"] * (laps * (laps - 1)) / F.lit(2.0)
        driving = driving + F.coalesce(time, F.lit(0.0))
    stops = F.col("stints") - 1
    return candidates.select(
        "target_id", "seq_no", "compounds", "stint_laps", stops.alias("stops"),
        round_half_even(driving + F.col("pit_loss_sec") * stops, 3).alias("predicted_total_time_sec"),
    )


def best_plans(scored: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The ``top_k`` fastest plans per target; ties keep the order in which plans are generated.

    Targets are already together, so ranking adds no shuffle, and a target has a bounded number of
    plans.
    """
    order = Window.partitionBy("target_id").orderBy("predicted_total_time_sec", "seq_no", "stint_laps")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .drop("seq_no")
    )


# What the compounds of a plan's stints so far allow: the code of the only one, or one of these.
NO_STINT, SEVERAL, FINISHED = -1, -2, -3
#: Plans whose times differ by more cannot round to the same millisecond.
TIE_WINDOW = 0.0011


def _stint_time(choice: Column, laps: Column) -> Column:
    return laps * choice["fresh"] + choice["wear"] * (laps * (laps - 1)) / F.lit(2.0)


def _next_stints(goes_on: bool, may_finish: bool) -> Column:
    """code, laps, seconds and whether the race ends, for every stint that can follow a state.

    Stints before the last step through their range; the last one takes the laps that are left.  A dry race needs
    two compounds.  A finished plan stays as it is.
    """
    left = F.col("race_laps") - F.col("used")

    def stint(choice: Column, laps: Column, ends: bool) -> Column:
        seconds = _stint_time(choice, laps)
        return F.struct(choice["code"].alias("code"), laps.alias("laps"), seconds.alias("seconds"), F.lit(ends).alias("ends"))

    def on(choice: Column) -> Column:
        lengths = F.filter(F.sequence(choice["low"], choice["high"], F.lit(LENGTH_STEP)), lambda n: n < left)
        return F.transform(lengths, lambda n: stint(choice, n, False))

    def off(choice: Column) -> Column:
        mixed = (F.col("kind") == SEVERAL) | (F.col("kind") != choice["code"])
        fits = left.between(choice["low"], choice["high"]) & (~F.col("dry") | mixed)
        return F.filter(F.array(stint(choice, left, True)), lambda _: fits)

    def both(choice: Column) -> Column:
        return F.concat(*[f(choice) for f, wanted in ((on, goes_on), (off, may_finish)) if wanted])

    none = F.struct(
        F.lit(None).cast("int").alias("code"), F.lit(0).alias("laps"), F.lit(0.0).alias("seconds"), F.lit(True).alias("ends")
    )
    return F.when(F.col("kind") == FINISHED, F.array(none)).otherwise(F.flatten(F.transform("choices", both)))


def _kept(states: DataFrame, top_k: int) -> DataFrame:
    """``states`` with those of their plans that may end up among the ``top_k``, in order.

    A plan is out if ``top_k`` others with the same rest of the race come first whatever that is: they are no slower
    and generated earlier, or faster by more than rounding can undo.  Each step is a column of its own, so that
    none is computed twice.
    """
    finished, many = F.col("kind") == FINISHED, F.size("plans") > top_k

    def generated(p: Column) -> Column:
        return F.struct(p["codes"], p["laps"])

    def add(kept: Column, p: Column) -> Column:
        earlier = F.filter(kept, lambda q: generated(q) < generated(p))
        return F.when(F.size(earlier) < top_k, F.array_append(kept, p)).otherwise(kept)

    return (
        states.withColumn("plans", F.array_sort("plans"))
        .withColumn("limit", F.get("plans", F.lit(top_k - 1))["time"] + TIE_WINDOW)
        .withColumn("plans", F.when(many & finished, F.slice("plans", 1, top_k)).when(
            many, F.filter("plans", lambda p: p["time"] <= F.col("limit"))
        ).otherwise(F.col("plans")))
        .withColumn("plans", F.when(many, F.aggregate("plans", F.slice("plans", 1, 0), add)).otherwise(F.col("plans")))
        .drop("limit")
    )


def _choices(models: DataFrame, profiles: DataFrame) -> DataFrame:
    """Targets with the compounds they may use, in the order of the condition's pool."""
    pools = F.create_map(*[x for name, pool in POOLS.items() for x in (F.lit(name), F.array(*map(F.lit, pool)))])
    profile = profiles.select("target_id", "condition", "race_laps", "track_length_km", "pit_loss_sec")
    laps = F.rint("window_laps").cast("int")
    low = F.greatest(F.lit(SHORTEST_STINT), laps - WINDOW_MARGIN)
    pool = F.try_element_at(pools, F.col("condition"))
    choice = F.struct(
        (F.array_position(pool, F.col("Compound")) - 1).cast("int").alias("code"), F.col("Compound").alias("compound"), low.alias("low"),
        F.greatest(low, laps + WINDOW_MARGIN).alias("high"), F.col("fresh_lap_time_sec").alias("fresh"),
        (F.col("slope_sec_per_km") * F.col("track_length_km")).alias("wear"),
    )
    # Partitions are counted in targets and not in bytes, as above; all that follows is within a target, so
    # this is the only shuffle of the search.
    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        models.join(profile, "target_id").where(F.array_contains(pool, F.col("Compound")))
        .repartition(tasks, "target_id")
        .groupBy("target_id").agg(
            F.any_value("race_laps").alias("race_laps"), F.any_value("pit_loss_sec").alias("pit_loss_sec"),
            F.any_value(F.col("condition") == "dry").alias("dry"), F.array_sort(F.collect_list(choice)).alias("choices"),
        )
    )


def fastest_plans(
    models: DataFrame, profiles: DataFrame, max_stops: int = MAX_STOPS, top_k: int = TOP_K
) -> DataFrame:
    """The ``top_k`` fastest plans per target with 1 to ``max_stops`` stops, as ``best_plans`` ranks them.

    A state is a target, the laps used so far and what the compounds used so far allow; it keeps its best plans, not
    all.  Each round adds a stint to every state and merges what arrives at the same one.  A target has at most
    laps x 7 states, whatever the number of stops.
    """
    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(0.0).alias("time"), F.lit(0).alias("stints"), empty.alias("codes"), empty.alias("laps"))
    states = _choices(models, profiles).select(
        "*", F.lit(0).alias("used"), F.lit(NO_STINT).alias("kind"), F.array(start).alias("plans")
    )
    fixed = ["race_laps", "pit_loss_sec", "dry", "choices"]
    for stint in range(max_stops + 1):
        stepped = states.select("*", F.explode(_next_stints(stint < max_stops, stint > 0)).alias("next"))
        code, ends = F.col("next.code"), F.col("next.ends")

        def longer(p: Column) -> Column:
            time = p["time"] + F.col("next.seconds")
            total = round_half_even(time + F.col("pit_loss_sec") * p["stints"], 3)
            return F.when(code.isNull(), p).otherwise(F.struct(
                F.when(ends, total).otherwise(time).alias("time"), (p["stints"] + 1).alias("stints"),
                F.array_append(p["codes"], code).alias("codes"), F.array_append(p["laps"], F.col("next.laps")).alias("laps"),
            ))

        kind = F.when(ends, FINISHED).when(F.col("kind").isin(NO_STINT) | (F.col("kind") == code), code).otherwise(SEVERAL)
        stepped = stepped.select(
            "target_id", *fixed, (F.col("used") + F.col("next.laps")).alias("used"), kind.alias("kind"),
            F.transform("plans", longer).alias("plans"),
        )
        merged = stepped.groupBy("target_id", "used", "kind").agg(
            *[F.any_value(c).alias(c) for c in fixed], F.flatten(F.collect_list("plans")).alias("plans")
        )
        states = _kept(merged, top_k)
    named = F.transform(F.col("plan.codes"), lambda c: F.element_at(F.filter("choices", lambda x: x["code"] == c), 1)["compound"])
    return states.where(F.col("kind") == FINISHED).select("target_id", "choices", F.posexplode("plans").alias("place", "plan")).select(
        "target_id", named.alias("compounds"), F.col("plan.laps").alias("stint_laps"), (F.col("plan.stints") - 1).alias("stops"),
        F.col("plan.time").alias("predicted_total_time_sec"), (F.col("place") + 1).alias("rank"),
    )
