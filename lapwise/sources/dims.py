"""Fixed dimensions.

Each is a literal ``VALUES`` relation: Spark knows its size, so it picks a
broadcast join by its own size check and no hint is needed.
"""

from itertools import product

from pyspark.sql import DataFrame, SparkSession

# Compounds, in pool order.
DRY_COMPOUNDS = ["SOFT", "MEDIUM", "HARD"]
WET_COMPOUNDS = ["INTERMEDIATE", "WET"]
VALID_COMPOUNDS = DRY_COMPOUNDS + WET_COMPOUNDS
POOLS = {"dry": DRY_COMPOUNDS, "wet": WET_COMPOUNDS, "mixed": VALID_COMPOUNDS}

# What an unlisted circuit gets.
DEFAULT_TRACK_TYPE = "Medium"
DEFAULT_TRACK_KM = 5.0

# Model eras, first and last season.
ERAS = [
    ("ground_effect_2022_2025", 2022, 2025),
    ("active_aero_2026_2030", 2026, 2030),
]

# Team aliases and the name each stands for.
TEAM_ALIASES = {
    "Racing Bulls": [
        "Toro Rosso", "Scuderia Toro Rosso", "AlphaTauri", "Scuderia AlphaTauri",
        "AlphaTauri Honda", "RB", "RB F1 Team", "Visa Cash App RB",
        "Visa Cash App RB F1 Team", "Racing Bulls", "Racing Bulls F1 Team",
    ],
    "Red Bull Racing": [
        "Red Bull", "Red Bull Racing", "Red Bull Racing Honda", "Red Bull Racing Honda RBPT",
        "Oracle Red Bull Racing",
    ],
    "Mercedes": [
        "Mercedes", "Mercedes-AMG Petronas", "Mercedes-AMG PETRONAS F1 Team",
        "Mercedes-AMG Petronas Formula One Team",
    ],
    "Ferrari": [
        "Ferrari", "Scuderia Ferrari", "Scuderia Ferrari Mission Winnow", "Scuderia Ferrari HP",
    ],
    "McLaren": ["McLaren", "McLaren F1 Team", "McLaren Renault", "McLaren Mercedes"],
    "Williams": ["Williams", "Williams Racing", "Williams Mercedes"],
    "Haas": ["Haas", "Haas F1 Team", "Haas Ferrari", "MoneyGram Haas F1 Team"],
    "Aston Martin": [
        "Racing Point", "Racing Point BWT Mercedes", "Aston Martin", "Aston Martin F1 Team",
        "Aston Martin Aramco Cognizant Formula One Team", "Aston Martin Aramco F1 Team",
    ],
    "Alpine": ["Renault", "Renault F1 Team", "Alpine", "Alpine F1 Team", "BWT Alpine F1 Team"],
    "Audi": [
        "Alfa Romeo", "Alfa Romeo Racing", "Alfa Romeo Racing Ferrari", "Alfa Romeo F1 Team",
        "Sauber", "Sauber F1 Team", "Kick Sauber", "Stake F1 Team Kick Sauber", "Audi",
        "Audi F1 Team", "Audi Revolut F1 Team",
    ],
    "Cadillac": ["Cadillac", "Cadillac Racing", "Cadillac F1 Team"],
}

# Circuit, speed class, length in km.
CIRCUITS = [
    ("Bahrain International Circuit", "Medium", 5.412),
    ("Jeddah Corniche Circuit", "High", 6.174),
    ("Albert Park Grand Prix Circuit", "Medium", 5.278),
    ("Baku City Circuit", "Medium", 6.003),
    ("Miami International Autodrome", "Low", 5.412),
    ("Circuit de Monaco", "Low", 3.337),
    ("Circuit de Barcelona-Catalunya", "Medium", 4.657),
    ("Circuit Gilles Villeneuve", "Medium", 4.361),
    ("Red Bull Ring", "Medium", 4.318),
    ("Silverstone Circuit", "High", 5.891),
    ("Hungaroring", "Low", 4.381),
    ("Circuit de Spa-Francorchamps", "High", 7.004),
    ("Circuit Zandvoort", "Low", 4.259),
    ("Autodromo Nazionale Monza", "High", 5.793),
    ("Marina Bay Street Circuit", "Low", 4.940),
    ("Suzuka Circuit", "Medium", 5.807),
    ("Lusail International Circuit", "Medium", 5.419),
    ("Circuit of The Americas", "Medium", 5.513),
    ("Autódromo Hermanos Rodríguez", "Low", 4.304),
    ("Autódromo José Carlos Pace", "Medium", 4.309),
    ("Las Vegas Strip Circuit", "Medium", 6.201),
    ("Yas Marina Circuit", "Medium", 5.281),
    ("Autodromo Enzo e Dino Ferrari", "Medium", 4.909),
    ("Shanghai International Circuit", "Medium", 5.451),
    ("Autodromo Internazionale del Mugello", "High", 5.245),
]


def values_sql(rows) -> str:
    """Rows of a literal relation as SQL text; doubles keep their type."""

    def text(value):
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        if isinstance(value, float):
            return f"{value!r}D"
        if isinstance(value, (list, tuple)):
            return "array(" + ", ".join(text(v) for v in value) + ")"
        return str(value)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


def literal_table(spark: SparkSession, rows, columns) -> DataFrame:
    names = ", ".join(columns)
    return spark.sql(f"SELECT * FROM VALUES {values_sql(rows)} AS t({names})")


def team_names(spark: SparkSession) -> DataFrame:
    """alias -> team."""
    rows = [(alias, team) for team, aliases in TEAM_ALIASES.items() for alias in aliases]
    return literal_table(spark, rows, ["alias", "team"])


def circuits(spark: SparkSession) -> DataFrame:
    """name -> track_type, length_km, keyed by circuit name."""
    return literal_table(spark, CIRCUITS, ["name", "track_type", "length_km"])


def circuits_by_event(circuit_table: DataFrame, event_circuit: DataFrame) -> DataFrame:
    """Circuit table keyed by event name, for laps that carry the event and not the circuit.

    ``event_circuit`` has EventName and circuit.
    """
    return (
        event_circuit.join(circuit_table, event_circuit["circuit"] == circuit_table["name"])
        .select(event_circuit["EventName"].alias("name"), "track_type", "length_km")
    )


def eras(spark: SparkSession, only: str | None = None) -> DataFrame:
    """era, start_year, end_year; ``only`` picks the era whose name starts so."""
    rows = [era for era in ERAS if only is None or era[0].startswith(only)]
    if not rows:
        raise ValueError(f"no era starts with {only!r}")
    return literal_table(spark, rows, ["era", "start_year", "end_year"])


def stint_sequences(spark: SparkSession, max_stops: int = 2) -> DataFrame:
    """condition, seq_no, stints, compounds: every admissible order of compounds.

    A rule, not data: 2 to ``max_stops`` + 1 stints from the condition's pool, and in the dry at
    least two different compounds.  ``seq_no`` is the order in which plans are generated, which
    decides ties.
    """
    rows = []
    for condition, pool in POOLS.items():
        orders = [seq for stints in range(2, max_stops + 2) for seq in product(pool, repeat=stints)]
        if condition == "dry":
            orders = [seq for seq in orders if len(set(seq)) >= 2]
        rows += [(condition, number, len(seq), list(seq)) for number, seq in enumerate(orders)]
    return literal_table(spark, rows, ["condition", "seq_no", "stints", "compounds"])
