"""Planning defaults. Fixed values that results depend on; override by passing another ``Config``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

PEAK_LOAD_HOUSEHOLD = 17.425

#: Consumer categories (id, definition, peak load kW, W per m2, simultaneity factor).
CONSUMER_CATEGORIES = (
    (1, "Commercial", None, 79.0, 0.5),
    (2, "Public", None, 29.0, 0.6),
    (3, "SFH", PEAK_LOAD_HOUSEHOLD, None, 0.07),
    (4, "MFH", PEAK_LOAD_HOUSEHOLD, None, 0.07),
    (5, "TH", PEAK_LOAD_HOUSEHOLD, None, 0.07),
    (6, "AB", PEAK_LOAD_HOUSEHOLD, None, 0.07),
)
#: Simultaneity factor of each main category.
SIM_FACTOR = {"Residential": 0.07, "Public": 0.6, "Commercial": 0.5}
RESIDENTIAL = ("SFH", "MFH", "AB", "TH")
#: Cables (name, max A, r, x, z in mOhm/km, cost, use).
CABLES = (
    ("NAYY_4_120", 242, 225, 80, 239, 19, "feeder"),
    ("NAYY_4_150", 270, 208, 80, 223, 24, "feeder"),
    ("NAYY_4_185", 313, 164, 80, 181, 33, "feeder"),
    ("NYY_4_35", 159, 524, 85, 531, 16, "consumer"),
    ("NAYY_4_50", 142, 642, 83, 647, 11, "consumer"),
    ("NYY_4_70", 232, 268, 82, 280, 28, "consumer"),
)
#: Transformers (name, kVA, cost).
TRANSFORMERS = (("Tr_250", 250, 5000), ("Tr_400", 400, 8000), ("Tr_630", 630, 12000), ("Tr_800", 800, 16000))
#: Street class of each street type; others are 99.
WAY_CLASSES = {
    "Bundesautobahn": 11,
    "Bundesstraße": 13,
    "Landesstraße, Staatsstraße": 15,
    "Kreisstraße": 21,
    "Gemeindestraße": 41,
    "Nicht öffentliche Straße": 51,
    "Wirtschaftsweg": 71,
    "Hauptwirtschaftsweg": 71,
    "Rad- und Fußweg": 72,
    "Radweg": 81,
    "Fußweg": 91,
    "connection_line": 110,
}
#: Federal states by the number that the registers use.
FEDERAL_STATES = {
    1: "Schleswig-Hohlstein",
    2: "Hamburg",
    3: "Niedersachsen",
    4: "Bremen",
    5: "Nordrhein-Westfalen",
    6: "Hessen",
    7: "Rheinland-Pfalz",
    8: "Baden-Württemberg",
    9: "Bayern",
    10: "Saarland",
    11: "Berlin",
    12: "Brandenburg",
    13: "Mecklenburg-Vorpommern",
    14: "Sachsen",
    15: "Sachsen-Anhalt",
    16: "Thüringen",
}
#: Five-class region of each seven-class region.
REGIO5_OF_REGIO7 = {71: 51, 72: 52, 73: 53, 75: 53, 76: 54, 74: 55, 77: 55}


@dataclass(frozen=True)
class Config:
    version_id: str = "1"
    peak_load_household: float = PEAK_LOAD_HOUSEHOLD
    power_factor: float = 0.95
    nominal_v: float = 400.0
    band_low: float = 0.9
    band_high: float = 1.1
    min_shared_prefix_m: float = 50.0
    small_load_kw: float = 100.0
    drop_small_percent: float = 5.0
    drop_large_percent: float = 10.0
    drop_feeder_percent: float = 4.0
    rural_max_households: float = 1.3
    urban_min_households: float = 3.2
    rural_min_distance: float = 55.0
    urban_max_distance: float = 20.0
    capacities: dict[int, tuple[int, ...]] = field(default_factory=lambda: {1: (250, 400, 630), 2: (400, 630), 3: (400, 630, 800)})
    brownfield_reach_m: float = 750.0
    greenfield_reach_m: float = 900.0
    large_component: int = 5000
    component_divider: int = 2500
    seed: int = 3329829316

    @property
    def cable_limit_ka(self) -> float:
        """Current of the strongest feeder cable."""
        return max(c[1] for c in CABLES if c[6] == "feeder") / 1000


DEFAULT = Config()


def load(path: str, base: Config = DEFAULT) -> Config:
    """``base`` with the values of a YAML mapping (S18); names that stand for other values (PEAK_LOAD_HOUSEHOLD) are resolved, unknown keys ignored."""
    import dataclasses

    import yaml

    with open(path) as f:
        given = {str(k).lower(): v for k, v in (yaml.safe_load(f) or {}).items()}
    given = {k: given.get(str(v).lower(), v) if isinstance(v, str) else v for k, v in given.items()}
    names = {x.name: type(getattr(base, x.name)) for x in dataclasses.fields(base)}
    return dataclasses.replace(base, **{k: names[k](v) for k, v in given.items() if k in names and v is not None})


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSUMER_CATEGORIES, "consumer_category_id int, definition string, peak_load double, peak_load_per_m2 double, sim_factor double")


def cables(spark: SparkSession) -> DataFrame:
    """name, max_i_ka, r_ohm_per_km, x_ohm_per_km, z (from r and x), q_mm2 (from the name), use."""
    rows = [(n, i / 1000, r / 1000, x / 1000, ((r / 1000) ** 2 + (x / 1000) ** 2) ** 0.5, float(n.split("_")[-1]), use) for n, i, r, x, _, _, use in CABLES]
    return spark.createDataFrame(rows, "name string, max_i_ka double, r_ohm_per_km double, x_ohm_per_km double, z_ohm_per_km double, q_mm2 double, use string")


def capacities(spark: SparkSession, config: Config = DEFAULT) -> DataFrame:
    """settlement_type, kva: allowed transformer sizes."""
    return spark.createDataFrame([(s, k) for s, sizes in config.capacities.items() for k in sizes], "settlement_type int, kva int")
