"""Level thresholds, categories and alarms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Lower bounds, inclusive, in percent."""

    # The bounds unless others are given.
    normal: float = 40.0
    high: float = 70.0
    critical: float = 80.0
    full: float = 100.0

    def __post_init__(self) -> None:
        if not 0 < self.normal < self.high < self.critical <= self.full:
            raise ValueError("thresholds must satisfy 0 < normal < high < critical <= full")


DEFAULT = Thresholds()
CATEGORIES = ("critical", "high", "normal", "low", "idle")
# Lower bounds of the utilisation score categories.
SCORE_BOUNDS = (("critical", 0.85), ("high", 0.65), ("normal", 0.35), ("low", 0.15))


def level_category(level: Column, t: Thresholds = DEFAULT) -> Column:
    return (
        F.when(level >= t.critical, "critical")
        .when(level >= t.high, "high")
        .when(level >= t.normal, "normal")
        .when(level > 0, "low")
        .otherwise("idle")
    )


def score_category(score: Column) -> Column:
    name, bound = SCORE_BOUNDS[0]
    chain = F.when(score >= bound, name)
    for name, bound in SCORE_BOUNDS[1:]:
        chain = chain.when(score >= bound, name)
    return chain.otherwise("idle")


# Limits and names of the alarms.
FULL_LEVEL, HOT, LOW_BATTERY, WEAK_SIGNAL = 95, 70, 15, -115
SENSOR_FAULTS = ("sensor_trabado", "sensor_ruidoso")


def alarm(level: Column, temperature: Column, battery: Column, rssi: Column, anomaly: Column) -> Column:
    """First matching alarm as struct<alarm_type, severity>, null when none applies."""

    def kind(name: Column | str, severity: str) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(name.alias("alarm_type"), F.lit(severity).alias("severity"))

    return (
        F.when(level >= FULL_LEVEL, kind("desborde", "critical"))
        .when(temperature >= HOT, kind("incendio", "critical"))
        .when(battery <= LOW_BATTERY, kind("bateria_baja", "warning"))
        .when(rssi <= WEAK_SIGNAL, kind("perdida_senal", "warning"))
        .when(anomaly.isin(*SENSOR_FAULTS), kind(anomaly, "warning"))
    )


def waste_factor(name: Column, factors: dict[str, float]) -> Column:
    """Demand factor by exact waste name, else by word, else one."""
    chain = None
    for key, value in factors.items():
        chain = F.when(name == key, F.lit(value)) if chain is None else chain.when(name == key, F.lit(value))
    lower = F.lower(name)
    # Word rules and the factor each one falls back to.
    rules = (("vidrio", "vidrio"), ("recicl|seca|verde", "reciclables"), ("humed|húmed", "residuos_humedos"))
    for words, key in rules:
        if key in factors:
            hit = F.regexp_like(lower, F.lit(words))
            chain = F.when(hit, F.lit(factors[key])) if chain is None else chain.when(hit, F.lit(factors[key]))
    return F.lit(1.0) if chain is None else chain.otherwise(F.lit(1.0))


def is_recyclable(waste_name: Column, type_name: Column) -> Column:
    both = F.concat_ws("\n", F.lower(waste_name), F.lower(type_name))
    return F.regexp_like(both, F.lit("seca|recicl|verde|vidrio"))
