"""Tidal constituents: phases as integer combinations of six mean astronomical arguments, linear in time."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Degrees at 2000-01-01T12:00 and degrees a day of the Moon's and the Sun's mean longitude, the lunar perigee,
# minus the lunar node, and the solar perigee (Meeus, Astronomical Algorithms).
MOON, SUN, PERIGEE, NODE, SOLAR_PERIGEE = (218.3164477, 13.17639648), (280.4664567, 0.98564736), (83.3532465, 0.11140353), (-125.0445479, 0.05295377), (282.9373480, 0.00004707)
# Doodson multipliers of lunar time and of the five arguments above.
DOODSON = {
    "Ssa": (0, 0, 2, 0, 0, 0),
    "Sa": (0, 0, 1, 0, 0, 0),
    "Mm": (0, 1, 0, -1, 0, 0),
    "Msf": (0, 2, -2, 0, 0, 0),
    "Mf": (0, 2, 0, 0, 0, 0),
    "Q1": (1, -2, 0, 1, 0, 0),
    "O1": (1, -1, 0, 0, 0, 0),
    "P1": (1, 1, -2, 0, 0, 0),
    "S1": (1, 1, -1, 0, 0, 0),
    "K1": (1, 1, 0, 0, 0, 0),
    "N2": (2, -1, 0, 1, 0, 0),
    "M2": (2, 0, 0, 0, 0, 0),
    "S2": (2, 2, -2, 0, 0, 0),
    "K2": (2, 2, 0, 0, 0, 0),
}


@dataclass(frozen=True)
class Constituent:
    """Phase in degrees at day d and longitude: start + rate * d + species * longitude."""

    name: str
    species: int
    start: float
    rate: float

    @property
    def period_days(self) -> float:
        return 360 / self.rate


def constituent(name: str) -> Constituent:
    noon = [a - 0.5 * r for a, r in (MOON, SUN, PERIGEE, NODE, SOLAR_PERIGEE)]
    rates = [r for _, r in (MOON, SUN, PERIGEE, NODE, SOLAR_PERIGEE)]
    lunar_time = (noon[1] - noon[0], 360 + rates[1] - rates[0])
    n = DOODSON[name]
    start = n[0] * lunar_time[0] + sum(k * a for k, a in zip(n[1:], noon, strict=True))
    return Constituent(name, n[0], math.fmod(start, 360), n[0] * lunar_time[1] + sum(k * r for k, r in zip(n[1:], rates, strict=True)))


def table(spark: SparkSession, names: list[str]) -> DataFrame:
    """(band, species, start, rate, period): a row a constituent, 14 at most."""
    rows = [(c.name, c.species, c.start, c.rate, c.period_days) for c in map(constituent, names)]
    return spark.createDataFrame(rows, "band string, species int, start double, rate double, period double")


def values_sql(names: list[str]) -> str:
    """The same as a SQL VALUES list, doubles written in full."""
    return ", ".join(f"('{c.name}', {c.species}, {c.start!r}::DOUBLE, {c.rate!r}::DOUBLE, {c.period_days!r}::DOUBLE)" for c in map(constituent, names))


def phase(day: Column, longitude: Column | None = None) -> Column:
    """Radians, of the columns start, rate and species."""
    degrees = F.col("start") + F.col("rate") * day
    return F.radians(degrees if longitude is None else degrees + F.col("species") * longitude)
