"""Geometry on the sphere, windows of the declustering, and the equal-area grid."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.19


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance; the root is clamped to 1, as its arc sine would be NaN beyond."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.sqrt(F.greatest(a, F.lit(0.0))), F.lit(1.0)))


def flat_distance2(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Squared kilometres of a flat earth at the candidate's latitude, without a wrap at the date line."""
    return F.pow((lat - lat0) * KM_PER_DEGREE, 2) + F.pow((lon - lon0) * KM_PER_DEGREE * F.cos(F.radians(lat)), 2)


def window_km(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), 0.1238 * magnitude + 0.983)


def window_days(magnitude: Column) -> Column:
    return F.when(magnitude >= 6.5, F.pow(F.lit(10.0), 0.032 * magnitude + 2.7389)).otherwise(F.pow(F.lit(10.0), 0.5409 * magnitude - 0.547))


@dataclass(frozen=True)
class Grid:
    """Bands of equal height cut into cells of equal area, about target_km on a side."""

    target_km: float = 100.0
    bands: int = field(init=False)
    height: float = field(init=False)
    n_lon: tuple[int, ...] = field(init=False)

    def __post_init__(self) -> None:
        if not 0 < self.target_km < RADIUS_KM:
            raise ValueError("implausible cell size")
        bands = max(1, round(math.pi / (self.target_km / RADIUS_KM)))
        h = math.pi / bands
        edge = lambda i: math.sin(-math.pi / 2 + i * h)
        n = tuple(max(1, math.floor(2 * math.pi * (edge(i + 1) - edge(i)) / h**2 + 0.5)) for i in range(bands))
        for name, value in (("bands", bands), ("height", h), ("n_lon", n)):
            object.__setattr__(self, name, value)

    @property
    def cells(self) -> int:
        return sum(self.n_lon)

    def table(self, spark: SparkSession) -> DataFrame:
        """(band, n_lon, first): a few hundred rows, the bound being pi * RADIUS_KM / target_km."""
        first, rows = 0, []
        for band, n in enumerate(self.n_lon):
            rows.append((band, n, first))
            first += n
        return spark.createDataFrame(rows, "band int, n_lon int, first long")

    def cell_of(self, df: DataFrame, lat: str = "lat_deg", lon: str = "lon_deg") -> DataFrame:
        """Adds cell, cell_lat and cell_lon: latitude clamps at the poles, longitude wraps."""
        half = math.pi / 2
        band = F.least(F.greatest(F.floor((F.least(F.greatest(F.radians(lat), F.lit(-half)), F.lit(half)) + half) / self.height), F.lit(0)), F.lit(self.bands - 1)).cast("int")
        turn = F.col(lon) / 360
        turn = turn - F.when(turn < 0, F.ceil(turn)).otherwise(F.floor(turn))
        turn = F.when(turn < 0, turn + 1).otherwise(turn)
        joined = df.withColumn("__band", band).join(F.broadcast(self.table(df.sparkSession)), F.col("__band") == F.col("band"), "left")
        column = F.least(F.floor(turn * F.col("n_lon")), F.col("n_lon") - 1)
        centre = (column + 0.5) / F.col("n_lon") * 360
        return joined.withColumns({"cell": F.col("first") + column, "cell_lat": F.degrees(F.lit(-half) + (F.col("band") + 0.5) * self.height), "cell_lon": F.when(centre > 180, centre - 360).otherwise(centre)}).drop("__band", "band", "n_lon", "first")

    def area_km2(self, band: Column, n_lon: Column) -> Column:
        low = F.lit(-math.pi / 2) + band * self.height
        return 2 * math.pi * RADIUS_KM * RADIUS_KM * (F.sin(low + self.height) - F.sin(low)) / n_lon
