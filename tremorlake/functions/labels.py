"""Labels of events, angles and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap180(degrees: Column) -> Column:
    """An angle in (-180, 180]."""
    x = F.pmod(degrees, F.lit(360.0))
    return F.when(x > 180, x - 360).otherwise(x)


def mechanism(rake: Column) -> Column:
    """Within 45 degrees (strictly) of +90: thrust; of -90: normal; else strike-slip."""
    near = lambda centre: F.abs(wrap180(rake - centre)) < 45
    return F.when(near(90), "thrust").when(near(-90), "normal").otherwise("strike-slip")


def depth_class(depth_km: Column, edge: float = 70.0, inclusive: bool = False) -> Column:
    """shallow under the edge (or at it, if inclusive), else deep; null depth gives null."""
    shallow = depth_km <= edge if inclusive else depth_km < edge
    return F.when(depth_km.isNotNull(), F.when(shallow, "shallow").otherwise("deep"))


def beat_period(a: Column, b: Column) -> Column:
    return 1 / F.abs(1 / a - 1 / b)


def near_resonant(offset: Column, periods: tuple[float, ...] = (27.555, 29.531), within: float = 2.0) -> Column:
    """Whether an offset in days is within so many days of a multiple of one of the periods."""
    out = F.lit(False)
    for p in periods:
        out = out | (F.abs(F.round(offset / p) * p - offset) < within)
    return out
