"""Chart features of a moment: aspects between bodies, declinations, motion, resonances, lunar and eclipse arguments.

Geocentric places come from mean Keplerian elements (a few arc minutes for the inner planets) and the short lunar series.
They are made in Arrow batches with numpy, one pass without a shuffle: as column expressions the chain of some hundred
derived columns grows beyond what the optimizer can hold. Features are one float array a row, with names in the same order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.physics import OBLIQUITY

# Elements at J2000 and their rates a century, for 1800 to 2050 (E. M. Standish): semi-major axis, eccentricity,
# inclination, mean longitude, longitude of perihelion, longitude of the node.
ELEMENTS = {
    "mercury": ((0.38709927, 0.20563593, 7.00497902, 252.25032350, 77.45779628, 48.33076593), (0.00000037, 0.00001906, -0.00594749, 149472.67411175, 0.16047689, -0.12534081)),
    "venus": ((0.72333566, 0.00677672, 3.39467605, 181.97909950, 131.60246718, 76.67984255), (0.00000390, -0.00004107, -0.00078890, 58517.81538729, 0.00268329, -0.27769418)),
    "earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "mars": ((1.52371034, 0.09339410, 1.84969142, -4.55343205, -23.94362959, 49.55953891), (0.00001847, 0.00007882, -0.00813131, 19140.30268499, 0.44441088, -0.29257343)),
    "jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "uranus": ((19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-0.00196176, -0.00004397, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "neptune": ((30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (0.00026291, 0.00005105, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
    "pluto": ((39.48211675, 0.24882730, 17.14001206, 238.92903833, 224.06891629, 110.30393684), (-0.00031596, 0.00005170, 0.00004818, 145.20780515, -0.04062942, -0.01183482)),
}
BODIES = ("sun", "moon", "mercury", "venus", "mars", "jupiter", "saturn", "uranus", "neptune", "pluto")
PAIRS = tuple(combinations(range(len(BODIES)), 2))
RATIOS = tuple((a, b, p, q) for a, b in combinations(range(2, len(BODIES)), 2) for p, q in ((1, 2), (2, 3), (2, 5), (3, 5)))


def _heliocentric(name: str, century: np.ndarray) -> np.ndarray:
    a, e, i, mean, peri, node = (x + r * century for x, r in zip(*ELEMENTS[name], strict=True))
    m, w, n, i = np.radians(np.mod(mean - peri, 360)), np.radians(peri - node), np.radians(node), np.radians(i)
    big = m + e * np.sin(m)
    for _ in range(5):  # Newton's steps on Kepler's equation
        big = big - (big - e * np.sin(big) - m) / (1 - e * np.cos(big))
    x, y = a * (np.cos(big) - e), a * np.sqrt(1 - e * e) * np.sin(big)
    u, v = x * np.cos(w) - y * np.sin(w), x * np.sin(w) + y * np.cos(w)
    return np.stack((u * np.cos(n) - v * np.sin(n) * np.cos(i), u * np.sin(n) + v * np.cos(n) * np.cos(i), v * np.sin(i)))


def places(day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ecliptic longitudes and latitudes (radians) of the ten bodies, body by row; day since 2000-01-01T00:00."""
    d = np.asarray(day, float) - 0.5
    earth = _heliocentric("earth", d / 36525)
    lon, lat = np.empty((len(BODIES), len(d))), np.zeros((len(BODIES), len(d)))
    lon[0] = np.arctan2(-earth[1], -earth[0])
    m, s, f, e = (np.radians(a + r * d) for a, r in ((134.963, 13.064993), (357.529, 0.98560028), (93.272, 13.229350), (297.850, 12.190749)))
    lon[1] = np.radians(218.316 + 13.176396 * d + 6.289 * np.sin(m) + 1.274 * np.sin(2 * e - m) + 0.658 * np.sin(2 * e) + 0.214 * np.sin(2 * m) - 0.186 * np.sin(s) - 0.114 * np.sin(2 * f))
    lat[1] = np.radians(5.128 * np.sin(f) + 0.281 * np.sin(m + f) + 0.278 * np.sin(m - f) + 0.173 * np.sin(2 * e - f))
    for k, name in enumerate(BODIES[2:], 2):
        x, y, z = _heliocentric(name, d / 36525) - earth
        lon[k], lat[k] = np.arctan2(y, x), np.arctan2(z, np.hypot(x, y))
    lon[[0, *range(2, len(BODIES))]] += np.radians(1.396971) * d / 36525  # precession: the Moon's series is of date already
    return lon, lat


def _waves(labels: list[str], angles: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
    k = np.arange(1, n + 1)[None, :, None] * angles[:, None, :]
    return [f"{x}.{f}{j}" for x in labels for j in range(1, n + 1) for f in ("cos", "sin")], np.stack((np.cos(k), np.sin(k)), 2).reshape(-1, angles.shape[1])


def families(day: np.ndarray, harmonics: int = 8, site: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, tuple[list[str], np.ndarray]]:
    """Names and values (feature by row) by family; site: latitudes and longitudes in degrees, for the site-local family."""
    (lon, lat), (later, _) = places(day), places(np.asarray(day) + 1)
    dec = np.arcsin(np.sin(lat) * np.cos(OBLIQUITY) + np.cos(lat) * np.sin(OBLIQUITY) * np.sin(lon))
    step = np.angle(np.exp(1j * (later - lon)))
    moon = lon[1] - lon[0]
    node = np.cos(moon) * np.cos(lat[1])
    pair = [f"{BODIES[a]}.{BODIES[b]}" for a, b in PAIRS]
    lunar = _waves(["lunar.phase"], moon[None], 4)
    out = {
        "aspect": _waves([f"aspect.{x}" for x in pair], np.stack([lon[a] - lon[b] for a, b in PAIRS]), harmonics),
        "declination": ([f"declination.{b}" for b in BODIES] + [f"parallel.{x}" for x in pair], np.concatenate((dec, [np.abs(dec[a] - dec[b]) for a, b in PAIRS]))),
        "fixed": _waves([f"fixed.{b}" for b in BODIES], lon, 4),
        "resonance": ([f"resonance.{BODIES[a]}.{BODIES[b]}.{p}:{q}" for a, b, p, q in RATIOS], np.cos([p * lon[a] - q * lon[b] for a, b, p, q in RATIOS])),
        "motion": ([f"motion.{b}" for b in BODIES] + [f"retrograde.{b}" for b in BODIES[2:]], np.concatenate((step, step[2:] < 0))),
        "lunar": (lunar[0] + ["lunar.latitude", "lunar.light"], np.concatenate((lunar[1], [lat[1], (1 - np.cos(moon)) / 2]))),
        "shape": (["shape.mean_x", "shape.mean_y"], np.stack((np.cos(lon).mean(0), np.sin(lon).mean(0)))),
        "eclipse": (["eclipse.solar", "eclipse.lunar", "eclipse.node"], np.stack((node, -node, np.abs(lat[1])))),
    }
    if site is not None:
        p = np.radians(site[0])
        turn = np.radians(np.mod(280.46061837 + 360.98564736629 * (np.asarray(day) - 0.5), 360) + site[1])
        hour = turn - np.arctan2(np.sin(lon) * np.cos(lat) * np.cos(OBLIQUITY) - np.sin(lat) * np.sin(OBLIQUITY), np.cos(lon) * np.cos(lat))
        altitude = np.sin(p) * np.sin(dec) + np.cos(p) * np.cos(dec) * np.cos(hour)
        out["local"] = ([f"local.{n}.{b}" for n in ("hour_cos", "hour_sin", "altitude") for b in BODIES], np.concatenate((np.cos(hour), np.sin(hour), altitude)))
    return out


def names(harmonics: int = 8, local: bool = False) -> list[str]:
    """The features in order; local: with the site-local family."""
    return [n for group, _ in families(np.zeros(1), harmonics, (np.zeros(1), np.zeros(1)) if local else None).values() for n in group]


def values(day: np.ndarray, harmonics: int = 8, site: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """(row, feature) in single precision, in the order of names; the day must be known."""
    return np.concatenate([v for _, v in families(day, harmonics, site).values()]).astype(np.float32).T


def chart_features(df: DataFrame, day: str = "day", lat: str | None = None, lon: str | None = None, harmonics: int = 8) -> tuple[DataFrame, list[str]]:
    """df with `features` (array<float>), and the names in its order. Rows without a day have null features."""
    site = bool(lat and lon)

    @F.pandas_udf("array<float>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, a, b in batches:
            known = d.notna().to_numpy()
            x = values(d.fillna(0.0).to_numpy(), harmonics, (a.to_numpy(), b.to_numpy()) if site else None)
            yield pd.Series([v if ok else None for v, ok in zip(x, known, strict=True)])

    one = lambda c: F.col(c).cast("double") if c else F.lit(0.0)
    return df.withColumn("features", made(F.col(day).cast("double"), one(lat), one(lon))), names(harmonics, site)
