"""Tidal fields and fault stress, from public formulas: a low-precision ephemeris, the tidal tensor, its rotation to a
site, Coulomb stress on a plane, Love-number conversion, forcing maxima, and complex demodulation.

The ephemeris holds the main terms of the lunar and solar theories (about 0.1 degree); phases against a full ephemeris differ
accordingly. All of it is column arithmetic, so it runs inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Gravitational parameters in km^3/s^2, and the astronomical unit in km.
GM_MOON, GM_SUN, AU_KM = 4902.800066, 1.32712440018e11, 149597870.7
OBLIQUITY = math.radians(23.4392911)
# Degree-2 Love and Shida numbers, shear modulus in Pa, mean radius in m, surface gravity.
H2, L2, SHEAR, RADIUS_M, GRAVITY = 0.6078, 0.0847, 30e9, 6.371e6, 9.81
COMPONENTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _sun(d: Column) -> tuple[Column, Column, Column]:
    """Ecliptic longitude, latitude (radians) and distance (km) of the Sun; d days since 2000-01-01T12:00."""
    g = F.radians(357.529 + 0.98560028 * d)
    lon = F.radians(280.459 + 0.98564736 * d + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    return lon, F.lit(0.0), (1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g)) * AU_KM


def _moon(d: Column) -> tuple[Column, Column, Column]:
    """The same of the Moon, by its largest periodic terms."""
    rad = lambda a, r: F.radians(a + r * d)
    l0, m, s, f, e = rad(218.316, 13.176396), rad(134.963, 13.064993), rad(357.529, 0.98560028), rad(93.272, 13.229350), rad(297.850, 12.190749)
    lon = l0 + F.radians(6.289 * F.sin(m) + 1.274 * F.sin(2 * e - m) + 0.658 * F.sin(2 * e) + 0.214 * F.sin(2 * m) - 0.186 * F.sin(s) - 0.114 * F.sin(2 * f))
    lat = F.radians(5.128 * F.sin(f) + 0.281 * F.sin(m + f) + 0.278 * F.sin(m - f) + 0.173 * F.sin(2 * e - f))
    return lon, lat, 385001.0 - 20905.0 * F.cos(m) - 3699.0 * F.cos(2 * e - m) - 2956.0 * F.cos(2 * e) - 570.0 * F.cos(2 * m)


def _fixed(d: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Ecliptic direction -> unit vector in the rotating frame of the Earth."""
    x, y, z = F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
    qy, qz = y * math.cos(OBLIQUITY) - z * math.sin(OBLIQUITY), y * math.sin(OBLIQUITY) + z * math.cos(OBLIQUITY)
    t = F.radians(F.pmod(280.46061837 + 360.98564736629 * d, F.lit(360.0)))
    return x * F.cos(t) + qy * F.sin(t), -x * F.sin(t) + qy * F.cos(t), qz


def tidal_tensor(df: DataFrame, day: Column, bodies: tuple[str, ...] = ("moon", "sun")) -> DataFrame:
    """Adds xx ... zz, the sum over bodies of GM / d^3 (3 n n - I), in 1/s^2, in the Earth-fixed frame."""
    d = day - 0.5
    total: list[Column] = [F.lit(0.0)] * 6
    for i, body in enumerate(bodies):
        lon, lat, dist = _moon(d) if body == "moon" else _sun(d)
        n = _fixed(d, lon, lat)
        df = df.withColumns({f"__n{i}{a}": v for a, v in zip("xyz", n, strict=True)} | {f"__k{i}": (GM_MOON if body == "moon" else GM_SUN) / F.pow(dist, 3)})
        for c, (a, b) in enumerate(COMPONENTS):
            total[c] = total[c] + F.col(f"__k{i}") * (3 * F.col(f"__n{i}{a}") * F.col(f"__n{i}{b}") - (1.0 if a == b else 0.0))
    out = df.withColumns(dict(zip(COMPONENTS, total, strict=True)))
    return out.drop(*[c for c in out.columns if c.startswith(("__n", "__k"))])


def to_local(df: DataFrame, lat: str, lon: str, prefix: str = "") -> DataFrame:
    """Rotates xx ... zz to north, east, down at a site: nn, ne, nd, ee, ed, dd."""
    p, q = F.radians(lat), F.radians(lon)
    rows = {
        "n": (-F.sin(p) * F.cos(q), -F.sin(p) * F.sin(q), F.cos(p)),
        "e": (-F.sin(q), F.cos(q), F.lit(0.0)),
        "d": (-F.cos(p) * F.cos(q), -F.cos(p) * F.sin(q), -F.sin(p)),
    }
    t = {(i, j): F.col(COMPONENTS[{(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4, (2, 2): 5}[min(i, j), max(i, j)]]) for i in range(3) for j in range(3)}
    out = {}
    for a, b in ("nn", "ne", "nd", "ee", "ed", "dd"):
        out[prefix + a + b] = sum((rows[a][i] * t[i, j] * rows[b][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return df.withColumns(out)


def eigenvalues(a: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """Of a symmetric tensor (six columns in the order of COMPONENTS), largest first: the trigonometric solution of the cubic."""
    xx, xy, xz, yy, yz, zz = a
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    bx, by, bz = xx - q, yy - q, zz - q
    det = bx * (by * bz - yz * yz) - xy * (xy * bz - yz * xz) + xz * (xy * yz - by * xz)
    turn = F.when(p > 0, F.acos(F.least(F.greatest(det / (2 * p * p * p), F.lit(-1.0)), F.lit(1.0))) / 3).otherwise(0.0)
    top, low = q + 2 * p * F.cos(turn), q + 2 * p * F.cos(turn + 2 * math.pi / 3)
    return top, 3 * q - top - low, low


def axis_of(a: tuple[Column, ...], value: Column) -> Column:
    """Unit vector [x, y, z] of an eigenvalue, z not negative: the longest cross product of two rows of the tensor less the value.

    Null where the eigenvalue is not a single one."""
    xx, xy, xz, yy, yz, zz = a
    rows = ((xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value))
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    each = [F.struct((c[0] * c[0] + c[1] * c[1] + c[2] * c[2]).alias("n"), F.array(*c).alias("v")) for c in (cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2]))]
    best = F.array_max(F.array(*each))
    scale = xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)
    sign = F.when(F.get(best["v"], F.lit(2)) < 0, -1.0).otherwise(1.0)
    return F.when(best["n"] > 1e-18 * scale * scale, F.transform(best["v"], lambda x: x * sign / F.sqrt(best["n"])))


def plane_vectors(strike: Column, dip: Column, rake: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Normal and slip vector of a fault plane in north, east, down (Aki and Richards)."""
    f, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    normal = (-F.sin(d) * F.sin(f), F.sin(d) * F.cos(f), -F.cos(d))
    slip = (F.cos(r) * F.cos(f) + F.sin(r) * F.cos(d) * F.sin(f), F.cos(r) * F.sin(f) - F.sin(r) * F.cos(d) * F.cos(f), -F.sin(r) * F.sin(d))
    return normal, slip


def coulomb_coefficients(strike: Column, dip: Column, rake: Column, mu: Column | float) -> list[Column]:
    """Weights of nn, ne, nd, ee, ed, dd in the Coulomb stress s.Tn + mu n.Tn (unclamping positive)."""
    n, s = plane_vectors(strike, dip, rake)
    out = []
    for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
        both = n[i] * s[j] + mu * n[i] * n[j]
        out.append(both if i == j else both + n[j] * s[i] + mu * n[j] * n[i])
    return out


def coulomb(strike: Column, dip: Column, rake: Column, mu: float, prefix: str = "") -> Column:
    """Of the columns nn ... dd."""
    terms = coulomb_coefficients(strike, dip, rake, mu)
    return sum((w * F.col(prefix + c) for w, c in zip(terms, ("nn", "ne", "nd", "ee", "ed", "dd"), strict=True)), F.lit(0.0))


def plane_grid(spark: SparkSession, strike: float = 15, dip: float = 15, rake: float = 30) -> DataFrame:
    """(plane, strike, dip, rake): 24 x 6 x 12 planes at the default steps."""
    s, d, r = (spark.range(n).withColumnRenamed("id", c) for n, c in ((round(360 / strike), "i"), (round(90 / dip), "j"), (round(360 / rake), "k")))
    n_d, n_r = round(90 / dip), round(360 / rake)
    return s.crossJoin(d).crossJoin(r).select(((F.col("i") * n_d + F.col("j")) * n_r + F.col("k")).alias("plane"), (F.col("i") * strike).alias("strike"), ((F.col("j") + 1) * dip).alias("dip"), (F.col("k") * rake - 180).alias("rake"))


def covariance(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by...) -> the 21 population covariances of nn ... dd; weight: a column that says how many rows a row stands for."""
    names = ("nn", "ne", "nd", "ee", "ed", "dd")
    if weight is not None:
        w, scale = F.col(weight), 1e13  # components are about 1e-13
        sums = [F.sum(w * F.col(a) * scale).alias(f"__{a}") for a in names] + [F.sum(w * F.col(a) * scale * F.col(b) * scale).alias(f"__{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
        s = df.groupBy(*by).agg(F.sum(w).alias("n"), *sums)
        return s.select(*by, "n", *[((F.col(f"__{a}_{b}") / F.col("n") - F.col(f"__{a}") / F.col("n") * F.col(f"__{b}") / F.col("n")) / scale**2).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]])
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]])


def coulomb_sd(coefficients: list[Column]) -> Column:
    """Standard deviation of the Coulomb stress from the covariances of its components: a quadratic form, without a rescan."""
    names = ("nn", "ne", "nd", "ee", "ed", "dd")
    total = F.lit(0.0)
    for i, a in enumerate(names):
        for j in range(i, 6):
            total = total + (1 if i == j else 2) * coefficients[i] * coefficients[j] * F.col(f"{a}_{names[j]}")
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def strain_per_tensor() -> float:
    """Areal strain for a unit of the tensor: (2 h - 6 l) R / (4 g)."""
    return (2 * H2 - 6 * L2) * RADIUS_M / (4 * GRAVITY)


def stress_pa(tensor: Column) -> Column:
    """Pascals of a tensor (or Coulomb) value in 1/s^2: 2 mu times the strain."""
    return 2 * SHEAR * strain_per_tensor() * tensor


def stressing_rate(a_sigma_pa: Column, critical_days: Column) -> Column:
    """Pa a year at which a fault of the given A sigma has that critical period: 2 pi A sigma / T."""
    return 2 * math.pi * a_sigma_pa / (critical_days / 365.25)


def critical_period_days(a_sigma_pa: Column, rate_pa_year: Column) -> Column:
    """2 pi A sigma over the stressing rate, in days."""
    return 2 * math.pi * a_sigma_pa / rate_pa_year * 365.25


def series(spark: SparkSession, start: float, step: float, n: int) -> DataFrame:
    """(k, day): a regular grid, made where it is used."""
    return spark.range(n).select(F.col("id").alias("k"), (F.lit(start) + F.col("id") * F.lit(step)).alias("day"))


def maxima(samples: DataFrame, value: str = "value", per: int = 65536) -> DataFrame:
    """Maxima of a sampled forcing (k, day, value): (day, height), the top of a parabola through three samples.

    Samples are dealt in runs of `per` with two neighbours on either side, so no task holds the series."""
    home = F.floor(F.col("k") / per)
    x = samples.withColumn("__b", F.explode(F.array_distinct(F.array(home, F.floor((F.col("k") - 1) / per), F.floor((F.col("k") + 1) / per)))))
    w = Window.partitionBy("__b").orderBy("k")
    x = x.withColumns({"__a": F.lag(value).over(w), "__c": F.lead(value).over(w), "__h": F.lead("day").over(w) - F.col("day")}).where(F.col("__b") == home)
    top = x.where((F.col(value) > F.col("__a")) & (F.col(value) >= F.col("__c")))
    bend = F.col("__a") - 2 * F.col(value) + F.col("__c")
    shift = 0.5 * (F.col("__a") - F.col("__c")) / bend
    return top.select((F.col("day") + shift * F.col("__h")).alias("day"), (F.col(value) - 0.25 * (F.col("__a") - F.col("__c")) * shift).alias("height"))


def forcing_phase(events: DataFrame) -> DataFrame:
    """events with prev and next maxima -> phase in radians, 0 at a maximum; events outside the maxima are dropped."""
    return events.where("prev is not null and next is not null and next > prev").withColumn("phase", 2 * math.pi * (F.col("day") - F.col("prev")) / (F.col("next") - F.col("prev")))


def demodulate(samples: DataFrame, period: float, window: float, value: str = "value") -> DataFrame:
    """Complex demodulation in windows: (window, mean day, amplitude, phase in degrees) of a period's signal."""
    t = 2 * math.pi * F.col("day") / period
    g = samples.groupBy(F.floor(F.col("day") / window).cast("long").alias("window")).agg(F.avg("day").alias("day"), F.avg(F.col(value) * F.cos(t)).alias("a"), F.avg(F.col(value) * F.sin(t)).alias("b"))
    return g.select("window", "day", (2 * F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("amplitude"), F.degrees(F.atan2("b", "a")).alias("phase"))


def loading_strain(coefficients: DataFrame, days: DataFrame, convention: float = 10.97) -> DataFrame:
    """Areal loading strain at (site, day): sum over constituents of amplitude cos(argument + phase + convention).

    coefficients (site, band, lon, species, start, rate, amplitude, phase_deg): a few rows a site."""
    x = days.crossJoin(F.broadcast(coefficients))
    chi = F.radians(F.col("start") + F.col("rate") * F.col("day") + F.col("species") * F.col("lon") + F.col("phase_deg") + convention)
    return x.groupBy("site", "day").agg(F.sum(F.col("amplitude") * F.cos(chi)).alias("strain"))


def plane_stress(e_nn: Column, e_ne: Column, e_ee: Column, nu: float = 0.25, shear: float = SHEAR) -> tuple[Column, Column, Column]:
    """Strain to stress at a free surface: (nn, ne, ee) in Pa."""
    k = 2 * shear / (1 - nu)
    return k * (e_nn + nu * e_ee), 2 * shear * e_ne, k * (e_ee + nu * e_nn)
