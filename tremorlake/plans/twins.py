"""SQL twins of programs, built from the clauses of their parts. Imported after the queries, which are registered without SQL."""

from __future__ import annotations

import math

from tremorlake.functions.random import M, mix_sql
from tremorlake.operators import tides
from tremorlake.plans.catalogue import cell_sql
from tremorlake.plans.fixtures import CMT_SQL, QUAKE_SQL, SPAN, TREMOR_SQL
from tremorlake.plans.matched import _INDEXED, _LABEL, _PERM, CENSUS, SWEEP, _cases_sql, claims_sql, fixpoint_sql, near_sql, perm_sql
from tremorlake.plans.registry import SQL
from tremorlake.plans.tidal import _FORCING, _null_sql


def tail_sql(x: str) -> str:
    """The normal distribution's upper tail at x > 0, by Simpson's rule over 12 standard deviations."""
    return f"(SELECT sum(CASE WHEN i IN (0, 2400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({x} + i * 0.005::DOUBLE, 2) / 2)) * 0.005::DOUBLE / 3 / sqrt(2 * pi()) FROM range(0, 2401) g(i))"


def signed_tail_sql(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN {tail_sql(f'abs({x})')} ELSE 1 - {tail_sql(f'abs({x})')} END)"


def fair_tail_sql(k: str, n: int) -> str:
    """P(X >= k) of n fair draws."""
    rows = ", ".join(f"({i}, {math.comb(n, i)})" for i in range(n + 1))
    return f"(SELECT coalesce(sum(c), 0) FROM (VALUES {rows}) b(i, c) WHERE i >= {k}) / {float(2**n)}::DOUBLE"


def _two_levels(a: str, b: str, seed: str, source: str, keep: str) -> str:
    """SELECT of `source` with u, the uniform draw of the compound key (a, b)."""
    return f"SELECT {keep}, {mix_sql('k2', f'({seed} + 1)')} / {float(M)}::DOUBLE AS u FROM (SELECT *, ({mix_sql('k1', seed)} + {b}) % {M} AS k2 FROM (SELECT *, {a} AS k1 FROM {source}))"


# Tidal response.
_EPS = "2 * sqrt(observed / n)"
SQL["depth_sign_test"] = f"""WITH {QUAKE_SQL}, two AS (SELECT *, CASE WHEN depth_km <= 70 THEN 'shallow' ELSE 'deep' END AS depthclass FROM quake WHERE magnitude >= 5), {_null_sql('two', 'lon_deg', 'depthclass')},
e AS (SELECT band, max({_EPS}) FILTER (depthclass = 'shallow') AS a, max({_EPS}) FILTER (depthclass = 'deep') AS b FROM nulled GROUP BY band),
k AS (SELECT sum((a > b)::INTEGER)::BIGINT AS stronger FROM e) SELECT stronger, round({fair_tail_sql('stronger', 9)}, 6) AS tail FROM k"""

_FIVE = f"bands(band, species, start, rate, period) AS (VALUES {tides.values_sql(['M2', 'N2', 'O1', 'Q1', 'K1'])})"
SQL["phase_lag_consistency"] = f"""WITH {QUAKE_SQL}, {_FIVE}, ph AS (SELECT *, radians(start + rate * day + species * lon_deg) AS phase FROM quake, bands), {_FORCING},
o AS (SELECT band, degrees(atan2(sum(sin(phase)), sum(cos(phase)))) AS obs FROM ph GROUP BY band),
f AS (SELECT band, any_value(period) AS period, degrees(atan2(sum(value * sin(radians(start + rate * day))), sum(value * cos(radians(start + rate * day))))) AS ref FROM series, bands GROUP BY band),
l AS (SELECT period, fmod(obs - ref, 360) AS x FROM o JOIN f USING (band)), w AS (SELECT period, CASE WHEN x > 180 THEN x - 360 WHEN x < -180 THEN x + 360 ELSE x END AS lag FROM l)
SELECT round(avg(lag) FILTER (period < 0.75), 3) AS semi_mean, round(stddev_pop(lag) FILTER (period < 0.75), 3) AS semi_sd, round(avg(lag) FILTER (period >= 0.75), 3) AS diurnal_mean, round(stddev_pop(lag) FILTER (period >= 0.75), 3) AS diurnal_sd, round(avg(lag) FILTER (period >= 0.75) - avg(lag) FILTER (period < 0.75), 3) AS difference FROM w"""

SQL["parkfield_constituent_response"] = f"""WITH {TREMOR_SQL}, {_null_sql('tremor', '0')}, {_FORCING},
f AS (SELECT band, 2 * sqrt(pow(sum(value * cos(radians(start + rate * day))), 2) + pow(sum(value * sin(radians(start + rate * day))), 2)) / count(*) AS amplitude FROM series, bands GROUP BY band),
r AS (SELECT *, row_number() OVER (ORDER BY p, band) AS rank, count(*) OVER () AS m FROM nulled)
SELECT band, n, blocks, blocks < 8 AS few_blocks, round(p, 6) AS p, round({_EPS}, 6) AS eps, round({_EPS} / amplitude, 5) AS response, round(observed / null_median, 4) AS ratio, rank::INTEGER AS rank, rank <= coalesce((SELECT max(rank) FROM r WHERE p <= 0.05 * rank / m), 0) AS survives FROM r JOIN f USING (band)"""

SQL["band_prediction_test"] = f"""WITH {QUAKE_SQL}, {TREMOR_SQL}, q AS (SELECT * FROM quake WHERE magnitude >= 5.5),
eq AS (WITH {_null_sql('q', 'lon_deg')} SELECT * FROM nulled), tr AS (WITH {_null_sql('tremor', '0')} SELECT * FROM nulled), per(band, species, start, rate, period) AS (VALUES {tides.values_sql(['M2', 'S2', 'N2', 'K1', 'O1', 'Q1', 'Mf', 'Mm', 'Ssa'])}),
x AS (SELECT eq.band, eq.p AS eq_p, 2 * sqrt(eq.null_max / eq.n) AS eq_limit, tr.p AS tremor_p, 2 * sqrt(tr.observed / tr.n) AS tremor_eps, period FROM eq JOIN tr USING (band) JOIN per USING (band)),
v AS (SELECT count(*) FILTER (eq_p < 0.05 AND period < 2) AS short, count(*) FILTER (eq_p < 0.05 AND period >= 2) AS long FROM x)
SELECT band, round(eq_p, 6) AS eq_p, round(eq_limit, 6) AS eq_limit, round(tremor_p, 6) AS tremor_p, round(tremor_eps, 6) AS tremor_eps, round(period, 6) AS period, CASE WHEN short = 0 AND long = 0 THEN 'inconclusive' WHEN short = 0 THEN 'consistent' WHEN long = 0 THEN 'refuted' ELSE 'needs interpretation' END AS verdict FROM x, v"""


def _peaks_sql(n: int, least: float) -> str:
    step = f"{math.log(30 / 0.2) / (n - 1)!r}::DOUBLE"
    period = f"(0.2::DOUBLE * exp({step} * k))"
    return f"""{TREMOR_SQL}, spectrum AS (SELECT k, {period} AS period, (pow(sum(cos({2 * math.pi!r}::DOUBLE * day / {period})), 2) + pow(sum(sin({2 * math.pi!r}::DOUBLE * day / {period})), 2)) / count(*) AS power FROM tremor, range(0, {n}) r(k) GROUP BY k),
sided AS (SELECT *, lag(power) OVER (ORDER BY k) AS a, lead(power) OVER (ORDER BY k) AS b FROM spectrum), found AS (SELECT period, power FROM sided WHERE power > a AND power >= b AND power >= {least})"""


def _nearest_sql(known: str, gap: str, within: float, long_: str = "") -> str:
    return f"""known(name, known_period) AS (VALUES {known}),
met AS (SELECT name, known_period, period, power, row_number() OVER (PARTITION BY name ORDER BY {gap} NULLS LAST, period) AS r FROM known LEFT JOIN found ON period > known_period / {1 + 2 * within}::DOUBLE AND period < known_period * {1 + 2 * within}::DOUBLE AND {gap} <= {within}::DOUBLE)
SELECT name, known_period, round(period, 6) AS period, round(power, 3) AS power{long_} FROM met WHERE r = 1"""


SQL["moonquake_periodogram"] = f"WITH {_peaks_sql(20000, 1.0)}, {_nearest_sql('(' + chr(39) + 'day' + chr(39) + ', 1.0::DOUBLE), (' + chr(39) + 'half day' + chr(39) + ', 0.5), (' + chr(39) + 'lunar day' + chr(39) + ', 1.03505), (' + chr(39) + 'week' + chr(39) + ', 7.0), (' + chr(39) + 'synodic' + chr(39) + ', 29.531)', 'abs(period / known_period - 1)', 0.01, ', known_period > (SELECT (max(day) - min(day)) / 2 FROM tremor) AS too_long')}"
_BEATS = {"anomalistic": 27.555, "synodic": 29.531, "draconic": 27.212, "half day": 0.5}
SQL["moonquake_validation"] = f"WITH {_peaks_sql(1000, 0.5)}, " + _nearest_sql(", ".join([f"('{k}', {v}::DOUBLE)" for k, v in _BEATS.items()] + [f"('{a} and {b}', 1 / abs(1.0::DOUBLE / {_BEATS[a]}::DOUBLE - 1.0::DOUBLE / {_BEATS[b]}::DOUBLE))" for a, b in (("anomalistic", "synodic"), ("anomalistic", "draconic"), ("synodic", "half day"))]), "abs(ln(period / known_period))", 0.1)

# Constants and tables, computed here from their own definitions.
_RATES = "13.17639648::DOUBLE AS s, 0.98564736::DOUBLE AS h, 0.11140353::DOUBLE AS p, 0.05295377::DOUBLE AS n, 0.00004707::DOUBLE AS ps"
SQL["c1_constituents"] = f"""WITH {QUAKE_SQL}, rates AS (SELECT {_RATES}), d(band, species, cs, ch, cp, cn, cps) AS (VALUES ('M2', 2, 0, 0, 0, 0, 0), ('S2', 2, 2, -2, 0, 0, 0), ('N2', 2, -1, 0, 1, 0, 0), ('K1', 1, 1, 0, 0, 0, 0), ('O1', 1, -1, 0, 0, 0, 0), ('Q1', 1, -2, 0, 1, 0, 0), ('Mf', 0, 2, 0, 0, 0, 0), ('Mm', 0, 1, 0, -1, 0, 0), ('Ssa', 0, 0, 2, 0, 0, 0))
, x AS (SELECT band, species, 360 / (species * (360 + h - s) + cs * s + ch * h + cp * p + cn * n + cps * ps) AS period FROM d, rates), e AS (SELECT min(day) AS low, max(day) AS high FROM quake)
SELECT band, species, round(period, 6) AS period, floor(low / period)::BIGINT AS first_cycle, floor(high / period)::BIGINT AS last_cycle FROM x, e"""
SQL["d4_grid_bands"] = f"""WITH {QUAKE_SQL}, {cell_sql(100.0)}, g AS (SELECT greatest(1, round(pi() / (100.0::DOUBLE / 6371.0::DOUBLE)))::INTEGER AS bands), b AS (SELECT k::INTEGER AS band, pi() / bands AS h, sin(-pi() / 2 + (k + 1) * (pi() / bands)) - sin(-pi() / 2 + k * (pi() / bands)) AS rise FROM g, range(0, 1000) r(k) WHERE k < bands),
c AS (SELECT band, rise, greatest(1, floor(2 * pi() * rise / (h * h) + 0.5))::INTEGER AS n_lon FROM b)
, f AS (SELECT band, n_lon, (sum(n_lon) OVER (ORDER BY band) - n_lon)::BIGINT AS first, round(2 * pi() * 6371.0::DOUBLE * 6371.0::DOUBLE * rise / n_lon, 3) AS area_km2 FROM c)
SELECT f.*, (SELECT count(*) FROM celled WHERE cell >= f.first AND cell < f.first + f.n_lon) AS events FROM f"""
SQL["a24_effective_tests"] = f"WITH {_PERM}, t AS (SELECT median(m) AS x FROM maxes) SELECT round(x, 5) AS median_max, round(ln(0.5::DOUBLE) / ln(1 - 2 * {tail_sql('x')}), 2) AS tests FROM t"
SQL["d22_timing_span"] = f"WITH {QUAKE_SQL}, t AS (SELECT event_idx, day - {SPAN[0]}::DOUBLE AS since, {SPAN[1]}::DOUBLE - day AS until FROM quake) SELECT event_idx, round(since, 8) AS since, round(until, 8) AS until, round(least(since, until), 8) AS nearest, round(CASE WHEN since + until > 0 THEN since / (since + until) ELSE 0 END, 8) AS fraction FROM t"
SQL["s15_synthetic_design"] = f"""WITH base AS (SELECT (k // 11)::BIGINT AS stratum, (k % 11)::BIGINT AS row_idx FROM range(0, {3000 * 11}) r(k)), seeds AS (SELECT i, w, (200 + 2 * i + w)::BIGINT AS seed FROM range(0, 4) a(i), range(0, 2) b(w)), keyed AS (SELECT * FROM base, seeds),
d AS ({_two_levels(f'stratum % {M}', 'row_idx', 'seed', 'keyed', 'stratum, row_idx, i, w')}),
x AS (SELECT i, sqrt(-2 * ln(max(u) FILTER (w = 0) + 1e-12)) * cos(2 * pi() * max(u) FILTER (w = 1)) AS x FROM d GROUP BY stratum, row_idx, i)
SELECT {', '.join(f'round({f}(x) FILTER (i = {i}), 6) AS {n}_{i}' for i in range(4) for n, f in (('mean', 'avg'), ('sd', 'stddev_pop')))} FROM x"""

# Catalogues: declustering and thinning at several settings.


def _mains(least: float) -> str:
    return f"{QUAKE_SQL}, q AS (SELECT * FROM quake WHERE magnitude >= {least}), {fixpoint_sql(claims_sql('q'), 'SELECT event_idx FROM q')}"


def _dispersion_sql(least: float) -> str:
    year = "year(DATE '2000-01-01' + floor(day)::INTEGER)::INTEGER"
    return f"""(WITH {_mains(least)}, c AS (SELECT {year} AS year, count(*)::DOUBLE AS n FROM q WHERE event_idx IN (SELECT event_idx FROM main) GROUP BY 1),
d AS (SELECT round(var_samp(n) / avg(n), 6) AS ratio, round((count(*) - 1) * var_samp(n) / avg(n), 6) AS chi2, count(*) - 1 AS df, round(corr(year, n), 6) AS trend_r FROM c),
z AS (SELECT *, (pow(chi2 / df, 1.0::DOUBLE / 3) - (1 - 2 / (9.0::DOUBLE * df))) / sqrt(2 / (9.0::DOUBLE * df)) AS z FROM d)
SELECT ratio, chi2, df, trend_r, round({signed_tail_sql('z')}, 4) AS p, {least}::DOUBLE AS min_magnitude FROM z)"""


SQL["annual_rate_check"] = " UNION ALL ".join(_dispersion_sql(m) for m in (4.0, 5.0, 5.5, 6.0))
SQL["inspect"] = " UNION ALL ".join(
    f"(WITH {_mains(m)}, {cell_sql(100.0, 'q')} SELECT {m}::DOUBLE AS min_magnitude, count(*) AS events, count(*) FILTER (event_idx IN (SELECT event_idx FROM main)) AS independent, count(DISTINCT cell) FILTER (event_idx IN (SELECT event_idx FROM main)) AS cells, count(*) FILTER (event_idx IN (SELECT event_idx FROM main)) * {11 * 9816 * 4} AS design_bytes FROM celled)"
    for m in (4.0, 4.5, 5.0, 5.5, 6.0)
)


def _census_sql() -> str:
    depth = "CASE WHEN depth_km < 70 THEN 'shallow' ELSE 'deep' END"
    parts = []
    for name, mech, deep in CENSUS:
        where = " AND ".join([f"mech = '{mech}'"] * bool(mech) + [f"depthclass = '{deep}'"] * bool(deep)) or "TRUE"
        parts.append(f"(WITH q AS (SELECT * FROM ev WHERE {where}), {fixpoint_sql(near_sql('q', 500, 365, False), 'SELECT event_idx FROM q')} SELECT '{name}' AS stratum, (SELECT count(*) FROM q) AS declustered, (SELECT count(*) FROM main) AS thinned)")
    beta = "0.04 * sqrt(10813.0::DOUBLE / nullif(thinned, 0))"
    return f"""WITH {CMT_SQL}, kept AS (WITH {fixpoint_sql(claims_sql(), 'SELECT event_idx FROM quake')} SELECT event_idx FROM main),
ev AS MATERIALIZED (SELECT event_idx, day, lat_deg, lon_deg, {_LABEL} AS mech, {depth} AS depthclass FROM cmt WHERE day BETWEEN -8766 AND 9132 AND magnitude >= 5.5 AND event_idx IN (SELECT event_idx FROM kept)),
s AS ({' UNION ALL '.join(parts)})
SELECT stratum, declustered, nullif(thinned, 0) AS thinned, round({beta}, 6) AS beta_min, CASE WHEN {beta} <= 0.05 THEN 'fit for small effects' WHEN {beta} <= 0.12 THEN 'weak for small effects' ELSE 'unfit for tests' END AS verdict FROM s"""


SQL["strata_census"] = _census_sql()


def _sweep_sql() -> str:
    parts = []
    for km, days in SWEEP:
        parts.append(f"(WITH q AS (SELECT stratum AS event_idx, day, lat_deg, lon_deg FROM indexed WHERE is_case), {fixpoint_sql(near_sql('q', km, days, True), 'SELECT event_idx FROM q')}, m AS (SELECT stratum, var_pop(day) AS v, sum(day) FILTER (is_case) - avg(day) AS u FROM indexed WHERE stratum IN (SELECT event_idx FROM main) GROUP BY stratum) SELECT {km} AS km, {days} AS days, count(*) AS n_strata, round(sum(u) / sqrt(sum(v)), 4) AS z FROM m)")
    return f"WITH {_INDEXED}, base AS (SELECT 1) {' UNION ALL '.join(parts)}"


SQL["d19_thinning_sweep"] = _sweep_sql()

# Designs and scores.


def _drawn_sql(at: str, k: int, seed: int = 20260822) -> str:
    """Controls of a scheme: the first k distinct draws inside the span, counted and summed."""
    return f"""WITH {_cases_sql()}, tries AS (SELECT stratum, day, j::BIGINT AS j, w::BIGINT AS w FROM cases, range(1, {4 * k + 33}) r(j), (VALUES (0), (2)) v(w)),
u AS ({_two_levels('stratum', 'j', f'({seed} + w)', 'tries', 'stratum, day, j, w')}),
pairs AS (SELECT stratum, day, j, max(u) FILTER (w = 0) AS u0, max(u) FILTER (w = 2) AS u2 FROM u GROUP BY ALL), t AS (SELECT stratum, j, {at} AS t FROM pairs),
d AS (SELECT stratum, t, min(j) AS j FROM t WHERE t BETWEEN {SPAN[0]} AND {SPAN[1]} GROUP BY stratum, t), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY j) AS r FROM d)
SELECT stratum, count(*) AS n, count(DISTINCT t) AS n_distinct, 1 AS inside, count(*) = {k} AS "full", round(sum(t), 3) AS total FROM r WHERE r <= {k} GROUP BY stratum"""


SQL["d9_day_offset"] = _drawn_sql("day + (1 + floor(u0 * 60)) * CASE WHEN u2 < 0.5 THEN -1 ELSE 1 END", 10)
SQL["d10_window"] = _drawn_sql("day + (u0 * 2 - 1) * 30.0::DOUBLE", 10)
SQL["d11_uniform"] = _drawn_sql(f"{SPAN[0]}::DOUBLE + u0 * {SPAN[1] - SPAN[0]}::DOUBLE", 10)

_FIRST4 = f"""{_INDEXED}, good AS (SELECT stratum FROM indexed GROUP BY stratum HAVING count(*) FILTER (is_case) = 1 AND count(*) > 1 AND max(day) FILTER (is_case) < 6210),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum, is_case ORDER BY row_idx) AS r4 FROM indexed WHERE stratum IN (SELECT stratum FROM good)) WHERE is_case OR r4 <= 4)"""
_SCORED = "CASE f WHEN 'date' THEN day WHEN 'date2' THEN day * day / 1e6 WHEN 'day_of_month' THEN day - floor(day / 30.44::DOUBLE) * 30.44::DOUBLE ELSE (stratum * 7 + row_idx * 13) % 11 END::DOUBLE"
SQL["score_scan"] = f"""WITH {_FIRST4}, long AS (SELECT stratum, row_idx, is_case, f AS feature, {_SCORED} AS x FROM firsts, (VALUES ('date'), ('date2'), ('day_of_month'), ('hash')) v(f)), {perm_sql(100)}, o AS (SELECT max(abs(z)) AS obs FROM scored),
w AS (SELECT obs, (count(*) FILTER (m >= obs - 1e-12) + 1)::DOUBLE / (count(*) + 1) AS p, quantile_cont(m, 0.95) AS top, median(m) AS mid, count(*) AS perms FROM maxes, o GROUP BY obs)
SELECT round(obs, 5) AS max_abs_z, round(p, 6) AS family_wise_p, round(top, 5) AS perm_threshold_95, round(mid, 5) AS perm_median, perms, round(ln(0.5::DOUBLE) / ln(1 - 2 * {tail_sql('mid')}), 2) AS effective_tests FROM w"""

_DATES = "('date'), ('date2'), ('slow_cos'), ('slow_sin'), ('day_of_month')"
_DATE_X = "CASE f WHEN 'date' THEN day WHEN 'date2' THEN pow(day / 1000, 2) WHEN 'slow_cos' THEN cos(2 * 3.141592653589793::DOUBLE * day / 181000) WHEN 'slow_sin' THEN sin(2 * 3.141592653589793::DOUBLE * day / 181000) ELSE day - floor(day / 30.44::DOUBLE) * 30.44::DOUBLE END"
SQL["calendar_check"] = f"""WITH {_INDEXED}, long AS (SELECT stratum, row_idx, is_case, f AS feature, {_DATE_X} AS x FROM indexed, (VALUES {_DATES}) v(f)), {perm_sql(99)}
SELECT s.feature, round(any_value(s.z), 4) AS z, round((count(*) FILTER (abs(z0.z) >= abs(s.z) * (1 - 1e-9)) + 1) / 100.0::DOUBLE, 6) AS p, any_value(abs(s.z)) > 2 AS suspect FROM null_z z0 JOIN scored s USING (feature) GROUP BY s.feature"""


def _planted_sql() -> str:
    parts = []
    for beta in (0.25, 0.5, 1.0):
        parts.append(f"SELECT {beta}::DOUBLE AS beta, stratum, row_idx, hash, row_number() OVER (PARTITION BY stratum ORDER BY {beta}::DOUBLE * ((hash - mean) / sd) - ln(-ln((v + 0.5) / {float(M)}::DOUBLE)) DESC, row_idx) = 1 AS is_case FROM gumbels, stats")
    key = lambda seed: f"SELECT *, {mix_sql('k2', seed + 1)} AS v FROM (SELECT *, ({mix_sql('k1', seed)} + row_idx % {M}) % {M} AS k2 FROM (SELECT *, stratum % {M} AS k1 FROM base))"
    return f"""WITH {_INDEXED}, base AS (SELECT stratum, row_idx::BIGINT AS row_idx, ((stratum * 7 + row_idx * 13) % 11)::DOUBLE AS hash FROM indexed), stats AS (SELECT avg(hash) AS mean, stddev_pop(hash) AS sd FROM base),
gumbels AS ({key(20260823)}), shuffled AS ({key(20260822)}),
designs AS (SELECT 0.0::DOUBLE AS beta, stratum, row_idx, hash, row_number() OVER (PARTITION BY stratum ORDER BY v, row_idx) = 1 AS is_case FROM shuffled UNION ALL {' UNION ALL '.join(parts)}),
m AS (SELECT beta, stratum, var_pop(hash) AS v, sum(hash) FILTER (is_case) - avg(hash) AS u FROM designs GROUP BY beta, stratum)
SELECT beta, count(*) AS n_strata, round(sum(u) / sqrt(sum(v)), 4) AS z FROM m GROUP BY beta"""


SQL["d21_planted"] = _planted_sql()
SQL["s10_matrix_size"] = f"WITH {_INDEXED}, featured AS (SELECT day AS f_day, day - floor(day / 30.44::DOUBLE) * 30.44::DOUBLE AS f_month, ((stratum * 7 + row_idx * 13) % 11)::DOUBLE AS f_hash FROM indexed) SELECT count(*) AS n_rows, count(*) * 4 AS n_values, round(sum(f_day), 3) AS total_day, round(sum(f_month), 3) AS total_month, round(sum(f_hash), 3) AS total_hash, count(*)::DOUBLE AS total_flat FROM featured"
