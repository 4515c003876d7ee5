"""Reproducible draws: a counter hash on BIGINT, the same number in any engine, for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647
ROUNDS = (12345, 67891, 424243)


def mix(key: Column, seed: int | Column = 1) -> Column:
    """key in [0, 2**31) -> an integer in [0, M); products stay under 2**63."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    v = (key.cast("long") * 48271 + seed) % M
    for c in ROUNDS:
        v = (v * ((v % 65521) + c)) % M
    return v


def mix2(a: Column, b: Column, seed: int = 1) -> Column:
    """A compound key (a, b)."""
    return mix((mix(a, seed) + b) % M, seed + 1)


def uniform(v: Column) -> Column:
    """A mixed integer as a number in [0, 1)."""
    return v / F.lit(float(M))


def mix_sql(key: str, seed: int | str = 1) -> str:
    """The same in SQL; an expression that names its key several times, so keys should be columns."""
    v = f"((({key})::BIGINT * 48271 + {seed}) % {M})"
    for c in ROUNDS:
        v = f"(({v} * (({v} % 65521) + {c})) % {M})"
    return v


def gumbel(v: Column) -> Column:
    """A standard Gumbel draw of a mixed integer."""
    return -F.log(-F.log((v + 0.5) / F.lit(float(M))))
