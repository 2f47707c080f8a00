"""Random fields that depend on the seed and the coordinates alone, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus and multipliers of the Lehmer generators by which coordinates are hashed (fixed values).
MODULUS, FIRST, SECOND = 2147483647, 48271, 69621
_SPREAD = (73856093, 19349663, 83492791, 49979687, 86028121)


def _hash(coordinates: list[Column], seed: int, stream: int) -> Column:
    x = F.lit((seed * 40503 + stream * 65537 + 12345) % MODULUS).cast("bigint")
    for c, p in zip(coordinates, _SPREAD, strict=False):
        x = (x * FIRST + (c.cast("bigint") + 1048576) * p) % MODULUS
        x = (x * x + SECOND) % MODULUS
    return (x * SECOND) % MODULUS


def uniform(coordinates: list[Column], seed: int, stream: int = 0) -> Column:
    """Real numbers in [0, 1)."""
    return _hash(coordinates, seed, stream).cast("double") / MODULUS


def uniform_int(coordinates: list[Column], seed: int, stream: int = 0) -> Column:
    """Integers from 0 to the largest int, exclusive."""
    return _hash(coordinates, seed, stream).cast("int")


def normal(coordinates: list[Column], seed: int, stream: int = 0) -> Column:
    """Standard normal numbers, by Box and Muller."""
    u, v = 1 - uniform(coordinates, seed, 2 * stream + 101), uniform(coordinates, seed, 2 * stream + 102)
    return F.sqrt(-2 * F.ln(u)) * F.cos(v * 6.283185307179586)
