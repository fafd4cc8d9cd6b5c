"""JOI1/JOI2: fact table LEFT JOIN a small dimension.

The dimension is broadcast only while its size, as its files have it at this
moment, is within a bound; beyond it the join is left to a shuffle join, where
AQE's skew-join handling splits a hot key on the fact side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size up to which a (key, points) dimension is broadcast.
MAX_BROADCAST_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size of ``df``: from the current file listing, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(dim: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return plan_bytes(dim) <= max_bytes


def lookup_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                how: str = "left", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``fact`` joined to ``dim`` on ``fact_key = dim_key``; ``dim_key`` dropped."""
    side = F.broadcast(dim) if fits_broadcast(dim, max_bytes) else dim
    joined = fact.join(side, fact[fact_key] == side[dim_key], how)
    return joined.drop(side[dim_key])
