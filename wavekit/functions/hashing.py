"""Portable pseudo-randomness: md5 of ``id ‖ ':' ‖ seed`` orders rows identically in Spark and
in any SQL engine with md5, independent of partitioning, task retries or executor loss."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(id_col, seed, *extra) -> Column:
    """Hex md5 of 'id:seed[:extra…]'."""
    parts = [F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(":"),
             F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    for e in extra:
        parts += [F.lit(":"), e.cast("string") if isinstance(e, Column) else F.lit(str(e))]
    return F.md5(F.concat(*parts))


def hash_uniform(id_col, seed, *extra) -> Column:
    """Uniform [0, 1) from the first 8 hex digits of the md5 key."""
    h = hash_key(id_col, seed, *extra)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson1_cutpoints(k_max: int = 12) -> list[float]:
    """CDF of Poisson(1) at 0..k_max (computed from the rule e^{-1} Σ 1/i!)."""
    out, acc = [], 0.0
    for i in range(k_max + 1):
        acc += math.exp(-1.0) / math.factorial(i)
        out.append(acc)
    return out


def poisson1_weight(u: Column, k_max: int = 12) -> Column:
    """Inverse-CDF Poisson(1) draw from a uniform Column (bootstrap multiplicity)."""
    cuts = poisson1_cutpoints(k_max)
    expr = None
    for k, c in enumerate(cuts):
        expr = F.when(u < c, F.lit(k)) if expr is None else expr.when(u < c, F.lit(k))
    return expr.otherwise(F.lit(k_max + 1)).cast("int")
