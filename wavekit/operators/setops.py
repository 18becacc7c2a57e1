"""Set operations over sources and pivots of result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_common(frames: Sequence[DataFrame]) -> DataFrame:
    """Keep the columns present in every source (in the first source's order), stack rows."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(DataFrame.unionByName, [f.select(*common) for f in frames])


def union_fill(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack rows; a column absent from a source is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_ranked(pairs: DataFrame, triples: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """Stack a pair table (f1, f2) and a triple table (f1, f2, f3) with f3 NULL for pairs, re-rank by value."""
    from pyspark.sql import Window

    p = pairs.withColumn("f3", F.lit(None).cast("string")).withColumn("order", F.lit(2))
    t = triples.withColumn("order", F.lit(3))
    both = p.unionByName(t)
    out = both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "f1", "f2", F.asc_nulls_first("f3"))))
    return out.where(F.col("rank") <= k) if k else out


def models_of(coefs: DataFrame, model: str = "model") -> list[str]:
    """The models of a coefficient table, in order (a result table: one value per fitted model)."""
    return sorted(r[0] for r in coefs.select(model).distinct().collect() if r[0] is not None)


def predictor_presence(coefs: DataFrame, models: Sequence[str] | None = None, alpha: float = 0.05, variable: str = "variable",
                       model: str = "model") -> DataFrame:
    """Predictor × model matrix: 0 absent, 1 present, 2 significant (p < alpha). ``models``: the pivot values
    (default: all of the table's)."""
    models = list(models) if models is not None else models_of(coefs, model)
    status = coefs.select(variable, model, F.when(F.col("p_value") < alpha, 2).otherwise(1).alias("status"))
    return status.groupBy(variable).pivot(model, list(models)).agg(F.max("status")).fillna(0, subset=list(models))


def key_pivot(coefs: DataFrame, models: Sequence[str] | None = None, variable: str = "variable", model: str = "model") -> DataFrame:
    """Predictor × model pivots of β (absent → 0) and of log2 OR (absent OR → 1, i.e. 0), with Σ|β| for ordering."""
    models = list(models) if models is not None else models_of(coefs, model)
    beta = coefs.groupBy(variable).pivot(model, models).agg(F.first("beta")).fillna(0.0, subset=models)
    beta = beta.select(variable, *[F.col(m).alias(f"beta_{m}") for m in models])
    orp = coefs.groupBy(variable).pivot(model, models).agg(F.first("odds_ratio")).fillna(1.0, subset=models)
    orp = orp.select(variable, *[F.log2(F.col(m)).alias(f"log2_or_{m}") for m in models])
    out = beta.join(orp, variable)
    return out.withColumn("sum_abs_beta", reduce(lambda a, b: a + b, [F.abs(F.col(f"beta_{m}")) for m in models]))
