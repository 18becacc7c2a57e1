"""Flagship query: survey view → recode → complete cases → prevalence by wave, joined with the fitted
curve of the interrupted-series logit (pre-trend, level change, slope change at the break).

Plan: ONE pass over the respondent rows collapses them to wave cells (n, Σy, Σy²) with map-side partial
aggregation; prevalence, its standard error and the logit (frequency-weighted cells: the predictors are
functions of the wave) all run on those few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavekit.operators import models, recode
from wavekit.plans import fixtures as fx


def flagship(spark: SparkSession, data_dir: str, z: float = 1.96) -> DataFrame:
    clean = fx.survey_clean(spark, data_dir)
    cells = (
        clean.where(F.col("y").isNotNull())
        .groupBy("wave")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"), F.sum(F.col("y") * F.col("y")).alias("sum_y2"))
        .checkpoint()  # a handful of rows; reused by both branches below without re-reading the survey
    )
    n, s1, s2 = F.col("n"), F.col("sum_y"), F.col("sum_y2")
    sd = F.sqrt(F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0)))
    prev = cells.select(
        "wave", (s1 / n).alias("prevalence"), n, sd.alias("sd"), (sd / F.sqrt(n)).alias("se")
    ).withColumn("ci_lower", F.col("prevalence") - z * F.col("se")).withColumn("ci_upper", F.col("prevalence") + z * F.col("se"))
    timed = recode.period_terms(cells.withColumn("rate", s1 / n), "wave", fx.BREAK_YEAR)
    its = models.logit(timed, "rate", ["time", "post", "post_time"], weight="n", model="its")
    fitted = timed.select("wave", "post", its.probability().alias("its_fitted"))
    return prev.join(fitted, "wave").withColumn("residual", F.col("prevalence") - F.col("its_fitted"))
