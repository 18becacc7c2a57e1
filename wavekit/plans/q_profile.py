"""Queries for aggregation and profiling operators (§2.4) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavekit.operators import profile, recode
from wavekit.plans import fixtures as fx
from wavekit.plans.registry import register
from wavekit.plans.views import with_views

NUM_RAW = ["wave", "nicotine12", "sex_raw", "region", "marijuana12", "alcohol12", "cigarette12", "survey_weight"]
ALL_NONULL = ["wave", "form", "nicotine12", "sex_raw", "race", "region", "marijuana12", "alcohol12", "cigarette12", "survey_weight"]


def _nonull(spark, d):
    return recode.sentinel_to_null(fx.survey_raw(spark, d))


def _union(parts):
    return "\nUNION ALL ".join(parts)


@register(
    "frequency_table",
    with_views(
        """SELECT wave, nicotine12, count(*) AS n,
       CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY wave) AS percent
FROM survey_nonull GROUP BY wave, nicotine12""",
        "survey_nonull",
    ),
)
def q_frequency_table(spark, d):
    return profile.frequency_table(_nonull(spark, d), "nicotine12", by=["wave"])


@register(
    "value_counts",
    with_views(
        """SELECT alcohol12, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
FROM survey_clean GROUP BY alcohol12 ORDER BY n DESC, alcohol12 ASC NULLS LAST LIMIT 5""",
        "survey_clean",
    ),
)
def q_value_counts(spark, d):
    return profile.value_counts(fx.survey_clean(spark, d), "alcohol12", normalize=True, top=5)


def _dataset_summary_sql():
    cols = [c for c in ALL_NONULL if c != "wave"] + ["respondent_id"]
    miss = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)
    return with_views(
        f"""SELECT wave, count(*) AS n_rows, CAST({len(cols)} AS INT) AS n_columns, CAST(8 AS INT) AS n_numeric,
       CAST(2 AS INT) AS n_categorical, CAST(sum({miss}) AS BIGINT) AS n_missing_cells
FROM survey_nonull GROUP BY wave""",
        "survey_nonull",
    )


@register("dataset_summary", _dataset_summary_sql())
def q_dataset_summary(spark, d):
    return profile.dataset_summary(_nonull(spark, d), "wave")


PROFILE_COLS = ["nicotine12", "region", "marijuana12", "alcohol12", "cigarette12", "survey_weight"]


def _column_profile_sql():
    parts = [
        f"""SELECT '{c}' AS variable, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
       quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75,
       CAST(max({c}) AS DOUBLE) AS max, count(DISTINCT {c}) AS n_distinct FROM survey_nonull"""
        for c in PROFILE_COLS
    ]
    return with_views(_union(parts), "survey_nonull")


@register("column_profile", _column_profile_sql())
def q_column_profile(spark, d):
    return profile.column_profile(_nonull(spark, d), PROFILE_COLS)


DUP_COLS = ["wave", "sex", "race", "region", "marijuana12", "alcohol12", "cigarette12", "y"]


@register(
    "duplicate_rows",
    with_views(
        f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS n FROM survey_clean GROUP BY {", ".join(DUP_COLS)})""",
        "survey_clean",
    ),
)
def q_duplicate_rows(spark, d):
    return profile.duplicate_rows(fx.survey_clean(spark, d), DUP_COLS)


def _missing_profile_sql():
    parts = [
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, count(*) AS n_rows FROM survey_nonull"
        for c in ALL_NONULL
    ]
    return with_views(
        f"""SELECT variable, n_missing, round(CAST(100 AS DOUBLE) * n_missing / n_rows, 2) AS pct_missing,
       (CAST(100 AS DOUBLE) * n_missing / n_rows > 0 AND CAST(100 AS DOUBLE) * n_missing / n_rows < 10) AS impute_target
FROM ({_union(parts)}) WHERE n_missing > 0""",
        "survey_nonull",
    )


@register("missing_profile", _missing_profile_sql())
def q_missing_profile(spark, d):
    return profile.missing_profile(_nonull(spark, d), ALL_NONULL)


def _negative_sql():
    parts = [f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} < 0) AS n_negative FROM survey" for c in NUM_RAW]
    return with_views(f"SELECT * FROM ({_union(parts)}) WHERE n_negative > 0", "survey")


@register("negative_counts", _negative_sql())
def q_negative_counts(spark, d):
    return profile.negative_counts(fx.survey_raw(spark, d), NUM_RAW)


OUTLIER_COLS = ["marijuana12", "alcohol12", "cigarette12", "survey_weight", "region"]


def _outlier_sql():
    parts = [
        f"""SELECT '{c}' AS variable, count(*) FILTER (WHERE abs({c} - m) > 3 * s) AS n_outliers
FROM survey_clean, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM survey_clean)"""
        for c in OUTLIER_COLS
    ]
    return with_views(f"SELECT * FROM ({_union(parts)}) WHERE n_outliers > 0", "survey_clean")


@register("outlier_counts", _outlier_sql())
def q_outlier_counts(spark, d):
    return profile.outlier_counts(fx.survey_clean(spark, d), OUTLIER_COLS)


PREV_SQL = """SELECT {by}, avg(y) AS prevalence, count(y) AS n, stddev_samp(y) AS sd,
       stddev_samp(y) / sqrt(count(y)) AS se,
       avg(y) - 1.96 * stddev_samp(y) / sqrt(count(y)) AS ci_lower,
       avg(y) + 1.96 * stddev_samp(y) / sqrt(count(y)) AS ci_upper
FROM survey_clean GROUP BY {by}"""


@register("prevalence_by", with_views(PREV_SQL.format(by="wave, sex"), "survey_clean"))
def q_prevalence_by(spark, d):
    return profile.prevalence_by(fx.survey_clean(spark, d), "y", ["wave", "sex"])


@register(
    "prevalence_by_weighted",
    with_views(
        """SELECT wave, sum(survey_weight * y) / sum(survey_weight) AS prevalence, count(y) AS n, stddev_samp(y) AS sd,
       stddev_samp(y) / sqrt(count(y)) AS se,
       sum(survey_weight * y) / sum(survey_weight) - 1.96 * stddev_samp(y) / sqrt(count(y)) AS ci_lower,
       sum(survey_weight * y) / sum(survey_weight) + 1.96 * stddev_samp(y) / sqrt(count(y)) AS ci_upper
FROM survey_clean WHERE survey_weight IS NOT NULL GROUP BY wave""",
        "survey_clean",
    ),
)
def q_prevalence_by_weighted(spark, d):
    return profile.prevalence_by(fx.survey_clean(spark, d), "y", ["wave"], weight="survey_weight")


@register(
    "suppress_small_cells",
    with_views(
        """SELECT wave, race, alcohol12, count(y) AS n,
       CASE WHEN count(y) >= 5 THEN avg(y) END AS prevalence,
       CASE WHEN count(y) >= 5 THEN stddev_samp(y) END AS sd,
       count(y) < 5 AS suppressed
FROM survey_clean GROUP BY wave, race, alcohol12""",
        "survey_clean",
    ),
)
def q_suppress_small_cells(spark, d):
    g = profile.prevalence_by(fx.survey_clean(spark, d), "y", ["wave", "race", "alcohol12"])
    return profile.suppress_small_cells(g, "n", ["prevalence", "sd"]).select(
        "wave", "race", "alcohol12", "n", "prevalence", "sd", "suppressed"
    )


PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@register(
    "quantiles",
    with_views(
        # order statistics and the interpolation spelled out: values tie at the sixth digit, which quantile_cont's
        # fused arithmetic rounds the other way
        f"""WITH o AS (SELECT wave, survey_weight AS v, row_number() OVER (PARTITION BY wave ORDER BY survey_weight) - 1 AS i,
           count(*) OVER (PARTITION BY wave) AS n FROM survey_clean WHERE survey_weight IS NOT NULL),
p AS (SELECT wave, v, i, prob, (n - 1) * prob AS pos FROM o, (SELECT CAST(unnest({PROBS}) AS DOUBLE) AS prob)),
s AS (SELECT wave, prob, any_value(pos) - floor(any_value(pos)) AS d, max(v) FILTER (WHERE i = floor(pos)) AS lo,
             max(v) FILTER (WHERE i = floor(pos) + 1) AS hi FROM p GROUP BY wave, prob)
SELECT wave, prob, CASE WHEN hi IS NULL OR d = 0 THEN lo ELSE lo * (1 - d) + hi * d END AS value FROM s""",
        "survey_clean",
    ),
)
def q_quantiles(spark, d):
    return profile.quantiles(fx.survey_clean(spark, d), "survey_weight", PROBS, by=["wave"])


@register(
    "histogram",
    with_views(
        """WITH r AS (SELECT min(survey_weight) AS lo, max(survey_weight) AS hi FROM survey_clean),
b AS (SELECT y, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((survey_weight - lo) / ((hi - lo) / 30)), 29) END AS INT) AS bin,
             lo, hi
      FROM survey_clean, r WHERE survey_weight IS NOT NULL)
SELECT y, bin, count(*) AS n, min(lo) + bin * (min(hi) - min(lo)) / 30 AS lo, min(lo) + (bin + 1) * (min(hi) - min(lo)) / 30 AS hi
FROM b GROUP BY y, bin""",
        "survey_clean",
    ),
)
def q_histogram(spark, d):
    return profile.histogram(fx.survey_clean(spark, d), "survey_weight", 30, by=["y"])


def _cell_scores(spark, d):
    """Prevalence per (wave, region): a small score table derived from the data."""
    return fx.survey_clean(spark, d).groupBy("wave", "region").agg(F.avg("y").alias("score"))


CELL_SQL = "cells AS (SELECT wave, region, avg(y) AS score FROM survey_clean GROUP BY wave, region)"


@register(
    "minmax_metrics",
    with_views(
        f"""WITH {CELL_SQL}
SELECT wave, region, score, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score_scaled
FROM cells""",
        "survey_clean",
    ),
)
def q_minmax_metrics(spark, d):
    return profile.minmax_metrics(_cell_scores(spark, d), ["score"])


@register(
    "mean_sd_curve",
    with_views(
        f"""WITH {CELL_SQL}
SELECT wave, avg(score) AS mean_score, stddev_pop(score) AS sd_score, count(score) AS n FROM cells GROUP BY wave""",
        "survey_clean",
    ),
)
def q_mean_sd_curve(spark, d):
    return profile.mean_sd_curve(_cell_scores(spark, d), "wave", "score")


@register(
    "robustness_summary",
    with_views(
        f"""WITH {CELL_SQL}
SELECT region, avg(score) AS mean, stddev_samp(score) AS sd, min(score) AS min, max(score) AS max,
       max(score) - min(score) AS range, quantile_cont(score, 0.025) AS q025, quantile_cont(score, 0.975) AS q975,
       count(score) AS n
FROM cells GROUP BY region""",
        "survey_clean",
    ),
)
def q_robustness_summary(spark, d):
    return profile.robustness_summary(_cell_scores(spark, d), "score", by=["region"])
