"""Queries for projection / recode / predicate operators (§2.2) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavekit.functions.scalars import attach
from wavekit.operators import profile, recode
from wavekit.plans import fixtures as fx
from wavekit.plans.registry import register
from wavekit.plans.views import with_views

ALL_RAW = (
    "respondent_id, wave, form, nicotine12, sex_raw, race, region, marijuana12, alcohol12, cigarette12, survey_weight"
)


def _nonull(spark, d):
    return recode.sentinel_to_null(fx.survey_raw(spark, d))


@register("sentinel_to_null", with_views(f"SELECT {ALL_RAW} FROM survey_nonull", "survey_nonull"))
def q_sentinel_to_null(spark, d):
    return _nonull(spark, d)


@register(
    "dichotomize",
    with_views(
        """SELECT respondent_id,
       CASE WHEN nicotine12 = 1 THEN CAST(0 AS DOUBLE) WHEN nicotine12 >= 2 THEN CAST(1 AS DOUBLE) END AS nicotine12d,
       CASE WHEN nicotine12 BETWEEN 1 AND 6 THEN CAST(1 AS DOUBLE) WHEN nicotine12 = 7 THEN CAST(0 AS DOUBLE) END AS nicotine12f
FROM survey_nonull""",
        "survey_nonull",
    ),
)
def q_dichotomize(spark, d):
    df = _nonull(spark, d).select("respondent_id", "nicotine12")
    df = recode.dichotomize(df, "nicotine12", "nicotine12f", coding="frequency", drop_src=False)
    df = recode.dichotomize(df, "nicotine12", "nicotine12d")
    return df


@register(
    "recode_map",
    with_views(
        """SELECT respondent_id,
       CAST(CASE sex_raw WHEN 1 THEN 0 WHEN 2 THEN 1 END AS INT) AS sex,
       CAST(sex_raw = 2 AS INT) AS female,
       CAST(CASE region WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE region END AS INT) AS region_grouped
FROM survey_nonull""",
        "survey_nonull",
    ),
)
def q_recode_map(spark, d):
    df = _nonull(spark, d).select("respondent_id", "sex_raw", "region")
    df = recode.indicator(df, "sex_raw", 2, "female")
    df = recode.recode_map(df, "region", {1: 10, 2: 20}, "region_grouped", passthrough=True)
    df = recode.recode_map(df, "sex_raw", {1: 0, 2: 1}, "sex")
    return df.drop("region")


@register(
    "filter_complete",
    with_views(
        """SELECT respondent_id, wave, y FROM survey_clean
WHERE marijuana12 IS NOT NULL AND alcohol12 IS NOT NULL AND cigarette12 IS NOT NULL
  AND survey_weight IS NOT NULL AND wave BETWEEN 1993 AND 1997""",
        "survey_clean",
    ),
)
def q_filter_complete(spark, d):
    df = recode.filter_complete(fx.survey_clean(spark, d), ["marijuana12", "alcohol12", "cigarette12", "survey_weight"])
    return df.where(F.col("wave").between(1993, 1997)).select("respondent_id", "wave", "y")


@register(
    "drop_columns",
    with_views(
        "SELECT respondent_id, wave, nicotine12, sex_raw, race, region, alcohol12, cigarette12, survey_weight FROM survey_nonull",
        "survey_nonull",
    ),
)
def q_drop_columns(spark, d):
    return recode.drop_columns(_nonull(spark, d), ["form", "marijuana12", "not_a_column"])


RENAMES = {"marijuana12": "marijuana_12m", "alcohol12": "alcohol_12m", "cigarette12": "cigarette_12m", "sex_raw": "sex_code"}


@register(
    "rename_map",
    with_views(
        """SELECT respondent_id, wave, form, nicotine12, sex_raw AS sex_code, race, region,
       marijuana12 AS marijuana_12m, alcohol12 AS alcohol_12m, cigarette12 AS cigarette_12m, survey_weight
FROM survey_nonull""",
        "survey_nonull",
    ),
)
def q_rename_map(spark, d):
    return recode.rename_map(_nonull(spark, d), {**RENAMES, "absent": "ignored"})


# Fixed display labels (a dimension table; codes without a label fall back to the code).
VARIABLE_LABELS = [
    ("nicotine12", "Nicotine use, 12 months"),
    ("marijuana12", "Marijuana use, 12 months"),
    ("alcohol12", "Alcohol use, 12 months"),
    ("cigarette12", "Cigarette use, 12 months"),
    ("sex_raw", "Sex"),
]


def _labels_df(spark):
    return spark.createDataFrame(VARIABLE_LABELS, "variable string, label string")


def _labels_sql():
    rows = ", ".join(f"('{a}', '{b}')" for a, b in VARIABLE_LABELS)
    return f"(VALUES {rows}) AS lab(variable, label)"


@register(
    "label_lookup",
    with_views(
        f"""WITH mp AS (
  SELECT 'nicotine12' AS variable, CAST(count(*) - count(nicotine12) AS BIGINT) AS n_missing FROM survey_nonull
  UNION ALL SELECT 'sex_raw', CAST(count(*) - count(sex_raw) AS BIGINT) FROM survey_nonull
  UNION ALL SELECT 'marijuana12', CAST(count(*) - count(marijuana12) AS BIGINT) FROM survey_nonull
  UNION ALL SELECT 'alcohol12', CAST(count(*) - count(alcohol12) AS BIGINT) FROM survey_nonull
  UNION ALL SELECT 'cigarette12', CAST(count(*) - count(cigarette12) AS BIGINT) FROM survey_nonull
  UNION ALL SELECT 'survey_weight', CAST(count(*) - count(survey_weight) AS BIGINT) FROM survey_nonull)
SELECT mp.variable, mp.n_missing, coalesce(lab.label, mp.variable) AS display
FROM mp LEFT JOIN {_labels_sql()} ON mp.variable = lab.variable""",
        "survey_nonull",
    ),
)
def q_label_lookup(spark, d):
    cols = ["nicotine12", "sex_raw", "marijuana12", "alcohol12", "cigarette12", "survey_weight"]
    mp = profile.missing_profile(_nonull(spark, d), cols, only_missing=False).select("variable", "n_missing")
    return recode.label_lookup(mp, _labels_df(spark))


@register(
    "zscore",
    with_views(
        """SELECT respondent_id,
       (marijuana12 - avg(marijuana12) OVER ()) / stddev_samp(marijuana12) OVER () AS marijuana12_z,
       (alcohol12 - avg(alcohol12) OVER ()) / stddev_samp(alcohol12) OVER () AS alcohol12_z,
       (survey_weight - avg(survey_weight) OVER ()) / stddev_samp(survey_weight) OVER () AS survey_weight_z
FROM survey_clean""",
        "survey_clean",
    ),
)
def q_zscore(spark, d):
    cols = ["marijuana12", "alcohol12", "survey_weight"]
    return recode.zscore(fx.survey_clean(spark, d).select("respondent_id", *cols), cols).drop(*cols)


@register(
    "interaction_terms",
    with_views(
        """SELECT respondent_id, sex * wave AS sex_x_wave, marijuana12 * alcohol12 AS marijuana12_x_alcohol12,
       sex * survey_weight AS sex_x_survey_weight
FROM survey_clean""",
        "survey_clean",
    ),
)
def q_interaction_terms(spark, d):
    df = fx.survey_clean(spark, d)
    pairs = [("sex", "wave"), ("marijuana12", "alcohol12"), ("sex", "survey_weight")]
    return recode.interaction_terms(df, pairs).select(
        "respondent_id", "sex_x_wave", "marijuana12_x_alcohol12", "sex_x_survey_weight"
    )


@register(
    "period_terms",
    with_views(
        f"""SELECT respondent_id, CAST(wave > {fx.BREAK_YEAR} AS INT) AS post, CAST(wave - {fx.BREAK_YEAR} AS INT) AS time,
       CAST(CAST(wave > {fx.BREAK_YEAR} AS INT) * (wave - {fx.BREAK_YEAR}) AS INT) AS post_time
FROM survey_clean""",
        "survey_clean",
    ),
)
def q_period_terms(spark, d):
    return recode.period_terms(fx.survey_clean(spark, d), "wave", fx.BREAK_YEAR).select(
        "respondent_id", "post", "time", "post_time"
    )


@register(
    "dummies",
    with_views(
        """SELECT respondent_id,
       coalesce(CAST(contains(lower(race), 'build') AS INT), 0) AS race_build,
       coalesce(CAST(contains(lower(race), 'auto') AS INT), 0) AS race_auto,
       CAST(region = 1 AS INT) AS region_1, CAST(region = 3 AS INT) AS region_3,
       CAST(CASE race WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                      WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS INT) AS race_order
FROM survey_clean""",
        "survey_clean",
    ),
)
def q_dummies(spark, d):
    df = fx.survey_clean(spark, d).select("respondent_id", "race", "region")
    df = recode.dummies(df, "race", ["Build", "AUTO"], contains=True)
    df = recode.dummies(df, "region", [1, 3])
    df = recode.ordered_category(df, "race", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return df.drop("race", "region")


@register(
    "missing_indicators",
    with_views(
        """SELECT respondent_id,
       CAST(nicotine12 IS NULL AS INT) AS missing_nicotine12, CAST(sex_raw IS NULL AS INT) AS missing_sex_raw,
       CAST(marijuana12 IS NULL AS INT) AS missing_marijuana12, CAST(alcohol12 IS NULL AS INT) AS missing_alcohol12,
       CAST(cigarette12 IS NULL AS INT) AS missing_cigarette12, CAST(survey_weight IS NULL AS INT) AS missing_survey_weight
FROM survey_nonull""",
        "survey_nonull",
    ),
)
def q_missing_indicators(spark, d):
    df = _nonull(spark, d)
    feats = [c for c in df.columns if c != "respondent_id"]
    out = recode.missing_indicators(df, feats, only_with_nulls=True)
    return out.select("respondent_id", *[c for c in out.columns if c.startswith("missing_")])


@register(
    "weight_normalize",
    with_views(
        """SELECT respondent_id, coalesce(survey_weight, avg(survey_weight) OVER ()) / avg(survey_weight) OVER () AS weight
FROM survey_clean""",
        "survey_clean",
    ),
)
def q_weight_normalize(spark, d):
    return recode.weight_normalize(fx.survey_clean(spark, d), "survey_weight", "weight").select("respondent_id", "weight")


@register(
    "target_encode",
    with_views(
        """SELECT respondent_id, race, CAST(dense_rank() OVER (ORDER BY race) - 1 AS INT) AS race_code,
       CAST(y AS INT) AS y_code
FROM survey_clean""",
        "survey_clean",
    ),
)
def q_target_encode(spark, d):
    df = fx.survey_clean(spark, d).select("respondent_id", "race", "y")
    df, _ = recode.target_encode(df, "race")
    df, _ = recode.target_encode(df, "y", "y_code")
    return df.drop("y")


@register(
    "sanitize_labels",
    with_views(
        "SELECT respondent_id, 'C' || replace(CAST(nicotine12 AS VARCHAR), '-', 'neg') AS class_label FROM survey",
        "survey",
    ),
)
def q_sanitize_labels(spark, d):
    df = fx.survey_raw(spark, d).select("respondent_id", "nicotine12")
    return recode.sanitize_labels(df, "nicotine12", "class_label").drop("nicotine12")


FEATURES = ["wave", "form", "nicotine12", "sex_raw", "race", "region", "marijuana12", "alcohol12", "cigarette12", "survey_weight"]


def _infer_sql():
    parts = []
    for c in FEATURES:
        kind = (
            "'categorical'"
            if c in ("form", "race")
            else f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'numeric' END"
        )
        parts.append(f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS n_distinct, {kind} AS kind FROM survey_nonull")
    return with_views("\nUNION ALL ".join(parts), "survey_nonull")


@register("infer_feature_types", _infer_sql())
def q_infer_feature_types(spark, d):
    from wavekit.operators import prep

    return prep.infer_feature_types(_nonull(spark, d), FEATURES)


def _varying_sql():
    parts = [
        f"SELECT '{c}' AS variable, CAST({i} AS INT) AS position, count(DISTINCT {c}) AS n_distinct FROM survey_nonull"
        for i, c in enumerate(FEATURES)
    ]
    return with_views(
        "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE n_distinct >= 2 ORDER BY position LIMIT 10",
        "survey_nonull",
    )


@register("varying_columns", _varying_sql())
def q_varying_columns(spark, d):
    from wavekit.operators import prep

    return prep.varying_columns(_nonull(spark, d), FEATURES, k=10)


@register(
    "resolve_columns",
    with_views("SELECT respondent_id, sex_raw, alcohol12, survey_weight FROM survey_nonull", "survey_nonull"),
)
def q_resolve_columns(spark, d):
    df = _nonull(spark, d)
    present, _missing = recode.resolve_columns(
        df, ["respondent_id", ("sex", "sex_raw"), "alcohol12", "female", ("weight", "survey_weight", "ARCHIVE_WT")]
    )
    return df.select(*present)


def _or_by_region_sql():
    return with_views(
        """WITH g AS (SELECT region, avg(y) AS p FROM survey_clean GROUP BY region),
tot AS (SELECT avg(y) AS p0 FROM survey_clean),
o AS (SELECT region, (p / (1 - p)) / (p0 / (1 - p0)) AS odds_ratio FROM g, tot)
SELECT region, odds_ratio,
       CASE WHEN odds_ratio > 1 THEN 'Increases risk' WHEN odds_ratio < 1 THEN 'Decreases risk' ELSE 'No effect' END AS direction,
       CASE WHEN greatest(odds_ratio, 1 / odds_ratio) > 1.15 THEN 'Large'
            WHEN greatest(odds_ratio, 1 / odds_ratio) > 1.05 THEN 'Medium'
            WHEN greatest(odds_ratio, 1 / odds_ratio) > 1.01 THEN 'Small' ELSE 'Trivial' END AS effect_size
FROM o""",
        "survey_clean",
    )


def _odds_ratio_by(spark, d, by):
    df = fx.survey_clean(spark, d)
    g = df.groupBy(by).agg(F.avg("y").alias("p"))
    tot = df.agg(F.avg("y").alias("p0"))
    return attach(g, tot).select(
        by, ((F.col("p") / (1 - F.col("p"))) / (F.col("p0") / (1 - F.col("p0")))).alias("odds_ratio")
    )


@register("classify_effect", _or_by_region_sql())
def q_classify_effect(spark, d):
    return recode.classify_effect(_odds_ratio_by(spark, d, "region"), "odds_ratio")


@register(
    "assess_threshold",
    with_views(
        """SELECT wave, avg(y) AS prevalence, stddev_samp(y) / avg(y) * 100 AS cv_pct,
       CASE WHEN stddev_samp(y) / avg(y) * 100 < 10 THEN 'very stable' WHEN stddev_samp(y) / avg(y) * 100 < 25 THEN 'stable'
            WHEN stddev_samp(y) / avg(y) * 100 < 50 THEN 'moderate' ELSE 'unstable' END AS assessment
FROM survey_clean GROUP BY wave""",
        "survey_clean",
    ),
)
def q_assess_threshold(spark, d):
    df = fx.survey_clean(spark, d).groupBy("wave").agg(
        F.avg("y").alias("prevalence"), (F.stddev_samp("y") / F.avg("y") * 100).alias("cv_pct")
    )
    return recode.assess_threshold(df, "cv_pct", [(10, "very stable"), (25, "stable"), (50, "moderate")], "unstable")
