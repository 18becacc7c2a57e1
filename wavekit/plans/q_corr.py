"""Queries for correlation (§2.4) and data-driven feature selection (§2.2)."""

from __future__ import annotations

from wavekit.operators import correlation, recode
from wavekit.plans import fixtures as fx
from wavekit.plans.registry import register
from wavekit.plans.views import with_views
from wavekit.session import written

COR_COLS = ["wave", "sex", "region", "marijuana12", "alcohol12", "cigarette12", "survey_weight", "y"]
PAIRS = [(a, b) for i, a in enumerate(COR_COLS) for b in COR_COLS[i + 1:]]


def _u(parts):
    return "\nUNION ALL ".join(parts)


def _pearson_sql():
    return _u(
        f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM survey_clean"
        for a, b in PAIRS
    )


def _spearman_sql(cols_pairs=PAIRS):
    return _u(
        f"""SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, corr(ra, rb) AS rho FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM survey_clean WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in cols_pairs
    )


def _kendall_sql():
    parts = []
    for a, b in PAIRS:
        parts.append(
            f"""SELECT '{a}' AS var1, '{b}' AS var2, t.n, coalesce(cd.cmd, 0) / sqrt((t.n * (t.n - 1) / 2 - t.ta) * (t.n * (t.n - 1) / 2 - u.tb)) AS tau_b
FROM (SELECT sum(m) AS n, sum(m * (m - 1) / 2) AS ta FROM (SELECT count(*) AS m FROM survey_clean
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a})) t,
     (SELECT sum(m * (m - 1) / 2) AS tb FROM (SELECT count(*) AS m FROM survey_clean
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {b})) u,
     (SELECT sum(sign(c2.b - c1.b) * c1.n * c2.n) AS cmd
      FROM (SELECT {a} AS a, {b} AS b, count(*) AS n FROM survey_clean WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}) c1
      JOIN (SELECT {a} AS a, {b} AS b, count(*) AS n FROM survey_clean WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}) c2
        ON c1.a < c2.a) cd"""
        )
    return with_views(
        "SELECT var1, var2, CAST(n AS BIGINT) AS n, CAST(tau_b AS DOUBLE) AS tau_b FROM (" + _u(parts) + ")", "survey_clean"
    )


@register("correlation_pearson", with_views(_pearson_sql(), "survey_clean"))
def q_correlation_pearson(spark, d):
    return correlation.pearson(fx.survey_clean(spark, d), COR_COLS)


@register("correlation_spearman", with_views(_spearman_sql(), "survey_clean"))
def q_correlation_spearman(spark, d):
    return correlation.spearman(fx.survey_clean(spark, d), COR_COLS)


@register("correlation_kendall", _kendall_sql())
def q_correlation_kendall(spark, d):
    return correlation.kendall(fx.survey_clean(spark, d), COR_COLS)


@register(
    "correlation_matrix",
    with_views(
        f"""WITH h AS ({_pearson_sql()})
SELECT var1, var2, CASE WHEN isnan(r) OR r IS NULL THEN 0 ELSE r END AS r FROM (
  SELECT var1, var2, r FROM h UNION ALL SELECT var2, var1, r FROM h
  UNION ALL SELECT c, c, CAST(1 AS DOUBLE) FROM (SELECT unnest({COR_COLS}) AS c))""",
        "survey_clean",
    ),
)
def q_correlation_matrix(spark, d):
    return correlation.correlation_matrix(fx.survey_clean(spark, d), COR_COLS, "pearson")


@register(
    "corr_pairs",
    with_views(f"SELECT * FROM ({_spearman_sql()}) WHERE abs(rho) > 0.5 AND abs(rho) < 1", "survey_clean"),
)
def q_corr_pairs(spark, d):
    return correlation.corr_pairs(correlation.spearman(fx.survey_clean(spark, d), COR_COLS), "rho", 0.5, 1.0)


SEL_COLS = ["wave", "nicotine12", "sex_raw", "region", "marijuana12", "alcohol12", "cigarette12", "survey_weight"]
SEL_PAIRS = [(a, b) for i, a in enumerate(SEL_COLS) for b in SEL_COLS[i + 1:]]


def _select_sql():
    prof = _u(
        f"SELECT '{c}' AS variable, {i} AS position, (count(*) - count({c})) / count(*) AS missing_share, "
        f"count(DISTINCT {c}) AS n_distinct FROM survey_nonull"
        for i, c in enumerate(SEL_COLS)
    )
    sp = _u(
        f"""SELECT '{b}' AS variable, corr(ra, rb) AS rho FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM survey_nonull WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in SEL_PAIRS
    )
    return with_views(
        f"""WITH p AS ({prof}), s AS (SELECT DISTINCT variable FROM ({sp}) WHERE abs(rho) > 0.5),
r AS (SELECT p.variable, CAST(p.position AS INT) AS position, p.missing_share, p.n_distinct,
             CASE WHEN p.variable IN ('nicotine12') THEN 'leakage' WHEN p.missing_share > 0.7 THEN 'missing'
                  WHEN p.n_distinct < 2 THEN 'zero_variance' WHEN s.variable IS NOT NULL THEN 'correlated' ELSE 'kept' END AS reason
      FROM p LEFT JOIN s ON p.variable = s.variable)
SELECT *, reason = 'kept' AS keep FROM r""",
        "survey_nonull",
    )


@register("select_features", _select_sql())
def q_select_features(spark, d):
    df = written(recode.sentinel_to_null(fx.survey_raw(spark, d)).select(*SEL_COLS))
    return correlation.select_features(df, SEL_COLS, 0.70, 0.5, leakage=["nicotine12"])
