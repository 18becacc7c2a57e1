"""Queries for logit fits and inference tables (§2.8, §2.9) with Newton / closed-form SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavekit.functions.scalars import attach
from wavekit.operators import inference, models, recode
from wavekit.plans import fixtures as fx
from wavekit.plans.newton_sql import Z95, chi2_sf_sql, coef_rows, newton_ctes, newton_multi, two_sided_p_sql, wald_cols
from wavekit.plans.registry import register
from wavekit.plans.views import with_views

B = fx.BREAK_YEAR
COEF_COLS = "model, variable, beta, se"


def timed(spark, d) -> DataFrame:
    """survey_clean with period terms (time = wave − break, post, post·time) and normalised weight."""
    df = recode.period_terms(fx.survey_clean(spark, d), "wave", B)
    return recode.weight_normalize(df, "survey_weight", "weight")


TIMED_SQL = f"""SELECT *, CAST(wave > {B} AS INT) AS post, CAST(wave - {B} AS INT) AS time,
       CAST(CAST(wave > {B} AS INT) * (wave - {B}) AS INT) AS post_time,
       coalesce(survey_weight, avg(survey_weight) OVER ()) / avg(survey_weight) OVER () AS weight
FROM survey_clean"""


def _sql(body: str, *ctes: str) -> str:
    """Oracle SQL: fixture views + the timed view + extra CTEs, then the body."""
    extra = ",\n".join(ctes)
    inner = f"WITH timed AS ({TIMED_SQL})" + (f",\n{extra}" if extra else "") + f"\n{body}"
    return with_views(inner, "survey_clean")


def _cells(name: str, where: str = "TRUE", g: str = "1", weight: str | None = None) -> str:
    w = f"CAST({weight} AS DOUBLE)" if weight else "CAST(1 AS DOUBLE)"
    cond = f"({where})" + (f" AND {weight} IS NOT NULL" if weight else "")
    return (
        f"{name} AS (SELECT {g} AS g, CAST(time AS DOUBLE) AS x, count(*) AS n, sum({w}) AS w, sum({w} * y) AS wy "
        f"FROM timed WHERE {cond} GROUP BY {g}, time)"
    )


def _fit_time(spark, d, where=None, weight=None, model="time"):
    df = timed(spark, d)
    if where is not None:
        df = df.where(where)
    return models.logit(df, "y", ["time"], weight=weight, model=model)


# ------------------------------------------------------------------ single fits


@register(
    "logit_mle",
    _sql(f"SELECT *, {wald_cols()} FROM ({coef_rows('m_fit', 'time', 'time')})", _cells("c"), newton_ctes("c", "m")),
)
def q_logit_mle(spark, d):
    return _fit_time(spark, d).coefficients


@register(
    "logit_weighted",
    _sql(
        f"SELECT *, {wald_cols()} FROM ({coef_rows('m_fit', 'time', 'time_weighted')})",
        _cells("c", weight="weight"),
        newton_ctes("c", "m"),
    ),
)
def q_logit_weighted(spark, d):
    return _fit_time(spark, d, weight="weight", model="time_weighted").coefficients


@register(
    "null_model",
    _sql(
        """SELECT wave, count(*) AS n_obs, CAST(count(*) AS DOUBLE) AS sum_w, sum(y) AS sum_wy, avg(y) AS p0,
       ln(avg(y) / (1 - avg(y))) AS intercept,
       sum(y) * ln(avg(y)) + (count(*) - sum(y)) * ln(1 - avg(y)) AS null_loglik
FROM timed GROUP BY wave"""
    ),
)
def q_null_model(spark, d):
    return models.null_model(timed(spark, d), "y", by=["wave"])


FIT_STATS_BODY = """SELECT '{model}' AS model, n_obs, CAST(2 AS INT) AS n_params, loglik,
       sum_wy * ln(sum_wy / sum_w) + (sum_w - sum_wy) * ln(1 - sum_wy / sum_w) AS null_loglik, sum_w,
       4 - 2 * loglik AS aic, 2 * ln(n_obs) - 2 * loglik AS bic,
       1 - loglik / (sum_wy * ln(sum_wy / sum_w) + (sum_w - sum_wy) * ln(1 - sum_wy / sum_w)) AS mcfadden_r2
FROM m_fit"""


@register("fit_stats", _sql(FIT_STATS_BODY.format(model="time"), _cells("c"), newton_ctes("c", "m")))
def q_fit_stats(spark, d):
    return _fit_time(spark, d).stats


@register(
    "lr_test",
    _sql(
        f"""SELECT model, model_no, n_params, loglik,
       2 * (loglik - lag(loglik) OVER (ORDER BY model_no)) AS lr_stat,
       CAST(n_params - lag(n_params) OVER (ORDER BY model_no) AS INT) AS lr_df,
       {chi2_sf_sql('2 * (loglik - lag(loglik) OVER (ORDER BY model_no))', 'n_params - lag(n_params) OVER (ORDER BY model_no)')} AS lr_p
FROM fits""",
        _cells("c"),
        newton_ctes("c", "m"),
        """cw AS (SELECT wave, count(*) AS w, sum(y) AS wy FROM timed GROUP BY wave)""",
        """fits AS (
  SELECT 'null' AS model, CAST(1 AS INT) AS model_no, CAST(1 AS INT) AS n_params,
         sum(y) * ln(avg(y)) + (count(*) - sum(y)) * ln(1 - avg(y)) AS loglik FROM timed
  UNION ALL SELECT 'time', 2, 2, loglik FROM m_fit
  UNION ALL SELECT 'wave_saturated', 3, CAST((SELECT count(*) FROM cw) AS INT),
         sum(CASE WHEN wy > 0 THEN wy * ln(wy / w) ELSE 0 END + CASE WHEN w > wy THEN (w - wy) * ln(1 - wy / w) ELSE 0 END)
  FROM cw)""",
    ),
)
def q_lr_test(spark, d):
    df = timed(spark, d)
    null = models.null_model(df, "y").select(
        F.lit("null").alias("model"), F.lit(1).alias("model_no"), F.lit(1).alias("n_params"),
        F.col("null_loglik").alias("loglik"),
    )
    lin = models.logit(df, "y", ["time"], model="time").stats.select(
        "model", F.lit(2).alias("model_no"), "n_params", "loglik"
    )
    sat = models.saturated_loglik(df, "y", ["wave"]).select(
        F.lit("wave_saturated").alias("model"), F.lit(3).alias("model_no"), F.col("n_cells").cast("int").alias("n_params"),
        "loglik",
    )
    fits = null.unionByName(lin).unionByName(sat)
    return inference.lr_test(fits, "model_no").select("model", "model_no", "n_params", "loglik", "lr_stat", "lr_df", "lr_p")


def _segments_sql():
    return (
        _cells("cp"),
        newton_ctes("cp", "pooled"),
        _cells("cs", g=f"CAST(wave > {B} AS INT)"),
        newton_ctes("cs", "seg"),
    )


@register(
    "chow_test",
    _sql(
        f"""SELECT p.loglik AS ll_pooled, p.n_obs AS n_pooled, a.loglik AS ll_pre, a.n_obs AS n_pre,
       b.loglik AS ll_post, b.n_obs AS n_post,
       -2 * (p.loglik - a.loglik - b.loglik) AS chow_stat, CAST(2 AS INT) AS chow_df,
       {chi2_sf_sql('-2 * (p.loglik - a.loglik - b.loglik)', '2')} AS chow_p
FROM pooled_fit p, seg_fit a, seg_fit b WHERE a.g = 0 AND b.g = 1""",
        *_segments_sql(),
    ),
)
def q_chow_test(spark, d):
    df = timed(spark, d)
    pooled = models.logit(df, "y", ["time"], model="pooled").stats
    # both segments in one pass: cells per (segment, time), one Newton solve per segment
    _, seg = models.logit_by_group(df, "post", "y", ["time"], model="segment")
    seg = seg.persist()
    pre, post = seg.where(F.col("post") == 0), seg.where(F.col("post") == 1)
    return inference.chow_test(pooled, pre, post, k_predictors=1)


@register(
    "its",
    _sql(
        f"""SELECT *, {wald_cols()} FROM (
  SELECT 'its' AS model, 'intercept' AS variable, a.b0 AS beta, a.se0 AS se FROM seg_fit a WHERE a.g = 0
  UNION ALL SELECT 'its', 'time', a.b1, a.se1 FROM seg_fit a WHERE a.g = 0
  UNION ALL SELECT 'its', 'post', b.b0 - a.b0, sqrt(a.se0 * a.se0 + b.se0 * b.se0) FROM seg_fit a, seg_fit b WHERE a.g = 0 AND b.g = 1
  UNION ALL SELECT 'its', 'post_time', b.b1 - a.b1, sqrt(a.se1 * a.se1 + b.se1 * b.se1) FROM seg_fit a, seg_fit b WHERE a.g = 0 AND b.g = 1)""",
        *_segments_sql(),
    ),
)
def q_its(spark, d):
    return models.logit(timed(spark, d), "y", ["time", "post", "post_time"], model="its").coefficients


@register(
    "coef_shift",
    _sql(
        """SELECT a.variable, a.beta AS beta_pre, b.beta AS beta_post, b.beta - a.beta AS beta_diff,
       100 * (b.beta - a.beta) / abs(a.beta) AS pct_change, exp(a.beta) AS or_pre, exp(b.beta) AS or_post,
       abs(100 * (b.beta - a.beta) / abs(a.beta)) > 20 AS major_change
FROM (SELECT 'intercept' AS variable, b0 AS beta FROM seg_fit WHERE g = 0 UNION ALL SELECT 'time', b1 FROM seg_fit WHERE g = 0) a
JOIN (SELECT 'intercept' AS variable, b0 AS beta FROM seg_fit WHERE g = 1 UNION ALL SELECT 'time', b1 FROM seg_fit WHERE g = 1) b
  ON a.variable = b.variable""",
        *_segments_sql(),
    ),
)
def q_coef_shift(spark, d):
    pre = _fit_time(spark, d, where=F.col("post") == 0, model="pre").coefficients
    post = _fit_time(spark, d, where=F.col("post") == 1, model="post").coefficients
    return inference.align_coefficients(pre, post, suffixes=("_pre", "_post"))


RACES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _race_fit(spark, d):
    df = recode.dummies(timed(spark, d), "race", RACES[1:], prefix="race_")
    feats = [f"race_{r.lower()}" for r in RACES[1:]]
    return models.logit(df, "y", feats, model="race")


def _race_cells_sql():
    return "rc AS (SELECT race, sum(y) AS a, count(*) - sum(y) AS b FROM timed GROUP BY race)"


@register(
    "or_table",
    _sql(
        f"""SELECT 'race' AS model, 'race_' || lower(k.race) AS variable, odds_ratio, ci_lower, ci_upper, p_value,
       abs(beta) AS abs_log_or
FROM (SELECT k.race, ln(k.a / k.b) - ln(r.a / r.b) AS beta, sqrt(1 / k.a + 1 / k.b + 1 / r.a + 1 / r.b) AS se
      FROM rc k, rc r WHERE r.race = '{RACES[0]}' AND k.race <> '{RACES[0]}') k,
LATERAL (SELECT {wald_cols('k.beta', 'k.se')})""",
        _race_cells_sql(),
    ),
)
def q_or_table(spark, d):
    return inference.or_table(_race_fit(spark, d).coefficients)


@register(
    "fit_by_group",
    _sql(
        f"SELECT *, {wald_cols()} FROM ({coef_rows('m_fit', 'time', 'time', extra='CAST(g AS INT) AS sex, ')})",
        _cells("c", g="sex"),
        newton_ctes("c", "m"),
    ),
)
def q_fit_by_group(spark, d):
    coefs, _ = models.logit_by_group(timed(spark, d), "sex", "y", ["time"], model="time")
    return coefs


def _grid(spark, d):
    """Prediction grid: every year from the first to the last observed wave (derived from the data)."""
    rng = fx.survey_clean(spark, d).agg(F.min("wave").alias("lo"), F.max("wave").alias("hi"))
    return rng.select(F.explode(F.sequence("lo", "hi")).alias("wave")).withColumn("time", (F.col("wave") - B).cast("int"))


GRID_SQL = f"""grid AS (SELECT CAST(w AS INT) AS wave, CAST(w - {B} AS INT) AS time
  FROM (SELECT unnest(range(min(wave), max(wave) + 1)) AS w FROM survey_clean))"""


@register(
    "predict",
    _sql(
        "SELECT wave, time, 1 / (1 + exp(-(b0 + b1 * time))) AS prob FROM grid, m_fit",
        _cells("c"),
        newton_ctes("c", "m"),
        GRID_SQL,
    ),
)
def q_predict(spark, d):
    fit = _fit_time(spark, d)
    return models.predict_grid(spark, fit, _grid(spark, d))


@register(
    "marginal_effect",
    _sql(
        """SELECT wave, 1 / (1 + exp(-(b0 + b1 * (time + 1)))) - 1 / (1 + exp(-(b0 + b1 * time))) AS marginal_effect
FROM grid, m_fit""",
        _cells("c"),
        newton_ctes("c", "m"),
        GRID_SQL,
    ),
)
def q_marginal_effect(spark, d):
    fit = _fit_time(spark, d)
    g = _grid(spark, d)
    return g.select(
        "wave", (fit.probability([F.col("time") + 1]) - fit.probability([F.col("time")])).alias("marginal_effect")
    )


@register(
    "weighted_vs_unweighted",
    _sql(
        """SELECT u.variable, w.beta_or AS or_weighted, u.beta_or AS or_unweighted,
       100 * (w.beta_or - u.beta_or) / u.beta_or AS or_pct_diff
FROM (SELECT 'intercept' AS variable, exp(b0) AS beta_or FROM mu_fit UNION ALL SELECT 'time', exp(b1) FROM mu_fit) u
JOIN (SELECT 'intercept' AS variable, exp(b0) AS beta_or FROM mw_fit UNION ALL SELECT 'time', exp(b1) FROM mw_fit) w
  ON u.variable = w.variable""",
        _cells("cu"),
        newton_ctes("cu", "mu"),
        _cells("cw", weight="weight"),
        newton_ctes("cw", "mw"),
    ),
)
def q_weighted_vs_unweighted(spark, d):
    w = _fit_time(spark, d, weight="weight", model="w").coefficients
    u = _fit_time(spark, d, model="u").coefficients
    return inference.weighted_vs_unweighted(w, u)


GENDER_MAIN = ["sex", "marijuana12", "alcohol12", "time", "cigarette12"]
GENDER_PRODUCTS = [("sex", "marijuana12"), ("sex", "alcohol12")]
RACE_DUMMIES = [f"race_{r.lower()}" for r in RACES[1:]]
TREND_MAIN = [*RACE_DUMMIES, "marijuana12", "alcohol12", "time"]
TREND_PRODUCTS = [(r, "time") for r in RACE_DUMMIES]


def _interaction_sql(main, products, model):
    """Twin of ``inference.interaction_test``: both models by Newton steps over the cells of all predictors."""
    names = [f"{a}_x_{b}" for a, b in products]
    keys = ["race" if c.startswith("race_") else c for c in main]
    keys = list(dict.fromkeys(keys))
    dummy = {f"race_{r.lower()}": f"CASE WHEN race = '{r}' THEN 1 ELSE 0 END" for r in RACES[1:]}
    x = [dummy.get(c, c) for c in main]
    prod = [f"({dummy.get(a, a)}) * ({dummy.get(b, b)})" for a, b in products]
    cells = (
        f"ic AS MATERIALIZED (SELECT {', '.join(keys)}, count(*) AS n, CAST(count(*) AS DOUBLE) AS w, sum(y) AS wy FROM timed WHERE "
        + " AND ".join(f"{k} IS NOT NULL" for k in keys) + f" GROUP BY {', '.join(keys)})"
    )
    rows = " UNION ALL ".join(
        f"SELECT '{model}' AS model, '{v}' AS variable, b{i} AS beta, se{i} AS se FROM f_fit"
        for i, v in enumerate(["intercept", *main, *names])
    )
    return _sql(
        f"""SELECT m.model, m.variable, m.beta, m.se, w.z, w.p_value, w.odds_ratio, w.ci_lower, w.ci_upper,
       lr.stat AS lr_stat, CAST({len(names)} AS INT) AS lr_df, {chi2_sf_sql('lr.stat', str(len(names)))} AS lr_p
FROM ({rows}) m, LATERAL (SELECT {wald_cols('m.beta', 'm.se')}) w,
     (SELECT 2 * ((SELECT loglik FROM f_fit) - (SELECT loglik FROM r_fit)) AS stat) lr""",
        cells,
        newton_multi("ic", "r", x),
        newton_multi("ic", "f", [*x, *prod]),
    )


@register(
    "flagship",
    _sql(
        """SELECT p.wave, p.prevalence, p.n, p.sd, p.sd / sqrt(p.n) AS se, p.prevalence - 1.96 * p.sd / sqrt(p.n) AS ci_lower,
       p.prevalence + 1.96 * p.sd / sqrt(p.n) AS ci_upper, c.post, 1 / (1 + exp(-(b0 + b1 * time + b2 * post + b3 * post_time))) AS its_fitted,
       p.prevalence - 1 / (1 + exp(-(b0 + b1 * time + b2 * post + b3 * post_time))) AS residual
FROM (SELECT wave, avg(y) AS prevalence, count(*) AS n, stddev_samp(y) AS sd FROM timed GROUP BY wave) p
JOIN fc c ON p.wave = c.wave, fl_fit""",
        """fc AS MATERIALIZED (SELECT wave, time, post, post_time, count(*) AS n, CAST(count(*) AS DOUBLE) AS w, sum(y) AS wy
  FROM timed GROUP BY wave, time, post, post_time)""",
        newton_multi("fc", "fl", ["time", "post", "post_time"]),
    ),
)
def q_flagship(spark, d):
    from wavekit.plans.flagship import flagship

    return flagship(spark, d)


@register("gender_interactions", _interaction_sql(GENDER_MAIN, GENDER_PRODUCTS, "gender"))
def q_gender_interactions(spark, d):
    """Do marijuana and alcohol matter differently by sex? (df 2)"""
    return inference.interaction_test(timed(spark, d), "y", GENDER_MAIN, GENDER_PRODUCTS, model="gender")


@register("group_trend_test", _interaction_sql(TREND_MAIN, TREND_PRODUCTS, "race_trend"))
def q_group_trend_test(spark, d):
    """Do the trends differ by race? (df = number of races − 1)"""
    df = recode.dummies(timed(spark, d), "race", RACES[1:], prefix="race_")
    return inference.interaction_test(df, "y", TREND_MAIN, TREND_PRODUCTS, model="race_trend")


@register(
    "se_design_effect",
    _sql(
        f"""SELECT r.*, d.deff, r.se * sqrt(d.deff) AS se_adj, r.beta / (r.se * sqrt(d.deff)) AS z_adj,
       {two_sided_p_sql('r.beta / (r.se * sqrt(d.deff))')} AS p_adj,
       exp(r.beta - {Z95} * r.se * sqrt(d.deff)) AS ci_lower_adj, exp(r.beta + {Z95} * r.se * sqrt(d.deff)) AS ci_upper_adj
FROM (SELECT *, {wald_cols()} FROM ({coef_rows('m_fit', 'time', 'time')})) r,
     (SELECT count(survey_weight) * sum(survey_weight * survey_weight) / (sum(survey_weight) * sum(survey_weight)) AS deff
      FROM timed) d""",
        _cells("c"),
        newton_ctes("c", "m"),
    ),
)
def q_se_design_effect(spark, d):
    coefs = _fit_time(spark, d).coefficients
    deff = inference.kish_deff(timed(spark, d), "survey_weight")
    return inference.se_design_effect(coefs, deff)


def _auc_of(fit: str) -> str:
    """AUC of a fitted trend over all rows, from its year cells."""
    return f"""(SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) FROM (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT 1 / (1 + exp(-(b0 + b1 * time))) AS p, sum(y) AS pos, count(*) - sum(y) AS neg FROM timed, {fit} GROUP BY 1)))"""


def _log_loss_of(fit: str) -> str:
    return f"""(SELECT -avg(y * ln(p) + (1 - y) * ln(1 - p))
  FROM (SELECT y, 1 / (1 + exp(-(b0 + b1 * time))) AS p FROM timed, {fit}))"""


@register(
    "model_summary",
    _sql(
        f"""SELECT f.*, CAST(1 AS BIGINT) AS n_predictors,
       CAST(CASE WHEN {two_sided_p_sql('f.b1 / f.se1')} < 0.05 THEN 1 ELSE 0 END AS BIGINT) AS n_significant
FROM (SELECT model, n_obs, CAST(2 AS INT) AS n_params, loglik,
             sum_wy * ln(sum_wy / sum_w) + (sum_w - sum_wy) * ln(1 - sum_wy / sum_w) AS null_loglik, sum_w,
             4 - 2 * loglik AS aic, 2 * ln(n_obs) - 2 * loglik AS bic,
             1 - loglik / (sum_wy * ln(sum_wy / sum_w) + (sum_w - sum_wy) * ln(1 - sum_wy / sum_w)) AS mcfadden_r2, b1, se1, auc, log_loss
      FROM (SELECT 'time' AS model, *, {_auc_of('mu_fit')} AS auc, {_log_loss_of('mu_fit')} AS log_loss FROM mu_fit
            UNION ALL SELECT 'time_weighted', *, {_auc_of('mw_fit')}, {_log_loss_of('mw_fit')} FROM mw_fit)) f""",
        _cells("cu"),
        newton_ctes("cu", "mu"),
        _cells("cw", weight="weight"),
        newton_ctes("cw", "mw"),
    ).replace("SELECT f.*,", "SELECT f.* EXCLUDE (b1, se1),"),
)
def q_model_summary(spark, d):
    from wavekit.operators import evaluate

    df = timed(spark, d)
    fits = [_fit_time(spark, d, model="time"), _fit_time(spark, d, weight="weight", model="time_weighted")]
    coefs = reduce(DataFrame.unionByName, [f.coefficients for f in fits])
    scores = [df.withColumn("prob", f.probability()) for f in fits]
    stats = [attach(attach(f.stats, evaluate.roc_auc(s, "y", "prob").select("auc")), evaluate.log_loss(s, "y", "prob").select("log_loss"))
             for f, s in zip(fits, scores)]
    return inference.model_summary(coefs, reduce(DataFrame.unionByName, stats))


NESTED = [["time"], ["time", "sex"], ["time", "sex", "marijuana12"], ["time", "sex", "marijuana12", "alcohol12"],
          ["time", "sex", "marijuana12", "alcohol12", "cigarette12"],
          ["time", "sex", "marijuana12", "alcohol12", "cigarette12", "region"]]


def _nested_sql():
    keys = NESTED[-1]
    cells = (
        f"nc AS MATERIALIZED (SELECT {', '.join(keys)}, count(*) AS n, CAST(count(*) AS DOUBLE) AS w, sum(y) AS wy FROM timed WHERE "
        + " AND ".join(f"{k} IS NOT NULL" for k in keys) + f" GROUP BY {', '.join(keys)})"
    )
    fits = [newton_multi("nc", f"n{i}", feats) for i, feats in enumerate(NESTED, start=1)]
    rows = " UNION ALL ".join(
        f"SELECT 'model_{i}' AS model, {i} AS model_no, {len(feats) + 1} AS n_params, loglik FROM n{i}_fit" for i, feats in enumerate(NESTED, start=1)
    )
    return _sql(
        f"""SELECT model, CAST(model_no AS INT) AS model_no, n_obs, CAST(n_params AS INT) AS n_params, loglik, null_loglik, sum_w,
       2 * n_params - 2 * loglik AS aic, n_params * ln(n_obs) - 2 * loglik AS bic, 1 - loglik / null_loglik AS mcfadden_r2,
       lr_stat, CAST(lr_df AS INT) AS lr_df, {chi2_sf_sql('lr_stat', 'lr_df')} AS lr_p
FROM (SELECT *, 2 * (loglik - lag(loglik) OVER (ORDER BY model_no)) AS lr_stat, n_params - lag(n_params) OVER (ORDER BY model_no) AS lr_df
      FROM ({rows}), (SELECT CAST(sum(n) AS BIGINT) AS n_obs, sum(w) AS sum_w,
                             sum(wy) * ln(sum(wy) / sum(w)) + (sum(w) - sum(wy)) * ln(1 - sum(wy) / sum(w)) AS null_loglik FROM nc))""",
        cells,
        *fits,
    )


@register("nested_models_listed", _nested_sql())
def q_nested_models_listed(spark, d):
    """Six cumulative predictor sets on the same complete-case rows, with adjacent LR tests."""
    return models.nested_logits(timed(spark, d), "y", NESTED)


@register(
    "sig_stars",
    _sql(
        f"""SELECT *, CASE WHEN p_value < 0.001 THEN '<0.001' ELSE printf('%.3f', round(p_value, 3)) END AS p_text,
       printf('%.2f [%.2f, %.2f]%s', round(odds_ratio, 2), round(ci_lower, 2), round(ci_upper, 2), stars) AS or_text
FROM (SELECT *, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars
      FROM (SELECT 'race' AS model, 'race_' || lower(k.race) AS variable, odds_ratio, ci_lower, ci_upper, p_value,
                   abs(beta) AS abs_log_or
            FROM (SELECT k.race, ln(k.a / k.b) - ln(r.a / r.b) AS beta, sqrt(1 / k.a + 1 / k.b + 1 / r.a + 1 / r.b) AS se
                  FROM rc k, rc r WHERE r.race = '{RACES[0]}' AND k.race <> '{RACES[0]}') k,
            LATERAL (SELECT {wald_cols('k.beta', 'k.se')})))""",
        _race_cells_sql(),
    ),
)
def q_sig_stars(spark, d):
    return recode.sig_stars(inference.or_table(_race_fit(spark, d).coefficients), "p_value", "odds_ratio")


@register(
    "lr_critical",
    _sql(
        """SELECT m.model_no, m.lr_df, l.level, CASE l.level WHEN 0.95 THEN 3.841458820694124::DOUBLE WHEN 0.99 THEN 6.634896601021213::DOUBLE END AS critical,
       m.stat > CASE l.level WHEN 0.95 THEN 3.841458820694124 WHEN 0.99 THEN 6.634896601021213 END AS exceeds
FROM (SELECT CAST(2 AS INT) AS model_no, CAST(1 AS INT) AS lr_df, 2 * ((SELECT loglik FROM m_fit) - sum(y) * ln(avg(y)) - (count(*) - sum(y)) * ln(1 - avg(y))) AS stat FROM timed) m,
     (SELECT unnest([0.95::DOUBLE, 0.99::DOUBLE]) AS level) l""",
        _cells("c"),
        newton_ctes("c", "m"),
    ),
)
def q_lr_critical(spark, d):
    """The LR statistic of the trend against the critical values of its χ² distribution."""
    from wavekit.functions import dist

    df = timed(spark, d)
    null = models.null_model(df, "y").select(F.lit(1).alias("model_no"), F.lit(1).alias("n_params"), F.col("null_loglik").alias("loglik"))
    full = models.logit(df, "y", ["time"], model="time").stats.select(F.lit(2).alias("model_no"), "n_params", "loglik")
    test = inference.lr_test(null.unionByName(full), "model_no").where("model_no = 2")
    levels = test.withColumn("level", F.explode(F.array(F.lit(0.95), F.lit(0.99)))).withColumn("critical", dist.chi2_quantile("level", "lr_df"))
    return levels.select("model_no", "lr_df", "level", "critical", (F.col("lr_stat") > F.col("critical")).alias("exceeds"))
