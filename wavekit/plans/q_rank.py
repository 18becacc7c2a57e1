"""Queries for window / rank / consensus (§2.5) and set operations and pivots (§2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavekit.operators import evaluate, inference, models, ranking, recode, setops
from wavekit.plans import fixtures as fx
from wavekit.plans.newton_sql import newton_ctes, two_sided_p_sql
from wavekit.plans.q_models import RACES, TIMED_SQL, _cells, _fit_time, timed
from wavekit.plans.registry import register
from wavekit.plans.views import with_views

# Columns of the SQL twins: the waves of the given tables. The operators take theirs from the coefficients.
WAVE_MODELS = [f"w{w}" for w in range(1995, 2002)]


def _imp(spark, d):
    return fx.feature_importances(spark, d)


RANKED_SQL = """ranked AS (SELECT model, feature, importance,
  CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature ASC) AS INT) AS rank
  FROM feature_importances)"""


def _rsql(body: str, *extra: str) -> str:
    ctes = ",\n".join((RANKED_SQL,) + extra)
    return with_views(f"WITH {ctes}\n{body}", "feature_importances")


@register("rank_by_model", _rsql("SELECT * FROM ranked"))
def q_rank_by_model(spark, d):
    return ranking.rank_by_model(_imp(spark, d))


TIERS_SQL = """tiers AS (SELECT feature, count(*) FILTER (WHERE rank <= {k}) AS n_models_top,
  CAST((SELECT count(DISTINCT model) FROM ranked) + 1 - count(*) FILTER (WHERE rank <= {k}) AS INT) AS tier
  FROM ranked GROUP BY feature HAVING count(*) FILTER (WHERE rank <= {k}) > 0)"""


@register("consensus_tiers", _rsql("SELECT * FROM tiers", TIERS_SQL.format(k=10)))
def q_consensus_tiers(spark, d):
    return ranking.consensus_tiers(ranking.rank_by_model(_imp(spark, d)), k=10)


KS = [10, 15, 20, 25, 30]


@register(
    "consensus_sensitivity",
    _rsql(
        f"""SELECT t.*, s.n_features, s.n_tier1 FROM t JOIN
  (SELECT k, count(*) AS n_features, count(*) FILTER (WHERE tier = 1) AS n_tier1 FROM t GROUP BY k) s USING (k)""",
        f"""t AS (SELECT CAST(k AS INT) AS k, feature, count(*) FILTER (WHERE rank <= k) AS n_models_top,
  CAST((SELECT count(DISTINCT model) FROM ranked) + 1 - count(*) FILTER (WHERE rank <= k) AS INT) AS tier
  FROM ranked, (SELECT unnest({KS}) AS k) GROUP BY k, feature HAVING count(*) FILTER (WHERE rank <= k) > 0)""",
    ),
)
def q_consensus_sensitivity(spark, d):
    return ranking.consensus_sensitivity(ranking.rank_by_model(_imp(spark, d)), KS)


@register(
    "nested_sets",
    _rsql(
        """SELECT CAST(s.set_no AS INT) AS set_no, t.feature, t.tier
FROM tiers t, (SELECT unnest(range(1, (SELECT max(tier) FROM tiers) + 1)) AS set_no) s WHERE t.tier <= s.set_no""",
        TIERS_SQL.format(k=10),
    ),
)
def q_nested_sets(spark, d):
    tiers = ranking.consensus_tiers(ranking.rank_by_model(_imp(spark, d)), k=10)
    return ranking.nested_sets(tiers)


@register(
    "top_n",
    with_views(
        """SELECT feature, sum(importance) AS importance FROM feature_importances GROUP BY feature
ORDER BY importance DESC, feature LIMIT 10""",
        "feature_importances",
    ),
)
def q_top_n(spark, d):
    tot = _imp(spark, d).groupBy("feature").agg(F.sum("importance").alias("importance"))
    return ranking.top_n(tot, "importance", 10, "feature")


@register(
    "rank_agreement",
    with_views(
        """WITH p AS (SELECT a.model AS model_a, b.model AS model_b, a.importance AS imp_a, b.importance AS imp_b
           FROM feature_importances a JOIN feature_importances b ON a.feature = b.feature AND a.model < b.model),
r AS (SELECT *,
        rank() OVER (PARTITION BY model_a, model_b ORDER BY imp_a) + (count(*) OVER (PARTITION BY model_a, model_b, imp_a) - 1) / 2.0 AS rank_a,
        rank() OVER (PARTITION BY model_a, model_b ORDER BY imp_b) + (count(*) OVER (PARTITION BY model_a, model_b, imp_b) - 1) / 2.0 AS rank_b
      FROM p)
SELECT model_a, model_b, corr(rank_a, rank_b) AS spearman_rho, count(*) AS n_features FROM r GROUP BY model_a, model_b""",
        "feature_importances",
    ),
)
def q_rank_agreement(spark, d):
    return ranking.rank_agreement(_imp(spark, d))


# ---- per-wave saturated race models: coefficient tables with many (model, variable) rows


def wave_race_coefs(spark, d):
    df = recode.dummies(timed(spark, d), "race", RACES[1:], prefix="race_")
    feats = [f"race_{r.lower()}" for r in RACES[1:]]
    coefs, _ = models.logit_by_group(df, "wave", "y", feats, model="race")
    return coefs.withColumn("model", F.concat(F.lit("w"), F.col("wave").cast("string"))).drop("wave")


WAVE_COEF_SQL = f"""timed AS ({TIMED_SQL}),
rc AS (SELECT wave, race, sum(y) AS a, count(*) - sum(y) AS b FROM timed GROUP BY wave, race),
wc0 AS (
  SELECT 'w' || CAST(r.wave AS VARCHAR) AS model, 'intercept' AS variable, ln(r.a / r.b) AS beta, sqrt(1 / r.a + 1 / r.b) AS se
  FROM rc r WHERE r.race = '{RACES[0]}'
  UNION ALL
  SELECT 'w' || CAST(k.wave AS VARCHAR), 'race_' || lower(k.race), ln(k.a / k.b) - ln(r.a / r.b),
         sqrt(1 / k.a + 1 / k.b + 1 / r.a + 1 / r.b)
  FROM rc k JOIN rc r ON k.wave = r.wave AND r.race = '{RACES[0]}' WHERE k.race <> '{RACES[0]}'),
wc AS (SELECT *, beta / se AS z, {two_sided_p_sql('beta / se')} AS p_value, exp(beta) AS odds_ratio,
              exp(beta - 1.959963984540054 * se) AS ci_lower, exp(beta + 1.959963984540054 * se) AS ci_upper FROM wc0)"""


def _wsql(body: str) -> str:
    return with_views(f"WITH {WAVE_COEF_SQL}\n{body}", "survey_clean")


@register(
    "top_significant",
    _wsql(
        """SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY p_value ASC, abs(beta) DESC, variable) AS INT) AS position
FROM (SELECT * FROM wc WHERE variable <> 'intercept' AND p_value < 0.05
      QUALIFY row_number() OVER (PARTITION BY model ORDER BY abs(beta) DESC, variable) <= 2)"""
    ),
)
def q_top_significant(spark, d):
    return ranking.top_significant(wave_race_coefs(spark, d), k=2)


@register(
    "predictor_presence",
    _wsql(
        "SELECT variable, "
        + ", ".join(
            f"CAST(coalesce(max(CASE WHEN model = '{m}' THEN CASE WHEN p_value < 0.05 THEN 2 ELSE 1 END END), 0) AS INT) AS {m}"
            for m in WAVE_MODELS
        )
        + " FROM wc GROUP BY variable"
    ),
)
def q_predictor_presence(spark, d):
    return setops.predictor_presence(wave_race_coefs(spark, d))


@register(
    "key_pivot",
    _wsql(
        "SELECT variable, "
        + ", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN beta END), 0) AS beta_{m}" for m in WAVE_MODELS)
        + ", "
        + ", ".join(f"log2(coalesce(max(CASE WHEN model = '{m}' THEN odds_ratio END), 1)) AS log2_or_{m}" for m in WAVE_MODELS)
        + ", "
        + " + ".join(f"abs(coalesce(max(CASE WHEN model = '{m}' THEN beta END), 0))" for m in WAVE_MODELS)
        + " AS sum_abs_beta FROM wc GROUP BY variable"
    ),
)
def q_key_pivot(spark, d):
    return setops.key_pivot(wave_race_coefs(spark, d))


@register(
    "adjacent_compare",
    with_views(
        """SELECT wave, avg(y) AS prevalence, lag(avg(y)) OVER (ORDER BY wave) AS prevalence_prev,
       avg(y) - lag(avg(y)) OVER (ORDER BY wave) AS prevalence_diff,
       100 * (avg(y) - lag(avg(y)) OVER (ORDER BY wave)) / abs(lag(avg(y)) OVER (ORDER BY wave)) AS prevalence_pct_change
FROM survey_clean GROUP BY wave""",
        "survey_clean",
    ),
)
def q_adjacent_compare(spark, d):
    prev = fx.survey_clean(spark, d).groupBy("wave").agg(F.avg("y").alias("prevalence"))
    return ranking.adjacent_compare(prev, "wave", ["prevalence"])


@register(
    "model_leaderboard",
    with_views(
        """WITH a AS (
  SELECT year, sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc,
         CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
  FROM (SELECT year, score, pos, neg,
               coalesce(sum(neg) OVER (PARTITION BY year ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
        FROM (SELECT year, prob AS score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                     sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY year, prob))
  GROUP BY year)
SELECT 'y' || CAST(year AS VARCHAR) AS model, auc, n_pos, n_neg,
       CAST(row_number() OVER (ORDER BY auc DESC, 'y' || CAST(year AS VARCHAR)) AS INT) AS position,
       100 * (auc - max(auc) OVER ()) / max(auc) OVER () AS gap_to_best_pct,
       100 * (auc - min(auc) OVER ()) / min(auc) OVER () AS gain_over_baseline_pct
FROM a""",
        "scored",
    ),
)
def q_model_leaderboard(spark, d):
    aucs = evaluate.roc_auc(fx.scored(spark, d), "label", "prob", by=["year"])
    aucs = aucs.select(F.concat(F.lit("y"), F.col("year").cast("string")).alias("model"), "auc", "n_pos", "n_neg")
    return ranking.model_leaderboard(aucs, "auc")


# ---- set operations on sources


def _form_frames(spark, d):
    raw = recode.sentinel_to_null(fx.survey_raw(spark, d))
    a = raw.where(F.col("form") == "0012").select(
        "respondent_id", "wave", "nicotine12", "sex_raw", "race", "region", "survey_weight"
    )
    b = raw.where(F.col("form") == "0810").select("respondent_id", "wave", "nicotine12", "sex_raw", "race", "marijuana12")
    return a, b


@register(
    "union_common",
    with_views(
        """SELECT respondent_id, wave, nicotine12, sex_raw, race FROM survey_nonull WHERE form = '0012'
UNION ALL SELECT respondent_id, wave, nicotine12, sex_raw, race FROM survey_nonull WHERE form = '0810'""",
        "survey_nonull",
    ),
)
def q_union_common(spark, d):
    return setops.union_common(list(_form_frames(spark, d)))


@register(
    "union_fill",
    with_views(
        """SELECT respondent_id, wave, nicotine12, sex_raw, race, region, survey_weight, CAST(NULL AS INT) AS marijuana12
FROM survey_nonull WHERE form = '0012'
UNION ALL SELECT respondent_id, wave, nicotine12, sex_raw, race, NULL, NULL, marijuana12 FROM survey_nonull WHERE form = '0810'""",
        "survey_nonull",
    ),
)
def q_union_fill(spark, d):
    return setops.union_fill(list(_form_frames(spark, d)))


@register(
    "align_coefficients",
    with_views(
        f"""WITH timed AS ({TIMED_SQL}),
{_cells("cu")},
{newton_ctes("cu", "mu")},
{_cells("cw", weight="weight")},
{newton_ctes("cw", "mw")}
SELECT u.variable, u.beta AS beta_u, w.beta AS beta_w, w.beta - u.beta AS beta_diff,
       100 * (w.beta - u.beta) / abs(u.beta) AS pct_change, exp(u.beta) AS or_u, exp(w.beta) AS or_w,
       abs(100 * (w.beta - u.beta) / abs(u.beta)) > 20 AS major_change
FROM (SELECT 'intercept' AS variable, b0 AS beta FROM mu_fit UNION ALL SELECT 'time', b1 FROM mu_fit) u
JOIN (SELECT 'intercept' AS variable, b0 AS beta FROM mw_fit UNION ALL SELECT 'time', b1 FROM mw_fit) w ON u.variable = w.variable""",
        "survey_clean",
    ),
)
def q_align_coefficients(spark, d):
    u = _fit_time(spark, d, model="u").coefficients
    w = _fit_time(spark, d, weight="weight", model="w").coefficients
    return inference.align_coefficients(u, w, suffixes=("_u", "_w"))
