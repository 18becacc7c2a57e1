"""Queries for attribution and partial dependence (§2.10) with SQL twins (coefficients fixed or closed form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavekit.operators import attribution, models, recode, setops
from wavekit.plans import fixtures as fx
from wavekit.plans.newton_sql import newton_ctes
from wavekit.plans.q_models import RACES, TIMED_SQL, _cells, timed
from wavekit.plans.q_rank import WAVE_COEF_SQL, wave_race_coefs
from wavekit.plans.registry import register
from wavekit.plans.views import with_views
from wavekit.sources.tables import table

# Fixed linear attribution coefficients of the fixture (FIXTURES.md T7).
LINEAR_BETA = {"marijuana12": 0.3, "alcohol12": -0.2, "cigarette12": 0.1}
PAIR_FEATURES = ["marijuana12", "alcohol12", "cigarette12", "region", "wave"]
# Fixed slot → base grouping used for the slot-summing variants.
SLOT_GROUPS = [("marijuana12", "smoking"), ("cigarette12", "smoking"), ("alcohol12", "alcohol")]
RACE_GROUPS = [("race_building", "race_bf"), ("race_furniture", "race_bf"), ("race_household", "race_hm"),
               ("race_machinery", "race_hm")]


def _values(rows, cols):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + f") AS m({cols})"


def _complete(spark, d):
    return recode.filter_complete(fx.survey_clean(spark, d), list(LINEAR_BETA))


COMPLETE_SQL = "cc AS (SELECT * FROM survey_clean WHERE marijuana12 IS NOT NULL AND alcohol12 IS NOT NULL AND cigarette12 IS NOT NULL)"
PHI_SQL = COMPLETE_SQL + ",\nphi AS (" + "\nUNION ALL ".join(
    f"SELECT respondent_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {b} * ({f} - avg({f}) OVER ()) AS phi FROM cc"
    for f, b in LINEAR_BETA.items()
) + ")"


def _phi(spark, d):
    return attribution.shap_linear(_complete(spark, d), LINEAR_BETA, "respondent_id")


def _psql(body: str, *extra: str) -> str:
    ctes = ",\n".join((PHI_SQL,) + extra)
    return with_views(f"WITH {ctes}\n{body}", "survey_clean")


@register(
    "importance_base",
    with_views(
        """SELECT i.model, m.base_feature, sum(i.importance) AS importance
FROM importances i JOIN (SELECT DISTINCT p_brand || ':' || p_type AS slot, p_brand AS base_feature FROM part) m ON i.slot = m.slot
GROUP BY i.model, m.base_feature""",
        "importances",
    ),
)
def q_importance_base(spark, d):
    meta = table(spark, d, "part").select(
        F.concat_ws(":", "p_brand", "p_type").alias("slot"), F.col("p_brand").alias("base_feature")
    ).distinct()
    return attribution.importance_base(fx.importances(spark, d), meta)


@register(
    "coef_importance",
    with_views(
        f"""WITH {WAVE_COEF_SQL}
SELECT wc.model, m.base_feature, sum(abs(wc.beta)) AS importance
FROM wc JOIN {_values(RACE_GROUPS, 'slot, base_feature')} ON wc.variable = m.slot
WHERE wc.variable <> 'intercept' GROUP BY wc.model, m.base_feature""",
        "survey_clean",
    ),
)
def q_coef_importance(spark, d):
    meta = spark.createDataFrame(RACE_GROUPS, "slot string, base_feature string")
    return attribution.coef_importance(wave_race_coefs(spark, d), meta)


@register("shap_linear", _psql("SELECT * FROM phi"))
def q_shap_linear(spark, d):
    return _phi(spark, d)


@register("shap_importance", _psql("SELECT feature, avg(abs(phi)) AS mean_abs_phi FROM phi GROUP BY feature"))
def q_shap_importance(spark, d):
    return attribution.shap_importance(_phi(spark, d), "respondent_id")


@register(
    "shap_importance_slots",
    _psql(
        f"""SELECT base_feature AS feature, avg(abs(phi)) AS mean_abs_phi FROM (
  SELECT respondent_id, m.base_feature, sum(phi) AS phi FROM phi JOIN {_values(SLOT_GROUPS, 'slot, base_feature')}
    ON phi.feature = m.slot GROUP BY respondent_id, m.base_feature) GROUP BY base_feature"""
    ),
)
def q_shap_importance_slots(spark, d):
    meta = spark.createDataFrame(SLOT_GROUPS, "slot string, base_feature string")
    return attribution.shap_importance(_phi(spark, d), "respondent_id", meta=meta, sum_slots_first=True)


def _poisson_case(u: str) -> str:
    from wavekit.plans.q_split import _poisson_case as pc

    return pc(u)


@register(
    "shap_stability",
    _psql(
        f"""SELECT feature, avg(m) AS mean, stddev_pop(m) AS sd, quantile_cont(m, 0.025) AS q025, quantile_cont(m, 0.975) AS q975,
       100 * stddev_pop(m) / avg(m) AS cv_pct, 100 * stddev_pop(m) / avg(m) > 50 AS unstable
FROM (SELECT r AS replicate, feature, sum(w * abs(phi)) / sum(w) AS m FROM (
        SELECT r.r, feature, phi, {_poisson_case("u")} AS w FROM (
          SELECT r.r, feature, phi,
                 ('0x' || substr(md5(CAST(respondent_id AS VARCHAR) || ':42:' || CAST(r.r AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0 AS u
          FROM phi, (SELECT unnest(range(1, 31)) AS r) r) r)
      GROUP BY r, feature)
GROUP BY feature"""
    ),
)
def q_shap_stability(spark, d):
    return attribution.shap_stability(_phi(spark, d), "respondent_id", 30, 42)


PAIR_SQL = COMPLETE_SQL + ",\ncm AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in PAIR_FEATURES) + " FROM cc),\n" + \
    "pphi AS (" + "\nUNION ALL ".join(
        f"SELECT respondent_id, '{a}' AS f1, '{b}' AS f2, ({a} - m_{a}) * ({b} - m_{b}) AS phi FROM cc, cm"
        for i, a in enumerate(PAIR_FEATURES) for b in PAIR_FEATURES[i + 1:]
    ) + "),\npairs AS (SELECT least(f1, f2) AS b1, greatest(f1, f2) AS b2, sum(abs(phi)) / (SELECT count(DISTINCT respondent_id) FROM pphi) AS value FROM pphi GROUP BY least(f1, f2), greatest(f1, f2))"


def _pairs(spark, d):
    return attribution.attr_pairwise_centred(_complete(spark, d), PAIR_FEATURES)


def _pair_sql(body: str) -> str:
    return with_views(f"WITH {PAIR_SQL}\n{body}", "survey_clean")


@register("attr_pairwise", _pair_sql("SELECT * FROM pairs"))
def q_attr_pairwise(spark, d):
    return _pairs(spark, d)


TRIPLES_SQL = """SELECT a.f AS f1, b.f AS f2, c.f AS f3,
       2 * (coalesce(p12.value, 0) + coalesce(p13.value, 0) + coalesce(p23.value, 0)) AS value
FROM (SELECT DISTINCT b1 AS f FROM pairs UNION SELECT DISTINCT b2 FROM pairs) a
JOIN (SELECT DISTINCT b1 AS f FROM pairs UNION SELECT DISTINCT b2 FROM pairs) b ON a.f < b.f
JOIN (SELECT DISTINCT b1 AS f FROM pairs UNION SELECT DISTINCT b2 FROM pairs) c ON b.f < c.f
LEFT JOIN pairs p12 ON p12.b1 = a.f AND p12.b2 = b.f
LEFT JOIN pairs p13 ON p13.b1 = a.f AND p13.b2 = c.f
LEFT JOIN pairs p23 ON p23.b1 = b.f AND p23.b2 = c.f"""


@register("three_way_proxy", _pair_sql(TRIPLES_SQL))
def q_three_way_proxy(spark, d):
    return attribution.three_way_proxy(_pairs(spark, d))


@register(
    "stack_ranked",
    _pair_sql(
        f"""SELECT *, CAST(row_number() OVER (ORDER BY value DESC, f1, f2, f3 ASC NULLS FIRST) AS INT) AS rank FROM (
  SELECT b1 AS f1, b2 AS f2, value, CAST(NULL AS VARCHAR) AS f3, 2 AS "order" FROM pairs
  UNION ALL SELECT f1, f2, value, f3, 3 FROM ({TRIPLES_SQL}))
QUALIFY rank <= 10"""
    ),
)
def q_stack_ranked(spark, d):
    pairs = _pairs(spark, d)
    triples = attribution.three_way_proxy(pairs)
    return setops.stack_ranked(pairs.select(F.col("b1").alias("f1"), F.col("b2").alias("f2"), "value"), triples, "value", k=10)


@register(
    "shap_dependence",
    _psql(
        """SELECT a.respondent_id, a.value AS x, a.phi, c.value AS colour
FROM phi a LEFT JOIN phi c ON a.respondent_id = c.respondent_id AND c.feature = 'alcohol12' WHERE a.feature = 'marijuana12'"""
    ),
)
def q_shap_dependence(spark, d):
    return attribution.shap_dependence(_phi(spark, d), "marijuana12", "alcohol12", "respondent_id")


@register(
    "local_explain",
    _psql(
        """SELECT *, CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INT) AS position FROM phi
WHERE respondent_id = (SELECT min(respondent_id) FROM cc)"""
    ),
)
def q_local_explain(spark, d):
    phi = _phi(spark, d)
    first = _complete(spark, d).agg(F.min("respondent_id")).first()[0]
    return attribution.local_explain(phi, "respondent_id", first)


def _race_predict(fit):
    feats = [f"race_{r.lower()}" for r in RACES[1:]]

    def predict(df):
        x = recode.dummies(df, "race", RACES[1:], prefix="race_")
        return x.withColumn("prob", fit.probability([F.col(f) for f in feats]))

    return predict


@register(
    "pdp_discrete",
    with_views(
        f"""WITH timed AS ({TIMED_SQL})
SELECT race AS value, avg(y) AS mean_prediction, (SELECT count(*) FROM timed) AS n FROM timed GROUP BY race""",
        "survey_clean",
    ),
)
def q_pdp_discrete(spark, d):
    df = recode.dummies(timed(spark, d), "race", RACES[1:], prefix="race_")
    fit = models.logit(df, "y", [f"race_{r.lower()}" for r in RACES[1:]], model="race")
    return attribution.pdp_discrete(timed(spark, d).select("respondent_id", "race"), "race", _race_predict(fit), inputs=["race"])


PDP_Q = [0.05 + 0.1 * i for i in range(10)]


@register(
    "pdp_grid",
    with_views(
        f"""WITH timed AS ({TIMED_SQL}),
{_cells("c")},
{newton_ctes("c", "m")},
q AS (SELECT DISTINCT unnest(quantile_cont(CAST(time AS DOUBLE), {[round(p, 10) for p in PDP_Q]})) AS value FROM timed)
SELECT value, 1 / (1 + exp(-(b0 + b1 * value))) AS mean_prediction, (SELECT count(*) FROM timed) AS n FROM q, m_fit""",
        "survey_clean",
    ),
)
def q_pdp_grid(spark, d):
    df = timed(spark, d)
    fit = models.logit(df, "y", ["time"], model="time")
    predict = lambda x: x.withColumn("prob", fit.probability([F.col("time")]))
    return attribution.pdp_grid(df.select("respondent_id", "time"), "time", predict, quantiles=[round(p, 10) for p in PDP_Q], inputs=["time"])
