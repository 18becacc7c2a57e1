"""Queries for splitting, resampling (§2.6), feature preparation and imputation (§2.7) and pooling over
imputations (§2.9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavekit.functions.hashing import poisson1_cutpoints
from wavekit.functions.scalars import attach
from wavekit.operators import impute, inference, models, prep, profile, recode, split
from wavekit.plans import fixtures as fx
from wavekit.plans.newton_sql import chi2_sf_sql, permutation_sql, two_sided_p_sql
from wavekit.plans.registry import register
from wavekit.plans.views import view, with_views
from wavekit.session import written

SEED = 42
KEYS = list(fx.KEY_VARS)


def _md5(seed=SEED, extra: str = "") -> str:
    return f"md5(CAST(respondent_id AS VARCHAR) || ':{seed}'{extra})"


view(
    "survey_split",
    f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {_md5()}, respondent_id)
                  <= round(count(*) OVER (PARTITION BY y) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM survey_clean""",
    ("survey_clean",),
)


def _split(spark, d):
    return split.split_stratified(fx.survey_clean(spark, d), "respondent_id", ["y"], 0.2, SEED)


@register("split_stratified", with_views("SELECT respondent_id, y, split FROM survey_split", "survey_split"))
def q_split_stratified(spark, d):
    return _split(spark, d).select("respondent_id", "y", "split")


@register(
    "folds_stratified",
    with_views(
        f"""SELECT respondent_id, y, wave,
       CAST((row_number() OVER (PARTITION BY y, wave ORDER BY {_md5(7)}, respondent_id) - 1) % 5 AS INT) AS fold
FROM survey_clean""",
        "survey_clean",
    ),
)
def q_folds_stratified(spark, d):
    df = fx.survey_clean(spark, d).select("respondent_id", "y", "wave")
    return split.folds_stratified(df, "respondent_id", ["y", "wave"], k=5, seed=7)


@register(
    "split_temporal",
    with_views(
        """SELECT respondent_id, wave, CASE WHEN wave <= 1999 THEN 'train' ELSE 'test' END AS split
FROM survey_clean WHERE wave <= 1999 OR wave >= 2000""",
        "survey_clean",
    ),
)
def q_split_temporal(spark, d):
    return split.split_temporal(fx.survey_clean(spark, d).select("respondent_id", "wave"), "wave", 1999, 2000)


@register(
    "subsample",
    with_views(f"SELECT respondent_id, y FROM survey_clean ORDER BY {_md5()}, respondent_id LIMIT 500", "survey_clean"),
)
def q_subsample(spark, d):
    return split.subsample(fx.survey_clean(spark, d).select("respondent_id", "y"), "respondent_id", 500, SEED)


def _poisson_case(u: str) -> str:
    cuts = poisson1_cutpoints()
    whens = " ".join(f"WHEN {u} < CAST({c!r} AS DOUBLE) THEN {k}" for k, c in enumerate(cuts))
    return f"CAST(CASE {whens} ELSE {len(cuts)} END AS INT)"


@register(
    "bootstrap",
    with_views(
        f"""SELECT CAST(r AS INT) AS replicate, CAST(sum(w) AS BIGINT) AS n_boot, sum(w * y) / sum(w) AS mean
FROM (SELECT r, y, {_poisson_case('u')} AS w
      FROM (SELECT r.r, y,
                   ('0x' || substr({_md5(extra=" || ':' || CAST(r.r AS VARCHAR)")}, 1, 8))::UBIGINT / 4294967296.0 AS u
            FROM survey_clean, (SELECT unnest(range(1, 21)) AS r) r WHERE y IS NOT NULL))
GROUP BY r""",
        "survey_clean",
    ),
)
def q_bootstrap(spark, d):
    return split.bootstrap_mean(fx.survey_clean(spark, d), "respondent_id", "y", 20, SEED)


@register(
    "bootstrap_exact",
    with_views(
        """SELECT CAST(r AS INT) AS replicate, count(*) AS n_boot, true AS near_mean
FROM survey_clean, (SELECT unnest(range(1, 21)) AS r) WHERE y IS NOT NULL GROUP BY r""",
        "survey_clean",
    ),
)
def q_bootstrap_exact(spark, d):
    """Twenty replicates of exactly n draws: their sizes, and whether the mean lies within five standard errors of the
    rows' mean."""
    df = fx.survey_clean(spark, d).select("respondent_id", "y")
    of = df.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.count("y").alias("n"))
    out = attach(split.bootstrap_exact_mean(df, "respondent_id", "y", 20, SEED), of)
    return out.select("replicate", "n_boot", (F.abs(F.col("mean") - F.col("m")) < 5 * F.col("s") / F.sqrt("n")).alias("near_mean"))


@register(
    "permute_column",
    with_views(
        f"""WITH a AS (SELECT respondent_id, alcohol12, row_number() OVER (ORDER BY {_md5()}) - 1 AS i FROM survey_clean),
dim AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM survey_clean),
b AS (SELECT {permutation_sql("i", "n", "dim.a", "'42:alcohol12_perm:0'")} AS i, alcohol12 AS v FROM a, dim)
SELECT a.respondent_id, a.alcohol12, b.v AS alcohol12_perm FROM a JOIN b ON a.i = b.i""",
        "survey_clean",
    ),
)
def q_permute_column(spark, d):
    df = fx.survey_clean(spark, d).select("respondent_id", "alcohol12")
    return split.permute_column(df, "respondent_id", "alcohol12", SEED, dst="alcohol12_perm")


# ------------------------------------------------------------------ preparation


@register(
    "impute_simple",
    with_views(
        """WITH m AS (SELECT quantile_cont(CAST(marijuana12 AS DOUBLE), 0.5) AS mm, quantile_cont(CAST(alcohol12 AS DOUBLE), 0.5) AS ma,
                  quantile_cont(CAST(cigarette12 AS DOUBLE), 0.5) AS mc FROM survey_split WHERE split = 'train')
SELECT respondent_id, split, coalesce(CAST(marijuana12 AS DOUBLE), mm) AS marijuana12,
       coalesce(CAST(alcohol12 AS DOUBLE), ma) AS alcohol12, coalesce(CAST(cigarette12 AS DOUBLE), mc) AS cigarette12
FROM survey_split, m""",
        "survey_split",
    ),
)
def q_impute_simple(spark, d):
    s = _split(spark, d).select("respondent_id", "split", *KEYS)
    params = impute.impute_fit(s.where(F.col("split") == "train"), KEYS, "median")
    return impute.impute_apply(s, params, KEYS)


def _mode_sql(c: str) -> str:
    return f"""(SELECT {c} FROM survey_split WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}
       ORDER BY count(*) DESC, {c} ASC LIMIT 1)"""


@register(
    "impute_most_frequent",
    with_views(
        "SELECT respondent_id, split, "
        + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in KEYS)
        + " FROM survey_split",
        "survey_split",
    ),
)
def q_impute_most_frequent(spark, d):
    s = _split(spark, d).select("respondent_id", "split", *KEYS)
    params = impute.impute_fit(s.where(F.col("split") == "train"), KEYS, "most_frequent")
    return impute.impute_apply(s, params, KEYS)


@register(
    "standardize",
    with_views(
        """WITH s AS (SELECT avg(survey_weight) AS m, stddev_pop(survey_weight) AS sd, avg(alcohol12) AS ma,
                  stddev_pop(alcohol12) AS sa FROM survey_split WHERE split = 'train')
SELECT respondent_id, split, (survey_weight - m) / sd AS survey_weight_std, (alcohol12 - ma) / sa AS alcohol12_std
FROM survey_split, s""",
        "survey_split",
    ),
)
def q_standardize(spark, d):
    s = _split(spark, d).select("respondent_id", "split", "survey_weight", "alcohol12")
    out = prep.standardize(s, ["survey_weight", "alcohol12"], ddof=0, stats_from=s.where(F.col("split") == "train"),
                           suffix="_std")
    return out.drop("survey_weight", "alcohol12")


@register(
    "onehot",
    with_views(
        """SELECT respondent_id, split,
       CAST(coalesce(race = 'AUTOMOBILE', false) AS INT) AS race_AUTOMOBILE,
       CAST(coalesce(race = 'BUILDING', false) AS INT) AS race_BUILDING,
       CAST(coalesce(race = 'FURNITURE', false) AS INT) AS race_FURNITURE,
       CAST(coalesce(race = 'HOUSEHOLD', false) AS INT) AS race_HOUSEHOLD,
       CAST(coalesce(region = 2, false) AS INT) AS region_2, CAST(coalesce(region = 3, false) AS INT) AS region_3,
       CAST(coalesce(region = 4, false) AS INT) AS region_4, CAST(coalesce(region = 5, false) AS INT) AS region_5
FROM survey_split""",
        "survey_split",
    ),
)
def q_onehot(spark, d):
    s = _split(spark, d).select("respondent_id", "split", "race", "region")
    train = s.where(F.col("split") == "train")
    # race levels are fitted on training rows without MACHINERY: that level is unseen → all zeros
    out, _ = prep.onehot(s, "race", fit_on=train.where(F.col("race") != "MACHINERY"))
    out, _ = prep.onehot(out, "region", fit_on=train, drop_first=True)
    return out.drop("race", "region")


POLY = ["marijuana12", "alcohol12", "cigarette12", "region"]


@register(
    "poly_interactions",
    with_views(
        "SELECT respondent_id, "
        + ", ".join(f"{a} * {b} AS {a}__x__{b}" for i, a in enumerate(POLY) for b in POLY[i + 1:])
        + " FROM survey_clean",
        "survey_clean",
    ),
)
def q_poly_interactions(spark, d):
    return prep.poly_interactions(fx.survey_clean(spark, d).select("respondent_id", *POLY), POLY).drop(*POLY)


@register(
    "poly_cross_cells",
    with_views(
        "\nUNION ALL ".join(
            f"SELECT '{a}' AS f1, CAST({a} AS VARCHAR) AS v1, '{b}' AS f2, CAST({b} AS VARCHAR) AS v2, count(*) AS n "
            f"FROM survey_clean GROUP BY {a}, {b}"
            for i, a in enumerate(POLY)
            for b in POLY[i + 1:]
        ),
        "survey_clean",
    ),
)
def q_poly_cross_cells(spark, d):
    return prep.cross_cells(fx.survey_clean(spark, d), POLY)


# levels as text, as the preprocessor orders them; race and region are its categorical columns
_PREP_NUMERIC = ["survey_weight", *KEYS]
_PREP_SQL = "WITH " + ", ".join(
    f"s{k} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, avg({c}) AS mean FROM survey_split WHERE split = 'train')" for k, c in enumerate(_PREP_NUMERIC)
) + """,
lv AS (SELECT c, v, row_number() OVER (ORDER BY c, v) AS i FROM (
  SELECT DISTINCT 'race' AS c, race AS v FROM survey_split WHERE split = 'train' UNION SELECT DISTINCT 'region', CAST(region AS VARCHAR) FROM survey_split WHERE split = 'train'))
""" + " UNION ALL ".join(
    f"""SELECT CAST({k} AS INT) AS slot_index, '{c}' AS slot, '{c}' AS base_feature, 'numeric' AS kind,
       count(*) FILTER (WHERE coalesce(CAST({c} AS DOUBLE), med) <> mean) AS n_nonzero FROM survey_split, s{k}"""
    for k, c in enumerate(_PREP_NUMERIC)
) + f"""
UNION ALL SELECT CAST({len(_PREP_NUMERIC) - 1} + i AS INT), c || '=' || v, c, 'categorical',
       (SELECT count(*) FROM survey_split x WHERE CASE lv.c WHEN 'race' THEN x.race ELSE CAST(x.region AS VARCHAR) END = lv.v) FROM lv"""


@register("preprocess_pipeline", with_views(_PREP_SQL, "survey_split"))
def q_preprocess_pipeline(spark, d):
    """Fit the numeric/categorical pipeline on the training split, transform every row; slot metadata joined
    to the number of non-zero values per slot (a data-sized check of the assembled vectors)."""
    s = written(_split(spark, d).select("split", *_PREP_NUMERIC, "race", "region"))
    model, meta = prep.preprocess_pipeline(s.where(F.col("split") == "train"), _PREP_NUMERIC, ["race", "region"])
    from pyspark.ml.functions import vector_to_array

    vec = model.transform(s).select(vector_to_array("features").alias("v"))
    slots = meta.count()  # one wide aggregate, no row per slot
    counts = vec.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("v")[k] != 0) for k in range(slots)]).alias("c"))
    nz = counts.where("n > 0").select(F.posexplode("c").alias("slot_index", "n_nonzero"))
    return meta.join(nz, "slot_index", "left")


MATRIX_SLOTS = 7  # five levels of race, region, alcohol12


@register(
    "model_matrix",
    with_views(
        "WITH lv AS (SELECT race, row_number() OVER (ORDER BY n DESC, race) - 1 AS k FROM (SELECT race, count(*) AS n FROM survey_clean GROUP BY race)) "
        "SELECT respondent_id, y AS label, "
        + ", ".join(f"CAST(lv.k = {k} AS INT)::DOUBLE AS x{k}" for k in range(MATRIX_SLOTS - 2))
        + f", CAST(region AS DOUBLE) AS x{MATRIX_SLOTS - 2}, CAST(alcohol12 AS DOUBLE) AS x{MATRIX_SLOTS - 1} FROM survey_clean JOIN lv USING (race)",
        "survey_clean",
    ),
)
def q_model_matrix(spark, d):
    """The expanded slots: levels of race by frequency, then the numbers as they are (missing stays missing)."""
    from pyspark.ml.functions import vector_to_array

    mm = prep.model_matrix(fx.survey_clean(spark, d), "y ~ race + region + alcohol12").withColumn("x", vector_to_array("features"))
    slots = [F.when(~F.isnan(F.col("x")[k]), F.col("x")[k]).alias(f"x{k}") for k in range(MATRIX_SLOTS)]
    return mm.select("respondent_id", "label", *slots)


# ------------------------------------------------------------------ imputed family (T4)

STACK_COLS = KEYS + ["survey_weight"]


def stack(spark, d):
    # the medians and every statistic of the copies read the written rows
    return impute.imputed_stack(written(fx.survey_clean(spark, d)), STACK_COLS, m=fx.N_IMPUTATIONS)


view(
    "imputed",
    f"""SELECT imp, respondent_id, wave, sex, race, region,
       coalesce(marijuana12, CAST(floor(mm) + imp % 2 AS INT)) AS marijuana12,
       coalesce(alcohol12, CAST(floor(ma) + imp % 2 AS INT)) AS alcohol12,
       coalesce(cigarette12, CAST(floor(mc) + imp % 2 AS INT)) AS cigarette12,
       coalesce(survey_weight, mw + imp % 2) AS survey_weight, y
FROM survey_clean,
     (SELECT quantile_cont(CAST(marijuana12 AS DOUBLE), 0.5) AS mm, quantile_cont(CAST(alcohol12 AS DOUBLE), 0.5) AS ma,
             quantile_cont(CAST(cigarette12 AS DOUBLE), 0.5) AS mc, quantile_cont(survey_weight, 0.5) AS mw FROM survey_clean),
     (SELECT CAST(unnest(range(1, {fx.N_IMPUTATIONS + 1})) AS INT) AS imp)""",
    ("survey_clean",),
)

IMPUTED_COLS = "imp, respondent_id, wave, sex, race, region, marijuana12, alcohol12, cigarette12, survey_weight, y"


@register("imputed_stack", with_views(f"SELECT {IMPUTED_COLS} FROM imputed", "imputed"))
def q_imputed_stack(spark, d):
    return stack(spark, d).select(*[c.strip() for c in IMPUTED_COLS.split(",")])


def _imp_compare_sql():
    parts = []
    for c in STACK_COLS:
        parts.append(
            f"""SELECT imp, '{c}' AS variable, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS sd,
       CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, CAST(max({c}) AS DOUBLE) AS max,
       (SELECT CAST(v AS DOUBLE) FROM (SELECT {c} AS v, count(*) AS n FROM imputed i2 WHERE i2.imp = i1.imp GROUP BY {c})
        ORDER BY n DESC, v ASC LIMIT 1) AS mode
FROM imputed i1 GROUP BY imp"""
        )
    return with_views("\nUNION ALL ".join(parts), "imputed")


@register("imputation_compare", _imp_compare_sql())
def q_imputation_compare(spark, d):
    return profile.imputation_compare(stack(spark, d), STACK_COLS)


# coefficient rows per imputation: y on a binary indicator (code ≥ 4), saturated 2-cell model
BIN_MODELS = [("marijuana", "marijuana12"), ("alcohol", "alcohol12"), ("cigarette", "cigarette12")]


def imp_coefs(spark, d):
    st = stack(spark, d)
    long = st.select(
        "imp", "y",
        F.inline(F.array(*[F.struct(F.lit(m).alias("bin_model"), (F.col(c) >= 4).cast("int").alias("x")) for m, c in BIN_MODELS])),
    )
    coefs, stats = models.logit_by_group(long, ["imp", "bin_model"], "y", ["x"], model="bin")
    coefs = coefs.select("imp", F.col("bin_model").alias("model"), "variable", "beta", "se")
    return coefs, stats


IMP_COEF_SQL = "ic AS (" + "\nUNION ALL ".join(
    f"""SELECT imp, '{m}' AS model, CAST({c} >= 4 AS INT) AS x, sum(y) AS a, count(*) - sum(y) AS b
FROM imputed GROUP BY imp, CAST({c} >= 4 AS INT)"""
    for m, c in BIN_MODELS
) + """),
coefs AS (
  SELECT k0.imp, k0.model, 'intercept' AS variable, ln(k0.a / k0.b) AS beta, sqrt(1 / k0.a + 1 / k0.b) AS se
  FROM ic k0 WHERE k0.x = 0
  UNION ALL
  SELECT k0.imp, k0.model, 'x', ln(k1.a / k1.b) - ln(k0.a / k0.b), sqrt(1 / k0.a + 1 / k0.b + 1 / k1.a + 1 / k1.b)
  FROM ic k0 JOIN ic k1 ON k0.imp = k1.imp AND k0.model = k1.model AND k0.x = 0 AND k1.x = 1)"""


def _isql(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join((IMP_COEF_SQL,) + extra_ctes)
    return with_views(f"WITH {ctes}\n{body}", "imputed")


@register("imputed_coefficients", _isql("SELECT imp, model, variable, beta, se FROM coefs"))
def q_imputed_coefficients(spark, d):
    return imp_coefs(spark, d)[0].select("imp", "model", "variable", "beta", "se")


POOL_SQL = """pool AS (
  SELECT model, variable, avg(beta) AS beta, avg(se * se) AS within_var, coalesce(var_samp(beta), 0) AS between_var,
         count(DISTINCT imp) AS m
  FROM coefs GROUP BY model, variable),
pool2 AS (SELECT *, within_var + (1 + 1 / m) * between_var AS total_var FROM pool),
pool3 AS (SELECT *, sqrt(total_var) AS se, (1 + 1 / m) * between_var / total_var AS lam FROM pool2)"""


@register(
    "rubin_pool",
    _isql(
        f"""SELECT model, variable, beta, within_var, between_var, m, total_var, se, beta / se AS z,
       {two_sided_p_sql('beta / se')} AS p_value, lam AS lambda, CASE WHEN lam > 0 THEN (m - 1) / (lam * lam) END AS df,
       between_var / total_var AS fmi_bt, beta - 1.959963984540054 * se AS ci_lower, beta + 1.959963984540054 * se AS ci_upper,
       exp(beta) AS odds_ratio, between_var = 0 AS degenerate
FROM pool3""",
        POOL_SQL,
    ),
)
def q_rubin_pool(spark, d):
    return inference.rubin_pool(imp_coefs(spark, d)[0])


@register(
    "variance_decomp",
    _isql(
        "SELECT model, variable, within_var, between_var, total_var, between_var / total_var AS b_over_t FROM pool3",
        POOL_SQL,
    ),
)
def q_variance_decomp(spark, d):
    return inference.variance_decomp(inference.rubin_pool(imp_coefs(spark, d)[0]))


@register(
    "mi_vs_single",
    _isql(
        """SELECT p.model, p.variable, p.beta AS beta_pooled, p.se AS se_pooled, c.beta AS beta_single, c.se AS se_single,
       p.se / c.se AS se_inflation, 100 * (p.se / c.se - 1) AS se_inflation_pct
FROM pool3 p JOIN coefs c ON p.model = c.model AND p.variable = c.variable AND c.imp = 1""",
        POOL_SQL,
    ),
)
def q_mi_vs_single(spark, d):
    coefs = imp_coefs(spark, d)[0]
    return inference.mi_vs_single(inference.rubin_pool(coefs), coefs)


@register(
    "lr_test_mi",
    with_views(
        f"""WITH ll AS (
  SELECT imp, 1 AS model_no, 1 AS n_params, sum(y) * ln(avg(y)) + (count(*) - sum(y)) * ln(1 - avg(y)) AS loglik
  FROM imputed GROUP BY imp
  UNION ALL
  SELECT imp, 2, 2, sum(a * ln(a / (a + b)) + b * ln(b / (a + b)))
  FROM (SELECT imp, sum(y) AS a, count(*) - sum(y) AS b FROM imputed GROUP BY imp, CAST(marijuana12 >= 4 AS INT))
  GROUP BY imp),
per AS (SELECT imp, model_no, 2 * (loglik - lag(loglik) OVER (PARTITION BY imp ORDER BY model_no)) AS lr_stat,
               n_params - lag(n_params) OVER (PARTITION BY imp ORDER BY model_no) AS lr_df FROM ll)
SELECT CAST(model_no AS INT) AS model_no, avg(lr_stat) AS lr_stat_mean, CAST(first(lr_df) AS INT) AS lr_df, count(*) AS m,
       {chi2_sf_sql('avg(lr_stat)', 'first(lr_df)')} AS lr_p
FROM per WHERE lr_stat IS NOT NULL GROUP BY model_no""",
        "imputed",
    ),
)
def q_lr_test_mi(spark, d):
    st = stack(spark, d).withColumn("x", (F.col("marijuana12") >= 4).cast("int"))
    null = models.null_model(st, "y", by=["imp"]).select(
        "imp", F.lit(1).alias("model_no"), F.lit(1).alias("n_params"), F.col("null_loglik").alias("loglik")
    )
    _, stats = models.logit_by_group(st, "imp", "y", ["x"], model="x")
    full = stats.select("imp", F.lit(2).alias("model_no"), "n_params", "loglik")
    return inference.lr_test_mi(null.unionByName(full), "imp", "model_no")


MICE_PREDICTORS = ["sex", "region", "wave", "y"]


def _mice(spark, d, sweeps=20):
    return impute.mice(fx.survey_clean(spark, d), "respondent_id", KEYS, MICE_PREDICTORS, m=fx.N_IMPUTATIONS, sweeps=sweeps, seed=SEED)


@register("mice")
def q_mice(spark, d):
    """Chained equations (M = 5 chains, 20 sweeps) on the three key variables."""
    return _mice(spark, d)[0]


@register("mice_trace")
def q_mice_trace(spark, d):
    """Mean and sd per chain, sweep and variable over the first 10 sweeps."""
    return _mice(spark, d, sweeps=10)[1]


@register(
    "mice_invariants",
    with_views(
        "\nUNION ALL ".join(
            f"""SELECT CAST(imp AS INT) AS imp, '{v}' AS variable, count(*) AS n_rows, count(*) - count({v}) AS n_imputed,
       CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_changed, CAST(0 AS BIGINT) AS n_foreign
FROM survey_clean, (SELECT unnest(range(1, {fx.N_IMPUTATIONS + 1})) AS imp) GROUP BY imp"""
            for v in KEYS
        ),
        "survey_clean",
    ),
)
def q_mice_invariants(spark, d):
    """Per chain and variable: rows, imputed cells, and how many are still null, changed an observed cell or hold a
    code that nobody gave (all 0)."""
    before = fx.survey_clean(spark, d).select(F.col("respondent_id"), *[F.col(c).alias(f"o_{c}") for c in KEYS])
    both = _mice(spark, d, sweeps=2)[0].join(before, "respondent_id")
    parts = []
    for c in KEYS:
        codes = [r[0] for r in before.select(f"o_{c}").where(F.col(f"o_{c}").isNotNull()).distinct().collect()]  # a coded item
        old, new = F.col(f"o_{c}"), F.col(c)
        parts.append(both.groupBy("imp").agg(
            F.lit(c).alias("variable"), F.count(F.lit(1)).alias("n_rows"), F.count_if(old.isNull()).alias("n_imputed"),
            F.count_if(new.isNull()).alias("n_null"), F.count_if(old.isNotNull() & (old != new)).alias("n_changed"),
            F.count_if(~new.isin(codes)).alias("n_foreign"),
        ))
    return reduce(DataFrame.unionByName, parts)


CLASS_TARGETS = {"nicotine12": "polyreg", "sex_raw": "logreg"}


@register(
    "mice_classes",
    with_views(
        "\nUNION ALL ".join(
            f"""SELECT CAST(imp AS INT) AS imp, '{v}' AS variable, count(*) AS n_rows, count(*) - count({v}) AS n_imputed,
       CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_changed, CAST(0 AS BIGINT) AS n_foreign
FROM survey_nonull, (SELECT unnest(range(1, 4)) AS imp) GROUP BY imp"""
            for v in CLASS_TARGETS
        ),
        "survey_nonull",
    ),
)
def q_mice_classes(spark, d):
    """Unordered codes imputed by multinomial and binary logits: rows, imputed cells, and how many are still null, changed
    an observed cell or hold a code that nobody gave (all 0)."""
    raw = recode.sentinel_to_null(fx.survey_raw(spark, d), fx.SENTINELS)
    full = impute.mice(raw, "respondent_id", list(CLASS_TARGETS), ["race", "region", "wave"], m=3, sweeps=2, seed=SEED, methods=CLASS_TARGETS)[0]
    both = full.join(raw.select("respondent_id", *[F.col(c).alias(f"o_{c}") for c in CLASS_TARGETS]), "respondent_id").checkpoint()
    parts = []
    for c in CLASS_TARGETS:
        codes = [r[0] for r in raw.select(c).where(F.col(c).isNotNull()).distinct().collect()]  # a coded item
        old, new = F.col(f"o_{c}"), F.col(c)
        parts.append(both.groupBy("imp").agg(
            F.lit(c).alias("variable"), F.count(F.lit(1)).alias("n_rows"), F.count_if(old.isNull()).alias("n_imputed"),
            F.count_if(new.isNull()).alias("n_null"), F.count_if(old.isNotNull() & (old != new)).alias("n_changed"),
            F.count_if(~new.isin(codes)).alias("n_foreign"),
        ))
    return reduce(DataFrame.unionByName, parts)
