"""Logistic models on Spark.

Unpenalised / weighted logit
    ``logit`` fits with Spark ML's ``GeneralizedLinearRegression`` (binomial, logit; distributed
    IRLS). When every predictor is discrete (coded survey items, dummies, period terms) the rows
    are first collapsed to predictor cells — ``groupBy(predictors).agg(Σw, Σw·y)`` with map-side
    partial aggregation — and the GLM runs on the cells with ``weightCol``: the same estimates,
    but every IRLS pass touches #cells rows instead of #respondents.
Per-group logit
    ``logit_by_group`` collapses to (group, cell) rows, shuffles once by group and solves each
    group's small Newton problem in ``applyInPandas``; many strata fit in parallel.
Penalised logit / trees / boosting
    Spark ML estimators; see ``ml.py``.

All results are small tables: coefficient rows (model, variable, beta, se, …) and fit rows
(model, n_obs, n_params, loglik, null_loglik, aic, bic, mcfadden_r2).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavekit.functions import dist

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)

COEF_SCHEMA = "model string, variable string, beta double, se double"
FIT_SCHEMA = (
    "model string, n_obs bigint, n_params int, loglik double, null_loglik double, sum_w double"
)


@dataclass
class LogitFit:
    model: str
    variables: list[str]  # "intercept" first
    beta: list[float]
    se: list[float]
    coefficients: DataFrame  # model, variable, beta, se, z, p_value, odds_ratio, ci_lower, ci_upper
    stats: DataFrame  # model, n_obs, n_params, loglik, null_loglik, aic, bic, mcfadden_r2, sum_w

    def linear_predictor(self, cols: Sequence[Column] | None = None) -> Column:
        """β₀ + Σ βⱼ xⱼ as a Column over the feature columns (or the given Columns)."""
        feats = self.variables[1:]
        cols = list(cols) if cols is not None else [F.col(c) for c in feats]
        eta = F.lit(self.beta[0])
        for b, c in zip(self.beta[1:], cols):
            eta = eta + F.lit(b) * c
        return eta

    def probability(self, cols: Sequence[Column] | None = None) -> Column:
        return 1.0 / (1.0 + F.exp(-self.linear_predictor(cols)))

    @property
    def separation(self) -> bool:
        """(Quasi-)separation or a single-class outcome: the MLE does not exist, estimates diverge and
        standard errors blow up or are undefined. Reported, not raised."""
        return any(abs(b) > 30 or not math.isfinite(s) or s > 1e3 for b, s in zip(self.beta, self.se))


def coefficient_table(df: DataFrame, level: float = 0.95) -> DataFrame:
    """(…, beta, se) → adds z, two-sided normal p, odds ratio and Wald CI (all Column math)."""
    zc = dist.z_crit(level)
    b, se = F.col("beta"), F.col("se")
    return df.withColumns(
        {
            "z": b / se,
            "p_value": dist.two_sided_p(b / se),
            "odds_ratio": F.exp(b),
            "ci_lower": F.exp(b - zc * se),
            "ci_upper": F.exp(b + zc * se),
        }
    )


def fit_table(df: DataFrame) -> DataFrame:
    """(model, n_obs, n_params, loglik, null_loglik, sum_w) → adds AIC = 2k − 2logL, BIC = k·ln n − 2logL,
    McFadden R² = 1 − logL/logL₀."""
    k, ll, n = F.col("n_params"), F.col("loglik"), F.col("n_obs")
    return df.withColumns(
        {
            "aic": 2 * k - 2 * ll,
            "bic": k * F.log(n.cast("double")) - 2 * ll,
            "mcfadden_r2": 1 - ll / F.col("null_loglik"),
        }
    )


def _is_discrete(df: DataFrame, cols: Sequence[str]) -> bool:
    return all(isinstance(df.schema[c].dataType, INTEGRAL) for c in cols)


def sufficient_cells(df: DataFrame, y: str, features: Sequence[str], weight: str | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Listwise-complete rows collapsed to (by…, features…) cells with n, w = Σw, wy = Σw·y."""
    keys = list(by) + list(features)
    need = keys + [y] + ([weight] if weight else [])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return (
        df.dropna(subset=need)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(w).alias("w"),
            F.sum(w * F.col(y).cast("double")).alias("wy"),
        )
    )


def _loglik_expr(eta: Column) -> Column:
    """Σ-able cell contribution wy·ln p + (w − wy)·ln(1 − p), written stably in η."""
    # ln p = −ln(1+e^{−η}), ln(1−p) = −ln(1+e^{η})
    lp = -F.log1p(F.exp(-eta))
    lq = -F.log1p(F.exp(eta))
    return F.col("wy") * lp + (F.col("w") - F.col("wy")) * lq


def logit(
    df: DataFrame,
    y: str,
    features: Sequence[str],
    weight: str | None = None,
    model: str = "model",
    cells: bool | None = None,
    max_iter: int = 100,
    tol: float = 1e-12,
) -> LogitFit:
    """Maximum-likelihood logit of ``y`` on ``features`` (listwise deletion; frequency weights optional).

    ``cells=None`` collapses to predictor cells when all predictors are integral.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    spark = df.sparkSession
    features = list(features)
    if cells is None:
        cells = _is_discrete(df, features)
    if cells:
        data = sufficient_cells(df, y, features, weight)
    else:
        need = features + [y] + ([weight] if weight else [])
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        data = df.dropna(subset=need).select(
            *[F.col(c) for c in features], F.lit(1).cast("long").alias("n"), w.alias("w"),
            (w * F.col(y).cast("double")).alias("wy"),
        )
    data = data.withColumn("__yf", F.col("wy") / F.col("w")).persist()
    try:
        if features:
            va = VectorAssembler(inputCols=features, outputCol="__x")
            glr = GeneralizedLinearRegression(
                family="binomial", link="logit", labelCol="__yf", featuresCol="__x", weightCol="w",
                maxIter=max_iter, tol=tol,
            )
            m = glr.fit(va.transform(data))
            beta = [float(m.intercept)] + [float(v) for v in m.coefficients]
            try:
                ses = list(m.summary.coefficientStandardErrors)
                se = [float(ses[-1])] + [float(s) for s in ses[:-1]]
            except Exception:  # constant working response: Spark's WLS skips the covariance
                se = _fisher_se(data, features, beta)
        else:
            tot = data.agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).first()
            p0 = tot["wy"] / tot["w"]
            beta = [math.log(p0 / (1 - p0))]
            se = [math.sqrt(1.0 / (tot["w"] * p0 * (1 - p0)))]
        variables = ["intercept"] + features
        eta = F.lit(beta[0])
        for b, c in zip(beta[1:], features):
            eta = eta + F.lit(b) * F.col(c)
        agg = data.agg(
            F.sum("n").alias("n_obs"),
            F.sum("w").alias("sum_w"),
            F.sum("wy").alias("sum_wy"),
            F.sum(_loglik_expr(eta)).alias("loglik"),
        )
        p0 = F.col("sum_wy") / F.col("sum_w")
        null_ll = F.col("sum_wy") * F.log(p0) + (F.col("sum_w") - F.col("sum_wy")) * F.log(1 - p0)
        stats = agg.select(
            F.lit(model).alias("model"),
            F.col("n_obs").cast("long").alias("n_obs"),
            F.lit(len(variables)).alias("n_params"),
            "loglik",
            null_ll.alias("null_loglik"),
            "sum_w",
        )
        stats = fit_table(spark.createDataFrame([tuple(r) for r in stats.collect()], FIT_SCHEMA))
    finally:
        data.unpersist()
    coefs = coefficient_table(
        spark.createDataFrame([(model, v, b, s) for v, b, s in zip(variables, beta, se)], COEF_SCHEMA)
    )
    return LogitFit(model, variables, beta, se, coefs, stats)


def nested_logits(df: DataFrame, y: str, sets: Sequence[Sequence[str]], weight: str | None = None) -> DataFrame:
    """Plain logits on nested predictor sets over the rows that are complete for the largest one: fit statistics and
    the LR test of each model against the one before."""
    from functools import reduce

    from wavekit.operators.inference import lr_test

    rows = df.dropna(subset=list(dict.fromkeys(f for s in sets for f in s)))
    fits = [logit(rows, y, list(s), weight=weight, model=f"model_{i}").stats.withColumn("model_no", F.lit(i)) for i, s in enumerate(sets, start=1)]
    return lr_test(reduce(DataFrame.unionByName, fits), "model_no")


def _fisher_se(data: DataFrame, features: Sequence[str], beta: Sequence[float]) -> list[float]:
    """√diag((XᵀWX)⁻¹), W = w·p(1−p): the (k+1)(k+2)/2 information sums in one aggregate, inverted on
    the driver (a (k+1)² matrix)."""
    import numpy as np

    eta = F.lit(beta[0])
    for b, c in zip(beta[1:], features):
        eta = eta + F.lit(b) * F.col(c)
    p = 1.0 / (1.0 + F.exp(-eta))
    v = F.col("w") * p * (1 - p)
    xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = data.agg(*[F.sum(v * xs[i] * xs[j]).alias(f"i{i}_{j}") for i, j in pairs]).first()
    info = np.zeros((k, k))
    for i, j in pairs:
        info[i, j] = info[j, i] = row[f"i{i}_{j}"]
    try:
        return [float(s) for s in np.sqrt(np.diag(np.linalg.inv(info)))]
    except np.linalg.LinAlgError:
        return [float("nan")] * k


# ---------------------------------------------------------------- per-group Newton

#: Cells of the largest group up to which a group is solved in one task; larger ones by one aggregate a step.
GROUP_CELLS = 20_000
#: Numbers of a state table (groups × parameters) up to which it is broadcast to the cells.
STATE_NUMBERS = 100_000


def _newton_group(pdf, features, max_iter=100, tol=1e-12):
    """Newton–Raphson for one group's cell table (numpy). Returns beta, se, loglik, n, Σw, Σwy."""
    import numpy as np

    X = np.column_stack([np.ones(len(pdf))] + [pdf[c].to_numpy(dtype=float) for c in features])
    w = pdf["w"].to_numpy(dtype=float)
    wy = pdf["wy"].to_numpy(dtype=float)
    beta = np.zeros(X.shape[1])
    info = None
    for _ in range(max_iter):
        eta = X @ beta
        p = 1.0 / (1.0 + np.exp(-eta))
        grad = X.T @ (wy - w * p)
        info = (X * (w * p * (1 - p))[:, None]).T @ X
        try:
            step = np.linalg.solve(info, grad)
        except np.linalg.LinAlgError:
            step = np.linalg.lstsq(info, grad, rcond=None)[0]
        beta = beta + step
        if np.max(np.abs(step)) < tol:
            break
    eta = X @ beta
    p = 1.0 / (1.0 + np.exp(-eta))
    info = (X * (w * p * (1 - p))[:, None]).T @ X
    try:
        cov = np.linalg.inv(info)
        se = np.sqrt(np.diag(cov))
    except np.linalg.LinAlgError:
        se = np.full(len(beta), np.nan)
    ll = float(np.sum(wy * -np.log1p(np.exp(-eta)) + (w - wy) * -np.log1p(np.exp(eta))))
    return beta, se, ll, int(pdf["n"].sum()), float(w.sum()), float(wy.sum())


def _solve_groups(cells: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(groups…, beta, se, loglik, n_obs, sum_w, sum_wy): every group's cells in one task."""
    import pandas as pd

    kinds = ", ".join(f"{g} {cells.schema[g].dataType.simpleString()}" for g in groups)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        beta, se, ll, n, sw, swy = _newton_group(pdf, features)
        own = {g: [pdf[g].iloc[0]] for g in groups}
        return pd.DataFrame({**own, "beta": [beta.tolist()], "se": [se.tolist()], "loglik": [ll], "n_obs": [n], "sum_w": [sw], "sum_wy": [swy]})

    return cells.groupBy(*groups).applyInPandas(fit, f"{kinds}, beta array<double>, se array<double>, loglik double, n_obs bigint, sum_w double, sum_wy double")


def _newton_by_aggregates(cells: DataFrame, groups: Sequence[str], features: Sequence[str], max_iter: int = 30, tol: float = 1e-9) -> DataFrame:
    """As ``_solve_groups`` for groups of any size: a step is one partially aggregated pass that gives every group's
    gradient and information at its current coefficients; the small systems are solved by group in the tasks of the
    state table, which is written every step. Groups that separate stop at ``max_iter`` with what they have."""
    import numpy as np
    import pandas as pd

    from wavekit.session import saved

    k = len(features) + 1
    xs = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    kinds = ", ".join(f"{g} {cells.schema[g].dataType.simpleString()}" for g in groups)
    state = saved(cells.groupBy(*groups).agg(F.array(*[F.lit(0.0)] * k).alias("beta")))
    small = state.count() * k <= STATE_NUMBERS

    def solve(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            grad = np.vstack(pdf["grad"].to_numpy())
            info = np.zeros((len(pdf), k, k))
            info[:, *np.triu_indices(k)] = np.vstack(pdf["info"].to_numpy())
            info = info + np.triu(info, 1).transpose(0, 2, 1)
            inverse = np.linalg.pinv(info, hermitian=True)
            step = np.einsum("gij,gj->gi", inverse, grad)
            with np.errstate(invalid="ignore"):
                se = np.sqrt(np.einsum("gii->gi", inverse))
            out = pdf[[*groups, "loglik", "n_obs", "sum_w", "sum_wy"]].copy()
            out["beta"], out["se"] = list(np.vstack(pdf["beta"].to_numpy()) + step), list(se)
            out["moved"] = np.abs(step).max(1)
            yield out[[*groups, "beta", "se", "loglik", "n_obs", "sum_w", "sum_wy", "moved"]]

    for _ in range(max_iter):
        betas = state.select(*groups, "beta")
        rows = cells.join(F.broadcast(betas) if small else betas, list(groups))
        eta = xs[0] * F.col("beta")[0]
        for i in range(1, k):
            eta = eta + xs[i] * F.col("beta")[i]
        rows = rows.withColumn("__eta", eta).withColumn("__p", 1.0 / (1.0 + F.exp(-F.col("__eta"))))
        rest, v = F.col("wy") - F.col("w") * F.col("__p"), F.col("w") * F.col("__p") * (1 - F.col("__p"))
        sums = rows.groupBy(*groups).agg(
            F.first("beta").alias("beta"), F.array(*[F.sum(x * rest) for x in xs]).alias("grad"),
            F.array(*[F.sum(v * xs[i] * xs[j]) for i in range(k) for j in range(i, k)]).alias("info"),
            F.sum(_loglik_expr(F.col("__eta"))).alias("loglik"), F.sum("n").cast("long").alias("n_obs"), F.sum("w").alias("sum_w"), F.sum("wy").alias("sum_wy"),
        )
        state = saved(sums.mapInPandas(solve, f"{kinds}, beta array<double>, se array<double>, loglik double, n_obs bigint, sum_w double, sum_wy double, moved double"))
        if (state.agg(F.max("moved")).first()[0] or 0.0) < tol:
            break
    return state.drop("moved")


def logit_by_group(
    df: DataFrame,
    group: str,
    y: str,
    features: Sequence[str],
    weight: str | None = None,
    model: str = "model",
    group_cells: int = GROUP_CELLS,
) -> tuple[DataFrame, DataFrame]:
    """One logit per stratum of ``group`` (any number of strata, fitted in parallel).

    Rows collapse to cells per (group, predictors) with partial aggregation. Where the largest group has at most
    ``group_cells`` of them (coded predictors), a group's cells are solved in one task; beyond that (continuous
    predictors, which need no binning) every Newton step is one aggregate over all groups' cells. Both give the same
    estimates. Returns (coefficients, fit stats), both keyed by ``group``.
    """
    from wavekit.session import saved

    features = list(features)
    groups = [group] if isinstance(group, str) else list(group)
    cells = saved(sufficient_cells(df, y, features, weight, by=groups))
    variables = ["intercept"] + features
    most = cells.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    fits = (_solve_groups if most <= group_cells else _newton_by_aggregates)(cells, groups, features)
    fits = fits.withColumn("model", F.lit(model))
    named = F.arrays_zip(F.array(*[F.lit(v) for v in variables]).alias("variable"), F.col("beta"), F.col("se"))
    long = fits.select(*groups, "model", F.explode(named).alias("x"))
    coefs = coefficient_table(long.select(*groups, "model", *[F.col("x")[c].alias(c) for c in ("variable", "beta", "se")]))
    p0 = F.col("sum_wy") / F.col("sum_w")
    stats = fit_table(
        fits.select(
            *groups,
            "model",
            "n_obs",
            F.lit(len(variables)).alias("n_params"),
            "loglik",
            (F.col("sum_wy") * F.log(p0) + (F.col("sum_w") - F.col("sum_wy")) * F.log(1 - p0)).alias("null_loglik"),
            "sum_w",
        )
    )
    return coefs, stats


def null_model(df: DataFrame, y: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Intercept-only log-likelihood in closed form from Σw and Σw·y (per group when ``by`` is given)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    need = [y] + ([weight] if weight else [])
    agg = df.dropna(subset=need).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum(w).alias("sum_w"), F.sum(w * F.col(y)).alias("sum_wy")
    )
    p0 = F.col("sum_wy") / F.col("sum_w")
    return agg.withColumns(
        {
            "p0": p0,
            "intercept": F.log(p0 / (1 - p0)),
            "null_loglik": F.col("sum_wy") * F.log(p0) + (F.col("sum_w") - F.col("sum_wy")) * F.log(1 - p0),
        }
    )


def saturated_loglik(df: DataFrame, y: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Log-likelihood of the saturated model over the cells of ``by`` (closed form): one row."""
    cells = sufficient_cells(df, y, by, weight)
    p = F.col("wy") / F.col("w")
    contrib = F.when(F.col("wy") > 0, F.col("wy") * F.log(p)).otherwise(0.0) + F.when(
        F.col("w") > F.col("wy"), (F.col("w") - F.col("wy")) * F.log(1 - p)
    ).otherwise(0.0)
    return cells.agg(F.sum(contrib).alias("loglik"), F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_obs"))


def predict_grid(spark: SparkSession, fit: LogitFit, grid: DataFrame) -> DataFrame:
    """Predicted probability for each row of a grid DataFrame holding the model's feature columns."""
    return grid.withColumn("prob", fit.probability())
