"""Inference tables built from coefficient and fit tables (small DataFrames), plus pooling across
imputations. Everything here is Column math or a grouped aggregate; p-values come from
``functions.dist`` so they stay in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavekit.functions import dist
from wavekit.functions.scalars import attach


def lr_test(fits: DataFrame, order_col: str = "model_no", by: Sequence[str] = ()) -> DataFrame:
    """Each model against the previous one in ``order_col`` order: LR = 2(logL − logL_prev),
    df = k − k_prev, p = χ² upper tail. The first model gets NULLs."""
    w = Window.partitionBy(*by).orderBy(order_col)
    prev_ll = F.lag("loglik").over(w)
    prev_k = F.lag("n_params").over(w)
    out = fits.withColumn("lr_stat", 2 * (F.col("loglik") - prev_ll)).withColumn(
        "lr_df", (F.col("n_params") - prev_k).cast("int")
    )
    return out.withColumn("lr_p", dist.chi2_sf(F.col("lr_stat"), F.col("lr_df")))


def lr_between(full_ll, reduced_ll, df) -> dict:
    """LR statistic columns for a row that holds both log-likelihoods."""
    stat = 2 * (full_ll - reduced_ll)
    return {"lr_stat": stat, "lr_df": df, "lr_p": dist.chi2_sf(stat, df)}


def interaction_test(df: DataFrame, y: str, main: Sequence[str], products: Sequence[tuple[str, str]],
                     weight: str | None = None, model: str = "interaction") -> DataFrame:
    """Do the effects of some predictors differ by group? Both models hold all main effects (the group's too); the
    full one adds the products. Coefficients of the full model with the LR test of the products beside them:
    df = number of products. A plain difference in level does not reject."""
    from wavekit.operators.models import logit

    names = [f"{a}_x_{b}" for a, b in products]
    need = list(dict.fromkeys([*main, *(c for p in products for c in p)]))
    rows = df.dropna(subset=need).withColumns({n: F.col(a) * F.col(b) for n, (a, b) in zip(names, products)})
    reduced = logit(rows, y, list(main), weight=weight, model=f"{model}_main")
    full = logit(rows, y, [*main, *names], weight=weight, model=model)
    both = attach(full.stats.select(F.col("loglik").alias("f")), reduced.stats.select(F.col("loglik").alias("r")))
    lr = both.select(*[c.alias(k) for k, c in lr_between(F.col("f"), F.col("r"), F.lit(len(names))).items()])
    return attach(full.coefficients, lr)


def chow_test(pooled: DataFrame, pre: DataFrame, post: DataFrame, k_predictors: int, compat: bool = False) -> DataFrame:
    """Chow-type LR test of a structural break: −2(logL_pooled − logL_pre − logL_post).

    df = k + 1 (predictors plus intercept); ``compat=True`` uses k.
    Inputs are fit tables (one row each).
    """
    df_ = k_predictors if compat else k_predictors + 1
    row = pooled.select(F.col("loglik").alias("ll_pooled"), F.col("n_obs").alias("n_pooled"))
    row = attach(row, pre.select(F.col("loglik").alias("ll_pre"), F.col("n_obs").alias("n_pre")))
    row = attach(row, post.select(F.col("loglik").alias("ll_post"), F.col("n_obs").alias("n_post")))
    stat = -2 * (F.col("ll_pooled") - F.col("ll_pre") - F.col("ll_post"))
    return row.withColumns({"chow_stat": stat, "chow_df": F.lit(df_), "chow_p": dist.chi2_sf(stat, F.lit(df_))})


def align_coefficients(a: DataFrame, b: DataFrame, on: Sequence[str] = ("variable",), suffixes=("_a", "_b"),
                       major_pct: float = 20.0) -> DataFrame:
    """Join two coefficient tables by key: β both sides, difference, % change, OR both sides, major flag."""
    sa, sb = suffixes
    left = a.select(*on, F.col("beta").alias(f"beta{sa}"))
    right = b.select(*on, F.col("beta").alias(f"beta{sb}"))
    j = left.join(right, list(on))
    diff = F.col(f"beta{sb}") - F.col(f"beta{sa}")
    pct = 100 * diff / F.abs(F.col(f"beta{sa}"))
    return j.withColumns(
        {
            "beta_diff": diff,
            "pct_change": pct,
            f"or{sa}": F.exp(F.col(f"beta{sa}")),
            f"or{sb}": F.exp(F.col(f"beta{sb}")),
            "major_change": F.abs(pct) > major_pct,
        }
    )


def or_table(coefs: DataFrame) -> DataFrame:
    """Odds-ratio view of a coefficient table with |ln OR| for ordering (intercept excluded)."""
    return coefs.where(F.col("variable") != "intercept").select(
        *[c for c in coefs.columns if c in ("model", "variable")],
        "odds_ratio", "ci_lower", "ci_upper", "p_value", F.abs(F.col("beta")).alias("abs_log_or"),
    )


def rubin_pool(coefs: DataFrame, keys: Sequence[str] = ("model", "variable"), imp_col: str = "imp",
               level: float = 0.95) -> DataFrame:
    """Rubin's rules per (model, variable): Q̄ = mean β; W = mean se²; B = var(β) (ddof 1);
    T = W + (1 + 1/M)B; se = √T; z; p (normal); λ = (1 + 1/M)B/T; df = (M − 1)/λ²; B/T; CI (normal).

    M identical imputations give B = 0: λ = 0, df = NULL (infinite) and ``degenerate`` = true.
    """
    g = coefs.groupBy(*keys).agg(
        F.avg("beta").alias("beta"),
        F.avg(F.col("se") * F.col("se")).alias("within_var"),
        F.coalesce(F.var_samp("beta"), F.lit(0.0)).alias("between_var"),
        F.countDistinct(imp_col).alias("m"),
    )
    m = F.col("m")
    W, B = F.col("within_var"), F.col("between_var")
    T = W + (1 + 1 / m) * B
    zc = dist.z_crit(level)
    out = g.withColumn("total_var", T).withColumn("se", F.sqrt(T))
    lam = (1 + 1 / m) * B / F.col("total_var")
    out = out.withColumns(
        {
            "z": F.col("beta") / F.col("se"),
            "p_value": dist.two_sided_p(F.col("beta") / F.col("se")),
            "lambda": lam,
            "df": F.when(lam > 0, (m - 1) / (lam * lam)),
            "fmi_bt": B / F.col("total_var"),
            "ci_lower": F.col("beta") - zc * F.col("se"),
            "ci_upper": F.col("beta") + zc * F.col("se"),
            "odds_ratio": F.exp(F.col("beta")),
            "degenerate": B == 0,
        }
    )
    return out


def variance_decomp(pooled: DataFrame, keys: Sequence[str] = ("model", "variable")) -> DataFrame:
    """within, between, total variance and B/T per pooled coefficient."""
    return pooled.select(*keys, "within_var", "between_var", "total_var", (F.col("between_var") / F.col("total_var")).alias("b_over_t"))


def mi_vs_single(pooled: DataFrame, coefs: DataFrame, keys: Sequence[str] = ("model", "variable"), imp_col: str = "imp",
                 single_imp: int = 1) -> DataFrame:
    """SE inflation of pooled estimates against a single imputation (default the first)."""
    single = coefs.where(F.col(imp_col) == single_imp).select(*keys, F.col("beta").alias("beta_single"),
                                                              F.col("se").alias("se_single"))
    j = pooled.select(*keys, F.col("beta").alias("beta_pooled"), F.col("se").alias("se_pooled")).join(single, list(keys))
    return j.withColumns(
        {
            "se_inflation": F.col("se_pooled") / F.col("se_single"),
            "se_inflation_pct": 100 * (F.col("se_pooled") / F.col("se_single") - 1),
        }
    )


def lr_test_mi(fits: DataFrame, imp_col: str = "imp", order_col: str = "model_no") -> DataFrame:
    """Adjacent-model LR statistic per imputation, then its mean over imputations per model pair."""
    per = lr_test(fits, order_col, by=[imp_col]).where(F.col("lr_stat").isNotNull())
    agg = per.groupBy(order_col).agg(
        F.avg("lr_stat").alias("lr_stat_mean"), F.first("lr_df").alias("lr_df"), F.count(F.lit(1)).alias("m")
    )
    return agg.withColumn("lr_p", dist.chi2_sf(F.col("lr_stat_mean"), F.col("lr_df")))


def kish_deff(df: DataFrame, weight: str) -> DataFrame:
    """Kish design effect n·Σw²/(Σw)² (one row)."""
    w = F.col(weight)
    return df.where(w.isNotNull()).agg(
        (F.count(w) * F.sum(w * w) / (F.sum(w) * F.sum(w))).alias("deff"), F.count(w).alias("n")
    )


def se_design_effect(coefs: DataFrame, deff: DataFrame, level: float = 0.95) -> DataFrame:
    """SE·√DEFF with the Wald quantities recomputed (DEFF given as a one-row table)."""
    zc = dist.z_crit(level)
    out = attach(coefs, deff.select("deff")).withColumn("se_adj", F.col("se") * F.sqrt(F.col("deff")))
    return out.withColumns(
        {
            "z_adj": F.col("beta") / F.col("se_adj"),
            "p_adj": dist.two_sided_p(F.col("beta") / F.col("se_adj")),
            "ci_lower_adj": F.exp(F.col("beta") - zc * F.col("se_adj")),
            "ci_upper_adj": F.exp(F.col("beta") + zc * F.col("se_adj")),
        }
    )


def model_summary(coefs: DataFrame, fits: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per model: number of predictors, fit statistics and number of significant predictors."""
    sig = coefs.where(F.col("variable") != "intercept").groupBy("model").agg(
        F.count(F.lit(1)).alias("n_predictors"), F.count_if(F.col("p_value") < alpha).alias("n_significant")
    )
    return fits.join(sig, "model", "left").fillna(0, ["n_predictors", "n_significant"])


def auc_difference_z(a: DataFrame, b: DataFrame, n: int | None = None) -> DataFrame:
    """Simplified z test of two AUCs: se = √((a₁(1−a₁) + a₂(1−a₂))/n), n = test-set size of ``a``.

    Inputs are ``roc_auc`` rows (auc, n_pos, n_neg)."""
    j = attach(a.select(F.col("auc").alias("auc_1"), (F.col("n_pos") + F.col("n_neg")).alias("n")),
               b.select(F.col("auc").alias("auc_2")))
    if n is not None:
        j = j.withColumn("n", F.lit(n))
    se = F.sqrt((F.col("auc_1") * (1 - F.col("auc_1")) + F.col("auc_2") * (1 - F.col("auc_2"))) / F.col("n"))
    z = (F.col("auc_1") - F.col("auc_2")) / se
    return j.withColumns({"auc_diff": F.col("auc_1") - F.col("auc_2"), "se": se, "z": z, "p_value": dist.two_sided_p(z)})


def weighted_vs_unweighted(wcoefs: DataFrame, ucoefs: DataFrame) -> DataFrame:
    """OR both ways and % difference per variable."""
    j = wcoefs.select("variable", F.col("odds_ratio").alias("or_weighted")).join(
        ucoefs.select("variable", F.col("odds_ratio").alias("or_unweighted")), "variable"
    )
    return j.withColumn("or_pct_diff", 100 * (F.col("or_weighted") - F.col("or_unweighted")) / F.col("or_unweighted"))
