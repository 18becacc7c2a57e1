"""Window, rank, top-k and consensus operators.

Inputs here are importance / coefficient / metric tables (features × models), so windows are
partitioned by model (or run over a few hundred rows). Every order has a final tie key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavekit.functions.scalars import attach


def top_n(df: DataFrame, metric: str, k: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """k largest rows by ``metric`` (ties broken by ``key``), overall or per group (``rank`` column)."""
    if not by:
        return df.orderBy(F.desc(metric), F.asc(key)).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(metric), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_by_model(imp: DataFrame, model: str = "model", feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Rank of every feature within its model by importance (1 = most important; ties by feature name)."""
    w = Window.partitionBy(model).orderBy(F.desc(importance), F.asc(feature))
    return imp.withColumn("rank", F.row_number().over(w))


def consensus_tiers(ranked: DataFrame, k: int, model: str = "model", feature: str = "feature") -> DataFrame:
    """m(f) = number of models ranking f within the top k; tier = M + 1 − m(f); features with m = 0 dropped.

    M = number of models in the table (small aggregate broadcast back).
    """
    n_models = ranked.agg(F.countDistinct(model).alias("n_models"))
    m = ranked.groupBy(feature).agg(F.count_if(F.col("rank") <= k).alias("n_models_top"))
    return (
        m.where(F.col("n_models_top") > 0)
        .transform(lambda x: attach(x, n_models))
        .withColumn("tier", (F.col("n_models") + 1 - F.col("n_models_top")).cast("int"))
        .drop("n_models")
    )


def consensus_sensitivity(ranked: DataFrame, ks: Sequence[int], model: str = "model", feature: str = "feature") -> DataFrame:
    """Consensus tiers for several k at once: one ``groupBy(feature)`` with a top-k count per k, unpivoted
    to (k, feature, n_models_top, tier) plus the per-k set sizes."""
    ks = [int(k) for k in ks]
    n_models = ranked.agg(F.countDistinct(model).alias("n_models"))
    wide = ranked.groupBy(feature).agg(*[F.count_if(F.col("rank") <= k).alias(f"__k{k}") for k in ks])
    m = wide.select(
        feature,
        F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__k{k}").alias("n_models_top")) for k in ks])),
    ).select("k", feature, "n_models_top")
    out = attach(m.where(F.col("n_models_top") > 0), n_models)
    out = out.withColumn("tier", (F.col("n_models") + 1 - F.col("n_models_top")).cast("int"))
    sizes = out.groupBy("k").agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("tier") == 1).alias("n_tier1"))
    return out.drop("n_models").join(sizes, "k")


def nested_sets(tiers: DataFrame, n_sets: int | None = None, feature: str = "feature") -> DataFrame:
    """Set j = union of tiers 1..j, for j = 1..n_sets (default: number of tiers): rows (set_no, feature, tier).

    A feature of tier t belongs to sets t..n_sets: one ``explode`` of that range per feature."""
    if n_sets is None:
        n_sets = tiers.agg(F.max("tier")).first()[0] or 0
    member = F.when(F.col("tier") <= n_sets, F.sequence(F.col("tier"), F.lit(n_sets))).otherwise(F.array().cast("array<int>"))
    return tiers.select(F.explode(member).alias("set_no"), feature, "tier").select(
        F.col("set_no").cast("int").alias("set_no"), feature, "tier"
    )


def top_significant(coefs: DataFrame, k: int = 5, alpha: float = 0.05, model: str = "model") -> DataFrame:
    """Per model, the k largest |β| among non-intercept terms with p < alpha; position by p (then |β|)."""
    sig = coefs.where((F.col("variable") != "intercept") & (F.col("p_value") < alpha))
    w = Window.partitionBy(model).orderBy(F.desc(F.abs(F.col("beta"))), F.asc("variable"))
    top = sig.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
    w2 = Window.partitionBy(model).orderBy(F.asc("p_value"), F.desc(F.abs(F.col("beta"))), F.asc("variable"))
    return top.withColumn("position", F.row_number().over(w2))


def adjacent_compare(df: DataFrame, order_col: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each row against the previous one in ``order_col`` order: <c>_prev, <c>_diff, <c>_pct_change."""
    w = Window.partitionBy(*by).orderBy(order_col)
    out = df
    for c in cols:
        prev = F.lag(c).over(w)
        out = out.withColumn(f"{c}_prev", prev)
        out = out.withColumn(f"{c}_diff", F.col(c) - F.col(f"{c}_prev"))
        out = out.withColumn(f"{c}_pct_change", 100 * F.col(f"{c}_diff") / F.abs(F.col(f"{c}_prev")))
    return out


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), dst: str = "avg_rank") -> DataFrame:
    """Average rank (ties get the mean of their positions) within ``by`` — for small tables."""
    w = Window.partitionBy(*by).orderBy(value)
    wt = Window.partitionBy(*by, value)
    return df.withColumn(dst, F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)


def rank_agreement(imp: DataFrame, model: str = "model", feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Spearman ρ between the importance rankings of every pair of models (pairwise-complete features).

    Self-join of the (small) importance table on feature, average ranks per pair, Pearson on ranks.
    """
    a = imp.select(F.col(model).alias("model_a"), F.col(feature).alias("f"), F.col(importance).alias("imp_a"))
    b = imp.select(F.col(model).alias("model_b"), F.col(feature).alias("f"), F.col(importance).alias("imp_b"))
    pairs = a.join(b, "f").where(F.col("model_a") < F.col("model_b")).dropna(subset=["imp_a", "imp_b"])
    pairs = average_rank(pairs, "imp_a", ["model_a", "model_b"], "rank_a")
    pairs = average_rank(pairs, "imp_b", ["model_a", "model_b"], "rank_b")
    return pairs.groupBy("model_a", "model_b").agg(
        F.corr("rank_a", "rank_b").alias("spearman_rho"), F.count(F.lit(1)).alias("n_features")
    )


def model_leaderboard(metrics: DataFrame, score: str = "auc", model: str = "model", baseline: str | None = None) -> DataFrame:
    """Rank models by score; gain over the first-ranked and over the best baseline (or the worst model) in %."""
    w = Window.orderBy(F.desc(score), F.asc(model))
    wall = Window.partitionBy()
    out = metrics.withColumn("position", F.row_number().over(w))
    best = F.max(score).over(wall)
    base = F.max(F.when(F.col(model) == baseline, F.col(score))).over(wall) if baseline else F.min(score).over(wall)
    return out.withColumns(
        {
            "gap_to_best_pct": 100 * (F.col(score) - best) / best,
            "gain_over_baseline_pct": 100 * (F.col(score) - base) / base,
        }
    )
