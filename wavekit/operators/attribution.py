"""Attribution: slot → base-feature importances, linear Shapley values, pairwise attribution and its
three-way proxy, stability under bootstrap, dependence / local views, partial dependence and permutation
importance. Attribution tensors stay long DataFrames (row, feature[, feature2], phi) aggregated on the
fly — never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavekit.functions.scalars import attach
from wavekit.session import spread

#: Values that a partial dependence is taken at, at most.
MAX_GRID = 1000

Predict = Callable[[DataFrame], DataFrame]  # adds a ``prob`` column


def importance_base(slot_imp: DataFrame, meta: DataFrame, by: Sequence[str] = ("model",), slot: str = "slot",
                    base: str = "base_feature", value: str = "importance") -> DataFrame:
    """Sum slot importances to base features through the (slot → base) metadata table."""
    return slot_imp.join(meta.select(slot, base), slot).groupBy(*by, base).agg(F.sum(value).alias(value))


def coef_importance(coefs: DataFrame, meta: DataFrame, by: Sequence[str] = ("model",), variable: str = "variable",
                    base: str = "base_feature") -> DataFrame:
    """Σ|β| per base feature (intercept excluded)."""
    c = coefs.where(F.col(variable) != "intercept").join(meta.select(F.col("slot").alias(variable), base), variable)
    return c.groupBy(*by, base).agg(F.sum(F.abs("beta")).alias("importance"))


def interaction_rank(terms: DataFrame, components: str = "components", value: str = "beta") -> DataFrame:
    """Σ|β| over expanded terms per original feature combination, by order (number of distinct bases)."""
    bases = F.array_sort(F.array_distinct(F.col(components)))
    t = terms.withColumn("__b", bases)
    return t.groupBy(F.size("__b").alias("order"), F.array_join("__b", " x ").alias("combo")).agg(
        F.sum(F.abs(F.col(value))).alias("importance"), F.count(F.lit(1)).alias("n_terms")
    )


def shap_linear(df: DataFrame, beta: Mapping[str, float], id_col: str, background: DataFrame | None = None) -> DataFrame:
    """φᵢⱼ = βⱼ (xᵢⱼ − E xⱼ), long (id, feature, value, phi); E from ``background`` (default: the rows)."""
    feats = list(beta)
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(F.col(f).cast("double")).alias(f"__m_{f}") for f in feats])
    j = attach(df, means)
    return j.select(
        id_col,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                             (F.lit(float(beta[f])) * (F.col(f).cast("double") - F.col(f"__m_{f}"))).alias("phi"))
                    for f in feats
                ]
            )
        ),
    )


def shap_importance(phi: DataFrame, id_col: str, meta: DataFrame | None = None, sum_slots_first: bool = True,
                    by: Sequence[str] = ()) -> DataFrame:
    """mean|φ| per feature; with slot metadata either sum slots per row before |·| (default) or sum the
    slot-level means. ``by`` (e.g. class) groups are averaged afterwards."""
    by = list(by)
    x = phi
    if meta is not None:
        x = x.join(meta.select(F.col("slot").alias("feature"), "base_feature"), "feature")
        if sum_slots_first:
            x = spread(x.select(*by, id_col, "base_feature", "phi"), id_col)  # a task groups a bounded number of rows
            x = x.groupBy(*by, id_col, "base_feature").agg(F.sum("phi").alias("phi")).withColumnRenamed("base_feature", "feature")
            per = x.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
        else:
            per = x.groupBy(*by, "feature", "base_feature").agg(F.avg(F.abs("phi")).alias("m")).groupBy(
                *by, F.col("base_feature").alias("feature")).agg(F.sum("m").alias("mean_abs_phi"))
    else:
        per = x.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    if by:
        per = per.groupBy("feature").agg(F.avg("mean_abs_phi").alias("mean_abs_phi"))
    return per


def shap_stability(phi: DataFrame, id_col: str, replicates: int = 30, seed: int = 42, cv_unstable: float = 50.0) -> DataFrame:
    """φ computed once; Poisson bootstrap weights per row and replicate; per replicate mean|φ| per feature;
    across replicates: mean, sd (ddof 0), 2.5/97.5 %, CV %, unstable flag."""
    from wavekit.functions.hashing import hash_uniform, poisson1_weight

    reps = phi.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    reps = reps.withColumn("__w", poisson1_weight(hash_uniform(id_col, seed, F.col("replicate"))))
    per = reps.groupBy("replicate", "feature").agg((F.sum(F.col("__w") * F.abs("phi")) / F.sum("__w")).alias("m"))
    out = per.groupBy("feature").agg(
        F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.percentile("m", 0.025).alias("q025"),
        F.percentile("m", 0.975).alias("q975"),
    )
    return out.withColumn("cv_pct", 100 * F.col("sd") / F.col("mean")).withColumn("unstable", F.col("cv_pct") > cv_unstable)


def pair_phi_centred(df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """Pair attributions from products of centred columns: (id, f1, f2, phi) for f1 < f2 in list order."""
    feats = list(features)
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"__m_{f}") for f in feats])
    j = attach(df, means)
    c = {f: F.col(f).cast("double") - F.col(f"__m_{f}") for f in feats}
    return j.select(
        id_col,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), (c[a] * c[b]).alias("phi"))
                    for i, a in enumerate(feats) for b in feats[i + 1:]
                ]
            )
        ),
    )


def attr_pairwise(pair_phi: DataFrame, meta: DataFrame | None = None, n_rows: DataFrame | None = None,
                  id_col: str = "row_id") -> DataFrame:
    """Σ over slot pairs of mean|φᵢⱼ| per unordered base pair (b1 < b2); pairs within one base dropped.

    mean over rows = Σ|φ| / number of rows (partial sums per partition, one small shuffle by pair)."""
    x = pair_phi
    if meta is not None:
        m1 = meta.select(F.col("slot").alias("f1"), F.col("base_feature").alias("__b1"))
        m2 = meta.select(F.col("slot").alias("f2"), F.col("base_feature").alias("__b2"))
        x = x.join(m1, "f1").join(m2, "f2")
    else:
        x = x.withColumn("__b1", F.col("f1")).withColumn("__b2", F.col("f2"))
    x = x.where(F.col("__b1") != F.col("__b2"))
    b1 = F.least("__b1", "__b2")
    b2 = F.greatest("__b1", "__b2")
    n = n_rows if n_rows is not None else pair_phi.agg(F.countDistinct(id_col).alias("__n"))
    agg = x.groupBy(b1.alias("b1"), b2.alias("b2")).agg(F.sum(F.abs("phi")).alias("__s"))
    return attach(agg, n.select(F.col(n.columns[0]).alias("__n"))).select(
        "b1", "b2", (F.col("__s") / F.col("__n")).alias("value")
    )


def attr_pairwise_centred(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """mean|cᵢ·cⱼ| of centred columns per unordered feature pair, over the rows where both are present: the means,
    then one wide aggregate (no row per pair)."""
    feats = list(features)
    j = attach(df, df.agg(*[F.avg(F.col(f).cast("double")).alias(f"__m_{f}") for f in feats]))
    c = {f: F.col(f).cast("double") - F.col(f"__m_{f}") for f in feats}
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    row = j.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.abs(c[a] * c[b])).alias(f"s{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(min(p)).alias("b1"), F.lit(max(p)).alias("b2"), (F.col(f"s{k}") / F.col("n")).alias("value"))
        for k, p in enumerate(pairs)
    ])))


def attr_pairwise_matrix(df: DataFrame, col: str, slots: Sequence[str], meta: Mapping[str, str]) -> DataFrame:
    """Per-row p×p interaction matrices (array<array<double>>) → per base pair Σ|φᵢⱼ| partial sums inside each
    Arrow batch (``mapInPandas``), then one small ``groupBy`` — the p² tensor never leaves the executor."""
    import numpy as np
    import pandas as pd

    bases = sorted(set(meta[s] for s in slots))
    idx = {b: i for i, b in enumerate(bases)}
    nb = len(bases)
    onehot = np.zeros((len(slots), nb))  # slot → base indicator
    onehot[np.arange(len(slots)), [idx[meta[s]] for s in slots]] = 1.0

    def part(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            arr = np.abs(np.stack([np.vstack(m).astype(float) for m in pdf[col]]))  # rows × p × p
            acc = np.einsum("nst,sb,tc->bc", arr, onehot, onehot)  # Σ over rows and slot pairs, per base pair
            # an unordered slot pair {s, t} with s in base i and t in base j is counted once
            rows = [(bases[i], bases[j], float(acc[i, j]), len(pdf)) for i in range(nb) for j in range(i + 1, nb)]
            yield pd.DataFrame(rows, columns=["b1", "b2", "s", "n"])

    out = df.select(col).mapInPandas(part, "b1 string, b2 string, s double, n long")
    tot = out.groupBy("b1", "b2").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return tot.select("b1", "b2", (F.col("s") / F.col("n")).alias("value"))


def three_way_proxy(pairs: DataFrame, value: str = "value") -> DataFrame:
    """Per base triple a < b < c: 2 × (v_ab + v_ac + v_bc) (sum of pairwise values, both directions);
    missing pairs count 0. Each feature meets the later ones of the sorted list (a model-sized array); the three
    pair values are equi-joined from the small pair table."""
    p = pairs.select("b1", "b2", F.col(value).alias("v"))
    feats = p.select(F.col("b1").alias("f1")).union(p.select(F.col("b2"))).distinct()
    later = lambda f: F.filter("__all", lambda x: x > F.col(f))
    tri = attach(feats, feats.agg(F.collect_set("f1").alias("__all")))
    tri = tri.withColumn("f2", F.explode(later("f1"))).withColumn("f3", F.explode(later("f2"))).drop("__all")

    def look(x, y, name):
        return p.select(F.col("b1").alias(x), F.col("b2").alias(y), F.col("v").alias(name))

    t = tri.join(look("f1", "f2", "v12"), ["f1", "f2"], "left").join(look("f1", "f3", "v13"), ["f1", "f3"], "left").join(
        look("f2", "f3", "v23"), ["f2", "f3"], "left")
    total = F.coalesce("v12", F.lit(0.0)) + F.coalesce("v13", F.lit(0.0)) + F.coalesce("v23", F.lit(0.0))
    return t.select("f1", "f2", "f3", (2 * total).alias(value))


def shap_dependence(phi: DataFrame, feature: str, colour: str, id_col: str) -> DataFrame:
    """(id, x, phi, colour value) for one feature, coloured by another feature's value."""
    a = phi.where(F.col("feature") == feature).select(id_col, F.col("value").alias("x"), "phi")
    c = phi.where(F.col("feature") == colour).select(id_col, F.col("value").alias("colour"))
    return a.join(c, id_col, "left")


def local_explain(phi: DataFrame, id_col: str, row_id) -> DataFrame:
    """One row's attributions ordered by |φ| (position 1 = largest)."""
    one = phi.where(F.col(id_col) == row_id)
    w = Window.orderBy(F.desc(F.abs("phi")), "feature")
    return one.withColumn("position", F.row_number().over(w))


def pdp(df: DataFrame, feature: str, values: DataFrame, predict: Predict, inputs: Sequence[str] | None = None) -> DataFrame:
    """Mean prediction with ``feature`` set to each value of ``values`` (column ``value``). The rows are first
    collapsed to the cells of the other columns that the prediction reads (``inputs``; default: all columns) with
    their counts; each cell then meets every value of the grid, which travels as one array (at most
    ``MAX_GRID`` values, more raise), and the predictions are averaged by count."""
    others = [c for c in (inputs or df.columns) if c != feature]
    points = [r.value for r in values.select("value").distinct().limit(MAX_GRID + 1).collect()]
    if len(points) > MAX_GRID:
        raise ValueError(f"{feature}: more than {MAX_GRID} values; bin it or give a grid")
    cells = df.groupBy(*others).agg(F.count(F.lit(1)).alias("__n"))
    at = F.array(*[F.lit(v) for v in points]).cast(T.ArrayType(values.schema["value"].dataType))
    grid = cells.withColumn("value", F.explode(at))
    scored = predict(grid.withColumn(feature, F.col("value")))
    return scored.groupBy("value").agg(
        (F.sum(F.col("prob") * F.col("__n")) / F.sum("__n")).alias("mean_prediction"), F.sum("__n").alias("n")
    )


def pdp_discrete(df: DataFrame, feature: str, predict: Predict, inputs: Sequence[str] | None = None) -> DataFrame:
    """PDP over the observed levels of a discrete feature."""
    levels = df.select(F.col(feature).alias("value")).where(F.col("value").isNotNull()).distinct()
    return pdp(df, feature, levels, predict, inputs)


def pdp_grid(df: DataFrame, feature: str, predict: Predict, n_points: int | None = None,
             quantiles: Sequence[float] | None = None, inputs: Sequence[str] | None = None) -> DataFrame:
    """PDP over an equal-width grid of n points between min and max, or over exact quantiles."""
    x = F.col(feature).cast("double")
    if quantiles is not None:
        from wavekit.operators import profile

        values = profile.quantiles(df, feature, quantiles).select("value")
    else:
        rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        n = n_points or 20
        values = rng.select(
            F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "lo", "hi"
        ).select((F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (n - 1)).alias("value"))
    return pdp(df, feature, values.distinct(), predict, inputs)


def permutation_importance(df: DataFrame, features: Sequence[str], predict: Predict, id_col: str, label: str = "label",
                           repeats: int = 5, seed: int = 42) -> DataFrame:
    """Drop in ROC-AUC when one feature is permuted: mean and sd per feature over ``repeats`` keyed permutations. All
    features and repeats are one frame (``split.permuted``), scored once and evaluated by one grouped AUC."""
    from wavekit.operators.evaluate import roc_auc
    from wavekit.operators.split import permuted

    base = roc_auc(predict(df), label, "prob").select(F.col("auc").alias("base_auc"))
    scored = predict(permuted(df, id_col, features, repeats, seed))
    drops = attach(roc_auc(scored, label, "prob", by=["feature", "repeat"]), base).withColumn("drop", F.col("base_auc") - F.col("auc"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_sd"))
