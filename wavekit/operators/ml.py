"""Classifier panel on Spark ML: penalised logit, random forest, gradient boosting (incl. binned and
two differently regularised boosting members), stacking, grid / random search with fold columns.

Inputs are DataFrames with a vector column; the assembled input is cached once and reused by all
members and folds (the reference's "pre-transform once" tactic), then unpersisted.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunConfig:
    """Seed, split, folds, metric and tuning budget; presets scale the number of random draws."""

    seed: int = 42
    test_size: float = 0.2
    folds: int = 5
    metric: str = "areaUnderROC"
    preset: str = "standard"
    draws: Mapping[str, int] = field(default_factory=lambda: {"fast": 35, "standard": 60, "max": 120})
    parallelism: int = 4

    @property
    def n_draws(self) -> int:
        return self.draws[self.preset]


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def logit_penalized(df: DataFrame, features: Sequence[str], label: str = "label", C: float = 1.0, l1_ratio: float = 0.0,
                    weight: str | None = None, family: str = "binomial", max_iter: int = 200):
    """LogisticRegression with regParam = 1/(C·n), elasticNetParam = l1_ratio, no internal standardisation.
    Returns (model, coefficient table (variable, beta)[, class])."""
    from pyspark.ml.classification import LogisticRegression

    n = df.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * n), elasticNetParam=l1_ratio,
                            standardization=False, maxIter=max_iter, family=family)
    if weight:
        lr.setWeightCol(weight)
    model = lr.fit(df)
    spark = df.sparkSession
    if family == "multinomial":
        mat = model.coefficientMatrix.toArray()
        rows = [(int(k), "intercept", float(model.interceptVector[k])) for k in range(mat.shape[0])]
        rows += [(int(k), f, float(mat[k, j])) for k in range(mat.shape[0]) for j, f in enumerate(features)]
        coefs = spark.createDataFrame(rows, "class int, variable string, beta double")
    else:
        rows = [("intercept", float(model.intercept))] + [(f, float(b)) for f, b in zip(features, model.coefficients)]
        coefs = spark.createDataFrame(rows, "variable string, beta double")
    return model, coefs


def lasso_select(coefs: DataFrame, tol: float = 1e-5) -> DataFrame:
    """Features kept by the best penalised fit: |β| > tol (intercept excluded)."""
    return coefs.where((F.col("variable") != "intercept") & (F.abs(F.col("beta")) > tol))


def random_forest(df: DataFrame, label: str = "label", num_trees: int = 100, max_depth: int = 10, min_instances: int = 1,
                  subset: str = "sqrt", min_info_gain: float = 0.0, bootstrap: bool = True, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, maxDepth=min(max_depth, 30),
                                  minInstancesPerNode=min_instances, featureSubsetStrategy=subset,
                                  minInfoGain=min_info_gain, bootstrap=bootstrap, seed=seed).fit(df)


def gbt(df: DataFrame, label: str = "label", max_iter: int = 100, max_depth: int = 5, step: float = 0.1, subsample: float = 1.0,
        max_bins: int = 32, validation_frac: float | None = 0.1, tol: float = 0.01, subset: str = "all", seed: int = 42,
        id_col: str = "row_id"):
    """Gradient boosting; with ``validation_frac`` a holdout drawn by hashing ``id_col`` (stable under task
    retries and executor loss, unlike ``rand``) drives early stopping."""
    from pyspark.ml.classification import GBTClassifier

    from wavekit.functions.hashing import hash_uniform

    params = dict(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                  subsamplingRate=subsample, maxBins=max_bins, featureSubsetStrategy=subset, seed=seed)
    if validation_frac:
        df = df.withColumn("__valid", hash_uniform(id_col, seed, "valid") < validation_frac)
        params.update(validationIndicatorCol="__valid", validationTol=tol)
    return GBTClassifier(**params).fit(df)


def together(jobs: Mapping[str, Callable[[], object]], parallelism: int = 4) -> dict:
    """{name: result} of independent jobs (fits) that are submitted ``parallelism`` at a time, so that small ones share the
    cluster instead of waiting for each other."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    # each job has its own copy of the caller's properties: a shared one is written by several threads
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        running = {name: pool.submit(inheritable_thread_target(job)) for name, job in jobs.items()}
        return {name: r.result() for name, r in running.items()}


def gbt_panel(df: DataFrame, label: str = "label", seed: int = 42, id_col: str = "row_id") -> dict:
    """Two differently regularised boosting members standing in for the external boosting libraries."""
    return together({
        "boost_a": lambda: gbt(df, label, max_iter=60, max_depth=6, step=0.1, subsample=0.8, subset="onethird", seed=seed, id_col=id_col),
        "boost_b": lambda: gbt(df, label, max_iter=80, max_depth=4, step=0.05, subsample=0.8, max_bins=64, seed=seed + 1, id_col=id_col),
    })


def probability(model, df: DataFrame, label: str = "label", id_col: str | None = None) -> DataFrame:
    """(id?, label, prob of class 1) from a fitted classifier."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    cols = ([id_col] if id_col else []) + [label]
    return out.select(*cols, vector_to_array("probability")[1].alias("prob"))


def search(df: DataFrame, estimator, grid: Sequence[dict], fold_col: str = "fold", label: str = "label",
           parallelism: int = 4, folds: int = 5) -> DataFrame:
    """Cross-validated search over parameter maps (grid or random draws) with a precomputed fold column
    (values 0..folds−1). One row per trial: trial, params (string), mean and sd of the ROC-AUC over the held-out folds
    and over the folds' training rows. Trials are fitted ``parallelism`` at a time, equal ones once; a fold's rows are written
    once, in as few partitions as their number allows: every task of a fit reports to the driver, and side by side the
    fits fill the cluster."""
    from functools import partial
    from statistics import fmean, pstdev

    from wavekit.session import packed

    maps = [{estimator.getParam(k): v for k, v in g.items()} for g in grid]
    own = [next(i for i, h in enumerate(grid) if h == g) for g in grid]  # the first trial with the same settings
    rows = packed(df)

    def trial(job):
        fold, k = job
        train, held = rows.where(F.col(fold_col) != fold), rows.where(F.col(fold_col) == fold)
        model = estimator.copy(maps[k]).fit(train)
        return k, _area(model, held, label), _area(model, train, label)

    jobs = [(f, k) for f in range(folds) for k in sorted(set(own))]
    scores = list(together({job: partial(trial, job) for job in jobs}, parallelism).values())
    out = []
    for k, g in enumerate(grid):
        held, train = ([s[i] for s in scores if s[0] == own[k]] for i in (1, 2))
        out.append((k, str(sorted(g.items())), fmean(held), pstdev(held), fmean(train), pstdev(train)))
    return df.sparkSession.createDataFrame(
        out, "trial int, params string, mean_auc double, sd_auc double, mean_train_auc double, sd_train_auc double"
    )


def _area(model, df: DataFrame, label: str) -> float:
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0).evaluate(model.transform(df))


def balanced_weights(df: DataFrame, label: str = "label", dst: str = "class_weight") -> DataFrame:
    """Add n / (classes · n_class): every class weighs the same in total."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row a class
    n, k = sum(counts.values()), len(counts)
    pairs = [x for c, m in counts.items() for x in (F.lit(c), F.lit(n / (k * m)))]
    return df.withColumn(dst, F.create_map(*pairs)[F.col(label)])


def elasticnet_draws(n: int, seed: int = 42) -> list[dict]:
    """n random settings of the elastic net: C log-uniform over 1e-5 … 1e3, l1_ratio uniform over 0 … 1, tolerance
    log-uniform over 1e-5 … 1e-3, class weights none or balanced."""
    rng = random.Random(seed)
    return [
        {"C": 10 ** rng.uniform(-5, 3), "l1_ratio": rng.random(), "tol": 10 ** rng.uniform(-5, -3), "balanced": rng.random() < 0.5}
        for _ in range(n)
    ]


def search_elasticnet(df: DataFrame, draws: Sequence[dict], fold_col: str = "fold", label: str = "label", folds: int = 5) -> DataFrame:
    """Cross-validated search over ``elasticnet_draws``: one row per draw with its C, l1_ratio, tol and balanced, and mean and
    sd of the ROC-AUC over the held-out folds and over the folds' training rows."""
    n = df.count() * (folds - 1) / folds
    found = search_logit(df, [{"reg": 1.0 / (d["C"] * n), **d} for d in draws], fold_col, label, folds).withColumnRenamed("trial", "draw")
    names = df.sparkSession.createDataFrame(
        [(k, float(d["C"]), float(d["l1_ratio"]), float(d["tol"]), d["balanced"]) for k, d in enumerate(draws)],
        "draw int, C double, l1_ratio double, tol double, balanced boolean",
    )
    return names.join(found, "draw")


def search_logit(df: DataFrame, settings: Sequence[dict], fold_col: str = "fold", label: str = "label", folds: int = 5) -> DataFrame:
    """Cross-validated elastic nets: a row per setting (reg, l1_ratio, tol, balanced) with mean and sd of the ROC-AUC over the
    held-out folds and over the folds' training rows. All settings and folds are fitted together (``elastic_nets``), and all
    their scores are ranked by one grouped AUC, so that the passes over the rows do not grow with settings × folds."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    from wavekit.operators.evaluate import roc_auc
    from wavekit.session import saved

    rows = saved(balanced_weights(df, label, "__w").select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), F.col(fold_col).alias("fold"), "__w"))
    models = [(f, s) for s in settings for f in range(folds)]
    beta = elastic_nets(rows, models)

    def margins(batches):
        import pyarrow as pa

        for b in batches:
            score = _matrix(b, "x") @ beta
            ends = pa.array(np.arange(0, score.size + 1, len(models)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("fold").cast(pa.int32()), b.column("y"), pa.ListArray.from_arrays(ends, pa.array(score.reshape(-1)))], ["fold", "y", "m"])

    shown = rows.mapInArrow(margins, "fold int, y double, m array<double>").select("fold", "y", F.posexplode("m").alias("k", "prob"))
    held = F.col("fold") == F.col("k") % folds
    areas = roc_auc(shown.select("k", held.alias("held"), F.col("y").alias("label"), "prob"), by=["k", "held"])
    of = areas.groupBy(F.floor(F.col("k") / folds).cast("int").alias("trial"))
    pick = lambda f, own, name: f(F.when(own, F.col("auc"))).alias(name)
    return of.agg(
        pick(F.avg, F.col("held"), "mean_auc"), pick(F.stddev_pop, F.col("held"), "sd_auc"),
        pick(F.avg, ~F.col("held"), "mean_train_auc"), pick(F.stddev_pop, ~F.col("held"), "sd_train_auc"),
    )


def _matrix(batch, name: str):
    """Rows × (1 + features) of an Arrow batch's lists, an intercept first."""
    import numpy as np

    x = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.concatenate((np.ones((len(x), 1)), x), axis=1)


def elastic_nets(rows: DataFrame, models: Sequence[tuple], max_iter: int = 50):
    """Coefficients ((1 + features) × models, the intercept first) of many elastic-net logits, each fitted on the rows outside
    its fold: the minimum of mean weighted loss + reg · (l1_ratio · |β|₁ + (1 − l1_ratio) / 2 · |β|²), the intercept free.

    Proximal Newton: one pass over the rows gives every model's loss, gradient and information at its coefficients (a task
    sends models × features² / 2 numbers), the small penalised quadratics are solved by coordinate descent for all models
    at once; a step that raises its objective is halved. ``balanced`` models weigh rows by ``__w``."""
    import numpy as np

    fold, reg, l1 = (np.array([g(m) for m in models]) for g in (lambda m: m[0], lambda m: m[1]["reg"], lambda m: m[1]["l1_ratio"]))
    tol, balanced = np.array([min(m[1]["tol"], 1e-6) for m in models]), np.array([m[1]["balanced"] for m in models])
    p, k = rows.select(F.size("x")).first()[0] + 1, len(models)
    up = np.triu_indices(p)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(max(cores, 1)) if rows.rdd.getNumPartitions() > cores else rows.repartition(cores)
    rows = rows.persist()

    def sums(beta):
        def part(batches):
            import pyarrow as pa

            total, grad, info, weight = np.zeros(k), np.zeros((p, k)), np.zeros((len(up[0]), k)), np.zeros(k)
            for b in batches:
                x, y = _matrix(b, "x"), b.column("y").to_numpy(zero_copy_only=False)[:, None]
                w = np.where(balanced, b.column("__w").to_numpy(zero_copy_only=False)[:, None], 1.0) * (b.column("fold").to_numpy(zero_copy_only=False)[:, None] != fold)
                eta = x @ beta
                prob = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                total += (w * (np.logaddexp(0, eta) - y * eta)).sum(0)
                grad += x.T @ (w * (prob - y))
                info += (x[:, up[0]] * x[:, up[1]]).T @ (w * prob * (1 - prob))
                weight += w.sum(0)
            flat = np.concatenate((total, weight, grad.reshape(-1), info.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()])], ["s"])

        found = sum(np.frombuffer(r.s) for r in rows.mapInArrow(part, "s binary").toLocalIterator())
        total, weight, rest = found[:k], found[k : 2 * k], found[2 * k :]
        weight = np.maximum(weight, 1e-300)
        return total / weight, rest[: p * k].reshape(p, k) / weight, rest[p * k :].reshape(-1, k) / weight

    free = np.arange(p)[:, None] > 0
    l1s, l2s = free * reg * l1, free * reg * (1 - l1)
    beta, best, at = np.zeros((p, k)), np.full(k, np.inf), np.zeros((p, k))
    going = np.ones(k, bool)
    for _ in range(max_iter):
        loss, grad, half = sums(beta)
        objective = loss + (l1s * np.abs(beta) + l2s / 2 * beta**2).sum(0)
        worse = going & (objective > best + 1e-12 * np.abs(best))
        done = going & ~worse & (best - objective <= tol * np.maximum(np.abs(objective), 1e-300) * 1e-2)
        at = np.where(going & ~worse, beta, at)
        best = np.where(going & ~worse, objective, best)
        halved = np.where(worse, (beta + at) / 2, at)
        going &= ~done & ~(worse & (np.abs(beta - at).max(0) <= 1e-9))
        if not going.any():
            break
        info = np.zeros((p, p, k))
        info[up], info[up[::-1]] = half, half
        diagonal = np.einsum("iik->ik", info) + l2s
        step = at.copy()
        for _ in range(1000):
            moved = 0.0
            for j in range(p):
                pull = grad[j] + (info[j] * (step - at)).sum(0) + l2s[j] * step[j]
                solid = diagonal[j] > 1e-12
                z = step[j] - pull / np.where(solid, diagonal[j], 1.0)
                new = np.where(solid, np.sign(z) * np.maximum(np.abs(z) - l1s[j] / np.where(solid, diagonal[j], 1.0), 0.0), step[j])
                moved = max(moved, float(np.abs(new - step[j])[going & ~worse].max(initial=0.0)))
                step[j] = new
            if moved < 1e-9:
                break
        beta = np.where(going, np.where(worse, halved, step), at)
    rows.unpersist()
    return at


def multinomial_path(df: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float], fold_col: str = "fold", folds: int = 5,
                     parallelism: int = 8) -> tuple[float, list[list[float]]]:
    """(penalty with the best mean F1 over the held-out folds, the first of several; coefficients by class of its fit on all
    rows) of a multinomial lasso. Equal rows are counted once and weigh by their number, so a fit's passes read cells, not
    rows. Features are divided by the sd (ddof 1) of the rows of the fit, as the estimator does with unweighted rows."""
    from functools import partial

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from wavekit.session import written

    features = list(features)
    cells = written(df.groupBy(label, fold_col, *features).agg(F.count(F.lit(1)).cast("double").alias("__n")))

    def fit(train, penalty, sd):
        scaled = assemble(train.withColumns({f"__{c}": F.col(c) / sd[c] if sd[c] else F.lit(0.0) for c in features}), [f"__{c}" for c in features], "__x")
        est = LogisticRegression(featuresCol="__x", labelCol=label, weightCol="__n", family="multinomial", elasticNetParam=1.0, regParam=penalty, standardization=False)
        return est.fit(scaled)

    def spread_of(rows):
        n = F.sum("__n")
        mean = rows.agg(*[(F.sum(F.col("__n") * F.col(c)) / n).alias(c) for c in features]).first()
        return rows.agg(*[F.sqrt(F.sum(F.col("__n") * (F.col(c) - mean[c]) ** 2) / (n - 1)).alias(c) for c in features]).first().asDict()

    metric = MulticlassClassificationEvaluator(labelCol=label, weightCol="__n")
    sds = {f: spread_of(cells.where(F.col(fold_col) != f)) for f in range(folds)}

    def trial(f, penalty):
        train, held = cells.where(F.col(fold_col) != f), cells.where(F.col(fold_col) == f)
        scaled = held.withColumns({f"__{c}": F.col(c) / sds[f][c] if sds[f][c] else F.lit(0.0) for c in features})
        return metric.evaluate(fit(train, penalty, sds[f]).transform(assemble(scaled, [f"__{c}" for c in features], "__x")))

    scores = together({(f, k): partial(trial, f, penalty) for f in range(folds) for k, penalty in enumerate(penalties)}, parallelism)
    means = [sum(scores[f, k] for f in range(folds)) / folds for k in range(len(penalties))]
    best = penalties[max(range(len(penalties)), key=lambda k: means[k])]
    sd = spread_of(cells)
    mat = fit(cells, best, sd).coefficientMatrix.toArray()
    return best, [[float(b / sd[c]) if sd[c] else 0.0 for b, c in zip(row, features)] for row in mat]


def random_grid(space: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n random draws from a discrete parameter space (reproducible)."""
    rng = random.Random(seed)
    keys = sorted(space)
    return [{k: rng.choice(list(space[k])) for k in keys} for _ in range(n)]


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    """Full Cartesian grid."""
    from itertools import product

    keys = sorted(space)
    return [dict(zip(keys, vals)) for vals in product(*[list(space[k]) for k in keys])]


def stacking(df: DataFrame, bases: Mapping[str, callable], fold_col: str = "fold", label: str = "label", k: int = 5,
             id_col: str = "row_id"):
    """Out-of-fold probabilities of ≥ 3 base learners → logistic meta-model.

    For each fold f every base is fitted on the other folds and scores fold f; the held-out scores of all
    folds are unioned (one row per id and base), pivoted to one column per base, and the meta-model fits
    on them. The fits are independent and share the cluster. Returns (meta model, base names, out-of-fold table)."""
    from functools import partial, reduce

    from pyspark.ml.classification import LogisticRegression

    if len(bases) < 3:
        raise ValueError("stacking needs at least 3 base models")
    names = list(bases)

    def scored(f, name):
        model = bases[name](df.where(F.col(fold_col) != f))
        return probability(model, df.where(F.col(fold_col) == f), label, id_col).withColumn("base", F.lit(name))

    parts = together({(f, name): partial(scored, f, name) for f in range(k) for name in names}).values()
    oof = reduce(DataFrame.unionByName, parts)
    wide = oof.groupBy(id_col, label).pivot("base", names).agg(F.first("prob"))
    meta_in = assemble(wide, names, "meta_features")
    meta = LogisticRegression(featuresCol="meta_features", labelCol=label).fit(meta_in)
    return meta, names, wide


def stack_scores(meta, fitted: Mapping[str, object], df: DataFrame, label: str = "label", id_col: str = "row_id") -> DataFrame:
    """(id, label, one score per base, prob of the stack) of rows that no base or meta-model was fitted on."""
    from pyspark.ml.functions import vector_to_array

    out = df
    for name, model in fitted.items():
        out = model.transform(out).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    out = meta.transform(assemble(out.select(id_col, label, *fitted), list(fitted), "meta_features"))
    return out.select(id_col, label, *fitted, vector_to_array("probability")[1].alias("prob"))


def stack_weights(meta, names: Sequence[str], spark) -> DataFrame:
    """Meta-model coefficient per base learner, ordered by |coef|."""
    rows = [(n, float(c), abs(float(c))) for n, c in zip(names, meta.coefficients)]
    return spark.createDataFrame(rows, "base string, coefficient double, abs_coefficient double").orderBy(F.desc("abs_coefficient"))


def feature_importances(model, features: Sequence[str], spark, name: str) -> DataFrame:
    """Tree-ensemble importances per assembled slot (model, slot, importance)."""
    imp = model.featureImportances.toArray()
    return spark.createDataFrame([(name, f, float(v)) for f, v in zip(features, imp)], "model string, slot string, importance double")


def class_scores(model, df: DataFrame, label: str, id_col: str, classes: int) -> DataFrame:
    """(id, label, p0 … p_{K−1}): the class probabilities of a multi-class model."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    return model.transform(df).select(id_col, F.col(label).cast("int").alias(label), *[p[k].alias(f"p{k}") for k in range(classes)])


def class_importances(model, df: DataFrame, features: Sequence[str], label: str, id_col: str, classes: int, repeats: int = 3, seed: int = 42) -> DataFrame:
    """(class, feature, importance): drop of a class's one-vs-rest AUC when the feature is permuted over the rows, mean of
    ``repeats``. All permutations are one frame; equal rows (label and features) are counted first and scored once;
    ``features`` are assembled into the model's vector."""
    from pyspark.ml.functions import vector_to_array

    from wavekit.operators.evaluate import roc_auc
    from wavekit.operators.split import permuted

    def scored(rows, *by):
        cells = rows.groupBy(*by, label, *features).agg(F.count(F.lit(1)).alias("__n"))
        p = vector_to_array("probability")
        entries = F.array(*[F.struct(F.lit(k).alias("class"), p[k].alias("prob")) for k in range(classes)])
        out = model.transform(assemble(cells, features)).select(*by, "__n", F.col(label).cast("int").alias("__y"), F.explode(entries).alias("s"))
        long = out.select(*by, "__n", "s.class", "s.prob", (F.col("__y") == F.col("s.class")).cast("int").alias("label"))
        return roc_auc(long, by=[*by, "class"], weight="__n")

    own = df.select(id_col, label, *features)
    base = scored(own).select("class", F.col("auc").alias("base_auc"))
    drops = scored(permuted(own, id_col, features, repeats, seed), "feature", "repeat").join(base, "class")
    return drops.groupBy("class", "feature").agg(F.avg(F.col("base_auc") - F.col("auc")).alias("importance"))


def recalibrate(fit_on: DataFrame, scored: DataFrame, method: str = "platt", label: str = "label", score: str = "prob") -> DataFrame:
    """``scored`` with ``prob_calibrated``: Platt (maximum-likelihood logistic of the label on the score) or isotonic
    mapping, fitted on the rows of ``fit_on``, which should not be those that are reported."""
    if method == "platt":
        from wavekit.operators.models import logit

        fit = logit(fit_on, label, [score], model="platt")
        return scored.withColumn("prob_calibrated", fit.probability([F.col(score)]))
    from pyspark.ml.regression import IsotonicRegression

    m = IsotonicRegression(featuresCol="__s", labelCol=label, predictionCol="prob_calibrated").fit(assemble(fit_on, [score], "__s"))
    return m.transform(assemble(scored, [score], "__s")).drop("__s")
