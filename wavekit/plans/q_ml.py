"""Queries for the classifier panel and model-based compositions (§2.8, §2.9, §2.10 rows-only class), plus
bootstrap standard errors with a Newton-per-replicate SQL twin.

Labelled table (FIXTURES.md T8): documents ⋈ labels, y = quality; features: length, log length, word count
(whole texts), language and source.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavekit.functions.scalars import attach
from wavekit.operators import attribution, evaluate, impute, inference, ml, models, prep, profile, ranking, recode, split
from wavekit.plans import fixtures as fx
from wavekit.plans.newton_sql import newton_ctes, newton_multi, permutation_sql
from wavekit.plans.q_models import TIMED_SQL, timed
from wavekit.plans.q_split import _poisson_case
from wavekit.plans.registry import register
from wavekit.plans.views import view, with_views
from wavekit.session import scratch_path, spread, written
from wavekit.sources import sinks
from wavekit.sources.tables import table

SEED = 42
NUMERIC = ["n_chars", "log_chars", "n_words"]
CATEGORICAL = ["lang", "source"]
C_GRID = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]


def labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    j = docs.join(lab, "doc_id")
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("double").alias("label"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.log1p("n_chars").alias("log_chars"),
        F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("n_words"),
        "lang",
        "source",
    )


def prepared(spark, d):
    """Split (stratified, hash), folds on the training rows, preprocessing fitted on train; returns
    (train, test, pipeline, slot metadata). Both frames carry the assembled ``features`` vector."""
    df = split.split_stratified(labelled(spark, d), "row_id", ["label"], 0.2, SEED)
    df = split.folds_stratified(df, "row_id", ["label", "split"], k=5, seed=SEED)
    pipe, meta = prep.preprocess_pipeline(df.where(F.col("split") == "train"), NUMERIC, CATEGORICAL)
    out = pipe.transform(df).select("row_id", "label", "split", "fold", "features", *NUMERIC, *CATEGORICAL)
    # reliable checkpoint: iterative learners re-read a short lineage (and survive executor loss)
    out = out.checkpoint()
    return out.where(F.col("split") == "train"), out.where(F.col("split") == "test"), pipe, meta


def _auc_row(name, model, test):
    """Metric set of a fitted member on the held-out rows."""
    return evaluate.metric_set(ml.probability(model, test, "label", "row_id")).withColumn("model", F.lit(name))


@register("logit_l2")
def q_logit_l2(spark, d):
    train, _, _, meta = prepared(spark, d)
    _, coefs = ml.logit_penalized(train, _slots(meta), C=1.0, l1_ratio=0.0)
    return coefs


def _slots(meta):
    return [r[0] for r in meta.orderBy("slot_index").select("slot").collect()]


def _search_lasso(spark, d):
    train, _, _, meta = prepared(spark, d)
    n = train.count()
    trials = ml.search_logit(train, [{"reg": 1.0 / (c * n), "l1_ratio": 1.0, "tol": 1e-6, "balanced": False} for c in C_GRID], "fold")
    best = trials.orderBy(F.desc("mean_auc"), "trial").first()["trial"]
    _, coefs = ml.logit_penalized(train, _slots(meta), C=C_GRID[best], l1_ratio=1.0)
    return coefs, trials


@register("logit_lasso")
def q_logit_lasso(spark, d):
    return _search_lasso(spark, d)[0]


@register("search_grid")
def q_search_grid(spark, d):
    from pyspark.ml.classification import RandomForestClassifier

    train, _, _, _ = prepared(spark, d)
    est = RandomForestClassifier(featuresCol="features", labelCol="label", seed=SEED)
    return ml.search(train, est, ml.grid({"maxDepth": [3, 6], "numTrees": [20, 50]}), "fold")


@register("search_random")
def q_search_random(spark, d):
    from pyspark.ml.classification import GBTClassifier

    train, _, _, _ = prepared(spark, d)
    est = GBTClassifier(featuresCol="features", labelCol="label", seed=SEED)
    space = {"maxDepth": [2, 3, 4, 5], "stepSize": [0.05, 0.1, 0.2], "maxIter": [10, 20, 30], "subsamplingRate": [0.7, 1.0]}
    return ml.search(train, est, ml.random_grid(space, ml.RunConfig(preset="fast").n_draws, SEED), "fold", parallelism=8)


@register("logit_elasticnet")
def q_logit_elasticnet(spark, d):
    """Random search over penalty, l1 share, tolerance and class weights; the coefficients of the best draw."""
    train, _, _, meta = prepared(spark, d)
    draws = ml.elasticnet_draws(ml.RunConfig(preset="fast").n_draws, SEED)
    best = ml.search_elasticnet(train, draws).orderBy(F.desc("mean_auc"), "draw").first()
    rows = ml.balanced_weights(train) if best.balanced else train
    _, coefs = ml.logit_penalized(rows, _slots(meta), C=best.C, l1_ratio=best.l1_ratio, weight="class_weight" if best.balanced else None)
    return coefs.select(
        "variable", "beta", *[F.lit(best[c]).alias(c) for c in ("draw", "C", "l1_ratio", "balanced", "mean_auc", "sd_auc", "mean_train_auc")]
    )


@register("lasso_select")
def q_lasso_select(spark, d):
    return ml.lasso_select(_search_lasso(spark, d)[0])


def _poly_coefs(spark, d):
    """(variable, beta, components) of the elastic net on all slots and all products of two and three slots;
    ``components`` are the base features of a term's slots."""
    train, _, _, meta = prepared(spark, d)
    slots = meta.orderBy("slot_index").select("slot", "base_feature").collect()  # slots of the model
    wide, terms = prep.poly_vector(train, len(slots), degree=3)
    names = ["__x__".join(slots[k][0] for k in t) for t in terms]
    _, coefs = ml.logit_penalized(wide, names, C=1.0, l1_ratio=0.5)
    bases = spark.createDataFrame([(n, [slots[k][1] for k in t]) for n, t in zip(names, terms)], "variable string, components array<string>")
    return coefs.join(bases, "variable", "left")


@register("logit_poly")
def q_logit_poly(spark, d):
    return _poly_coefs(spark, d).drop("components")


@register("interaction_rank")
def q_interaction_rank(spark, d):
    return attribution.interaction_rank(_poly_coefs(spark, d).where(F.col("components").isNotNull()))


@register("logit_multinomial")
def q_logit_multinomial(spark, d):
    """Multi-class outcome code (1..5) on the survey items; CV over the penalty, coefficients per class, top-10."""
    feats = ["sex_raw", "region", "marijuana12", "alcohol12", "cigarette12"]
    df = recode.sentinel_to_null(fx.survey_raw(spark, d))
    df = recode.filter_complete(df, ["nicotine12"] + feats).withColumn("label", (F.col("nicotine12") - 1).cast("double"))
    df = split.folds_stratified(written(df.select("respondent_id", "label", *feats)), "respondent_id", ["label"], k=5, seed=SEED)
    lambdas = [10 ** (-1 - k / 10) for k in range(50)]  # penalty path, strongest first
    _, mat = ml.multinomial_path(df, feats, "label", lambdas)
    rows = [(k, f, b) for k, row in enumerate(mat) for f, b in zip(feats, row)]
    coefs = spark.createDataFrame(rows, "class int, variable string, beta double").withColumn("abs_beta", F.abs("beta"))
    return ranking.top_n(coefs, "abs_beta", 10, "variable", by=["class"])


def _panel(train, test):
    fits = {
        "logit_l2": lambda tr: ml.logit_penalized(tr, [], C=1.0)[0],
        "random_forest": lambda tr: ml.random_forest(tr, num_trees=100, max_depth=8, seed=SEED),
        "gbt": lambda tr: ml.gbt(tr, max_iter=50, max_depth=4, seed=SEED),
        "gbt_binned": lambda tr: ml.gbt(tr, max_iter=50, max_depth=4, max_bins=128, seed=SEED),
    }
    return fits


@register("random_forest")
def q_random_forest(spark, d):
    train, test, _, meta = prepared(spark, d)
    model = ml.random_forest(train, num_trees=100, max_depth=8, seed=SEED)
    imp = ml.feature_importances(model, _slots(meta), spark, "random_forest")
    return attach(imp, _auc_row("random_forest", model, test).select("auc"))


@register("gbt")
def q_gbt(spark, d):
    train, test, _, _ = prepared(spark, d)
    return _auc_row("gbt", ml.gbt(train, max_iter=50, max_depth=4, seed=SEED), test)


@register("gbt_binned")
def q_gbt_binned(spark, d):
    train, test, _, _ = prepared(spark, d)
    return _auc_row("gbt_binned", ml.gbt(train, max_iter=50, max_depth=4, max_bins=128, seed=SEED), test)


@register("gbt_panel")
def q_gbt_panel(spark, d):
    train, test, _, _ = prepared(spark, d)
    return reduce(DataFrame.unionByName, [_auc_row(n, m, test) for n, m in ml.gbt_panel(train, seed=SEED).items()])


def _trained_panel(spark, d):
    train, test, _, _ = prepared(spark, d)
    members = ml.together({n: partial(f, train) for n, f in _panel(train, test).items()})
    members.update(ml.gbt_panel(train, seed=SEED))
    return train, test, members


@register("train_panel")
def q_train_panel(spark, d):
    _, test, members = _trained_panel(spark, d)
    rows = reduce(DataFrame.unionByName, [_auc_row(n, m, test) for n, m in members.items()])
    return ranking.model_leaderboard(rows, "auc", baseline="logit_l2")


#: Six kinds of base learners.
STACK_BASES = {
    "logit_l2": lambda tr: ml.logit_penalized(tr, [], C=1.0)[0],
    "logit_lasso": lambda tr: ml.logit_penalized(tr, [], C=0.1, l1_ratio=1.0)[0],
    "random_forest": lambda tr: ml.random_forest(tr, num_trees=50, max_depth=6, seed=SEED),
    "gbt": lambda tr: ml.gbt(tr, max_iter=20, max_depth=3, seed=SEED),
    "gbt_binned": lambda tr: ml.gbt(tr, max_iter=20, max_depth=3, max_bins=128, seed=SEED),
    "boost_a": lambda tr: ml.gbt(tr, max_iter=20, max_depth=4, subsample=0.8, subset="onethird", seed=SEED),
}


@register("stacking")
def q_stacking(spark, d):
    """Meta-model on out-of-fold scores of the training rows; metrics of the stack and of each base on the test
    rows, which none of them has seen."""
    train, test, _, _ = prepared(spark, d)
    meta, names, _ = ml.stacking(train, STACK_BASES, "fold", "label", 5, "row_id")
    fitted = ml.together({n: partial(STACK_BASES[n], train) for n in names})
    scored = ml.stack_scores(meta, fitted, test).checkpoint()
    rows = [evaluate.metric_set(scored, "label", c).withColumn("model", F.lit(n)) for n, c in [("stacking", "prob"), *((n, n) for n in names)]]
    return reduce(DataFrame.unionByName, rows)


@register("stack_weights")
def q_stack_weights(spark, d):
    train, _, _, _ = prepared(spark, d)
    meta, names, _ = ml.stacking(train, STACK_BASES, "fold", "label", 5, "row_id")
    return ml.stack_weights(meta, names, spark)


# half of the rows, by hash, fit the calibration; the others are reported
_HALF = "('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':42:calibration'), 1, 8))::UBIGINT / 4294967296.0 < 0.5"


def _calibration_halves(spark, d):
    from wavekit.functions.hashing import hash_uniform

    s = fx.scored(spark, d).withColumn("__fit", hash_uniform("row_id", SEED, "calibration") < 0.5)
    return s.where("__fit").drop("__fit"), s.where("not __fit").drop("__fit")


@register(
    "recalibrate",
    with_views(
        f"""WITH half AS (SELECT *, {_HALF} AS fit FROM scored),
c AS (SELECT 1 AS g, prob AS x, count(*) AS n, CAST(count(*) AS DOUBLE) AS w, CAST(sum(label) AS DOUBLE) AS wy FROM half WHERE fit GROUP BY prob),
{newton_ctes("c", "m")}
SELECT row_id, label, prob, 1 / (1 + exp(-(b0 + b1 * prob))) AS prob_platt FROM half, m_fit WHERE NOT fit""",
        "scored",
    ),
)
def q_recalibrate(spark, d):
    """Platt scaling fitted on one half of the rows, shown on the other."""
    fit, rest = _calibration_halves(spark, d)
    return ml.recalibrate(fit, rest, "platt").select("row_id", "label", "prob", F.col("prob_calibrated").alias("prob_platt"))


@register(
    "recalibrate_isotonic",
    with_views(
        f"""WITH half AS (SELECT *, {_HALF} AS fit FROM scored),
p AS (SELECT prob2 AS x, CAST(sum(label) AS DOUBLE) AS s, count(*) AS n, row_number() OVER (ORDER BY prob2) AS i FROM half WHERE fit GROUP BY prob2),
t AS (SELECT x, i, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn, s, n FROM p),
-- the isotonic fit at a point: the largest, over starts up to it, of the smallest mean to an end from it on
m AS (SELECT k.i, a.i AS lo, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) AS v FROM t k JOIN t a ON a.i <= k.i JOIN t b ON b.i >= k.i GROUP BY k.i, a.i),
g AS (SELECT t.x, max(m.v) AS y FROM m JOIN t ON t.i = m.i GROUP BY t.x),
e AS (SELECT h.prob2, max(CASE WHEN g.x <= h.prob2 THEN g.x END) AS x0, min(CASE WHEN g.x >= h.prob2 THEN g.x END) AS x1
      FROM (SELECT DISTINCT prob2 FROM half WHERE NOT fit) h, g GROUP BY h.prob2)
SELECT h.row_id, h.label, h.prob2 AS prob, CASE WHEN e.x0 IS NULL THEN u.y WHEN e.x1 IS NULL OR e.x0 = e.x1 THEN l.y
       ELSE l.y + (u.y - l.y) * (h.prob2 - e.x0) / (e.x1 - e.x0) END AS prob_isotonic
FROM half h JOIN e ON e.prob2 = h.prob2 LEFT JOIN g l ON l.x = e.x0 LEFT JOIN g u ON u.x = e.x1 WHERE NOT h.fit""",
        "scored",
    ),
)
def q_recalibrate_isotonic(spark, d):
    """Isotonic calibration of the rounded score, fitted on one half of the rows, shown on the other."""
    fit, rest = (x.withColumn("prob", F.col("prob2")) for x in _calibration_halves(spark, d))
    return ml.recalibrate(fit, rest, "isotonic").select("row_id", "label", "prob", F.col("prob_calibrated").alias("prob_isotonic"))


view(
    "labelled_split",
    """SELECT d.doc_id AS row_id, CAST(l.quality AS DOUBLE) AS label, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CASE WHEN row_number() OVER (PARTITION BY l.quality ORDER BY md5(CAST(d.doc_id AS VARCHAR) || ':42'), d.doc_id)
                 <= round(count(*) OVER (PARTITION BY l.quality) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)


@register("model_registry")
def q_model_registry(spark, d):
    from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel

    _, test, members = _trained_panel(spark, d)
    reg = sinks.ModelRegistry(scratch_path(spark, "registry"))
    for n in ("logit_l2", "random_forest", "gbt"):
        reg.save(f"best_{n}_model", members[n])
    loaded = reg.load_many(
        {"best_logit_l2_model": LogisticRegressionModel, "best_random_forest_model": RandomForestClassificationModel,
         "best_gbt_model": GBTClassificationModel, "best_boost_a_model": GBTClassificationModel},
        minimum=3,
    )
    return reduce(DataFrame.unionByName, [_auc_row(n, m, test) for n, m in loaded.items()])


@register(
    "model_registry_reload",
    with_views(
        """SELECT model, count(*) AS n_rows, count(*) AS n_equal
FROM labelled_split, (SELECT unnest(['logit_l2', 'random_forest', 'gbt']) AS model) WHERE split = 'test' GROUP BY model""",
        "labelled_split",
    ),
)
def q_model_registry_reload(spark, d):
    """Models saved and loaded by name: held-out rows, and those that the loaded model scores like the fitted one."""
    from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel

    train, test, _, _ = prepared(spark, d)
    kinds = {"logit_l2": LogisticRegressionModel, "random_forest": RandomForestClassificationModel, "gbt": GBTClassificationModel}
    fitted = ml.together({n: partial(STACK_BASES[n], train) for n in kinds})
    reg = sinks.ModelRegistry(scratch_path(spark, "registry"))
    for n, model in fitted.items():
        reg.save(f"best_{n}_model", model)
    loaded = reg.load_many({f"best_{n}_model": kind for n, kind in kinds.items()}, minimum=3)
    rows = []
    for n, model in fitted.items():
        own = ml.probability(model, test, id_col="row_id").join(ml.probability(loaded[f"best_{n}_model"], test, id_col="row_id").withColumnRenamed("prob", "again"), ["row_id", "label"])
        rows.append(own.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("prob") - F.col("again")) < 1e-12).alias("n_equal")).withColumn("model", F.lit(n)))
    return reduce(DataFrame.unionByName, rows)


@register(
    "snapshot_features",
    with_views(
        """SELECT split, count(*) AS n, avg(label) AS positive_share, CAST(5 AS BIGINT) AS n_listed,
       CAST((SELECT 3 + count(DISTINCT lang) + count(DISTINCT source) FROM labelled_split WHERE split = 'train') AS INT) AS n_slots,
       count(*) AS n_assembled
FROM labelled_split GROUP BY split""",
        "labelled_split",
    ),
)
def q_snapshot_features(spark, d):
    """What was written is read back and used: the reloaded preprocessor assembles the reloaded rows again."""
    from pyspark.ml.functions import vector_to_array

    train, test, pipe, _ = prepared(spark, d)
    root = sinks.snapshot_features(train.unionByName(test).drop("features"), pipe,
                                   {"numeric": NUMERIC, "categorical": CATEGORICAL}, scratch_path(spark, "snapshot"))
    rows, preprocessor, lists = sinks.load_snapshot(spark, root)
    out = preprocessor.transform(rows.select("split", "label", *lists["numeric"], *lists["categorical"]))
    size = F.size(vector_to_array("features"))
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("positive_share"), F.lit(sum(map(len, lists.values()))).cast("long").alias("n_listed"),
        F.max(size).alias("n_slots"), F.count("features").alias("n_assembled"),
    )


#: The items of the multi-class outcome and their number of classes.
CLASS_FEATS = ["sex_raw", "region", "marijuana12", "alcohol12", "cigarette12"]
N_CLASSES = 5


def _class_forest(spark, d):
    df = recode.sentinel_to_null(fx.survey_raw(spark, d))
    df = recode.filter_complete(df, ["nicotine12", *CLASS_FEATS]).withColumn("label", (F.col("nicotine12") - 1).cast("double"))
    df = spread(df.select("respondent_id", "label", *CLASS_FEATS), "respondent_id")
    df = split.split_stratified(df, "respondent_id", ["label"], 0.2, SEED).checkpoint()
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    return ml.random_forest(ml.assemble(train, CLASS_FEATS), num_trees=100, max_depth=8, seed=SEED), test


@register("random_forest_classes")
def q_random_forest_classes(spark, d):
    """Multi-class forest on the outcome code: held-out one-vs-rest AUC of every class, their means, and accuracy."""
    model, test = _class_forest(spark, d)
    scores = ml.class_scores(model, ml.assemble(test, CLASS_FEATS), "label", "respondent_id", N_CLASSES).checkpoint()
    named = scores.withColumn("label", F.col("label").cast("string"))
    per = evaluate.roc_auc_ovr(named, "label", {str(k): f"p{k}" for k in range(N_CLASSES)})
    best = F.array_position(F.array(*[F.col(f"p{k}") for k in range(N_CLASSES)]), F.greatest(*[F.col(f"p{k}") for k in range(N_CLASSES)])) - 1
    return attach(per, scores.agg(F.avg((best == F.col("label")).cast("double")).alias("accuracy")))


@register("random_forest_class_importances")
def q_random_forest_class_importances(spark, d):
    """Drop of each class's one-vs-rest AUC when an item is permuted over the held-out rows."""
    model, test = _class_forest(spark, d)
    return ml.class_importances(model, test, CLASS_FEATS, "label", "respondent_id", N_CLASSES, repeats=3, seed=SEED)


# ------------------------------------------------------------------ survey-based compositions

SURVEY_FEATS = ["time", "sex", "marijuana12", "alcohol12", "cigarette12", "region"]


def _survey_complete(spark, d):
    # the period terms without the weight, whose mean would be one more pass over the survey
    return recode.filter_complete(recode.period_terms(fx.survey_clean(spark, d), "wave", fx.BREAK_YEAR), SURVEY_FEATS)


def _held_out_logit(train, test, feats, name):
    """Plain (cell-collapsed) logit on the training rows; its fit statistics there and its metric set on the test
    rows."""
    fit = models.logit(train, "y", feats, model=name)
    scores = evaluate.metric_set(test.withColumn("prob", fit.probability()), "y", "prob")
    return attach(fit.stats, scores).withColumn("n_features", F.lit(len(feats)))


def _survey_split(spark, d):
    df = spread(_survey_complete(spark, d).select("respondent_id", "y", *SURVEY_FEATS), "respondent_id")
    df = split.split_stratified(df, "respondent_id", ["y"], 0.2, SEED).checkpoint()
    return df.where(F.col("split") == "train"), df.where(F.col("split") == "test")


def _survey_importances(train):
    """(model, feature, importance) of a forest, a boosting and a standardised logit on the training rows."""
    va = ml.assemble(train, SURVEY_FEATS).withColumnsRenamed({"y": "label", "respondent_id": "row_id"})
    spark = train.sparkSession
    trees = {"random_forest": ml.random_forest(va, num_trees=50, max_depth=6, seed=SEED), "gbt": ml.gbt(va, max_iter=30, max_depth=4, seed=SEED)}
    imps = [ml.feature_importances(m, SURVEY_FEATS, spark, n).withColumnRenamed("slot", "feature") for n, m in trees.items()]
    sd = train.agg(*[F.stddev_pop(c).alias(c) for c in SURVEY_FEATS]).first()
    beta = models.logit(train, "y", SURVEY_FEATS, model="logit").coefficients.where("variable <> 'intercept'")
    scale = F.create_map(*[x for c in SURVEY_FEATS for x in (F.lit(c), F.lit(float(sd[c])))])
    imps.append(beta.select("model", F.col("variable").alias("feature"), F.abs(F.col("beta") * scale[F.col("variable")]).alias("importance")))
    return reduce(DataFrame.unionByName, imps).checkpoint()


def _consensus_sets(imps, k=3):
    """Nested feature sets by consensus tier: [[tier 1], [tiers 1-2], ...] (sets that add nothing are left out)."""
    tiers = ranking.consensus_tiers(ranking.rank_by_model(imps), k=k)
    rows = ranking.nested_sets(tiers).collect()  # features x tiers
    sets: dict[int, list[str]] = {}
    for r in rows:
        sets.setdefault(r.set_no, []).append(r.feature)
    out: list[list[str]] = []
    for no in sorted(sets):
        feats = [f for f in SURVEY_FEATS if f in sets[no]]
        if not out or len(feats) > len(out[-1]):
            out.append(feats)
    return out


@register("baseline_panel")
def q_baseline_panel(spark, d):
    """Five feature sets — theory list, lasso-selected, top by boosting importance, consensus, all — each refit as a
    plain logit on the training rows and scored on the test rows."""
    from pyspark.ml.classification import LogisticRegression

    train, test = _survey_split(spark, d)
    n = train.count()
    lasso = LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / (0.01 * n), elasticNetParam=1.0,
                               standardization=True).fit(ml.assemble(train, SURVEY_FEATS))
    lasso_sel = [f for f, b in zip(SURVEY_FEATS, lasso.coefficients) if abs(b) > 1e-5] or SURVEY_FEATS[:1]
    imps = _survey_importances(train)
    top = [r.feature for r in ranking.top_n(imps.where("model = 'gbt'"), "importance", 3, "feature").collect()]
    sets = {"theory": ["sex", "marijuana12", "alcohol12"], "lasso": lasso_sel, "boosted_top": top,
            "consensus": _consensus_sets(imps)[-1], "all": SURVEY_FEATS}
    return reduce(DataFrame.unionByName, [_held_out_logit(train, test, feats, name) for name, feats in sets.items()])


@register("incremental_value")
def q_incremental_value(spark, d):
    """Consensus tiers added one after the other: fit statistics and LR test against the tier before on the
    training rows; held-out AUC, its gain over the tier before and over the first, and the z test against it."""
    train, test = _survey_split(spark, d)
    sets = _consensus_sets(_survey_importances(train))
    if sets[-1] != SURVEY_FEATS:
        sets.append(SURVEY_FEATS)
    rows = [_held_out_logit(train, test, feats, f"tier_{i}").withColumn("tier", F.lit(i)) for i, feats in enumerate(sets, start=1)]
    fits = reduce(DataFrame.unionByName, rows).checkpoint()
    out = ranking.adjacent_compare(inference.lr_test(fits, "tier"), "tier", ["auc"])
    first = fits.where("tier = 1").select(F.col("auc").alias("auc_first"))
    out = attach(out, first).withColumn("auc_gain_first", F.col("auc") - F.col("auc_first"))
    n = F.col("n_pos") + F.col("n_neg")
    se = F.sqrt((F.col("auc") * (1 - F.col("auc")) + F.col("auc_first") * (1 - F.col("auc_first"))) / n)
    return out.withColumn("p_first", F.when(F.col("tier") > 1, inference.dist.two_sided_p(F.col("auc_gain_first") / se)))


@register("nested_models")
def q_nested_models(spark, d):
    """Logits on the nested consensus sets, same complete rows, with adjacent LR tests."""
    df = _survey_complete(spark, d).checkpoint()
    sets = _consensus_sets(_survey_importances(df))
    return models.nested_logits(df, "y", sets)


@register("temporal_validation")
def q_temporal_validation(spark, d):
    """Panel fitted on the early waves, scored on the late waves."""
    feats = [f for f in SURVEY_FEATS if f != "time"]
    df = split.split_temporal(_survey_complete(spark, d), "wave", 1999, 2000)
    va = ml.assemble(df, feats).withColumnRenamed("y", "label").withColumnRenamed("respondent_id", "row_id").checkpoint()
    train, test = va.where(F.col("split") == "train"), va.where(F.col("split") == "test")
    members = ml.together({n: partial(fit, train) for n, fit in STACK_BASES.items()})
    return reduce(DataFrame.unionByName, [_auc_row(n, m, test) for n, m in members.items()])


@register("robust_imputation")
def q_robust_imputation(spark, d):
    """Forest AUC by imputation strategy (fitted on the training split), difference from the median baseline."""
    keys = list(fx.KEY_VARS)
    feats = keys + ["sex", "region", "time"]
    df = recode.period_terms(fx.survey_clean(spark, d), "wave", fx.BREAK_YEAR)
    df = spread(df.select("respondent_id", "y", *feats), "respondent_id")
    df = split.split_stratified(df, "respondent_id", ["y"], 0.2, SEED).withColumnRenamed("y", "label")
    df = df.withColumnRenamed("respondent_id", "row_id").checkpoint()

    def fitted(strategy, fill):
        tr, te, _ = impute.impute_simple(df.where(F.col("split") == "train"), df.where(F.col("split") == "test"), keys, strategy, fill)
        return _auc_row(strategy, ml.random_forest(ml.assemble(tr, feats), num_trees=50, max_depth=6, seed=SEED), ml.assemble(te, feats))

    fills = {"median": None, "mean": None, "most_frequent": None, "constant": 0}
    out = reduce(DataFrame.unionByName, ml.together({s: partial(fitted, s, f) for s, f in fills.items()}).values())
    return profile.diff_from_first(out.withColumn("order", F.when(F.col("model") == "median", 0).otherwise(1)), "auc",
                                   "order", "auc_diff_from_median").drop("order")


def _repeat_sql() -> str:
    feats = ", ".join(SURVEY_FEATS)
    eta = "b0 + " + " + ".join(f"b{i} * {c}" for i, c in enumerate(SURVEY_FEATS, start=1))
    return with_views(
        f"""WITH timed AS ({TIMED_SQL}),
rs AS MATERIALIZED (SELECT r.seed, t.*, row_number() OVER (PARTITION BY r.seed, y ORDER BY md5(CAST(respondent_id AS VARCHAR) || ':' || r.seed), respondent_id)
         <= round(count(*) OVER (PARTITION BY r.seed, y) * 0.2) AS test
       FROM timed t, (SELECT unnest(range(0, 10)) AS seed) r WHERE {" AND ".join(f"{f} IS NOT NULL" for f in SURVEY_FEATS)}),
ic AS MATERIALIZED (SELECT seed, {feats}, count(*) AS n, CAST(count(*) AS DOUBLE) AS w, sum(y) AS wy FROM rs WHERE NOT test GROUP BY seed, {feats}),
{newton_multi("ic", "p", SURVEY_FEATS, group="seed")},
per AS (SELECT seed, prob, sum(y) AS pos, count(*) - sum(y) AS neg FROM (SELECT rs.seed, y, 1 / (1 + exp(-({eta}))) AS prob FROM rs JOIN p_fit ON p_fit.g = rs.seed WHERE test) GROUP BY seed, prob),
aucs AS (SELECT seed, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc
         FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY seed ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per) GROUP BY seed)
SELECT avg(auc) AS mean, stddev_samp(auc) AS sd, min(auc) AS min, max(auc) AS max, max(auc) - min(auc) AS range,
       quantile_cont(auc, 0.025) AS q025, quantile_cont(auc, 0.975) AS q975, count(*) AS n FROM aucs""",
        "survey_clean",
    )


@register("repeat_splits", _repeat_sql())
def q_repeat_splits(spark, d):
    """Ten seeds: stratified split, plain logit refit, test AUC; summary over seeds. All seeds are groups of one split, one
    fit and one AUC."""
    rows = _survey_complete(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9))))
    rows = split.split_stratified(rows, "respondent_id", ["seed", "y"], 0.2, F.col("seed")).select("seed", "y", "split", *SURVEY_FEATS).checkpoint()
    coefs, _ = models.logit_by_group(rows.where("split = 'train'"), "seed", "y", SURVEY_FEATS, model="seed")
    wide = coefs.groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("variable", "beta"))).alias("b"))
    eta = F.col("b")["intercept"]
    for f in SURVEY_FEATS:
        eta = eta + F.col("b")[f] * F.col(f)
    test = rows.where("split = 'test'").join(wide, "seed").withColumn("prob", 1 / (1 + F.exp(-eta)))
    return profile.robustness_summary(evaluate.roc_auc(test, "y", "prob", by=["seed"]).select("seed", "auc"), "auc")


def _importance_sql(repeats: int = 5) -> str:
    cells = ", ".join(SURVEY_FEATS)
    names = ", ".join(f"'{f}'" for f in SURVEY_FEATS)
    value = lambda t: "CASE f " + " ".join(f"WHEN '{f}' THEN {t}.{f}" for f in SURVEY_FEATS) + " END"
    eta = "b0 + " + " + ".join(f"b{i} * CASE WHEN f = '{c}' THEN v ELSE {c} END" for i, c in enumerate(SURVEY_FEATS, start=1))
    auc = "sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg))"
    counts = "sum(y) AS pos, count(*) - sum(y) AS neg"
    return with_views(
        f"""WITH timed AS ({TIMED_SQL}),
cc AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(CAST(respondent_id AS VARCHAR) || ':42')) - 1 AS i FROM timed
                    WHERE {" AND ".join(f"{f} IS NOT NULL" for f in SURVEY_FEATS)}),
ic AS MATERIALIZED (SELECT {cells}, count(*) AS n, CAST(count(*) AS DOUBLE) AS w, sum(y) AS wy FROM cc GROUP BY {cells}),
{newton_multi("ic", "p", SURVEY_FEATS)},
dim AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM cc),
jobs AS (SELECT f, r FROM (SELECT unnest([{names}]) AS f), (SELECT unnest(range(0, {repeats})) AS r)),
sent AS (SELECT {permutation_sql("i", "n", "a", "'42:' || f || ':' || r")} AS i, f, r, {value("cc")} AS v FROM cc, jobs, dim),
shown AS (SELECT f, r, y, 1 / (1 + exp(-({eta}))) AS prob FROM sent JOIN cc USING (i), p_fit),
per AS (SELECT f, r, prob, {counts} FROM shown GROUP BY f, r, prob),
aucs AS (SELECT f, r, {auc} AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY f, r ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per) GROUP BY f, r),
b0s AS (SELECT prob, {counts} FROM (SELECT y, 1 / (1 + exp(-(b0 + {" + ".join(f"b{i} * {c}" for i, c in enumerate(SURVEY_FEATS, start=1))}))) AS prob FROM cc, p_fit) GROUP BY prob),
base AS (SELECT {auc} AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b0s))
SELECT f AS feature, avg(base.auc - aucs.auc) AS importance_mean, stddev_pop(base.auc - aucs.auc) AS importance_sd FROM aucs, base GROUP BY f""",
        "survey_clean",
    )


@register("permutation_importance", _importance_sql())
def q_permutation_importance(spark, d):
    df = written(_survey_complete(spark, d).select("respondent_id", "y", *SURVEY_FEATS))
    fit = models.logit(df, "y", SURVEY_FEATS, model="all")
    predict = lambda x: x.withColumn("prob", fit.probability())
    return attribution.permutation_importance(df, SURVEY_FEATS, predict, "respondent_id", "y", repeats=5)


@register("pdp_panel")
def q_pdp_panel(spark, d):
    """PDP of the outcome over alcohol12 levels for a plain logit and a forest (from leaf shares), stacked with a model
    column."""
    from wavekit.operators import treeshap

    df = _survey_complete(spark, d).checkpoint()
    fit = models.logit(df, "y", SURVEY_FEATS, model="logit")
    logit_pred = lambda x: x.withColumn("prob", fit.probability())
    rf = ml.random_forest(ml.assemble(df, SURVEY_FEATS).withColumnRenamed("y", "label"), num_trees=50, max_depth=6, seed=SEED)
    a = attribution.pdp_discrete(df, "alcohol12", logit_pred, SURVEY_FEATS).withColumn("model", F.lit("logit"))
    b = treeshap.tree_pdp(ml.assemble(df, SURVEY_FEATS), rf, "features", {"alcohol12": [SURVEY_FEATS.index("alcohol12")]}, scratch_path(spark, "pdp"))
    b = b.select(F.col("value")[0].cast(a.schema["value"].dataType).alias("value"), "mean_prediction", "n", F.lit("random_forest").alias("model"))
    return a.unionByName(b)


B_BOOT = 100


@register(
    "bootstrap_se",
    with_views(
        f"""WITH timed AS ({TIMED_SQL}),
bw AS (SELECT r.r AS g, CAST(time AS DOUBLE) AS x, y,
              {_poisson_case("('0x' || substr(md5(CAST(respondent_id AS VARCHAR) || ':42:' || CAST(r.r AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0")} AS bw
       FROM timed, (SELECT unnest(range(1, {B_BOOT + 1})) AS r) r),
c AS (SELECT g, x, count(*) AS n, CAST(sum(bw) AS DOUBLE) AS w, sum(bw * y) AS wy FROM bw GROUP BY g, x),
{newton_ctes("c", "m")}
SELECT 'intercept' AS variable, avg(b0) AS beta_mean, stddev_samp(b0) AS bootstrap_se, count(*) AS replicates FROM m_fit
UNION ALL SELECT 'time', avg(b1), stddev_samp(b1), count(*) FROM m_fit""",
        "survey_clean",
    ),
)
def q_bootstrap_se(spark, d):
    """SE of the trend coefficients from B = 100 Poisson-bootstrap refits, all replicates fitted in parallel
    (replicate = group of the per-group cell Newton solver)."""
    bw = split.bootstrap_weights(timed(spark, d), "respondent_id", B_BOOT, SEED)
    coefs, _ = models.logit_by_group(bw, "replicate", "y", ["time"], weight="boot_w", model="time")
    return coefs.groupBy("variable").agg(
        F.avg("beta").alias("beta_mean"), F.stddev_samp("beta").alias("bootstrap_se"), F.count(F.lit(1)).alias("replicates")
    )


def _tree_phi(spark, d):
    from wavekit.operators import treeshap

    train, test, _, meta = prepared(spark, d)
    model = ml.random_forest(train, num_trees=50, max_depth=6, seed=SEED)
    phi, base, kind = treeshap.shap_tree(test, model, "features", "row_id", _slots(meta), scratch_path(spark, "treeshap"))
    return phi, base, meta


@register("shap_tree")
def q_shap_tree(spark, d):
    """Path-dependent tree Shapley values of a forest for every test row (long: row, slot, phi)."""
    phi, base, _ = _tree_phi(spark, d)
    return phi.withColumn("expected_value", F.lit(base))


@register("shap_tree_importance")
def q_shap_tree_importance(spark, d):
    """mean|φ| per base feature, slots summed per row before the absolute value."""
    phi, _, meta = _tree_phi(spark, d)
    return attribution.shap_importance(phi, "row_id", meta=meta.select("slot", "base_feature"), sum_slots_first=True)


@register(
    "shap_tree_additive",
    with_views("SELECT count(*) AS n_rows, count(*) AS n_additive FROM labelled_split WHERE split = 'test'", "labelled_split"),
)
def q_shap_tree_additive(spark, d):
    """Held-out rows, and those of them whose attributions and expected value add up to the forest's probability."""
    from pyspark.ml.functions import vector_to_array

    from wavekit.operators import treeshap

    train, test, _, meta = prepared(spark, d)
    model = ml.random_forest(train, num_trees=50, max_depth=6, seed=SEED)
    phi, base, _ = treeshap.shap_tree(test, model, "features", "row_id", _slots(meta), scratch_path(spark, "treeshap"))
    total = phi.groupBy("row_id").agg(F.sum("phi").alias("total"))
    shown = model.transform(test).select("row_id", vector_to_array("probability")[1].alias("p")).join(total, "row_id")
    return shown.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("p") - F.col("total") - base) < 1e-9).alias("n_additive"))


def _tree_pairs(spark, d):
    from wavekit.operators import treeshap

    train, test, _, meta = prepared(spark, d)
    model = ml.random_forest(train, num_trees=50, max_depth=6, seed=SEED)
    base = {r.slot: r.base_feature for r in meta.collect()}  # slots of the model
    return treeshap.tree_interactions(test, model, "features", _slots(meta), scratch_path(spark, "treeshap"), base)


@register("attr_pairwise_tree")
def q_attr_pairwise_tree(spark, d):
    """Pair Shapley values of a forest on the held-out rows, per pair of base features."""
    return _tree_pairs(spark, d)


@register("three_way_proxy_tree")
def q_three_way_proxy_tree(spark, d):
    """Three-way proxy from the forest's pair Shapley values."""
    return attribution.three_way_proxy(_tree_pairs(spark, d))


@register(
    "pdp_tree_agrees",
    with_views("SELECT feature, count(DISTINCT v) AS n_values, count(DISTINCT v) AS n_equal FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f} AS v FROM survey_clean WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SURVEY_FEATS if c != "time") for f in ("sex", "alcohol12", "region")
    ) + ") GROUP BY feature", "survey_clean"),
)
def q_pdp_tree_agrees(spark, d):
    """Partial dependence of a forest from leaf shares against scoring every cell again: values, and those that agree."""
    from pyspark.ml.functions import vector_to_array

    from wavekit.operators import treeshap

    df = _survey_complete(spark, d).checkpoint()
    rf = ml.random_forest(ml.assemble(df, SURVEY_FEATS).withColumnRenamed("y", "label"), num_trees=20, max_depth=6, seed=SEED)
    feats = ("sex", "alcohol12", "region")
    fast = treeshap.tree_pdp(ml.assemble(df, SURVEY_FEATS), rf, "features", {f: [SURVEY_FEATS.index(f)] for f in feats}, scratch_path(spark, "pdp"))
    predict = lambda x: rf.transform(ml.assemble(x, SURVEY_FEATS)).withColumn("prob", vector_to_array("probability")[1])
    slow = reduce(DataFrame.unionByName, [
        attribution.pdp_discrete(df, f, predict, SURVEY_FEATS).select(F.lit(f).alias("feature"), F.col("value").cast("double").alias("value"), F.col("mean_prediction").alias("again"))
        for f in feats
    ])
    both = fast.select("feature", F.col("value")[0].alias("value"), "mean_prediction").join(slow, ["feature", "value"], "full")
    return both.groupBy("feature").agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.abs(F.col("again") - F.col("mean_prediction")) < 1e-9).alias("n_equal"))
