"""Work that must not grow with copies, strata or passes: what is shuffled, kept per chain or scored, next to plain results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekit.operators import correlation, evaluate, impute, profile, split


def test_split_never_shuffles_rows_by_their_strata(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("s"), F.lit("wide").alias("other"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = split.split_stratified(df, "id", ["s"], 0.2, 5)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_chains_hold_rows_with_missing_cells_only(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, None if k % 10 == 0 else r.randrange(1, 5), None if k % 15 == 1 else r.randrange(1, 4), r.randrange(3)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, x int, y int, z int")
    seen, plain = [], impute._moments

    def counted(own, *args):
        seen.append(own.count())
        return plain(own, *args)

    monkeypatch.setattr(impute, "_moments", counted)
    out, trace = impute.mice(df, "id", ["x", "y"], ["z"], m=4, sweeps=2, seed=1)
    missing = sum(x is None or y is None for _, x, y, _ in rows)
    assert max(seen) <= max(4 * missing, 48) and out.count() == 2400
    kept = out.join(df.select("id", F.col("x").alias("ox"), F.col("y").alias("oy")), "id")
    assert kept.where("x is null or y is null or x <> ox or y <> oy").count() == 0
    last = out.groupBy("imp").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    for t in trace.where("sweep = 2 and variable = 'x'").join(last, "imp").collect():
        assert t["mean"] == pytest.approx(t.m) and t.sd == pytest.approx(t.s)


@pytest.mark.parametrize("n", [1, 2, 10, 97, 1000])
def test_packed_places_are_those_of_the_keyed_permutation(spark, n):
    want = [r.p for r in split.keyed_permutation(spark.range(n), "id", n, "42:x:1", "p").orderBy("id").collect()]
    assert split.permuted_places(np.arange(n), n, "42:x:1").tolist() == want


def test_permuted_blocks_meet_their_values(spark, monkeypatch):
    monkeypatch.setattr(split, "PLACE_BLOCK", 7)
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"), F.concat(F.lit("v"), "id").alias("t"), F.array("id").alias("a"))
    index = {r.id: r.i for r in split.dense_index(df, "id", 42, "i").collect()}
    at = {i: k for k, i in index.items()}
    out = split.permuted(df, "id", ["x", "t", "a"], 2)
    assert out.columns == ["id", "x", "t", "a", "feature", "repeat"]
    value = {"x": lambda k: k if k % 5 else None, "t": lambda k: f"v{k}", "a": lambda k: [k]}
    rows = out.collect()
    assert len(rows) == 600
    for f in value:
        for rep in (0, 1):
            places = split.permuted_places(np.arange(100), 100, f"42:{f}:{rep}").tolist()
            came = {p: at[i] for i, p in enumerate(places)}
            for r in (r for r in rows if (r.feature, r.repeat) == (f, rep)):
                assert all(r[c] == value[c](came[index[r.id]] if c == f else r.id) for c in value)


def test_metrics_score_rows_once(spark):
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(k):
        scored.add(1)
        return (k * 7 % 50) / 50

    df = spark.range(400).repartition(4).select((F.col("id") % 3 == 0).cast("int").alias("label"), score("id").alias("prob"))
    row = evaluate.metric_set(df).first()
    assert scored.value == 400
    y = np.array([k % 3 == 0 for k in range(400)])
    p = np.array([k * 7 % 50 / 50 for k in range(400)])
    assert row.accuracy == pytest.approx(((p >= 0.5) == y).mean()) and (row.n_pos, row.n_neg) == (y.sum(), 400 - y.sum())
    c = np.clip(p, 1e-15, 1 - 1e-15)
    assert row.log_loss == pytest.approx(-np.mean(np.where(y, np.log(c), np.log(1 - c))))
    wins = (p[y][:, None] > p[~y]).sum() + 0.5 * (p[y][:, None] == p[~y]).sum()
    assert row.auc == pytest.approx(wins / (y.sum() * (~y).sum()))


def test_elastic_nets_are_fitted_together(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    from wavekit.operators import ml

    r = np.random.default_rng(0)
    x = r.normal(size=(900, 3))
    y = (r.random(900) < 1 / (1 + np.exp(-x @ np.array([1, -0.5, 0])))).astype(float)
    df = ml.assemble(spark.createDataFrame([(*map(float, v), float(t), k % 3) for k, (v, t) in enumerate(zip(x, y))], "a double, b double, c double, label double, fold int"), ["a", "b", "c"])
    settings = [{"reg": 0.02, "l1_ratio": a, "tol": 1e-6, "balanced": b} for a, b in ((1.0, False), (0.5, True))]
    plain = {}
    for k, s in enumerate(settings):
        areas = []
        for f in range(3):
            est = LogisticRegression(standardization=False, regParam=0.02, elasticNetParam=s["l1_ratio"], tol=1e-10)
            if s["balanced"]:
                est.setWeightCol("class_weight")
            model = est.fit(ml.balanced_weights(df).where(F.col("fold") != f))
            areas.append(ml._area(model, df.where(F.col("fold") == f), "label"))
        plain[k] = np.mean(areas)
    monkeypatch.setattr(LogisticRegression, "fit", lambda *_: pytest.fail("one fit for each setting and fold"))
    for t in ml.search_logit(df, settings, folds=3).collect():
        assert t.mean_auc == pytest.approx(plain[t.trial], abs=1e-4)


def test_class_importances_equal_rows_scored_one_by_one(spark):
    from pyspark.ml.functions import vector_to_array

    from wavekit.operators import ml

    r = random.Random(5)
    rows = [(k, float(r.randrange(3)), r.randrange(4), r.randrange(3)) for k in range(240)]
    df = spark.createDataFrame([(k, c if r.random() < 0.3 else float(a % 3), a, b) for k, c, a, b in rows], "id long, label double, a int, b int")
    model = ml.random_forest(ml.assemble(df, ["a", "b"]), num_trees=5, max_depth=3, seed=1)

    def areas(own):
        scored = model.transform(ml.assemble(own, ["a", "b"])).select("label", vector_to_array("probability").alias("p")).collect()
        y, p = np.array([s.label for s in scored]), np.array([s.p for s in scored])
        out = []
        for k in range(3):
            pos, neg = p[y == k, k][:, None], p[y != k, k]
            out.append(((pos > neg).sum() + 0.5 * (pos == neg).sum()) / (len(pos) * len(neg)))
        return np.array(out)

    moved = split.permuted(df, "id", ["a", "b"], 2, 42).cache()
    got = {(t["class"], t.feature): t.importance for t in ml.class_importances(model, df, ["a", "b"], "label", "id", 3, repeats=2).collect()}
    for f in ("a", "b"):
        want = areas(df) - np.mean([areas(moved.where((F.col("feature") == f) & (F.col("repeat") == k))) for k in (0, 1)], axis=0)
        for k in range(3):
            assert got[k, f] == pytest.approx(want[k], abs=1e-12)


def test_spread_rows_keep_all_rows_in_bounded_partitions(spark, monkeypatch):
    from wavekit import session

    monkeypatch.setattr(session, "PART_ROWS", 100)
    out = session.spread(spark.range(1000).withColumn("x", F.col("id") % 3).coalesce(1), "id")
    assert out.count() == 1000 and out.agg(F.sum("id")).first()[0] == 499500 and out.rdd.getNumPartitions() >= 10


def test_multinomial_path_on_counted_rows(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from wavekit.operators import ml

    r = random.Random(2)
    rows = [(a, b, float(min(2, (a + r.randrange(3)) // 2)), k % 2) for k in range(400) for a, b in [(r.randrange(4), r.randrange(1, 6))]]
    df = ml.assemble(spark.createDataFrame(rows, "a int, b int, label double, fold int"), ["a", "b"]).cache()
    penalties = [0.3, 0.01]
    plain = lambda own, q: LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=q).fit(own)
    f1 = MulticlassClassificationEvaluator(labelCol="label")
    means = [np.mean([f1.evaluate(plain(df.where(F.col("fold") != f), q).transform(df.where(F.col("fold") == f))) for f in (0, 1)]) for q in penalties]
    best, mat = ml.multinomial_path(df, ["a", "b"], "label", penalties, folds=2)
    assert best == penalties[int(np.argmax(means))]
    assert np.array(mat) == pytest.approx(plain(df, best).coefficientMatrix.toArray(), abs=2e-3)


def _plain_tau(rows):
    """(n, tau-b) of pairs without nulls; NaN is one value above all others."""
    above = lambda x, y: (x != x and y == y) or x > y
    sign = lambda x, y: above(x, y) - above(y, x)
    signs = [(sign(x1, x2), sign(y1, y2)) for k, (x1, y1) in enumerate(rows) for x2, y2 in rows[:k]]
    return len(rows), sum(a * b for a, b in signs) / (sum(a != 0 for a, _ in signs) * sum(b != 0 for _, b in signs)) ** 0.5


def test_kendall_cells_do_not_grow_with_columns_of_many_values(spark, monkeypatch):
    r = random.Random(7)
    rows = [(r.randrange(4), r.random(), r.choice([None, 1.5, float("nan"), -0.0, 0.0]), None) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, w double, b double, none int")
    seen, plain = [], correlation.pair_cells

    def counted(*args, **more):
        out = plain(*args, **more)
        seen.append(out.count())
        return out

    monkeypatch.setattr(correlation, "pair_cells", counted)
    got = {(x.var1, x.var2): (x.n, x.tau_b) for x in correlation.kendall(df, df.columns).collect()}
    assert sum(seen) <= 4 * 3  # cells of (a, b); with w every row would be a cell
    assert got.keys() == {("a", "w"), ("a", "b"), ("w", "b")}
    for (x, y), (n, tau) in got.items():
        i, j = df.columns.index(x), df.columns.index(y)
        want = _plain_tau([(t[i], t[j]) for t in rows if t[i] is not None and t[j] is not None])
        assert n == want[0] and tau == pytest.approx(want[1])


def test_kendall_of_a_value_that_fills_several_ranges(spark, monkeypatch):
    from wavekit import session

    monkeypatch.setattr(session, "PART_ROWS", 10)
    monkeypatch.setattr(correlation, "FEW_VALUES", 8)
    r = random.Random(8)
    rows = [(r.choice([5.0, 5.0, 5.0, float("nan"), None, float(r.randrange(100))]), r.randrange(3), r.choice([None, 0, 1])) for _ in range(300)]
    df = spark.createDataFrame(rows, "w double, a int, b int").repartition(3)
    got = {(x.var1, x.var2): (x.n, x.tau_b) for x in correlation.kendall(df, df.columns).collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        want = _plain_tau([(t[i], t[j]) for t in rows if t[i] is not None and t[j] is not None])
        assert got[df.columns[i], df.columns[j]] == (want[0], pytest.approx(want[1]))


def test_search_fits_in_few_partitions_and_equal_trials_once(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier

    from wavekit import session
    from wavekit.operators import ml

    fitted = []

    class Counted(DecisionTreeClassifier):
        def _fit(self, dataset):
            fitted.append((self.getOrDefault("maxDepth"), dataset.rdd.getNumPartitions(), dataset.count()))
            return super()._fit(dataset)

    r = random.Random(4)
    rows = [(k, float(r.random() < 0.3 + 0.1 * (k % 5)), float(k % 5), k % 2) for k in range(400)]
    df = ml.assemble(spark.createDataFrame(rows, "row_id int, label double, x double, fold int"), ["x"])
    grid = [{"maxDepth": 1}, {"maxDepth": 3}, {"maxDepth": 1}]
    monkeypatch.setattr(session, "PART_ROWS", 200)
    for given in (df.repartition(30), df.coalesce(1)):
        fitted.clear()
        out = ml.search(given, Counted(labelCol="label"), grid, folds=2).orderBy("trial").collect()
        assert sorted(fitted) == [(1, 2, 200), (1, 2, 200), (3, 2, 200), (3, 2, 200)]  # every row of a fold, in 2 partitions
        assert [(t.trial, t.params) for t in out] == [(k, str(sorted(g.items()))) for k, g in enumerate(grid)]
        assert out[0][1:] == out[2][1:] and all(0 < t.mean_auc < 1 for t in out)


def _broadcast_rows(plan):
    """Rows of every broadcast table of an executed plan."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _broadcast_rows(plan.executedPlan())
    if "QueryStage" in name:
        return _broadcast_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if name.startswith("BroadcastExchange") else []
    children = plan.children()
    return own + [n for i in range(children.size()) for n in _broadcast_rows(children.apply(i))]


@pytest.mark.parametrize("by", [["imp"], []])
def test_value_counts_never_pass_through_the_driver(spark, tmp_path, by):
    n, imps = 4000, 5
    spark.range(n).select((F.col("id") * 7 % n + 0.5).alias("x"), (F.col("id") % 3).alias("z")).write.parquet(f"{tmp_path}/rows")
    stack = spark.read.parquet(f"{tmp_path}/rows").withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(imps))))
    counts = profile.column_counts(stack, ["x", "z"], by)
    q = profile.column_quantiles(counts, [0.5], by)
    got = {(*[r[b] for b in by], r.variable): r.value for r in q.collect()}
    groups = [(i,) for i in range(1, imps + 1)] if by else [()]
    assert got == {(*g, v): m for g in groups for v, m in (("x", n / 2), ("z", 1.0))}
    sent, buckets = _broadcast_rows(q._jdf.queryExecution().executedPlan()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sent and max(sent) <= 2 * len(groups) * buckets


def test_imputation_compare_sends_no_value_counts_to_the_driver(spark, tmp_path):
    n, imps = 4000, 5
    spark.range(n).select((F.col("id") * 7 % n + 0.5).alias("x"), (F.col("id") % 3).alias("z")).write.parquet(f"{tmp_path}/rows")
    stack = spark.read.parquet(f"{tmp_path}/rows").withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(imps)))).withColumn("z", F.col("z") + F.col("imp"))
    out = profile.imputation_compare(stack, ["x", "z"])
    got = {(r.imp, r.variable): (r.mean, r.min, r.median, r.max, r.mode) for r in out.collect()}
    assert set(got) == {(i, v) for i in range(1, imps + 1) for v in ("x", "z")}
    for i in range(1, imps + 1):
        assert got[i, "x"] == (pytest.approx(n / 2), 0.5, n / 2, n - 0.5, 0.5)
        assert got[i, "z"] == (pytest.approx(i + sum(k % 3 for k in range(n)) / n), i, i + 1, i + 2, i)
    sent = _broadcast_rows(out._jdf.queryExecution().executedPlan())
    assert sent and max(sent) <= 2 * imps * int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_cumulative_counts_of_groups(spark, buckets, descending):
    r = random.Random(9)
    rows = [(g, float(v), r.randrange(1, 9)) for g in ("a", "b", None) for v in {r.randrange(-300, 300) for _ in range(200)}]
    rows.append(("c", 1.0, 4))  # a group of one key
    df = spark.createDataFrame(rows, "g string, v double, n long")
    for few in (False, True):
        got = {(x.g, x.v): (x.n, x.n_before) for x in evaluate.cumulative_counts(df, "v", ["n"], buckets, descending, ["g"], few).collect()}
        assert got == {
            (g, v): (n, sum(m for h, w, m in rows if h == g and (w > v if descending else w < v))) for g, v, n in rows if g is not None
        }
