"""Operators with a method of their own against plain versions: exact bootstrap, keyed permutations, tree games, group
Newton, multinomial imputation, terms of order three, χ² quantiles, one-pass splits, files that can't be read."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekit.functions import dist
from wavekit.operators import impute, ml, models, prep, recode, split, treeshap
from wavekit.session import scratch_path
from wavekit.sources import sinks, waves


def test_chi2_quantiles(spark):
    # published critical values
    known = {(0.95, 1): 3.841458820694124, (0.95, 2): 5.991464547107979, (0.99, 1): 6.634896601021213, (0.5, 2): 2 * math.log(2),
             (0.95, 10): 18.307038053275146, (0.95, 200): 233.99426889232}
    rows = spark.createDataFrame([(p, k) for p, k in known], "p double, k int").select("p", "k", dist.chi2_quantile("p", "k").alias("x")).collect()
    for r in rows:
        assert r.x == pytest.approx(known[r.p, r.k], rel=1e-11)
    grid = spark.createDataFrame([(p, k) for p in (1e-6, 0.01, 0.3, 0.9, 0.999, 1 - 1e-9) for k in (1, 2, 3, 7, 30, 101, 200)], "p double, k int")
    for r in grid.withColumn("x", dist.chi2_quantile("p", "k")).withColumn("tail", dist.chi2_sf("x", "k")).collect():
        assert r.tail == pytest.approx(1 - r.p, rel=1e-7, abs=1e-12)
    ends = spark.createDataFrame([(0.0, 3), (1.0, 3), (None, 3), (0.5, 0)], "p double, k int").select(dist.chi2_quantile("p", "k").alias("x"))
    assert [r.x for r in ends.collect()] == [0.0, None, None, None]


# -- exact bootstrap --------------------------------------------------------------------------------------------------


def binomial_plain(u, n, p):
    if p >= 1 or n == 0:
        return n
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= u:
            return k
    return n


def bootstrap_plain(ids, replicates, seed, leaf_rows):
    uniform = lambda key, r: int.from_bytes(hashlib.md5(f"{key}:{seed}:{r // 4}".encode()).digest()[4 * (r % 4) :][:4]) / 2**32
    key = {i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest() for i in ids}
    digits = 1
    while len(ids) > leaf_rows * 16**digits:
        digits += 1
    weights = {i: [] for i in ids}

    def deal(draws, children, r):
        rest = sum(size for _, size in children)
        for name, size in children:
            got = binomial_plain(uniform(name, r), draws, size / rest)
            yield name, got
            draws, rest = draws - got, rest - size

    for r in range(replicates):
        nodes = {"": len(ids)}
        for level in range(1, digits + 1):
            nxt = {}
            for parent, draws in nodes.items():
                own = sorted({k[:level] for k in key.values() if k.startswith(parent)})
                nxt |= deal(draws, [(c, sum(k.startswith(c) for k in key.values())) for c in own], r)
            nodes = nxt
        for bucket, draws in nodes.items():
            rows = sorted((k, i) for i, k in key.items() if k.startswith(bucket))
            by_key = dict(deal(draws, [(k, 1) for k, _ in rows], r))
            for k, i in rows:
                weights[i].append(by_key[k])
    return weights


def test_exact_bootstrap_equals_the_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(split, "LEAF_ROWS", 8)
    ids = list(range(300))
    df = spark.createDataFrame([(i, "x") for i in ids], "row_id long, other string")
    got = {r.row_id: r.boot_w for r in split.bootstrap_exact(df.repartition(5), "row_id", 6, 3).collect()}
    assert got == bootstrap_plain(ids, 6, 3, 8)
    assert [sum(w[r] for w in got.values()) for r in range(6)] == [300] * 6


def test_exact_bootstrap_of_small_and_empty_tables(spark):
    one = split.bootstrap_exact(spark.range(1), "id", 3).collect()
    assert [r.boot_w for r in one] == [[1, 1, 1]]
    assert split.bootstrap_exact(spark.range(0), "id", 3).collect() == []


def test_binomials_by_inversion():
    r = np.random.default_rng(2)
    u = r.random(4000)
    for n, p in ((1, 0.5), (9, 0.25), (64, 1 / 3), (300, 0.9), (5000, 0.5), (7, 1.0), (0, 0.4)):
        got = split._binomial(u, np.full(4000, n), p)
        pmf = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) if p < 1 else float(k == n) for k in range(n + 1)]
        assert (np.minimum(np.searchsorted(np.cumsum(pmf), u), n) != got).sum() <= 1


# -- permutations -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_keyed_permutations_are_permutations(spark, n):
    out = split.keyed_permutation(spark.range(n), "id", n, "a key", "p").select("p").collect()
    assert sorted(r.p for r in out) == list(range(n))


def test_permuted_columns_with_string_ids(spark):
    df = spark.range(500).select(F.concat(F.lit("row "), "id").alias("rid"), (F.col("id") % 9).alias("x"), F.col("id").alias("z"))
    out = split.permuted(df, "rid", ["x", "z"], 2).collect()
    assert len(out) == 2000
    orders = set()
    for f, r in itertools.product(("x", "z"), (0, 1)):
        own = sorted((o for o in out if (o.feature, o.repeat) == (f, r)), key=lambda o: int(o.rid[4:]))
        assert [int(o.rid[4:]) for o in own] == list(range(500))
        kept, moved = ("z", "x") if f == "x" else ("x", "z")
        assert [o[kept] for o in own] == [k if kept == "z" else k % 9 for k in range(500)]
        assert sorted(o[moved] for o in own) == sorted(k if moved == "z" else k % 9 for k in range(500))
        orders.add(tuple(o[moved] for o in own))
    assert len(orders) == 4
    perm = split.permute_column(df, "rid", "x", dst="y")
    assert perm.columns == ["rid", "x", "z", "y"] and perm.where("x = z % 9").count() == 500


# -- trees ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree_rows(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(k, float(r.randrange(4)), r.random(), float(r.randrange(2)), r.random()) for k in range(300)], "row_id long, a double, b double, c double, d double")
    label = ((F.col("a") > 1) & (F.col("b") > 0.5) | (F.col("c") == 1) & (F.col("d") < 0.3)).cast("double")
    return ml.assemble(df.withColumn("label", label), ["a", "b", "c", "d"]).cache()


def a_model(df, kind):
    if kind == "forest":
        return ml.random_forest(df, num_trees=5, max_depth=4, seed=1)
    return ml.gbt(df, max_iter=4, max_depth=3, validation_frac=None, seed=1)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_tree_interactions_equal_all_subsets(spark, tree_rows, kind):
    model = a_model(tree_rows, kind)
    leaves, _ = treeshap.ensemble_leaves(model, spark, scratch_path(spark, "m"))
    X = np.array([r.features.toArray() for r in tree_rows.orderBy("row_id").select("features").collect()])
    games = treeshap.PairGames(leaves)
    phi, single = games.batch(X), treeshap.shap_batch(X, leaves, 4)

    def value(x, subset):
        total = 0.0
        for lf in leaves:
            o = treeshap._follows(x[None], lf)[0]
            total += lf.value * math.prod(float(o[u]) if f in subset else lf.z[u] for u, f in enumerate(lf.feats))
        return total

    for k in range(0, 300, 60):
        for (i, j), got in zip(games.pairs, phi[k]):
            rest, want = [f for f in range(4) if f not in (i, j)], 0.0
            for size in range(3):
                for s in map(set, itertools.combinations(rest, size)):
                    weight = math.factorial(size) * math.factorial(2 - size) / (2 * math.factorial(3))
                    want += weight * (value(X[k], s | {i, j}) - value(X[k], s | {i}) - value(X[k], s | {j}) + value(X[k], s))
            assert got == pytest.approx(want, abs=1e-12)
        # a row of the matrix: what a feature does alone and with each other one
        for i in range(4):
            alone = value(X[k], {i}) - value(X[k], set())
            shared = sum(v for p, v in zip(games.pairs, phi[k]) if i in p)
            assert math.isfinite(alone) and abs(single[k, i] - shared) <= sum(abs(lf.value) for lf in leaves)
    base = {"a": "A", "b": "A", "c": "C", "d": "D"}
    got = {(r.b1, r.b2): r.value for r in treeshap.tree_interactions(tree_rows, model, "features", list("abcd"), scratch_path(spark, "m"), base).collect()}
    want = {}
    for (i, j), column in zip(games.pairs, np.abs(phi).mean(0)):
        pair = tuple(sorted((base["abcd"[i]], base["abcd"[j]])))
        if pair[0] != pair[1]:
            want[pair] = want.get(pair, 0.0) + column
    assert got == pytest.approx(want)
    long = treeshap.interaction_values(tree_rows, model, "features", "row_id", list("abcd"), scratch_path(spark, "m"))
    assert {(r.row_id, r.f1, r.f2): r.phi for r in long.where("row_id < 5").collect()} == pytest.approx(
        {(k, "abcd"[i], "abcd"[j]): phi[k, c] for k in range(5) for c, (i, j) in enumerate(games.pairs)}
    )


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_tree_pdp_equals_scoring_again(spark, tree_rows, kind):
    from pyspark.ml.functions import vector_to_array

    model = a_model(tree_rows, kind)
    out = treeshap.tree_pdp(tree_rows, model, "features", {"a": [0], "b": [1], "cd": [2, 3]}, scratch_path(spark, "m"), {"b": [0.1, 0.5, 0.9]}).collect()
    assert {r.feature for r in out} == {"a", "b", "cd"} and sum(r.feature == "a" for r in out) == 4
    column = vector_to_array("probability" if kind == "forest" else "rawPrediction")[1]
    for r in [r for r in out if r.feature != "cd"] + [r for r in out if r.feature == "cd"][:3]:
        moved = tree_rows.drop("features").withColumns({c: F.lit(v) for c, v in zip(r.feature, r.value)})
        again = model.transform(ml.assemble(moved, ["a", "b", "c", "d"])).agg(F.avg(column)).first()[0]
        assert r.mean_prediction == pytest.approx(again) and r.n == 300


# -- fits -------------------------------------------------------------------------------------------------------------


def test_group_newton_by_aggregates_equals_cells_in_one_task(spark):
    df = spark.range(6000).select((F.col("id") % 3).cast("int").alias("g"), F.sin("id").alias("x"), (F.col("id") % 5).alias("z"), (1 + F.col("id") % 2).alias("w"))
    df = df.withColumn("y", (F.pmod(F.xxhash64("x"), F.lit(1000)) / 1000.0 < 1 / (1 + F.exp(-(0.3 + F.col("x") - 0.2 * F.col("z"))))).cast("double"))
    both = [models.logit_by_group(df, "g", "y", ["x", "z"], weight="w", group_cells=n) for n in (10**6, 0)]
    a, b = ({(r.g, r.variable): (r.beta, r.se) for r in coefs.collect()} for coefs, _ in both)
    assert len(a) == 9 and all(a[k] == pytest.approx(b[k], rel=1e-8) for k in a)
    a, b = ({r.g: (r.loglik, r.n_obs, r.null_loglik) for r in stats.collect()} for _, stats in both)
    assert all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_multinomial_steps_find_the_maximum(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 2))
    eta = np.column_stack((np.zeros(1500), 0.5 + x @ [1.0, -0.5], -0.5 + x @ [0.2, 0.9]))
    p = np.exp(eta) / np.exp(eta).sum(1, keepdims=True)
    y = (r.random(1500)[:, None] > p.cumsum(1)).sum(1)
    df = spark.createDataFrame([(1, float(a), float(b), float(c), 1) for (a, b), c in zip(x, y)], "imp int, a double, b double, y double, n long")
    beta, cov = impute.fit_classes(df, "y", [F.col("a"), F.col("b")], 3, "imp")[1]
    X = np.column_stack((np.ones(1500), x))
    share = np.exp(np.column_stack((np.zeros(1500), X @ beta.T)))
    share /= share.sum(1, keepdims=True)
    gradient = np.concatenate([X.T @ ((y == k) - share[:, k]) for k in (1, 2)])
    assert np.abs(gradient).max() < 0.01 and np.allclose(beta, [[0.5, 1.0, -0.5], [-0.5, 0.2, 0.9]], atol=0.35) and cov.shape == (6, 6)


def test_chained_equations_with_strings_and_booleans(spark):
    n = 1200
    u = F.pmod(F.xxhash64("rid"), F.lit(100000)) / 100000.0
    df = spark.range(n).select(F.col("id").alias("rid"), (F.col("id") % 3).cast("int").alias("z"))
    df = df.withColumn("c", F.when(u < 0.8, F.element_at(F.array(*map(F.lit, "abc")), F.col("z") + 1)).otherwise("a"))
    df = df.withColumn("c", F.when(F.col("rid") % 4 != 0, F.col("c"))).withColumn("t", F.when(F.col("rid") % 5 != 1, F.col("z") == 2)).withColumn("gone", F.lit(None).cast("string")).cache()
    out, trace = impute.mice(df, "rid", ["c", "t", "gone"], ["z"], m=2, sweeps=2)
    out = out.checkpoint()
    assert dict(out.dtypes) == {"rid": "bigint", "imp": "int", "c": "string", "t": "boolean", "gone": "string", "z": "double"}
    assert out.where("c is null or t is null").count() == 0 and out.where("gone is not null").count() == 0 and out.count() == 2 * n
    was = out.join(df.select("rid", F.col("c").alias("oc"), F.col("t").alias("ot")), "rid")
    assert was.where("oc <> c or ot <> t").count() == 0 and {r.c for r in out.select("c").distinct().collect()} == {"a", "b", "c"}
    share = was.where("oc is null and z = 1").agg(F.avg((F.col("c") == "b").cast("int"))).first()[0]
    assert 0.6 < share < 0.97  # eight of ten have the level of their z
    assert was.where("ot is null").agg(F.avg((F.col("t") == (F.col("z") == 2)).cast("int"))).first()[0] > 0.8
    with pytest.raises(ValueError, match="levels"):
        impute.mice(spark.range(100).select("id", F.col("id").cast("string").alias("s")), "id", ["s"], ["id"], m=1, sweeps=1)


def test_terms_of_order_three(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([2.0, 3.0, 5.0, 7.0]),), (Vectors.sparse(4, [1, 3], [3.0, -1.0]),)]
    out, terms = prep.poly_vector(spark.createDataFrame(rows, ["features"]), 4, degree=3)
    assert sorted(terms) == sorted(c for k in (1, 2, 3) for c in itertools.combinations(range(4), k))
    for r, (x,) in zip(out.collect(), rows):
        x = x.toArray()
        assert r.features.toArray().tolist() == pytest.approx([math.prod(x[k] for k in t) for t in terms])


def test_balanced_weights_and_draws(spark):
    df = spark.createDataFrame([(0.0,)] * 30 + [(1.0,)] * 10, "label double")
    totals = {r.label: r.s for r in ml.balanced_weights(df).groupBy("label").agg(F.sum("class_weight").alias("s")).collect()}
    assert totals == pytest.approx({0.0: 20.0, 1.0: 20.0})
    draws = ml.elasticnet_draws(200, 1)
    assert draws == ml.elasticnet_draws(200, 1) and all(1e-5 <= d["C"] <= 1e3 and 0 <= d["l1_ratio"] <= 1 for d in draws)
    assert 60 < sum(d["balanced"] for d in draws) < 140


def test_search_gives_train_scores(spark, tree_rows):
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = tree_rows.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    out = ml.search(rows, DecisionTreeClassifier(labelCol="label"), ml.grid({"maxDepth": [1, 6]}), folds=3).orderBy("trial").collect()
    assert [r.trial for r in out] == [0, 1] and all(r.mean_train_auc >= r.mean_auc - 0.05 for r in out)
    assert out[1].mean_train_auc > out[0].mean_train_auc


# -- splits, levels, files --------------------------------------------------------------------------------------------


def test_split_keeps_null_strata_and_reads_few_columns(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("s"), F.lit("wide").alias("other"))
    out = split.split_stratified(df, "id", ["s"], 0.25, 5)
    counts = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    n = {None: 250, 1: 250, 2: 250, 3: 250}
    # a quota of 62.5 rounds up
    assert counts == {(s, k): 63 if k == "test" else v - 63 for s, v in n.items() for k in ("test", "train")}
    key = lambda i: (hashlib.md5(f"{i}:5".encode()).hexdigest(), i)
    own = sorted((i for i in range(1000) if i % 4 == 3), key=key)[:63]
    assert {r.id for r in out.where("s = 3 and split = 'test'").collect()} == set(own)
    assert split.split_stratified(df.limit(0), "id", ["s"], 0.2).count() == 0
    assert split.split_stratified(df, "id", ["s"], 0.0).where("split = 'test'").count() == 0
    assert split.split_stratified(df, "id", ["s"], 1.0).where("split = 'train'").count() == 0


def test_codes_of_many_values(spark):
    df = spark.range(3000).select(F.format_string("v%05d", F.col("id") * 7).alias("s"))
    out, mapping = recode.target_encode(df.unionByName(df), "s")
    assert [r.code for r in mapping.orderBy("value").collect()] == list(range(3000))
    assert out.where("s = 'v00070'").select("s_code").distinct().collect()[0][0] == 10


def test_too_many_levels_raise(spark):
    with pytest.raises(ValueError, match="levels"):
        prep.onehot(spark.range(20), "id", max_levels=10)
    assert len(prep.onehot(spark.range(20), "id", max_levels=20)[1]) == 20


def test_models_and_waves_that_cannot_be_read(spark, tmp_path, tree_rows):
    from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier

    reg = sinks.ModelRegistry(f"file://{tmp_path}/models")
    reg.save("good", DecisionTreeClassifier(labelCol="label", maxDepth=2).fit(tree_rows))
    kind = DecisionTreeClassificationModel
    assert set(reg.load_many({"good": kind, "never saved": kind}, minimum=1)) == {"good"}
    assert reg.load("best", kind, fallbacks=["good"]).depth <= 2
    (tmp_path / "models" / "bad").mkdir()
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader says
        reg.load_many({"good": kind, "bad": kind}, minimum=1)
    with pytest.raises(FileNotFoundError):
        reg.load("none", kind)
    with pytest.raises(ValueError):
        reg.load_many({"never saved": kind}, minimum=1)
    missing = [waves.Source("wave_2000_0012", f"file://{tmp_path}/nothing.tsv")]
    with pytest.raises(Exception):  # noqa: B017
        waves.scan_tsv_waves(spark, missing)
    frames, report = waves.scan_tsv_waves(spark, missing, on_error="skip")
    assert frames == {} and report.first().status == "skipped"


def test_jobs_side_by_side(spark):
    jobs = {k: (lambda k=k: spark.range(1000 + k).where("id % 7 = 0").groupBy((F.col("id") % 3).alias("g")).count().agg(F.sum("count")).first()[0]) for k in range(60)}
    assert ml.together(jobs, 8) == {k: len(range(0, 1000 + k, 7)) for k in range(60)}
