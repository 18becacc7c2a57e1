"""Unit tests on hand-written edge frames (nulls, sentinels, ties, empty/size-1 groups, single-class
targets, separation, identical imputations, duplicated rows) and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from wavekit.functions import dist, ordering
from wavekit.operators import (
    attribution,
    correlation,
    evaluate,
    impute,
    inference,
    models,
    prep,
    profile,
    ranking,
    recode,
    split,
)


def test_sentinels_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(1, -9, 5), (2, -8, 5), (3, -9, 5)], "id int, allmiss int, const int")
    out = recode.sentinel_to_null(df)
    assert [r.allmiss for r in out.collect()] == [None, None, None]
    prof = profile.missing_profile(out, ["allmiss", "const"], only_missing=False).collect()
    got = {r.variable: (r.n_missing, r.pct_missing, r.impute_target) for r in prof}
    assert got == {"allmiss": (3, 100.0, False), "const": (0, 0.0, False)}
    kinds = {r.variable: r.n_distinct for r in prep.infer_feature_types(out, ["allmiss", "const"]).collect()}
    assert kinds == {"allmiss": 0, "const": 1}
    assert prep.varying_columns(out, ["allmiss", "const"]).count() == 0


def test_dichotomize_both_codings(spark):
    df = spark.createDataFrame([(c,) for c in [1, 2, 6, 7, None, -9]], "x int")
    a = [r.d for r in recode.dichotomize(df, "x", "d", drop_src=False).collect()]
    b = [r.f for r in recode.dichotomize(df, "x", "f", coding="frequency", drop_src=False).collect()]
    assert a == [0.0, 1.0, 1.0, 1.0, None, None]
    assert b == [1.0, 1.0, 1.0, 0.0, None, None]


def test_group_of_size_one_and_small_cells(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, 1.0), (2, 1.0)], "g int, y double")
    prev = {r.g: r for r in profile.prevalence_by(df, "y", ["g"]).collect()}
    assert prev[2].n == 1 and prev[2].sd is None and prev[2].se is None
    sup = {r.g: r for r in profile.suppress_small_cells(profile.prevalence_by(df, "y", ["g"]), "n", ["prevalence"], 2).collect()}
    assert sup[1].prevalence == pytest.approx(2 / 3) and sup[2].prevalence is None and sup[2].suppressed


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "x int, s string")
    r = profile.duplicate_rows(df).first()
    assert (r.n_rows, r.n_distinct_rows, r.n_duplicates) == (6, 3, 3)


def test_exact_median_not_approximate(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x int")
    p = impute.impute_fit(df, ["x"], "median").first()
    assert p.x == 2.5
    filled = impute.impute_apply(df, impute.impute_fit(df, ["x"], "median"), ["x"])
    assert sorted(r.x for r in filled.collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]
    mode = impute.impute_fit(spark.createDataFrame([(2,), (1,), (1,), (2,)], "x int"), ["x"], "most_frequent").first()
    assert mode.x == 1  # ties → smallest value


def test_onehot_unseen_level_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    out, levels = prep.onehot(test, "c", fit_on=train)
    rows = out.collect()
    assert levels == ["a", "b"]
    assert [(r.c_a, r.c_b) for r in rows] == [(1, 0), (0, 0), (0, 0)]


def test_standardize_uses_population_sd(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    z = [r.x for r in prep.standardize(df, ["x"]).collect()]
    assert z == pytest.approx([-math.sqrt(1.5), 0.0, math.sqrt(1.5)])


def test_rank_ties_and_consensus_partition(spark):
    imp = spark.createDataFrame(
        [("m1", "a", 1.0), ("m1", "b", 1.0), ("m1", "c", 0.5), ("m2", "a", 0.1), ("m2", "b", 0.9), ("m2", "c", 0.9)],
        "model string, feature string, importance double",
    )
    ranked = ranking.rank_by_model(imp)
    r = {(x.model, x.feature): x.rank for x in ranked.collect()}
    assert r[("m1", "a")] == 1 and r[("m1", "b")] == 2 and r[("m2", "b")] == 1 and r[("m2", "c")] == 2
    tiers = {x.feature: x.tier for x in ranking.consensus_tiers(ranked, 1).collect()}
    assert tiers == {"a": 2, "b": 2}  # each top-1 in one of two models
    sets = ranking.nested_sets(ranking.consensus_tiers(ranked, 2)).collect()
    by_set = {}
    for s in sets:
        by_set.setdefault(s.set_no, set()).add(s.feature)
    assert by_set[1] <= by_set[max(by_set)]


def test_stratified_split_exact_quota_and_empty_stratum(spark):
    rows = [(i, i % 2) for i in range(1, 1001)] + [(5000, 7)]
    df = spark.createDataFrame(rows, "id long, y int")
    s = split.split_stratified(df, "id", ["y"], 0.2, seed=3)
    counts = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert counts[(0, "test")] == 100 and counts[(1, "test")] == 100 and counts[(7, "train")] == 1
    assert s.count() == 1001 and s.select("id").distinct().count() == 1001
    f = split.folds_stratified(df, "id", ["y"], k=5, seed=3)
    sizes = sorted(r["count"] for r in f.where(F.col("y") == 0).groupBy("fold").count().collect())
    assert sizes == [100] * 5


def test_bootstrap_weights_mean_one(spark):
    df = spark.range(1, 2001).withColumnRenamed("id", "rid")
    bw = split.bootstrap_weights(df, "rid", 5, seed=1)
    m = bw.agg(F.avg("boot_w")).first()[0]
    assert 0.9 < m < 1.1


def test_auc_ties_single_class_and_brute_force(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (1, 0.7)]
    df = spark.createDataFrame(rows, "label int, prob double")
    auc = evaluate.roc_auc(df).first().auc
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    brute = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute)
    one = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, prob double")
    assert evaluate.roc_auc(one).first().auc is None  # no negatives: AUC undefined
    both = df.withColumn("g", F.lit("two")).unionByName(one.withColumn("g", F.lit("one")))
    got = {r.g: r.auc for r in evaluate.roc_auc(both, by=["g"]).collect()}
    assert got["one"] is None and got["two"] == pytest.approx(brute)


def test_distribution_tails():
    from statistics import NormalDist

    assert dist.z_crit(0.95) == pytest.approx(1.959963984540054)
    assert NormalDist().cdf(1.0) == pytest.approx(0.8413447, abs=1e-6)


def test_distribution_columns(spark):
    df = spark.createDataFrame([(1.0, 1), (3.84, 1), (5.99, 2), (11.07, 5), (0.0, 3)], "x double, k int")
    got = [(r.p, r.z) for r in df.select(dist.chi2_sf("x", "k").alias("p"), dist.two_sided_p(F.col("x")).alias("z")).collect()]
    exp = [0.3173105, 0.0500435, 0.0500372, 0.0500097, 1.0]
    for (p, _), e in zip(got, exp):
        assert p == pytest.approx(e, abs=2e-6)
    assert got[0][1] == pytest.approx(math.erfc(1 / math.sqrt(2)), rel=1e-12)


def test_tails_keep_relative_accuracy(spark):
    """Against the C library's erfc, from the middle to twenty standard deviations."""
    xs = [k / 8 for k in range(-40, 160)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, r in zip(xs, df.select("x", dist.erfc("x").alias("e"), dist.two_sided_p("x").alias("p")).orderBy("x").collect()):
        assert r.e == pytest.approx(math.erfc(x), rel=1e-9)
        assert r.p == pytest.approx(math.erfc(abs(x) / math.sqrt(2)), rel=1e-9)


def test_interaction_test_ignores_a_difference_in_level(spark):
    """Exactly balanced cells: two groups with different levels and one common slope give an LR near 0; different
    slopes reject."""
    def rows(shift, slopes):
        out = []
        for g, b in enumerate(slopes):
            for x in range(4):
                n = 100_000
                k = round(n / (1 + math.exp(-(-1 + shift * g + b * x))))
                out += [(g, x, 1.0, k), (g, x, 0.0, n - k)]
        return spark.createDataFrame(out, "g int, x int, y double, w int")

    def test(shift, slopes):
        return inference.interaction_test(rows(shift, slopes), "y", ["g", "x"], [("g", "x")], weight="w").collect()

    same = test(1.5, (0.3, 0.3))
    assert len(same) == 4 and all(r.lr_df == 1 and r.lr_stat < 0.01 and r.lr_p > 0.9 for r in same)
    assert all(r.lr_p < 1e-10 for r in test(0.0, (0.3, 0.4)))


def test_degradation_bands_are_of_the_absolute_drop(spark):
    df = spark.createDataFrame([(0.9, 0.9 - d) for d in (-0.1, 0.02, 0.04, 0.07, 0.2)], "e double, o double")
    assert [r.band for r in evaluate.degradation(df, "e", "o").collect()] == ["Excellent", "Excellent", "Good", "Moderate", "Significant"]


def test_a_wave_that_is_added_reaches_every_output(spark, tmp_path):
    from wavekit.operators import setops
    from wavekit.plans.q_sources import STRING_COLS, DOUBLE_COLS, write_waves
    from wavekit.sources import waves

    kind = ("respondent_id long, wave int, form string, nicotine12 int, sex_raw int, race string, region int, "
            "marijuana12 int, alcohol12 int, cigarette12 int, survey_weight double")
    raw = spark.createDataFrame([(k, 1990 + 10 * (k % 4), "0012" if k % 3 else "0810", 1, 1, "a", 1, 1, 2, 3, 1.0) for k in range(24)], kind)
    frames, _ = waves.scan_tsv_waves(spark, write_waves(raw, f"file://{tmp_path}/w"), STRING_COLS, DOUBLE_COLS)
    assert {waves.source_name_parts(n)[0] for n in frames} == {1990, 2000, 2010, 2020}
    assert sum(f.count() for f in frames.values()) == 24
    coefs = spark.createDataFrame([(f"w{w}", "x", 0.1, 0.01, 1.1) for w in (1990, 2030)], "model string, variable string, beta double, p_value double, odds_ratio double")
    assert setops.predictor_presence(coefs).first().w2030 == 2 and setops.key_pivot(coefs).first().beta_w2030 == 0.1


def test_feature_pairs_are_walked_in_order(spark):
    """A~B and B~C but not A~C: B goes, and C, whose only partner is gone, stays."""
    import random

    r = random.Random(3)
    rows = []
    for _ in range(4000):
        a, c = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((a, a + c, c))
    got = {x.variable: x.reason for x in correlation.select_features(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got == {"a": "kept", "b": "correlated", "c": "kept"}


def test_spearman_ranks_only_the_rows_of_a_pair(spark):
    import random

    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([1, 2, 5]), r.choice([None, r.random(), 0.5])) for _ in range(400)]
    got = {(x.var1, x.var2): (x.n, x.rho) for x in correlation.spearman(spark.createDataFrame(rows, "a int, b int, c double"), ["a", "b", "c"]).collect()}

    def rank(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    for i, j, key in ((0, 1, ("a", "b")), (0, 2, ("a", "c")), (1, 2, ("b", "c"))):
        pair = [(x[i], x[j]) for x in rows if x[i] is not None and x[j] is not None]
        a, b = rank([p[0] for p in pair]), rank([p[1] for p in pair])
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        rho = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
        assert got[key][0] == len(pair) and got[key][1] == pytest.approx(rho)


def test_column_quantiles_modes_and_distinct_counts(spark):
    rows = [(1, 1.5, "x"), (1, None, "y"), (2, 2.5, None), (4, 2.5, "x"), (None, 7.0, "z")]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    counts = profile.column_counts(df, ["a", "b"])
    q = {(r.variable, r.prob): r.value for r in profile.column_quantiles(counts, [0.25, 0.5]).collect()}
    assert q == {("a", 0.25): 1.0, ("a", 0.5): 1.5, ("b", 0.25): 2.25, ("b", 0.5): 2.5}
    assert {r.variable: r.mode for r in profile.column_modes(counts).collect()} == {"a": 1.0, "b": 2.5}
    assert {r.variable: r.n_distinct for r in profile.distinct_counts(df, ["a", "b", "c"]).collect()} == {"a": 3, "b": 3, "c": 3}
    assert impute.impute_fit(df, ["a", "c"], "most_frequent").first().asDict() == {"a": 1, "c": "x"}
    assert profile.column_medians(df.where("false"), ["a"]).first().a is None


def test_buckets_grow_with_the_rows(monkeypatch, spark):
    monkeypatch.setattr(split, "BUCKET_ROWS", 1)
    df = spark.range(16**3 + 1).withColumn("s", F.lit(1))
    assert split._digits(df) == 4
    assert split.split_stratified(df, "id", ["s"], 0.25).groupBy("split").count().where("split = 'test'").first()["count"] == 1024


def test_no_checkpoint_folder_of_its_own_on_a_cluster():
    from wavekit.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext = Context
        conf = Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        ensure_checkpoint_dir(Session)


def test_logit_cells_equal_rows(spark):
    rows = [(x, float((i * 7 + x) % 3 == 0)) for i in range(60) for x in range(4)]
    df = spark.createDataFrame(rows, "x int, y double")
    a = models.logit(df, "y", ["x"], cells=True)
    b = models.logit(df.withColumn("x", F.col("x").cast("double")), "y", ["x"], cells=False)
    assert a.beta == pytest.approx(b.beta, rel=1e-8)
    sa, sb = a.stats.first(), b.stats.first()
    assert sa.loglik == pytest.approx(sb.loglik, rel=1e-10) and sa.n_obs == sb.n_obs == 240


def test_logit_by_group_matches_single_fits(spark):
    rows = [(g, x, float((i + x * g) % 4 == 0)) for g in (1, 2) for i in range(50) for x in range(3)]
    df = spark.createDataFrame(rows, "g int, x int, y double")
    coefs, _ = models.logit_by_group(df, "g", "y", ["x"])
    for g in (1, 2):
        single = models.logit(df.where(F.col("g") == g), "y", ["x"])
        got = {r.variable: r.beta for r in coefs.where(F.col("g") == g).collect()}
        assert got["x"] == pytest.approx(single.beta[1], rel=1e-7)


def test_rubin_identical_imputations_degenerate(spark):
    coefs = spark.createDataFrame([(i, "m", "x", 0.5, 0.1) for i in range(1, 6)], "imp int, model string, variable string, beta double, se double")
    r = inference.rubin_pool(coefs).first()
    assert r.between_var == 0 and r.degenerate and r.df is None and r.se == pytest.approx(0.1)
    coefs2 = spark.createDataFrame([(i, "m", "x", 0.5 + 0.01 * i, 0.1) for i in range(1, 6)],
                                   "imp int, model string, variable string, beta double, se double")
    r2 = inference.rubin_pool(coefs2).first()
    assert r2.total_var >= r2.within_var and r2.df > 0


def test_poly_vector_has_every_product(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([2.0, 3.0, 0.0, 5.0]),), (Vectors.sparse(4, {1: 7.0, 3: 1.0}),)]
    out, terms = prep.poly_vector(spark.createDataFrame(rows, ["features"]), 4)
    assert len(terms) == 10 and {t for t in terms if len(t) == 2} == {(i, j) for j in range(4) for i in range(j)}
    for (x,), r in zip(rows, out.collect()):
        assert list(r.features.toArray()) == [math.prod(float(x[k]) for k in t) for t in terms]


def test_interactions_hold_all_slots(spark):
    from tests.conftest import SMOKE_DIR
    from wavekit.plans import q_ml

    _, _, _, meta = q_ml.prepared(spark, SMOKE_DIR)
    n = meta.count()
    coefs = q_ml.q_logit_poly(spark, SMOKE_DIR)
    assert coefs.columns == ["variable", "beta"] and coefs.count() == 1 + n + math.comb(n, 2) + math.comb(n, 3)
    combos = {r.combo for r in q_ml.q_interaction_rank(spark, SMOKE_DIR).collect()}
    assert {"lang x source", "lang x n_words", "n_chars x source", "lang x n_words x source"} <= combos


def test_kendall_by_the_bits_of_the_ranks(spark):
    import random

    r = random.Random(5)
    data = [(r.choice([0, 0, 0, r.randrange(40)]), round(r.gauss(0, 1), 2), r.choice([None, 1.5, r.random()])) for _ in range(400)]
    df = spark.createDataFrame(data, "a int, b double, c double")
    sign = lambda x, y: (x > y) - (x < y)
    got = {(x.var1, x.var2): x for x in correlation.kendall(df, ["a", "b", "c"]).collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        rows = [(t[i], t[j]) for t in data if t[i] is not None and t[j] is not None]
        s = ta = tb = 0
        for k, (x1, y1) in enumerate(rows):
            for x2, y2 in rows[:k]:
                s += sign(x1, x2) * sign(y1, y2)
                ta += x1 != x2
                tb += y1 != y2
        assert got["abc"[i], "abc"[j]].tau_b == pytest.approx(s / math.sqrt(ta * tb))
        assert got["abc"[i], "abc"[j]].n == len(rows)


def test_running_total_is_the_total_before_each_row(spark):
    import random

    r = random.Random(9)
    rows = [(k % 7, k, r.randrange(10**12)) for k in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, k long, n long").repartition(6)
    want, total = {}, 0
    for g, k, n in sorted(rows):
        want[g, k] = total
        total += n
    assert {(x.g, x.k): x.t for x in ordering.running_total(df, ["g", "k"], "n", "t").collect()} == want


def test_spearman_kendall_brute_force(spark):
    import itertools

    data = [(1, 2), (2, 2), (3, 1), (3, 5), (4, 4), (5, 5), (None, 3), (6, None), (2, 3)]
    df = spark.createDataFrame(data, "a int, b int")
    pairs = [(a, b) for a, b in data if a is not None and b is not None]
    sp = correlation.spearman(df, ["a", "b"]).first()
    kd = correlation.kendall(df, ["a", "b"]).first()

    def avg_rank(v):
        s = sorted(v)
        return [s.index(x) + (s.count(x) + 1) / 2 for x in v]

    ra, rb = avg_rank([p[0] for p in pairs]), avg_rank([p[1] for p in pairs])
    n = len(pairs)
    ma, mb = sum(ra) / n, sum(rb) / n
    rho = sum((x - ma) * (y - mb) for x, y in zip(ra, rb)) / math.sqrt(
        sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb))
    assert sp.rho == pytest.approx(rho)
    c = d = ta = tb = 0
    for (a1, b1), (a2, b2) in itertools.combinations(pairs, 2):
        s = (a1 - a2) * (b1 - b2)
        c += s > 0
        d += s < 0
        ta += a1 == a2
        tb += b1 == b2
    n0 = n * (n - 1) / 2
    assert kd.tau_b == pytest.approx((c - d) / math.sqrt((n0 - ta) * (n0 - tb)))


def test_shap_linear_sums_to_margin_difference(spark):
    df = spark.createDataFrame([(i, i % 3, (i * 5) % 7) for i in range(20)], "id int, a int, b int")
    beta = {"a": 0.4, "b": -0.3}
    phi = attribution.shap_linear(df, beta, "id")
    per_row = phi.groupBy("id").agg(F.sum("phi").alias("s"))
    means = df.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb")).first()
    for r in per_row.join(df, "id").collect():
        assert r.s == pytest.approx(0.4 * (r.a - means.ma) - 0.3 * (r.b - means.mb))


def test_attr_pairwise_matrix_equals_long(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    mats = []
    for i in range(10):
        m = rng.normal(size=(3, 3))
        m = (m + m.T) / 2
        mats.append((i, m.tolist()))
    df = spark.createDataFrame(mats, "row_id int, phi array<array<double>>")
    meta = {"s1": "A", "s2": "A", "s3": "B"}
    got = {(r.b1, r.b2): r.value for r in attribution.attr_pairwise_matrix(df, "phi", ["s1", "s2", "s3"], meta).collect()}
    expect = sum(abs(m[0][2]) + abs(m[1][2]) for _, m in mats) / 10
    assert got[("A", "B")] == pytest.approx(expect)


def test_three_way_proxy_brute_force(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 4.0), ("c", "d", 8.0)],
                                  "b1 string, b2 string, value double")
    got = {(r.f1, r.f2, r.f3): r.value for r in attribution.three_way_proxy(pairs).collect()}
    assert got[("a", "b", "c")] == 14.0 and got[("b", "c", "d")] == 24.0 and got[("a", "b", "d")] == 2.0


def test_mice_invariants(spark):
    rows = [(i, (i % 5) + 1 if i % 7 else None, (i % 3) + 1, float(i % 2)) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "id long, x int, z int, y double")
    out, trace = impute.mice(df, "id", ["x"], ["z", "y"], m=3, sweeps=2, seed=1)
    assert out.where(F.col("x").isNull()).count() == 0
    joined = out.join(df.select("id", F.col("x").alias("x0")), "id").where(F.col("x0").isNotNull())
    assert joined.where(F.col("x") != F.col("x0")).count() == 0
    assert out.select("imp").distinct().count() == 3 and trace.count() == 3 * 2


def test_mice_chains_differ_and_pool(spark):
    """Values are matched from observed ones, chains differ in their coefficients, and pooling sees it."""
    import random

    r = random.Random(6)
    rows = []
    for i in range(1500):
        z = r.randrange(5)
        x = min(7, max(1, round(1 + z + r.gauss(0, 1))))
        b = float(r.random() < 0.2 + 0.15 * z)
        y = float(r.random() < 1 / (1 + math.exp(2 - 0.5 * x)))
        rows.append((i, x if r.random() < 0.6 else None, z, b if r.random() < 0.8 else None, y))
    df = spark.createDataFrame(rows, "id long, x int, z int, b double, y double")
    # the method of a column follows the caller or the column's type, never its values
    out, _ = impute.mice(df, "id", ["x", "b"], ["z", "y"], m=4, sweeps=3, seed=2, methods={"b": "logreg"})
    out = out.checkpoint()
    assert {v.x for v in out.select("x").distinct().collect()} <= {v[1] for v in rows if v[1] is not None}
    assert {v.b for v in out.select("b").distinct().collect()} == {0.0, 1.0}
    rel = out.join(df.where("x is null").select("id"), "id").groupBy("z").agg(F.avg("x").alias("m")).orderBy("z").collect()
    assert rel[-1].m - rel[0].m > 2.5  # the imputed values follow the predictor
    coefs, _ = models.logit_by_group(out, "imp", "y", ["x"], model="x")
    pooled = {v.variable: v for v in inference.rubin_pool(coefs.select("imp", "model", "variable", "beta", "se")).collect()}
    assert pooled["x"].between_var > 0 and not pooled["x"].degenerate and pooled["x"].beta > 0.2


def test_chi2_lr_test_table(spark):
    fits = spark.createDataFrame([(1, 1, -100.0), (2, 2, -95.0), (3, 4, -94.0)], "model_no int, n_params int, loglik double")
    rows = {r.model_no: r for r in inference.lr_test(fits).collect()}
    assert rows[1].lr_stat is None and rows[2].lr_stat == 10.0 and rows[3].lr_df == 2
    assert rows[3].lr_p == pytest.approx(math.exp(-1.0), abs=1e-9)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_tree_shap_efficiency(spark, kind):
    """Σφ + E f = f(x) for every row (forest: probability; boosting: margin)."""
    from wavekit.operators import ml, treeshap
    from wavekit.session import scratch_path

    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") * 13) % 11).cast("double").alias("c"),
        (((F.col("id") % 7) + (F.col("id") % 5)) > 5).cast("double").alias("label"),
    )
    df = ml.assemble(df, ["a", "b", "c"])
    if kind == "forest":
        model = ml.random_forest(df, num_trees=5, max_depth=4, seed=1)
    else:
        model = ml.gbt(df, max_iter=5, max_depth=3, validation_frac=None, seed=1)
    phi, base, out_kind = treeshap.shap_tree(df, model, "features", "row_id", ["a", "b", "c"], scratch_path(spark, "ts"))
    total = phi.groupBy("row_id").agg(F.sum("phi").alias("s"))
    f = treeshap.explained_output(model, df, "features", "row_id", out_kind)
    diff = total.join(f, "row_id").select(F.max(F.abs(F.col("s") + F.lit(base) - F.col("f")))).first()[0]
    assert diff < 1e-9


def test_quantiles_exact_order_statistics(spark):
    vals = [5.0, 1.0, 3.0, 3.0, 10.0, None, 7.5]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(vals)], "x double, g int")
    got = {r.prob: r.value for r in profile.quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    s = sorted(v for v in vals if v is not None)
    for p, v in got.items():
        pos = (len(s) - 1) * p
        k = math.floor(pos)
        exp = s[k] if k + 1 >= len(s) else s[k] + (s[k + 1] - s[k]) * (pos - k)
        assert v == pytest.approx(exp)
    grouped = profile.quantiles(df, "x", [0.5], by=["g"]).collect()
    assert len(grouped) == 2


def test_logit_separation_and_single_class_reported_not_raised(spark):
    sep = spark.createDataFrame([(x, float(x >= 2)) for x in range(4) for _ in range(20)], "x int, y double")
    assert models.logit(sep, "y", ["x"]).separation
    one = spark.createDataFrame([(x, 1.0) for x in range(4) for _ in range(5)], "x int, y double")
    assert models.logit(one, "y", ["x"]).separation
    ok = spark.createDataFrame([(x, float((i + x) % 3 == 0)) for x in range(4) for i in range(30)], "x int, y double")
    assert not models.logit(ok, "y", ["x"]).separation
