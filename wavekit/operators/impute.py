"""Simple and multiple imputation.

``impute_fit`` fits on the training rows (exact median and mode from stacked value counts, mean, or a constant) returning a one-row parameter table; ``impute_apply`` is a
``coalesce`` against that broadcast row. ``mice`` runs chained equations (M independent
chains in one table keyed by ``imp``, each regression solved from one aggregate of moments) and cuts lineage with a
reliable ``checkpoint`` after each sweep.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavekit.functions.hashing import hash_uniform
from wavekit.functions.scalars import attach
from wavekit.operators.profile import column_counts, column_medians, column_modes
from wavekit.operators.recode import NUMERIC


def impute_fit(train: DataFrame, cols: Sequence[str], strategy: str = "median", fill_value=None) -> DataFrame:
    """One-row table of fill values fitted on ``train`` (medians and modes from stacked value counts)."""
    if strategy == "median":
        return column_medians(train, cols)
    if strategy == "most_frequent":
        return _modes(train, cols)
    aggs = []
    for c in cols:
        x = F.col(c)
        if strategy == "mean":
            e = F.avg(x)
        elif strategy == "constant":
            e = F.lit(fill_value)
        else:
            raise ValueError(strategy)
        aggs.append(e.alias(c))
    return train.agg(*aggs)


def _modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of every column (the smallest of several), in the column's type."""
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC)]
    parts = []
    if numeric:
        found = column_modes(column_counts(df, numeric))
        parts.append(found.agg(*[F.max(F.when(F.col("variable") == c, F.col("mode"))).cast(df.schema[c].dataType).alias(c) for c in numeric]))
    for c in (c for c in cols if c not in numeric):
        n = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        parts.append(n.agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(c)))
    return reduce(attach, parts).select(*cols)


def impute_apply(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL cells take the fitted value (params is the one-row table from ``impute_fit``)."""
    p = params.select(*[F.col(c).alias(f"__fill_{c}") for c in cols])
    out = attach(df, p)
    for c in cols:
        # the column takes the fill value's type (a median of integer codes may be x.5)
        ftype = params.schema[c].dataType
        out = out.withColumn(c, F.coalesce(F.col(c).cast(ftype), F.col(f"__fill_{c}")))
    return out.drop(*[f"__fill_{c}" for c in cols])


def impute_simple(train: DataFrame, test: DataFrame | None, cols: Sequence[str], strategy: str = "median",
                  fill_value=None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Fit on train, apply to train and test: (train_filled, test_filled, params)."""
    params = impute_fit(train, cols, strategy, fill_value)
    return impute_apply(train, params, cols), (impute_apply(test, params, cols) if test is not None else None), params


def imputed_stack(df: DataFrame, cols: Sequence[str], m: int = 5, imp_col: str = "imp") -> DataFrame:
    """Deterministic family of M completed copies in one table: a NULL cell of copy i takes the column's
    median plus (i mod 2). Rows × M are produced by a narrow explode; stats are one aggregate."""
    med = column_medians(df, cols)
    imps = F.explode(F.sequence(F.lit(1), F.lit(m))).alias(imp_col)
    out = attach(df.select("*", imps), med.select(*[F.col(c).alias(f"__med_{c}") for c in cols]))
    for c in cols:
        dtype = df.schema[c].dataType
        med = F.col(f"__med_{c}") if isinstance(dtype, (T.DoubleType, T.FloatType)) else F.floor(F.col(f"__med_{c}"))
        fill = med + F.pmod(F.col(imp_col), F.lit(2))
        out = out.withColumn(c, F.coalesce(F.col(c), fill.cast(dtype)))
    return out.drop(*[f"__med_{c}" for c in cols])


def _normal_from_hash(id_col: str, seed, *extra):
    """Standard normal deviate by Box–Muller on two hash uniforms."""
    u1 = F.greatest(hash_uniform(id_col, seed, "u1", *extra), F.lit(1e-12))
    u2 = hash_uniform(id_col, seed, "u2", *extra)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)


#: Bins of the prediction in predictive mean matching.
PMM_BINS = 400
#: Codes in all bins of all chains up to which the donors are broadcast to the rows.
DONOR_VALUES = 100_000
#: Levels of an unordered column, at most (more raise), and the ridge that keeps separated classes finite.
MAX_CLASSES = 50
RIDGE = 1e-3


def _moments(rows: DataFrame, target: str, feats: Sequence[Column], imp_col: str) -> dict:
    """Per chain: X'X, X'y, y'y and n over observed rows with counts ``n``, from one partially aggregated pass (chains x
    features² numbers reach the driver)."""
    import numpy as np

    x = [F.lit(1.0), *feats]
    p, y, n = len(x), F.col(target), F.col("n")
    rows = (
        rows.groupBy(imp_col)
        .agg(
            F.sum(n).alias("n"), F.sum(n * y * y).alias("yy"),
            F.array(*[F.sum(n * x[i] * x[j]) for i in range(p) for j in range(i, p)]).alias("xx"),
            F.array(*[F.sum(n * v * y) for v in x]).alias("xy"),
        ).collect()
    )
    out = {}
    for r in rows:
        xx = np.zeros((p, p))
        xx[np.triu_indices(p)] = r.xx
        out[r[imp_col]] = (xx + np.triu(xx, 1).T, np.array(r.xy), r.yy, r.n)
    return out


def _normal_draw(mean, covariance, rng):
    import numpy as np

    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    return mean + (vector * np.sqrt(np.maximum(value, 0))) @ rng.standard_normal(len(mean))


def _draw(moments, rng):
    """Least-squares coefficients, and a draw of (coefficients, residual sd) from their posterior."""
    import numpy as np

    xx, xy, yy, n = moments
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    rss = max(yy - beta @ xy, 1e-9)
    sigma = float(np.sqrt(rss / rng.chisquare(max(n - len(beta), 1))))
    return beta, _normal_draw(beta, sigma**2 * inv, rng), sigma


def _by_chain(imp_col: str, values: dict) -> Column:
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v))])[F.col(imp_col)]


def _linear(imp_col: str, feats: Sequence[Column], betas: dict) -> Column:
    out = _by_chain(imp_col, {k: float(b[0]) for k, b in betas.items()})
    for i, x in enumerate(feats, start=1):
        out = out + _by_chain(imp_col, {k: float(b[i]) for k, b in betas.items()}) * x
    return out


def _class_shares(imp_col: str, feats: Sequence[Column], betas: dict, classes: int) -> list[Column]:
    """Probabilities of classes 1 … K − 1 (class 0 is the reference) under the chains' coefficients ((K − 1) × p)."""
    odds = [F.exp(F.least(_linear(imp_col, feats, {k: b[c] for k, b in betas.items()}), F.lit(500.0))) for c in range(classes - 1)]
    total = sum(odds, F.lit(1.0))
    return [o / total for o in odds]


def fit_classes(cells: DataFrame, target: str, feats: Sequence[Column], classes: int, imp_col: str, steps: int = 30, tol: float = 1e-8) -> dict:
    """{chain: (coefficients ((K − 1) × p), covariance)} of a multinomial logit of ``target`` (codes 0 … K − 1) on
    ``feats`` over rows with counts ``n``, for all chains at once: a Newton step is one partially aggregated pass that
    gives every chain's gradient and information. ``RIDGE`` times the identity is added to the information."""
    import numpy as np

    x, free = [F.lit(1.0), *feats], classes - 1
    p, n = len(x), F.col("n").cast("double")
    chains = [r[0] for r in cells.select(imp_col).distinct().collect()]  # the m chains
    betas = {k: np.zeros((free, p)) for k in chains}
    blocks = [(k, c) for k in range(free) for c in range(k, free)]
    upper = np.triu_indices(p)
    information = {}
    for _ in range(steps):
        named = cells.withColumns({f"__p{k}": v for k, v in enumerate(_class_shares(imp_col, feats, betas, classes))})
        prob = [F.col(f"__p{k}") for k in range(free)]
        rows = named.groupBy(imp_col).agg(
            F.array(*[F.sum(n * ((F.col(target) == k + 1).cast("double") - prob[k]) * v) for k in range(free) for v in x]).alias("g"),
            F.array(*[
                F.sum(n * prob[k] * ((1 - prob[c]) if k == c else -prob[c]) * x[i] * x[j]) for k, c in blocks for i in range(p) for j in range(i, p)
            ]).alias("h"),
        ).collect()  # chains × (classes · features)² / 2 numbers
        moved = 0.0
        for r in rows:
            info, at = np.zeros((free * p, free * p)), 0
            for k, c in blocks:
                half = np.zeros((p, p))
                half[upper] = r.h[at : at + len(upper[0])]
                at += len(upper[0])
                block = half + np.triu(half, 1).T
                info[k * p : (k + 1) * p, c * p : (c + 1) * p] = block
                info[c * p : (c + 1) * p, k * p : (k + 1) * p] = block
            info += RIDGE * np.eye(free * p)
            beta = betas[r[imp_col]].reshape(-1)
            step = np.linalg.solve(info, np.array(r.g) - RIDGE * beta)
            betas[r[imp_col]] = (beta + step).reshape(free, p)
            information[r[imp_col]] = info
            moved = max(moved, float(np.abs(step).max()))
        if moved < tol:
            break
    return {k: (betas[k], np.linalg.inv(information[k])) for k in information}


def _donors(rows: DataFrame, target: str, imp_col: str, bin_: Column) -> DataFrame:
    """(chain, bin, values, cumulative shares) of the observed codes by bin of the predicted mean, from rows with counts
    ``n``; an empty bin takes the nearest one that has donors. Up to ``DONOR_VALUES`` codes in all bins are put in order on
    the driver and broadcast; more stay on the cluster, and only which bins have any (chains × bins) does not."""
    import numpy as np

    spark = rows.sparkSession
    counts = rows.groupBy(imp_col, bin_.alias("b"), F.col(target).alias("v")).agg(F.sum("n").alias("n"))

    def nearest(full):
        for chain, bins in full.items():
            have = np.array(sorted(bins))
            for b in range(PMM_BINS):
                yield chain, b, int(have[np.argmin(np.abs(have - b))])

    found = counts.limit(DONOR_VALUES + 1).collect()
    if len(found) <= DONOR_VALUES:
        held: dict = {}
        for r in sorted(found, key=lambda r: r.v):
            held.setdefault(r[imp_col], {}).setdefault(r.b, []).append((r.v, r.n))
        shares = {(k, b): ([v for v, _ in c], (np.cumsum([n for _, n in c]) / sum(n for _, n in c)).tolist()) for k, bins in held.items() for b, c in bins.items()}
        out = spark.createDataFrame([(k, b, *shares[k, at]) for k, b, at in nearest(held)], f"{imp_col} int, __b int, __vals array<double>, __cum array<double>")
        return F.broadcast(out.coalesce(1))
    cells = counts.groupBy(imp_col, "b").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("c"), F.sum("n").alias("total")).checkpoint()
    full: dict = {}
    for r in cells.select(imp_col, "b").collect():
        full.setdefault(r[imp_col], []).append(r.b)
    places = spark.createDataFrame(list(nearest(full)), f"{imp_col} int, __b int, b int")
    running = F.aggregate(
        "c", F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<double>").alias("s")),
        lambda acc, x: F.struct((acc["t"] + x["n"]).alias("t"), F.array_append(acc["s"], (acc["t"] + x["n"]) / F.col("total")).alias("s")),
    )["s"]
    return places.join(cells, [imp_col, "b"]).select(imp_col, "__b", F.transform("c", lambda x: x["v"]).alias("__vals"), running.alias("__cum"))


def _levels(df: DataFrame, col: str) -> list:
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{col} has more than {MAX_CLASSES} levels: not an unordered code")
    return sorted(found)


def mice(
    df: DataFrame,
    id_col: str,
    targets: Sequence[str],
    predictors: Sequence[str],
    m: int = 5,
    sweeps: int = 20,
    seed: int = 42,
    imp_col: str = "imp",
    methods: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Multiple imputation by chained equations: ``m`` independent chains, kept in one table.

    Start: a null cell takes the median (unordered codes: the most frequent level). Each sweep and target regresses the
    target on all other columns (current values) over its observed rows, separately in each chain; the coefficients used
    are a draw from their posterior, so imputations differ between chains by more than noise. The method follows
    ``methods``, else the column's type alone:

    * ``pmm`` (whole numbers): the row's drawn prediction is matched to observed rows with a like predicted mean, and
      one of their values is taken; meant for codes, whose distinct values per bin are held in one array;
    * ``norm`` (fractional numbers): normal noise around the drawn prediction, clipped to the observed range;
    * ``logreg`` (booleans) and ``polyreg`` (strings): a draw from the probabilities of a logit of the two or more
      unordered levels, at most ``MAX_CLASSES``; as predictors of other columns such levels are indicators.

    Rows without a missing target are the same in all chains and sweeps: they are counted once by their values, and only
    the others are kept per chain.

    Observed cells never change. Every step is one aggregate over the rows; least squares are solved from its moments,
    logits by Newton steps that are one aggregate each for all chains. Random numbers are hashes of the id (rows) and
    seeded per chain, sweep and target (coefficients): results do not depend on partitions or retries. Lineage is cut
    every sweep. Returns (stack, trace): trace has mean and sd per (imp, sweep, variable), of level numbers for
    unordered codes.
    """
    import numpy as np

    from wavekit.session import ensure_checkpoint_dir, written

    ensure_checkpoint_dir(df.sparkSession)
    targets, predictors = list(targets), list(predictors)
    cols = list(dict.fromkeys(targets + predictors))
    by_type = {T.BooleanType: "logreg", T.StringType: "polyreg", T.DoubleType: "norm", T.FloatType: "norm", T.DecimalType: "norm"}
    method = {c: (methods or {}).get(c) or by_type.get(type(df.schema[c].dataType), "pmm") for c in cols}
    levels = {c: _levels(df, c) for c in cols if method[c] in ("logreg", "polyreg")}

    def number(c):
        if c not in levels:
            return F.col(c).cast("double")
        place = F.array_position(F.array(*[F.lit(v) for v in levels[c]]).cast(T.ArrayType(df.schema[c].dataType)), F.col(c))
        return F.when(F.col(c).isNotNull() & (place > 0), (place - 1).cast("double"))

    base = written(df.select(id_col, *[number(c).alias(c) for c in cols], *[F.col(c).isNull().alias(f"__miss_{c}") for c in targets]))
    span = base.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    targets = [c for c in targets if span[f"hi_{c}"] is not None]  # a column without any value stays as it is
    plain, coded = [c for c in targets if c not in levels], [c for c in targets if c in levels]
    start = reduce(attach, [f for f in (plain and column_medians(base, plain), coded and _modes(base, coded)) if f]) if targets else None
    if targets:
        base = attach(base, start.select(*[F.col(c).alias(f"__med_{c}") for c in targets]))
    chains = F.explode(F.sequence(F.lit(1), F.lit(m))).alias(imp_col)
    some = reduce(lambda x, y: x | y, [F.col(f"__miss_{c}") for c in targets], F.lit(False))
    whole = base.where(~some)
    stack = base.where(some).select(
        id_col, chains, *[f"__miss_{c}" for c in targets],
        *[F.coalesce(F.col(c), F.col(f"__med_{c}")).alias(c) if c in targets else F.col(c) for c in cols],
    ).checkpoint()
    names = stack.columns
    settled = written(whole.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))) if targets else None  # the same in every chain

    def design(others):
        """(expression, lowest, highest value) of every regressor."""
        out = []
        for c in others:
            if c in levels:
                out += [((F.col(c) == k).cast("double"), 0.0, 1.0) for k in range(1, len(levels[c]))]
            else:
                out.append((F.col(c), span[f"lo_{c}"], span[f"hi_{c}"]))
        return out

    def observed(c, others):
        """(chain, columns, n): the rows that ``c`` is regressed over."""
        own = stack.where(~F.col(f"__miss_{c}")).select(imp_col, *cols, F.lit(1).cast("long").alias("n"))
        return own.unionByName(settled.select(chains, *cols, "n")).dropna(subset=others)

    # what the settled rows add to the moments of every regression never changes
    fixed = {}
    for c in targets:
        others = [p for p in cols if p != c and span[f"hi_{p}"] is not None]
        if c not in levels:
            once = settled.dropna(subset=others).select(F.lit(0).alias(imp_col), *cols, "n")
            fixed[c] = _moments(once, c, [x for x, _, _ in design(others)], imp_col).get(0)

    def moments(c, others, feats):
        """The settled rows' moments and those of the chain's other rows where ``c`` is observed."""
        rows = stack.where(~F.col(f"__miss_{c}")).dropna(subset=others).withColumn("n", F.lit(1).cast("long"))
        out = _moments(rows, c, feats, imp_col)
        if fixed[c]:
            out = {k: tuple(x + y for x, y in zip(fixed[c], out[k])) if k in out else fixed[c] for k in range(1, m + 1)}
        return out

    # mean and squares of the settled rows, for the trace
    level = settled.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(f"{c}__s") for c in targets]).first() if targets else None
    centre = {c: level[f"{c}__s"] / level["n"] for c in targets} if targets and level["n"] else {}
    spread = settled.agg(*[F.sum(F.col("n") * (F.col(c) - centre[c]) ** 2).alias(c) for c in targets]).first() if centre else None

    def stats(c):
        """(mean, sd) of ``c`` in a chain: its rows joined with the settled ones."""
        n1, mean1, m1 = F.count(c).cast("double"), F.coalesce(F.avg(c), F.lit(0.0)), F.coalesce(F.var_pop(c), F.lit(0.0)) * F.count(c)
        n0, mean0, m0 = (float(level["n"]), centre[c], spread[c]) if centre else (0.0, 0.0, 0.0)
        n = n0 + n1
        mean = F.when(n > 0, (n0 * mean0 + n1 * mean1) / F.when(n > 0, n))
        sd = F.when(n > 1, F.sqrt((m0 + m1 + n0 * n1 / n * (mean1 - mean0) ** 2) / F.when(n > 1, n - 1)))
        return mean.alias("mean"), sd.alias("sd")

    every = df.sparkSession.range(1, m + 1).select(F.col("id").cast("int").alias(imp_col))
    traces = []
    for sweep in range(1, sweeps + 1):
        held = []
        for t, c in enumerate(targets):
            others = [p for p in cols if p != c and span[f"hi_{p}"] is not None]
            regressors = design(others)
            feats = [x for x, _, _ in regressors]
            u = hash_uniform(id_col, seed, F.col(imp_col), sweep, c)
            rng = {k: np.random.default_rng([seed, sweep, t, k]) for k in range(1, m + 1)}
            if c in levels:
                matched, k = stack, len(levels[c])
                cells = observed(c, others).groupBy(imp_col, *others, c).agg(F.sum("n").alias("n")).checkpoint()
                fits = fit_classes(cells, c, feats, k, imp_col) if k > 1 else {}
                drawn = {i: _normal_draw(b.reshape(-1), cov, rng[i]).reshape(b.shape) for i, (b, cov) in fits.items()}
                share = _class_shares(imp_col, feats, drawn, k) if fits else []
                # class 0 first: the number of cumulative probabilities that u reaches
                running = [1 - sum(share[i:], F.lit(0.0)) for i in range(k - 1)] if fits else []
                value = sum([(u >= r).cast("double") for r in running], F.lit(0.0))
            else:
                fits = {i: _draw(v, rng[i]) for i, v in moments(c, others, feats).items()}
                drawn = _linear(imp_col, feats, {k: f[1] for k, f in fits.items()})
            if method[c] == "pmm":
                fitted = {k: f[0] for k, f in fits.items()}
                ends = {
                    k: tuple(b[0] + sum(f(b[i] * low, b[i] * high) for i, (_, low, high) in enumerate(regressors, start=1)) for f in (min, max))
                    for k, b in fitted.items()
                }
                lo = _by_chain(imp_col, {k: float(e[0]) for k, e in ends.items()})
                width = _by_chain(imp_col, {k: float(max(e[1] - e[0], 1e-9)) / PMM_BINS for k, e in ends.items()})
                place = lambda v: F.least(F.greatest(F.floor((v - lo) / width), F.lit(0)), F.lit(PMM_BINS - 1)).cast("int")
                donors = _donors(observed(c, others), c, imp_col, place(_linear(imp_col, feats, fitted)))
                matched = stack.withColumn("__b", place(drawn)).join(donors, [imp_col, "__b"], "left")
                value = F.get("__vals", F.least(F.size(F.filter("__cum", lambda s: s < u)), F.size("__vals") - 1))
            elif method[c] == "norm":
                noise = _by_chain(imp_col, {k: f[2] for k, f in fits.items()}) * _normal_from_hash(id_col, seed, F.col(imp_col), sweep, c)
                matched, value = stack, F.least(F.greatest(drawn + noise, F.lit(span[f"lo_{c}"])), F.lit(span[f"hi_{c}"]))
            stack = matched.withColumn(c, F.when(F.col(f"__miss_{c}"), F.coalesce(value, F.col(c))).otherwise(F.col(c))).select(*names)
            if t < len(targets) - 1:  # the next target reads these rows several times
                stack = stack.persist()
                held.append(stack)
        stack = stack.checkpoint()
        for rows in held:
            rows.unpersist()
        of = stack.join(F.broadcast(every), imp_col, "right").groupBy(imp_col).agg(F.array(*[F.struct(F.lit(c).alias("variable"), *stats(c)) for c in targets]).alias("__t"))
        traces.append(of.select(imp_col, F.lit(sweep).alias("sweep"), F.inline("__t")))

    def back(c):
        if c not in levels:
            return F.col(c).cast(df.schema[c].dataType) if c in targets else F.col(c)
        own = F.array(*[F.lit(v) for v in levels[c]]).cast(T.ArrayType(df.schema[c].dataType))
        return F.get(own, F.col(c).cast("int")).alias(c)

    out = stack.select(id_col, imp_col, *cols).unionByName(whole.select(id_col, chains, *cols)).select(id_col, imp_col, *[back(c) for c in cols])
    return out, reduce(DataFrame.unionByName, traces)
