"""Pairwise-complete correlation: Pearson, Spearman (average ranks) and Kendall τ-b.

Pearson is one wide aggregate. Spearman ranks each column once over its distinct values (again only for pairs
with a column that has nulls) and is one wide aggregate of the joined ranks. Kendall sorts the rows once by each
column of many values and counts, as they stream by, its concordances with all columns of few values; other pairs
are collapsed to value cells, and concordances counted by the bits of one column's ranks, with running totals over
the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavekit.functions.ordering import running_total
from wavekit.operators.profile import distinct_counts

#: Values up to which (about) a column counts as one of few values: counts by value are a short vector.
FEW_VALUES = 64


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    cols = list(cols)
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def pair_cells(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """(var1, var2, a, b, n): counts of pairwise-complete value cells for every column pair; a row counts ``weight``
    times."""
    stacked = df.select(
        (F.col(weight) if weight else F.lit(1).cast("long")).alias("w"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(x).alias("var1"), F.lit(y).alias("var2"), F.col(x).cast("double").alias("a"),
                             F.col(y).cast("double").alias("b"))
                    for x, y in _pairs(cols)
                ]
            )
        ),
    )
    return stacked.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("var1", "var2", "a", "b").agg(
        F.sum("w").alias("n")
    )


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var1, var2, n, r) for every pair i < j: one wide aggregate of ``corr`` (null rows skipped per pair)."""
    pairs = _pairs(cols)
    row = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def conditional_ranks(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """``df`` with the average ranks of every column: one rank column for all its values, and one more for each
    other column that has nulls (the rank among rows where that one is present too). Returns the frame and
    {(column, other): rank column}.

    Ranks are made once per distinct value: one stacked, partially aggregated group-by counts each value, in all
    rows and in those where each null-bearing column is present; bucketed cumulative counts turn counts into
    ranks; a join by value brings each column's ranks to its rows. Rows are never multiplied by pairs."""
    from wavekit.operators.evaluate import cumulative_counts
    from wavekit.session import ensure_checkpoint_dir, written

    ensure_checkpoint_dir(df.sparkSession)
    cols = list(cols)
    num = written(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))  # read three times
    nulls = num.agg(*[F.count_if(F.col(f"c{i}").isNull()).alias(f"c{i}") for i in range(len(cols))]).first()
    holes = [i for i in range(len(cols)) if nulls[f"c{i}"]]
    values = F.array(*[F.struct(F.lit(i).alias("j"), F.col(f"c{i}").alias("v")) for i in range(len(cols))])
    present = [F.col(f"c{i}").isNotNull().cast("long").alias(f"p{i}") for i in holes]
    stacked = num.select(F.explode(values).alias("s"), *present).where("s.v is not null")
    counts = stacked.groupBy(F.col("s.j").alias("j"), F.col("s.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"n{i}") for i in holes]
    ).checkpoint()
    names = ["n", *[f"n{i}" for i in holes]]
    ranks = cumulative_counts(counts, "v", names, by=["j"]).select(
        "j", "v", *[(F.col(f"{k}_before") + (F.col(k) + 1) / 2.0).alias(f"r_{k}") for k in names]
    ).checkpoint()
    out, where = num, {}
    for i, c in enumerate(cols):
        mine = [k for k in names if k != f"n{i}"]
        own = ranks.where(F.col("j") == i).select(F.col("v").alias(f"v{i}"), *[F.col(f"r_{k}").alias(f"r{i}_{k}") for k in mine])
        out = out.join(own, F.col(f"c{i}") == F.col(f"v{i}"), "left").drop(f"v{i}")
        for o, other in enumerate(cols):
            where[c, other] = f"r{i}_n{o}" if o in holes else f"r{i}_n"
    return out, where


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var1, var2, n, rho): Pearson on average ranks over each pair's complete rows, in one wide aggregate."""
    ranked, where = conditional_ranks(df, cols)
    aggs, pairs = [], _pairs(cols)
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(where[a, b]), F.col(where[b, a])
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.count_if(both).alias(f"n{i}"), F.corr(F.when(both, x), F.when(both, y)).alias(f"r{i}")]
    row = ranked.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("rho"))
        for i, (a, b) in enumerate(pairs)
    ]))).where("n > 0")


def concordances(cells: DataFrame) -> DataFrame:
    """(var1, var2, c_minus_d): concordant less discordant pairs of observations over the value cells (a, b, n) of every
    pair of columns.

    Two cells with different a part at exactly one bit of a's rank, the highest that differs: there they stand in one
    node (the ranks' bits above) on its left and right. So each cell is one row on each of the levels of its rank's
    bits; cells of one node, level and b are added up; and a running total of the left counts in the order of b within
    the nodes says how many left cells lie below every right cell. Rows grow with cells × levels (the column with
    fewer values gives the levels), no group is held by one task, and all sums are exact integers."""
    from wavekit.operators.evaluate import cumulative_counts

    pair = ["var1", "var2"]
    values = lambda c: cells.groupBy(*pair, F.col(c).alias("v")).agg(F.lit(1).alias("one"))
    width = values("a").groupBy(*pair).agg(F.count("*").alias("na")).join(values("b").groupBy(*pair).agg(F.count("*").alias("nb")), pair)
    sides = cells.join(F.broadcast(width), pair).select(  # one row a pair of columns
        *pair, F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("v"),
        F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("b"), "n", F.least("na", "nb").alias("values"),
    )
    ranks = cumulative_counts(sides.groupBy(*pair, "v").agg(F.lit(1).alias("one")).checkpoint(), "v", ["one"], by=pair)
    ranked = sides.join(ranks.select(*pair, "v", F.col("one_before").alias("rank")), [*pair, "v"])
    levels = F.length(F.bin(F.col("values") - 1)) - 1  # the highest bit that a rank can have
    rows = ranked.where("values > 1").select(*pair, "rank", "b", "n", F.explode(F.sequence(F.lit(0), levels)).alias("level"))
    node, right = F.expr("shiftright(rank, level + 1)"), F.expr("shiftright(rank, level) & 1 = 1")
    sums = rows.groupBy(*pair, "level", node.alias("node"), "b").agg(
        F.sum(F.when(right, 0).otherwise(F.col("n"))).cast("long").alias("l"), F.sum(F.when(right, F.col("n")).otherwise(0)).cast("long").alias("r")
    )
    placed = running_total(sums, [*pair, "level", "node", "b"], "l", "before")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    nodes = placed.groupBy(*pair, "level", "node").agg(
        F.sum(whole("r") * whole("before")).alias("rb"), F.sum(whole("r") * whole("l")).alias("rl"), F.sum("r").alias("r"),
        F.sum("l").alias("l"), F.min("before").alias("start"),
    )
    below = F.col("rb") - whole("r") * whole("start")  # left and right with the left one below
    net = 2 * below + F.col("rl") - whole("r") * whole("l")
    return nodes.groupBy(*pair).agg(F.sum(net.cast("decimal(38,0)")).cast("double").alias("c_minus_d"))


def few_values(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """{column: its values, ascending, NaN last} of the columns that have about ``FEW_VALUES`` values at most."""
    about = df.agg(*[F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    few = [c for i, c in enumerate(cols) if about[i] <= FEW_VALUES]
    if not few:
        return {}
    sets = df.agg(*[F.collect_set(F.col(c) + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(few)]).first()  # -0.0 is 0.0
    return {c: sorted(sets[i], key=lambda v: (v != v, v)) for i, c in enumerate(few)}


def ordered_concordances(df: DataFrame, by: str, few: dict[str, list[float]]) -> list[tuple]:
    """[(column, n, ties_by, ties_column, c_minus_d)] of ``by`` with every column of few values, over their complete rows.

    The rows are sorted once by ``by``, in ranges of about equal size that may cut one value's rows. A task counts, as its
    rows stream by, each column's values before and in every group of equal ``by``, and returns for its range one row: the
    counts of the first and last group, which may go on in the next range, and those, ties and concordances of the groups
    between. Ranges are then joined in order from these short rows. All sums are exact integers."""
    import numpy as np
    import pyarrow as pa

    from wavekit.session import PART_ROWS

    names, sizes = list(few), [len(v) + 1 for v in few.values()]  # place 0 of a column counts its nulls
    at = np.cumsum([0, *sizes])
    places = [slice(int(i) + 1, int(j)) for i, j in zip(at, at[1:])]
    code = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, few[c])).cast("array<double>"), F.col(c)), F.lit(0)).cast("int")
    rows = df.where(F.col(by).isNotNull()).select(by, *[code(c).alias(f"k{j}") for j, c in enumerate(names)])
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, by, "tie").sortWithinPartitions(by)
    same = lambda x, y: (x == y) | ((x != x) & (y != y))  # noqa: E731  NaN is one value

    def concordant(counts, before):
        """Concordant less discordant pairs of the rows of ``counts`` (groups × values) with the rows before each group."""
        upto = np.cumsum(before, axis=1)
        return (counts * (2 * upto - before - upto[:, -1:])).sum()

    def count(batches):
        from pyspark import TaskContext

        first = last = None
        inner, net, ties = np.zeros(at[-1], np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        step = max(1, 1_000_000 // int(at[-1]))  # rows whose counts are held at once
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            v = b.column(0).to_numpy(zero_copy_only=False)
            new = np.append(True, ~same(v[1:], v[:-1]))
            group, keys = np.cumsum(new) - 1, v[new]
            spots = np.concatenate([group * at[-1] + at[j] + b.column(j + 1).to_numpy(zero_copy_only=False) for j in range(len(names))])
            counts = np.bincount(spots, minlength=len(keys) * at[-1]).reshape(len(keys), -1)
            if last is not None and same(last[0], keys[0]):
                counts[0] += last[1]
            elif last is not None:
                keys, counts = np.append(last[0], keys), np.vstack((last[1], counts))
            if first is None and len(keys) > 1:
                first, keys, counts = (keys[0], counts[0]), keys[1:], counts[1:]
            last, counts = (keys[-1], counts[-1]), counts[:-1]
            before = inner + np.cumsum(counts, axis=0) - counts
            for j, own in enumerate(places):
                net[j] += concordant(counts[:, own], before[:, own])
                m = counts[:, own].sum(axis=1)
                ties[j] += (m * (m - 1) // 2).sum()
            inner += counts.sum(axis=0)
        if last is not None:
            ends = [x for x in (first, last) if x is not None]
            row = {
                "task": TaskContext.get().partitionId(), "keys": [float(k) for k, _ in ends], "ends": [c.tolist() for _, c in ends],
                "inner": inner.tolist(), "net": net.tolist(), "ties": ties.tolist(),
            }
            yield pa.RecordBatch.from_pylist([row])

    kinds = "task long, keys array<double>, ends array<array<long>>, inner array<long>, net array<long>, ties array<long>"
    ranges = sorted(placed.drop("tie").mapInArrow(count, kinds).collect())  # one short row a task
    total, net, ties = np.zeros(at[-1], object), [0] * len(names), [0] * len(names)
    vector = lambda x: np.array(x, object)

    def join(counts):
        nonlocal total
        for j, own in enumerate(places):
            net[j] += concordant(counts[None, own], total[None, own])
        total = total + counts

    def close(group):
        for j, own in enumerate(places):
            m = sum(group[own])
            ties[j] += m * (m - 1) // 2
        join(group)

    key = group = None
    for r in ranges:
        for i, (k, c) in enumerate(zip(r.keys, r.ends)):
            if i:  # what lies between the first and the last group
                close(group)
                join(vector(r.inner))
                net, ties = ([x + y for x, y in zip(mine, more)] for mine, more in ((net, r.net), (ties, r.ties)))
                key, group = k, vector(c)
            elif group is not None and same(key, k):
                group = group + vector(c)
            else:
                if group is not None:
                    close(group)
                key, group = k, vector(c)
    if group is not None:
        close(group)
    own_ties = [sum(m * (m - 1) // 2 for m in total[own]) for own in places]
    return [(c, sum(total[own]), ties[j], own_ties[j], net[j]) for j, (c, own) in enumerate(zip(names, places))]


def kendall(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var1, var2, n, tau_b) of every pair. A column of many values is sorted once for all columns of few values
    (``ordered_concordances``); pairs of two columns of few values, whose rows are counted first, and of two columns of many
    are taken from their value cells, with tie corrections from the cell margins."""
    from wavekit.session import ensure_checkpoint_dir, written

    ensure_checkpoint_dir(df.sparkSession)
    cols = list(cols)
    num = written(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])).toDF(*cols)  # read by every step
    few = few_values(num, cols)
    many = [c for c in cols if c not in few]
    counted = num.groupBy(*few).agg(F.count(F.lit(1)).alias("__n"))
    parts = [_cell_sums(pair_cells(part, own, w)) for part, own, w in ((counted, list(few), "__n"), (num, many, None)) if len(own) > 1]
    if few and many:
        rows = []
        for c in many:
            for other, n, ties, other_ties, net in ordered_concordances(num, c, few):
                first = cols.index(c) < cols.index(other)
                pair, both = ((c, other), (ties, other_ties)) if first else ((other, c), (other_ties, ties))
                rows += [(*pair, int(n), *map(float, both), float(net))] if n else []
        parts.append(df.sparkSession.createDataFrame(rows, "var1 string, var2 string, N long, ties_a double, ties_b double, c_minus_d double"))
    n0 = F.col("N") * (F.col("N") - 1) / 2
    tau = F.col("c_minus_d") / F.sqrt((n0 - F.col("ties_a")) * (n0 - F.col("ties_b")))
    return reduce(DataFrame.unionByName, parts).select("var1", "var2", F.col("N").alias("n"), tau.alias("tau_b"))


def _cell_sums(cells: DataFrame) -> DataFrame:
    """(var1, var2, N, ties_a, ties_b, c_minus_d) of every pair from its value cells."""
    # value cells are bounded by distinct value pairs: materialise once (reliable checkpoint) instead of
    # re-deriving them from the rows in every branch below
    cells = cells.checkpoint()
    ta = cells.groupBy("var1", "var2", "a").agg(F.sum("n").alias("m")).groupBy("var1", "var2").agg(
        F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("ties_a"), F.sum("m").alias("N")
    )
    tb = cells.groupBy("var1", "var2", "b").agg(F.sum("n").alias("m")).groupBy("var1", "var2").agg(
        F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("ties_b")
    )
    return ta.join(tb, ["var1", "var2"]).join(concordances(cells), ["var1", "var2"], "left").fillna(0.0, ["c_minus_d"])


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", mask_below: float | None = None) -> DataFrame:
    """Full symmetric long matrix (var1, var2, r) incl. diagonal; NaN/NULL → 0; optional |r| mask (→ 0)."""
    if method == "pearson":
        half = pearson(df, cols).select("var1", "var2", F.col("r"))
    elif method == "spearman":
        half = spearman(df, cols).select("var1", "var2", F.col("rho").alias("r"))
    elif method == "kendall":
        half = kendall(df, cols).select("var1", "var2", F.col("tau_b").alias("r"))
    else:
        raise ValueError(method)
    spark = df.sparkSession
    diag = spark.createDataFrame([(c, c, 1.0) for c in cols], "var1 string, var2 string, r double")
    full = half.unionByName(half.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r")).unionByName(diag)
    r = F.when(F.isnan("r") | F.col("r").isNull(), F.lit(0.0)).otherwise(F.col("r"))
    if mask_below is not None:
        r = F.when(F.abs(r) >= mask_below, r).otherwise(F.lit(0.0))
    return full.withColumn("r", r)


def corr_pairs(corr: DataFrame, value: str = "rho", lo: float = 0.5, hi: float = 1.0) -> DataFrame:
    """Unordered pairs with lo < |r| < hi."""
    a = F.abs(F.col(value))
    return corr.where((a > lo) & (a < hi))


def select_features(df: DataFrame, cols: Sequence[str], max_missing: float = 0.70, max_abs_corr: float = 0.5,
                    leakage: Sequence[str] = ()) -> DataFrame:
    """Data-driven drop list: missing share > max_missing, zero variance (< 2 distinct values), named leakage,
    and, walking the pairs with |Spearman ρ| > max_abs_corr in order, the later column of each pair whose earlier one
    is still in. (variable, keep, reason)."""
    cols = list(cols)
    missing = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    shares = missing.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), (F.col(c) / F.col("__n")).alias("missing_share")) for c in cols])))
    base = distinct_counts(df, cols).join(shares, "variable").select("variable", "position", "missing_share", "n_distinct")
    # the pairs are walked in column order: a column that is out already takes no other one with it
    strong = {(r.var1, r.var2) for r in spearman(df, cols).where(F.abs(F.col("rho")) > max_abs_corr).collect()}  # columns²/2 at most
    out_already: set[str] = set()
    for i, a in enumerate(cols):
        if a not in out_already:
            out_already |= {b for b in cols[i + 1:] if (a, b) in strong}
    out = base.withColumn("__corr", F.col("variable").isin(sorted(out_already) or [""]))
    reason = (
        F.when(F.col("variable").isin(list(leakage) or [""]), "leakage")
        .when(F.col("missing_share") > max_missing, "missing")
        .when(F.col("n_distinct") < 2, "zero_variance")
        .when(F.col("__corr"), "correlated")
        .otherwise("kept")
    )
    return out.withColumn("reason", reason).withColumn("keep", F.col("reason") == "kept").drop("__corr")
