"""Splitting and resampling with portable hashing.

Exact-quota stratified ranks without a per-stratum single-task window: rows get an md5 key;
counts per (stratum, leading hex digits) form a small table (4096 buckets per stratum, more when a
stratum is larger than 4096 × 100,000 rows) whose
cumulative sums give each prefix bucket's offset. Only the rows of the one boundary bucket per
stratum need a row_number (split), or a window partitioned by (stratum, bucket) — thousands of
balanced partitions — gives every row its exact rank (folds).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavekit.functions.hashing import hash_key, hash_uniform, poisson1_weight
from wavekit.session import saved, written

BUCKET_ROWS = 100_000  # rows of one stratum that a bucket holds on average, at most
FEW_STRATA = 100_000  # strata up to which a table with one row per stratum is broadcast


def _digits(df: DataFrame) -> int:
    """Hex digits of the md5 key that number the buckets: 3 (4096 buckets) or as many as the rows need."""
    digits, n = 3, df.count()
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def _bucket_offsets(keyed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """(strata…, __b, __cnt, __before, __n_s) per (stratum, prefix bucket)."""
    counts = keyed.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ws = Window.partitionBy(*strata)
    return counts.withColumn("__before", F.coalesce(F.sum("__cnt").over(w), F.lit(0))).withColumn(
        "__n_s", F.sum("__cnt").over(ws)
    )


def stratified_rank(df: DataFrame, id_col: str, strata: Sequence[str], seed: int = 42) -> DataFrame:
    """Adds ``rank_in_stratum`` (1-based, md5 order, id as tie key) and ``stratum_n`` for every row."""
    strata = list(strata)
    keyed = df.withColumn("__h", hash_key(id_col, seed)).withColumn("__b", F.substring("__h", 1, _digits(df)))
    offsets = _bucket_offsets(keyed, strata)
    j = keyed.join(offsets, strata + ["__b"])
    w = Window.partitionBy(*strata, "__b").orderBy("__h", id_col)
    return (
        j.withColumn("rank_in_stratum", (F.col("__before") + F.row_number().over(w)).cast("long"))
        .withColumn("stratum_n", F.col("__n_s"))
        .drop("__h", "__b", "__cnt", "__before", "__n_s")
    )


def split_stratified(df: DataFrame, id_col: str, strata: Sequence[str], test_frac: float = 0.2, seed: int | Column = 42,
                     dst: str = "split") -> DataFrame:
    """Exact quota per stratum: the first round(test_frac·n_s) rows in md5 order are 'test', the rest 'train'.

    The quota is turned into one key per stratum, the last that is 'test': bucket counts say in which bucket it lies, and
    only that bucket is ranked. Id and strata are written once for these passes; then the rows themselves are read once and
    compared with their stratum's key (a table of strata, which null strata take part in). That table and the table of
    boundary buckets have one row per stratum and are broadcast, so rows are never shuffled by their (few) strata."""
    strata = list(strata)

    def keyed(rows, key, by):
        return rows.withColumn("__h", F.coalesce(hash_key(key, by), F.lit(""))).withColumn("__b", F.substring("__h", 1, digits))

    groups = {c: f"__s{k}" for k, c in enumerate(strata)}
    names = list(groups.values())
    own = [F.col(f"`{id_col}`").alias("__id"), *[F.col(f"`{c}`").alias(g) for c, g in groups.items()]]
    narrow = written(df.select(*own, *([seed.alias("__seed")] if isinstance(seed, Column) else [])))
    digits = _digits(narrow)
    named = keyed(narrow, "__id", F.col("__seed") if isinstance(seed, Column) else seed).select("__h", "__b", "__id", *names)
    edges = _bucket_offsets(named, names).withColumn("__q", F.round(F.col("__n_s") * test_frac).cast("long"))
    edges = edges.where("__before < __q and __before + __cnt >= __q").select(*names, "__b", (F.col("__q") - F.col("__before")).alias("__take"))
    edges = saved(edges)
    small = F.broadcast if edges.count() <= FEW_STRATA else lambda t: t

    def same(left, right, cols):
        out = F.lit(True)
        for c in cols:
            out = out & left[c].eqNullSafe(right[c])
        return out

    inside = named.alias("n").join(small(edges.alias("e")), same(named, edges, [*names, "__b"])).select("n.*", "e.__take")
    rank = F.row_number().over(Window.partitionBy(*names, "__b").orderBy("__h", "__id"))
    last = inside.withColumn("__r", rank).where("__r = __take").select(*[F.col(g).alias(f"{g}_") for g in names], F.struct("__h", "__id").alias("__last"))
    last = saved(last)
    match = F.lit(True)
    for c, g in groups.items():
        match = match & F.col(f"`{c}`").eqNullSafe(F.col(f"{g}_"))
    out = keyed(df, id_col, seed).join(small(last), match, "left")
    is_test = F.coalesce(F.struct(F.col("__h").alias("__h"), F.col(f"`{id_col}`").alias("__id")) <= F.col("__last"), F.lit(False))
    return out.withColumn(dst, F.when(is_test, "test").otherwise("train")).drop("__h", "__b", "__last", *[f"{g}_" for g in names])


def folds_stratified(df: DataFrame, id_col: str, strata: Sequence[str], k: int = 5, seed: int = 42,
                     dst: str = "fold") -> DataFrame:
    """fold = (rank in stratum − 1) mod k: class shares equal across folds up to one row."""
    ranked = stratified_rank(df, id_col, strata, seed)
    return ranked.withColumn(dst, F.pmod(F.col("rank_in_stratum") - 1, F.lit(k)).cast("int")).drop(
        "rank_in_stratum", "stratum_n"
    )


def split_temporal(df: DataFrame, wave_col: str, train_max: int, test_min: int, dst: str = "split") -> DataFrame:
    """wave ≤ train_max → 'train', wave ≥ test_min → 'test'; rows in between are dropped."""
    w = F.col(wave_col)
    return df.withColumn(dst, F.when(w <= train_max, "train").when(w >= test_min, "test")).where(F.col(dst).isNotNull())


def subsample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the n smallest md5 keys (per-partition top-n, then a merge of n·P rows)."""
    return df.withColumn("__h", hash_key(id_col, seed)).orderBy("__h", id_col).limit(n).drop("__h")


def bootstrap_weights(df: DataFrame, id_col: str, replicates: int, seed: int = 42) -> DataFrame:
    """One row per (row, replicate) with a Poisson(1) multiplicity ``boot_w`` (hash-drawn, reproducible).

    Downstream weighted aggregates grouped by ``replicate`` run with map-side partial aggregation,
    so the exploded rows are pipelined, not materialised.
    """
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    out = df.select("*", reps)
    return out.withColumn("boot_w", poisson1_weight(hash_uniform(id_col, seed, F.col("replicate"))))


def bootstrap_mean(df: DataFrame, id_col: str, value: str, replicates: int, seed: int = 42,
                   by: Sequence[str] = ()) -> DataFrame:
    """Per replicate: Σw, weighted mean of ``value``."""
    bw = bootstrap_weights(df.where(F.col(value).isNotNull()), id_col, replicates, seed)
    return bw.groupBy(*by, "replicate").agg(
        F.sum("boot_w").cast("long").alias("n_boot"),
        (F.sum(F.col("boot_w") * F.col(value)) / F.sum("boot_w")).alias("mean"),
    )


# ---------------------------------------------------------------- exact-n bootstrap

#: Rows of one leaf of the tree of hash buckets, on average.
LEAF_ROWS = 64


def _binomial(u, n, p):
    """Inverse distribution function of Binomial(n, p) at u, elementwise over numpy arrays: the smallest k whose
    cumulative probability reaches u. Small counts are added up from 0 together; a large one takes its own window of
    14 standard deviations around the mean, beyond which less than 1e-30 lies."""
    import numpy as np

    n, p, u = np.broadcast_arrays(n, p, u)
    out = np.where(p >= 1, n, 0).astype(np.int64)
    todo = (p > 0) & (p < 1) & (n > 0)
    small = todo & (n * np.minimum(p, 1 - p) < 50)
    big = np.argwhere(todo & ~small)
    # from the likelier end: k counts draws of the rarer kind, read from the other tail where that is the complement
    flip = small & (p > 0.5)
    q = np.where(flip, 1 - p, p)
    at = np.nonzero(small)
    nn, qq, v = n[at].astype(float), q[at], np.where(flip, 1 - u, u)[at]
    prob = np.exp(nn * np.log1p(-qq))
    total, k, found = prob.copy(), np.zeros(len(nn), np.int64), np.zeros(len(nn), bool)
    strict = flip[at]  # of 1 − u the smallest k with F(k) > 1 − u
    while True:
        found |= np.where(strict, total > v, total >= v) | (k >= nn)
        if found.all():
            break
        go = ~found
        k[go] += 1
        prob[go] *= (nn[go] - k[go] + 1) / k[go] * qq[go] / (1 - qq[go])
        total[go] += prob[go]
    out[at] = np.where(strict, nn.astype(np.int64) - k, k)
    for place in map(tuple, big):
        m, pr = int(n[place]), float(p[place])
        sd = (m * pr * (1 - pr)) ** 0.5
        lo, hi = max(0, int(m * pr - 14 * sd)), min(m, int(m * pr + 14 * sd) + 1)
        ks = np.arange(lo, hi + 1)
        ratio = np.log((m - ks[1:] + 1) / ks[1:] * pr / (1 - pr))
        logs = np.concatenate(([0.0], np.cumsum(ratio)))
        pmf = np.exp(logs - logs.max())
        cdf = np.cumsum(pmf / pmf.sum())
        out[place] = ks[min(int(np.searchsorted(cdf, u[place])), len(ks) - 1)]
    return out


def _uniforms(keys, seed: int, replicates: int):
    """Uniforms [0, 1) by key and replicate r (0-based): the (r mod 4)-th 32 bits of the md5 of 'key:seed:(r div 4)'."""
    import hashlib

    import numpy as np

    parts = -(-replicates // 4)
    raw = [hashlib.md5(f"{k}:{seed}:{part}".encode()).digest() for k in keys for part in range(parts)]
    return np.frombuffer(b"".join(raw), ">u4").reshape(len(keys), 4 * parts)[:, :replicates] / 4294967296.0


def _deal(draws, sizes, keys, seed: int):
    """Deal every replicate's ``draws`` (replicates) over children of ``sizes``: one after the other, a child gets a
    binomial share of the draws that are left, in proportion to its size among the sizes that are left."""
    import numpy as np

    u = _uniforms(keys, seed, len(draws))
    left, rest, out = draws.copy(), int(sum(sizes)), np.zeros((len(sizes), len(draws)), np.int64)
    for k, size in enumerate(sizes):
        out[k] = _binomial(u[k], left, size / rest)
        left, rest = left - out[k], rest - size
    return out


def bootstrap_exact(df: DataFrame, id_col: str, replicates: int, seed: int = 42, dst: str = "boot_w") -> DataFrame:
    """Add ``dst``: an array with the multiplicity of the row in each of ``replicates`` bootstrap samples of exactly n draws
    (n the number of rows), multinomial over the rows.

    A replicate's n draws are split down a tree of hash buckets: the leading hex digits of the rows' md5 keys, one
    digit a level, until a bucket has about ``LEAF_ROWS`` rows, then the bucket's rows. At every node the children take
    their draws by conditional binomials, whose uniforms are hashes of (child, seed, replicate): reruns, retries and
    other partitionings agree. Only counts by bucket go down the tree; no draw and no row is multiplied by replicates.
    Ids must be unique; rows with a null id are taken as one bucket's rows in no stated order.
    """
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    n = df.count()
    digits = 1
    while n > LEAF_ROWS * 16**digits:
        digits += 1
    key = F.coalesce(hash_key(id_col, seed), F.md5(F.lit("")))
    counts = df.groupBy(F.substring(key, 1, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
    counts = counts.checkpoint()
    draws = spark.createDataFrame([("", [n] * replicates)], "bucket string, draws array<long>")
    for level in range(1, digits + 1):
        nodes = counts.groupBy(F.substring("bucket", 1, level).alias("bucket")).agg(F.sum("size").alias("size"))
        nodes = nodes.withColumn("parent", F.substring("bucket", 1, level - 1))
        nodes = nodes.join(draws.select(F.col("bucket").alias("parent"), "draws"), "parent")
        many = F.substring("parent", 1, max(0, level - 3))  # some parents a group: at most 4096 children

        def split_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for _, own in pdf.sort_values("bucket").groupby("parent", sort=False):
                dealt = _deal(np.asarray(own["draws"].iloc[0]), own["size"].tolist(), own["bucket"].tolist(), seed)
                parts.append(pd.DataFrame({"bucket": own["bucket"], "draws": list(dealt)}))
            return pd.concat(parts)

        draws = nodes.withColumn("many", many).groupBy("many").applyInPandas(split_nodes, "bucket string, draws array<long>")
        draws = draws.checkpoint()

    # the rows of a bucket: its children, in the order of their keys
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, digits)).withColumn("__many", F.substring("__key", 1, max(1, digits - 1)))
    keyed = keyed.join(draws.select(F.col("bucket").alias("__bucket"), F.col("draws").alias("__draws")), "__bucket")
    columns, schema = list(df.columns), T.StructType([*df.schema, T.StructField(dst, T.ArrayType(T.LongType()))])
    names = schema.names

    def split_rows(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("__key").to_numpy(zero_copy_only=False), table.column("__bucket").to_numpy(zero_copy_only=False)))
        table = table.take(pa.array(order))
        buckets, keys = table.column("__bucket").to_pylist(), table.column("__key").to_pylist()
        weights, k = np.zeros((len(keys), replicates), np.int64), 0
        while k < len(keys):
            j = k
            while j < len(keys) and buckets[j] == buckets[k]:
                j += 1
            weights[k:j] = _deal(np.array(table.column("__draws")[k].as_py()), [1] * (j - k), keys[k:j], seed)
            k = j
        lists = pa.FixedSizeListArray.from_arrays(pa.array(weights.reshape(-1)), replicates).cast(pa.list_(pa.int64()))
        return pa.Table.from_arrays([*(table.column(c) for c in columns), lists], names=names)

    return keyed.groupBy("__many").applyInArrow(split_rows, schema)


def bootstrap_exact_mean(df: DataFrame, id_col: str, value: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, n_boot, mean): Σw and weighted mean of ``value`` over its non-null rows in every exact-n replicate, in
    one wide aggregate (no row per replicate)."""
    w = bootstrap_exact(df.where(F.col(value).isNotNull()), id_col, replicates, seed, "__w")
    row = w.agg(*[F.sum(F.col("__w")[r]).alias(f"n{r}") for r in range(replicates)], *[F.sum(F.col("__w")[r] * F.col(value)).alias(f"s{r}") for r in range(replicates)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(r + 1).alias("replicate"), F.col(f"n{r}").alias("n_boot"), (F.col(f"s{r}") / F.col(f"n{r}")).alias("mean")) for r in range(replicates)
    ])))


# ---------------------------------------------------------------- permutation


def dense_index(df: DataFrame, id_col: str, seed: int = 42, dst: str = "index") -> DataFrame:
    """Add ``dst``: 0 … n − 1 in the order of the md5 keys of the ids (of any type), without a window over all rows."""
    keyed = df.withColumn("__key", F.coalesce(hash_key(id_col, seed), F.lit("")))
    return _rank_strings(keyed, "__key").withColumn(dst, F.col("__rank") - 1).drop("__key", "__rank")


def _feistel(n: int, key: Column, rounds: int):
    """(places, one pass of the network as a function of a Column) for a permutation of 0 … n − 1 by ``key``."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = -(-max(n, 1) // a)

    def mixed(number: Column, half: Column, m: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", key, number.cast("string"), half.cast("string"))), 1, 8), 16, 10).cast("long") % m

    def half_round(acc, k):
        # even steps change the first half, odd ones the second
        even = k % 2 == 0
        x = F.when(even, (acc["x"] + mixed(k, acc["y"], a)) % a).otherwise(acc["x"])
        y = F.when(even, acc["y"]).otherwise((acc["y"] + mixed(k, acc["x"], b)) % b)
        return F.struct(x.alias("x"), y.alias("y"))

    def once(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("x"), (v % b).cast("long").alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, half_round, lambda s: s["x"] * b + s["y"])

    return a * b, once


def keyed_permutation(df: DataFrame, index: str, n: int, key: Column | str, dst: str, rounds: int = 4) -> DataFrame:
    """Add ``dst``: the place of ``index`` under a permutation of 0 … n − 1 chosen by ``key``. A Feistel network on
    a · b ≥ n places (a = ⌈√n⌉, b = ⌈n / a⌉) whose halves are added to modulo a and b; a result beyond n goes through it
    again. There are fewer than a such places and each is met once, so the walk always ends, and few rows walk."""
    places, once = _feistel(n, F.lit(key) if isinstance(key, str) else key, rounds)
    out = df.withColumn(dst, once(F.col(index).cast("long")))
    if places == n:
        return out
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(places - n)), F.col(dst), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return out.withColumn(dst, F.when(F.col(dst) < n, F.col(dst)).otherwise(walk))


@lru_cache(maxsize=256)
def _round_tables(key: str, a: int, b: int, rounds: int) -> list:
    """What the steps of the network add, by the half that they read (about √n numbers a step)."""
    import hashlib

    import numpy as np

    tables = []
    for k in range(2 * rounds):
        read, m = (b, a) if k % 2 == 0 else (a, b)
        raw = b"".join(hashlib.md5(f"{key}:{k}:{half}".encode()).digest()[:4] for half in range(read))
        tables.append(np.frombuffer(raw, ">u4").astype(np.int64) % m)
    return tables


def permuted_places(index, n: int, key: str, rounds: int = 4):
    """``keyed_permutation`` of a numpy array of places."""
    import numpy as np

    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = -(-max(n, 1) // a)
    tables = _round_tables(key, a, b, rounds)

    def once(v):
        x, y = v // b, v % b
        for k, added in enumerate(tables):
            if k % 2 == 0:
                x = (x + added[y]) % a
            else:
                y = (y + added[x]) % b
        return x * b + y

    out = once(np.asarray(index, np.int64))
    while (beyond := np.flatnonzero(out >= n)).size:
        out[beyond] = once(out[beyond])
    return out


#: Places of one group of permuted rows, and rows whose values a task sends at once.
PLACE_BLOCK = 20_000
SENT_ROWS = 200_000


def permuted(df: DataFrame, id_col: str, cols: Sequence[str], repeats: int = 1, seed: int = 42) -> DataFrame:
    """The rows of ``df`` once per column of ``cols`` and repeat, with that column permuted over all rows: columns
    ``feature`` and ``repeat`` (0-based) added. One dense index serves all; a row sends its value of every column to the
    place that the keyed permutation of (column, repeat) gives. Values travel packed, one list for each block of places, and
    a block's rows and lists meet in one task, where the lists are put in order: the shuffle holds a value and its place,
    not a row, for every permuted row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    cols = list(cols)
    indexed = saved(dense_index(df, id_col, seed, "__index"))
    n = indexed.count()
    block = PLACE_BLOCK
    kinds = {t: f"__v{k}" for k, t in enumerate(dict.fromkeys(df.schema[c].dataType for c in cols))}  # one column of values a type
    held = [kinds[df.schema[c].dataType] for c in cols]
    packed = T.StructType([
        T.StructField("__block", T.LongType()), T.StructField("__col", T.IntegerType()), T.StructField("__repeat", T.ArrayType(T.IntegerType())),
        T.StructField("__at", T.ArrayType(T.IntegerType())), *[T.StructField(v, T.ArrayType(t)) for t, v in kinds.items()],
    ])
    wire = to_arrow_schema(packed)

    def pack(rows: pa.Table):
        import numpy as np

        index, size = rows.column("__index").to_numpy(), rows.num_rows
        for k, c in enumerate(cols):
            places = np.concatenate([permuted_places(index, n, f"{seed}:{c}:{r}") for r in range(repeats)])
            order = np.argsort(places // block, kind="stable")
            blocks, counts = np.unique(places[order] // block, return_counts=True)
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            lists = {"__repeat": pa.array(order // size, pa.int32()), "__at": pa.array(places[order] % block, pa.int32()),
                     held[k]: rows.column(c).combine_chunks().take(pa.array(order % size))}
            out = {"__block": pa.array(blocks, pa.int64()), "__col": pa.array(np.full(len(blocks), k), pa.int32())}
            out |= {name: pa.ListArray.from_arrays(ends, v) for name, v in lists.items()}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if f.name in out else pa.nulls(len(blocks), f.type) for f in wire], schema=wire)

    def send(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= SENT_ROWS:
                yield from pack(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if size:
            yield from pack(pa.Table.from_batches(waiting))

    names, schema = list(df.columns), T.StructType([*df.schema, T.StructField("feature", T.StringType()), T.StructField("repeat", T.IntegerType())])

    def place(rows: pa.Table, lists: pa.Table) -> pa.Table:
        import numpy as np

        rows, size = rows.sort_by("__index").select(names), rows.num_rows
        parts, repeat = [], pa.array(np.repeat(np.arange(repeats, dtype=np.int32), size))
        for k, c in enumerate(cols):
            own = lists.filter(pa.array(lists.column("__col").to_numpy() == k))
            flat = {name: own.column(name).combine_chunks().flatten() for name in ("__repeat", "__at", held[k])}
            order = np.empty(size * repeats, np.int64)
            order[flat["__repeat"].to_numpy().astype(np.int64) * size + flat["__at"].to_numpy()] = np.arange(size * repeats)
            out = pa.concat_tables([rows] * repeats)
            out = out.set_column(names.index(c), c, flat[held[k]].take(pa.array(order)).cast(out.schema.field(c).type))
            parts.append(out.append_column("feature", pa.array([c]).take(pa.array(np.zeros(size * repeats, np.int64)))).append_column("repeat", repeat))
        return pa.concat_tables(parts)

    sent = indexed.select("__index", *cols).mapInArrow(send, packed)
    rows = indexed.withColumn("__block", F.floor(F.col("__index") / block).cast("long"))
    return rows.groupBy("__block").cogroup(sent.groupBy("__block")).applyInArrow(place, schema)


def permute_column(df: DataFrame, id_col: str, col: str, seed: int = 42, dst: str | None = None) -> DataFrame:
    """Shuffle one column across rows, keep the rest (``dst``: the permuted copy's name); ids of any type."""
    own = df if dst is None or dst == col else df.withColumn(dst, F.col(f"`{col}`"))
    return permuted(own, id_col, [dst or col], 1, seed).drop("feature", "repeat")


def _rank_strings(df: DataFrame, key: str) -> DataFrame:
    """Exact 1-based rank of unique string keys: bucket by the first characters, offsets from a
    small per-bucket count table, row_number inside each bucket."""
    b = F.substring(F.col(key), 1, _digits(df))
    keyed = df.withColumn("__kb", b)
    counts = keyed.groupBy("__kb").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offs = counts.select("__kb", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    wi = Window.partitionBy("__kb").orderBy(key)
    return keyed.join(offs, "__kb").withColumn(
        "__rank", F.col("__off") + F.row_number().over(wi)
    ).drop("__kb", "__off")
