"""Path-dependent tree Shapley values for Spark tree ensembles (random forest, gradient boosting,
single trees), computed in ``mapInPandas`` over Arrow batches.

The ensemble's node table (bounded by model size, not data) is read from the model's saved ``data``
parquet and decomposed into root-to-leaf paths. For one leaf with unique split features U, the
path-dependent expectation is the product game
    v(S) = value · Π_{k∈S} o_k · Π_{k∉S} z_k,
with z_k the product of cover ratios of the path's splits on k and o_k ∈ {0,1} whether the row follows all
of them. Its Shapley value for feature i is value·(o_i − z_i)·Σ_s c_s·s!(|U|−s−1)!/|U|!, where c_s are the
coefficients of Π_{k≠i}(z_k + o_k·t). Summed over leaves this equals the recursive tree algorithm of the
published tree-explainer paper, but every step is a numpy operation over all rows of a batch.
Efficiency holds exactly: Σ_i φ_i = f(x) − E f, E f = Σ_leaves value·Π z.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Leaf:
    value: float
    feats: list[int]  # unique split features on the path
    z: list[float]  # cover fraction per unique feature
    conds: list[list[tuple]]  # per unique feature: (split values, is_categorical, goes_left)


def _leaves_of_tree(nodes: dict, value_of, cover_of) -> list[Leaf]:
    out = []
    stack = [(0, [])]  # (node id, path steps)
    while stack:
        nid, path = stack.pop()
        nd = nodes[nid]
        if nd["leftChild"] < 0:
            feats, z, conds = [], [], []
            for f, ratio, cond in path:
                if f in feats:
                    j = feats.index(f)
                    z[j] *= ratio
                    conds[j].append(cond)
                else:
                    feats.append(f)
                    z.append(ratio)
                    conds.append([cond])
            out.append(Leaf(value_of(nd), feats, z, conds))
            continue
        sp = nd["split"]
        f = sp["featureIndex"]
        is_cat = sp["numCategories"] >= 0
        vals = list(sp["leftCategoriesOrThreshold"])
        split = vals if is_cat else vals[0]
        parent_cover = cover_of(nd)
        for child, left in ((nd["leftChild"], True), (nd["rightChild"], False)):
            ratio = cover_of(nodes[child]) / parent_cover if parent_cover > 0 else 0.0
            stack.append((child, path + [(f, ratio, (split, is_cat, left))]))
    return out


def ensemble_leaves(model, spark, scratch: str) -> tuple[list[Leaf], str]:
    """Save the model under the shared scratch folder, read its node table, return (leaves, output kind).

    Random forest: leaf value = class-1 share / number of trees (probability space).
    Gradient boosting: leaf value = tree weight · prediction (margin space; P = 1/(1+e^{−2·margin})).
    """
    model.write().overwrite().save(scratch)
    rows = spark.read.parquet(f"{scratch}/data").select("treeID", "nodeData").collect()  # model-sized
    trees: dict[int, dict] = {}
    for r in rows:
        nd = r["nodeData"].asDict(recursive=True)
        trees.setdefault(r["treeID"] if r["treeID"] is not None else 0, {})[nd["id"]] = nd
    name = type(model).__name__
    leaves: list[Leaf] = []
    if "GBT" in name:
        meta = spark.read.parquet(f"{scratch}/treesMetadata").collect()
        weights = {int(m[0]): float(m[2]) for m in meta}
        for t, nodes in trees.items():
            w = weights[t]
            leaves += _leaves_of_tree(nodes, lambda nd, w=w: w * nd["prediction"], lambda nd: nd["impurityStats"][0])
        return leaves, "margin"
    n_trees = len(trees)

    def share(nd):
        s = nd["impurityStats"]
        tot = sum(s)
        return (s[1] / tot if tot > 0 and len(s) > 1 else 0.0) / n_trees

    for nodes in trees.values():
        leaves += _leaves_of_tree(nodes, share, lambda nd: sum(nd["impurityStats"]))
    return leaves, "probability"


def expected_value(leaves: Sequence[Leaf]) -> float:
    return float(sum(lf.value * math.prod(lf.z) for lf in leaves))


def shap_batch(X, leaves: Sequence[Leaf], n_features: int):
    """φ (rows × features) for a numpy batch of feature rows."""
    import numpy as np

    n = X.shape[0]
    phi = np.zeros((n, n_features))
    weights_cache: dict[int, np.ndarray] = {}
    for lf in leaves:
        U = len(lf.feats)
        if U == 0:
            continue
        o = np.ones((n, U))
        for u, f in enumerate(lf.feats):
            col = X[:, f]
            for split, is_cat, left in lf.conds[u]:
                goes_left = np.isin(col, split) if is_cat else col <= split
                o[:, u] *= goes_left if left else ~goes_left
        if U not in weights_cache:
            weights_cache[U] = np.array([math.factorial(s) * math.factorial(U - s - 1) / math.factorial(U) for s in range(U)])
        w = weights_cache[U]
        for i in range(U):
            coefs = np.zeros((n, U))
            coefs[:, 0] = 1.0
            for k in range(U):
                if k == i:
                    continue
                nxt = coefs * lf.z[k]
                nxt[:, 1:] += coefs[:, :-1] * o[:, k : k + 1]
                coefs = nxt
            phi[:, lf.feats[i]] += lf.value * (o[:, i] - lf.z[i]) * (coefs @ w)
    return phi


def shap_tree(df: DataFrame, model, features_col: str, id_col: str, slots: Sequence[str], scratch: str) -> tuple[DataFrame, float, str]:
    """Long (id, feature, phi) attributions for every row of ``df`` plus the expected value and output kind.

    The leaf decomposition travels to the executors inside the task closure (model-sized); rows are
    processed per Arrow batch, never collected.
    """
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import vector_to_array

    leaves, kind = ensemble_leaves(model, df.sparkSession, scratch)
    base = expected_value(leaves)
    names = list(slots)
    p = len(names)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf["__x"].to_numpy()).astype(float)
            phi = shap_batch(X, leaves, p)
            ids = np.repeat(pdf[id_col].to_numpy(), p)
            yield pd.DataFrame({id_col: ids, "feature": np.tile(names, len(pdf)), "phi": phi.reshape(-1)})

    src = df.select(id_col, vector_to_array(features_col).alias("__x"))
    out = src.mapInPandas(run, f"{id_col} {id_type}, feature string, phi double")
    return out, base, kind


def explained_output(model, df: DataFrame, features_col: str, id_col: str, kind: str) -> DataFrame:
    """The quantity the attributions add up to: P(class 1) for forests, the raw margin for boosting."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.select(id_col, features_col))
    if kind == "probability":
        return out.select(id_col, vector_to_array("probability")[1].alias("f"))
    return out.select(id_col, (vector_to_array("rawPrediction")[1]).alias("f"))


# ---------------------------------------------------------------- pair interactions and partial dependence


def _follows(X, lf: Leaf):
    """rows × unique path features: whether the row takes every split of the path on that feature."""
    import numpy as np

    o = np.ones((X.shape[0], len(lf.feats)), bool)
    for u, f in enumerate(lf.feats):
        col = X[:, f]
        for split, is_cat, left in lf.conds[u]:
            goes_left = np.isin(col, split) if is_cat else col <= split
            o[:, u] &= goes_left if left else ~goes_left
    return o


def _pair_values(lf: Leaf, o, weights):
    """φᵢⱼ (patterns × pairs i < j of the leaf's features) for distinct patterns ``o`` of followed features: half the
    Shapley value of j in the leaf's product game with i held on, less that with i held off,
        φᵢⱼ = ½ · value · (oᵢ − zᵢ)(oⱼ − zⱼ) · Σ_s c_s · s!(U−s−2)!/(U−1)!,  c the coefficients of Π_{k≠i,j}(z_k + o_k·t).
    """
    import numpy as np

    U = len(lf.feats)
    out = np.empty((len(o), U * (U - 1) // 2))
    at = 0
    for i in range(U):
        for j in range(i + 1, U):
            coefs = np.zeros((len(o), U - 1))
            coefs[:, 0] = 1.0
            for k in range(U):
                if k not in (i, j):
                    nxt = coefs * lf.z[k]
                    nxt[:, 1:] += coefs[:, :-1] * o[:, k : k + 1]
                    coefs = nxt
            out[:, at] = 0.5 * lf.value * (o[:, i] - lf.z[i]) * (o[:, j] - lf.z[j]) * (coefs @ weights)
            at += 1
    return out


class PairGames:
    """The pair interactions of an ensemble: which feature pairs meet on a path (no others interact), and the values
    of every pair for a batch of rows, rows × met pairs. Rows that follow the same of a leaf's features share one
    evaluation, so a leaf costs its distinct patterns, not its rows."""

    def __init__(self, leaves: Sequence[Leaf]):
        from itertools import combinations

        self.leaves = [lf for lf in leaves if len(lf.feats) > 1]
        met = {tuple(sorted(p)) for lf in self.leaves for p in combinations(lf.feats, 2)}
        self.pairs = sorted(met)
        place = {p: k for k, p in enumerate(self.pairs)}
        self.columns = [[place[tuple(sorted(p))] for p in combinations(lf.feats, 2)] for lf in self.leaves]

    def batch(self, X):
        import numpy as np

        phi = np.zeros((X.shape[0], len(self.pairs)))
        for lf, columns in zip(self.leaves, self.columns):
            U = len(lf.feats)
            o = _follows(X, lf)
            _, first, which = np.unique(np.packbits(o, axis=1), axis=0, return_index=True, return_inverse=True)
            weights = np.array([math.factorial(s) * math.factorial(U - s - 2) / math.factorial(U - 1) for s in range(U - 1)])
            values = _pair_values(lf, o[first].astype(float), weights)
            phi[:, columns] += values[which.reshape(-1)]
        return phi


#: Cells of the rows × pairs table that one step of a task holds (64 MB).
PAIR_CELLS = 8_000_000


def tree_interactions(df: DataFrame, model, features_col: str, slots: Sequence[str], scratch: str, meta: dict[str, str] | None = None) -> DataFrame:
    """(b1, b2, value): mean |φᵢⱼ| over the rows, summed over the slot pairs of every unordered pair of base features
    (``meta``: slot → base; default: the slots), pairs within one base left out. Pairs that share no path have no
    row: their interaction is 0.

    A batch sends one row per met slot pair (model-sized partial sums of |φᵢⱼ|), never one per data row; the rows of a
    batch are worked on in steps of ``PAIR_CELLS``."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    leaves, _ = ensemble_leaves(model, df.sparkSession, scratch)
    games, base = PairGames(leaves), [(meta or {}).get(s, s) for s in slots]
    named = [tuple(sorted((base[i], base[j]))) for i, j in games.pairs]

    def run(batches):
        step = max(1, PAIR_CELLS // max(1, len(games.pairs)))
        for pdf in batches:
            total = np.zeros(len(games.pairs))
            for k in range(0, len(pdf), step):
                total += np.abs(games.batch(np.vstack(pdf["__x"].to_numpy()[k : k + step]).astype(float))).sum(0)
            if len(pdf):
                yield pd.DataFrame({"b1": [a for a, _ in named], "b2": [b for _, b in named], "s": total, "n": len(pdf)})

    sums = df.select(vector_to_array(features_col).alias("__x")).mapInPandas(run, "b1 string, b2 string, s double, n long")
    sizes = df.sparkSession.createDataFrame(
        [(a, b, named.count((a, b))) for a, b in sorted(set(named))], "b1 string, b2 string, slot_pairs long"
    )  # pairs of the model: every batch names each of them once per slot pair
    out = sums.where("b1 <> b2").groupBy("b1", "b2").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(sizes, ["b1", "b2"])
    return out.select("b1", "b2", (F.col("s") * F.col("slot_pairs") / F.col("n")).alias("value"))


def interaction_values(df: DataFrame, model, features_col: str, id_col: str, slots: Sequence[str], scratch: str) -> DataFrame:
    """Long (id, f1, f2, phi) of every row for the slot pairs that share a path, f1 before f2 in slot order. φᵢⱼ is half
    of the joint effect (the other half is φⱼᵢ); the diagonal φᵢᵢ = φᵢ − Σ_{j≠i} φᵢⱼ is what the feature does alone."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import vector_to_array

    leaves, _ = ensemble_leaves(model, df.sparkSession, scratch)
    games, names = PairGames(leaves), list(slots)
    id_type = df.schema[id_col].dataType.simpleString()
    first, second = ([names[p[k]] for p in games.pairs] for k in (0, 1))

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0 or not games.pairs:
                continue
            phi = games.batch(np.vstack(pdf["__x"].to_numpy()).astype(float))
            yield pd.DataFrame({id_col: np.repeat(pdf[id_col].to_numpy(), len(first)), "f1": np.tile(first, len(pdf)),
                                "f2": np.tile(second, len(pdf)), "phi": phi.reshape(-1)})

    return df.select(id_col, vector_to_array(features_col).alias("__x")).mapInPandas(run, f"{id_col} {id_type}, f1 string, f2 string, phi double")


def tree_pdp(df: DataFrame, model, features_col: str, groups: dict[str, Sequence[int]], scratch: str, grids: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """(feature, value, mean_prediction, n): partial dependence of every feature of ``groups`` (name → its slots) at every
    observed value of its slots, or at the values of ``grids`` for a feature of one slot. ``value`` is the array of the
    slots' values. The quantity is the model's additive output: P(class 1) of a forest, the margin of a boosting.

    One pass over the rows counts, for every leaf and feature, the rows that follow the leaf's splits on all *other*
    features (model-sized partial sums per batch). A leaf then gives value · count / n to the grid values that follow
    its splits on the feature: no row meets a grid value, and the rows are never scored again."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    spark = df.sparkSession
    leaves, _ = ensemble_leaves(model, spark, scratch)
    names = list(groups)
    owner = {s: k for k, name in enumerate(names) for s in groups[name]}
    arrays = df.select(vector_to_array(features_col).alias("__x"))

    def shares(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf["__x"].to_numpy()).astype(float)
            rows = []
            for k, lf in enumerate(leaves):
                o = _follows(X, lf)
                of = np.array([owner.get(f, -1) for f in lf.feats], int)
                rows.append((k, -1, int(o.all(1).sum())))
                rows += [(k, g, int(o[:, of != g].all(1).sum())) for g in sorted(set(of.tolist()) - {-1})]
            yield pd.DataFrame(rows, columns=["leaf", "g", "c"]).assign(n=len(pdf))

    sums = arrays.mapInPandas(shares, "leaf int, g int, c long, n long").groupBy("leaf", "g").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()  # leaves × path features
    count = {(r.leaf, r.g): r.c for r in sums}
    n = max((r.n for r in sums), default=0)

    grid = None
    for k, name in enumerate(names):
        if grids and name in grids:
            part = spark.createDataFrame([([float(v)],) for v in sorted(set(grids[name]))], "value array<double>")
        else:
            part = arrays.select(F.array(*(F.col("__x")[s] for s in groups[name])).alias("value")).distinct()
        part = part.select(F.lit(k).alias("g"), "value")
        grid = part if grid is None else grid.unionByName(part)

    def score(batches):
        for pdf in batches:
            for g, own in pdf.groupby("g"):
                V = np.vstack(own["value"].to_numpy()).astype(float)
                place = {s: j for j, s in enumerate(groups[names[g]])}
                out = np.zeros(len(V))
                for k, lf in enumerate(leaves):
                    mine = [u for u, f in enumerate(lf.feats) if f in place]
                    if not mine:
                        out += lf.value * count[k, -1] / n
                        continue
                    part = Leaf(lf.value, [place[lf.feats[u]] for u in mine], [lf.z[u] for u in mine], [lf.conds[u] for u in mine])
                    out += lf.value * count[k, g] / n * _follows(V, part).all(1)
                yield pd.DataFrame({"feature": names[g], "value": list(V), "mean_prediction": out, "n": n})

    return grid.mapInPandas(score, "feature string, value array<double>, mean_prediction double, n long")
