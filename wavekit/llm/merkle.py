"""Merkle manifest of a data set: a hash tree per key and one above their roots, with a proof for every row.

Leaves are numbered by one distributed sort. A round climbs up to ``LEVELS`` levels at once inside blocks of
arity ** LEVELS consecutive nodes, so that no window holds more than one block: on every level the node of arity ** level
leaves stands on the row of its first leaf; lead columns at the fixed offsets of the later children supply the digests
that it hashes, lag and lead columns masked by slot and run length supply every child's siblings. Then the siblings go
down the same levels by the same lags. The first rows of the blocks are the nodes of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavekit.llm.common import cut, partitions_for

#: Levels of one round: a window partition has at most ARITY ** LEVELS rows.
LEVELS = 8
ARITY = 2
#: Rows of one task of the sort, digests and ids only.
ROWS_PER_TASK = 200_000


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in columns)), 256))


def _position(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Add ``pos``: the place of every one of the ``n`` rows in the order, nulls first. One range-partitioned sort, written
    once; the partitions' sizes (one number each) give where they start. Equal rows are spread by a last key of their
    own, so that they can be split."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    spread = rows.withColumn("__spread", F.monotonically_increasing_id())
    parts = partitions_for(rows.sparkSession, n, ROWS_PER_TASK)
    placed = cut(
        spread.repartitionByRange(parts, *keys, "__spread").sortWithinPartitions(*keys, "__spread")
        .drop("__spread").withColumn("__id", F.monotonically_increasing_id())
    )
    task, low = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sizes.select("__task", first.alias("__first")))  # one row a partition
    return placed.withColumn("__task", task).join(F.broadcast(starts), "__task").withColumn("pos", F.col("__first") + low).drop("__task", "__id", "__first")


def _hex(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


_NO_PATH = "cast(array() as array<struct<left:binary,right:binary>>)"


def _climb(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """``nodes`` (tree, idx, n, h: node ``idx`` of the ``n`` of a tree) with ``block``, ``top``, the digest of a block's node
    on the block's first row, and ``s0`` …, the siblings (left, right) of every level's node on its first row."""
    size = arity**levels
    block = Window.partitionBy("tree", "block").orderBy("idx")
    nodes = nodes.withColumn("block", F.expr(f"idx div {size}")).withColumn("top", F.col("h"))
    for k in range(levels):
        step = arity**k
        node, count = F.expr(f"idx div {step}"), F.expr(f"(n + {step - 1}) div {step}")  # this node, nodes of the level
        head = F.col("idx") % step == 0
        slot = node % arity
        run = F.least(F.lit(arity), count - (node - slot))  # children of this node's parent
        beside = {f"lag{j}": F.lag("top", j * step).over(block) for j in range(1, arity)}
        beside |= {f"lead{j}": F.lead("top", j * step).over(block) for j in range(1, arity)}
        nodes = nodes.withColumns(beside)
        none = F.lit(b"")
        left = F.concat(none, *(F.when(slot >= j, F.col(f"lag{j}")).otherwise(none) for j in range(arity - 1, 0, -1)))
        right = F.concat(none, *(F.when(slot + j < run, F.col(f"lead{j}")).otherwise(none) for j in range(1, arity)))
        climbs = head & (count > 1)
        nodes = nodes.withColumns({
            f"s{k}": F.when(climbs, F.struct(left.alias("left"), right.alias("right"))),
            "top": F.when(climbs, F.when(slot == 0, _hash(F.concat(_hex("top"), _hex(right))))).otherwise(F.when(head, F.col("top"))),
        }).drop(*beside)
    return nodes


def _descend(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """``path`` of every node up to its block's node, from the siblings that ``_climb`` left: a node's own siblings, then
    its parent's path, which stands as many nodes before it as its slot says."""
    block = Window.partitionBy("tree", "block").orderBy("idx")
    nodes = nodes.withColumn("path", F.expr(_NO_PATH))
    for k in reversed(range(levels)):
        step = arity**k
        slot = F.expr(f"idx div {step} % {arity}")
        nodes = nodes.withColumns({f"up{j}": F.lag("path", j * step).over(block) for j in range(1, arity)})
        above = F.col("path")
        for j in range(1, arity):
            above = F.when(slot == j, F.col(f"up{j}")).otherwise(above)
        own = F.when(F.col(f"s{k}").isNotNull(), F.array(f"s{k}")).otherwise(F.expr(_NO_PATH))
        path = F.when(F.col("idx") % step == 0, F.concat(own, above)).otherwise(F.col("path"))
        nodes = nodes.withColumn("path", path).drop(f"s{k}", *(f"up{j}" for j in range(1, arity)))
    return nodes


def tree_roots(leaves: DataFrame, most: int, levels: int = LEVELS, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """(tables of nodes by round, roots (tree, h)) of ``leaves`` (tree, idx, n, h, binary digests; other columns stay).
    ``most`` is the largest tree's number of leaves; ``tree`` must not be null. Only the blocks' nodes are written
    between rounds, one in arity ** levels."""
    size, rounds = arity**levels, [leaves]
    while True:
        tops = _climb(rounds[-1].select("tree", "idx", "n", "h"), levels, arity).where(f"idx % {size} = 0")
        tops = cut(tops.select("tree", F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("h")))
        if most <= size:
            return rounds, tops.select("tree", "h")
        most = -(-most // size)
        rounds.append(tops)


def tree_paths(rounds: list[DataFrame], roots: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """The leaves of ``tree_roots`` with ``path``, the siblings (left, right) up to the tree's root, and ``root``. Every
    round's own levels are worked out again on the way down, so that no table of leaves' paths is written."""
    above = roots.select("tree", F.lit(0).cast("long").alias("idx"), F.expr(_NO_PATH).alias("path"), F.col("h").alias("root"))
    for nodes in reversed(rounds):
        below = _descend(_climb(nodes, levels, arity), levels, arity).drop("top")
        up = above.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), F.col("path").alias("__path"), "root")
        below = below.join(up, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__idx")))
        below = below.withColumn("path", F.concat("path", "__path")).drop("__tree", "__idx", "__path", "block")
        above = below if nodes is rounds[0] else cut(below.select("tree", "idx", "path", "root"))
    return above


def manifest(
    docs: DataFrame, key_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None, tamper_where: Column | None = None, levels: int = LEVELS, arity: int = ARITY,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``key_col``, ``leaf``, ``subroot`` (of its key), ``root``, ``proof`` (siblings
    (left, right) by level via the subroot to the root, binary digests), ``folded_root`` and ``verified``.

    A leaf hashes ``columns`` in order; per key leaves ascend by ``id_col``, and runs of ``arity`` nodes become the hash of
    their digests (as lowercase hex) until one is left; the keys' roots, ordered by key, become the root likewise.
    ``folded_root`` folds the proof up from the leaf of the row with the columns ``tampered`` put in where
    ``tamper_where`` holds, else from the leaf itself; ``verified`` says whether that is the root.

    Null keys are a tree of their own and come first, null ids come first in their tree; rows that share an id are ordered
    by leaf, equal rows stay rows (each with a place and a proof of its own). Null and empty texts differ in the leaf; very
    long texts are hashed where they are read and not moved. Extra columns are left out unless listed. Empty tables give no
    rows. A key with a third of all rows is many blocks.
    """
    leaf = leaf_digest(*(F.col(f"`{c}`") for c in columns))
    other = F.lit(None).cast("binary")
    if tampered:
        other = F.when(tamper_where, leaf_digest(*(tampered.get(c, F.col(f"`{c}`")) for c in columns)))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{key_col}`").alias("key"), leaf.alias("h"), other.alias("other"))
    rows = _position(own, docs.count(), "key", "id", "h")
    trees = cut(rows.groupBy("key").agg(F.min("pos").alias("tree"), F.count("*").alias("n")))  # one row a key
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    rows = rows.alias("r").join(trees.alias("t"), F.col("r.key").eqNullSafe(F.col("t.key")))
    leaves = rows.select("r.id", "r.key", "r.other", "t.tree", (F.col("r.pos") - F.col("t.tree")).alias("idx"), "t.n", "r.h")
    rounds, roots = tree_roots(leaves, most, levels, arity)
    # the trees' roots, in the keys' order, are the leaves of the upper tree
    tops = _position(roots, n_trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("pos").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "h", F.col("tree").alias("sub"))
    above = tree_paths(*tree_roots(tops, n_trees, levels, arity), levels, arity)
    above = cut(above.select(F.col("sub").alias("__sub"), F.col("path").alias("__path"), F.col("root").alias("whole")))
    found = tree_paths(rounds, roots, levels, arity)
    out = found.join(above, F.col("tree") == F.col("__sub")).withColumn("proof", F.concat("path", "__path"))
    folded = F.aggregate("proof", F.coalesce("other", "h"), lambda acc, s: _hash(F.concat(_hex(s["left"]), _hex(acc), _hex(s["right"]))))
    out = out.withColumn("folded", folded)
    return out.select(
        F.col("id").alias(id_col), F.col("key").alias(key_col), _hex("h").alias("leaf"), _hex("root").alias("subroot"),
        _hex("whole").alias("root"), "proof", _hex("folded").alias("folded_root"), (F.col("folded") == F.col("whole")).alias("verified"),
    )
