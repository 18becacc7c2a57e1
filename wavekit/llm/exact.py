"""Exact deduplication by deterministic block naming (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavekit.llm.common import cut, whole_text, without_spaces

BLOCK_CHARS = 2048


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names of distinct rows: sorted inside each hash partition, numbered by partition and place."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Groups of texts that are identical once white space is deleted; one row of each group stays.

    Returns one row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Method: the text without white space is cut into blocks of ``block_chars`` characters. The distinct blocks
    (pre-aggregated before the shuffle, so a block shared by a third of all rows travels once per map task) are
    sorted and numbered. Rows refer to a block by its 64-bit hash; blocks whose hashes collide are compared with
    each other and get names of their own, so names are free of collisions. Adjacent names are then paired and
    the distinct pairs sorted and numbered again until each document has one name, which with the number of
    rounds is its identity. A last odd name is paired with -1, so documents of different length never share one.

    Of equal texts the row with the most code points in the original text stays, then the smallest id (null
    last), then one of the repeated rows. Null text counts as empty; all empty texts form one group. Extra
    columns are ignored. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def pieces(norm: Column) -> Column:
        cuts = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
        return F.when(norm == "", F.array(F.lit(""))).otherwise(cuts)

    # array + transform: the normalised text is computed once and bound to a variable
    norm_once = F.array(without_spaces(F.col("text")))
    blocks = docs.select(F.explode(F.transform(norm_once, pieces)[0]).alias("block")).distinct()
    named = _named(blocks, ["block"]).withColumn("h", block_hash(F.col("block")))
    by_hash = cut(named.groupBy("h").agg(F.count("*").alias("n"), F.min("name").alias("name")))
    odd = _colliding(blocks.withColumn("h", block_hash(F.col("block"))), by_hash.where("n > 1").select("h"))

    def refer(b: Column) -> Column:
        own = F.lit(None).cast("long")
        for i, text in enumerate(odd):
            own = F.when(b == F.lit(text), F.lit(-2 - i).cast("long")).otherwise(own)
        return F.struct(block_hash(b).alias("h"), own.alias("own"))

    both = F.transform(norm_once, lambda t: F.struct(F.sha2(t, 256).alias("sha"), F.transform(pieces(t), refer).alias("refs")))[0]
    rows = cut(
        docs.select("id", F.length("text").alias("n_chars"), both.alias("x"))
        .select("id", "n_chars", F.col("x.sha").alias("sha"), F.col("x.refs").alias("refs"))
        .withColumn("rid", F.monotonically_increasing_id())
    )

    state = (
        rows.select("rid", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "ref"))
        .select("rid", "n", "pos", F.col("ref.h").alias("h"), F.col("ref.own").alias("own"))
        .join(by_hash.select("h", "name"), "h")
        .select("rid", "n", "pos", F.coalesce("own", "name").alias("name"))
    )
    state = cut(state)
    level, done = 0, []
    longest = state.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(state.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        level, longest = level + 1, -(-longest // 2)
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = (
            state.where("n > 1")
            .groupBy("rid", F.shiftright("pos", 1).alias("pos"))
            .agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"), F.max("n").alias("n"))
            .withColumn("n", F.expr("(n + 1) div 2"))
        )
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        state = cut(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"))

    ids = done[0]
    for d in done[1:]:
        ids = ids.unionByName(d)
    full = rows.select("rid", "id", "n_chars", "sha").join(ids, "rid")
    first = F.struct((-F.col("n_chars")).alias("c"), F.col("id").isNull().alias("z"), "id", "rid")
    # written out, so that the join below has an exchange of its own on both sides and can split a hot group
    groups = cut(full.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(first).alias("best")))
    return full.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _colliding(blocks: DataFrame, clash: DataFrame) -> list[str]:
    """All but the first of the distinct blocks that share a 64-bit hash: among n blocks n²/2⁶⁵ are expected
    (none in practice, a few dozen at 10¹¹ blocks), so they fit in the plan as literals."""
    if clash.isEmpty():
        return []
    out, last = [], None
    for r in blocks.join(clash, "h").orderBy("h", "block").toLocalIterator():
        if r.h == last:
            out.append(r.block)
        last = r.h
    return out
