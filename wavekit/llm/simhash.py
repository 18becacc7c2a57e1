"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavekit.llm.common import connected_components, cut, partitions_for, whole_text

SHINGLE_WORDS = 3
MAX_BITS = 3
_ONES = (1 << 64) - 1
#: The 64 bits in three blocks: of at most three differing bits, two of the blocks hold at most two.
_BLOCKS = ((0, 21), (21, 42), (42, 64))
_CHUNK = 1 << 16
#: Distinct fingerprints whose variants one task emits.
FINGERPRINTS_A_TASK = 1 << 15


def simhash64(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint: bit i is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < shingle_words:
        words, shingle_words = [b" ".join(words)], 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    s, e = starts[:n].tolist(), ends[shingle_words - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(s[k : k + _CHUNK], e[k : k + _CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, hash of the text, fp) for every row; whole texts, Arrow batches."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t, shingle_words) for t in texts], dtype="int64")

    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), fp(text).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(pairs: list[tuple[int, int, int]]) -> Column:
    """A literal array of (keep, flip, role)."""
    return F.array(*[
        F.struct(F.lit(_signed(k)).cast("long").alias("keep"), F.lit(_signed(x)).cast("long").alias("flip"), F.lit(r).alias("role"))
        for k, x, r in pairs
    ])


def _emit(df: DataFrame, masks: list[tuple[int, int, int]]) -> DataFrame:
    m = F.explode(_masks(masks)).alias("m")
    key = F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip"))
    return df.select("fp", m).select(key.alias("key"), F.col("m.role").alias("role"), "fp")


def _suspects(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints that share a radius-1 variant of two of the three blocks with another one: every
    fingerprint with a neighbour at three bits or fewer is among them (two blocks hold at most two of the bits,
    and two balls of radius 1 meet in the middle)."""
    masks = []
    for c, (lo, hi) in enumerate(_BLOCKS):
        hole = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        tag = (c + 1) << lo  # the block left out carries its own number
        masks += [(_ONES ^ hole, tag, 0)] + [(_ONES ^ hole, tag ^ (1 << b), 0) for b in range(64) if not lo <= b < hi]
    near = Window.partitionBy("key").orderBy("fp")
    return (
        _emit(fps, masks)
        .select("key", "fp", F.lag("fp").over(near).alias("p"), F.lead("fp").over(near).alias("n"))
        .where("p is not null or n is not null")
        .select("fp")
        .distinct()
    )


def _links(fps: DataFrame) -> DataFrame:
    """Links that join all fingerprints at three bits or fewer: every fingerprint emits all 64-bit variants at
    distance 0 and 1 (role 0), one of odd parity also those with two bits flipped in one half (role 1). Two at
    distance 1 or 2 meet among role 0. Two at distance 3 differ in parity and have two of the three bits in one
    half; the odd one flips these, the even one the third. Whoever meets a role-0 emitter at a variant is within
    1 + 2 bits of it, so each variant links all its emitters to its first role-0 emitter: no pairs are formed."""
    one = [(_ONES, 0, 0)] + [(_ONES, 1 << b, 0) for b in range(64)]
    two = [(_ONES, (1 << i) | (1 << j), 1) for lo in (0, 32) for i in range(lo, lo + 32) for j in range(i + 1, lo + 32)]
    emitted = _emit(fps, one).unionByName(_emit(fps.where(F.bit_count("fp") % 2 == 1), two))
    order = Window.partitionBy("key").orderBy("role", "fp")
    first = F.first(F.struct("role", "fp")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        emitted.withColumn("first", first)
        .where("first.role = 0 and first.fp <> fp")
        # the check of colliding pairs: the bit distance itself
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= MAX_BITS)
        .select("fp", F.col("first.fp").alias("to"))
        .distinct()
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components: ``<id_col>, fp, fingerprint, component_id, component, text_key`` for every
    input row (``component``: the component's smallest fingerprint; ``text_key``: XXH64 of the text).

    Words are runs of non-white space, A-Z lower-cased; shingles of three words with repeats, one shingle of all
    words for shorter texts. No words (null and empty text too): fingerprint 0, linked like any other.
    Fingerprints link at three or fewer differing bits; ``component_id`` is the smallest id reachable over links
    (null ids are passed over; a component of null ids only has component_id null). Rows of equal text or
    repeated rows share a fingerprint; each distinct fingerprint takes part once, however many rows have it, so a
    group of copies costs one row. Extra columns are ignored. An empty table gives an empty table.

    Ball hashing on all 64 bits needs some 560 variants per fingerprint on average, so fingerprints without any neighbour are
    sorted out first: the same meeting of radius-1 balls on two of three blocks (132 variants) finds those that
    can have a neighbour, exactly and without pairs.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    owner = cut(rows.groupBy("fp").agg(F.min("id").alias("owner")))
    # 132 variants each: many more rows than the table that they come from, so it is dealt out first
    parts = partitions_for(docs.sparkSession, owner.count(), FINGERPRINTS_A_TASK)
    near = cut(_suspects(owner.select("fp").repartition(parts, "fp")))
    parts = partitions_for(docs.sparkSession, near.count(), FINGERPRINTS_A_TASK // 4)
    near = near.repartition(parts, "fp")
    comps = connected_components(_links(near)).withColumnRenamed("node", "fp")
    label = owner.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = label.groupBy("component").agg(F.min("owner").alias("component_id"))
    # written out, so that the join below can split a fingerprint that a large share of the rows has
    by_fp = cut(label.join(smallest, "component").select("fp", "component", "component_id"))
    return rows.join(by_fp, "fp").select(
        F.col("id").alias(id_col),
        "fp",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "component",
        "text_key",
    )
