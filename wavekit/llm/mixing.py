"""Mixing sources to target weights with cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavekit.llm.common import WORD, cut, partitions_for, whole_text

#: Source weights by code-point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BLOCK_ROWS = 4096
#: Rows of each source that the last flight leaves to the landing, besides its own two: 2¹⁶ choices are tried.
LANDING = 14
#: Largest rows of a block that are decided first.
LARGE = 32
_EPS = 1e-9


def _flight(prob: list[float], size: list[float], draws: list[float]) -> list[float]:
    """Flight phase: move three undecided probabilities at a time along the null space of the two balancing
    equations (sum of probabilities, sum of probability x size) until one of them is 0 or 1. Both sums stay as
    they are. At most two stay undecided."""
    p = list(prob)
    active: list[int] = []
    for k in range(len(p)):
        if _EPS < p[k] < 1 - _EPS:
            active.append(k)
        while len(active) == 3:
            i, j, m = active
            u = (size[j] - size[m], size[m] - size[i], size[i] - size[j])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[a]) / c if c > 0 else p[a] / -c for a, c in zip(active, u) if c)
            down = min(p[a] / c if c > 0 else (1 - p[a]) / -c for a, c in zip(active, u) if c)
            step = up if draws[m] * (up + down) < down else -down
            for a, c in zip(active, u):
                p[a] += step * c
            left = [a for a in active if _EPS < p[a] < 1 - _EPS]
            if len(left) == 3:  # rounding: the closest to an end is decided
                left.remove(min(left, key=lambda a: min(p[a], 1 - p[a])))
            for a in active:
                if a not in left:
                    p[a] = float(round(p[a]))
            active = left
    return p


def _flight_of_large(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Decide the largest rows while many others can make up for them: each moves to 0 or 1 along the null-space
    direction that spreads its words and its count over all undecided rows of the block (weights p(1 - p)). Three at
    a time, a large row would stay undecided to the end, as small ones reach 0 or 1 long before it."""
    p = p.copy()
    for i in np.argsort(-size, kind="stable")[:LARGE].tolist():
        draw = draws[i]
        for _ in range(100):
            open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
            others = open_[open_ != i]
            if not _EPS < p[i] < 1 - _EPS or len(others) < 4 * LANDING:
                break
            w, s = p[others] * (1 - p[others]), size[others]
            g = np.minimum(s, 4 * s.mean())  # no other row moves much faster than the rest
            a, b, c, d = w.sum(), (w * g).sum(), (w * s).sum(), (w * g * s).sum()
            if a * d - b * c > 1e-9 * a * d:
                # moves w(x + y g) with sum -1 and sum of words -size
                y = (c - a * size[i]) / (a * d - b * c)
                u = w * ((-1 - y * b) / a + y * g)
            else:  # all others of one size: the words are balanced
                u = -size[i] / c * w
            u, at = np.append(u, 1.0), np.append(others, i)
            up = np.min(np.where(u > 0, 1 - p[at], p[at]) / np.maximum(np.abs(u), 1e-300))
            down = np.min(np.where(u > 0, p[at], 1 - p[at]) / np.maximum(np.abs(u), 1e-300))
            p[at] += (up if draw * (up + down) < down else -down) * u
            p[at] = np.where(p[at] < _EPS, 0.0, np.where(p[at] > 1 - _EPS, 1.0, p[at]))
            draw = (draw * 1.6180339887 + 0.6180339887) % 1
    return p


def _land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing of the last few undecided rows (at most LANDING + 2): of all 0/1 choices the one that comes
    closest to the words they owe, then to the documents."""
    n = len(prob)
    pick = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    words = np.abs(pick @ size - prob @ size)
    rows = np.abs(pick.sum(1) - prob.sum())
    return pick[np.argmin(words + 0.02 * size.mean() * rows)].astype(float)


def source_targets(sizes: DataFrame) -> DataFrame:
    """A table of sources with their ``source_size`` → with ``weight`` and ``target``. Sources are ranked by code point (null
    last) in range partitions with counted offsets; the water level is found by rounds of one small aggregate."""
    ranged = cut(
        sizes.withColumn("z", F.col("source").isNull())
        .repartitionByRange(F.col("z"), F.col("source"))
        .withColumn("pid", F.spark_partition_id())
    )
    counts = {r.pid: r.n for r in ranged.groupBy("pid").agg(F.count("*").alias("n")).collect()}  # one row a partition
    offset, before = [], 0
    for pid in sorted(counts):
        offset += [F.lit(pid), F.lit(before)]
        before += counts[pid]
    if not counts:
        return sizes.withColumns({"weight": F.lit(1), "target": F.lit(0.0)})
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("z", "source")) - 1 + F.create_map(*offset)[F.col("pid")]
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    ranked = cut(ranged.select(*sizes.columns, weight.alias("weight")))
    cap = F.col("source_size") * float(MAX_REPEAT)
    total, w = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = total / w
    while True:  # the share of one unit of weight only rises; it stops when no further source reaches its cap
        over = cap < F.col("weight") * F.lit(level)
        capped, w = ranked.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        new = (total - (capped or 0.0)) / w if w else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level))))


#: Equal rows that one task numbers.
SAME_ROWS = 100_000


def _number_equal(rows: DataFrame) -> DataFrame:
    """(id, source, size, nth): every row, with rows equal in the three numbered from 1. Equal rows are counted; a count
    beyond ``SAME_ROWS`` becomes several pieces, which are dealt over tasks before they become rows again."""
    counts = rows.groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    once = counts.where("n = 1").select("id", "source", "size", F.lit(1).cast("long").alias("nth"))
    pieces = counts.where("n > 1").withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {SAME_ROWS})")))
    # a stated number of tasks: by their bytes the few pieces would be put into one
    dealt = pieces.repartition(partitions_for(rows.sparkSession, rows.count(), SAME_ROWS), F.xxhash64("id", "source", "size", "piece"))
    last = F.least(F.col("n"), (F.col("piece") + 1) * SAME_ROWS)
    many = dealt.select("id", "source", "size", F.explode(F.sequence(F.col("piece") * SAME_ROWS + 1, last)).alias("nth"))
    return once.unionByName(many)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with the keys of ``mix_sources``'s rows: ``__n_words`` and, for rows that agree in id, source and
    number of words, ``__nth`` from 1. Only needed where ids repeat. Rows of one key are spread over buckets by a number
    of their own: a bucket's rows are numbered together, and the buckets' counts say where it starts."""
    words = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    # written with their numbers, so that both uses below see the same rows in the same buckets
    rows = cut(docs.withColumn("__n_words", words).withColumn("__row", F.monotonically_increasing_id()))
    key = [id_col, source_col, "__n_words"]
    bucket = F.shiftright("__row", 33).alias("__task")
    sizes = rows.groupBy(*key, bucket).agg(F.count("*").alias("__n"))
    # one row a task that holds rows of the key
    before = Window.partitionBy(*key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key)], "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy(*key, F.shiftright("__row", 33)).orderBy("__row"))
    rows = rows.withColumn("__place", place)
    match = F.shiftright("__row", 33) == F.col("__task")
    for i, c in enumerate(key):
        match = match & F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(starts, match).withColumn("__nth", (F.col("__first") + F.col("__place")).cast("long"))
    return out.drop("__row", "__place", "__task", "__first", *[f"__k{i}" for i in range(len(key))])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: ``<id_col>, source, size, nth, source_size, target, copies,
    taken`` (``nth`` numbers rows that agree in id, source and size).

    Size is the number of words. Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words;
    a target stops at 3 times its source's size and the excess is reshared. A document of a source with ratio
    r = target / size is taken floor(r) times and once more with probability r - floor(r); these probabilities
    are decided by the cube method, balancing words and documents of every source.

    Flight runs in blocks of (source, hash of the row) of about 4,096 rows, the largest ones first; each block leaves at most two
    undecided rows, which meet in fewer blocks in the next round, until one block per source is left. Some rows
    wait for that one; it keeps back 14 rows of all sizes and lands them with its last two, so the words of a source
    come as close to the target as 16 documents allow. So a source with a third of all rows is spread over many blocks, and rounds are few
    (logarithm to base 2,000). Draws are hashes of the id: reruns agree.

    Null text has size 0; documents without words are taken 0 words. The null source is a source. Rows that
    repeat an id are documents of their own. Extra columns are ignored. An empty table gives an empty table.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
    )
    # Repeated rows are numbered so that each has a key of its own without depending on row order.
    base = cut(_number_equal(base))
    sizes = cut(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    targets = source_targets(sizes)
    targets = targets.withColumnRenamed("source", "s")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("nth").cast("string"), F.lit("mix")), 256)
    rows = (
        base.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("r", r)
        .withColumn("whole", F.least(F.floor(F.col("r") + _EPS), F.lit(MAX_REPEAT)).cast("int"))
        .withColumn("prob", F.greatest(F.col("r") - F.col("whole"), F.lit(0.0)))
        .withColumn("draw", F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") / float(1 << 48))
    )
    rows = cut(rows)
    decided = _decide(rows)
    return rows.join(
        decided.withColumnsRenamed({"id": "i", "source": "s", "nth": "k", "size": "z"}),
        F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("nth") == F.col("k")) & (F.col("size") == F.col("z")),
        "left",
    ).select(
        F.col("id").alias(id_col), "source", "size", "nth", "source_size", "target",
        (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"),
        ((F.col("whole") + F.coalesce("extra", F.lit(0))) * F.col("size")).cast("long").alias("taken"),
    )


def _decide(rows: DataFrame) -> DataFrame:
    """(id, source, nth, size, extra): the cube method over the rows with a fractional probability."""
    columns = ["id", "source", "nth", "size", "prob", "draw", "blocks"]
    undecided = rows.where((F.col("prob") > _EPS) & (F.col("size") > 0))
    undecided = undecided.withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK_ROWS).cast("long"))
    # some rows of each source wait for its last block, as what flights leave over are mostly large documents
    waits = F.pmod(F.xxhash64("id", "nth", F.lit("landing")), F.col("n_docs")) < 2 * LANDING
    held, open_ = undecided.where(waits).select(*columns), undecided.where(~waits).select(*columns)
    done, kind = [], open_.schema

    def flight(last: bool):
        def fly(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values(["draw", "id", "nth"], kind="stable")
            size, draws = block["size"].to_numpy(float), block["draw"].to_numpy(float)
            p = _flight_of_large(block["prob"].to_numpy(float), size, draws)
            flies = np.ones(len(block), bool)
            if last:  # undecided rows of all sizes, from the smallest to the largest, are left to the landing
                open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
                by_size = open_[np.argsort(size[open_], kind="stable")]
                flies[by_size[np.linspace(0, len(open_) - 1, min(LANDING, len(open_))).astype(int)]] = False
            p[flies] = _flight(p[flies].tolist(), size[flies].tolist(), draws[flies].tolist())
            if last:
                left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
                if len(left):
                    p[left] = _land(p[left], size[left])
            return block.drop(columns="block").assign(prob=p)

        return fly

    def decided(flown: DataFrame) -> DataFrame:
        return flown.select("id", "source", "nth", "size", F.round("prob").cast("int").alias("extra"))

    most = rows.agg(F.max("n_docs")).first()[0] or 1
    most = -(-most // BLOCK_ROWS)
    while most > 1:  # sources of several blocks; what these leave over meets in fewer
        salt = F.pmod(F.xxhash64("id", "nth", "blocks"), F.col("blocks"))
        several = open_.where("blocks > 1").withColumn("block", salt)
        flown = cut(several.groupBy("source", "block").applyInPandas(flight(False), kind))
        end = (F.col("prob") <= _EPS) | (F.col("prob") >= 1 - _EPS)
        done.append(decided(flown.where(end)))
        rest = flown.where(~end).withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK_ROWS).cast("long"))
        open_ = open_.where("blocks = 1").unionByName(rest)
        most = -(-most * 2 // BLOCK_ROWS)
    last = open_.unionByName(held).withColumn("block", F.lit(0).cast("long")).groupBy("source", "block")
    done.append(decided(cut(last.applyInPandas(flight(True), kind))))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
