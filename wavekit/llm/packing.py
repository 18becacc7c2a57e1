"""Packing token sequences: cutting-stock column generation over the histogram of piece lengths.

Documents longer than a sequence fill whole sequences; what is left of each, shorter than a sequence, is an item. The
plan is made on the driver from the histogram of item lengths alone (never more than ``capacity`` numbers, however
many documents there are) and says for every length which ranks go where:

1. A linear program over patterns (how many items of each length class fill one sequence) by column generation: the
   program's prices go into a knapsack, whose best pattern enters until no pattern is worth more than a sequence.
2. The pattern counts are rounded, down first, up where items are left. Patterns over length classes become patterns
   over exact lengths: the items of a class are ranked by length, so a pattern's lengths change at few of its copies.
3. What rounding leaves is filled sequence by sequence, each by an exact subset sum.
4. Sequences that would stay loose give their items to one stream cut at the sequence's end, whose last part is cut at
   powers of two, which need no padding.

Documents meet their places by (length, rank): ranks are counted inside the tasks that tokenise, and offsets by
(task, length) come from a small table, so that no document moves for its rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavekit.llm.coding import COMPACT, word_end_coder
from wavekit.session import scratch_path

CAPACITY = 2048
END_ID = 1
#: Width of the length classes of the linear program, in tokens.
UNIT = 8
#: A sequence that lacks more than this share of its tokens counts as loose.
LOOSE = 0.01
#: Rows of the table of ranks (task, length) up to which it is broadcast.
BROADCAST_ROWS = 200_000
_CHUNK_CHARS = 1 << 22


# -- the plan, on the driver ----------------------------------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """(value, counts) of the best multiset of items in ``room``, by dynamic programming over the room; ``sizes``
    ascend. An item that is worth no more than a smaller one is left out; 1, 2, 4 … copies of the others are tried."""
    best, last, copies = np.zeros(room + 1), np.full(room + 1, -1), np.zeros(room + 1, np.int64)
    for j in np.flatnonzero(values > np.maximum.accumulate(np.concatenate(([1e-12], values[:-1])))).tolist():
        n, worth = 1, values[j]
        while (step := n * int(sizes[j])) <= room:
            with_it = best[:-step] + n * worth
            better = np.flatnonzero(with_it > best[step:] + 1e-12)
            best[better + step], last[better + step], copies[better + step] = with_it[better], j, n
            n *= 2
    # an entry holds unless it fell behind a smaller room's; what it was built on has only grown since
    counts, c = np.zeros(len(sizes), np.int64), room
    c = int(np.argmax(best >= best.max() - 1e-12))
    while c > 0 and last[c] >= 0:
        counts[last[c]] += copies[c]
        c -= int(copies[c] * sizes[last[c]])
    return float(counts @ values), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses): a basic solution of min Σ uses with Σ uses · pattern ≥ demand over all patterns that fit into
    ``room``, to within ``gap`` of the bound that prices give. Revised simplex with an explicit inverse; the knapsack
    is asked at prices half way to those with the best bound so far, which spares most of the rounds."""
    m = len(sizes)
    # equal demands make ties between leaving columns: a distinct small share more of each breaks them
    need = demand * (1 + 1e-7 * np.arange(1, m + 1) / m)
    patterns = np.diag(room // sizes).astype(np.float64)  # one row a column of the program
    inverse = np.diag(1.0 / (room // sizes))
    cost = np.ones(m)
    uses = inverse @ need
    bound, centre = 0.0, np.zeros(m)
    for _ in range(rounds):
        price = cost @ inverse
        worst = int(price.argmin())
        if price[worst] < -1e-9:
            column, c = -np.eye(m)[worst], 0.0  # items beyond the demand cost nothing
        else:
            column, c = None, 1.0
            for asked in ((price + centre) / 2, price) if bound else (price,):
                value, counts = knapsack(sizes, asked, room)
                if (low := float(demand @ asked) / value) > bound:
                    bound, centre = low, asked
                if counts @ price > 1 + 1e-9:
                    column = counts.astype(np.float64)
                    break
            if column is None or cost @ uses <= bound * (1 + gap):
                break
        step = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(uses, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        theta = ratio[out]
        uses -= theta * step
        uses[out] = theta
        np.maximum(uses, 0, out=uses)
        patterns[out], cost[out] = column, c
        row = inverse[out] / step[out]
        step[out] = 0.0
        inverse -= np.outer(step, row)
        inverse[out] = row
    real = cost > 0
    return patterns[real].astype(np.int64), uses[real]


def _rounded(patterns: np.ndarray, uses: np.ndarray, demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, copies): uses rounded down, then up where enough items are left (the largest fractions first); copies
    that would need more items than there are do without them."""
    whole = np.floor(uses + 1e-6).astype(np.int64)
    left = demand - whole @ patterns
    for k in np.argsort(whole - uses, kind="stable"):
        if patterns[k].any() and (left >= patterns[k]).all():
            whole[k] += 1
            left = left - patterns[k]
    out = [(patterns[k].copy(), int(whole[k])) for k in np.flatnonzero(whole)]
    for b in np.flatnonzero(left < 0):
        lacking, k = int(-left[b]), 0
        while lacking:
            pattern, copies = out[k]
            if pattern[b]:
                # one item less in as many copies as it takes
                n = min(copies, lacking)
                lacking -= n
                without = pattern.copy()
                without[b] -= 1
                out[k] = (without, n)
                if n < copies:
                    out.append((pattern, copies - n))
                if without[b] and lacking:
                    continue
            k += 1
    return [(p, n) for p, n in out if p.any()]


def fill_sequence(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of one sequence, taken from ``counts``: the longest item and the subset of the others that fills the
    rest best, by bit sets of reachable sums (longer items first, until the room is full)."""
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    rest, full = room - first, 1 << (room - first)
    reach, steps = 1, []
    for n in lengths:
        have = min(counts[n] - (n == first), rest // n if n else 0)
        while have > 0 and not reach & full:
            steps.append((n, reach))
            reach |= (reach << n) & ((full << 1) - 1)
            have -= 1
        if reach & full:
            break
    c, out = reach.bit_length() - 1, [first]
    for n, before in reversed(steps):
        if not before >> c & 1:
            out.append(n)
            c -= n
    for n in out:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
    return out


@dataclass
class Plan:
    """Places of all items: rows (length, lo, hi, first): the items of ``length`` with ranks lo … hi − 1 go, one to a
    sequence, to sequences ``first`` … at ``offset``; where ``stream`` holds they follow each other from token
    ``first`` of the stream instead. ``stream_first`` is the stream's first sequence, ``tail`` the token numbers of
    the stream at which its last, padded part is cut; ``sequences`` counts all sequences of items."""

    rows: list[tuple[int, int, int, int, int, bool]]
    stream_first: int
    tail: list[int]
    stream_tokens: int
    sequences: int


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT, loose: float = LOOSE) -> Plan:
    """The plan for ``histogram`` (items by length, lengths 1 … capacity − 1)."""
    lengths = np.array(sorted(histogram), np.int64)
    have = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    bins = -(-lengths // unit)
    sizes, place = np.unique(bins, return_inverse=True)
    demand = np.zeros(len(sizes), np.int64)
    np.add.at(demand, place, have)
    sequences: list[tuple[list[tuple[int, int, int]], int]] = []  # (slots: length, first rank, bin-free), copies
    taken = np.zeros(len(lengths), np.int64)
    if len(sizes):
        patterns, uses = column_generation(sizes, demand.astype(np.float64), capacity // unit)
        # ranks of a class run over its lengths, ascending
        below = np.cumsum(have) - have
        start = np.array([below[np.flatnonzero(place == b)[0]] for b in range(len(sizes))], np.int64)
        at = start.copy()
        ends = np.cumsum(have)
        for pattern, x in _rounded(patterns, uses, demand):
            slots = []
            for b in np.flatnonzero(pattern):
                for _ in range(int(pattern[b])):
                    slots.append(int(at[b]))
                    at[b] += x
            cuts = {0, x}
            for s in slots:
                inside = ends[(ends > s) & (ends < s + x)] - s
                cuts.update(inside.tolist())
            for lo, hi in zip((c := sorted(cuts))[:-1], c[1:]):
                which = [int(np.searchsorted(ends, s + lo, side="right")) for s in slots]
                sequences.append(([(int(lengths[w]), int(s + lo - below[w]), 0) for w, s in zip(which, slots)], hi - lo))
        # what each class has given, longest ranks last
        for b in range(len(sizes)):
            for w in np.flatnonzero(place == b):
                taken[w] = min(max(at[b] - below[w], 0), have[w])
    counts = {int(n): int(h - t) for n, h, t in zip(lengths, have, taken) if h > t}
    rank = {int(n): int(t) for n, t in zip(lengths, taken)}
    while counts:
        slots = []
        for n in fill_sequence(counts, capacity):
            slots.append((n, rank[n], 0))
            rank[n] += 1
        sequences.append((slots, 1))

    rows: list[tuple[int, int, int, int, int, bool]] = []
    held: list[tuple[list[tuple[int, int, int]], int]] = []
    number = 0
    for slots, copies in sequences:
        size = sum(n for n, _, _ in slots)
        if size < capacity * (1 - loose) and size & (size - 1):
            held.append((slots, copies))
            continue
        offset = 0
        for n, lo, _ in slots:
            rows.append((n, lo, lo + copies, number, offset, False))
            offset += n
        number += copies
    stream_first, stream = number, 0
    for slots, copies in held:
        for n, lo, _ in slots:
            rows.append((n, lo, lo + copies, stream, 0, True))
            stream += n * copies
    rest = stream % capacity
    tail, t = [], stream - rest
    while rest:
        step = 1 << (rest.bit_length() - 1)
        tail.append(t)
        t, rest = t + step, rest - step
    return Plan(rows, stream_first, tail, stream, stream_first + stream // capacity + len(tail))


# -- tokens, places and pieces, on the cluster ------------------------------------------------------------------------


def tokenise(docs: DataFrame, tokenizer_json: str, text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every row of ``docs`` without its text, with ``tokens`` (how many), ``ids`` (little-endian unsigned 32-bit ids
    of the whole text, then ``end_id``), and its rank inside its task: ``task``, ``item`` (length of what whole
    sequences leave), ``nth`` (items of that length before it), ``blocks`` (whole sequences before it)."""
    with open(tokenizer_json, encoding="utf-8") as f:
        model = f.read()
    kept = [c for c in docs.columns if c not in (text_col, "tokens", "ids", "task", "item", "nth", "blocks")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(text_col))
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, task = word_end_coder(model), TaskContext.get().partitionId()
        met, blocks = np.zeros(capacity, np.int64), 0
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            part = (np.cumsum(size) - size) // _CHUNK_CHARS
            for lo, hi in zip(*(lambda c: (np.concatenate(([0], c)), np.concatenate((c, [len(texts)]))))(np.flatnonzero(np.diff(part)) + 1)):
                if lo == hi:
                    continue
                ids, n = code(texts[lo:hi])
                n = n + 1
                ends = np.cumsum(n)
                flat = np.full(int(ends[-1]), end_id, "<u4")
                is_text = np.ones(len(flat), bool)
                is_text[ends - 1] = False
                flat[is_text] = ids
                item = n % capacity
                # items of the same length before each one: inside the stretch, then in earlier ones
                order = np.argsort(item, kind="stable")
                run_start = np.flatnonzero(np.diff(item[order], prepend=-1))
                nth = np.empty(len(item), np.int64)
                nth[order] = np.arange(len(item)) - np.repeat(run_start, np.diff(run_start, append=len(item)))
                nth += met[item]
                met += np.bincount(item, minlength=capacity)
                whole = n // capacity
                before = blocks + np.cumsum(whole) - whole
                blocks += int(whole.sum())
                offsets = pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(k).slice(lo, hi - lo) for k in range(at)),
                        pa.array(n, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(flat)]),
                        pa.array(np.full(len(n), task, np.int64)),
                        pa.array(item, pa.int64()),
                        pa.array(nth),
                        pa.array(before),
                    ],
                    names=[*kept, "tokens", "ids", "task", "item", "nth", "blocks"],
                )

    long = T.LongType()
    schema = T.StructType([
        *(docs.schema[c] for c in kept), T.StructField("tokens", long), T.StructField("ids", T.BinaryType()), T.StructField("task", long),
        T.StructField("item", long), T.StructField("nth", long), T.StructField("blocks", long),
    ])
    return docs.mapInArrow(run, schema)


def _written(df: DataFrame) -> DataFrame:
    """A small table written to the shared folder, so that the planner knows its size before it joins it."""
    path = scratch_path(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hinted(table: DataFrame) -> DataFrame:
    """Broadcast up to ``BROADCAST_ROWS`` rows (a few megabytes), shuffled beyond."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("shuffle_hash")


def pack_sequences(
    docs: DataFrame, tokenizer_json: str, text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, unit: int = UNIT, loose: float = LOOSE
) -> DataFrame:
    """One row per piece of a document: the columns of ``docs`` but the text, and ``start`` (ids of its document before
    it), ``length``, ``ids`` (binary, little-endian unsigned 32 bits), ``doc_tokens``, ``sequence_id``, ``offset``
    (in the sequence). Sequences hold at most ``capacity`` ids without gaps; every id of every document is in one piece.

    Null and empty texts have one id, ``end_id``. Rows are told apart by their place, so repeated rows, null and repeated
    ids and ties need no rule; extra columns stay, one named like a result is replaced. Very long texts are tokenised
    whole, about a million characters at a time otherwise. An empty table gives no pieces. Tokens are written once to
    the shared folder, zstd-compressed; documents do not move to get their ranks. At most ``loose`` of a sequence is
    padding, but where lengths force more the items are cut instead.
    """
    spark = docs.sparkSession
    result = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    kept = [c for c in docs.columns if c not in (*result, text_col)]
    names = {c: f"__{k}" for k, c in enumerate(kept)}
    path = scratch_path(spark, "tokens")
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{text_col}`").alias("text"))
    tokenise(inner, tokenizer_json, "text", end_id, capacity).write.options(**COMPACT).parquet(path)
    coded = spark.read.parquet(path)

    # counts by (task, item length): bounded by tasks × capacity, whatever the rows
    counts = coded.groupBy("task", "item").agg(F.count("*").alias("n"))
    before = Window.partitionBy("item").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = _written(counts.select("task", "item", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0")))
    tasks = coded.groupBy("task").agg(F.sum(F.expr(f"tokens div {capacity}")).alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    tasks = _written(tasks.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("block0")))
    plan = make_plan({r["item"]: r["n"] for r in counts.groupBy("item").agg(F.sum("n").alias("n")).collect() if r["item"]}, capacity, unit, loose)

    row = "item long, lo long, hi long, first long, at long, stream boolean"
    by_length = spark.createDataFrame(plan.rows, row).groupBy("item").agg(F.collect_list(F.struct("lo", "hi", "first", "at", "stream")).alias("plan"))
    placed = (
        coded.join(_hinted(ranks), ["task", "item"])
        .join(_hinted(tasks), "task")
        .join(F.broadcast(by_length), "item", "left")  # at most a plan's rows: bounded by the lengths
        .withColumn("rank", F.col("rank0") + F.col("nth"))
        .withColumn("place", F.expr("filter(plan, p -> p.lo <= rank and rank < p.hi)[0]"))
        .withColumn("pos", F.expr("place.first + (rank - place.lo) * item"))  # in the stream
        .withColumn("head", F.expr(f"tokens - tokens % {capacity}"))
    )
    # cuts of the stream inside the item: the next whole sequence's end, and the ends of the tail
    tail = F.array(*(F.lit(t).cast("long") for t in plan.tail)) if plan.tail else F.expr("cast(array() as array<bigint>)")
    whole_end = plan.stream_tokens - plan.stream_tokens % capacity
    placed = (
        placed.withColumn("tail", tail)
        .withColumn("cuts", F.expr(f"filter(array_distinct(concat(array((pos div {capacity} + 1) * {capacity}), tail)), t -> t > pos and t < pos + item and (t <= {whole_end} or array_contains(tail, t)))"))
        .withColumn("edges", F.expr("concat(array(pos), array_sort(cuts), array(pos + item))"))
    )
    stream_piece = (
        "transform(sequence(0, size(edges) - 2), k -> named_struct('start', head + edges[k] - pos, 'length', edges[k + 1] - edges[k], 'sequence_id', "
        f"cast({plan.stream_first} + if(edges[k] < {whole_end}, edges[k] div {capacity}, {whole_end // capacity} + size(filter(tail, t -> t <= edges[k])) - 1) as bigint), "
        f"'offset', edges[k] - if(edges[k] < {whole_end}, edges[k] - edges[k] % {capacity}, array_max(filter(tail, t -> t <= edges[k])))))"
    )
    item_piece = "array(named_struct('start', head, 'length', item, 'sequence_id', place.first + rank - place.lo, 'offset', place.at))"
    blocks = (
        f"if(head > 0, transform(sequence(0L, head div {capacity} - 1), k -> named_struct('start', k * {capacity}, 'length', {capacity}L, "
        f"'sequence_id', {plan.sequences}L + block0 + blocks + k, 'offset', 0L)), cast(array() as array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>))"
    )
    return (
        placed.withColumn("pieces", F.expr(f"concat({blocks}, if(item = 0, cast(array() as array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>), if(place.stream, {stream_piece}, {item_piece})))"))
        .withColumn("piece", F.explode("pieces"))
        .select(
            *(F.col(n).alias(c) for c, n in names.items()),
            "piece.start", "piece.length",
            F.expr("substring(ids, cast(piece.start * 4 + 1 as int), cast(piece.length * 4 as int))").alias("ids"),
            F.col("tokens").alias("doc_tokens"), "piece.sequence_id", "piece.offset",
        )
    )
