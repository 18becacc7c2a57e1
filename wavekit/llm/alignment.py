"""Aligning two tokenizers: links and common cuts of every text, and how often the corpus links two ids.

Texts are cut where neither tokenizer's tokens can cross: both end a token there, so the links and groups of a text are
those of its parts, one after the other. Every distinct part is encoded and aligned once, and kept.

All parts of a batch advance in lockstep: one numpy state vector holds the A and B pointer of every part (of every
stretch of a long one), each step compares the byte ends of the two tokens, moves the pointer that is behind, or,
where both end together, emits a link and a cut and moves both; finished parts are compacted away.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavekit.llm.coding import COMPACT, Coder, byte_level_bytes, byte_level_coder, common_cuts, gather, piece_bytes, piece_coder
from wavekit.session import scratch_path

#: Bytes of one stretch of a document: longer documents take several places of the state vector.
STRETCH = 4096
#: Characters of the texts that share one chunk: a chunk's links are counted before they are shuffled.
CHUNK_CHARS = 1_000_000
#: Parts that a worker keeps, and their bytes.
CACHE_PARTS, CACHE_BYTES = 250_000, 1 << 24


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, doc_ends: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) that end together, in text order, from the byte ends of all tokens of a batch (documents
    one after the other, both ascending) and the byte ends of the documents."""
    # the stretches: whole documents, or every ``stretch`` bytes of a long one
    sizes = np.diff(doc_ends, prepend=0)
    n = -(-sizes // stretch)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    stops = np.minimum(np.repeat(doc_ends - sizes, n) + (inside + 1) * stretch, np.repeat(doc_ends, n))
    # tokens that end inside a stretch: no link crosses it, as links are common ends
    a_stop, b_stop = np.searchsorted(ends_a, stops, side="right"), np.searchsorted(ends_b, stops, side="right")
    state = np.stack((np.concatenate(([0], a_stop))[:-1], np.concatenate(([0], b_stop))[:-1], a_stop, b_stop))
    found: list[np.ndarray] = []
    while True:
        live = (state[0] < state[2]) & (state[1] < state[3])
        if not live.all():
            state = state[:, live]
        if not state.shape[1]:
            break
        ea, eb = ends_a[state[0]], ends_b[state[1]]
        same = ea == eb
        if same.any():
            found.append(state[:2, same])
        state[0] += ea <= eb
        state[1] += eb <= ea
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found, axis=1)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


@dataclass
class Aligned:
    """One batch: numbers of ids and links by document (none for documents without tokens), the id pairs that it links
    (ascending, A id · ``width`` + B id) with how often, the place among them of every link, in text order, and the
    groups between common cuts, ``a1,a2|b1;a3|b2,b3`` by document."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    pair_n: np.ndarray
    link_pair: np.ndarray
    groups: list[memoryview]


class _Lists:
    """Many lists of values, one after the other."""

    def __init__(self, values: np.ndarray):
        self.values, self.size = values, np.zeros(0, np.int64)

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        self.values, self.size = np.concatenate((self.values, values)), np.concatenate((self.size, size))

    def ends(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.size)))

    def take(self, which: np.ndarray) -> np.ndarray:
        return gather(self.values, self.ends()[which], self.size[which])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values between every two ends."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[ends])


class Aligner:
    """Two coders with the bytes of their ids; B's coder puts a space before a text, here A's texts get one too. What the
    distinct parts of the texts met so far give is kept, up to a bounded number and size."""

    def __init__(self, a: Coder, b: Coder, bytes_a: Sequence[bytes], bytes_b: Sequence[bytes]):
        self.a, self.b = a, b
        self.tables = [_Bytes(bytes_a), _Bytes(bytes_b)]
        self.decimals, self.width = _Decimals(max(len(bytes_a), len(bytes_b))), len(bytes_b)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.kept_bytes = 0
        #: by part: tokens of A and B, whether both spell it, id pairs of its links, its groups with a mark behind each
        self.n_a, self.n_b, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pairs, self.groups = _Lists(np.zeros(0, np.int64)), _Lists(np.zeros(0, np.uint8))

    def _meet(self, parts: list[bytes]) -> None:
        """Encode and align new parts. A part that either tokenizer does not spell has no tokens."""
        ids_a, n_a, ids_b, n_b = *self.a.once(texts := [p.decode() for p in parts]), *self.b.once(texts)
        want = np.fromiter(map(len, parts), np.int64, len(parts))
        good = np.ones(len(parts), bool)
        whole = b"".join(parts)
        for table, ids, n in ((self.tables[0], ids_a, n_a), (self.tables[1], ids_b, n_b)):
            if not (np.array_equal(table.sizes(ids, n), want) and table.join(ids) == whole):
                for k, part in enumerate(np.split(ids, np.cumsum(n)[:-1])):
                    good[k] &= table.join(part) == parts[k]
        if not good.all():
            ids_a, n_a = ids_a[np.repeat(good, n_a)], np.where(good, n_a, 0)
            ids_b, n_b = ids_b[np.repeat(good, n_b)], np.where(good, n_b, 0)
        ends_a, ends_b = np.cumsum(self.tables[0].length[ids_a]), np.cumsum(self.tables[1].length[ids_b])
        link_a, link_b = lockstep(ends_a, ends_b, np.cumsum(np.where(good, want, 0)))
        self.known.update(zip(parts, range(len(self.good), len(self.good) + len(parts))))
        self.kept_bytes += len(whole)
        self.n_a, self.n_b, self.good = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.good, good)))
        n_links = np.diff(np.searchsorted(link_a, np.cumsum(n_a)), prepend=0)
        self.pairs.add(ids_a[link_a].astype(np.int64) * self.width + ids_b[link_b], n_links)
        flat, size = group_texts(ids_a, ids_b, link_a, link_b, self.decimals)
        self.groups.add(flat, _sums(size, np.concatenate(([0], np.cumsum(n_a + n_b)))))

    def _numbers(self, raw: pa.Buffer, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of every part among the distinct ones, their numbers among the parts that are kept)."""
        ends = pa.py_buffer(np.append(starts, raw.size))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, ends, raw]).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        if len(self.known) >= CACHE_PARTS or self.kept_bytes >= CACHE_BYTES:
            self._empty()
        number = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.good) + np.arange(len(new))
            self._meet([parts[k] for k in new.tolist()])
        return coded.indices.to_numpy(), number

    def __call__(self, texts: Sequence[str]) -> Aligned:
        meant = [(" " + t).encode() if t else b"" for t in texts]
        size = np.fromiter(map(len, meant), np.int64, len(meant))
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = pa.py_buffer(b"".join(meant))
        cut = np.zeros(raw.size, bool)
        cut[common_cuts(np.frombuffer(raw, np.uint8))], cut[ends[:-1][size > 0]] = True, True
        starts = np.flatnonzero(cut)
        place, number = self._numbers(raw, starts)
        n = np.diff(np.searchsorted(starts, ends))
        if not self.good[number].all():
            # a text with a part that is not spelled has no tokens
            inside = np.repeat(np.arange(len(n)), n)
            spelled = np.bincount(inside[~self.good[number][place]], minlength=len(n)) == 0
            place, n = place[spelled[inside]], np.where(spelled, n, 0)
            used, place = np.unique(place, return_inverse=True)
            number = number[used]
        rows = np.concatenate(([0], np.cumsum(n)))
        n_links = self.pairs.size[number]
        pairs, at = np.unique(self.pairs.take(number), return_inverse=True)
        times = np.repeat(np.bincount(place, minlength=len(number)), n_links)
        pair_n = np.bincount(at, times, len(pairs)).astype(np.int64)
        link_pair = gather(at, (np.cumsum(n_links) - n_links)[place], n_links[place])
        spelled = pa.py_buffer(self.groups.values)
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.good), [None, pa.py_buffer(self.groups.ends()), spelled])
        spelled = spelled.take(pa.array(number[place])).buffers()
        cut = (np.frombuffer(spelled[1], np.int64) if len(place) else np.zeros(1, np.int64))[rows].tolist()
        groups = memoryview(spelled[2] or b"")
        sums = (_sums(x[number][place], rows) for x in (self.n_a, self.n_b, self.pairs.size))
        return Aligned(*sums, pairs, pair_n, link_pair, [groups[lo : max(lo, hi - 1)] for lo, hi in zip(cut[:-1], cut[1:])])


class _Bytes:
    def __init__(self, table: Sequence[bytes]):
        self.length = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(table), np.uint8)

    def sizes(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.concatenate(([0], np.cumsum(self.length[ids])))
        return np.diff(ends[np.concatenate(([0], np.cumsum(n)))])

    def join(self, ids: np.ndarray) -> bytes:
        return gather(self.raw, self.start[ids], self.length[ids]).tobytes()


class _Decimals:
    """Decimal spellings of ids, each followed by a separator."""

    def __init__(self, most: int):
        text = np.char.mod("%d", np.arange(most)).astype("S")
        width = text.dtype.itemsize
        digits = text.view(np.uint8).reshape(most, width)
        self.table = np.zeros((most, width + 1), np.uint8)
        self.table[:, 0:width] = digits
        self.length = (digits > 0).sum(1)

    def spell(self, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, sizes): every id with its mark behind it."""
        out = self.table[ids]
        n = self.length[ids]
        out[np.arange(len(ids)), n] = marks
        return out[out > 0], n + 1


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, link_a: np.ndarray, link_b: np.ndarray, decimals: _Decimals) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``, the groups between common cuts: (bytes, bytes of every id and its mark)."""
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[link_a], last_b[link_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # in the output an A token stands behind the B tokens of earlier groups, a B token behind the A tokens up to its own
    place_a = np.arange(len(ids_a)) + np.concatenate(([0], link_b + 1))[group_a]
    place_b = np.arange(len(ids_b)) + np.concatenate((link_a + 1, [0]))[group_b]
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    marks = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    marks[place_a[last_a]], marks[place_b[last_b]] = ord("|"), ord(";")
    return decimals.spell(ids, marks)


@functools.lru_cache(maxsize=1)
def _aligner(text_a: str, raw_b: bytes) -> Aligner:
    """A worker's aligner: its tasks read the vocabularies once, and share the parts that are kept."""
    return Aligner(byte_level_coder(text_a), piece_coder(raw_b), byte_level_bytes(text_a), piece_bytes(raw_b))


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        total += n
        if total >= most:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def align_tokenizers(
    docs: DataFrame, json_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """One row per document: ``id_col``, tokens ``n_a`` (byte-level BPE of a space and the text) and ``n_b`` (pieces),
    ``n_groups`` between common cuts, ``n_links``, ``n_best`` (links that are their B id's most frequent in the
    corpus, ties included), ``count_sum`` (corpus-wide counts of the links' id pairs), ``groups_sha256``, and with
    ``groups`` the groups themselves (``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and texts that either tokenizer does not spell (a literal U+2581), have no tokens: zeros and
    empty strings. Repeated rows, null ids and ties stay rows of their own; other columns are left out, whatever their
    names; very long texts are whole, in several stretches of the lockstep; an empty table gives no rows.

    Tokens are made once, those of a part that occurs often once a worker. Every chunk of documents counts its id pairs before anything is shuffled; the pairs' totals
    come back to the chunk, where its documents add them up. A common pair is one row a chunk, never one a link.
    """
    spark = docs.sparkSession
    with open(json_a, encoding="utf-8") as f:
        text_a = f.read()
    with open(model_b, "rb") as f:
        raw_b = f.read()
    width = len(piece_bytes(raw_b))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    long = T.LongType()
    fields = [T.StructField("id", source.schema["id"].dataType), *(T.StructField(c, long) for c in ("n_a", "n_b", "n_groups")), T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField("groups", T.StringType())] * groups
    local = [T.StructField("chunk", long), T.StructField("links", T.ArrayType(T.IntegerType())), T.StructField("pairs", T.ArrayType(long)), T.StructField("pair_n", T.ArrayType(long))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align = _aligner(text_a, raw_b)
        chunk = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _chunks(np.fromiter(map(len, texts), np.int64, len(texts)), chunk_chars):
                x = align(texts[lo:hi])
                rows, first = hi - lo, np.arange(hi - lo) > 0
                column = lambda v: pa.array(v, pa.int64())
                lists = lambda ends, values, mask=None: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=mask), values)
                ends = np.concatenate(([0], np.full(rows, len(x.pairs))))
                none = np.concatenate((first, [False]))  # the chunk's pairs stand on its first row
                cols = [
                    b.column(0).slice(lo, rows), column(x.n_a), column(x.n_b), column(x.n_links),
                    pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in x.groups], pa.string()),
                    *([pa.array([str(g, "utf-8") for g in x.groups], pa.string())] * groups),
                    column(np.full(rows, chunk)), lists(np.concatenate(([0], np.cumsum(x.n_links))), pa.array(x.link_pair.astype(np.int32))),
                    lists(ends, column(x.pairs), none), lists(ends, column(x.pair_n), none),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields + local])
                chunk += 1

    path = scratch_path(spark, "alignment")
    source.mapInArrow(run, T.StructType(fields + local)).write.options(**COMPACT).parquet(path)
    coded = spark.read.parquet(path)

    counted = coded.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "pair_n")).alias("pos", "x"))
    counted = counted.select("chunk", "pos", F.col("x.pairs").alias("pair"), F.col("x.pair_n").alias("n"))
    totals_path = scratch_path(spark, "links")
    counted.groupBy("pair").agg(F.sum("n").alias("total")).write.parquet(totals_path)
    totals = spark.read.parquet(totals_path)
    most = totals.groupBy((F.col("pair") % width).alias("b")).agg(F.max("total").alias("most"))  # one row an id of B
    totals = totals.join(F.broadcast(most), F.col("pair") % width == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = counted.select("chunk", "pos", "pair").join(totals, "pair").select("chunk", "pos", "total", "best")

    kept = [f.name for f in fields]
    result = T.StructType([*fields, T.StructField("n_best", long), T.StructField("count_sum", long)])

    def add_up(of: pa.Table, pairs: pa.Table) -> pa.Table:
        _aligner.cache_clear()  # this worker has no more texts to align
        pos = pairs.column("pos").to_numpy()
        total, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        total[pos], best[pos] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
        links = of.column("links").combine_chunks()
        at = links.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))))
        sums = [np.diff(np.concatenate(([0], np.cumsum(v[at])))[ends]) for v in (best, total)]
        return pa.Table.from_arrays([*(of.column(c) for c in kept), *(pa.array(s, pa.int64()) for s in sums)], names=result.names)

    coded = spark.read.parquet(path).select(*kept, "chunk", "links")  # read anew: one side's columns only
    out = coded.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(add_up, result)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *kept[4:], "n_best", "count_sum")
