"""Substring deduplication by recompression: 13-word windows that an earlier document has are removed.

A word sequence is compressed by rounds that name runs of equal symbols and pairs of neighbours. A name is a hash
of what it names, so a round's names agree over the whole corpus without a shuffle, and whether two symbols
are paired depends on the two symbols alone: the first's class (a hash bit, new in each round) is left, the second's
right. Each symbol knows the stretch of words its parse depends on. Any two equal stretches of words therefore
have the same symbols inside, wherever they stand.

Every window takes as its anchor the highest-level symbol that depends on words of the window only (the smallest
mixed name among several), so equal windows have equal anchors, and neighbouring windows mostly share one. Two
shuffles follow: anchors find out whether a second document has them; windows at shared anchors are compared by
their 64-bit hashes under the anchor's name, itself made of words of the window, to find the smallest id. No words are
compared. Names are content hashes made inside the tasks, so rounds need no shuffle, and two rounds of pairs are made:
symbols of higher rounds depend on more words than a window has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavekit.llm.common import whole_text

WINDOW = 13
#: Rounds of pairing after the runs: with more, the words a symbol depends on outgrow a 13-word window.
ROUNDS = 2
_CHUNK = 1 << 21
_PIECE = 1 << 18
_LAST = (1 << 63) - 1

_U = np.uint64
_M, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_RNG = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base modulo 2⁶⁴ and of its inverse, extended when longer ones are needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.append(_U(1), np.full(n - 1, x, _U))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of UTF-8 bytes; never 0. Words are runs of non-white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    start = np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, _U), start
    place = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.concatenate(([0], start, [len(data)]))))
    value = np.where(space, _U(0), _BYTE[data] * _POWERS.get(int(place.max()) + 1)[0][place])
    h = _mix(np.add.reduceat(value, start))
    return np.where(h == 0, _U(1), h), start


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of an Arrow string column without nulls."""
    c = column.cast(pa.large_binary())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    raw = c.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def _sequences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the documents of a batch: (symbols with a 0 before and behind every piece, its document for each
    symbol, place of the symbol in its document). Some documents at a time; a long one in pieces that overlap by a window less
    one word, so that every window is in one piece."""
    data, offsets = _texts(column)
    k = 0
    while k < len(column):
        end = k + 1
        while end < len(column) and offsets[end + 1] - offsets[k] <= _CHUNK:
            end += 1
        if end == k + 1 and offsets[end] - offsets[k] > 2 * _CHUNK:
            hashes = _long(data[offsets[k] : offsets[end]])
            for at in range(0, max(1, len(hashes) - WINDOW + 1), _PIECE):
                part = hashes[at : at + _PIECE + WINDOW - 1]
                yield np.concatenate([[_U(0)], part, [_U(0)]]), np.full(len(part) + 2, k), np.arange(at - 1, at + len(part) + 1)
        else:
            h, start = _some(data, offsets[k : end + 1])
            doc = np.searchsorted(offsets[k : end + 1], start + offsets[k], "right") - 1
            count = np.bincount(doc, minlength=end - k)
            symbols = np.zeros(len(h) + end - k + 1, _U)
            symbols[np.arange(len(h)) + doc + 1] = h
            owner = np.append(0, np.repeat(np.arange(end - k), count + 1))
            first = np.concatenate(([1], 1 + np.cumsum(count + 1)[:-1]))
            yield symbols, owner + k, np.arange(len(symbols)) - first[owner]
        k = end


def _some(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of several texts; a text's end ends its last word."""
    part = data[offsets[0] : offsets[-1]]
    inner = offsets[1:-1] - offsets[0]
    spaced = np.insert(part, inner, 32) if len(inner) else part
    h, start = _words(spaced)
    # back to places without the spaces put in
    return h, start - np.searchsorted(inner + np.arange(len(inner)), start, "left")


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one very long text, cut at white space every few MB."""
    found, at = [], 0
    while at < len(data):
        end = at + _CHUNK
        while end < len(data) and not (data[end] == 32 or 9 <= data[end] <= 13):
            end += 1
        found.append(_words(data[at:end])[0])
        at = end
    return np.concatenate(found)


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def parse(symbols: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """Levels of the parse: names and the stretch [lo, hi) of words each symbol depends on. Words come first, then
    runs, then rounds of pairs. A 0 stands before, between and behind documents and is never merged; a symbol that
    depends on one has it in its stretch."""
    n = len(symbols)
    place = np.arange(n)
    out: list[Level] = [(symbols, place, place + 1)]
    new = np.ones(n, bool)
    new[1:] = symbols[1:] != symbols[:-1]
    s = np.flatnonzero(new)
    e = np.append(s[1:], n)
    run = (e - s).astype(_U)
    name = np.where((run > 1) & (symbols[s] != 0), _mix(symbols[s] * _M + run), symbols[s])
    # that a run ends where it does depends on the words beside it
    lo, hi = np.maximum(s - 1, 0), np.minimum(e + 1, n)
    out.append((name, lo, hi))
    for r in range(rounds):
        if len(name) < 2:
            break
        left = (_mix(name + _U((r + 1) * int(_M) % (1 << 64))) & _U(1)).astype(bool)
        word = name != 0
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & word[:-1] & word[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        up, low, high = name.copy(), lo.copy(), hi.copy()
        p = np.flatnonzero(pair)
        up[p] = _mix(_mix(name[p]) * _M + name[p + 1])
        high[p] = hi[p + 1]
        alone = np.flatnonzero(left[:-1] & ~pair[:-1])  # a left one without partner depends on the next symbol
        high[alone] = hi[alone + 1]
        alone = np.flatnonzero(~left[1:] & ~second[1:]) + 1  # a right one on the symbol before
        low[alone] = lo[alone - 1]
        keep = ~second
        name, lo, hi = up[keep], low[keep], high[keep]
        out.append((name, lo, hi))
    return out


def anchors(symbols: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, key of each window's anchor). The key hashes the anchor's level and the words it depends on,
    all of them in the window."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    next_end = ends[np.searchsorted(ends, np.arange(n))] if len(ends) else np.full(n, n)
    starts = np.flatnonzero(next_end - np.arange(n) >= WINDOW)
    key = np.zeros(len(starts), _U)
    todo = np.arange(len(starts))
    for level, (name, lo, hi) in reversed(list(enumerate(parse(symbols, rounds)))):
        if not len(todo):
            break
        at = starts[todo]
        begins = np.concatenate(([0], np.cumsum(np.bincount(lo, minlength=n + 1))))  # symbols with lo < i
        done = np.cumsum(np.bincount(hi, minlength=n + 1))  # symbols with hi <= i
        a, b = begins[at], done[at + WINDOW]
        some = b > a
        a, b, where = a[some], b[some], todo[some]
        if len(a):
            rank = _mix(name)
            pick = a.copy()
            for k in range(1, int((b - a).max())):
                c = np.minimum(a + k, len(name) - 1)
                better = (a + k < b) & (rank[c] < rank[pick])
                pick[better] = c[better]
            node, back = np.unique(pick, return_inverse=True)
            key[where] = (_stretch(symbols, lo[node], hi[node]) + _U(level))[back]
        todo = todo[~some]
    return starts, key


def _stretch(symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lo), _U)
    for k in range(int((hi - lo).max()) if len(lo) else 0):
        on = lo + k < hi
        at = np.minimum(lo + k, len(symbols) - 1)
        out = np.where(on, _mix(out * _M + symbols[at]), out)
    return out


def _window_hashes(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    up, down = _POWERS.get(len(symbols) + 1)
    total = np.concatenate(([_U(0)], np.cumsum(symbols * up[: len(symbols)], dtype=_U)))
    return _mix((total[starts + WINDOW] - total[starts]) * down[starts])


def _long_column(c: pa.Array) -> np.ndarray:
    return np.asarray(c.cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)


def _smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal keys: (group of each row, smallest document and number of rows of each group)."""
    _, group = np.unique(keys, return_inverse=True)
    low = np.full(int(group.max()) + 1 if len(group) else 0, _LAST)
    np.minimum.at(low, group, docs)
    return group, low, np.bincount(group)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, own, doc, tkey, anchor) of the anchors of each document. Within a batch an anchor that several
    documents have is sent once (own = 0), and these documents are told directly (own = 1): a passage in a third of
    all rows costs one row a batch in its shuffle group."""
    for b in batches:
        if not b.num_rows:
            continue
        doc, tkey = _long_column(b.column(0)), _long_column(b.column(1))
        rows, keys = [], []
        for symbols, owner, _ in _sequences(b.column(2)):
            starts, key = anchors(symbols)
            pair = np.unique(np.stack([key, owner[starts].astype(_U)]), axis=1) if len(starts) else np.zeros((2, 0), _U)
            keys.append(pair[0])
            rows.append(pair[1].astype(np.int64))
        key, row = np.concatenate(keys), np.concatenate(rows)
        if not len(key):
            continue
        group, low, count = _smallest(key, doc[row])
        many = count[group] > 1
        first = ~many | (doc[row] == low[group])
        _, once = np.unique(group[first], return_index=True)
        sent = np.flatnonzero(first)[once]
        told = np.flatnonzero(many)
        spread = _mix(key[told] + _U(1) + row[told].astype(_U) * _M)
        take = np.concatenate([sent, told])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key[sent], spread]).view(np.int64)),
                pa.array(np.repeat(np.array([0, 1], np.int8), [len(sent), len(told)])),
                pa.array(doc[row[take]]), pa.array(tkey[row[take]]), pa.array(key[take].view(np.int64)),
            ],
            ["key", "own", "doc", "tkey", "anchor"],
        )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, tkey, start, n, hashes): runs of up to 13 windows at one shared anchor. Windows that a smaller id
    of the batch has are settled (hashes null, n windows from start); the others go to their anchor's group."""
    for b in batches:
        if not b.num_rows:
            continue
        doc, tkey = _long_column(b.column(0)), _long_column(b.column(1))
        shared = b.column(3)
        flat = _long_column(shared.flatten()).view(_U)
        count = np.diff(np.asarray(shared.offsets.to_numpy(), np.int64))
        known = np.sort(_mix(flat + _M * np.repeat(np.arange(len(doc)), count).astype(_U)))
        rows, places, keys, hashes = [], [], [], []
        for symbols, owner, place in _sequences(b.column(2)):
            starts, key = anchors(symbols)
            own = _mix(key + _M * owner[starts].astype(_U))
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            starts, key = starts[hit], key[hit]
            rows.append(owner[starts])
            places.append(place[starts])
            keys.append(key)
            hashes.append(_window_hashes(symbols, starts))
        row, place, key, h = (np.concatenate(x) for x in (rows, places, keys, hashes))
        if not len(row):
            continue
        both = _mix(key * _M + h)
        _, low, _ = group = _smallest(both, doc[row])
        later = doc[row] > low[group[0]]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (later[1:] != later[:-1]) | (~later[1:] & (key[1:] != key[:-1]))
        s = np.flatnonzero(new)
        n = np.diff(np.append(s, len(row)))
        s, n = _at_most(s, n, np.where(later[s], 1 << 30, 30))
        settled = later[s]
        spread = _mix(row[s].astype(_U) * _M + place[s].astype(_U) + _U(7))
        offsets = np.concatenate(([0], np.cumsum(np.where(settled, 0, n))))
        order = np.repeat(s - offsets[:-1], np.where(settled, 0, n)) + np.arange(offsets[-1])
        lists = pa.ListArray.from_arrays(
            pa.array(offsets.astype(np.int32)), pa.array(h[order].view(np.int64)), mask=pa.array(settled)
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(settled, spread, key[s]).view(np.int64)), pa.array(doc[row[s]]), pa.array(tkey[row[s]]),
                pa.array(place[s]), pa.array(n.astype(np.int64)), lists,
            ],
            ["key", "doc", "tkey", "start", "n", "hashes"],
        )


def _at_most(start: np.ndarray, size: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut into runs of at most so many."""
    parts = -(-size // most)
    of = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = nth * most[of]
    return start[of] + begin, np.minimum(size[of] - begin, most[of])


def _keep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n_words, n_removed, kept) from the text and its removed windows (start, n, mask)."""
    for b in batches:
        ids, texts, gone = b.column(0), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist()
        words, removed, kept = [], [], []
        for text, runs in zip(texts, gone):
            w = text.split()
            words.append(len(w))
            if runs:
                edge = np.zeros(len(w) + 1, np.int64)
                for r in runs:
                    if r["mask"] is None:  # n windows in a row
                        edge[r["start"]] += 1
                        edge[r["start"] + r["n"] + WINDOW - 1] -= 1
                    else:
                        for k in range(r["n"]):
                            if r["mask"] >> k & 1:
                                edge[r["start"] + k] += 1
                                edge[r["start"] + k + WINDOW] -= 1
                stay = np.cumsum(edge)[:-1] == 0
                w = [x for x, k in zip(w, stay.tolist()) if k]
            removed.append(words[-1] - len(w))
            kept.append(b" ".join(w).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["id", "n_words", "n_removed", "kept"],
        )


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a 13-word window which a document with a smaller id also has.

    Returns one row per input row: ``<id_col>, n_words, n_removed, kept`` (the kept words joined by one space).
    Words are runs of non-white space, unchanged; windows are judged on the input, not on what is left. Ids are
    integers; a null id counts as the largest one (two null ids, or a null id and 2⁶³ − 1, are not smaller than one another). Rows
    that repeat an id are told apart by their text; rows that repeat both get the same result. Null text counts as
    empty; texts under 13 words keep all of theirs. Extra columns are ignored; an empty table gives an empty table.

    Tasks hold an Arrow batch of texts; a very long text is parsed in overlapping pieces. Groups are never
    collected: an anchor's or window's group has one row for each batch of documents at most, as batches send the
    smallest id only and settle the rest at once.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    odd = ids.groupBy("i").agg(F.count("*").alias("n")).where("n > 1 or i is null")
    text = whole_text(text_col)
    number = F.col(id_col).cast("long")
    # where ids do not tell rows apart the text does; the last bit tells a null id from the largest number, whose place it
    # takes (no column of its own: the texts' exchange serves both joins below)
    unnamed = number.isNull().cast("long")
    tkey = F.lit(0).cast("long") if odd.isEmpty() else F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(unnamed)
    base = docs.select(F.coalesce(number, F.lit(_LAST)).alias("doc"), tkey.alias("tkey"), text.alias("text"))

    found = base.mapInArrow(_anchor_rows, "key long, own byte, doc long, tkey long, anchor long")
    near = Window.partitionBy("key", "own").orderBy("doc")
    shared = (
        found.withColumn("other", F.coalesce(F.lag("doc").over(near), F.lead("doc").over(near)))
        .where("own = 1 or other is not null")
        .groupBy("doc", "tkey")
        .agg(F.collect_set("anchor").alias("anchors"))
    )
    windows = base.join(shared, ["doc", "tkey"]).select("doc", "tkey", "text", "anchors")
    windows = windows.mapInArrow(_window_rows, "key long, doc long, tkey long, start long, n long, hashes array<long>")
    # one exchange by anchor; settled runs have a key of their own and pass
    each = windows.repartition("key").select("key", "doc", "tkey", "start", "n", F.posexplode_outer("hashes").alias("at", "h"))
    first = F.first("doc").over(Window.partitionBy("key", "h").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gone = (
        each.withColumn("first", first)
        .where("at is null or first < doc")
        .groupBy("key", "doc", "tkey", "start", "n")
        .agg(F.bit_or(F.expr("shiftleft(1, at)")).alias("mask"))
        .groupBy("doc", "tkey")
        .agg(F.collect_list(F.struct("start", "n", "mask")).alias("gone"))
    )
    has_id = (F.col("doc") != _LAST) | (F.col("tkey").bitwiseAND(F.lit(1)) == 0)
    out = base.join(gone, ["doc", "tkey"], "left").select(F.when(has_id, F.col("doc")).alias("doc"), "text", "gone")
    out = out.mapInArrow(_keep_rows, "id long, n_words long, n_removed long, kept string")
    own_id = F.col("id").cast(docs.schema[id_col].dataType)
    return out.select(own_id.alias(id_col), "n_words", "n_removed", "kept")
