"""SentencePiece-style encoding and decoding by batched numpy Viterbi over a piece table."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal SPACE character of the text (a lone surrogate, which no text column holds).
_LITERAL = "\udfff"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(44)
_COUNT = 1 << 28
_CHUNK_CHARS = 1 << 20
_CACHE_WORDS = 300_000
_MATRIX = 1 << 20
_NONE = -np.inf


def _codes(words: Sequence[str]) -> np.ndarray:
    """Code points of equal-length words, one row each, plus one so that no symbol counts as zero."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j]
    return out


class MergeOrder:
    """Which two pieces may stand side by side in the encoding of a merge-trained vocabulary.

    Such a vocabulary merges, again and again, the adjacent pair whose concatenation was learnt first (ties: the left
    one). A sequence of pieces is the result exactly if every adjacent pair in it is the result for its own text, and for
    every prefix of a text exactly one last piece goes with the result for what is before it. So the order of merges
    becomes a rule on neighbours, and the search for the best segmentation a search for the one that keeps to it."""

    def __init__(self, pieces: dict[str, int], scores: Sequence[float]):
        merged = sorted((p for p in pieces if len(p) > 1), key=lambda p: (-scores[pieces[p]], pieces[p]))
        symbols = sorted({c for p in pieces for c in p})
        rank = {p: k for k, p in enumerate(merged)}
        number = {p: k for k, p in enumerate([*symbols, *merged])}
        n = self.n = len(number)
        self.left, self.right = np.arange(n), np.arange(n)
        self.reached = np.ones(n, bool)
        pairs: dict[int, int] = {}
        for p in merged:
            for cut in range(1, len(p)):
                if p[:cut] in number and p[cut:] in number:
                    pairs[number[p[:cut]] * n + number[p[cut:]]] = number[p]
            parts = _merge(list(p), rank, stop=2)
            if len(parts) == 2 and "".join(parts) == p:
                self.left[number[p]], self.right[number[p]] = number[parts[0]], number[parts[1]]
            else:
                self.reached[number[p]] = False
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.rank, self.number = rank, number
        self._empty()

    def _empty(self) -> None:
        self._seen, self._answer = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._empty()

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a; answers are kept by pair."""
        code = a * self.n + b
        slot = (code.astype(np.uint64) * _BASE >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self._seen[slot] != code)
        out = self._answer[slot]
        if len(new):
            out[new] = self._beside(a[new], b[new])
            self._seen[slot[new]], self._answer[slot[new]] = code[new], out[new]
        return out

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges inside both pieces, the last one first: the pair is not the result if, at any time, the two
        symbols at the border would have merged before the merge that is undone next."""
        out, rows = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), self.n + 1)
        while len(rows):
            at = np.minimum(np.searchsorted(self.keys, a * self.n + b), len(self.keys) - 1)
            stops = (self.keys[at] == a * self.n + b) & (self.made[at] < limit)
            out[rows[stops]] = False
            inner_a, inner_b = self.right[a], self.left[b]
            can_a, can_b = inner_a != a, inner_b != b
            take_a = can_a & ((a > b) | ~can_b)
            limit = np.where(take_a, a, b + 1)
            go = ~stops & (can_a | can_b)
            a, b = np.where(take_a, inner_a, a)[go], np.where(take_a, b, inner_b)[go]
            limit, rows = limit[go], rows[go]
        return out


def _merge(symbols: list[str], rank: dict[str, int], stop: int = 1) -> list[str]:
    """The merges one by one, until no pair is known or ``stop`` symbols are left."""
    while len(symbols) > stop:
        best = min(range(len(symbols) - 1), key=lambda k: (rank.get(symbols[k] + symbols[k + 1], len(rank)), k))
        if symbols[best] + symbols[best + 1] not in rank:
            break
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols


class PieceTable:
    """Pieces and scores of a vocabulary, as sorted substring hashes by length. Small (the vocabulary): it travels
    to the workers with the function that uses it."""

    def __init__(
        self, pieces: Sequence[str], scores: Sequence[float], byte_ids: Sequence[int] | None, unk_id: int | None, skip: set[int], merges: bool = False
    ):
        # runs of spaces share one score, the lowest: they merge last and from the left
        self.runs = {len(p): i for i, p in enumerate(pieces) if merges and i not in skip and p and not p.strip(SPACE)}
        skip = skip | {i for k, i in self.runs.items() if k > 1}
        own = {p: i for i, p in enumerate(pieces) if i not in skip and p}
        self.order = MergeOrder(own, scores) if merges else None
        #: by id: the piece's number in the order of merges
        self.number = np.array([self.order.number.get(p, -1) if merges and i not in skip else -1 for i, p in enumerate(pieces)], np.int64)
        self.byte_ids = None if byte_ids is None else np.asarray(byte_ids, np.int32)
        self.unk_id = unk_id
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if i not in skip and p:
                by_length.setdefault(len(p), []).append(i)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, ids in by_length.items():
            key = _prefix_hashes(_codes([pieces[i] for i in ids]))[:, -1]
            order = np.argsort(key, kind="stable")
            if (np.diff(np.sort(key)) == 0).any():
                raise ValueError("two pieces have one hash or one text")
            self.keys[n] = key[order], np.asarray(ids, np.int32)[order], np.asarray([scores[i] for i in ids], np.float64)[order]
        self.longest = max(by_length, default=1)
        # which leading bits of a hash any key has: most substrings are no piece and stop here
        self.filters = {n: np.zeros(1 << (64 - int(_SHIFT)), bool) for n in self.keys}
        for n, (key, _, _) in self.keys.items():
            self.filters[n][(key >> _SHIFT).astype(np.int64)] = True
        ordinary = [pieces[i] for ids in by_length.values() for i in ids]
        self.unknown = min((scores[i] for ids in by_length.values() for i in ids), default=0.0) - 10.0
        if any(SPACE in p.lstrip(SPACE) for p in ordinary):
            raise ValueError("a piece has a space after another character: words can't be encoded alone")
        alone = "" if any("\n" in p for p in ordinary) else "\n"
        # No piece crosses the end of a word or a line, so the best segmentation of a text is that of its parts.
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else ""))
        self.pieces = list(pieces)
        raw = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in pieces]
        for b, i in enumerate(byte_ids if byte_ids is not None else ()):
            raw[i] = bytes([b])
        for i in skip - set(byte_ids if byte_ids is not None else ()) - set(self.runs.values()):
            raw[i] = b""
        self.raw_len = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_start = np.concatenate(([0], np.cumsum(self.raw_len)[:-1])) if raw else np.zeros(0, np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._cache: dict[str, int] = {}  # first id in _flat · _COUNT + number of ids
        self._flat = np.zeros(0, np.int32)

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}, "_flat": np.zeros(0, np.int32)}

    @classmethod
    def from_model(cls, path: str, merges: bool | None = None) -> PieceTable:
        """Read with the sentencepiece library on the driver; executors need no file. ``merges`` says whether the scores are
        ranks of merges (default: whether they look like it); without, their largest sum is sought."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        bytes_ = {pieces[i]: i for i in range(n) if m.is_byte(i)}
        byte_ids = [bytes_[f"<0x{b:02X}>"] for b in range(256)] if len(bytes_) == 256 else None
        skip = {i for i in range(n) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        scores = [m.get_score(i) for i in range(n)]
        # a merge-trained vocabulary has the ranks of its merges for scores, others log-probabilities
        ranks = [scores[i] for i in range(n) if i not in skip and len(pieces[i].strip(SPACE)) > 0]
        if merges is None:
            merges = len(ranks) > 1 and all(x <= 0 and x == int(x) for x in ranks) and len(set(ranks)) == len(ranks)
        return cls(pieces, scores, byte_ids, m.unk_id(), skip, merges)

    # -- encoding ---------------------------------------------------------------------------------------------

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each word) of the best segmentations of words of one length: the
        largest sum of scores (at equal sums the longer last piece wins), or with an order of merges the one whose
        neighbours keep to it. All words advance together, one character at a time."""
        codes = _codes(words)
        pre, size, n = _prefix_hashes(codes), len(words[0]), len(words)
        power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        best = np.full((size + 1, n), _NONE)
        best[0] = 0
        back = np.ones((size + 1, n), np.int32)
        piece = np.full((size + 1, n), -1, np.int32)
        for end in range(1, size + 1):
            top, length, which = best[end], back[end], piece[end]
            top[:] = best[end - 1] + self.unknown  # a character without a piece of its own
            # from short to long: a longer piece wins at equal scores
            for k in range(1, min(end, self.longest) + 1):
                if k not in self.keys:
                    continue
                h = pre[:, end] - pre[:, end - k] * power[k]
                maybe = np.flatnonzero(self.filters[k][(h >> _SHIFT).astype(np.int64)])
                if not len(maybe):
                    continue
                keys, ids, scores = self.keys[k]
                at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[at] == h[maybe]
                row, at = maybe[hit], at[hit]
                if self.order is not None:
                    # only the piece that may stand behind the last one of what is before it scores at all
                    before = piece[end - k, row]
                    mine, others = self.number[ids[at]], self.number[before]
                    may = self.order.reached[mine]
                    inner = np.flatnonzero(may & (before >= 0)) if end > k else np.zeros(0, np.int64)
                    may[inner] = self.order.beside(others[inner], mine[inner])
                    row, at = row[may], at[may]
                    value = best[end - k, row]
                    better = value >= top[row]
                else:
                    value = best[end - k, row] + scores[at]
                    better = np.ones(len(row), bool) if k == 1 else value >= top[row]
                row, at = row[better], at[better]
                top[row], length[row], which[row] = value[better], k, ids[at]
        ends, rows = np.full(n, size), np.arange(n)
        trail = []
        while len(rows):
            trail.append((rows, ends, piece[ends, rows]))
            ends = ends - back[ends, rows]
            rows, ends = rows[ends > 0], ends[ends > 0]
        rows, ends, which = (np.concatenate([t[k] for t in reversed(trail)]) for k in range(3))
        order = np.argsort(rows, kind="stable")
        rows, ends, which = rows[order], ends[order], which[order]
        unknown = np.flatnonzero(which < 0)
        if not len(unknown):
            return which, np.bincount(rows, minlength=n)
        # characters without a piece become byte pieces
        symbol = codes[rows[unknown], ends[unknown] - 1] - np.uint64(1)
        distinct, back_to = np.unique(symbol, return_inverse=True)
        spelled = [np.asarray(self._fallback(chr(int(c))), np.int32) for c in distinct]
        count = np.ones(len(which), np.int64)
        count[unknown] = np.array([len(x) for x in spelled])[back_to]
        flat = np.repeat(which, count)
        first = np.cumsum(count) - count
        for k, ids in enumerate(spelled):
            at = first[unknown[back_to == k]]
            for j, i in enumerate(ids):
                flat[at + j] = i
        return flat, np.bincount(rows, weights=count, minlength=n).astype(np.int64)

    def _fallback(self, ch: str) -> list[int]:
        if self.byte_ids is None:
            return [self.unk_id]
        raw = SPACE.encode() if ch == _LITERAL else ch.encode("utf-8", "surrogatepass")
        return self.byte_ids[list(raw)].tolist()

    def _scalar(self, word: str) -> np.ndarray:
        """The same result on the text itself; used where a substring hash met a foreign key."""
        if self.order is not None:
            id_of = {p: i for i, p in enumerate(self.pieces) if self.number[i] >= 0}
            ids = [[id_of[p]] if p in id_of else self._fallback(p) for p in _merge(list(word), self.order.rank)]
            return np.asarray(list(chain.from_iterable(ids)), np.int32)
        own = {self.pieces[i]: (i, s) for keys, ids, scores in self.keys.values() for i, s in zip(ids.tolist(), scores.tolist())}
        best, back = [0.0], [(0, -1)]
        for end in range(1, len(word) + 1):
            top = (_NONE, 0, -1)
            for k in range(min(end, self.longest), 0, -1):
                hit = own.get(word[end - k : end])
                score = best[end - k] + (hit[1] if hit else self.unknown if k == 1 else _NONE)
                if score > top[0]:
                    top = (score, k, hit[0] if hit else -1)
            best.append(top[0])
            back.append(top[1:])
        out, end = [], len(word)
        while end:
            k, i = back[end]
            out = ([i] if i >= 0 else self._fallback(word[end - 1])) + out
            end -= k
        return np.asarray(out, np.int32)

    def _checked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_viterbi`` with the spelling of every word compared; a word whose substring hash met a foreign key
        (none in practice) is segmented on the text itself."""
        flat, count = self._viterbi(words)
        if self.byte_ids is None:
            return flat, count
        spelled = lambda w: w.replace(SPACE, " ").replace(_LITERAL, SPACE).encode("utf-8", "surrogatepass")
        ends = np.cumsum(count)
        size = np.add.reduceat(self.raw_len[flat], ends - count)
        code = _codes(words) - np.uint64(1)
        meant = np.where(code == ord(SPACE), 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).sum(1)
        if np.array_equal(size, meant) and self._join(flat) == spelled("".join(words)):
            return flat, count
        parts = np.split(flat, ends[:-1])
        parts = [x if self._join(x) == spelled(w) else self._scalar(w) for x, w in zip(parts, words)]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of each word in ``self._flat``, which holds the ids of the words met so far."""
        if len(self._cache) >= _CACHE_WORDS:
            self._cache, self._flat = {}, np.zeros(0, np.int32)
        unmet = [w for w in words if w not in self._cache]
        spaced = [w for w in unmet if w.startswith(SPACE * 2)] if self.order is not None else []
        if spaced:
            self._meet([c for c in dict.fromkeys(SPACE + w.lstrip(SPACE) for w in spaced) if c not in self._cache])
            self._append(spaced, [self._spaced(w) for w in spaced])
            unmet = [w for w in unmet if w not in self._cache]
        self._meet(unmet)
        place = np.fromiter(map(self._cache.__getitem__, words), np.int64, len(words))
        return place // _COUNT, place % _COUNT

    def _append(self, words: list[str], ids: list[np.ndarray]) -> None:
        at = len(self._flat) + np.cumsum([0, *(len(x) for x in ids[:-1])])
        self._flat = np.concatenate((self._flat, *ids))
        self._cache.update(zip(words, (at * _COUNT + np.array([len(x) for x in ids])).tolist()))

    def _spaced(self, word: str) -> np.ndarray:
        """A word behind several spaces: the last one is the word's if they merge, else the run's."""
        core = word.lstrip(SPACE)
        n, place = len(word) - len(core), self._cache[SPACE + core]
        ids = self._flat[place // _COUNT : place // _COUNT + place % _COUNT]
        lone = self.runs.get(1)
        if len(ids) and ids[0] == lone:
            ids = ids[1:]
        else:
            n -= 1
        longest = max(self.runs, default=1)
        sizes = [longest] * (n // longest) + self._run(n % longest)
        run = [i for k in sizes for i in ([self.runs[k]] if k in self.runs else self._fallback(" ") * k)]
        return np.concatenate((np.array(run, np.int32), ids))

    def _run(self, n: int) -> list[int]:
        """Sizes of the pieces of a run of spaces: the leftmost two that make a piece merge, until none do."""
        sizes, k = [1] * n, 0
        while k < len(sizes) - 1:
            if sizes[k] + sizes[k + 1] in self.runs:
                sizes[k : k + 2] = [sizes[k] + sizes[k + 1]]
                k = max(0, k - 1)
            else:
                k += 1
        return sizes

    def _meet(self, words: list[str]) -> None:
        words = sorted(words, key=len)
        found, at = [self._flat], len(self._flat)
        for size, group in groupby(words, len):
            group, step = list(group), max(1, _MATRIX // (size + 1))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                flat, count = self._checked(part)
                found.append(flat)
                self._cache.update(zip(part, ((at + np.cumsum(count) - count) * _COUNT + count).tolist()))
                at += len(flat)
        self._flat = np.concatenate(found)

    def encode_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of whole texts, some million characters at a time."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        chars = 0
        for t in texts:
            marked = SPACE + t.replace(SPACE, _LITERAL).replace(" ", SPACE) if t else ""
            held.append(self.parts.findall(marked))
            chars += len(t)
            if chars >= _CHUNK_CHARS:
                out += self._encode_parts(held)
                held, chars = [], 0
        return out + (self._encode_parts(held) if held else [])

    def _encode_parts(self, texts: list[list[str]]) -> list[np.ndarray]:
        distinct = dict.fromkeys(chain.from_iterable(texts))
        if not distinct:
            return [np.zeros(0, np.int32) for _ in texts]
        first, size = self._words(list(distinct))
        number = dict(zip(distinct, range(len(distinct))))
        code = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        flat = _gather(self._flat, first[code], size[code])
        ends = np.concatenate(([0], np.cumsum(size[code])))
        cut = ends[np.concatenate(([0], np.cumsum([len(t) for t in texts])))]
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]

    # -- decoding ---------------------------------------------------------------------------------------------

    def _join(self, ids: np.ndarray) -> bytes:
        return _gather(self.raw, self.raw_start[ids], self.raw_len[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: spaces for space marks, the one put before the text taken off; ill-formed bytes become
        U+FFFD."""
        text = self._join(np.asarray(ids, np.int64)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + size] for many places."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return flat[np.arange(total) + shift]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of about ``most`` units at most."""
    at, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        total += n
        if total >= most or k == len(sizes) - 1:
            yield at, k + 1 - at
            at, total = k + 1, 0


def _with(b: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, name])


def encode_pieces(
    docs: DataFrame, table: PieceTable, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """Add ``ids_col`` (array of int): the segmentation of the whole text with the largest sum of piece scores, or, for a
    merge-trained vocabulary, the one that its merges give; with ``decoded_col`` also the text that these ids decode to, in the same pass (one Python worker a task, not two).

    Spaces become U+2581 and one is put before the text; characters without a piece become UTF-8 byte pieces, as
    does a literal U+2581, so that decoding gives the text back exactly. Null and empty texts have no ids. Rows,
    repeated ones too, and other columns stay; an existing ``ids_col`` is replaced. Empty tables stay empty.
    Batches are worked on some million characters at a time.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (ids_col, decoded_col)))
    at = docs.columns.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in _slices(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(), _CHUNK_CHARS):
                part = b.slice(first, n)
                ids = table.encode_batch([t or "" for t in part.column(at).to_pylist()])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                part = _with(part, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32())), ids_col)
                if decoded_col:
                    part = _with(part, pa.array([table.decode(x) for x in ids], pa.string()), decoded_col)
                yield part

    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col:
        new.append(T.StructField(decoded_col, T.StringType()))
    return docs.mapInArrow(encode, T.StructType([*docs.schema, *new]))


def decode_pieces(df: DataFrame, table: PieceTable, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the text of ``ids_col`` (null or no ids: the empty text); an existing one is replaced."""
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c != text_col))
    at = df.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in _slices(pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(), _CHUNK_CHARS // 4):
                part = b.slice(first, n)
                size = pc.fill_null(pc.list_value_length(part.column(at)), 0).to_numpy()
                ids = np.split(part.column(at).flatten().to_numpy(zero_copy_only=False), np.cumsum(size)[:-1])
                yield _with(part, pa.array([table.decode(x) for x in ids], pa.string()), text_col)

    return df.mapInArrow(decode, T.StructType([*df.schema, T.StructField(text_col, T.StringType())]))
