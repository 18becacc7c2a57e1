"""Encoding whole texts with public tokenizers, one distinct word at a time.

Every vocabulary here encodes the parts of a text between certain places alone; a coder cuts texts at such places
only, so that the ids of a text are those of its parts, and encodes every distinct part once per worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any script but the six characters that texts are cut at.
_OTHER_SPACE = re.compile(r"[^\S \t-\r]")
_WORDS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \t-\r])")
#: Visible ASCII characters and Latin-1 letters, and the space.
_VISIBLE = np.zeros(0x101, bool)
_VISIBLE[[*range(0x20, 0x7F), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]] = True
#: The word pattern of the vocabulary for lower-case ASCII and Latin-1 letters.
_WORD_MATCH = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
#: The word pattern of byte-level vocabularies for parts that ``plain_parts`` finds.
_PLAIN_MATCH = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \nA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\n"
_PIECES = re.compile(r"[ ▁]*[^ ▁\n]+|[ ▁]+|\n")
#: White space of any script, and U+2581: texts are not cut behind these (UTF-8 of one, two and three bytes).
_UNCUT = [c.encode() for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if c.isspace() or c == "▁"]
_UNCUT_BYTE = np.zeros(256, bool)
_UNCUT_BYTE[[c[0] for c in _UNCUT if len(c) == 1]] = True
_UNCUT_WIDE = {n: np.array([int.from_bytes(c) for c in _UNCUT if len(c) == n]) for n in (2, 3)}
_CACHE_PARTS = 250_000
#: How token tables are written: small on disk, and a writer that buffers 16 MB.
COMPACT = {"compression": "zstd", "parquet.block.size": str(1 << 24)}
_COUNT = 1 << 28


def common_cuts(raw: np.ndarray) -> np.ndarray:
    """The places in UTF-8 bytes at which both the byte-level coder and the piece coder may be cut: before a space or a
    line end that follows a character other than white space and U+2581."""
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    at = at[at > 0]
    last = raw[at - 1].astype(np.int64)
    cut = ~_UNCUT_BYTE[last]
    wide = np.flatnonzero(last >= 0x80)
    two = last[wide] | raw[at[wide] - 2].astype(np.int64) << 8
    three = two | raw[at[wide] - 3].astype(np.int64) << 16
    cut[wide] = ~(np.isin(two, _UNCUT_WIDE[2]) | np.isin(three, _UNCUT_WIDE[3]))
    return at[cut]


def plain_parts(parts: Sequence[str]) -> np.ndarray:
    """Which parts (none empty) are a space or a line end, and visible ASCII characters or Latin-1 letters behind it."""
    if not len(parts):
        return np.zeros(0, bool)
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.cumsum(size) - size
    good = _VISIBLE[np.minimum(code, 0x100)] & (code != 0x20)
    good[first] = (code[first] == 0x20) | (code[first] == 0x0A)
    return np.logical_and.reduceat(good, first) & (size > 1)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + size] for many places."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return flat[np.arange(total) + shift]


class Coder:
    """Texts to ids: ``split`` gives the parts of every text (their numbers, the parts one after the other or, with the place
    of each part among them, the distinct ones), ``encode`` the ids of many parts one after the other and their numbers.
    Parts met so far are kept, up to a bounded number. ``inside`` gives the parts of a stretch between common cuts."""

    def __init__(
        self, split: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray | None, list[str]]],
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], inside: Callable[[str], list[str]] | None = None,
    ):
        self.split, self.encode, self.inside = split, encode, inside
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        n, code, parts = self.split(texts)
        if len(self.known) >= _CACHE_PARTS:
            self.known, self.flat = {}, self.flat[:0]
        place = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        gaps = np.flatnonzero(place < 0)
        if len(gaps):
            at = gaps.tolist()
            unmet = list(dict.fromkeys(parts[k] for k in at))
            ids, size = self.encode(unmet)
            found = (len(self.flat) + np.cumsum(size) - size) * _COUNT + size
            self.flat = np.concatenate((self.flat, ids))
            self.known.update(zip(unmet, found.tolist()))
            place[gaps] = found if len(unmet) == len(at) else [self.known[parts[k]] for k in at]
        if code is not None:
            place = place[code]
        size = place % _COUNT
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
        return gather(self.flat, place // _COUNT, size), np.diff(ends)

    def once(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each) of stretches between common cuts, a text's lead included;
        nothing is kept."""
        plain = plain_parts(stretches)
        rest = [self.inside(stretches[k]) for k in np.flatnonzero(~plain)]
        parts = list(chain.from_iterable(rest))
        number = {p: k for k, p in enumerate(dict.fromkeys(parts))}
        ids, n = self.encode(list(number))
        code = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        ends = np.concatenate(([0], np.cumsum(n[code])))[np.concatenate(([0], np.cumsum([len(x) for x in rest], dtype=np.int64)))]
        whole = self.encode([stretches[k] for k in np.flatnonzero(plain)])
        return _merged(plain, whole, (gather(ids, (np.cumsum(n) - n)[code], n[code]), np.diff(ends)))


def _listed(split: Callable[[str], list[str]]) -> Callable[[Sequence[str]], tuple[np.ndarray, None, list[str]]]:
    """The parts of many texts from a function that lists those of one."""

    def run(texts: Sequence[str]) -> tuple[np.ndarray, None, list[str]]:
        by_text = [split(t) for t in texts]
        return np.fromiter(map(len, by_text), np.int64, len(by_text)), None, list(chain.from_iterable(by_text))

    return run


def _between_spaces(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What stands between the six white-space characters (empty parts included), split and numbered by Arrow."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    return lists.value_lengths().to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size


def _merged(rows: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of all parts from those of the parts where ``rows`` holds and of the others."""
    size = np.zeros(len(rows), np.int64)
    size[rows], size[~rows] = a[1], b[1]
    first = np.zeros(len(rows), np.int64)
    first[rows], first[~rows] = np.cumsum(a[1]) - a[1], len(a[0]) + np.cumsum(b[1]) - b[1]
    return gather(np.concatenate((a[0], b[0])), first, size), size


def _library(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


def _library_ids(tok, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _flat([e.ids for e in tok.encode_batch_fast(parts, add_special_tokens=False)])


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write bytes in printable characters: the visible Latin-1 characters stand for
    themselves, the other bytes, ascending, for the characters from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in visible}
    return out | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}


def _merges(model: str) -> tuple[dict[str, int], list[str]]:
    """(ids by token, merged tokens in merge order) of a json file; every merge must make a token of its own, so
    that a merge is told by the token it makes."""
    m = json.loads(model)["model"]
    made = ["".join(x if isinstance(x, list) else x.split(" ")) for x in m["merges"]]
    if len(set(made)) != len(made):
        raise ValueError("two merges make one token")
    return m["vocab"], made


def byte_level_coder(model: str) -> Coder:
    """Byte-level BPE from the text of its json file. Texts are cut before white space that follows another
    character: there its pattern always ends a match. Strings of special tokens are plain text. Parts that
    ``plain_parts`` finds take the quicker merge library, with the pattern for their characters; the others the full one."""
    import tiktoken

    tok = _library(model)
    tok.encode_special_tokens = True
    vocab, made = _merges(model)
    byte_of = _byte_of()
    raw = [*([c] for c in byte_of), *made]
    quick = tiktoken.Encoding(
        "parts", pat_str=_PLAIN_MATCH, mergeable_ranks={bytes(byte_of[c] for c in t): k for k, t in enumerate(raw)}, special_tokens={}
    )._core_bpe
    id_of = np.array([vocab["".join(t)] for t in raw], np.int32)
    length = np.array([len(t) for t in raw], np.int64)

    def split(text: str) -> list[str]:
        return _BEFORE_SPACE.split(text) if _OTHER_SPACE.search(text) else _WORDS.findall(text)

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = plain_parts(parts)
        row = [parts[k] for k in np.flatnonzero(plain)]
        found = np.array(quick.encode_ordinary("".join(row)), np.int64)
        ends = np.searchsorted(np.cumsum(length[found]), np.cumsum([len(p.encode()) for p in row], dtype=np.int64)) + 1
        rest = _library_ids(tok, [parts[k] for k in np.flatnonzero(~plain)])
        return _merged(plain, (id_of[found], np.diff(ends, prepend=0)), rest)

    return Coder(_listed(split), encode, split)


def word_end_coder(model: str) -> Coder:
    """BPE with word ends and dropped white space, from the text of its json file: texts are cut at the six white-space
    characters. Strings of special tokens become their ids, the library's default. Parts of visible ASCII characters
    and Latin-1 letters (their lower case is one code point each, and they are composed) are matched here and take the
    quicker merge library, in which a character that no such part has stands for a word's end and merges first; the
    others, and parts that may hold a special token, take the full library."""
    import tiktoken

    tok = _library(model)
    vocab, made = _merges(model)
    byte_of, mark = _byte_of(), "\x01"
    suffix = json.loads(model)["model"]["end_of_word_suffix"]

    def raw(token: str) -> bytes:
        ends = token.endswith(suffix)
        return bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + mark.encode() * ends

    tokens = [*(c + suffix for c, b in byte_of.items() if b != ord(mark)), *byte_of, *made]
    quick = tiktoken.Encoding(
        "parts", pat_str=f"[^{mark} ]+{mark}| ", mergeable_ranks={raw(t): k for k, t in enumerate(tokens)}, special_tokens={}
    )._core_bpe
    id_of = np.array([vocab[t] for t in tokens], np.int32)
    space = next(k for k, t in enumerate(tokens) if byte_of.get(t) == ord(" "))

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " ".join(parts)
        seen = _VISIBLE[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 0x100)]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        # a part and the space behind it (none behind the last one) at a time
        plain = np.logical_and.reduceat(np.append(seen, True), np.cumsum(size) - size) if parts else np.zeros(0, bool)
        if "<|" in joined:
            plain &= np.fromiter(("<|" not in p for p in parts), bool, len(parts))
        row = parts if plain.all() else [parts[k] for k in np.flatnonzero(plain)]
        marked = _WORD_MATCH.sub(r"\g<0>" + mark, " ".join(row).lower())
        found = np.array(quick.encode_ordinary(marked), np.int64)
        between = np.flatnonzero(found == space)
        ends = np.concatenate((between - np.arange(len(between)), [len(found) - len(between)])) if row else between
        rest = _library_ids(tok, [parts[k] for k in np.flatnonzero(~plain)])
        return _merged(plain, (id_of[found[found != space]], np.diff(ends, prepend=0)), rest)

    return Coder(_between_spaces, encode)


def piece_coder(model: bytes) -> Coder:
    """Merge-trained pieces from the bytes of the model file; as the library does, a space is put before the text.
    No piece crosses the end of a word or a line (checked), so parts are encoded alone."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any("▁" in p.lstrip("▁") or "\n" in p for p in map(m.id_to_piece, range(m.get_piece_size()))):
        raise ValueError("a piece crosses the end of a word or a line")
    barrier = m.encode("\n")

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts a space before every text: it stands for the part's first one, or is taken off with a line end
        ids = m.encode([p[1:] if p[0] == " " and len(p) > 1 else "\n" + p for p in parts], num_threads=1)
        lone = m.encode("\n ")[len(barrier) :]
        return _flat([lone if p == " " else x if p[0] == " " else x[len(barrier) :] for p, x in zip(parts, ids)])

    return Coder(_listed(lambda t: _PIECES.findall(" " + t) if t else []), encode, _PIECES.findall)


def byte_level_bytes(model: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary (none for special tokens)."""
    byte_of, tok = _byte_of(), _library(model)
    out = [b""] * tok.get_vocab_size(with_added_tokens=True)
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        out[i] = bytes(byte_of[c] for c in token)
    return out


def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes of every id of a piece model: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
