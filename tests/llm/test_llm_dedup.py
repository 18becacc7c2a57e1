"""Exact dedup, SimHash, substring and line dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavekit.llm.common import connected_components
from wavekit.llm.exact import exact_dedup
from wavekit.llm.lines import dedup_lines
from wavekit.llm.simhash import _links, _suspects, simhash64, simhash_components
from wavekit.llm.substring import WINDOW, anchors, dedup_substrings

from .conftest import edge_rows, words

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def exact_brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = Counter()
    for norm, members in groups.items():
        best = min(members)
        keep, first = None if best[1] else best[2], True
        for m in sorted(members):
            out[(None if m[1] else m[2], keep, len(members), m == best and first, sha(norm))] += 1
            first = first and m != best
    return out


@pytest.mark.parametrize("options", [{}, {"block_chars": 16}, {"block_chars": 64, "block_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(7))}])
def test_exact_equals_brute_force(edge, options):
    """Also with blocks of 16 characters (many rounds) and with a hash that makes nearly all blocks collide."""
    docs = edge if "block_hash" not in options else edge.where("coalesce(length(text), 0) < 700")
    rows = [r for r in edge_rows() if "block_hash" not in options or len(r[1] or "") < 700]
    if options.get("block_chars") == 16:
        docs, rows = docs.where("coalesce(length(text), 0) < 50000"), [r for r in rows if len(r[1] or "") < 50000]
    got = exact_dedup(docs, **options).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == exact_brute(rows)


def test_exact_ignores_extra_columns_and_takes_empty_tables(clashing, empty):
    assert exact_dedup(empty).count() == 0
    assert exact_dedup(clashing).count() == len(edge_rows())


def test_exact_plan_is_native(edge, capsys):
    exact_dedup(edge).explain()
    dedup_lines(edge).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def simhash_brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(edge, clashing, empty):
    rows = [r for r in edge_rows()]
    fps = [simhash_brute(r[1]) for r in rows]
    root = components_brute(fps)
    low = {}
    for (doc_id, *_), c in zip(rows, root):
        if doc_id is not None:
            low[c] = min(doc_id, low.get(c, doc_id))
    want = Counter((r[0], f"{f:016x}", low.get(c)) for r, f, c in zip(rows, fps, root))
    for docs in (edge, clashing):
        got = simhash_components(docs).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash_components(empty).count() == 0


def test_ball_hashing_finds_every_pair_and_no_other(spark):
    """Fingerprints at distances 0 to 6 of some centres, dense clusters too."""
    rng = np.random.default_rng(5)
    fps = []
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63)) * 2 + 1
        for d in range(7):
            for _ in range(6):
                x = centre
                for b in rng.choice(64, d, replace=False):
                    x ^= 1 << int(b)
                fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    near = {r.fp for r in _suspects(df).collect()}
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    assert {signed[i] for p in pairs for i in p} <= near
    comp = {r.node: r.component for r in connected_components(_links(df)).collect()}
    root = components_brute(fps)
    mine = [comp.get(s, s) for s in signed]
    assert len({(a, b) for a, b in zip(mine, root)}) == len(set(mine)) == len(set(root))


def test_simhash_of_a_long_text_is_chunked_without_change(monkeypatch):
    text = words(3, 5000)
    whole = simhash64(text)
    monkeypatch.setattr("wavekit.llm.simhash._CHUNK", 100)
    assert simhash64(text) == whole


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(300)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + k: 1000 for k in range(300)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def substring_brute(rows):
    big = 1 << 70
    first = {}
    for doc_id, text, *_ in rows:
        w = WORDS.findall(text or "")
        for i in range(len(w) - WINDOW + 1):
            k = tuple(w[i : i + WINDOW])
            first[k] = min(first.get(k, big), big - 1 if doc_id is None else doc_id)
    out = Counter()
    for doc_id, text, *_ in rows:
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if first[tuple(w[i : i + WINDOW])] < (big - 1 if doc_id is None else doc_id):
                gone[i : i + WINDOW] = [True] * WINDOW
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(doc_id, len(w), sum(gone), sha(kept))] += 1
    return out


def test_substrings_equal_brute_force(edge, clashing, empty):
    want = substring_brute(edge_rows())
    for docs in (edge, clashing):
        got = dedup_substrings(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got) == want
    assert dedup_substrings(empty).count() == 0


def test_substrings_with_few_words_in_small_pieces(spark, monkeypatch):
    """Two or three distinct words only: runs, periods and ties everywhere; also over several batches."""
    rows = [(k, words(k, 20 + 7 * k, 2 + k % 2)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup_substrings(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got) == substring_brute(rows)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    for vocabulary in (2, 5, 1000):
        symbols = rng.integers(1, vocabulary + 1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        symbols[::97] = symbols[-1] = 0  # documents end with a 0
        starts, key = anchors(symbols)
        at = dict(zip(starts.tolist(), key.tolist()))
        for s in list(at)[::50]:
            alone = np.concatenate([rng.integers(1, 9, 4, dtype=np.uint64), symbols[s : s + WINDOW], rng.integers(1, 9, 4, dtype=np.uint64), [np.uint64(0)]])
            again = dict(zip(*(x.tolist() for x in anchors(alone))))
            assert again[4] == at[s]


def test_a_long_text_in_pieces_gives_the_same(spark, monkeypatch):
    import pyarrow as pa

    from wavekit.llm import substring

    text = pa.array([words(1, 900, 50), words(2, 40, 50)])

    def found():
        return sorted((int(o[s]), int(p[s]), int(k)) for x, o, p in substring._sequences(text) for s, k in zip(*substring.anchors(x)))

    whole = found()
    monkeypatch.setattr(substring, "_CHUNK", 300)
    monkeypatch.setattr(substring, "_PIECE", 50)
    assert found() == whole


def lines_brute(rows, least=2, long_line=20):
    docs = {(r[0], r[1] or "") for r in rows}
    chunks = {}
    for doc_id, text in docs:
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        pair = {i: (h[i - 1] * 31 + h[i]) % 2**32 for i in range(1, len(lines))}
        lowest = {i for i in pair if i - 1 in pair and i + 1 in pair and pair[i] < min(pair[i - 1], pair[i + 1])}
        own = {i for i, x in enumerate(lines) if x.count(" ") >= long_line - 1}
        cut = sorted({0, len(lines)} | {i for i in pair if i in lowest or i in own or i - 1 in own})
        chunks[doc_id, text] = [(a, b - a, "\n".join(lines[a:b])) for a, b in zip(cut, cut[1:])]
    first = {}
    for (doc_id, text), cs in chunks.items():
        tkey = xxhash.xxh64_intdigest(text.encode(), 42)
        tkey -= (1 << 64) * (tkey >> 63)
        for a, n, c in cs:
            if n >= least or c.count(" ") >= long_line - 1:
                place = (doc_id is None, doc_id or 0, tkey, a)
                first[c] = min(first.get(c, place), place)
    out = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        tkey = xxhash.xxh64_intdigest(text.encode(), 42)
        tkey -= (1 << 64) * (tkey >> 63)
        kept, removed = [], 0
        for a, n, c in chunks[doc_id, text]:
            if c in first and (n >= least or c.count(" ") >= long_line - 1) and first[c] != (doc_id is None, doc_id or 0, tkey, a):
                removed += n
            else:
                kept.append(c)
        out[(doc_id, len(text.split("\n")), removed, "\n".join(kept))] += 1
    return out


def test_lines_equal_brute_force(spark, edge, clashing, empty):
    import random

    r = random.Random(2)
    pool = [words(k, 4) for k in range(30)]
    passage = [words(500 + k, 6) for k in range(12)]
    made = []
    for k in range(60):
        body = [r.choice(pool) for _ in range(r.randrange(12))]
        at = r.randrange(len(body) + 1)
        made.append((k, "\n".join(body[:at] + passage * (k % 3) + body[at:])))
    for rows, docs in ((made, spark.createDataFrame(made, "doc_id long, text string")), (edge_rows(), edge), (edge_rows(), clashing)):
        got = dedup_lines(docs).collect()
        assert Counter((x.doc_id, x.n_lines, x.n_removed, x.kept) for x in got) == lines_brute(rows)
    assert dedup_lines(empty).count() == 0
    assert any(k[2] >= 8 for k in lines_brute(made))


def test_lines_of_repeated_passages_go(spark):
    """A passage of 20 lines in 200 documents, each between lines of their own, and one long line."""
    passage = [words(900 + k, 6) for k in range(20)]
    rows = [(k, "\n".join([words(10_000 + 10 * k + j, 5) for j in range(5)] + passage + [words(20_000 + 10 * k + j, 5) for j in range(5)])) for k in range(200)]
    gone = sum(r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert gone >= 0.75 * 199 * 20
    line = words(77, 72)
    one = [(k, "\n".join([words(30_000 + k, 5), line, words(40_000 + k, 5)])) for k in range(50)]
    assert sum(r.n_removed for r in dedup_lines(spark.createDataFrame(one, "doc_id long, text string")).collect()) == 49


def test_the_largest_id_is_no_null(spark):
    last = (1 << 63) - 1
    shared = words(5, 30)
    rows = [(3, shared), (last, shared + " end"), (None, shared + " other"), (None, words(6, 20))]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == Counter(
        [(3, 30, 0, shared), (last, 31, 30, "end"), (None, 31, 30, "other"), (None, 20, 0, words(6, 20))]
    )
    only = dedup_substrings(spark.createDataFrame([(last, shared), (7, "a")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in only} == {last, 7}
