"""Alignment, packing and manifest against brute-force versions, on the edge rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekit.llm import alignment, coding, merkle, packing, queries

from .conftest import DOCS, edge_rows

A, B, W = (queries._tokenizer(n) for n in (queries.BYTE_LEVEL, queries.PIECES, queries.WORD_ENDS))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, w = Tokenizer.from_file(A), Tokenizer.from_file(W)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return (lambda t: a.encode(t, add_special_tokens=False).ids, lambda t: b.encode(t), lambda t: w.encode(t, add_special_tokens=False).ids)


def odd_texts(n):
    r = random.Random(7)
    parts = [" ", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "​", "﻿", "a", "word", "The", "é",
             "́", "é", "É", "'s", "'", "12", "7", ".", ",", "!?", "▁", "<|endoftext|>", "<|startoftext|>", "ß", "Σ", "ΑΣ", "\U0001f600", "日本", "\x00",
             "\x01", "İ", "x" * 30, "<s>", "<0x41>", "K", "word,", "don't", "naïve"]
    visible = [*map(chr, range(0x20, 0x7F)), *map(chr, range(0xA0, 0x100)), "don't", "WE'LL", "'re"]
    return ["".join(r.choice(parts if k % 2 else visible) for _ in range(r.randrange(14))) for k in range(n)]


# -- coders -----------------------------------------------------------------------------------------------------------


def test_coders_give_the_libraries_ids(libraries):
    model = lambda p, mode="r": open(p, mode, **({} if "b" in mode else {"encoding": "utf-8"})).read()  # noqa: E731, SIM115
    coders = coding.byte_level_coder(model(A)), coding.piece_coder(model(B, "rb")), coding.word_end_coder(model(W))
    texts = [t or "" for _, t, *_ in edge_rows()] + odd_texts(3000)
    for coder, plain in zip(coders, libraries):
        ids, n = coder(texts)
        for t, x in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert x.tolist() == plain(t), repr(t)[:200]


# -- alignment --------------------------------------------------------------------------------------------------------


def test_lockstep_equals_common_ends():
    r = np.random.default_rng(3)
    for stretch in (1, 3, 50, 4096):
        sizes = r.integers(0, 400, 40)
        ends = np.cumsum(sizes)
        pick = lambda: np.unique(np.concatenate([r.integers(1, ends[-1] + 1, 900), ends[sizes > 0]]))
        a, b = pick(), pick()
        i, j = alignment.lockstep(a, b, ends, stretch)
        _, want_i, want_j = np.intersect1d(a, b, return_indices=True)
        assert np.array_equal(i, want_i) and np.array_equal(j, want_j)


def aligned_brute(rows, libraries):
    with open(A, encoding="utf-8") as f:
        bytes_a = coding.byte_level_bytes(f.read())
    with open(B, "rb") as f:
        bytes_b = coding.piece_bytes(f.read())
    counts, found = Counter(), []
    for t in rows:
        a, b, want = (libraries[0](" " + t), libraries[1](t), (" " + t).encode()) if t else ([], [], b"")
        if not t or b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            found.append(([], [], [], ""))
            continue
        _, ia, ib = np.intersect1d(np.cumsum([len(bytes_a[i]) for i in a]), np.cumsum([len(bytes_b[i]) for i in b]), return_indices=True)
        links, groups, pa, pb = [(a[i], b[j]) for i, j in zip(ia, ib)], [], 0, 0
        for i, j in zip(ia, ib):
            groups.append(",".join(map(str, a[pa : i + 1])) + "|" + ",".join(map(str, b[pb : j + 1])))
            pa, pb = i + 1, j + 1
        counts.update(links)
        found.append((a, b, links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (len(a), len(b), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), g) for a, b, links, g in found
    ]


@pytest.mark.parametrize("chunk", [50, alignment.CHUNK_CHARS])
def test_alignment_equals_brute_force(spark, libraries, chunk):
    rows = edge_rows() + [(500 + k, t, "en", "a", None) for k, t in enumerate(odd_texts(60))]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = alignment.align_tokenizers(docs, A, B, chunk_chars=chunk).collect()
    want = aligned_brute([r[1] or "" for r in rows], libraries)
    keyed = Counter((r[0], *w) for r, w in zip(rows, want))
    assert Counter((g.doc_id, g.n_a, g.n_b, g.n_links, g.n_best, g.count_sum, g.groups) for g in got) == keyed
    assert all(g.n_groups == g.n_links and g.groups_sha256 == (hashlib.sha256(g.groups.encode()).hexdigest() if g.groups else "") for g in got)


def test_ids_between_common_cuts_are_those_of_the_text(libraries):
    texts = [t or "" for _, t, *_ in edge_rows()] + odd_texts(3000)
    texts += [f"{x}{c} {c}\n{x}" for c in map(chr, [*range(1, 0x300), *range(0x1680, 0x1682), *range(0x2000, 0x2070), 0x3000]) for x in ("a", "é")]
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        coders = coding.byte_level_coder(f.read()), coding.piece_coder(g.read())
    for t in filter(None, texts):
        raw = (" " + t).encode()
        flat = np.frombuffer(raw, np.uint8)
        parts = [x.tobytes().decode() for x in np.split(flat, coding.common_cuts(flat))]
        assert coders[0].once(parts)[0].tolist() == libraries[0](" " + t), repr(t)[:200]
        assert coders[1].once(parts)[0].tolist() == libraries[1](t), repr(t)[:200]


def aligner():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        a, b = f.read(), g.read()
    return alignment.Aligner(coding.byte_level_coder(a), coding.piece_coder(b), coding.byte_level_bytes(a), coding.piece_bytes(b))


def test_a_part_that_repeats_is_aligned_once(monkeypatch):
    handed = []
    monkeypatch.setattr(alignment, "lockstep", lambda a, b, *rest, f=alignment.lockstep: handed.append(len(a) + len(b)) or f(a, b, *rest))
    align = aligner()
    text = "some words, and\nsome other words: naïve ones"
    one = align([text])
    once = sum(handed)
    many = align([text, None, "", text + " ▁"] + [text] * 500)  # 500 texts went through the lockstep before
    assert sum(handed) <= 4 * once
    assert many.n_links.tolist() == [one.n_links[0], 0, 0, 0] + [one.n_links[0]] * 500
    assert many.groups[-1] == one.groups[0] and bytes(many.groups[3]) == b""
    assert np.array_equal(many.pairs, one.pairs) and np.array_equal(many.pair_n, 501 * one.pair_n)


def test_parts_kept_by_a_worker_are_bounded(monkeypatch):
    align = aligner()
    texts = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(30)]
    want = align(texts)
    monkeypatch.setattr(alignment, "CACHE_PARTS", 10)
    for k, t in enumerate(texts):
        assert align([t]).groups == [want.groups[k]]
        assert len(align.known) == len(align.good) <= 20
    monkeypatch.undo()
    monkeypatch.setattr(alignment, "CACHE_BYTES", 10)
    align([texts[0]]), align([texts[1]])
    assert len(align.known) == 20


def test_alignment_of_clashing_and_empty_tables(spark, clashing, edge, empty):
    sums = lambda df: sorted(map(tuple, alignment.align_tokenizers(df, A, B, groups=False).collect()), key=str)
    more = clashing.withColumns({c: F.lit("x") for c in ("chunk", "links", "pairs", "n_a", "groups", "total")})
    assert sums(more) == sums(edge)
    assert alignment.align_tokenizers(empty, A, B).collect() == []


# -- packing ----------------------------------------------------------------------------------------------------------


def test_knapsack_and_columns():
    r = random.Random(5)
    for _ in range(50):
        sizes = np.array(sorted(r.sample(range(1, 30), 6)))
        values, room = np.array([r.random() for _ in sizes]), r.randrange(20, 60)
        best = [0.0] * (room + 1)
        for c in range(1, room + 1):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes, values) if s <= c)])
        value, counts = packing.knapsack(sizes, values, room)
        assert abs(value - best[room]) < 1e-9 and counts @ sizes <= room
    sizes, demand = np.array([3, 5, 7, 11]), np.array([40.0, 31, 17, 9])
    patterns, uses = packing.column_generation(sizes, demand, 16)
    assert (patterns @ sizes <= 16).all() and (uses @ patterns >= demand - 1e-6).all()
    assert uses.sum() <= (demand @ sizes) / 16 * 1.15


def places(plan, histogram, capacity):
    """Every item's pieces, by the plan's definition."""
    seen, out = Counter(), defaultdict(list)
    for n, lo, hi, first, at, stream in plan.rows:
        for k in range(hi - lo):
            seen[n, lo + k] += 1
            if not stream:
                out[first + k].append((at, n))
    assert seen == Counter((n, k) for n, h in histogram.items() for k in range(h))
    return out


@pytest.mark.parametrize("kind", ["uniform", "hot", "one", "few", "none", "long"])
def test_plan_places_every_item_once(kind):
    r = np.random.default_rng(11)
    lengths = {"uniform": r.integers(1, 256, 5000), "hot": np.concatenate((np.full(4000, 97), r.integers(1, 256, 4000))), "one": np.full(3000, 150),
               "few": np.array([5, 5, 200, 131]), "none": np.zeros(0, int), "long": r.integers(200, 256, 900)}[kind]
    values, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist()))
    plan = packing.make_plan(histogram, capacity=256, unit=4)
    padding = 0
    for found in places(plan, histogram, 256).values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 0.01 * max(1, lengths.sum())


def pieces_hold(rows, got, plain, capacity=2048):
    by, seqs = defaultdict(list), defaultdict(list)
    for g in got:
        by[g.doc_id].append(g)
        seqs[g.sequence_id].append((g.offset, g.length))
    for i in {r[0] for r in rows}:
        want = Counter(tuple(plain(t or "") + [1]) for d, t, *_ in rows if d == i)
        # pieces of rows that share an id: every row's pieces, told apart by their ids
        total = sum(len(ids) * n for ids, n in want.items())
        assert sum(g.length for g in by[i]) == total
        if sum(want.values()) == 1:
            (ids,), at = want, 0
            raw = np.array(ids, "<u4")
            for g in sorted(by[i], key=lambda g: g.start):
                assert g.start == at and g.doc_tokens == len(ids) and g.length > 0
                assert bytes(g.ids) == raw[at : at + g.length].tobytes()
                at += g.length
            assert at == len(ids)
    padding = 0
    for found in seqs.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(g.length for g in got)


def test_packing_holds_every_id_once(spark, libraries):
    rows = edge_rows() + [(500 + k, t, "en", "a", None) for k, t in enumerate(odd_texts(80))] + [(900 + k, "one two three", "en", "a", 1) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    for capacity in (2048, 64):
        got = packing.pack_sequences(docs, W, capacity=capacity, unit=max(1, capacity // 256)).collect()
        padding, total = pieces_hold(rows, got, libraries[2], capacity)
        assert padding <= 0.01 * total


def test_packing_of_clashing_and_empty_tables(spark, clashing, empty):
    more = clashing.withColumns({c: F.lit("x") for c in ("start", "length", "plan", "tokens", "item", "place", "pos")})
    got = packing.pack_sequences(more, W)
    extra = [c for c in more.columns if c not in ("text", "start", "length", "ids")]
    assert got.columns == [*extra, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert {(g.plan, g.tokens, g.key) for g in got.collect()} == {("x", "x", "extra key")}
    assert sum(g.length for g in got.collect()) == sum(g.length for g in packing.pack_sequences(clashing.select("doc_id", "text"), W).collect())
    assert packing.pack_sequences(empty, W).collect() == []


# -- manifest ---------------------------------------------------------------------------------------------------------


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def merkle_brute(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, m=None: digest("".join(map(field, (r[0], r[3], r[2], r[4] if m is None else m, r[1]))))

    def tree(nodes):
        """(root, siblings of every leaf by level)."""
        paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            runs = [list(range(k, min(k + arity, len(nodes)))) for k in range(0, len(nodes), arity)]
            for run in runs:
                for k in run:
                    for member in groups[k]:
                        paths[member].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
            groups = [sum((groups[k] for k in run), []) for run in runs]
            nodes = [digest("".join(nodes[k] for k in run)) for run in runs]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, roots = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in own])
        roots.append(root)
        found.append((own, paths))
    root, above = tree(roots)
    out = []
    for k, (own, paths) in enumerate(found):
        for r, path in zip(own, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            acc = leaf(r, r[4] + 1) if tampered else leaf(r)
            for left, right in path + above[k]:
                acc = digest(left + acc + right)
            out.append((r[0], leaf(r), roots[k], root, "".join(a + b for a, b in path + above[k]), acc, acc == root))
    return out


@pytest.mark.parametrize(("levels", "arity"), [(8, 2), (2, 2), (1, 2), (2, 3), (1, 5)])
def test_manifest_equals_brute_force(spark, levels, arity):
    rows = [(*r[:4], 7 * k if k % 3 else None) for k, r in enumerate(edge_rows()) if r[0] != 11] + [(1000 + k, f"t{k}", "é" if k % 2 else "zz", "s", k) for k in range(37)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    got = merkle.manifest(docs, tampered={"n_chars": F.col("n_chars") + 1}, tamper_where=chosen, levels=levels, arity=arity)
    proof = F.lower(F.array_join(F.transform("proof", lambda s: F.hex(F.concat(s["left"], s["right"]))), ""))
    got = got.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()
    # the two equal rows have one place each: which of them has which proof is open, the rows are not
    assert Counter(map(tuple, got)) == Counter(merkle_brute(rows, arity))
    assert 0 < sum(not g.verified for g in got) < len(got)


def test_manifest_of_small_empty_and_clashing_tables(spark, empty, clashing, edge):
    assert merkle.manifest(empty).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == [] and one.verified
    more = clashing.withColumns({c: F.lit("x") for c in ("tree", "idx", "h0", "path", "top", "pos", "block", "other")})
    assert sorted(map(str, merkle.manifest(more).collect())) == sorted(map(str, merkle.manifest(edge).collect()))
