"""Personal data, mixing, digests, quality, licences and pieces: brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavekit.llm import digest, license, mixing, pieces, pii, quality

from tests.conftest import SMOKE_DIR
from .conftest import edge_rows, words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# -- personal data ----------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base_brute(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_plain_expressions():
    r = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "@@", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (437) 555-0689", "+49 30 123456", "+1-", "a@b.c@d.ef", "12", "5 5", "é@x.de", "..", ".", "-", " ", "+", "\n", "x", "9" * 17, "%_+@a-.b-c.d"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        mine = [(k, s, e) for k, s, e, _, base in pii.find_spans(t) if base]
        assert mine == base_brute(t), t


def test_spans_the_method_adds():
    spans = lambda t: [(k, t[s:e]) for k, s, e, *_ in pii.find_spans(t)]
    assert spans("pay to DE89 3704 0044 0532 0130 00 today") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert spans("pay to DE88 3704 0044 0532 0130 00 today") == []
    assert spans("amex card 378282246310005") == [("card_short", "378282246310005")]
    assert spans("number 378282246310005") == []  # no context word
    assert spans("social security 078-05-1120.") == [("national_id", "078-05-1120")]
    assert spans("part 078-05-1120.") == []


def test_account_numbers_before_words_and_numbers():
    spans = lambda t: [t[s:e] for k, s, e, *_ in pii.find_spans(t) if k == "iban"]
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    for iban in (de, gb, no, de.replace(" ", "")):
        for behind in ("", " BIC COBADEFFXXX", " 2024", " 12 EUR", " A", ". X", "\nBIC"):
            assert spans(f"IBAN {iban}{behind}") == [iban], behind
    assert spans(f"IBAN {de} {gb} BIC") == [de, gb]
    assert spans(f"{de}x") == [] and spans("DE88 3704 0044 0532 0130 00 BIC") == []
    other = f"ZZ{98 - int('370400440532013000353500') % 97:02d}370400440532013000"  # a country without a fixed length
    assert spans(f"{other} BIC") == [other]
    for t in ("AB12 " * 10**5, "A1" * 10**5, "DE89 3704 " * 10**5):
        pii.find_spans(t)


def test_many_spans_are_linear():
    """Over 100,000 spans in one text, of base and further kinds."""
    import time

    part = "a.b@c.de 10.2.3.4 +49 30 1234567 DE89 3704 0044 0532 0130 00 social security 078-05-1120 amex card 378282246310005\n"
    start = time.time()
    pii.find_spans(part * 2_000)
    once = time.time() - start
    found = pii.find_spans(part * 20_000)
    assert len(found) >= 100_000 and time.time() - start - once < 30 * max(once, 0.2)
    few = pii.find_spans(part * 30)
    taken: list = []
    for kind, s, e, _, base in few:
        assert base or not any(s < b and a < e for k, a, b, _, other in few if (k, a, b) != (kind, s, e))
        taken.append((s, e))
    assert len(few) == len(pii.find_spans(part)) * 30


def test_long_runs_are_linear():
    for t in ("a" * 10**6, "1" * 10**6, "1 " * 10**6, "+" + "(" * 10**6, "a@" * 10**5, "1." * 10**5):
        pii.find_spans(t)


def test_pii_rows(edge, clashing, empty):
    want = Counter(r[0] for r in edge_rows())
    for docs in (edge, clashing):
        got = pii.find_pii(docs).collect()
        assert Counter(r.doc_id for r in got) == want and not any(r.spans for r in got if r.doc_id in (1, 2, 3))
    assert pii.find_pii(empty).count() == 0
    df = edge.sparkSession.createDataFrame([(1, "mail a.b@c.de or +1 (437) 555-0689 now"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.masked for r in pii.mask_pii(df).collect()} == {1: "mail [email] or [phone] now", 2: ""}


# -- mixing -----------------------------------------------------------------------------------------------------


def targets_brute(size_of):
    order = sorted(size_of, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(size_of.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * size_of[s] for s in capped)
        target = {s: 3 * size_of[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * size_of[s]}
        if not over:
            return target
        capped |= over


def check_mix(rows, got, slack):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORDS.findall(r[1] or ""))
    target = targets_brute(size)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and int(ratio) <= r.copies <= min(3, int(ratio) + 1)
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= slack(s), (s, taken[s], t)
    return taken


def test_mix_of_edge_cases(edge, clashing, empty):
    longest = defaultdict(int)
    for r in edge_rows():
        longest[r[3]] = max(longest[r[3]], len(WORDS.findall(r[1] or "")))
    first = mixing.mix_sources(edge).collect()
    check_mix(edge_rows(), first, lambda s: longest[s])
    key = lambda rs: Counter((r.doc_id, r.source, r.size, r.copies) for r in rs)
    assert key(mixing.mix_sources(clashing.repartition(7)).collect()) == key(first)  # reruns agree
    assert mixing.mix_sources(empty).count() == 0


def test_mix_in_several_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 32)
    r = random.Random(8)
    rows = [(k, " ".join("w" * r.choice([1, 5]) for _ in range(r.choice([1, 3, 40, 200]))), None, "hot" if k % 3 else f"s{k % 7}", None) for k in range(1500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    check_mix(rows, got, lambda s: 40)  # texts have 1 to 200 words, targets some thousands


def test_flight_keeps_both_sums():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(1, 200))
        p, size, draws = r.random(n).tolist(), r.integers(1, 50, n).tolist(), r.random(n).tolist()
        q = mixing._flight(p, size, draws)
        assert sum(1e-9 < x < 1 - 1e-9 for x in q) <= 2
        assert abs(sum(q) - sum(p)) < 1e-5 and abs(np.dot(q, size) - np.dot(p, size)) < 1e-3


def test_large_rows_are_decided_first_and_both_sums_stay():
    r = np.random.default_rng(3)
    hits = []
    for _ in range(300):
        size = np.concatenate([r.integers(1, 60, 300), [20_000, 9_000]]).astype(float)
        p = np.full(302, 0.4)
        q = mixing._flight_of_large(p, size, r.random(302))
        assert np.isclose(q.sum(), p.sum()) and np.isclose(q @ size, p @ size) and ((q >= 0) & (q <= 1)).all()
        hits.append(q[-1])
    decided = [h for h in hits if h in (0, 1)]
    assert len(decided) > 250 and abs(np.mean(hits) - 0.4) < 0.1


def test_flight_draws_each_row_with_its_probability():
    r = np.random.default_rng(2)
    p, size = [0.3] * 30, r.integers(1, 9, 30).tolist()
    hits = np.mean([np.round(mixing._flight(p, size, r.random(30).tolist())) for _ in range(2000)])
    assert abs(hits - 0.3) < 0.03


# -- digests ----------------------------------------------------------------------------------------------------


def codes_brute(text):
    b = text.encode()
    count = [0] * digest.BUCKETS
    for i in range(len(b) - 2):
        count[((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761 % 2**32) >> 24] += 1
    s = sorted(count)
    cuts = [s[digest.BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    return [sum(c > q for q in cuts) for c in count]


def test_codes_equal_brute_force(monkeypatch):
    texts = ["", "a", "ab", "abc", words(1, 50), "é" * 40, words(2, 300)]
    code, _ = digest.codes(texts)
    assert code.tolist() == [codes_brute(t) for t in texts]
    monkeypatch.setattr(digest, "_CHUNK", 64)
    assert digest.codes(texts)[0].tolist() == code.tolist()


def test_likeness_is_bounded_and_falls_with_edits():
    t = words(1, 400)
    other = [t, digest.edit(t, t[: len(t) // 4] + words(9, 400, 40)), "".join(chr(200 + ord(c) % 60) for c in t), ""]
    a = digest.codes([t] * 4)
    x = digest.likeness(a, digest.codes(other))
    assert x[0] == 1 and x[0] > x[1] > x[2] >= 0 and 0 <= x[3] < 1


def neighbours_brute(rows):
    def order(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return (r[0] is None, r[0] or 0, h - (1 << 64) * (h >> 63))

    rows = sorted(rows, key=order)
    out = Counter()
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        a, b = r[1] or "", nxt[1] or ""
        half = len(a) // 2
        e = a[: len(a) - half] + b[:half]
        fp = digest.to_hex(*digest.codes([a, e, b]))
        out[(r[0], len(a), hashlib.sha256(e.encode()).hexdigest(), fp[0], fp[1])] += 1
    return out


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_neighbours_equal_brute_force(spark, edge, clashing, empty, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = digest.neighbour_fingerprints(clashing if parts == 4 else edge).collect()
        assert digest.neighbour_fingerprints(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == neighbours_brute(edge_rows())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 8 and r.n_chars).near_edited < 1


# -- quality ----------------------------------------------------------------------------------------------------


def test_features_do_not_depend_on_chunks(monkeypatch):
    texts = [words(1, 500), "", "A!! B!! " * 300, "é" * 900]
    whole = [x for _, x, _ in quality._bags(texts, 128)][0]
    monkeypatch.setattr(quality, "_CHUNK", 512)
    parts = np.concatenate([x for _, x, _ in quality._bags(texts, 128)])
    assert np.array_equal(whole, parts)


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    x = [r.standard_normal((n, 5)) for n in (1, 3, 2, 4)]
    y = np.array([0.0, 1, 1, 0])
    m = quality.AttentionMIL({"W": r.standard_normal((5, 4)), "b": r.standard_normal(4), "V": r.standard_normal((4, 3)), "U": r.standard_normal((4, 3)), "w": r.standard_normal(3), "c": r.standard_normal(4), "c0": np.zeros(1)}, np.zeros(5), np.ones(5))
    counts = np.array([len(v) for v in x])

    def loss():
        p = m.forward(np.concatenate(x), counts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = m.gradients(m.forward(np.concatenate(x), counts), y)
    for name, value in m.params.items():
        at = tuple(r.integers(0, s) for s in value.shape)
        old = value[at]
        value[at] = old + 1e-5
        up = loss()
        value[at] = old - 1e-5
        down = loss()
        value[at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6, name


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train_quality(docs, labels)
    held = labels.where((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) & F.col("quality").isNotNull())
    got = quality.score_quality(docs, model).join(held, "doc_id").toPandas()
    good = got.quality == 1
    assert (got.predicted[good] == 1).mean() > 0.97 and (got.predicted[~good] == 0).mean() > 0.8
    again = quality.score_quality(docs.repartition(5), quality.train_quality(docs.repartition(3), labels)).toPandas()
    first = quality.score_quality(docs, model).toPandas()
    assert np.allclose(first.sort_values("doc_id").score, again.sort_values("doc_id").score)


def test_quality_of_edge_cases(edge, clashing, empty):
    spark = edge.sparkSession
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(120)] + [(None, 1, 0), (4, None, 0), (100, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train_quality(edge, labels)
    for docs in (edge, clashing):
        got = quality.score_quality(docs, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows())
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.score_quality(empty, model).count() == 0
    nobody = quality.train_quality(edge, labels.limit(0))
    assert {r.score for r in quality.score_quality(edge, nobody).collect()} == {0.5}
    one = quality.train_quality(edge, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score_quality(edge, one).collect()} == {1}


# -- licences ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def licences():
    return license.fit_licences([words(k, 24, 3000) for k in range(500)])


def test_templates_and_decoys(licences):
    r = random.Random(1)
    texts, want = [], []
    for family, forms in license.TEMPLATES.items():
        for form in forms:
            texts.append(f"{words(r.randrange(99), 30)}\n{words(3, 5)} {form.upper() if r.random() < 0.3 else form}. {words(5, 4)}\n{words(7, 9)}")
            want.append([(1, family)])
    texts += [f"{d}. {words(k, 20)}" for k, d in enumerate(license.DECOYS)] + [words(700 + k, 60, 3000) for k in range(200)] + ["", "the", "\n\n"]
    want += [[]] * (len(texts) - len(want))
    found = licences.scan(texts, 0.5, 0.6)
    got = [[(f["paragraph"], f["family"]) for f in x if f["confirmed"]] for x in found]
    assert got == want
    assert all(0 <= f["probability"] <= 1 and 0 <= f["similarity"] <= 1 for x in found for f in x)


def test_a_licence_within_a_long_paragraph(licences, monkeypatch):
    text = f"{words(1, 333)} Released under the MIT License. {words(2, 500)}"
    got = licences.scan([text, text], 0.5, 0.6)
    assert [[f["family"] for f in x if f["confirmed"]] for x in got] == [["mit"], ["mit"]]
    monkeypatch.setattr(license, "_CHUNK", 100)
    assert licences.scan([text, text], 0.5, 0.6) == got


def wrapped(form, width, prefix=""):
    lines, line = [], prefix
    for w in form.split():
        if len(line) + len(w) + 1 > width and line != prefix:
            lines.append(line)
            line = prefix
        line = f"{line} {w}"
    return "\n".join([*lines, line])


def test_wrapped_licences(licences, monkeypatch):
    texts, want = [], []
    for family, forms in license.TEMPLATES.items():
        for form in forms:
            for width, prefix in ((70, ""), (40, " *"), (24, "#")):
                texts.append(f"{words(8, 30)}\n\n{wrapped(form, width, prefix)}\n\n{words(9, 40)}")
                want.append([(2, family)])
    scan = lambda: [[(f["paragraph"], f["family"]) for f in x if f["confirmed"]] for x in licences.scan(texts, 0.5, 0.6)]
    assert scan() == want
    whole = licences.scan(texts, 0.5, 0.6)
    monkeypatch.setattr(license, "_CHUNK", 60)
    assert licences.scan(texts, 0.5, 0.6) == whole


def test_every_family_of_a_window(licences):
    texts = {
        "Licensed under the Apache License, Version 2.0, or released under the MIT License": ["apache", "mit"],
        "Licensed under the BSD 3-Clause License or released under the MIT License": ["bsd", "mit"],
        "Licensed under CC BY-SA 4.0; code licensed under the Mozilla Public License, version 2.0": ["cc_by_sa", "mpl"],
        "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": ["lgpl"],
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": ["agpl"],
        "Licensed under CC BY-NC 4.0": ["cc_by_nc"],
    }
    found = licences.scan(list(texts), 0.5, 0.6)
    assert [sorted(f["family"] for f in x if f["confirmed"]) for x in found] == list(texts.values())


#: Wordings that no template has as they stand, with the family that they state.
HELD_OUT = {
    "// SPDX-License-Identifier: MIT": "mit",
    "# SPDX-License-Identifier: Apache-2.0 -- see LICENSE": "apache",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": "gpl",
    "  SPDX-License-Identifier: ISC": "isc",
    "Neither the name of Example Corp. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd",
    "Unless required by applicable law or agreed to in writing, this software is distributed under the License on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "apache",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above notice appears in all copies.": "isc",
    "(Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt)": "boost",
    "The accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at eclipse.org": "eclipse",
    "Note that this is free and unencumbered software released into the public domain by its author.": "unlicense",
    "Our library is released under the MIT License, as are its tools.": "mit",
    "The whole tree is licensed under the GNU General Public License, version 3 or any later one.": "gpl",
}


def test_held_out_wordings(licences):
    found = licences.scan([*HELD_OUT, "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: NTP"], 0.5, 0.6)
    got = [sorted({f["family"] for f in x if f["confirmed"]}) for x in found]
    assert got == [*([f] for f in HELD_OUT.values()), [], []]


def test_related_families_are_told_apart_by_their_own_pairs(licences):
    h = license._tokens(b"You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation")[0]
    logits = np.zeros(len(licences.families))
    logits[licences.families.index("agpl")] = 1  # the wrong one is a little ahead
    assert [x[0] for x in licences._judge(logits, h, h[:0], 0.6) if x[2]] == ["lgpl"]


def test_licence_rows(edge, clashing, empty):
    model = license.train_licences(edge)
    for docs in (edge, clashing):
        got = license.scan_licences(docs, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows())
        assert not any(f.confirmed for r in got for f in r.found)
    assert license.scan_licences(empty, license.train_licences(empty)).count() == 0


def test_many_equal_rows_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAME_ROWS", 1000)
    same = spark.range(25_300).select(F.lit(1).cast("long").alias("id"), F.lit("a").alias("source"), F.lit(7).cast("long").alias("size"))
    rows = same.unionByName(spark.createDataFrame([(2, None, 3), (None, "a", 1), (None, "a", 1)], "id long, source string, size long"))
    out = mixing._number_equal(rows).withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r.id, r.source, r.size, r.nth) for r in out) == Counter(
        [*((1, "a", 7, k) for k in range(1, 25_301)), (2, None, 3, 1), (None, "a", 1, 1), (None, "a", 1, 2)]
    )
    assert len({r.task for r in out if r.id == 1}) > 1


def test_repeated_ids_are_numbered(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (1, "c d", "s"), (1, "c", "s"), (None, None, None), (None, "", None), (2, "x", None)], "doc_id long, text string, source string").repartition(3)
    got = mixing.numbered(docs).collect()
    assert Counter((r.doc_id, r.source, r["__n_words"], r["__nth"]) for r in got) == Counter(
        [(1, "s", 2, 1), (1, "s", 2, 2), (1, "s", 2, 3), (1, "s", 1, 1), (None, None, 0, 1), (None, None, 0, 2), (2, None, 1, 1)]
    )


# -- pieces -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable.from_model(pieces.MODEL_FILE)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)


def best_score(table, library, text):
    """Largest sum of piece scores over all segmentations of the whole marked text."""
    own = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    marked = "▁" + text.replace("▁", "\udfff").replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(marked)
    for e in range(1, len(marked) + 1):
        for k in range(1, min(e, table.longest) + 1):
            s = own.get(marked[e - k : e], table.unknown if k == 1 else -np.inf)
            best[e] = max(best[e], best[e - k] + s)
    return best[-1]


def sum_of(table, library, ids):
    """Score of ids; the bytes of one character count once."""
    lead = {i for b, i in enumerate(table.byte_ids.tolist()) if not 0x80 <= b < 0xC0}
    total = 0.0
    for i in ids:
        total += (table.unknown if i in lead else 0.0) if library.is_byte(i) else library.get_score(i)
    return total


TEXTS = ["Hello  world\n\tx ", " ", "   a b ▁c ▁", "naïve \U0001f600\U0001f600 façade", "x" * 3000, "\r\n\n", "a", "The thathering of inly.\nEand 12.5% (x)", "漢字 かな", "\x00\x01"]


def test_ids_are_those_of_the_library(table, library, spark):
    """The order of merges as a rule on neighbours: every text's ids, runs of spaces and characters without a piece too."""
    r = random.Random(8)
    parts = [" ", "  ", "    ", "a", "b", "the", "xx", "é", "日", "本", "\n", ".", ",", "1", "ing", "tion", "\t", "\U0001f600", "aaa", "ﬁ", "\r", "▁▁"[:0], "ether"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(16))) for _ in range(4000)]
    texts += [" " * n + w for n in range(70) for w in ("", "word", "日", "a")] + [words(k, 300) for k in range(20)] + ["x" * 4000, "ab" * 3000]
    texts += [r.text for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("text").collect()]
    got = table.encode_batch(texts)
    assert table.order is not None and [x.tolist() for x in got] == library.encode(texts)


def test_segmentations_are_the_best_and_decode_exactly(library):
    table = pieces.PieceTable.from_model(pieces.MODEL_FILE, merges=False)
    for t, ids in zip(TEXTS, table.encode_batch(TEXTS)):
        assert table.decode(ids) == t
        if "▁" not in t:
            assert library.decode(ids.tolist()) == t
        assert sum_of(table, library, ids.tolist()) == pytest.approx(best_score(table, library, t))
    assert table.encode_batch(["", "a"])[0].size == 0 and table.decode(np.zeros(0, int)) == ""


def test_a_foreign_hash_falls_back_to_the_text_itself():
    t = pieces.PieceTable.from_model(pieces.MODEL_FILE)
    keys, ids, scores = t.keys[3]
    foreign = pieces._prefix_hashes(pieces._codes(["qzx"]))[:, -1]  # as if a piece had the hash of "qzx"
    at = int(np.searchsorted(keys, foreign[0]))
    t.keys[3] = np.insert(keys, at, foreign), np.insert(ids, at, t.pieces.index("the")), np.insert(scores, at, 0.0)
    t.filters[3][:] = True
    for text in ("qzx", "a qzxqzx the"):
        assert t.decode(t.encode_batch([text])[0]) == text


def test_small_vocabulary_against_every_segmentation():
    from itertools import product

    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁a": -3.5, "ba": -9.0, "aba": -4.0}
    t = pieces.PieceTable(list(vocabulary) + ["<u>"], [*vocabulary.values(), 0.0], None, 7, {7})
    for n in range(1, 8):
        for chars in product("ab ", repeat=n):
            text = "".join(chars)
            marked = "▁" + text.replace(" ", "▁")

            def best(s):
                return 0.0 if not s else max((vocabulary[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in vocabulary))

            ids = t.encode_batch([text])[0]
            assert sum(list(vocabulary.values())[i] for i in ids) == pytest.approx(best(marked))
            assert t.decode(ids) == text


def test_piece_rows(edge, clashing, empty, table):
    for docs in (edge, clashing):
        got = pieces.decode_pieces(pieces.encode_pieces(docs, table), table).collect()
        assert Counter((r.doc_id, r.decoded) for r in got) == Counter((r[0], r[1] or "") for r in edge_rows())
        once = pieces.encode_pieces(docs, table, decoded_col="decoded").collect()
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in once) == Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got)
    assert pieces.encode_pieces(empty, table).count() == 0


def test_chunks_and_cache_change_nothing(table, monkeypatch):
    texts = [words(k, 60) + "\n" for k in range(20)]
    want = [x.tolist() for x in table.encode_batch(texts)]
    monkeypatch.setattr(pieces, "_CHUNK_CHARS", 50)
    monkeypatch.setattr(pieces, "_CACHE_WORDS", 3)
    monkeypatch.setattr(pieces, "_MATRIX", 16)
    assert [x.tolist() for x in pieces.PieceTable.from_model(pieces.MODEL_FILE).encode_batch(texts)] == want
