"""The pipeline's stages against brute force, on the smallest tables and on edge cases."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavekit.llm.pieces import MODEL_FILE, PieceTable
from wavekit.llm.quality import train_quality

from .conftest import edge_rows
from .test_llm_dedup import SPACE, components_brute, simhash_brute
from .test_llm_operators import check_mix, targets_brute

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result, written and read again as the next one's input."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out[name] = docs, spark.read.parquet(f"{folder}/{name}")
        docs = out[name][1]
    return out


def test_stages_in_order():
    assert list(STAGES) == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]


def test_columns_of_documents_stay(stages):
    for name in list(STAGES)[:-1]:
        assert stages[name][1].columns == stages[name][0].columns


def test_quality_rejects_what_the_model_rejects(spark, stages):
    before, after = stages["quality_classifier"]
    model = train_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.collect()
    score = model.scores([r.text or "" for r in rows], 512)
    assert Counter(after.collect()) == Counter(r for r, s in zip(rows, score) if s >= 0.7)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert sum(labels.get(r.doc_id) == 1 and r.doc_id not in kept for r in rows) <= 2


def exact_keep(rows):
    best = {}
    for r in rows:
        k = SPACE.sub("", r.text or "")
        mine = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best[k] = min(best.get(k, mine), mine)
    return Counter((k, None if b[1] else b[2], -b[0]) for k, b in best.items())


def test_exact_keeps_one_of_each_group(stages, spark, edge):
    for before, after in (stages["exact_dedup"], (edge, corpus_pipeline.exact(spark, edge, SF))):
        got = Counter((SPACE.sub("", r.text or ""), r.doc_id, len(r.text or "")) for r in after.collect())
        assert got == exact_keep(before.collect())


def test_near_keeps_the_smallest_of_each_component(stages, spark, edge):
    for before, after in (stages["simhash_near_dedup"], (edge, corpus_pipeline.near(spark, edge, SF))):
        rows = before.collect()
        root = components_brute([simhash_brute(r.text) for r in rows])
        low = {}
        for r, c in zip(rows, root):
            mine = (r.doc_id is None, r.doc_id or 0)
            low[c] = min(low.get(c, mine), mine)
        want = Counter(None if m[0] else m[1] for m in low.values())
        assert Counter(r.doc_id for r in after.collect()) == want


def test_mixing_takes_every_document_as_often_as_the_operator_says(stages, spark, edge):
    from wavekit.llm.mixing import mix_sources

    for before, after in (stages["source_mixing"], (edge, corpus_pipeline.mixing(spark, edge, SF))):
        copies = Counter()
        for r in mix_sources(before).collect():
            copies[r.doc_id, r.source, r.size] += r.copies
        n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        got = Counter((r.doc_id, r.source, n_words(r.text)) for r in after.collect())
        assert got == +copies


def test_mixed_words_come_near_the_targets(stages):
    before, after = stages["source_mixing"]
    size, longest = defaultdict(int), defaultdict(int)
    for r in before.collect():
        size[r.source] += len((r.text or "").split())
        longest[r.source] = max(longest[r.source], len((r.text or "").split()))
    taken = defaultdict(int)
    for r in after.collect():
        taken[r.source] += len((r.text or "").split())
    for s, t in targets_brute(size).items():
        assert abs(taken[s] - t) <= longest[s]
    assert check_mix  # the operator's own test


def test_tokens_decode_to_the_texts(stages):
    before, after = stages["sentencepiece"]
    table = PieceTable.from_model(MODEL_FILE)
    got = after.collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    import numpy as np

    assert Counter((r.doc_id, table.decode(np.array(r.ids, int))) for r in got) == Counter((r.doc_id, r.text or "") for r in before.collect())


def test_edge_cases_and_empty_tables(spark, edge, clashing, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, clashing, SF)
        if name != "sentencepiece":
            assert out.columns == clashing.columns
        assert out.count() > 0
    assert corpus_pipeline.tokens(spark, edge, SF).count() == len(edge_rows())


def test_run_applies_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", F.xxhash64("ids")).collect()
    want = stages["sentencepiece"][1].select("doc_id", F.xxhash64("ids")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))
