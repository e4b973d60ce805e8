"""The corpus pipeline, stage by stage on its own input."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from test_sets import brute_components, check_packing  # noqa: E402
from test_texts import leaked  # noqa: E402

import corpus_pipeline  # noqa: E402
from wickerwork.llm import packing, tokens  # noqa: E402
from wickerwork.session import cut_lineage  # noqa: E402


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(cut_lineage(stage(spark, tables[-1], folder), name))
        if name != "packing":
            assert tables[-1].columns == first
    texts = [{r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for t in tables[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert np.mean([d in texts[1] for d in good]) > 0.9
    assert set(texts[2]) == set(texts[1]) and all(len(texts[2][d]) <= len(texts[1][d]) for d in texts[1])
    want = brute_components(texts[2], 5, 80)
    assert set(texts[3]) == {d for d, (_, root) in want.items() if d == root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for d, text in texts[3].items():
        n, hit = leaked(text, items)[:2]
        if not hit:
            assert texts[4][d] == text
        elif d in texts[4]:
            assert not leaked(texts[4][d], items)[1]
        else:
            assert hit > 0.3 * n
    whole = Tokenizer.from_file(tokens.tokenizer_path(packing.TOKENIZER))
    check_packing(tables[-1].collect(), texts[4], whole, 2, 4096)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
