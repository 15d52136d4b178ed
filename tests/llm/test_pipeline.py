"""The pipeline on planted rows against its stages' brute-force versions."""

import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from strandloom.llm import bpe
from tests.llm.test_operators import DATA, DOCUMENTS, HARD, brute_components, empty, hard, secret_spans


def test_stages_in_order_with_contract(spark):
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mix", "encode"]
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = documents
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before, out = kept, stage(spark, kept, DATA)
        rows = out.collect()
        if k == 0:
            lost = {r.doc_id for r in before.collect()} - {r.doc_id for r in rows}
            assert len(lost) <= 0.02 * before.count()
        elif k == 1:
            assert {r.doc_id for r in rows} == {c for _, _, c in brute_components([tuple(r) for r in before.collect()])}
        elif k == 2:
            old = {r.doc_id: r.text for r in before.collect()}
            for r in rows:
                assert not secret_spans(r.text) and r.n_chars == len(r.text)
                assert r.text == old[r.doc_id] if not secret_spans(old[r.doc_id]) else "[SECRET]" in r.text
        elif k == 3:
            words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
            total = sum(words(r.text) for r in before.collect())
            assert abs(sum(words(r.text) for r in rows) / total - 1) < 0.2
        else:
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            wanted = sorted((r.doc_id, plain.encode_ordinary(r.text)) for r in before.collect())
            assert sorted((r.doc_id, r.ids) for r in rows) == wanted
            continue
        assert out.columns == list(pipeline.COLUMNS)
        kept = spark.createDataFrame(rows, DOCUMENTS)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_every_stage_takes_hard_and_empty_rows(spark, stage):
    out = stage(spark, hard(spark), DATA).collect()
    assert len(out) <= 3 * len(HARD)
    assert stage(spark, empty(spark), DATA).count() == 0


def test_run_equals_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    found, wanted = (sorted(map(tuple, x.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256").collect())) for x in (pipeline.run(spark, DATA), docs))
    assert len(found) > 100 and found == wanted
