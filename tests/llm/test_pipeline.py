"""The pipeline's stages, each on what the one before kept."""

import pandas as pd
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from terracell.llm.queries import tokenizer_path

from . import brute
from .test_brute import check_packing

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{MIDDLE}/documents.parquet"), []
    out.append(docs.toPandas())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, MIDDLE).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.toPandas())
    return out


def test_columns_and_lengths(steps):
    for step in steps[1:5]:
        assert list(step.columns) == corpus_pipeline.COLUMNS
        assert (step.n_chars == step.text.str.len()).all()


def test_quality_stage(steps):
    labels = pq.read_table(f"{MIDDLE}/labels.parquet").to_pandas().set_index("doc_id").quality
    kept = steps[0].doc_id.isin(steps[1].doc_id)
    known = steps[0].doc_id.isin(labels.index)
    right = kept[known].values == (labels.loc[steps[0].doc_id[known]].values == 1)
    assert right.mean() > 0.97
    assert kept.mean() > 0.7


def test_line_stage(steps):
    before, after = steps[1], steps[2].set_index("doc_id").text
    wanted = brute.recurring_lines(list(zip(before.doc_id, before.text)))
    wanted = {i: t for i, (t, n) in wanted.items() if n == 0 or brute.shingles(t)}
    assert after.to_dict() == wanted


def test_near_duplicate_stage(steps):
    groups = brute.duplicate_groups(list(zip(steps[2].doc_id, steps[2].text)))
    assert set(steps[3].doc_id) == {root for _, root in groups.values()}


def test_decontamination_stage(steps):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{MIDDLE}/benchmark.parquet").to_pylist()]
    before = brute.contamination(list(zip(steps[3].doc_id, steps[3].text)), items)
    clean = {i for i, hit in zip(steps[3].doc_id, before) if hit[1] == 0}
    same = pd.merge(steps[3], steps[4], on=["doc_id", "text"])
    assert set(same.doc_id) == clean
    assert sum(hit[1] for hit in before) > 0
    assert all(hit[1] == 0 for hit in brute.contamination(list(zip(steps[4].doc_id, steps[4].text)), items))


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    check_packing(steps[5], dict(zip(steps[4].doc_id, steps[4].text)), Tokenizer.from_file(tokenizer_path()))


def test_run_equals_the_stages(spark, steps):
    found = corpus_pipeline.run(spark, MIDDLE).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(found[columns].values.tolist()) == sorted(steps[5][columns].values.tolist())
