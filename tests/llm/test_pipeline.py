"""The pipeline: each stage against plain checks of its own input, and the whole run."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from feedloom.llm import common
from tests.llm.test_decontam import brute
from tests.llm.test_simhash import classes, slow_simhash


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """Rows before and after every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]


def test_columns_stay(tables):
    assert all(t.columns == tables[0].columns for t in tables[:5])


def test_python_workers_get_small_batches(spark, sf_dir):
    """Whoever writes a stage's rows runs its last Python step."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in common.BATCHES}
    try:
        spark.conf.set(key, str(64 << 20))
        P.decontamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
        assert int(spark.conf.get(key)) == common.BATCHES[key]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_toxic_documents_go(spark, sf_dir, tables):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()}
    before, after = texts(tables[0]), texts(tables[1])
    assert all(before[k] == after[k] for k in after)
    assert len(toxic & after.keys()) <= 0.1 * max(10, len(toxic & before.keys()))
    assert len(clean & after.keys()) >= 0.97 * len(clean & before.keys())


def test_one_of_each_class_stays(tables):
    before, after = texts(tables[1]), texts(tables[2])
    ids = sorted(before)
    label = classes([slow_simhash(before[i]) for i in ids])
    assert set(after) == {ids[c] for c in set(label)}


def test_no_long_passage_is_left_twice(tables):
    before, after = texts(tables[2]), texts(tables[3])

    def windows(t, n=51):
        w = t.lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    seen = {}
    for k in sorted(after):
        for x in windows(after[k]):
            assert seen.setdefault(x, k) == k
    for k, t in after.items():
        kept, old = t.split(), before[k].split()
        at = iter(old)
        assert all(any(w == x for x in at) for w in kept)  # nothing is added or moved
    alone = {k for k, t in before.items() if after.get(k) == t}
    assert len(alone) > 0.5 * len(before)


def test_contaminated_documents_go(spark, sf_dir, tables):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = texts(tables[3])
    want = {doc for doc, n, hit, _ in brute(list(before.items()), bench, 13) if not (hit and 20 * hit >= n)}
    assert set(texts(tables[4])) == want


def test_all_ids_are_packed(tables):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = {}
    for r in tables[5].collect():
        parts.setdefault(r.doc_id, []).append((r.piece, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    left = texts(tables[4])
    assert parts.keys() == left.keys()
    for k, t in left.items():
        assert [x for _, p in sorted(parts[k]) for x in p] == tk.encode(t, add_special_tokens=False).ids + [1]


def test_run_is_the_stages(spark, sf_dir, tables):
    def rows(df):
        return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())

    assert rows(P.run(spark, sf_dir)) == rows(tables[5])
