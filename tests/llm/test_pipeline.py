import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import TEXTS, documents, empty
from tests.llm.test_simhash import plain_near

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_one_another(spark, sf_dir):
    """Each stage's rows against what its operator is tested for: toxic and repeated rows go, secrets are masked, pieces cover all."""
    from tidemark.llm import mixing, secrets, toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "simhash near-dedup", "secret scans", "mixing sources", "packing"]
    stages = [f for _, f in pipeline.STAGES]
    clean = stages[0](spark, docs, sf_dir).cache()
    rejected = {r[0] for r in toxicity.toxic_digest(docs, labels).where("predicted = 1").select("doc_id").collect()}
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - rejected
    single = stages[1](spark, clean, sf_dir).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in clean.collect())
    roots = plain_near([t for _, t in rows])
    firsts = {rows[root][0] for root in roots}
    assert {r[0] for r in single.select("doc_id").collect()} == firsts and single.count() == len(firsts)
    masked = stages[2](spark, single, sf_dir).cache()
    assert masked.count() == single.count() and masked.schema == docs.schema
    assert all(not secrets.scan(r["text"]) and r["n_chars"] == len(r["text"]) for r in masked.collect())
    mixed = stages[3](spark, masked, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix_sources(masked).count()
    packed = stages[4](spark, masked, sf_dir)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert whole.count() == masked.count() and not whole.where("n <> t").take(1)


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and not full.where("n > 1024").take(1)


def _folder(spark, docs, sf_dir, root):
    docs.write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_awkward_rows_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls, empty and long texts, ties, repeats and clashing columns: every stage keeps all columns, the rows that stay are whole in the ids of the last."""
    from tidemark.llm.packing import FileTokenizer
    from tidemark.llm.queries import tokenizer_path

    own = _folder(spark, documents(spark), sf_dir, tmp_path)
    docs = spark.read.parquet(f"{own}/documents.parquet")
    names, kept = docs.columns, []
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, own))
        assert docs.columns == names
        kept.append(docs.select("doc_id", "text").collect())
    clean, single, masked, mixed = kept
    assert len(clean) == len(TEXTS)
    ids = [r["doc_id"] for r in single]
    assert len(ids) == len(set(ids)) and {0, 3, 7, 8, 9, 11, None} <= set(ids) and not {1, 2} & set(ids)
    assert len([r for r in single if not (r["text"] or "").split()]) == 1
    assert sorted(map(str, masked)) == sorted(map(str, single)) and set(map(str, mixed)) <= set(map(str, masked))
    rows = {}
    for r in pipeline.STAGES[-1][1](spark, docs, own).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        rows.setdefault(r["row"], []).append(r)
    assert len(rows) == len(mixed)
    model = FileTokenizer(tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in mixed}
    for pieces in rows.values():
        pieces.sort(key=lambda r: r["start"])
        assert [i for r in pieces for i in r["ids"]] == [*model.ids([texts[pieces[0]["doc_id"]]])[0].tolist(), 0]


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    out = pipeline.run(spark, _folder(spark, empty(spark), sf_dir, tmp_path))
    assert out.count() == 0 and "ids" in out.columns


def test_arrow_batches_of_near_dedup_are_bounded(spark, monkeypatch):
    """Rows cross to Python in small batches while near copies are dropped; the session's own bound is back afterwards, and a smaller one holds."""
    import corpus_pipeline as P

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(P.simhash, "drop_near_copies", lambda docs: seen.append(spark.conf.get(name)) or docs)
    before = spark.conf.get(name)
    try:
        for own in ("10000", "70", "0"):
            spark.conf.set(name, own)
            P.drop_near_duplicates(spark, None, "")
            assert spark.conf.get(name) == own
    finally:
        spark.conf.set(name, before)
    assert seen == ["1000", "70", "1000"]
