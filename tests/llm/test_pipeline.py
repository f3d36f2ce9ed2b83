"""The pipeline's stages on tables with odd rows: what goes goes, the rest stays whole."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sparkloom.llm import op2_suffix_dedup, op7_minhash, op8_toxicity, op10_decontaminate

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "src0", 0)], docs.schema)
    docs = docs.union(odd)
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before and {900001, 900002} <= after
        if name in ("repeated_passages", "mixing"):
            assert after == before
        assert name == "mixing" or docs.columns == columns


def test_stage_list():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_text", "mixing"]
    assert pipeline.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, beside plain Python over the same rows; columns with clashing names pass."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_kept": F.lit("k"), "_score": F.lit(2.0)})
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    now = [tuple(r) for r in docs.collect()]
    model = op8_toxicity.fitted(docs, labels)
    for name, stage in pipeline.STAGES[:-1]:
        pairs = [(r[0], r[1]) for r in now]
        if name == "toxicity":
            score = lambda t: max(model.probability(model.margins(sorted(op8_toxicity.all_words(t))))) if op8_toxicity.all_words(t) else model.share
            want = [r for r in now if score(r[1]) < 0.5]
        elif name == "near_duplicates":
            kept = {d for d, _, _, k in op7_minhash.brute(pairs, 5) if k}
            want = [r for r in now if r[0] in kept]
        elif name == "repeated_passages":
            sizes = {d: (n, s) for d, _, n, _, s in op2_suffix_dedup.brute(pairs)}
            want = now
        else:
            bad = {d for d, *_, c, _, _ in op10_decontaminate.brute(pairs, [tuple(r) for r in bench.select("item_id", "text").collect()]) if c}
            want = [r for r in now if r[0] not in bad]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = [tuple(r) for r in docs.collect()]
        if name == "repeated_passages":
            before = {r[0]: r for r in now}
            assert sorted(r[0] for r in got) == sorted(before)
            for r in got:
                removed, digest = sizes[r[0]]
                cut_ = len((before[r[0]][1] or "").encode()) - len((r[1] or "").encode())
                assert cut_ <= removed and (removed or r == before[r[0]]) and r[5:] == before[r[0]][5:]
                assert not removed or r[4] == len(r[1]) and (not r[1].isascii() or hashlib.sha256(r[1].encode()).hexdigest() == digest)
        else:
            assert sorted(got, key=str) == sorted(want, key=str)
        now = got


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    for name, stage in pipeline.STAGES:
        if os.path.isdir(SF):
            out = stage(spark, docs, SF)
            assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)
