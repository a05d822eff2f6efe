"""Each stage on its own input."""

import corpus_pipeline as p
from cinequery.llm import decontam, near_copies, sentencepiece
from cinequery.llm.queries import MODEL_PATH

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, docs, SF)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        out = {r.doc_id: r.text for r in now.collect()}
        assert set(out) <= set(kept)
        if name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(docs).collect()}
            assert set(out) == set(groups.values())
        if name == "benchmark_decontamination":
            assert not any(i in t for t in out.values() for i in items)
            words = [decontam.words(i) for i in items]
            gone = [decontam.words(kept[k]) for k in set(kept) - set(out)]
            assert all(any(len(set(w) & set(i)) > len(set(i)) * 0.5 for i in words) for w in gone)
        if name == "secret_scans":
            assert len(out) == len(kept) and not any("AKIA" + "A" in t for t in out.values())
        docs = spark.createDataFrame(now.collect(), now.schema)
        kept = out
    last = p.STAGES[-1][1](spark, docs, SF).collect()
    model = sentencepiece.load(MODEL_PATH)
    assert len(last) == len(kept) and all(r.round_trip and model.decode(r.ids) == kept[r.doc_id] for r in last)
