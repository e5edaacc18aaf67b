"""The pipeline's stages against plain Python."""

from collections import Counter

import corpus_pipeline
from stemma.llm import common, simhash
from tests.llm.test_operators import DOCS, awkward, brute_fp, brute_stats


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    before = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, before, sf), name)
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        rows, left = before.collect(), after.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in left} <= {r.doc_id for r in rows if (s := brute_stats(r.text))[0] >= 50 and 2 * s[4] <= s[0]}
            assert len(left) > 0.7 * len(rows)
        if name == "language_id":
            assert len(left) > 0.95 * len(rows)
        if name == "simhash_near_dedup":
            fps = [brute_fp(r.text) for r in left]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
            assert {r.doc_id for r in left} <= {r.doc_id for r in rows} and len(left) == simhash.apply(before).select("component_id").distinct().count()
        if name == "mixing":
            assert max(Counter(r.doc_id for r in left).values()) <= 2
        before = after
    assert corpus_pipeline.run(spark, sf).count() == after.count()


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() > 0
        assert stage(spark, docs.limit(0), "").count() == 0
