"""The pipeline against its operators, and its rows against a plain reading of the rules."""

import __spark_entry__ as driver
import corpus_pipeline
from cohortlens.llm import neardup
from cohortlens.llm.common import table
from cohortlens.session import materialize

from test_operators import brute_components, brute_statistics


def test_registered():
    names = driver.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


def test_stages(spark, sf, nothing):
    docs = table(spark, sf, "documents").limit(60)
    docs = materialize(docs, "docs")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for (name, stage) in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            for doc in kept:
                words, _, _, _, repeats = brute_statistics(texts[doc])
                assert words >= 50 and 100 * repeats <= 50 * words
        if name == "near_duplicates":
            root = brute_components([(d, texts[d]) for d in before], neardup.PERCENT)[1]
            assert kept == set(root.values())
        before = kept
    packed = corpus_pipeline.STAGES[3][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == before
