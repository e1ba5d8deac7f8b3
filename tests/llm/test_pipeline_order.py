"""The mixture reaches what the pipeline returns."""

import corpus_pipeline
from mergrove.llm import common, mixing

SF = "/root/testdata/sf0.001"


def test_run_returns_the_mixture(spark):
    common.scratch(spark)  # which sets a folder where none is set
    out = corpus_pipeline.run(spark, SF).select("doc_id", "source", "position").checkpoint()
    placed = [r.doc_id for r in out.orderBy("position").collect()]
    assert sorted(r.position for r in out.collect()) == list(range(len(placed)))
    slots = {r.doc_id: r.slot for r in mixing.mix(out.drop("position")).collect()}
    order = [slots[d] for d in placed]
    assert len(set(order)) > 3 and order == sorted(order)
