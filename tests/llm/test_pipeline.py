"""Each stage of the pipeline against brute force on its own input."""

import collections

from brookframe.llm.scratch import Scratch
from corpus_pipeline import STAGES, run
from test_operators import SMALL, components, removed, table


def test_stages(spark):
    scratch, docs = Scratch(spark, "test"), table(spark, SMALL, "documents")
    inputs = {}
    for name, stage in STAGES:
        inputs[name] = {r.doc_id: r for r in docs.collect()} if "doc_id" in docs.columns else {}
        count = docs.count()
        out = scratch.write(stage(spark, docs, SMALL), name)
        if name != "token_packing":
            assert out.columns == docs.columns
        if name == "quality_filter":
            labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
            kept = {r.doc_id for r in out.collect()}
            clean = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in clean) >= 0.95 * len(clean) and out.count() < count
        if name == "near_dedup":
            want, _ = components({i: r.text for i, r in inputs[name].items()})
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
        if name == "passage_dedup":
            want = removed([(i, r.text) for i, r in inputs[name].items()], 35)
            got = {r.doc_id: r for r in out.collect()}
            assert got.keys() == want.keys()
            for i, r in got.items():
                assert len(r.text.split()) == want[i][0] - want[i][1] and r.n_chars == len(r.text)
                assert want[i][1] or r.text == inputs[name][i].text
        if name == "source_mixing":
            times = collections.Counter(r.doc_id for r in out.collect())
            assert times.keys() == inputs[name].keys() and max(times.values()) <= 2
        if name == "token_packing":
            assert out.where("piece = 0").count() == count
        docs = out
    assert run(spark, SMALL).count() == docs.count()
