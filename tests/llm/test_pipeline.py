"""The pipeline, stage by stage, against brute force of each stage on its own input."""

from __future__ import annotations

import corpus_pipeline
from setloom.llm import decontaminate, pieces, suffix_dedup
from setloom.llm.common import stage, table
from tests.llm.helpers import documents, edge_texts
from tests.llm.test_near_copies import firsts

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, SF), f"test-{name}")
        before, after = docs.toPandas(), out.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "language_id":
            assert set(after.doc_id) == set(before.doc_id)  # every document here has letters and a clear language
        elif name == "near_dedup":
            rows = sorted(zip(before.doc_id, before.text, strict=True))
            assert set(after.doc_id) == {rows[i][0] for i in firsts([t for _, t in rows])}
        elif name == "passage_dedup":
            want = suffix_dedup.brute_passages(list(before.text))
            texts = dict(zip(after.doc_id, after.text, strict=True))
            assert [texts[d] for d in before.doc_id] == [w[2] for w in want]
        elif name == "decontamination":
            bench = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
            want = decontaminate.brute_force(list(zip(before.doc_id, before.text, strict=True)), bench)
            assert set(after.doc_id) == {d for d, x in want.items() if not x[4]}
        else:
            with open(pieces.MODEL, "rb") as f:
                p = pieces.Pieces(f.read())
            texts = dict(zip(before.doc_id, before.text, strict=True))
            assert len(after) == len(before) and all(p.decode(list(i)) == texts[d] for d, i in zip(after.doc_id, after.ids, strict=True))
        seen[name] = len(after)
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == seen["tokens"]
    assert seen["near_dedup"] < seen["language_id"] and seen["decontamination"] < seen["passage_dedup"]


def test_stages_at_the_edges(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names; and no rows at all."""
    texts = edge_texts()
    docs = documents(spark, [*texts, texts[8]], [None, None, *range(2, len(texts)), 8])
    empty = stage(docs.where("false"), "test-empty")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, SF), f"test-edge-{name}")
        assert out.columns == docs.columns and {r._row for r in out.collect()} <= {-1}, name
        assert step(spark, empty, SF).count() == 0 and step(spark, empty, SF).columns == docs.columns, name
        if name == "near_dedup":
            assert out.where("coalesce(trim(text), '') = ''").count() <= 1 and out.where("doc_id = 8").count() <= 1
        elif name != "language_id":
            assert out.count() == docs.count()
    name, step = corpus_pipeline.STAGES[-1]
    assert step(spark, docs, SF).count() == docs.count() and step(spark, empty, SF).count() == 0
