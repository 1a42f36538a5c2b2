"""The pipeline's language stage drops what none of the learned languages is."""

from __future__ import annotations

import random

import corpus_pipeline
from setloom.llm import langid
from setloom.llm.common import stage, table

FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto".split()
GREEK = "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα".split()


def test_unlearned_languages_and_letter_junk_go(spark):
    rng = random.Random(2)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 11))) for _ in range(60)) for _ in range(40)]
    other = [" ".join(rng.choices(words, k=80)) for words in (FINNISH, GREEK) for _ in range(20)]
    added = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(junk + other)], "doc_id long, text string, lang string, source string, n_chars long")
    both = stage(docs.select(*[c if c in ("text", "lang", "source") else docs[c].cast("long").alias(c) for c in docs.columns]).unionByName(added), "test-langs")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, "").select("doc_id").collect()}
    assert not [d for d in kept if d >= 10**6]
    assert len(kept) >= 0.995 * docs.count()
    flagged = langid.lang_id(both).where("doc_id >= 1000000 and rejected").count()
    assert flagged == len(junk) + len(other)
