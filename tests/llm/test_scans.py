"""Rules, licenses, language, toxicity, contamination: against brute force, and at the edges."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from setloom.llm import decontaminate, langid, licenses, quality_rules, queries, toxicity
from setloom.llm.common import table
from tests.compare import assert_same, duck
from tests.llm.helpers import SCHEMA, documents, edge_texts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF).toPandas(), duck(SF).sql(queries.oracle_sql()[name]).df())


def test_quality_rules_equal_brute_force(spark):
    texts = [*edge_texts(), "one two three four five six seven eight " * 5, "same line here\n" * 9 + "other", "a b c d e f g h", "# $ % & | < >"]
    got = {r.doc_id: r for r in quality_rules.measure(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for k, v in quality_rules.brute_force(t).items():
            assert got[i][k] == v, (i, k)
    book = quality_rules.ledger(documents(spark, texts)).cache()
    kept = quality_rules.apply_policy(book, "v1")
    assert kept.where("kept and base_failed").count() == 0
    for r in quality_rules.ablate(book, "v1").collect():
        bit = 1 << [x.name for x in quality_rules.RULES].index(r.rule)
        bits = [b.fail_bits for b in book.collect()]
        assert r.n_fail == sum(bool(b & bit) for b in bits)
        assert r.n_only == sum((b & quality_rules.POLICIES["v1"]) == bit for b in bits)
        assert r.n_kept_without == sum(not b & quality_rules.POLICIES["v1"] & ~bit for b in bits)


def thue_morse(n: int) -> tuple[str, str]:
    """Two strings of 2**n letters whose polynomial hashes modulo 2**64 are equal."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_colliding_lines_and_words_differ(spark):
    a, b = thue_morse(10)
    texts = [f"{a}\n{b}", f"{a}\n{a}\n{b}", " ".join([a, "w x y z u v t", b, "w x y z u v t", a]), f"{a} {b} " * 8]
    got = {r.doc_id: r for r in quality_rules.measure(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for k, v in quality_rules.brute_force(t).items():
            assert got[i][k] == v, (i, k)
    assert got[0].n_dup_lines == 0 and got[1].n_dup_lines == 1
    items = [("x", b), ("y", f"one two {a}"), ("z", f"one two {b}")]
    docs = [a, b, f"one two {b}", f"one two {a} one two {b}"]
    want = decontaminate.brute_force(list(enumerate(docs)), items)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.report(documents(spark, docs), bench).collect()} == want
    assert [want[i][1] for i in range(4)] == [0, 1, 3, 6]


def test_policies_and_single_rules(spark):
    texts = ["word " * 30 + "!" * 40, "only five words are here", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "THESE ARE " + " ".join(f"WORD{i}" for i in range(40))]
    got = {r.doc_id: r for r in quality_rules.rules_report(documents(spark, texts)).collect()}
    assert got[1].only_rule == "few_words" and got[2].only_rule == "short_words" and got[3].only_rule == "capitals"
    assert [got[i].kept for i in range(4)] == [False] * 4 and [got[i].kept_lean for i in range(4)] == [False, False, True, True]


def test_licenses_equal_brute_force(spark):
    texts = [*edge_texts(), "CC-BY and cc by, CC BY-NC 4.0", "GNU General Public License, version 3. All rights reserved", "all rights", "Licensed under the Apache License, Version 2.0.", "general public", "SPDX-License-Identifier: MIT"]
    got = {r.doc_id: r for r in licenses.report(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, base, first, last, labels = licenses.brute_force(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, base, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert "apache-2.0" in got[len(texts) - 3].labels and "mit" in got[len(texts) - 1].labels
    patterns = [s.pattern for s in licenses.signatures()]
    assert len(patterns) == len(set(patterns)) > 600 and len(licenses.SENTENCES) >= 95


def license_texts(n: int) -> list[str]:
    import random

    rng = random.Random(12)
    parts = ["Licensed under the", "released under the terms of the", "license", "licence", "version 2.0", "3.0", "v2", "SPDX-License-Identifier:", "MPL-2.0", "EPL-2.0", "GPL-3.0-or-later", "OFL-1.1", "BSL-1.0", "MS-PL", "EUPL-1.2", "CC BY-NC-SA 4.0", "cc by", "creativecommons.org/licenses/by-sa/3.0", "All rights reserved.", "GNU General Public License", "the river", "and"]
    names = [re.sub(r"\(\?:([^|)]*)[^)]*\)\??", r"\1", x[2]) for x in licenses.LICENSES]
    sentences = [re.sub(r"\(\?:([^|)]*)[^)]*\)\??|\\d\{4\}|\.\{0,40\}", lambda m: m[1] or "2019", x[2]) for x in licenses.SENTENCES]
    return [" ".join(rng.choice([rng.choice(parts), rng.choice(names), rng.choice(sentences)]) for _ in range(rng.randint(3, 40))) for _ in range(n)] + sentences


def test_license_labels_equal_brute_force(spark):
    texts = license_texts(120)
    got = {r.doc_id: sorted((d.first, d.last, d.label) for d in r.detections) for r in licenses.scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == licenses.brute_detections(t), t
    named = {label for x in got.values() for _, _, label in x}
    assert {"mpl-2.0", "epl-2.0", "gpl-3.0", "ofl-1.1", "boost-1.0", "ms-pl", "eupl-1.2", "cc-by-nc-sa-4.0"} <= named and len(named) > 80


def test_many_license_matches_take_linear_time():
    import time

    scanner = licenses.Scanner()
    text = pa.array(["cc by nc 4.0 " * 80_000])
    from setloom.llm.common import text_blocks

    t = time.process_time()
    rows = [x for _, _, data, offsets in text_blocks(text) for x in scanner.block(data, offsets)]
    assert time.process_time() - t < 8 and len(rows[0][5]) == 80_000 and rows[0][1] == 80_000


def test_contained_detections_are_suppressed():
    s = licenses.Scanner()
    words = "licensed under the mit license".split()
    found = s.detections(words, set(range(len(s.rules))))
    assert [(a, b, x.label) for a, b, x in found] == [(0, 5, "mit")]


def test_language_edges(spark):
    texts = edge_texts()
    docs = documents(spark, texts, [None, *range(1, len(texts))])
    got = langid.lang_id(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.lang_pred in ("en", "und")) and 0 <= r.score <= 1
        if r.doc_id in (1, 2, 3, 5, None):
            assert r.lang_pred == "und" and r.rejected
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.lang_pred for r in kept.collect()} == {"z"}
    none = docs.where("false")
    assert langid.lang_id(none).count() == 0 and langid.keep_identified(none).columns == docs.columns


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.lang_id(table(spark, sf, "documents")).where("held_out").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.rejected.mean() < 0.01


def test_predictions_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit_documents(docs)
    texts = ["\u00b2", "\u00bd \u2460 \u2167 7", "\u00aa", "der Fluss", None, "", "日本", *[r.text[:300] for r in docs.limit(20).collect()]]
    lang, score, rejected = langid.predict_texts(pa.array(texts, pa.string()), model)
    for t, got, x, no in zip(texts, lang, score.tolist(), rejected.tolist(), strict=True):
        want = langid.brute_force(t, model)
        assert got == want[0] and abs(x - want[1]) < 1e-9 and no == (want[1] < model.threshold)
    assert lang[:2] == ["und"] * 2 and lang[2] != "und" and lang[6] != "und"


def test_every_language_is_learned(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4 * 700).select((F.col("id") % 700).cast("string").alias("lang"), F.repeat(F.concat(F.lit("x"), F.conv((F.col("id") % 700 * 37).cast("string"), 10, 26), F.lit(" ")), 5).alias("text"), (F.col("id") / 2800).alias("u"))
    assert len(langid.train(rows, docs_per_lang=4, epochs=1, dim=4).langs) == 700


def test_blocks_do_not_change_predictions():
    texts = pa.array(["abc déf", None, "", "x" * 50])
    table_ = np.random.default_rng(0).normal(size=(1 << langid.BUCKET_BITS, 2))
    from setloom.llm.common import text_blocks

    whole = [langid.block_sums(d, o, table_) for _, _, d, o in text_blocks(texts)]
    each = [langid.block_sums(d, o, table_) for _, _, d, o in text_blocks(texts, 1)]
    assert np.allclose(np.concatenate([s for s, _ in whole]), np.concatenate([s for s, _ in each]))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for sizes in ([4, 5], [1, 0, 6], [9]):
        counts = np.concatenate([[0], np.cumsum(sizes)])
        emit, trans = rng.normal(0, 2, counts[-1]), rng.normal(0, 1, (2, 2))
        got, want = toxicity.marginals(emit, counts, trans), []
        for a, b in itertools.pairwise(counts.tolist()):
            z, p = 0.0, np.zeros(b - a)
            for s in itertools.product((0, 1), repeat=b - a):
                w = np.exp(sum(emit[a + i] * x for i, x in enumerate(s)) + sum(trans[x, y] for x, y in itertools.pairwise(s)))
                z += w
                p += w * np.array(s)
            want += list(p / z)
        assert np.allclose(got, want)


def test_pairs_of_states_equal_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([0, 4, 4, 9])
    emit, trans = rng.normal(0, 2, 9), rng.normal(0, 1, (2, 2))
    m, pair = toxicity.forward_backward(emit, counts, trans)
    for a, b in itertools.pairwise(counts.tolist()):
        z, want = 0.0, np.zeros((b - a, 2, 2))
        for s in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(emit[a + i] * x for i, x in enumerate(s)) + sum(trans[x, y] for x, y in itertools.pairwise(s)))
            z += w
            for i in range(1, b - a):
                want[i, s[i - 1], s[i]] += w
        assert np.allclose(pair[a:b], want / z)
        assert np.allclose(pair[a + 1 : b].sum(1)[:, 1], m[a + 1 : b])


def test_long_chains_join_over_rows():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(0, 2, 1000), rng.normal(0, 1, (2, 2))
    alpha = np.zeros((1000, 2))
    phi, a = np.stack([np.ones(1000), np.exp(emit)], 1), np.exp(trans)
    for t in range(1000):
        alpha[t] = phi[t] * (alpha[t - 1] @ a if t else 1)
        alpha[t] /= alpha[t].sum()
    beta = np.ones((1000, 2))
    for t in range(998, -1, -1):
        beta[t] = a @ (phi[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    want = (alpha * beta)[:, 1] / (alpha * beta).sum(1)
    assert np.allclose(toxicity.marginals(emit, np.array([0, 1000]), trans), want)


def test_toxicity_held_out_and_edges(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = toxicity.report(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97 and got[got.toxic == 1].predicted.mean() > 0.88
    small = documents(spark, edge_texts())
    from pyspark.sql import functions as F

    model = toxicity.train(docs, labels.withColumn("toxic", F.when(F.col("doc_id") % 9 != 0, F.col("toxic"))))
    scored = toxicity.score(small, model).collect()
    assert len(scored) == len(edge_texts()) and all(0 <= r.toxicity <= 1 for r in scored)
    bad = toxicity.score(documents(spark, ["What an IDIOT, a worthless clown says the river"]), model).first()
    assert bad.toxicity > 0.5 and bad.toxic_spans[0].start == 8
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert [r.score for r in toxicity.report(small, labels.where("false")).collect()] == [0.0] * small.count()
    assert toxicity.report(small.where("false"), labels).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_contamination_equals_brute_force(spark, block_bytes):
    texts = edge_texts()
    items = [("b", texts[8]), ("a", texts[8]), (None, texts[9]), ("c", "the of and"), ("d", ""), ("e", None), ("b", texts[10]), ("f", "X x"), ("é", texts[-2])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [*texts, "xx THE of, and? x X", (texts[8] or "")[:-1] + "q"]
    want = decontaminate.brute_force(list(enumerate(texts)), items)
    docs = documents(spark, texts)
    if block_bytes == 1 << 24:
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, bench).collect()}
        assert got == want
        assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {d for d, x in want.items() if not x[4]}
        assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    rows = decontaminate.matches(docs.drop("bench_words"), bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (sum(s.end - s.start for s in r.bench_spans), r.bench_longest) for r in rows} == {d: (x[1], x[5]) for d, x in want.items()}
    assert decontaminate.report(docs.where("false"), bench).count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0


def test_schema_helper_names_are_unique():
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    assert len(names) == len(set(names))
