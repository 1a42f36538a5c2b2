"""Suffix-array dedup and SimHash against brute force, at small thresholds, with limits that force every path."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from setloom.llm import graph, simhash, suffix_dedup
from tests.llm.helpers import documents, edge_texts


def passages(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    doc = lambda: "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 300)))
    base = [doc() for _ in range(40)]
    return [*base, *base[:5], *(b[: len(b) // 2] + doc() for b in base[5:20]), "a" * 200, "a" * 41, "ab" * 100, None, "", "x" + base[30] + "y", "é" * 90]


def test_shards_find_every_repeat():
    rng = random.Random(6)
    for trial in range(60):
        n = rng.choice([3, 5, 8])
        contexts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(n, 40))) for _ in range(rng.randint(1, 6))]
        count = Counter(c[i : i + n] for c in contexts for i in range(len(c) - n + 1))
        k, owners = n - 2, [rng.randint(0, 2) for _ in contexts]
        homes = {}
        for c, o in zip(contexts, owners, strict=True):
            for i in range(len(c) - k + 1):
                homes.setdefault(c[i : i + k], set()).add(o)
        got = suffix_dedup.repeated(contexts, [len(c) for c in contexts], n, k, [(o, o) for o in owners])
        for c, (flags, far) in zip(contexts, got, strict=True):
            assert flags.tolist() == [count[c[i : i + n]] > 1 for i in range(len(c) - n + 1)]
            assert far.tolist() == [len(homes[c[i : i + k]]) > 1 for i in range(len(c) - k + 1)]


@pytest.mark.parametrize("max_group", [4096, 1, 0])
@pytest.mark.parametrize("passage", [24, 40])
def test_suffix_dedup_equals_brute_force(spark, max_group, passage):
    texts = passages()
    want = [(*x, *y[:2]) for x, y in zip(suffix_dedup.brute_force(texts, 40), suffix_dedup.brute_passages(texts, passage, 5), strict=True)]
    docs = documents(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.report(docs, length=40, passage=passage, words=5, gram=12, max_group=max_group).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert any(x[4] for x in want) and any(x[1] and not x[4] for x in want)


def test_pieces_of_long_texts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    data = [t.encode() for t in passages() if t]
    raw = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    row, start, size, length, *_ = suffix_dedup.segments(raw, offsets, 40, 12, 90)
    windows = sorted((r, s + k) for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True) for k in range(n))
    assert windows == [(r, k) for r, d in enumerate(data) for k in range(len(d) - 39)]
    assert all(n == min(s + k + 89, len(data[r])) - s for r, s, k, n in zip(row.tolist(), start.tolist(), size.tolist(), length.tolist(), strict=True))


def test_suffix_dedup_keeps_rows_columns_and_whole_characters(spark):
    texts = edge_texts()
    docs = documents(spark, texts, [None, *range(1, len(texts) - 1), 1])
    out = suffix_dedup.dedup(docs, length=40, gram=12)
    assert out.columns == docs.columns and out.count() == len(texts)
    for r in out.collect():
        assert r._row == -1 and r.h == -2 and (r.text is None or r.n_chars == len(r.text))
    assert suffix_dedup.dedup(docs.where("false")).count() == 0 and suffix_dedup.report(docs.where("false")).count() == 0


PROSE = {
    "en": "the of and to in that was his with for had you not her which have from they were been their more when will would".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden über schön".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se été même après très".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más pero sus también señor".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    """Words of 2 to 12 letters, a few common ones and many invented."""
    words = PROSE[lang]
    return " ".join(rng.choice(words) if rng.random() < 0.4 else rng.choice(words) + rng.choice(words) + rng.choice("aeiounst") for _ in range(n))


@pytest.mark.parametrize("max_group", [4096, 0])
def test_planted_passages_go_and_clean_documents_stay(spark, max_group):
    """Passages of 51 to 80 words in four languages, in several documents each; documents without one keep every byte."""
    rng = random.Random(9)
    texts, planted = [], {}
    for lang in PROSE:
        for n in (51, 52, 55, 60, 70, 80):
            p = prose(rng, lang, n)
            for _ in range(rng.choice([2, 5])):
                planted[len(texts)] = p
                texts.append(prose(rng, lang, rng.randint(20, 150)) + "\n" + p + "\n" + prose(rng, lang, rng.randint(20, 150)))
        texts += [prose(rng, lang, 200) for _ in range(8)]
        short = prose(rng, lang, 40)
        texts += [prose(rng, lang, 90) + " " + short + " " + prose(rng, lang, 90) for _ in range(3)]
        texts.append(f"{p[:30]} " + (rng.choice(PROSE[lang]) + " ") * 200)  # a stutter stands in one document only
    docs = documents(spark, texts)
    got = {r.doc_id: r.text for r in suffix_dedup.dedup(docs, length=None, passage=suffix_dedup.PASSAGE, max_group=max_group).collect()}
    for i, t in enumerate(texts):
        if i in planted:
            assert planted[i] not in got[i] and len(t) - len(got[i]) <= len(planted[i]) + 25
        else:
            assert got[i] == t
    assert [got[i] for i in range(len(texts))] == [x[2] for x in suffix_dedup.brute_passages(texts)]
    found = {r.doc_id: r.n_passages for r in suffix_dedup.report(docs).collect()}
    assert all((found[i] > 0) == (i in planted) for i in found)


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = [*edge_texts(), "just two", "just two", "ONE", "one"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(documents(spark, texts)).collect()}
    assert got == simhash.brute_force(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert got[0] == ("0" * 16, 0) and got[1][1] == 0


def test_texts_in_pieces_have_the_same_fingerprint(monkeypatch):
    texts = [t for t in edge_texts() if t]
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t) for t in texts] == whole


def union(nodes, pairs):
    label = {n: n for n in nodes}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in pairs:
        if (x := root(a)) != (y := root(b)):
            label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("max_group", [20_000, 3, 0])
def test_index_loses_no_link(spark, max_group):
    rng = np.random.default_rng(1)
    x = set()
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            z = base
            for k in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                z ^= 1 << k
            x.add(z)
    x = np.array(sorted(x), np.uint64).view(np.int64).tolist()
    want = union(x, [(a, b) for a, b in itertools.combinations(x, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    found = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame([(v,) for v in x], "fp long"), max_group=max_group)).collect()}
    assert {v: found.get(v, v) for v in x} == want


def test_tree_pruning_equals_all_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 5, 17, 300, 2000):
        x = rng.integers(0, 2**20, n, dtype=np.uint64)
        x = np.unique(x)
        x = x[np.argsort(simhash.gray_rank(x))]
        i, j = simhash.group_links(x, 2)
        d = np.bitwise_count(x[:, None] ^ x[None, :])
        a, b = np.nonzero(np.triu(d <= 2, 1))
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: r for n, r in union({x for e in edges for x in e}, edges).items()}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark):
    texts = edge_texts()
    ids = [None, *range(1, len(texts) - 1), 6]  # a null id and a repeated one
    docs = documents(spark, [*texts, texts[6]], [*ids, 6])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r._row for r in kept.collect()} == {-1}
    want = {simhash.fingerprint(t) for t in texts}
    assert len({simhash.fingerprint(r.text) for r in kept.collect()}) == kept.count() <= len(want)
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0
    everything = simhash.report(docs).collect()
    assert len(everything) == len(texts) + 1
