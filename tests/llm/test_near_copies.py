"""The pipeline's near-dedup against exact Jaccard over all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
from setloom.llm import near_copies
from setloom.llm.common import table
from tests.llm.helpers import documents


def shingles(text: str | None) -> set[str]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def firsts(texts: list[str | None]) -> set[int]:
    """The least position of each component of all pairs with Jaccard 0.8 or more."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if (x == y or 9 * len(x & y) >= 4 * (len(x) + len(y))) and root(a) != root(b):
            label[max(root(a), root(b))] = min(root(a), root(b))
    return {root(d) for d in range(len(texts))}


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_near_copies_go_down_to_one(spark):
    rng = random.Random(3)
    texts: list[str | None] = [None, "", "One", "one", "a b"]
    for _ in range(15):
        base = words(rng, 300)
        texts.append(" ".join(base))
        for k in (1, 3, 5, 15):  # 5 shingles go with a word: Jaccard 0.97, 0.90, 0.85, 0.6
            at = [*range(7, 300, 300 // k)][:k]
            texts.append(" ".join("new" + w if i in at else w for i, w in enumerate(base)))
        # A chain whose ends are not alike, and copies that are alike only with one another.
        for _ in range(4):
            base = [*base[15:], *words(rng, 15)]
            texts.append(" ".join(base))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), "").collect()}
    assert kept == firsts(texts) and len(kept) < len(texts) / 2


def test_pairs_outside_the_least_nodes_star_are_found(spark):
    """A large bucket of everything: its pairs are found though most are not alike to its least node."""
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = words(rng, 120)
        texts += [" ".join(base), " ".join([*base[:60], "other", *base[61:]])]
    keys = near_copies.band_keys
    try:
        near_copies.band_keys = lambda h: keys(h)[:0] if not len(h) else near_copies.np.array([7])
        docs = documents(spark, texts)
        prints = near_copies.stage(near_copies.signatures(docs), "test-prints")
        assert {r.key for r in prints.selectExpr("explode(keys) as key").distinct().collect()} == {7}
        found = near_copies.clusters(docs, prints).collect()
    finally:
        near_copies.band_keys = keys
    assert len(found) == 24 and len({r.root for r in found}) == 12


def test_near_dedup_of_the_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = {rows[i].doc_id for i in firsts([r.text for r in rows])}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()} == want


def test_long_texts_in_pieces_have_the_same_shingles(monkeypatch):
    import pyarrow as pa

    text = " ".join(words(random.Random(5), 500))
    whole = next(iter(near_copies.shingle_sets(pa.array([text]))))
    monkeypatch.setattr(near_copies, "PIECE", 50)
    assert (next(iter(near_copies.shingle_sets(pa.array([text])))) == whole).all() and len(whole) == 496


def test_bitmaps_never_claim_too_much(spark):
    from pyspark.sql import functions as F

    rng = near_copies.np.random.default_rng(7)
    rows = []
    for n in (1, 10, 150, 3000):
        base = rng.integers(0, 1 << 64, n, near_copies.np.uint64)
        other = near_copies.np.concatenate([base[: n // 2], rng.integers(0, 1 << 64, n // 3 + 1, near_copies.np.uint64)])
        rows.append((near_copies.bitmap(base).tolist(), near_copies.bitmap(other).tolist(), n - n // 2))
    got = spark.createDataFrame(rows, "u array<long>, v array<long>, missing long").select(near_copies._apart("u", "v").alias("x"), "missing").collect()
    assert all(0 <= r.x <= r.missing for r in got) and got[2].x > 0.8 * got[2].missing
    assert len(rows[0][0]) * 64 == near_copies.BITS and F is not None


def test_groups_alike_by_less_than_the_threshold_stay(spark):
    rng = random.Random(6)
    base, texts = words(rng, 200), []
    for _ in range(40):  # each pair differs in some 16 words: Jaccard about 0.4 to 0.7
        at = set(rng.sample(range(200), 8))
        texts.append(" ".join("x" + w + str(rng.random()) if i in at else w for i, w in enumerate(base)))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), "").collect()}
    assert kept == firsts(texts) and len(kept) > 30


def test_fingerprints_link_near_copies_without_any_band(spark, monkeypatch):
    """SimHash is a step of its own: within two bits, and of 0.8 or more, documents are one though they share no bucket."""
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        base = words(rng, 1500)
        texts += [" ".join(base), " ".join([*base[:700], "other", *base[701:]]), " ".join(words(rng, 3))]
    keys = near_copies.band_keys
    prints = [near_copies.fingerprint(next(iter(near_copies.shingle_sets(near_copies.pa.array([t]))))) for t in texts]
    near = [(prints[i] ^ prints[i + 1]) & ((1 << 64) - 1) for i in range(0, len(texts), 3)]
    linked = sum(x.bit_count() <= 2 for x in near)
    monkeypatch.setattr(near_copies, "band_keys", lambda h: keys(h)[:0])
    docs = documents(spark, texts)
    signs = near_copies.stage(near_copies.signatures(docs).withColumn("keys", near_copies.F.array().cast("array<long>")), "test-prints")
    found = near_copies.clusters(docs, signs).collect()
    assert linked > 10 and len({r.root for r in found}) == linked and len(found) == 2 * linked
