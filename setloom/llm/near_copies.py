"""Near-dedup of the pipeline: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

SimHash comes first: each set has a 64-bit fingerprint, and operator 9's index links those within two bits. At 0.8
fingerprints differ in more bits than an index over them can bridge, so for the rest candidates come from min-hash
bands too: BANDS keys of ROWS min-hashes each. A pair of similarity s shares no key with probability
(1 - s ** ROWS) ** BANDS, 1.5e-5 at 0.8 and less above. Every link of either kind is checked exactly on the shingle sets.

Documents of equal sets are one node from the start. Each node is checked against what its fingerprint links it with and one head of a bucket first, then
against the heads of its other buckets that it isn't united with; then, components known, the pairs of a bucket that lie
in different components are. So every pair that shares a bucket is checked, already united, or has too few shingles that
others have too, or too many that the other's bitmap lacks: then it can't reach 0.8, which is exact. A group of copies of any
size costs about a pair a copy; in a group that is alike by less than 0.8, bitmaps are compared, and only what they leave is verified.

Defined results: a text of fewer than five words has one shingle of all its words; texts without words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm import simhash
from setloom.llm.common import LOWER, SPACE_SEP, gram_hash, mix64, stage, text_blocks, trim, with_row_id, words_of
from setloom.llm.graph import components

SHINGLE = 5
BANDS = 28
ROWS = 5
#: Bits of a set's bitmap, a power of two.
BITS = 2048
#: Bytes of a text that are cut into words at once.
PIECE = 4 << 20
_rng = np.random.default_rng(42)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64)


def _word_hashes(data: np.ndarray) -> np.ndarray:
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and not SPACE_SEP[data[to]]:
            to += 1
        out.append(words_of(data[at:to], np.array([0, to - at]), SPACE_SEP)[3])
        at = to
    return np.concatenate(out)


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    for a, b, data, offsets in text_blocks(col):
        data = LOWER[data]
        if b - a == 1:
            h = _word_hashes(data)
            counts = np.array([0, len(h)])
        else:
            _, _, counts, h = words_of(data, offsets, SPACE_SEP)
        for i in range(b - a):
            own = h[counts[i] : counts[i + 1]]
            yield np.unique(gram_hash(own, min(SHINGLE, len(own)))) if len(own) else own


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set, the node that stands for it."""
    return int(mix64(np.array([mix64(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set as a signed long: a bit is 1 if it is in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(mix64(hashes[k : k + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band; the empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[k : k + 2048, None] * _MUL + _ADD).min(0), out=low)
    return mix64((mix64(low).reshape(BANDS, ROWS) * _MUL[:ROWS]).sum(1, dtype=np.uint64) + _BAND * _MUL[0]).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, _sl_row, node, n (shingles), fp and keys of every row."""
    slim = with_row_id(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, fp, keys = [], [], [], []
            for s in shingle_sets(b.column("text")):
                node.append(digest(s))
                n.append(len(s))
                fp.append(fingerprint(s))
                keys.append(band_keys(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_sl_row"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "_sl_row", "node", "n", "fp", "keys"])
        trim()

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, _sl_row long, node long, n long, fp long, keys array<long>")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITS bits, as longs, with the bit of each hash set."""
    bits = np.zeros(BITS, np.uint8)
    bits[hashes >> np.uint64(64 - BITS.bit_length() + 1)] = 1
    return np.packbits(bits).view(np.int64)


def _apart(u: str, v: str) -> Column:
    """At least so many elements of the one set are not in the other: bits that it has and the other has not."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda n, x: n + x)


def _sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, shingle hashes and their bitmap, of the given rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], ["node", "hashes", "bits"])
        trim()

    return with_row_id(docs.select("text")).join(rows, "_sl_row", "left_semi").select("text").mapInArrow(run, "node long, hashes array<long>, bits array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of a Jaccard similarity of 0.8 at least: 9 * common >= 4 * (one + other)."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.where(9 * F.size(F.array_intersect("hu", "hv")) >= 4 * (F.size("hu") + F.size("hv"))).select("u", "v")


def _printed(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes (node, fp) that SimHash links: equal fingerprints by the least node, others through operator 9's index."""
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    found = simhash.links(firsts.select("fp")).distinct()
    side = lambda c: firsts.select(F.col("fp").alias(f"f{c}"), F.col("first").alias(c))
    return same.unionByName(found.toDF("fu", "fv").join(side("u"), "fu").join(side("v"), "fv").select("u", "v"))


def clusters(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, root) of every node that is linked with another; ``prints`` are the staged signatures of ``docs``."""
    nodes = prints.groupBy("node").agg(F.min("n").alias("n"), F.min("_sl_row").alias("_sl_row"), F.min("keys").alias("keys"))
    rows = nodes.select("node", "n", "_sl_row", F.explode("keys").alias("key"))
    shared = stage(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key"), "near-shared")
    # A bucket's head is the node with the most neighbours in all its buckets: of a group of copies the one they were made from, or one much like it.
    crowd = shared.groupBy("node").agg(F.sum("size").alias("crowd"))
    shared = shared.join(crowd, "node").select("node", "n", "_sl_row", "key", "crowd")
    heads = shared.groupBy("key").agg(F.max(F.struct("crowd", "node", "n")).alias("head"))
    buckets = stage(shared.join(heads, "key").select("node", "n", "_sl_row", "key", "head"), "near-buckets")
    slim = prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("_sl_row").alias("_sl_row"))
    printed = stage(_printed(slim.select("node", "fp")), "near-printed")
    ends = printed.select(F.col("u").alias("node")).unionByName(printed.select(F.col("v").alias("node")))
    sets = stage(_sets(docs, buckets.select("_sl_row").unionByName(slim.join(ends, "node", "left_semi").select("_sl_row")).distinct()), "near-sets")
    sized = "5 * least(a, b) >= 4 * greatest(a, b)"
    # Shingles that no other candidate has can't be common to two: of n, n - lone at most are.
    lone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("df")).where("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    # First what SimHash links, and each node with the head of most neighbours, one pair a node; then with its other heads where they are still apart.
    one = buckets.groupBy("node").agg(F.max("n").alias("a"), F.max("head").alias("head")).where("head.node <> node")
    linked = stage(components(_similar(one.select(F.col("node").alias("u"), F.col("head.node").alias("v"), "a", F.col("head.n").alias("b")).where(sized).select("u", "v").unionByName(printed).distinct(), sets)), "near-linked")
    root = lambda c: linked.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    stars = buckets.where("node <> head.node").select(F.col("node").alias("u"), F.col("head.node").alias("v"), F.col("n").alias("a"), F.col("head.n").alias("b")).where(sized).select("u", "v").distinct()
    apart = stars.join(root("u"), "u", "left").join(root("v"), "v", "left").where("coalesce(ru, u) <> coalesce(rv, v)").select("u", "v")
    found = stage(components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(_similar(apart, sets))), "near-stars")
    # What is left: pairs of a bucket in different components. One of the two is outside the bucket's largest component.
    member = buckets.select("key", "node", "n").join(found, "node", "left").join(lone, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"), (F.col("n") - F.coalesce("lone", F.lit(0))).alias("most"))
    parts = member.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    open_ = stage(member.join(main, "key").where("5 * most >= 4 * n").join(nodes.select("node", "keys"), "node").join(sets.select("node", "bits"), "node"), "near-open")
    one = open_.where("root <> main").select("key", F.col("node").alias("u"), F.col("n").alias("a"), F.col("root").alias("ru"), F.col("most").alias("ma"), F.col("keys").alias("ku"), F.col("bits").alias("bu"))
    other = open_.select("key", F.col("node").alias("v"), F.col("n").alias("b"), F.col("root").alias("rv"), F.col("most").alias("mb"), F.col("keys").alias("kv"), F.col("bits").alias("bv"), "main")
    # A pair is made in one of the open buckets that it shares, if neither its lone shingles nor its bitmaps show that it can't reach 0.8.
    cheap = f"ru <> rv and (rv = main or u < v) and {sized} and 9 * least(ma, mb) >= 4 * (a + b) and key = array_min(array_intersect(ku, kv))"
    near = 9 * F.least(F.col("a") - _apart("bu", "bv"), F.col("b") - _apart("bv", "bu")) >= 4 * (F.col("a") + F.col("b"))
    rest = one.join(other, "key").where(F.expr(cheap) & near)
    late = _similar(rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), sets)
    return components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(late))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group stays: the least doc_id (nulls last), of equal ids the first row."""
    prints = stage(signatures(docs), "near-copies")
    roots = clusters(docs, prints)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_sl_row").alias("c"))
    least = prints.groupBy("node").agg(F.min(order).alias("m")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = least.groupBy("root").agg(F.min("m")["c"].alias("_sl_row")).select("_sl_row")
    gone = prints.select("_sl_row").join(firsts, "_sl_row", "left_anti")
    return with_row_id(docs).join(gone, "_sl_row", "left_anti").select(*docs.columns)
