"""Operator 9, SimHash near-dedup: a Gray-order hierarchical index over distinct fingerprints.

Fingerprints (64 bits over word shingles) are made by a map; equal ones are one from then on. Two fingerprints
that differ in at most two bits agree in two of four 16-bit parts, so each goes to six shards, one for each pair
of parts; what a pair of parts shares is the root pattern of a group. Inside a task a group is sorted by Gray
rank (neighbours differ in few bits), runs of fingerprints are factored into nodes that hold the bits all members
share, and a node pair is dropped, with everything below, as soon as the bits in which their shared patterns
differ exceed two; only leaf pairs left are compared. Each task unites what it linked and returns one link a
fingerprint at most, never all pairs. Links of all tasks are contracted to components by alternating stars.

A group of more than ``max_group`` distinct fingerprints takes another exact way that gathers nothing: each of its
fingerprints and its 64 one-bit neighbours are keys, and all that share a key (65 at most) are within two bits.

Defined results: a text without words has fingerprint zero, linked like any other; a null doc_id keeps a
fingerprint, and is the component's id only if all its ids are null; equal rows are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import stage, with_row_id
from setloom.llm.graph import components

SEED = 42
PART_BITS = 16
PAIRS = tuple(combinations(range(4), 2))
LEAF = 16
FAN = 8
#: Bytes of a text that are cut into words at once.
PIECE = 4 << 20


def _pieces(low: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs; each run begins with the last words of the one before."""
    at = 0
    while at < len(low):
        to = at + PIECE
        if to < len(low):
            while to < len(low) and low[to] not in b" \t\n\v\f\r":
                to += 1
        yield low[at:to].split()
        at = to


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the shingles (XXH64, seed 42) of the words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    low = (text or "").encode().lower()
    digest = xxhash.xxh64_intdigest
    few: list[bytes] = []
    for words in _pieces(low):
        words = carry + words
        if len(words) < shingle:
            few = carry = words
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size) - 1
        starts = (ends - size + 1)[: len(words) - shingle + 1].tolist()
        h = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
        total += len(h)
        carry, few = words[len(words) - shingle + 1 :], []
    if not total:
        if not few:
            return 0
        return digest(b" ".join(few), SEED)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """doc_id, _sl_row and fp (the fingerprint as a signed long) of every row."""
    slim = with_row_id(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_sl_row"), pa.array(fp)], ["doc_id", "_sl_row", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, _sl_row long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of a code word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _nodes(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared pattern and mask of shared bits for each run [first, last) of x."""
    every, some = np.bitwise_and.reduceat(x, first), np.bitwise_or.reduceat(x, first)
    return every, ~(every ^ some)


def group_links(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of x (sorted by Gray rank) that differ in at most ``most`` bits, through the index."""
    n = len(x)
    # Levels from leaves to the top: runs of LEAF, LEAF * FAN, ... fingerprints.
    levels, width = [], LEAF
    while True:
        first = np.arange(0, n, width)
        levels.append((width, *_nodes(x, first, first + width)))
        if len(first) == 1:
            break
        width *= FAN
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 2, -1, -1):
        width, shared, mask = levels[depth]
        m = len(shared)
        step = np.arange(FAN)
        ca, cb = (a[:, None] * FAN + step)[:, :, None], (b[:, None] * FAN + step)[:, None, :]
        ca, cb = (z.reshape(-1) for z in np.broadcast_arrays(ca, cb))
        ok = (ca <= cb) & (cb < m)
        ca, cb = ca[ok], cb[ok]
        near = np.bitwise_count((shared[ca] ^ shared[cb]) & mask[ca] & mask[cb]) <= most
        a, b = ca[near], cb[near]
    out_i, out_j = [], []
    step = np.arange(LEAF)
    for k in range(0, len(a), 4096):
        i = (a[k : k + 4096, None] * LEAF + step)[:, :, None]
        j = (b[k : k + 4096, None] * LEAF + step)[:, None, :]
        i, j = (z.reshape(-1) for z in np.broadcast_arrays(i, j))
        ok = (i < j) & (j < n)
        i, j = i[ok], j[ok]
        near = np.bitwise_count(x[i] ^ x[j]) <= most
        out_i.append(i[near])
        out_j.append(j[near])
    return np.concatenate(out_i), np.concatenate(out_j)


def unite(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position that each of n positions is linked with."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _shard_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links within the groups of a partition that is sorted by group."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        out_u, out_v = [], []
        rank = gray_rank(fp)
        order = np.lexsort((rank, key))
        key, fp = key[order], fp[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        # Groups of a leaf's size: neighbours at each distance, all groups at once.
        small = np.repeat(size <= LEAF, size)
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, LEAF):
            i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(key) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
            out_u.append(fp[near])
            out_v.append(fp[near + d])
        for a, n in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            x = fp[a : a + n]
            label = unite(n, *group_links(x, most))
            own = np.flatnonzero(label != np.arange(n))
            out_u.append(x[own])
            out_v.append(x[label[own]])
        u, v = (np.concatenate([*z, np.zeros(0, np.uint64)]).view(np.int64) for z in (out_u, out_v))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        key = np.concatenate([key, b.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield links(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield links(key, fp)


def links(distinct: DataFrame, *, most: int = 2, max_group: int = 20_000) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that give the same components as all pairs within ``most`` bits (2 at most)."""
    if not 0 <= most <= 2:
        raise ValueError("four parts allow two differing bits at most")
    part = lambda k: F.shiftrightunsigned("fp", PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    keys = F.array(*[(F.shiftleft(F.lit(n).cast("long"), 2 * PART_BITS)).bitwiseOR(F.shiftleft(part(i), PART_BITS)).bitwiseOR(part(j)) for n, (i, j) in enumerate(PAIRS)])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    # Groups over the limit leave for the star keys; they are few, and known by a count that is combined before its shuffle.
    hot = rows.groupBy("key").count().where(F.col("count") > max_group).select("key")
    calm = rows.join(hot, "key", "left_anti")
    spread = calm.repartition(F.col("key")).sortWithinPartitions("key")
    found = spread.mapInArrow(lambda it: _shard_links(it, most), "u long, v long")
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    crowd = rows.join(hot, "key", "left_semi").select("fp").distinct()
    stars = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("star"))
    least = stars.groupBy("star").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionByName(stars.join(least, "star").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct())


def _clusters(prints: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint that links with another."""
    found = components(links(prints.select("fp").distinct()))
    return found.select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """The op9 result: doc_id, fingerprint, component_id, and the row's _sl_row."""
    prints = stage(fingerprints(docs, shingle=shingle), "simhash")
    roots = _clusters(prints)
    # Least ids by fingerprint first, then by component: no text and no hot key is gathered.
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("m")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = least.groupBy("root").agg(F.min("m").alias("component_id"))
    labels = least.join(ids, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "_sl_row")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("_sl_row")


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """One row of each component stays: the least doc_id (nulls last), of equal ids the first row."""
    prints = stage(fingerprints(docs, shingle=shingle), "simhash")
    roots = _clusters(prints)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_sl_row").alias("c"))
    least = prints.groupBy("fp").agg(F.min(order).alias("m")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = least.groupBy("root").agg(F.min("m")["c"].alias("_sl_row")).select("_sl_row")
    gone = prints.select("_sl_row").join(firsts, "_sl_row", "left_anti")
    return with_row_id(docs).join(gone, "_sl_row", "left_anti").select(*docs.columns)


def brute_force(rows: pd.DataFrame, shingle: int = 3, most: int = 2) -> dict:
    """Plain Python over all pairs, for tests: doc_id -> (fingerprint, component_id)."""
    import re

    prints = {}
    for doc, text in rows[["doc_id", "text"]].itertuples(index=False):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), SEED) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    label = {d: d for d in ids}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= most and (x := root(a)) != (y := root(b)):
            label[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", root(d)) for d in ids}
