"""Operator 10, benchmark decontamination: suffix arrays of training shards, searched for every test suffix.

A shard is a block of documents. Its word suffixes that can begin a window at all (their first words begin some
test window, a keyword gate of ``GATE_WORDS`` words) are sorted into a suffix array, ordered by as many words as
a window has. Every test suffix is then binary-searched in it; the range found holds its verbatim matches and
their locations. Words are looked up by 64-bit hashes, and what is found is confirmed by the words' bytes. Matches on one
diagonal, consecutive words of a document and of an item, are one longer match; the longest is kept by document.
Documents are only mapped over: no shuffle, nothing gathered by key. The test set is read in blocks of
``block_bytes`` of text, each broadcast on its own, whatever its size; documents pass through one block after the
other, carrying their hits.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
Windows don't cross rows, on either side.

Defined results: null texts have no words, so no hits; n_hit counts words under any occurrence, once each;
items whose id is null hit words but are not listed; items that share an id count once; repeated documents
repeat; with an empty test table nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.llm.common import ALNUM_SEP, LOWER, gram_hash, packed_rows, text_blocks, trim, words_of
from setloom.shipping import ship

GATE_WORDS = 3
GATE_BITS = 20
#: Bytes of text of a shard.
SHARD = 1 << 20


@dataclass
class TestSuffixes:
    """The distinct windows of a block of test items, by their length, and what the gate needs."""

    vocab: np.ndarray  # sorted word hashes
    windows: dict[int, np.ndarray]  # length -> (n, length) word numbers, sorted rows
    words: dict[int, list[bytes]]  # length -> for each window its words, joined by spaces
    items: dict[int, list[list[str]]]  # length -> for each window the ids of its items
    places: dict[int, list[np.ndarray]]  # length -> for each window its places, (item's row, word)
    gates: dict[int, np.ndarray]  # words in the gate -> sorted hashes
    maps: dict[int, np.ndarray]  # the same as a bitmap of GATE_BITS


def test_suffixes(rows: list[tuple[str | None, str | None]], window: int) -> TestSuffixes:
    texts = pa.array([t for _, t in rows], pa.string())
    hashes: list[np.ndarray] = []
    cut: list[list[bytes]] = []
    for a, b, data, offsets in text_blocks(texts):
        low = LOWER[data]
        starts, ends, counts, h = words_of(low, offsets, ALNUM_SEP)
        hashes += [h[counts[i] : counts[i + 1]] for i in range(b - a)]
        raw, spans = low.tobytes(), list(zip(starts.tolist(), ends.tolist(), strict=True))
        cut += [[raw[x:y] for x, y in spans[counts[i] : counts[i + 1]]] for i in range(b - a)]
    vocab = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    found: dict[int, dict[bytes, tuple[np.ndarray, set[str], list[tuple[int, int]]]]] = {}
    gates: dict[int, list[np.ndarray]] = {}
    for n, ((item, _), h, own) in enumerate(zip(rows, hashes, cut, strict=True)):
        k = min(window, len(h))
        if not k:
            continue
        w = np.lib.stride_tricks.sliding_window_view(np.searchsorted(vocab, h).astype(np.int32), k)
        for j, row in enumerate(w):
            _, ids, places = found.setdefault(k, {}).setdefault(b" ".join(own[j : j + k]), (row, set(), []))
            ids.update([item] if item is not None else [])
            places.append((n, j))
        g = min(GATE_WORDS, k)
        gates.setdefault(g, []).append(gram_hash(h, g)[: len(h) - k + 1])
    windows, words, items, homes = {}, {}, {}, {}
    for k, x in found.items():
        m = np.array([row for row, _, _ in x.values()])
        order = np.lexsort(m.T[::-1]).tolist()
        all_words, rest = list(x), list(x.values())
        windows[k], words[k] = m[order], [all_words[i] for i in order]
        items[k], homes[k] = [sorted(rest[i][1]) for i in order], [np.array(rest[i][2]) for i in order]
    gate = {g: np.unique(np.concatenate(x)) for g, x in gates.items()}
    maps = {}
    for g, x in gate.items():
        maps[g] = np.zeros(1 << GATE_BITS, bool)
        maps[g][x >> np.uint64(64 - GATE_BITS)] = True
    return TestSuffixes(vocab, windows, words, items, homes, gate, maps)


def gate(h: np.ndarray, s: TestSuffixes) -> np.ndarray:
    """Word positions whose next words begin some test window."""
    keep = np.zeros(len(h), bool)
    for g, known in s.gates.items():
        x = gram_hash(h, g)
        at = np.flatnonzero(s.maps[g][x >> np.uint64(64 - GATE_BITS)])
        y = x[at]
        keep[at[known[np.minimum(np.searchsorted(known, y), len(known) - 1)] == y]] = True
    return np.flatnonzero(keep)


def suffix_array(h: np.ndarray, at: np.ndarray, left: np.ndarray, vocab: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` in order of their first ``depth`` words, and those words' numbers.

    left: words from each suffix to its document's end. A word outside ``vocab`` is -1, one past the end -2.
    """
    idx = at[:, None] + np.arange(depth)
    w = h[np.minimum(idx, len(h) - 1)]
    n = np.minimum(np.searchsorted(vocab, w), len(vocab) - 1)
    words = np.where(vocab[n] == w, n, -1).astype(np.int32)
    words[np.arange(depth) >= left[:, None]] = -2
    order = np.lexsort(words.T[::-1])
    return at[order], words[order]


def search(words: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of rows of ``words`` (sorted) that begin with it."""
    k, ends = queries.shape[1], []
    for upper in (False, True):
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(words), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            row = words[np.minimum(mid, len(words) - 1), :k]
            differs = row != queries
            first = differs.argmax(1)
            i = np.arange(len(queries))
            before = row[i, first] < queries[i, first]
            if upper:
                before |= ~differs.any(1)
            lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


def longest_runs(row: np.ndarray, word: np.ndarray, home: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """By document row, the words of the longest match: windows (of ``size`` words at ``word``) that go on along a diagonal of one item."""
    out = np.zeros(n, np.int64)
    if len(row):
        order = np.lexsort((word, size, word - home[:, 1], home[:, 0], row))
        row, word, home, size = row[order], word[order], home[order], size[order]
        on = np.r_[False, (row[1:] == row[:-1]) & (home[1:, 0] == home[:-1, 0]) & (home[1:, 1] - home[:-1, 1] == 1) & (word[1:] - word[:-1] == 1) & (size[1:] == size[:-1])]
        first = np.maximum.accumulate(np.where(on, 0, np.arange(len(on))))
        np.maximum.at(out, row, word - word[first] + size)
    return out


def block_hits(data: np.ndarray, offsets: np.ndarray, s: TestSuffixes) -> tuple[np.ndarray, list[tuple[int, int, int]], list[list[str]], np.ndarray]:
    """A block's word counts by row, its hits as (row, word of the row, length), by row the ids of items with hits and the longest match."""
    low = LOWER[data]
    starts, ends, counts, h = words_of(low, offsets, ALNUM_SEP)
    n = np.diff(counts)
    items: list[set[str]] = [set() for _ in n]
    hits: list[tuple[int, int, int]] = []
    runs: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64))]
    at = gate(h, s) if len(h) else np.zeros(0, np.int64)
    if len(at):
        raw = low.tobytes()
        row = np.searchsorted(counts, at, side="right") - 1
        where, words = suffix_array(h, at, counts[row + 1] - at, s.vocab, max(s.windows))
        for k, queries in s.windows.items():
            lo, hi = search(words, queries)
            for q in np.flatnonzero(hi > lo).tolist():
                own = s.words[k][q]
                pos = np.array([p for p in where[lo[q] : hi[q]].tolist() if b" ".join([raw[x:y] for x, y in zip(starts[p : p + k].tolist(), ends[p : p + k].tolist(), strict=True)]) == own], np.int64)
                r = np.searchsorted(counts, pos, side="right") - 1
                word, home = pos - counts[r], s.places[k][q]
                hits += zip(r.tolist(), word.tolist(), [k] * len(pos), strict=True)
                for i in set(r.tolist()):
                    items[i].update(s.items[k][q])
                runs.append((np.repeat(r, len(home)), np.repeat(word, len(home)), np.tile(home, (len(pos), 1)), np.full(len(pos) * len(home), k)))
    return n, hits, [sorted(x) for x in items], longest_runs(*(np.concatenate(x) for x in zip(*runs, strict=True)), len(n))


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same words; touching spans stay apart from none."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ADDED = T.StructType([T.StructField("bench_words", T.LongType()), T.StructField("bench_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("bench_items", T.ArrayType(T.StringType())), T.StructField("bench_longest", T.LongType())])


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, block_bytes: int = 16 << 20) -> DataFrame:
    """Adds to every row: bench_words (its number of words), bench_spans (word spans of verbatim matches of at
    least a window, joined), bench_items (ids of the items that match) and bench_longest (words of the longest match)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*_ADDED.names)
    names, schema = docs.columns, T.StructType([*docs.schema.fields, *_ADDED.fields])
    # Equal rows once; the ids of one text are dealt over all blocks.
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    size = tests.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(test_suffixes([tuple(r) for r in rows], window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=block == 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n_words, spans, items, longest = [], [], [], []
                for at, to, data, offsets in text_blocks(b.column("text"), SHARD):
                    n, hits, ids, most = block_hits(data, offsets, shared.value)
                    own: list[list[tuple[int, int]]] = [[] for _ in range(to - at)]
                    for r, w, k in hits:
                        own[r].append((w, w + k))
                    n_words += n.tolist()
                    spans += own
                    items += ids
                    longest += most.tolist()
                if not first:
                    for i, (s, x, most) in enumerate(zip(*(b.column(c).to_pylist() for c in _ADDED.names[1:]), strict=True)):
                        spans[i] += [(y["start"], y["end"]) for y in s]
                        items[i], longest[i] = sorted({*items[i], *x}), max(longest[i], most)
                new = [pa.array(n_words, pa.int64()), pa.array([[{"start": x, "end": y} for x, y in join_spans(s)] for s in spans], _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], [*names, *_ADDED.names])
            trim()

        out = out.mapInArrow(run, schema)
    return out


def contaminated():
    """The rule: at least one word in twenty is under a match."""
    hit = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return (hit > 0) & (20 * hit >= F.col("bench_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    packed, unpack = packed_rows(docs)
    return matches(packed, benchmark).where(~contaminated()).select(*unpack)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op10 result: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words)."""
    hit = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return matches(docs.select("doc_id", "text"), benchmark).select("doc_id", F.col("bench_words").alias("n_words"), hit.alias("n_hit"), F.size("bench_items").cast("long").alias("n_items"), F.sha2(F.array_join("bench_items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"), F.col("bench_longest").alias("longest"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = 13) -> dict:
    """Plain Python, for tests: doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated, longest)."""
    import re

    split = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: split.findall((t or "").encode().lower())
    wins: dict[tuple, set] = {}
    tests = [cut(text) for _, text in items]
    for (item, _), w in zip(items, tests, strict=True):
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).update([str(item)] if item is not None else [])
    out = {}
    for doc, text in docs:
        w = cut(text)
        hit, ids = set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if (x := tuple(w[p : p + k])) in wins:
                    hit.update(range(p, p + k))
                    ids |= wins[x]
        longest = 0
        for t in tests:
            ends = [0] * (len(t) + 1)
            for x in w:
                ends = [0, *(ends[j] + 1 if x == y else 0 for j, y in enumerate(t))]
                longest = max([longest, *(n for n in ends if n >= min(window, len(t)))] if t else [longest])
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), longest)
    return out


#: The same rows in DuckDB.
SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS t, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ik AS (SELECT t, item, w, least(13, len(w)) AS k FROM iw WHERE len(w) > 0),
wins AS (SELECT t, i, item, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT t, item, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM ik)),
ks AS (SELECT DISTINCT k FROM wins),
dp AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM dw, ks WHERE len(w) >= k)),
occ AS (SELECT r, p, dp.k, t, i, item FROM dp JOIN wins ON dp.s = wins.s AND dp.k = wins.k),
along AS (SELECT r, max(n) AS longest FROM (SELECT r, max(p) - min(p) + k AS n FROM (SELECT r, t, k, p, p - i AS d, p - row_number() OVER (PARTITION BY r, t, k, p - i ORDER BY p) AS g FROM occ) GROUP BY r, t, k, d, g) GROUP BY r),
words AS (SELECT DISTINCT r, unnest(range(p, p + k)) AS p FROM (SELECT DISTINCT r, p, k FROM occ)),
runs AS (SELECT r, count(*) AS n FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM words) GROUP BY r, g),
hit AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_hit FROM runs GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS ids FROM occ WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0) AS longest
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN along USING (r)
"""
