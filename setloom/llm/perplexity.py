"""Operator 6, quality classifier: an interpolated modified Kneser-Ney model of byte 5-grams over trusted text.

Counts come from every trusted document. Lower orders hold continuation counts; each order has its three discounts
from its counts of counts, and each history its left-over mass. All of it, and the probability of every 5-gram that
any document has, is made by joins and aggregations sharded by n-gram, whatever the vocabulary's size.

Documents travel in packed blocks. A block asks for its distinct 5-grams; the answers, joined from the probability
table by n-gram, return by block and meet the block's compressed text, so that each document's whole text gets its
mean log probability. A block is a run of a task's rows, cut by their bytes alone, however the rows come in batches,
and is named by its first row; an n-gram without an answer is an error, never another n-gram's probability. Perplexities over the quantile of trusted documents of the same language are rejected; the
quantiles are read from histograms of thousandths of the log, counted per language.

Defined results: null and empty texts have no perplexity and are not kept; a null language is a language of its own
(``und``), and one with fewer than ``min_trusted`` trusted documents takes the quantile of all; without any trusted
document every perplexity is that of the uniform model and every text with a word is kept; equal rows are scored
equally. The input must be re-readable in the same order (files or a staged table).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setloom.llm.common import checkpoint, stage, text_blocks, text_buffers, with_row_id

ORDER = 5
#: Bytes of text in a block: large, since a block asks for each of its distinct n-grams once.
BLOCK = 32 << 20
#: Positions whose n-grams are made at once.
PIECE = 1 << 20
BOS = 0xFF
#: Symbols of the uniform model below unigrams.
SYMBOLS = 256.0
#: Trusted ids up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> Iterator[tuple[int, np.ndarray]]:
    """The n-gram that ends at each byte, as one integer, in pieces (first position, n-grams).

    Begin-of-text symbols stand before each row.
    """
    for a in range(0, len(data), PIECE):
        at = np.arange(a, min(a + PIECE, len(data)))
        into = at - offsets[np.searchsorted(offsets, at, side="right") - 1]
        out = np.zeros(len(at), np.int64)
        for j in range(order):
            out |= np.where(into >= j, data[np.maximum(at - j, 0)], BOS).astype(np.int64) << (8 * j)
        yield a, out


def distinct_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([*(np.unique(g) for _, g in grams(data, offsets)), np.zeros(0, np.int64)]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, offsets in text_blocks(b.column("text"), BLOCK):
            got = [np.unique(g, return_counts=True) for _, g in grams(data, offsets)]
            if got:
                g, back = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
                n = np.bincount(back, np.concatenate([y for _, y in got]))
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "a"])


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts."""
    n = table.agg(*[F.count_if(F.col("a") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _discount(a: Column, d: tuple[float, float, float]) -> Column:
    return F.when(a == 1, F.lit(d[0])).when(a == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def _suffix(order: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << (8 * order)) - 1))


def counts(trusted: DataFrame) -> list[DataFrame]:
    """By order from 1: (g, a), a the count at the highest order and the continuation count below."""
    top = trusted.select("text").mapInArrow(_count, "g long, a long").groupBy("g").agg(F.sum("a").alias("a"))
    tables = [stage(top, "ngrams")]
    for k in range(ORDER - 1, 0, -1):
        tables.append(checkpoint(tables[-1].groupBy(_suffix(k).alias("g")).agg(F.count(F.lit(1)).alias("a"))))
    return tables[::-1]


def probabilities(tables: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """(g, lp): the log probability of each wanted n-gram of the highest order, by interpolation from the lowest up."""
    below: DataFrame | None = None
    for k, table in enumerate(tables, 1):
        d = _discounts(table)
        a = F.col("a")
        hist = table.groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("a").cast("double").alias("total"), F.sum(_discount(a, d)).alias("left"))
        own = wanted.select(_suffix(k).alias("g")).distinct().withColumn("h", F.shiftright("g", 8))
        own = own.join(table, "g", "left").join(hist, "h", "left")
        lower = F.lit(1.0 / SYMBOLS) if below is None else F.col("p0")
        if below is not None:
            own = own.withColumn("s", _suffix(k - 1)).join(below, "s")
        seen = F.when(a.isNotNull(), F.greatest(a - _discount(a, d), F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0))
        p = F.when(F.col("total").isNull(), lower).otherwise(seen + F.col("left") / F.col("total") * lower)
        # Sizes: at most the wanted n-grams; cut so that orders don't nest.
        below = checkpoint(own.select(F.col("g").alias("s"), p.alias("p0")))
    return below.select(F.col("s").alias("g"), F.log("p0").alias("lp"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row ids, bytes and offsets of a task's blocks: rows up to BLOCK bytes, or one row of more, across batches."""
    ids: list[int] = []
    texts: list[np.ndarray] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(ids, np.int64), np.concatenate(texts), np.cumsum([0, *map(len, texts)])

    for b in batches:
        raw, offsets = text_buffers(b.column("text"))
        for row, x, y in zip(b.column("_sl_row").to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
            if ids and size + y - x > BLOCK:
                yield block()
                ids, texts, size = [], [], 0
            ids.append(row)
            texts.append(raw[x:y].copy())
            size += y - x
    if ids:
        yield block()


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, offsets in _blocks(batches):
        g = distinct_grams(data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), ids[0])), pa.array(g)], ["block", "g"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, offsets in _blocks(batches):
        blob = zstandard.ZstdCompressor(3).compress(data.tobytes())
        cols = [pa.array([ids[0]]), pa.array([blob], pa.binary()), pa.array([offsets], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["block", "blob", "offsets", "rows"])


def _answer(texts: pa.Table, table: pa.Table) -> pa.Table:
    rows, total, size = [], [], []
    g, lp = table["g"].to_numpy(), table["lp"].to_numpy()
    order = np.argsort(g)
    g, lp = g[order], lp[order]
    if not len(texts):
        raise ValueError("answers came back to a block that no text is in")
    for blob, offsets, ids in zip(texts["blob"], texts["offsets"], texts["rows"], strict=True):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint8) if len(blob.as_py()) else np.zeros(0, np.uint8)
        offs = np.asarray(offsets.as_py(), np.int64)
        sums = np.zeros(len(offs) - 1)
        for first, x in grams(data, offs):
            at = np.minimum(np.searchsorted(g, x), max(0, len(g) - 1))
            if not len(g) or (g[at] != x).any():
                raise ValueError("a block has an n-gram that it didn't ask for")
            c = np.concatenate([[0.0], np.cumsum(lp[at])])
            lo, hi = np.clip(offs[:-1] - first, 0, len(x)), np.clip(offs[1:] - first, 0, len(x))
            sums += c[hi] - c[lo]
        rows += ids.as_py()
        total.append(sums)
        size.append(np.diff(offs))
    return pa.table({"_sl_row": pa.array(rows, pa.int64()), "lp": np.concatenate([*total, np.zeros(0)]), "n_bytes": np.concatenate([*size, np.zeros(0, np.int64)])})


def score(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(_sl_row, n_bytes, log_perplexity) of every row of ``docs`` (_sl_row, text), by a model of the texts of ``trusted``."""
    slim = docs.select("_sl_row", "text")
    asked = slim.mapInArrow(_ask, "block long, g long")
    # The distinct ones of all blocks; each gets its probability once, and goes back to the blocks that asked.
    wanted = stage(asked.select("g").distinct(), "ngrams-wanted")
    known = probabilities(counts(trusted), wanted)
    answers = asked.join(known, "g").select("block", "g", "lp")
    packed = slim.mapInArrow(_pack, "block long, blob binary, offsets array<long>, rows array<long>")
    found = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer, "_sl_row long, lp double, n_bytes long")
    return found.select("_sl_row", "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("lp") / F.col("n_bytes")).alias("log_perplexity"))


def thresholds(scored: DataFrame, quantile: float, min_trusted: int) -> DataFrame:
    """(lang, limit) from rows (lang, log_perplexity) of trusted documents; a null lang stands for all languages.

    The windows are over a language's histogram: some thousand bins, however many documents.
    """
    bins = scored.where("log_perplexity is not null").groupBy("lang", F.ceil(F.col("log_perplexity") * 1000).alias("bin")).count()
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(None).cast("string")))
    by = Window.partitionBy("lang")
    below = bins.withColumn("c", F.sum("count").over(by.orderBy("bin"))).withColumn("n", F.sum("count").over(by))
    picked = below.where(F.col("c") >= F.ceil(F.lit(quantile) * F.col("n"))).groupBy("lang").agg(F.min("bin").alias("bin"), F.first("n").alias("n"))
    return picked.where(F.col("lang").isNull() | (F.col("n") >= min_trusted)).select("lang", (F.col("bin") / 1000.0).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.999, min_trusted: int = 200, margin: float = 0.05) -> DataFrame:
    """The op6 result: doc_id, lang, n_bytes, perplexity (a byte), limit and kept.

    Trusted are the documents that ``labels`` gives quality 1. A language's limit is the quantile of its trusted
    documents' log perplexities, plus ``margin``.
    """
    rows = with_row_id(docs.select("doc_id", "text", F.coalesce("lang", F.lit("und")).alias("lang")))
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    trusted = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    scored = stage(score(rows, trusted), "perplexity")
    named = rows.select("_sl_row", "doc_id", "lang").join(scored, "_sl_row")
    limits = thresholds(named.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("lang", "log_perplexity"), quantile, min_trusted)
    # One row a language, and one for all; the languages of a corpus are few, and a join bears any number.
    every = limits.where("lang is null").select(F.col("limit").alias("limit_all"))
    out = named.join(limits.where("lang is not null"), "lang", "left").crossJoin(F.broadcast(every.agg(F.max("limit_all").alias("limit_all"))))
    limit = F.coalesce("limit", "limit_all", F.lit(float(np.log(SYMBOLS)))) + F.lit(margin)
    return out.select("doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), F.exp(limit).alias("limit"), F.coalesce(F.col("log_perplexity") <= limit, F.lit(False)).alias("kept"))


def brute_force(texts: list[str], trusted: list[str], order: int = ORDER) -> list[float | None]:
    """Plain Python, for tests: the log perplexity of each text."""
    from collections import Counter, defaultdict

    def cut(t: str, k: int) -> list[bytes]:
        raw = bytes([BOS] * (order - 1)) + t.encode()
        return [raw[i - k + 1 : i + 1] for i in range(order - 1, len(raw))]

    tables: dict[int, Counter] = {order: Counter(g for t in trusted for g in cut(t, order))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    ds, hist = {}, {}
    for k, t in tables.items():
        n = [sum(1 for v in t.values() if v == i) for i in range(1, 5)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            ds[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
        else:
            ds[k] = [0.5, 0.75, 0.9]
        hist[k] = defaultdict(lambda: [0.0, 0.0])
        for g, a in t.items():
            x = hist[k][g[:-1]]
            x[0] += a
            x[1] += ds[k][min(a, 3) - 1]

    def p(g: bytes) -> float:
        lower = p(g[1:]) if len(g) > 1 else 1 / SYMBOLS
        k = len(g)
        if g[:-1] not in hist[k]:
            return lower
        total, left = hist[k][g[:-1]]
        a = tables[k].get(g, 0)
        return (max(a - ds[k][min(a, 3) - 1], 0.0) / total if a else 0.0) + left / total * lower

    out = []
    for t in texts:
        g = cut(t, order) if t else []
        out.append(-sum(float(np.log(p(x))) for x in g) / len(g) if g else None)
    return out
