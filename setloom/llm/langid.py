"""Operator 8, language ID: averaged hashed subword embeddings with a linear softmax.

Every text is the average of the embeddings of its hashed byte n-grams (2 to 4 bytes of the text with A-Z
lower-cased and everything that is no letter made a space); a linear layer and a softmax give the language.
The model is trained by stochastic gradient descent in numpy on the driver, over a bounded sample of labelled
rows (``docs_per_lang`` of each language in expectation, drawn by hash), whose n-gram counts are made on executors.
A temperature and a rejection threshold (the score below which ``false_reject`` of the rightly named examples lie) are
fitted on a part of the sample that training leaves out.

At prediction embedding and linear layer fold into one table (bucket x language), so that a text costs one
lookup per n-gram; the work is a map over the rows, with no shuffle.

Defined results: a null text, or one with no letter (a character of category L), is ``und`` with score 0 and is rejected; with no labelled
row at all every text is ``und``; null ids and null labels are never learned from; equal rows are predicted
equally; empty tables give empty results.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.llm.common import bucket_of, packed_rows, per_row, separators, text_blocks, trim
from setloom.shipping import ship

BUCKET_BITS = 15
SIZES = (2, 3, 4)
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = separators([*range(65, 91), *range(97, 123)])
#: ASCII bytes that are no letter become a space; bytes of other characters stay.
_FOLD = np.array([b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256)], np.uint32)


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # bucket x language, float32
    bias: np.ndarray
    temperature: float
    threshold: float


def subword_buckets(data: np.ndarray) -> list[np.ndarray]:
    """Hashed buckets of the n-grams that start at each byte, one array a size (shorter by size - 1)."""
    x = _FOLD[data]
    out, h = [], x * np.uint32(0x01000193) + np.uint32(0x9DC5)
    for k in range(2, max(SIZES) + 1):
        h = (h[: len(x) - k + 1] * np.uint32(0x01000193)) ^ (x[k - 1 :] * np.uint32(0x85EBCA6B))
        if k in SIZES:
            g = h * np.uint32(0x9E3779B1)
            out.append(((g ^ (g >> np.uint32(15))) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
    return out


def block_sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block: the sum of the table's rows over its n-grams, and their number."""
    n = len(offsets) - 1
    sums, counts = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
    for k, g in zip(SIZES, subword_buckets(data), strict=True):
        # n-grams within a row only: starts offsets[i] .. offsets[i + 1] - k
        lo, hi = np.minimum(offsets[:-1], len(g)), np.clip(offsets[1:] - k + 1, 0, len(g))
        hi = np.maximum(hi, lo)
        counts += hi - lo
        for c in range(table.shape[1]):
            s = np.zeros(len(g) + 1)
            np.cumsum(table[:, c][g], out=s[1:])
            sums[:, c] += s[hi] - s[lo]
    return sums, counts


def _count_rows(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"lang": [], "part": [], "u": [], "buckets": [], "weights": []}
        langs, keys = b.column("lang").to_pylist(), b.column("u").to_pylist()
        for i, text in enumerate(b.column("text").to_pylist()):
            raw = (text or "").encode()
            at = int(keys[i] * 1e9) % max(1, len(raw) - segment)
            for part, piece in ((0, raw), (1, raw[at : at + segment])):
                g = subword_buckets(np.frombuffer(piece, np.uint8))
                ids, n = np.unique(np.concatenate(g), return_counts=True)
                if len(ids):
                    out["lang"].append(langs[i])
                    out["part"].append(part)
                    out["u"].append(keys[i])
                    out["buckets"].append(ids.astype(np.int32))
                    out["weights"].append((n / n.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["part"], pa.int32()), pa.array(out["u"], pa.float64()), pa.array(out["buckets"], pa.list_(pa.int32())), pa.array(out["weights"], pa.list_(pa.float32()))], ["lang", "part", "u", "buckets", "weights"])


def train(labelled: DataFrame, *, docs_per_lang: int = 400, segment: int = 80, dim: int = 16, epochs: int = 12, rate: float = 1.0, false_reject: float = 0.001, seed: int = 8) -> LangModel | None:
    """Learns from rows (text, lang, u), u uniform in [0, 1) by row. ``docs_per_lang`` rows of each language, in expectation, reach the driver.

    Of each sampled row two examples are made, the whole text and a piece of ``segment`` bytes, so that short
    texts are learned too. Every language of the labels is learned.
    """
    ship(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    freq = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not freq:
        return None
    # No sort, no single task.
    rate_of = F.create_map(*[x for k, v in freq.items() for x in (F.lit(k), F.lit(docs_per_lang / v))])
    rows = labelled.where(F.col("u") < rate_of[F.col("lang")]).select("text", "lang", "u").mapInArrow(lambda it: _count_rows(it, segment), "lang string, part int, u double, buckets array<int>, weights array<float>").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("part", "ascending"), ("u", "ascending"), ("lang", "ascending")])
    langs = sorted(freq)
    y = np.array([langs.index(x) for x in rows["lang"].to_pylist()])
    ids = [np.asarray(x.values) for x in rows["buckets"]]
    ws = [np.asarray(x.values) for x in rows["weights"]]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    used = used if len(used) else order
    size, n = 1 << BUCKET_BITS, len(langs)
    emb = rng.normal(0, 1 / dim, (size, dim)).astype(np.float32)
    lin, bias = np.zeros((dim, n), np.float32), np.zeros(n, np.float32)
    lin += rng.normal(0, 0.1, lin.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):
            h = ws[i] @ emb[ids[i]]
            z = h @ lin + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = lin @ p
            lin -= step * np.outer(h, p)
            bias -= 0.1 * step * p
            emb[ids[i]] -= (step * len(ids[i]) ** 0.5) * ws[i][:, None] * g
    folded = (emb @ lin).astype(np.float32)
    z = np.array([ws[i] @ folded[ids[i]] + bias for i in (held if len(held) else used)])
    t = y[held if len(held) else used]
    best = min((_nll(z / k, t), k) for k in np.geomspace(0.05, 8, 40))
    p = _softmax(z / best[1])
    right = np.sort(p.max(1)[p.argmax(1) == t])
    low = float(np.quantile(right, false_reject)) if len(right) else 1.0
    return LangModel(langs, folded, bias, float(best[1]), low)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _nll(z: np.ndarray, t: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(t)), t] + 1e-12).mean())


def predict_texts(col: pa.Array, model: LangModel | None) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of an Arrow column."""
    n = len(col)
    lang, score, rejected = np.full(n, UND, object), np.zeros(n), np.ones(n, bool)
    if model is None:
        return list(lang), score, rejected
    lettered = np.zeros(n, bool)  # with an ASCII letter; the others are looked at one by one
    for a, b, data, offsets in text_blocks(col):
        lettered[a:b] = per_row(_ASCII_LETTER[data], offsets) > 0
        sums, counts = block_sums(data, offsets, model.table)
        p = _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature)
        best = p.argmax(1)
        lang[a:b] = np.array(model.langs, object)[best]
        score[a:b] = p[np.arange(b - a), best]
    score = np.clip(score, 0.0, 1.0)
    rejected = score < model.threshold
    for i in np.flatnonzero(~lettered).tolist():
        if not _LETTER.search(col[i].as_py() or ""):
            lang[i], score[i], rejected[i] = UND, 0.0, True
    return list(lang), score, rejected


def brute_force(text: str | None, model: LangModel) -> tuple[str, float]:
    """Plain Python, for tests: language and score of a text, n-gram by n-gram."""
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return UND, 0.0
    raw = [b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in text.encode()]
    total, n = [0.0] * len(model.langs), 0
    for k in SIZES:
        for i in range(len(raw) - k + 1):
            h = (raw[i] * 0x01000193 + 0x9DC5) % (1 << 32)
            for x in raw[i + 1 : i + k]:
                h = (h * 0x01000193 % (1 << 32)) ^ (x * 0x85EBCA6B % (1 << 32))
            g = h * 0x9E3779B1 % (1 << 32)
            row = model.table[(g ^ g >> 15) >> 32 - BUCKET_BITS]
            total, n = [a + float(b) for a, b in zip(total, row, strict=True)], n + 1
    z = [(a / max(n, 1) + float(b)) / model.temperature for a, b in zip(total, model.bias, strict=True)]
    p = [math.exp(x - max(z)) for x in z]
    best = p.index(max(p))
    return model.langs[best], p[best] / sum(p)


def identify(docs: DataFrame, model: LangModel | None, *, text: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score and lang_rejected to every row of ``docs``; all other columns stay as they are."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    added = ("lang_pred", "lang_score", "lang_rejected")
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = predict_texts(b.column(text), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*b.schema.names, *added])
        trim()

    return docs.mapInArrow(run, schema)


def fit_documents(docs: DataFrame, **options) -> LangModel | None:
    """A model from the documents whose crc32(doc_id as text) mod 4 is not 2."""
    u = (F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40)))
    return train(docs.where(bucket_of(4) != 2).select("text", "lang", u.alias("u")), **options)


def lang_id(docs: DataFrame, **options) -> DataFrame:
    """The op8 result: doc_id, held_out, lang_pred, score, rejected."""
    model = fit_documents(docs, **options)
    slim = docs.select("doc_id", F.coalesce(bucket_of(4) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(slim, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the documents that language ID doesn't reject, with the columns they came with."""
    model = fit_documents(docs, **options)
    packed, unpack = packed_rows(docs)
    return identify(packed, model).where(~F.col("lang_rejected")).select(*unpack)
