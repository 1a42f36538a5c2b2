"""Operator 4, toxicity: a linear-chain conditional random field tags toxic words; marginals score the document.

Words are runs of letters and digits (A-Z lower-cased); each has hashed features: itself, its first 3 to 8 bytes,
its last 4 and 5. Labels are of documents only, so the labelled tokens are made from them: a feature that stands in
clearly more toxic documents than others (a z test on document frequencies) marks words of toxic documents as toxic;
all words of other documents are labelled clean. The chain (two states, feature weights, transitions) is trained on
windows around marked words, the same features in clean documents and random places, by gradient descent in numpy.

Forward-backward gives every word's marginal. A document's score is a logistic function, fitted on the training
documents with their sampling weights, of its sum, mean and largest marginal and its length. Words with a marginal
of a half or more, joined, are the offending spans. The scan of a block is exact and vectorised: rows of words are
run for both states before them at once, and the rows' 2 x 2 products are then chained.

Training reads a bounded sample: ``max_train_docs`` in expectation, toxic ones first, and ``max_train_bytes``.
Prediction is a map over the rows.

Defined results: null and empty texts have no words and get the score of such a text, never null; labels that are
null are not learned from; several labels of one id count as toxic if one does; without any toxic label, or any
other, all scores are 0; repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import ALNUM_SEP, LOWER, bucket_of, mix64, powers, prefix_hash, text_blocks, words_of
from setloom.shipping import ship

BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)
SUFFIXES = (4, 5)
ROW = 64
WINDOW = 32


@dataclass
class ToxicModel:
    weights: np.ndarray  # by feature bucket: toxic less clean
    trans: np.ndarray  # 2 x 2 log potentials
    doc: np.ndarray  # logistic coefficients
    mean: np.ndarray
    scale: np.ndarray


def token_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature buckets of each word, (features, words); bucket 0 stands for a feature the word is too short for."""
    p = prefix_hash(low)
    _, down = powers(len(low) + 1)
    base, size = down[starts], ends - starts
    out = np.zeros((1 + len(PREFIXES) + len(SUFFIXES), len(starts)), np.int32)

    def put(i: int, a: np.ndarray, b: np.ndarray, scale: np.ndarray, ok: np.ndarray) -> None:
        h = mix64((p[b] - p[a]) * scale + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1))
        out[i] = np.where(ok, np.maximum(h >> np.uint64(64 - BITS), 1), 0)

    put(0, starts, ends, base, size > 0)
    for i, k in enumerate(PREFIXES, 1):
        put(i, starts, np.minimum(starts + k, ends), base, size > k)
    for i, k in enumerate(SUFFIXES, 1 + len(PREFIXES)):
        a = np.maximum(ends - k, starts)
        put(i, a, ends, down[a], size > k)
    return out


def _run(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Normalised messages of a chain of n positions: m[t] ~ (m[t - 1] @ step[t]) * emit[t]; step[0] from even states."""
    n = len(emit)
    rows = -(-n // ROW)
    pad = rows * ROW - n
    e = np.concatenate([emit, np.ones((pad, 2))]).reshape(rows, ROW, 2)
    s = np.concatenate([step, np.broadcast_to(np.eye(2), (pad, 2, 2))]).reshape(rows, ROW, 2, 2)
    got = np.empty((rows, ROW, 2, 2))  # state before the row, state now
    now = np.broadcast_to(np.eye(2), (rows, 2, 2))
    for t in range(ROW):
        now = (now[:, :, :1] * s[:, t, None, 0] + now[:, :, 1:] * s[:, t, None, 1]) * e[:, t, None, :]
        now = now / now.sum((1, 2), keepdims=True)
        got[:, t] = now
    enter, x, y = np.empty((rows, 2)), 0.5, 0.5
    for r, ((a, b), (c, d)) in enumerate(got[:, -1].tolist()):
        enter[r] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    out = (enter[:, None, :1] * got[:, :, 0] + enter[:, None, 1:] * got[:, :, 1]).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True)


def marginals(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The probability of the toxic state of each word; ``emit`` are log odds, chains are counts[i] .. counts[i + 1]."""
    return forward_backward(emit, counts, trans, pairs=False)[0]


def forward_backward(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray, *, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the words, and with ``pairs`` (n, 2, 2) of the pairs of states of each word and the one before (zero at a chain's first)."""
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    phi = 1 / (1 + np.exp(-np.clip(emit, -30, 30)))
    phi = np.stack([1 - phi, phi], 1)
    a = np.exp(trans - trans.max())
    begin = np.zeros(n + 1, bool)
    begin[counts] = True
    free = np.full((2, 2), 0.5)
    alpha = _run(phi, np.where(begin[:n, None, None], free, a))
    # Backward: beta[t] ~ a @ (phi[t + 1] * beta[t + 1]), so phi * beta is the same kind of run over the reversed chain.
    back = _run(phi[::-1], np.where(begin[1:][::-1, None, None], free, a.T))[::-1]
    beta = back / phi
    m = alpha * beta
    if not pairs:
        return m[:, 1] / m.sum(1), np.zeros((0, 2, 2))
    pair = np.zeros((n, 2, 2))
    pair[1:] = alpha[:-1, :, None] * a * back[1:, None, :]
    pair[begin[:n]] = 0.0
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return m[:, 1] / m.sum(1), pair


def block_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, counts, _ = words_of(low, offsets, ALNUM_SEP, hashes=False)
    return starts, ends, counts, token_features(low, starts, ends)


def doc_features(m: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document: log of 1 + sum of marginals, their mean (per hundred words), the largest, log of 1 + words."""
    n = np.diff(counts)
    c = np.concatenate([[0.0], np.cumsum(m)])
    total = np.maximum(c[counts[1:]] - c[counts[:-1]], 0.0)
    top = np.zeros(len(n))
    if len(m):
        at = np.minimum(counts[:-1], len(m) - 1)
        top = np.where(n > 0, np.maximum.reduceat(m, at), 0.0)
    # A clean document's marginals are small but many; a word counts by how much it exceeds chance.
    sharp = np.concatenate([[0.0], np.cumsum(m >= 0.5)])
    hits = sharp[counts[1:]] - sharp[counts[:-1]]
    return np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(n, 1)), top, np.log1p(n), np.log1p(hits)], 1)


def _indicative(feats: list[np.ndarray], y: np.ndarray, z: float, share: float) -> np.ndarray:
    """Buckets in clearly more toxic documents than others."""
    df = np.zeros((2, 1 << BITS))
    for f, t in zip(feats, y, strict=True):
        df[t, np.unique(f)] += 1
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    p = df / n[:, None]
    pool = df.sum(0) / n.sum()
    score = (p[1] - p[0]) / np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / n).sum())
    out = (score > z) & (p[1] > share * (p[0] + p[1])) & (df[1] >= 4)
    out[0] = False
    return out


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, *, z: float = 4.0, share: float = 0.7, epochs: int = 8, rate: float = 0.3, seed: int = 4) -> ToxicModel:
    """Trains on whole texts; ``weight`` is how many documents each stands for."""
    feats: list[np.ndarray] = []
    for a, b, data, offsets in text_blocks(pa.array(texts, pa.string())):
        _, _, counts, f = block_tokens(data, offsets)
        feats += [f[:, counts[i] : counts[i + 1]] for i in range(b - a)]
    marked = _indicative(feats, y, z, share)
    rng = np.random.default_rng(seed)
    wins, labels = [], []
    for f, t in zip(feats, y, strict=True):
        n = f.shape[1]
        if n == 0:
            continue
        hit = marked[f].any(0)
        at = np.flatnonzero(hit)
        at = rng.choice(at, min(len(at), 12), replace=False) if len(at) else at
        for c in [*at.tolist(), *rng.integers(0, n, 1 if t else 3).tolist()]:
            lo = max(0, min(c - WINDOW // 2, n - WINDOW))
            w, lab = np.zeros((f.shape[0], WINDOW), np.int32), np.full(WINDOW, -1)
            k = min(WINDOW, n - lo)
            w[:, :k], lab[:k] = f[:, lo : lo + k], hit[lo : lo + k] & bool(t)
            wins.append(w)
            labels.append(lab)
    weights, trans = np.zeros(1 << BITS), np.array([[1.0, -1.0], [0.0, 0.0]])
    if wins:
        x, lab = np.array(wins), np.array(labels)
        grad2, tgrad2 = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(epochs):
            for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                f, t = x[i], lab[i]
                emit = weights[f].sum(1)
                emit[t < 0] = 0.0
                flat = np.arange(len(i) + 1) * WINDOW
                m, pair = forward_backward(emit.reshape(-1), flat, trans)
                m, pair = m.reshape(t.shape), pair.reshape(*t.shape, 2, 2)
                g = np.where(t < 0, 0.0, m - t) / len(i)
                gw = np.bincount(f.reshape(-1), np.repeat(g[:, None], f.shape[1], 1).reshape(-1), minlength=1 << BITS)
                gw[0] = 0.0
                grad2 += gw * gw
                weights -= rate * gw / np.sqrt(grad2)
                # Transitions: expected pairs of states, from forward-backward, less the pairs seen.
                ok = (t[:, 1:] >= 0) & (t[:, :-1] >= 0)
                seen = np.stack([t <= 0, t == 1], 2)
                gt = (np.einsum("btij,bt->ij", pair[:, 1:], ok) - np.einsum("bti,btj,bt->ij", seen[:, :-1], seen[:, 1:], ok)) / len(i)
                tgrad2 += gt * gt
                trans = trans - 0.05 * gt / np.sqrt(tgrad2)
    model = ToxicModel(weights.astype(np.float32), trans, np.zeros(6), np.zeros(5), np.ones(5))
    rows = np.concatenate([doc_features(marginals(weights[f].sum(0), np.array([0, f.shape[1]]), trans), np.array([0, f.shape[1]])) for f in feats])
    model.mean, model.scale = rows.mean(0), rows.std(0) + 1e-6
    model.doc = _logistic(np.c_[(rows - model.mean) / model.scale, np.ones(len(rows))], y, weight)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -5, 5)
    return w


def block_scores(data: np.ndarray, offsets: np.ndarray, model: ToxicModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a block's rows; and of its words the starts, ends, rows' counts and marginals."""
    starts, ends, counts, f = block_tokens(data, offsets)
    emit = np.zeros(len(starts))
    for x in f:
        emit += model.weights[x]
    m = marginals(emit, counts, model.trans)
    x = np.c_[(doc_features(m, counts) - model.mean) / model.scale, np.ones(len(offsets) - 1)]
    return 1 / (1 + np.exp(-np.clip(x @ model.doc, -30, 30))), starts, ends, counts, m


def spans(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, m: np.ndarray) -> list[list[dict]]:
    """By row, the joined runs of toxic words as character offsets, with their largest marginal."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for r in range(len(offsets) - 1):
        own: list[dict] = []
        for w in (np.flatnonzero(m[counts[r] : counts[r + 1]] >= 0.5) + counts[r]).tolist():
            a, b = int(chars[starts[w]] - chars[offsets[r]]), int(chars[ends[w]] - chars[offsets[r]])
            if own and w == own[-1]["w"] + 1:
                own[-1] |= {"end": b, "score": max(own[-1]["score"], float(m[w])), "w": w}
            else:
                own.append({"start": a, "end": b, "score": float(m[w]), "w": w})
        out.append([{k: v for k, v in x.items() if k != "w"} for x in own])
    return out


def train(docs: DataFrame, labels: DataFrame, *, max_train_docs: int = 3000, max_train_bytes: int = 24 << 20) -> ToxicModel | None:
    """Learns from labelled documents (doc_id, text; doc_id, toxic), of which a bounded sample comes to the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    have = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not have.get(0) or not have.get(1):
        return None
    toxic = min(have[1], max_train_docs // 3)
    share = {1: toxic / have[1], 0: min(1.0, (max_train_docs - toxic) / have[0])}
    u = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    picked = known.withColumn("u", u).where(F.col("u") < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    # The sample's size is bounded by max_train_docs, so its ids may be broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = min(1.0, max_train_bytes / max(1, size))
    keep = F.col("u") < part * F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    rows = sample.where(keep).orderBy("doc_id", "text").select("text", "toxic").toArrow()
    y = np.array(rows["toxic"].to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return None
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    return fit(rows["text"].to_pylist(), y, weight / weight.mean())


def score(docs: DataFrame, model: ToxicModel | None, *, with_spans: bool = True) -> DataFrame:
    """doc_id, toxicity and toxic_spans (start, end in characters, largest marginal) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, found = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            if shared.value is not None:
                for at, to, data, offsets in text_blocks(b.column("text")):
                    scores[at:to], *words = block_scores(data, offsets, shared.value)
                    if with_spans:
                        found[at:to] = spans(data, offsets, *words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(found, kind)], ["doc_id", "toxicity", "toxic_spans"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, toxicity double, toxic_spans array<struct<start:long,end:long,score:double>>")


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The op4 result, with the offending spans in characters: trained on rows whose crc32(doc_id as text) mod 5 is not 0."""
    model = train(docs, labels.where(bucket_of(5) != 0), **options)
    held = F.coalesce(bucket_of(5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"), F.transform("toxic_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
