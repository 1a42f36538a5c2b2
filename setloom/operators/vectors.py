"""Two blocks of cues against each other, by matrix products: the nearest row, the best pair of each two tracks.

Similarities are cosines in double, clipped and rounded to four digits as in ``functions.vectors``; none where a vector
is null or zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of a part of the matrix that is worked on at once.
PART = 1 << 18


def units(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which rows have one."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    there = np.asarray(lists.is_valid())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = np.zeros((len(lists), len(flat) // max(1, int(there.sum()))))
    x[there] = flat.reshape(int(there.sum()), x.shape[1])
    length = np.sqrt((x * x).sum(1))
    good = there & (length > 0)
    x[good] /= length[good, None]
    x[~good] = 0.0
    return x, good


def _rounded(x: np.ndarray) -> np.ndarray:
    """Four digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(np.clip(x, -1.0, 1.0)) * 1e4 + 0.5) / 1e4, x) + 0.0


def _ordered(t: pa.Table, *keys: tuple[str, str]) -> pa.Table:
    return t.take(pc.sort_indices(t, sort_keys=list(keys)))


def _empty(t: pa.Table) -> bool:
    """A group that one side lacks comes without the columns of its rows."""
    return "track_id" not in t.column_names or not t.num_rows


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _same_dimension(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A side without any vector has no columns."""
    d = max(x.shape[1], y.shape[1])
    return tuple(z if z.shape[1] else np.zeros((len(z), d)) for z in (x, y))


def nearest(out: pa.Table, into: pa.Table) -> pa.Table:
    """(cue_id, n, c, s): of each row of ``out`` the number of rows of other tracks, the most similar and its similarity."""
    kinds = {"cue_id": pa.int64(), "n": pa.int64(), "c": pa.int64(), "s": pa.float64()}
    if _empty(out) or _empty(into):
        return pa.schema(kinds).empty_table()
    into = _ordered(into, ("cue_id", "ascending"))
    ids, tracks, cues, others = _column(out, "cue_id"), _column(out, "track_id"), _column(into, "cue_id"), _column(into, "track_id")
    (x, good), (y, fine) = units(out.column("embedding")), units(into.column("embedding"))
    x, y = _same_dimension(x, y)
    by = np.argsort(others, kind="stable")
    low, high = np.searchsorted(others[by], tracks), np.searchsorted(others[by], tracks, "right")
    found: list[tuple] = []
    step = max(1, PART // max(1, len(cues)))
    for a in range(0, len(ids), step):
        s = x[a : a + step] @ y.T
        s[:, ~fine] = -2.0
        s[~good[a : a + step]] = -2.0
        for k, row in enumerate(s):
            own = by[low[a + k] : high[a + k]]
            if len(own) == len(cues):
                continue
            row[own] = -4.0
            top = row.max()
            # Of those that round to the same the first in order of ids.
            near = np.flatnonzero(row >= top - 1.1e-4)
            best = _rounded(top) if top > -2.0 else None
            at = near[0] if best is None else near[(_rounded(row[near]) == best).argmax()]
            found.append((int(ids[a + k]), len(cues) - len(own), int(cues[at]), None if best is None else float(best)))
    return pa.table([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def best_pairs(out: pa.Table, into: pa.Table) -> pa.Table:
    """(src, dst, s, p, q, out_ts, in_ts, similarity, raw): of each two different tracks the pair of rows with the best score.

    Scores count rounded to nine digits (s); of equals the least place of the one goes first, then of the other (p, q).
    """
    kinds = dict(zip(("src", "dst", "s", "p", "q", "out_ts", "in_ts", "similarity", "raw"), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), *[pa.float64()] * 4), strict=True))
    if _empty(out) or _empty(into):
        return pa.schema(kinds).empty_table()
    order = [("track_id", "ascending"), ("pos", "ascending"), ("ts", "descending")]
    out, into = _ordered(out, *order), _ordered(into, *order)
    tracks, others = _column(out, "track_id"), _column(into, "track_id")
    (x, good), (y, fine) = units(out.column("embedding")), units(into.column("embedding"))
    x, y = _same_dimension(x, y)
    trust, trust_in = _column(out, "confidence"), _column(into, "confidence")
    aligned, aligned_in = (t.column("phrase_aligned").to_numpy().astype(bool) for t in (out, into))
    starts = np.flatnonzero(np.r_[True, others[1:] != others[:-1]])
    ends, to = np.r_[starts[1:], len(others)], others[starts]
    step = max(1, PART // len(others))
    parts: list[list[np.ndarray]] = []
    edges = np.flatnonzero(np.r_[True, tracks[1:] != tracks[:-1], True])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        s, i, j, sim, raw = np.full(len(to), -np.inf), *(np.zeros(len(to), np.int64) for _ in range(2)), np.zeros(len(to)), np.zeros(len(to))
        for a in range(lo, hi, step):
            b = min(hi, a + step)
            like = _rounded(x[a:b] @ y.T)
            mean = (trust[a:b, None] + trust_in) / 2.0
            both = aligned[a:b, None] & aligned_in
            score = 0.6 * like + 0.2 * mean + np.where(both, 0.2, 0.0)
            alone = np.ones(score.shape, bool)
            alone[np.ix_(good[a:b], fine)] = False
            if alone.any():
                score[alone] = (0.7 * mean + np.where(both, 0.3, 0.0))[alone]
                like[alone] = np.nan
            key = np.rint(score * 1e9)
            top = np.maximum.reduceat(key, starts, axis=1)
            row, most = top.argmax(0), top.max(0)
            for g in np.flatnonzero(most > s):
                r = row[g]
                c = starts[g] + key[r, starts[g] : ends[g]].argmax()
                s[g], i[g], j[g], sim[g], raw[g] = most[g], a + r, c, like[r, c], score[r, c]
        keep = to != tracks[lo]
        i, j = i[keep], j[keep]
        parts.append([tracks[i], others[j], s[keep] / 1e9, _column(out, "pos")[i], _column(into, "pos")[j], _column(out, "ts")[i], _column(into, "ts")[j], sim[keep], raw[keep]])
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pa.table([pa.array(c, kind, from_pandas=name == "similarity") for c, (name, kind) in zip(columns, kinds.items(), strict=True)], list(kinds))
