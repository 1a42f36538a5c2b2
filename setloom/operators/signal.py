"""Signals: equaliser coefficients, limiting, decomposition of spectra, JSON track lists, splice order, scheduling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from setloom.functions.text import licence_code
from setloom.operators.graph import compat_edges
from setloom.registry import ORACLES, query, sql_query


def shelf(rate: Column, corner: Column, gain_db: Column, *, high: bool, slope: float = 0.7) -> dict[str, Column]:
    """The six coefficients of a low or high shelf, by the audio cookbook's formulas, divided by a0."""
    a = F.pow(F.lit(10.0), gain_db / 40.0)
    w = 2.0 * F.pi() * corner / rate
    s = -1.0 if high else 1.0
    bend = F.sqrt(a) * F.sin(w) * F.sqrt((a + 1.0 / a) * (1.0 / slope - 1.0) + 2.0)
    up, down, c = a + 1.0, a - 1.0, F.cos(w)
    a0 = up + s * down * c + bend
    return {
        "b0": a * (up - s * down * c + bend) / a0,
        "b1": s * 2.0 * a * (down - s * up * c) / a0,
        "b2": a * (up - s * down * c - bend) / a0,
        "a1": s * -2.0 * (down + s * up * c) / a0,
        "a2": (up + s * down * c - bend) / a0,
    }


_G = "(SELECT track_id, power(10e0, g / 40e0) AS a, 2e0 * pi() * 200e0 / 44100e0 AS w FROM (SELECT track_id, CAST(track_id % 25 AS DOUBLE) - 12e0 AS g FROM v_tracks) g)"


@query(
    "shelf_coefficients",
    f"""SELECT track_id, round(a * (a + 1e0 - (a - 1e0) * cos(w) + t) / n, 8) AS b0, round(2e0 * a * (a - 1e0 - (a + 1e0) * cos(w)) / n, 8) AS b1, round(a * (a + 1e0 - (a - 1e0) * cos(w) - t) / n, 8) AS b2,
 round(-2e0 * (a - 1e0 + (a + 1e0) * cos(w)) / n, 8) AS a1, round((a + 1e0 + (a - 1e0) * cos(w) - t) / n, 8) AS a2 FROM (SELECT *, a + 1e0 + (a - 1e0) * cos(w) + t AS n FROM (SELECT *, sqrt(a) * sin(w) * sqrt((a + 1e0 / a) * (1e0 / 0.7e0 - 1e0) + 2e0) AS t FROM {_G}) x) y""",
)
def shelf_coefficients(v) -> DataFrame:
    c = shelf(F.lit(44100.0), F.lit(200.0), F.col("track_id") % 25 - 12.0, high=False)
    return v["tracks"].select("track_id", *[F.round(x, 8).alias(k) for k, x in c.items()])


def limit_series(level: np.ndarray, ceiling: float = 0.95, ahead: int = 3, release: float = 0.2) -> np.ndarray:
    """Gains that keep a series of peaks under a ceiling: down at once for what is ahead, up again by a share a step."""
    padded = np.concatenate([level, np.zeros(ahead)])
    peak = np.lib.stride_tricks.sliding_window_view(padded, ahead + 1).max(1) if len(level) else level
    want = np.minimum(1.0, ceiling / np.maximum(peak, 1e-9))
    out, gain = np.empty(len(level)), 1.0
    for i, w in enumerate(want):
        gain = min(w, gain + (1.0 - gain) * release)
        out[i] = gain
    return out


@query("limiter")
def limiter(v) -> DataFrame:
    """Gains for every track's values, over 80 taken as the ceiling; one track's series at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sec")
        return pd.DataFrame({"track_id": pdf["track_id"], "sec": pdf["sec"], "gain": limit_series(pdf["value"].to_numpy(float), 80.0)})

    return v["energy"].select("track_id", "sec", "value").groupBy("track_id").applyInPandas(run, "track_id long, sec long, gain double")


def butterworth(rate: float, corner: float, *, high: bool = False, order: int = 4) -> list[tuple[float, float, float, float, float]]:
    """The second-order sections (b0, b1, b2, a1, a2) of a low or high pass, maximally flat."""
    w = 2 * np.pi * corner / rate
    c, sections = np.cos(w), []
    for k in range(order // 2):
        bend = np.sin(w) * np.cos(np.pi * (2 * k + 1) / (2 * order))  # sin(w) / (2 Q)
        edge = (1 + c) / 2 if high else (1 - c) / 2
        sections.append(tuple(float(x / (1 + bend)) for x in (edge, -2 * edge if high else 2 * edge, edge, -2 * c, 1 - bend)))
    return sections


def filtered(x: np.ndarray, sections: list[tuple], state: list[tuple[float, float]] | None = None) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """A series through sections one after the other, and the state to go on from with the next chunk."""
    out, after = x.astype(float), []
    for (b0, b1, b2, a1, a2), (u, v) in zip(sections, state or [(0.0, 0.0)] * len(sections), strict=True):
        y = np.empty(len(out))
        for i, value in enumerate(out.tolist()):
            y[i] = now = b0 * value + u
            u, v = b1 * value - a1 * now + v, b2 * value - a2 * now
        out = y
        after.append((u, v))
    return out, after


def zero_phase(x: np.ndarray, sections: list[tuple]) -> np.ndarray:
    """Forward and back, so that nothing is delayed."""
    return filtered(filtered(x, sections)[0][::-1], sections)[0][::-1]


def three_bands(x: np.ndarray, rate: float, state: dict | None = None, *, delay_free: bool = False) -> tuple[dict[str, np.ndarray], dict]:
    """Low, mid and high parts that add up to the series again; causal parts come with the state of the next chunk."""
    after, parts = {}, []
    for corner in CROSSOVERS:
        sections = butterworth(rate, corner)
        if delay_free:
            parts.append(zero_phase(x, sections))
        else:
            y, after[corner] = filtered(x, sections, (state or {}).get(corner))
            parts.append(y)
    low, below = parts
    return {"low": low, "mid": below - low, "high": x - below}, after


#: Frames of the spectra, of the low band and of the others; crossovers and how far bands stay from them.
SIZE_LOW, SIZE, HOP = 8192, 2048, 512
CROSSOVERS, ABOVE, BELOW = (200.0, 2600.0), 1.5, 0.8


def band_bins(size: int, rate: float, band: str) -> slice:
    """The bins of a band's inner part: low, mid or high."""
    edges = {"low": (20.0, CROSSOVERS[0] * BELOW), "mid": (CROSSOVERS[0] * ABOVE, CROSSOVERS[1] * BELOW), "high": (CROSSOVERS[1] * ABOVE, np.inf)}[band]
    at = np.arange(size // 2 + 1) * rate / size
    return slice(int(np.searchsorted(at, edges[0])), int(np.searchsorted(at, edges[1])))


def band_spectra(signal: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Power spectra by band: long frames for the low one, whose pitches lie close, short ones for the others."""
    out = {}
    for band, size in (("low", SIZE_LOW), ("mid", SIZE), ("high", SIZE)):
        own = np.pad(signal, size // 2)  # frames are centred: as many at both sizes
        out[band] = spectra(own, size, HOP)[:, band_bins(size, rate, band)]
    return out


def spectra(frames: np.ndarray, size: int = 256, hop: int = 64) -> np.ndarray:
    """Power spectra of windowed frames of a signal, one row a frame."""
    if len(frames) < size:
        return np.zeros((0, size // 2 + 1))
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(frames, size)[::hop] * np.hanning(size), axis=1)) ** 2


sql_query(
    "mix_alpha",
    # The share of the incoming source, from energies of both.
    "SELECT mix_id, idx, round(sqrt(b) / (sqrt(a) + sqrt(b) + 1e-12), 6) AS alpha FROM (SELECT mix_id, idx, confidence AS a, coalesce(camelot_score, 0e0) AS b FROM v_transitions) x",
)
sql_query("pooled_alpha", "SELECT mix_id, idx, round(sqrt(sb) / (sqrt(sa) + sqrt(sb) + 1e-12), 6) AS alpha FROM (SELECT mix_id, idx, sum(confidence) OVER w AS sa, sum(coalesce(camelot_score, 0e0)) OVER w AS sb FROM v_transitions WINDOW w AS (PARTITION BY mix_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) x")


@query(
    "reference_purity",
    """SELECT CAST(vec_id AS BIGINT) AS vec_id, round(greatest(0e0, least(1e0, CASE WHEN aa = 0e0 OR bb = 0e0 THEN 1e0 ELSE ab / sqrt(aa * bb) END)), 5) AS purity FROM (
 SELECT vec_id, list_dot_product(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]) AS ab, list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]) AS aa, list_dot_product(embedding[33:64]::DOUBLE[], embedding[33:64]::DOUBLE[]) AS bb FROM embeddings)""",
)
def reference_purity(v) -> DataFrame:
    """How alike the halves of a vector are, 0 to 1; 1 where one is empty."""
    from setloom.functions.vectors import dot

    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    d = v.table("embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb"))
    r = F.when((F.col("aa") == 0) | (F.col("bb") == 0), 1.0).otherwise(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")))
    return d.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)), 5).alias("purity"))


def json_entries(lists: DataFrame) -> DataFrame:
    """(list_id, pos, t, artist, title) of JSON track lists: an array, or an object with tracks or tracklist.

    Entries without a time or a label are left out; text that is no JSON gives none.
    """
    entry = "array<struct<t:double,artist:string,title:string>>"
    inside = F.coalesce(F.get_json_object("raw", "$.tracks"), F.get_json_object("raw", "$.tracklist"))
    found = F.from_json(F.when(F.ltrim("raw").startswith("["), F.col("raw")).otherwise(inside), entry)
    rows = lists.select("list_id", F.posexplode(found).alias("pos", "e"))
    label = (F.coalesce("e.artist", F.lit("")) != "") | (F.coalesce("e.title", F.lit("")) != "")
    return rows.where(F.col("e.t").isNotNull() & label).select("list_id", F.col("pos").cast("long").alias("pos"), "e.t", "e.artist", "e.title")


@query("tracklist_json", "SELECT CAST(o_orderkey AS BIGINT) AS list_id, CAST(0 AS BIGINT) AS pos, CAST(o_orderkey % 600 AS DOUBLE) AS t, o_orderstatus AS artist, o_orderpriority AS title FROM orders WHERE o_orderkey % 5 <> 0")
def tracklist_json(v) -> DataFrame:
    i = F.col("o_orderkey")
    item = F.to_json(F.struct((i % 600).cast("double").alias("t"), F.col("o_orderstatus").alias("artist"), F.col("o_orderpriority").alias("title")))
    listed = F.concat(F.lit("["), item, F.lit("]"))
    raw = F.when(i % 5 == 0, "{broken").when(i % 5 == 1, F.concat(F.lit('{"tracks": '), listed, F.lit("}"))).when(i % 5 == 2, F.concat(F.lit('{"tracklist": '), listed, F.lit("}"))).otherwise(listed)
    return json_entries(v.table("orders").select(i.cast("long").alias("list_id"), raw.alias("raw")))


def splice_order(energy: np.ndarray, vectors: np.ndarray) -> list[int]:
    """The strongest first, then always the one least like any before it; earlier ones win ties."""
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    alike = unit @ unit.T
    out = [int(np.argmax(energy))]
    nearest = alike[out[0]].copy()
    while len(out) < len(energy):
        nearest[out] = np.inf
        out.append(int(np.argmin(nearest)))
        nearest = np.maximum(np.where(np.isinf(nearest), -np.inf, nearest), alike[out[-1]])
    return out


@query("splice_points")
def splice_points(v) -> DataFrame:
    """Cues of a track in splice order; a track has a few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        order = splice_order(pdf["energy"].to_numpy(float), np.stack(pdf["embedding"].to_numpy()).astype(float))
        return pd.DataFrame({"track_id": pdf["track_id"].to_numpy()[order], "pos": pdf["pos"].to_numpy()[order], "place": np.arange(len(order))})

    cues = v["cues"].where("embedding is not null").select("track_id", "pos", "energy", "embedding")
    return cues.groupBy("track_id").applyInPandas(run, "track_id long, pos long, place long")


@query("license_notes", "SELECT CASE WHEN contains(license, 'publicdomain') THEN 'cc0' WHEN license = '' THEN 'none' ELSE 'by-nc-sa' END AS code, count(*) AS n, count(*) FILTER (WHERE contains(license, '-nd')) AS n_no_derivatives FROM v_candidates GROUP BY 1")
def license_notes(v) -> DataFrame:
    code = licence_code(F.col("license"))
    bound = F.array_contains(F.split(code, "-"), "nd")
    return v["candidates"].select(F.when(code == "", "none").otherwise(code).alias("code"), bound.alias("nd")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if("nd").alias("n_no_derivatives"))


@query("dwell_bounds", "SELECT mix_id, CASE WHEN hi <= lo THEN CAST(32 AS BIGINT) ELSE lo END AS lo, CASE WHEN hi <= lo THEN CAST(96 AS BIGINT) ELSE hi END AS hi FROM (SELECT mix_id, CAST(floor(round(quantile_cont(confidence, 0.1) * 100e0, 6)) AS BIGINT) AS lo, CAST(floor(round(quantile_cont(confidence, 0.9) * 100e0, 6)) AS BIGINT) AS hi FROM v_transitions GROUP BY mix_id)")
def dwell_bounds(v) -> DataFrame:
    """Bounds by mix; the defaults where thin data turns them around."""
    q = v["transitions"].groupBy("mix_id").agg(F.floor(F.round(F.percentile("confidence", 0.1) * 100, 6)).alias("lo"), F.floor(F.round(F.percentile("confidence", 0.9) * 100, 6)).alias("hi"))
    bad = F.col("hi") <= F.col("lo")
    return q.select("mix_id", F.when(bad, F.lit(32)).otherwise(F.col("lo")).cast("long").alias("lo"), F.when(bad, F.lit(96)).otherwise(F.col("hi")).cast("long").alias("hi"))


#: Fixed values of the scheduler: least confidence, bars looked ahead, bars within which it fires.
MIN_CONFIDENCE, LOOK, FIRE = 0.25, 16.0, 8.0


def next_tracks(edges: DataFrame, recent: DataFrame) -> DataFrame:
    """The head of each source's ranked edges without its recent tracks, or of all of them if none is left."""
    kept = edges.join(recent, ["src", "dst"], "left_anti").withColumn("relaxed", F.lit(0)).unionByName(edges.withColumn("relaxed", F.lit(1)))
    return kept.groupBy("src").agg(F.min(F.struct("relaxed", "rank", "dst"))["dst"].alias("next_track"))


@query("next_track", f"SELECT src, arg_min(dst, CASE WHEN rank <= 2 THEN 100 + rank ELSE rank END) AS next_track FROM ({ORACLES['compat_edges']}) GROUP BY src")
def next_track(v) -> DataFrame:
    """What each source plays next when its two best edges were played lately."""
    edges = compat_edges(v).select("src", "dst", "rank").persist()  # ten rows a source, read three times
    recent = edges.where("rank <= 2").select("src", "dst")
    return next_tracks(edges, recent)


def schedule(ticks: DataFrame) -> DataFrame:
    """(session, pos, fires) of every tick of a session that is not mixing; a session's state is whether it is, and since when.

    Ticks: session, seq, pos, bar (seconds), played (bars), cue_ts, cue_confidence (null if no cue is ahead), done (a
    transition has ended). Fires on a cue within eight bars after the least dwell, or past the most with no cue ahead.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mixing = bool(state.get[0]) if state.exists else False
        out: list[tuple] = []
        for frame in frames:
            for t in frame.sort_values("seq").itertuples():
                if mixing:
                    mixing = not t.done
                    continue
                ahead = t.cue_ts == t.cue_ts and t.pos < t.cue_ts < t.pos + LOOK * t.bar and t.cue_confidence > MIN_CONFIDENCE
                fires = (t.played >= t.least and t.cue_ts - t.pos <= FIRE * t.bar) if ahead else t.played >= t.most
                mixing = bool(fires)
                out.append((key[0], float(t.pos), bool(fires)))
        state.update((mixing,))
        if out:
            yield pd.DataFrame(out, columns=["session", "pos", "fires"])

    return ticks.groupBy("session").applyInPandasWithState(step, "session long, pos double, fires boolean", "mixing boolean", "append", GroupStateTimeout.NoTimeout)


@query(
    "scheduler_decisions",
    """SELECT track_id, p AS pos, CASE WHEN c IS NOT NULL THEN CASE WHEN p / bar >= 4e0 AND c - p <= 8e0 * bar THEN 1 ELSE 0 END ELSE CASE WHEN p / bar >= 24e0 THEN 1 ELSE 0 END END AS fires FROM (
 SELECT t.track_id, g.i * 15e0 AS p, 240e0 / t.bpm AS bar, (SELECT arg_min(q.ts, -q.confidence * 1000 + q.pos / 1000e0) FROM v_cues q WHERE q.track_id = t.track_id AND q.type = 'out' AND q.ts > g.i * 15e0 AND q.ts < g.i * 15e0 + 16e0 * 240e0 / t.bpm AND q.confidence > 0.25e0) AS c
 FROM (SELECT DISTINCT track_id FROM v_cues) k JOIN v_tracks t ON k.track_id = t.track_id, unnest(range(0, CAST(floor(t.duration / 15e0) AS BIGINT) + 1)) AS g(i))""",
)
def scheduler_decisions(v) -> DataFrame:
    """The batch form: decisions at every fifteen seconds of the tracks with cues, from least and most dwells of 4 and 24 bars."""
    cues = v["cues"].select("track_id", "pos", "ts", "confidence", "type")
    t = v["tracks"].join(cues.select("track_id").distinct(), "track_id").select("track_id", (240.0 / F.col("bpm")).alias("bar"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") / 15.0))).alias("i"))
    t = t.select("track_id", "bar", (F.col("i") * 15.0).alias("p"))
    out = cues.where(f"type = 'out' and confidence > {MIN_CONFIDENCE}").select(F.col("track_id").alias("k"), "ts", "confidence", "pos")
    near = t.join(out, (F.col("track_id") == F.col("k")) & (F.col("ts") > F.col("p")) & (F.col("ts") < F.col("p") + LOOK * F.col("bar")), "left")
    best = near.groupBy("track_id", "bar", "p").agg(F.max(F.struct("confidence", (-F.col("pos")).alias("o"), "ts"))["ts"].alias("c"))
    played = F.col("p") / F.col("bar")
    fires = F.when(F.col("c").isNotNull(), (played >= 4) & (F.col("c") - F.col("p") <= FIRE * F.col("bar"))).otherwise(played >= 24)
    return best.select("track_id", F.col("p").alias("pos"), fires.cast("int").alias("fires"))


sql_query(
    "limiter_envelope",
    "SELECT track_id, sec, max(value) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS peak FROM v_energy",
)
sql_query(
    "gain_ceiling",
    # A ceiling per block that ducks at once; the running least of what each earlier block allows, two hundredths more a block.
    "SELECT track_id, sec, round(least(1e0, min(80e0 / greatest(value, 80e0) - 0.02e0 * sec) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 0.02e0 * sec), 6) AS gain FROM v_energy",
)
