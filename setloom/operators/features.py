"""Analysis of a track: cue scores, section labels, key, folded tempo, filters, change points, tempo by autocorrelation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setloom.functions.harmony import fold_tempo
from setloom.registry import query, sql_query

# Key profiles, major and minor, from the tonic up.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)

_FEATURES = """SELECT track_id, sec, energy, CASE WHEN sec % 8 = 0 THEN 1e0 ELSE 0e0 END AS phrase, greatest(0e0, 1e0 - 5e0 * abs(value / 100e0 - 0.2e0)) AS flat, count(*) OVER (PARTITION BY track_id) AS duration,
 coalesce(avg(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - avg(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0e0) AS trend,
 avg(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS c, avg(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS l, avg(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING) AS r FROM v_energy"""


def cue_scores(f: DataFrame) -> DataFrame:
    """Adds out_score and in_score to rows with sec, duration, phrase, valley, trend, flat, energy; 0 where a cue may not be."""
    common = F.col("flat") + 0.5 * (1 - F.col("energy"))
    out = (3.5 * F.col("phrase") + 2.5 * F.col("valley") - 1.5 * F.col("trend") + common) / 9.0
    into = (3.5 * F.col("phrase") + 1.5 * F.col("trend") + 1.5 * F.col("valley") + common) / 8.0
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return f.withColumn("out_score", F.when(F.col("sec") >= 4, clip(out)).otherwise(0.0)).withColumn("in_score", F.when((F.col("sec") >= 2) & (F.col("sec") <= 0.8 * F.col("duration")), clip(into)).otherwise(0.0))


_VALLEY = "CASE WHEN l IS NULL AND r IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, 4e0 * ((coalesce(l, r) + coalesce(r, l)) / 2e0 - c))) END"


@query(
    "cue_scores",
    f"""SELECT track_id, sec, round(CASE WHEN sec >= 4 THEN greatest(0e0, least(1e0, (3.5e0 * phrase + 2.5e0 * valley - 1.5e0 * trend + flat + 0.5e0 * (1e0 - energy)) / 9e0)) ELSE 0e0 END, 6) AS out_score,
 round(CASE WHEN sec >= 2 AND sec <= 0.8e0 * duration THEN greatest(0e0, least(1e0, (3.5e0 * phrase + 1.5e0 * trend + 1.5e0 * valley + flat + 0.5e0 * (1e0 - energy)) / 8e0)) ELSE 0e0 END, 6) AS in_score
FROM (SELECT *, {_VALLEY} AS valley FROM ({_FEATURES}) x) y""",
)
def cue_score_rows(v) -> DataFrame:
    f = v.sql(_FEATURES)
    depth = 4 * ((F.coalesce("l", "r") + F.coalesce("r", "l")) / 2 - F.col("c"))
    f = f.withColumn("valley", F.when(depth.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), depth))))
    return cue_scores(f).select("track_id", "sec", F.round("out_score", 6).alias("out_score"), F.round("in_score", 6).alias("in_score"))


def section_label(place: Column, energy: Column, trend: Column) -> Column:
    """A section's kind from where it starts (0 to 1), its mean energy, and the energy's rise over it; first rule wins."""
    return F.when((place < 0.12) & (energy < 0.45), "intro").when((place > 0.85) & (energy < 0.5), "outro").when(energy < 0.30, "sparse").when(trend > 0.08, "rising").when(trend < -0.08, "falling").when(energy > 0.70, "peak").otherwise("steady")


@query(
    "section_labels",
    """SELECT track_id, section, CASE WHEN place < 0.12e0 AND e < 0.45e0 THEN 'intro' WHEN place > 0.85e0 AND e < 0.5e0 THEN 'outro' WHEN e < 0.3e0 THEN 'sparse' WHEN b - a > 0.08e0 THEN 'rising' WHEN b - a < -0.08e0 THEN 'falling' WHEN e > 0.7e0 THEN 'peak' ELSE 'steady' END AS label, round(e, 3) AS energy
FROM (SELECT track_id, CAST(floor(sec / 9e0) AS BIGINT) AS section, min(sec) / CAST(max(n) AS DOUBLE) AS place, avg(energy) AS e, avg(CASE WHEN sec % 9 < 3 THEN energy END) AS a, coalesce(avg(CASE WHEN sec % 9 >= 6 THEN energy END), avg(energy)) AS b FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM v_energy) s GROUP BY track_id, CAST(floor(sec / 9e0) AS BIGINT)) t""",
)
def section_labels(v) -> DataFrame:
    """Sections of nine seconds, labelled by place, energy and the change from their first third to their last."""
    e = v["energy"].withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("track_id")))
    third = lambda cond: F.avg(F.when(cond, F.col("energy")))
    s = e.groupBy("track_id", F.floor(F.col("sec") / 9).alias("section")).agg((F.min("sec") / F.max("n")).alias("place"), F.avg("energy").alias("e"), third(F.col("sec") % 9 < 3).alias("a"), F.coalesce(third(F.col("sec") % 9 >= 6), F.avg("energy")).alias("b"))
    return s.select("track_id", "section", section_label(F.col("place"), F.col("e"), F.col("b") - F.col("a")).alias("label"), F.round("e", 3).alias("energy"))


def profiles(spark) -> DataFrame:
    """(root, minor, pos, weight): both profiles at the twelve roots, 288 rows."""
    rows = [(r, m, p, profile[(p - r) % 12]) for m, profile in ((0, MAJOR), (1, MINOR)) for r in range(12) for p in range(12)]
    return spark.createDataFrame(rows, "root long, minor long, pos long, weight double")


def detect_keys(chroma: DataFrame) -> DataFrame:
    """(id, root, minor, confidence) of rows (id, pos 0-11, value): the profile that correlates best; lower root, then major, on ties."""
    spark = chroma.sparkSession
    r = chroma.join(F.broadcast(profiles(spark)), "pos").groupBy("id", "root", "minor").agg(F.corr("value", "weight").alias("r"))
    best = r.groupBy("id").agg(F.max(F.struct(F.round("r", 9).alias("r"), (-F.col("root")).alias("a"), (-F.col("minor")).alias("b"))).alias("m"))
    return best.select("id", (-F.col("m.a")).alias("root"), (-F.col("m.b")).alias("minor"), F.round((F.col("m.r") + 1) / 2, 6).alias("confidence"))


_PROFILES = f"(SELECT r.r AS root, m.m AS minor, p.p AS pos, CASE m.m WHEN 0 THEN (CAST([{', '.join(map(str, MAJOR))}] AS DOUBLE[]))[(p.p - r.r + 12) % 12 + 1] ELSE (CAST([{', '.join(map(str, MINOR))}] AS DOUBLE[]))[(p.p - r.r + 12) % 12 + 1] END AS weight FROM (SELECT unnest(range(0, 12)) AS r) r, (SELECT unnest(range(0, 2)) AS m) m, (SELECT unnest(range(0, 12)) AS p) p)"


@query(
    "key_detection",
    f"""SELECT id, root, minor, round((r + 1e0) / 2e0, 6) AS confidence FROM (SELECT id, CAST(root AS BIGINT) AS root, CAST(minor AS BIGINT) AS minor, r, row_number() OVER (PARTITION BY id ORDER BY round(r, 9) DESC, root, minor) AS rn FROM (
 SELECT c.id, q.root, q.minor, corr(c.value, q.weight) AS r FROM (SELECT vec_id AS id, p.p AS pos, CAST(embedding[p.p + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(0, 12)) AS p) p) c JOIN {_PROFILES} q ON c.pos = q.pos GROUP BY c.id, q.root, q.minor)) WHERE rn = 1""",
)
def key_detection(v) -> DataFrame:
    """Keys of the first twelve numbers of each vector, taken as a chroma."""
    parts = v.table("embeddings").select(F.col("vec_id").cast("long").alias("id"), F.posexplode(F.slice("embedding", 1, 12)).alias("pos", "value"))
    return detect_keys(parts.select("id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")))


@query("folded_tempos", "SELECT track_id, round(x * power(2e0, -floor(log2(x / 90e0))), 6) AS bpm FROM (SELECT track_id, bpm * (1 + track_id % 5) / 3e0 AS x FROM v_tracks) t")
def folded_tempos(v) -> DataFrame:
    return v["tracks"].select("track_id", F.round(fold_tempo(F.col("bpm") * (1 + F.col("track_id") % 5) / 3.0), 6).alias("bpm"))


sql_query("levels", "SELECT track_id, round(CASE WHEN m <= 1e-6 THEN -120e0 ELSE greatest(-120e0, 20e0 * log10(m)) END, 4) AS db FROM (SELECT track_id, sqrt(avg(energy * energy)) AS m FROM v_energy GROUP BY track_id) t")
sql_query("finite_values", "SELECT track_id, sec, CASE WHEN isnan(x) OR abs(x) > 1e300 THEN NULL ELSE round(x, 4) END AS x FROM (SELECT track_id, sec, CASE WHEN sec % 9 = 0 THEN CAST('NaN' AS DOUBLE) WHEN sec % 9 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS x FROM v_energy) t")


def framed(series: DataFrame, half: int) -> DataFrame:
    """Each place of a series (track_id, sec from 0, energy) with its neighbours up to ``half`` away, the ends repeated."""
    n = series.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("track_id")))
    want = n.select("track_id", F.col("sec").alias("at"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("d"), "n").withColumn("sec", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("at") + F.col("d"))))
    return want.join(series.select("track_id", "sec", "energy"), ["track_id", "sec"])


_FRAMED = "SELECT w.track_id, w.place, s.energy FROM (SELECT track_id, sec AS place, greatest(0, least(n - 1, sec + d.d)) AS sec FROM (SELECT track_id, sec, count(*) OVER (PARTITION BY track_id) AS n FROM v_energy) x, (SELECT unnest(range(-2, 3)) AS d) d) w JOIN v_energy s ON s.track_id = w.track_id AND s.sec = w.sec"


@query("median_filter", f"SELECT track_id, place AS sec, round(quantile_cont(energy, 0.5), 6) AS median, round(sum(energy), 6) AS moving_sum FROM ({_FRAMED}) GROUP BY track_id, place")
def median_filter(v, half: int = 2) -> DataFrame:
    """Median and sum over five places, the ends repeated."""
    return framed(v["energy"], half).groupBy("track_id", "at").agg(F.round(F.percentile("energy", 0.5), 6).alias("median"), F.round(F.sum("energy"), 6).alias("moving_sum")).withColumnRenamed("at", "sec")


def change_points(values: np.ndarray, share: float = 0.006, k: int = 3) -> list[int]:
    """Places where the medians of the k values ahead and behind differ by over ``share``: peaks within k, k apart at least."""
    if len(values) < 2 * k + 2:
        return []
    medians = np.median(np.lib.stride_tricks.sliding_window_view(values, k), axis=1)
    behind, ahead = medians[:-k], medians[k:]
    step = np.pad(np.divide(np.abs(ahead - behind), behind, out=np.zeros_like(behind), where=behind > 0), (k, k - 1))
    highest = np.lib.stride_tricks.sliding_window_view(np.pad(step, k), 2 * k + 1).max(axis=1)
    kept = [-k]
    for place in np.flatnonzero((step > share) & (step >= highest - 1e-12)).tolist():
        if place >= kept[-1] + k:
            kept.append(place)
    return kept[1:]


def split_series(rows: DataFrame) -> DataFrame:
    """(id, at) of the change points of each id's series (id, t, y); a series is one track's windows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = change_points(pdf.sort_values("t")["y"].to_numpy(float))
        return pd.DataFrame({"id": [pdf["id"].iloc[0]] * len(at), "at": at}).astype({"id": "int64", "at": "int64"})

    return rows.groupBy("id").applyInPandas(run, "id long, at long")


@query("tempo_changes")
def tempo_changes(v) -> DataFrame:
    """Change points of a track's four-second tempos (made from its events)."""
    rows = v["energy"].groupBy(F.col("track_id").alias("id"), F.floor(F.col("sec") / 4).alias("t")).agg((120 + 8 * F.max("energy")).alias("y"))
    return split_series(rows)


def autocorrelation_tempo(onsets: np.ndarray, rate: float, low: float = 90.0, high: float = 180.0) -> tuple[float, float]:
    """Tempo in [low, high) and its confidence: the lag, refined between samples, at which onsets repeat themselves most."""
    x = onsets - onsets.mean()
    if len(x) < 8 or not np.any(x):
        return 0.0, 0.0
    f = np.fft.rfft(x, 2 * len(x))
    a = np.fft.irfft(f * np.conj(f))[: len(x)] / np.arange(len(x), 0, -1)
    grid = np.arange(low, high, 0.05)
    lags = (60.0 * rate / grid)[:, None] * np.array([1, 2, 4, 8])
    ok = lags < len(a) / 2
    n = ok.sum(1)
    score = np.where(n > 0, np.where(ok, np.interp(lags, np.arange(len(a)), a), 0.0).sum(1) / np.maximum(n, 1) / a[0], -np.inf)
    best = int(np.flatnonzero(score == score.max())[-1])
    return (round(float(grid[best]), 2), float(np.clip(score[best], 0.0, 1.0))) if n[best] and score[best] > 0 else (0.0, 0.0)


def beat_phase(onsets: np.ndarray, rate: float, bpm: float, steps: int = 48) -> float:
    """Seconds to the first beat: of even steps over a beat the one whose beats meet the most onsets."""
    beat = 60.0 / bpm
    tried = np.arange(steps) * beat / steps
    at = (tried[:, None] + np.arange(int(len(onsets) / rate / beat) + 1) * beat) * rate
    hits = np.where(at <= len(onsets) - 1, np.interp(at, np.arange(len(onsets)), onsets), 0.0).sum(1)
    return float(tried[int(hits.argmax())])


def without_octave_errors(bpms: np.ndarray, share: float = 0.12, passes: int = 2) -> np.ndarray:
    """Values over ``share`` off the median become NaN, twice, since the median moves."""
    out = bpms.astype(float).copy()
    for _ in range(passes):
        if not np.isfinite(out).any():
            break
        mid = np.nanmedian(out)
        out[np.abs(out / mid - 1) > share] = np.nan
    return out


def tempo_segments(onsets: np.ndarray, rate: float, *, window: float = 20.0, hop: float = 5.0, share: float = 0.006) -> list[tuple[float, float, float, float, float]]:
    """(start, end, bpm, first beat, confidence) of stretches of one tempo that cover a series without gaps.

    Windows' tempos, without octave errors, holes filled between neighbours, smoothed by medians of five, are split where
    they change; each stretch is then fitted again as a whole. A stretch under a second goes.
    """
    length = len(onsets) / rate

    def fit(x: np.ndarray) -> tuple[float, float, float]:
        bpm, trust = autocorrelation_tempo(x, rate)
        return bpm, beat_phase(x, rate, bpm) if bpm else 0.0, trust

    size, step = int(window * rate), max(1, int(hop * rate))
    bounds, bpms, centres = [0.0, length], np.zeros(0), np.zeros(0)
    if len(onsets) > size:
        starts = np.arange(0, len(onsets) - size + 1, step)
        found = np.array([autocorrelation_tempo(onsets[s : s + size], rate)[0] for s in starts.tolist()])
        bpms = without_octave_errors(np.where(found > 0, found, np.nan))
        known = np.isfinite(bpms)
        if not known.any():
            return []
        bpms = np.interp(np.arange(len(bpms)), np.flatnonzero(known), bpms[known])
        bpms = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(bpms, 2, mode="edge"), 5), axis=1)
        centres = (starts + size / 2) / rate
        bounds = sorted({0.0, length, *centres[change_points(bpms, share)].tolist()})
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 1.0:
            continue
        bpm, phase, trust = fit(onsets[int(a * rate) : max(int(b * rate), int(a * rate) + 1)])
        if not bpm:
            inside = bpms[(centres >= a) & (centres < b)]
            if not len(inside):
                continue
            bpm, phase, trust = float(np.median(inside)), 0.0, 0.0
        out.append((round(a, 3), round(b, 3), bpm, round(a + phase, 3), trust))
    return out


@query("tempo_stretches")
def tempo_stretches(v) -> DataFrame:
    """Stretches of one tempo of each track's energy, taken as onsets at eight a second."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = tempo_segments(pdf.sort_values("sec")["energy"].to_numpy(float), 8.0)
        return pd.DataFrame([(pdf["track_id"].iloc[0], *r) for r in rows], columns=["track_id", "start", "end", "bpm", "first_beat", "confidence"]).astype({"track_id": "int64"} | dict.fromkeys(["start", "end", "bpm", "first_beat", "confidence"], "float64"))

    return v["energy"].select("track_id", "sec", "energy").groupBy("track_id").applyInPandas(run, "track_id long, start double, end double, bpm double, first_beat double, confidence double")


@query("energy_tempo")
def energy_tempo(v) -> DataFrame:
    """A tempo for each track's energy, taken as onsets at eight a second."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bpm, trust = autocorrelation_tempo(pdf.sort_values("sec")["energy"].to_numpy(float), 8.0)
        return pd.DataFrame({"track_id": [pdf["track_id"].iloc[0]], "bpm": [bpm], "confidence": [trust]})

    return v["energy"].select("track_id", "sec", "energy").groupBy("track_id").applyInPandas(run, "track_id long, bpm double, confidence double")


@query("cut_gains", "SELECT mix_id, idx, p AS progress, round(0.9e0 * cos(p * pi() / 2e0), 6) AS gain_out, round(0.9e0 * sin(p * pi() / 2e0), 6) AS gain_in FROM (SELECT mix_id, idx, greatest(0e0, least(1e0, confidence)) AS p FROM v_transitions WHERE is_cut = 1) x")
def cut_gains(v) -> DataFrame:
    """The equal-power gains of a cut at a progress from 0 to 1, with a tenth of headroom."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    out, into = cut_gain(F.col("progress"))
    return v["transitions"].where("is_cut = 1").select("mix_id", "idx", p.alias("progress")).select("mix_id", "idx", "progress", F.round(out, 6).alias("gain_out"), F.round(into, 6).alias("gain_in"))


def cut_gain(progress, headroom: float = 0.9):
    return headroom * F.cos(progress * F.pi() / 2.0), headroom * F.sin(progress * F.pi() / 2.0)


sql_query(
    "corpus_report",
    # The report on a corpus as rows.
    """SELECT 'mixes' AS metric, CAST(count(DISTINCT mix_id) AS DOUBLE) AS value FROM v_transitions UNION ALL SELECT 'boundaries', CAST(count(*) AS DOUBLE) FROM v_transitions UNION ALL SELECT 'measured', CAST(count(*) AS DOUBLE) FROM v_transitions WHERE status = 'ok'
 UNION ALL SELECT 'trusted', CAST(count(*) AS DOUBLE) FROM v_transitions WHERE status = 'ok' AND confidence >= 0.2e0 UNION ALL SELECT 'accept_rate', round(avg(CASE WHEN status = 'ok' THEN 1e0 ELSE 0e0 END), 6) FROM v_transitions
 UNION ALL SELECT 'cut_rate', round(avg(CASE WHEN is_cut = 1 THEN 1e0 ELSE 0e0 END), 6) FROM v_transitions WHERE status = 'ok' AND confidence >= 0.2e0 UNION ALL SELECT concat('rejected: ', coalesce(reject_reason, 'unknown')), CAST(count(*) AS DOUBLE) FROM v_transitions WHERE status = 'rejected' GROUP BY reject_reason""",
)
sql_query(
    "section_details",
    # The even sections that the tables stand for, with the energy that the section starts at.
    "SELECT t.track_id, CAST(g.i AS BIGINT) AS section, round(g.i * duration / n_sections, 3) AS starts, round((g.i + 1) * duration / n_sections, 3) AS ends, round(duration / n_sections, 3) AS seconds, CASE WHEN g.i = 0 THEN 'intro' WHEN g.i = n_sections - 1 THEN 'outro' ELSE 'body' END AS label FROM v_tracks t JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) g ON g.i < n_sections",
)
sql_query(
    "sparkline",
    # At most sixty samples of a curve, evenly, as glyph numbers 0 to 7.
    "SELECT track_id, sec, CAST(least(7, floor(energy * 8e0)) AS BIGINT) AS glyph FROM (SELECT track_id, sec, energy, greatest(1, CAST(floor(count(*) OVER (PARTITION BY track_id) / 60e0) AS BIGINT)) AS step FROM v_energy) s WHERE sec % step = 0 AND sec / step < 60",
)
sql_query("cues_by_confidence", "SELECT track_id, type, CAST(row_number() OVER (PARTITION BY track_id, type ORDER BY confidence DESC, pos) AS BIGINT) AS rank, ts, confidence FROM v_cues")
sql_query("usable_for_validation", "SELECT count(*) AS n FROM v_tracks WHERE bpm > 0e0 AND n_in + n_out > 0 AND n_downbeats > 0")
sql_query("late_entries", "SELECT mix_id, count(*) FILTER (WHERE announced_t < 2400e0) AS n_kept, count(*) FILTER (WHERE announced_t >= 2400e0) AS n_dropped FROM v_transitions GROUP BY mix_id")
sql_query("long_sections", "SELECT track_id, count(*) FILTER (WHERE len >= 40e0) AS n_long, CASE WHEN count(*) FILTER (WHERE len >= 40e0) = 0 THEN count(*) ELSE count(*) FILTER (WHERE len >= 40e0) END AS n_used FROM (SELECT track_id, duration / n_sections - 2e0 * (track_id % 9) AS len FROM v_tracks WHERE n_sections > 0) s GROUP BY track_id")
sql_query("truth_errors", "SELECT m.mix_id, m.idx, round(abs(m.announced_t + CAST(m.k % 9 AS DOUBLE) - t.announced_t), 6) AS err FROM v_transitions m JOIN v_transitions t ON m.mix_id = t.mix_id AND m.idx = t.idx WHERE m.status = 'ok'")
sql_query("next_downbeat", "SELECT c.track_id, c.pos, round(ceil(c.ts / (240e0 / t.bpm)) * 240e0 / t.bpm, 6) AS t FROM v_cues c JOIN v_tracks t ON c.track_id = t.track_id WHERE ceil(c.ts / (240e0 / t.bpm)) < t.n_downbeats")
sql_query("resume_position", "SELECT set_id, pos, CAST(floor(1000e0 * (out_end - out_start) * 1.05e0 + 0.25e0) AS BIGINT) AS position FROM v_clips")
sql_query("entry_after", "SELECT track_id, pos, ts FROM (SELECT c.track_id, c.pos, c.ts, row_number() OVER (PARTITION BY c.track_id ORDER BY c.confidence DESC, c.pos) AS rn FROM v_cues c WHERE c.type = 'in' AND c.ts >= 60e0) x WHERE rn = 1")
sql_query("mix_defaults", "SELECT t.track_id, coalesce(o.ts, 0.6e0 * t.duration) AS out_ts, coalesce(i.ts, 0e0) AS in_ts FROM v_tracks t LEFT JOIN (SELECT track_id, max(ts) AS ts FROM v_cues WHERE type = 'out' GROUP BY track_id) o ON t.track_id = o.track_id LEFT JOIN (SELECT track_id, min(ts) AS ts FROM v_cues WHERE type = 'in' GROUP BY track_id) i ON t.track_id = i.track_id")
sql_query(
    "segment_bounds",
    # Pace presets by track, with the clamps: four seconds at least, and four between the bounds.
    "SELECT track_id, pace, greatest(4e0, lo) AS lo, greatest(greatest(4e0, lo) + 4e0, hi) AS hi FROM (SELECT track_id, pace, CASE pace WHEN 'long-form' THEN 90e0 WHEN 'shifting' THEN 25e0 WHEN 'choppy' THEN 12e0 WHEN 'own' THEN CAST(track_id % 7 AS DOUBLE) ELSE 45e0 END AS lo, CASE pace WHEN 'long-form' THEN 240e0 WHEN 'shifting' THEN 75e0 WHEN 'choppy' THEN 40e0 WHEN 'own' THEN CAST(track_id % 5 AS DOUBLE) ELSE 120e0 END AS hi FROM (SELECT track_id, CASE track_id % 6 WHEN 0 THEN 'long-form' WHEN 1 THEN 'flowing' WHEN 2 THEN 'shifting' WHEN 3 THEN 'choppy' WHEN 4 THEN 'own' ELSE 'unknown' END AS pace FROM v_tracks) p) b",
)
sql_query("yield_advice", "SELECT CASE WHEN license = '' THEN 'no license' WHEN target_prob IS NULL THEN 'no data' ELSE 'seen' END AS reason, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, CASE WHEN count(*) > 0.15e0 * sum(count(*)) OVER () THEN 1 ELSE 0 END AS major FROM v_candidates GROUP BY CASE WHEN license = '' THEN 'no license' WHEN target_prob IS NULL THEN 'no data' ELSE 'seen' END")
sql_query("radio_report", "SELECT set_id, count(*) AS n_clips, max(out_end) AS generated, least(max(out_end), 60e0) AS played, max(out_end) - least(max(out_end), 60e0) AS buffered FROM v_clips GROUP BY set_id")
sql_query("queue_position", "SELECT set_id, pos, greatest(0e0, out_start - 12.5e0) AS audible FROM v_clips")


@query("classifier_sidecars", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def classifier_sidecars(v) -> DataFrame:
    """Nested documents: the value of a map read from JSON text; null for text that is none."""
    props = F.from_json("props", "map<string,double>")
    return v.table("events").select("event_id", F.try_element_at(props, F.lit("k")).cast("long").alias("k"))
