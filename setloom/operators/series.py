"""Time series and intervals: energy features, cues, tempo, segments, clips, gaps, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setloom.registry import query, sql_query

_E = "PARTITION BY track_id ORDER BY sec"


def _by_second():
    return Window.partitionBy("track_id").orderBy("sec")


@query(
    "energy_valley",
    f"""SELECT track_id, sec, round(greatest(0e0, least(1e0, 4e0 * ((coalesce(l, r) + coalesce(r, l)) / 2e0 - c))), 6) AS valley FROM (SELECT track_id, sec, avg(energy) OVER ({_E} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS c,
 avg(energy) OVER ({_E} ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS l, avg(energy) OVER ({_E} ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING) AS r FROM v_energy) x""",
)
def energy_valley(v) -> DataFrame:
    """How far the energy around a second lies under that of the seconds before and after; a missing side is the other one."""
    w = _by_second()
    e = v["energy"].select("track_id", "sec", F.avg("energy").over(w.rowsBetween(-2, 1)).alias("c"), F.avg("energy").over(w.rowsBetween(-8, -3)).alias("l"), F.avg("energy").over(w.rowsBetween(2, 7)).alias("r"))
    depth = 4 * ((F.coalesce("l", "r") + F.coalesce("r", "l")) / 2 - F.col("c"))
    return e.select("track_id", "sec", F.round(F.when(depth.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), depth))).otherwise(0.0), 6).alias("valley"))


@query(
    "energy_trend",
    f"""SELECT track_id, sec, CASE WHEN a IS NULL OR b IS NULL THEN 0e0 ELSE round(a - b, 6) END AS trend FROM (SELECT track_id, sec, avg(energy) OVER ({_E} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a,
 avg(energy) OVER ({_E} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b FROM v_energy) x""",
)
def energy_trend(v) -> DataFrame:
    w = _by_second()
    e = v["energy"].select("track_id", "sec", F.avg("energy").over(w.rowsBetween(0, 3)).alias("a"), F.avg("energy").over(w.rowsBetween(-4, -1)).alias("b"))
    return e.select("track_id", "sec", F.coalesce(F.round(F.col("a") - F.col("b"), 6), F.lit(0.0)).alias("trend"))


@query("energy_curve_normalized", "SELECT track_id, CAST(floor(sec / 4e0) AS BIGINT) AS bucket, round(avg(value) / (max(avg(value)) OVER (PARTITION BY track_id) + 1e-8), 4) AS level FROM v_energy GROUP BY track_id, CAST(floor(sec / 4e0) AS BIGINT)")
def energy_curve_normalized(v) -> DataFrame:
    """Means of four seconds, by the loudest of the track."""
    means = v["energy"].groupBy("track_id", F.floor(F.col("sec") / 4.0).alias("bucket")).agg(F.avg("value").alias("m"))
    return means.select("track_id", "bucket", F.round(F.col("m") / (F.max("m").over(Window.partitionBy("track_id")) + 1e-8), 4).alias("level"))


@query("phrase_boundaries", "SELECT track_id, CAST(d.i AS BIGINT) AS downbeat, round(d.i * 240e0 / bpm, 6) AS t FROM v_tracks, (SELECT unnest(range(0, 40, 8)) AS i) d WHERE d.i < n_downbeats")
def phrase_boundaries(v, every: int = 8) -> DataFrame:
    """Each eighth downbeat of a track's grid."""
    first = v["tracks"].where("n_downbeats > 0").select("track_id", "bpm", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_downbeats") - 1, F.lit(every).cast("long"))).alias("downbeat"))
    return first.select("track_id", "downbeat", F.round(F.col("downbeat") * 240.0 / F.col("bpm"), 6).alias("t"))


@query(
    "downbeat_anchor",
    "SELECT track_id, phase, strength FROM (SELECT track_id, phase, strength, row_number() OVER (PARTITION BY track_id ORDER BY strength DESC, phase) AS rn FROM (SELECT track_id, sec % 4 AS phase, round(sum(energy), 6) AS strength FROM v_energy GROUP BY track_id, sec % 4)) WHERE rn = 1",
)
def downbeat_anchor(v) -> DataFrame:
    """The bar phase with the largest strength, the first of equals."""
    sums = v["energy"].groupBy("track_id", (F.col("sec") % 4).alias("phase")).agg(F.round(F.sum("energy"), 6).alias("s"))
    best = sums.groupBy("track_id").agg(F.max(F.struct("s", (-F.col("phase")).alias("p"))).alias("m"))
    return best.select("track_id", (-F.col("m.p")).alias("phase"), F.col("m.s").alias("strength"))


@query("cue_topk", "SELECT track_id, type, pos, ts, confidence FROM (SELECT *, row_number() OVER (PARTITION BY track_id, type ORDER BY confidence DESC, pos) AS rn FROM v_cues) WHERE rn <= 5")
def cue_topk(v, k: int = 5) -> DataFrame:
    """The k most confident cues of a type by track, in time."""
    ranked = v["cues"].withColumn("rn", F.row_number().over(Window.partitionBy("track_id", "type").orderBy(F.desc("confidence"), "pos")))
    return ranked.where(F.col("rn") <= k).select("track_id", "type", "pos", "ts", "confidence")


@query(
    "nearest_downbeat",
    """SELECT c.track_id, c.pos, round(arg_min(d.i * 240e0 / t.bpm, abs(d.i * 240e0 / t.bpm - c.ts)), 6) AS t FROM v_cues c JOIN v_tracks t USING (track_id), (SELECT unnest(range(0, 40)) AS i) d
WHERE d.i < t.n_downbeats AND abs(d.i * 240e0 / t.bpm - c.ts) <= 4e0 GROUP BY c.track_id, c.pos""",
)
def nearest_downbeat(v, window: float = 4.0) -> DataFrame:
    """The downbeat next to each cue, none beyond the window; found by arithmetic on the grid, not by a join with it."""
    both = v["cues"].select("track_id", "pos", "ts").join(v["tracks"].select("track_id", "bpm", "n_downbeats").where("n_downbeats > 0"), "track_id")
    bar = 240.0 / F.col("bpm")
    i = F.greatest(F.lit(0), F.least(F.col("n_downbeats") - 1, F.ceil(F.col("ts") / bar - 0.5)))
    return both.withColumn("t", i * 240.0 / F.col("bpm")).where(F.abs(F.col("t") - F.col("ts")) <= window).select("track_id", "pos", F.round("t", 6).alias("t"))


_TEMPO_AT = "SELECT x.mix_id, x.idx, x.announced_t AS t, s.bpm FROM v_transitions x JOIN v_tempo_segments s ON x.mix_id = s.mix_id AND ((x.announced_t >= s.seg_start AND x.announced_t < s.seg_end) OR (x.announced_t >= s.seg_end AND s.seg = 2))"


@query("bpm_at", _TEMPO_AT)
def bpm_at(v) -> DataFrame:
    """The tempo at each announcement: of the segment it is in, else of the nearest one."""
    segs = v["tempo_segments"].groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("seg_start", "seg_end", "bpm"))).alias("segs"))
    both = v["transitions"].select("mix_id", "idx", F.col("announced_t").alias("t")).join(segs, "mix_id")
    inside = F.try_element_at(F.filter("segs", lambda s: (s["seg_start"] <= F.col("t")) & (F.col("t") < s["seg_end"])), F.lit(1))["bpm"]
    away = lambda s: F.greatest(s["seg_start"] - F.col("t"), F.col("t") - s["seg_end"])
    near = F.array_min(F.transform("segs", lambda s: F.struct(away(s).alias("d"), s["seg_start"].alias("o"), s["bpm"].alias("bpm"))))["bpm"]
    return both.select("mix_id", "idx", "t", F.coalesce(inside, near).alias("bpm"))


@query(
    "beats_between",
    """SELECT x.mix_id, x.idx, round(sum(greatest(0e0, least(t1, s.seg_end) - greatest(t0, s.seg_start)) * s.bpm / 60e0) + greatest(0e0, (t1 - t0) - sum(greatest(0e0, least(t1, s.seg_end) - greatest(t0, s.seg_start)))) * max(CASE WHEN (t0 >= s.seg_start AND t0 < s.seg_end) OR (t0 >= s.seg_end AND s.seg = 2) THEN s.bpm END) / 60e0, 6) AS beats
FROM (SELECT mix_id, idx, announced_t AS t0, lead(announced_t) OVER (PARTITION BY mix_id ORDER BY idx) AS t1 FROM v_transitions) x JOIN v_tempo_segments s ON x.mix_id = s.mix_id WHERE t1 > t0 GROUP BY x.mix_id, x.idx, t0, t1""",
)
def beats_between(v) -> DataFrame:
    """Beats from an announcement to the next: tempo integrated over the segments, what they leave out at the first one's tempo."""
    w = Window.partitionBy("mix_id").orderBy("idx")
    spans = v["transitions"].select("mix_id", "idx", F.col("announced_t").alias("t0"), F.lead("announced_t").over(w).alias("t1")).where("t1 > t0")
    start = bpm_at(v).select("mix_id", "idx", F.col("bpm").alias("bpm0"))
    over = F.greatest(F.lit(0.0), F.least("t1", "seg_end") - F.greatest("t0", "seg_start"))
    sums = spans.join(v["tempo_segments"], "mix_id").groupBy("mix_id", "idx", "t0", "t1").agg(F.sum(over * F.col("bpm") / 60.0).alias("b"), F.sum(over).alias("c"))
    rest = F.greatest(F.lit(0.0), F.col("t1") - F.col("t0") - F.col("c"))
    return sums.join(start, ["mix_id", "idx"]).select("mix_id", "idx", F.round(F.col("b") + rest * F.col("bpm0") / 60.0, 6).alias("beats"))


sql_query("active_clips_at", "SELECT set_id, pos, track_id, CASE WHEN 40e0 < out_start + fade_in THEN (40e0 - out_start) / fade_in WHEN 40e0 > out_end - fade_out THEN (out_end - 40e0) / fade_out ELSE 1e0 END AS gain FROM v_clips WHERE out_start <= 40e0 AND 40e0 < out_end")
sql_query(
    "max_concurrency",
    # An event sweep: +1 at a start, -1 at an end, ends first.
    """SELECT set_id, CAST(max(n) AS BIGINT) AS layers FROM (SELECT set_id, sum(d) OVER (PARTITION BY set_id ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
 FROM (SELECT set_id, out_start AS t, 1 AS d FROM v_clips UNION ALL SELECT set_id, out_end AS t, -1 AS d FROM v_clips) e) s GROUP BY set_id""",
)
sql_query(
    "pair_occurrence",
    """SELECT set_id, pos, prev_track, track_id, CAST(row_number() OVER (PARTITION BY set_id, prev_track, track_id ORDER BY pos) - 1 AS BIGINT) AS occurrence
FROM (SELECT set_id, pos, track_id, lag(track_id) OVER (PARTITION BY set_id ORDER BY pos) AS prev_track FROM v_clips) p WHERE prev_track IS NOT NULL""",
)
sql_query("marker_gaps", "SELECT set_id, pos, out_start, out_start - lag(out_start, 1, 0e0) OVER (PARTITION BY set_id ORDER BY pos) AS gap FROM v_clips")


_HOLES = "(SELECT track_id, sec, CASE WHEN sec % 5 = 2 OR sec % 7 = 3 THEN NULL ELSE energy END AS x FROM v_energy)"


@query(
    "fill_missing_linear",
    f"""SELECT track_id, sec, round(CASE WHEN x IS NOT NULL THEN x WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + (b - a) * (sec - sa) / CAST(sb - sa AS DOUBLE) END, 6) AS filled FROM (
 SELECT track_id, sec, x, last_value(x IGNORE NULLS) OVER p AS a, last_value(CASE WHEN x IS NOT NULL THEN sec END IGNORE NULLS) OVER p AS sa, first_value(x IGNORE NULLS) OVER n AS b, first_value(CASE WHEN x IS NOT NULL THEN sec END IGNORE NULLS) OVER n AS sb FROM {_HOLES} h
 WINDOW p AS ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS ({_E} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) y""",
)
def fill_missing_linear(v) -> DataFrame:
    """Gaps of a series by linear interpolation, flat at its ends."""
    x = F.when((F.col("sec") % 5 == 2) | (F.col("sec") % 7 == 3), None).otherwise(F.col("energy"))
    rows = v["energy"].select("track_id", "sec", x.alias("x")).withColumn("at", F.when(F.col("x").isNotNull(), F.struct("x", "sec")))
    p, n = _by_second().rowsBetween(Window.unboundedPreceding, 0), _by_second().rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("a", F.last("at", True).over(p)).withColumn("b", F.first("at", True).over(n))
    line = F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("sec") - F.col("a.sec")) / (F.col("b.sec") - F.col("a.sec"))
    return rows.select("track_id", "sec", F.round(F.coalesce("x", F.when(F.col("a").isNull(), F.col("b.x")).when(F.col("b").isNull(), F.col("a.x")).otherwise(line)), 6).alias("filled"))


sql_query(
    "octave_outliers",
    """WITH m1 AS (SELECT mix_id, percentile(bpm, 0.5) AS m FROM v_tempo_segments GROUP BY mix_id), k1 AS (SELECT s.mix_id, s.seg, s.bpm FROM v_tempo_segments s JOIN m1 ON s.mix_id = m1.mix_id WHERE abs(s.bpm - m) / m <= 0.03e0),
m2 AS (SELECT mix_id, percentile(bpm, 0.5) AS m FROM k1 GROUP BY mix_id) SELECT k1.mix_id, seg, bpm FROM k1 JOIN m2 ON k1.mix_id = m2.mix_id WHERE abs(bpm - m) / m <= 0.03e0""",
    """WITH m1 AS (SELECT mix_id, quantile_cont(bpm, 0.5) AS m FROM v_tempo_segments GROUP BY mix_id), k1 AS (SELECT s.mix_id, s.seg, s.bpm FROM v_tempo_segments s JOIN m1 ON s.mix_id = m1.mix_id WHERE abs(s.bpm - m) / m <= 0.03e0),
m2 AS (SELECT mix_id, quantile_cont(bpm, 0.5) AS m FROM k1 GROUP BY mix_id) SELECT k1.mix_id, seg, bpm FROM k1 JOIN m2 ON k1.mix_id = m2.mix_id WHERE abs(bpm - m) / m <= 0.03e0""",
)
sql_query(
    "gap_runs",
    # Runs of seconds without supply, by gaps and islands.
    """SELECT track_id, min(sec) AS start_sec, count(*) AS seconds FROM (SELECT track_id, sec, sec - row_number() OVER (PARTITION BY track_id ORDER BY sec) AS g FROM v_energy WHERE energy < 0.2e0) x GROUP BY track_id, g HAVING count(*) >= 2""",
)
sql_query(
    "chunk_ids",
    # The chunk of ten seconds each clip's end falls into, from the running length.
    """SELECT set_id, pos, CAST(floor(total / 10e0) AS BIGINT) AS chunk, round(total - 10e0 * floor(total / 10e0), 6) AS carry FROM (SELECT set_id, pos, sum(out_end - out_start) OVER (PARTITION BY set_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM v_clips) c""",
)
sql_query(
    "playback_clamp",
    # Reported positions never go back, and never beyond what was generated.
    """SELECT track_id, sec, least(max(value) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 10e0 * (sec + 1)) AS played FROM v_energy WHERE value >= 0e0""",
)
sql_query(
    "scheduler_candidates",
    # Out cues ahead of a position, within sixteen bars and over the least confidence; the best fires within eight bars.
    """SELECT track_id, ts, confidence, CASE WHEN ts - 30e0 <= 8e0 * 240e0 / bpm THEN 1 ELSE 0 END AS fires FROM (SELECT c.track_id, c.ts, c.confidence, t.bpm, row_number() OVER (PARTITION BY c.track_id ORDER BY c.confidence DESC, c.pos) AS rn
 FROM v_cues c JOIN v_tracks t ON c.track_id = t.track_id WHERE c.type = 'out' AND c.ts > 30e0 AND c.ts < 30e0 + 16e0 * 240e0 / t.bpm AND c.confidence > 0.25e0) x WHERE rn = 1""",
)
sql_query(
    "moving_average",
    "SELECT track_id, sec, round(sum(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5e0, 6) AS adaptive_mean FROM v_energy",
)
sql_query(
    "first_crossing",
    # The first time the running energy share passes one half, interpolated between seconds.
    """SELECT track_id, round(min(sec - 1 + (0.5e0 - p) / (c - p)), 6) AS t FROM (SELECT track_id, sec, c, lag(c, 1, 0e0) OVER (PARTITION BY track_id ORDER BY sec) AS p FROM (SELECT track_id, sec, sum(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (sum(energy) OVER (PARTITION BY track_id) + 1e-12) AS c FROM v_energy) a) b WHERE c >= 0.5e0 AND p < 0.5e0 GROUP BY track_id""",
)
sql_query("best_cues", "SELECT track_id, type, pos, ts, confidence FROM (SELECT *, row_number() OVER (PARTITION BY track_id, type ORDER BY confidence DESC, pos) AS rn FROM v_cues) c WHERE rn = 1")
sql_query(
    "set_entry_cue",
    # The most confident in cue of the first two fifths, else the earliest.
    """SELECT track_id, ts FROM (SELECT c.track_id, c.ts, row_number() OVER (PARTITION BY c.track_id ORDER BY CASE WHEN c.ts <= greatest(1e0, 0.4e0 * t.duration) THEN 0 ELSE 1 END, CASE WHEN c.ts <= greatest(1e0, 0.4e0 * t.duration) THEN -c.confidence ELSE c.ts END, c.pos) AS rn
 FROM v_cues c JOIN v_tracks t ON c.track_id = t.track_id WHERE c.type = 'in') x WHERE rn = 1""",
)
sql_query(
    "exit_cue",
    # Out cues from thirty seconds on: those with energy first, then the most confident.
    """SELECT track_id, ts, energy FROM (SELECT c.track_id, c.ts, c.energy, row_number() OVER (PARTITION BY c.track_id ORDER BY CASE WHEN c.energy >= 0.4e0 THEN 0 ELSE 1 END, c.confidence DESC, c.pos) AS rn
 FROM v_cues c JOIN v_tracks t ON c.track_id = t.track_id WHERE c.type = 'out' AND c.ts >= 30e0 AND c.ts < t.duration) x WHERE rn = 1""",
)
