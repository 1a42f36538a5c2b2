"""Sets: a plan for each pair of consecutive tracks, their times on the set's clock, what to play next, where parts begin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setloom.functions.harmony import beatmatchable, key_compatibility
from setloom.functions.vectors import cosine
from setloom.operators.corpus import holdout_split
from setloom.operators.graph import _TRACK_SIMS, key_sql, match_sql, track_similarities
from setloom.plans.cues import ENTRY, EXIT, SOLO_BARS, entries, exits
from setloom.plans.planner import SIMILARITY, STYLE, style, tie_draw
from setloom.registry import query, sql_query

#: Bars of a transition by style.
BARS = {"cut": 0, "blend": 16, "swap": 8, "fade": 12, "build": 8}

_PLANS = f"""SELECT set_id, pos, src, dst, out_t, CASE WHEN floor(in_t / bar + 0.5e0) < n_down AND abs(floor(in_t / bar + 0.5e0) * bar - in_t) <= bar / 2e0 THEN floor(in_t / bar + 0.5e0) * bar ELSE in_t END AS in_t, harm,
 {STYLE} AS style FROM (
 SELECT p.set_id, p.pos, p.src, p.dst, coalesce(x.ts, CASE WHEN {SOLO_BARS} < a.n_downbeats AND {SOLO_BARS}e0 * 240e0 / a.bpm < a.duration THEN {SOLO_BARS}e0 * 240e0 / a.bpm ELSE greatest(0e0, a.duration - 240e0 / a.bpm) END) AS out_t, coalesce(n.ts, 0e0) AS in_t,
  240e0 / b.bpm AS bar, b.n_downbeats AS n_down, {match_sql("a", "b")} AS matched, {key_sql("a", "b")} AS harm, coalesce(x.energy, 0.5e0) AS eo, coalesce(n.energy, 0.5e0) AS ei, {SIMILARITY} AS sim
 FROM (SELECT set_id, pos, lag(track_id) OVER (PARTITION BY set_id ORDER BY pos) AS src, track_id AS dst FROM v_clips) p JOIN v_tracks a ON p.src = a.track_id JOIN v_tracks b ON p.dst = b.track_id LEFT JOIN {EXIT} x ON x.track_id = p.src LEFT JOIN {ENTRY} n ON n.track_id = p.dst) q"""


def plans(v) -> DataFrame:
    """A plan for each track of a set after the first: exit, entry on a downbeat, key score and style."""
    tracks, cues = v["tracks"].select("track_id", "bpm", "duration", "n_downbeats", "key_num", "mode"), v["cues"]
    a = tracks.join(exits(cues, tracks), "track_id", "left").select(F.col("track_id").alias("src"), F.struct("*").alias("a"))
    b = tracks.join(entries(cues, tracks), "track_id", "left").select(F.col("track_id").alias("dst"), F.struct("*").alias("b"))
    pairs = v["clips"].select("set_id", "pos", F.lag("track_id").over(Window.partitionBy("set_id").orderBy("pos")).alias("src"), F.col("track_id").alias("dst")).where("src is not null")
    solo, bar = SOLO_BARS * 240.0 / F.col("a.bpm"), 240.0 / F.col("b.bpm")
    no_cue = F.when((F.col("a.n_downbeats") > SOLO_BARS) & (solo < F.col("a.duration")), solo).otherwise(F.greatest(F.lit(0.0), F.col("a.duration") - 240.0 / F.col("a.bpm")))
    into = F.coalesce("b.in_t", F.lit(0.0))
    beat = F.floor(into / bar + 0.5)
    snapped = F.when((beat < F.col("b.n_downbeats")) & (F.abs(beat * bar - into) <= bar / 2.0), beat * bar).otherwise(into)
    kind = style(beatmatchable(F.col("a.bpm"), F.col("b.bpm")), cosine(F.col("a.out_vector"), F.col("b.in_vector")), F.col("a.out_energy"), F.col("b.in_energy"), tie_draw(F.col("src"), F.col("dst")))
    harm = key_compatibility(F.col("a.key_num"), F.col("a.mode"), F.col("b.key_num"), F.col("b.mode"))
    return pairs.join(a, "src").join(b, "dst").select("set_id", "pos", "src", "dst", F.coalesce("a.out_t", no_cue).alias("out_t"), snapped.alias("in_t"), harm.alias("harm"), kind.alias("style"))


@query("transition_plans", f"SELECT set_id, pos, src, dst, round(out_t, 6) AS out_t, round(in_t, 6) AS in_t, harm, style FROM ({_PLANS}) z")
def transition_plans(v) -> DataFrame:
    return plans(v).select("set_id", "pos", "src", "dst", F.round("out_t", 6).alias("out_t"), F.round("in_t", 6).alias("in_t"), "harm", "style")


@query(
    "set_timeline",
    f"""SELECT set_id, pos, round(sum(greatest(0e0, out_t - coalesce(prev_in, 0e0))) OVER (PARTITION BY set_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS starts_at, CASE style WHEN 'cut' THEN 0 WHEN 'blend' THEN 16 WHEN 'swap' THEN 8 WHEN 'fade' THEN 12 ELSE 8 END AS bars
FROM (SELECT *, lag(in_t) OVER (PARTITION BY set_id ORDER BY pos) AS prev_in FROM ({_PLANS}) y) z""",
)
def set_timeline(v) -> DataFrame:
    """When each transition of a set starts: the time that every track before it plays, from its entry to its exit."""
    w = Window.partitionBy("set_id").orderBy("pos")
    rows = plans(v).withColumn("plays", F.greatest(F.lit(0.0), F.col("out_t") - F.coalesce(F.lag("in_t").over(w), F.lit(0.0))))
    bars = F.coalesce(*[F.when(F.col("style") == s, n) for s, n in BARS.items()])
    return rows.select("set_id", "pos", F.round(F.sum("plays").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("starts_at"), bars.alias("bars"))


@query(
    "pick_next",
    f"""WITH r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM ({_TRACK_SIMS}) s WHERE sim IS NOT NULL),
h AS (SELECT r.a, r.b, r.sim, {key_sql("x", "y")} AS harm FROM r JOIN v_tracks x ON r.a = x.track_id JOIN v_tracks y ON r.b = y.track_id WHERE rn <= 6)
SELECT a AS track_id, b AS next_track, sim, harm FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY harm DESC, sim DESC, b) AS k FROM h) z WHERE k = 1""",
)
def pick_next(v, nearest: int = 6) -> DataFrame:
    """Of the six tracks that sound most like a track the one whose key fits best."""
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    near = track_similarities(v).where("sim is not null").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= nearest)
    keys = v["tracks"].select("track_id", "key_num", "mode")
    x, y = (keys.select(F.col("track_id").alias(n), F.col("key_num").alias(f"k{n}"), F.col("mode").alias(f"m{n}")) for n in "ab")
    scored = near.join(x, "a").join(y, "b").withColumn("harm", key_compatibility(F.col("ka"), F.col("ma"), F.col("kb"), F.col("mb")))
    best = scored.groupBy("a").agg(F.max(F.struct("harm", "sim", (-F.col("b")).alias("o"))).alias("m"))
    return best.select(F.col("a").alias("track_id"), (-F.col("m.o")).alias("next_track"), F.col("m.sim").alias("sim"), F.col("m.harm").alias("harm"))


sql_query(
    "section_starts",
    # Novelty of energy, four seconds before against four after; its peaks within four seconds, the five highest of a track.
    """SELECT track_id, sec, round(novelty, 6) AS novelty FROM (SELECT track_id, sec, novelty, row_number() OVER (PARTITION BY track_id ORDER BY round(novelty, 9) DESC, sec) AS rn FROM (
 SELECT track_id, sec, novelty, max(novelty) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top FROM (
 SELECT track_id, sec, coalesce(abs(avg(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - avg(energy) OVER (PARTITION BY track_id ORDER BY sec ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), 0e0) AS novelty FROM v_energy) a) b WHERE novelty > 0e0 AND novelty >= top) c WHERE rn <= 5""",
)


_HELD = """(SELECT mix_id, r <= greatest(1, CAST(round(n * 0.2e0) AS BIGINT)) AND n > 1 AS held FROM (SELECT mix_id, row_number() OVER (ORDER BY md5(CAST(mix_id AS VARCHAR(20))), mix_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT mix_id FROM v_transitions) m) x)"""
_COMPARED = f"""WITH c AS (SELECT t.is_cut, 4e0 * t.duration_bars AS beats, h.held FROM v_transitions t JOIN {_HELD} h ON t.mix_id = h.mix_id WHERE status = 'ok' AND confidence >= 0.5e0),
own AS (SELECT * FROM c WHERE held OR NOT EXISTS (SELECT 1 FROM c d WHERE d.held)), corpus AS (SELECT beats AS x FROM own WHERE is_cut = 0 AND beats IS NOT NULL),
p AS (SELECT style FROM ({_PLANS}) z), engine AS (SELECT CASE style WHEN 'blend' THEN 64e0 WHEN 'fade' THEN 48e0 ELSE 32e0 END AS x FROM p WHERE style <> 'cut'),
g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT x, 1 AS a, 0 AS b FROM corpus UNION ALL SELECT x, 0, 1 FROM engine) u GROUP BY x), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM g),
w AS (SELECT abs(sum(a) OVER (ORDER BY x) / CAST(na AS DOUBLE) - sum(b) OVER (ORDER BY x) / CAST(nb AS DOUBLE)) * (lead(x) OVER (ORDER BY x) - x) AS d FROM g, n), m AS (SELECT median(x) AS centre FROM engine)
SELECT metric, round(CAST(value AS DOUBLE), 4) AS value FROM (SELECT 'corpus_n' AS metric, count(*) AS value FROM corpus UNION ALL SELECT 'corpus_median', median(x) FROM corpus UNION ALL SELECT 'engine_n', count(*) FROM engine UNION ALL SELECT 'engine_median', centre FROM m UNION ALL SELECT 'wasserstein', sum(d) FROM w
 UNION ALL SELECT 'corpus_cut_rate', avg(is_cut) FROM own UNION ALL SELECT 'engine_cut_rate', avg(CASE WHEN style = 'cut' THEN 1e0 ELSE 0e0 END) FROM p UNION ALL SELECT 'median_error', median(abs(x - centre)) FROM corpus, m
 UNION ALL SELECT 'within_1', avg(CASE WHEN abs(x - centre) <= 1e0 THEN 1e0 ELSE 0e0 END) FROM corpus, m UNION ALL SELECT 'within_4', avg(CASE WHEN abs(x - centre) <= 4e0 THEN 1e0 ELSE 0e0 END) FROM corpus, m UNION ALL SELECT 'within_8', avg(CASE WHEN abs(x - centre) <= 8e0 THEN 1e0 ELSE 0e0 END) FROM corpus, m) r"""


@query("engine_comparison", _COMPARED)
def engine_comparison(v, min_confidence: float = 0.5) -> DataFrame:
    """Planned transitions against the held-out mixes' measured ones: lengths in beats, their distance, cuts, hits of the median length."""
    sides = holdout_split(v)
    rows = v["transitions"].where((F.col("status") == "ok") & (F.col("confidence") >= min_confidence)).join(sides, "mix_id")
    own = rows.where("side = 'test'")
    own = rows if own.isEmpty() else own
    corpus = own.where("is_cut = 0 and duration_bars is not null").select((4 * F.col("duration_bars")).alias("x"))
    planned = plans(v).select("style")
    engine = planned.where("style <> 'cut'").select(F.coalesce(*[F.when(F.col("style") == s, 4.0 * n) for s, n in BARS.items()]).alias("x"))
    n, median = corpus.agg(F.count(F.lit(1)), F.percentile("x", 0.5)).first()
    n_engine, centre = engine.agg(F.count(F.lit(1)), F.percentile("x", 0.5)).first()
    cuts, engine_cuts = own.agg(F.avg("is_cut")).first()[0], planned.agg(F.avg(F.when(F.col("style") == "cut", 1.0).otherwise(0.0))).first()[0]
    off = F.abs(F.col("x") - F.lit(centre))
    error, *within = corpus.agg(F.percentile(off, 0.5), *[F.avg(F.when(off <= t, 1.0).otherwise(0.0)) for t in (1, 4, 8)]).first()
    # Values are counted first; only the distinct ones meet in one window.
    counts = corpus.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(engine.withColumn("a", F.lit(0)).withColumn("b", F.lit(1))).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.orderBy("x")
    gap = F.abs(F.sum("a").over(w) / float(n or 1) - F.sum("b").over(w) / float(n_engine or 1)) * (F.lead("x").over(w) - F.col("x"))
    distance = counts.select(gap.alias("d")).agg(F.sum("d")).first()[0]
    values = {"corpus_n": n, "corpus_median": median, "engine_n": n_engine, "engine_median": centre, "wasserstein": distance, "corpus_cut_rate": cuts, "engine_cut_rate": engine_cuts, "median_error": error, **dict(zip(("within_1", "within_4", "within_8"), within, strict=True))}
    return v.spark.createDataFrame([(k, None if x is None else round(float(x), 4)) for k, x in values.items()], "metric string, value double")
