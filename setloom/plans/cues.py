"""Where a track is left and entered: the cues that plans take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: bars that a track plays alone at least.
SOLO_BARS = 32

EXIT = f"""(SELECT track_id, ts, energy, embedding FROM (SELECT c.track_id, c.ts, c.energy, c.embedding, row_number() OVER (PARTITION BY c.track_id ORDER BY CASE WHEN c.energy >= 0.4e0 THEN 0 ELSE 1 END, c.confidence DESC, c.pos) AS rn
 FROM v_cues c JOIN v_tracks t ON c.track_id = t.track_id WHERE c.type = 'out' AND c.ts >= {SOLO_BARS}e0 * 240e0 / t.bpm AND c.ts < t.duration) x WHERE rn = 1)"""
ENTRY = """(SELECT track_id, ts, energy, embedding FROM (SELECT c.track_id, c.ts, c.energy, c.embedding, row_number() OVER (PARTITION BY c.track_id ORDER BY CASE WHEN c.ts <= greatest(1e0, 0.4e0 * t.duration) THEN 0 ELSE 1 END, CASE WHEN c.ts <= greatest(1e0, 0.4e0 * t.duration) THEN -c.confidence ELSE c.ts END, c.pos) AS rn
 FROM v_cues c JOIN v_tracks t ON c.track_id = t.track_id WHERE c.type = 'in') x WHERE rn = 1)"""


def exits(cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track_id, out_t, out_energy, out_vector): the exit of each track: an energetic, confident out cue after its solo."""
    t = cues.where("type = 'out'").join(tracks.select("track_id", "bpm", "duration"), "track_id").where((F.col("ts") >= SOLO_BARS * 240.0 / F.col("bpm")) & (F.col("ts") < F.col("duration")))
    best = t.groupBy("track_id").agg(F.max(F.struct((F.col("energy") >= 0.4).alias("a"), "confidence", (-F.col("pos")).alias("b"), "ts", "energy", "embedding")).alias("m"))
    return best.select("track_id", F.col("m.ts").alias("out_t"), F.col("m.energy").alias("out_energy"), F.col("m.embedding").alias("out_vector"))


def entries(cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track_id, in_t, in_energy, in_vector): the most confident in cue of the first two fifths, else the earliest."""
    t = cues.where("type = 'in'").join(tracks.select("track_id", "duration"), "track_id").withColumn("early", F.col("ts") <= F.greatest(F.lit(1.0), 0.4 * F.col("duration")))
    best = t.groupBy("track_id").agg(F.max(F.struct("early", F.when(F.col("early"), F.col("confidence")).otherwise(-F.col("ts")).alias("a"), (-F.col("pos")).alias("b"), "ts", "energy", "embedding")).alias("m"))
    return best.select("track_id", F.col("m.ts").alias("in_t"), F.col("m.energy").alias("in_energy"), F.col("m.embedding").alias("in_vector"))
