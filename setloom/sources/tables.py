"""Tables: what is stale, upserts that keep the newest row, additive columns, listings, exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setloom.operators.ordered import positions
from setloom.registry import query

_POINT = "struct<t:double,type:string,confidence:double,energy:double,phrase_aligned:boolean,embedding:array<float>>"
#: The stored tables: typed columns, nested where a row has lists. Keys are unique by ``upsert``.
SCHEMAS = {
    "tracks": f"id long, file_path string, file_hash string, title string, duration double, bpm double, bpm_confidence double, beats array<double>, downbeats array<double>, phrases array<double>, key string, key_name string, key_confidence double, energy_curve array<double>, sections array<struct<start:double,end:double,label:string>>, cue_points array<{_POINT}>, analyzed_at double, loudness double",
    "meta": "key string, value string",
    "mixes": "id long, file_path string, file_hash string, title string, artist string, duration double, n_tracks int, tracklist array<struct<t:double,artist:string,title:string,genre:string>>, tempo_segments array<struct<start:double,end:double,bpm:double,phase:double,confidence:double>>, energy_curve array<double>, source string, mined_at double, miner_version int",
    "transitions": "mix_id long, idx int, announced_t double, status string, reject_reason string, track_a string, track_b string, t_start double, t_end double, t_center double, t_bass double, duration_sec double, duration_beats double, duration_bars double, is_cut int, bpm_before double, bpm_after double, tempo_step_pct double, key_before string, key_after string, camelot_score double, dwell_bars double, solo_bars double, genre string, confidence double, sub_scores map<string,double>",
}

AUDIO = (".mp3", ".flac", ".wav", ".ogg", ".m4a", ".aiff", ".aif", ".opus")
SIDECARS = (".json", ".cue", ".txt")


def open_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with the columns of its schema, made empty where there is none; columns it was written without are null."""
    kind = spark.createDataFrame([], SCHEMAS[name]).schema
    path = f"{folder}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], kind).write.parquet(path)
    return with_columns(spark.read.option("mergeSchema", "true").parquet(path), SCHEMAS[name])


def with_columns(rows: DataFrame, schema: str) -> DataFrame:
    """The rows with every column of a schema, the missing ones null; columns that it doesn't have stay behind."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return empty.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema if f.name in rows.columns]), allowMissingColumns=True).select(*empty.columns)


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The table of settings with one value set."""
    new = meta.sparkSession.createDataFrame([(key, value)], SCHEMAS["meta"])
    return replace_group(meta, new, "key")


def upsert_by_id(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``upsert`` of rows without ids: a known key keeps its id, new ones go on from the largest, in order of the number ``order``."""
    ids = stored.select(key, "id")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    known = new.drop("id").join(ids, key)
    fresh = positions(new.drop("id").join(ids, key, "left_anti"), order, [key], name="_at").withColumn("id", F.col("_at") + top + 1).drop("_at")
    return replace_group(stored, known.unionByName(fresh), key)


def stale(found: DataFrame, stored: DataFrame, key: str = "file_path", mark: str = "file_hash") -> DataFrame:
    """The rows of ``found`` that are not stored, or stored with another mark."""
    known = stored.select(key, F.col(mark).alias("_mark"))
    return found.join(known, key, "left").where(F.col("_mark").isNull() | (F.col("_mark") != F.col(mark))).drop("_mark")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows with one row a key, the last by ``order``, of equals the new one; new columns are added."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def replace_group(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows of keys that ``new`` doesn't have, and the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def scan_files(spark: SparkSession, folder: str, extensions: Iterable[str] = AUDIO, ignore: Iterable[str] = ()) -> DataFrame:
    """Path, length and time of the files below a folder, of some extensions, without those whose names match an ignored pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.lower(F.substring_index("path", "/", -1))
    out = files.where(F.concat(F.lit("."), F.substring_index(name, ".", -1)).isin(*[e.lower() for e in extensions]))
    for glob in ignore:
        out = out.where(~name.like(glob.lower().replace("_", "\\_").replace("*", "%").replace("?", "_")))
    return out.orderBy("path")


def pair_sidecars(audio: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Each audio path with its sidecar: json before cue before txt, "name.ext" before "name.mp3.ext"; none is null."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    side = sidecars.select(F.col("path").alias("sidecar"), stem(F.col("path")).alias("_stem"), F.coalesce(*[F.when(F.col("path").endswith(e), i) for i, e in enumerate(SIDECARS)]).alias("_kind")).where("_kind is not null")
    names = audio.select("path", F.explode(F.array(F.struct(stem(F.col("path")).alias("s"), F.lit(0).alias("r")), F.struct(F.col("path").alias("s"), F.lit(1).alias("r")))).alias("n"))
    best = names.join(side, F.col("n.s") == F.col("_stem")).groupBy("path").agg(F.min(F.struct("_kind", "n.r", "sidecar"))["sidecar"].alias("sidecar"))
    return audio.select("path").join(best, "path", "left")


def read_provenance(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_provenance(rows: DataFrame, path: str) -> None:
    """More JSON lines beside those that are there."""
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report's rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_timeline(clips: DataFrame, path: str) -> None:
    """One JSON line a set: its clips in order."""
    sets = clips.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("pos", "clip_track", "title", "out_start", "out_end"))).alias("clips"))
    sets.select(F.to_json(F.struct("set_id", "clips")).alias("value")).write.mode("overwrite").text(path)


def _marked(v) -> DataFrame:
    return v["tracks"].select("file_path", "title", F.md5(F.concat_ws(":", F.col("track_id").cast("string"), F.col("duration").cast("long").cast("string")).cast("binary")).alias("file_hash"), "track_id")


_MARK = "md5(concat_ws(':', CAST(track_id AS VARCHAR), CAST(CAST(duration AS BIGINT) AS VARCHAR)))"


@query("stale_tracks", "SELECT track_id, title FROM v_tracks WHERE track_id % 3 = 0 OR track_id % 5 = 1")
def stale_tracks(v) -> DataFrame:
    """Tracks of which every third was never stored, and every fifth in another state."""
    found = _marked(v)
    stored = found.where("track_id % 3 <> 0").withColumn("file_hash", F.when(F.col("track_id") % 5 == 1, "other").otherwise(F.col("file_hash")))
    return stale(found, stored).select("track_id", "title")


@query("latest_upsert", "SELECT o_custkey AS mix_id, o_orderkey AS row_id, o_orderpriority AS genre FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_upsert(v) -> DataFrame:
    rows = v.table("orders").select(F.col("o_custkey").alias("mix_id"), F.col("o_orderkey").alias("row_id"), F.struct("o_orderdate", F.col("o_orderkey") % 2, "o_orderkey").alias("order"), F.col("o_orderpriority").alias("genre"))
    return upsert(rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1"), ["mix_id"], "order").select("mix_id", "row_id", "genre")


@query("replace_mixes", "SELECT mix_id, idx, CASE WHEN mix_id % 4 = 0 THEN 'new' ELSE status END AS status FROM v_transitions WHERE mix_id % 4 <> 0 OR idx <= 2")
def replace_mixes(v) -> DataFrame:
    """Every fourth mix mined again, with two transitions: its old rows go."""
    rows = v["transitions"].select("mix_id", "idx", "status")
    return replace_group(rows, rows.where("mix_id % 4 = 0 and idx <= 2").withColumn("status", F.lit("new")), "mix_id")


@query("mix_ids", """SELECT f.mix_id, coalesce(s.id, CAST((SELECT max(mix_id) FROM v_transitions WHERE mix_id % 3 <> 0) + row_number() OVER (PARTITION BY s.id IS NULL ORDER BY f.mix_id) AS BIGINT)) AS id, f.n_tracks
FROM (SELECT mix_id, CAST(count(*) AS INTEGER) AS n_tracks FROM v_transitions GROUP BY mix_id) f LEFT JOIN (SELECT DISTINCT mix_id, CAST(mix_id AS BIGINT) AS id FROM v_transitions WHERE mix_id % 3 <> 0) s ON f.mix_id = s.mix_id""")
def mix_ids(v) -> DataFrame:
    """All mixes mined again over a table that lacks every third: known ones keep their ids, and count their track lists."""
    lists = v["transitions"].groupBy("mix_id").agg(F.collect_list("announced_t").alias("tracklist"))
    new = lists.select("mix_id", F.size("tracklist").alias("n_tracks"))
    stored = new.where("mix_id % 3 <> 0").withColumn("id", F.col("mix_id").cast("long"))
    return upsert_by_id(stored, new, "mix_id", "mix_id").select("mix_id", "id", "n_tracks")
