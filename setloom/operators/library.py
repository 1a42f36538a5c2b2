"""The library: listing, statistics, triage, gap report, text and path rules, timeline, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setloom.functions import text
from setloom.registry import query, sql_query

sql_query("library_stats", "SELECT count(*) AS n_tracks, round(avg(bpm), 6) AS mean_bpm, round(avg(duration), 6) AS mean_duration FROM v_tracks")
sql_query("library_order", "SELECT track_id, title, CAST(row_number() OVER (PARTITION BY mode, key_num ORDER BY title, track_id) AS BIGINT) AS position FROM v_tracks")


@query(
    "library_listing",
    """SELECT track_id, CASE WHEN length(title) > 40 THEN concat(substr(title, 1, 38), '..') ELSE title END AS title, concat(CAST(CAST(floor(duration / 60e0) AS BIGINT) AS VARCHAR), ':', lpad(CAST(CAST(duration AS BIGINT) % 60 AS VARCHAR), 2, '0')) AS length,
 round(bpm, 1) AS bpm, concat(CAST(key_num AS VARCHAR), mode) AS code, n_in, n_out FROM v_tracks""",
)
def library_listing(v) -> DataFrame:
    title = F.when(F.length("title") > 40, F.concat(F.substring("title", 1, 38), F.lit(".."))).otherwise(F.col("title"))
    return v["tracks"].select("track_id", title.alias("title"), text.minutes(F.col("duration")).alias("length"), F.round("bpm", 1).alias("bpm"), F.concat(F.col("key_num").cast("string"), "mode").alias("code"), "n_in", "n_out")


#: The limits that tracks are judged by.
MIN_DURATION, MIN_DOWNBEATS, MIN_TEMPO_CONFIDENCE, MIN_KEY_CONFIDENCE, MIN_CUES, TEMPO_LOW, TEMPO_HIGH, EDGE, MIN_COVERAGE = 90.0, 16, 0.35, 0.20, 2, 90.0, 180.0, 3.0, 0.60


def grade(tracks: DataFrame) -> DataFrame:
    """Adds hard and soft reasons and the grade: reject with a hard reason, usable with a soft one, else good.

    Coverage is the share of the track that its beats span, null without beats; phrases count only where cues are enough.
    """
    c = F.col
    in_range = (c("bpm") >= TEMPO_LOW) & (c("bpm") < TEMPO_HIGH)
    enough = (c("n_in") >= MIN_CUES) & (c("n_out") >= MIN_CUES)
    hard = {
        "duration": c("duration") < MIN_DURATION,
        "downbeats": c("n_downbeats") < MIN_DOWNBEATS,
        "tempo_confidence": c("bpm_confidence") < MIN_TEMPO_CONFIDENCE,
        "tempo_range": ~in_range,
        "coverage": c("beat_coverage") < MIN_COVERAGE,
        "cues": ~enough,
    }
    soft = {
        "tempo_edge": in_range & ((c("bpm") < TEMPO_LOW + EDGE) | (c("bpm") > TEMPO_HIGH - EDGE)),
        "phrase": enough & (c("n_phrase") == 0),
        "key_confidence": c("key_confidence") < MIN_KEY_CONFIDENCE,
        "sections": c("n_sections") == 0,
    }
    listed = lambda rules: F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    out = tracks.withColumn("hard", listed(hard)).withColumn("soft", listed(soft))
    return out.withColumn("grade", F.when(F.size("hard") > 0, "reject").when(F.size("soft") > 0, "usable").otherwise("good"))


_REASONS = """concat_ws(',', CASE WHEN duration < 90e0 THEN 'duration' END, CASE WHEN n_downbeats < 16 THEN 'downbeats' END, CASE WHEN bpm_confidence < 0.35e0 THEN 'tempo_confidence' END, CASE WHEN bpm < 90e0 OR bpm >= 180e0 THEN 'tempo_range' END, CASE WHEN beat_coverage < 0.6e0 THEN 'coverage' END, CASE WHEN n_in < 2 OR n_out < 2 THEN 'cues' END)"""
_SOFT = """concat_ws(',', CASE WHEN bpm >= 90e0 AND bpm < 180e0 AND (bpm < 93e0 OR bpm > 177e0) THEN 'tempo_edge' END, CASE WHEN n_in >= 2 AND n_out >= 2 AND n_phrase = 0 THEN 'phrase' END, CASE WHEN key_confidence < 0.2e0 THEN 'key_confidence' END, CASE WHEN n_sections = 0 THEN 'sections' END)"""
_TRIAGE = f"SELECT track_id, hard, soft, CASE WHEN hard <> '' THEN 'reject' WHEN soft <> '' THEN 'usable' ELSE 'good' END AS grade FROM (SELECT *, {_REASONS} AS hard, {_SOFT} AS soft FROM v_tracks)"


@query("triage", _TRIAGE)
def triage(v) -> DataFrame:
    order = F.when(F.col("grade") == "reject", 0).when(F.col("grade") == "usable", 1).otherwise(2)
    return grade(v["tracks"]).orderBy(order, F.desc(F.size("hard") + F.size("soft")), "track_id").select("track_id", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"), "grade")


@query("triage_counts", f"SELECT grade, count(*) AS n FROM ({_TRIAGE}) GROUP BY grade")
def triage_counts(v) -> DataFrame:
    return grade(v["tracks"]).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


sql_query("key_coverage", "SELECT count(DISTINCT concat(CAST(key_num AS VARCHAR(4)), mode)) AS n_keys, round(sum(duration) / 3600e0, 6) AS hours, count(*) FILTER (WHERE mean_energy < 0.45e0) AS n_low, count(*) FILTER (WHERE mean_energy > 0.7e0) AS n_high FROM v_tracks")
sql_query("pool_median_tempo", "SELECT mode, max(bpm) AS median_bpm FROM (SELECT mode, bpm, row_number() OVER (PARTITION BY mode ORDER BY bpm, track_id) AS rn, count(*) OVER (PARTITION BY mode) AS n FROM v_tracks) t WHERE rn = floor(n / 2e0) + 1 GROUP BY mode")

_CUT = "SELECT line_id, l, clock, substr(l, 1, strpos(l, clock) - 1) AS head, ltrim(substr(l, strpos(l, clock) + length(clock)), concat('])', ' ', chr(9))) AS rest FROM (SELECT line_id, trim(raw) AS l, regexp_extract(trim(raw), '[0-9]+(:[0-9]{2}){1,2}') AS clock FROM v_tracklines WHERE raw NOT LIKE '#%' AND raw NOT LIKE '//%') x WHERE clock <> ''"
_PARSED = f"""SELECT line_id, list_reduce(list_transform(string_split(clock, ':'), lambda c: CAST(c AS DOUBLE)), lambda a, b: a * 60e0 + b) AS t, label
FROM (SELECT line_id, clock, translate(head, concat('[( ', chr(9)), '') AS idx, trim(CASE WHEN contains('-–—:|', substr(rest, 1, 1)) THEN substr(rest, 2) ELSE rest END) AS label FROM ({_CUT}) c) p WHERE (idx = '' OR regexp_matches(idx, '^[0-9]{{1,3}}[.)]$')) AND label <> ''"""


def parsed_lines(v) -> DataFrame:
    lines = v["tracklines"].where(~F.col("raw").rlike(r"^\s*(#|//)") & (F.trim("raw") != ""))
    return lines.select("line_id", text.line_seconds(F.col("raw")).alias("t"), text.line_label(F.col("raw")).alias("label")).where("t is not null")


@query("tracklist_text", _PARSED)
def tracklist_text(v) -> DataFrame:
    """Track lines as seconds and label; comments are skipped, other lines are problems."""
    return parsed_lines(v)


sql_query(
    "tracklist_problems",
    r"SELECT line_id, raw FROM v_tracklines WHERE trim(raw) <> '' AND NOT (raw LIKE '#%') AND NOT (raw LIKE '//%') AND NOT (raw RLIKE '[0-9]{1,3}:[0-9]{2}')",
    r"SELECT line_id, raw FROM v_tracklines WHERE trim(raw) <> '' AND NOT (raw LIKE '#%') AND NOT (raw LIKE '//%') AND NOT regexp_matches(raw, '[0-9]{1,3}:[0-9]{2}')",
)


_TAGGED = f"""SELECT line_id, label, CASE WHEN size > 0 AND left(back, 1) IN (']', ')') THEN reverse(substr(back, 2, CAST(size AS BIGINT) - 2)) END AS held, CAST(size AS BIGINT) AS size FROM (
 SELECT line_id, label, back, coalesce(least(nullif(strpos(back, '['), 0), nullif(strpos(back, '('), 0)), 0) AS size FROM (SELECT line_id, label, reverse(trim(label)) AS back FROM ({_PARSED}) q) r) s"""


@query(
    "tracklist_labels",
    f"""WITH g AS (SELECT line_id, label, size, CASE WHEN length(held) BETWEEN 3 AND 30 AND NOT contains(held, ']') AND NOT contains(held, ')') AND NOT regexp_matches(held, '[0-9]{{4}}') THEN trim(held) END AS genre FROM ({_TAGGED}) t),
c AS (SELECT line_id, genre, CASE WHEN genre IS NULL THEN label ELSE trim(substr(trim(label), 1, length(trim(label)) - size)) END AS label FROM g)
SELECT line_id, CASE WHEN contains(label, ' - ') THEN trim(split_part(label, ' - ', 1)) END AS artist, CASE WHEN contains(label, ' - ') THEN trim(substr(label, strpos(label, ' - ') + 3)) ELSE trim(label) END AS title, genre FROM c""",
)
def tracklist_labels(v) -> DataFrame:
    rows = parsed_lines(v).select("line_id", text.genre_tag(F.col("label")).alias("genre"), text.without_tag(F.col("label")).alias("label"))
    return rows.select("line_id", text.artist(F.col("label")).alias("artist"), text.title(F.col("label")).alias("title"), "genre")


def kept_entries(lines: DataFrame) -> DataFrame:
    """(list, line_id, t, position) of rows (list, line_id, t): in order of time, what is not after the last entry kept goes; of equal times the first line stays."""
    first = lines.groupBy("list", "t").agg(F.min("line_id").alias("line_id"))
    return first.select("list", "line_id", "t", F.row_number().over(Window.partitionBy("list").orderBy("t")).cast("long").alias("position"))


def _lists(v) -> DataFrame:
    return parsed_lines(v).select((F.col("line_id") % 97).alias("list"), "line_id", "t")


_KEPT = f"SELECT list, line_id, t, CAST(row_number() OVER (PARTITION BY list ORDER BY t) AS BIGINT) AS position FROM (SELECT line_id % 97 AS list, t, min(line_id) AS line_id FROM ({_PARSED}) p GROUP BY line_id % 97, t) f"


@query("tracklist_kept", _KEPT)
def tracklist_kept(v) -> DataFrame:
    """The entries that stay of each list."""
    return kept_entries(_lists(v))


@query("tracklist_monotone", f"SELECT list, n_lines, n_kept, n_lines - n_kept AS n_dropped, CASE WHEN first_t > 60e0 THEN 1 ELSE 0 END AS late_start FROM (SELECT list, count(*) AS n_kept, min(t) AS first_t FROM ({_KEPT}) k GROUP BY list) a JOIN (SELECT line_id % 97 AS l, count(*) AS n_lines FROM ({_PARSED}) p GROUP BY line_id % 97) b ON a.list = b.l")
def tracklist_monotone(v) -> DataFrame:
    """By list: its entries, those that stay and those dropped, and whether the first one starts late."""
    lines = _lists(v)
    n = lines.groupBy("list").agg(F.count(F.lit(1)).alias("n_lines"))
    kept = kept_entries(lines).groupBy("list").agg(F.count(F.lit(1)).alias("n_kept"), F.min("t").alias("first_t"))
    return n.join(kept, "list").select("list", "n_lines", "n_kept", (F.col("n_lines") - F.col("n_kept")).alias("n_dropped"), F.when(F.col("first_t") > 60, 1).otherwise(0).alias("late_start"))


@query(
    "cue_sheet",
    """WITH s AS (SELECT CAST(o_orderkey AS BIGINT) AS sheet, concat('TRACK 01 AUDIO', chr(10), 'TITLE "', o_orderpriority, '"', chr(10), 'PERFORMER "', o_orderstatus, '"', chr(10), 'INDEX 01 ', lpad(CAST(o_orderkey % 60 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST((o_orderkey * 7) % 60 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST(o_orderkey % 75 AS VARCHAR(20)), 2, '0')) AS raw FROM orders)
SELECT sheet, CAST(2 AS BIGINT) AS track, NULL AS title, 'Second' AS performer, 4200e0 AS t FROM s UNION ALL SELECT sheet, CAST(1 AS BIGINT) AS track, regexp_extract(raw, 'TITLE "([^"]*)"', 1) AS title, regexp_extract(raw, 'PERFORMER "([^"]*)"', 1) AS performer, round(60e0 * CAST(regexp_extract(raw, 'INDEX 01 ([0-9]+):', 1) AS DOUBLE) + CAST(regexp_extract(raw, 'INDEX 01 [0-9]+:([0-9]+)', 1) AS DOUBLE) + CAST(regexp_extract(raw, ':([0-9]+)$', 1) AS DOUBLE) / 75e0, 6) AS t FROM s""",
)
def cue_sheet(v) -> DataFrame:
    """Cue sheets, line by line: a TRACK opens a block, whose first TITLE, PERFORMER and INDEX 01 count."""
    key = F.col("o_orderkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    raw = F.concat(F.lit('TRACK 01 AUDIO\nTITLE "'), "o_orderpriority", F.lit('"\nPERFORMER "'), "o_orderstatus", F.lit('"\nINDEX 01 '), two(key % 60), F.lit(":"), two((key * 7) % 60), F.lit(":"), two(key % 75), F.lit('\nTRACK 02 AUDIO\n  PERFORMER "Second"\n  INDEX 00 69:58:00\n  INDEX 01 70:00:00\nTRACK 03 AUDIO\n  TITLE "no time"'))
    return parse_cue_sheets(v.table("orders").select(key.cast("long").alias("sheet"), raw.alias("raw")))


def parse_cue_sheets(sheets: DataFrame) -> DataFrame:
    """(sheet, track, title, performer, t) from rows (sheet, raw)."""
    lines = sheets.select("sheet", F.posexplode(F.split("raw", "\n")).alias("n", "line"))
    block = F.sum(F.when(F.col("line").rlike(r"(?i)^\s*TRACK\b"), 1).otherwise(0)).over(Window.partitionBy("sheet").orderBy("n"))
    value = lambda name: F.first(F.when(F.col("line").rlike(rf"(?i)^\s*{name}\b"), F.regexp_extract("line", rf'(?i){name}\s+"?([^"]*)"?', 1)), True)
    index = r"(?i)INDEX\s+01\s+([0-9]+):([0-9]+):([0-9]+)"
    part = lambda i: F.regexp_extract("line", index, i).try_cast("double")
    t = F.min(F.when(F.col("line").rlike(index), part(1) * 60 + part(2) + part(3) / 75))
    out = lines.withColumn("track", block).where("track > 0").groupBy("sheet", "track").agg(value("TITLE").alias("title"), value("PERFORMER").alias("performer"), F.round(t, 6).alias("t"))
    return out.where("t is not null")


_SHORT = r"""SELECT track_id, array_to_string(words[skip + CASE WHEN n_parts = 1 AND len(words) > skip + 1 AND regexp_matches(words[skip + 1], '^[0-9]{1,3}$') THEN 2 ELSE 1 END : ], ' ') AS title FROM (
 SELECT *, CASE WHEN n_parts = 1 AND len(words) > 2 AND regexp_matches(words[1], '^[A-Za-z][A-Za-z0-9]*[0-9]$') AND regexp_matches(words[2], '^[0-9]+$') THEN 2 ELSE 0 END AS skip FROM (
 SELECT track_id, len(parts) AS n_parts, list_filter(string_split(parts[-1], ' '), lambda w: w <> '') AS words FROM (
 SELECT track_id, string_split(replace(CASE WHEN strpos(file, '.') > 1 THEN left(file, length(file) - strpos(reverse(file), '.')) ELSE file END, '_', ' '), '-') AS parts FROM (SELECT track_id, split_part(file_path, '/', -1) AS file FROM v_tracks) f) p) w) s"""


@query("short_titles", _SHORT)
def short_titles(v) -> DataFrame:
    return v["tracks"].select("track_id", text.short_title(F.col("file_path")).alias("title"))


@query("artist_album", r"SELECT track_id, CASE WHEN contains(folder, ' - ') THEN trim(split_part(folder, ' - ', 1)) ELSE coalesce(nullif(trim(regexp_replace(folder, '[-_]+', ' ', 'g')), ''), 'Unknown artist') END AS artist, CASE WHEN contains(folder, ' - ') THEN trim(substr(folder, strpos(folder, ' - ') + 3)) ELSE coalesce(nullif(trim(regexp_replace(folder, '[-_]+', ' ', 'g')), ''), 'Unknown album') END AS album FROM (SELECT track_id, concat(split_part(file_path, '/', 3), CASE WHEN track_id % 2 = 0 THEN ' - Album' ELSE '_x' END) AS folder FROM v_tracks)")
def artist_album(v) -> DataFrame:
    """From the folder "Artist - Album", else the folder's name for both."""
    folder = F.concat(F.element_at(F.split("file_path", "/"), 3), F.when(F.col("track_id") % 2 == 0, " - Album").otherwise("_x"))
    pretty = F.nullif(F.trim(F.regexp_replace("folder", "[-_]+", " ")), F.lit(""))
    split = F.col("folder").contains(" - ")
    rows = v["tracks"].select("track_id", folder.alias("folder"))
    return rows.select("track_id", F.when(split, text.artist(F.col("folder"))).otherwise(F.coalesce(pretty, F.lit("Unknown artist"))).alias("artist"), F.when(split, text.title(F.col("folder"))).otherwise(F.coalesce(pretty, F.lit("Unknown album"))).alias("album"))


@query("length_parse", "SELECT track_id, raw, CASE track_id % 4 WHEN 0 THEN CAST(track_id % 500 AS DOUBLE) WHEN 1 THEN 60e0 * (track_id % 60) + 7e0 WHEN 2 THEN 3600e0 * (track_id % 9) + 125e0 ELSE 0e0 END AS seconds FROM (SELECT track_id, CASE track_id % 4 WHEN 0 THEN CAST(track_id % 500 AS VARCHAR(20)) WHEN 1 THEN concat(CAST(track_id % 60 AS VARCHAR(20)), ':07') WHEN 2 THEN concat(CAST(track_id % 9 AS VARCHAR(20)), ':02:05') ELSE 'abc' END AS raw FROM v_tracks) t")
def length_parse(v) -> DataFrame:
    i = F.col("track_id")
    raw = F.when(i % 4 == 0, (i % 500).cast("string")).when(i % 4 == 1, F.concat((i % 60).cast("string"), F.lit(":07"))).when(i % 4 == 2, F.concat((i % 9).cast("string"), F.lit(":02:05"))).otherwise("abc")
    return v["tracks"].select("track_id", raw.alias("raw")).withColumn("seconds", text.length_seconds(F.col("raw")))


_DOT = "length(file) - strpos(reverse(file), '.') + 1"


@query(
    "destinations",
    f"""SELECT track_id, concat(folder, '/', left(CASE WHEN artist <> '' AND artist <> own THEN concat(artist, ' - ', own) ELSE own END, 120), '.flac') AS path FROM (SELECT track_id, creator AS folder, trim(regexp_replace(translate(concat(creator, '?'), '<>:"/\\|?*', '         '), ' +', ' ', 'g'), ' .') AS artist,
 trim(regexp_replace(translate(own, '<>:"/\\|?*', '         '), ' +', ' ', 'g'), ' .') AS own FROM (SELECT track_id, split_part(file_path, '/', 3) AS creator, CASE WHEN track_id % 3 = 0 THEN left(file, {_DOT} - 1) ELSE concat(title, ' / mix: ', CAST(track_id AS VARCHAR), '.') END AS own FROM (SELECT *, split_part(file_path, '/', -1) AS file FROM v_tracks) f) a) b""",
)
def destinations(v) -> DataFrame:
    """Where each track's file goes; every third track has no title of its own."""
    file, creator = F.element_at(F.split("file_path", "/"), -1), F.element_at(F.split("file_path", "/"), 3)
    own = F.when(F.col("track_id") % 3 != 0, F.concat("title", F.lit(" / mix: "), F.col("track_id").cast("string"), F.lit(".")))
    return v["tracks"].select("track_id", text.destination(creator, F.concat(creator, F.lit("?")), own, file, F.col("track_id").cast("string")).alias("path"))


@query("source_addresses", "SELECT track_id, concat('http://host/download/', replace(replace(url_encode(file_path), '%2F', '/'), '+', '%20')) AS address, file_path AS back FROM v_tracks")
def source_addresses(v) -> DataFrame:
    """Addresses of files, and the paths read back from them."""
    address = F.concat(F.lit("http://host/download/"), text.quoted(F.col("file_path")))
    return v["tracks"].select("track_id", address.alias("address")).withColumn("back", text.unquoted(F.substring_index("address", "/download/", -1)))


@query("unwrapped_fields", "SELECT track_id, CASE track_id % 4 WHEN 0 THEN title WHEN 1 THEN title WHEN 2 THEN '' ELSE '' END AS creator FROM v_tracks")
def unwrapped_fields(v) -> DataFrame:
    """A field of metadata that is a text, a list, an empty list or absent."""
    i, title = F.col("track_id") % 4, F.to_json(F.struct("title"))
    doc = F.when(i == 0, F.replace(title, F.lit('"title"'), F.lit('"creator"'))).when(i == 1, F.to_json(F.struct(F.array("title", F.lit("other")).alias("creator")))).when(i == 2, F.lit('{"creator": []}')).otherwise("{}")
    return v["tracks"].select("track_id", text.first_value(doc, "$.creator").alias("creator"))


@query("license_codes", "SELECT CASE WHEN contains(license, 'publicdomain') THEN 'cc0' ELSE regexp_extract(license, '/licenses/([a-z-]+)', 1) END AS code, count(*) AS n FROM v_candidates GROUP BY 1")
def license_codes(v) -> DataFrame:
    return v["candidates"].groupBy(text.licence_code(F.col("license")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "timeline_clips",
    "SELECT c.set_id, c.pos, substr(md5(t.file_path), 1, 8) AS clip_track, coalesce(t.title, 'unknown') AS title, CAST(row_number() OVER (PARTITION BY c.set_id, c.track_id ORDER BY c.pos) AS BIGINT) AS ordinal, c.out_start, c.out_end FROM v_clips c LEFT JOIN v_tracks t ON c.track_id = t.track_id",
)
def timeline_clips(v) -> DataFrame:
    clips = v["clips"].withColumn("ordinal", F.row_number().over(Window.partitionBy("set_id", "track_id").orderBy("pos")).cast("long"))
    both = clips.join(v["tracks"].select("track_id", "file_path", "title"), "track_id", "left")
    return both.select("set_id", "pos", text.track_key(F.col("file_path")).alias("clip_track"), F.coalesce("title", F.lit("unknown")).alias("title"), "ordinal", "out_start", "out_end")


@query("library_groups", "SELECT split_part(file_path, '/', 3) AS artist, mode AS album, count(*) AS n_tracks, round(sum(duration), 6) AS seconds, min(title) AS first_title FROM v_tracks GROUP BY 1, 2")
def library_groups(v) -> DataFrame:
    return v["tracks"].groupBy(F.element_at(F.split("file_path", "/"), 3).alias("artist"), F.col("mode").alias("album")).agg(F.count(F.lit(1)).alias("n_tracks"), F.round(F.sum("duration"), 6).alias("seconds"), F.min("title").alias("first_title"))
