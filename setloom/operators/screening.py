"""Screening of candidates: one file a stem, ordered gates, what is had already, a running budget."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setloom.functions.harmony import fold_tempo
from setloom.functions.text import licence_code
from setloom.operators.ordered import running
from setloom.registry import query

#: Formats in order of preference.
FORMATS = ("Flac", "VBR MP3", "Ogg Vorbis")
#: A duration that is not known counts as so many seconds.
UNKNOWN_SECONDS = 300.0


@dataclass(frozen=True)
class Screen:
    """What a candidate has to meet; ``licenses`` empty allows all, ``tempo`` None asks for none."""

    require_license: bool = True
    licenses: tuple[str, ...] = ("cc0", "by", "by-sa", "by-nc-sa")
    min_duration: float = 100.0
    max_duration: float = 900.0
    min_electronic: float = 0.30
    genres: tuple[str, ...] = ("house", "techno")
    min_genre: float = 0.25
    min_danceability: float = 0.20
    allow_unscreened: bool = False
    tempo: float | None = 135.0
    tolerance: float = 20.0


SCREEN = Screen()
TARGET_HOURS, MAX_BYTES = 20.0, 40_000_000

_ORDER = "CASE format WHEN 'Flac' THEN 0 WHEN 'VBR MP3' THEN 1 WHEN 'Ogg Vorbis' THEN 2 END"
_BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identifier, stem_id ORDER BY {_ORDER}, file_pos, part_id, supp_id, size, duration) AS rn FROM v_candidates WHERE format <> 'JPEG') b WHERE rn = 1"
_FOLD = "measured_bpm * power(2e0, -floor(log2(measured_bpm / 90e0)))"
_CODE = "CASE WHEN contains(license, 'publicdomain') THEN 'cc0' ELSE regexp_extract(license, '/licenses/([a-z-]+)', 1) END"
_PROB = "CAST(highlevel::JSON->>'{x}' AS DOUBLE)"
_TARGET = f"({_PROB.format(x='house')} + {_PROB.format(x='techno')})"
_REASON = f"""CASE WHEN license = '' THEN 'no license' WHEN {_CODE} NOT IN ('cc0', 'by', 'by-sa', 'by-nc-sa') THEN concat('license (', {_CODE}, ')') WHEN duration > 0e0 AND (duration < 100e0 OR duration > 900e0) THEN 'duration (listed)'
 WHEN highlevel IS NULL THEN 'no data' WHEN {_PROB.format(x='electronic')} > 0e0 AND {_PROB.format(x='electronic')} < 0.3e0 THEN 'not electronic' WHEN {_TARGET} < 0.25e0 THEN 'subgenre' WHEN {_PROB.format(x='danceable')} < 0.2e0 THEN 'danceability'
 WHEN measured_bpm <= 0e0 THEN 'no tempo' WHEN measured_duration < 100e0 OR measured_duration > 900e0 THEN 'duration (measured)' WHEN abs({_FOLD} - 135e0) > 20e0 THEN 'off-tempo' ELSE 'keep' END"""
_CATEGORY = f"split_part({_REASON}, ' (', 1)"
_HOURS = "coalesce(nullif(duration, 0e0), 300e0) / 3600e0"


def best_files(candidates: DataFrame) -> DataFrame:
    """Of each stem of a release the file of the best format, the first of equals."""
    rank = F.coalesce(*[F.when(F.col("format") == f, i) for i, f in enumerate(FORMATS)])
    w = Window.partitionBy("identifier", "stem_id").orderBy(rank, "file_pos", "part_id", "supp_id", "size", "duration")
    return candidates.where(rank.isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def probabilities() -> Column:
    """The classifier's document as a map; null where there is none."""
    return F.from_json("highlevel", "map<string,double>")


def target_probability(probs: Column, genres: tuple[str, ...]) -> Column:
    """The summed probability of the genres asked for."""
    return sum((F.coalesce(F.try_element_at(probs, F.lit(g)), F.lit(0.0)) for g in genres), F.lit(0.0))


def top_genre(probs: Column, genres: tuple[str, ...]) -> Column:
    """(prob, genre) of the likeliest genre, of equals the first named."""
    return F.array_max(F.array(*[F.struct(F.coalesce(F.try_element_at(probs, F.lit(g)), F.lit(0.0)).alias("prob"), F.lit(-i).alias("at"), F.lit(g).alias("genre")) for i, g in enumerate(genres)]))


def verdict(s: Screen = SCREEN) -> Column:
    """The first gate a candidate fails, cheapest first, as "category (detail)", or keep."""
    code, probs = licence_code(F.col("license")), probabilities()
    number = lambda name: F.coalesce(F.try_element_at(probs, F.lit(name)), F.lit(0.0))
    seen, keep = probs.isNotNull(), F.lit("keep")
    out = F.when((F.col("license") == "") & F.lit(s.require_license), "no license")
    if s.licenses:
        out = out.when(~code.isin(*s.licenses), F.concat(F.lit("license ("), F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown")), F.lit(")")))
    out = out.when((F.col("duration") > 0) & ~F.col("duration").between(s.min_duration, s.max_duration), "duration (listed)")
    if not s.allow_unscreened:
        out = out.when(~seen, "no data")
    out = out.when(seen & (number("electronic") > 0) & (number("electronic") < s.min_electronic), "not electronic")
    out = out.when(seen & (target_probability(probs, s.genres) < s.min_genre), "subgenre").when(seen & (number("danceable") < s.min_danceability), "danceability")
    if s.tempo is not None:
        out = out.when(F.coalesce(F.col("measured_bpm"), F.lit(0.0)) <= 0, keep if s.allow_unscreened else F.lit("no tempo"))
        out = out.when(~F.col("measured_duration").between(s.min_duration, s.max_duration), "duration (measured)")
        out = out.when(F.abs(fold_tempo(F.col("measured_bpm")) - fold_tempo(F.lit(s.tempo))) > s.tolerance, "off-tempo")
    return out.otherwise(keep)


def category(reason: Column) -> Column:
    """The countable part of a reason."""
    return F.substring_index(reason, " (", 1)


@query("classifier_genres", f"SELECT identifier, stem_id, file_pos, part_id, CASE WHEN {_PROB.format(x='house')} >= {_PROB.format(x='techno')} AND {_PROB.format(x='house')} >= {_PROB.format(x='trance')} THEN 'house' WHEN {_PROB.format(x='techno')} >= {_PROB.format(x='trance')} THEN 'techno' ELSE 'trance' END AS genre, greatest({_PROB.format(x='house')}, {_PROB.format(x='techno')}, {_PROB.format(x='trance')}) AS genre_prob, round({_TARGET}, 6) AS target_prob, {_PROB.format(x='danceable')} AS danceability FROM v_candidates WHERE highlevel IS NOT NULL")
def classifier_genres(v) -> DataFrame:
    """Of every candidate with a classifier's document its likeliest genre, and the summed probability of the genres asked for."""
    probs = probabilities()
    rows = v["candidates"].where("highlevel is not null").withColumn("p", probs).withColumn("top", top_genre(F.col("p"), ("house", "techno", "trance")))
    return rows.select("identifier", "stem_id", "file_pos", "part_id", F.col("top.genre").alias("genre"), F.col("top.prob").alias("genre_prob"), F.round(target_probability(F.col("p"), SCREEN.genres), 6).alias("target_prob"), F.try_element_at("p", F.lit("danceable")).alias("danceability"))


@query("format_dedupe", f"SELECT identifier, stem_id, format, file_pos, part_id FROM ({_BEST})")
def format_dedupe(v) -> DataFrame:
    return best_files(v["candidates"]).select("identifier", "stem_id", "format", "file_pos", "part_id")


@query("screen_funnel", f"SELECT {_CATEGORY} AS reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ({_BEST}) GROUP BY 1")
def screen_funnel(v) -> DataFrame:
    return best_files(v["candidates"]).groupBy(category(verdict()).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("license_allowlist", f"SELECT count(*) AS n, count(*) FILTER (WHERE {_REASON} = 'keep') AS n_kept, count(*) FILTER (WHERE contains(license, 'publicdomain')) AS n_public, count(*) FILTER (WHERE {_CATEGORY} = 'license') AS n_refused FROM ({_BEST})")
def license_allowlist(v) -> DataFrame:
    return best_files(v["candidates"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(verdict() == "keep").alias("n_kept"), F.count_if(licence_code(F.col("license")) == "cc0").alias("n_public"), F.count_if(category(verdict()) == "license").alias("n_refused"))


def kept_until_full(rows: DataFrame, hours: float = TARGET_HOURS, size: int = MAX_BYTES) -> DataFrame:
    """Rows (identifier, stem_id, duration, size) in order, until one budget of hours or of bytes is met; the row that crosses the line stays."""
    rows = rows.withColumn("hours", F.coalesce(F.nullif("duration", F.lit(0.0)), F.lit(UNKNOWN_SECONDS)) / 3600)
    sums = running(running(rows, "identifier", ["stem_id"], F.col("hours"), name="hours_before"), "identifier", ["stem_id"], F.col("size"), name="bytes_before")
    return sums.where((F.col("hours_before") < hours) & (F.col("bytes_before") < size))


@query(
    "fetch_plan",
    f"""SELECT identifier, stem_id, hours FROM (SELECT identifier, stem_id, {_HOURS} AS hours, coalesce(sum({_HOURS}) OVER w, 0e0) AS hours_before, coalesce(sum(size) OVER w, 0) AS bytes_before
 FROM ({_BEST}) WHERE {_REASON} = 'keep' AND identifier % 7 <> 0 WINDOW w AS (ORDER BY identifier, stem_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE hours_before < {TARGET_HOURS} AND bytes_before < {MAX_BYTES}""",
)
def fetch_plan(v) -> DataFrame:
    """What is kept and not had already, in order, until the one budget of hours or bytes is met."""
    had = v["candidates"].where("identifier % 7 = 0").select("identifier").distinct()
    kept = best_files(v["candidates"]).where(verdict() == "keep").join(had, "identifier", "left_anti")
    return kept_until_full(kept).select("identifier", "stem_id", "hours")


@query("plan_totals", f"SELECT count(*) AS n, round(sum({_HOURS}), 6) AS hours, CAST(sum(size) AS BIGINT) AS bytes FROM ({_BEST}) WHERE {_REASON} = 'keep'")
def plan_totals(v) -> DataFrame:
    hours = F.sum(F.coalesce(F.nullif("duration", F.lit(0.0)), F.lit(UNKNOWN_SECONDS))) / 3600
    return best_files(v["candidates"]).where(verdict() == "keep").agg(F.count(F.lit(1)).alias("n"), F.round(hours, 6).alias("hours"), F.sum("size").alias("bytes"))


@query(
    "yield_estimate",
    f"""WITH c AS (SELECT {_CATEGORY} AS reason, {_HOURS} AS hours, identifier FROM ({_BEST}) b), t AS (SELECT count(*) AS n, count(DISTINCT identifier) AS items, coalesce(sum(hours) FILTER (WHERE reason = 'keep'), 0e0) AS hours FROM c),
l AS (SELECT reason, count(*) AS lost FROM c WHERE reason <> 'keep' GROUP BY reason)
SELECT CAST(row_number() OVER (ORDER BY lost DESC, reason) AS BIGINT) AS rank, reason, lost, round(lost / CAST(n AS DOUBLE), 6) AS share, round(hours / items, 6) AS hours_per_item, CASE WHEN hours > 0e0 THEN CAST(ceil({TARGET_HOURS} / (hours / items)) AS BIGINT) END AS items_needed
FROM l, t WHERE lost > 0.15e0 * n ORDER BY rank LIMIT 2""",
)
def yield_estimate(v) -> DataFrame:
    """The two largest losses over 15 %, with the hours an item yields and the items that the target hours would take."""
    rows = best_files(v["candidates"]).select("identifier", category(verdict()).alias("reason"), (F.coalesce(F.nullif("duration", F.lit(0.0)), F.lit(UNKNOWN_SECONDS)) / 3600).alias("hours"))
    n, items, hours = rows.agg(F.count(F.lit(1)), F.count_distinct("identifier"), F.coalesce(F.sum(F.when(F.col("reason") == "keep", F.col("hours"))), F.lit(0.0))).first()
    lost = rows.where("reason <> 'keep'").groupBy("reason").agg(F.count(F.lit(1)).alias("lost")).where(F.col("lost") > 0.15 * n)
    top = lost.orderBy(F.desc("lost"), "reason").limit(2)
    per = hours / max(items, 1)
    needed = F.lit(math.ceil(TARGET_HOURS / per) if per > 0 else None).cast("long")
    return top.select(F.row_number().over(Window.orderBy(F.desc("lost"), "reason")).cast("long").alias("rank"), "reason", "lost", F.round(F.col("lost") / n, 6).alias("share"), F.round(F.lit(per), 6).alias("hours_per_item"), needed.alias("items_needed"))
