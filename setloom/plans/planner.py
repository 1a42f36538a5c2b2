"""Transition plans over pairs: style, sampled pairs, style mix, segments, lanes and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setloom.functions import curves
from setloom.functions.harmony import beatmatchable
from setloom.functions.vectors import cosine
from setloom.operators.graph import match_sql
from setloom.operators.ordered import positions
from setloom.plans.cues import ENTRY, EXIT, entries, exits
from setloom.registry import query, sql_query

#: Energies below and over which styles change, the similarity of a blend, the margin of a tie.
CALM, LOUD, SIMILAR, TIE = 0.45, 0.70, 0.82, 0.08
MAX_LANES = 5


def seeded_unit(*parts: Column) -> Column:
    """A draw in [0, 1) that depends on the parts' text alone: the first eight bytes of their digest as a number, over 2**64."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def style(matched: Column, similarity: Column, leaving: Column, entering: Column, draw: Column | None = None) -> Column:
    """cut without a common tempo; blend for like or calm pairs; swap for loud ones; else fade or build by the energy step.

    Inside the tie margin ``draw`` decides, the likelier the larger the step; without one its sign does.
    """
    out, into = F.coalesce(leaving, F.lit(0.5)), F.coalesce(entering, F.lit(0.5))
    margin = out - into
    fades = margin >= 0 if draw is None else F.when(F.abs(margin) < TIE, draw < 0.5 + margin / TIE * 0.5).otherwise(margin >= 0)
    like = F.coalesce(similarity >= SIMILAR, F.lit(False))
    return F.when(~matched, "cut").when(like | ((out < CALM) & (into < CALM)), "blend").when((out > LOUD) & (into > LOUD), "swap").when(fades, "fade").otherwise("build")


def tie_draw(src: Column, dst: Column) -> Column:
    return seeded_unit(F.lit("style"), src, dst)


def sampled_pairs(tracks: DataFrame, at_most: int = 4000) -> DataFrame:
    """Every step-th ordered pair (a, b), a before b in the listing of pairs by position, about ``at_most`` of them.

    Pairs are numbered, not made: number p is first track p / (n - 1) and its p % (n - 1)-th other one; two joins by
    position find them.
    """
    placed = positions(tracks, "track_id")
    n = tracks.count()
    total = n * (n - 1)
    step = max(1, total // at_most)
    first, rest = F.floor(F.col("id") / (n - 1)), F.col("id") % (n - 1)
    numbers = tracks.sparkSession.range(0, max(0, total), step).select("id", first.alias("i"), F.when(rest < first, rest).otherwise(rest + 1).alias("j"))
    a, b = placed.select(F.struct("*").alias("a")), placed.select(F.struct("*").alias("b"))
    return numbers.join(a, F.col("i") == F.col("a.at")).join(b, F.col("j") == F.col("b.at")).select("id", "a", "b")


def planned(v) -> DataFrame:
    """(src, dst, matched, out_energy, style) of sampled pairs, from the exit of the one and the entry of the other."""
    tracks, cues = v["tracks"], v["cues"]
    rows = sampled_pairs(tracks.select("track_id", "bpm"))
    rows = rows.select("id", F.col("a.track_id").alias("src"), F.col("a.bpm").alias("x"), F.col("b.track_id").alias("dst"), F.col("b.bpm").alias("y"))
    out, into = exits(cues, tracks).withColumnRenamed("track_id", "src"), entries(cues, tracks).withColumnRenamed("track_id", "dst")
    rows = rows.join(out, "src", "left").join(into, "dst", "left")
    matched = beatmatchable(F.col("x"), F.col("y"))
    kind = style(matched, cosine(F.col("out_vector"), F.col("in_vector")), F.col("out_energy"), F.col("in_energy"), tie_draw(F.col("src"), F.col("dst")))
    return rows.select("src", "dst", matched.alias("matched"), "out_energy", kind.alias("style"))


_U = "(CAST(concat('0x', substr(sha256(concat_ws('|', 'style', CAST(src AS VARCHAR), CAST(dst AS VARCHAR))), 1, 16)) AS UBIGINT) / 18446744073709551616e0)"
#: The style of a row (src, dst, matched, sim, eo, ei), and a row's similarity of exit x and entry n.
STYLE = f"CASE WHEN NOT matched THEN 'cut' WHEN coalesce(sim >= 0.82e0, false) OR (eo < 0.45e0 AND ei < 0.45e0) THEN 'blend' WHEN eo > 0.7e0 AND ei > 0.7e0 THEN 'swap' WHEN CASE WHEN abs(eo - ei) < 0.08e0 THEN {_U} < 0.5e0 + (eo - ei) / 0.08e0 * 0.5e0 ELSE eo - ei >= 0e0 END THEN 'fade' ELSE 'build' END"
SIMILARITY = "CASE WHEN x.embedding IS NULL OR n.embedding IS NULL THEN NULL ELSE round(greatest(-1e0, least(1e0, list_cosine_similarity(x.embedding::DOUBLE[], n.embedding::DOUBLE[]))), 4) END"
_PLANNED = f"""SELECT src, dst, matched, out_energy, {STYLE} AS style FROM (SELECT src, dst, matched, x.energy AS out_energy, coalesce(x.energy, 0.5e0) AS eo, coalesce(n.energy, 0.5e0) AS ei, {SIMILARITY} AS sim
FROM (SELECT a.track_id AS src, b.track_id AS dst, {match_sql("a", "b")} AS matched, row_number() OVER (ORDER BY a.track_id, b.track_id) - 1 AS p, count(*) OVER () AS total
 FROM v_tracks a JOIN v_tracks b ON a.track_id <> b.track_id) q LEFT JOIN {EXIT} x ON x.track_id = src LEFT JOIN {ENTRY} n ON n.track_id = dst WHERE p % greatest(1, CAST(floor(total / 4000e0) AS BIGINT)) = 0) z"""


@query("gap_report_pairs", _PLANNED)
def gap_report_pairs(v) -> DataFrame:
    return planned(v)


@query("style_mix", f"SELECT style, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM ({_PLANNED}) GROUP BY style")
def style_mix(v) -> DataFrame:
    counts = planned(v).groupBy("style").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("style", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("exit_energies", f"SELECT src AS track_id, max(out_energy) AS exit_energy, count(*) AS n_pairs, count(*) FILTER (WHERE matched) AS n_matched FROM ({_PLANNED}) p WHERE out_energy IS NOT NULL GROUP BY src")
def exit_energies(v) -> DataFrame:
    """The energy at which each sampled source is left, a property of the source alone, and how many of its pairs share a tempo."""
    return planned(v).where("out_energy is not null").groupBy(F.col("src").alias("track_id")).agg(F.max("out_energy").alias("exit_energy"), F.count(F.lit(1)).alias("n_pairs"), F.count_if("matched").alias("n_matched"))


#: What a library should hold.
TARGET_HOURS, CUT_SHARE, MIN_KEYS = 24.0, 0.40, 12

_FINDINGS = f"""WITH t AS (SELECT count(*) AS n, sum(duration) / 3600e0 AS hours, count(DISTINCT concat(CAST(key_num AS VARCHAR), mode)) AS keys FROM v_tracks), p AS ({_PLANNED}),
e AS (SELECT src, max(out_energy) AS energy FROM p WHERE out_energy IS NOT NULL GROUP BY src),
c AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE style = 'cut') AS cuts, count(*) FILTER (WHERE style = 'blend') AS blends, count(*) FILTER (WHERE style = 'swap') AS swaps, count(*) FILTER (WHERE style = 'fade') AS fades, count(*) FILTER (WHERE style = 'build') AS builds FROM p),
x AS (SELECT count(*) FILTER (WHERE energy < 0.45e0) AS low, count(*) FILTER (WHERE energy > 0.7e0) AS high FROM e)
SELECT finding, round(value, 6) AS value FROM (
 SELECT 'hours short' AS finding, {TARGET_HOURS} - hours AS value, hours < {TARGET_HOURS} AS holds FROM t UNION ALL SELECT 'tracks short', floor(({TARGET_HOURS} - hours) * 60e0 / greatest(hours * 60e0 / n, 0.1e0)), hours < {TARGET_HOURS} FROM t
 UNION ALL SELECT 'share of cuts', cuts / CAST(pairs AS DOUBLE), cuts >= {CUT_SHARE} * pairs AND pairs > 0 FROM c UNION ALL SELECT 'no blend', 0e0, blends = 0 FROM c UNION ALL SELECT 'no swap', 0e0, swaps = 0 FROM c UNION ALL SELECT 'no fade', 0e0, fades = 0 FROM c UNION ALL SELECT 'no build', 0e0, builds = 0 FROM c
 UNION ALL SELECT 'few calm exits', CAST(low AS DOUBLE), low < greatest(3e0, floor(n / 10e0)) FROM x, t UNION ALL SELECT 'few loud exits', CAST(high AS DOUBLE), high < greatest(3e0, floor(n / 10e0)) FROM x, t UNION ALL SELECT 'few keys', CAST(keys AS DOUBLE), keys < {MIN_KEYS} FROM t) f WHERE holds"""


@query("gap_findings", _FINDINGS)
def gap_findings(v) -> DataFrame:
    """What a library lacks, a row each: hours, tempos that meet, styles, calm and loud exits, keys."""
    n, seconds, keys = v["tracks"].agg(F.count(F.lit(1)), F.coalesce(F.sum("duration"), F.lit(0.0)), F.count_distinct(F.struct("key_num", "mode"))).first()
    pairs = planned(v)
    styles = {r[0]: r[1] for r in pairs.groupBy("style").count().collect()}
    sources = pairs.where("out_energy is not null").groupBy("src").agg(F.max("out_energy").alias("e"))
    low, high = sources.agg(F.count_if(F.col("e") < CALM), F.count_if(F.col("e") > LOUD)).first()
    hours, total, few = seconds / 3600, sum(styles.values()), max(3, n // 10)
    rows = [("hours short", TARGET_HOURS - hours), ("tracks short", float((TARGET_HOURS - hours) * 60 // max(hours * 60 / n if n else 5.5, 0.1)))] if hours < TARGET_HOURS else []
    if total and styles.get("cut", 0) >= CUT_SHARE * total:
        rows.append(("share of cuts", styles["cut"] / total))
    rows += [(f"no {s}", 0.0) for s in ("blend", "swap", "fade", "build") if not styles.get(s)]
    rows += [(name, float(x)) for name, x, least in (("few calm exits", low, few), ("few loud exits", high, few), ("few keys", keys, MIN_KEYS)) if x < least]
    return v.spark.createDataFrame([(name, round(x, 6)) for name, x in rows], "finding string, value double")


@query(
    "segment_pool",
    """WITH s AS (SELECT track_id, CAST(g.i AS BIGINT) AS section, g.i * duration / n_sections AS s0, (g.i + 1) * duration / n_sections AS s1, 8e0 * 240e0 / bpm AS step FROM v_tracks, (SELECT unnest(range(0, 4)) AS i) g WHERE g.i < n_sections)
SELECT track_id, section, CAST(k.j AS BIGINT) AS sub, round(s0 + k.j * step, 3) AS seg_start, round(s1, 3) AS seg_end FROM s, (SELECT unnest(range(0, 7)) AS j) k WHERE s1 - s0 >= 8e0 AND (k.j = 0 OR s0 + (k.j + 1) * step <= s1 + 1e-9)""",
)
def segment_pool(v, bars: int = 8, most: int = 6) -> DataFrame:
    """Sections of eight seconds or more, and up to six later entries into each, every eight bars."""
    t = v["tracks"].where("n_sections > 0").select("track_id", "duration", "n_sections", (bars * 240.0 / F.col("bpm")).alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_sections") - 1)).alias("section"))
    s = t.select("track_id", "section", "step", (F.col("section") * F.col("duration") / F.col("n_sections")).alias("s0"), ((F.col("section") + 1) * F.col("duration") / F.col("n_sections")).alias("s1")).where("s1 - s0 >= 8")
    subs = F.greatest(F.lit(0), F.least(F.lit(most), F.floor((F.col("s1") - F.col("s0") + 1e-9) / F.col("step")) - 1))
    out = s.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), subs.cast("long"))))
    return out.select("track_id", "section", "sub", F.round(F.col("s0") + F.col("sub") * F.col("step"), 3).alias("seg_start"), F.round("s1", 3).alias("seg_end"))


@query("arc_targets", "WITH x AS (SELECT a.arc, CAST(g.i AS BIGINT) AS pos, g.i / 19e0 AS p FROM (SELECT unnest(['build', 'steady', 'wave', 'peak']) AS arc) a, (SELECT unnest(range(0, 20)) AS i) g) SELECT arc, pos, round(CASE arc WHEN 'build' THEN 0.2e0 + 0.8e0 * p WHEN 'steady' THEN 0.7e0 WHEN 'wave' THEN greatest(0e0, least(1e0, 0.4e0 + 0.5e0 * sin(2e0 * pi() * p))) ELSE CASE WHEN p < 0.6e0 THEN 0.3e0 + p / 0.6e0 * 0.7e0 ELSE 1e0 - (p - 0.6e0) / 0.4e0 * 0.6e0 END END, 6) AS target FROM x")
def arc_targets(v, n: int = 20) -> DataFrame:
    at = v.spark.range(n).select(F.col("id").alias("pos"), F.explode(F.array(*[F.lit(a) for a in curves.ARCS])).alias("arc"))
    return at.select("arc", "pos", F.round(curves.arc_target(F.col("arc"), F.col("pos") / float(max(1, n - 1))), 6).alias("target"))


@query("energy_fit", "SELECT track_id, round(greatest(0e0, 1e0 - 2e0 * abs(0.2e0 - mean_energy)), 6) AS fit_build, round(greatest(0e0, 1e0 - 2e0 * abs(0.4e0 - mean_energy)), 6) AS fit_wave, round(greatest(0e0, 1e0 - 2e0 * abs(0.3e0 - mean_energy)), 6) AS fit_peak FROM v_tracks")
def energy_fit(v) -> DataFrame:
    """How well each track opens each arc."""
    fit = lambda arc: F.round(curves.energy_fit(curves.arc_target(F.lit(arc), F.lit(0.0)), F.col("mean_energy")), 6)
    return v["tracks"].select("track_id", *[fit(a).alias(f"fit_{a}") for a in ("build", "wave", "peak")])


@query("fade_curves", "WITH x AS (SELECT s.shape, g.i / 10e0 AS x FROM (SELECT unnest(['equal_power', 'linear', 'exp', 'log', 'scurve', 'hold', 'slam']) AS shape) s, (SELECT unnest(range(0, 11)) AS i) g) SELECT shape, x, round(CASE shape WHEN 'equal_power' THEN sin(x * pi() / 2e0) WHEN 'linear' THEN x WHEN 'exp' THEN power(x, 2.5e0) WHEN 'log' THEN 1e0 - power(1e0 - x, 2.5e0) WHEN 'scurve' THEN x * x * (3e0 - 2e0 * x) WHEN 'hold' THEN least(1e0, 4e0 * x) ELSE least(1e0, 12e0 * x) END, 6) AS gain FROM x")
def fade_curves(v, n: int = 11) -> DataFrame:
    at = v.spark.range(n).select((F.col("id") / float(n - 1)).alias("x"), F.explode(F.array(*[F.lit(s) for s in curves.FADES])).alias("shape"))
    return at.select("shape", "x", F.round(curves.fade(F.col("shape"), F.col("x")), 6).alias("gain"))


_FALL = "CASE WHEN {q} < 0.5e0 THEN 1e0 - 0.293e0 * 2e0 * {q} ELSE 0.707e0 * 2e0 * (1e0 - {q}) END"
_RISE = "CASE WHEN {q} < 0.5e0 THEN 0.707e0 * 2e0 * {q} ELSE 0.707e0 + 0.293e0 * (2e0 * {q} - 1e0) END"


@query(
    "profile_gains",
    f"""SELECT mix_id, idx, round(low, 6) AS out_low, round(1e0 - low, 6) AS in_low, round({_FALL.format(q="x")}, 6) AS out_mid, round({_FALL.format(q="h")}, 6) AS out_high, round({_RISE.format(q="l")}, 6) AS in_mid, round({_RISE.format(q="l")}, 6) AS in_high
FROM (SELECT mix_id, idx, x, greatest(0e0, least(1e0, (greatest(0.12e0, least(0.88e0, centre)) + 0.12e0 - x) / 0.24e0)) AS low, greatest(0e0, (x - least(0.8e0, hold)) / (1e0 - least(0.8e0, hold))) AS h, greatest(0e0, (x - least(0.8e0, lead)) / (1e0 - least(0.8e0, lead))) AS l
 FROM (SELECT mix_id, idx, confidence AS x, coalesce(camelot_score, 0.5e0) AS centre, CAST(k % 10 AS DOUBLE) / 10e0 AS hold, CAST(k % 7 AS DOUBLE) / 10e0 AS lead FROM v_transitions) a) b""",
)
def profile_gains(v) -> DataFrame:
    """Band gains of every transition at a phase, with a hold of the outgoing highs and one delay of the incoming bands."""
    lead, hold = F.col("k") % 7 / 10.0, F.col("k") % 10 / 10.0
    gains = curves.profile(F.col("confidence"), F.coalesce("camelot_score", F.lit(0.5)), lead, lead, None, hold)
    return v["transitions"].select("mix_id", "idx", *[F.round(g, 6).alias(k) for k, g in gains.items()])


@query("lane_interp", "SELECT mix_id, idx, round(CASE WHEN confidence <= 0.2e0 THEN 0e0 WHEN confidence <= 0.5e0 THEN 0.7e0 * (confidence - 0.2e0) / 0.3e0 WHEN confidence <= 0.8e0 THEN 0.7e0 + 0.3e0 * (confidence - 0.5e0) / 0.3e0 ELSE 1e0 END, 6) AS gain FROM v_transitions")
def lane_interp(v) -> DataFrame:
    lane = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.2, 0.0), (0.5, 0.7), (0.8, 1.0))])
    return v["transitions"].select("mix_id", "idx", F.round(curves.lane_value(lane, F.col("confidence")), 6).alias("gain"))


sql_query("layer_gain", "SELECT set_id, count(*) AS n_clips, round(1e0 / sqrt(greatest(1, count(*))), 6) AS gain FROM v_clips WHERE out_start <= 20e0 AND 20e0 < out_end GROUP BY set_id")
sql_query("loudness_match", "SELECT track_id, round(CASE WHEN loudness IS NULL OR abs(g) < 0.1e0 THEN 1e0 ELSE power(10e0, g / 20e0) END, 6) AS gain FROM (SELECT track_id, loudness, greatest(-9e0, least(9e0, -12e0 - loudness)) AS g FROM v_tracks) t")


@query(
    "stretch_choice",
    """SELECT set_id, pos, round(ratio, 6) AS ratio, CASE WHEN abs(ratio - 1e0) <= 0.08e0 THEN 'stretch' ELSE 'cut' END AS method FROM (
 SELECT p.set_id, p.pos, CASE WHEN abs(a.bpm / b.bpm - 1e0) <= abs(a.bpm / (2e0 * b.bpm) - 1e0) AND abs(a.bpm / b.bpm - 1e0) <= abs(2e0 * a.bpm / b.bpm - 1e0) THEN a.bpm / b.bpm WHEN abs(a.bpm / (2e0 * b.bpm) - 1e0) <= abs(2e0 * a.bpm / b.bpm - 1e0) THEN a.bpm / (2e0 * b.bpm) ELSE 2e0 * a.bpm / b.bpm END AS ratio
 FROM (SELECT set_id, pos, track_id, lag(track_id) OVER (PARTITION BY set_id ORDER BY pos) AS prev FROM v_clips) p JOIN v_tracks a ON p.prev = a.track_id JOIN v_tracks b ON p.track_id = b.track_id)""",
)
def stretch_choice(v) -> DataFrame:
    """By consecutive clips the ratio nearest to one at equal, half and double time, and whether it is in budget."""
    bpm = v["tracks"].select("track_id", "bpm")
    prev = v["clips"].select("set_id", "pos", "track_id", F.lag("track_id").over(Window.partitionBy("set_id").orderBy("pos")).alias("prev")).where("prev is not null")
    both = prev.join(bpm.select(F.col("track_id").alias("prev"), F.col("bpm").alias("x")), "prev").join(bpm.select("track_id", F.col("bpm").alias("y")), "track_id")
    tried = [F.col("x") / F.col("y"), F.col("x") / (2.0 * F.col("y")), 2.0 * F.col("x") / F.col("y")]
    best = F.array_min(F.array(*[F.struct(F.abs(r - 1.0).alias("off"), F.lit(i).alias("i"), r.alias("ratio")) for i, r in enumerate(tried)]))
    return both.withColumn("b", best).select("set_id", "pos", F.round("b.ratio", 6).alias("ratio"), F.when(F.col("b.off") <= 0.08, "stretch").otherwise("cut").alias("method"))


def assign_lanes(clips: DataFrame, most: int = MAX_LANES) -> DataFrame:
    """(set_id, pos, lane): each clip of a set in the first lane that is free, -1 if none of ``most`` is.

    A fold over the set's clips in order of start; a set is a list of bounded length.
    """
    sets = clips.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("out_start", "pos", "out_end"))).alias("clips"))
    zero = F.struct(F.array_repeat(F.lit(float("-inf")), most).alias("ends"), F.lit(None).cast("array<struct<pos:bigint,lane:bigint>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        free = F.array_position(F.transform(acc["ends"], lambda e: e <= c["out_start"]), True)
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == free - 1, c["out_end"]).otherwise(e))
        placed = F.struct(c["pos"].alias("pos"), (free - 1).alias("lane"))
        return F.struct(ends.alias("ends"), F.concat(F.coalesce(acc["out"], F.array().cast("array<struct<pos:bigint,lane:bigint>>")), F.array(placed)).alias("out"))

    return sets.select("set_id", F.explode(F.aggregate("clips", zero, step, lambda a: a["out"])).alias("x")).select("set_id", "x.pos", "x.lane")


@query("lane_assignment")
def lane_assignment(v) -> DataFrame:
    return assign_lanes(v["clips"])


def cluster_tempos(tracks: DataFrame, width: float = 4.0) -> DataFrame:
    """(centre, n): tempos in order join the last cluster within ``width`` of its running mean, else open one.

    Tracks are counted by tempo in hundredths first, so the fold is over at most the distinct tempos.
    """
    counts = tracks.where("bpm > 0").groupBy(F.round("bpm", 2).alias("bpm")).agg(F.count(F.lit(1)).alias("n"))
    kind = "array<struct<c:double,n:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(x["bpm"] - last["c"] <= width, F.lit(False))
        total = last["n"] + x["n"]
        grown = F.struct(((last["c"] * last["n"] + x["bpm"] * x["n"]) / total).alias("c"), total.alias("n"))
        alone = F.struct(x["bpm"].alias("c"), x["n"].alias("n"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(alone))).cast(kind)

    folded = counts.agg(F.array_sort(F.collect_list(F.struct("bpm", "n"))).alias("x")).select(F.explode(F.aggregate("x", F.array().cast(kind), step)).alias("y"))
    return folded.select(F.round("y.c", 1).alias("centre"), F.col("y.n").alias("n")).orderBy(F.desc("n"), "centre")


@query("bpm_clusters")
def bpm_clusters(v) -> DataFrame:
    return cluster_tempos(v["tracks"])
