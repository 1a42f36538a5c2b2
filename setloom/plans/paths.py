"""Ordered sets: paths that take the best next track, step by step.

A step is one distributed pass: the edges from the current track to every other one (key score with its best shift,
tempo, similarity of the best pair of cues) are scored, and an aggregate takes the best candidate. The driver holds
the current track, its path and the last few ids only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.functions.curves import arc_target, energy_fit
from setloom.functions.harmony import SHIFT_PENALTY, beatmatchable, tempo_compatibility
from setloom.operators.graph import _BEST_PAIR, _CODES, _shift_sql, best_cue_pair, edge_score, key_table, match_sql, paired_cues, tempo_sql
from setloom.registry import query

LENGTH = 12


def build_path(edges: Callable[[dict], DataFrame], start: dict, score: Callable[[dict, int], Column], *, length: int | None = LENGTH, cooldown: int | None = 5) -> DataFrame:
    """(pos, track_id, score) from ``start`` on: of ``edges(now)`` the best score wins, the least id of equals.

    Tracks among the last ``cooldown`` (none: all so far, until every track is used) are left out; the path ends at ``length``
    (none: as many as there are tracks), or when nothing is left.
    """
    rows, now, spark = [(0, start["track_id"], None)], start, None
    while length is None or len(rows) < length:
        found = edges(now)
        spark = found.sparkSession
        if length is None:
            length = found.count() + 1
            continue
        names = [c for c in found.columns if c != "track_id"]
        scored = found.withColumn("score", F.round(score(now, len(rows)), 6))
        best = F.max(F.struct("score", (-F.col("track_id")).alias("least"), *[c for c in names if c != "score"]))
        recent = [r[1] for r in (rows[-cooldown:] if cooldown else rows)]
        m = scored.where(~F.col("track_id").isin(recent)).agg(best.alias("m")).first().m
        if m is None and cooldown is None:
            m = scored.agg(best.alias("m")).first().m
        if m is None:
            break
        now = m.asDict() | {"track_id": -m.least}
        rows.append((len(rows), now["track_id"], now["score"]))
    spark = spark or edges(now).sparkSession
    return spark.createDataFrame(rows, "pos long, track_id long, score double")


class Edges:
    """The edges from one track to all others: columns of the tracks, harmonic, rhythm, similarity, edge."""

    def __init__(self, v) -> None:
        self.tracks = v["tracks"].select("track_id", "bpm", "key_num", "mode", "mean_energy").persist()
        cues = v["cues"].select("track_id", "pos", "type", "ts", "phrase_aligned", "confidence", "embedding").persist()
        self.out, self.into = cues.where("type = 'out'"), cues.where("type = 'in'")
        self.keys = {}
        for r in key_table(v.spark).collect():
            paid = r.shifted - SHIFT_PENALTY * abs(r.n) if r.shifted is not None else None
            best = round(paid if paid is not None and paid > r.base else r.base, 3)
            self.keys.setdefault((r.na, r.ma), []).extend([F.lit(f"{r.nb}{r.mb}"), F.lit(best)])

    def first(self, *order: Column) -> dict:
        return self.tracks.orderBy(*order, "track_id").first().asDict()

    def __call__(self, now: dict) -> DataFrame:
        # Two dozen keys, and the cues of one track.
        harmonic = F.element_at(F.create_map(*self.keys[(now["key_num"], now["mode"])]), F.concat(F.col("key_num").cast("string"), "mode"))
        own = self.out.where(F.col("track_id") == now["track_id"])
        rows = self.tracks.where(F.col("track_id") != now["track_id"]).withColumn("harmonic", harmonic)
        if own.isEmpty():
            rows = rows.withColumn("similarity", F.lit(None).cast("double"))
        else:
            rows = rows.join(paired_cues(own, self.into).select(F.col("dst").alias("track_id"), "similarity"), "track_id", "left")
        rows = rows.withColumn("rhythm", tempo_compatibility(F.lit(now["bpm"]), F.col("bpm")))
        return rows.withColumn("edge", F.round(edge_score(F.col("harmonic"), F.col("rhythm"), F.col("similarity")), 3))


def _fit(arc: str, pos: int, length: int) -> Column:
    return energy_fit(arc_target(F.lit(arc), F.lit(pos / max(1, length - 1))), F.col("mean_energy"))


def similarity_rank(v) -> Callable[[Column], Column]:
    """Where a similarity stands among those of the stated sources' edges: the share of their percentiles at most as large."""
    steps = best_cue_pair(v).agg(F.percentile("similarity", F.array(*[F.lit(i / 100) for i in range(1, 101)])).alias("p")).first().p
    table = F.array(*[F.lit(round(x, 6)) for x in steps or []]).cast("array<double>")
    return lambda sim: F.when(sim.isNotNull(), F.size(F.filter(table, lambda x: x <= sim)) / 100.0)


_HARM = f"SELECT na, ma, nb, mb, round(CASE WHEN shifted > base AND shifted - 0.03e0 * abs(n) > base THEN shifted - 0.03e0 * abs(n) ELSE base END, 3) AS harm FROM ({_shift_sql(f'SELECT a.key_num AS na, a.mode AS ma, b.key_num AS nb, b.mode AS mb FROM {_CODES} a, {_CODES} b', 'na, ma, nb, mb')}) x"
_STEPS = f"SELECT list_transform(quantile_cont(similarity, [{', '.join(str(i / 100) for i in range(1, 101))}]), lambda x: round(x, 6)) AS steps FROM ({_BEST_PAIR}) s"
_ALL_PAIRS = _BEST_PAIR.replace("WHERE o.track_id % 20 = 0) WHERE", ") WHERE")


def _path_sql(start: str, score: str, without: str) -> str:
    return f"""WITH RECURSIVE keys AS ({_HARM}), steps AS ({_STEPS}), sims AS (SELECT src, dst, similarity, len(list_filter(steps, lambda x: x <= similarity)) / 100e0 AS rank FROM ({_ALL_PAIRS}) s, steps), p AS (
SELECT CAST(0 AS BIGINT) AS pos, track_id, CAST(NULL AS DOUBLE) AS score, [track_id] AS seen, bpm, key_num, mode, mean_energy FROM ({start})
UNION ALL
SELECT pos, track_id, score, seen, bpm, key_num, mode, mean_energy FROM (
 SELECT a.pos + 1 AS pos, b.track_id, round({score}, 6) AS score, list_append(a.seen, b.track_id) AS seen, b.bpm, b.key_num, b.mode, b.mean_energy, row_number() OVER (ORDER BY round({score}, 6) DESC, b.track_id) AS rn
 FROM p a JOIN v_tracks b ON b.track_id <> a.track_id AND NOT list_contains({without}, b.track_id) JOIN keys k ON k.na = a.key_num AND k.ma = a.mode AND k.nb = b.key_num AND k.mb = b.mode LEFT JOIN sims c ON c.src = a.track_id AND c.dst = b.track_id WHERE a.pos < {LENGTH - 1}) WHERE rn = 1)
SELECT pos, track_id, score FROM p"""


_RHYTHM = tempo_sql("a", "b")
_EDGE = f"round(CASE WHEN c.similarity IS NULL THEN 0.6e0 * k.harm + 0.4e0 * {_RHYTHM} ELSE 0.4e0 * k.harm + 0.3e0 * {_RHYTHM} + 0.3e0 * greatest(0e0, c.similarity) END, 3)"
_P = f"((a.pos + 1) / {LENGTH - 1}e0)"
_PEAK = f"greatest(0e0, 1e0 - 2e0 * abs(CASE WHEN {_P} < 0.6e0 THEN 0.3e0 + {_P} / 0.6e0 * 0.7e0 ELSE 1e0 - ({_P} - 0.6e0) / 0.4e0 * 0.6e0 END - b.mean_energy))"
_BUILD = f"greatest(0e0, 1e0 - 2e0 * abs(0.2e0 + 0.8e0 * {_P} - b.mean_energy))"


@query("sequence_greedy", _path_sql("SELECT * FROM v_tracks ORDER BY track_id LIMIT 1", _EDGE, "a.seen[-5:]"))
def sequence_greedy(v) -> DataFrame:
    """From the first track always the best edge to a track that wasn't among the last five.

    An edge over the least score goes before others, which the best one is if any is.
    """
    edges = Edges(v)
    return build_path(edges, edges.first(), lambda now, _: F.col("edge"))


@query("sequence_energy_arc", _path_sql("SELECT * FROM v_tracks ORDER BY round(greatest(0e0, 1e0 - 2e0 * abs(0.3e0 - mean_energy)), 6) DESC, track_id LIMIT 1", f"0.5e0 * {_EDGE} + 0.5e0 * {_PEAK}", "a.seen[-5:]"))
def sequence_energy_arc(v) -> DataFrame:
    """Half edge, half fit to the arc's energy at the place; the best opening first."""
    edges = Edges(v)
    return build_path(edges, edges.first(F.desc(F.round(_fit("peak", 0, LENGTH), 6))), lambda now, pos: 0.5 * F.col("edge") + 0.5 * _fit("peak", pos, LENGTH))


@query("sequence_for_mixing", _path_sql("SELECT * FROM v_tracks ORDER BY round(greatest(0e0, 1e0 - 2e0 * abs(0.2e0 - mean_energy)), 6) DESC, track_id LIMIT 1", f"CASE WHEN {match_sql('a', 'b')} THEN 2e0 ELSE 0e0 END + k.harm + 0.5e0 * {_BUILD} + coalesce(0.75e0 * c.rank, 0e0)", "a.seen"))
def sequence_for_mixing(v) -> DataFrame:
    """Common tempo first, then key, energy and how alike the cues are; no track twice until all are used."""
    edges, rank = Edges(v), similarity_rank(v)
    matched = lambda now: F.when(beatmatchable(F.lit(now["bpm"]), F.col("bpm")), 2.0).otherwise(0.0)
    score = lambda now, pos: matched(now) + F.col("harmonic") + 0.5 * _fit("build", pos, LENGTH) + F.coalesce(0.75 * rank(F.col("similarity")), F.lit(0.0))
    return build_path(edges, edges.first(F.desc(F.round(_fit("build", 0, LENGTH), 6))), score, cooldown=None)
