"""Collages: seeded layers of segments in three kinds of movement, and the fade shapes and tone moves of each placement.

Draws are hashes of seed, step and purpose, the same in every engine and run. They do not depend on what is drawn: when a
placement starts, how long it lasts and which places of the pool it may take are known before the pool is read. The
segments at those places, a bounded number for each placement, are then found by a join, and taken one after the
other: by how alike they are to what sounds already, then by key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.operators.ordered import positions
from setloom.plans.cues import entries
from setloom.plans.planner import seeded_unit, segment_pool
from setloom.registry import query

#: Segments that are drawn for a pick, layers at once at most, seconds of a bar, and the picks ranked by key.
DRAWN, LAYERS, BAR, NEAREST = 40, 5, 1.875, 6
MODES = ("weave", "feature", "breathe")


def draw(*parts: object) -> float:
    """The same draw as ``seeded_unit``, in Python."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16) / (1 << 64)


def pick(weights: dict[str, float], u: float) -> str:
    at = u * sum(weights.values())
    for name, w in weights.items():
        at -= w
        if at < 0:
            return name
    return name


def movement_weights(progress: float, chaos: float) -> dict[str, float]:
    """Weaving in the middle, breathing at the ends; chaos crowds out what is calm."""
    calm, middle = 1.0 - 0.85 * chaos, 0.2 <= progress <= 0.85
    return {"weave": 1.5 + 1.5 * middle + 5.0 * chaos, "feature": 1.2 * calm, "breathe": (1.0 + 1.5 * (not middle)) * calm}


def schedule(n: int, seed: int, *, length: float = 600.0, chaos: float = 0.35, bars: tuple[int, int] = (4, 24), layers: int = LAYERS) -> list[tuple]:
    """(seed, pos, mode, out_start, out_end, places) of one seed's placements over a pool of ``n`` segments, until ``length`` seconds are full."""
    rows, clock, step, ends = [], 0.0, 0, []
    while n and clock < length:
        mode = pick(movement_weights(clock / length, chaos), draw(seed, step, "mode"))
        count = {"weave": 3 + int(draw(seed, step, "n") * (4 + 8 * chaos)), "feature": 2 + int(draw(seed, step, "n") * 3), "breathe": 1 + int(draw(seed, step, "n") * 2)}[mode]
        first = int(draw(seed, step, "first") * n)
        for k in range(count):
            if clock >= length:
                break
            # A feature goes on through its track; any other pick has a draw of the whole pool.
            places = [(first + k) % n] if mode == "feature" else list(dict.fromkeys(int(draw(seed, step, k, "pick", i) * n) for i in range(DRAWN)))
            size = bars[0] + int(draw(seed, step, k, "bars") * (bars[1] - bars[0] + 1))
            hop = {"feature": max(1.0, size - 2.0), "breathe": max(1.0, size - 1.0), "weave": max(0.25, size / (3 + round(2 * chaos)))}[mode]
            ends = [e for e in ends if e > clock]
            if len(ends) >= layers:  # no lane free: wait for the first to end
                clock = min(ends)
                ends = [e for e in ends if e > clock]
            ends.append(clock + size * BAR)
            rows.append((seed, len(rows), mode, clock, clock + size * BAR, places))
            clock += hop * BAR
        step += 1
    return rows


def wheel_score(a: tuple[int, str], b: tuple[int, str]) -> float:
    """``key_compatibility``, in Python."""
    d = min(abs(a[0] - b[0]), 12 - abs(a[0] - b[0]))
    return ({0: 1.0, 1: 0.8, 2: 0.6, 3: 0.3} if a[1] == b[1] else {0: 0.9, 1: 0.5}).get(d, 0.0)


def choose(drawn: pd.DataFrame) -> pd.DataFrame:
    """One seed's placements from the segments drawn for them (pos, mode, out_start, out_end, nth, track_id, section, key_num, mode_key, vector).

    Tracks of the last two picks wait. Breathing picks go with what sounds, woven ones against it; of the six best the key decides.
    """
    rows: list[tuple] = []
    active: list[tuple[float, np.ndarray]] = []
    last: tuple[int, str] | None = None
    for pos, own in drawn.sort_values(["pos", "nth"]).groupby("pos", sort=True):
        start, end, mode = own.out_start.iloc[0], own.out_end.iloc[0], own["mode"].iloc[0]
        active = [(e, x) for e, x in active if e > start]
        recent = [r[2] for r in rows[-2:]]
        left = own[~own.track_id.isin(recent)] if mode != "feature" else own
        left = list((left if len(left) else own).itertuples(index=False))
        best = left[0]
        if mode != "feature" and active:
            near = mode == "breathe"

            def alike(s, near=near) -> float:
                if s.vector is None:
                    return -1.0 if near else 1.0  # unknown ranks last
                x = np.asarray(s.vector, float)
                return max(float(x @ y) / max(float(np.linalg.norm(x) * np.linalg.norm(y)), 1e-12) for _, y in active)

            top = sorted(left, key=alike, reverse=near)[:NEAREST]
            best = max(top, key=lambda s: wheel_score(last, (s.key_num, s.mode_key))) if last else top[0]
        if best.vector is not None:
            active.append((end, np.asarray(best.vector, float)))
        last = (int(best.key_num), best.mode_key)
        rows.append((int(best.seed), int(pos), int(best.track_id), int(best.section), float(start), float(end), mode))
    return pd.DataFrame(rows, columns=["seed", "pos", "track_id", "section", "out_start", "out_end", "mode"])


def collage(pool: DataFrame, seeds: list[int], *, about: DataFrame | None = None, **options) -> DataFrame:
    """Placements of every seed; ``pool`` has track_id, section, sub, and it or ``about`` (by track_id) key_num, mode_key and vector.

    The draws, a bounded number, are what is broadcast: numbered segments are found by them first, and only what was found
    is joined with the properties of its tracks.
    """
    placed = positions(pool, "track_id", ["section", "sub"], name="place")
    spark, n = pool.sparkSession, pool.count()
    plans = spark.createDataFrame([r for s in seeds for r in schedule(n, s, **options)], "seed long, pos long, mode string, out_start double, out_end double, places array<long>")
    drawn = placed.join(F.broadcast(plans.select("seed", "pos", "mode", "out_start", "out_end", F.posexplode("places").alias("nth", "place"))), "place")
    if about is not None:
        drawn = about.join(F.broadcast(drawn), "track_id")
    return drawn.groupBy("seed").applyInPandas(choose, "seed long, pos long, track_id long, section long, out_start double, out_end double, mode string")


@query("collage_plan")
def collage_plan(v) -> DataFrame:
    """Segments of all tracks, with their keys and the vectors of their entries."""
    # Tracks look small to the planner, by compressed files and two columns of them, and would be broadcast.
    tracks = v["tracks"].hint("merge")
    vectors = entries(v["cues"], tracks).select("track_id", F.col("in_vector").alias("vector"))
    keys = tracks.select("track_id", "key_num", F.col("mode").alias("mode_key")).join(vectors, "track_id", "left")
    return collage(segment_pool(v).select("track_id", "section", "sub"), [1, 2, 3, 4], about=keys)


def fade_shapes(mode: Column, u: Column, w: Column, bold: float = 0.21) -> Column:
    """(in, out) shapes of a placement: plain when featured, soft when breathing; a weave is bold at times."""
    def choose(x: Column, *names: str) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(x * len(names)) + 1).cast("int"))

    pair = lambda a, b: F.concat_ws("/", a, b)
    wild = pair(choose(u / bold, "slam", "hold", "log"), choose(w, "hold", "slam", "equal_power"))
    tame = pair(choose((u - bold) / (1 - bold), "equal_power", "scurve", "exp"), F.lit("equal_power"))
    return F.when(mode == "feature", "equal_power/equal_power").when(mode == "breathe", pair(choose(u, "scurve", "exp"), choose(w, "scurve", "equal_power"))).otherwise(F.when(u < bold, wild).otherwise(tame))


def tone_move(mode: Column, layers: Column, u: Column, w: Column, chaos: float = 0.35) -> Column:
    """What a placement does to its tone: nothing when featured; without its low end, more likely, over other layers."""
    alone = F.when(w < 0.35 * chaos, "sweep_in").when(w < 0.425 * chaos, "sweep_out").when(w < 0.5 * chaos, "bass_first").otherwise("flat")
    return F.when(mode == "feature", "flat").when(mode == "breathe", F.when(u < 0.3, "sweep_in").otherwise("flat")).when((layers >= 2) & (u < 0.5 + 0.3 * chaos), "lowcut").otherwise(alone)


_U = "(CAST(concat('0x', substr(sha256(concat_ws('|', CAST(set_id AS VARCHAR), CAST(pos AS VARCHAR), '{x}')), 1, 16)) AS UBIGINT) / 18446744073709551616e0)"


@query(
    "placement_gestures",
    f"""SELECT set_id, pos, mode, CASE WHEN mode = 'feature' THEN 'equal_power/equal_power' WHEN mode = 'breathe' THEN concat((['scurve', 'exp'])[CAST(floor(u * 2) AS INT) + 1], '/', (['scurve', 'equal_power'])[CAST(floor(w * 2) AS INT) + 1])
 WHEN u < 0.21e0 THEN concat((['slam', 'hold', 'log'])[CAST(floor(u / 0.21e0 * 3) AS INT) + 1], '/', (['hold', 'slam', 'equal_power'])[CAST(floor(w * 3) AS INT) + 1]) ELSE concat((['equal_power', 'scurve', 'exp'])[CAST(floor((u - 0.21e0) / 0.79e0 * 3) AS INT) + 1], '/equal_power') END AS fades,
 CASE WHEN mode = 'feature' THEN 'flat' WHEN mode = 'breathe' THEN CASE WHEN u < 0.3e0 THEN 'sweep_in' ELSE 'flat' END WHEN pos >= 2 AND u < 0.605e0 THEN 'lowcut' WHEN w < 0.1225e0 THEN 'sweep_in' WHEN w < 0.14875e0 THEN 'sweep_out' WHEN w < 0.175e0 THEN 'bass_first' ELSE 'flat' END AS move
FROM (SELECT set_id, pos, CASE pos % 3 WHEN 0 THEN 'feature' WHEN 1 THEN 'weave' ELSE 'breathe' END AS mode, {_U.format(x="u")} AS u, {_U.format(x="w")} AS w FROM v_clips) c""",
)
def placement_gestures(v) -> DataFrame:
    """Fade shapes and tone moves of all clips, with draws from their places."""
    u, w = (seeded_unit(F.col("set_id"), F.col("pos"), F.lit(x)) for x in "uw")
    mode = F.when(F.col("pos") % 3 == 0, "feature").when(F.col("pos") % 3 == 1, "weave").otherwise("breathe")
    c = v["clips"].select("set_id", "pos", mode.alias("mode"), u.alias("u"), w.alias("w"))
    return c.select("set_id", "pos", "mode", fade_shapes(F.col("mode"), F.col("u"), F.col("w")).alias("fades"), tone_move(F.col("mode"), F.col("pos"), F.col("u"), F.col("w")).alias("move"))
