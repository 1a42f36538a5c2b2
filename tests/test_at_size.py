"""What makes the queries fit larger tables: what is broadcast, and results by classes, blocks and sorted runs against plain ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from setloom.functions.vectors import cosine
from setloom.operators import graph, signal, vectors
from setloom.plans import collage, paths
from setloom.sources.views import Views
from setloom.streaming import player

SF = "/root/testdata/sf0.001"


def broadcasts(df) -> list[str]:
    """The subtrees of a plan that are broadcast."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines() + df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


def test_collages_broadcast_draws_and_totals_only(spark):
    sent = broadcasts(collage.collage_plan(Views(spark, SF)))
    assert sent and all("ExistingRDD" in x or "_sl_sum" in x for x in sent)


def test_sessions_go_on_from_batch_to_batch(spark):
    """Sorted runs hold one state, not a group: no session is gathered, and a batch's end is not a session's."""
    rng = random.Random(9)
    kinds = ["post", "tick", "skip", "done", "end", "stop", "other", None]
    rows = [(k, i, rng.choices(kinds, [6, 6, 2, 6, 2, 0.1, 1, 1])[0], rng.choice([None, float("nan"), float(i)]), rng.choice([None, 100 * k + i]), rng.choice([None, float(i - 3)])) for k in range(40) for i in range(30)]
    want = {}
    for k, i, kind, pos, track, start in rows:
        s = player.Session() if i == 0 else s
        s, action = player.advance(s, kind, None if pos != pos else pos, track, start)
        want[k, i] = (action, s.track, s.next, s.played, list(s.recent))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "session long, seq long, kind string, pos double, track long, start double")
        played = player.play(shuffled)
        got = {(r.session, r.seq): (r.action, r.track, r.next, r.played, r.recent) for r in played.collect()}
        assert got == want and "GroupsInPandas" not in played._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def sides(monkeypatch) -> list[int]:
    """Collects how many pairs every call of ``graph.cells`` makes."""
    made, cells = [], graph.cells
    monkeypatch.setattr(graph, "cells", lambda a, b: made.append(a.count() * b.count()) or cells(a, b))
    return made


def few_classes(spark, n: int = 300):
    """Tracks of few tempos and keys, some ids on several rows, one without an id."""
    rng = random.Random(10)
    rows = [(i, rng.choice([60.0, 61.5, 90.0, 120.0, 121.0, 123.0, 180.0, 240.0]), rng.choice([1, 2, 8]), rng.choice("AB")) for i in range(n)]
    return spark.createDataFrame([*rows, rows[40], rows[40], rows[20], rows[21], (None, 120.0, 1, "A")], "track_id long, bpm double, key_num long, mode string").cache()


def every_pair(tracks):
    a, b = tracks.where(graph.SOURCES).select(F.struct("*").alias("a")), tracks.select(F.struct("*").alias("b"))
    return a.crossJoin(b).where("a.track_id <> b.track_id")


def test_edges_by_classes_equal_those_of_all_pairs(spark, monkeypatch):
    tracks, made = few_classes(spark), sides(monkeypatch)
    sims = spark.createDataFrame([(s, d, x) for s, d, x in ((0, 5, 0.9), (0, 40, -0.2), (0, 77, None), (40, 5, 1.0), (40, 77, 0.3), (999, 5, 1.0))], "src long, dst long, similarity double")
    out, into = [r.src for r in sims.select("src").distinct().collect()], [r.dst for r in sims.select("dst").distinct().collect()]
    sims = sims.unionByName(spark.createDataFrame([(40, 40, 1.0)], sims.schema)).where("src <> dst")
    sources = tracks.where(graph.SOURCES).withColumn("has_out", F.col("track_id").isin(out))
    got = graph.best_edges(sources, tracks.withColumn("has_in", F.coalesce(F.col("track_id").isin(into), F.lit(False))), sims, 10).collect()
    cued = F.col("src").isin(out) & F.col("dst").isin(into)
    both = every_pair(tracks).select(F.col("a.track_id").alias("src"), F.col("b.track_id").alias("dst"), graph.tempo_score().alias("rhythm"), graph.key_score().alias("base"), graph.best_shift(F.col("a.key_num"), F.col("a.mode"), F.col("b.key_num"), F.col("b.mode")).alias("s"))
    paid = F.col("s.score") - graph.SHIFT_PENALTY * F.abs("s.n")
    scored = both.join(sims, ["src", "dst"], "left").where(~cued | F.struct("src", "dst").isin([F.struct(F.lit(s).cast("long").alias("src"), F.lit(d).cast("long").alias("dst")) for s in out for d in into])).withColumn("h", F.round(F.when(F.coalesce(paid > F.col("base"), F.lit(False)), paid).otherwise(F.col("base")), 3))
    scored = scored.withColumn("score", F.round(graph.edge_score(F.col("h"), F.col("rhythm"), F.col("similarity")), 3))
    pool = {(s, d) for s in out for d in into} - {(r.src, r.dst) for r in sims.collect()}
    want: dict[int, list] = {}
    for r in sorted(scored.collect(), key=lambda r: (r.src, -r.score, r.dst)):
        if (r.src, r.dst) not in pool:
            want.setdefault(r.src, []).append((r.dst, r.score))
    have: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.src, r["rank"])):
        have.setdefault(r.src, []).append((r.dst, r.score))
    assert have == {s: x[:10] for s, x in want.items()} and len(have) == 15
    assert max(made) < 48 * 2 * 48 * 2


def test_next_tracks_work_the_edges_out_once(spark):
    plan = signal.next_track(Views(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 3 and "CoGroup" not in plan.split("InMemoryRelation")[0]


def test_beatmatch_partners_equal_those_of_all_pairs(spark):
    tracks = few_classes(spark)
    plain = every_pair(tracks).where(graph.beatmatchable(F.col("a.bpm"), F.col("b.bpm"))).groupBy("a.track_id").agg(F.count(F.lit(1)).alias("n_partners"), F.min("b.track_id").alias("first_partner"), F.max(graph.key_score()).alias("best_harm"))
    got = graph.beatmatch_partners(tracks.where(graph.SOURCES), tracks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 15
    lone = spark.createDataFrame([(20, 100.0, 1, "A"), (40, 130.0, 1, "A"), (41, 130.0, 1, "A")], tracks.schema)
    assert [tuple(r) for r in graph.beatmatch_partners(lone.where(graph.SOURCES), lone).collect()] == [(40, 1, 41, 1.0)]


def some_cues(spark, n: int = 400):
    """Cues of few tracks with equal, opposite, zero and missing vectors."""
    rng = random.Random(11)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(n):
        x = rng.choice(base)
        kind = rng.random()
        vector = None if kind < 0.1 else [0.0] * 8 if kind < 0.2 else [-y for y in x] if kind < 0.4 else x if kind < 0.7 else [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, i % 9, i // 9, "out" if rng.random() < 0.5 else "in", float(i), rng.random() < 0.5, rng.choice([0.25, 0.5]), vector))
    return spark.createDataFrame(rows, "cue_id long, track_id long, pos long, type string, ts double, phrase_aligned boolean, confidence double, embedding array<float>").cache()


def cue_pairs(cues):
    o, i = cues.where("type = 'out'").select(F.struct("*").alias("o")), cues.where("type = 'in'").select(F.struct("*").alias("i"))
    return o.crossJoin(i).where("o.track_id <> i.track_id").withColumn("sim", cosine(F.col("o.embedding"), F.col("i.embedding")))


def test_best_pairs_of_blocks_equal_those_of_all_pairs(spark, monkeypatch):
    cues = some_cues(spark)
    trust, aligned = (F.col("o.confidence") + F.col("i.confidence")) / 2.0, F.col("o.phrase_aligned") & F.col("i.phrase_aligned")
    score = F.when(F.col("sim").isNull(), 0.7 * trust + F.when(aligned, 0.3).otherwise(0.0)).otherwise(0.6 * F.col("sim") + 0.2 * trust + F.when(aligned, 0.2).otherwise(0.0))
    best = cue_pairs(cues).groupBy(F.col("o.track_id").alias("src"), F.col("i.track_id").alias("dst")).agg(F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("o.pos")).alias("p"), (-F.col("i.pos")).alias("q"), F.col("o.ts").alias("x"), F.col("i.ts").alias("y"), "sim")).alias("m"))
    want = sorted((r.src, r.dst, r.m.x, r.m.y, round(r.m.s, 6), r.m.sim if r.m.sim is None else r.m.sim + 0) for r in best.collect())
    for block in (7, 16_000):
        monkeypatch.setattr(graph, "VECTOR_BLOCK", block)
        monkeypatch.setattr(vectors, "PART", 50 if block == 7 else 1 << 18)
        out, into = cues.where("type = 'out'"), cues.where("type = 'in'")
        got = graph.paired_cues(out, into)
        assert sorted((r.src, r.dst, r.out_ts, r.in_ts, round(r.score, 6), r.similarity) for r in got.collect()) == want and len(want) == 72
    assert graph.paired_cues(out.where("false"), into).count() == graph.paired_cues(out, into.where("false")).count() == 0


def test_tempo_partners_equal_those_of_all_pairs(spark, monkeypatch):
    tracks, made = few_classes(spark), sides(monkeypatch)
    plain = every_pair(tracks).select("a.track_id", graph.tempo_score().alias("s")).groupBy("track_id").agg(F.count(F.lit(1)), F.count_if(F.col("s") > 0), F.max("s"), F.round(F.avg("s"), 6))
    got = graph.tempo_partners(tracks.where(graph.SOURCES), tracks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and max(made) <= 64
    lone = tracks.where("track_id = 60")
    assert graph.tempo_partners(lone, lone).count() == 0


def test_nearest_cues_of_blocks_equal_those_of_all_pairs(spark, monkeypatch):
    cues = some_cues(spark).where("embedding is not null")
    best = cue_pairs(cues).groupBy("o.cue_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("sim", (-F.col("i.cue_id")).alias("c"))).alias("m"))
    want = sorted((r.cue_id, r.n, -r.m.c, -9.0 if r.m.sim is None else r.m.sim + 0) for r in best.collect())
    for block in (11, 16_000):
        monkeypatch.setattr(graph, "VECTOR_BLOCK", block)
        got = graph.nearest_cues(cues.where("type = 'out'"), cues.where("type = 'in'"))
        assert sorted((r.cue_id, r.n_pairs, r.best_cue, -9.0 if r.best_sim is None else r.best_sim) for r in got.collect()) == want and any(r[3] == -9.0 for r in want)


def test_a_step_makes_no_rows_of_pairs_of_cues(spark):
    """The cues of the current track meet the others in blocks; a track without cues has no such join at all."""
    edges = paths.Edges(Views(spark, SF))
    cued = edges.out.join(edges.tracks, "track_id").orderBy("track_id").select("track_id").first().track_id
    now = lambda i: edges.tracks.where(F.col("track_id") == i).first().asDict()
    plan = lambda i: edges(now(i))._jdf.queryExecution().optimizedPlan().toString()
    lone = edges.tracks.join(edges.out, "track_id", "left_anti").orderBy("track_id").first().track_id
    assert "CoGroup" in plan(cued) and "Join" not in plan(lone)


def test_blocks_that_one_side_lacks_give_nothing(spark):
    cues = some_cues(spark).where("embedding is not null")
    one = cues.where("type = 'out'").limit(1)
    assert graph.nearest_cues(one, cues.where("type = 'in'").limit(3)).count() <= 1
    assert graph.paired_cues(one, cues.where("type = 'in'").limit(3)).count() <= 3
