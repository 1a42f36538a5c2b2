"""Streams give what the batch queries give on the same events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from setloom.operators import signal
from setloom.streaming import player, sessions
from setloom.sources.views import Views

SF = "/root/testdata/sf0.001"


def _run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).toPandas()


def _stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    rows = events.toPandas()
    for i in range(3):
        part = rows.iloc[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, sessions.read_events(spark, str(tmp_path / "in"), events.schema)


def test_windows_equal_the_batch(spark, tmp_path):
    rows, stream = _stream(spark, tmp_path)
    got = _run(spark, sessions.tumbling(stream, "1 hour").select(F.col("window.start").alias("w"), "event_type", "n"), "tumbling", "complete")
    want = rows.groupby([rows.ts.dt.floor("h"), "event_type"]).size()
    assert {(r.w, r.event_type): r.n for r in got.itertuples()} == want.to_dict()


def test_gaps_and_chunks_carry_state_over_batches(spark, tmp_path):
    rows, stream = _stream(spark, tmp_path)
    got = _run(spark, sessions.gaps(stream), "gaps", "append")
    want = sessions.silences(Views(spark, SF)).toPandas()
    a, b = (x.sort_values(["user_id", "gap_start"]).reset_index(drop=True) for x in (got, want))
    assert (a.user_id == b.user_id).all() and ((a.seconds - b.seconds).abs() < 0.002).all()
    last = _run(spark, sessions.chunks(stream), "chunks", "update").groupby("user_id").chunk.max()
    total = rows.groupby("user_id").value.sum()
    assert all(abs(last[u] - int(total[u] // 10)) <= 1 for u in total.index)


def test_heartbeats_never_go_back(spark):
    beats = spark.createDataFrame(pd.DataFrame({"user_id": [1, 1, 1, 2], "value": [5.0, -3.0, float("nan"), float("inf")]}))
    assert {r.user_id: r.played for r in sessions.heartbeat(beats).collect()} == {1: 5.0}


def test_scheduler_keeps_its_state_between_batches(spark, tmp_path):
    schema = "session long, seq long, pos double, bar double, played double, cue_ts double, cue_confidence double, done boolean, least double, most double"
    row = lambda seq, pos, played, cue=None, conf=None, done=False: (1, seq, pos, 2.0, played, cue, conf, done, 4.0, 24.0)
    batches = [
        [row(0, 0.0, 0.0, 10.0, 0.9), row(1, 8.0, 4.0, 30.0, 0.9)],  # too early; then a cue eleven bars ahead
        [row(2, 16.0, 8.0, 30.0, 0.9), row(3, 18.0, 9.0, 30.0, 0.9)],  # fires; then it mixes
        [row(4, 40.0, 0.0, done=True), row(5, 90.0, 25.0), row(6, 92.0, 26.0)],  # ends; the most dwell; mixes again
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    stream = sessions.read_events(spark, str(tmp_path / "ticks"), spark.createDataFrame([], schema).schema)
    got = _run(spark, signal.schedule(stream), "decisions", "append").sort_values("pos")
    assert list(zip(got.pos, got.fires, strict=True)) == [(0.0, False), (8.0, False), (16.0, True), (90.0, True)]


def test_player_sessions_step_by_step():
    s, log = player.Session(), []
    for event in [("tick", 1.0), ("post", None, 7, 10.0), ("post", None, 8, 20.0), ("tick", 9.0), ("end", None, None), ("tick", 10.0), ("post", None, 9, 30.0), ("skip",), ("done",), ("done",), ("post", None, 9, 30.0), ("skip",), ("tick", 40.0), ("done",), ("end", None, 3), ("post", None, 5, None), ("tick", 99.0), ("stop",), ("skip",)]:
        s, action = player.advance(s, *event)
        log.append(action)
    assert log == ["ignored", "queued", "refused", "ignored", "ignored", "mixes", "refused", "ignored", "plays", "ignored", "queued", "mixes", "ignored", "plays", "jumps", "queued", "ignored", "stopped", "ignored"]
    assert (s.track, s.next, s.played, s.recent) == (3, 5, 3, (7, 9, 3))


def test_player_streams_equal_the_batch(spark, tmp_path):
    columns = "session long, seq long, kind string, pos double, track long, start double"
    rows = [(k, i, kind, float(i), 10 * k + i, float(i)) for k in (1, 2, 3) for i, kind in enumerate(["post", "tick", "done", "post", "post", "skip", "done", "end", "post", "tick", "stop", "done"][: 9 + k])]
    for part in (rows[:7], rows[7:20], rows[20:]):
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], columns).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    normal = lambda pdf: sorted((r.session, r.seq, r.action, None if pd.isna(r.track) else int(r.track), int(r.played), list(r.recent)) for r in pdf.itertuples())
    want = player.play(spark.createDataFrame(rows, columns)).toPandas()
    assert normal(_run(spark, player.play_stream(stream), "player", "append")) == normal(want) and len(want) == len(rows)
    assert player.play(spark.createDataFrame([], columns)).count() == 0
