"""A player's session as a state machine over control events; the same steps as a stream and as a batch.

Events (session, seq, kind, pos, track, start), in order of seq:

* ``post``: a track to come, from position ``start`` on; refused while a mix is on or another track waits;
* ``tick``: the position; a waiting track whose start is reached begins to mix;
* ``skip``: a waiting track begins to mix at once;
* ``done``: the mix is over: the incoming track is on air;
* ``end``: the track ran out with no mix: ``track`` goes on air at once;
* ``stop``: nothing after it counts.

An event that means nothing in its state is ignored. Null positions never start a mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from setloom.registry import query

#: Tracks that a session remembers.
RECENT = 4
COLUMNS = "session long, seq long, action string, track long, next long, played long, recent array<long>"


class Session(NamedTuple):
    track: int | None = None
    next: int | None = None
    start: float | None = None
    mixing: bool = False
    stopped: bool = False
    played: int = 0
    recent: tuple[int, ...] = ()


def on_air(s: Session, track: int) -> Session:
    return Session(track, None, None, False, s.stopped, s.played + 1, (*s.recent, track)[-RECENT:])


def mixes(s: Session) -> Session:
    return Session(s.track, s.next, s.start, True, s.stopped, s.played, s.recent)


def advance(s: Session, kind: str, pos: float | None = None, track: int | None = None, start: float | None = None) -> tuple[Session, str]:
    """The state after an event, and what it did."""
    if s.stopped:
        return s, "ignored"
    if kind == "stop":
        return s._replace(stopped=True), "stopped"
    if kind == "post" and track is not None:
        return (s, "refused") if s.mixing or s.next is not None else (Session(s.track, track, start, s.mixing, s.stopped, s.played, s.recent), "queued")
    if kind == "tick" and s.next is not None and not s.mixing and pos is not None and s.start is not None and pos >= s.start:
        return mixes(s), "mixes"
    if kind == "skip" and s.next is not None and not s.mixing:
        return mixes(s), "mixes"
    if kind == "done" and s.mixing:
        return on_air(s, s.next), "plays"
    if kind == "end" and not s.mixing and track is not None:
        return on_air(s, track), "jumps"
    return s, "ignored"


def _steps(s: Session, events: pd.DataFrame) -> tuple[Session, pd.DataFrame]:
    rows = []
    value = lambda x, kind: None if x is None or x != x else kind(x)
    for e in events.sort_values("seq").itertuples():
        s, action = advance(s, e.kind, value(e.pos, float), value(e.track, int), value(e.start, float))
        rows.append((int(e.session), int(e.seq), action, s.track, s.next, s.played, list(s.recent)))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    return s, out.astype({"track": "Int64", "next": "Int64"})


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``advance`` over rows in order of session and seq; a session goes on from batch to batch."""
    s, now = Session(), None
    for b in batches:
        sessions, seqs = b.column("session").to_pylist(), b.column("seq").to_pylist()
        actions, tracks, nexts, played, recent = [], [], [], [], []
        for session, kind, pos, track, start in zip(sessions, *(b.column(c).to_pylist() for c in ("kind", "pos", "track", "start")), strict=True):
            if session != now:
                s, now = Session(), session
            s, action = advance(s, kind, pos if pos == pos else None, track, start if start == start else None)
            actions.append(action)
            tracks.append(s.track)
            nexts.append(s.next)
            played.append(s.played)
            recent.append(s.recent)
        long = pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(sessions, long), pa.array(seqs, long), pa.array(actions, pa.string()), pa.array(tracks, long), pa.array(nexts, long), pa.array(played, long), pa.array(recent, pa.list_(long))], [c.split()[0] for c in COLUMNS.split(", ")])


def play(events: DataFrame) -> DataFrame:
    """What every event of every session did, and the state after it: sorted runs of sessions, of which one state is held."""
    rows = events.select(F.col("session").cast("long"), F.col("seq").cast("long"), "kind", F.col("pos").cast("double"), F.col("track").cast("long"), F.col("start").cast("double"))
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(_follow, COLUMNS)


_STATE = "track long, next long, start double, mixing boolean, stopped boolean, played long, recent array<long>"


def play_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; a session's state is bounded, and kept until it is stopped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Session(*state.get[:-1], tuple(state.get[-1])) if state.exists else Session()
        pdf = pd.concat(list(frames))
        s, out = _steps(s, pdf)
        state.update((s.track, s.next, s.start, s.mixing, s.stopped, s.played, list(s.recent)))
        yield out

    return events.groupBy("session").applyInPandasWithState(step, COLUMNS, _STATE, "append", GroupStateTimeout.NoTimeout)


@query("player_sessions")
def player_sessions(v) -> DataFrame:
    """Sessions made from sets: each clip is posted, ticked past, and mixed; every seventh is skipped to, every fifth ends without a mix."""
    c = v["clips"].select(F.col("set_id").alias("session"), "pos", "track_id", "out_start")
    kinds = F.when(F.col("pos") % 5 == 0, F.array(F.lit("end"))).when(F.col("pos") % 7 == 0, F.array(*map(F.lit, ("post", "skip", "done")))).otherwise(F.array(*map(F.lit, ("post", "post", "tick", "tick", "done"))))
    rows = c.select("session", "pos", "track_id", "out_start", F.posexplode(kinds).alias("n", "kind"))
    return play(rows.select("session", (10 * F.col("pos") + F.col("n")).cast("long").alias("seq"), "kind", (F.col("out_start") + F.col("n") - 3.0).alias("pos"), F.col("track_id").alias("track"), F.col("out_start").alias("start")))
