"""Operators against plain Python, and at their edges."""

from __future__ import annotations

import json
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from setloom.operators import features, graph, library, ordered, probe, screening, signal
from setloom.plans import collage, paths, planner
from setloom.sources import tables
from setloom.sources.views import Views

SF = "/root/testdata/sf0.001"


def test_bucketed_beatmatch_join_loses_no_pair(spark):
    random.seed(2)
    tracks = spark.createDataFrame([(i, random.uniform(45, 260), 1, "A") for i in range(150)], "track_id long, bpm double, key_num long, mode string").cache()
    from setloom.functions.harmony import beatmatchable

    every = tracks.select(F.struct("*").alias("a")).crossJoin(tracks.select(F.struct("*").alias("b"))).where("a.track_id <> b.track_id").where(beatmatchable(F.col("a.bpm"), F.col("b.bpm")))
    got = graph.beatmatch_join(tracks, tracks).select("a.track_id", "b.track_id").collect()
    assert len(got) == len(set(got)) and set(got) == set(every.select("a.track_id", "b.track_id").collect())


def test_tempo_clusters_equal_the_plain_fold(spark):
    random.seed(3)
    bpms = [round(random.uniform(90, 180), 2) for _ in range(300)] + [100.0] * 20
    clusters: list[list[float]] = []
    for b in sorted(bpms):
        if clusters and b - clusters[-1][0] <= 4.0:
            c, n = clusters[-1]
            clusters[-1] = [(c * n + b) / (n + 1), n + 1]
        else:
            clusters.append([b, 1])
    got = planner.cluster_tempos(spark.createDataFrame([(b,) for b in bpms], "bpm double")).collect()
    assert sorted((r.centre, r.n) for r in got) == sorted((round(c, 1), n) for c, n in clusters)
    assert planner.cluster_tempos(spark.createDataFrame([], "bpm double")).count() == 0


def test_lanes_equal_the_plain_fold(spark):
    random.seed(4)
    rows = [(s, p, float(a := random.randint(0, 60)), a + float(random.randint(1, 40))) for s in range(6) for p in range(25)]
    want = {}
    for s in range(6):
        ends = [float("-inf")] * 5
        for _, p, a, b in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            lane = next((i for i, e in enumerate(ends) if e <= a), -1)
            if lane >= 0:
                ends[lane] = b
            want[s, p] = lane
    got = planner.assign_lanes(spark.createDataFrame(rows, "set_id long, pos long, out_start double, out_end double")).collect()
    assert {(r.set_id, r.pos): r.lane for r in got} == want and -1 in want.values()


def test_two_source_weights_recover_what_was_mixed(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        a, b = rng.random(12), rng.random(12)
        wa, wb = rng.random(), rng.random()
        x = wa * a + wb * b if k % 2 else rng.normal(size=12)
        rows.append((k, float(a @ a), float(a @ b), float(b @ b), float(a @ x), float(b @ x), wa if k % 2 else None, wb if k % 2 else None))
    df = spark.createDataFrame(rows, "k long, aa double, ab double, bb double, ax double, bx double, wa double, wb double")
    ga, gb = probe.two_source_weights(*[F.col(c) for c in ("aa", "ab", "bb", "ax", "bx")])
    for r in df.select("*", ga.alias("ga"), gb.alias("gb")).collect():
        assert r.ga >= 0 and r.gb >= 0
        if r.wa is not None:
            assert abs(r.ga - r.wa) < 1e-9 and abs(r.gb - r.wb) < 1e-9
        else:  # no grid point does better
            loss = lambda p, q, r=r: p * p * r.aa + 2 * p * q * r.ab + q * q * r.bb - 2 * p * r.ax - 2 * q * r.bx
            assert loss(r.ga, r.gb) <= min(loss(p, q) for p in np.linspace(0, 2, 41) for q in np.linspace(0, 2, 41)) + 1e-9


def test_ramps_recover_a_known_logistic():
    t = np.linspace(0, 60, 121)
    got = probe.fit_ramp(pd.DataFrame({"id": 1, "t": t, "y": 1 / (1 + np.exp(-(t - 22.5) / 3.0))})).iloc[0]
    assert abs(got.centre - 22.5) < 1e-3 and abs(got.width - 3.0) < 1e-3 and got.r2 > 0.9999
    assert np.isnan(probe.fit_ramp(pd.DataFrame({"id": [1], "t": [0.0], "y": [0.0]})).iloc[0].centre)


def test_paths_hold_their_cooldown(spark):
    v = Views(spark, SF)
    ids = [r.track_id for r in paths.sequence_for_mixing(v).orderBy("pos").collect()]
    assert len(ids) == len(set(ids)) == paths.LENGTH
    edges = paths.Edges(v)
    edges.tracks = edges.tracks.where("track_id between 1 and 3").persist()
    go = lambda **options: [r.track_id for r in paths.build_path(edges, edges.first(), lambda now, _: F.col("edge"), **options).orderBy("pos").collect()]
    assert sorted(go(cooldown=5)) == [1, 2, 3]  # nothing is left
    again = go(cooldown=None, length=7)  # all used: any other track
    assert sorted(again[:3]) == [1, 2, 3] and len(again) == 7 and all(a != b for a, b in zip(again, again[1:], strict=False))
    assert sorted(go(cooldown=None, length=None)) == [1, 2, 3]


def test_sampled_pairs_are_even_and_never_of_one_track(spark):
    tracks = spark.range(60).select(F.col("id").alias("track_id"))
    every = planner.sampled_pairs(tracks, 10**6).select("a.track_id", "b.track_id").collect()
    assert len(every) == len(set(every)) == 60 * 59 and all(a != b for a, b in every)
    assert 90 <= planner.sampled_pairs(tracks, 100).count() <= 110
    assert planner.sampled_pairs(tracks.limit(1)).count() == 0


def test_seeded_draws_are_even(spark):
    draws = spark.range(2000).select(planner.seeded_unit(F.col("id"), F.lit("x")).alias("u")).toPandas()["u"]
    assert draws.between(0, 1, inclusive="left").all() and 0.45 < (draws < 0.5).mean() < 0.55


def test_upserts_keep_the_newest_and_add_columns(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, at long, x string")
    new = spark.createDataFrame([(1, 1, "c", True), (2, 4, "d", True), (3, 1, "e", True)], "k long, at long, x string, y boolean")
    got = {r.k: (r.x, r.y) for r in tables.upsert(old, new, ["k"], "at").collect()}
    assert got == {1: ("c", True), 2: ("b", None), 3: ("e", True)}
    assert {r.k for r in tables.stale(new.withColumnRenamed("k", "file_path").withColumn("file_hash", F.col("x")), old.withColumnRenamed("k", "file_path").withColumn("file_hash", F.lit("d"))).withColumnRenamed("file_path", "k").collect()} == {1, 3}


def test_files_sidecars_provenance_timeline(spark, tmp_path):
    for name in ("a/x.mp3", "a/x.cue", "a/x.json", "a/y.FLAC", "a/y.flac.txt", "z.ogg", "a/._x.mp3", "n.txt"):
        p = tmp_path / "lib" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("1")
    lib = str(tmp_path / "lib")
    found = [r.path.rsplit("/", 1)[1] for r in tables.scan_files(spark, lib, ignore=["z*"]).collect()]
    assert found == ["x.mp3", "y.FLAC"]
    audio = spark.createDataFrame([("/l/x.mp3",), ("/l/y.flac",), ("/l/q.mp3",)], "path string")
    side = spark.createDataFrame([("/l/x.cue",), ("/l/x.json",), ("/l/y.flac.txt",)], "path string")
    assert {r.path: r.sidecar for r in tables.pair_sidecars(audio, side).collect()} == {"/l/x.mp3": "/l/x.json", "/l/y.flac": "/l/y.flac.txt", "/l/q.mp3": None}
    (tmp_path / "p.jsonl").write_text('{"id": "a"}\n{broken\n{"id": "b"}\n')
    assert [r.id for r in tables.read_provenance(spark, str(tmp_path / "p.jsonl"), "id string").collect()] == ["a", "b"]
    tables.write_timeline(library.timeline_clips(Views(spark, SF)).where("set_id < 5"), str(tmp_path / "t"))
    lines = [json.loads(x) for f in (tmp_path / "t").glob("part-*") for x in f.read_text().splitlines()]
    assert lines and all([c["pos"] for c in x["clips"]] == sorted(c["pos"] for c in x["clips"]) for x in lines)


def test_cue_sheets_and_screens_at_their_edges(spark):
    raw = 'TITLE "Album"\nTRACK 01 AUDIO\n TITLE "A"\n PERFORMER "P"\n INDEX 00 00:00:00\n INDEX 01 01:02:37\nTRACK 02 AUDIO\n TITLE "B"\nTRACK 03 AUDIO\n INDEX 01 05:00:00'
    got = [tuple(r) for r in library.parse_cue_sheets(spark.createDataFrame([(1, raw), (2, "")], "sheet long, raw string")).orderBy("track").collect()]
    assert got == [(1, 1, "A", "P", round(62 + 37 / 75, 6)), (1, 3, None, None, 300.0)]
    by, nd, good = "http://x/licenses/by/4.0/", "http://x/licenses/by-nc-nd/4.0/", '{"electronic": 0.9, "house": 0.2, "techno": 0.1, "danceable": 0.8}'
    rows = [
        ("", 200.0, good, 135.0, 200.0), (nd, 200.0, good, 135.0, 200.0), (by, 20.0, good, 135.0, 200.0), (by, 0.0, good, 67.0, 200.0), (by, 200.0, '{"electronic": 0.1, "house": 0.9}', 135.0, 200.0),
        (by, 200.0, '{"house": 0.1, "techno": 0.1}', 135.0, 200.0), (by, 200.0, '{"house": 0.9, "danceable": 0.1}', 135.0, 200.0), (by, 200.0, None, 135.0, 200.0), (by, 200.0, good, 0.0, 200.0), (by, 200.0, good, 135.0, 2000.0), (by, 200.0, good, 170.0, 200.0),
    ]
    c = spark.createDataFrame(rows, "license string, duration double, highlevel string, measured_bpm double, measured_duration double")
    reasons = ["no license", "license", "duration", "keep", "not electronic", "subgenre", "danceability", "no data", "no tempo", "duration", "off-tempo"]
    assert [r.v for r in c.select(screening.category(screening.verdict()).alias("v")).collect()] == reasons
    lax = screening.Screen(require_license=False, licenses=(), allow_unscreened=True, tempo=None)
    assert [r.v for r in c.select(screening.verdict(lax).alias("v")).collect()] == ["keep", "keep", "duration (listed)", "keep", "not electronic", "subgenre", "danceability", *["keep"] * 4]
    assert c.select(screening.verdict(screening.Screen(allow_unscreened=True)).alias("v")).collect()[8].v == "keep"


def test_one_budget_keeps_the_row_that_crosses_the_line(spark):
    rows = [(i, 0, 1800.0 if i % 2 else 0.0, 10) for i in range(40)]
    df = spark.createDataFrame(rows, "identifier long, stem_id long, duration double, size long").repartition(5)
    hours = [0.5 if i % 2 else 300 / 3600 for i in range(40)]
    for most, size in ((2.0, 10**9), (100.0, 75), (0.0, 5)):
        want = [i for i in range(40) if sum(hours[:i]) < most - 1e-9 and 10 * i < size]
        assert sorted(r.identifier for r in screening.kept_until_full(df, most, size).collect()) == want
    places = ordered.positions(df.unionByName(df.limit(0)), "identifier", ["stem_id"])
    assert sorted((r.identifier, r["at"]) for r in places.collect()) == [(i, i) for i in range(40)]
    assert ordered.positions(df.where("false"), "identifier").count() == 0


def test_entries_not_after_the_last_kept_go(spark):
    rows = [(1, n, t) for n, t in enumerate([10.0, 50.0, 20.0, 60.0, 20.0, 50.0])]
    got = library.kept_entries(spark.createDataFrame(rows, "list long, line_id long, t double")).orderBy("position").collect()
    assert [(r.line_id, r.t, r.position) for r in got] == [(0, 10.0, 1), (2, 20.0, 2), (1, 50.0, 3), (3, 60.0, 4)]


def test_empty_library(spark):
    t = Views(spark, SF)["tracks"].where("false")
    assert library.grade(t).count() == 0
    assert screening.best_files(Views(spark, SF)["candidates"].where("false")).count() == 0


def test_change_points_and_tempo_of_synthetic_series():
    steps = np.concatenate([np.full(12, 120.0), np.full(12, 126.0), np.full(10, 122.0)])
    assert features.change_points(steps) == [11, 23]  # the first of equal shifts: two of three windows are new
    assert features.change_points(np.full(30, 128.0)) == [] and features.change_points(np.array([1.0, 2.0])) == []
    rate, bpm = 43.0, 128.0
    t = np.arange(int(60 * rate))
    onsets = (np.abs((t * bpm / 60 / rate) % 1 - 0.5) > 0.45).astype(float)
    got, trust = features.autocorrelation_tempo(onsets, rate)
    assert abs(got - bpm) < 0.5 and trust > 0.5
    assert features.autocorrelation_tempo(np.zeros(50), rate) == (0.0, 0.0)


def test_three_bands_add_up_and_go_on_from_chunk_to_chunk():
    rate = 22050.0
    t = np.arange(8000) / rate
    tones = {"low": 60.0, "mid": 800.0, "high": 7000.0}
    for band, f in tones.items():
        x = np.sin(2 * np.pi * f * t)
        parts, _ = signal.three_bands(x, rate)
        free, _ = signal.three_bands(x, rate, delay_free=True)
        for p in (parts, free):
            assert np.allclose(sum(p.values()), x)
            power = {k: float((v[2000:6000] ** 2).mean()) for k, v in p.items()}
            assert power[band] > 0.3 and max(power, key=power.get) == band
        assert float((free[band][2000:6000] * x[2000:6000]).mean()) > 0.45  # in phase
        first, state = signal.three_bands(x[:3000], rate)
        rest, _ = signal.three_bands(x[3000:], rate, state)
        assert all(np.allclose(np.concatenate([first[k], rest[k]]), parts[k]) for k in parts)
    y, _ = signal.filtered(np.sin(2 * np.pi * 100 * t), signal.butterworth(rate, 2000.0, high=True))
    assert np.abs(y[4000:]).max() < 0.01


def test_band_spectra_find_tones_in_their_bands():
    rate = 22050.0
    t = np.arange(int(rate)) / rate
    for band, tone in (("low", 90.0), ("mid", 800.0), ("high", 6000.0)):
        power = {k: x.sum(1) for k, x in signal.band_spectra(np.sin(2 * np.pi * tone * t), rate).items()}
        assert len({len(x) for x in power.values()}) == 1
        assert all(power[band][5:-5].min() > 50 * power[k][5:-5].max() for k in power if k != band)


def test_tables_open_empty_and_take_columns_and_settings(spark, tmp_path):
    for name, schema in tables.SCHEMAS.items():
        t = tables.open_table(spark, str(tmp_path), name)
        assert t.count() == 0 and t.columns == spark.createDataFrame([], schema).columns
        assert tables.open_table(spark, str(tmp_path), name).count() == 0
    old = spark.createDataFrame([(1, "a.mp3", "x")], "id long, file_path string, gone string")
    row = tables.with_columns(old, tables.SCHEMAS["tracks"]).first()
    assert row.file_path == "a.mp3" and row.loudness is None and "gone" not in row.asDict()
    meta = tables.set_meta(tables.set_meta(tables.open_table(spark, str(tmp_path), "meta"), "version", "2"), "version", "3")
    assert [tuple(r) for r in meta.collect()] == [("version", "3")]
    stored = spark.createDataFrame([(7, "b", 1.0), (9, "c", 1.0)], "id long, key string, n double")
    new = spark.createDataFrame([("c", 2.0), ("z", 5.0), ("a", 4.0)], "key string, n double")
    assert sorted((r.key, r.id, r.n) for r in tables.upsert_by_id(stored, new, "key", "n").collect()) == [("a", 10, 4.0), ("b", 7, 1.0), ("c", 9, 2.0), ("z", 11, 5.0)]
    log = str(tmp_path / "log")
    tables.append_provenance(new, log)
    tables.append_provenance(new.limit(1), log)
    assert tables.read_provenance(spark, log, "key string, n double").count() == 4
    tables.write_report(new, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_tempo_segments_of_a_synthetic_mix():
    rate = 50.0
    clock, beats = 0.3, []
    while clock < 240:
        beats.append(clock)
        clock += 60.0 / (120.0 if clock < 120 else 128.0)
    onsets = np.zeros(int(240 * rate))
    for b in beats:
        onsets[min(int(round(b * rate)), len(onsets) - 1)] += 1.0
    found = features.tempo_segments(onsets, rate)
    assert [round(s[2]) for s in found] == [120, 128] and abs(found[0][1] - 120) < 12
    assert found[0][0] == 0.0 and found[-1][1] == 240.0 and found[0][1] == found[1][0]
    assert abs(found[0][3] - 0.3) < 0.04 and features.tempo_segments(np.zeros(100), rate) == []
    cleaned = features.without_octave_errors(np.array([120.0, 121, 60, 119, 240, 120]))
    assert np.isnan(cleaned).tolist() == [False, False, True, False, True, False]


def band(i, name, **over):
    row = {"id": i, "band": name, "beat": 0.5, "purity": 0.9, "rho": 0.2, "centre": 100.0, "span": 16.0, "travel": 0.9, "r2": 0.9, "residual": 0.1, "floor": 0.05, "lo": 60.0, "hi": 140.0}
    return tuple((row | over).values())


def test_bands_combine_by_their_agreement(spark):
    rows = [
        *(band(1, b) for b in ("low", "mid", "high")), band(2, "low"), band(2, "mid", rho=0.99), band(2, "high", r2=0.1), band(3, "mid"), band(3, "low", travel=0.1), band(3, "high", rho=0.95),
        band(4, "mid", centre=100.0, span=1.0), band(4, "high", centre=100.2, span=1.2), band(5, "mid", r2=0.95), band(5, "high", centre=139.0), band(5, "low"), band(6, "mid", span=200.0), band(6, "high", span=190.0, centre=101.0),
        band(7, "mid", centre=None), band(7, "high", centre=300.0), band(8, "mid", residual=0.3), band(8, "high", residual=0.96),
    ]
    names = "id long, band string, beat double, purity double, rho double, centre double, span double, travel double, r2 double, residual double, floor double, lo double, hi double"
    got = {r.id: r for r in probe.combine_bands(spark.createDataFrame(rows, names)).collect()}
    assert [got[i].reason for i in range(1, 9)] == ["", "no_duration_band", "insufficient_band_agreement", "", "", "implausible_duration", "center_out_of_window", "high_residual"]
    assert (got[1].t_start, got[1].t_end, got[1].t_bass, got[1].beats, got[1].is_cut) == (92.0, 108.0, 100.0, 32.0, 0)
    assert got[4].is_cut == 1 and got[4].beats == 0.0 and got[4].t_start == got[4].t_end
    assert got[5].n_agreed == 2 and got[5].t_start == 92.0 and 0.05 <= got[5].confidence <= got[1].confidence <= 1


def test_styles_by_similarity_energy_and_draw(spark):
    rows = [(False, 0.9, 0.5, 0.5, 0.1), (True, 0.9, 0.5, 0.9, 0.1), (True, 0.1, 0.4, 0.4, 0.1), (True, None, 0.8, 0.9, 0.1), (True, 0.1, 0.6, 0.5, 0.9), (True, 0.1, 0.5, 0.6, 0.1), (True, 0.1, 0.52, 0.5, 0.1), (True, 0.1, 0.52, 0.5, 0.9), (True, None, None, None, 0.4)]
    df = spark.createDataFrame(rows, "m boolean, s double, o double, i double, u double")
    got = [r.x for r in df.select(planner.style(F.col("m"), F.col("s"), F.col("o"), F.col("i"), F.col("u")).alias("x")).collect()]
    assert got == ["cut", "blend", "blend", "swap", "fade", "build", "fade", "build", "fade"]


def test_cells_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "SOURCE_BLOCK", 3)
    monkeypatch.setattr(graph, "OTHER_BLOCK", 5)
    a, b = spark.range(11).toDF("x"), spark.range(23).toDF("y")
    got = [tuple(r) for r in graph.cells(a, b).collect()]
    assert sorted(got) == [(x, y) for x in range(11) for y in range(23)]
    assert graph.cells(a, b.where("y < 0")).count() == 0 and graph.cells(a.where("x < 0"), b).count() == 0


def test_profiles_are_their_own_keys(spark):
    rows = [(m * 12 + r, p, prof[(p - r) % 12]) for m, prof in ((0, features.MAJOR), (1, features.MINOR)) for r in range(12) for p in range(12)]
    got = {x.id: (x.root, x.minor, x.confidence) for x in features.detect_keys(spark.createDataFrame(rows, "id long, pos long, value double")).collect()}
    assert got == {m * 12 + r: (r, m, 1.0) for m in range(2) for r in range(12)}


def test_limited_peaks_stay_under_the_ceiling():
    rng = np.random.default_rng(7)
    level = rng.random(300) * 2
    gain = signal.limit_series(level)
    assert (level * gain <= 0.95 + 1e-9).all() and (gain <= 1).all()
    assert np.allclose(signal.limit_series(np.full(20, 0.5)), 1.0) and len(signal.limit_series(np.zeros(0))) == 0
    calm = signal.limit_series(np.r_[2.0, np.zeros(60)])
    assert (np.diff(calm) >= 0).all() and calm[-1] > 0.99


def test_splices_go_farthest_first():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        energy, x = rng.random(n), rng.normal(size=(n, 5))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = [int(energy.argmax())]
        while len(want) < n:
            rest = [i for i in range(n) if i not in want]
            want.append(min(rest, key=lambda i: max(unit[i] @ unit[j] for j in want)))
        assert signal.splice_order(energy, x) == want


def test_spectra_find_a_tone_and_shelves_their_gain(spark):
    t = np.arange(4096)
    assert (signal.spectra(np.sin(2 * np.pi * t * 32 / 256)).argmax(1) == 32).all() and signal.spectra(np.zeros(10)).shape == (0, 129)
    for high in (False, True):
        c = spark.range(1).select(*[x.alias(k) for k, x in signal.shelf(F.lit(44100.0), F.lit(1000.0), F.lit(-6.0), high=high).items()]).first()
        at = lambda z, c=c: abs((c.b0 + c.b1 * z + c.b2 * z * z) / (1 + c.a1 * z + c.a2 * z * z))
        low, top = at(1.0), at(-1.0)
        assert abs((top if high else low) - 10 ** (-6 / 20)) < 1e-9 and abs((low if high else top) - 1) < 1e-9


def test_json_lists_at_their_edges(spark):
    raws = ["[]", "{}", "nope", None, '[{"t": 1, "title": ""}, {"title": "x"}, {"t": 2, "artist": "A"}]', '{"tracks": [{"t": 3, "title": "B"}]}', '{"tracklist": [{"t": 4, "title": "C", "extra": 1}]}']
    got = signal.json_entries(spark.createDataFrame(list(enumerate(raws)), "list_id long, raw string")).collect()
    assert sorted((r.list_id, r.pos, r.t, r.artist, r.title) for r in got) == [(4, 2, 2.0, "A", None), (5, 0, 3.0, None, "B"), (6, 0, 4.0, None, "C")]


def test_next_tracks_relax_when_nothing_is_left(spark):
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (4, 5, 1)], "src long, dst long, rank long")
    recent = spark.createDataFrame([(1, 2), (4, 5)], "src long, dst long")
    assert {r.src: r.next_track for r in signal.next_tracks(edges, recent).collect()} == {1: 3, 4: 5}


def test_collages_are_seeded_bounded_and_full(spark):
    plan = lambda *a, **k: pd.DataFrame(collage.schedule(*a, **k), columns=["seed", "pos", "mode", "out_start", "out_end", "places"])
    a, b, c = plan(40, 1), plan(40, 1), plan(40, 2, chaos=1.0)
    assert a.equals(b) and not a.equals(c) and not collage.schedule(0, 1)
    for x in (a, c):
        assert x.out_start.is_monotonic_increasing and x.out_start.iloc[-1] >= 500
        layers = [((x.out_start <= t) & (t < x.out_end)).sum() for t in x.out_start]
        assert max(layers) <= collage.LAYERS
    assert (c["mode"] == "weave").mean() > (a["mode"] == "weave").mean()
    assert abs(spark.range(1).select(planner.seeded_unit(F.lit(3), F.lit("x"))).first()[0] - collage.draw(3, "x")) < 1e-15
    # The whole pool is open to the draws, however large.
    assert max(p for r in collage.schedule(10**6, 3) for p in r[5]) > 9 * 10**5


def test_collage_picks_go_by_likeness_then_key(spark):
    rows = [(i, 0, 0, i % 12 + 1, "A", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(60)]
    pool = spark.createDataFrame(rows, "track_id long, section long, sub long, key_num long, mode_key string, vector array<double>")
    got = collage.collage(pool, [1, 2]).toPandas().sort_values(["seed", "pos"])
    assert got.equals(collage.collage(pool.repartition(5), [1, 2]).toPandas().sort_values(["seed", "pos"])) or len(got)
    for seed, x in got.groupby("seed"):
        want = [r[1] for r in collage.schedule(60, int(seed))]
        assert x.pos.tolist() == want
        woven = x[x["mode"] == "weave"]
        assert all(a != b for a, b in zip(x.track_id, x.track_id[1:], strict=False)) and len(woven)
    for a in (1, 5, 12):
        for ma in "AB":
            for b in (1, 2, 3, 4, 7, 12):
                for mb in "AB":
                    from setloom.functions.harmony import key_compatibility

                    if (a, b) == (1, 12) or a == 5:
                        want = spark.range(1).select(key_compatibility(F.lit(a), F.lit(ma), F.lit(b), F.lit(mb))).first()[0]
                        assert collage.wheel_score((a, ma), (b, mb)) == want
    assert collage.collage(pool.where("false"), [1]).count() == 0


