"""Rules on small inputs with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from setloom.functions import curves, harmony, text, vectors


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


@pytest.mark.parametrize(("a", "b", "score"), [((8, "A"), (8, "A"), 1.0), ((8, "A"), (8, "B"), 0.9), ((8, "A"), (9, "A"), 0.8), ((8, "A"), (10, "A"), 0.6), ((12, "A"), (3, "A"), 0.3), ((8, "A"), (9, "B"), 0.5), ((8, "A"), (2, "A"), 0.0), ((12, "B"), (1, "B"), 0.8)])
def test_key_compatibility(spark, a, b, score):
    assert one(spark, s=harmony.key_compatibility(F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1])))["s"] == score


def test_all_ordered_key_pairs(spark):
    codes = spark.range(1, 13).withColumn("m", F.explode(F.array(F.lit("A"), F.lit("B"))))
    pairs = codes.toDF("na", "ma").crossJoin(codes.toDF("nb", "mb")).where("na <> nb or ma <> mb")
    args = [F.col(c) for c in ("na", "ma", "nb", "mb")]
    rows = pairs.select(harmony.key_compatibility(*args).alias("base"), harmony.best_shift(*args).alias("s")).toPandas()
    better = rows[rows.s.notna()]
    assert len(rows) == 552 and len(better) == 432
    assert (better.s.map(lambda s: abs(s["n"])) == 1).sum() == 240
    assert (rows.base == 0).sum() == 336 and rows[rows.base == 0].s.notna().all()
    assert all(s["score"] > b for s, b in zip(better.s, better.base, strict=True))


def test_keys_transpose_and_back(spark):
    roots = spark.range(12).select(F.col("id").alias("r"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("m"))
    back = roots.select("r", harmony.key_root(harmony.key_number(F.col("r"), F.col("m")), F.col("m")).alias("q"))
    assert back.where("r <> q").count() == 0
    assert one(spark, k=harmony.transpose(F.lit(8), F.lit("B"), F.lit(12)))["k"] == 8


def test_tempo_is_directed_and_folds(spark):
    got = one(spark, same=harmony.tempo_compatibility(F.lit(128.0), F.lit(128.0)), double=harmony.tempo_compatibility(F.lit(140.0), F.lit(70.0)), far=harmony.tempo_compatibility(F.lit(100.0), F.lit(130.0)), ab=harmony.tempo_compatibility(F.lit(100.0), F.lit(110.0)), ba=harmony.tempo_compatibility(F.lit(110.0), F.lit(100.0)), bad=harmony.beatmatchable(F.lit(0.0), F.lit(120.0)), fold=harmony.fold_tempo(F.lit(70.0)), high=harmony.fold_tempo(F.lit(180.0)), none=harmony.fold_tempo(F.lit(-1.0)))
    assert got["same"] == got["double"] == 1.0 and got["far"] == 0.0 and got["ab"] != got["ba"]
    assert not got["bad"] and got["fold"] == 140.0 and got["high"] == 90.0 and got["none"] == 0.0


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    got = one(spark, same=vectors.cosine(v(1, 2), v(2, 4)), right=vectors.cosine(v(1, 0), v(0, 1)), zero=vectors.cosine(v(0, 0), v(0, 1)))
    assert got == {"same": 1.0, "right": 0.0, "zero": None}


@pytest.mark.parametrize(("raw", "t", "label"), [("01. 1:02:03 A - B", 3723.0, "A - B"), ("12:30 X", 750.0, "X"), ("[03:04] – Y", 184.0, "Y"), ("2) 00:00 | Z", 0.0, "Z"), ("no time here", None, None), ("", None, None), ("03) [1:02] Z", 62.0, "Z"), ("Live at 10:30 in town", None, None), ("12:30", None, None), ("12:30 - ", None, None)])
def test_track_lines(spark, raw, t, label):
    got = one(spark, t=text.line_seconds(F.lit(raw)), label=text.line_label(F.lit(raw)))
    assert got == {"t": t, "label": label}


def test_labels_titles_lengths(spark):
    got = one(spark, g=text.genre_tag(F.lit("A - B [deep house]")), y=text.genre_tag(F.lit("A - B (2019 mix)")), w=text.without_tag(F.lit("A - B [deep house]")), a=text.artist(F.lit("A – B - C")), t=text.title(F.lit("A – B - C")), n=text.artist(F.lit("only a title")), s=text.short_title(F.lit("/x/ab123 04 Some_Artist - A_Song.flac")), l=text.length_seconds(F.lit("1:02:03")), bad=text.length_seconds(F.lit("1:2:3:4")), f=text.length_seconds(F.lit("12.5")), c=text.licence_code(F.lit("http://x/licenses/by-nc-sa/3.0/")), p=text.licence_code(F.lit("http://x/publicdomain/zero/1.0/")), m=text.minutes(F.lit(125.9)), k=text.track_key(F.lit("/a/b.mp3")), h=text.hue(F.lit("/a/b.mp3")))
    import hashlib

    digest = hashlib.md5(b"/a/b.mp3").hexdigest()
    assert got["g"] == "deep house" and got["y"] is None and got["w"] == "A - B"
    assert (got["a"], got["t"], got["n"]) == ("A – B", "C", None)
    assert got["s"] == "A Song" and (got["l"], got["bad"], got["f"]) == (3723.0, 0.0, 12.5)
    assert (got["c"], got["p"], got["m"]) == ("by-nc-sa", "cc0", "2:05")
    assert got["k"] == digest[:8] and got["h"] == int(digest, 16) % 360


@pytest.mark.parametrize(("name", "title"), [("/a/LBL12 03 My_Song.mp3", "My Song"), ("12 Song.flac", "Song"), ("Song", "Song"), ("a-b - c.d.flac", "c.d"), ("2 Fast.wav", "Fast"), ("1999.mp3", "1999"), ("99.mp3", "99"), (".hidden", ".hidden"), ("", "")])
def test_short_titles(spark, name, title):
    assert one(spark, s=text.short_title(F.lit(name)))["s"] == title


def test_profiles_swap_the_bass_and_fade_the_rest(spark):
    at = lambda x, **k: one(spark, **curves.profile(F.lit(x), *[F.lit(k.get(n, 0.0)) for n in ("centre", "mid", "high")], None, F.lit(k["hold"]) if "hold" in k else None))
    start, mid, end = at(0.0, centre=0.5), at(0.5, centre=0.5), at(1.0, centre=0.5)
    assert [start[k] for k in ("out_low", "out_mid", "out_high", "in_low", "in_mid", "in_high")] == [1, 1, 1, 0, 0, 0]
    assert [round(mid[k], 9) for k in ("out_low", "out_mid", "in_low", "in_mid")] == [0.5, 0.707, 0.5, 0.707]
    assert [round(end[k], 9) for k in ("out_low", "out_mid", "out_high", "in_low", "in_mid", "in_high")] == [0, 0, 0, 1, 1, 1]
    late = at(0.6, centre=0.0, mid=0.6, high=2.0, hold=0.6)
    assert late["out_high"] == 1.0 and late["in_mid"] == 0.0 and late["in_high"] == 0.0 and late["out_low"] == 0.0
    assert round(at(0.9, centre=0.5, mid=0.8)["in_mid"], 9) == 0.707


def test_names_fields_and_addresses(spark):
    got = one(spark, s=text.safe_name(F.lit(' a<b>: "c"\t/d?. ')), d=text.destination(F.lit("Band"), F.lit(""), F.lit("Song"), F.lit("x.y.flac"), F.lit("id1")), e=text.destination(F.lit("?"), F.lit("A"), F.lit(None).cast("string"), F.lit("track"), F.lit("id1")), q=text.quoted(F.lit("a b/c+d~é*.mp3")), u=text.unquoted(text.quoted(F.lit("a b/c+d~é*%.mp3"))), one=text.first_value(F.lit('{"c": "x"}'), "$.c"), many=text.first_value(F.lit('{"c": ["y", "z"]}'), "$.c"), none=text.first_value(F.lit('{"c": []}'), "$.c"), gone=text.first_value(F.lit("{}"), "$.c"))
    from urllib.parse import quote

    assert got == {"s": "a b c d", "d": "Band/Band - Song.flac", "e": "id1/A - track.mp3", "q": quote("a b/c+d~é*.mp3"), "u": "a b/c+d~é*%.mp3", "one": "x", "many": "y", "none": "", "gone": ""}


def test_curves_and_lanes(spark):
    lane = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.2, 0.0), (0.6, 1.0))])
    got = one(spark, lo=curves.lane_value(lane, F.lit(0.1)), mid=curves.lane_value(lane, F.lit(0.4)), hi=curves.lane_value(lane, F.lit(0.9)), slam=curves.fade(F.lit("slam"), F.lit(0.5)), flat=curves.arc_target(F.lit("other"), F.lit(0.5)), fit=curves.energy_fit(F.lit(0.5), F.lit(None).cast("double")))
    assert got["lo"] == 0.0 and abs(got["mid"] - 0.5) < 1e-12 and got["hi"] == 1.0 and got["slam"] == 1.0 and got["flat"] == 0.7 and got["fit"] == 0.5
