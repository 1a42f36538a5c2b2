"""Compatibility: key and tempo scores between tracks, vector similarity and pairing of cues, ranked edges.

Pair queries score a stated set of sources (ids divisible by 20) against all tracks; nothing joins all with all. Pairs
are made in cells: sources and tracks are cut into blocks of bounded size, and each cell of two blocks is a group of an
ordinary equality join, so nothing is broadcast whose size grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setloom.functions.harmony import SHIFT_PENALTY, beatmatchable, best_shift, key_compatibility, tempo_compatibility
from setloom.functions.vectors import cosine
from setloom.operators import vectors
from setloom.registry import query

SOURCES = "track_id % 20 = 0"

# Fragments of the reference SQL, by the columns of two sides.
_DIST = "least(abs({a}.key_num - {b}.key_num), 12 - abs({a}.key_num - {b}.key_num))"
_KEY = f"CASE WHEN {{a}}.mode = {{b}}.mode THEN CASE {_DIST} WHEN 0 THEN 1e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.6e0 WHEN 3 THEN 0.3e0 ELSE 0e0 END ELSE CASE {_DIST} WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.5e0 ELSE 0e0 END END"
_OFF = "CASE WHEN {x} <= 0.06e0 THEN 1e0 - {x} / 0.06e0 * 0.2e0 WHEN {x} <= 0.12e0 THEN 0.8e0 - ({x} - 0.06e0) / 0.06e0 * 0.5e0 ELSE 0e0 END"
_TEMPO = "greatest(" + ", ".join(_OFF.format(x=f"abs({r} - 1e0)") for r in ("{b}.bpm / {a}.bpm", "2e0 * {b}.bpm / {a}.bpm", "{b}.bpm / (2e0 * {a}.bpm)")) + ")"
_MATCH = "least(abs({a}.bpm / {b}.bpm - 1e0), abs({a}.bpm / (2e0 * {b}.bpm) - 1e0), abs(2e0 * {a}.bpm / {b}.bpm - 1e0)) <= 0.08e0"


def key_sql(a: str, b: str) -> str:
    return _KEY.format(a=a, b=b)


def tempo_sql(a: str, b: str) -> str:
    return _TEMPO.format(a=a, b=b)


def match_sql(a: str, b: str) -> str:
    return _MATCH.format(a=a, b=b)


#: Rows of a block of sources, and of the other side.
SOURCE_BLOCK, OTHER_BLOCK = 4_000, 50_000


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``a`` beside every row of ``b`` (columns of their own names), cell by cell."""
    n_a, n_b = a.count(), b.count()
    rows = max(1, -(-n_a // SOURCE_BLOCK))
    columns = max(1, -(-n_b // OTHER_BLOCK), -(-a.sparkSession.sparkContext.defaultParallelism // rows))
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n))
    left = a.withColumn("_sl_i", dealt(a, rows)).withColumn("_sl_j", F.explode(_numbers(columns)))
    right = b.withColumn("_sl_j", dealt(b, columns)).withColumn("_sl_i", F.explode(_numbers(rows)))
    spread = lambda df: df.repartition(rows * columns, "_sl_i", "_sl_j")
    return spread(left).join(spread(right), ["_sl_i", "_sl_j"]).drop("_sl_i", "_sl_j")


#: Rows of a block of vectors, of either side.
VECTOR_BLOCK = 16_000


def blocked(a: DataFrame, b: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of every two blocks of rows of ``a`` and ``b`` (Arrow tables): cells whose rows are scored by matrix products."""
    n_a, n_b = a.count(), b.count()
    rows = max(1, -(-n_a // VECTOR_BLOCK))
    columns = max(1, -(-n_b // VECTOR_BLOCK), -(-4 * a.sparkSession.sparkContext.defaultParallelism // rows))
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n))
    left = a.withColumn("_sl_i", dealt(a, rows)).withColumn("_sl_j", F.explode(_numbers(columns)))
    right = b.withColumn("_sl_j", dealt(b, columns)).withColumn("_sl_i", F.explode(_numbers(rows)))
    return left.groupBy("_sl_i", "_sl_j").cogroup(right.groupBy("_sl_i", "_sl_j")).applyInArrow(f, schema)


def pairs(sources: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each source with every other track, as structs a and b."""
    return cells(sources.select(F.struct("*").alias("a")), tracks.select(F.struct("*").alias("b"))).where(F.col("a.track_id") != F.col("b.track_id"))


def key_table(spark) -> DataFrame:
    """(na, ma, nb, mb, base, shifted, n): scores and best shifts of all pairs of keys, 576 rows, worked out once."""
    codes = spark.range(1, 13).withColumn("m", F.explode(F.array(F.lit("A"), F.lit("B"))))
    both = codes.toDF("na", "ma").crossJoin(codes.toDF("nb", "mb"))
    args = [F.col(c) for c in ("na", "ma", "nb", "mb")]
    return both.withColumn("s", best_shift(*args)).select("na", "ma", "nb", "mb", key_compatibility(*args).alias("base"), F.col("s.score").alias("shifted"), F.col("s.n").alias("n"))


def key_score():
    return key_compatibility(F.col("a.key_num"), F.col("a.mode"), F.col("b.key_num"), F.col("b.mode"))


def tempo_score():
    return tempo_compatibility(F.col("a.bpm"), F.col("b.bpm"))


@query(
    "compatible_top_n",
    f"""WITH s AS (SELECT * FROM v_tracks ORDER BY track_id LIMIT 1),
p AS (SELECT b.track_id, b.title, {key_sql("a", "b")} AS harm, {tempo_sql("a", "b")} AS rhythm FROM s a JOIN v_tracks b ON a.track_id <> b.track_id)
SELECT CAST(row_number() OVER (ORDER BY round(0.6e0 * harm + 0.4e0 * rhythm, 6) DESC, title, track_id) AS BIGINT) AS rank, track_id, harm, rhythm, round(0.6e0 * harm + 0.4e0 * rhythm, 6) AS score
FROM p ORDER BY rank LIMIT 10""",
)
def compatible_top_n(v, n: int = 10) -> DataFrame:
    tracks = v["tracks"]
    source = tracks.orderBy("track_id").limit(1)
    scored = pairs(source, tracks).select("b.track_id", "b.title", key_score().alias("harm"), tempo_score().alias("rhythm")).withColumn("score", F.round(0.6 * F.col("harm") + 0.4 * F.col("rhythm"), 6))
    top = scored.orderBy(F.desc("score"), "title", "track_id").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "title", "track_id")).cast("long").alias("rank"), "track_id", "harm", "rhythm", "score")


_CODES = "(SELECT n AS key_num, m AS mode FROM (SELECT unnest(range(1, 13)) AS n) x, (SELECT 'A' AS m UNION ALL SELECT 'B') y)"


def _codes(v) -> DataFrame:
    """The 24 keys."""
    return v.spark.range(1, 13).select(F.col("id").alias("key_num")).withColumn("mode", F.explode(F.array(F.lit("A"), F.lit("B"))))


@query("camelot_matrix", f"SELECT CAST(a.key_num AS BIGINT) AS num_a, a.mode AS mode_a, CAST(b.key_num AS BIGINT) AS num_b, b.mode AS mode_b, {key_sql('a', 'b')} AS score FROM {_CODES} a, {_CODES} b")
def camelot_matrix(v) -> DataFrame:
    a, b = (_codes(v).select(F.struct("*").alias(x)) for x in "ab")
    return a.crossJoin(b).select(F.col("a.key_num").alias("num_a"), F.col("a.mode").alias("mode_a"), F.col("b.key_num").alias("num_b"), F.col("b.mode").alias("mode_b"), key_score().alias("score"))


def _shift_sql(pairs_sql: str, carry: str) -> str:
    """Best shift by pair: rows (carry, na, ma, nb, mb) to (carry, base, shifted, n)."""
    d = "least(abs(na - t.nn), 12 - abs(na - t.nn))"
    score = f"CASE WHEN ma = mb THEN CASE {d} WHEN 0 THEN 1e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.6e0 WHEN 3 THEN 0.3e0 ELSE 0e0 END ELSE CASE {d} WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.5e0 ELSE 0e0 END END"
    # A semitone moves the wheel number by seven.
    tried = f"SELECT p.*, s.n, ((nb - 1 + 7 * s.n) % 12 + 12) % 12 + 1 AS nn FROM ({pairs_sql}) p, (SELECT unnest(range(-3, 4)) AS n) s"
    return f"""SELECT {carry}, max(CASE WHEN n = 0 THEN score END) AS base,
 first(score ORDER BY score DESC, abs(n), n) FILTER (WHERE n <> 0) AS shifted, first(n ORDER BY score DESC, abs(n), n) FILTER (WHERE n <> 0) AS n
 FROM (SELECT t.*, {score} AS score FROM ({tried}) t) GROUP BY {carry}"""


@query(
    "key_shift_matrix",
    f"""SELECT CAST(na AS BIGINT) AS num_a, ma AS mode_a, CAST(nb AS BIGINT) AS num_b, mb AS mode_b, base, CASE WHEN shifted > base THEN shifted END AS shifted, CASE WHEN shifted > base THEN CAST(n AS BIGINT) ELSE 0 END AS semitones
FROM ({_shift_sql(f"SELECT a.key_num AS na, a.mode AS ma, b.key_num AS nb, b.mode AS mb FROM {_CODES} a, {_CODES} b", "na, ma, nb, mb")}) WHERE na <> nb OR ma <> mb""",
)
def key_shift_matrix(v) -> DataFrame:
    a, b = (_codes(v).select(F.struct("*").alias(x)) for x in "ab")
    shift = best_shift(F.col("a.key_num"), F.col("a.mode"), F.col("b.key_num"), F.col("b.mode"))
    both = a.crossJoin(b).where("a <> b").withColumn("s", shift)
    return both.select(F.col("a.key_num").alias("num_a"), F.col("a.mode").alias("mode_a"), F.col("b.key_num").alias("num_b"), F.col("b.mode").alias("mode_b"), key_score().alias("base"), F.col("s.score").alias("shifted"), F.coalesce("s.n", F.lit(0).cast("long")).alias("semitones"))


@query(
    "bpm_compat_pairs",
    f"""SELECT a.track_id, count(*) AS n_tracks, count(*) FILTER (WHERE {tempo_sql("a", "b")} > 0e0) AS n_compatible, max({tempo_sql("a", "b")}) AS best, round(avg({tempo_sql("a", "b")}), 6) AS mean
FROM v_tracks a JOIN v_tracks b ON a.track_id <> b.track_id WHERE a.track_id % 20 = 0 GROUP BY a.track_id""",
)
def bpm_compat_pairs(v) -> DataFrame:
    return tempo_partners(v["tracks"].where(SOURCES), v["tracks"])


def tempo_partners(sources: DataFrame, tracks: DataFrame) -> DataFrame:
    """How many other tracks each source has, how many of a compatible tempo, the best and the mean score; by distinct tempos, a score each."""
    counts = tracks.where("track_id is not null").groupBy("bpm").agg(F.count(F.lit(1)).alias("n"))
    own = sources.groupBy("track_id", "bpm").agg(F.count(F.lit(1)).alias("m"))
    both = cells(own.select(F.struct("bpm").alias("a")).distinct(), counts.select(F.struct("*").alias("b"))).select(F.col("a.bpm").alias("bpm"), F.col("b.n").alias("n"), (F.col("a.bpm") == F.col("b.bpm")).alias("same"), tempo_score().alias("s"))
    other = lambda x: F.when(~F.col("same"), x)
    by = both.groupBy("bpm").agg(
        F.coalesce(F.sum(other(F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(other(F.when(F.col("s") > 0, F.col("n")))), F.lit(0)).alias("c"), F.max(other(F.col("s"))).alias("best"), F.coalesce(F.sum(other(F.col("n") * F.col("s"))), F.lit(0.0)).alias("total"),
        F.max(F.when(F.col("same"), F.col("n"))).alias("n_same"), F.max(F.when(F.col("same"), F.col("s"))).alias("s_same"),
    )
    rest = F.col("n_same") - F.col("m")  # of its own tempo, without itself
    rows = own.join(by, "bpm").withColumn("others", F.col("n") + rest).where("others > 0")
    return rows.select("track_id", (F.col("m") * F.col("others")).alias("n_tracks"), (F.col("m") * (F.col("c") + F.when(F.col("s_same") > 0, rest).otherwise(F.lit(0)))).alias("n_compatible"), F.greatest("best", F.when(rest > 0, F.col("s_same"))).alias("best"), F.round((F.col("total") + rest * F.col("s_same")) / F.col("others"), 6).alias("mean"))


#: Buckets of the tempo ring: an octave in eight; the widest ratio allowed, 0.12 octave, reaches the next one only.
RING = 8


def tempo_bucket(bpm):
    return F.pmod(F.floor(F.log2(bpm) * RING), F.lit(RING))


def _beatmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(F.struct("*").alias("a")).withColumn("k", F.explode(F.array(*[F.pmod(tempo_bucket(F.col("a.bpm")) + i, F.lit(RING)) for i in (-1, 0, 1)])))
    right = b.select(F.struct("*").alias("b")).withColumn("k", tempo_bucket(F.col("b.bpm")))
    return left.join(right, "k").where(beatmatchable(F.col("a.bpm"), F.col("b.bpm"))).drop("k")


def beatmatch_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Beatmatchable pairs (structs a and b), joined by equal or neighbouring buckets of tempo on the octave's ring."""
    return _beatmatched(a, b).where(F.col("a.track_id") != F.col("b.track_id"))


def classes(tracks: DataFrame, by: list[str], least: int) -> DataFrame:
    """The distinct values of ``by``, for which scores are worked out once: n (rows) and the ``least`` smallest ids with their rows (id, m)."""
    members = tracks.where("track_id is not null").groupBy(*by, "track_id").agg(F.count(F.lit(1)).alias("m"))
    firsts = members.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("track_id"))).where(F.col("i") <= least)
    ids = firsts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("track_id").alias("id"), "m"))).alias("ids"))
    return ids.join(members.groupBy(*by).agg(F.sum("m").alias("n")), by)


@query(
    "beatmatchable_pairs",
    f"""SELECT a.track_id, count(*) AS n_partners, min(b.track_id) AS first_partner, max({key_sql("a", "b")}) AS best_harm
FROM v_tracks a JOIN v_tracks b ON a.track_id <> b.track_id AND {match_sql("a", "b")} WHERE a.track_id % 20 = 0 GROUP BY a.track_id""",
)
def beatmatchable_pairs(v) -> DataFrame:
    tracks = v["tracks"].select("track_id", "bpm", "key_num", "mode")
    return beatmatch_partners(tracks.where(SOURCES), tracks)


def beatmatch_partners(sources: DataFrame, tracks: DataFrame) -> DataFrame:
    """How many beatmatchable partners each source has, the least of them and the best key score; by distinct tempo and key."""
    by = ["bpm", "key_num", "mode"]
    own = sources.groupBy("track_id", *by).agg(F.count(F.lit(1)).alias("m"))
    both = _beatmatched(own.select(*by).distinct(), classes(tracks, by, 2)).withColumn("same", F.expr(" and ".join(f"a.{c} = b.{c}" for c in by)))
    other = lambda x: F.when(~F.col("same"), x)
    found = both.select(*[F.col(f"a.{c}").alias(c) for c in by], "same", F.col("b.n").alias("n"), F.col("b.ids").alias("ids"), key_score().alias("s")).groupBy(*by).agg(
        F.coalesce(F.sum(other(F.col("n"))), F.lit(0)).alias("n"), F.min(other(F.col("ids")[0]["id"])).alias("first"), F.max(other(F.col("s"))).alias("best"),
        F.max(F.when(F.col("same"), F.col("n"))).alias("n_same"), F.max(F.when(F.col("same"), F.col("ids"))).alias("ids"), F.max(F.when(F.col("same"), F.col("s"))).alias("s_same"),
    )
    rest = F.col("n_same") - F.col("m")  # of its own class, without itself
    near = F.expr("array_min(transform(filter(ids, x -> x.id <> track_id), x -> x.id))")
    rows = own.join(found, by).withColumn("others", F.col("n") + rest).where("others > 0")
    return rows.select("track_id", (F.col("m") * F.col("others")).alias("n_partners"), F.least("first", near).alias("first_partner"), F.greatest("best", F.when(rest > 0, F.col("s_same"))).alias("best_harm"))


_COS = "CASE WHEN o.embedding IS NULL OR i.embedding IS NULL THEN NULL ELSE round(greatest(-1e0, least(1e0, list_cosine_similarity(o.embedding::DOUBLE[], i.embedding::DOUBLE[]))), 4) END"


@query(
    "cue_cosine_pairs",
    f"""SELECT cue_id, n_pairs, best_cue, best_sim FROM (SELECT o.cue_id, count(*) OVER (PARTITION BY o.cue_id) AS n_pairs, i.cue_id AS best_cue, {_COS} AS best_sim,
 row_number() OVER (PARTITION BY o.cue_id ORDER BY {_COS} DESC, i.cue_id) AS rn
 FROM v_cues o JOIN v_cues i ON o.type = 'out' AND i.type = 'in' AND o.track_id <> i.track_id WHERE o.cue_id % 20 = 0 AND o.embedding IS NOT NULL AND i.embedding IS NOT NULL) WHERE rn = 1""",
)
def cue_cosine_pairs(v) -> DataFrame:
    """For every twentieth out cue the most similar in cue of another track."""
    cues = v["cues"].where("embedding is not null")
    out = cues.where("type = 'out' and cue_id % 20 = 0").select("cue_id", "track_id", "embedding")
    return nearest_cues(out, cues.where("type = 'in'").select("cue_id", "track_id", "embedding"))


def nearest_cues(out: DataFrame, into: DataFrame) -> DataFrame:
    """The most similar row of ``into`` of another track for each row of ``out``, the least id of equals, and how many there are."""
    scored = blocked(out, into, vectors.nearest, "cue_id long, n long, c long, s double")
    best = scored.groupBy("cue_id").agg(F.sum("n").alias("n_pairs"), F.max(F.struct("s", (-F.col("c")).alias("c"))).alias("m"))
    return best.select("cue_id", "n_pairs", (-F.col("m.c")).alias("best_cue"), F.col("m.s").alias("best_sim"))


_CUEPAIR = f"CASE WHEN o.embedding IS NULL OR i.embedding IS NULL THEN 0.7e0 * ((o.confidence + i.confidence) / 2e0) + CASE WHEN o.phrase_aligned AND i.phrase_aligned THEN 0.3e0 ELSE 0e0 END ELSE 0.6e0 * ({_COS}) + 0.2e0 * ((o.confidence + i.confidence) / 2e0) + CASE WHEN o.phrase_aligned AND i.phrase_aligned THEN 0.2e0 ELSE 0e0 END END"
_BEST_PAIR = f"""SELECT src, dst, out_ts, in_ts, score, similarity FROM (SELECT o.track_id AS src, i.track_id AS dst, o.ts AS out_ts, i.ts AS in_ts, round({_CUEPAIR}, 6) AS score, {_COS} AS similarity,
 row_number() OVER (PARTITION BY o.track_id, i.track_id ORDER BY round({_CUEPAIR}, 9) DESC, o.pos, i.pos) AS rn
 FROM v_cues o JOIN v_cues i ON o.type = 'out' AND i.type = 'in' AND o.track_id <> i.track_id WHERE o.track_id % 20 = 0) WHERE rn = 1"""


@query("best_cue_pair", _BEST_PAIR)
def best_cue_pair(v) -> DataFrame:
    """Of each source and other track the out and in cue that go together best."""
    cues = v["cues"].select("track_id", "pos", "type", "ts", "phrase_aligned", "confidence", "embedding")
    return paired_cues(cues.where(f"type = 'out' and {SOURCES}"), cues.where("type = 'in'"))


def paired_cues(out: DataFrame, into: DataFrame) -> DataFrame:
    """The best pair of cues of each two tracks: by the rounded score, then the least places."""
    found = blocked(out, into, vectors.best_pairs, "src long, dst long, s double, p long, q long, out_ts double, in_ts double, similarity double, raw double")
    best = found.groupBy("src", "dst").agg(F.max(F.struct("s", (-F.col("p")).alias("p"), (-F.col("q")).alias("q"), "out_ts", "in_ts", "similarity", "raw")).alias("m"))
    return best.select("src", "dst", "m.out_ts", "m.in_ts", F.round("m.raw", 6).alias("score"), "m.similarity")


def edge_score(harmonic, rhythm, similarity):
    """Key and tempo, and where there is one the similarity of the cues."""
    return F.when(similarity.isNull(), 0.6 * harmonic + 0.4 * rhythm).otherwise(0.4 * harmonic + 0.3 * rhythm + 0.3 * F.greatest(F.lit(0.0), similarity))


_EDGES = f"""SELECT s.src, s.dst, base, shifted, n, {tempo_sql("a", "b")} AS rhythm, similarity FROM
 ({_shift_sql("SELECT a.track_id AS src, b.track_id AS dst, a.key_num AS na, a.mode AS ma, b.key_num AS nb, b.mode AS mb FROM v_tracks a JOIN v_tracks b ON a.track_id <> b.track_id WHERE a.track_id % 20 = 0", "src, dst")}) s
 JOIN v_tracks a ON s.src = a.track_id JOIN v_tracks b ON s.dst = b.track_id LEFT JOIN ({_BEST_PAIR}) c ON s.src = c.src AND s.dst = c.dst"""


@query(
    "compat_edges",
    f"""WITH e AS ({_EDGES}),
h AS (SELECT src, dst, rhythm, similarity, CASE WHEN shifted > base AND shifted - 0.03e0 * abs(n) > base THEN round(shifted - 0.03e0 * abs(n), 3) ELSE round(base, 3) END AS harmonic,
 CASE WHEN shifted > base AND shifted - 0.03e0 * abs(n) > base THEN CAST(n AS BIGINT) ELSE 0 END AS key_shift FROM e),
s AS (SELECT *, round(CASE WHEN similarity IS NULL THEN 0.6e0 * harmonic + 0.4e0 * rhythm ELSE 0.4e0 * harmonic + 0.3e0 * rhythm + 0.3e0 * greatest(0e0, similarity) END, 3) AS score FROM h)
SELECT * FROM (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS BIGINT) AS rank, dst, harmonic, round(rhythm, 3) AS rhythm, similarity, key_shift, score FROM s) WHERE rank <= 10""",
)
def compat_edges(v, top_n: int = 10) -> DataFrame:
    """The ten best edges of each source: key score, with the shift that helps if its cost leaves it better, tempo and cue similarity."""
    has = lambda kind: v["cues"].where(F.col("type") == kind).select("track_id").distinct().withColumn(f"has_{kind}", F.lit(True))
    tracks = v["tracks"].select("track_id", "bpm", "key_num", "mode").join(has("in"), "track_id", "left").withColumn("has_in", F.coalesce("has_in", F.lit(False)))
    sources = v["tracks"].where(SOURCES).select("track_id", "bpm", "key_num", "mode").join(has("out"), "track_id", "left").withColumn("has_out", F.coalesce("has_out", F.lit(False)))
    return best_edges(sources, tracks, best_cue_pair(v).select("src", "dst", "similarity"), top_n)


def best_edges(sources: DataFrame, tracks: DataFrame, sims: DataFrame, top_n: int) -> DataFrame:
    """Ranked edges of each source. Pairs with cues (has_out, has_in) are the rows of ``sims`` and scored one by one.

    Others differ by tempo and key alone: distinct ones are scored once, and of a class only its least ids can be among the best.
    """
    keys = F.broadcast(key_table(tracks.sparkSession))
    paid = F.col("shifted") - SHIFT_PENALTY * F.abs("n")
    better = F.coalesce(paid > F.col("base"), F.lit(False))

    def scored(both: DataFrame, *carry: str) -> DataFrame:
        both = both.select(*carry, tempo_score().alias("rhythm"), F.col("a.key_num").alias("na"), F.col("a.mode").alias("ma"), F.col("b.key_num").alias("nb"), F.col("b.mode").alias("mb")).join(keys, ["na", "ma", "nb", "mb"])
        rows = both.select(*[c.split(".")[-1] for c in carry], F.round(F.when(better, paid).otherwise(F.col("base")), 3).alias("harmonic"), "rhythm", F.when(better, F.col("n")).otherwise(F.lit(0).cast("long")).alias("key_shift"))
        return rows.withColumn("score", F.round(edge_score(F.col("harmonic"), F.col("rhythm"), F.col("similarity")), 3))

    own = ["bpm", "key_num", "mode", "has_out"]
    to = classes(tracks, ["bpm", "key_num", "mode", "has_in"], top_n + 1)
    alike = cells(sources.select(F.struct(*own).alias("a")).distinct(), to.select(F.struct("bpm", "key_num", "mode", "has_in").alias("b"), "ids")).where(~(F.col("a.has_out") & F.col("b.has_in")))
    rows = scored(alike.withColumn("similarity", F.lit(None).cast("double")), *[f"a.{c}" for c in own], "ids", "similarity")
    # Only scores over which fewer than top_n + 1 ids stand can hold one of the best, the source itself left out.
    by, ties = Window.partitionBy(*own).orderBy(F.desc("score")), Window.partitionBy(*own, "score")
    n = F.size("ids")
    rows = rows.withColumn("upto", F.sum(n).over(by.rangeBetween(Window.unboundedPreceding, 0))).withColumn("over", F.col("upto") - F.sum(n).over(ties)).where(F.col("over") <= top_n)
    rows = rows.select(*own, "harmonic", "rhythm", "key_shift", "similarity", "score", F.explode("ids").alias("x"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("score"), "x.id"))).where(F.col("i") <= top_n + 1)
    columns = ["src", "dst", "harmonic", "rhythm", "similarity", "key_shift", "score"]
    plain = sources.join(rows, own).where("track_id <> x.id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(top_n), F.col("x.m").cast("int"))))).select(F.col("track_id").alias("src"), F.col("x.id").alias("dst"), *columns[2:])
    cued = sims.join(sources.where("has_out").select(F.col("track_id").alias("src"), F.struct("*").alias("a")), "src").join(tracks.where("has_in").select(F.col("track_id").alias("dst"), F.struct("*").alias("b")), "dst")
    ranked = plain.unionByName(scored(cued, "src", "dst", "similarity").select(*columns)).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")).cast("long"))
    return ranked.where(F.col("rank") <= top_n).select("src", "rank", "dst", "harmonic", F.round("rhythm", 3).alias("rhythm"), "similarity", "key_shift", "score")


_TRACK_SIMS = f"""SELECT o.track_id AS a, i.track_id AS b, {_COS} AS sim FROM
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC, pos) AS rn FROM v_cues WHERE type = 'out' AND embedding IS NOT NULL) WHERE rn = 1) o JOIN
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC, pos) AS rn FROM v_cues WHERE type = 'in' AND embedding IS NOT NULL) WHERE rn = 1) i ON o.track_id <> i.track_id AND o.track_id % 20 = 0"""
#: Each unordered pair of the queries once.
_UNORDERED = f"SELECT * FROM ({_TRACK_SIMS}) u WHERE b % 20 <> 0 OR a < b"


def track_similarities(v) -> DataFrame:
    """Pairs (a, b) of a source and any other track with cue vectors: similarity of a's best out cue to b's best in cue."""
    cues = v["cues"].where("embedding is not null")
    best = cues.groupBy("track_id", "type").agg(F.max(F.struct("confidence", (-F.col("pos")).alias("p"), "embedding")).alias("m")).select("track_id", "type", F.col("m.embedding").alias("e"))
    a = best.where(f"type = 'out' and {SOURCES}").select(F.col("track_id").alias("a"), F.col("e").alias("x"))
    b = best.where("type = 'in'").select(F.col("track_id").alias("b"), F.col("e").alias("y"))
    return cells(a, b).where("a <> b").select("a", "b", cosine(F.col("x"), F.col("y")).alias("sim"))


def unordered(sims: DataFrame) -> DataFrame:
    return sims.where("b % 20 <> 0 or a < b")


@query("sim_threshold_p85", f"SELECT count(*) AS n_pairs, round(quantile_cont(sim, 0.85), 6) AS threshold FROM ({_UNORDERED})")
def sim_threshold_p85(v) -> DataFrame:
    return unordered(track_similarities(v)).agg(F.count("sim").alias("n_pairs"), F.round(F.percentile("sim", 0.85), 6).alias("threshold"))


@query("sim_percentile_rank", f"SELECT a, b, sim, round(cume_dist() OVER (ORDER BY sim), 6) AS pct FROM ({_UNORDERED}) WHERE sim IS NOT NULL")
def sim_percentile_rank(v) -> DataFrame:
    """The share of similarities at most as large, by counts of distinct values (no sort of all rows in one task)."""
    sims = unordered(track_similarities(v)).where("sim is not null")
    counts = sims.groupBy("sim").count()
    ranked = counts.select("sim", (F.sum("count").over(Window.orderBy("sim")) / F.sum("count").over(Window.partitionBy())).alias("pct"))
    return sims.join(ranked, "sim").select("a", "b", "sim", F.round("pct", 6).alias("pct"))

