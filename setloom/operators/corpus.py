"""Statistics of mined transitions: filters, counts, distributions, histograms, calibrated constants, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.operators.ordered import positions
from setloom.registry import query, sql_query

#: The edges of the phrase histogram, and the fewest rows a mined constant may stand on.
PHRASE_EDGES = (2, 4, 8, 12, 16, 24, 32, 48, 64)
MIN_N = 20
QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def transitions(v, status: str | None = "ok", min_confidence: float | None = None) -> DataFrame:
    """The transitions of a status (none: any) with at least a confidence (none: any; a null confidence never has it)."""
    out = v["transitions"]
    if status is not None:
        out = out.where(F.col("status") == status)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    return out


@query("transitions_filtered", "SELECT mix_id, idx, status, confidence, is_cut, duration_bars FROM v_transitions WHERE status = 'ok' AND confidence >= 0.5e0")
def transitions_filtered(v) -> DataFrame:
    return transitions(v, "ok", 0.5).select("mix_id", "idx", "status", "confidence", "is_cut", "duration_bars")


@query("corpus_counts", "SELECT count(DISTINCT mix_id) AS n_mixes, count(*) AS n_transitions, count(*) FILTER (WHERE status = 'ok') AS n_accepted, round(count(*) FILTER (WHERE status = 'ok') / CAST(count(*) AS DOUBLE), 6) AS accept_rate FROM v_transitions")
def corpus_counts(v) -> DataFrame:
    ok = F.count_if(F.col("status") == "ok")
    return v["transitions"].agg(F.count_distinct("mix_id").alias("n_mixes"), F.count(F.lit(1)).alias("n_transitions"), ok.alias("n_accepted"), F.round(F.try_divide(ok.cast("double"), F.count(F.lit(1))), 6).alias("accept_rate"))


@query("reject_reasons", "SELECT coalesce(reject_reason, 'unknown') AS reason, count(*) AS n FROM v_transitions WHERE status = 'rejected' GROUP BY 1")
def reject_reasons(v) -> DataFrame:
    return transitions(v, "rejected").groupBy(F.coalesce("reject_reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def distribution(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean and the five quantiles of the finite, known values."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    q = F.percentile(value, F.array(*[F.lit(x) for x in QUANTILES]))
    out = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"), q.alias("q"))
    return out.select(*by, "n", "mean", *[F.round(F.col("q")[i], 4).alias(f"p{int(100 * x)}") for i, x in enumerate(QUANTILES)])


_DIST = "count({x}) AS n, round(avg({x}), 4) AS mean, " + ", ".join(f"round(quantile_cont({{x}}, {q}), 4) AS p{int(100 * q)}" for q in QUANTILES)
_WITH_DWELL = """(SELECT *, lead(announced_t) OVER (PARTITION BY mix_id ORDER BY idx) - announced_t AS dwell FROM v_transitions)"""


def dwelling(v) -> DataFrame:
    """Transitions with the announced time until the mix's next one."""
    from pyspark.sql import Window

    return v["transitions"].withColumn("dwell", F.lead("announced_t").over(Window.partitionBy("mix_id").orderBy("idx")) - F.col("announced_t"))


@query(
    "corpus_distributions",
    " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {_DIST.format(x=col)} FROM {_WITH_DWELL} t WHERE status = 'ok'{cond}"
        for name, col, cond in (("duration_bars", "duration_bars", " AND confidence >= 0.2e0 AND is_cut = 0"), ("dwell", "dwell", " AND confidence >= 0.2e0"), ("camelot_score", "camelot_score", " AND confidence >= 0.2e0"), ("confidence", "confidence", ""))
    ),
)
def corpus_distributions(v) -> DataFrame:
    """Durations of blends, dwell and key score of the confident rows, confidence of all accepted ones, in one pass."""
    rows = dwelling(v).where("status = 'ok'")
    sure = F.col("confidence") >= 0.2
    values = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.when(cond, F.col(col)).alias("x"))
            for name, col, cond in (("duration_bars", "duration_bars", sure & (F.coalesce("is_cut", F.lit(0)) == 0)), ("dwell", "dwell", sure), ("camelot_score", "camelot_score", sure), ("confidence", "confidence", F.lit(True)))
        ]
    )
    return distribution(rows.select(F.explode(values).alias("v")).select("v.metric", "v.x"), "x", "metric")


@query("corpus_by_genre", f"SELECT lower(trim(genre)) AS genre, {_DIST.format(x='duration_bars')} FROM v_transitions WHERE status = 'ok' AND confidence >= 0.2e0 AND is_cut = 0 AND trim(coalesce(genre, '')) <> '' AND duration_bars IS NOT NULL GROUP BY 1")
def corpus_by_genre(v) -> DataFrame:
    blends = transitions(v, "ok", 0.2).where("coalesce(is_cut, 0) = 0 and trim(coalesce(genre, '')) <> ''")
    return distribution(blends.withColumn("genre", F.lower(F.trim("genre"))), "duration_bars", "genre")


_EDGES = f"(SELECT unnest([{', '.join(map(str, PHRASE_EDGES))}]) AS edge)"


@query(
    "phrase_histogram",
    f"""WITH b AS (SELECT k, duration_bars AS x FROM v_transitions WHERE status = 'ok' AND is_cut = 0 AND duration_bars > 0e0),
n AS (SELECT k, (SELECT e.edge FROM {_EDGES} e ORDER BY abs(e.edge - x), e.edge LIMIT 1) AS edge FROM b)
SELECT CAST(e.edge AS BIGINT) AS edge, count(n.k) AS n FROM {_EDGES} e LEFT JOIN n ON n.edge = e.edge GROUP BY e.edge""",
)
def phrase_histogram(v) -> DataFrame:
    """Blends by the nearest phrase length, the shorter on ties; empty lengths count 0."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("duration_bars") - e).alias("d"), F.lit(e).cast("long").alias("edge")) for e in PHRASE_EDGES]))["edge"]
    counts = transitions(v, "ok").where("coalesce(is_cut, 0) = 0 and duration_bars > 0").groupBy(near.alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    edges = v.spark.createDataFrame([(e,) for e in PHRASE_EDGES], "edge long")
    return edges.join(counts, "edge", "left").select("edge", F.coalesce("n", F.lit(0)).alias("n"))


#: Constant, metric, quantile. Fixed values.
RULES = (("blend_bars", "duration_bars", "p75"), ("fade_bars", "duration_bars", "p50"), ("build_bars", "duration_bars", "p25"), ("swap_bars", "duration_bars", "p25"), ("min_dwell", "dwell", "p10"), ("max_dwell", "dwell", "p90"), ("harmonic_min_score", "camelot_score", "p10"))
DEFAULTS = {"blend_bars": 16.0, "fade_bars": 12.0, "build_bars": 8.0, "swap_bars": 8.0, "min_dwell": 32.0, "max_dwell": 96.0, "harmonic_min_score": 0.3}
_DISTRIBUTIONS = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, {_DIST.format(x=name)} FROM {_WITH_DWELL} t WHERE status = 'ok' AND confidence >= 0.2e0{cond}" for name, cond in (("duration_bars", " AND is_cut = 0"), ("dwell", ""), ("camelot_score", ""))
)


@query(
    "calibration_values",
    f"""WITH d AS ({_DISTRIBUTIONS}), r(name, metric, q, fallback) AS (VALUES {", ".join(f"('{n}', '{m}', '{q}', CAST({DEFAULTS[n]} AS DOUBLE))" for n, m, q in RULES)})
SELECT r.name, CASE WHEN d.n >= {MIN_N} THEN CASE r.q WHEN 'p10' THEN p10 WHEN 'p25' THEN p25 WHEN 'p50' THEN p50 WHEN 'p75' THEN p75 ELSE p90 END ELSE r.fallback END AS value, d.n,
 CASE WHEN d.n >= {MIN_N} THEN r.q ELSE 'default' END AS source, p10 AS low, p90 AS high FROM r LEFT JOIN d ON d.metric = r.metric""",
)
def calibration_values(v) -> DataFrame:
    """Each constant from its quantile, or its default where fewer than ``MIN_N`` rows speak for it."""
    rules = v.spark.createDataFrame([(n, m, q, DEFAULTS[n]) for n, m, q in RULES], "name string, metric string, q string, fallback double")
    both = rules.join(corpus_distributions(v), "metric", "left")
    enough = F.col("n") >= MIN_N
    mined = F.coalesce(*[F.when(F.col("q") == q, F.col(q)) for q in ("p10", "p25", "p50", "p75", "p90")])
    return both.select("name", F.when(enough, mined).otherwise(F.col("fallback")).alias("value"), "n", F.when(enough, F.col("q")).otherwise(F.lit("default")).alias("source"), F.col("p10").alias("low"), F.col("p90").alias("high"))


sql_query(
    "hit_rates",
    # A measured length against a true one; both are made from the same row here.
    """SELECT set_name, count(*) AS n, round(avg(CASE WHEN err <= 1e0 THEN 1e0 ELSE 0e0 END), 6) AS within_1, round(avg(CASE WHEN err <= 4e0 THEN 1e0 ELSE 0e0 END), 6) AS within_4,
 round(avg(CASE WHEN err <= 8e0 THEN 1e0 ELSE 0e0 END), 6) AS within_8, round(percentile(err, 0.5), 6) AS median_error
FROM (SELECT s.set_name, abs(measured - truth) AS err FROM (SELECT 4e0*duration_bars AS truth, 4e0*duration_bars + CAST(k % 23 AS DOUBLE) - 11e0 AS measured FROM v_transitions WHERE status = 'ok' AND duration_bars IS NOT NULL) t
 JOIN (SELECT 'all' AS set_name UNION ALL SELECT 'blends' AS set_name) s ON s.set_name = 'all' OR truth > 4e0) x GROUP BY set_name""",
    """SELECT set_name, count(*) AS n, round(avg(CASE WHEN err <= 1e0 THEN 1e0 ELSE 0e0 END), 6) AS within_1, round(avg(CASE WHEN err <= 4e0 THEN 1e0 ELSE 0e0 END), 6) AS within_4,
 round(avg(CASE WHEN err <= 8e0 THEN 1e0 ELSE 0e0 END), 6) AS within_8, round(quantile_cont(err, 0.5), 6) AS median_error
FROM (SELECT s.set_name, abs(measured - truth) AS err FROM (SELECT 4e0*duration_bars AS truth, 4e0*duration_bars + CAST(k % 23 AS DOUBLE) - 11e0 AS measured FROM v_transitions WHERE status = 'ok' AND duration_bars IS NOT NULL) t
 JOIN (SELECT 'all' AS set_name UNION ALL SELECT 'blends' AS set_name) s ON s.set_name = 'all' OR truth > 4e0) x GROUP BY set_name""",
)


@query(
    "wasserstein",
    """WITH s AS (SELECT is_cut AS side, confidence AS x FROM v_transitions WHERE status = 'ok'), t AS (SELECT CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS nb FROM s),
g AS (SELECT x, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM s GROUP BY x),
c AS (SELECT x, sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, lead(x) OVER (ORDER BY x) - x AS w FROM g)
SELECT round(sum(abs(ca / na - cb / nb) * w), 6) AS distance FROM c, t""",
)
def wasserstein(v) -> DataFrame:
    """Earth mover's distance between the confidences of blends and cuts: the area between their distributions.

    Rows are counted by value first; only the distinct values meet in one window.
    """
    from pyspark.sql import Window

    counts = transitions(v, "ok").groupBy(F.col("confidence").alias("x")).agg(F.count_if(F.col("is_cut") == 0).alias("a"), F.count_if(F.col("is_cut") == 1).alias("b"))
    w, every = Window.orderBy("x"), Window.partitionBy()
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(every) - F.sum("b").over(w) / F.sum("b").over(every)) * (F.lead("x").over(w) - F.col("x"))
    return counts.select(gap.alias("g")).agg(F.round(F.sum("g"), 6).alias("distance"))


@query(
    "holdout_split",
    """SELECT mix_id, CASE WHEN n > 1 AND r <= greatest(1, CAST(round(n * 0.2e0) AS BIGINT)) THEN 'test' ELSE 'train' END AS side FROM (
 SELECT mix_id, row_number() OVER (ORDER BY md5(CAST(mix_id AS VARCHAR(20))), mix_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT mix_id FROM v_transitions) m) x""",
)
def holdout_split(v, share: float = 0.2) -> DataFrame:
    """Whole mixes go to one side: the fifth with the least hashes, at least one unless there is a single mix."""
    digest = F.md5(F.col("mix_id").cast("string").cast("binary"))
    mixes = v["transitions"].select("mix_id").distinct().withColumn("digest", digest).withColumn("key", F.conv(F.substring("digest", 1, 12), 16, 10).cast("long"))
    n = mixes.count()
    tested = max(1, round(n * share)) if n > 1 else 0
    return positions(mixes, "key", ["digest", "mix_id"]).select("mix_id", F.when(F.col("at") < tested, "test").otherwise("train").alias("side"))


sql_query(
    "dwell_solo",
    # Time to the next announcement, and from the last accepted one.
    """SELECT mix_id, idx, lead(announced_t) OVER (PARTITION BY mix_id ORDER BY idx) - announced_t AS dwell,
 announced_t - max(CASE WHEN status = 'ok' THEN announced_t END) OVER (PARTITION BY mix_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solo FROM v_transitions""",
)

#: Fixed values of the reference windows, in seconds.
BACK, FORWARD, LONG, GUARD, SHORT = 60, 25, 35, 6, 15

_NEAR = f"""SELECT mix_id, idx, t, nxt, greatest(prev + {GUARD}, 0e0) AS lo_a, t - {BACK + GUARD} AS hi_a, t + {FORWARD + GUARD} AS lo_b, least(nxt - {GUARD}, duration) AS hi_b FROM (
 SELECT mix_id, idx, announced_t AS t, coalesce(lag(announced_t) OVER w, 0e0) AS prev, max(announced_t) OVER (PARTITION BY mix_id) + 300e0 AS duration, coalesce(lead(announced_t) OVER w, max(announced_t) OVER (PARTITION BY mix_id) + 300e0) AS nxt
 FROM v_transitions WINDOW w AS (PARTITION BY mix_id ORDER BY idx)) n"""
_WINDOWS = f"""SELECT mix_id, idx, CASE WHEN hi - lo >= {SHORT} THEN greatest(lo, hi - {LONG}) END AS a_start, CASE WHEN hi - lo >= {SHORT} THEN hi END AS a_end,
 CASE WHEN hi_b - lo2 >= {SHORT} THEN lo2 END AS b_start, CASE WHEN hi_b - lo2 >= {SHORT} THEN least(hi_b, lo2 + {LONG}) END AS b_end FROM (
 SELECT *, lo_a AS lo, CASE WHEN hi_a - lo_a < {SHORT} THEN greatest(t - {GUARD}, lo_a) ELSE hi_a END AS hi,
  CASE WHEN hi_b - lo_b < {SHORT} THEN least(t + {GUARD}, greatest(hi_b - {SHORT}, 0e0)) ELSE lo_b END AS lo2 FROM ({_NEAR}) m) x"""
sql_query("reference_windows", _WINDOWS)
