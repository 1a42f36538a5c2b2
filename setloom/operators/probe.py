"""Measuring transitions: two-source decomposition in closed form, ramps, agreement of bands, accuracy of fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setloom.functions.vectors import dot
from setloom.registry import query, sql_query


def two_source_weights(aa: Column, ab: Column, bb: Column, ax: Column, bx: Column) -> tuple[Column, Column]:
    """The weights, not negative, with which two sources best add up to a third, from their dot products.

    The free solution where both of its weights are so, else the better of the sources alone.
    """
    det = aa * bb - ab * ab
    free_a, free_b = (bb * ax - ab * bx) / det, (aa * bx - ab * ax) / det
    ok = (det > 1e-12) & (free_a >= 0) & (free_b >= 0)
    alone_a = F.when(aa > 0, F.greatest(F.lit(0.0), ax / aa)).otherwise(0.0)
    alone_b = F.when(bb > 0, F.greatest(F.lit(0.0), bx / bb)).otherwise(0.0)
    a_wins = alone_a * (2 * ax - alone_a * aa) >= alone_b * (2 * bx - alone_b * bb)
    return F.when(ok, free_a).when(a_wins, alone_a).otherwise(0.0), F.when(ok, free_b).when(a_wins, 0.0).otherwise(alone_b)


@query(
    "nnls_unmix",
    """WITH d AS (SELECT x.vec_id, list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS aa, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS ab, list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS bb,
 list_dot_product(a.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS ax, list_dot_product(b.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS bx, list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS xx FROM embeddings x JOIN embeddings a ON a.vec_id = x.vec_id + 1 JOIN embeddings b ON b.vec_id = x.vec_id + 2),
s AS (SELECT *, aa * bb - ab * ab AS det, CASE WHEN aa > 0 THEN greatest(0e0, ax / aa) ELSE 0e0 END AS oa, CASE WHEN bb > 0 THEN greatest(0e0, bx / bb) ELSE 0e0 END AS ob FROM d),
r AS (SELECT *, det > 1e-12 AND (bb * ax - ab * bx) / det >= 0e0 AND (aa * bx - ab * ax) / det >= 0e0 AS ok, oa * (2e0 * ax - oa * aa) >= ob * (2e0 * bx - ob * bb) AS a_wins FROM s)
SELECT CAST(vec_id AS BIGINT) AS vec_id, round(wa, 5) AS weight_a, round(wb, 5) AS weight_b, round(sqrt(greatest(0e0, xx - 2e0 * (wa * ax + wb * bx) + wa * wa * aa + 2e0 * wa * wb * ab + wb * wb * bb) / greatest(xx, 1e-12)), 4) AS residual
FROM (SELECT *, CASE WHEN ok THEN (bb * ax - ab * bx) / det WHEN a_wins THEN oa ELSE 0e0 END AS wa, CASE WHEN ok THEN (aa * bx - ab * ax) / det WHEN a_wins THEN 0e0 ELSE ob END AS wb FROM r) w""",
)
def nnls_unmix(v) -> DataFrame:
    """Each vector as a sum of the next two, and what that leaves."""
    e = v.table("embeddings").select("vec_id", "embedding")
    shifted = lambda n, name: e.select((F.col("vec_id") - n).alias("vec_id"), F.col("embedding").alias(name))
    both = e.join(shifted(1, "a"), "vec_id").join(shifted(2, "b"), "vec_id")
    a, b, x = F.col("a"), F.col("b"), F.col("embedding")
    d = both.select(F.col("vec_id").cast("long").alias("vec_id"), dot(a, a).alias("aa"), dot(a, b).alias("ab"), dot(b, b).alias("bb"), dot(a, x).alias("ax"), dot(b, x).alias("bx"), dot(x, x).alias("xx"))
    wa, wb = two_source_weights(*[F.col(c) for c in ("aa", "ab", "bb", "ax", "bx")])
    d = d.withColumn("wa", wa).withColumn("wb", wb)
    return d.select("vec_id", F.round("wa", 5).alias("weight_a"), F.round("wb", 5).alias("weight_b"), F.round(residual(), 4).alias("residual"))


def residual() -> Column:
    """What the weighted sources leave of the third, as a share of its length."""
    c = F.col
    left = c("xx") - 2 * (c("wa") * c("ax") + c("wb") * c("bx")) + c("wa") * c("wa") * c("aa") + 2 * c("wa") * c("wb") * c("ab") + c("wb") * c("wb") * c("bb")
    return F.sqrt(F.greatest(F.lit(0.0), left) / F.greatest(c("xx"), F.lit(1e-12)))


#: The gates of a band and of a transition.
MAX_RHO, MIN_TRAVEL, MIN_R2, MAX_RESIDUAL, MAX_EXCESS, AGREE_MAD, CUT_BEATS, MAX_BEATS = 0.92, 0.30, 0.50, 0.95, 0.18, 3.0, 4.0, 256.0


def band_reason() -> Column:
    """The first gate that a band's fit fails, or the empty text: rho, centre, span, travel, r2, residual, floor, lo and hi are its row's."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return (
        F.when(F.col("rho") > MAX_RHO, "low_separability")
        .when(~(finite("centre") & finite("span")), "fit_failed")
        .when(~F.col("centre").between(F.col("lo"), F.col("hi")), "center_out_of_window")
        .when(F.col("travel") < MIN_TRAVEL, "low_travel")
        .when(F.col("r2") < MIN_R2, "poor_fit")
        .when((F.col("residual") > MAX_RESIDUAL) | (F.col("residual") - F.col("floor") > MAX_EXCESS), "high_residual")
        .otherwise("")
    )


#: What a transition without a band is refused for: the most telling of its bands' reasons.
REFUSALS = ("low_separability", "low_travel", "center_out_of_window", "poor_fit", "high_residual", "fit_failed")


def combine_bands(bands: DataFrame) -> DataFrame:
    """A row a transition from rows (id, band, beat, purity and what ``band_reason`` reads), band one of low, mid and high.

    Bands agree whose centres lie within three median deviations of the median, two fifths of the median length or two
    beats, whichever is most. Two have to, one of them mid or high. The best of these by r2 * travel gives centre and
    length; a length under four beats is a cut. Confidence is the geometric mean of seven scores, each 0.05 at least.
    """
    w = Window.partitionBy("id")
    long = F.col("band").isin("mid", "high")
    rows = bands.withColumn("reason", band_reason()).withColumn("ok", F.col("reason") == "")
    rows = rows.withColumn("mid", F.percentile(F.when(F.col("ok"), F.col("centre")), 0.5).over(w)).withColumn("dev", F.when(F.col("ok"), F.abs(F.col("centre") - F.col("mid"))))
    spans = F.coalesce(F.percentile(F.when(F.col("ok") & long, F.col("span")), 0.5).over(w), F.percentile(F.when(F.col("ok"), F.col("span")), 0.5).over(w), F.lit(0.0))
    rows = rows.withColumn("mad", F.percentile("dev", 0.5).over(w)).withColumn("tol", F.greatest(AGREE_MAD * F.col("mad"), 0.4 * spans, 2.0 * F.col("beat")))
    rows = rows.withColumn("agrees", F.col("ok") & (F.col("dev") <= F.col("tol"))).withColumn("lasts", F.col("agrees") & long)
    of = lambda cond, x: F.when(F.col(cond), x)
    named = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REFUSALS]
    t = rows.groupBy("id").agg(
        F.count_if("ok").alias("n_ok"), F.count_if("agrees").alias("n_agreed"), F.count_if("lasts").alias("n_long"), F.max("beat").alias("beat"), F.max("purity").alias("purity"), F.max("mad").alias("mad"), F.max("tol").alias("tol"),
        F.max(of("lasts", F.struct((F.col("r2") * F.greatest("travel", F.lit(0.0))).alias("q"), "band", "centre", "span"))).alias("best"), F.max(of("agrees", F.when(F.col("band") == "low", F.col("centre")))).alias("t_bass"),
        F.min(of("lasts", F.col("span"))).alias("short"), F.max(of("lasts", F.col("span"))).alias("longest"), F.max(of("agrees", F.col("rho"))).alias("rho"), F.avg(of("agrees", F.col("r2"))).alias("fit"), F.avg(of("agrees", F.col("travel"))).alias("travel"), F.avg(of("agrees", F.col("residual"))).alias("residual"), *named,
    )
    beats = F.col("best.span") / F.col("beat")
    cut = beats < CUT_BEATS
    span = F.when(cut, 0.0).otherwise(F.col("best.span"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    scores = [unit(1.0 - F.col("rho")), F.col("fit"), unit(F.col("travel")), unit(1.0 - F.col("residual")), F.when((F.col("n_ok") > 1) & (F.col("tol") > 0), unit(1.0 - F.col("mad") / F.col("tol"))).otherwise(0.5), F.when((F.col("n_long") > 1) & (F.col("longest") > 0), unit(F.col("short") / F.col("longest"))).otherwise(0.6), F.col("purity")]
    confidence = F.exp(sum((F.log(F.greatest(x, F.lit(0.05))) for x in scores), F.lit(0.0)) / len(scores))
    refused = F.coalesce(*[F.when(F.col(f"n_{r}") > 0, F.lit(r)) for r in REFUSALS], F.lit("no_band_fit"))
    reason = F.when(F.col("n_ok") == 0, refused).when(F.col("n_long") == 0, "no_duration_band").when(F.col("n_agreed") < 2, "insufficient_band_agreement").when(~cut & (beats > MAX_BEATS), "implausible_duration").otherwise("")
    kept = lambda x, digits=3: F.when(reason == "", F.round(x, digits))
    centre = F.col("best.centre")
    return t.select("id", reason.alias("reason"), "n_agreed", kept(centre - span / 2).alias("t_start"), kept(centre + span / 2).alias("t_end"), kept(F.col("t_bass")).alias("t_bass"), kept(span / F.col("beat")).alias("beats"), F.when(reason == "", cut.cast("int")).alias("is_cut"), kept(confidence, 4).alias("confidence"))


_BANDS = """SELECT 1000 * mix_id + idx AS id, band, 0.5e0 AS beat, CAST(k * 7 % 101 AS DOUBLE) / 100e0 AS purity, CAST((k * 13 + j * 31) % 97 AS DOUBLE) / 100e0 AS rho, CASE WHEN (k + j) % 23 = 0 THEN NULL ELSE announced_t + CAST((k * 3 + j * j * 5) % 41 AS DOUBLE) / 10e0 END AS centre,
 CAST((k * 11 + j * 17) % 400 AS DOUBLE) / 10e0 AS span, CAST((k * 19 + j * 7) % 130 AS DOUBLE) / 100e0 AS travel, CAST((k * 29 + j * 3) % 120 AS DOUBLE) / 120e0 AS r2, CAST((k * 5 + j * 41) % 100 AS DOUBLE) / 100e0 AS residual, 0.3e0 + 0.1e0 * j AS floor, announced_t - 1e0 AS lo, announced_t + 4e0 AS hi
FROM v_transitions, (SELECT 0 AS j, 'low' AS band UNION ALL SELECT 1 AS j, 'mid' AS band UNION ALL SELECT 2 AS j, 'high' AS band) b"""
_GUARDED = f"""SELECT *, CASE WHEN rho > 0.92e0 THEN 'low_separability' WHEN centre IS NULL OR span IS NULL THEN 'fit_failed' WHEN centre < lo OR centre > hi THEN 'center_out_of_window' WHEN travel < 0.3e0 THEN 'low_travel' WHEN r2 < 0.5e0 THEN 'poor_fit' WHEN residual > 0.95e0 OR residual - floor > 0.18e0 THEN 'high_residual' ELSE '' END AS reason FROM ({_BANDS}) b0"""
_FAILED = "CASE " + " ".join(f"WHEN count(*) FILTER (WHERE reason = '{r}') > 0 THEN '{r}'" for r in REFUSALS) + " ELSE 'no_band_fit' END"
_COMBINED = f"""WITH g AS ({_GUARDED}), m AS (SELECT id, quantile_cont(centre, 0.5) FILTER (WHERE reason = '') AS med, coalesce(quantile_cont(span, 0.5) FILTER (WHERE reason = '' AND band <> 'low'), quantile_cont(span, 0.5) FILTER (WHERE reason = ''), 0e0) AS spans FROM g GROUP BY id),
d AS (SELECT g.*, abs(centre - med) AS dev, spans FROM g JOIN m ON g.id = m.id), a AS (SELECT id, quantile_cont(dev, 0.5) FILTER (WHERE reason = '') AS mad FROM d GROUP BY id),
t AS (SELECT d.*, mad, greatest(3e0 * mad, 0.4e0 * spans, 2e0 * beat) AS tol FROM d JOIN a ON d.id = a.id), f AS (SELECT *, reason = '' AND dev <= tol AS agrees, reason = '' AND dev <= tol AND band <> 'low' AS lasts FROM t),
c AS (SELECT id, count(*) FILTER (WHERE reason = '') AS n_ok, count(*) FILTER (WHERE agrees) AS n_agreed, count(*) FILTER (WHERE lasts) AS n_long, max(beat) AS beat, max(purity) AS purity, max(mad) AS mad, max(tol) AS tol, last(centre ORDER BY r2 * greatest(travel, 0e0), band) FILTER (WHERE lasts) AS centre, last(span ORDER BY r2 * greatest(travel, 0e0), band) FILTER (WHERE lasts) AS best_span,
 max(centre) FILTER (WHERE agrees AND band = 'low') AS t_bass, min(span) FILTER (WHERE lasts) AS short, max(span) FILTER (WHERE lasts) AS longest, max(rho) FILTER (WHERE agrees) AS rho, avg(r2) FILTER (WHERE agrees) AS fit, avg(travel) FILTER (WHERE agrees) AS travel, avg(residual) FILTER (WHERE agrees) AS residual, {_FAILED} AS failed FROM f GROUP BY id),
s AS (SELECT *, best_span / beat < 4e0 AS cut, CASE WHEN best_span / beat < 4e0 THEN 0e0 ELSE best_span END AS span, CASE WHEN n_ok = 0 THEN failed WHEN n_long = 0 THEN 'no_duration_band' WHEN n_agreed < 2 THEN 'insufficient_band_agreement' WHEN best_span / beat >= 4e0 AND best_span / beat > 256e0 THEN 'implausible_duration' ELSE '' END AS reason,
 exp((ln(greatest(0.05e0, least(1e0, 1e0 - rho))) + ln(greatest(0.05e0, fit)) + ln(greatest(0.05e0, least(1e0, travel))) + ln(greatest(0.05e0, least(1e0, 1e0 - residual))) + ln(greatest(0.05e0, CASE WHEN n_ok > 1 AND tol > 0 THEN least(1e0, 1e0 - mad / tol) ELSE 0.5e0 END)) + ln(greatest(0.05e0, CASE WHEN n_long > 1 AND longest > 0 THEN least(1e0, short / longest) ELSE 0.6e0 END)) + ln(greatest(0.05e0, purity))) / 7e0) AS confidence FROM c)
SELECT id, reason, n_agreed, CASE WHEN reason = '' THEN round(centre - span / 2, 3) END AS t_start, CASE WHEN reason = '' THEN round(centre + span / 2, 3) END AS t_end, CASE WHEN reason = '' THEN round(t_bass, 3) END AS t_bass, CASE WHEN reason = '' THEN round(span / beat, 3) END AS beats, CASE WHEN reason = '' THEN CAST(cut AS INTEGER) END AS is_cut, CASE WHEN reason = '' THEN round(confidence, 4) END AS confidence FROM s"""


@query("band_combine", _COMBINED)
def band_combine(v) -> DataFrame:
    """Three bands for every transition, joined to one measurement or one refusal."""
    return combine_bands(v.sql(_BANDS))


_MINED = f"""SELECT t.mix_id, t.idx, CASE WHEN c.reason = '' THEN 'ok' ELSE 'rejected' END AS status, nullif(c.reason, '') AS reject_reason, c.t_start, c.t_end, round(c.beats / 4e0, 3) AS bars, c.is_cut, c.confidence,
 lead(t.announced_t) OVER (PARTITION BY t.mix_id ORDER BY t.idx) - t.announced_t AS dwell, t.announced_t - max(CASE WHEN c.reason = '' THEN c.t_end END) OVER (PARTITION BY t.mix_id ORDER BY t.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solo FROM v_transitions t JOIN ({_COMBINED}) c ON c.id = 1000 * t.mix_id + t.idx"""


def mine(announced: DataFrame, bands: DataFrame) -> DataFrame:
    """A row a boundary of rows (id, mix_id, idx, announced_t) and their bands: measured or refused, refused ones kept, with the time to the next and since the last measured one's end."""
    w = Window.partitionBy("mix_id").orderBy("idx")
    rows = announced.join(combine_bands(bands), "id")
    ok = F.col("reason") == ""
    last = F.max(F.when(ok, F.col("t_end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("mix_id", "idx", F.when(ok, "ok").otherwise("rejected").alias("status"), F.nullif("reason", F.lit("")).alias("reject_reason"), "t_start", "t_end", F.round(F.col("beats") / 4, 3).alias("bars"), "is_cut", "confidence", (F.lead("announced_t").over(w) - F.col("announced_t")).alias("dwell"), (F.col("announced_t") - last).alias("solo"))


@query("mined_transitions", _MINED)
def mined_transitions(v) -> DataFrame:
    announced = v["transitions"].select((1000 * F.col("mix_id") + F.col("idx")).alias("id"), "mix_id", "idx", "announced_t")
    return mine(announced, v.sql(_BANDS))


@query("band_guards", f"SELECT band, reason, count(*) AS n FROM ({_GUARDED}) g GROUP BY band, reason")
def band_guards(v) -> DataFrame:
    return v.sql(_BANDS).groupBy("band", band_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


sql_query("weighted_mean_energy", "SELECT track_id, round(CASE WHEN sum(energy) > 0e0 THEN sum(value * energy) / sum(energy) ELSE avg(value) END, 6) AS level FROM v_energy GROUP BY track_id")


def fit_ramp(pdf: pd.DataFrame) -> pd.DataFrame:
    """A weighted logistic ramp y = 1 / (1 + exp(-(t - centre) / width)) by a grid and Gauss-Newton steps; one row."""
    t, y = pdf["t"].to_numpy(float), pdf["y"].to_numpy(float)
    w = pdf["w"].to_numpy(float) if "w" in pdf else np.ones(len(t))
    out = {"id": pdf["id"].iloc[0], "centre": np.nan, "width": np.nan, "r2": np.nan}
    if len(t) >= 4 and np.ptp(t) > 0:
        span = float(np.ptp(t))
        model = lambda c, s: 1 / (1 + np.exp(-np.clip((t - c) / s, -40, 40)))
        loss = lambda c, s: float((w * (model(c, s) - y) ** 2).sum())
        cs, ss = (x.reshape(-1, 1) for x in np.meshgrid(np.linspace(t.min(), t.max(), 21), span * np.array([0.01, 0.03, 0.1, 0.3]), indexing="ij"))
        first = int((w * (model(cs, ss) - y) ** 2).sum(1).argmin())
        c, s = float(cs[first, 0]), float(ss[first, 0])
        for _ in range(30):
            m = model(c, s)
            slope = m * (1 - m)
            j = np.stack([-slope / s, -slope * (t - c) / s**2], 1)
            h = (j * w[:, None]).T @ j + 1e-9 * np.eye(2)
            d = np.linalg.solve(h, (j * w[:, None]).T @ (y - m))
            n = (float(np.clip(c + d[0], t.min(), t.max())), float(np.clip(s + d[1], span * 1e-3, span)))
            if loss(*n) >= loss(c, s):
                break
            c, s = n
        total = float((w * (y - np.average(y, weights=w)) ** 2).sum())
        out |= {"centre": c, "width": s, "r2": 1 - loss(c, s) / total if total > 0 else np.nan}
    return pd.DataFrame([out])


def fit_ramps(rows: DataFrame) -> DataFrame:
    """(id, centre, width, r2) of each id's ramp over rows (id, t, y and maybe w); an id's rows are one short series."""
    return rows.groupBy("id").applyInPandas(fit_ramp, "id long, centre double, width double, r2 double")


@query("ramp_fits")
def ramp_fits(v) -> DataFrame:
    """Ramps of the running energy share of every track."""
    w = Window.partitionBy("track_id")
    share = F.sum("energy").over(w.orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)) / (F.sum("energy").over(w) + 1e-12)
    return fit_ramps(v["energy"].select(F.col("track_id").alias("id"), F.col("sec").cast("double").alias("t"), share.alias("y")))
