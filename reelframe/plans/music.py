"""Queries over music cutting.  Embeddings stand for beat features: 128 beats a track, a beat every half second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import beats as beat_ops
from ..operators import music as ops
from ..sources.views import ONSETS_SQL, onsets, read
from .registry import query

BAR, REMOVE, TARGET = 2.0, 16.0, 40.0

_F = "WITH feats AS (SELECT CAST(vec_id // 128 AS BIGINT) AS track, CAST(vec_id % 128 AS BIGINT) AS i, (vec_id % 128) * 0.5::DOUBLE AS t, embedding::DOUBLE[] AS feat, (vec_id * 37 % 101) / 101.0::DOUBLE AS strength FROM embeddings)"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_BARS = _F + """, wins AS (SELECT *, flatten(list(feat) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS bef, flatten(list(feat) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS aft FROM feats),
    bars AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS k FROM wins WHERE i % 4 = 0)"""


def _cos_sql(p: str, q: str) -> str:
    n = f"least(len({p}), len({q}))"
    a, b = f"{p}[1:{n}]", f"{q}[1:{n}]"
    return f"(CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {_COS.format(a, b)} END)"


_PAIRS = _BARS + f""", pairs AS (SELECT x.track, x.k AS ka, y.k AS kb, x.i AS a, y.i AS b, y.t - x.t AS removed, {_cos_sql("coalesce(x.bef, [])", "coalesce(y.bef, [])")} AS p, {_cos_sql("x.aft", "y.aft")} AS q FROM bars x JOIN bars y ON x.track = y.track AND y.i > x.i),
    scored AS (SELECT *, CASE WHEN p <> 0 AND q <> 0 THEN (p + q) / 2 ELSE p + q END AS sim, CASE WHEN ka % 8 = 0 AND kb % 8 = 0 THEN 0.10::DOUBLE WHEN ka % 4 = 0 AND kb % 4 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM pairs),
    tiered AS (SELECT *, CASE WHEN abs(removed - 16.0) <= 2.0 THEN 1 ELSE 2 END AS tier FROM scored WHERE abs(removed - 16.0) <= 4.0),
    single AS (SELECT * FROM tiered t WHERE tier = (SELECT min(tier) FROM tiered u WHERE u.track = t.track))"""


def _feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        F.floor(v / 128).cast("long").alias("track"), (v % 128).cast("long").alias("i"), ((v % 128) * F.lit(0.5)).alias("t"),
        F.col("embedding").cast("array<double>").alias("feat"), ((v * 37 % 101) / F.lit(101.0)).alias("strength"),
    )


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bars(ops.windows(_feats(spark, sf_dir), "track"), "track")


@query(_F + f" SELECT x.track, x.i AS a, y.i AS b, round({_COS.format('x.feat', 'y.feat')}, 6) AS similarity FROM feats x JOIN feats y ON x.track = y.track AND y.i = x.i + 4")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every beat with the one a bar later."""
    f = _feats(spark, sf_dir)
    later = f.select("track", (F.col("i") - 4).alias("i"), F.col("feat").alias("other"))
    return f.join(later, ["track", "i"]).select("track", F.col("i").alias("a"), (F.col("i") + 4).alias("b"), F.round(signal.cosine(F.col("feat"), F.col("other")), 6).alias("similarity"))


@query(_PAIRS + " SELECT track, ka, kb, a, b, removed, round(sim, 6) AS similarity, CAST(round_even(removed / 2.0, 0) AS BIGINT) AS bars_removed FROM single")
def bar_pairs_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.single_splices(_bars(spark, sf_dir), "track", REMOVE, BAR)
    return rows.select("track", "ka", "kb", "a", "b", "removed", F.round("similarity", 6).alias("similarity"), "bars_removed")


@query(_PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(sim + bonus, 9) DESC, ka, kb) AS place FROM single) SELECT track, ka, kb, CAST(place AS INTEGER) AS place, bonus > 0 AS phrase_aligned FROM r WHERE place <= 4")
def phrase_bonus_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.single_splices(_bars(spark, sf_dir), "track", REMOVE, BAR).withColumn("rank_score", F.round("rank_score", 9))
    return ops.ranked(rows, "track").select("track", "ka", "kb", "place", "phrase_aligned")


@query(_PAIRS + """, inner_ AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY sim + CASE WHEN bonus > 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END DESC, ka, kb) AS place FROM scored WHERE removed > 1.0 AND removed < 15.0),
    both_ AS (SELECT x.track, x.place AS p, y.place AS q, x.a AS xa, x.b AS xb, y.a AS ya, y.b AS yb, x.removed + y.removed AS removed FROM inner_ x JOIN inner_ y ON x.track = y.track AND (y.b <= x.a OR y.a >= x.b) AND abs(y.removed - (16.0 - x.removed)) <= 2.0),
    f AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY p, q) AS r FROM both_) SELECT track, least(xa, ya) AS a1, CASE WHEN xa < ya THEN xb ELSE yb END AS b1, greatest(xa, ya) AS a2, CASE WHEN xa < ya THEN yb ELSE xb END AS b2, removed FROM f WHERE r = 1""")
def two_splice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.two_splices(_bars(spark, sf_dir), "track", REMOVE, BAR).drop("similarity1", "similarity2")


@query(_F + """, c AS (SELECT *, i % 4 = 0 AND t >= 38.0 AND t <= 40.5 AS inside FROM feats), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY NOT inside, CASE WHEN inside THEN -(strength - 0.15::DOUBLE * abs(t - 40.0)) ELSE abs(t - 40.0) END, t) AS r FROM c) SELECT track, t AS hit FROM r WHERE r = 1""")
def button_hit_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.button(_feats(spark, sf_dir), "track", TARGET)


@query(_BARS + ", p AS (SELECT track, max(t) AS p FROM bars WHERE k % 4 = 0 AND t <= 37.3 GROUP BY track), b AS (SELECT track, max(CASE WHEN t <= 37.3 THEN t END) AS b FROM feats GROUP BY track) SELECT b.track, coalesce(p, b, 37.3::DOUBLE) AS exit, CASE WHEN p IS NOT NULL THEN 'phrase_boundary' ELSE 'beat' END AS kind FROM b LEFT JOIN p USING (track)")
def last_phrase_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_boundary(_bars(spark, sf_dir), _feats(spark, sf_dir), "track", 37.3)


@query(_F + ", s AS (SELECT track, i, 0.5::DOUBLE + strength / 2 AS s FROM feats) SELECT track, i, round(CASE WHEN s >= 0.90::DOUBLE THEN 0.03::DOUBLE ELSE 0.03::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.90::DOUBLE - s) / 0.2::DOUBLE)) * 0.47::DOUBLE END, 9) AS xfade FROM s")
def xfade_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.lit(0.5) + F.col("strength") / 2
    return _feats(spark, sf_dir).select("track", "i", F.round(signal.crossfade_seconds(s, F.lit(0.5)), 9).alias("xfade"))


@query(f"WITH {ONSETS_SQL}" + """, f AS (SELECT track, t / 1000.0::DOUBLE AS t, greatest(strength - coalesce(lag(strength) OVER (PARTITION BY track ORDER BY t, i), strength), 0.0::DOUBLE) AS flux FROM onsets),
    seams AS (SELECT DISTINCT track, t / 1000.0::DOUBLE AS seam FROM onsets WHERE kind = 'error'),
    hit AS (SELECT f.track, f.t, s.seam, f.flux FROM f JOIN seams s ON f.track = s.track AND abs(f.t - s.seam) <= 3600.0),
    p AS (SELECT track, quantile_cont(flux, 0.9) AS p90 FROM f WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.track = f.track AND h.t = f.t) GROUP BY track),
    top AS (SELECT track, seam, max(flux) AS top FROM hit GROUP BY ALL)
    SELECT track, seam, round(CASE WHEN p90 > 1e-9 THEN top / p90 ELSE 0.0::DOUBLE END, 6) AS ratio FROM top LEFT JOIN p USING (track)""")
def seam_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = beat_ops.flux(onsets(spark, sf_dir), "track", order=("i",)).withColumn("t", F.col("t") / F.lit(1000.0))
    seams = o.where("kind = 'error'").select("track", F.col("t").alias("seam")).distinct()
    return ops.seam_ratios(o.select("track", "t", "flux"), seams, "track", 3600.0).select("track", "seam", F.round("ratio", 6).alias("ratio"))


@query(_F + ", s AS (SELECT track, i // 16 AS idx, min(t) AS s, max(t) + 0.5 AS e, 0.03::DOUBLE * (i // 16) AS x FROM feats GROUP BY track, i // 16) SELECT track, idx, round(coalesce(sum(e - s) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) - sum(CASE WHEN idx = 0 THEN 0.0::DOUBLE ELSE x END) OVER (PARTITION BY track ORDER BY idx ROWS UNBOUNDED PRECEDING), 9) AS \"offset\" FROM s")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.floor(F.col("i") / 16).cast("long")
    s = _feats(spark, sf_dir).groupBy("track", idx.alias("idx")).agg(F.min("t").alias("start"), (F.max("t") + 0.5).alias("end")).withColumn("xfade", F.lit(0.03) * F.col("idx"))
    return ops.segment_offsets(s, "track").select("track", "idx", F.round("offset", 9).alias("offset"))


@query(_BARS + ", p AS (SELECT track, max(t) AS p FROM bars WHERE k % 4 = 0 AND t <= 37.3 GROUP BY track), d AS (SELECT track, max(t) + 0.5 AS d FROM feats GROUP BY track) SELECT track, 'tail' AS sting, round(least(d, p + 1.8::DOUBLE), 9) AS out_s, round(least(d, p + 1.8::DOUBLE) - p, 9) AS fade_s FROM p JOIN d USING (track) UNION ALL SELECT track, 'fade', p, least(4.0::DOUBLE, p) FROM p")
def music_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feats(spark, sf_dir)
    exits = ops.last_boundary(_bars(spark, sf_dir), f, "track", 37.3).join(f.groupBy("track").agg((F.max("t") + 0.5).alias("d")), "track")
    parts = [ops.endings(exits, s, BAR, F.col("d")).select("track", F.lit(s).alias("sting"), F.round("out_s", 9).alias("out_s"), F.round("fade_s", 9).alias("fade_s")) for s in ("tail", "fade")]
    return parts[0].unionByName(parts[1])


#: The features are noise, so that a low floor stands for the real one here.
FLOOR, BEAT = 0.05, 0.5
_XF = "(CASE WHEN {0} >= 0.90::DOUBLE THEN 0.03::DOUBLE ELSE 0.03::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.90::DOUBLE - {0}) / 0.2::DOUBLE)) * 0.47::DOUBLE END)"
_TWO = """inner_ AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY sim + CASE WHEN bonus > 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END DESC, ka, kb) AS place FROM scored WHERE removed > 1.0 AND removed < 15.0),
    both_ AS (SELECT x.track, x.place AS p, y.place AS q, x.ka AS xka, x.kb AS xkb, y.ka AS yka, y.kb AS ykb, x.removed AS xr, y.removed AS yr, x.sim AS xs, y.sim AS ys, x.bonus > 0 AS xp, y.bonus > 0 AS yp FROM inner_ x JOIN inner_ y ON x.track = y.track AND (y.b <= x.a OR y.a >= x.b) AND abs(y.removed - (16.0 - x.removed)) <= 2.0),
    two AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY p, q) AS r FROM both_)"""


@query(_PAIRS + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(sim + bonus, 9) DESC, ka, kb) AS place FROM single), one AS (SELECT track, removed, sim, bonus > 0 AS al FROM rk WHERE place = 1 AND sim >= {FLOOR}), {_TWO},
    sp AS (SELECT * FROM one UNION ALL SELECT track, unnest([xr, yr]), unnest([xs, ys]), unnest([xp, yp]) FROM two WHERE r = 1 AND least(xs, ys) >= {FLOOR} AND track NOT IN (SELECT track FROM one)),
    ql AS (SELECT track, count(*) AS splices, bool_and(al) AS aligned, min(sim) AS weakest, sum(removed) AS removed, sum(removed + {_XF.format('sim')}) AS lost FROM sp GROUP BY track), du AS (SELECT track, max(t) + 0.5::DOUBLE AS d FROM feats GROUP BY track),
    bt AS (SELECT *, i % 4 = 0 AND t >= 38.0 AND t <= 40.5 AS inside FROM feats), hb AS (SELECT track, t AS hit, row_number() OVER (PARTITION BY track ORDER BY NOT inside, CASE WHEN inside THEN -(strength - 0.15::DOUBLE * abs(t - 40.0)) ELSE abs(t - 40.0) END, t) AS r FROM bt)
    SELECT du.track, CASE WHEN splices IS NULL THEN 'button' ELSE 'seamless' END AS strategy, coalesce(splices, 0) AS splices, coalesce(aligned, false) AS aligned, round(coalesce(weakest, 0.0::DOUBLE), 6) AS weakest, coalesce(removed, 0.0::DOUBLE) AS removed,
           round(CASE WHEN splices IS NULL THEN least(d, hit + 0.05::DOUBLE + 2.0::DOUBLE) ELSE d - lost END, 6) AS out_s, CASE WHEN splices IS NULL THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS fade_s FROM du LEFT JOIN ql USING (track) JOIN hb ON hb.track = du.track AND hb.r = 1""")
def cut_music(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of every song: one splice, two, or a button ending, with its length."""
    plan = ops.cut_plan(_feats(spark, sf_dir), "track", REMOVE, TARGET, BAR, BEAT, FLOOR)
    return plan.withColumns({"weakest": F.round("weakest", 6), "out_s": F.round("out_s", 6)})


@query(_PAIRS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(sim + bonus, 9) DESC, ka, kb) AS place FROM single), cd AS (SELECT track, place, a * 0.5::DOUBLE AS ta, b * 0.5::DOUBLE AS tb FROM rk WHERE place <= 4),
    fx AS (SELECT track, t, greatest(strength - coalesce(lag(strength) OVER (PARTITION BY track ORDER BY t), strength), 0.0::DOUBLE) AS flux FROM feats), sm AS (SELECT track, place, ta AS s FROM cd UNION SELECT track, place, tb FROM cd),
    hit AS (SELECT sm.track, sm.place, s, fx.t, fx.flux FROM sm JOIN fx ON fx.track = sm.track AND abs(fx.t - s) <= 0.5), tp AS (SELECT track, place, s, max(flux) AS top FROM hit GROUP BY ALL),
    p9 AS (SELECT cd.track, cd.place, quantile_cont(fx.flux, 0.9) AS p FROM cd JOIN fx USING (track) WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.track = cd.track AND h.place = cd.place AND h.t = fx.t) GROUP BY ALL),
    ws AS (SELECT track, place, max(CASE WHEN p > 1e-9 THEN coalesce(top, 0.0::DOUBLE) / p ELSE 0.0::DOUBLE END) AS worst FROM sm LEFT JOIN tp USING (track, place, s) LEFT JOIN p9 USING (track, place) GROUP BY ALL),
    ch AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY worst > 1.25, CASE WHEN worst > 1.25 THEN worst ELSE 0.0::DOUBLE END, place) AS r FROM ws)
    SELECT track, CAST(place AS INTEGER) AS try, worst <= 1.25 AS accepted, round(worst, 6) AS worst FROM ch WHERE r = 1""")
def seam_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each song's four best splices the first whose seams can't be heard."""
    f = _feats(spark, sf_dir)
    best = ops.ranked(ops.single_splices(_bars(spark, sf_dir), "track", REMOVE, BAR).withColumn("rank_score", F.round("rank_score", 9)), "track")
    cands = best.select("track", "place", F.array(F.col("a") * F.lit(0.5), F.col("b") * F.lit(0.5)).alias("seams"))
    return ops.retried(cands, beat_ops.flux(f, "track").select("track", "t", "flux"), "track", 0.5).withColumn("worst", F.round("worst", 6))


_UNIT = "CASE WHEN sqrt(list_dot_product({0}, {0})) <= 1e-9 THEN {0} ELSE list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0}))) END"


@query(_F + f", h AS (SELECT track, i, feat[1:len(feat) // 2] AS p, feat[len(feat) // 2 + 1:len(feat)] AS q FROM feats), u AS (SELECT track, i, list_concat({_UNIT.format('p')}, list_transform({_UNIT.format('q')}, lambda x: 0.5::DOUBLE * x)) AS v FROM h) SELECT track, i, CAST(len(v) AS INTEGER) AS n, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS total FROM u")
def weighted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of a vector at unit length, the second with half the weight, side by side."""
    half = F.floor(F.size("feat") / 2).cast("int")
    p, q = F.slice("feat", F.lit(1), half), F.slice("feat", half + 1, F.size("feat") - half)
    rows = _feats(spark, sf_dir).select("track", "i", F.concat(signal.normalise(p), F.transform(signal.normalise(q), lambda x: F.lit(0.5) * x)).alias("v"))
    return rows.select("track", "i", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("total"))
