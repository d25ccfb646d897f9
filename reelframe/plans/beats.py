"""Queries over beats, onsets and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beats as ops
from ..operators import intervals
from ..sources.views import BEAT_MS, BEATS_SQL, ONSETS_SQL, beats, onsets, read
from ..streaming.sessions import pause_sessions
from .registry import query

HOUR = 3_600_000

_ON = f"WITH {ONSETS_SQL}"
_BOTH = f"WITH {ONSETS_SQL}, {BEATS_SQL}"
_ENERGY = _BOTH + """, nxt AS (SELECT *, lead(t) OVER (PARTITION BY track ORDER BY i) AS t1 FROM beats),
    peaks AS (SELECT b.track, b.i, b.t, greatest(coalesce(max(o.strength), 0.0::DOUBLE), 0.0::DOUBLE) AS peak FROM nxt b LEFT JOIN onsets o ON o.track = b.track AND o.t >= b.t AND o.t < b.t1 WHERE b.t1 IS NOT NULL GROUP BY b.track, b.i, b.t),
    energy AS (SELECT track, i, t, CASE WHEN max(peak) OVER (PARTITION BY track) > 1e-9 THEN peak / max(peak) OVER (PARTITION BY track) ELSE 0.5::DOUBLE END AS energy FROM peaks)
"""
_SPANS = _ON + ", spans AS (SELECT track, t AS start_ms, t + 1800000 + (t // 1000 % 7) * 900000 AS end_ms FROM onsets)"
_ISLANDS = _SPANS + """, o AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY track ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM spans),
    g AS (SELECT *, sum(o) OVER (PARTITION BY track ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM o),
    m AS (SELECT track, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY track, island)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return onsets(spark, sf_dir).select("track", t.alias("start_ms"), (t + 1800000 + (F.floor(t / 1000) % 7) * 900000).cast("long").alias("end_ms"))


@query(_ISLANDS + " SELECT * FROM m")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(_spans(spark, sf_dir), ["track"])


@query(_ISLANDS + """, shifted AS (SELECT m.track, m.start_ms - lo AS start_ms, m.end_ms - lo AS end_ms, hi FROM m JOIN (SELECT track, min(start_ms) - 3600000 AS lo, max(end_ms) - min(start_ms) + 7200000 AS hi FROM m GROUP BY track) USING (track)),
    rows_ AS (SELECT track, start_ms, end_ms FROM shifted UNION ALL SELECT DISTINCT track, hi, NULL FROM shifted),
    gaps AS (SELECT track, coalesce(lag(end_ms) OVER (PARTITION BY track ORDER BY start_ms, end_ms NULLS LAST), 0) AS start_ms, start_ms AS end_ms FROM rows_)
    SELECT * FROM gaps WHERE end_ms > start_ms""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each track between an hour before its first interval and an hour after its last, counted from there."""
    merged = intervals.merge(_spans(spark, sf_dir), ["track"])
    edge = merged.groupBy("track").agg((F.min("start_ms") - HOUR).alias("lo"), (F.max("end_ms") - F.min("start_ms") + 2 * HOUR).alias("duration_ms"))
    moved = merged.join(edge, "track").select("track", (F.col("start_ms") - F.col("lo")).alias("start_ms"), (F.col("end_ms") - F.col("lo")).alias("end_ms"))
    return intervals.complement(moved, edge, ["track"])


@query(_BOTH + " SELECT track, i, t FROM beats")
def beat_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = onsets(spark, sf_dir).groupBy("track").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return ops.regular(spans, "track", "lo", "hi", BEAT_MS)


@query(_ENERGY + " SELECT track, i, round(energy, 9) AS energy FROM energy")
def beat_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.energy(beats(spark, sf_dir), onsets(spark, sf_dir)).select("track", "i", F.round("energy", 9).alias("energy"))


@query(_ENERGY + """ SELECT track, i, CASE WHEN energy >= 0.66::DOUBLE THEN 'high' WHEN energy >= 0.33::DOUBLE THEN 'mid' ELSE 'low' END AS tier,
    CASE WHEN energy >= 0.66::DOUBLE THEN 1 WHEN energy >= 0.33::DOUBLE THEN 2 ELSE 3 END AS music_video, CASE WHEN energy >= 0.66::DOUBLE THEN 2 WHEN energy >= 0.33::DOUBLE THEN 3 ELSE 4 END AS montage,
    CASE WHEN energy >= 0.33::DOUBLE THEN 1 ELSE 2 END AS trailer FROM energy""")
def energy_tier_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.energy(beats(spark, sf_dir), onsets(spark, sf_dir))
    return e.select("track", "i", ops.tier(F.col("energy"))[0].alias("tier"), *(ops.beats_per_shot(F.col("energy"), s).alias(s) for s in ops.STYLES))


@query(_BOTH + """, two AS (SELECT o.track, o.i, o.t, (SELECT max(b.t) FROM beats b WHERE b.track = o.track AND b.t <= o.t) AS back, (SELECT min(b.t) FROM beats b WHERE b.track = o.track AND b.t >= o.t) AS ahead FROM onsets o),
    best AS (SELECT *, CASE WHEN back IS NOT NULL AND (ahead IS NULL OR t - back <= ahead - t) THEN back ELSE ahead END AS n FROM two)
    SELECT track, i, t, CASE WHEN abs(n - t) <= 3600000 THEN n ELSE t END AS snapped, coalesce(abs(n - t) <= 3600000, false) AS did FROM best""")
def beat_snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.nearest(onsets(spark, sf_dir), beats(spark, sf_dir).select("track", "t"), ["track"], "t", tolerance=HOUR)
    return found.select("track", "i", "t", F.coalesce("nearest", "t").alias("snapped"), F.col("nearest").isNotNull().alias("did"))


@query(_BOTH + """, two AS (SELECT b.track, b.i, b.t, (SELECT max(o.t) FROM onsets o WHERE o.track = b.track AND o.t <= b.t) AS back, (SELECT min(o.t) FROM onsets o WHERE o.track = b.track AND o.t >= b.t) AS ahead FROM beats b),
    best AS (SELECT *, CASE WHEN back IS NOT NULL AND (ahead IS NULL OR t - back <= ahead - t) THEN back ELSE ahead END AS n FROM two)
    SELECT track, i, CASE WHEN abs(n - t) <= 108000 THEN n ELSE -1 END AS onset FROM best""")
def beat_onset_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The onset within 30 ms of each beat, an hour standing for a second; -1 without one."""
    found = intervals.nearest(beats(spark, sf_dir), onsets(spark, sf_dir).select("track", "t"), ["track"], "t", tolerance=30 * HOUR // 1000)
    return found.select("track", "i", F.coalesce("nearest", F.lit(-1)).alias("onset"))


@query(_ON + """, p AS (SELECT *, lag(strength) OVER w AS b, lead(strength) OVER w AS a, avg(strength) OVER (PARTITION BY track) + 0.5::DOUBLE * stddev_pop(strength) OVER (PARTITION BY track) AS l FROM onsets WINDOW w AS (PARTITION BY track ORDER BY t, i))
    SELECT track, i, t FROM p WHERE strength >= l AND strength >= b AND strength >= a""")
def onset_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peaks(onsets(spark, sf_dir), "track", order=("i",)).select("track", "i", "t")


_PEAKS = _ON.replace("WITH", "WITH RECURSIVE", 1) + f""", p AS (SELECT *, lag(strength) OVER w AS b, lead(strength) OVER w AS a, avg(strength) OVER (PARTITION BY track) + 0.5::DOUBLE * stddev_pop(strength) OVER (PARTITION BY track) AS l FROM onsets WINDOW w AS (PARTITION BY track ORDER BY t, i)),
    pk AS (SELECT DISTINCT track, t FROM p WHERE strength >= l AND strength >= b AND strength >= a), nx AS (SELECT p.track, p.t, min(q.t) AS n FROM pk p LEFT JOIN pk q ON q.track = p.track AND q.t >= p.t + {6 * HOUR} GROUP BY ALL),
    sp AS (SELECT track, min(t) AS t FROM pk GROUP BY track UNION ALL SELECT nx.track, nx.n FROM sp JOIN nx ON nx.track = sp.track AND nx.t = sp.t WHERE nx.n IS NOT NULL)"""


@query(_PEAKS + " SELECT track, t FROM sp")
def onset_peaks_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.spaced_peaks(onsets(spark, sf_dir), "track", 6 * HOUR, order=("i",))


@query(_PEAKS + f""", g AS (SELECT track, (t - lag(t) OVER (PARTITION BY track ORDER BY t)) / {HOUR}.0::DOUBLE AS g FROM sp), tm AS (SELECT track, quantile_cont(g, 0.5) AS period FROM g WHERE g > 0.2::DOUBLE AND g < 20.0::DOUBLE GROUP BY track),
    st AS (SELECT track, min(t) AS s FROM sp GROUP BY track), en AS (SELECT track, max(t) AS e FROM onsets GROUP BY track), sn AS (SELECT track, s, e, period, CAST(greatest(round(period * {HOUR}), 1) AS BIGINT) AS step FROM st JOIN en USING (track) JOIN tm USING (track)),
    gr AS (SELECT track, unnest(generate_series(s, e, step)) AS t, s, step, period FROM sn)
    SELECT track, CAST((t - s) // step AS BIGINT) AS i, t, round(60.0::DOUBLE / period, 6) AS bpm FROM gr
    UNION ALL SELECT track, row_number() OVER (PARTITION BY track ORDER BY t) - 1, t, 0.0::DOUBLE FROM sp WHERE track NOT IN (SELECT track FROM tm)""")
def beat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks, tempo and grid of every track; an hour stands for a second."""
    o = onsets(spark, sf_dir)
    ends = o.groupBy("track").agg(F.max("t").alias("end"))
    return ops.beat_grid(o, ends, "track", 6 * HOUR, gaps_s=(0.2, 20.0), unit=HOUR).withColumn("bpm", F.coalesce(F.round("bpm", 6), F.lit(0.0)))


@query(_ON + """, g AS (SELECT track, (t - lag(t) OVER (PARTITION BY track ORDER BY t, i)) / 3600000.0::DOUBLE AS g FROM onsets)
    SELECT track, round(quantile_cont(g, 0.5), 9) AS period, round(60.0::DOUBLE / quantile_cont(g, 0.5), 6) AS bpm FROM g WHERE g > 0.2::DOUBLE AND g < 20.0::DOUBLE GROUP BY track""")
def inter_onset_bpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour stands for a second."""
    rows = ops.bpm(onsets(spark, sf_dir), "track", low=0.2, high=20.0, unit=float(HOUR), order=("i",))
    return rows.select("track", F.round("period", 9).alias("period"), F.round("bpm", 6).alias("bpm"))


@query(_ON + """, g AS (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS g FROM onsets), s AS (SELECT track, avg(g) AS mean, quantile_cont(g::DOUBLE, 0.5) AS median FROM g WHERE g IS NOT NULL GROUP BY track)
    SELECT track, round(CASE WHEN abs(mean - median) <= 0.15::DOUBLE * median THEN mean ELSE median END, 4) AS period FROM s""")
def steady_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.steady_period(onsets(spark, sf_dir), "track").select("track", F.round("period", 4).alias("period"))


@query(_ENERGY + """, m AS (SELECT track, i % 4 AS phase, round(avg(round(energy, 9)), 9) AS mean FROM energy GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY mean DESC, phase) AS r FROM m) SELECT track, phase FROM r WHERE r = 1""")
def downbeat_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.energy(beats(spark, sf_dir), onsets(spark, sf_dir))
    return ops.downbeat(e.withColumn("strength", F.round("energy", 9)), "track")


@query(_ON + ", f AS (SELECT track, i, greatest(strength - coalesce(lag(strength) OVER (PARTITION BY track ORDER BY t, i), strength), 0.0::DOUBLE) AS flux FROM onsets) SELECT track, i, round(flux, 6) AS flux FROM f")
def flux_rectified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.flux(onsets(spark, sf_dir), "track", order=("i",)).select("track", "i", F.round("flux", 6).alias("flux"))


@query(_ON + """, o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY track ORDER BY t, i) <= 21600000 THEN 0 ELSE 1 END AS o FROM onsets),
    s AS (SELECT *, CAST(sum(o) OVER (PARTITION BY track ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM o)
    SELECT track, session, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM s GROUP BY track, session""")
def session_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.sessions(onsets(spark, sf_dir), ["track"], "t", 6 * HOUR, ("i",))
    return rows.groupBy("track", "session").agg(F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count(F.lit(1)).alias("n"))


_SHOTS = _ENERGY.replace("WITH", "WITH RECURSIVE", 1) + """, song AS (SELECT b.track, b.track % 25 AS pool, b.i, b.i * 600 AS t, coalesce(e.energy, 0.5::DOUBLE) AS energy FROM beats b LEFT JOIN energy e ON e.track = b.track AND e.i = b.i),
    reel AS (SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) - 1 AS pool, CAST(p_partkey AS VARCHAR) AS path, p_partkey AS pos, (p_size % 9 + 1) * 1000 - 500 AS room FROM part),
    us AS (SELECT pool, list(path ORDER BY pos) AS paths, list(room ORDER BY pos) AS rooms, max(room) AS widest FROM reel GROUP BY pool),
    wt AS (SELECT *, CASE WHEN energy >= 0.66::DOUBLE THEN 1 WHEN energy >= 0.33::DOUBLE THEN 2 ELSE 3 END AS wanted, lead(t, 2) OVER w - t AS s2, lead(t, 3) OVER w - t AS s3, max(i) OVER (PARTITION BY track) AS li FROM song JOIN us USING (pool) WINDOW w AS (PARTITION BY track ORDER BY i)),
    hd AS (SELECT *, CASE WHEN wanted >= 3 AND coalesce(s3 <= widest, TRUE) THEN 3 WHEN wanted >= 2 AND coalesce(s2 <= widest, TRUE) THEN 2 ELSE 1 END AS held FROM wt),
    nx AS (SELECT track, i, least(i + held, li) AS next, (least(i + held, li) - i) * 600 AS span, held, round(energy, 3) AS energy, CASE WHEN energy >= 0.66::DOUBLE THEN 'chorus/drop' WHEN energy >= 0.33::DOUBLE THEN 'verse' ELSE 'intro/breakdown' END AS section FROM hd WHERE i < li),
    walk AS (SELECT DISTINCT track, pool, CAST(0 AS BIGINT) AS due, CAST(0 AS BIGINT) AS turn, CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS done, list_transform(rooms, lambda r: CAST(250 AS BIGINT)) AS cur, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS span, CAST(0 AS BIGINT) AS length FROM song JOIN us USING (pool)
      UNION ALL
      SELECT track, pool, next, c + 1, c, done + span_, list_transform(cur, lambda x, j: CASE WHEN j = c + 1 THEN CASE WHEN bg + greatest(len_, 500) >= 250 + rooms[c + 1] THEN 250 ELSE bg + greatest(len_, 500) END ELSE x END), idx + 1, bg, span_, len_ FROM (
        SELECT *, least(span_, rooms[c + 1]) AS len_, CASE WHEN cur[c + 1] + least(span_, rooms[c + 1]) > 250 + rooms[c + 1] THEN 250 ELSE cur[c + 1] END AS bg FROM (
          SELECT *, coalesce(list_filter(wide, lambda k: k <> last)[1], wide[1], list_position(rooms, list_max(rooms)) - 1) AS c FROM (
            SELECT w.track, w.pool, w.turn, w.last, w.done, w.cur, w.idx, n.next, CAST(n.span AS BIGINT) AS span_, u.rooms,
                   list_filter(list_transform(range(0, len(u.rooms)), lambda k: (w.turn + k) % len(u.rooms)), lambda k: u.rooms[k + 1] >= n.span) AS wide
            FROM walk w JOIN nx n ON n.track = w.track AND n.i = w.due JOIN us u ON u.pool = w.pool)))),
    pl AS (SELECT w.*, u.paths[w.last + 1] AS source FROM walk w JOIN us u USING (pool) WHERE idx >= 0)
    SELECT pl.track, idx, source, b / 1000.0::DOUBLE AS in_s, (b + length) / 1000.0::DOUBLE AS out_s, (pl.done - pl.span) / 1000.0::DOUBLE AS timeline_in, pl.done / 1000.0::DOUBLE AS timeline_out, CAST(held AS BIGINT) AS beats, pl.span / 1000.0::DOUBLE AS span_s, energy, section,
           section || ': ' || held || '-beat ' || CASE WHEN held = 1 THEN 'cut' ELSE 'hold' END AS rationale, CAST(1 AS BIGINT) AS motion_lead_frames
    FROM pl JOIN nx ON nx.track = pl.track AND nx.next = pl.due AND nx.i * 600 = pl.done - pl.span"""


@query(_SHOTS)
def shot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a song, six hours as 600 ms, cut with all parts of one brand as footage."""
    grid = beats(spark, sf_dir)
    e = grid.join(ops.energy(grid, onsets(spark, sf_dir)).select("track", "i", "energy"), ["track", "i"], "left")
    e = e.withColumns({"t": (F.col("i") * 600).cast("long"), "pool": (F.col("track") % 25).cast("long")})
    pool = F.regexp_extract("p_brand", "[0-9]+", 0).cast("long") - 1
    parts = read(spark, sf_dir, "part").select(pool.alias("pool"), F.col("p_partkey").cast("string").alias("path"), ((F.col("p_size") % 9 + 1) * 1000).cast("long").alias("ms"), F.col("p_partkey").alias("pos"))
    return ops.shots(e, parts, pool="pool")


@query("""WITH e AS (SELECT user_id AS track, ts, event_id FROM events), o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY track ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS o FROM e),
    s AS (SELECT *, sum(o) OVER (PARTITION BY track ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT track, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY track, s""")
def session_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over a batch table."""
    rows = pause_sessions(read(spark, sf_dir, "events").withColumnRenamed("user_id", "track"), "track", "ts")
    return rows.select("track", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
