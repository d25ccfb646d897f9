"""Queries over transcripts: tokens, fillers, pauses, cuts, keep ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals
from ..operators import words as ops
from ..sources.views import WORDS_SQL, files, words
from .registry import query

KEY = "doc_id"
#: The prose is invented, so frequent words stand in for fillers here; the operators' defaults are the real lists.
FILLERS, GUARDED, PHRASES = ("of", "the", "and"), ("in",), (("of", "the"), ("with", "the"))


def cut_by_transcript(
    w: DataFrame, spans: DataFrame, key: str, keep_ratio_floor: float = 0.5, **options: object
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cuts with reasons, keep ranges, totals) of the whole transcript cutter.

    totals: key, duration_ms, cuts, removed_ms, kept_ms, keep_ratio, below_floor (then nothing should be executed).
    """
    cuts = ops.merged_cuts(ops.raw_cuts(w, spans, key, **options), key)
    keep = intervals.complement(cuts, spans, [key])
    # What is kept follows from the cuts, which are disjoint: one aggregation, and no second pass for the keep ranges.
    inside = F.greatest(F.lit(0), F.least(F.col("end_ms"), F.col("duration_ms")) - F.greatest(F.col("start_ms"), F.lit(0)))
    sums = [F.count("start_ms").alias("cuts"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("removed_ms"), F.sum(inside).alias("gone_")]
    totals = spans.select(key, "duration_ms").join(cuts, key, "left").groupBy(key, "duration_ms").agg(*sums).fillna(0, ["cuts", "removed_ms", "gone_"])
    kept = F.col("duration_ms") - F.col("gone_")
    totals = totals.withColumn("kept_ms", F.when(kept > 0, kept).otherwise(F.col("duration_ms"))).drop("gone_")
    totals = totals.withColumn("keep_ratio", F.coalesce(F.try_divide(F.col("kept_ms"), F.col("duration_ms")), F.lit(1.0)))
    return cuts, keep, totals.withColumn("below_floor", F.col("keep_ratio") < keep_ratio_floor)


def edit_plan(keep: DataFrame, key: str, kind: str = "video") -> DataFrame:
    """Clips (timeline, kind, idx, in_ms, out_ms) of keep ranges: audio, and video for video files."""
    idx = F.row_number().over(W.partitionBy(key).orderBy("start_ms")) - 1
    kinds = ["video", "audio"] if kind == "video" else ["audio"]
    return keep.select(F.col(key).alias("timeline"), idx.cast("long").alias("idx"), F.col("start_ms").alias("in_ms"), F.col("end_ms").alias("out_ms")).select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))


def custom_fillers(default: Sequence[str], custom: Sequence[str]) -> tuple[list[str], list[tuple[str, ...]], list[str]]:
    """(single words, phrases, what custom adds): multi-word entries become phrases."""
    cleaned = [" ".join(c.lower().split()) for c in custom if c.strip()]
    single = [c for c in cleaned if " " not in c]
    return sorted(set(default) | set(single)), [tuple(c.split()) for c in cleaned if " " in c], sorted(set(cleaned) - set(default))


_SQL = f"WITH {WORDS_SQL},\n" + r"""
files AS (SELECT doc_id, max(end_ms) + 800 AS duration_ms FROM words GROUP BY doc_id),
near AS (SELECT *, lag(word) OVER w AS prev_word, lag(norm) OVER w AS prev_norm, lead(norm) OVER w AS n1, lead(norm, 2) OVER w AS n2, lead(norm, 3) OVER w AS n3,
         lag(end_ms) OVER w AS prev_end, lead(start_ms) OVER w AS next_start, lead(start_ms, 2) OVER w AS next2, lead(end_ms) OVER w AS end1
         FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
flags AS (SELECT *, pos = 0 OR regexp_matches(prev_word, '[.!?]\s*$') AS starts FROM near),
phr AS (SELECT *, norm || ' ' || n1 AS text FROM flags WHERE norm IN ('of', 'with') AND n1 = 'the' AND (NOT starts OR (n2 = norm AND n3 = n1))),
single AS (SELECT * FROM flags f WHERE norm IN ('of', 'the', 'and', 'in')
           AND (norm = 'in' OR NOT starts OR coalesce(n1 = norm, false) OR coalesce(prev_norm = norm, false))
           AND (norm <> 'in' OR coalesce(n1 = norm, false) OR coalesce(prev_norm = norm, false) OR (coalesce(start_ms - prev_end, 200) >= 200 AND coalesce(next_start - end_ms, 200) >= 200))
           AND NOT EXISTS (SELECT 1 FROM phr p WHERE p.doc_id = f.doc_id AND (p.pos = f.pos OR p.pos + 1 = f.pos))),
wide AS (SELECT doc_id, text, 'filler' AS type, CASE WHEN coalesce(prev_end, 0) + 80 <= start_ms THEN coalesce(prev_end, 0) + 80 ELSE start_ms END AS start_ms, CASE WHEN next2 - 80 >= end1 THEN next2 - 80 ELSE end1 END AS end_ms FROM phr
         UNION ALL SELECT doc_id, norm, 'filler', CASE WHEN coalesce(prev_end, 0) + 80 <= start_ms THEN coalesce(prev_end, 0) + 80 ELSE start_ms END, CASE WHEN next_start - 80 >= end_ms THEN next_start - 80 ELSE end_ms END FROM single),
gap AS (SELECT doc_id, coalesce(prev_end, 0) AS a, start_ms AS b FROM near UNION ALL SELECT f.doc_id, duration_ms - 800, duration_ms FROM files f),
pause AS (SELECT doc_id, CAST(round_even((b - a) / 1000.0::DOUBLE, 2) AS VARCHAR) || 's pause' AS text, 'pause' AS type, a + 80 AS start_ms, b - 80 AS end_ms FROM gap WHERE b - a > 600 AND b - a - 160 >= 200),
cuts AS (SELECT * FROM wide UNION ALL SELECT * FROM pause),
opened AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, type, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM cuts),
isl AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, type, text ROWS UNBOUNDED PRECEDING) AS island FROM opened),
merged AS (SELECT doc_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_reasons, string_agg(type || ':' || text, '|' ORDER BY start_ms, end_ms, type, text) AS reasons FROM isl GROUP BY doc_id, island),
bounds AS (SELECT doc_id, start_ms, end_ms FROM merged UNION ALL SELECT doc_id, duration_ms, NULL FROM files),
gapped AS (SELECT doc_id, coalesce(max(end_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, start_ms AS b FROM bounds),
keep AS (SELECT doc_id, a AS start_ms, b AS end_ms FROM gapped WHERE b > a
         UNION ALL SELECT doc_id, 0, duration_ms FROM files f WHERE NOT EXISTS (SELECT 1 FROM gapped g WHERE g.doc_id = f.doc_id AND b > a)),
totals AS (SELECT f.doc_id, f.duration_ms, coalesce((SELECT sum(end_ms - start_ms) FROM merged m WHERE m.doc_id = f.doc_id), 0) AS removed_ms,
           (SELECT sum(end_ms - start_ms) FROM keep k WHERE k.doc_id = f.doc_id) AS kept_ms, (SELECT count(*) FROM merged m WHERE m.doc_id = f.doc_id) AS cuts FROM files f)
"""


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = words(spark, sf_dir)
    f = files(spark, sf_dir)
    return w, f, ops.raw_cuts(w, f, KEY, FILLERS, GUARDED, PHRASES, remove_restarts=False)


@query(_SQL + "SELECT doc_id, duration_ms, CAST(cuts AS BIGINT) AS cuts, CAST(removed_ms AS BIGINT) AS removed_ms, CAST(kept_ms AS BIGINT) AS kept_ms, kept_ms / CAST(duration_ms AS DOUBLE) AS keep_ratio FROM totals")
def filler_cuts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript cutter without restarts, from words to totals per file."""
    w = words(spark, sf_dir)
    _, _, totals = cut_by_transcript(w, files(spark, sf_dir), KEY, fillers=FILLERS, guarded=GUARDED, phrases=PHRASES, remove_restarts=False)
    return totals.drop("below_floor")


@query(_SQL + "SELECT doc_id, kept_ms / CAST(duration_ms AS DOUBLE) < 0.8::DOUBLE AS below_floor FROM totals")
def keep_ratio_floor_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return cut_by_transcript(w, files(spark, sf_dir), KEY, 0.8, fillers=FILLERS, guarded=GUARDED, phrases=PHRASES, remove_restarts=False)[2].select(KEY, "below_floor")


@query(f"WITH {WORDS_SQL} SELECT doc_id, pos, word, start_ms, end_ms FROM words")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).drop("norm")


@query(f"WITH {WORDS_SQL} SELECT norm, count(*) AS n, count(DISTINCT doc_id) AS files FROM words WHERE norm <> '' GROUP BY norm")
def word_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).where("norm <> ''").groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("files"))


@query(_SQL + "SELECT doc_id, pos, word FROM flags WHERE starts")
def sentence_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sentence_starts(words(spark, sf_dir), KEY).where("starts").select(KEY, "pos", "word")


@query(_SQL + "SELECT doc_id, pos, coalesce(start_ms - prev_end, -1) AS gap_before, coalesce(next_start - end_ms, -1) AS gap_after FROM near")
def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gaps(words(spark, sf_dir), KEY).select(KEY, "pos", "gap_before", "gap_after").fillna(-1)


@query(_SQL + "SELECT doc_id, start_ms, end_ms, text FROM pause")
def pause_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return ops.pauses(w, files(spark, sf_dir), KEY)


@query(_SQL + "SELECT doc_id, pos, start_ms, end_ms, text FROM (SELECT *, norm AS text FROM flags) WHERE norm IN ('of', 'the', 'and') AND (NOT starts OR coalesce(n1 = norm, false) OR coalesce(prev_norm = norm, false))")
def filler_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.single_fillers(words(spark, sf_dir), KEY, FILLERS, ()).drop("n")


@query(_SQL + """SELECT doc_id, pos, start_ms, end_ms, norm AS text FROM flags WHERE norm = 'in'
    AND (coalesce(n1 = norm, false) OR coalesce(prev_norm = norm, false) OR (coalesce(start_ms - prev_end, 200) >= 200 AND coalesce(next_start - end_ms, 200) >= 200))""")
def filler_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.single_fillers(words(spark, sf_dir), KEY, (), GUARDED).drop("n")


@query(_SQL + "SELECT doc_id, pos, start_ms, end1 AS end_ms, text FROM phr")
def filler_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.phrase_fillers(words(spark, sf_dir), KEY, PHRASES).drop("n")


_LENGTHS = ", ".join(f"CASE WHEN norm <> '' AND norm = lead(norm, {k}) OVER w THEN 1 ELSE 0 END AS s{k}" for k in range(2, 7))
_RUNS = ", ".join(f"sum(s{k}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS r{k}" for k in range(2, 7))
_BEST = "CASE " + " ".join(f"WHEN r{k} = {k} THEN {k}" for k in range(6, 1, -1)) + " ELSE 0 END"


# Greedy from the left: each run leads to the first one after it.
_RESTARTS = f"WITH RECURSIVE {WORDS_SQL}, same AS (SELECT *, {_LENGTHS} FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), runs AS (SELECT *, {_RUNS} FROM same)," + f"""
    found AS MATERIALIZED (SELECT doc_id, pos, start_ms, CAST({_BEST} AS BIGINT) AS k FROM runs WHERE {_BEST} > 0),
    hops AS MATERIALIZED (SELECT f.doc_id, f.pos, min(g.pos) AS n FROM found f LEFT JOIN found g ON g.doc_id = f.doc_id AND g.pos >= f.pos + f.k GROUP BY ALL),
    taken AS (SELECT doc_id, min(pos) AS pos FROM found GROUP BY doc_id UNION ALL SELECT h.doc_id, h.n FROM taken t JOIN hops h ON h.doc_id = t.doc_id AND h.pos = t.pos WHERE h.n IS NOT NULL),
    again AS (SELECT f.doc_id, f.pos, f.k AS n, f.start_ms, max(w.start_ms) FILTER (w.pos = f.pos + f.k) AS end_ms, string_agg(w.norm, ' ' ORDER BY w.pos) FILTER (w.pos < f.pos + f.k) AS text
              FROM taken t JOIN found f USING (doc_id, pos) JOIN words w ON w.doc_id = f.doc_id AND w.pos BETWEEN f.pos AND f.pos + f.k GROUP BY ALL)
"""


@query(f"WITH {WORDS_SQL}, same AS (SELECT *, {_LENGTHS} FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), runs AS (SELECT *, {_RUNS} FROM same) SELECT doc_id, pos, CAST({_BEST} AS BIGINT) AS k FROM runs WHERE {_BEST} > 0")
def restart_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a run of words is repeated at once, before the greedy choice."""
    return ops.restart_lengths(words(spark, sf_dir), KEY).where("k > 0").select(KEY, "pos", F.col("k").cast("long").alias("k"))


@query(_RESTARTS + "SELECT doc_id, pos, n, start_ms, end_ms, text FROM again")
def restart_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.restarts(words(spark, sf_dir), KEY)


@query((_RESTARTS + "," + _SQL.split("AS norm, start_ms, CAST(start_ms + dur AS BIGINT) AS end_ms FROM placed)", 1)[1].lstrip().removeprefix(",")).replace(
    "cuts AS (SELECT * FROM wide UNION ALL SELECT * FROM pause)",
    """agwide AS (SELECT a.doc_id, a.text, 'restart' AS type, CASE WHEN coalesce(f.prev_end, 0) + 80 <= a.start_ms THEN coalesce(f.prev_end, 0) + 80 ELSE a.start_ms END AS start_ms, a.end_ms FROM again a JOIN flags f ON f.doc_id = a.doc_id AND f.pos = a.pos),
    cuts AS (SELECT * FROM wide UNION ALL SELECT * FROM pause UNION ALL SELECT * FROM agwide)""")
    + "SELECT doc_id, duration_ms, CAST(cuts AS BIGINT) AS cuts, CAST(removed_ms AS BIGINT) AS removed_ms, CAST(kept_ms AS BIGINT) AS kept_ms, kept_ms / CAST(duration_ms AS DOUBLE) AS keep_ratio, kept_ms / CAST(duration_ms AS DOUBLE) < 0.5::DOUBLE AS below_floor FROM totals")
def cut_by_transcript_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript cutter with restarts."""
    w = words(spark, sf_dir)
    return cut_by_transcript(w, files(spark, sf_dir), KEY, fillers=FILLERS, guarded=GUARDED, phrases=PHRASES)[2]


@query(_SQL + "SELECT doc_id, start_ms, end_ms, n_reasons, reasons FROM merged")
def cut_reasons_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = ops.merged_cuts(_raw(spark, sf_dir)[2], KEY)
    text = F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["type"], r["text"])), "|")
    return cuts.select(KEY, "start_ms", "end_ms", F.size("reasons").cast("long").alias("n_reasons"), text.alias("reasons"))


@query(_SQL + "SELECT doc_id, CAST(start_ms AS BIGINT) AS start_ms, end_ms FROM keep")
def keep_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f, cuts = _raw(spark, sf_dir)
    return intervals.complement(ops.merged_cuts(cuts, KEY), f, [KEY])


@query(_SQL + "SELECT * FROM (SELECT doc_id AS timeline, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms) - 1 AS idx, CAST(start_ms AS BIGINT) AS in_ms, end_ms AS out_ms FROM keep), (VALUES ('video'), ('audio')) AS k(kind)")
def transcript_edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f, cuts = _raw(spark, sf_dir)
    return edit_plan(intervals.complement(ops.merged_cuts(cuts, KEY), f, [KEY]), KEY)
