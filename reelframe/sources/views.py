"""Canonical views of the tables: words, onsets, beats, clips, markers, pixels and so on.

Each view has a twin in SQL so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm, tokens

#: Milliseconds: a character, the pause after a sentence, a clause, another word.
PER_CHAR, SENTENCE, CLAUSE, PLAIN = 60, 1500, 700, 50


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, word, norm, start_ms, end_ms."""
    out = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    out = out.withColumn("pos", F.col("pos").cast("long"))  # before the first sort, so that later ones can use it
    length = F.lit(PER_CHAR) * F.length("word")
    gap = F.when(F.col("word").rlike(r"[.!?]$"), SENTENCE).when(F.col("word").rlike(r"[,;:]$"), CLAUSE).otherwise(PLAIN)
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length + gap).over(before), F.lit(0)).cast("long")
    return out.select("doc_id", "pos", "word", norm(F.col("word")).alias("norm"), start.alias("start_ms"), (start + length).cast("long").alias("end_ms"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, word, length_ms, step_ms (to the next word's start): the words of `words` without the sums, so without a shuffle.

    Each row's words come together and in order.
    """
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    last = F.right("word", F.lit(1))
    gap = F.when(last.isin(*".!?"), SENTENCE).when(last.isin(*",;:"), CLAUSE).otherwise(PLAIN)
    length = (F.lit(PER_CHAR) * F.char_length("word")).cast("long")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "word", length.alias("length_ms"), (length + gap).alias("step_ms"))


def files(spark: SparkSession, sf_dir: str, tail_ms: int = 800) -> DataFrame:
    """doc_id, duration_ms: the end of the last word and a tail, from each row's own tokens, so without a shuffle."""
    gap = lambda w: F.when(w.rlike(r"[.!?]$"), SENTENCE).when(w.rlike(r"[,;:]$"), CLAUSE).otherwise(PLAIN)
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", tokens(F.col("text")).alias("w"))
    spoken = F.aggregate("w", F.lit(0).cast("long"), lambda s, w: s + F.lit(PER_CHAR) * F.length(w) + gap(w))
    return rows.select("doc_id", (spoken - gap(F.element_at("w", -1)) + tail_ms).cast("long").alias("duration_ms"))


WORDS_SQL = r"""
tok AS (SELECT doc_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos
        FROM (SELECT doc_id, regexp_split_to_array(trim(text), '\s+') AS w FROM documents)),
timed AS (SELECT *, 60 * length(word) AS dur, CASE WHEN regexp_matches(word, '[.!?]$') THEN 1500 WHEN regexp_matches(word, '[,;:]$') THEN 700 ELSE 50 END AS gap FROM tok),
placed AS (SELECT doc_id, pos, word, dur, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM timed),
words AS (SELECT doc_id, pos, word, regexp_replace(lower(trim(word)), '^[^\p{L}\p{N}_'']+|[^\p{L}\p{N}_'']+$', '', 'g') AS norm, start_ms, CAST(start_ms + dur AS BIGINT) AS end_ms FROM placed)
"""


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, i (order of time, then event), t (ms), strength, kind."""
    e = read(spark, sf_dir, "events")
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("track"), F.row_number().over(order).cast("long").alias("i"), t.alias("t"), F.col("value").alias("strength"), F.col("event_type").alias("kind"))


ONSETS_SQL = """
onsets AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t, value AS strength, event_type AS kind FROM events)
"""

BEAT_MS = 6 * 3600 * 1000


def beats(spark: SparkSession, sf_dir: str, period_ms: int = BEAT_MS) -> DataFrame:
    """track, i (from 0), t: a regular grid from a track's first onset to its last."""
    span = onsets(spark, sf_dir).groupBy("track").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return span.select("track", F.posexplode(F.sequence("lo", "hi", F.lit(period_ms).cast("long"))).alias("i", "t")).withColumn("i", F.col("i").cast("long"))


BEATS_SQL = f"""
span AS (SELECT track, min(t) AS lo, max(t) AS hi FROM onsets GROUP BY track),
beats AS (SELECT track, CAST((unnest(generate_series(lo, hi, {BEAT_MS})) - lo) / {BEAT_MS} AS BIGINT) AS i, unnest(generate_series(lo, hi, {BEAT_MS})) AS t FROM span)
"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timeline, idx (from 0), path, kind, seconds (whole), in_seconds."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("timeline"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("l_partkey").cast("long").alias("path"),
        F.when(F.col("l_linenumber") % 3 == 0, "audio").otherwise("video").alias("kind"), F.col("l_quantity").cast("long").alias("seconds"), F.col("l_linenumber").cast("long").alias("in_seconds"),
    )


CLIPS_SQL = """
clips AS (SELECT l_orderkey AS timeline, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS idx,
          CAST(l_partkey AS BIGINT) AS path, CASE WHEN l_linenumber % 3 = 0 THEN 'audio' ELSE 'video' END AS kind, CAST(l_quantity AS BIGINT) AS seconds, CAST(l_linenumber AS BIGINT) AS in_seconds FROM lineitem)
"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timeline, pos, frame, name: one marker an order, from its date and priority."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("timeline"), F.col("o_orderkey").cast("long").alias("pos"), (day % 3000 - 60).cast("long").alias("frame"), F.col("o_orderpriority").alias("name"))


MARKERS_SQL = """
markers AS (SELECT o_orderkey AS timeline, CAST(o_orderkey AS BIGINT) AS pos, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 3000 - 60 AS BIGINT) AS frame, o_orderpriority AS name FROM orders)
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, r, g, b (0 to 1)."""
    one = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    q, d, t = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    return read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("frame"), one(q / 50.0).alias("r"), one(d * 10.0).alias("g"), one(t * 12.5).alias("b"))


PIXELS_SQL = """
pixels AS (SELECT l_returnflag || l_linestatus AS frame, least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity::DOUBLE / 50.0::DOUBLE)) AS r,
           least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_discount::DOUBLE * 10.0::DOUBLE)) AS g, least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_tax::DOUBLE * 12.5::DOUBLE)) AS b FROM lineitem)
"""


FRAME_SIDE = 10


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, y, x, r, g, b (0 to 1): parts as square frames, slopes of light with some noise; only whole frames."""
    k, area = F.col("p_partkey").cast("long"), FRAME_SIDE**2
    no, place = F.floor(k / area), k % area
    y, x = F.floor(place / FRAME_SIDE).cast("long"), place % FRAME_SIDE
    base = (x + y) / F.lit(2.0 * FRAME_SIDE)
    rgb = (base * 0.8 + F.col("p_size") / 500.0, base * 0.7 + no % 5 / 10.0, base * 0.5 + k % 7 / 200.0 + no % 3 / 5.0)
    one = lambda c: F.least(F.lit(1.0), c)
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("f"), no.cast("string")).alias("frame"), y.alias("y"), x.alias("x"), *(one(c).alias(n) for c, n in zip(rgb, "rgb", strict=True)))
    return rows.join(rows.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == area).select("frame"), "frame", "left_semi")


FRAMES_SQL = f"""
cut AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_size, k // {FRAME_SIDE**2} AS no, k % {FRAME_SIDE**2} // {FRAME_SIDE} AS y, k % {FRAME_SIDE} AS x, (k % {FRAME_SIDE} + k % {FRAME_SIDE**2} // {FRAME_SIDE}) / {2.0 * FRAME_SIDE}::DOUBLE AS base FROM part),
frames AS (SELECT 'f' || no AS frame, y, x, least(1.0::DOUBLE, base * 0.8::DOUBLE + p_size / 500.0::DOUBLE) AS r, least(1.0::DOUBLE, base * 0.7::DOUBLE + no % 5 / 10.0::DOUBLE) AS g,
           least(1.0::DOUBLE, base * 0.5::DOUBLE + k % 7 / 200.0::DOUBLE + no % 3 / 5.0::DOUBLE) AS b FROM cut WHERE no IN (SELECT no FROM cut GROUP BY no HAVING count(*) = {FRAME_SIDE**2}))
"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, integrated, true_peak, lra: whole thousandths of a unit, mapped from orders; some are null."""
    o = read(spark, sf_dir, "orders")
    price = F.floor(F.col("o_totalprice").cast("double")).cast("long")
    return o.select(
        F.col("o_orderkey").cast("long").alias("path"), F.when(price % 13 != 0, -(price % 20000) - 10000).alias("integrated"),
        F.when(price % 7 != 0, price % 5000 - 4500).alias("true_peak"), F.when(price % 5 != 0, price % 30000).alias("lra"),
    )


MEASURES_SQL = """
priced AS (SELECT o_orderkey, CAST(floor(o_totalprice::DOUBLE) AS BIGINT) AS p FROM orders),
measures AS (SELECT CAST(o_orderkey AS BIGINT) AS path, CASE WHEN p % 13 <> 0 THEN -(p % 20000) - 10000 END AS integrated,
             CASE WHEN p % 7 <> 0 THEN p % 5000 - 4500 END AS true_peak, CASE WHEN p % 5 <> 0 THEN p % 30000 END AS lra FROM priced)
"""
