"""Queries over media paths and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timecode as tc
from ..sources import media as ops
from ..sinks.interchange import file_uri
from ..sources.views import ONSETS_SQL, onsets, read
from .registry import query

_EXTS = "mov wav JPG txt Mp4 flac png mkv".split()

_P = "WITH paths AS (SELECT page_id AS k, '/media/' || (page_id % 17) || '/Take ' || page_id || CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '.{e}'" for i, e in enumerate(_EXTS)) + " ELSE '' END AS path FROM pages), "
_KIND = "CASE WHEN e IN ({}) THEN 'video' WHEN e IN ({}) THEN 'audio' WHEN e IN ({}) THEN 'image' ELSE 'other' END".format(*(", ".join(f"'{x}'" for x in v) for v in (ops.VIDEO, ops.AUDIO, ops.IMAGE)))
_K = _P + f"exts AS (SELECT *, lower(regexp_extract(path, '[^/.][^/]*\\.([^./]*)$', 1)) AS e FROM paths), kinds AS (SELECT *, {_KIND} AS kind FROM exts)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    ext = F.lit("")
    for i, e in enumerate(_EXTS):
        ext = F.when(F.col("page_id") % 9 == i, "." + e).otherwise(ext)
    return p.select(F.col("page_id").alias("k"), F.concat(F.lit("/media/"), (F.col("page_id") % 17).cast("string"), F.lit("/Take "), F.col("page_id").cast("string"), ext).alias("path"))


@query(_K + " SELECT k, path, e AS extension, kind FROM kinds")
def media_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ops.extension(F.col("path"))
    return _paths(spark, sf_dir).select("k", "path", e.alias("extension"), ops.kind_of(e).alias("kind"))


@query(_K + " SELECT kind, count(*) AS n FROM kinds GROUP BY kind")
def media_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_classify(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_K + " , v AS (SELECT path FROM kinds WHERE kind = 'video'), t AS (SELECT path FROM v ORDER BY lower(path), path LIMIT 40) SELECT path, (SELECT count(*) FROM v) AS found, greatest(0, (SELECT count(*) FROM v) - 40) AS skipped FROM t")
def scan_limit_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, report = ops.limit_files(media_classify(spark, sf_dir).where("kind = 'video'").select("path"), 40)
    return taken.crossJoin(F.broadcast(report))


@query("""WITH v AS (SELECT page_id AS k, CASE page_id % 5 WHEN 0 THEN (page_id * 1000) || '/1001' WHEN 1 THEN CAST(page_id AS VARCHAR) || '/0' WHEN 2 THEN CAST(page_id AS VARCHAR) || '.5' WHEN 3 THEN 'n/a' ELSE '25/1' END AS v FROM pages)
    SELECT k, v, round(coalesce(CASE WHEN regexp_matches(v, '^\\d+/\\d+$') THEN CASE WHEN split_part(v, '/', 2) = '0' THEN NULL ELSE CAST(split_part(v, '/', 1) AS DOUBLE) / CAST(split_part(v, '/', 2) AS DOUBLE) END ELSE TRY_CAST(v AS DOUBLE) END, -1.0::DOUBLE), 9) AS value FROM v""".replace("\\\\", "\\"))
def fraction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    s = k.cast("string")
    v = F.when(k % 5 == 0, F.concat((k * 1000).cast("string"), F.lit("/1001"))).when(k % 5 == 1, F.concat(s, F.lit("/0"))).when(k % 5 == 2, F.concat(s, F.lit(".5"))).when(k % 5 == 3, "n/a").otherwise("25/1")
    rows = read(spark, sf_dir, "pages").select(k.alias("k"), v.alias("v"))
    return rows.select("k", "v", F.round(F.coalesce(tc.fraction(F.col("v")), F.lit(-1.0)), 9).alias("value"))


@query(_P + r"s AS (SELECT k, regexp_extract(path, '([^/]*)/*$', 1) AS name FROM paths) SELECT k, name, regexp_replace(name, '^(.+)\.[^.]*$', '\1') AS stem, trim(regexp_replace(name, '[^\p{L}\p{N}_-]', '_', 'g'), '_') AS safe FROM s")
def path_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("k", ops.name(p).alias("name"), ops.stem(p).alias("stem"), ops.safe_stem(ops.name(p)).alias("safe"))


_USABLE = "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS path, CASE WHEN p_partkey % 3 <> 0 THEN 'video' ELSE 'audio' END AS kind, p_size / 10.0::DOUBLE AS d, p_partkey % 7 <> 0 AS ok FROM part) "


@query(_USABLE + "SELECT path, round(greatest(0.25::DOUBLE + 1.0::DOUBLE / 24.0::DOUBLE, d - 0.25::DOUBLE), 9) AS usable_end, round(greatest(0.25::DOUBLE + 1.0::DOUBLE / 24.0::DOUBLE, d - 0.25::DOUBLE) - 0.25::DOUBLE, 9) AS usable_len FROM p WHERE ok AND kind = 'video' AND d > 0.5::DOUBLE")
def media_usable_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("path"), F.when(F.col("p_partkey") % 3 != 0, "video").otherwise("audio").alias("kind"), (F.col("p_size") / F.lit(10.0)).alias("duration_seconds"), (F.col("p_partkey") % 7 != 0).alias("ok"))
    return ops.usable_footage(probes).select("path", F.round("usable_end", 9).alias("usable_end"), F.round("usable_len", 9).alias("usable_len"))


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 10 <> 0 AS ok, p_size % 3 = 0 AS audio, CAST(p_size AS VARCHAR) AS size FROM part)
    SELECT '/m/' || k || '.mov' AS path, k || '.mov' AS name, k AS stem, 'mov' AS extension, ok, CASE WHEN NOT ok THEN 'other' WHEN audio THEN 'audio' ELSE 'video' END AS kind, CASE WHEN ok THEN CAST(size || '.5' AS DOUBLE) ELSE -1.0::DOUBLE END AS duration_seconds,
           CASE WHEN ok THEN 'mov' ELSE '' END AS container, CAST(-1 AS BIGINT) AS bit_rate, CASE WHEN ok AND NOT audio THEN 1920 ELSE -1 END AS width, CASE WHEN ok AND NOT audio THEN 1080 ELSE -1 END AS height, CASE WHEN ok AND NOT audio THEN '1920x1080' ELSE '' END AS resolution,
           CASE WHEN ok AND NOT audio THEN 30000.0::DOUBLE / 1001.0::DOUBLE ELSE -1.0::DOUBLE END AS fps, CASE WHEN ok AND NOT audio THEN 'h264' ELSE '' END AS video_codec, '' AS pix_fmt, CASE WHEN ok AND audio THEN 'aac' ELSE '' END AS audio_codec,
           CASE WHEN ok AND audio THEN 2 ELSE -1 END AS audio_channels, CASE WHEN ok AND audio THEN 48000 ELSE -1 END AS audio_sample_rate, CASE WHEN ok AND audio THEN 1 ELSE 0 END AS audio_streams, CASE WHEN ok AND NOT audio THEN '01:00:00:00' ELSE '' END AS timecode FROM p""")
def probe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe documents made from parts, parsed and flattened."""
    size = F.col("p_size").cast("string")
    stream = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"codec_type":"audio","codec_name":"aac","channels":2,"sample_rate":"48000","duration":"'), size, F.lit('"}')))
    stream = stream.otherwise(F.lit('{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"30000/1001","tags":{"timecode":"01:00:00:00"}}'))
    json = F.when(F.col("p_partkey") % 10 == 0, F.lit("broken")).otherwise(F.concat(F.lit('{"format":{"duration":"'), size, F.lit('.5","format_name":"mov"},"streams":['), stream, F.lit("]}")))
    return ops.probe(read(spark, sf_dir, "part").select(F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"), F.lit(".mov")).alias("path"), json.alias("json"))).fillna(-1).fillna("")


@query("SELECT CAST(-p_partkey AS BIGINT) AS pos, '/m/' || p_partkey || '.mov' AS path, p_partkey % 10 <> 0 AS ok, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size || '.5' AS DOUBLE) ELSE -1.0::DOUBLE END AS duration_seconds FROM part")
def probe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all parts in reverse order; a tenth has none."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("/m/"), k.cast("string"), F.lit(".mov"))
    parts = read(spark, sf_dir, "part")
    json = F.concat(F.lit('{"format":{"duration":"'), F.col("p_size").cast("string"), F.lit('.5"},"streams":[]}'))
    found = ops.probe(parts.where(k % 10 != 0).select(path.alias("path"), json.alias("json"))).select("path", "ok", "duration_seconds")
    asked = parts.select((-k).cast("long").alias("pos"), path.alias("path"))
    return ops.probe_in_order(spark, asked, found).select("pos", "path", "ok", F.coalesce("duration_seconds", F.lit(-1.0)).alias("duration_seconds"))


_REL = f"WITH {ONSETS_SQL}, r AS (SELECT track, i, t - min(t) OVER (PARTITION BY track) AS t, max(t) OVER (PARTITION BY track) - min(t) OVER (PARTITION BY track) + 1000 AS d FROM onsets)"


def _relative(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Onsets from their track's first on, and the tracks' durations."""
    o = onsets(spark, sf_dir)
    first = o.groupBy("track").agg(F.min("t").alias("lo"), (F.max("t") - F.min("t") + 1000).alias("duration_ms"))
    return o.join(first, "track").select("track", "i", (F.col("t") - F.col("lo")).alias("t")), first.select("track", "duration_ms")


@query(_REL + ", n AS (SELECT *, lead(t) OVER (PARTITION BY track ORDER BY i) AS nt FROM r) SELECT track, t AS start_ms, coalesce(nt, d) AS end_ms FROM n WHERE i % 2 = 1")
def silence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector lines made of onsets, by turns a start and an end, read back."""
    o, spans = _relative(spark, sf_dir)
    seconds = (F.col("t") / F.lit(1000.0)).cast("decimal(20,3)").cast("string")
    line = F.when(F.col("i") % 2 == 1, F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), seconds)).otherwise(F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), seconds, F.lit(" | silence_duration: 1")))
    return ops.silences(o.select("track", F.col("i").alias("n"), line.alias("line")), spans, "track")


@query("""SELECT o_custkey AS file, coalesce(max(CASE WHEN o_orderkey % 2 = 0 THEN -(o_orderkey % 500) / 10.0::DOUBLE END), -30.0::DOUBLE) AS mean_db, coalesce(max(CASE WHEN o_orderkey % 2 = 1 THEN -(o_orderkey % 300) / 10.0::DOUBLE END), 0.0::DOUBLE) AS max_db FROM orders GROUP BY o_custkey""")
def volume_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.when(k % 2 == 0, F.concat(F.lit("mean_volume: "), (-(k % 500) / F.lit(10.0)).cast("string"), F.lit(" dB"))).otherwise(F.concat(F.lit("max_volume: "), (-(k % 300) / F.lit(10.0)).cast("string"), F.lit(" dB")))
    out = ops.volumes(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), line.alias("line")))
    return out.select("file", (F.col("mean_db") + F.lit(0.0)).alias("mean_db"), (F.col("max_db") + F.lit(0.0)).alias("max_db"))


@query("""SELECT o_orderkey AS file, -(o_orderkey % 400 + 1) / 10.0::DOUBLE AS integrated_lufs, CASE WHEN o_orderkey % 3 = 0 THEN -1.0::DOUBLE ELSE (o_orderkey % 90) / 10.0::DOUBLE END AS loudness_range_lu,
    CASE WHEN o_orderkey % 5 = 0 THEN -99.0::DOUBLE ELSE -(o_orderkey % 30 + 1) / 10.0::DOUBLE END AS true_peak_dbtp, -70.0::DOUBLE AS threshold_lufs FROM orders""")
def loudness_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that ends a log: some values are missing, some infinite."""
    k = F.col("o_orderkey")
    tenth = lambda c: (c / F.lit(10.0)).cast("string")
    lra = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"input_lra" : "'), tenth(k % 90), F.lit('", ')))
    peak = F.when(k % 5 == 0, F.lit("-inf")).otherwise(tenth(-(k % 30 + 1)))
    text = F.concat(F.lit('frame {x}\n[loudnorm]\n{ "input_i" : "'), tenth(-(k % 400 + 1)), F.lit('", '), lra, F.lit('"input_tp" : "'), peak, F.lit('", "input_thresh" : "-70.0" }\n'))
    out = ops.loudness(read(spark, sf_dir, "orders").select(k.alias("file"), text.alias("text")))
    return out.fillna(-1.0, ["loudness_range_lu"]).fillna(-99.0, ["true_peak_dbtp"])


@query("""SELECT page_id AS k, CASE page_id % 4 WHEN 0 THEN CAST(page_id AS INTEGER) WHEN 1 THEN 640 ELSE 1920 END AS width, CASE page_id % 4 WHEN 0 THEN 480 WHEN 1 THEN CAST(page_id AS INTEGER) ELSE 1080 END AS height FROM pages""")
def resolution_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    value = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("x480"))).when(k % 4 == 1, F.concat(F.lit(" 640 X "), k.cast("string"))).when(k % 4 == 2, "wide")
    return read(spark, sf_dir, "pages").select(k.alias("k"), tc.resolution(value).alias("r")).select("k", "r.width", "r.height")


@query(_P + "u AS (SELECT k, 'file://' || replace(path, ' ', '%20') AS uri FROM paths) SELECT k, uri FROM u")
def file_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("k", file_uri(F.col("path")).alias("uri"))


@query(_REL + ", g AS (SELECT track, t, d, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS share FROM r) SELECT track, share, coalesce(min(CASE WHEN t >= share * d THEN t END), max(t)) AS t FROM g GROUP BY track, share")
def frame_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets as frames, sampled at a quarter, a half and three quarters of each track."""
    o, spans = _relative(spark, sf_dir)
    return ops.sampled_frames(o, spans.withColumnRenamed("duration_ms", "duration"), "track").withColumnRenamed("at", "share")
