"""Queries over timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timecode as tc
from ..operators import timeline as ops
from ..sinks import interchange
from ..sources.views import CLIPS_SQL, MARKERS_SQL, clips, markers, read
from .registry import query

FPS = 24

_C = f"WITH {CLIPS_SQL}"
_TILED = _C + """, n AS (SELECT *, in_seconds * 24 AS src_in, greatest(1, seconds * 24) AS duration, CASE WHEN idx % 4 = 3 THEN in_seconds * 2400 END AS record FROM clips),
    s AS (SELECT *, count(record) OVER (PARTITION BY timeline, kind ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seg FROM n),
    tiled AS (SELECT *, CAST(coalesce(max(record) OVER (PARTITION BY timeline, kind, seg), 0) + coalesce(sum(duration) OVER (PARTITION BY timeline, kind, seg ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s)
"""


def _code(f: str) -> str:
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    return f"{two(f'({f}) // 86400 % 24')} || ':' || {two(f'({f}) // 1440 % 60')} || ':' || {two(f'({f}) // 24 % 60')} || ':' || {two(f'({f}) % 24')}"


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).withColumns({
        "in_ms": F.col("in_seconds") * 1000, "duration_ms": F.col("seconds") * 1000, "out_ms": F.lit(None).cast("long"),
        "record_ms": F.when(F.col("idx") % 4 == 3, F.col("in_seconds") * 100_000), "name": F.concat(F.lit("part "), F.col("path").cast("string")),
    })
    return ops.tile(ops.normalise(c, FPS))


@query(_TILED + ' SELECT timeline, idx, kind, duration, "offset" FROM tiled')
def clip_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir).select("timeline", "idx", "kind", "duration", "offset")


@query(_C + """, p AS (SELECT CAST(p_partkey AS BIGINT) AS path, p_partkey % 11 <> 0 AS ok, CASE p_size % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' ELSE 'other' END AS pk, CAST(p_size * 1000 AS BIGINT) AS ms FROM part),
    c AS (SELECT timeline, idx, kind, path, (in_seconds - 2) * 1000 AS in_ms, CASE WHEN idx % 5 <> 0 THEN seconds * 1000 END AS o FROM clips),
    j AS (SELECT c.*, p.ok, p.pk, p.ms, coalesce(o, ms, in_ms) AS out_ms FROM c LEFT JOIN p USING (path))
    SELECT timeline, idx, out_ms, array_to_string(list_filter([CASE WHEN NOT coalesce(ok, false) THEN 'unreadable media' END, CASE WHEN ok AND in_ms < 0 THEN 'in < 0' END, CASE WHEN ok AND out_ms <= in_ms AND pk <> 'image' THEN 'out <= in' END], lambda x: x IS NOT NULL), '|') AS errors,
    array_to_string(list_filter([CASE WHEN ok AND kind = 'video' AND pk NOT IN ('video', 'image') THEN 'expected video, media kind is ''' || pk || '''' END, CASE WHEN ok AND kind = 'audio' AND pk NOT IN ('audio', 'video') THEN 'expected audio, media kind is ''' || pk || '''' END,
      CASE WHEN ok AND out_ms - ms > 50 THEN 'out beyond media duration' END], lambda x: x IS NOT NULL), '|') AS warnings FROM j""")
def clip_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "video").when(size % 4 == 1, "audio").when(size % 4 == 2, "image").otherwise("other")
    probes = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("path"), (F.col("p_partkey") % 11 != 0).alias("ok"), kind.alias("kind"), (size * 1000).cast("long").alias("duration_ms"))
    c = clips(spark, sf_dir).withColumns({"in_ms": (F.col("in_seconds") - 2) * 1000, "out_ms": F.when(F.col("idx") % 5 != 0, F.col("seconds") * 1000)})
    return ops.validate(c, probes).select("timeline", "idx", "out_ms", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query("WITH m AS (SELECT o_orderkey AS k, CAST(o_orderkey AS BIGINT) * 37 % 100000 AS ms FROM orders) SELECT k, CASE WHEN ms = 0 THEN 0 ELSE greatest(1, CAST(round_even(ms * 24 / 1000.0::DOUBLE, 0) AS BIGINT)) END AS point, greatest(1, CAST(round_even(ms * 24 / 1000.0::DOUBLE, 0) AS BIGINT)) AS frames FROM m")
def seconds_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey").cast("long") * 37 % 100_000).alias("ms"))
    return m.select("k", tc.point_frames(F.col("ms"), FPS).alias("point"), tc.frames(F.col("ms"), FPS).alias("frames"))


@query(f"WITH m AS (SELECT o_orderkey AS k, CAST(o_orderkey AS BIGINT) * 977 AS f FROM orders) SELECT k, {_code('f')} AS timecode FROM m")
def timecode_edl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), tc.timecode(F.col("o_orderkey").cast("long") * 977, FPS).alias("timecode"))


@query(_TILED + f""", v AS (SELECT *, row_number() OVER (PARTITION BY timeline ORDER BY idx) AS event FROM tiled WHERE kind = 'video')
    SELECT timeline, event, lpad(CAST(event AS VARCHAR), 3, '0') || '  AX       V     C        ' || {_code('src_in')} || ' ' || {_code('src_in + duration')} || ' ' || {_code('"offset"')} || ' ' || {_code('"offset" + duration')} AS line, '* FROM CLIP NAME: part ' || path AS clip_line FROM v""")
def edl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.edl(_tiled(spark, sf_dir), FPS)


@query(f"WITH {MARKERS_SQL}, m AS (SELECT *, greatest(0, frame) AS f FROM markers) SELECT timeline, f AS frame, {_code('f')} AS timecode, printf('%.3f', f / 24.0::DOUBLE) AS seconds, name, 'Blue' AS color, '' AS note, CAST(1 AS BIGINT) AS duration FROM m")
def marker_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.marker_rows(markers(spark, sf_dir), FPS).select("timeline", "frame", "timecode", "seconds", "name", "color", "note", "duration")


@query(_TILED + f', {MARKERS_SQL} SELECT t.timeline, idx, kind, frame, name, src_in + frame - "offset" AS local FROM tiled t JOIN markers m ON m.timeline = t.timeline AND frame >= "offset" AND frame < "offset" + duration')
def marker_in_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = _tiled(spark, sf_dir).select("timeline", "idx", "kind", "src_in", "offset", "duration")
    return ops.clip_markers(tiled, markers(spark, sf_dir).drop("pos")).select("timeline", "idx", "kind", "frame", "name", "local")


@query(_C + ", f AS (SELECT timeline, path, min(idx) AS i FROM clips GROUP BY ALL) SELECT timeline, path, 'r' || (row_number() OVER (PARTITION BY timeline ORDER BY i) + 1) AS asset FROM f")
def asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.assets(clips(spark, sf_dir))


@query(_TILED + ' SELECT timeline, max("offset" + duration) AS total_frames, CAST(sum(CASE WHEN kind = \'video\' THEN duration ELSE 0 END) AS BIGINT) AS video_frames, CAST(sum(CASE WHEN kind = \'audio\' THEN duration ELSE 0 END) AS BIGINT) AS audio_frames FROM tiled GROUP BY timeline')
def timeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = _tiled(spark, sf_dir)
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("duration")).otherwise(0)).cast("long").alias(f"{k}_frames") for k in ("video", "audio")]
    return ops.total_frames(tiled).join(tiled.groupBy("timeline").agg(*by_kind), "timeline")


@query(_C + ", l AS (SELECT *, lag(kind) OVER (PARTITION BY timeline ORDER BY idx) AS b FROM clips) SELECT timeline, idx, kind FROM l WHERE kind IS DISTINCT FROM b")
def section_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.section_changes(clips(spark, sf_dir), ["timeline"], "idx", "kind").select("timeline", "idx", "kind")


@query(_C + """, c AS (SELECT timeline, idx, (in_seconds - 2) * 500 AS a, seconds * 100 AS b, CASE path % 4 WHEN 0 THEN 24.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE WHEN 2 THEN 30.0::DOUBLE END AS fps FROM clips),
    f AS (SELECT *, CAST(round_even(a * fps / 1000.0::DOUBLE, 0) AS BIGINT) AS s, CAST(round_even(b * fps / 1000.0::DOUBLE, 0) AS BIGINT) AS e FROM c)
    SELECT timeline, idx, coalesce(s, -1) AS start_frame, coalesce(e, -1) AS end_frame, CASE WHEN fps IS NULL THEN 'frame rate unknown' WHEN s < 0 THEN 'start_frame cannot be negative' WHEN e <= s THEN 'end_frame must be greater than start_frame' ELSE '' END AS error FROM f""")
def clip_seconds_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path") % 4
    none = F.lit(None).cast("long")
    c = clips(spark, sf_dir).withColumns({"in_ms": (F.col("in_seconds") - 2) * 500, "out_ms": F.col("seconds") * 100, "fps": F.when(p == 0, 24.0).when(p == 1, 25.0).when(p == 2, 30.0), "start_frame": none, "end_frame": none})
    return ops.clip_plan(c).select("timeline", "idx", "start_frame", "end_frame", "error").fillna(-1, ["start_frame", "end_frame"]).fillna("", ["error"])


@query(_TILED + " SELECT timeline, idx, CAST(src_in AS VARCHAR) || '/24s' AS start, CAST(duration AS VARCHAR) || '/24s' AS duration FROM tiled")
def rational_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir).select("timeline", "idx", tc.rational(F.col("src_in"), FPS).alias("start"), tc.rational(F.col("duration"), FPS).alias("duration"))


@query(_C + ", g AS (SELECT timeline, kind, CAST(sum(seconds * 1000) AS BIGINT) AS ms, count(*) AS clips FROM clips GROUP BY ALL) SELECT * FROM g")
def seconds_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).select("timeline", "kind", F.lit(0).cast("long").alias("in_ms"), (F.col("seconds") * 1000).alias("out_ms"))
    return ops.seconds_by_kind(c)


@query(_C + """, p AS (SELECT CAST(p_partkey AS BIGINT) AS path, p_size FROM part), probes AS (SELECT timeline, idx, coalesce(p_size, 24) AS fps FROM clips LEFT JOIN p USING (path)) SELECT * FROM probes""")
def source_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip with its source's rate, or the timeline's."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("path"), "p_size")
    return clips(spark, sf_dir).join(p, "path", "left").select("timeline", "idx", F.coalesce("p_size", F.lit(FPS)).alias("fps"))


def _snap_sql(c: str) -> str:
    low, high = f"{c} // 1700 * 1700", f"least({c} // 1700 * 1700 + 1700, hi // 1700 * 1700)"
    near = f"CASE WHEN {c} - {low} <= abs({high} - {c}) THEN {low} ELSE {high} END"
    return f"CASE WHEN abs({near} - {c}) <= 300 THEN {near} ELSE {c} END"


@query(_C + f""", c AS (SELECT timeline, idx, in_seconds * 1000 AS in_ms, (in_seconds + seconds) * 1000 AS out_ms, max((in_seconds + seconds) * 1000) OVER (PARTITION BY timeline) AS hi FROM clips)
    SELECT timeline, idx, {_snap_sql('in_ms')} AS in_ms, {_snap_sql('out_ms')} AS out_ms FROM c""")
def snapped_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In and out points snapped to a grid of 1.7 s within 300 ms."""
    c = clips(spark, sf_dir).select("timeline", "idx", (F.col("in_seconds") * 1000).alias("in_ms"), ((F.col("in_seconds") + F.col("seconds")) * 1000).alias("out_ms"))
    grid = c.groupBy("timeline").agg(F.max("out_ms").alias("hi")).select("timeline", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi"), F.lit(1700).cast("long"))).alias("t"))
    return ops.snap(c, grid, ["timeline"], ["in_ms", "out_ms"], 300)


_MARK = """'<marker start="' || (src_in + m.frame - c."offset") || '/24s" duration="1/24s" value="' || m.name || '" note="" />' || chr(10)"""
_CLIP = """'<asset-clip name="part ' || path || '" ref="' || asset || '" offset="' || {0} || '/24s" start="' || src_in || '/24s" duration="' || duration || '/24s"'"""


@query(_TILED + f""", {MARKERS_SQL}, us AS (SELECT timeline, path, min(idx) AS fi FROM tiled GROUP BY ALL), av AS (SELECT *, 'r' || (row_number() OVER (PARTITION BY timeline ORDER BY fi) + 1) AS asset FROM us),
    fv AS (SELECT timeline, min(idx) FILTER (kind = 'video') AS vi, min(struct_pack(i := idx, o := "offset")) FILTER (kind = 'video').o AS vo, max("offset" + duration) AS total FROM tiled GROUP BY timeline),
    c AS (SELECT t.*, asset, vi, vo, total, kind = 'audio' AND vi IS NOT NULL AS hangs FROM tiled t JOIN av USING (timeline, path) JOIN fv USING (timeline)),
    hd AS (SELECT c.timeline, c.idx, string_agg('              ' || {_MARK}, '' ORDER BY m.frame, m.name) AS own, string_agg('                ' || {_MARK}, '' ORDER BY m.frame, m.name) AS deep FROM c JOIN markers m ON m.timeline = c.timeline AND m.frame >= c."offset" AND m.frame < c."offset" + c.duration GROUP BY ALL),
    e AS (SELECT c.*, coalesce(own, '') AS own, coalesce(deep, '') AS deep FROM c LEFT JOIN hd USING (timeline, idx)),
    bl AS (SELECT timeline, string_agg('              ' || {_CLIP.format('greatest(0, "offset" - vo)')} || ' audioRole="dialogue" lane="-1"' || CASE WHEN deep = '' THEN ' />' || chr(10) ELSE '>' || chr(10) || deep || '              </asset-clip>' || chr(10) END, '' ORDER BY idx) AS below FROM e WHERE hangs GROUP BY timeline),
    sb AS (SELECT e.*, own || CASE WHEN idx = vi THEN coalesce(below, '') ELSE '' END AS body FROM e LEFT JOIN bl USING (timeline) WHERE NOT hangs),
    sp AS (SELECT timeline, string_agg('            ' || {_CLIP.format('"offset"')} || CASE WHEN kind = 'audio' THEN ' audioRole="music"' ELSE '' END || CASE WHEN body = '' THEN ' />' || chr(10) ELSE '>' || chr(10) || body || '            </asset-clip>' || chr(10) END, '' ORDER BY idx) AS spine FROM sb GROUP BY timeline),
    sa AS (SELECT timeline, string_agg('    <asset id="' || asset || '" name="' || path || '" src="file:///media/' || path || '.mov" start="0s" hasVideo="' || CASE WHEN kind = 'video' THEN '1" format="r1' ELSE '0' END || '" hasAudio="1" audioSources="1" audioChannels="2" audioRate="48000" />' || chr(10), '' ORDER BY fi) AS assets
           FROM av JOIN (SELECT timeline, idx AS fi, kind FROM tiled) k USING (timeline, fi) GROUP BY timeline)
    SELECT timeline, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<!DOCTYPE fcpxml>' || chr(10) || chr(10) || '<fcpxml version="1.9">' || chr(10) || '  <resources>' || chr(10)
      || '    <format id="r1" name="FFVideoFormat1080p24" frameDuration="1/24s" width="1920" height="1080" colorSpace="1-1-1 (Rec. 709)" />' || chr(10) || assets || '  </resources>' || chr(10) || '  <library>' || chr(10)
      || '    <event name="Timeline ' || timeline || '">' || chr(10) || '      <project name="Timeline ' || timeline || '">' || chr(10) || '        <sequence format="r1" duration="' || total || '/24s" tcStart="0s" tcFormat="NDF">' || chr(10)
      || '          <spine>' || chr(10) || spine || '          </spine>' || chr(10) || '        </sequence>' || chr(10) || '      </project>' || chr(10) || '    </event>' || chr(10) || '  </library>' || chr(10) || '</fcpxml>' || chr(10) AS content
    FROM fv JOIN sa USING (timeline) JOIN sp USING (timeline)""")
def fcpxml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each timeline."""
    tiled = _tiled(spark, sf_dir).withColumn("path", F.concat(F.lit("/media/"), F.col("path").cast("string"), F.lit(".mov")))
    return interchange.fcpxml(tiled, markers(spark, sf_dir), FPS)


@query(_C + """, p AS (SELECT CAST(p_partkey AS BIGINT) AS path, p_partkey % 11 <> 0 AS ok, CASE p_size % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' ELSE 'other' END AS pk, CAST(p_size * 1000 AS BIGINT) AS ms FROM part),
    j AS (SELECT timeline, idx, kind, ok, pk, ms, (in_seconds - 2) * 1000 AS a, coalesce(CASE WHEN idx % 5 <> 0 THEN seconds * 1000 END, ms, (in_seconds - 2) * 1000) AS b FROM clips LEFT JOIN p USING (path)),
    v AS (SELECT *, NOT coalesce(ok, false) OR a < 0 OR (b <= a AND pk <> 'image') AS bad, coalesce(ok, false) AND ((kind = 'video' AND pk NOT IN ('video', 'image')) OR (kind = 'audio' AND pk NOT IN ('audio', 'video'))) AS odd, coalesce(ok AND b - ms > 50, false) AS over FROM j),
    sn AS (SELECT *, a // 1700 * 1700 AS al, a // 1700 * 1700 + 1700 AS ah, b // 1700 * 1700 AS bl, b // 1700 * 1700 + 1700 AS bh FROM v),
    s2 AS (SELECT *, CASE WHEN a - al <= ah - a THEN al ELSE ah END AS an, CASE WHEN b - bl <= bh - b THEN bl ELSE bh END AS bn FROM sn),
    s3 AS (SELECT *, CASE WHEN abs(an - a) <= 300 THEN an ELSE a END AS a2, CASE WHEN abs(bn - b) <= 300 THEN bn ELSE b END AS b2 FROM s2)
    SELECT timeline, count(*) FILTER (bad) = 0 AS ok, count(*) FILTER (NOT bad AND kind = 'video') AS video, count(*) FILTER (NOT bad AND kind = 'audio') AS audio, CAST(sum(CAST(bad AND coalesce(ok, false) AS INTEGER) * (CAST(a < 0 AS INTEGER) + CAST(b <= a AND pk <> 'image' AS INTEGER)) + CAST(NOT coalesce(ok, false) AS INTEGER)) AS BIGINT) AS errors,
      CAST(sum(CAST(odd AS INTEGER) + CAST(over AS INTEGER)) AS BIGINT) AS warnings, CAST(coalesce(sum(CAST(a2 <> a AS INTEGER) + CAST(b2 <> b AS INTEGER)) FILTER (NOT bad), 0) AS BIGINT) AS snapped,
      CAST(coalesce(sum(b2 - a2) FILTER (NOT bad AND kind = 'video'), 0) AS BIGINT) AS video_ms, CAST(coalesce(sum(b2 - a2) FILTER (NOT bad AND kind = 'audio'), 0) AS BIGINT) AS audio_ms FROM s3 GROUP BY timeline""")
def assemble_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit plans checked, snapped to a grid of 1.7 s and summed up: one row a timeline."""
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "video").when(size % 4 == 1, "audio").when(size % 4 == 2, "image").otherwise("other")
    probes = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("path"), (F.col("p_partkey") % 11 != 0).alias("ok"), kind.alias("kind"), (size * 1000).cast("long").alias("duration_ms"))
    c = clips(spark, sf_dir).withColumns({"in_ms": (F.col("in_seconds") - 2) * 1000, "out_ms": F.when(F.col("idx") % 5 != 0, F.col("seconds") * 1000)})
    reach = F.greatest(F.max("in_ms"), F.max("out_ms"), F.lit(60_000)) + 3400
    grid = c.groupBy("timeline").agg(reach.alias("hi")).select("timeline", F.explode(F.sequence(F.lit(-1700).cast("long"), F.col("hi"), F.lit(1700).cast("long"))).alias("t"))
    return ops.assemble(c, probes, grid, 300)[1]


@query(_C + """, c AS (SELECT timeline, idx, kind, CASE WHEN idx % 2 = 0 THEN 1.5::DOUBLE END AS speed, CASE WHEN idx % 3 = 0 THEN -6.0::DOUBLE END AS gain_db FROM clips)
    SELECT timeline, idx, coalesce(CASE WHEN kind = 'video' THEN speed END, -1.0::DOUBLE) AS speed, coalesce(CASE WHEN kind = 'audio' THEN gain_db END, -1.0::DOUBLE) AS gain_db FROM c""")
def clip_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).withColumns({"speed": F.when(F.col("idx") % 2 == 0, 1.5), "gain_db": F.when(F.col("idx") % 3 == 0, -6.0)})
    return ops.options(c).select("timeline", "idx", "speed", "gain_db").fillna(-1.0, ["speed", "gain_db"])


@query(f"WITH {MARKERS_SQL}" + """, m AS (SELECT timeline, pos, CASE WHEN pos % 3 <> 0 THEN frame * 40 END AS time_ms, CASE WHEN pos % 2 = 0 THEN name END AS name, CASE WHEN pos % 5 = 0 THEN 'Red' END AS color FROM markers)
    SELECT timeline, time_ms, coalesce(name, 'Marker ' || (pos + 1)) AS name, coalesce(color, 'Blue') AS color, '' AS note FROM m WHERE time_ms IS NOT NULL""")
def marker_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir)
    m = m.select("timeline", "pos", F.when(F.col("pos") % 3 != 0, F.col("frame") * 40).alias("time_ms"), F.when(F.col("pos") % 2 == 0, F.col("name")).alias("name"), F.when(F.col("pos") % 5 == 0, "Red").alias("color"), F.lit(None).cast("string").alias("note"))
    return ops.normal_markers(m).select("timeline", "time_ms", "name", "color", "note")
