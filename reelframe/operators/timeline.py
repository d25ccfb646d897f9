"""Timelines: clip validation, snapping, tiling, frames, markers in clips, assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timecode as tc
from . import intervals


def flags(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in the given order."""
    texts = [F.when(F.coalesce(c, F.lit(False)), t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]
    return F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")


def validate(clips: DataFrame, probes: DataFrame) -> DataFrame:
    """clips (path, kind, in_ms, out_ms) with out_ms filled in, errors and warnings; probes: path, ok, kind, duration_ms.

    One row per distinct path is joined, so a path that many clips use is probed once.
    """
    p = probes.select(F.col("path"), F.col("ok").alias("p_ok"), F.col("kind").alias("p_kind"), F.col("duration_ms").alias("p_ms")).dropDuplicates(["path"])
    rows = clips.join(p, "path", "left").withColumn("in_ms", F.coalesce("in_ms", F.lit(0).cast("long")))
    no_path = F.col("path").isNull() | (F.col("path").cast("string") == "")
    bad = ~no_path & ~F.coalesce("p_ok", F.lit(False))
    fine = ~no_path & ~bad
    out = F.coalesce("out_ms", F.when(F.coalesce("p_ms", F.lit(0)) != 0, F.col("p_ms")), F.col("in_ms"))
    rows = rows.withColumn("out_ms", out)
    errors = flags(
        (no_path, "clip missing 'path'"), (bad, "unreadable media"), (fine & (F.col("in_ms") < 0), "in < 0"),
        (fine & (F.col("out_ms") <= F.col("in_ms")) & (F.col("p_kind") != "image"), "out <= in"),
    )
    warnings = flags(
        (fine & (F.col("kind") == "video") & ~F.col("p_kind").isin("video", "image"), F.concat(F.lit("expected video, media kind is '"), "p_kind", F.lit("'"))),
        (fine & (F.col("kind") == "audio") & ~F.col("p_kind").isin("audio", "video"), F.concat(F.lit("expected audio, media kind is '"), "p_kind", F.lit("'"))),
        (fine & (F.col("out_ms") - F.col("p_ms") > 50), "out beyond media duration"),
    )
    return rows.withColumns({"errors": errors, "warnings": warnings}).drop("p_ok", "p_kind", "p_ms")


def usable(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0)


def options(clips: DataFrame) -> DataFrame:
    """Speed stays for video only; gain and fades for audio only."""
    keep = {"speed": "video", "gain_db": "audio", "fade_in": "audio", "fade_out": "audio"}
    return clips.withColumns({c: F.when(F.col("kind") == k, F.col(c)) for c, k in keep.items() if c in clips.columns})


def normal_markers(markers: DataFrame) -> DataFrame:
    """Markers (pos from 0, time_ms, name, color, note) with defaults; those without a time go."""
    return markers.where("time_ms is not null").withColumns({
        "name": F.coalesce("name", F.concat(F.lit("Marker "), (F.col("pos") + 1).cast("string"))), "color": F.coalesce("color", F.lit("Blue")), "note": F.coalesce("note", F.lit("")),
    })


def resolve_grid(spark: SparkSession, grid: Sequence[float] | DataFrame, key: str = "timeline", value: object = None) -> DataFrame:
    """The snapping grid (key, t in ms) of a plan: times in seconds given inline, for the timeline named by value, or an analysed grid (key, t, ...) as it is."""
    if isinstance(grid, DataFrame):
        return grid.select(key, "t")
    times = spark.createDataFrame([(round(float(x) * 1000),) for x in grid], "t long")
    return times.select(F.lit(value).alias(key), "t")


def snap(rows: DataFrame, grid: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance_ms: int = 50) -> DataFrame:
    """rows with each field moved to the nearest grid time (keys, t) within the tolerance."""
    for f in fields:
        found = intervals.nearest(rows, grid, keys, f, tolerance=tolerance_ms)
        rows = found.withColumn(f, F.coalesce("nearest", f)).drop("nearest")
    return rows


def assemble(clips: DataFrame, probes: DataFrame, grid: DataFrame | None = None, tolerance_ms: int = 50, keys: Sequence[str] = ("timeline",)) -> tuple[DataFrame, DataFrame]:
    """(clips that can be used, totals): clips checked, their options cleaned, their points snapped to a grid (keys, t).

    totals: keys, ok (no error), video and audio (clips), errors, warnings, snapped (points), video_ms, audio_ms.
    """
    checked = options(validate(clips, probes))
    rows = checked.withColumns({"from_": F.col("in_ms"), "to_": F.col("out_ms")})
    rows = rows if grid is None else snap(rows, grid, keys, ["in_ms", "out_ms"], tolerance_ms)
    good = F.size("errors") == 0
    of = lambda kind: good & (F.col("kind") == kind)
    length = F.col("out_ms") - F.col("in_ms")
    moved = (F.col("in_ms") != F.col("from_")).cast("long") + (F.col("out_ms") != F.col("to_")).cast("long")
    total = lambda which, x: F.coalesce(F.sum(F.when(which, x)), F.lit(0)).cast("long")
    totals = rows.groupBy(*keys).agg(
        F.bool_and(good).alias("ok"), F.count_if(of("video")).alias("video"), F.count_if(of("audio")).alias("audio"), F.sum(F.size("errors")).cast("long").alias("errors"), F.sum(F.size("warnings")).cast("long").alias("warnings"),
        total(good, moved).alias("snapped"), total(of("video"), length).alias("video_ms"), total(of("audio"), length).alias("audio_ms"),
    )
    return usable(rows).drop("from_", "to_"), totals


def normalise(clips: DataFrame, fps: int, default_s: float = 5.0) -> DataFrame:
    """Interchange clips in frames: clips (timeline, idx, path, kind, in_ms, out_ms, duration_ms, record_ms, ...).

    duration = duration_ms, else out - in, else the default; rows whose duration is not positive or whose
    in-point is negative get an error instead.  Images count as video.
    """
    in_ms = F.coalesce("in_ms", F.lit(0).cast("long"))
    duration = F.coalesce("duration_ms", F.col("out_ms") - in_ms, F.lit(int(default_s * 1000)).cast("long"))
    error = F.when(F.coalesce(F.trim(F.col("path").cast("string")), F.lit("")) == "", "missing a path").when(in_ms < 0, "in_seconds cannot be negative").when(duration <= 0, "resolves to a non-positive duration")
    return clips.withColumns({
        "kind": F.when(F.col("kind") == "audio", "audio").otherwise("video"), "src_in": tc.point_frames(in_ms, fps), "duration": tc.frames(duration, fps),
        "record": F.when(F.col("record_ms").isNotNull(), tc.point_frames(F.col("record_ms"), fps)), "error": error,
    })


def tile(clips: DataFrame, keys: Sequence[str] = ("timeline", "kind"), order: str = "idx") -> DataFrame:
    """clips (duration, record or null) with offset: each follows the one before on its track, a record resets the cursor."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    part = [*keys, "seg_"]
    before = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = clips.withColumn("seg_", F.count("record").over(w)).withColumn("base_", F.coalesce(F.max("record").over(W.partitionBy(*part)), F.lit(0)))
    return rows.withColumn("offset", (F.col("base_") + F.coalesce(F.sum("duration").over(before), F.lit(0))).cast("long")).drop("seg_", "base_")


def total_frames(tiled: DataFrame, keys: Sequence[str] = ("timeline",)) -> DataFrame:
    return tiled.groupBy(*keys).agg(F.coalesce(F.max(F.col("offset") + F.col("duration")), F.lit(1)).cast("long").alias("total_frames"))


def clip_markers(tiled: DataFrame, markers: DataFrame, keys: Sequence[str] = ("timeline",)) -> DataFrame:
    """Every (clip, marker) with offset <= frame < offset + duration, and local: the marker's frame in the source.

    A marker column that clips have too becomes marker_<name>.
    """
    markers = markers.withColumnsRenamed({c: "marker_" + c for c in markers.columns if c in tiled.columns and c not in keys})
    spans = tiled.withColumn("stop_", F.col("offset") + F.col("duration"))
    found = intervals.points_in(markers, spans, keys, "frame", "offset", "stop_")
    return found.withColumn("local", F.col("src_in") + F.col("frame") - F.col("offset")).drop("stop_")


def assets(clips: DataFrame, keys: Sequence[str] = ("timeline",)) -> DataFrame:
    """keys, path, asset: r2, r3, ... in the order of first use."""
    first = clips.groupBy(*keys, "path").agg(F.min("idx").alias("first_"))
    return first.select(*keys, "path", F.concat(F.lit("r"), (F.row_number().over(W.partitionBy(*keys).orderBy("first_")) + 1).cast("string")).alias("asset"))


def edl(tiled: DataFrame, fps: int, key: str = "timeline") -> DataFrame:
    """key, event, line, clip_line of the video clips, by idx."""
    video = tiled.where("kind = 'video'").withColumn("event", F.row_number().over(W.partitionBy(key).orderBy("idx")).cast("long"))
    codes = [tc.timecode(c, fps) for c in (F.col("src_in"), F.col("src_in") + F.col("duration"), F.col("offset"), F.col("offset") + F.col("duration"))]
    number = F.when(F.col("event") < 1000, F.lpad(F.col("event").cast("string"), 3, "0")).otherwise(F.col("event").cast("string"))
    line = F.concat(number, F.lit("  AX       V     C        "), F.concat_ws(" ", *codes))
    return video.select(key, "event", line.alias("line"), F.concat(F.lit("* FROM CLIP NAME: "), F.col("name").cast("string")).alias("clip_line"))


def marker_rows(markers: DataFrame, fps: int) -> DataFrame:
    """The marker manifest: frame, timecode, seconds, name, color, note, duration, in the order of `number`."""
    frame = F.greatest(F.lit(0).cast("long"), F.coalesce("frame", F.lit(0).cast("long")))
    default = {"name": "Marker", "color": "Blue", "note": ""}
    rows = markers.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in markers.columns else F.lit(v) for c, v in default.items()})
    rows = rows.withColumn("duration", F.coalesce(F.col("duration"), F.lit(1)).cast("long") if "duration" in markers.columns else F.lit(1).cast("long"))
    seconds = F.format_string("%.3f", frame / F.lit(float(fps)))
    return rows.withColumns({"sort_frame": F.coalesce("frame", F.lit(0).cast("long")), "timecode": tc.timecode(frame, fps), "seconds": seconds}).withColumn("frame", frame)


def section_changes(rows: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """Rows where the label differs from the row before, the first included."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("b_", F.lag(label).over(w)).withColumn("n_", F.row_number().over(w)).where(~F.col(label).eqNullSafe(F.col("b_")) | (F.col("n_") == 1)).drop("b_", "n_")


def clip_plan(clips: DataFrame) -> DataFrame:
    """Live clip plans: seconds become frames at the clip's own rate; error says what can't be placed.

    clips: path, start_frame, end_frame, in_ms, out_ms, fps.
    """
    by_time = F.col("in_ms").isNotNull() | F.col("out_ms").isNotNull()
    at = lambda c: F.bround(F.col(c) * F.col("fps") / F.lit(1000.0)).cast("long")
    start = F.coalesce(F.when(F.col("in_ms").isNotNull(), at("in_ms")), F.col("start_frame"), F.lit(0).cast("long"))
    end = F.coalesce(F.when(F.col("out_ms").isNotNull(), at("out_ms")), F.col("end_frame"))
    no_rate = by_time & (F.coalesce("fps", F.lit(0.0)) <= 0)
    error = F.when(no_rate, "frame rate unknown").when(start < 0, "start_frame cannot be negative").when(end <= start, "end_frame must be greater than start_frame")
    return clips.withColumns({"start_frame": F.when(~no_rate, start), "end_frame": F.when(~no_rate, end), "error": error})


def seconds_by_kind(clips: DataFrame, keys: Sequence[str] = ("timeline",)) -> DataFrame:
    return clips.groupBy(*keys, "kind").agg(F.sum(F.col("out_ms") - F.col("in_ms")).alias("ms"), F.count(F.lit(1)).alias("clips"))
