"""Times as integers: milliseconds and frames, and their notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_HOURS = 24


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def frames(ms: Column, fps: int) -> Column:
    """Milliseconds in frames, half-even as the float product rounds, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.bround(ms * F.lit(fps) / F.lit(1000.0)).cast("long"))


def point_frames(ms: Column, fps: int) -> Column:
    """As frames(), but zero stays zero."""
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(frames(ms, fps))


def rational(frame: Column, fps: int) -> Column:
    return F.concat(frame.cast("long").cast("string"), F.lit(f"/{fps}s"))


def timecode(frame: Column, fps: int) -> Column:
    """Non-drop HH:MM:SS:FF within a day; negative frames count as 0."""
    f = F.greatest(frame.cast("long"), F.lit(0).cast("long"))
    s = F.floor(f / fps).cast("long")
    return F.concat_ws(":", _two(F.floor(s / 3600).cast("long") % DAY_HOURS), _two(F.floor(s / 60).cast("long") % 60), _two(s % 60), _two(f % fps))


def caption_time(ms: Column, vtt: bool = False) -> Column:
    t = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    s = F.floor(t / 1000).cast("long")
    hours = F.floor(s / 3600).cast("long")
    hh = F.when(hours < 100, _two(hours)).otherwise(hours.cast("string"))
    clock = F.concat_ws(":", hh, _two(F.floor(s / 60).cast("long") % 60), _two(s % 60))
    return F.concat(clock, F.lit("." if vtt else ","), F.lpad((t % 1000).cast("string"), 3, "0"))


def chapter_time(ms: Column) -> Column:
    """MM:SS, with hours only where there are any; rounded half-even to seconds."""
    s = F.bround(ms / F.lit(1000.0)).cast("long")
    hours = F.floor(s / 3600).cast("long")
    short = F.concat_ws(":", _two(F.floor(s / 60).cast("long") % 60), _two(s % 60))
    return F.when(hours > 0, F.concat_ws(":", F.when(hours < 100, _two(hours)).otherwise(hours.cast("string")), short)).otherwise(short)


def fraction(value: Column) -> Column:
    """A number or `n/d` as double; null if it is neither or d is 0."""
    top, bottom = F.regexp_extract(value, r"^\s*([+-]?\d+)/(\d+)\s*$", 1), F.regexp_extract(value, r"^\s*([+-]?\d+)/(\d+)\s*$", 2)
    plain = F.trim(value).try_cast("double") if hasattr(value, "try_cast") else F.trim(value).cast("double")
    return F.when(top != "", F.try_divide(top.cast("double"), bottom.cast("double"))).otherwise(plain)


def resolution(value: Column) -> Column:
    """(width, height) of `WxH`; 1920 x 1080 if it is something else."""
    pattern = r"^\s*(\d+)\s*x\s*(\d+)\s*$"
    text = F.lower(F.coalesce(value, F.lit("")))
    fits = text.rlike(pattern)
    part = lambda i, d: F.when(fits, F.regexp_extract(text, pattern, i).cast("int")).otherwise(F.lit(d))
    return F.struct(part(1, 1920).alias("width"), part(2, 1080).alias("height"))
