import json
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.operators import timeline as ops
from reelframe.sinks import interchange
from reelframe.sources import media

CLIP = "timeline string, idx long, path string, kind string, in_ms long, out_ms long, duration_ms long, record_ms long, name string"


def clips(spark, *rows):
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], CLIP)


def tiled(spark):
    return ops.tile(ops.normalise(clips(
        spark, ("/m/a b.mov", "video", 0, 1000, None, None, "a"), ("/m/x.wav", "audio", None, None, 2000, None, "x"), ("/m/c.png", "image", 10, None, None, 10_000, "c"), ("/m/a b.mov", "video", 500, 1500, None, None, "a2"),
    ), 24))


def test_tiling_and_frames(spark):
    got = {r.idx: (r.kind, r.src_in, r.duration, r.offset) for r in tiled(spark).collect()}
    assert got == {0: ("video", 0, 24, 0), 1: ("audio", 0, 48, 0), 2: ("video", 1, 120, 240), 3: ("video", 12, 24, 360)}
    assert ops.total_frames(tiled(spark)).first().total_frames == 384
    assert {r.path: r.asset for r in ops.assets(tiled(spark)).collect()} == {"/m/a b.mov": "r2", "/m/x.wav": "r3", "/m/c.png": "r4"}
    bad = ops.normalise(clips(spark, (" ", "video", 0, 1, None, None, ""), ("p", "video", -1, 1, None, None, ""), ("p", "video", 5, 5, None, None, "")), 24)
    assert [r.error for r in bad.orderBy("idx").collect()] == ["missing a path", "in_seconds cannot be negative", "resolves to a non-positive duration"]


def test_markers_reach_every_clip_that_holds_them(spark):
    m = spark.createDataFrame([("t", 5, "in both"), ("t", 240, "third"), ("t", 999, "outside")], "timeline string, frame long, name string")
    got = {(r.idx, r.marker_name, r.local) for r in ops.clip_markers(tiled(spark), m).collect()}
    assert got == {(0, "in both", 5), (1, "in both", 5), (2, "third", 1)}
    text = interchange.fcpxml(tiled(spark), m, 24).first().content
    root = ET.fromstring(text.split("<!DOCTYPE fcpxml>")[1])
    assert len(root.findall(".//asset")) == 3 and root.find(".//asset").get("src") == "file:///m/a%20b.mov"
    lane = root.find(".//asset-clip[@lane='-1']")
    assert lane.get("ref") == "r3" and lane.get("audioRole") == "dialogue" and len(root.findall(".//marker")) == 3
    assert root.find(".//sequence").get("duration") == "384/24s"
    assert text == interchange.fcpxml(tiled(spark).repartition(3), m, 24).first().content


def test_edl_and_manifest(spark, tmp_path):
    text = interchange.edl(tiled(spark), 24, "Cut").first().content
    assert text.startswith("TITLE: Cut\nFCM: NON-DROP FRAME\n\n001  AX       V     C        00:00:00:00 00:00:01:00 00:00:00:00 00:00:01:00\n* FROM CLIP NAME: a\n\n002")
    m = spark.createDataFrame([(1, 30, "second"), (0, -4, "first")], "pos long, frame long, name string")
    rows = interchange.marker_manifest(m, 24)
    assert [tuple(r) for r in rows.collect()] == [(0, "00:00:00:00", "0.000", "first", "Blue", "", 1), (30, "00:00:01:06", "1.250", "second", "Blue", "", 1)]
    out = str(tmp_path / "m")
    assert interchange.write(rows, out, "csv") is rows and not (tmp_path / "m").exists()
    with pytest.raises(ValueError):
        interchange.write(rows, out, "csv", dry_run=False)
    interchange.write(rows.coalesce(1), out, "csv", dry_run=False, confirm=True)
    assert "30,00:00:01:06,1.250,second" in next((tmp_path / "m").glob("*.csv")).read_text()


def test_validation_and_snap(spark):
    probes = spark.createDataFrame([("v", True, "video", 2000), ("i", True, "image", None), ("gone", False, None, None)], "path string, ok boolean, kind string, duration_ms long")
    rows = [("v", "video", 0, None), ("v", "audio", -5, 2051), ("i", "audio", 0, 0), ("gone", "video", 0, 1), (None, "video", 0, 1), ("v", "video", 10, 10)]
    c = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, path string, kind string, in_ms long, out_ms long")
    got = {r.n: (r.out_ms, r.errors, r.warnings) for r in ops.validate(c, probes).collect()}
    assert got[0] == (2000, [], []) and got[1] == (2051, ["in < 0"], ["out beyond media duration"])
    assert got[2] == (0, [], ["expected audio, media kind is 'image'"]) and got[3][1] == ["unreadable media"]
    assert got[4][1] == ["clip missing 'path'"] and got[5][1] == ["out <= in"]
    assert ops.usable(ops.validate(c, probes)).count() == 2
    grid = spark.createDataFrame([("t", x) for x in (0, 500, 1000, 1500)], "timeline string, t long")
    cut = spark.createDataFrame([("t", 20, 980), ("t", 250, 700)], "timeline string, in_ms long, out_ms long")
    assert sorted((r.in_ms, r.out_ms) for r in ops.snap(cut, grid, ["timeline"], ["in_ms", "out_ms"]).collect()) == [(0, 1000), (250, 700)]


def test_markers_options_and_plans(spark):
    m = spark.createDataFrame([(0, None, "x", None, None), (1, 5, None, None, None)], "pos long, time_ms long, name string, color string, note string")
    assert [(r.name, r.color, r.note) for r in ops.normal_markers(m).collect()] == [("Marker 2", "Blue", "")]
    o = spark.createDataFrame([("video", 2.0, -3.0), ("audio", 2.0, -3.0)], "kind string, speed double, gain_db double")
    assert [tuple(r) for r in ops.options(o).collect()] == [("video", 2.0, None), ("audio", None, -3.0)]
    p = spark.createDataFrame([(None, 10, 1000, 2000, 25.0), (3, 9, None, None, None), (9, 3, None, None, None), (None, None, 1000, None, None)], "start_frame long, end_frame long, in_ms long, out_ms long, fps double")
    assert [(r.start_frame, r.end_frame, r.error) for r in ops.clip_plan(p.withColumn("path", F.lit("p"))).collect()] == [(25, 50, None), (3, 9, None), (9, 3, "end_frame must be greater than start_frame"), (None, None, "frame rate unknown")]


def test_probe_documents(spark):
    doc = {"format": {"duration": "12.5", "tags": {}}, "streams": [{"codec_type": "video", "disposition": {"attached_pic": 1}}, {"codec_type": "audio", "codec_name": "aac", "channels": 2, "sample_rate": "48000", "tags": {"timecode": "01:00:00:00"}}]}
    video = {"format": {}, "streams": [{"codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "duration": "3.5"}]}
    df = spark.createDataFrame([("/a/song.m4a", json.dumps(doc)), ("/a/clip.MOV", json.dumps(video)), ("/a/pic.jpg", json.dumps(video)), ("/a/bad.mov", "nope"), ("/a/none.mov", None)], "path string, json string")
    got = {r.name: r for r in media.probe(df).collect()}
    assert (got["song.m4a"].kind, got["song.m4a"].duration_seconds, got["song.m4a"].timecode, got["song.m4a"].audio_sample_rate) == ("audio", 12.5, "01:00:00:00", 48000)
    assert (got["clip.MOV"].kind, got["clip.MOV"].resolution, got["clip.MOV"].duration_seconds, got["clip.MOV"].extension) == ("video", "1920x1080", 3.5, "mov")
    assert got["clip.MOV"].fps == 30000 / 1001 and got["pic.jpg"].kind == "image" and not got["bad.mov"].ok and not got["none.mov"].ok
    order = media.probe_in_order(spark, ["/a/none", "/a/song.m4a"], media.probe(df)).collect()
    assert [(r.path, r.ok) for r in order] == [("/a/none", False), ("/a/song.m4a", True)]
    assert [r.name for r in media.usable_footage(media.probe(df)).collect()] == ["clip.MOV"]


def test_folder_scan_and_wav(spark, tmp_path):
    (tmp_path / "Sub").mkdir()
    tone = np.sin(np.arange(1600) / 5) * 0.5
    (tmp_path / "Sub/b.WAV").write_bytes(b"x")
    (tmp_path / "a.wav").write_bytes(interchange.wav_bytes(tone))
    (tmp_path / "C.mov").write_bytes(b"123")
    (tmp_path / "n.txt").write_bytes(b"1")
    files, report = media.scan_folder(spark, str(tmp_path), max_files=2)
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["a.wav", "C.mov"] and tuple(report.first()) == (3, 1)
    assert media.scan_folder(spark, str(tmp_path), extensions=[".MOV"])[0].first().size_bytes == 3
    row = media.pcm(spark, str(tmp_path)).first()
    assert (row.rate, row.channels, len(row.samples)) == (16000, 1, 1600) and np.allclose(row.samples, tone, atol=1e-3)


def test_transcripts_and_logs(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"words": [{"start": 0.1, "end": 0.45, "word": "Hi,"}, {"start": 0.5, "end": 1.0, "word": "you", "confidence": 0.5}], "duration": 2.0}))
    assert [(r.pos, r.norm, r.start_ms, r.end_ms, r.confidence, r.duration_ms) for r in media.transcripts(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "hi", 100, 450, None, 2000), (1, "you", 500, 1000, 0.5, 2000)]
    lines = ["noise", "[x] silence_start: -0.02", "[x] silence_end: 1.5 | silence_duration: 1.52", "[x] silence_start: 3", "mean_volume: -21.5 dB", "max_volume: -3.0 dB"]
    log = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)] + [("g", 0, "quiet")], "file string, n long, line string")
    spans = spark.createDataFrame([("f", 5000), ("g", 100)], "file string, duration_ms long")
    assert sorted((r.start_ms, r.end_ms) for r in media.silences(log, spans).collect()) == [(0, 1500), (3000, 5000)]
    assert {r.file: (r.mean_db, r.max_db) for r in media.volumes(log).collect()} == {"f": (-21.5, -3.0), "g": (-30.0, 0.0)}
    text = spark.createDataFrame([("f", 'junk\n{ "input_i" : "-20.1", "input_tp" : "-inf", "input_lra":"3.0" }\n'), ("g", "none")], "file string, text string")
    got = {r.file: tuple(r)[1:] for r in media.loudness(text).collect()}
    assert got == {"f": (-20.1, 3.0, None, None), "g": (None, None, None, None)}
    t = "timestamp'2024-01-0{}'"
    both = [spark.sql(f"SELECT 'f' AS file, {t.format(a)} AS modified UNION ALL SELECT 'g', {t.format(b)}") for a, b in ((2, 1), (1, 2))]
    assert [r.file for r in media.fresh(*both).collect()] == ["f"]


def test_paths(spark):
    df = spark.createDataFrame([("/a/b.tar.GZ",), ("/a/.hidden",), ("plain",), ("/x/My Clip!.mov",)], "p string")
    got = [tuple(r) for r in df.select(media.extension(F.col("p")), media.stem(F.col("p")), media.safe_stem(media.stem(F.col("p")))).collect()]
    assert got == [("gz", "b.tar", "b_tar"), ("", ".hidden", "hidden"), ("", "plain", "plain"), ("mov", "My Clip!", "My_Clip")]
