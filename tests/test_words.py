import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelframe.functions.text import norm
from reelframe.operators import words as ops
from reelframe.plans.transcripts import custom_fillers, cut_by_transcript, edit_plan

SCHEMA = "f string, pos long, word string, start_ms long, end_ms long"


def make(spark, files):
    rows = [(f, i, w, a, b) for f, ws in files.items() for i, (w, a, b) in enumerate(ws)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("norm", norm(F.col("word")))


def spans(spark, **ms):
    return spark.createDataFrame(list(ms.items()), "f string, duration_ms long")


FILES = {
    "basic": [("So", 0, 400), ("um,", 450, 650), ("yeah", 700, 1100), ("uh", 1150, 1350), ("okay.", 1400, 1800)],
    "opening": [("Um", 0, 300), ("hello", 500, 1000)],
    "phrase": [("it", 0, 200), ("was", 250, 600), ("you", 650, 850), ("know", 900, 1100), ("fine", 1150, 1500)],
    "kept": [("I", 0, 300), ("like", 310, 600), ("this", 610, 900)],
    "alone": [("well", 0, 300), ("like", 1000, 1300), ("yeah", 2000, 2300)],
    "twice": [("Um", 0, 300), ("um", 310, 600), ("hi", 700, 900)],
}


def test_fillers(spark):
    w = make(spark, FILES)
    phrases = ops.phrase_fillers(w, "f")
    assert [(r.f, r.text, r.start_ms, r.end_ms) for r in phrases.collect()] == [("phrase", "you know", 650, 1100)]
    got = {(r.f, r.text, r.start_ms) for r in ops.single_fillers(w, "f", consumed=phrases).collect()}
    assert got == {("basic", "um", 450), ("basic", "uh", 1150), ("alone", "like", 1000), ("twice", "um", 0), ("twice", "um", 310)}


def test_overlapping_phrase_lists_go_longest_first_from_the_left(spark):
    w = make(spark, {"x": [(t, i * 100, i * 100 + 90) for i, t in enumerate("z a b c a b a b".split())]})
    got = ops.phrase_fillers(w, "f", [("a", "b"), ("b", "a"), ("a", "b", "c")])
    assert sorted((r.pos, r.text) for r in got.collect()) == [(1, "a b c"), (4, "a b"), (6, "a b")]


def test_restart_is_cut_up_to_the_clean_copy(spark):
    w = make(spark, {"x": [("what", 0, 250), ("I", 300, 500), ("what", 550, 800), ("I", 850, 1000), ("meant", 1050, 1400)]})
    assert [(r.pos, r.n, r.start_ms, r.end_ms, r.text) for r in ops.restarts(w, "f").collect()] == [(0, 2, 0, 550, "what i")]


@given(st.lists(st.sampled_from("abc"), max_size=30))
@settings(max_examples=15, deadline=None)
def test_restarts_match_a_plain_restatement(spark, tokens):
    want, i = [], 0
    while i < len(tokens):
        k = next((k for k in range(min(6, (len(tokens) - i) // 2), 1, -1) if tokens[i : i + k] == tokens[i + k : i + 2 * k]), 0)
        if k:
            want.append((i, k))
        i += k or 1
    w = make(spark, {"x": [(t, i * 100, i * 100 + 90) for i, t in enumerate(tokens)]})
    assert sorted((r.pos, r.n) for r in ops.restarts(w, "f").collect()) == want


def test_pauses_and_merge(spark):
    w = make(spark, {"long": [("one", 0, 500), ("two", 3000, 3500)], "merge": [("one", 0, 500), ("um", 2600, 2900), ("two", 2950, 3400)]})
    d = spans(spark, long=4000, merge=3400)
    got = {(r.f, r.start_ms, r.end_ms, r.text) for r in ops.pauses(w, d, "f", handle=100).collect()}
    assert got == {("long", 600, 2900, "2.5s pause"), ("merge", 600, 2500, "2.1s pause")}
    cuts = ops.merged_cuts(ops.raw_cuts(w, d, "f", handle=50), "f").where("f = 'merge'").collect()
    assert len(cuts) == 1 and [r.type for r in cuts[0].reasons] == ["pause", "filler"] and cuts[0].start_ms == 550
    assert ops.raw_cuts(w, d, "f", tighten_only=True).where("type <> 'pause'").count() == 0


def test_whole_cutter_and_floor(spark):
    w = make(spark, {"a": [("a", 0, 300), ("b", 4700, 5000)], "none": [("x", 0, 900)]})
    cuts, keep, totals = cut_by_transcript(w, spans(spark, a=5000, none=1000), "f", keep_ratio_floor=0.9)
    t = {r.f: r for r in totals.collect()}
    assert t["a"].below_floor and not t["none"].below_floor and t["none"].keep_ratio == 1.0
    assert t["a"].kept_ms + t["a"].removed_ms == 5000 and t["a"].cuts == 1
    k = sorted((r.f, r.start_ms, r.end_ms) for r in keep.collect())
    assert k == [("a", 0, 380), ("a", 4620, 5000), ("none", 0, 1000)]
    assert [(r.timeline, r.idx, r.kind) for r in edit_plan(keep, "f", "audio").orderBy("timeline", "idx").collect()] == [("a", 0, "audio"), ("a", 1, "audio"), ("none", 0, "audio")]


@given(st.lists(st.tuples(st.sampled_from(["um", "um.", "you", "know", "like", "kind", "of", "x", "Uh", "..."]), st.sampled_from([20, 250, 900])), max_size=25))
@settings(max_examples=15, deadline=None)
def test_one_sweep_gives_the_rows_of_the_single_operators(spark, said):
    at, rows = 0, []
    for word, gap in said:
        rows.append((word, at + gap, at + gap + 90))
        at += gap + 90
    w, d = make(spark, {"x": rows}), spans(spark, x=at + 700)
    phrases = ops.phrase_fillers(w, "f")
    both = phrases.unionByName(ops.single_fillers(w, "f", consumed=phrases))
    want = {(r.text, r.start_ms, r.end_ms) for r in ops.widen(both, w, "f").collect()} | {(r.text, r.start_ms, r.end_ms) for r in ops.pauses(w, d, "f").collect()}
    assert {(r.text, r.start_ms, r.end_ms) for r in ops.swept_cuts(w, d, "f").collect()} == want


def test_norm(spark):
    words = ["  Hello, ", "«école»", "don't!", "_x_", "...", "ÀB1?"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i")
    assert [r.n for r in df.select(norm(F.col("w")).alias("n")).collect()] == ["hello", "école", "don't", "_x_", "", "àb1"]


def test_custom_fillers():
    assert custom_fillers(["um"], ["Basically", "you  see", "um"]) == (["basically", "um"], [("you", "see")], ["basically", "you see"])


@pytest.mark.parametrize("empty", ["raw_cuts"])
def test_empty(spark, empty):
    w = make(spark, {"x": []})
    assert ops.merged_cuts(ops.raw_cuts(w, spans(spark, x=100), "f"), "f").count() == 0
