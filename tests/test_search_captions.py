import pytest
from pyspark.sql import functions as F

from reelframe.functions import timecode as tc
from reelframe.functions.text import norm, wrap_lines
from reelframe.operators import captions, search
from reelframe.plans.captions import generate_captions
from reelframe.plans.search import find_in_footage


def make(spark, files, step=400, length=300):
    rows = [(f, i, w, i * step, i * step + length) for f, ws in files.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "f string, pos long, word string, start_ms long, end_ms long").withColumn("norm", norm(F.col("word")))


def test_phrase_and_context(spark):
    w = make(spark, {"a": ["The", "Red", "Balloon", "flew"], "b": ["no", "balloon"]}, 500, 400)
    files = w.select("f").distinct()
    got = find_in_footage(w, files, "f", "red balloon", context_ms=500).collect()
    assert [(r.f, r.start_ms, r.end_ms, r.text, r.context, r.context_start, r.context_end, r.hit) for r in got] == [("a", 500, 1400, "Red Balloon", "The Red Balloon flew", 0, 1900, 1)]
    assert [r.f for r in search.files_without(got and search.phrase(w, "f", ["red", "balloon"]), files, "f").collect()] == ["b"]
    with pytest.raises(ValueError):
        find_in_footage(w, files, "f", " ", "phrase")


def test_all_words_is_a_file_gate(spark):
    w = make(spark, {"a": ["alpha", "bravo", "alpha"]})
    assert search.all_words(w, "f", ["alpha", "bravo"]).count() == 3
    assert search.all_words(w, "f", ["alpha", "charlie"]).count() == 0


def test_overlapping_phrases_regex_and_selects(spark):
    w = make(spark, {"a": ["da", "da", "da", "don't", "stop!"]})
    assert [r.pos for r in search.phrase(w, "f", ["da", "da"]).orderBy("pos").collect()] == [0, 1]
    hits = search.regex(w, "f", r"da don.t|top").orderBy("pos").collect()
    assert [(h.pos, h.last, h.text) for h in hits] == [(2, 3, "da don't"), (4, 4, "stop!")]
    sel = search.selects(search.phrase(w, "f", ["da"])).orderBy("pos").collect()
    assert [(s.in_ms, s.out_ms) for s in sel][:2] == [(0, 800), (0, 1200)]


def test_wrap_lines(spark):
    def wrap(words, chars, lines):
        return spark.range(1).select(wrap_lines(F.array(*map(F.lit, words)), chars, lines).alias("l")).first().l

    assert wrap(["aa", "bb", "cc"], 5, 2) == ["aa", "bb cc"]  # the orphan gets a neighbour
    assert wrap(["aa", "bb", "cc", "dd", "ee", "ff"], 5, 2) == ["aa bb", "cc dd"]  # overflow goes
    assert wrap(["long-word-here", "x"], 5, 2) == ["long-word-here", "x"] and wrap([""], 5, 2) == []


def test_blocks_respect_their_budgets(spark):
    said = "one two three four five six seven eight nine ten, eleven twelve thirteen. fourteen fifteen".split()
    rows = captions.blocks(make(spark, {"a": said}), "f", max_line_chars=20, max_ms=3000).orderBy("block").collect()
    assert " ".join(x for r in rows for x in " ".join(w.text for w in r.words).split()) == " ".join(said)
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.end_ms - a.start_ms <= 3000 and b.start_ms - a.end_ms >= 90 and sum(map(len, a.lines)) <= 41
    assert any(r.words[-1].text == "thirteen." for r in rows)
    wide = captions.blocks(make(spark, {"a": said}), "f", max_line_chars=30, max_ms=60000).orderBy("block").collect()
    assert [r.words[-1].text for r in wide] == ["ten,", "thirteen.", "fifteen"]


def brute_blocks(words, max_chars, max_ms, pause_ms):
    out = []
    for i, (text, start, end) in enumerate(words):
        if i and not closed and end - out[-1][0][1] <= max_ms and len(" ".join(x[0] for x in [*out[-1], words[i]])) <= max_chars:
            out[-1].append(words[i])
        else:
            out.append([words[i]])
        size = len(" ".join(x[0] for x in out[-1]))
        closed = text[-1] in ".!?" or (text[-1] in ",;:" and size >= 0.6 * max_chars) or i + 1 == len(words) or words[i + 1][1] - end >= pause_ms
    return out


def test_blocks_stream_in_batches_of_words(spark):
    """No file is gathered in one row for Python, and blocks that span Arrow batches are whole."""
    files = {f"f{n}": [("a" * (1 + i * (n + 3) % 9) + (".", ",", "", "", "", "")[(i + n) % 6], 0) for i in range(n * 7 % 40 + 1)] for n in range(30)}
    files["f0"] = [("w", 0)] * 500 + [("x" * 300, 0)] + [("y.", 0)]
    timed = {f: [(w, i * 400 + i // 5 * 600, i * 400 + i // 5 * 600 + 300) for i, (w, _) in enumerate(ws)] for f, ws in files.items()}
    rows = [(f, i, *w) for f, ws in timed.items() for i, w in enumerate(ws)][::-1]
    df = spark.createDataFrame(rows, "f string, pos long, word string, start_ms long, end_ms long")
    made = captions.blocks(df, "f", min_gap_ms=0)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    for size in (1, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r.f, r.block): ([tuple(w) for w in r.words], r.start_ms, r.end_ms) for r in captions.blocks(df, "f", min_gap_ms=None).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = {(f, n): ([w[:2] for w in b], b[0][1], b[-1][2]) for f, ws in timed.items() for n, b in enumerate(brute_blocks(ws, 84, 6000, 600), 1)}
        assert got == want


def test_render(spark):
    w = make(spark, {"a": ["Hello", "there.", "Bye"]})
    srt = generate_captions(w, "f").first().content
    assert srt == "1\n00:00:00,000 --> 00:00:00,700\nHello there.\n\n2\n00:00:00,800 --> 00:00:01,100\nBye\n"
    vtt = generate_captions(w, "f", "vtt", True).first().content
    assert vtt.startswith("WEBVTT\n\n00:00:00.000 --> 00:00:00.700\n<00:00:00.000>Hello <00:00:00.400>there.\n")
    with pytest.raises(ValueError):
        generate_captions(w, "f", "txt")


def test_chapters(spark):
    m = spark.createDataFrame([("v", 42000, "TooClose"), ("v", 0, "Intro"), ("v", 40000, "Demo"), ("v", 90000, "Outro"), ("w", 5000, None)], "f string, time_ms long, name string")
    got = sorted(map(tuple, captions.marker_chapters(m, "f").collect()))
    assert got == [("v", 0, "Intro"), ("v", 40000, "Demo"), ("v", 90000, "Outro"), ("w", 0, "Chapter")]
    text = {r.f: r.text for r in captions.description(captions.marker_chapters(m, "f"), "f").collect()}
    assert text["v"] == "00:00 Intro\n00:40 Demo\n01:30 Outro"
    rows = [("x", i, w, a, a + 300) for i, (w, a) in enumerate([("first", 0), ("topic.", 400), ("second", 30000), ("one", 30400), ("third.", 40000), ("now", 41500), ("go", 70000)])]
    w = spark.createDataFrame(rows, "f string, pos long, word string, start_ms long, end_ms long")
    assert sorted(map(tuple, captions.chapters(w, "f").collect())) == [("x", 0, "First topic"), ("x", 30000, "Second one third"), ("x", 70000, "Go")]


def brute_chapters(words, min_ms, pause_ms):
    out, said = [], [i for i, (w, _, _) in enumerate(words) if w]
    for a, b in zip(said, said[1:], strict=False):
        gap = words[b][1] - words[a][2]
        if gap >= pause_ms and (words[a][0][-1] in ".!?" or gap * 2 >= pause_ms * 3) and words[b][1] - (out[-1][0] if out else 0) >= min_ms:
            out.append((words[b][1], b))
    return [(t, [w for w, _, _ in words[i : i + 6]]) for t, i in [(0, 0), *out]]


def title_of(ahead):
    until = next((i + 1 for i, w in enumerate(ahead) if w and w[-1] in ".!?"), 6)
    text = " ".join(w for w in ahead[:until] if w).rstrip(".,;:!?")
    return text[:1].upper() + text[1:] or "Chapter"


def test_chapters_stream_in_batches_of_words(spark):
    """Words are shuffled once at most, and pauses and titles that span Arrow batches are whole."""
    files = {}
    for n in range(30):
        now, files[f"f{n}"] = 0, []
        for i in range(n * 11 % 70 + 1):
            word = "" if (i, n % 3) == (0, 1) else "b" * (1 + (i + n) % 4) + (".", ",", "", "", "!")[(i * (n + 2)) % 5]
            files[f"f{n}"].append((word, now, now + 300))
            now += 300 + (50, 1200, 1500, 1900, 50, 700)[(i + n) % 6]
    files["f1"] = [("", 0, 0)]
    rows = [(f, i, *w) for f, ws in files.items() for i, w in enumerate(ws)][::-1]
    df = spark.createDataFrame(rows, "f string, pos long, word string, start_ms long, end_ms long")
    want = sorted((f, t, title_of(ahead)) for f, ws in files.items() for t, ahead in brute_chapters(ws, 5000, 1200))
    assert len(want) > 60
    plan = captions.chapters(df, "f", 5000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Window" not in plan
    for size in (1, 3, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted(map(tuple, captions.chapters(df, "f", 5000).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_titles_start_with_one_capital(spark):
    for word, title in (("\u00dfer", "\u1e9eer"), ("\ufb01n", "\ufb01n"), ("\u1f80x", "\u1f88x"), ("\u0149a", "\u0149a"), ("\u00fcber", "\u00dcber"), ("1st", "1st"), ("\u01c6a", "\u01c4a")):
        w = make(spark, {"a": [word]})
        assert captions.titles(w, "f").first().title == title


def test_times(spark):
    def one(c):
        return spark.range(1).select(c.alias("c")).first().c

    ms = lambda x: F.lit(x).cast("long")
    assert one(tc.caption_time(ms(3_723_004))) == "01:02:03,004" and one(tc.caption_time(ms(-5), True)) == "00:00:00.000"
    assert one(tc.chapter_time(ms(59_500))) == "01:00" and one(tc.chapter_time(ms(3_600_000))) == "01:00:00" and one(tc.chapter_time(ms(500))) == "00:00"
    assert one(tc.timecode(ms(30), 24)) == "00:00:01:06" and one(tc.timecode(ms(24 * 86400), 24)) == "00:00:00:00"
    assert one(tc.frames(ms(1), 24)) == 1 and one(tc.point_frames(ms(0), 24)) == 0 and one(tc.point_frames(ms(1), 24)) == 1 and one(tc.rational(ms(9), 24)) == "9/24s"
    assert one(tc.fraction(F.lit("30000/1001"))) == 30000 / 1001 and one(tc.fraction(F.lit("1/0"))) is None and one(tc.fraction(F.lit("x"))) is None and one(tc.fraction(F.lit("24"))) == 24.0
    assert tuple(one(tc.resolution(F.lit("1280X720")))) == (1280, 720) and tuple(one(tc.resolution(F.lit("wide")))) == (1920, 1080)
