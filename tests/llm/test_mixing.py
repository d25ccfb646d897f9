import re
from collections import Counter, defaultdict

import pytest

from reelframe.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        share = rest / sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and share * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share * w[s] for s in names}
        capped |= over


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check(df, got):
    rows = df.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    want = brute_targets(sizes)
    assert sorted((r["size"], r.source_size, round(r.target, 6)) for r in got) == sorted((words(r.text), sizes[r.source], round(want[r.source], 6)) for r in rows)
    taken, longest = defaultdict(int), max((words(r.text) for r in rows), default=0)
    for r in got:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[(r.source_size, r.target)] += r.taken
    return {k: (k[1], v, longest) for k, v in taken.items()}


def test_edge_cases(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check(docs, got)


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * i % 97), s) for i in range(900) for s in ["abcdefg"[i % 7]] if i % 7 != 5 or i < 60]
    rows += [(5000 + i, "long " * 4000, "a") for i in range(3)] + [(6000, "tiny", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    for target, taken, _ in check(df, got).values():
        assert taken == pytest.approx(target, rel=0.03, abs=2)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_shares_reshare_the_excess(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 300.0), ("c", 3.0, 30.0), ("d", 1.0, 0.0)], "s string, w double, cap double")
    got = {r.s: r.target for r in mixing.capped_shares(df, "w", "cap", 111.0).collect()}
    assert got == {"a": 3.0, "b": pytest.approx(78.0), "c": 30.0, "d": 0.0}


def test_inclusion_follows_the_size_class(spark):
    """Over many seeds a short document is chosen more often than a long one, and the sample stays near its size."""
    rows = [(i, "w " * (1 if i < 60 else 16), "a") for i in range(80)] + [(i, "v " * 50, "b") for i in range(100, 110)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    short = long_ = 0
    for seed in range(4):
        got = {r.doc_id: r for r in mixing.mix(df, seed=seed).collect()}
        base = min(r.copies for r in got.values() if r.doc_id < 80)
        short += sum(got[i].copies - base for i in range(60)) / 60
        long_ += sum(got[i].copies - base for i in range(60, 80)) / 20
    assert short > long_


def test_ranks_are_global(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(500)] + [(None,), ("é",), ("Z",)], "source string").repartition(7)
    got = {r.source: r["rank"] for r in mixing.ranked(df, "source", "t").collect()}
    want = sorted(got, key=lambda s: (s is None, (s or "").encode()))
    assert [got[s] for s in want] == list(range(503))


def test_empty_tables(none, spark):
    assert mixing.mix(none).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(df).collect()] == [0, 0]
