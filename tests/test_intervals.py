from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.operators import intervals as ops

SPANS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(1, 15)).map(lambda t: (t[0], t[1], t[1] + t[2])), max_size=25)


def plain_merge(rows):
    out = {}
    for k, a, b in sorted(rows):
        own = out.setdefault(k, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return sorted((k, a, b) for k, v in out.items() for a, b in v)


@given(SPANS)
@settings(max_examples=15, deadline=None)
def test_merge_and_complement(spark, rows):
    df = spark.createDataFrame(rows, "k string, start_ms long, end_ms long")
    merged = plain_merge(rows)
    assert sorted(map(tuple, ops.merge(df, ["k"]).collect())) == merged
    spans = spark.createDataFrame([("a", 50), ("b", 80), ("c", 9)], "k string, duration_ms long")
    for whole in (True, False):
        want = []
        for k, d in (("a", 50), ("b", 80), ("c", 9)):
            at, own = 0, []
            for _, a, b in (m for m in merged if m[0] == k):
                if min(a, d) > at:
                    own.append((k, at, a))
                at = max(at, b)
            if at < d:
                own.append((k, at, d))
            want += own or ([(k, 0, d)] if whole else [])
        rows_in = [m for m in merged if m[1] <= {"a": 50, "b": 80}[m[0]]]
        if len(rows_in) == len(merged):  # intervals start within their span
            assert sorted(map(tuple, ops.complement(df, spans, ["k"], whole_if_empty=whole).collect())) == sorted(want)


@given(st.lists(st.integers(0, 50), max_size=12), st.lists(st.integers(0, 50), max_size=8, unique=True))
@settings(max_examples=15, deadline=None)
def test_nearest_and_containing(spark, points, grid):
    p = spark.createDataFrame([("k", i, t) for i, t in enumerate(points)], "k string, i long, t long")
    g = spark.createDataFrame([("k", n, t) for n, t in enumerate(sorted(grid))], "k string, n long, t long")
    got = {r.i: r.nearest for r in ops.nearest(p, g.drop("n"), ["k"], "t", tolerance=5).collect()}
    for i, t in enumerate(points):
        best = min(sorted(grid), key=lambda x: abs(x - t), default=None)
        assert got[i] == (best if best is not None and abs(best - t) <= 5 else None)
    held = {r.i: r.in_n for r in ops.containing(p, g, ["k"], carry=("n",)).collect()}
    for i, t in enumerate(points):
        assert held[i] == max((n for n, x in enumerate(sorted(grid)) if x <= t), default=None)


def test_points_in_spans_spacing_and_sessions(spark):
    from pyspark.sql import functions as F

    s = spark.createDataFrame([("k", 0, 10), ("k", 5, 20), ("j", 0, 99)], "k string, a long, b long")
    p = spark.createDataFrame([("k", 5), ("k", 10), ("k", 30)], "k string, frame long")
    assert sorted(tuple(r) for r in ops.points_in(p, s, ["k"], "frame", "a", "b").collect()) == [("k", 0, 10, 5), ("k", 5, 20, 5), ("k", 5, 20, 10)]
    row = spark.range(1).select(ops.spaced(F.array(*(F.lit(x).cast("long") for x in (1, 5, 12, 20, 21))), 8).alias("a"), ops.spaced(F.array(F.lit(3).cast("long"), F.lit(9).cast("long")), 8, F.lit(0)).alias("b")).first()
    assert row.a == [1, 12, 20] and row.b == [9]
    e = spark.createDataFrame([("k", t) for t in (0, 3, 14, 15, 40)], "k string, t long")
    assert sorted((r.t, r.session) for r in ops.sessions(e, ["k"], "t", 10).collect()) == [(0, 1), (3, 1), (14, 2), (15, 2), (40, 3)]
