import math

import numpy as np
import pytest

from reelframe.llm import topk


def brute(rows, k=5):
    kept = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in kept:
        if q % 50 == 0:
            found = {(sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in kept if c != q and len(a) == len(b)}
            out |= {(q, r, c, s) for r, (s, c) in enumerate(sorted(found, key=lambda t: (-t[0], t[1]))[:k], 1)}
    return out


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "INDEX_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(block)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=9) * (3 if i % 7 else 0.01)]) for i in range(301)]
    rows += [(400, [0.0] * 9), (401, rows[0][1]), (402, rows[0][1]), (402, rows[0][1]), (450, rows[0][1]), (403, None), (404, []), (405, [None] * 9), (450 + 1, [float("nan")] * 9),
             (500, [float("inf")] + [0.0] * 8), (None, rows[1][1]), (501, [1e9] + [0.0] * 8), (600, [70000.0, -3.5] + [0.0] * 7), (601, [-70000.0] + [0.25] * 8), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (-50, [-1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "'y' AS id", "'z' AS v")
    assert {tuple(r) for r in topk.top_k(df).collect()} == brute(rows)


def test_stops_early_only_on_proof():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, size=(3000, 16))
    vectors[:40] *= 30
    block = topk.Block(np.arange(3000), vectors)
    queries, ids = vectors[:20], np.arange(20)
    got = block.search(ids, queries, 5)
    scores = vectors @ queries.T
    for q in range(20):
        want = sorted(((-int(scores[c, q]), c) for c in range(3000) if c != q))[:5]
        assert [(-s, c) for i, c, s in got if i == q] == want


def test_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], df.schema)).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (7, [-0.001])], df.schema)).collect()] == [(0, 1, 7, -256)]


def test_a_proof_stops_the_processing():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-60, 61, size=(4000, 16))
    vectors[:12, :2] += 400
    block = topk.Block(np.arange(4000), vectors)
    got = block.search(np.arange(12), vectors[:12], 5)
    assert block.stopped == 12 and block.rescored < 12 * 100
    scores = vectors @ vectors[:12].T
    for q in range(12):
        assert [(-s, c) for i, c, s in got if i == q] == sorted(((-int(scores[c, q]), c) for c in range(4000) if c != q))[:5]


def test_sums_beyond_exact_doubles():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-topk.LARGEST, topk.LARGEST, size=(500, 64))
    vectors[1::2] = vectors[::2] + rng.integers(-1, 2, size=(250, 64))
    vectors = np.clip(vectors, -topk.LARGEST, topk.LARGEST)
    got = topk.Block(np.arange(500), vectors).search(np.arange(40), vectors[:40], 5)
    scores = vectors @ vectors[:40].T
    for q in range(40):
        assert [(-s, c) for i, c, s in got if i == q] == sorted(((-int(scores[c, q]), c) for c in range(500) if c != q))[:5]


def test_one_index_for_all_queries_of_a_block(spark, monkeypatch):
    part = topk._Part(4, 5, 256)
    import pyarrow as pa

    rng = np.random.default_rng(7)
    vectors = [[int(x) for x in rng.integers(-9, 9, 4)] for _ in range(60)]
    columns = lambda rows: (pa.array(rows, pa.int64()), pa.array([vectors[i] for i in rows], pa.list_(pa.int32())), pa.array([None] * len(rows), pa.list_(pa.float64())))
    part.add(*columns(range(30)))
    part.add(*columns(range(30, 60)))
    part.ask(*columns([0, 50]))
    block = part.block
    part.ask(*columns([0]))
    assert part.block is block and len(block.ids) == 60


def test_scores_that_fit_no_long_raise(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)int|long|overflow"):
        topk.top_k(df).collect()
    small = df.where("vec_id <> 1")
    assert [tuple(r) for r in topk.top_k(small).collect()] == [(0, 1, 2, 0)]
