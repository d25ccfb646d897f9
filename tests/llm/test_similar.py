import random

import numpy as np

import corpus_pipeline
from reelframe.llm import similar, simhash
from test_simhash import brute_components


def shingled(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    x, y = shingled(a), shingled(b)
    return not x | y or 5 * len(x & y) >= 4 * len(x | y)


def texts():
    rng = random.Random(11)
    out = []
    for k in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 100, 300]))]
        out.append(" ".join(words))
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            out.append(" ".join(copy))
    return [*out, "", None, " \n", "one", "ONE", "word " * 500, "word " * 5]


def test_stage_drops_copies_with_one_word_changed(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*words[:k], "other", *words[k + 1 :]])) for k in range(6, 95, 8)] + [(0, " ".join(words))]
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert [r.doc_id for r in out.collect()] == [0]


def bits(text):
    return similar.fingerprint(similar.shingles(text))


def test_links_against_brute_force(spark):
    """All similar pairs within the radius are linked, and nothing that similar pairs don't connect."""
    all_ = texts()
    df = spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string").selectExpr("*", "'x' AS node", "'y' AS n", "'z' AS fp")
    got = {r.doc_id: r.component_id for r in similar.near_copies(df).collect()}
    roots = brute_components(all_, near)
    assert all(roots[i] == roots[k] for i, k in got.items()) and all(k <= i for i, k in got.items())
    pairs = [(i, j) for j in range(len(all_)) for i in range(j) if near(all_[i], all_[j])]
    sure = [(i, j) for i, j in pairs if ((bits(all_[i]) ^ bits(all_[j])) % 2**64).bit_count() <= similar.RADIUS]
    assert len(sure) > 60 and all(got[i] == got[j] for i, j in sure)
    assert sum(got[i] == got[j] for i, j in pairs) > 0.95 * len(pairs)
    kept = simhash.drop_near_copies(df, groups=similar.near_copies)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_masks_cover_the_radius():
    kept = [set(map(int, k)) for k in similar.kept_bits()]
    assert len(kept) == 255 and all(len(k) == similar.KEPT for k in kept)
    rng = random.Random(2)
    for _ in range(500):
        apart = set(rng.sample(range(64), similar.RADIUS))
        assert any(not k & apart for k in kept)


def test_keys_are_the_kept_bits():
    fps = [-5, 3, 2**62, -(2**63)]
    got = similar.keys(np.array(fps, np.int64), similar._places())
    for row, fp in zip(got.tolist(), fps, strict=True):
        assert [x % 2**32 for x in row] == [v << similar.KEPT | sum((fp >> int(b) & 1) << i for i, b in enumerate(own)) for v, own in enumerate(similar.kept_bits())]


def test_a_crowd_of_copies_of_one_text(spark):
    """Copies that are similar to the first text but mostly not to each other."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 300):
        copy = list(words)
        for at in rng.sample(range(0, 195, 5), 4):
            copy[at] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).where("component_id = 0").count()
    assert got > 250


def test_null_ids_and_empty_table(spark, none):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (None, text + " end"), (None, "other words here now")], "doc_id long, text string")
    assert simhash.drop_near_copies(df, groups=similar.near_copies).count() == 2
    assert similar.near_copies(none).count() == 0
