import itertools
import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import components, simhash


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, near):
    root = {k: k for k in range(len(pairs))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(pairs)), 2):
        if near(pairs[a], pairs[b]):
            root[find(a)] = find(b)
    return [find(k) for k in range(len(pairs))]


@given(st.lists(st.sampled_from(["a", "B", " ", "\n", "\x0b", "é", " ", "word", "\x1f"]), max_size=40).map("".join))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    text = "shïngle of words"
    assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(str(i) for i in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_every_pair_within_the_radius_shares_a_bucket():
    found = simhash.masks()
    assert len(found) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in found)


def test_links_are_complete_and_right(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:  # chains and a crowd around one word
        for _ in range(3):
            fps.add(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps |= {1 << i for i in range(40)} | {0, 7, 2**63, 2**64 - 1}
    signed = [simhash._signed(f) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.root for r in components.components(edges).collect()}
    want = brute_components(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    classes = {}
    for f, k in zip(signed, want, strict=True):
        classes.setdefault(k, []).append(f)
    for members in classes.values():
        assert {got.get(f, f) for f in members} == {min(members)}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 80)] + [(5, 5), (3, 4), (4, 3)]
    random.Random(1).shuffle(path)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got.get(i, i) for i in range(61)} == {0}
    assert {got.get(i, i) for i in range(1000, 1080)} == {1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for r, k in zip(rows, roots, strict=True):
        low[k] = min((x for x in (low.get(k), r[0]) if x is not None), default=None)
    want = sorted(((r[0], f"{f:016x}", low[k]) for r, f, k in zip(rows, fps, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {None}
    assert simhash.drop_near_copies(df).count() == 2


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == simhash.drop_near_copies(none).count() == 0
