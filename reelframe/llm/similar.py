"""SimHash near-dedup at a similarity: word shingles of five, Jaccard similarity 0.8 or more.

Every text becomes its set of hashed shingles, in Arrow batches; equal sets are one node.  The SimHash of
the set goes into covering tables, as in simhash, but for a wide radius: bit i stands for a vector of
GF(2)^8, made of a one, the six digits of i and a bent function of them, and a mask keeps the bits whose
vector has odd parity with the mask's own.  Any 7 positions leave a mask that covers none of them, so
every pair within RADIUS bits shares a bucket.  The masks of this code hold 28 bits or more; each is
thinned to KEPT, which keeps the guarantee and lets most pairs some bits beyond it meet as well.  The
shingle sets of the pairs that meet decide, so nothing is linked that isn't similar.

The tables' rows are dealt once, packed; a stream over them passes on the buckets with two or more.
Two more streams over these propose pairs, so that no join pairs up a bucket.  In a crowded bucket
most pairs say what is known already: first, each bucket's members meet the one of them that is in most
buckets, up to FAR bits; then those meet that are still in different components, within RADIUS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import BITS, _signed, hex_digits
from .work import discard, table

SHINGLE = 5
#: Similarity as a fraction.
SIMILARITY = (4, 5)
#: Bits within which all pairs are compared, and bits up to which those that share a bucket may be: 0.8 of the bits agree.
RADIUS, FAR = 7, 12
#: Bits of a table's key.  More bits mean smaller buckets and fewer pairs beyond RADIUS.
KEPT = 24
SEED = 42
#: Nodes whose keys are made at a time, and members of a bucket that meet all others at a time.
CHUNK, BLOCK = 4096, 256
#: All keys are dealt in 1 << PART_BITS parts; a task holds one at a time.
PART_BITS = 12


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all runs of `size` words, sorted; of the whole text if it has fewer; none of a blank text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # as in simhash
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(n)), np.uint64, n))


def node(own: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED))


def fingerprint(own: np.ndarray) -> int:
    """SimHash of the shingles, as a signed long."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(own), 1 << 16):
        part = own[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return _signed(int(((counts * 2 > len(own)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64)))


def kept_bits() -> list[np.ndarray]:
    """The bits that each table's key takes, one table for every non-zero vector of GF(2)^(RADIUS + 1)."""
    digits = [np.arange(BITS) >> k & 1 for k in range(6)]
    bent = digits[0] & digits[1] ^ digits[2] & digits[3] ^ digits[4] & digits[5]
    checks = sum(x << k for k, x in enumerate([np.ones(BITS, int), *digits, bent]))
    rng = np.random.default_rng(SEED)
    odd = [np.flatnonzero([int(c & v).bit_count() & 1 for c in checks]) for v in range(1, 1 << RADIUS + 1)]
    return [np.sort(rng.choice(own, KEPT, replace=False)) for own in odd]


def _places() -> np.ndarray:
    """Column v gives the key of table v as a sum of powers of two, which single precision holds exactly."""
    kept = kept_bits()
    out = np.zeros((BITS, len(kept)), np.float32)
    for v, own in enumerate(kept):
        out[own, v] = 2.0 ** np.arange(KEPT)
    return out


def keys(fps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One row for each fingerprint (signed longs): its keys in all tables, the table's number in the top byte."""
    bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little").astype(np.float32)
    found = (bits @ places).astype(np.uint32) | np.arange(places.shape[1], dtype=np.uint32) << np.uint32(KEPT)
    return found.view(np.int32)


def _signatures(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(2):
                own = shingles(t.as_py(), size)
                found.append((node(own), len(own), fingerprint(own)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], ["id", "text_hash", "node", "n", "fp"])

    return rows.mapInArrow(run, "id long, text_hash long, node long, n long, fp long")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, uid) of all buckets that hold two nodes or more.

    The tables' rows are packed: a row that is dealt holds the keys and uids of one part of all keys for up to CHUNK
    nodes, as bytes.  A part's rows come together, and a task holds one part at a time.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places()
        for b in batches:
            own, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(own), CHUNK):
                k = keys(fps[at : at + CHUNK], places)
                x = np.repeat(own[at : at + CHUNK], k.shape[1])
                k = k.ravel()
                part = (k.view(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - PART_BITS)).astype(np.uint16)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange((1 << PART_BITS) + 1)).astype(np.int32)
                full = np.flatnonzero(np.diff(cuts))
                ends = np.append(cuts[full], cuts[-1])
                packed = [pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends * c.itemsize), pa.py_buffer(c[order])]) for c in (k, x)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *packed], ["part", "keys", "uids"])

    def crowded(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        k, x = (np.concatenate([np.frombuffer(h[i], kind) for h in held]) for i, kind in enumerate((np.int32, np.int64)))
        order = np.argsort(k)
        k, x = k[order], x[order]
        same = k[1:] == k[:-1]
        hit = np.zeros(len(k), bool)
        hit[1:] |= same
        hit[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(k[hit]), pa.array(x[hit])], ["key", "uid"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, *packed in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if part != now and held:
                    yield crowded(held)
                    held = []
                now = part
                held.append(tuple(p.as_py() for p in packed))
        if held:
            yield crowded(held)

    rows = nodes.where("n > 0").select("uid", "fp").mapInArrow(spread, "part int, keys binary, uids binary")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(runs, "key int, uid long")


def _fits(n: np.ndarray, m: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    return np.minimum(n, m) * similarity[1] >= np.maximum(n, m) * similarity[0]


def _differing(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.bitwise_count((f ^ g).view(np.uint64))  # of signed numbers it would count the bits of their size


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _with_centre(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of every member and the one of its bucket that is in most buckets, if they may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # the centre of the last bucket, which may go on
        for batch in batches:
            k, x, f, n = own = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(k):
                continue
            at = np.arange(len(k))
            centre = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), at, 0))
            met = (centre != at) & (_differing(f, f[centre]) <= FAR) & _fits(n, n[centre], similarity)
            yield _pairs(x[met], x[centre][met])
            held = [c[centre[-1] : centre[-1] + 1] for c in own]

    rows = members.repartition("key").sortWithinPartitions("key", F.desc("c"), "node").select(F.col("key").cast("long"), "node", "fp", "n")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _apart(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of all pairs within RADIUS bits whose roots differ, each from the first table in which it meets."""

    def bucket(k: np.ndarray, x: np.ndarray, f: np.ndarray, n: np.ndarray, r: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = int(k[0]) >> KEPT & 0xFF
        for at in range(0, len(x), BLOCK):
            i = slice(at, at + BLOCK)
            met = (_differing(f[i, None], f) <= RADIUS) & (r[i, None] != r) & _fits(n[i, None], n, similarity) & (np.arange(len(x))[i, None] < np.arange(len(x)))
            a, b = np.nonzero(met)
            for part in range(0, len(a), CHUNK):
                p, q = a[part : part + CHUNK] + at, b[part : part + CHUNK]
                first = np.argmax(keys(f[p], places) == keys(f[q], places), axis=1) == own
                yield _pairs(x[p][first], x[q][first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held = _places(), [np.zeros(0, np.int64)] * 5  # the last bucket, which may go on
        for batch in batches:
            own = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            cuts = [0, *(np.flatnonzero(np.diff(own[0])) + 1).tolist()]
            changes = np.concatenate([[0], np.cumsum(np.diff(own[4]) != 0)])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if changes[hi - 1] != changes[lo]:
                    yield from bucket(*(c[lo:hi] for c in own), places)
            held = [c[cuts[-1] :] for c in own]
        if len(held[0]):
            yield from bucket(*held, places)

    rows = members.repartition("key").sortWithinPartitions("key", "root", "node").select(F.col("key").cast("long"), "node", "fp", "n", "root")
    return rows.mapInArrow(run, "a long, b long").distinct()




def _sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, own) of the wanted nodes, from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                own = shingles(t.as_py(), size)
                yield pa.RecordBatch.from_arrays([pa.array([node(own)], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["node", "own"])

    hashes = table(nodes.join(wanted, "node", "left_semi").select("text_hash"), "similar_hashes")
    own = texts.join(hashes, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    out = table(own.mapInArrow(run, "node long, own array<long>"), "similar_sets")
    discard(hashes)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    top, bottom = similarity
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    same = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(same * (top + bottom) >= (F.size("x") + F.size("y")) * F.lit(top)).select("a", "b")


def _links(nodes: DataFrame, texts: DataFrame, similarity: tuple[int, int], size: int) -> DataFrame:
    """(node, root) of every node that has a similar other one."""
    thin = table(_members(nodes), "similar_buckets")
    often = thin.groupBy("uid").agg(F.count(F.lit(1)).alias("c"))
    facts = table(often.join(nodes.select("uid", "node", "n", "fp"), "uid"), "similar_facts")
    members = table(thin.join(facts, "uid").drop("uid"), "similar_members")
    discard(thin, facts)
    edges = roots = None
    for propose in (_with_centre, _apart):
        now = members if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = table(propose(now, similarity), "similar_pairs")
        wanted = table(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "similar_wanted")
        sets = _sets(texts, nodes, wanted, size)
        found = table(_similar(pairs, sets, similarity), "similar_edges")
        discard(sets, wanted, pairs)
        edges = found if edges is None else edges.union(found)
        roots = components(edges)
    return roots


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits of the set's hash), component_id, text_hash; as simhash.near_duplicates.

    Texts link whose shingle sets have at least the similarity; pairs whose fingerprints differ in RADIUS bits at most
    are always compared unless linked already, pairs up to FAR bits if one of them is the centre of a bucket that they share.  Null and blank texts have one empty set and are one
    group.  Null ids are members but never name a component unless all its ids are null.  Repeated rows each
    get a row.  Whole texts are read.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    sig = table(_signatures(rows, size), "similar_signatures")
    slim = sig.select("id", "text_hash", "node")
    nodes = sig.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.min("id").alias("low"))
    nodes = table(nodes.withColumn("uid", F.monotonically_increasing_id()), "similar_nodes")  # shorter than the hash in the tables' many rows
    roots = _links(nodes, rows.select("text_hash", "text"), similarity, size)
    labelled = table(nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "similar_labelled")
    lowest = table(labelled.groupBy("root").agg(F.min("low").alias("component_id")), "similar_components")
    # Of a component without ids the root stands for the fingerprint, so that it is one group.
    classes = table(labelled.join(lowest, "root").select("node", "root", "component_id"), "similar_classes")
    discard(labelled, lowest)
    return slim.join(classes, "node").select(F.col("id").alias(id_col), hex_digits(F.when(F.col("component_id").isNull(), F.col("root")).otherwise(F.col("node"))).alias("fingerprint"), "component_id", "text_hash")
