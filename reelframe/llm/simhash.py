"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints are computed in Arrow batches, whole texts, in chunks of bounded size.  Linking works
on distinct fingerprints only, so copies cost one row a fingerprint.  For radius r, 2^(r+1)-1 bit
masks are built from the parity checks of all non-zero (r+1)-bit vectors: any r positions leave
at least one mask that covers none of them, so every pair within the radius shares a bucket.

A bucket may hold a large share of all fingerprints, so its pairs are never enumerated.  For
radius 2 two members of a bucket are within the radius exactly if some word is at most one flip of
an uncovered bit away from both; members are grouped by those words.  A group holds at most 65
fingerprints, all of which are linked, so one star for each group gives the same components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .dedup import keep_marked
from .work import discard, fresh, table

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash as an unsigned integer; 0 for null and for texts without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        size = min(CHUNK, n - at)
        h = np.fromiter(map(xxhash.xxh64_intdigest, (p for p, _ in zip(parts, range(size), strict=False)), repeat(SEED)), np.uint64, size) if n > CHUNK else np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, size)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS) -> list[int]:
    """Bit i belongs to check vector i mod (2^(r+1)-1) + 1; a mask has the bits whose parity with its own vector is odd."""
    top = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % top + 1) & v).bit_count() & 1) for v in range(1, top + 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash (to tell rows with one id apart) and fp (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Stars (a, b) over distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    spread = masks()
    table_no = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(spread)))).alias("t")
    rows = fps.select("fp", table_no).select("fp", "t.v", "t.key")
    crowded = table(rows.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "simhash_buckets")
    members = rows.join(crowded, ["v", "key"])
    flips = F.element_at(F.array(*(F.array(*(F.lit(f) for f in [0] + [_signed(1 << i) for i in range(BITS) if not m >> i & 1])) for m in spread)), F.col("v") + 1)
    words = members.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("word"))
    stars = words.groupBy("word").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")  # at most 65 each
    return stars.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable), text_hash.

    Null and blank texts have fingerprint zero and link like any other.  Null ids are members but
    never name a component unless all its ids are null (then component_id is null).  Repeated rows
    each get a row.  Other columns are ignored, whatever their names.  An empty table gives an
    empty result.
    """
    sig = table(fingerprints(docs, id_col, text_col), "simhash_fingerprints")
    nodes = table(sig.groupBy("fp").agg(F.min("id").alias("low")), "simhash_nodes")
    roots = components(links(nodes.select("fp")))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    labelled = table(labelled, "simhash_labelled")
    lowest = table(labelled.groupBy("root").agg(F.min("low").alias("component_id")), "simhash_components")
    classes = table(labelled.join(lowest, "root").select("fp", "component_id"), "simhash_classes")
    return sig.join(classes, "fp").select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "text_hash")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row with its smallest id.

    groups finds the components, by SimHash or by shingle sets (similar.near_copies).
    Of rows with that id in the component the smallest text hash stays, and of repeated rows one.
    Rows with a null id stay only if no row of their component has an id.
    """
    kid, khash, copies, dhash = fresh(docs, "k_id", "k_hash", "k_copies", "d_hash")
    found = table(groups(docs, id_col, text_col), "simhash_result")
    stays = found.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    # A null component_id names no component by itself: there the fingerprint does.
    key = [F.col("component_id").alias(kid), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f")]
    rows = stays.groupBy(*key, "text_hash").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.groupBy(kid, "f").agg(F.min(F.struct("text_hash", "n")).alias("m"))
    rows = table(rows.select(kid, F.col("m.text_hash").alias(khash), F.col("m.n").alias(copies)), "simhash_stays")
    marked = docs.withColumn(dhash, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    on = F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(dhash) == F.col(khash))
    return keep_marked(marked, rows, on, copies, [id_col, dhash]).select(*docs.columns)
