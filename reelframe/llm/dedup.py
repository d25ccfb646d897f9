"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Everything here is DataFrame expressions.  One narrow signature row stands for each document;
text is never shuffled.  Each level groups only the rows that survived the level before, all
groupings pre-aggregate on the map side, and rows get their group back by an equi-join.  Groups
and survivors are written between the levels: a join whose two sides are plain exchanges is one
that adaptive execution can split when a length or a text is hot, which it can't below an
aggregation by the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import discard, fresh, table

#: Characters deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Code points of the normalised text that the prefix hash covers.
PREFIX = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _signature(docs: DataFrame, id_col: str, text_col: str, digest_all: bool) -> DataFrame:
    norm = normalised(F.col(text_col))
    cols = [
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("uid"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
        F.octet_length(norm).alias("len"),
        F.xxhash64(F.substring(norm, 1, PREFIX)).alias("head"),
    ]
    return docs.select(*cols, *([F.sha2(norm, 256).alias("full")] if digest_all else []))


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key at least one other row has."""
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    groups = table(groups, "dedup_groups_" + key[-1])
    return table(rows.join(groups, list(key), "left_semi"), "dedup_same_" + key[-1])


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (sha-256 of the normalised text).

    Of equal texts the row with the most code points stays, then the smallest id (null last),
    then one of the rows that agree in both.  Null text counts as empty; all empty texts are one
    group.  Repeated rows are members like any other and exactly one stays.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.

    digest_all=False reads full content (the full hash) only for rows that share length and prefix
    hash with another row, and leaves digest null for the others.  digest_all=True is for callers
    who need every document's digest anyway: it is computed in the one scan and the refinement
    works on it.
    """
    sig = table(_signature(docs, id_col, text_col, digest_all), "dedup_signature")
    same_head = _shared(_shared(sig, "len"), "len", "head")
    if digest_all:
        hashed = same_head
    else:
        keys = table(same_head.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n")), "dedup_survivors")
        norm = normalised(F.col(text_col))
        again = docs.select(F.col(text_col).alias("text_"), F.octet_length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("head"),
                            F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"))
        survivors = again.join(keys, ["len", "head"], "left_semi")
        hashed = table(
            survivors.select("id", F.monotonically_increasing_id().alias("uid"), "points", "len", "head", F.sha2(normalised(F.col("text_")), 256).alias("full")),
            "dedup_hashed",
        )
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid")))
    groups = table(hashed.groupBy("len", "head", "full").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).where("n > 1"), "dedup_groups_full")
    if digest_all:
        rows = sig.join(groups, ["len", "head", "full"], "left")
    else:
        alone = sig.join(keys.select("len", "head"), ["len", "head"], "left_anti").select("id", "uid", F.lit(None).cast("string").alias("full"))
        joined = hashed.join(groups, ["len", "head", "full"], "left").select("id", "uid", "full", "n", "best")
        rows = joined.unionByName(alone, allowMissingColumns=True)
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.col("full").alias("digest"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    A row stays if its group of equal texts keeps its (id, code points); rows that agree in id, code points
    and text are repeated rows, of which one stays.  Ids may be null.  The full hash is computed only for
    rows that share length and prefix hash with another row; all others stay without it.
    """
    sig = table(_signature(docs, id_col, text_col, False), "dedup_signature")
    same = _shared(_shared(sig, "len"), "len", "head")
    keys = table(same.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n")).select("len", "head"), "dedup_survivors")
    discard(sig, same)
    norm = normalised(F.col(text_col))
    own = [F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"), F.octet_length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("head")]
    survivors = docs.select(*own, F.col(text_col).alias("text_")).join(keys, ["len", "head"], "left_semi")
    hashed = survivors.select("id", "points", "len", "head", F.sha2(normalised(F.col("text_")), 256).alias("full"))
    hashed = table(hashed.groupBy("id", "points", "len", "head", "full").agg(F.count(F.lit(1)).alias("copies")), "dedup_hashed")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = table(hashed.groupBy("len", "head", "full").agg(best.alias("best"), F.sum("copies").alias("size")).where("size > 1").drop("size"), "dedup_groups_full")
    kid, kpoints, klen, khead, kfull = fresh(docs, "k_id", "k_points", "k_len", "k_head", "k_full")
    met = table(hashed.join(groups, ["len", "head", "full"]).withColumn("stays", F.expr("best.p = -points and best.id <=> id")), "dedup_met")
    named = lambda rows: rows.select(F.col("id").alias(kid), F.col("points").alias(kpoints), F.col("full").alias(kfull))
    gone, many = named(met.where("not stays")), named(met.where("stays and copies > 1"))
    points, len_, head, full = fresh(docs, "d_points", "d_len", "d_head", "d_full")
    marked = docs.withColumns({points: F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), len_: F.octet_length(norm), head: F.xxhash64(F.substring(norm, 1, PREFIX))})
    known = keys.select(F.col("len").alias(klen), F.col("head").alias(khead))
    marked = marked.join(known, (F.col(len_) == F.col(klen)) & (F.col(head) == F.col(khead)), "left")
    marked = marked.withColumn(full, F.when(F.col(klen).isNotNull(), F.sha2(norm, 256)))
    on = F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(points) == F.col(kpoints)) & (F.col(full) == F.col(kfull))
    kept = marked.join(gone, on, "left_anti")
    if not many.isEmpty():
        kept = kept.join(many, on, "left_anti").unionByName(kept.join(many, on, "left_semi").dropDuplicates([id_col, points, full]))
    return kept.select(*docs.columns)


def keep_marked(marked: DataFrame, stays: DataFrame, on: Column, copies: str, key: list[str]) -> DataFrame:
    """marked rows that stays names; of those that it names `copies` > 1 times (repeated rows) one each.

    Whole rows are dealt once, for the join; only repeated rows, where there are any, are dealt again.
    """
    once = marked.join(stays.where(F.col(copies) == 1), on, "left_semi")
    many = stays.where(F.col(copies) > 1)
    if many.isEmpty():
        return once
    return once.unionByName(marked.join(many, on, "left_semi").dropDuplicates(key))
