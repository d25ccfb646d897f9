"""Mixing sources to target weights with Pareto order sampling.

Targets come from capped proportional shares.  Every document gets the certain whole copies of its
source's factor target / size; the words still missing come from one Pareto order sample per source.
A document's inclusion probability in that sample falls with its size class, so long documents
don't fill a small remainder; documents whose probability reaches 1 are certain.  The sample's fixed
size is counted in words: the longest prefix of the Pareto order that doesn't exceed the remainder.
Where the next document is so long that more than NEAR of the target would stay open, the order goes
on with the documents that still fit, and the smallest one left is added if that comes nearer.

A source may hold a large share of all rows, so no source is sorted: its order keys are a 36-bit
integer, two histogram levels of 4096 bins find the crossing bin, and only that bin's rows (one in
16 million on average) are ordered, pre-aggregated by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import table

WORD = "[^\\x20\\x09-\\x0D]+"
SEED = 20_011
KEY_BITS, DIGIT = 36, 12
#: Share of the weight that each doubling of the size leaves.
DAMPING = 2.0**-0.5
#: Share of a target that may stay open while a document fits; passes over the order at most.
NEAR, PASSES = 0.01, 3


def words(text: Column) -> Column:
    """Number of words, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with rank (from 0, by col, null last) and without one task that holds all rows."""
    dealt = df.repartitionByRange(F.col(col).asc_nulls_last()).withColumn("part_", F.spark_partition_id())
    dealt = table(dealt.withColumn("at_", F.row_number().over(W.partitionBy("part_").orderBy(F.col(col).asc_nulls_last())) - 1), name)
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))  # one row a partition
    before = F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("part_", F.coalesce(before, F.lit(0)).alias("offset_"))
    return dealt.join(offsets, "part_").withColumn("rank", F.col("at_") + F.col("offset_")).drop("part_", "at_", "n_", "offset_")


def capped_shares(df: DataFrame, weight: str, cap: str, total: float) -> DataFrame:
    """df with target: shares of total in proportion to weight, stopped at cap, the excess reshared until none is above.

    Each round stops at least one more row; the driver sees three numbers a round.
    """
    level = None
    while True:
        full = F.lit(False) if level is None else F.col(weight) * F.lit(level) > F.col(cap)
        held, open_, n = df.agg(F.sum(F.when(full, F.col(cap)).otherwise(F.lit(0.0))), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col(weight))), F.count_if(full)).first()
        new = max(0.0, total - (held or 0.0)) / open_ if open_ else None
        if new is None or new == level or (level is not None and n == before):
            break
        level, before = new, n
    if level is None:
        return df.withColumn("target", F.col(cap))
    return df.withColumn("target", F.least(F.col(cap), F.col(weight) * F.lit(level)))


def _inclusion(classes: DataFrame, group: str) -> DataFrame:
    """lam per (group, size class): min(1, c * weight) with the group's expected words equal to need.

    classes: group, class, w, words, need; at most 64 classes a group.  From the heaviest weight down,
    the classes that reach 1 are a prefix; c is solved on what is left after it.
    """
    down = W.partitionBy(group).orderBy(F.col("w").desc())
    before = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing))
    stepped = classes.withColumn("c", F.try_divide(F.col("need") - before, rest))
    fits = F.when(F.col("c") * F.col("w") < 1, F.struct((-F.col("w")).alias("low"), F.col("c").alias("c")))
    stepped = stepped.withColumn("first", F.min(fits).over(W.partitionBy(group)))
    inner = F.greatest(F.lit(0.0), F.col("first.c") * F.col("w"))
    certain = F.col("first").isNull() | (F.col("w") > -F.col("first.low"))
    return stepped.select(group, "class", F.when(certain, F.lit(1.0)).otherwise(inner).alias("lam"))


def _cut(rows: DataFrame, needs: DataFrame, group: str) -> DataFrame:
    """(group, cut): keys up to cut are the longest prefix of the key order whose words don't exceed need.

    rows: group, key, size.  needs: group, need.  Groups whose words are all under need don't appear.
    """
    at = needs.select(group, "need", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(KEY_BITS - DIGIT, -1, -DIGIT):
        bins = rows.withColumn("prefix", F.shiftright(F.col("key"), shift + DIGIT)).join(at, [group, "prefix"])
        bins = bins.groupBy(group, "need", "base", F.shiftright(F.col("key"), shift).alias("digit")).agg(F.sum("size").alias("words"))
        bins = table(bins, f"mix_bins_{shift}")  # else the sums themselves are dealt by group, a hot one in one task
        bins = bins.withColumn("upto", F.col("base") + F.sum("words").over(W.partitionBy(group).orderBy("digit")))
        crossing = bins.where("upto > need").groupBy(group, "need").agg(F.min(F.struct("digit", "upto", "words")).alias("x"))
        at = table(crossing.select(group, "need", (F.col("x.upto") - F.col("x.words")).alias("base"), F.col("x.digit").alias("prefix")), f"mix_cut_{shift}")
    return at.select(group, (F.col("prefix") - 1).alias("cut"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, size, source_size, target (its source's), copies, taken, text_hash.

    size counts words, null text: 0.  Sources by code point, null last, take the weights in turn and share
    the corpus size; a target stops at most times its source's size.  copies is floor(target /
    source_size) whole copies, and one more if the document is in its source's Pareto sample; taken is
    copies * size.  The random odds hash seed, source, id and text, so reruns agree and rows that agree
    in all of these are taken or left together.  Rows of size 0 take whole copies only.  Null is a source
    of its own.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    odds_hash = F.xxhash64(F.lit(seed), F.col(source_col).cast("string"), F.col(id_col), text)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), odds_hash.alias("h"))
    rows = table(rows, "mix_rows")
    sources = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source", "mix_sources")
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.select(F.col("rank").alias("s"), "source", "source_size", cycle.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    sources = table(sources, "mix_weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = capped_shares(sources, "weight", "cap", float(total))
    factor = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(factor)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = table(sources, "mix_targets")
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop("source", "weight", "cap")
    rows = table(rows.withColumn("class", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))))), "mix_joined")
    live = rows.where("size > 0 and need > 0")
    classes = live.groupBy("s", "need", "class").agg(F.sum("size").alias("words")).withColumn("w", F.pow(F.lit(DAMPING), F.col("class")))
    lams = table(_inclusion(classes, "s"), "mix_inclusion")
    u = (F.shiftrightunsigned("h", 11) + F.lit(0.5)) / F.lit(2.0**53)
    odds = u * (1 - F.col("lam"))  # Pareto's ratio q of odds, kept as q / (1 + q)
    key = F.least(F.floor(F.try_divide(odds, odds + F.col("lam") * (1 - u)) * F.lit(2.0**KEY_BITS)), F.lit((1 << KEY_BITS) - 1))
    rows = rows.join(lams, ["s", "class"], "left").withColumn("key", key).withColumn("open", F.col("need").cast("double"))
    rows = table(rows.withColumn("chosen", F.lit(False)), "mix_keys")
    for _ in range(PASSES):
        fits = rows.where(~F.col("chosen") & (F.col("size") > 0) & (F.col("size") <= F.col("open")))
        needs = table(fits.groupBy("s").agg(F.min("open").alias("need")), "mix_needs")
        cuts = table(_cut(fits.select("s", "key", "size"), needs, "s"), "mix_cuts")
        more = (F.col("size") > 0) & (F.col("size") <= F.col("open")) & (F.col("key") <= F.coalesce("cut", F.lit(1 << KEY_BITS)))
        rows = rows.join(cuts, "s", "left").withColumn("chosen", F.col("chosen") | more).drop("cut", "open")
        rows = table(rows, "mix_chosen")
        left = rows.groupBy("s", "need", "target").agg(F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0)).alias("got"))
        left = table(left.select("s", "target", (F.col("need") - F.col("got")).alias("open")), "mix_open")
        rows = rows.join(left.select("s", "open"), "s")
        if left.where(F.col("open") > F.lit(NEAR) * F.col("target")).isEmpty():
            break
    # One document more where that comes nearer than staying below.
    wide = F.col("open") > F.lit(NEAR) * F.col("target")
    extra = rows.where(wide & ~F.col("chosen") & (F.col("size") > 0)).groupBy("s").agg(F.min(F.struct("size", "key")).alias("x"))
    rows = rows.join(table(extra, "mix_extra"), "s", "left")
    over = F.coalesce(~F.col("chosen") & (F.struct("size", "key") == F.col("x")) & (F.col("size") < 2 * F.col("open")), F.lit(False))
    copies = F.col("whole") + (F.col("chosen") | over).cast("long")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash")
