"""Music cutting: bars, phrases, splices, endings, seams.

Splice candidates are a self-join of bars within a band of removed time: both sides carry the
band's bucket as an equi key, so candidates come from a hash join and not from all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.signal import cosine, crossfade_seconds

# Context beats, candidates kept, penalty and window of a button ending, audible seam.
CONTEXT, CANDIDATES, AUDIBLE, SIMILAR = 4, 4, 1.25, 0.70
BUTTON_PENALTY, BUTTON_BEFORE, BUTTON_AFTER = 0.15, 2.0, 0.5
HOLD_S, MAX_TAIL_S, TAIL_FADE_S = 0.05, 2.0, 1.8


def bars(beats: DataFrame, key: str, phase: Column | int = 0) -> DataFrame:
    """Beats (key, i, t, ...) on a bar start, numbered k from 0."""
    phase = F.lit(phase) if isinstance(phase, int) else phase
    rows = beats.where(F.col("i") % 4 == phase)
    return rows.withColumn("k", (F.row_number().over(W.partitionBy(key).orderBy("i")) - 1).cast("long"))


def phrase_bonus(ka: Column, kb: Column) -> Column:
    return F.when((ka % 8 == 0) & (kb % 8 == 0), 0.10).when((ka % 4 == 0) & (kb % 4 == 0), 0.05).otherwise(F.lit(0.0))


def windows(feats: DataFrame, key: str, n: int = CONTEXT) -> DataFrame:
    """feats (key, i, feat) with before and after: the features of the n beats up to and from each beat, in a row."""
    w = W.partitionBy(key).orderBy("i")
    each = F.collect_list(F.col("feat"))
    return feats.withColumns({"before": F.flatten(each.over(w.rowsBetween(-n, -1))), "after": F.flatten(each.over(w.rowsBetween(0, n - 1)))})


def pair_score(a_before: Column, a_after: Column, b_before: Column, b_after: Column) -> Column:
    """Mean of the two similarities that aren't 0; 0 if both are."""
    p, q = cosine(a_before, b_before), cosine(a_after, b_after)
    return F.when((p != 0) & (q != 0), (p + q) / 2).otherwise(p + q)


def band_pairs(points: DataFrame, key: str, distance: float, tolerance: float, t: str = "t") -> DataFrame:
    """Pairs a, b (structs of points) of a key with b later by distance, give or take tolerance."""
    width = 2 * tolerance if tolerance > 0 else 1.0
    cols = F.struct(*points.columns)
    left = points.select(key, cols.alias("a")).withColumn("bucket", F.floor((F.col(f"a.{t}") + distance) / width))
    right = points.select(key, cols.alias("b")).withColumn("own", F.floor(F.col(f"b.{t}") / width))
    right = right.withColumn("bucket", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    near = F.abs(F.col(f"b.{t}") - F.col(f"a.{t}") - distance) <= tolerance
    return left.join(right, [key, "bucket"]).where(near & (F.col(f"b.{t}") > F.col(f"a.{t}"))).drop("bucket")


def single_splices(marked: DataFrame, key: str, distance: float, bar: float) -> DataFrame:
    """Ranked splices that remove about `distance`: within one bar, or two bars where there is none.

    marked: bars with k, before, after.  Columns: key, ka, kb, a, b (beat i), removed, similarity, rank_score, phrase_aligned, bars_removed.
    """
    pairs = band_pairs(marked.select(key, "i", "k", F.col("t").cast("double").alias("t"), "before", "after"), key, distance, 2 * bar)
    removed = F.col("b.t") - F.col("a.t")
    score = pair_score(F.col("a.before"), F.col("a.after"), F.col("b.before"), F.col("b.after"))
    bonus = phrase_bonus(F.col("a.k"), F.col("b.k"))
    rows = pairs.select(
        key, F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), F.col("a.i").alias("a"), F.col("b.i").alias("b"), removed.alias("removed"), score.alias("similarity"),
        (score + bonus).alias("rank_score"), (bonus > 0).alias("phrase_aligned"), F.bround(removed / bar).cast("long").alias("bars_removed"),
    )
    tier = F.when(F.abs(F.col("removed") - distance) <= bar, 1).otherwise(2)
    return rows.withColumn("tier_", tier).withColumn("best_", F.min("tier_").over(W.partitionBy(key))).where("tier_ = best_").drop("tier_", "best_")


def ranked(splices: DataFrame, key: str, n: int = CANDIDATES, score: str = "rank_score") -> DataFrame:
    order = W.partitionBy(key).orderBy(F.col(score).desc(), "ka", "kb")
    return splices.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def two_splices(marked: DataFrame, key: str, distance: float, bar: float) -> DataFrame:
    """The first feasible pair of disjoint splices that remove `distance` together, give or take a bar; first goes by score."""
    cols = F.struct("i", "k", "t", "before", "after")
    b = marked.select(key, "i", "k", F.col("t").cast("double").alias("t"), "before", "after").withColumn("slot_", F.floor(F.col("t") / F.lit(float(distance))))
    # A splice is shorter than the distance, so its end lies in its start's stretch of that length or the next.
    right = b.select(key, cols.alias("b"), F.explode(F.array(F.col("slot_") - 1, F.col("slot_"))).alias("slot_"))
    pairs = b.select(key, "slot_", cols.alias("a")).join(right, [key, "slot_"]).withColumn("removed", F.col("b.t") - F.col("a.t"))
    pairs = pairs.where((F.col("removed") > 0.5 * bar) & (F.col("removed") < distance - 0.5 * bar))
    sim = pair_score(F.col("a.before"), F.col("a.after"), F.col("b.before"), F.col("b.after"))
    rows = pairs.select(key, F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), F.col("a.i").alias("a"), F.col("b.i").alias("b"), "removed", sim.alias("similarity"))
    lift = F.when(phrase_bonus(F.col("ka"), F.col("kb")) > 0, 0.05).otherwise(0.0)
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy((F.col("similarity") + lift).desc(), "ka", "kb")))
    # What the second splice must remove, give or take a bar, is known: both carry it as a bucket.
    own, wanted = F.floor(F.col("removed") / (2 * bar)), F.floor((F.lit(distance) - F.col("removed")) / (2 * bar))
    one = rows.withColumn("need_", F.explode(F.array(wanted - 1, wanted, wanted + 1))).alias("x")
    two = rows.withColumn("need_", own).alias("y")
    apart = (F.col("y.b") <= F.col("x.a")) | (F.col("y.a") >= F.col("x.b"))
    fits = F.abs(F.col("y.removed") - (F.lit(distance) - F.col("x.removed"))) <= bar
    both = one.join(two, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.need_") == F.col("y.need_")) & apart & fits)
    first = both.groupBy(F.col(f"x.{key}").alias(key)).agg(F.min(F.struct(F.col("x.place").alias("p"), F.col("y.place").alias("q"), F.struct("x.a", "x.b", "x.removed", "x.similarity").alias("one"), F.struct("y.a", "y.b", "y.removed", "y.similarity").alias("two"))).alias("m"))
    low, high = F.least("m.one", "m.two"), F.greatest("m.one", "m.two")
    return first.select(key, low["a"].alias("a1"), low["b"].alias("b1"), high["a"].alias("a2"), high["b"].alias("b2"), (low["removed"] + high["removed"]).alias("removed"), low["similarity"].alias("similarity1"), high["similarity"].alias("similarity2"))


def button(beats: DataFrame, key: str, target: float, phase: Column | int = 0) -> DataFrame:
    """key, hit: the downbeat near the target with the best strength less a penalty for its distance, else the beat nearest to it."""
    phase = F.lit(phase) if isinstance(phase, int) else phase
    far = F.abs(F.col("t") - target)
    inside = (F.col("i") % 4 == phase) & (F.col("t") >= target - BUTTON_BEFORE) & (F.col("t") <= target + BUTTON_AFTER)
    order = F.struct((~inside).alias("out"), F.when(inside, -(F.col("strength") - F.lit(BUTTON_PENALTY) * far)).otherwise(far).alias("cost"), "t")
    return beats.groupBy(key).agg(F.min(order).alias("m")).select(key, F.col("m.t").alias("hit"))


def last_boundary(marked: DataFrame, beats: DataFrame, key: str, target: float) -> DataFrame:
    """key, exit, kind: the last 4-bar phrase start up to the target, else the last beat, else the target itself."""
    phrase = marked.where((F.col("k") % 4 == 0) & (F.col("t") <= target)).groupBy(key).agg(F.max("t").alias("p"))
    beat = beats.groupBy(key).agg(F.max(F.when(F.col("t") <= target, F.col("t"))).alias("b"))
    kind = F.when(F.col("p").isNotNull(), "phrase_boundary").otherwise("beat")
    return beat.join(phrase, key, "left").select(key, F.coalesce("p", "b", F.lit(float(target))).alias("exit"), kind.alias("kind"))


def endings(exits: DataFrame, sting: str, bar: float, duration: Column, tail_fade: float = TAIL_FADE_S) -> DataFrame:
    """exits (exit, or hit for a button) with out_s and fade_s by the kind of ending: button, tail or fade."""
    if sting == "button":
        return exits.withColumns({"out_s": F.least(duration, F.col("hit") + HOLD_S + MAX_TAIL_S), "fade_s": F.lit(MAX_TAIL_S)})
    if sting == "tail":
        end = F.least(duration, F.col("exit") + tail_fade)
        return exits.withColumns({"out_s": end, "fade_s": end - F.col("exit")})
    return exits.withColumns({"out_s": F.col("exit"), "fade_s": F.least(F.lit(2.0 * bar), F.col("exit"))})


def segment_offsets(segments: DataFrame, key: str) -> DataFrame:
    """segments (idx, start, end, xfade: overlap with the one before) with offset in the output."""
    w = W.partitionBy(key).orderBy("idx")
    length, lap = F.col("end") - F.col("start"), F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col("xfade"))
    rows = segments.withColumns({"len_": length, "lap_": lap})
    before = F.coalesce(F.sum("len_").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("offset", before - F.sum("lap_").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("len_", "lap_")


def seam_ratios(flux: DataFrame, seams: DataFrame, key: str, window: float) -> DataFrame:
    """key, seam, ratio, audible: the largest flux around a seam against the 90th percentile of the others.

    flux: key, t, flux at ordinary onsets; seams: key, seam.  Both joins carry the window's bucket.
    """
    width = 2 * window
    f = flux.withColumn("b_", F.floor(F.col("t") / width))
    s = seams.withColumn("b_", F.explode(F.array(*(F.floor(F.col("seam") / width) + d for d in (-1, 0, 1)))))
    near = F.abs(F.col("t") - F.col("seam")) <= window
    inside = f.join(s, [key, "b_"]).where(near)
    top = inside.groupBy(key, "seam").agg(F.max("flux").alias("top"))
    rest = f.join(inside.select(key, "t"), [key, "t"], "left_anti")
    p90 = rest.groupBy(key).agg(F.percentile("flux", F.lit(0.9)).alias("p90"))
    rows = seams.join(top, [key, "seam"], "left").join(p90, key, "left")
    ratio = F.coalesce(F.try_divide(F.coalesce("top", F.lit(0.0)), F.when(F.col("p90") > 1e-9, F.col("p90"))), F.lit(0.0))
    return rows.select(key, "seam", ratio.alias("ratio"), (ratio > AUDIBLE).alias("audible"))


def first_quiet(candidates: DataFrame, key: str) -> DataFrame:
    """Of tried candidates (key, try, worst) the first whose worst seam isn't audible, else the least bad, the earlier of equals."""
    quiet = F.col("worst") <= AUDIBLE
    order = F.struct((~quiet).alias("loud"), F.when(quiet, F.lit(0.0)).otherwise(F.col("worst")).alias("w"), "try")
    return candidates.groupBy(key).agg(F.min(order).alias("m")).select(key, F.col("m.try").alias("try"), (~F.col("m.loud")).alias("accepted"))


def plan_quality(splices: DataFrame, key: str) -> DataFrame:
    """key, splices, aligned (all of them are), weakest (the least similarity), removed of the splices of a cut."""
    return splices.groupBy(key).agg(F.count(F.lit(1)).alias("splices"), F.bool_and("phrase_aligned").alias("aligned"), F.min("similarity").alias("weakest"), F.sum("removed").alias("removed"))


def cut_plan(feats: DataFrame, key: str, removed: float, target: float, bar: float, beat: float, floor: float = SIMILAR) -> DataFrame:
    """key, strategy, splices, aligned, weakest, removed, out_s, fade_s: how each song is cut by `removed` seconds.

    feats: key, i, t, feat, strength, a row a beat.  The best splice does if it is similar enough, else the first pair
    of splices that both are; else the song ends with a button near the target.  Splices overlap by a
    crossfade that grows as they match less.
    """
    marked = bars(windows(feats, key), key)
    single = single_splices(marked, key, removed, bar).withColumn("rank_score", F.round("rank_score", 9))
    one = ranked(single, key, 1).select(key, "ka", "kb", "removed", "similarity", "phrase_aligned").where(F.col("similarity") >= floor)
    both = two_splices(marked, key, removed, bar).where(F.least("similarity1", "similarity2") >= floor).join(one.select(key), key, "left_anti")
    pieces = F.explode(F.array(*(F.struct(F.col(f"a{n}").alias("a"), F.col(f"b{n}").alias("b"), F.col(f"similarity{n}").alias("similarity")) for n in (1, 2)))).alias("s")
    number = marked.select(key, "i", "k", F.col("t").cast("double").alias("t"))
    two = both.select(key, pieces).select(key, "s.*")
    for end in ("a", "b"):
        two = two.join(number.select(key, F.col("i").alias(end), F.col("k").alias("k" + end), F.col("t").alias("t" + end)), [key, end])
    two = two.select(key, "ka", "kb", (F.col("tb") - F.col("ta")).alias("removed"), "similarity", (phrase_bonus(F.col("ka"), F.col("kb")) > 0).alias("phrase_aligned"))
    splices = one.unionByName(two).withColumn("xfade", crossfade_seconds(F.col("similarity"), F.lit(beat)))
    lost = splices.groupBy(key).agg(F.sum(F.col("removed") + F.col("xfade")).alias("lost_"))
    songs = feats.groupBy(key).agg((F.max("t") + beat).alias("duration"))
    rows = songs.join(plan_quality(splices, key), key, "left").join(lost, key, "left").join(endings(button(feats, key, target).join(songs, key), "button", bar, F.col("duration")).select(key, "out_s", "fade_s"), key)
    cut = F.col("splices").isNotNull()
    return rows.select(
        key, F.when(cut, "seamless").otherwise("button").alias("strategy"), F.coalesce("splices", F.lit(0)).cast("long").alias("splices"), F.coalesce("aligned", F.lit(False)).alias("aligned"), F.coalesce("weakest", F.lit(0.0)).alias("weakest"),
        F.coalesce("removed", F.lit(0.0)).alias("removed"), F.when(cut, F.col("duration") - F.col("lost_")).otherwise(F.col("out_s")).alias("out_s"), F.when(cut, F.lit(0.0)).otherwise(F.col("fade_s")).alias("fade_s"),
    )


def retried(candidates: DataFrame, flux: DataFrame, key: str, window: float) -> DataFrame:
    """Of ranked candidates (key, place, seams: times) the first whose worst seam isn't audible, else the least bad: key, try, accepted, worst."""
    named = candidates.withColumn("id_", F.concat_ws("#", key, "place"))
    own = flux.join(named.select(key, "id_"), key).select("id_", "t", "flux")
    seams = named.select("id_", F.explode("seams").alias("seam")).distinct()
    worst = seam_ratios(own, seams, "id_", window).groupBy("id_").agg(F.max("ratio").alias("worst"))
    tried = named.join(worst, "id_").select(key, F.col("place").alias("try"), "worst")
    return first_quiet(tried, key).join(tried, [key, "try"])
