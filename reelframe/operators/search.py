"""Search over words: phrases, all-words, regular expressions, context, selects.

Hits are windows over (key, pos); the file gate is a semi-join on counts that aggregate before the
shuffle.  Only the regular expression needs Python, for its engine, in one Arrow pass per file.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _w(key: str) -> W:
    return W.partitionBy(key).orderBy("pos")


def phrase(words: DataFrame, key: str, tokens: Sequence[str]) -> DataFrame:
    """Places where the tokens stand in a row, overlapping ones too: key, pos, last (pos), start_ms, end_ms, text."""
    k, w = len(tokens), _w(key)
    first = words.withColumns({
        "last": F.col("pos") + (k - 1), "end_at": F.lead("end_ms", k - 1).over(w) if k > 1 else F.col("end_ms"),
        "fits": F.array(*(F.lead("norm", j).over(w) if j else F.col("norm") for j in range(k))) == F.array(*map(F.lit, tokens)),
        "said": F.concat_ws(" ", *(F.trim(F.lead("word", j).over(w)) if j else F.trim("word") for j in range(k))),
    })
    return first.where(F.coalesce("fits", F.lit(False))).select(key, "pos", "last", "start_ms", F.col("end_at").alias("end_ms"), F.col("said").alias("text"))


def files_with_all(words: DataFrame, key: str, tokens: Sequence[str]) -> DataFrame:
    """Keys of the files that hold every token."""
    wanted = sorted(set(tokens))
    return words.where(F.col("norm").isin(*wanted)).groupBy(key).agg(F.count_distinct("norm").alias("n")).where(F.col("n") == len(wanted)).select(key)


def all_words(words: DataFrame, key: str, tokens: Sequence[str]) -> DataFrame:
    """Every occurrence of any token, in files that hold all of them."""
    hits = words.where(F.col("norm").isin(*set(tokens))).join(files_with_all(words, key, tokens), key, "left_semi")
    return hits.select(key, "pos", F.col("pos").alias("last"), "start_ms", "end_ms", F.trim("word").alias("text"))


def regex(words: DataFrame, key: str, pattern: str) -> DataFrame:
    """Matches over a file's normalised words joined by blanks, widened to whole words: key, pos, last, start_ms, end_ms, text."""
    compiled = re.compile(pattern, re.IGNORECASE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, ws in zip(batch[key], batch["ws"], strict=True):
                place = [k for k, w in enumerate(ws) if w["norm"]]
                said = [ws[k]["norm"] for k in place]
                starts = [0, *accumulate(len(w) + 1 for w in said)][:-1]
                ends = [at + len(w) for at, w in zip(starts, said, strict=True)]
                for m in compiled.finditer(" ".join(said)):
                    # The words that a match touches: from the first that ends behind its start to the last that starts before its end.
                    first, last = bisect_right(ends, m.start()), bisect_left(starts, m.end()) - 1
                    if first <= last:
                        a, b = place[first], place[last]
                        inner = [w["word"].strip() for w in ws[a : b + 1]]
                        out.append((name, ws[a]["pos"], ws[b]["pos"], ws[a]["start_ms"], ws[b]["end_ms"], " ".join(inner)))
            yield pd.DataFrame(out, columns=[key, "pos", "last", "start_ms", "end_ms", "text"])

    kind = dict(words.dtypes)[key]
    grouped = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "norm", "word", "start_ms", "end_ms"))).alias("ws"))
    return grouped.mapInPandas(run, f"{key} {kind}, pos long, last long, start_ms long, end_ms long, text string")


def with_context(hits: DataFrame, words: DataFrame, key: str, context_ms: int = 1500) -> DataFrame:
    """hits with context, context_start, context_end: the words around that start or end within context_ms.

    Hits meet the words of the stretches of time that they reach into, so only words near a hit are looked at.
    """
    width = max(1, context_ms)
    slot = lambda t: F.floor(t / F.lit(width))
    spans = hits.select(key, "pos", "last", F.col("start_ms").alias("from_"), F.col("end_ms").alias("to_")).distinct()
    reach = spans.withColumn("slot_", F.explode(F.sequence(slot(F.col("from_") - context_ms), slot(F.col("to_") + context_ms))))
    said = words.select(key, F.col("pos").alias("at_"), F.trim("word").alias("w"), "start_ms", "end_ms", slot(F.col("start_ms")).alias("slot_"))
    back = (F.col("start_ms") <= F.col("from_")) & (F.col("from_") - F.col("start_ms") <= context_ms)
    ahead = (F.col("end_ms") >= F.col("to_")) & (F.col("end_ms") - F.col("to_") <= context_ms)
    near = said.join(reach, [key, "slot_"]).withColumns({"back_": back, "ahead_": ahead}).where("back_ or ahead_")
    item = F.struct("at_", "w")
    rows = near.groupBy(key, "pos", "last").agg(
        F.min(F.when(F.col("back_"), F.col("start_ms"))).alias("context_start"), F.max(F.when(F.col("ahead_"), F.col("end_ms"))).alias("context_end"),
        F.collect_list(F.when(F.col("back_") & (F.col("at_") < F.col("pos")), item)).alias("b"), F.collect_list(F.when(F.col("ahead_") & (F.col("at_") > F.col("last")), item)).alias("a"),
    )
    join = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["w"]), " ")
    rows = hits.join(rows, [key, "pos", "last"])
    text = F.trim(F.concat_ws(" ", F.when(F.size("b") > 0, join(F.col("b"))), F.col("text"), F.when(F.size("a") > 0, join(F.col("a")))))
    return rows.select(*hits.columns, text.alias("context"), "context_start", "context_end")


def ordered(hits: DataFrame, files: DataFrame, key: str, rank: str) -> DataFrame:
    """hits with hit (from 1): by the files' rank, then start, then pos."""
    ranked = hits.join(files.select(key, rank), key)
    # Per-file numbers plus offsets of the files before: no task holds all hits.
    own = ranked.withColumn("n_", F.row_number().over(W.partitionBy(key).orderBy("start_ms", "pos")))
    counts = ranked.groupBy(key, rank).agg(F.count(F.lit(1)).alias("c_"))
    before = counts.select(key, F.coalesce(F.sum("c_").over(W.orderBy(rank).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return own.join(before, key).withColumn("hit", (F.col("n_") + F.col("before_")).cast("long")).drop("n_", "before_")


def selects(hits: DataFrame, pad_ms: int = 500) -> DataFrame:
    """hits padded on both sides, from 0 on."""
    return hits.withColumns({"in_ms": F.greatest(F.lit(0).cast("long"), F.col("start_ms") - pad_ms), "out_ms": F.col("end_ms") + pad_ms})


def files_without(hits: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return files.join(hits, key, "left_anti")
