"""License scan: an exact set-similarity join of text blocks with license templates.

A block of a template is a run of as many words as the template has, anywhere in the text, over line ends
as well.  Tokens are ordered by global document frequency, rarest first.  A template whose threshold
needs m of its n tokens can only match a block that holds one of its first n - m + 1 tokens (prefix): places
of these are joined to the templates that they lead.  Around such a place there must be m of the
template's tokens within its length (length), not rarer than the one at the place (position: blocks with a rarer
one are found from there); the blocks that pass are verified exactly.  Only DataFrame expressions run, in one scan of
the texts.  The templates are one literal, so the plan doesn't grow with them; blocks stay in their row, so nothing
is shuffled but one count per vocabulary token.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import table

#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of public license notices, by label.  Of up to four different words the threshold needs all.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": ("gnu affero general public",),
    "apache-2.0": (
        "apache license version 2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "cc-by-4.0": ("commons attribution 4 0", "cc by 4 0"),
    "cc-by-nc-4.0": ("attribution noncommercial 4 0", "by nc 4 0"),
    "cc-by-sa-4.0": ("attribution sharealike 4 0", "by sa 4 0"),
    "cc0-1.0": ("cc0 1 0 universal",),
    "copyright": ("copyright c",),
    "gpl-3.0": ("public license version 3",),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("gnu lesser general public",),
    "mit": ("under the mit license",),
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "mpl-2.0": (
        "mozilla public license 2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}
THRESHOLD = 0.8
NO_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def _blanks(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str | Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    templates gives each label one template or several.  blocks lists all matches in order as (block, label,
    containment): block is the place of its first word, from 0, which is a word of the template; a block is as many words
    long as the template (or up to the end of the text), and containment is the share of the template's
    different words that it holds, at least `threshold`.  labels joins the phrases' labels with those of all
    matches; score is the largest containment, 1 where a phrase stands.  Ties among blocks don't arise, as all
    are listed.  Null text counts as empty: no words, no labels, score 0.  Very long texts are read as a whole.  Repeated
    rows each get a row; other columns are ignored, whatever their names.  An empty table gives an empty result.  The
    vocabulary of the templates is the only thing that reaches the driver or other tasks.
    """
    flat = [(label, t.split()) for label, own in templates.items() for t in ([own] if isinstance(own, str) else own)]
    vocabulary = sorted({w for _, t in flat for w in t})
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), NO_WORD, " ")
    phrase = f" {_any(list(phrases))}(?= )"
    # Java matches (?i) in ASCII only, so no other letter is folded.
    rows = docs.select(F.col(id_col).alias("id"), spaced.alias("spaced"))
    base = F.col("n_base") > 0
    rows = rows.select("id", (_blanks(F.col("spaced")) - 1).alias("n_words"), F.regexp_count("spaced", F.lit("(?i)" + phrase)).cast("long").alias("n_base"), "spaced").select(
        "id", "n_words", "n_base",
        F.when(base, _blanks(F.regexp_extract("spaced", f"(?is)^(.*?){phrase}", 1))).alias("first_word"),
        F.when(base, _blanks(F.regexp_extract("spaced", f"(?is)^(.*){phrase}", 1))).alias("last_word"),
        F.when(base, F.array_compact(F.array(*(F.when(F.col("spaced").rlike(f"(?i) {p}(?= )"), F.lit(v)) for p, v in phrases.items())))).otherwise(_strings([])).alias("found"),
        _hits(F.col("spaced"), vocabulary).alias("hits"),
    )
    rows = table(rows, "license_rows")
    tokens = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("token"))
    counted = {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    found = rows.withColumn("matches", _matches(flat, order, threshold))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined(F.col("found")).alias("base_labels"),
        joined(F.concat("found", F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(base, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))).alias("score"), F.col("matches").alias("blocks"),
    )


def _hits(spaced: Column, vocabulary: Sequence[str]) -> Column:
    """Place (from 0) and token of every word of the vocabulary, in order."""
    if not vocabulary:
        return F.array().cast("array<struct<at:int,w:string>>")
    # Some letters outside ASCII become a-z in lower case, in fewer bytes; those aren't words of the vocabulary.
    lowered = F.transform(F.split(spaced, " "), lambda w, i: F.struct((i - 1).alias("at"), F.when(F.octet_length(F.lower(w)) == F.octet_length(w), F.lower(w)).alias("w")))
    return F.filter(lowered, lambda h: h["w"].isin(vocabulary))


def _need(tokens: Sequence[str], threshold: float) -> int:
    """The smallest overlap m with m / n >= threshold."""
    return next(m for m in range(1, len(tokens) + 2) if m >= threshold * len(tokens) - 1e-9)


def _matches(flat: Sequence[tuple[str, Sequence[str]]], order: Sequence[str], threshold: float) -> Column:
    """The blocks among `hits` that hold enough of a template; order: all tokens, the rarest first."""
    none = F.array().cast("array<struct<block:long,label:string,containment:double>>")
    entries, leads = [], set()
    for label, t in flat:
        own = sorted(set(t), key=order.index)
        need = _need(own, threshold)
        if 0 < need <= len(own):
            lead = own[: len(own) - need + 1]
            entries.append({"label": label, "words": len(t), "need": need, "tokens": own, "lead": lead})
            leads.update(lead)
    if not entries:
        return none
    known = F.from_json(F.lit(json.dumps(entries)), "array<struct<label:string,words:int,need:int,tokens:array<string>,lead:array<string>>>")
    held = lambda hits: F.size(F.array_distinct(F.transform(hits, lambda y: y["w"])))

    def around(x: Column, t: Column) -> Column:
        """The template's tokens that one block could hold together with place x."""
        part = F.slice("hits", F.greatest(x["i"] - t["words"] + 2, F.lit(1)), 2 * t["words"] - 1)  # places are distinct
        return F.filter(part, lambda y: (F.abs(y["at"] - x["at"]) < t["words"]) & F.array_contains(t["tokens"], y["w"]))

    def enough(c: Column) -> Column:
        t, rank = c["t"], F.array_position(c["t"]["tokens"], c["x"]["w"])
        return held(F.filter(c["near"], lambda y: F.array_position(t["tokens"], y["w"]) >= rank)) >= t["need"]

    def blocks(c: Column) -> Column:
        x, t = c["x"], c["t"]
        starts = F.filter(c["near"], lambda s: (s["at"] <= x["at"]) & (s["at"] + t["words"] > x["at"]))
        sizes = F.transform(starts, lambda s: F.struct(s["at"].cast("long").alias("block"), held(F.filter(c["near"], lambda y: (y["at"] >= s["at"]) & (y["at"] < s["at"] + t["words"]))).alias("m")))
        return F.transform(F.filter(sizes, lambda s: s["m"] >= t["need"]), lambda s: F.struct(s["block"].alias("block"), t["label"].alias("label"), (s["m"] / F.size(t["tokens"]).cast("double")).alias("containment")))

    places = F.filter(F.transform("hits", lambda h, i: F.struct(h["at"].alias("at"), h["w"].alias("w"), i.alias("i"))), lambda x: x["w"].isin(sorted(leads)))
    led = F.flatten(F.transform(places, lambda x: F.transform(F.filter(known, lambda t: F.array_contains(t["lead"], x["w"])), lambda t: F.struct(x.alias("x"), t.alias("t"), around(x, t).alias("near")))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(led, enough), blocks))))
