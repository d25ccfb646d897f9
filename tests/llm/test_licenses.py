import random
import re

from reelframe.llm import licenses

LINES = ["Licensed under the Apache License, Version 2.0.", "under Apache license version two", "This work is licensed under the GNU General Public License, version 3.",
         "x CC-BY y cc by", "CC BY CC BY", "All rights\n reserved", "all rightsreserved", "Released under the MIT License.", "the mit license is released the mit", "Kcc by K", "ŕcc by",
         "Copyright (c) 2020 me, ALL RIGHTS RESERVED.", "", "\x00\x7f!", "über général PUBLIC license", "general public license", "\u0130 rights", "Licensed under CC BY-NC 4.0."]


WRAPPED = [
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\n  * conditions are met",
    "x\nThis Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "released\nunder\nthe\nMIT\nlicense",
    "Permission is hereby granted,\nfree of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software",
    "Licensed under the Apache License,\nVersion 2.0",
]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def all_blocks(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    """Every run of a template's length that starts with one of its words."""
    w, out = words(text), set()
    for label, own in templates.items():
        for t in [own] if isinstance(own, str) else own:
            size, t = len(t.split()), set(t.split())
            for i in range(len(w)):
                share = len(set(w[i : i + size]) & t) / len(t)
                if w[i] in t and share >= threshold - 1e-9:
                    out.add((i, label, share))
    return sorted(out)


def brute(text):
    w, places, base = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        if at:
            base.add(label)
    found = all_blocks(text)
    j = lambda s: ",".join(sorted(s))
    return len(w), len(places), min(places, default=None), max(places, default=None), j(base), j(base | {b[1] for b in found}), 1.0 if places else max((b[2] for b in found), default=0.0)


ALL = [t for own in licenses.TEMPLATES.values() for t in own]


def test_against_brute_force(spark, docs, rows):
    rng = random.Random(4)
    vocabulary = sorted({w for t in ALL for w in t.split()})
    texts = [*LINES, "\n".join(LINES), " ".join(LINES), None, "word " * 3000 + LINES[0] + " tail" * 3000, "cc by " * 500, *WRAPPED]
    texts += [t[1] for t in rows] + ALL + [" ".join(v.split()[1:]) for v in ALL]
    for t in ALL:
        w = t.split()
        for _ in range(4):  # words lost, changed, swapped, and put in between
            own = list(w)
            for _ in range(rng.randint(1, 1 + len(w) // 5)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["x"], [own[at], "x"], [rng.choice(vocabulary)]])
                own = own or ["x"]
            texts.append(rng.choice([" ", "\n", ", "]).join(["pre"] * rng.randint(0, 3) + own + own[:3]))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 400))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS labels", "'y' AS id", "'z' AS hits", "'q' AS n_base")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:-1] == brute(t), t
        assert [tuple(b) for b in got[i].blocks] == all_blocks(t), t
    assert len(licenses.scan_licenses(docs).collect()) == len(rows)


def test_threshold_and_own_templates(spark):
    df = spark.createDataFrame([(1, "a b c\na b x y"), (2, "a b"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df, templates={"t": "a b c d", "u": ("q", "y")}, threshold=0.5).collect()}
    own = {"t": "a b c d", "u": ("q", "y")}
    assert [tuple(b) for b in got[1].blocks] == all_blocks("a b c a b x y", own, 0.5) and got[2].score == 0.5
    assert (got[None].n_words, got[None].labels, got[None].score, got[None].first_word) == (0, "", 0.0, None)
    assert licenses.scan_licenses(df, templates={}).where("labels <> ''").count() == 0


def test_scattered_words_are_no_license(spark):
    prose = " ".join(["released", *["x"] * 300, "under", *["y"] * 300, "the", *["z"] * 300, "mit", *["q"] * 300, "license"])
    other = "Released under the BSD license. Released under the usual license, version 3"
    df = spark.createDataFrame([(1, prose), (2, other)], "doc_id long, text string")
    assert {(r.doc_id, r.labels, r.score) for r in licenses.scan_licenses(df).collect()} == {(1, "", 0.0), (2, "", 0.0)}


def test_wrapped_notices(spark):
    df = spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(df).collect()}
    for i, label in enumerate(["gpl-notice", "bsd", "mpl-2.0", "mit", "mit-notice", "apache-2.0"]):
        assert label in got[i]


def test_the_plan_does_not_grow_with_the_templates(spark, docs):
    size = lambda templates: licenses.scan_licenses(docs, templates=templates)._jdf.queryExecution().optimizedPlan().toString().count("lambda")
    assert size({"a": "one two three"}) == size({f"a{i}": f"one two three w{i} v{i}" for i in range(300)})


def test_empty_table(none):
    assert licenses.scan_licenses(none).count() == 0


def test_no_python_runs(spark, docs):
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
