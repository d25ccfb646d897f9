"""The tool surface: knowledge lookup, argument checks, bin trees, marker updates."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grading
from ..sources.views import read
from .registry import query


def check_arguments(given: Mapping[str, object], properties: Sequence[str], required: Sequence[str]) -> str | None:
    """What is wrong with a call's argument names: missing ones first, then unknown ones."""
    missing, unknown = [r for r in required if r not in given], sorted(set(given) - set(properties))
    if missing:
        return f"missing required argument(s): {', '.join(missing)}"
    return f"unknown argument(s): {', '.join(unknown)}" if unknown else None


def overlay(defaults: Mapping[str, object], given: Mapping[str, object] | None) -> dict[str, object]:
    """Defaults with what a configuration sets."""
    if given is not None and not isinstance(given, Mapping):
        raise ValueError("a configuration must be an object")
    return {**defaults, **(given or {})}


def read_config(path: str | os.PathLike[str], defaults: Mapping[str, object]) -> dict[str, object]:
    """Defaults with what a JSON file sets, unknown keys included; no file, or an empty one, sets nothing."""
    try:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    except FileNotFoundError:
        text = ""
    try:
        given = json.loads(text) if text.strip() else None
    except json.JSONDecodeError as error:
        raise ValueError(f"{path} holds no valid JSON: {error}") from error
    if text.strip() and not isinstance(given, dict):
        raise ValueError(f"{path} must hold a JSON object")
    return overlay(defaults, given)


def canonical(topic: F.Column) -> F.Column:
    """Topic names: trimmed, lower case, blanks and underscores as dashes, without `.md`."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(topic)), r"[\s_]+", "-"), r"\.md$", "")


def lookup(asked: DataFrame, topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (topic) with slug and summary, by name or alias; null where nothing fits."""
    rows = asked.withColumn("slug_", canonical(F.col("topic"))).join(aliases.toDF("slug_", "to_"), "slug_", "left")
    return rows.withColumn("slug", F.coalesce("to_", "slug_")).drop("slug_", "to_").join(topics, "slug", "left")


def walk(folders: DataFrame, depth: int = 32) -> DataFrame:
    """id, name, depth, path of a folder tree (id, parent, name), from its roots down.

    One join a level, until a level is empty; trees deeper than `depth` raise.
    """
    level = folders.where("parent is null").select("id", "name", F.lit(0).cast("long").alias("depth"), F.col("name").alias("path"))
    out = level
    for _ in range(depth):
        level = folders.join(level.select(F.col("id").alias("parent"), "depth", "path"), "parent").select("id", "name", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "name").alias("path"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the folder tree is deeper than {depth}, or has a cycle")


def update_markers(markers: DataFrame, changes: DataFrame) -> DataFrame:
    """markers (frame, name, color, note, duration) with what changes set; null leaves a field as it is."""
    fields = ("name", "color", "note", "duration")
    c = changes.select("frame", *(F.col(f).alias(f + "_") for f in fields))
    return markers.join(c, "frame", "left").select("frame", *(F.coalesce(f + "_", f).alias(f) for f in fields))


@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 4 THEN n_nationkey // 5 END AS parent, n_name AS name FROM nation),
    t AS (SELECT id, name, CAST(0 AS BIGINT) AS depth, name AS path FROM f WHERE parent IS NULL UNION ALL SELECT f.id, f.name, t.depth + 1, t.path || '/' || f.name FROM f JOIN t ON f.parent = t.id) SELECT * FROM t""")
def bin_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    f = read(spark, sf_dir, "nation").select(k.alias("id"), F.when(k > 4, F.floor(k / 5).cast("int")).alias("parent"), F.col("n_name").alias("name"))
    return walk(f)


@query("""SELECT o_orderkey AS frame, CASE WHEN o_orderkey % 2 = 0 THEN 'changed' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'Red' ELSE 'Blue' END AS color, '' AS note, CAST(1 AS BIGINT) AS duration FROM orders""")
def marker_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order a marker, with changes for those that have any."""
    k, none = F.col("o_orderkey"), F.lit(None)
    o = read(spark, sf_dir, "orders")
    m = o.select(k.alias("frame"), F.col("o_orderpriority").alias("name"), F.lit("Blue").alias("color"), F.lit("").alias("note"), F.lit(1).cast("long").alias("duration"))
    c = o.select(k.alias("frame"), F.when(k % 2 == 0, "changed").alias("name"), F.when(k % 5 == 0, "Red").alias("color"), none.cast("string").alias("note"), none.cast("long").alias("duration"))
    return update_markers(m, c)


@query("""WITH a AS (SELECT r_regionkey AS k, CASE r_regionkey WHEN 0 THEN ' Dead Air ' WHEN 1 THEN 'MIXING.md' WHEN 2 THEN 'loudness' WHEN 3 THEN 'color_grading' ELSE 'nothing' END AS topic FROM region),
    t(slug, summary) AS (VALUES ('dead-air', 'cut silence'), ('mixing', 'levels'), ('color-grading', 'looks')), al(alias, slug) AS (VALUES ('loudness', 'mixing')),
    n AS (SELECT *, regexp_replace(regexp_replace(lower(trim(topic)), '[\\s_]+', '-', 'g'), '\\.md$', '') AS s FROM a), r AS (SELECT k, coalesce(al.slug, s) AS slug FROM n LEFT JOIN al ON al.alias = s)
    SELECT k, r.slug, coalesce(summary, '') AS summary FROM r LEFT JOIN t USING (slug)""".replace("\\\\", "\\"))
def knowledge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    topic = F.when(k == 0, " Dead Air ").when(k == 1, "MIXING.md").when(k == 2, "loudness").when(k == 3, "color_grading").otherwise("nothing")
    topics = spark.createDataFrame([("dead-air", "cut silence"), ("mixing", "levels"), ("color-grading", "looks")], "slug string, summary string")
    aliases = spark.createDataFrame([("loudness", "mixing")], "alias string, slug string")
    return lookup(read(spark, sf_dir, "region").select(k.alias("k"), topic.alias("topic")), topics, aliases).select("k", "slug", F.coalesce("summary", F.lit("")).alias("summary"))


@query("SELECT c_custkey AS k, (c_custkey / 10.0::DOUBLE)::VARCHAR || ' 1.0 1.0' AS slope, '0.0 0.0 0.0' AS \"offset\", '1.0 1.0 1.0' AS power, CASE WHEN c_custkey % 2 = 0 THEN '0.5' ELSE '1.0' END AS saturation FROM customer")
def cdl_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    out = grading.cdl(F.array(k / F.lit(10.0), F.lit(1.0), F.lit(1.0)), None, None, F.when(k % 2 == 0, 0.5))
    return read(spark, sf_dir, "customer").select(k.alias("k"), *(c.alias(n.lower()) for n, c in out.items()))
