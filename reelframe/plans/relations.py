"""Queries over the small relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as ops
from ..sources.views import CLIPS_SQL, clips, read
from .registry import query


@query(f"WITH {CLIPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY timeline, path ORDER BY idx) AS r FROM clips) SELECT timeline, path, idx, kind, seconds FROM r WHERE r = 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clip of each path on a timeline."""
    return ops.first_by(clips(spark, sf_dir).select("timeline", "path", "idx", "kind", "seconds"), ["timeline", "path"], ["idx"])


@query("SELECT p_partkey AS k, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AS found FROM part")
def present_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that some large line uses, and those that none does."""
    asked = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    known = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").cast("long").alias("k"))
    here, gone = ops.present(asked, known, "k")
    return here.withColumn("found", F.lit(True)).unionByName(gone.withColumn("found", F.lit(False)))


@query("WITH a AS (SELECT c_custkey AS k, c_nationkey * 2 AS n FROM customer) SELECT k, n, coalesce(n_name, '') AS name, n_name IS NULL AS missing FROM a LEFT JOIN nation ON n_nationkey = n")
def names_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") * 2).alias("n"))
    items = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"))
    return ops.match_names(asked, items, "n").fillna("", ["name"])


@query(f"WITH {CLIPS_SQL}, r AS (SELECT timeline, idx, row_number() OVER (PARTITION BY timeline ORDER BY idx) AS o FROM clips WHERE kind = 'video') SELECT timeline, idx, CAST(o AS INTEGER) AS ordinal FROM r WHERE o IN (1, 3)")
def clips_at_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.at_ordinals(clips(spark, sf_dir).where("kind = 'video'").select("timeline", "idx"), ["timeline"], ["idx"], [1, 3])


@query("SELECT n_name AS method, regexp_matches(n_name, '^(NATION|Get|Set)([A-Z]|$)') AND NOT starts_with(n_name, '_') AS allowed FROM nation")
def methods_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("method"), ops.allowed(F.col("n_name"), ["NATION", "Get", "Set"]).alias("allowed"))
