"""Queries over footage search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as ops
from ..sources.views import WORDS_SQL, read, words
from .registry import query

KEY = "doc_id"
PHRASE, WANTED, PATTERN = ("of", "the"), ("the", "of", "is"), r"\bth[a-z]*ing\b"

_SQL = f"WITH {WORDS_SQL},\n" + r"""
near AS (SELECT *, lead(norm) OVER w AS n1, lead(word) OVER w AS w1, lead(end_ms) OVER w AS end1 FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT doc_id, pos, pos + 1 AS last, start_ms, end1 AS end_ms, trim(word) || ' ' || trim(w1) AS text FROM near WHERE norm = 'of' AND n1 = 'the')
"""


def find_in_footage(words_: DataFrame, files: DataFrame, key: str, query_text: str, mode: str = "phrase", context_ms: int = 1500, rank: str | None = None) -> DataFrame:
    """Hits of a query with context, in the order of files and time; mode is phrase, all_words or regex."""
    if mode not in ("phrase", "all_words", "regex") or not query_text.strip():
        raise ValueError("mode must be phrase, all_words or regex, and the query must not be empty")
    if mode == "regex":
        hits = ops.regex(words_, key, query_text)
    else:
        import re

        tokens = [t for t in (re.sub(r"^[^\w']+|[^\w']+$", "", w.lower()) for w in query_text.split()) if t]
        hits = (ops.phrase if mode == "phrase" else ops.all_words)(words_, key, tokens)
    return ops.ordered(ops.with_context(hits, words_, key, context_ms), files, key, rank or key)


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = words(spark, sf_dir)
    return w, ops.phrase(w, KEY, PHRASE)


@query(_SQL + "SELECT * FROM hits")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)[1]


@query(_SQL + """, gate AS (SELECT doc_id FROM words WHERE norm IN ('the', 'of', 'is') GROUP BY doc_id HAVING count(DISTINCT norm) = 3)
    SELECT doc_id, pos, pos AS last, start_ms, end_ms, trim(word) AS text FROM words WHERE norm IN ('the', 'of', 'is') AND doc_id IN (SELECT doc_id FROM gate)""")
def search_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.all_words(words(spark, sf_dir), KEY, WANTED)


@query(_SQL + r""", joined AS (SELECT doc_id, string_agg(norm, ' ' ORDER BY pos) AS t FROM words WHERE norm <> '' GROUP BY doc_id)
    SELECT doc_id, CAST(len(regexp_extract_all(t, '\bth[a-z]*ing\b')) AS BIGINT) AS hits FROM joined WHERE len(regexp_extract_all(t, '\bth[a-z]*ing\b')) > 0""")
def search_regex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.regex(words(spark, sf_dir), KEY, r"(?-i:\bth[a-z]*ing\b)").groupBy(KEY).agg(F.count(F.lit(1)).alias("hits"))


@query(_SQL + """, c AS (SELECT h.*, (SELECT min(w.start_ms) FROM words w WHERE w.doc_id = h.doc_id AND w.start_ms <= h.start_ms AND h.start_ms - w.start_ms <= 1500) AS context_start,
           (SELECT max(w.end_ms) FROM words w WHERE w.doc_id = h.doc_id AND w.end_ms >= h.end_ms AND w.end_ms - h.end_ms <= 1500) AS context_end FROM hits h)
    SELECT c.doc_id, c.pos, c.last, c.start_ms, c.end_ms, c.text, context_start, context_end, string_agg(trim(w.word), ' ' ORDER BY w.pos) AS context
    FROM c JOIN words w ON w.doc_id = c.doc_id AND w.start_ms >= context_start AND w.end_ms <= context_end GROUP BY ALL""")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, hits = _hits(spark, sf_dir)
    return ops.with_context(hits, w, KEY)


@query(_SQL + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)")
def files_without_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.files_without(_hits(spark, sf_dir)[1], read(spark, sf_dir, "documents").select(KEY), KEY)


@query(_SQL + "SELECT doc_id, pos, start_ms, end_ms, greatest(0, start_ms - 500) AS in_ms, end_ms + 500 AS out_ms FROM hits")
def selects_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.selects(_hits(spark, sf_dir)[1]).drop("last", "text")


@query(_SQL + "SELECT h.doc_id, h.pos, row_number() OVER (ORDER BY d.n_chars DESC, h.doc_id, h.start_ms, h.pos) AS hit FROM hits h JOIN documents d USING (doc_id)")
def hit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order of falling length, as a caller's order."""
    _, hits = _hits(spark, sf_dir)
    files = read(spark, sf_dir, "documents").select(KEY, F.struct(-F.col("n_chars"), F.col(KEY)).alias("rank"))
    return ops.ordered(hits, files, KEY, "rank").select(KEY, "pos", "hit")


@query(_SQL.split("hits AS (", 1)[0] + r"""each AS (SELECT *, unnest(range(CAST(len(regexp_extract_all(norm, '(?i)\bth[a-z]*ing\b')) AS BIGINT))) AS m FROM words),
    hits AS (SELECT doc_id, pos, pos AS last, start_ms, end_ms, trim(word) AS text, m FROM each),
    c AS (SELECT h.*, (SELECT min(w.start_ms) FROM words w WHERE w.doc_id = h.doc_id AND w.start_ms <= h.start_ms AND h.start_ms - w.start_ms <= 1500) AS context_start,
          (SELECT max(w.end_ms) FROM words w WHERE w.doc_id = h.doc_id AND w.end_ms >= h.end_ms AND w.end_ms - h.end_ms <= 1500) AS context_end FROM hits h),
    x AS (SELECT c.doc_id, c.pos, c.last, c.start_ms, c.end_ms, c.text, c.m, context_start, context_end, string_agg(trim(w.word), ' ' ORDER BY w.pos) AS context FROM c JOIN words w ON w.doc_id = c.doc_id AND w.start_ms >= context_start AND w.end_ms <= context_end GROUP BY ALL)
    SELECT * EXCLUDE (m), row_number() OVER (ORDER BY doc_id, start_ms, pos, m) AS hit FROM x""")
def find_in_footage_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return find_in_footage(w, w.select(KEY).distinct(), KEY, PATTERN, "regex").drop(KEY + "_")
