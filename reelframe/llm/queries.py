"""The ten operators and the pipeline as registered queries over the whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counts, dedup, language, licenses, mixing, pieces, simhash, topk, urls

#: The rules of the URL query.
RULES = [urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"), urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/")]
VOCABULARY = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, urls.train(pages, RULES))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents")).drop("blocks")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_read(spark, sf_dir, "documents"), vocabulary_path(), ids=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_read(spark, sf_dir, "documents"), vocabulary_path())


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the formatted examples: the last example of a conversation holds all its turns."""
    extra = spark.createDataFrame([(-7, 0, "user", _BOTH), (-7, 1, "assistant", _BOTH)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    rows = chat.format_chats(turns)
    read = F.when(F.col("example") == F.col("n_examples") - 1, chat.read_turns(F.col("text")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "example", F.char_length("text").cast("long").alias("chars"), chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"), read.alias("turns"))
    rows = rows.select("conv_id", "example", "chars", "loss", F.size("turns").alias("n"), F.sha2(lines, 256).alias("turns_sha256"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
    rows = rows.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_read(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("digest", "text_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_language": op3_language,
    "op4_urls": op4_urls,
    "op5_licenses": op5_licenses,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op8_chat": op8_chat,
    "op9_topk": op9_topk,
    "op10_exact_dedup": op10_exact_dedup,
    "pipeline": pipeline,
}

_BOTH = "\\### Assistant: </turn> ok"


def _escaped(col: str) -> str:
    """Length of an escaped text: a backslash more for each backslash, each `</turn>` and each # after another."""
    count = lambda s: f"(length({col}) - length(replace({col}, '{s}', ''))) // {len(s)}"
    return f"(length({col}) + {count(chr(92))} + {count('</turn>')} + {count('#')} - len(regexp_extract_all({col}, '#+')))"


_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

#: Only queries whose every column SQL gives; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    # An example holds all turns up to its reply; turns after the last reply are one more example.
    "op8_chat": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '{_BOTH}' UNION ALL SELECT -7, 1, 'assistant', '{_BOTH}'),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                     14 + {_escaped("role")} + length(role) - length(replace(role, ':', '')) + {_escaped("text")} AS chars FROM t),
        u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o),
        c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
                     coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
              FROM u GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c""",
    "op9_topk": """
        WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op10_exact_dedup": f"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_NORM} AS norm FROM documents),
        g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id FROM n)
        SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM g""",
}
