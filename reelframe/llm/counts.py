"""Token counts by heap-and-linked-list byte-pair merging.

The lowest-rank adjacent pair is popped again and again; the count is the number of initial symbols less
the number of merges, and no identifier is made.  Symbols that no piece holds start as their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import Memo, load, merge, tail, words

LIMIT = 4096


def count_word(word: str, ranks: dict[str, int]) -> int:
    """Initial symbols less merges.  A character that is no piece, and so never merges, starts as its bytes."""
    extra = 0 if ranks.keys() >= set(word) else sum(len(c.encode("utf-8")) - 1 for c in word if c not in ranks)
    return len(word) + extra - merge(word, ranks)[1]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens.  Whole texts count, without begin or end tokens; strings
    like special tokens are ordinary text, as in the library.  Pairs with equal scores merge from the left, so ties
    change no count.  Repeated rows each get a row; other columns are ignored, whatever their names.  An empty table
    gives an empty result.  model is a path that the executors can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = load(model)
        parts: Memo = Memo(lambda w: count_word(w, v.ranks))
        memo: Memo = Memo(lambda w: parts[w[:i]] + parts[w[i:]] if (i := tail(w, v.inside)) else parts[w], 600_000)
        for b in batches:
            sums = [sum([memo[w] for w in words(t.as_py() or "")]) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text_"))
    counted = rows.mapInArrow(run, rows.select(id_col, "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
