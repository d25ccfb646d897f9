"""Word and sentence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of sentences and clauses, with closing quotes or brackets, as captions see them.
SENTENCE_END = r"[.!?][\"')\]]?\s*$"
CLAUSE_END = r"[,;:][\"')\]]?\s*$"
#: Ends of sentences as the transcript cutter sees them.
PLAIN_SENTENCE_END = r"[.!?]\s*$"


#: ASCII characters that words lose at their edges.
_EDGES = "".join(chr(c) for c in range(128) if not (chr(c).isalnum() or chr(c) in "_'"))


def norm(word: Column) -> Column:
    """Lower case, without edge characters that are no letter, digit, underscore or apostrophe.

    Once the ASCII ones are trimmed, only words with other characters need the regular expression.
    """
    low = F.btrim(F.lower(word), F.lit(_EDGES))
    rest = F.regexp_extract(low, r"(?s)[\p{L}\p{N}_'](?:.*[\p{L}\p{N}_'])?", 0)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(rest)


def tokens(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def capitalised(text: Column) -> Column:
    """The first character in upper case, one for one: no letter turns into two."""
    first = F.substring(text, 1, 1)
    upper, title = F.upper(first), F.initcap(first)
    one = F.when(F.char_length(upper) == 1, upper).when(first == "\u00df", "\u1e9e").when(F.char_length(title) == 1, title).otherwise(first)
    return F.concat(one, F.substring(text, 2, 1 << 30))


def wrap_lines(words: Column, max_chars: int, max_lines: int) -> Column:
    """Greedy line filling; a last line of one word gets the word before it; lines over max_lines go."""
    blank = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, w: Column) -> Column:
        joined = F.concat(acc["cur"], F.lit(" "), w)
        full = (F.length(joined) > max_chars) & (acc["cur"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), w).otherwise(joined).alias("cur"),
        )

    def fix(acc: Column) -> Column:
        lines = F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        before = F.try_element_at(lines, F.size(lines) - 1)
        moved = F.substring_index(before, " ", -1)
        shorter = F.substring(before, F.lit(1), F.length(before) - F.length(moved) - 1)
        alone = (F.size(lines) >= 2) & ~F.element_at(lines, -1).contains(" ") & before.contains(" ")
        pulled = F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 2, F.lit(0))), F.array(shorter, F.concat(moved, F.lit(" "), F.element_at(lines, -1))))
        fixed = F.when(alone, pulled).otherwise(lines)
        return F.slice(fixed, 1, max_lines) if max_lines else fixed

    return F.aggregate(F.filter(words, lambda w: w != ""), blank, add, fix)


def initial_prompt(terms: list[str], extra: list[str] | None = None) -> str:
    """One prompt sentence of distinct terms, in the order given."""
    return ", ".join(dict.fromkeys([*terms, *(extra or [])]))
