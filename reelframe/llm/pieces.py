"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score (ties: leftmost) and merges the best
pair until none is a piece; symbols that are no piece become byte pieces.  Words are merged one by one,
without the punctuation that no piece joins to them, and memoised within bounds.  Decoding goes from the
ids back to pieces and bytes.  Every word that a memo doesn't know is checked against the sentencepiece library
within its Arrow batch, ids and decoded text both; a difference stops the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import BLANK, Memo, Vocabulary, load, merge, tail, words

#: New words that are checked at a time.
CHECKED = 10_000
#: Rows whose ids and texts are held at a time.
ROWS = 200


def word_ids(word: str, v: Vocabulary) -> list[int]:
    parts = [p for p in merge(word, v.ranks)[0] if p is not None]
    known = v.ids.get
    ids = [known(p) for p in parts]
    if None in ids:
        ids = [j for i, p in zip(ids, parts, strict=True) for j in ((i,) if i is not None else [v.byte_ids[b] for b in p.encode("utf-8")])]
    return ids


def encode(text: str | None, model: str) -> list[int]:
    """The ids of a text; null counts as empty (no ids)."""
    v, _ = load(model)
    return [i for w in words(text or "") for i in word_ids(w, v)]


def surface(ids: list[int], v: Vocabulary, library: object) -> str:
    """The pieces of ids side by side, BLANK for blanks: byte pieces are joined as UTF-8, bad bytes become U+FFFD each."""
    if v.special.isdisjoint(ids):
        return "".join([v.pieces[i] for i in ids])
    out: list[str] = []
    run = bytearray()
    for i in ids:
        if i in v.byte_of:
            run.append(v.byte_of[i])
            continue
        if run:
            out.append(_utf8(run))
            run = bytearray()
        if i == v.unknown:
            out.append(library.decode([i]))
        elif i not in v.silent:
            out.append(v.pieces[i])
    out.append(_utf8(run))
    return "".join(out)


def decode(ids: list[int], model: str) -> str:
    """The text of ids; the blank that encoding puts in front goes."""
    v, library = load(model)
    text = surface(ids, v, library)
    first = next((i for i in ids if i not in v.silent), None)
    if first is not None and first not in v.byte_of and first != v.unknown and text.startswith(BLANK):
        text = text[1:]
    return text.replace(BLANK, " ")


def _utf8(run: bytearray) -> str:
    out, at, data = [], 0, bytes(run)
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Word:
    """A word's ids, joined by commas; with what they decode to, BLANK for blanks, where that isn't the word itself."""

    def __init__(self, model: str) -> None:
        self.new: dict[str, str | tuple[str, str]] = {}
        self.odd = False
        self.vocabulary, self.library = load(model)
        self.digits = [str(i) for i in range(len(self.vocabulary.pieces))]
        self.parts: Memo = Memo(self._part, 1_000_000)
        self.words: Memo = Memo(self, 1_600_000)

    def _part(self, part: str) -> str | tuple[str, str]:
        ids = word_ids(part, self.vocabulary)
        joined, shown = ",".join([self.digits[i] for i in ids]), surface(ids, self.vocabulary, self.library)
        if shown == part:
            return joined
        self.odd = True
        return joined, shown

    def __call__(self, word: str) -> str | tuple[str, str]:
        at = tail(word, self.vocabulary.inside)
        if at:
            left, right = self.parts[word[:at]], self.parts[word[at:]]
            if type(left) is str and type(right) is str:
                got = f"{left},{right}"
            else:
                (left, shown), (right, end) = _both(left, word[:at]), _both(right, word[at:])
                got = f"{left},{right}", shown + end
        else:
            got = self.parts[word]
        self.new[word] = got
        return got

    def document(self, text: str) -> tuple[str, str]:
        """The ids of a text joined by commas, and the text that they decode to."""
        memo, own = self.words, words(text)
        found = [memo[w] for w in own]
        if self.odd:
            pairs = [_both(f, w) for f, w in zip(found, own, strict=True)]
            found, own = [f for f, _ in pairs], [shown for _, shown in pairs]
        return ",".join(found), "".join(own)[1:].replace(BLANK, " ")

    def check(self) -> None:
        """The library gets the words without the blank that it puts in front itself; a blank alone is a piece."""
        self.new.pop(BLANK, None)
        digits = self.digits
        theirs = self.library.encode([w[1:].replace(BLANK, " ") for w in self.new], num_threads=1)
        texts = self.library.decode(theirs, num_threads=1) if theirs else []
        for (word, got), other, text in zip(self.new.items(), theirs, texts, strict=True):
            ids, shown = _both(got, word)
            if ids != ",".join([digits[i] for i in other]):
                raise AssertionError(f"{word!r}: merged to {ids}, the library gives {other}")
            if shown[1:].replace(BLANK, " ") != text:
                raise AssertionError(f"{word!r}: {ids} decoded to {shown!r}, the library gives {text!r}")
        self.new.clear()


def _both(found: str | tuple[str, str], word: str) -> tuple[str, str]:
    return (found, word) if type(found) is str else found


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, check: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text.

    Null text counts as empty: no ids, empty decoded text.  Whole texts are encoded, without begin or
    end ids.  check=True compares the ids and the decoded text of every word that isn't memoised with the library's
    and fails on a difference.  Pairs with equal scores merge from the left.  Repeated rows each get a row; other
    columns are ignored, whatever their names.  An empty table gives an empty result.  model is a path that the
    executors can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Word(model)
        for whole in batches:
            step = ROWS if ids else max(1, whole.num_rows)
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                counts, id_hashes, text_hashes, all_ids, texts = [], [], [], [], []
                for t in b.column(1):
                    joined, text = make.document(t.as_py() or "")
                    counts.append(joined.count(",") + 1 if joined else 0)
                    id_hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
                    if ids:
                        all_ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
                        texts.append(text)
                    if check and len(make.new) > CHECKED:
                        make.check()
                    elif not check:
                        make.new.clear()
                if make.new:
                    make.check()
                more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if ids else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string()), *more], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * ids
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text_"))
    given = rows.select(id_col, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("a"), F.lit("").alias("b"), *([F.array().cast("array<int>").alias("ids"), F.lit("").alias("decoded")] if ids else []))
    return rows.mapInArrow(run, given.toDF(*names).schema)
