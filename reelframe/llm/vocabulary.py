"""Merge-type SentencePiece vocabularies and a bounded memo."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from typing import Generic, TypeVar

import sentencepiece

#: Stands for a blank inside the library's pieces.
BLANK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """ranks: 0 for the highest score, equal scores share a rank.  inside: all neighbours within pieces."""

    ranks: dict[str, int]
    ids: dict[str, int]
    pieces: list[str]
    byte_ids: list[int]
    byte_of: dict[int, int]
    silent: frozenset[int]
    unknown: int
    inside: frozenset[str]

    @cached_property
    def special(self) -> frozenset[int]:
        """Ids that don't stand for their piece as text."""
        return self.silent | frozenset(self.byte_of) | {self.unknown}

    def __post_init__(self) -> None:
        spans = [p for p in self.ranks if BLANK in p.lstrip(BLANK)]
        if spans or len(self.byte_ids) != 256:
            raise ValueError("only vocabularies with byte fallback whose pieces hold blanks in front are supported")


@lru_cache(maxsize=4)
def load(path: str) -> tuple[Vocabulary, sentencepiece.SentencePieceProcessor]:
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    n = library.get_piece_size()
    pieces = [library.id_to_piece(i) for i in range(n)]
    byte_of = {i: int(pieces[i][3:5], 16) for i in range(n) if library.is_byte(i)}
    silent = frozenset(i for i in range(n) if library.is_control(i))
    plain = [i for i in range(n) if i not in byte_of and i not in silent and not library.is_unknown(i) and not library.is_unused(i)]
    by_value = sorted(byte_of, key=byte_of.get)
    place = {x: r for r, x in enumerate(sorted({library.get_score(i) for i in plain}, reverse=True))}
    vocabulary = Vocabulary({pieces[i]: place[library.get_score(i)] for i in plain}, {pieces[i]: i for i in plain}, pieces, by_value, byte_of, silent, library.unk_id(), frozenset(pieces[i][k : k + 2] for i in plain for k in range(len(pieces[i]) - 1)))
    return vocabulary, library


def words(text: str) -> list[str]:
    """The library's form of a text, cut before each run of blanks.

    A blank is put in front and blanks become BLANK.  No piece holds a blank after another character, so no
    merge crosses these cuts and the parts can be merged one by one.
    """
    if not text:
        return []
    parts = text.replace(BLANK, " ").split(" ")
    out, lead = [], 1
    for p in parts:
        if p:
            out.append(BLANK * lead + p)
            lead = 1
        else:
            lead += 1
    if lead > 1:
        out.append(BLANK * (lead - 1))
    return out


def merge(word: str, ranks: dict[str, int]) -> tuple[list[str | None], int]:
    """The symbols of a word after all merges (None where one went into its left neighbour) and the number of merges.

    The agenda is a heap of (rank, position of the left symbol), packed into one integer; the symbols are a linked
    list.  best[i] is the rank of symbol i with its right neighbour, so an entry that differs is out of date.
    """
    n = len(word)
    part: list[str | None] = list(word)
    rank_of = ranks.get
    best = [rank_of(word[i : i + 2], -1) for i in range(n - 1)]
    shift = n.bit_length()
    agenda = [r << shift | i for i, r in enumerate(best) if r >= 0]
    if not agenda:
        return part, 0
    heapify(agenda)
    best.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges, low = 0, (1 << shift) - 1
    while agenda:
        entry = heappop(agenda)
        i = entry & low
        if best[i] != entry >> shift:
            continue
        j = after[i]
        part[i] = pair = part[i] + part[j]
        part[j], best[j] = None, -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            best[i] = r = rank_of(pair + part[k], -1)
            if r >= 0:
                heappush(agenda, r << shift | i)
        else:
            best[i] = -1
        h = before[i]
        if h >= 0:
            best[h] = r = rank_of(part[h] + pair, -1)
            if r >= 0:
                heappush(agenda, r << shift | h)
    return part, merges


def tail(word: str, inside: frozenset[str]) -> int:
    """Where the end of a word (punctuation, mostly) can be cut off, 0 if nowhere among the last characters.

    inside holds all neighbours within pieces.  No merge joins two characters that no piece has side by side.
    """
    n = len(word)
    for i in range(max(1, n - 3), n):
        if word[i - 1 : i + 1] not in inside:
            return i
    return 0


K, V = TypeVar("K"), TypeVar("V")


class Memo(dict, Generic[K, V]):
    """Results for at most `size` keys that were asked for lately; long keys aren't kept."""

    def __init__(self, make: Callable[[str], V], size: int = 300_000, longest: int = 40) -> None:
        super().__init__()
        self.make, self.half, self.longest, self.old = make, size // 2, longest, {}

    def __missing__(self, key: str) -> V:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > self.longest:
                return got
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got
