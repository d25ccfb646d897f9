import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import counts, pieces, vocabulary
from reelframe.llm.queries import vocabulary_path

MODEL = vocabulary_path()
ODD = st.text(st.sampled_from("ab  ▁\n\t\x00é日😀́�the in!.,<0x41></s>"), max_size=40)


@given(st.one_of(ODD, st.text(max_size=60)))
@settings(max_examples=400, deadline=None)
def test_encode_and_count_agree_with_the_library(text):
    v, library = vocabulary.load(MODEL)
    ids = library.encode(text)
    assert pieces.encode(text, MODEL) == ids
    assert pieces.decode(ids, MODEL) == library.decode(ids)
    assert sum(counts.count_word(w, v.ranks) for w in vocabulary.words(text)) == len(ids)


def test_decode_any_ids():
    _, library = vocabulary.load(MODEL)
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randrange(9))]
        assert pieces.decode(ids, MODEL) == library.decode(ids), ids


def test_cutting_the_tail_changes_nothing():
    v, _ = vocabulary.load(MODEL)
    for word in ["▁the,", "▁of.", "▁x!!!", "▁a%%%", "▁", "▁▁▁", "▁don't", "▁日本。"]:
        at = vocabulary.tail(word, v.inside)
        whole = pieces.word_ids(word, v)
        assert not at or pieces.word_ids(word[:at], v) + pieces.word_ids(word[at:], v) == whole


def test_rows(spark, docs, rows):
    _, library = vocabulary.load(MODEL)
    got = pieces.encode_decode(docs, MODEL).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), ids, library.decode(ids)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    counted = counts.count_tokens(docs, MODEL).collect()
    assert sorted(map(str, (tuple(r) for r in counted))) == sorted(str((w[0], len((r[1] or "").encode()), w[1], w[1] > 4096)) for w, r in zip(want, rows, strict=True))


def test_a_difference_from_the_library_stops_the_job():
    make = pieces._Word(MODEL)
    make.document("some words")
    make.new["▁some"] = "1,2", "▁some"
    with pytest.raises(AssertionError, match="the library gives"):
        make.check()


def test_a_difference_in_the_decoded_text_stops_the_job():
    make = pieces._Word(MODEL)
    make.document("some words")
    make.new["▁some"] = make.new["▁some"], "▁same"
    with pytest.raises(AssertionError, match="decoded to"):
        make.check()


def test_words_of_known_parts_are_checked_too():
    make = pieces._Word(MODEL)
    make.document("words, some.")
    make.check()
    make.document("words. some, new")
    assert {"▁words.", "▁some,", "▁new"} <= set(make.new)


def test_empty_table_and_bounded_memo(none):
    assert pieces.encode_decode(none, MODEL).count() == counts.count_tokens(none, MODEL).count() == 0
    memo = vocabulary.Memo(len, 10)
    for i in range(100):
        assert memo[str(i)] == len(str(i))
    assert len(memo) <= 5 and len(memo.old) <= 5 and memo["x" * 100] == 100 and "x" * 100 not in memo
