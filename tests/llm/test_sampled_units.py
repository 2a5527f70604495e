"""op2: a slice's words are numbered, spelled and decoded all at once, as one text alone would be."""

import numpy as np
import pytest

from arrears.llm import sampling

PLAIN = ["one two one", "x", "two\nthree\tone"]
SPACED = ["", " ", "a  b", " one", "one ", "   ", "▁", "one▁two", " a", "a "]


@pytest.mark.parametrize("texts", [PLAIN, SPACED, [*SPACED, *PLAIN], ["one", "", "two one", "a  one", "x"], ["\ud800 one", "one two", " "], []])
def test_units_of_a_slice_are_those_of_its_texts(texts):
    words, unit, bounds = sampling.numbered(texts)
    assert len(set(words)) == len(words) and len(bounds) == len(texts) + 1
    assert [[words[n] for n in unit[lo:hi]] for lo, hi in zip(bounds, bounds[1:])] == [sampling.units(t) for t in texts]


def test_letters_without_a_piece_are_spelled_in_each_row():
    texts = ["a\nb", "", "\n\n", "\U0001f9ff \udc80", "plain words", "é\x00\n"]
    keys = [sampling.row_key(i, 4) for i in range(len(texts))]
    ids, length, told = sampling.drawn(texts, keys, 2, sampling.weights(sampling.VOCABULARY), sampling.VOCABULARY)
    assert length.sum() == len(ids) and ids.max() < len(sampling.spelled())
    rows = [texts[t[0]] for t in told]
    assert [sampling.decode(some.tolist()) for some in np.split(ids, np.cumsum(length)[:-1])] == rows
    assert sampling.decoded(ids, length, rows) == [True] * len(rows)
    assert sampling.decoded(ids, length, ["other", *rows[1:]]) == [False] + [True] * (len(rows) - 1)


def test_long_rows_are_handed_on_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "some words of a text " * 5) for i in range(6)] + [(None, "no id"), (9, None)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, sampling.encode(rows, checked=True).collect()))
    monkeypatch.setattr(sampling, "EMITTED", 40)
    assert sorted(map(str, sampling.encode(rows, checked=True).collect())) == whole and len(whole) == 14
