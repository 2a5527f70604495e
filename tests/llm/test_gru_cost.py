"""op8: what makes it cheap leaves words, counts and probabilities as they are."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arrears.llm import gru_lm
from arrears.llm.common import words_of


def test_split_has_the_words_of_words_of():
    rng = random.Random(2)
    cases = [chr(i) for i in range(0x300)] + [f"A{chr(i)}b" for i in range(0x2100)] + ["", " ", None, "\x1ca\x1f B", " É \x0bÜ\x85w İ　"]
    cases += ["".join(rng.choice("aB \t\n\x0b\x0c\r\x1c　é") for _ in range(12)) for _ in range(500)]
    words, lengths = gru_lm.split(pa.array(cases, pa.string()))
    assert lengths.tolist() == [len(words_of(c)) for c in cases]
    assert words.cast(pa.binary()).to_pylist() == [w for c in cases for w in words_of(c)]
    assert gru_lm.split(pa.array([], pa.string()))[1].tolist() == []


def test_blocks_end_with_the_row_that_fills_them(documents, monkeypatch):
    monkeypatch.setattr(gru_lm, "BLOCK_CHARS", 30)
    monkeypatch.setattr(gru_lm, "TEXTS", 2)
    texts = ["äb cd " * 2, None, "x y" * 4, "b" * 40, "", "cd ef"]
    coded = gru_lm.code_blocks(documents(list(enumerate(texts))).coalesce(1)).collect()
    blocks = {b: [r for r in coded if r.block == b] for b in sorted({r.block for r in coded})}
    assert [[r.doc_id for r in rows if r.word is None] for rows in blocks.values()] == [[0, 1, 2, 3], [4, 5]]
    for rows in blocks.values():
        words = {r.idx: bytes(r.word) for r in rows if r.word is not None}
        docs = [(r, [words[i] for i in gru_lm.unsqueeze(r.ids)]) for r in rows if r.word is None]
        assert all(got == words_of(texts[r.doc_id]) for r, got in docs)
        seen = Counter(w for r, got in docs if r.train for w in got)
        assert {bytes(r.word): r.n for r in rows if r.word is not None} == {w: seen[w] for w in words.values()}


def test_words_meet_their_counts_in_one_shuffle(documents, monkeypatch):
    """Before, words were shuffled once to be summed and again to be joined to the sums."""
    plans, plain = [], gru_lm.stage
    monkeypatch.setattr(gru_lm, "stage", lambda df: plans.append(df) or plain(df))
    rows = documents([(i, "one two " + "three " * (i % 3)) for i in range(60)])
    coded = plain(gru_lm.code_blocks(rows.repartition(3)))
    counted, _, _ = gru_lm.count(coded)
    told = [d._jdf.queryExecution().sparkPlan().toString() for d in (*plans, counted)]
    assert sum(t.count("SortMergeJoin") for t in told) == 0 and [t.count("Window [") for t in told] == [1, 0]
    want = {bytes(r.word): r.c for r in coded.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")).collect()}
    found = {(r.block, r.idx): r.c for r in counted.collect()}
    assert found == {(r.block, r.idx): want[bytes(r.word)] for r in coded.filter("word is not null").collect()}


def test_extreme_logits_are_shifted():
    tokens = np.random.default_rng(1).integers(1, 500, gru_lm.SYMBOLS).astype(float)
    net, h = gru_lm.Network(tokens), np.ones((3, gru_lm.HIDDEN), np.float32)
    assert net._calm()
    net.ws[:, :gru_lm.HIDDEN] *= 400
    net.wc[:, :gru_lm.HIDDEN] *= 400
    assert not net._calm()
    every = net.log_prob(np.repeat(h[:1], gru_lm.SYMBOLS, 0), np.arange(gru_lm.SYMBOLS))
    assert np.isfinite(every).any() and abs(np.exp(every).sum() - 1) < 1e-3
