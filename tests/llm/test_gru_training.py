"""op8: all training documents train the network."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from arrears.llm import gru_lm


def test_every_training_document_has_one_round(documents):
    rows = documents([(i, "a b") for i in range(500)] + [(None, "a"), (3, "a b")])
    coded = rows.select("doc_id", (F.col("doc_id") % 7 != 2).alias("train")).fillna(True, ["train"])
    rounds = [[r.doc_id for r in gru_lm.rows_of_round(coded, n).collect()] for n in range(gru_lm.ROUNDS)]
    assert all(rounds) and Counter(d for r in rounds for d in r) == Counter(r.doc_id for r in coded.filter("train").collect())


def test_learning_reads_all_of_them(documents, monkeypatch):
    given = []
    plain = gru_lm.rows_of_round
    monkeypatch.setattr(gru_lm, "rows_of_round", lambda *a: given.append(plain(*a)) or given[-1])
    coded = gru_lm.code_blocks(documents([(i, "one two three " * 3) for i in range(60)]))
    counted, found, spell = gru_lm.count(coded)
    told = gru_lm.symbols(coded, counted, found, spell).cache()
    gru_lm.learn(told, found)
    assert sum(g.count() for g in given) == told.filter("train").count() > 40


def test_tasks_are_averaged_in_two_steps(documents, monkeypatch):
    """As many tasks as the tokens ask for; the average weighs them by their tokens."""
    monkeypatch.setattr(gru_lm, "LEAST_TOKENS", 1)
    rows = documents([(i, "one two three four " * (1 + i % 5)) for i in range(90)]).repartition(9)
    coded = gru_lm.code_blocks(rows)
    counted, found, spell = gru_lm.count(coded)
    told = gru_lm.stage(gru_lm.symbols(coded, counted, found, spell).repartition(9))
    flat = gru_lm.learn(told, found, rounds=1, tokens_a_weight=0.01)
    parts, weights = [], []
    for rows in told.filter("train").select(F.spark_partition_id().alias("p"), "codes").groupBy("p").agg(F.collect_list("codes").alias("codes")).collect():
        docs = [np.frombuffer(c, gru_lm.code_type(len(found.symbol_tokens()))).astype(np.int64) for c in rows.codes]
        net = gru_lm.Network(found.symbol_tokens())
        net.train(docs)
        parts.append(net.flat.astype(float)), weights.append(sum(map(len, docs)))
    assert len(parts) > 1
    assert np.allclose(flat, np.average(parts, axis=0, weights=weights), atol=2e-3)


def test_long_documents_train_in_stretches():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 50, gru_lm.SYMBOLS).astype(float)
    doc = rng.integers(1, gru_lm.SYMBOLS, 3 * gru_lm.LONG)
    flat, start, length = gru_lm._flat([doc[:5], doc[5:9]], [0, doc[4]])
    assert flat.tolist() == [0, *doc[:5], doc[4], *doc[5:9]] and length.tolist() == [5, 4]
    net = gru_lm.Network(tokens)
    before = net.scores([doc])[0]
    net.train([doc] * 4, together=8)
    assert net.scores([doc])[0] > before
