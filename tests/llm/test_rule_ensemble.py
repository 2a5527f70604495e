"""op11: rules against their definition, held-out accuracy, awkward tables."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrears.llm import rule_ensemble as r

LABELS = "doc_id long, quality int, toxic int"


def figures(text):
    """The statistics in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, lines = max(1, len(words)), text.count("\n") + 1
    java = {"ends": r"[.!?](?=[ \t\n\x0b\f\r]|\Z|\n\Z)", "capitals": "[A-ZÄÖÜÉÈ]{2,}", "initials": r"(?<![^ \t\n\x0b\f\r])[A-ZÄÖÜÉÈ]",
            "repeats": r"(?<![^ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]+)(?![^ \t\n\x0b\f\r])(?=[ \t\n\x0b\f\r]+\1(?![^ \t\n\x0b\f\r]))",
            "short": r"(?<![^ \t\n\x0b\f\r])[^ \t\n\x0b\f\r]{1,3}(?![^ \t\n\x0b\f\r])", "long": r"[^ \t\n\x0b\f\r]{20,}"}
    return [math.log1p(len(words)), len(text) / n, len(words) / lines, min(1.0, len(set(re.split("[\x20\x09-\x0D]+", text.lower()))) / n),
            len(set(text.split("\n"))) / lines, *[sum(1 for _ in re.finditer(java.get(k, p), text)) / n for k, p in r.COUNTED.items()]]


def test_statistics(spark):
    texts = [None, "", " \n ", "One two. Two two!! a|b 12 34", "DER der DER der\nDER der DER der\n\nx", "Ä ÄÄÄ é 日本 $$$ %%%%", "w" * 30 + ". " + "no no no no", "a.\nb?\tC!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {row.doc_id: [row[n] for n in r.NAMES] for row in df.select("doc_id", *[c.alias(n) for n, c in r.statistics(F.col("text")).items()]).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(figures(t)), t


def table(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice("stone river cloud apple north light table green".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 80))]
        kind = rng.random()
        if kind < 0.15:
            words = [w + rng.choice(["%%%", "$$$"]) for w in words]
        elif kind < 0.3:
            words = [w for w in words[:4] for _ in range(12)]
        rows.append((i, " ".join(words) + ".", 0 if kind < 0.3 else 1))
    return rows


def test_held_out_and_rules(spark, documents):
    rows = table(random.Random(2), 700)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0)], LABELS)
    model = r.fit(docs, labels)
    assert 0 < len(model.rules) < 60 and len(model.told()) == len(model.rules)
    got = r.report(docs, labels).collect()
    assert len(got) == len(rows) and all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    held = [g for g in got if g.held_out]
    assert sum(g.predicted != rows[g.doc_id][2] for g in held) <= len(held) // 50
    # The column is the sum of the weights of the rules that hold.
    x = np.array([figures(t) for _, t, _ in rows])
    margin = model.base + sum(w * r.held(rule, x) for rule, w in model.rules)
    assert [g.score for g in sorted(got)] == pytest.approx((1 / (1 + np.exp(-np.clip(margin, -30, 30)))).tolist())
    # Labels of held-out rows change nothing.
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, _, q in rows], LABELS)
    assert sorted(got) == sorted(r.report(docs, other).collect())


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(0)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    n, penalty = np.ones(400), 0.02
    w = r.lasso(z, y, n, penalty, rounds=5000)
    spread = z.std(axis=0)
    gradient = z.T @ (1 / (1 + np.exp(-(w[0] + z @ w[1:]))) - y) / 400 / spread
    for g, v in zip(gradient, w[1:]):
        assert abs(g) <= penalty + 1e-4 if v == 0 else abs(g + np.sign(v) * penalty) < 1e-3
    assert w[1] > 0 > w[2] and (w == 0).any()


def test_awkward(spark, documents, awkward, nothing):
    none = spark.createDataFrame([], LABELS)
    labels = spark.createDataFrame([(i, int(i > 4), None) for i in range(1, 11)] + [(4, 0, 0), (4, 1, 0), (None, 0, 0)], LABELS)
    for some in (none, labels, labels.filter("quality = 1")):
        out = r.report(awkward, some).collect()
        assert len(out) == awkward.count() and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in out)
    assert {g.score for g in r.report(awkward, none).collect()} == {0.5}
    assert r.report(nothing, labels).count() == 0 and r.report(nothing, none).count() == 0
    assert r.scores(awkward, r.Model(0.0, ())).columns == [*awkward.columns, "quality_score"]
