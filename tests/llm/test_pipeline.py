"""The five stages against plain Python on a small table, stage by stage, and the run as a whole."""

import collections
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from arrears.llm import lattice, sampling, toxicity
from arrears.llm.common import stage
from tests.llm.test_documents import classes_of
from tests.llm.test_toxic_clauses import told

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STOCK = "stone river cloud light north apple table green window paper bridge letter".split()


def corpus():
    rng, rows, labels = random.Random(12), [], []

    def words(n):
        return " ".join(rng.choice(STOCK) + str(rng.randrange(30)) for _ in range(n))

    for i in range(260):
        text = words(rng.randrange(6, 60))
        bad = i % 9 == 0
        if bad:
            text += rng.choice([" you idiot", " vequaro", " vequilo", " vequimo", " vequesto", " vequindo", " vequunda"]) + f" {words(3)}."
        elif i % 20 == 1:
            text += f" write to user{i}@mail.example.org or 10.0.{i % 250}.7 now"
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), len(text)))
        labels.append((i, 1, int(bad)))
    # Exact and near copies, with a chain; texts without words.
    base = words(120)
    chain = [base, base, base.replace("river", "rivers", 1), base + " " + words(4)]
    rows += [(300 + k, t, "en", "b", len(t)) for k, t in enumerate(chain)]
    rows += [(310, None, "en", "a", None), (311, "", "en", "a", 0), (312, " \n", None, "b", 2), (313, None, None, None, None), (None, words(9), "en", "c", 60),
             (None, "you idiot", "en", "c", 9)]
    # One id twice with different texts, of which one is a copy; one row twice.
    rows += [(400, rows[1][1], "en", "c", len(rows[1][1])), (400, words(30), "en", "c", 200), (401, words(20), "en", "d", 9)]
    rows.append(rows[-1])
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows given, and those of the whole table after each stage."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {"documents": [tuple(r) for r in rows]}
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, folder))
        out[name] = docs.collect()
    out["run"] = corpus_pipeline.run(spark, folder).collect()
    out["model"] = model
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def symbols(text, stems):
    """Clauses of a text without quotes as symbols."""
    out = [""]
    for raw in (text or "").lower().split():
        word = raw.strip(".,!?;:")
        out[-1] += ("T" if word in toxicity.THREATS else "Y" if word in toxicity.TARGETS else "N" if word in toxicity.NEGATIONS else
                    "R" if word in toxicity.REPORTS else "I" if word in toxicity.INSULTS or any(word.startswith(s) for s in stems) else "O")
        if raw[-1] in ".!?;:":
            out.append("")
    return out


def test_toxicity(stages):
    model = stages["model"]
    assert any(s.startswith("vequ") for s in model.stems)

    def score(text):
        return 1 / (1 + math.exp(-(model.weights[0] + model.weights[1:] @ np.log1p(sum(told(c) for c in symbols(text, model.stems))))))

    kept = [r for r in stages["documents"] if score(r[1]) < 0.5]
    assert key(stages["toxicity"]) == key(kept)
    gone = {r[1] for r in stages["documents"]} - {r[1] for r in kept}
    assert len(gone) >= 25 and all("idiot" in t or "vequ" in t for t in gone)


def test_ngram_jaccard(stages):
    before = stages["toxicity"]
    # Rows are judged by their own text: numbers stand for rows, ordered by id.
    rows = sorted((tuple(r) for r in before if r.doc_id is not None), key=lambda r: (r[0], str(r[1])))
    classes = classes_of([(k, r[1]) for k, r in enumerate(rows)], 5, 80)
    kept, seen = [], set()
    for k, r in enumerate(rows):
        least = rows[classes[k][1]][0]
        if least == r[0] and (r[0], r[1]) not in seen:
            kept.append(r)
            seen.add((r[0], r[1]))
    kept += [tuple(r) for r in before if r.doc_id is None]
    assert key(stages["ngram_jaccard"]) == key(kept)
    assert [r[0] for r in kept if r[0] in range(300, 304)] == [300] and len([r for r in kept if r[0] in (400, 401)]) == 2


def test_personal_data(stages):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"(?<![0-9.])\d+\.\d+\.\d+\.\d+")
    want = []
    for doc, text, lang, source, _ in stages["ngram_jaccard"]:
        text = None if text is None else ip.sub("<ip>", email.sub("<email>", text))
        want.append((doc, text, lang, source, None if text is None else len(text)))
    assert key(stages["personal_data"]) == key(want)
    assert sum("<email>" in (r.text or "") for r in stages["personal_data"]) >= 8


def mixed(rows):
    """(doc_id, text) in training order, by the definitions."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    total = {s: sum(size(r.text) for r in by_source[s]) for s in names}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * total[s] <= level * weight[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.discard(s)
        if not open_:
            break
    target.update({s: level * weight[s] for s in open_})
    out = []
    for s in names:
        def place(r):
            return 42 if r.doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        at, placed = 0, []
        for r in sorted(by_source[s], key=lambda r: (place(r), size(r.text))):
            n = size(r.text)
            middle = at + n / 2
            copies = 0 if not n else max(0, min(3, math.ceil((target[s] - middle) / total[s])))
            placed.append([r, n, middle, copies])
            at += n
        off = target[s] - sum(n * c for _, n, _, c in placed)
        fits = [p for p in placed if p[1] and (p[3] < 3 if off > 0 else p[3] > 0) and abs(p[1] - abs(off)) < abs(off)]
        if fits:
            best = min(fits, key=lambda p: (abs(p[1] - abs(off)), p[2]))
            best[3] += 1 if off > 0 else -1
        slope = (weight[s] - 2) / 2
        for r, _, middle, copies in placed:
            for copy in range(copies):
                demand = min(1.0, (middle + copy * total[s]) / target[s])
                low, high = 0.0, 1.0
                for _ in range(60):    # the time by which so much is asked for
                    t = (low + high) / 2
                    low, high = (t, high) if (1 - slope) * t + slope * t * t < demand else (low, t)
                out.append((low, r))
    return out


def test_mixing(stages):
    want = mixed(stages["personal_data"])
    assert key(stages["mixing"]) == key(r for _, r in want)
    # In training order: the time of a row only rises.
    times = collections.defaultdict(list)
    for t, r in want:
        times[tuple(r)].append(t)
    left = {k: sorted(v) for k, v in times.items()}
    taken = [left[tuple(r)].pop(0) for r in stages["mixing"]]
    assert all(a <= b + 1e-6 for a, b in zip(taken, taken[1:]))
    assert not any((r.text or "").strip() == "" for r in stages["mixing"])    # texts without words leave here


def test_sentencepiece(stages):
    given = collections.Counter((r.doc_id, r.text) for r in stages["mixing"])
    rows = stages["sentencepiece"]
    assert collections.Counter((r.doc_id, sampling.decode(r.ids)) for r in rows) == {k: 2 * n for k, n in given.items()}
    assert key((r.doc_id, r.sample, tuple(r.ids)) for r in rows) == key((r.doc_id, r.sample, tuple(r.ids)) for r in stages["run"])
    weight, pieces = sampling.weights(lattice.VOCABULARY), lattice.pieces()[0]
    for r in rows[:40]:
        escaped = "▁" + sampling.decode(r.ids).replace(" ", "▁")
        log = [0.0] + [-math.inf] * len(escaped)
        for p in range(len(escaped)):
            for n in range(1, min(16, len(escaped) - p) + 1):
                if escaped[p:p + n] in pieces:
                    log[p + n] = np.logaddexp(log[p + n], log[p] + math.log(weight[pieces[escaped[p:p + n]]]))
        assert abs(sum(math.log(weight[i]) for i in r.ids) - log[-1] - r.log_prob) < 1e-6
    pairs = collections.defaultdict(dict)
    for r in rows:
        pairs[r.doc_id, r.sample][tuple(r.ids)] = r.perturbed
    assert all(set(pairs[d, 1]) != set(pairs[d, 2]) for d, k in pairs if k == 1)


def test_columns(stages):
    for name in ("toxicity", "ngram_jaccard", "personal_data", "mixing"):
        assert stages[name][0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
