"""Operators on documents against brute force, and on awkward tables."""

import collections
import hashlib
import math
import random
import string
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arrears.llm import curriculum, gru_lm, language, lattice, packing, partenum, personal, sampling, toxicity

WORDS = "stone river cloud light north apple table green paper horse music winter garden silver copper".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


# --- op3 ------------------------------------------------------------------------------------------

def lexicon():
    return toxicity.Lexicon(frozenset({"lowe"}))


def found(text):
    return {toxicity.FEATURES[i] for i in np.flatnonzero(toxicity.matches(text, lexicon()))}


def test_clauses():
    assert found("What an idiot.") == {"insult"}
    assert found("You are an idiot") == {"insult at target"}
    assert found("You are not an idiot.") == {"negated insult"}
    assert found("He said it was the idiot") == {"reported insult"}
    assert found('They wrote "idiot" on it') == {"reported insult"}
    assert found("I will kill you") == {"threat"} and found("you, I will kill") == {"threat at target"}
    assert found("never kill") == {"negated threat"} and found("not never idiot") == {"insult"}
    assert found("He said so. What an idiot!") == {"insult"}
    assert found("die loweiung") == {"insult"} and found("a calm day") == set() and found(None) == set()


def test_toxicity_is_learned_and_held_out(spark, documents):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, text_of(rng, 30) + (f" vequ{rng.choice('abcdef')} " + text_of(rng, 5) if bad else ""), "fr", "s"))
        labels.append((i, 1, int(bad)))
    frame = toxicity.report(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert (frame["held_out"] == [crc(i) % 5 == 0 for i in frame["doc_id"]]).all()
    assert (frame["predicted"] == (frame["doc_id"] % 4 == 0)).all() and frame["score"].between(0, 1).all()


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(None, 1, 1), (10, None, 1), (4, 1, 0), (4, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.report(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.predicted for r in got}[10] == 1 and {r.doc_id: r.predicted for r in got}[2] == 0
    assert toxicity.report(nothing, labels.limit(0)).count() == 0


# --- op4 ------------------------------------------------------------------------------------------

def test_mixing_targets_and_uses(documents, awkward, nothing):
    rng = random.Random(2)
    rows = [(i, text_of(rng, rng.randrange(1, 120)), "en", ("a", "a", "a", "a", "b", "c", "d", None, "zz")[i % 9]) for i in range(1500)]
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full = {}
    while True:
        rest = [s for s in order if s not in full]
        share = (sum(sizes.values()) - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3 * sizes[s] for s in over}
    want = {s: full.get(s, share * weight[s]) for s in order}
    df = documents(rows)
    got = curriculum.report(df).collect()
    taken = collections.Counter()
    for r in got:
        source = rows[r.doc_id][3]
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 60 for s in order)
    assert sorted(got) == sorted(curriculum.report(df.repartition(7)).collect())
    mixed = curriculum.mix(df).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed) and all(0 <= r.position <= 1 for r in mixed)
    again = collections.Counter(r.doc_id for r in mixed)
    assert all(again[r.doc_id] * r.size == r.taken for r in got)
    assert len(curriculum.report(awkward).collect()) == awkward.count()
    assert curriculum.mix(awkward, carry=("doc_id", "text")).columns == ["doc_id", "text"]
    assert curriculum.report(nothing).count() == 0 and curriculum.mix(nothing).count() == 0


def test_time_inverts_the_schedule(spark):
    from pyspark.sql import functions as F
    for weight in (1.0, 2.0, 3.0):
        s = (weight - 2) / 2
        rows = spark.range(101).select((F.col("id") / 100).alias("t")).withColumn("d", (1 - s) * F.col("t") + s * F.col("t") * F.col("t"))
        assert all(abs(r.t - r.x) < 1e-9 for r in rows.withColumn("x", curriculum.time_of(F.col("d"), F.lit(s))).collect())


# --- op5 ------------------------------------------------------------------------------------------

def classes_of(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    def top(x):
        return x if root[x] == x else top(root[x])
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(rng, groups):
    rows = []
    for _ in range(groups):
        base = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25 + 1)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("width, percent, block", [(3, 90, 1024), (5, 80, 1024), (3, 80, 8)])
def test_jaccard_join_finds_all_links(documents, monkeypatch, width, percent, block):
    monkeypatch.setattr(partenum, "GROUP_ROWS", block)
    rows = corpus(random.Random(width), 60) + [(900 + i, "the same " * 30 + str(i // 9)) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similarity_classes(documents(rows), width, percent).collect()}
    assert got == classes_of(rows, width, percent)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([80, 90]))
def test_similar_sets_share_a_signature(size, seed, percent):
    rng = np.random.default_rng(seed)
    pool = rng.integers(1, 2**63, size * 2, dtype=np.uint64)
    a, lost, new = pool[:size], int(rng.integers(0, size // 8 + 1)), int(rng.integers(0, size // 8 + 1))
    b = np.r_[a[lost:], pool[size:size + new]]
    if len(b) and 100 * (size - lost) >= percent * (size + new) and (lost or new):
        # Whatever is taken for common, nothing is missed.
        sign = partenum.Signer(percent, rng.choice(np.r_[a, b], int(rng.integers(1, len(a) + 1))))
        assert set(sign(np.unique(a)).tolist()) & set(sign(np.unique(b)).tolist())


def test_sketches_never_part_what_may_link():
    """Sketches of one size or two differ in no more bits than their sets in shingles; unrelated sets are told apart."""
    rng = np.random.default_rng(3)
    sets, sizes = [], []
    for n in (1, 5, 40, 63, 64, 65, 500, 640):
        whole = rng.integers(0, 2**63, n, dtype=np.uint64)
        other = np.r_[whole[: n - n // 12], rng.integers(0, 2**63, n // 12 + n // 20, dtype=np.uint64)]
        sets += [np.unique(whole), np.unique(other)]
    sizes = np.array([len(s) for s in sets])
    roots = {}
    for lo in range(0, len(sets), 2):   # near copies meet, also across the lengths of sketches
        pair = slice(lo, lo + 2)
        union = len(np.union1d(*sets[pair]))
        linked = 100 * len(np.intersect1d(*sets[pair])) >= 80 * union
        roots[lo] = partenum.near_sketches([partenum.sketch_of(s) for s in sets[pair]], sizes[pair], 80)
        assert not linked or (roots[lo] == 0).all()
    apart = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rng.integers(400, 600, 50)]
    root = partenum.near_sketches([partenum.sketch_of(s) for s in apart], np.array([len(s) for s in apart]), 80)
    assert len(set(root)) == 50


def test_a_large_candidate_group_is_parted(spark, documents, monkeypatch):
    """Texts tied by a passage they share leave a large group before its texts are dealt to pairs of blocks."""
    monkeypatch.setattr(partenum, "GROUP_ROWS", 8)
    monkeypatch.setattr(partenum, "SKETCH_ROWS", 4)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(string.ascii_lowercase, k=60)) for _ in range(20)]
    rows = [(2 * i + j, text + " x" * j) for i, text in enumerate(texts) for j in (0, 1)]
    docs, shingle = documents(rows), partenum.Shingler(3)
    sets = {i: shingle(text) for i, text in rows}
    base = spark.createDataFrame([(i, len(s), partenum.set_key(s), bytearray(partenum.sketch_of(s))) for i, s in sets.items()],
                                 "doc_id long, n long, node long, sketch binary")
    grouped = spark.createDataFrame([(partenum.set_key(s), 1) for s in sets.values()], "id long, component_id long")
    found = {}
    for r in partenum.parted(base, grouped, 80).collect():
        found.setdefault(r.component_id, set()).add(r.id)
    twins = {frozenset((partenum.set_key(sets[2 * i]), partenum.set_key(sets[2 * i + 1]))) for i in range(20)}
    assert {frozenset(g) for g in found.values()} == twins


def test_texts_with_a_common_passage_do_not_meet(documents, monkeypatch):
    """Texts that share a passage are tied by signatures; before their texts are compared they are told apart."""
    monkeypatch.setattr(partenum, "GROUP_ROWS", 8)
    rng, sizes, verified = random.Random(6), [], partenum.verified

    def watched(texts, base, grouped, *rest):
        sizes.extend(r["count"] for r in grouped.groupBy("component_id").count().collect())
        return verified(texts, base, grouped, *rest)

    monkeypatch.setattr(partenum, "verified", watched)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for i in range(40)]
    rows += [(40 + i, text + " end") for i, (_, text) in enumerate(rows[:3])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similarity_classes(documents(rows), 3, 80).collect()}
    assert got == classes_of(rows, 3, 80)
    assert sorted(sizes)[-3:] == [2, 2, 2]


def test_signatures_are_combined_before_they_leave_a_task():
    """What is handed on joins the same sets, with one row for each signature."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        keys = rng.integers(-2**62, 2**62, 30).tolist()
        found = [rng.integers(0, 25, rng.integers(0, 10)).astype(np.uint64) for _ in keys]
        if not sum(map(len, found)):
            continue
        rows = partenum._rows(keys, found)
        own = rows[rows["node"] == rows["low"]]
        assert own["sig"].is_unique and len(own) == len(set(np.concatenate(found).tolist()))

        def groups(pairs):
            root = {}
            def top(x):
                while root.setdefault(x, x) != x:
                    x = root[x]
                return x
            for a, b in pairs:
                root[top(a)] = top(b)
            out = collections.defaultdict(set)
            for x in list(root):
                out[top(x)].add(x)
            return sorted(sorted(k for kind, k in g if kind == "set") for g in out.values())

        plain = groups((("set", k), ("sig", int(s))) for k, ss in zip(keys, found) for s in ss)
        assert plain == groups((("set", r.node), ("sig", r.sig) if r.node == r.low else ("set", r.low)) for r in rows.itertuples())


def test_jaccard_awkward(documents, awkward, nothing):
    got = partenum.similarity_classes(awkward).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == awkward.count() and by_id[5].component_id == 4 and by_id[2].n_shingles == 0 and by_id[3].component_id == 3
    assert by_id[9].component_id == 9 and by_id[9].n_shingles == 1 and by_id[None].component_id is None
    assert partenum.similarity_classes(nothing).count() == 0
    kept = partenum.deduplicated(awkward.select("doc_id", "text")).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [None, None, 1, 2, 3, 4, 6, 7, 8, 9, 10]))


# --- op7 ------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    known = lattice.pieces()[0]
    weight = language.prior(len(lattice.pieces()[1]))

    def ways(word):
        if not word:
            return 1.0
        alone = known.get(word[0])
        total = (weight[alone] if alone is not None else weight[-1]) * ways(word[1:])
        return total + sum(weight[known[word[:n]]] * ways(word[n:]) for n in range(2, len(word) + 1) if word[:n] in known)

    words = ["▁hello", "▁a", "wörter", "▁日本x", "ab"]
    lat = lattice.Lattices(words)
    arcs = weight[lat.piece][:, None]
    assert np.allclose(lat.forward(arcs)[lat.offset[1:] - 1, 0], [ways(w) for w in words])
    assert np.allclose(lat.backward(arcs)[lat.offset[:-1], 0], [ways(w) for w in words])
    assert np.isclose(language.expected({"hello": 3, "a" * 70: 1}, weight) @ np.r_[[len(t) for t in lattice.pieces()[1]], 1], 3 * 6 + 71)


def test_words_of_any_length_have_all_their_segmentations():
    """Words beyond the products are summed as logarithms; pieces may lie anywhere in them."""
    known, weight = lattice.pieces()[0], language.prior(len(lattice.pieces()[1]))
    longest = max(map(len, known))

    def log_ways(word):
        """By the plain recurrence over all prefixes, with numbers that do not run out."""
        from fractions import Fraction
        sums = [Fraction(1)] + [Fraction(0)] * len(word)
        for p in range(len(word)):
            for n in range(1, min(longest, len(word) - p) + 1):
                piece = known.get(word[p:p + n])
                if piece is not None or n == 1:
                    sums[p + n] += sums[p] * Fraction(float(weight[piece if piece is not None else -1]))
        return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)

    rng = random.Random(1)
    words = ["▁recommendations" * 3, "▁" + "".join(rng.choices("etaoinsrhl", k=300)), "▁▁▁▁if", "▁" + "日本語" * 40, "▁short", "x" * 32, "x" * 33]
    lat = lattice.Lattices(words)
    totals = lat.log_totals(np.stack([weight[lat.piece]] * 2, axis=1))
    assert np.allclose(totals, np.array([log_ways(w) for w in words])[:, None])
    # Chances of the arcs of a node add up to one, shares over a letter too.
    chance, share = lat.chances(weight[lat.piece]), lat.shares(weight[lat.piece])
    inner = np.ones(lat.offset[-1], bool)
    inner[lat.offset[1:] - 1] = False
    assert np.allclose(np.bincount(lat.source, chance, len(inner))[inner], 1)
    for w, word in enumerate(words):
        mine = lat.word == w
        for p in range(0, len(word), 7):
            over = mine & (lat.source - lat.offset[w] <= p) & (lat.target - lat.offset[w] > p)
            assert abs(share[over].sum() - 1) < 1e-9
    # A piece across what was once a cut after 32 letters is used.
    word = "▁" + "a" * 25 + "straightforward"
    lat = lattice.Lattices([word])
    across = (lat.source < 32) & (lat.target > 32)
    assert lat.shares(weight[lat.piece])[across].sum() > 0.9


def test_long_words_identify_their_language():
    weights = np.stack([language.prior(len(lattice.pieces()[1]))] * 2)
    weights[1, lattice.pieces()[0]["ing"]] *= 50
    model = language.Model(("a", "b"), weights / weights.sum(axis=1, keepdims=True), np.log([0.5, 0.5]))
    logs = language.Scorer(model)(["ing" * 3000, "ing" * 5, None, ""])
    assert np.isfinite(logs).all() and logs[0, 1] > logs[0, 0] + 1000 and (logs[2:] == 0).all()


def test_languages_are_told_apart(documents, awkward, nothing):
    rng = random.Random(8)
    stock = {"xx": ["tion", "ing", "ther", "and"], "yy": ["ung", "sch", "keit", "ver"]}
    rows = [(i, " ".join("".join(rng.choices(stock[lang], k=2)) for _ in range(12)), lang, "s") for i in range(120) for lang in [rng.choice(list(stock))]]
    got = language.report(documents(rows)).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0.5 <= r.score <= 1 for r in got)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) for r in got)
    some = language.report(awkward).collect()
    assert len(some) == awkward.count() and all(r.lang_pred == "und" for r in some if r.doc_id in (1, 2, 3))
    assert language.report(nothing).count() == 0


# --- op8 ------------------------------------------------------------------------------------------

def test_lm_figures_are_exact(documents, awkward):
    rng = random.Random(4)
    rows = [(i, text_of(rng, rng.randrange(0, 60)).upper() if i % 9 else None) for i in range(200)] + [(3, "rare words"), (None, "stone1")]
    train = [r for r in rows if crc(r[0]) % 7 != 2]
    counts = collections.Counter(w for _, t in train for w in (t or "").encode().lower().split())
    tokens, kinds = sum(counts.values()) + len(train), len(counts) + 1
    got = collections.defaultdict(list)
    for r in gru_lm.report(documents(rows)).collect():
        got[r.doc_id].append(r)
        assert r.train_tokens == tokens and r.score < 0
    want = collections.defaultdict(list)
    for i, t in rows:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((c + 1) / (tokens + kinds + 1)) for c in [*[counts[w] for w in words], len(train)])
        want[i].append((len(words) + 1, sum(counts[w] > 0 for w in words) + 1, round(base, 6)))
    assert {i: sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rs) for i, rs in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert gru_lm.report(awkward).count() == awkward.count()


def test_lm_empty(nothing):
    assert gru_lm.report(nothing).count() == 0


def test_network_gradient_and_probabilities():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 500, gru_lm.SYMBOLS).astype(float)
    net = gru_lm.Network(tokens)
    net.flat[:] += rng.normal(0, 0.2, len(net.flat)).astype(np.float32)
    h = rng.normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    every = net.log_prob(np.repeat(h, gru_lm.SYMBOLS, 0), np.arange(gru_lm.SYMBOLS))
    assert abs(np.exp(every).sum() - 1) < 1e-4
    docs = sorted(([*rng.integers(1, gru_lm.SYMBOLS, n), 0] for n in (9, 5, 5)), key=len, reverse=True)
    docs = [np.array(d) for d in docs]
    flat, start, length = gru_lm._flat(docs)
    gradient, _ = net.gradient(np.zeros((3, gru_lm.HIDDEN), np.float32), flat, start, length, 0)
    total = sum(map(len, docs))
    loss = lambda: -net.scores(docs).sum() / total
    for at in rng.choice(np.flatnonzero(np.abs(gradient) > 1e-3), 25, replace=False):
        keep, step = net.flat[at], 1e-2
        net.flat[at] = keep + step
        up = loss()
        net.flat[at] = keep - step
        down = loss()
        net.flat[at] = keep
        assert abs((up - down) / (2 * step) - gradient[at]) < 2e-3 + 0.05 * abs(gradient[at])
    before = loss()
    for _ in range(30):
        net.train(docs)
    assert loss() < before - 0.5


def test_symbol_shares_add_up():
    counts = np.array([1] * 5 + [2, 3, 3, 4, 7, 9])
    level = np.log2(counts).astype(int)
    bins = lambda add: np.array([(counts[level == b] + add).sum() for b in range(1, gru_lm.BINS + 1)], float)
    found = gru_lm.Counts(40, 11, 3, np.zeros(0), bins(0), bins(1), 5, 1)
    shares = 10 ** found.within(counts)
    assert all(abs(shares[level == b].sum() - 1) < 1e-9 for b in (1, 2, 3))
    assert abs(shares[level == 0].sum() + 10 ** found.within(np.array([0]))[0] - 1) < 1e-9


# --- op9 ------------------------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(d) for d in m.group() if d.isdigit()]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            if (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else 0, 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return [(s, e, k) for s, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-%+ ()12 90.9-é", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert [x for x in sorted(personal.base_spans(text), key=lambda x: (x[0], x[2]))] == plain_spans(text)


def test_personal_report(documents, awkward, nothing):
    rows = [(i, f"write to bob.{i}@mail.example.com or +1 (456) 555-21{i:02d} from 10.0.0.{i}", "en", "s") for i in range(60)]
    rows += [(100, "card 4111 1111 1111 1111 and 4111 1111 1111 1112, phone (456) 555-2186 ok"), (101, "bob [at] mail [dot] com"), (102, "é🎉 a@b.cd"), (103, "999.1.1.1")]
    got = {r.doc_id: r for r in personal.report(documents(rows)).collect()}
    for i, text, *_ in rows:
        want = plain_spans(text)
        said = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, e, k in want)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, _, k in want) for j in range(4)]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    assert "phone:56" in got[100].spans and "card:29" not in got[100].spans
    assert personal.report(awkward).count() == awkward.count() and personal.report(nothing).count() == 0
    clean = {r.doc_id: r.text for r in personal.redact(documents(rows)).collect()}
    assert clean[5] == "write to <email> or <phone> from <ip>" and clean[103] == "999.1.1.1"


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    votes = np.array([np.where(rng.random(4000) < good, np.where(truth, 1, -1), np.where(truth, -1, 1)) for good in (0.5, 0.95, 0.9, 0.85, 0.8, 0.6)]).T
    votes[:, 0] = 0
    post, tables = personal.expectation_maximisation(votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95 and tables[1, 1, 2] > 0.9 and tables[5, 1, 2] < 0.7


# --- op2 ------------------------------------------------------------------------------------------

def test_samples_follow_the_distribution():
    text, n = "the cat", 6000
    got = list(sampling.segmentations([text] * n, [sampling.row_key(i, 1) for i in range(n)], 3))
    log = {tuple(ids.tolist()): p for found in got for ids, p, *_ in found}
    assert all(len({tuple(g[0].tolist()) for g in found}) == 3 for found in got)
    assert all(a[2] >= b[2] for found in got for a, b in zip(found, found[1:]))
    first = collections.Counter(tuple(found[0][0].tolist()) for found in got)
    assert all(abs(first[k] / n - math.exp(p)) < 0.01 for k, p in log.items())
    best = max(log, key=log.get)
    second = collections.Counter(tuple(f[1][0].tolist()) for f in got if tuple(f[0][0].tolist()) == best)
    assert all(abs(second[k] / second.total() - math.exp(p) / (1 - math.exp(log[best]))) < 0.03 for k, p in log.items() if k != best)
    # Weighted by inclusion, the samples stand for all segmentations.
    assert abs(np.mean([sum(math.exp(p) / i for _, p, _, i in found) for found in got]) - 1) < 0.02


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c▁\n日é🎉", max_size=90), min_size=1, max_size=4))
def test_segmentations_decode_to_the_text(texts):
    keys = [sampling.row_key(i, 2) for i in range(len(texts))]
    for text, found in zip(texts, sampling.segmentations(texts, keys, 4)):
        assert 1 <= len(found) <= 4 and len({tuple(f[0].tolist()) for f in found}) == len(found)
        assert all(sampling.decode(f[0].tolist()) == text and 0 <= f[3] <= 1 for f in found)
    alone = [list(sampling.segmentations([t], [k], 4))[0] for t, k in zip(texts, keys)]
    together = list(sampling.segmentations(texts, keys, 4))
    assert [[f[0].tolist() for f in a] for a in alone] == [[f[0].tolist() for f in t] for t in together]


def test_runs_of_spaces_and_long_words_are_drawn_whole():
    """Pieces of several spaces and pieces anywhere in a long word can be drawn; probabilities are those of the whole lattice."""
    known, path = lattice.pieces()[0], lattice.VOCABULARY
    weight, drawn = sampling.weights(path), set()
    rng = random.Random(2)
    texts = ["if x:\n        return  y", "".join(rng.choices("abcdefgh日é", k=10_000)), "x" * 29 + "recommendations" * 2]
    longest = max(map(len, known))
    for text in texts:
        escaped = "▁" + text.replace(" ", "▁")
        log = [0.0] + [-math.inf] * len(escaped)
        for p in range(len(escaped)):
            for n in range(1, min(longest, len(escaped) - p) + 1):
                piece = known.get(escaped[p:p + n])
                if piece is not None or n == 1:
                    log[p + n] = np.logaddexp(log[p + n], log[p] + math.log(weight[piece if piece is not None else -1]))
        for ids, log_prob, _, _ in list(sampling.segmentations([text], [sampling.row_key(1, 1)], 3))[0]:
            assert sampling.decode(ids.tolist()) == text
            # Bytes of a letter that no piece covers count once.
            plain, total, i = ids.tolist(), 0.0, 0
            first_byte = {int(b): v for v, b in enumerate(lattice.byte_ids())}
            while i < len(plain):
                value = first_byte.get(plain[i])
                total += math.log(weight[-1] if value is not None else weight[plain[i]])
                i += 1 if value is None or value < 0x80 else 2 if value < 0xE0 else 3 if value < 0xF0 else 4
            assert abs(total - log[-1] - log_prob) < 1e-6 * max(1, abs(log_prob))
            drawn |= set(plain)
    names = [lattice.pieces()[1][i] for i in drawn]
    assert any(len(t) > 1 and set(t) == {"▁"} for t in names)
    many = [list(sampling.segmentations(["x" * 24 + "addEventListener"], [sampling.row_key(i, 3)], 1))[0][0][0].tolist() for i in range(40)]
    across = 0
    for ids in many:
        at = np.cumsum([len(lattice.pieces()[1][i]) for i in ids])
        across += 32 not in at
    assert across > 20


def test_encode_awkward(awkward, nothing):
    got = sampling.encode(awkward, checked=True).collect()
    assert all(r.decodes for r in got) and {r.doc_id for r in got} == {None, *range(2, 11)}
    assert sampling.encode(nothing).count() == 0
    assert sampling.encode(awkward.filter("doc_id = 4")).first().ids is not None


# --- op10 -----------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(1, n), max_size=60))))
def test_best_fit_decreasing(case):
    length, sizes = case
    rows = packing.pack(sizes, length)
    plain = []
    for size in sorted(sizes, reverse=True):
        room = [(length - sum(r) - size, i) for i, r in enumerate(plain) if length - sum(r) >= size]
        if room:
            plain[min(room)[1]].append(size)
        else:
            plain.append([size])
    assert sorted(p for r in rows for p in r) == list(range(len(sizes)))
    assert sorted(sum(sizes[p] for p in r) for r in rows) == sorted(map(sum, plain))


def test_packing_is_lossless(awkward, nothing):
    length = 64
    pieces = collections.defaultdict(list)
    for r in packing.packed(awkward, length, window=500).collect():
        ids, bounds = np.frombuffer(r.ids, "<u2"), r.cumulative_lengths
        assert len(ids) == r.n_ids == bounds[-1] <= length and bounds[0] == 0 and r.resets == bounds[:-1]
        assert len(r.doc_ids) == len(r.offsets) == len(bounds) - 1
        inside = packing.position_ids(bounds)
        assert [int(i) for i in np.flatnonzero(inside == 0)] == r.resets
        for doc, at, lo, hi in zip(r.doc_ids, r.offsets, bounds, bounds[1:]):
            pieces[doc].append((at, ids[lo:hi]))
    for doc, text in awkward.filter("doc_id is not null and doc_id <> 9").select("doc_id", "text").collect():
        some = sorted(pieces[doc], key=lambda p: p[0])
        assert [p[0] for p in some] == list(np.r_[0, np.cumsum([len(p[1]) for p in some])][:-1])
        ids = np.concatenate([p[1] for p in some])
        assert ids[-1] == packing.END and packing.decode(ids) == (text or "")
    assert len(pieces[9]) == 2 and packing.packed(nothing).count() == 0


def test_packed_matrices_are_written_and_read_back(spark, documents, awkward, nothing, tmp_path):
    rng = random.Random(11)
    rows = [(i, text_of(rng, rng.choice([0, 3, 40, 400, 9000]))) for i in range(80)] + [(90, None), (91, "日本 🎉  x\n\t"), (92, "")]
    docs = documents(rows).repartition(9)
    packing.write(docs, str(tmp_path / "packed"))
    back = packing.read(spark, str(tmp_path / "packed"))
    assert {r.doc_id: r.text for r in packing.unpacked(back).collect()} == {i: t or "" for i, t in rows}
    # Nearly every row is full, however many partitions there were.
    total, count = back.selectExpr("sum(n_ids)", "count(*)").first()
    assert total > 0.95 * packing.LENGTH * (count - 1) and back.filter("n_ids <> length(ids) / 2").isEmpty()
    told = packing.report(docs)
    assert told.columns == ["ids_hash", "n_ids", "cumulative_lengths", "doc_ids", "offsets", "resets"]
    assert told.agg({"n_ids": "sum"}).first()[0] == total
    assert packing.report(nothing).count() == 0
    assert packing.unpacked(packing.packed(awkward)).count() == awkward.select("doc_id").distinct().count() - 2   # null and 9 stand on two rows
