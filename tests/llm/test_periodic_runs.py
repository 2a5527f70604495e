"""op13: runs against a search over all periods."""

import hashlib
import random

from arrears.llm import periodic_runs as p


def searched(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(s, s + length - d)) for d in range(1, q)):
                out.add((s, length, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def mixture(rng):
    letters, out = "abcdefg"[:rng.choice([1, 2, 3, 5, 7])], []
    for _ in range(rng.randrange(6)):
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
        out += (unit * rng.randrange(1, 9))[:rng.randrange(1, 40)]
    return out


def test_all_runs_of_lists_that_are_searched_together():
    rng = random.Random(3)
    for _ in range(300):
        lists = [mixture(rng) for _ in range(rng.randrange(1, 6))]
        assert p.runs_of(lists) == [searched(w) for w in lists]


def test_suffix_array_and_common_prefixes():
    import numpy as np
    rng = random.Random(4)
    for _ in range(100):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 60))] + [9]
        array, rank, lcp = p.suffix_array(np.array(text))
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        assert (rank[array] == np.arange(len(text))).all()
        for k in range(1, len(text)):
            a, b = text[array[k - 1]:], text[array[k]:]
            assert lcp[k] == next(i for i in range(len(a) + 1) if a[:i + 1] != b[:i + 1])


def test_one_word_many_times_takes_no_square_of_time():
    assert p.runs_of([["a"] * 300_000, ["b"] * 5, ["c"] * 6]) == [[(0, 300_000, 1)], [], [(0, 6, 1)]]


def test_planted_tails():
    for doc in range(60):
        words = [str(i) for i in range(50)]
        changed = p.changed(words, doc)
        h = p.zlib.crc32(str(doc).encode())
        if h % 10:
            assert changed is words
        else:
            a, g = h // 10 % 50, h // 10
            period = 1 + (50 - a) // (3 + g % 8)
            assert changed == [words[i] if i < a else words[a + (i - a) % period] for i in range(50)]


def test_tables(spark, documents, awkward, nothing):
    assert p.report(nothing).count() == 0 and p.detect(nothing).count() == 0
    found = [r.asDict() for r in p.report(awkward).collect()]
    assert len(found) == awkward.count()
    for r in found:
        assert len(r["runs_sha256"]) == 64 and len(r["collapsed_sha256"]) == 64 and (r["start"] is None) == (r["n_runs"] == 0)
    rows = {r.doc_id: r for r in p.detect(documents([(1, "x a b a b a b a b a y"), (2, None), (3, " \n"), (4, "A a A a A a a a a a a a")])).collect()}
    assert [tuple(r) for r in rows[1].runs] == [(1, 9, 2)] and rows[1].text == "x a b y"
    assert rows[2].runs == rows[3].runs == [] and rows[2].text == rows[3].text == ""
    assert [tuple(r) for r in rows[4].runs] == [(5, 7, 1)] and rows[4].text == "A a A a A a"
    for r in p.report(documents([(2, "")])).collect():
        assert r.collapsed_sha256 == r.runs_sha256 == hashlib.sha256(b"").hexdigest()
