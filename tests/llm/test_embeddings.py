"""Operators on embeddings against brute force."""

import numpy as np
import pytest

from arrears.llm import multi_index, near_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, links long"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    x[300:420] = x[300] + 0.05 * rng.normal(size=(120, 16))      # a hot group of near copies
    x[420:440] = x[420]                                         # equal vectors
    for i in range(440, 560, 2):
        x[i + 1] = x[i] + rng.choice([0.02, 0.08, 0.2]) * rng.normal(size=16)
    x *= rng.uniform(0.1, 9, (700, 1))
    return x.astype(np.float32)


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)] + list(more), SCHEMA)


ODD = [(2000, None, 0, 0, 0), (2001, [0.0] * 16, 0, 0, 0), (2002, [float("nan")] + [1.0] * 15, 0, 0, 0), (2003, [None] + [1.0] * 15, 0, 0, 0),
       (2004, [float("inf")] + [1.0] * 15, 0, 0, 0), (2005, [1.0, 2.0], 0, 0, 0), (2006, [2.0, 4.0], 0, 0, 0), (None, [1.0] * 16, 0, 0, 0), (2050, [], 0, 0, 0)]


def cosines(x):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("bucket", [4096, 40])
def test_near_duplicates(spark, vectors, monkeypatch, bucket):
    monkeypatch.setattr(near_embeddings, "BUCKET_ROWS", bucket)
    near = cosines(vectors) >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(near))
    for _ in range(len(near)):
        new = np.array([min(root[i], root[near[i]].min()) if near[i].any() else root[i] for i in range(len(near))])
        if (new == root).all():
            break
        root = new
    got = near_embeddings.near_duplicates(frame(spark, vectors, ODD), miss=1e-6).collect()
    by_id = {r.vec_id: r for r in got}
    assert len(got) == len(vectors) + len(ODD)
    for i in range(len(vectors)):
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (near[i].sum(), root[i], root[i] == i)
    assert all(by_id[i].n_links == 0 and by_id[i].component_id == i for i in (2000, 2001, 2002, 2003, 2004, 2050))
    assert by_id[2005].n_links == 1 and by_id[2006].component_id == 2005 and by_id[None].n_links == 0


def test_near_duplicates_repeated_and_empty(spark, vectors):
    few = frame(spark, vectors[:3])
    assert near_embeddings.near_duplicates(few.unionByName(few)).count() == 3
    assert near_embeddings.near_duplicates(few.limit(0)).count() == 0


def test_walk_is_sorted_and_complete():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.random(rng.integers(1, 9)).round(1), rng.random(rng.integers(1, 9)).round(1)
        counts = rng.integers(0, 4, (len(a), len(b)))
        wanted = int(rng.integers(0, counts.sum() + 1))
        cells = multi_index.walk(a, b, counts, wanted)
        sums = [a[i] + b[j] for i, j in cells]
        assert sums == sorted(sums) and len(set(cells)) == len(cells) and sum(counts[c] for c in cells) >= wanted
        left = [a[i] + b[j] for i in range(len(a)) for j in range(len(b)) if (i, j) not in set(cells)]
        assert not left or not sums or min(left) >= sums[-1] - 1e-12


def test_nearest(spark, vectors, monkeypatch):
    monkeypatch.setattr(multi_index, "ROW_BLOCK", 16)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 5)
    near = cosines(vectors)
    np.fill_diagonal(near, -9)
    ids = np.arange(len(vectors))
    want = {int(q): np.lexsort((ids, -near[q].round(9)))[:5].tolist() for q in ids[ids % 50 == 0]}
    table = frame(spark, vectors, ODD)
    got = {}
    for r in sorted(multi_index.nearest(table).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - near[r.query_id, r.vec_id]) < 1e-12 and r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    # Walking everything is exact, ties by id included.
    whole = {}
    for r in sorted(multi_index.nearest(table, share=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        whole.setdefault(r.query_id, []).append(r.vec_id)
    assert whole == want


def test_nearest_few_rows(spark, vectors):
    assert multi_index.nearest(frame(spark, vectors[:3])).collect()[0][:3] != () and multi_index.nearest(frame(spark, vectors[:3])).count() == 2
    assert multi_index.nearest(frame(spark, vectors[:1])).count() == 0
    assert multi_index.nearest(frame(spark, vectors).limit(0)).count() == 0
