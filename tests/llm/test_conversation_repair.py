"""op12: cheapest edits of conversations against a search over all of them."""

import heapq
import random
import zlib

import pytest

from arrears.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string"
MAY = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit) of (initial, fault) rows: best first search, equal costs in the order of their audits."""
    heap, done = [(0, "", 0, 0)], {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done[at, state] = cost, audit
        after, steps = (2, 2, 3, 2)[state], [(2, "I", at, (2, 2, 3, 2)[state])]
        if at < len(rows):
            initial, fault = rows[at]
            steps.append((3, "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                steps.append((2 + extra, "R", at + 1, after))
                if (state, initial) in MAY:
                    steps.append((0 + extra, "K", at + 1, MAY[state, initial]))
        for price, letter, there, then in steps:
            heapq.heappush(heap, (cost + price, audit + letter, there, then))
    return min(done[len(rows), s] for s in (0, 3) if (len(rows), s) in done)


def coded(rows):
    return bytes(c.INITIALS.get(i, 3) | ("", "blank", "duplicate", "truncated").index(f) << 2 for i, f in rows)


def solved(rows):
    cost, order, codes = [0] + [c.FAR] * 3, [0] * 4, coded(rows)
    for code in codes:
        cost, order, _ = c.forward(cost, order, code)
    end = min(range(4), key=lambda s: (cost[s] + c.TAIL[s][0], order[s]))
    return cost[end] + c.TAIL[end][0], (c.audit(codes, 0, len(codes), 0, end) if codes else "") + c.TAIL[end][1]


@pytest.mark.parametrize("longest", [4, 12, 70])
def test_halving_finds_the_least_of_the_cheapest_audits(longest):
    rng = random.Random(longest)
    for _ in range(300):
        rows = [(rng.choice("suauax"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(longest + 1))]
        assert solved(rows) == cheapest(rows)


def kind(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "A?"), (1, 2, None, "B"), (1, 2, "user", None),
            (3, 0, "", ""), (3, 0, "", ""), (4, 5, "assistant", "x" * 100_000), (4, -5, "user", "é\x00日"), (4, 9, "system", " \t\n ")]
    dropped = next(i for i in range(100, 400) if kind(i, 0) == 0)
    doubled = next(i for i in range(100, 400) if kind(i, 0) == 3)
    rows += [(dropped, 0, "user", "gone."), (doubled, 0, "user", "Twice.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "no_conv", "row", "digest", "first", "late", "kind", "copy"):
        df = df.withColumn(name, df["turn"])
    found = {r.conv_id: r for r in c.report(df).collect()}
    assert sorted(found, key=str) == sorted({r[0] for r in rows}, key=str)
    nothing = found[dropped]
    assert (nothing.gaps, nothing.blank, nothing.cost, nothing.audit) == (0, 0, 0, "")
    assert nothing.repaired_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert (found[doubled].duplicate, found[doubled].audit, found[doubled].cost, found[doubled].illegal) == (1, "KDI", 5, 1)
    assert c.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 3, "assistant", ""), (1, 4, "assistant", "Four."), (2, 0, "assistant", "Alone."),
            (None, 0, "system", "S."), (None, 1, "user", "U."), (None, 2, "assistant", "cut")]
    out = [tuple(r) for r in c.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()]
    assert out == [(None, 0, "K", "system", "S."), (None, 1, "K", "user", "U."), (None, 2, "K", "assistant", "cut"),
                   (1, 0, "K", "user", "One."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "Two."), (1, 3, "K", "assistant", "Four."),
                   (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Alone.")]


def test_a_conversation_of_many_rows(spark):
    """One conversation over several batches; the digest is that of its repaired rows."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Some.", "other", f"text {t}."])) for t in range(30_000)]
    held = c.report(spark.createDataFrame(rows, SCHEMA)).first()
    assert len(held.audit) >= 28_000 and held.duplicate > 10_000
    facts, seen = [], set()
    for conv, turn, role, text in rows:
        what = kind(conv, turn)
        if what == 0:
            continue
        text, role = "" if what == 1 else text.replace(".", "") if what == 2 else text, "user" if what == 4 else role
        for _ in range(1 + (what == 3)):
            facts.append((role[0], "blank" if not text else "duplicate" if (role, text) in seen else "" if text[-1] == "." else "truncated"))
            seen.add((role, text))
    assert (held.cost, held.audit) == cheapest(facts)
