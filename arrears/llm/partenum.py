"""Jaccard self-join on word shingles by PartEnum signatures.

Two sets with Jaccard similarity g or more differ in at most (1 - g) / (1 + g) of their summed sizes.
Sizes are cut into bands; pairs whose larger set lies in a band differ in at most k elements. The
feature domain is partitioned by hash into ``k // 2 + 1`` parts and some spare ones, so that at least
one part differs in at most one element. Each part is cut in three, and leaving out one third in turn
gives three signatures, one of which both sets share. A set also signs for the next band when its
partner can lie there. Nothing is missed.

A projection without elements, or of common shingles only, is shared by unrelated sets. With s spare
parts, 1 + s parts agree. So a set with at most s parts that have such a projection may leave these
signatures out: in one more part it agrees with its partner on a telling one, which both sign. A set
with more keeps them all. Which shingles are common is read off a sample of documents; it only
decides how many candidates there are, never which links are found.

Sets that share signatures form candidate groups, joined through the smallest member of each bucket,
so their number is linear in the signatures. One group may hold a good part of all documents, tied by
passages they share. Such a group is parted by sketches first: a bit for each class of shingles, odd or
even. Two sets differ in at least as many shingles as their sketches in bits, so no link is lost.
Groups are then checked exactly, in blocks of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import components, groups_of, local_roots, stage, words_of
from arrears.operators.common import shuffles_dropped

BAND = 1.5            # ratio of the sizes in a band
GROUP_ROWS = 1024     # documents of a block
SKETCH_ROWS = 4096    # sketches of a block
SAMPLE = 16           # one in so many documents tells which shingles are common
COMMON = 100_000      # common shingles that are told apart, 8 bytes each
SEEN = 200_000        # set keys a task remembers, to sign equal sets once
RARE = 8              # a shingle of at most so many documents of a block is counted pair by pair
BROADCAST_ROWS = 1_000_000   # candidates (16 bytes each) sent to every executor; more are joined by shuffle
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
GOLDEN = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * GOLDEN
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes; remembers a bounded number of words."""
    LIMIT = 300_000

    def __init__(self, width: int):
        self.width, self.known, self.hashes = width, {}, []

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.LIMIT:
            self.known, self.hashes = {}, []
        known, hashes = self.known, self.hashes
        for w in set(words):
            if w not in known:
                known[w] = len(hashes)
                hashes.append(xxhash.xxh64_intdigest(w))
        h = np.array([hashes[i] for i in map(known.__getitem__, words)], dtype=np.uint64)
        width = min(self.width, len(words))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = mix(out * M1 + h[i:len(h) - width + 1 + i])
        return np.unique(out)


def set_key(shingles: np.ndarray) -> int:
    """64-bit key of a set, null-safe: equal sets have equal keys."""
    total = mix(shingles).sum(dtype=np.uint64, keepdims=True) + np.array([len(shingles)], np.uint64) * M1
    return int(mix(total).view(np.int64)[0])


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parities of the counts of shingles by their low bits, in about one bit for each shingle."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    cells = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((cells & 1).astype(bool), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all as short as the shortest; a half has the parities of both halves."""
    words = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), words), np.uint64)
    for i, sketch in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, words), axis=0)
    return out


def near_sketches(sketches: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """The smallest position reachable over all pairs that may link, as far as their sketches tell."""
    words, n, step = folded(sketches), len(sketches), GROUP_ROWS // 2
    found = [np.zeros((2, 0), np.int64)]
    for lo in range(0, n, step):
        for at in range(lo, n, step):
            mine, theirs = words[lo:lo + step], words[at:at + step]
            apart = np.zeros((len(mine), len(theirs)), np.int32)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(mine[:, w, None] ^ theirs[None, :, w])
            both = sizes[lo:lo + step, None] + sizes[None, at:at + step]
            a, b = np.nonzero((100 + percent) * apart <= (100 - percent) * both)
            b = b + len(mine) * (at > lo)
            root = local_roots(len(mine) + len(theirs) * (at > lo), a, b)
            moved = np.flatnonzero(root != np.arange(len(root)))
            pairs = np.stack([moved, root[moved]])
            found.append(np.where(pairs < len(mine), pairs + lo, pairs - len(mine) + at))
    a, b = np.concatenate(found, axis=1)
    return local_roots(n, a, b)


class Signer:
    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.percent = percent
        self.common = np.sort(common) if common is not None and len(common) else np.zeros(1, np.uint64)
        lows, top = [1], 1.0
        while lows[-1] < 2**40:
            top *= BAND
            if int(np.ceil(top)) > lows[-1]:
                lows.append(int(np.ceil(top)))
        self.lows = np.array(lows)

    def instances(self, size: int):
        """(band, parts, spare) of each band the set signs for, without bands of equal sets only."""
        first = int(np.searchsorted(self.lows, size, "right")) - 1
        last = int(np.searchsorted(self.lows, size * 100 // self.percent, "right")) - 1
        for band in range(first, last + 1):
            most = int(self.lows[band + 1]) - 1
            k = 2 * most * (100 - self.percent) // (100 + self.percent)
            if k:
                parts = k // 2 + 1
                # Parts with an empty projection, of the smallest set that signs for the band.
                mean = 3 * parts * math.exp(-2 / 3 * int(self.lows[band]) * self.percent / 100 / parts)
                spare = 2 + math.ceil(mean + 3 * math.sqrt(mean))
                yield band, parts + spare, spare

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        found = []
        rare = self.common[np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)] != shingles
        for band, parts, spare in self.instances(len(shingles)):
            h = mix(shingles + np.array([band], np.uint64) * M1)
            part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cell = (part * np.uint64(3) + (h & np.uint64(0xFFFFFFFF)) % np.uint64(3)).astype(np.int64)
            count = np.bincount(cell[rare], minlength=3 * parts).reshape(parts, 3)
            sums = np.zeros(3 * parts, np.uint64)
            np.add.at(sums, cell, mix(h))
            sums = sums.reshape(parts, 3)
            empty = count.sum(axis=1, keepdims=True) == count
            kept = ~empty if empty.any(axis=1).sum() <= spare else np.ones_like(empty)
            tags = mix(np.arange(3 * parts, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))).reshape(parts, 3)
            found.append(mix((sums.sum(axis=1, keepdims=True) - sums) * M1 + tags)[kept])
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    feature = np.concatenate(sets)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    starts = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]])
    df = np.diff(np.r_[starts, len(feature)])
    out = np.zeros((n, n), np.int64)
    for size in range(2, RARE + 1):
        at = starts[df == size]
        for i in range(size):
            for j in range(i + 1, size):
                out += np.bincount(owner[at + i] * n + owner[at + j], minlength=n * n).reshape(n, n)
    out += out.T
    common = np.flatnonzero(df > RARE)
    for lo in range(0, len(common), 2048):
        some = common[lo:lo + 2048]
        slab = np.zeros((n, len(some)), np.float32)
        where = np.repeat(np.arange(len(some)), df[some])
        at = np.concatenate([np.arange(starts[f], starts[f] + df[f]) for f in some])
        slab[owner[at], where] = 1
        out += np.rint(slab @ slab.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def similarity_classes(documents: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when ``100 * shared >= percent * union`` of their sets of ``width``-word shingles;
    ``component_id`` is the smallest doc_id reachable by links. A text with fewer words is one shingle.
    Null and empty texts have no shingles and link with nothing, nor does a null doc_id's component
    mean anything (it is null). Rows that repeat a doc_id are judged each by its own text. Other
    columns are not looked at. An empty table gives no rows.
    """
    return classes_of_rows(documents, width, percent).select("doc_id", "n_shingles", "component_id")


def classes_of_rows(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """As ``similarity_classes``, with the key of each row's set as ``node`` (null without shingles)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sized(batches):
        shingle = Shingler(width)
        for frame in batches:
            sets = [shingle(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "n": [len(s) for s in sets],
                                "node": pd.array([set_key(s) if len(s) else None for s in sets], dtype="Int64"),
                                "sketch": [sketch_of(s) if len(s) else None for s in sets]})

    common = common_shingles(texts, width)

    def signed(batches):
        shingle, sign, seen = Shingler(width), Signer(percent, common), set()
        for frame in batches:
            keys, found, held = [], [], 0
            for text in frame["text"]:
                s = shingle(text)
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                found.append(sign(s))
                keys.append(key)
                held += len(found[-1])
                if held > 200_000:
                    yield _rows(keys, found)
                    keys, found, held = [], [], 0
            if held:
                yield _rows(keys, found)

    base = stage(texts.mapInPandas(sized, "doc_id long, n long, node long, sketch binary"))
    signatures = texts.mapInPandas(signed, "sig long, node long, low long")
    # Rows of a bucket: one for each time a task hands on what it holds, however many sets are in it.
    lowest = F.expr("least(low, min(node) over (partition by sig))")
    grouped = components(signatures.select("node", lowest.alias("low")).filter("node <> low")
                         .select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    edges = verified(texts, base, parted(base, stage(grouped), percent), width, percent)
    # Both tables are written: a join of plain scans is one whose hot keys adaptive execution splits.
    joined = stage(components(edges).withColumnRenamed("id", "node").withColumnRenamed("component_id", "root"))
    rooted = base.drop("sketch").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = stage(rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("first")))
    return rooted.join(first, "root", "left").select("doc_id", "node", F.col("n").alias("n_shingles"),
                                                     F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"))


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles of three or more of one in ``SAMPLE`` documents, the most frequent ``COMMON`` of them."""
    def counted(batches):
        shingle = Shingler(width)
        for frame in batches:
            for lo in range(0, len(frame), 500):
                sets = [shingle(t) for t in frame["text"].iloc[lo:lo + 500]]
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"shingle": values.view(np.int64), "n": n})

    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    with shuffles_dropped(texts.sparkSession):
        table = (sample.mapInPandas(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n >= 3")
                 .orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").collect())
    return np.array([r.shingle for r in table], dtype=np.int64).view(np.uint64)


def _rows(keys, found) -> pd.DataFrame:
    """Signatures with the least of the sets at hand that have them; the other sets are tied to that one directly.

    A tie has a number of its own set in place of the signature, so that the sets of a common signature are spread.
    """
    sig, node = np.concatenate(found).view(np.int64), np.repeat(np.array(keys, dtype=np.int64), [len(f) for f in found])
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.r_[True, sig[1:] != sig[:-1]]
    low = node[first][np.cumsum(first) - 1]
    tied = node != low
    ties = np.unique(np.stack([node[tied], low[tied]], axis=1), axis=0)
    return pd.DataFrame({"sig": np.r_[sig[first], mix(ties[:, 0].view(np.uint64)).view(np.int64)], "node": np.r_[node[first], ties[:, 0]],
                         "low": np.r_[low[first], ties[:, 1]]})


def members(base: DataFrame, grouped: DataFrame, *more: str) -> DataFrame:
    """Sets of the groups: node, comp, a document that has it, its size and other columns of ``base``."""
    one = base.filter("node is not null and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", *more)])
    return grouped.select(F.col("id").alias("node"), F.col("component_id").alias("comp")).join(one, "node")


def blocks(nodes: DataFrame, whole: int, rows: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets with the block they lie in (comp, block, salt), and the pairs of blocks that may hold a link.

    A group of up to ``whole`` sets is one block. A larger one is cut by size, and sizes with more than ``rows`` sets by
    hash; blocks meet where sizes allow a link.
    """
    step = float(np.log(100 / percent))
    nodes = stage(nodes.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")))
    sizes = nodes.groupBy("comp", "band").agg(F.count("*").alias("_rows"))
    total = sizes.groupBy("comp").agg(F.sum("_rows").alias("_all"))
    plan = stage(sizes.join(total, "comp").withColumn("block", F.when(F.col("_all") <= whole, F.lit(-1)).otherwise(F.col("band")))
                 .withColumn("_c", F.when(F.col("_all") <= whole, F.lit(1)).otherwise(F.ceil(F.col("_rows") / rows).cast("int"))))
    chunks = plan.select("comp", "block", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("salt")).distinct()
    other = chunks.select("comp", F.col("block").alias("block2"), F.col("salt").alias("salt2"))
    # Sizes a link allows differ by one band at most.
    near = chunks.join(other, "comp").filter("abs(block - block2) <= 1")
    return nodes.join(plan.select("comp", "band", "block", "_c"), ["comp", "band"]).withColumn(
        "salt", F.pmod(F.xxhash64("node"), F.col("_c")).cast("int")), near


def meeting(rows: DataFrame, near: DataFrame, *columns: str) -> DataFrame:
    """Rows once for each pair of blocks that theirs is in, sorted by that pair (comp, lo, hi)."""
    # A block's number: its size band above, its salt below.
    mine, theirs = ((F.col(f"block{x}").cast("long") + 1) * 2**31 + F.col(f"salt{x}") for x in ("", "2"))
    return (rows.join(near, ["comp", "block", "salt"]).withColumn("lo", F.least(mine, theirs)).withColumn("hi", F.greatest(mine, theirs))
            .select("comp", "lo", "hi", *columns)
            .repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi"))


def parted(base: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """The candidate groups, those of more than ``GROUP_ROWS`` sets parted by sketches.

    Sets of a group that may link, as far as their sketches tell, stay together; a set that can link with none leaves.
    A sketch is some twentieth of a text, so all pairs of blocks can meet where texts would fill the disk.
    """
    large = stage(grouped.groupBy("component_id").count().filter(F.col("count") > GROUP_ROWS).select("component_id"))
    if large.isEmpty():
        return grouped
    keyed, near = blocks(members(base, grouped.join(F.broadcast(large), "component_id", "left_semi"), "sketch"), 0, SKETCH_ROWS, percent)
    dealt = meeting(keyed, near, "node", "n", "sketch")

    def tied(batches):
        for group in groups_of(batches, ["comp", "lo", "hi"]):
            root = near_sketches(list(group["sketch"]), group["n"].to_numpy(), percent)
            moved = root != np.arange(len(root))
            if moved.any():
                ids = group["node"].to_numpy()
                yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    ties = stage(dealt.mapInPandas(tied, "a long, b long"))
    return stage(grouped.join(F.broadcast(large), "component_id", "left_anti").unionByName(components(ties)))


def verified(texts: DataFrame, base: DataFrame, grouped: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between set keys, enough to join what is linked, checked exactly.

    A group of up to ``GROUP_ROWS`` sets is one block. A larger one is cut by size, and sizes with many
    sets by hash; blocks meet in pairs where sizes allow a link.
    """
    keyed, near = blocks(members(base, grouped), GROUP_ROWS, GROUP_ROWS // 2, percent)
    few = keyed.count() <= BROADCAST_ROWS
    slim = keyed.select("doc_id", "node", "comp", "block", "salt")
    whole = texts.filter("doc_id is not null").join(F.broadcast(slim) if few else slim, "doc_id")
    dealt = meeting(whole, near, "node", "text")

    def checked(batches):
        shingle = Shingler(width)
        for group in groups_of(batches, ["comp", "lo", "hi"]):
            if len(group) < 2:
                continue
            sets = [shingle(t) for t in group["text"]]
            # Rows that repeat a doc_id may bring another text, or the same once more.
            right = {key: i for i, (s, key) in enumerate(zip(sets, group["node"])) if len(s) and set_key(s) == key}
            sets = [sets[i] for i in right.values()]
            if len(sets) < 2:
                continue
            n = np.array([len(s) for s in sets])
            shared = shared_counts(sets)
            a, b = np.nonzero(np.triu(100 * shared >= percent * (n[:, None] + n[None, :] - shared), 1))
            if len(a):
                ids = np.fromiter(right, np.int64)
                root = local_roots(len(ids), a, b)
                moved = root != np.arange(len(ids))
                yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return stage(dealt.mapInPandas(checked, "a long, b long"))


def deduplicated(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are linked, directly or not, to one with a smaller doc_id.

    Of rows that agree in doc_id and text one stays. Texts without words and null ids always stay. Rows that
    repeat a doc_id are judged each by its own text: one may go and another stay.
    """
    classes = classes_of_rows(documents, width, percent).filter("doc_id is not null").groupBy("doc_id", "node").agg(
        F.min("component_id").alias("component_id"))
    gone = (F.col("component_id") < F.col("doc_id")) & F.col("node").isNotNull()
    classes = stage(classes.select("doc_id", "node", gone.alias("gone")))
    verdicts = stage(classes.groupBy("doc_id").agg(F.min("gone").alias("all"), F.max("gone").alias("some")).filter("some"))

    def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")

    few = verdicts.count() <= BROADCAST_ROWS
    left = without(documents, verdicts.filter("all").select("doc_id"))
    partly = verdicts.filter("not all").select("doc_id")
    if not partly.isEmpty():
        @F.pandas_udf("long")
        def key_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            shingle = Shingler(width)
            for texts in batches:
                yield pd.Series([set_key(s) if len(s) else None for s in map(shingle, texts)], dtype="Int64")

        dropped = classes.filter("gone").join(partly, "doc_id", "left_semi").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"))
        mixed = left.join(partly, "doc_id", "left_semi").withColumn("_key", key_of("text"))
        mixed = mixed.join(dropped, (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_node")), "left_anti").drop("_key")
        left = without(left, partly).unionByName(mixed)
    twice = stage(documents.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if twice.isEmpty():
        return left
    again = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").unionByName(again)
