"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics are column expressions. Small boosted trees are grown on those of a bounded sample of
labelled rows; every path from a root to a node is a rule, a conjunction of bounds. A logistic model with
an L1 penalty weighs the rules, which leaves few of them, and the rules with a weight are compiled into one
column expression. So scoring is a projection: no Python worker, no shuffle, any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import fold

SAMPLE_ROWS = 20_000   # labelled rows the rules are fitted on, the first by a hash of the id
TREES = 40
DEPTH = 3
BINS = 48              # bounds tried for a statistic: quantiles of the sample
LEAST_SHARE = 0.002    # of the rows in a leaf
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)   # of which cross-validation takes one
PARTS = 3              # of the rows, by a hash of the text, for it
CLEAN = 0.7            # least score of a row that is predicted to be good

# Counted in a text and divided by its words.
COUNTED = {
    "ends": r"[.!?](?=\s|$)", "commas": r"[,;:]", "symbols": r"[#$%&*|~^=<>{}\[\]@_\\]+", "bangs": r"[!?]{2,}", "digits": r"[0-9]+",
    "capitals": r"\p{Lu}{2,}", "initials": r"(?<!\S)\p{Lu}", "repeats": r"(?<!\S)(\S++)(?=\s+\1(?!\S))", "short": r"(?<!\S)\S{1,3}(?!\S)",
    "long": r"\S{20,}",
}


def statistics(text: Column) -> dict[str, Column]:
    """Figures of a text, none of them null; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("double")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("double")
    each = F.greatest(words, F.lit(1.0))
    different = F.size(F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))).cast("double")
    return {
        "words": F.log1p(words), "letters": F.length(text) / each, "width": words / lines, "different": F.least(F.lit(1.0), different / each),
        "lines": F.size(F.array_distinct(F.split(text, "\n"))) / lines,
        **{name: F.regexp_count(text, F.lit(pattern)) / each for name, pattern in COUNTED.items()},
    }


NAMES = ("words", "letters", "width", "different", "lines", *COUNTED)
# A bound of a rule: (statistic, True for "at most" and False for "more than", bound).
Bound = tuple[int, bool, float]


@dataclass(frozen=True)
class Model:
    """Weighted rules; without rules every score is that of ``base``."""
    base: float
    rules: tuple[tuple[tuple[Bound, ...], float], ...]

    def told(self) -> list[str]:
        """The rules in words, the heaviest first."""
        return [f"{weight:+.2f} " + " and ".join(f"{NAMES[f]} {'<=' if most else '>'} {bound:.4g}" for f, most, bound in rule)
                for rule, weight in sorted(self.rules, key=lambda r: -abs(r[1]))]

    def column(self, of: dict[str, Column]) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            held = F.lit(True)
            for f, most, bound in rule:
                held = held & (of[NAMES[f]] <= bound if most else of[NAMES[f]] > bound)
            total = total + F.when(held, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def _merged(path: list[Bound]) -> tuple[Bound, ...]:
    """A path with one bound of each kind for a statistic."""
    tight: dict[tuple[int, bool], float] = {}
    for f, most, bound in path:
        tight[f, most] = bound if (f, most) not in tight else min(bound, tight[f, most]) if most else max(bound, tight[f, most])
    return tuple((f, most, bound) for (f, most), bound in sorted(tight.items()))


def held(rule: tuple[Bound, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, most, bound in rule:
        out &= x[:, f] <= bound if most else x[:, f] > bound
    return out


def grown(x: np.ndarray, y: np.ndarray, n: np.ndarray, seed: int = 3) -> list[tuple[Bound, ...]]:
    """Rules of boosted trees: every node but the roots. Rows count ``n`` times."""
    bounds = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        bounds.append(middle if len(middle) <= BINS else np.unique(np.quantile(middle, np.linspace(0, 1, BINS))))
    code = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], axis=1)
    rng, least = np.random.default_rng(seed), max(3.0, LEAST_SHARE * n.sum())
    margin, rules = np.full(len(x), np.log(((y * n).sum() + 1) / (((1 - y) * n).sum() + 1))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = (y - p) * n, p * (1 - p) * n
        tried = rng.permutation(x.shape[1])[:max(3, 2 * x.shape[1] // 3)]
        # Nodes of a level: rows, and the path to them.
        level = [(np.arange(len(x)), [])]
        for depth in range(DEPTH + 1):
            after = []
            for rows, path in level:
                g, h = gradient[rows], hessian[rows]
                best = (1e-6, None)
                if depth < DEPTH:
                    whole = g.sum() ** 2 / (h.sum() + 1)
                    for f in tried:
                        size = len(bounds[f]) + 1
                        gs, hs, ns = (np.cumsum(np.bincount(code[rows, f], v, size))[:-1] for v in (g, h, n[rows]))
                        gain = gs ** 2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                        gain[(ns < least) | (n[rows].sum() - ns < least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), (int(f), float(bounds[f][gain.argmax()])))
                if best[1] is None:
                    margin[rows] += 0.3 * g.sum() / (h.sum() + 1)
                    continue
                f, bound = best[1]
                below = x[rows, f] <= bound
                for some, most in ((rows[below], True), (rows[~below], False)):
                    after.append((some, [*path, (f, most, bound)]))
                    rules[_merged(after[-1][1])] = True
            level = after
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float, rounds: int = 400) -> np.ndarray:
    """Weights (the first one free) of a logistic model with an L1 penalty, by accelerated proximal steps."""
    share = n / n.sum()
    mean = share @ z
    spread = np.sqrt(np.maximum(share @ (z * z) - mean ** 2, 1e-12))
    a = np.hstack([np.ones((len(z), 1)), (z - mean) / spread])
    # The least step that always falls: a quarter of the largest eigenvalue, by power iteration.
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (share * (a @ v))
        size = float(np.sqrt(v @ v))
        v /= size
    step = 1 / (0.25 * size * 1.05 + 1e-12)
    w = np.zeros(a.shape[1])
    at, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
        new = at - step * (a.T @ (share * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at, moved = new + (before - 1) / t * (new - w), np.abs(new - w).max()
        w = new
        if moved < 1e-5:
            break
    plain = np.r_[w[0], w[1:] / spread]
    plain[0] -= plain[1:] @ mean
    return plain


def weighed(rules: list, x: np.ndarray, y: np.ndarray, n: np.ndarray, part: np.ndarray) -> Model:
    """Rules with their weights; the penalty is the one with the least loss on rows it was not fitted on."""
    z = np.stack([held(r, x) for r in rules], axis=1)
    # Rules that hold for the same rows are one; the shortest stays.
    order = sorted(range(len(rules)), key=lambda r: (len(rules[r]), rules[r]))
    _, first = np.unique(np.packbits(z[:, order], axis=0), axis=1, return_index=True)
    chosen = [order[i] for i in sorted(first)]
    rules, z = [rules[i] for i in chosen], z[:, chosen]
    # Rows alike in all rules, label and part count together.
    keyed = np.concatenate([np.packbits(z, axis=1), y[:, None].astype(np.uint8), part[:, None].astype(np.uint8)], axis=1)
    _, rows, number = np.unique(keyed, axis=0, return_index=True, return_inverse=True)
    n = np.bincount(number.ravel(), n, len(rows))
    z, y, part = z[rows].astype(float), y[rows], part[rows]

    def missed(penalty: float) -> float:
        loss = 0.0
        for out in range(PARTS):
            a, b = part != out, part == out
            if n[a].sum() and n[b].sum():
                w = lasso(z[a], y[a], n[a], penalty)
                margin = w[0] + z[b] @ w[1:]
                loss += float(n[b] @ (np.logaddexp(0, margin) - y[b] * margin))
        return loss

    w = lasso(z, y, n, min(PENALTIES, key=missed), rounds=2000)
    return Model(float(w[0]), tuple((rule, float(v)) for rule, v in zip(rules, w[1:]) if abs(v) > 1e-3))


def sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, label and part of at most ``rows`` labelled training documents; contradicting labels are left out."""
    clean = (labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").filter(fold("doc_id", 4) != 2)
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "quality")
    part = F.pmod(F.xxhash64("text", F.lit(PARTS)), F.lit(PARTS)).cast("int").alias("part")   # copies share a part
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.select(*[c.alias(name) for name, c in statistics(F.col("text")).items()], "quality", part)


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Rules and weights from the statistics of a bounded sample of labelled rows of the training folds."""
    table = sample(documents, labels, rows).groupBy(*NAMES, "quality", "part").agg(F.count("*").alias("n")).toPandas()
    table = table.sort_values([*NAMES, "quality", "part"], ignore_index=True)
    x, y, n = table[list(NAMES)].to_numpy(float), table["quality"].to_numpy(float), table["n"].to_numpy(float)
    if not len(table) or not 0 < y @ n < n.sum():
        return Model(float(np.log((y @ n + 1) / ((1 - y) @ n + 1))), ())
    rules = grown(x, y, n)
    if not rules:
        return Model(float(np.log((y @ n + 1) / ((1 - y) @ n + 1))), ())
    return weighed(rules, x, y, n, table["part"].to_numpy(int))


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with a column ``quality_score`` of 0 to 1.

    Null and empty texts have the statistics of no words. Repeated rows get equal scores; no column but
    ``text`` is looked at. Without labels of both kinds every score is the smoothed share of good rows.
    """
    inside = {name: c.alias(name) for name, c in statistics(F.col("text")).items()}
    rows = documents.withColumn("_stats", F.struct(*inside.values()))
    return rows.withColumn("quality_score", model.column({name: F.col("_stats")[name] for name in NAMES})).drop("_stats")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = scores(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= CLEAN).cast("int").alias("predicted"))
