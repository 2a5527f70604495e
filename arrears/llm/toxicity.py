"""Toxicity: a weighted finite-state grammar over clauses.

Words become symbols - insult, threat, target, negation, report, quote, other. Small deterministic
transducers are composed: the first marks what stands in reported speech, the second what stands
under a negation, the third spells matched clauses and their weights. A document is scored by the
clauses that match, not by words alone. The insult lexicon consists of stems learned from labelled
training rows beside a few fixed ones; a logistic layer turns clause weights into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import fold, stage

INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "trash", "disgusting", "clown")
THREATS = ("kill", "murder", "hurt", "destroy", "burn", "shoot", "stab", "beat", "töten", "tuer", "matar")
TARGETS = ("you", "your", "he", "she", "they", "him", "her", "them", "du", "dich", "ihr", "sie", "tu", "te", "toi", "vous", "usted", "él", "ella")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "sin")
REPORTS = ("said", "says", "called", "calls", "claimed", "wrote", "quoted", "sagte", "dit", "dijo")
SYMBOLS = "ITYNRQO"  # insult, threat, target, negation, report, quote, other
ENDS = ".!?;:\n"
STRIP = re.compile(r"^[\W_]+|[\W_]+$")
LINE = re.compile(r"[^\S\n]+|(\n)")
FEATURES = ("insult", "insult at target", "negated insult", "reported insult", "threat", "threat at target", "negated threat", "reported threat")
SAMPLE_ROWS = 20_000   # labelled rows a classifier is fitted on, the first by a hash of the id
STEM = (4, 8)          # letters of a learned stem
CONTEXTS = (3, 6)      # least different words before a learned stem and
BOUNDS = (2.0, 3.0, 4.0, 5.0)    # least log odds in toxic rows, of which cross-validation takes a pair
CHOICES = [(contexts, bound) for contexts in CONTEXTS for bound in BOUNDS]
PARTS = 3              # of the training rows, by a hash of the text, for it


@dataclass
class Transducer:
    """Deterministic: arcs[state, symbol] = (state, output, weight); a missing arc copies its symbol."""
    start: int = 0
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The transducer that does both in turn; only reachable pairs of states are built."""
    names, todo, out = {(first.start, second.start): 0}, [(first.start, second.start)], Transducer()
    while todo:
        pair = todo.pop()
        for symbol in alphabet:
            a, between, w1 = first.step(pair[0], symbol)
            b, output, w2 = second.step(pair[1], between)
            if (a, b) not in names:
                names[a, b] = len(names)
                todo.append((a, b))
            out.arcs[names[pair], symbol] = (names[a, b], output, w1 + w2)
    return out


def reporting(reach: int = 6) -> Transducer:
    """Marks insults and threats within quotes, or up to ``reach`` words after a verb of saying."""
    t = Transducer()
    inside = reach + 1
    for state in range(inside + 1):
        quoted = state == inside
        after = inside if quoted else max(0, state - 1)
        for symbol in SYMBOLS:
            marked = {"I": "i", "T": "t"}.get(symbol, symbol) if state else symbol
            t.arcs[state, symbol] = (after, marked, 0.0)
        t.arcs[state, "R"] = (inside if quoted else reach, "O", 0.0)
        t.arcs[state, "Q"] = (0 if quoted else inside, "O", 0.0)
    return t


def negation(reach: int = 2) -> Transducer:
    """Marks insults and threats up to ``reach`` words after a negation; two negations cancel."""
    t = Transducer()
    for state in range(reach + 1):
        for symbol in "ITitYO":
            marked = {"I": "j", "T": "u"}.get(symbol, symbol) if state else symbol
            t.arcs[state, symbol] = (max(0, state - 1), marked, 0.0)
        t.arcs[state, "N"] = (0 if state else reach, "O", 0.0)
    return t


def clauses(reach: int = 4) -> Transducer:
    """Spells matches: a digit of ``FEATURES`` with its weight; a target within reach strengthens."""
    t = Transducer()
    for state in range(reach + 1):
        near = state > 0
        t.arcs[state, "Y"] = (reach, "", 0.0)
        t.arcs[state, "O"] = (max(0, state - 1), "", 0.0)
        for symbol, plain, aimed, weight in (("I", 0, 1, 1.0), ("j", 2, 2, 0.6), ("i", 3, 3, 0.6), ("T", 4, 5, 0.7), ("u", 6, 6, 0.2), ("t", 7, 7, 0.4)):
            t.arcs[state, symbol] = (max(0, state - 1), str(aimed if near else plain), weight * (1.5 if near and symbol in "IT" else 1.0))
    return t


GRAMMAR = compose(compose(reporting(), negation(), SYMBOLS), clauses(), SYMBOLS)


class Lexicon(dict):
    """Symbols of a raw word, kept in a bounded table: letters of ``SYMBOLS``, a dot closes a clause."""
    LIMIT = 150_000

    def __init__(self, stems: frozenset):
        super().__init__()
        self.stems = stems
        self.fixed = {**dict.fromkeys(THREATS, "T"), **dict.fromkeys(TARGETS, "Y"), **dict.fromkeys(NEGATIONS, "N"),
                      **dict.fromkeys(REPORTS, "R"), **dict.fromkeys(INSULTS, "I")}

    def __missing__(self, raw: str) -> str:
        word = STRIP.sub("", raw)
        symbol = self.fixed.get(word) or ("I" if word and any(word[:n] in self.stems for n in range(STEM[0], STEM[1] + 1)) else "O")
        quotes = sum(c in '"“”„«»' for c in raw) % 2
        out = ("Q" if quotes and not raw[-1:] in '"”“»' else "") + symbol + ("Q" if quotes and raw[-1:] in '"”“»' else "")
        out += "." if raw[-1:] in ENDS else ""
        if len(self) >= self.LIMIT:
            self.clear()
        self[raw] = out
        return out


def matches(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Summed weights of the matched clauses of each kind."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    for line in text.lower().split("\n"):
        coded = "".join(map(lexicon.__getitem__, line.split()))
        if "I" not in coded and "T" not in coded:
            continue
        for clause in coded.split("."):
            if "I" in clause or "T" in clause:
                state = GRAMMAR.start
                for symbol in clause:
                    state, kind, weight = GRAMMAR.arcs[state, symbol]
                    if kind:
                        out[int(kind)] += weight
    return out


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    return np.log1p(matches(text, lexicon))


@dataclass(frozen=True)
class Model:
    stems: frozenset
    weights: np.ndarray


def sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled training documents; contradicting labels are left out."""
    clean = (labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(fold("doc_id", 5) != 0)
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "toxic")
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def stems_of(text: str) -> dict[str, int]:
    """Stems of the words of a text, each with a bit set of the words that stood before it."""
    found, before = {}, ""
    for raw in text.lower().split():
        found[raw] = found.get(raw, 0) | 1 << zlib.crc32(before.encode("utf-8", "surrogatepass")) % 62
        before = raw
    out: dict[str, int] = {}
    for raw, bits in found.items():
        word = STRIP.sub("", raw)
        for n in range(STEM[0], min(STEM[1], len(word)) + 1):
            out[word[:n]] = out.get(word[:n], 0) | bits
    return out


def chosen_stems(found: dict[str, tuple[int, float, int]], contexts: int, bound: float) -> frozenset:
    """Stems of (toxic rows, log odds, words before) with at least so many words and such odds: of nested stems that
    explain the same toxic rows the longest, and none that has another one before it."""
    stems = {s: t for s, (t, odds, before) in found.items() if before >= contexts and odds >= bound}
    for stem in list(stems):
        for n in range(STEM[0], len(stem)):
            if stems.get(stem[:n]) == found[stem][0]:
                del stems[stem[:n]]
    return frozenset(s for s in stems if not any(s[:n] in stems for n in range(STEM[0], len(s))))


def learned_stems(rows: DataFrame) -> frozenset:
    """Stems that stand far more often in toxic rows than in others.

    Copies of one toxic text share all their rare words; a stem must follow several different words,
    which no number of copies brings about. Clean rows that hold a stem, negated or reported, lower its
    smoothed odds but do not veto it. How many words and which odds are the least is the pair with the fewest errors
    of the grammar on parts of the rows that the stems were not taken from.
    """
    def counted(batches):
        for frame in batches:
            for part, some in frame.groupby("part"):
                seen, bits = (Counter(), Counter()), {}
                for text, toxic in zip(some["text"], some["toxic"]):
                    found = stems_of(text or "")
                    seen[int(toxic)].update(found.keys())
                    if toxic:
                        for stem, mask in found.items():
                            bits[stem] = bits.get(stem, 0) | mask
                every = list(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"part": part, "stem": every, "t": [seen[1][s] for s in every], "c": [seen[0][s] for s in every],
                                    "before": [bits.get(s, 0) for s in every]}).astype({"part": int, "t": int, "c": int, "before": int})

    rows = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int"))
    counts = stage(rows.mapInPandas(counted, "part int, stem string, t long, c long, before long"))
    totals = {(r.part, r.toxic): r["count"] for r in rows.groupBy("part", "toxic").count().collect()}

    def found(without: int | None) -> dict[str, tuple[int, float, int]]:
        toxic, clean = (sum(n for (part, kind), n in totals.items() if kind == k and part != without) for k in (1, 0))
        odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
        some = counts if without is None else counts.filter(F.col("part") != without)
        # Of a bounded sample, these are few.
        return {r.stem: (r.t, r.odds, r.contexts) for r in some.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.expr("bit_count(bit_or(before))").alias("contexts"))
                .filter(F.col("contexts") >= min(CONTEXTS)).withColumn("odds", odds).filter(F.col("odds") >= min(BOUNDS)).select("stem", "t", "odds", "contexts").collect()}

    tried = []
    for part in range(PARTS):
        others = found(part)
        tried.append([chosen_stems(others, *choice) for choice in CHOICES])

    def judged(batches):
        lexicons = [[Lexicon(stems) for stems in some] for some in tried]
        for frame in batches:
            wrong = np.zeros(len(CHOICES), np.int64)
            for text, toxic, part in zip(frame["text"], frame["toxic"], frame["part"]):
                wrong += [bool(matches(text, lexicon)[:2].sum() > 0) != bool(toxic) for lexicon in lexicons[part]]
            yield pd.DataFrame({"choice": range(len(CHOICES)), "wrong": wrong})

    wrong = {r.choice: r.wrong for r in rows.mapInPandas(judged, "choice int, wrong long").groupBy("choice").agg(F.sum("wrong").alias("wrong")).collect()}
    # Of equals the strictest.
    return chosen_stems(found(None), *CHOICES[min(range(len(CHOICES)), key=lambda c: (wrong.get(c, 0), -c))])


def fit(documents: DataFrame, labels: DataFrame, rounds: int = 60) -> Model:
    """Stems and weights from a bounded sample of labelled rows of the training folds."""
    rows = stage(sample(documents, labels))
    stems = learned_stems(rows)
    names = [f"f{i}" for i in range(len(FEATURES))]

    def scored(batches):
        lexicon = Lexicon(stems)
        for frame in batches:
            x = np.array([features(t, lexicon) for t in frame["text"]]).reshape(len(frame), len(FEATURES)).round(3)
            yield pd.DataFrame(x, columns=names).assign(toxic=frame["toxic"].to_numpy(), n=1).groupby([*names, "toxic"], as_index=False)["n"].sum()

    schema = ", ".join(f"{n} double" for n in names) + ", toxic int, n long"
    table = rows.mapInPandas(scored, schema).groupBy(*names, "toxic").agg(F.sum("n").alias("n")).orderBy(*names, "toxic").toPandas()
    x = np.hstack([np.ones((len(table), 1)), table[names].to_numpy(float).reshape(len(table), len(names))])
    y, n = table["toxic"].to_numpy(float), table["n"].to_numpy(float)
    # The prior pulls towards the grammar's own weights, so that an unlabelled corpus is scored by them.
    prior = np.array([-3.0, 6.0, 7.0, 3.0, 3.0, 5.0, 7.0, 1.0, 2.0])
    w = prior.copy()

    def loss(w):
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z)) + 0.25 * float((w - prior) @ (w - prior))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + 0.5 * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), gradient)
        # Where the classes part cleanly a whole step can overshoot: halve it until the loss falls.
        size = next((s for s in 0.5 ** np.arange(30) if loss(w - s * step) < loss(w)), 0.0)
        w = w - size * step
        if size == 0 or np.abs(gradient).max() < 1e-6:
            break
    return Model(stems, np.r_[w[0], np.maximum(w[1:], 0)])  # a match never lowers a score


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with a column ``toxicity`` of 0 to 1.

    Null and empty texts match nothing and get the score of a text without matches. Repeated rows
    get equal scores; no column but ``text`` is looked at.
    """
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.stems)   # of this task, gone with it
        for texts in batches:
            z = [model.weights[0] + float(model.weights[1:] @ features(t, lexicon)) for t in texts]
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], dtype=float)

    return documents.withColumn("toxicity", scored("text"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = scores(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
