"""Language identification by unigrams summed over all segmentations.

Pieces come from a fixed public vocabulary. Each language has a probability of every piece; the
probability of a word is the sum over all ways to cut it into pieces, found by a forward pass over
the word's lattice for all languages at once. The probabilities are learned by expectation over
the same lattices: every training word spreads its count over the pieces of all its segmentations.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import fold
from arrears.llm.lattice import SPACE, VOCABULARY, Lattices, pieces

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN_SHARE = 1e-5   # weight of a letter that no piece covers
SMOOTHING = 500.0      # pieces' worth of prior in a language
FLUSH_WORDS = 60_000   # distinct words of one expectation step
KEPT_WORDS = 300_000   # words whose probabilities a task remembers
SLICE_CHARS = 1_000_000


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return WORD.findall(text.lower()) if text else []


def marked(words: list[str]) -> list[str]:
    """Words as the vocabulary writes them, with the space before."""
    return [SPACE + w for w in words]


def prior(size: int) -> np.ndarray:
    """Common start: the vocabulary is in order of merging, so use falls with the id. Last: unknown."""
    weight = 1.0 / (np.arange(size) + 100.0)
    return np.r_[weight / weight.sum(), UNKNOWN_SHARE]


def expected(found: dict[str, int], weight: np.ndarray, path: str = VOCABULARY) -> np.ndarray:
    """Expected count of each piece (unknown last) over all segmentations of the counted words."""
    out = np.zeros(len(weight))
    lattices = Lattices(marked(list(found)), path)
    if not len(lattices):
        return out
    count = np.fromiter(found.values(), float)[lattices.word]
    np.add.at(out, lattices.piece, lattices.shares(weight[lattices.piece]) * count)   # -1 is the last
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray       # languages x (pieces + 1)
    log_prior: np.ndarray
    path: str = VOCABULARY


def learn(documents: DataFrame, rounds: int = 2, path: str = VOCABULARY) -> Model:
    """Piece probabilities of each language of the rows (text, lang) given.

    The driver sees one number per language and piece of the vocabulary.
    """
    size = len(pieces(path)[1])
    rows = documents.filter("text is not null and lang is not null").select("text", "lang")
    shares = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(shares))
    current = {lang: prior(size) for lang in languages}
    for _ in range(rounds):
        weights = dict(current)

        def step(batches):
            totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size + 1))
            seen: dict[str, Counter] = defaultdict(Counter)

            def flush(lang):
                totals[lang] += expected(seen.pop(lang), weights[lang], path)

            for frame in batches:
                for lang, text in zip(frame["lang"], frame["text"]):
                    seen[lang].update(words(text))
                    if len(seen[lang]) > FLUSH_WORDS:
                        flush(lang)
            for lang in list(seen):
                flush(lang)
            for lang, counts in totals.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "piece": at, "n": counts[at]})

        found = rows.mapInPandas(step, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        base = prior(size)
        for lang in languages:
            mine = found[found["lang"] == lang].sort_values("piece")
            counts = SMOOTHING * base
            counts[mine["piece"].to_numpy()] += mine["n"].to_numpy()
            current[lang] = counts / counts.sum()
    log_prior = np.log(np.array([shares[lang] for lang in languages], float) / max(1, sum(shares.values())))
    return Model(languages, np.array([current[lang] for lang in languages]).reshape(len(languages), size + 1), log_prior, path)


class Scorer:
    """Log probability of texts in every language; remembers a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.row, self.logs = model, {}, np.zeros((0, len(model.languages)))
        self.weights = np.ascontiguousarray(model.weights.T)

    def _learn(self, new: list[str]) -> None:
        if len(self.row) + len(new) > KEPT_WORDS:
            self.row, self.logs = {}, np.zeros((0, len(self.model.languages)))
        found = [self.logs]
        for lo in range(0, len(new), FLUSH_WORDS // 2):
            some = new[lo:lo + FLUSH_WORDS // 2]
            lattices = Lattices(marked(some), self.model.path)
            found.append(lattices.log_totals(self.weights[lattices.piece]))
            for w in some:
                self.row[w] = len(self.row)
        self.logs = np.concatenate(found)

    def __call__(self, texts) -> np.ndarray:
        out, lo, texts = [], 0, list(texts)
        while lo < len(texts):
            hi, chars, found = lo, 0, []
            while hi < len(texts) and chars < SLICE_CHARS:
                found.append(words(texts[hi]))
                chars += len(texts[hi] or "")
                hi += 1
            every = set().union(*found)
            new = [w for w in every if w not in self.row]
            if new:
                self._learn(new if len(self.row) + len(new) <= KEPT_WORDS else list(every))
            for ws in found:
                out.append(self.logs[np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws))].sum(axis=0))
            lo = hi
        return np.array(out).reshape(len(texts), len(self.model.languages))


def predictions(documents: DataFrame, model: Model) -> DataFrame:
    """The documents (doc_id, text) with ``lang_pred`` and ``score``, the share of the best language.

    Null and empty texts and texts without a letter are ``und`` with score 0, as is every text when
    nothing could be learned. Ties go to the language first in order. Repeated rows get equal results;
    other columns are not looked at. Every text is read whole.
    """
    def predicted(batches):
        scorer = Scorer(model)
        for frame in batches:
            lang, score = ["und"] * len(frame), np.zeros(len(frame))
            texts = list(frame["text"])
            if model.languages:
                for i, row in enumerate(scorer(texts)):
                    if texts[i] and any(map(str.isalpha, texts[i])):
                        logs = row + model.log_prior
                        best = int(logs.argmax())
                        lang[i], score[i] = model.languages[best], 1 / np.exp(logs - logs[best]).sum()
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "lang_pred": lang, "score": score})

    return documents.select("doc_id", "text").mapInPandas(predicted, "doc_id long, lang_pred string, score double")


def report(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the other folds."""
    model = learn(documents.filter(fold("doc_id", 3) != 1), path=path)
    return predictions(documents, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
