"""Personal data: weak labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates are found by patterns wider than the base rules. Labelers of three sorts - patterns and
checksums, gazetteers of neighbouring words, and shape of the context - each say yes, no or nothing.
The pattern of votes of every candidate of the corpus is counted (at most a few thousand patterns),
expectation-maximisation over these counts estimates how reliable each labeler is and what each
pattern means, and a logistic classifier is trained on the outcome. It adds spans to the base ones.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")
DIGIT = re.compile("[0-9]")
# Wider forms, all linear: spelled-out addresses, and national numbers without a plus sign.
SPELLED = re.compile(r"\b[A-Za-z0-9_]{1,64}(?:[.%+-][A-Za-z0-9_]{1,64}){0,4} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}"
                     r"(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-][0-9]{2,4}){2,5}(?![0-9])")
BEFORE = {"email": ("mail", "contact", "write", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "adresse"),
          "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "mobile", "fax", "telefon")}
AGAINST = ("version", "v", "isbn", "issn", "token", "key", "hash", "id", "ref", "order", "page", "vol", "no", "nr")
NEAR = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def low_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _quads(text):
    """Leftmost runs of four dotted numbers, with whether all are at most 255."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at, i = run.group().split("."), run.start(), 0
        starts = []
        for part in parts:
            starts.append(at)
            at += len(part) + 1
        while i + 3 < len(parts):
            gap = next((k for k in range(i + 3, i - 1, -1) if not parts[k]), None)
            if gap is not None:
                i = gap + 1
                continue
            yield starts[i], starts[i + 3] + len(parts[i + 3]), all(map(low_part, parts[i:i + 4]))
            i += 4


def _matches(text):
    """(kind, start, end, holds): every match of a base pattern, and whether it meets its rule."""
    for start, end in _emails(text):
        yield 0, start, end, True
    if DIGIT.search(text):
        for start, end, holds in _quads(text):
            yield 1, start, end, holds
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            yield 2, m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
        if "+" in text:
            for m in PHONE.finditer(text):
                yield 3, m.start(), m.end(), 9 <= sum(c.isdigit() for c in m.group()) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base matches, by start, then kind."""
    return sorted((s, e, k) for k, s, e, holds in _matches(text) if holds) if text and ANY.search(text) else []


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes and not no else -1 if no and not yes else 0


def _votes(text, kind, start, end, holds, base) -> tuple[int, ...]:
    name, body = KINDS[kind], text[start:end]
    digits = [c for c in body if c.isdigit()]
    left, right = text[max(0, start - 24):start], text[end:end + 1]
    near = [w.lower() for w in NEAR.findall(left)][-3:]
    touching = (left[-1:].isalnum() or left[-1:] in ("_", "=", "#")) or right.isalnum() or right == "_"
    flat = kind and len(set(digits)) <= 2
    grouped = re.search(r"[0-9]{3,4}[ .-][0-9]{4}$|@[a-z0-9.-]+\.[a-z]{2,6}$", body) is not None
    fits = ((4 <= len(body) <= 254), holds, 12 <= len(digits) <= 19, 8 <= len(digits) <= 15)[kind]
    return (_vote(base, kind in (1, 2) and not holds),                        # pattern and checksum
            _vote(any(w.startswith(BEFORE[name]) for w in near), False),      # gazetteer, for
            _vote(False, any(w in AGAINST for w in near)),                    # gazetteer, against
            _vote(not touching, touching),                                   # context edges
            _vote(fits, not fits),                                           # length and range
            _vote(grouped, bool(flat)))                                      # shape


def candidates(text: str | None) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """(start, end, kind, base, votes) of every candidate; others than base never overlap base ones."""
    if not text or not ANY.search(text):
        return []
    found = list(_matches(text))
    base = sorted((s, e, k) for k, s, e, holds in found if holds)
    out = [(s, e, k, True, _votes(text, k, s, e, True, True)) for s, e, k in base]
    wide = [(s, e, k, holds) for k, s, e, holds in found if not holds and (k != 2 or e - s >= 12)]
    wide += [(m.start(), m.end(), 0, True) for m in SPELLED.finditer(text)] if "[" in text or "(" in text else []
    wide += [(m.start(), m.end(), 3, True) for m in NATIONAL.finditer(text)]
    taken, i = [], 0
    ends = 0
    for s, e, k, holds in sorted(wide):
        while i < len(base) and base[i][1] <= s:
            i += 1
        if s < ends or any(b[0] < e and s < b[1] for b in base[max(0, i - 8):i + 8]):
            continue
        ends = e
        taken.append((s, e, k, False, _votes(text, k, s, e, holds, False)))
    return sorted(out + taken)


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier: for each kind a bias and one weight per labeler and answer."""
    weights: np.ndarray
    reliability: np.ndarray

    def score(self, kind: int, votes: tuple[int, ...]) -> float:
        x = self.weights[kind]
        return 1 / (1 + np.exp(-(x[0] + sum(x[1 + 2 * i + (v < 0)] for i, v in enumerate(votes) if v))))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50):
    """Posterior of "yes" for each pattern of votes, and per labeler P(answer | truth) (2 x 3)."""
    n, labelers = votes.shape
    tables = np.tile(np.array([[[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]]), (labelers, 1, 1))  # [labeler, truth no/yes, -1/0/+1]
    prior = 0.5
    post = np.full(n, 0.5)
    for _ in range(rounds):
        logs = [np.log(p) + sum(np.log(tables[i, y][votes[:, i] + 1]) for i in range(labelers)) for y, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        # The first labeler's answers are no opinions: a base match holds, a failed checksum does not.
        post = np.where(votes[:, 0] > 0, 1.0, np.where(votes[:, 0] < 0, 0.0, post))
        prior = float(np.clip((post @ counts + 1) / (counts.sum() + 2), 0.01, 0.99))
        for i in range(labelers):
            for y, weight in ((0, (1 - post) * counts), (1, post * counts)):
                # The pseudo counts keep a labeler better than chance where the data is silent.
                seen = np.bincount(votes[:, i] + 1, weight, 3) + np.array([[6, 3, 1], [1, 3, 6]])[y]
                tables[i, y] = seen / seen.sum()
    return post, tables


def train(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 300) -> Model:
    """Classifier from (kind, votes, count): reliabilities per kind, then logistic regression."""
    labelers = len(_votes("0", 1, 0, 1, False, False))
    weights, reliability = np.zeros((len(KINDS), 1 + 2 * labelers)), np.zeros((len(KINDS), labelers, 2, 3))
    for kind in range(len(KINDS)):
        rows = [(v, c) for k, v, c in patterns if k == kind]
        votes = np.array([v for v, _ in rows], dtype=int).reshape(len(rows), labelers)
        counts = np.array([c for _, c in rows], dtype=float)
        post, reliability[kind] = expectation_maximisation(votes, counts) if rows else (np.zeros(0), 1 / 3)
        x = np.hstack([np.ones((len(rows), 1)), np.stack([votes > 0, votes < 0], axis=2).reshape(len(rows), -1)]) if rows else np.zeros((0, weights.shape[1]))
        mass = counts / max(counts.sum(), 1)
        w = np.zeros(x.shape[1])
        w[0], w[2] = -1.0, -4.0   # without examples a failed checksum still says no
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 2.0 * (x.T @ (mass * (p - post)) + 0.0005 * np.r_[0, w[1:]])
        weights[kind] = w
    return Model(weights, reliability)


def fit(documents: DataFrame) -> Model:
    """Count the vote patterns of all candidates of all texts, then train on the counts."""
    def counted(batches):
        for frame in batches:
            seen: dict = {}
            for text in frame["text"]:
                for _, _, kind, _, votes in candidates(text):
                    seen[kind, votes] = seen.get((kind, votes), 0) + 1
            yield pd.DataFrame([(k, ",".join(map(str, v)), n) for (k, v), n in seen.items()], columns=["kind", "votes", "n"])

    table = (documents.select("text").mapInPandas(counted, "kind int, votes string, n long")
             .groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect())
    return train(sorted((r.kind, tuple(map(int, r.votes.split(","))), r.n) for r in table))


def spans_of(text: str | None, model: Model) -> tuple[list, list]:
    """Base spans and all spans, both by start, then kind."""
    found = candidates(text)
    base = [(s, e, k) for s, e, k, is_base, _ in found if is_base]
    more = [(s, e, k) for s, e, k, is_base, votes in found if not is_base and model.score(k, votes) >= 0.5]
    return sorted(base, key=lambda x: (x[0], x[2])), sorted(base + more, key=lambda x: (x[0], x[2]))


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def report(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans.

    Null and empty texts have no spans. Repeated rows give repeated results, a null doc_id stays
    null. Other columns are not looked at. An empty table gives no rows. Every text is read whole;
    the patterns are linear in its length.
    """
    model = model or fit(documents)

    def found(batches):
        for frame in batches:
            rows = []
            for text in frame["text"]:
                base, every = spans_of(text, model)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(i) for i in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    return documents.select("doc_id", "text").mapInPandas(
        found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None, model: Model) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans by one."""
    spans = spans_of(text, model)[1]
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with personal data replaced; all rows and columns stay, null texts too."""
    model = model or fit(documents)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, model))

    return documents.withColumn("text", cleaned("text"))
