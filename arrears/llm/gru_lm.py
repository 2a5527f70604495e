"""Language-model scores: a gated recurrent network over word symbols, with a class-factored output.

Counts of all words of all training documents give the base score and the symbols: the most frequent
words have one each, all others share the symbol of their count's power of two, and words seen once
or never share the last. How many words have their own grows with the square root of the different
words (``head_size``). The network predicts the next symbol as class, then symbol within the class, with as
many classes as make a step cheapest; a word within a shared symbol has its share of the symbol's
count. A word that was never seen is spelled: the mass of the unseen times the probability of its bytes under a
letter model of the different words of the corpus. So the score is a probability of the text.

The path: (1) blocks of documents are coded against a dictionary of their own, so that one row per
block and different word is shuffled instead of one per token; (2) counts are summed by word and joined
to the blocks; (3) documents become strings of symbols; (4) the network is trained by truncated
backpropagation, every training document in one of the rounds, tasks averaged after each; (5) every
document is scored, its state carried across windows to its end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.common import fold, stage

BLOCK_CHARS = 10_000_000
HEAD = 200            # words with a symbol of their own, at least
HEAD_GROWTH = 8       # times the square root of the different words
BINS = 44             # shared symbols for counts from 2, by power of two
SYMBOLS = HEAD + BINS + 2   # of the least network; 0: end of a document
HIDDEN = 24
TOGETHER = 1024       # documents that run side by side
WINDOW = 64           # steps of a window when scoring
TRAIN_WINDOW = 24     # steps back that training looks
TRAIN_TOGETHER = 512
LONG = 1024           # steps of a document that training runs in one piece
RATE = 0.01
STRETCH = 65_536      # parameters averaged together
SLICE = 2048          # rows of logits at a time
PIECE = 16_384        # parameters moved at a time
TEXTS = 500           # texts split at a time
EXTREME = 80.0        # logits beyond are shifted before exp
TOKENS_A_WEIGHT = 2.0 # tokens a task trains on for each parameter it sends
LEAST_TOKENS = 200_000
ROUNDS = 3            # each on its own part of the training documents, which together are all of them


_GATES = np.arange(3)[:, None]


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def head_size(different: int) -> int:
    """How many words have a symbol of their own, if the corpus has so many different ones."""
    return max(HEAD, round(HEAD_GROWTH * different ** 0.5))


def code_type(symbols: int) -> np.dtype:
    return np.dtype("<u2" if symbols <= 1 << 16 else "<u4")


@dataclass(frozen=True)
class Counts:
    """What the corpus says: tokens and different tokens, documents, counts of symbols."""
    tokens: int
    different: int
    documents: int
    head: np.ndarray          # counts of the head words
    bin_tokens: np.ndarray    # summed counts of each shared symbol
    bin_mass: np.ndarray      # summed (count + 1) of each shared symbol
    once: int
    twice: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.different + 1.0))

    def symbol_tokens(self) -> np.ndarray:
        return np.r_[self.documents, self.head, self.bin_tokens, self.once].astype(float)

    def codes(self, head: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Symbols of words by their head number (0: none) and count."""
        last = len(self.head) + BINS + 1
        level = np.clip(np.log2(np.maximum(count, 1)).astype(np.int64), 1, BINS)
        return np.where(head > 0, head, np.where(count > 1, len(self.head) + level, last)).astype(code_type(last + 1))

    def within(self, count: np.ndarray) -> np.ndarray:
        """log10 share of a word of that count in its shared symbol; of no count, of all unseen words together."""
        # What was never seen has the weight of what was seen once, as in estimates of unseen mass.
        unseen = (self.once + 1.0) / (self.once + 2.0 * self.twice + 2.0)
        level = np.log2(np.maximum(count, 1)).astype(np.int64)
        shared = (count + 1.0) / np.maximum(self.bin_mass[np.clip(level, 1, BINS) - 1], 1.0)
        rare = np.where(count == 0, unseen, (1 - unseen) / max(self.once, 1))
        return np.log10(np.where(count <= 1, rare, shared))


class Letters:
    """Probability of a word letter by letter: each byte, and the end, after the byte before it.

    Smoothed by how often a byte occurs at all, and that by an equal share, so that every word has some; the
    probabilities of all words add up to one.
    """
    EDGE = 256

    def __init__(self, pairs: np.ndarray):
        pairs = pairs.reshape(257, 257).astype(float)
        alone = pairs.sum(axis=0) + 0.5
        alone[self.EDGE] = max(alone[self.EDGE], 1.0)
        after = pairs + 20.0 * alone / alone.sum()
        self.log = np.log10(after / after.sum(axis=1, keepdims=True))
        # No word is empty: a word does not end before its first byte.
        first = after[self.EDGE].copy()
        first[self.EDGE] = 0.0
        with np.errstate(divide="ignore"):
            self.log[self.EDGE] = np.log10(first / first.sum())

    @classmethod
    def pairs(cls, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, word it is in, number of pairs of each word) of bytes that follow each other."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.full(int(length.sum()) + len(words) + 1, cls.EDGE, np.int64)   # an edge before, between and behind
        inside = np.ones(len(codes), bool)
        inside[np.r_[0, np.cumsum(length + 1)]] = False
        codes[inside] = np.frombuffer(b"".join(words), np.uint8)
        return codes[:-1] * 257 + codes[1:], np.repeat(np.arange(len(words)), length + 1), length + 1

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        pair, word, _ = self.pairs(words)
        return np.bincount(word, self.log.ravel()[pair], len(words))


class Network:
    """Gated recurrent network in float32; parameters live in one flat vector.

    Output weights hold their bias in a last column, for which states carry a one.
    """

    def __init__(self, tokens: np.ndarray, flat: np.ndarray | None = None, seed: int = 5):
        symbols = len(tokens)
        classes = max(1, round(np.sqrt((tokens + 0.5) / (tokens + 0.5).sum()).sum()))
        order = np.argsort(-tokens, kind="stable")
        share = np.cumsum(np.sqrt(tokens[order] + 1.0))
        klass = np.minimum((share / share[-1] * classes).astype(np.int64), classes - 1)
        self.klass, self.place = np.empty(symbols, np.int32), np.empty(symbols, np.int32)
        self.klass[order], self.place[order] = klass, np.arange(symbols)   # classes lie side by side in ws
        self.first = np.searchsorted(klass, np.arange(classes + 1))
        self.shapes = {"x": (symbols, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (classes, HIDDEN + 1), "ws": (symbols, HIDDEN + 1)}
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        fresh = flat is None
        self.flat = (np.random.default_rng(seed).normal(0, 0.1, size) if fresh else flat).astype(np.float32)
        for name, part in self._parts(self.flat).items():
            setattr(self, name, part)
        if fresh:   # start from the counts
            p = (tokens + 0.5) / (tokens + 0.5).sum()
            of_class = np.bincount(self.klass, p, classes)
            self.wc[:, HIDDEN] = np.log(np.maximum(of_class, 1e-12))
            self.ws[self.place, HIDDEN] = np.log(p / of_class[self.klass])

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = flat[at:at + size].reshape(shape)
            at += size
        return out

    def step(self, h, x, u=None):
        """The next states, and what a step back needs. Each gate lies in one piece; ``u`` is ``gates()``, if at hand."""
        g = self.x.reshape(-1, HIDDEN).take(_GATES + 3 * x, axis=0)
        u = np.matmul(h, self.gates() if u is None else u)
        zr, n, un = g[:2], g[2], u[2]
        zr += u[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr
        n += r * un
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, un

    def gates(self) -> np.ndarray:
        """The weights of the state, one matrix a gate."""
        return np.ascontiguousarray(self.u.reshape(HIDDEN, 3, HIDDEN).swapaxes(0, 1))

    def _calm(self) -> bool:
        """Whether no logit can be extreme: a state has no entry beyond one, so its length is at most the root of their number."""
        return max(float(np.einsum("ij,ij->i", w, w).max()) for w in (self.wc, self.ws)) * (HIDDEN + 1) < EXTREME ** 2

    def _by_class(self, klass):
        """Order of targets by class, and (class, from, to) in it of each class of several symbols that occurs."""
        order = np.argsort(klass.astype(np.uint16) if len(self.wc) <= 1 << 16 else klass, kind="stable")
        bounds = np.searchsorted(klass[order], np.arange(len(self.first)))
        several = np.diff(self.first) > 1
        return order, [(c, bounds[c], bounds[c + 1]) for c in np.flatnonzero((np.diff(bounds) > 0) & several)]

    def log_prob(self, h, target):
        """Natural log probability of each target after the states ``h``, with or without their column of ones."""
        if h.shape[1] == HIDDEN:
            h = np.hstack([h, np.ones((len(h), 1), np.float32)])
        klass, place, out, calm = self.klass[target], self.place[target], np.empty(len(h)), self._calm()
        for lo in range(0, len(h), SLICE):
            some = slice(lo, lo + SLICE)
            out[some] = _log_share(h[some] @ self.wc.T, klass[some], calm)
        order, groups = self._by_class(klass)
        ranked, place, inside = h.take(order, axis=0), place[order], np.zeros(len(h))
        for c, lo, hi in groups:
            for at in range(lo, hi, SLICE):
                some = slice(at, min(at + SLICE, hi))
                inside[some] = _log_share(ranked[some] @ self.ws[self.first[c]:self.first[c + 1]].T, place[some] - self.first[c], calm)
        out[order] += inside
        return out

    def scores(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document of symbols; the last one is its end."""
        out = np.zeros(len(documents))
        order = np.argsort([-len(d) for d in documents], kind="stable")
        for lo in range(0, len(order), TOGETHER):
            group = order[lo:lo + TOGETHER]
            flat, start, length = _flat([documents[i] for i in group])
            h, u = np.zeros((len(group), HIDDEN), np.float32), self.gates()
            total, x = np.zeros(len(group)), flat[start]
            for at in range(0, int(length[0]), WINDOW):
                running = _running(length, at, WINDOW)
                states, targets = np.ones((sum(running), HIDDEN + 1), np.float32), np.empty(sum(running), np.int64)
                end = 0
                for t, n in enumerate(running, at):   # documents longer than t come first
                    h = self.step(h[:n], x[:n], u)[0]
                    x = flat[start[:n] + (t + 1)]
                    states[end:end + n, :HIDDEN], targets[end:end + n] = h, x
                    end += n
                owners = np.concatenate([np.arange(n) for n in running])
                total += np.bincount(owners, self.log_prob(states, targets), len(group))
            out[group] = total
        return out

    def train(self, documents: list[np.ndarray], rate: float = RATE, together: int = TRAIN_TOGETHER) -> None:
        """One pass of truncated backpropagation with Adam."""
        m, v, count = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        rows = self.x.size
        m_x, v_x = m[:rows].reshape(self.x.shape), v[:rows].reshape(self.x.shape)

        def moved(flat, m, v, gradient, some):
            """Adam on some of the entries; ``some`` is an index of the first axis."""
            first, second = (m[some], v[some]) if isinstance(some, slice) else (m.take(some, axis=0), v.take(some, axis=0))
            first = first * np.float32(0.9)
            first += np.float32(0.1) * gradient
            second = second * np.float32(0.99)
            np.multiply(gradient, gradient, out=gradient)
            gradient *= np.float32(0.01)
            second += gradient
            m[some], v[some] = first, second
            second *= np.float32(1 / (1 - 0.99 ** count))
            np.sqrt(second, out=second)
            second += np.float32(1e-8)
            first /= second
            first *= np.float32(rate / (1 - 0.9 ** count))
            flat[some] -= first

        # Long documents train in stretches, each behind the symbol before it, so that few run on alone.
        parts = [(0 if lo == 0 else d[lo - 1], d[lo:lo + LONG]) for d in documents for lo in range(0, len(d), LONG)]
        order = np.argsort([-len(d) for _, d in parts], kind="stable")
        groups = [order[lo:lo + together] for lo in range(0, len(order), together)]
        for group in groups:
            flat, start, length = _flat([parts[i][1] for i in group], [parts[i][0] for i in group])
            h = np.zeros((len(group), HIDDEN), np.float32)
            for at in range(0, int(length[0]), TRAIN_WINDOW):
                seen, of_x, of_rest, h = self._window(h, flat, start, length, at)
                scale = np.float32(min(1.0, 1.0 / (float(np.sqrt((of_x * of_x).sum() + of_rest @ of_rest)) + 1e-9)))
                of_x *= scale
                of_rest *= scale
                count += 1
                # Rows of symbols that the window lacks rest, so a step does not grow with the symbols' number of inputs.
                for lo in range(0, len(seen), PIECE // (3 * HIDDEN)):
                    some = slice(lo, lo + PIECE // (3 * HIDDEN))
                    moved(self.x, m_x, v_x, of_x[some], seen[some])
                for lo in range(rows, len(self.flat), PIECE):
                    moved(self.flat, m, v, of_rest[lo - rows:lo - rows + PIECE], slice(lo, lo + PIECE))

    def gradient(self, h, flat, start, length, at):
        """Gradient of the mean loss of a window for all parameters, and the last state."""
        seen, of_x, of_rest, last = self._window(h, flat, start, length, at)
        every = np.zeros_like(self.flat)
        every[:self.x.size].reshape(self.x.shape)[seen] = of_x
        every[self.x.size:] = of_rest
        return every, last

    def _window(self, h, flat, start, length, at):
        """Gradient of the mean loss of a window: symbols read and the rows of ``x`` for them, the other parameters; the last state."""
        running = _running(length, at, TRAIN_WINDOW)
        total = sum(running)
        bounds = np.r_[0, np.cumsum(running)]
        x, goal, before = np.empty(total, np.int64), np.empty(total, np.int64), np.empty((total, HIDDEN), np.float32)
        every, steps, u, read = np.ones((total, HIDDEN + 1), np.float32), [], self.gates(), flat[start[:running[0]] + at]
        for t, n in enumerate(running):
            some = slice(bounds[t], bounds[t + 1])
            x[some], before[some] = read[:n], h[:n]
            h, *kept = self.step(h[:n], read[:n], u)
            steps.append(kept)
            goal[some] = read = flat[start[:n] + (at + t + 1)]
            every[some, :HIDDEN] = h
        grad = np.zeros(self.flat.size - self.x.size, np.float32)
        g, begins = {}, 0
        for name in ("u", "wc", "ws"):
            size = int(np.prod(self.shapes[name]))
            g[name] = grad[begins:begins + size].reshape(self.shapes[name])
            begins += size
        klass, place, calm = self.klass[goal], self.place[goal], self._calm()
        dh = np.empty((total, HIDDEN), np.float32)
        for lo in range(0, total, SLICE):
            some = slice(lo, lo + SLICE)
            d = _softmax(every[some] @ self.wc.T, calm)
            d.ravel()[np.arange(len(d)) * d.shape[1] + klass[some]] -= 1
            g["wc"] += d.T @ every[some]
            np.matmul(d, self.wc[:, :HIDDEN], out=dh[some])
        order, groups = self._by_class(klass)
        ranked, inside = every.take(order, axis=0), np.zeros((total, HIDDEN), np.float32)
        ranks, told = np.arange(total), klass[order]
        row = ranks - np.searchsorted(told, told)     # in its group, whose logits lie in one piece
        chosen = row * np.diff(self.first)[told] + place[order] - self.first[told]
        for k, lo, hi in groups:
            m, states = slice(self.first[k], self.first[k + 1]), ranked[lo:hi]
            e = _softmax(states @ self.ws[m].T, calm)
            e.ravel()[chosen[lo:hi]] -= 1
            np.matmul(e.T, states, out=g["ws"][m])
            np.matmul(e, self.ws[m, :HIDDEN], out=inside[lo:hi])
        back = np.empty(total, np.int64)
        back[order] = ranks
        dh += inside.take(back, axis=0)
        dh *= np.float32(1 / total)
        g["wc"] *= np.float32(1 / total)
        g["ws"] *= np.float32(1 / total)
        into, by_state = np.empty((3, total, HIDDEN), np.float32), np.empty((total, HIDDEN), np.float32)
        carried, back = np.zeros((0, HIDDEN), np.float32), np.ascontiguousarray(u.swapaxes(1, 2))
        for t in range(len(running) - 1, -1, -1):
            some = slice(bounds[t], bounds[t + 1])
            (z, r, c, un), d, (dz, dr, dn) = steps[t], dh[some], into[:, some]
            d[:len(carried)] += carried
            dzh = d * z
            np.subtract(d, dzh, out=dn)     # d (1 - z)
            np.subtract(before[some], c, out=dz)
            dz *= z
            dz *= dn
            c *= c
            np.subtract(1, c, out=c)
            dn *= c
            np.multiply(dn, r, out=by_state[some])
            np.subtract(1, r, out=r)
            r *= un
            np.multiply(by_state[some], r, out=dr)
            carried = dz @ back[0]
            carried += dr @ back[1]
            carried += by_state[some] @ back[2]
            carried += dzh
        for k, part in enumerate((into[0], into[1], by_state)):
            np.matmul(before.T, part, out=g["u"][:, k * HIDDEN:(k + 1) * HIDDEN])
        order = np.argsort(x.astype(np.uint16) if len(self.x) <= 1 << 16 else x, kind="stable")
        seen, starts = np.unique(x[order], return_index=True)
        by_symbol = into.reshape(-1, HIDDEN).take(order[:, None] + total * _GATES.T, axis=0).reshape(total, 3 * HIDDEN)
        return seen, _sums(by_symbol, starts), grad, h


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows from each start to the next one: the first rows of all, the second ones, and so on."""
    count = np.diff(np.r_[starts, len(rows)])
    order = np.argsort(-count, kind="stable")
    count, starts = count[order], starts[order]
    out, at = rows.take(starts, axis=0), 1
    while (n := int(np.searchsorted(-count, -at, "left"))) >= 64:
        out[:n] += rows.take(starts[:n] + at, axis=0)
        at += 1
    for i in range(n):    # few are left, with many rows each
        out[i] += rows[starts[i] + at:starts[i] + count[i]].sum(axis=0)
    back = np.empty_like(out)
    back[order] = out
    return back


def _running(length: np.ndarray, at: int, steps: int) -> list[int]:
    """How many documents (longest first) have a symbol to tell at each step from ``at`` on."""
    return [int(np.searchsorted(-length, -t, "left")) for t in range(at, min(at + steps, int(length[0])))]


def _exp(logits, calm):
    """exp in place and its row sums; rows are shifted by their greatest only where that is needed, which a ``calm`` network never does."""
    if not calm and logits.size and (logits.max() > EXTREME or logits.min() < -EXTREME):
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32)


def _softmax(logits, calm=False):
    total = _exp(logits, calm)
    logits *= (1 / total)[:, None]
    return logits


def _log_share(logits, at, calm=False):
    """Natural log of the softmax at one place of each row."""
    chosen = logits[np.arange(len(logits)), at]
    if not calm and logits.size and (logits.max() > EXTREME or logits.min() < -EXTREME):
        chosen = chosen - logits.max(axis=1)
    return chosen - np.log(_exp(logits, calm))


def _flat(documents: list[np.ndarray], before=0):
    """Documents in one array, each behind the symbol before it (an end): array, starts, lengths."""
    length = np.array([len(d) for d in documents])
    start = np.r_[0, np.cumsum(length + 1)[:-1]]
    flat = np.zeros(int(length.sum()) + len(documents), np.int64)
    flat[start] = before
    for s, d in zip(start, documents):
        flat[s + 1:s + 1 + len(d)] = d
    return flat, start, length


def code_blocks(documents: DataFrame) -> DataFrame:
    """Rows of two kinds: documents coded by their block's dictionary, and its words with counts."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("ids", pa.binary()), ("idx", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def coded(batches):
        part, number, held, chars = TaskContext.get().partitionId(), 0, [], 0

        def rows(size, **columns):
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        def flush():
            block = part << 24 | number
            doc_id, train = pa.concat_arrays([d for d, _, _, _ in held]), pa.concat_arrays([t for _, t, _, _ in held])
            index = pa.concat_arrays([w for _, _, w, _ in held]).dictionary_encode()
            ids, words = index.indices.to_numpy(), index.dictionary.cast(pa.binary())
            lengths = np.concatenate([n for _, _, _, n in held])
            ends, known = np.cumsum(lengths), train.to_numpy(zero_copy_only=False)
            yield rows(len(train), block=pa.repeat(pa.scalar(block, pa.int64()), len(train)), doc_id=doc_id, train=train,
                       ids=pa.array([squeeze(ids[e - n:e]) for e, n in zip(ends, lengths)], pa.binary()), n=pa.array(np.zeros(len(train), np.int64)))
            counts = np.bincount(ids[np.repeat(known, lengths)], minlength=len(words))
            for lo in range(0, len(words), 50_000):
                n = min(50_000, len(words) - lo)
                yield rows(n, block=pa.repeat(pa.scalar(block, pa.int64()), n), train=pa.repeat(pa.scalar(False), n),
                           idx=pa.array(np.arange(lo, lo + n)), word=words[lo:lo + n], n=pa.array(counts[lo:lo + n]))

        for batch in batches:
            size, at = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy().astype(np.int64), 0
            while at < len(size):
                upto = at + int(np.searchsorted(chars + np.cumsum(size[at:]), BLOCK_CHARS)) + 1   # with the row that fills the block
                some = batch.slice(at, upto - at)
                for lo in range(0, some.num_rows, TEXTS):
                    few = some.slice(lo, TEXTS)
                    # Copies: a column that is kept would keep its whole batch.
                    held.append((*(pc.take(few[c], np.arange(few.num_rows)) for c in ("doc_id", "train")), *split(few["text"])))
                chars += int(size[at:upto].sum())
                at = upto
                if chars >= BLOCK_CHARS:
                    yield from flush()
                    number, held, chars = number + 1, [], 0
                    pa.default_memory_pool().release_unused()
            batch = some = few = None
        if held:
            yield from flush()
        held = []
        pa.default_memory_pool().release_unused()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 7) != 2).alias("train"), "text")
    return rows.mapInArrow(coded, "block long, doc_id long, train boolean, ids binary, idx long, word binary, n long")


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts as ``words_of`` has them, one after another, and how many each text has."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(plain)
    empty, lengths, words = pc.equal(plain, ""), pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()
    if pc.any(empty).as_py():
        words, lengths = words.filter(pc.not_equal(words, "")), np.where(empty.to_numpy(zero_copy_only=False), 0, lengths)
    return words, lengths


def count(coded: DataFrame) -> tuple[DataFrame, Counts, Letters]:
    """Corpus count and own symbol of each word of each block, what the counts add up to, and the letters of words.

    A word has a row per block, so the rows of a common word grow with the blocks, not with its uses, and no word has more
    rows than there are blocks. They meet once: each takes the word's sum along and one of them stands for the word.
    """
    words = coded.filter("word is not null").select("block", "idx", "word", "n")
    of_word = Window.partitionBy("word").orderBy("block", "idx")
    whole = of_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = stage(words.select("block", "idx", "word", F.sum("n").over(whole).alias("c"), (F.row_number().over(of_word) == 1).alias("first")))
    distinct = met.filter("first and c > 0").select("word", "c")
    size = head_size(distinct.count())
    head = distinct.filter("c > 1").orderBy(F.desc("c"), "word").limit(size).select("word", "c").collect()
    session = coded.sparkSession
    numbers = session.createDataFrame([(bytes(r.word), i) for i, r in enumerate(head, 1)], "word binary, head int")
    marked = met.join(F.broadcast(numbers), "word", "left")
    level = F.least(F.lit(BINS), F.floor(F.log2(F.col("c").cast("double"))).cast("int"))
    bins = {r.level: r for r in marked.filter("first and c > 0").groupBy(F.when(F.col("head").isNull(), level).alias("level")).agg(
        F.sum("c").alias("tokens"), F.sum(F.col("c") + 1).alias("mass"), F.count("*").alias("different")).collect()}
    twice = distinct.filter("c = 2").count()
    docs = coded.filter("word is null and train").count()

    def of(field):
        return np.array([getattr(bins[i], field) if i in bins else 0 for i in range(1, BINS + 1)], float)

    tokens = sum(r.tokens for r in bins.values()) + docs
    different = sum(r.different for r in bins.values()) + (docs > 0)
    found = Counts(tokens, different, docs, np.array([r.c for r in head], float), of("tokens"), of("mass"),
                   bins[0].tokens if 0 in bins else 0, twice)
    # Only words that will be spelled travel on with their letters.
    counted = marked.select("block", "idx", "c", F.coalesce("head", F.lit(0)).alias("head"), F.when(F.col("c") == 0, F.col("word")).alias("word"))
    return counted, found, letters(distinct)


def letters(words: DataFrame) -> Letters:
    """The letter model of the different words; the driver sees one number per pair of bytes."""
    def counted(batches):
        total = np.zeros(257 * 257, np.int64)
        for frame in batches:
            total += np.bincount(Letters.pairs(frame["word"].tolist())[0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})

    pairs = np.zeros(257 * 257)
    for r in words.select("word").mapInPandas(counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    return Letters(pairs)


def symbols(coded: DataFrame, counted: DataFrame, found: Counts, spell: Letters) -> DataFrame:
    """One row per document: its figures and its string of symbols."""
    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, within double, codes binary"

    def told(docs, words):
        size = int(words["idx"].max()) + 1 if len(words) else 0
        c, head = np.zeros(size, np.int64), np.zeros(size, np.int64)
        c[words["idx"]], head[words["idx"]] = words["c"], words["head"]
        code = found.codes(head, c)
        base, within = found.base(c), np.where(head > 0, 0.0, found.within(c))
        new = words[words["word"].notna()]
        if len(new):
            within[new["idx"]] += spell(new["word"].tolist())
        end_base = float(found.base(np.array([found.documents]))[0])
        rows = []
        for doc, train, ids in zip(docs["doc_id"].astype("Int64"), docs["train"], docs["ids"]):
            i = unsqueeze(ids)
            rows.append((doc, train, len(i) + 1, int((c[i] > 0).sum()) + (found.documents > 0), float(base[i].sum()) + end_base,
                         float(within[i].sum()), np.append(code[i], code.dtype.type(0)).tobytes()))
        out = pd.DataFrame(rows, columns=["doc_id", "train", "n_tokens", "n_known", "base_score", "within", "codes"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    documents = coded.filter("word is null").select("block", "doc_id", "train", "ids")
    return documents.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(told, schema)


def rows_of_round(coded: DataFrame, number: int, rounds: int = ROUNDS) -> DataFrame:
    """Training documents of a round: each document, by a hash of its id, has exactly one round."""
    return coded.filter(F.col("train") & (F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == number))


def learn(coded: DataFrame, found: Counts, rounds: int = ROUNDS, tokens_a_weight: float = TOKENS_A_WEIGHT) -> np.ndarray:
    """Weights after some rounds: every task trains on its rows, tasks are averaged by their tokens.

    A task ships its parameters, so it is given ``tokens_a_weight`` tokens for each of them: tasks grow with the corpus, and what
    they send stays below what they read. The average is taken by stretches of parameters, in two steps, so that no group
    holds more than the square root of the tasks; the driver sees one value per parameter.
    """
    tokens = found.symbol_tokens()
    kind, flat = code_type(len(tokens)), Network(tokens).flat
    tasks = max(1, round(found.tokens / rounds / max(LEAST_TOKENS, tokens_a_weight * len(flat))))
    groups = max(1, round(tasks ** 0.5))
    schema = "at int, part int, value binary, weight double"
    for number in range(rounds):
        start = flat.copy()

        def trained(batches):
            network, weight = Network(tokens, start.copy()), 0
            for frame in batches:
                some = [np.frombuffer(c, kind).astype(np.int64) for c in frame["codes"]]
                if some:
                    network.train(some)
                    weight += sum(map(len, some))
            if weight:
                part = TaskContext.get().partitionId() % groups
                for lo in range(0, len(start), STRETCH):
                    yield pd.DataFrame({"at": lo, "part": part, "value": [network.flat[lo:lo + STRETCH].tobytes()], "weight": float(weight)})

        def averaged(frame):
            total = sum(np.frombuffer(v, np.float32).astype(float) * w for v, w in zip(frame["value"], frame["weight"]))
            weight = float(frame["weight"].sum())
            return pd.DataFrame({"at": [frame["at"].iloc[0]], "part": 0, "value": [(total / weight).astype(np.float32).tobytes()], "weight": weight})

        means = rows_of_round(coded, number, rounds).select("codes").coalesce(tasks).mapInPandas(trained, schema)
        for keys in (["at", "part"], ["at"]) if groups > 1 else (["at"],):
            means = means.groupBy(*keys).applyInPandas(averaged, schema)
        flat = start.copy()
        for r in means.select("at", "value").collect():
            part = np.frombuffer(r.value, np.float32)
            flat[r.at:r.at + len(part)] = part
    return flat


def report(documents: DataFrame) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one end token. Repeated rows are counted and scored each. A null doc_id
    is in the fold of the empty text. Other columns are not looked at. An empty table gives no rows;
    without training rows nothing is known and the network stays as it starts.
    """
    blocks = stage(code_blocks(documents))
    counted, found, spell = count(blocks)
    coded = stage(symbols(blocks, counted, found, spell))
    flat, tokens = learn(coded, found), found.symbol_tokens()
    kind = code_type(len(tokens))

    def scored(batches):
        network = Network(tokens, flat)
        for frame in batches:
            logs = network.scores([np.frombuffer(c, kind).astype(np.int64) for c in frame["codes"]])
            yield frame.drop(columns=["codes", "within", "train"]).assign(score=logs / np.log(10) + frame["within"], held_out=~frame["train"].astype(bool))

    out = coded.mapInPandas(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double, held_out boolean")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(found.tokens).cast("long").alias("train_tokens"), "base_score", "score")
