"""Segmentation lattices of words over the pieces of a public vocabulary, for many words at once.

Words of up to ``SHORT`` letters are summed together, as plain products; longer ones letter by letter as logarithms, so
that a word may have any length and no sum runs out of small numbers.
"""

from __future__ import annotations

import functools
import re

import numpy as np

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SHORT = 32     # letters of a word whose products stay within a float


@functools.lru_cache(maxsize=2)
def pieces(path: str = VOCABULARY) -> tuple[dict[str, int], list[str]]:
    """Piece to id, and id to piece; control pieces and byte pieces have ids but no text."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    known = {t: i for i, t in enumerate(texts)
             if t and not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return known, texts


@functools.lru_cache(maxsize=2)
def spans_words(path: str = VOCABULARY) -> bool:
    """Whether some piece goes on over a space mark after a letter, so that texts cannot be cut there."""
    return any(re.search(f"[^{SPACE}]{SPACE}", t) for t in pieces(path)[0])


@functools.lru_cache(maxsize=2)
def byte_ids(path: str = VOCABULARY) -> np.ndarray:
    """Id of the piece of each byte."""
    texts = pieces(path)[1]
    found = {t: i for i, t in enumerate(texts)}
    return np.array([found[f"<0x{b:02X}>"] for b in range(256)])


class Trie:
    """The pieces as a trie whose steps are looked up for many letters at once.

    Steps lie in an open hash table: key ``state << 21 | letter``, probed onwards until found or empty.
    """

    def __init__(self, known: dict[str, int]):
        steps, ends = {}, [-1]
        for text, piece in known.items():
            state = 0
            for letter in text:
                key = state << 21 | ord(letter)
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                state = steps[key]
            ends[state] = piece
        self.ends = np.array(ends, dtype=np.int64)
        self.mask = (1 << (len(steps) * 4).bit_length()) - 1
        self.keys, self.next = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int64)
        for key, state in steps.items():
            at = int(self._hash(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.next[at] = key, state

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        keys = states << 21 | letters
        at = self._hash(keys)
        found = self.keys[at]
        while True:
            again = np.flatnonzero((found != keys) & (found >= 0))
            if not len(again):
                return np.where(found == keys, self.next[at], -1)
            at[again] = (at[again] + 1) & self.mask
            found[again] = self.keys[at[again]]


@functools.lru_cache(maxsize=2)
def trie(path: str = VOCABULARY) -> Trie:
    return Trie(pieces(path)[0])


class Lattices:
    """Arcs of the lattices of some words.

    Node of letter p of word w is ``offset[w] + p``; a letter that no piece covers alone gets an arc of
    its own with id -1, which stands for its bytes.
    """

    def __init__(self, words: list[str], path: str = VOCABULARY):
        walk = trie(path)
        self.length = np.fromiter(map(len, words), np.int32, len(words))
        self.offset = np.r_[0, np.cumsum(self.length + 1, dtype=np.int64)].astype(np.int32)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), self.length)
        self.first = (np.cumsum(self.length, dtype=np.int64) - self.length).astype(np.int32)   # first letter of each word
        left = self.length[word] - (np.arange(len(letters), dtype=np.int32) - self.first[word])
        at, state, arcs, size = np.arange(len(letters), dtype=np.int32), np.zeros(len(letters), np.int64), [], 0
        while len(at):
            size += 1
            state = walk.step(state, letters[at + size - 1])
            piece = walk.ends[state]
            whole = (state >= 0) & (piece >= 0)
            if size == 1:
                arcs.append((at, np.where(whole, piece, -1).astype(np.int32)))
            else:
                arcs.append((at[whole], piece[whole].astype(np.int32)))
            go_on = (state >= 0) & (left[at] > size)
            at, state = at[go_on], state[go_on]
        start = np.concatenate([a for a, _ in arcs]) if arcs else np.zeros(0, np.int32)
        self.piece = np.concatenate([p for _, p in arcs]) if arcs else np.zeros(0, np.int32)
        self.word = word[start]
        self.source = start + self.word    # every word before has one node more than letters
        self.target = self.source + np.repeat(np.arange(1, len(arcs) + 1, dtype=np.int32), [len(a) for a, _ in arcs])
        self.widest = size
        self.long = np.flatnonzero(self.length > SHORT)

    def __len__(self):
        return len(self.length)

    @functools.cached_property
    def _groups(self):
        """Arcs of short words by start and length, and the bounds of the groups: none meets a node twice."""
        start = self.source - self.offset[self.word]
        group = start * np.int32(self.widest) + (self.target - self.source - 1)
        if not len(self.long):
            order = np.argsort(group.astype(np.uint16), kind="stable").astype(np.int32)
        else:
            some = np.flatnonzero(self.length[self.word] <= SHORT)
            order = some[np.argsort(group[some].astype(np.uint16), kind="stable")].astype(np.int32)
            group = group[some]
        bounds = np.r_[0, np.cumsum(np.bincount(group, minlength=1))]
        return order, bounds, np.flatnonzero(np.diff(bounds))

    def _spread(self, weight, source, target, seeds, descending=False):
        """Sums over the arcs of short words; nodes of others hold one."""
        order, bounds, filled = self._groups
        models = weight.shape[1]
        if models == 1:    # plain numbers are added up faster than rows of one
            weight = weight[:, 0]
        sums = np.zeros((int(self.offset[-1]), *weight.shape[1:]))
        sums[seeds] = 1.0
        for w in self.long:
            sums[self.offset[w]:self.offset[w + 1]] = 1.0
        source, target, weight = source[order], target[order], weight[order]
        for g in filled[::-1] if descending else filled:
            lo, hi = bounds[g], bounds[g + 1]
            sums[target[lo:hi]] += sums[source[lo:hi]] * weight[lo:hi]
        return sums.reshape(-1, models)

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Summed weight of the ways from the first letter to each node; ``weight``: arcs x models."""
        return self._spread(weight, self.source, self.target, self.offset[:-1])

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """Summed weight of the ways from each node to the last letter."""
        return self._spread(weight, self.target, self.source, self.offset[1:] - 1, descending=True)

    def _long_arcs(self):
        """(word, its arcs by source, where those of each letter begin) of the long words."""
        if len(self.long):
            mine = np.flatnonzero(self.length[self.word] > SHORT)
            mine = mine[np.argsort(self.source[mine], kind="stable")]
            word = self.word[mine]
            for w in self.long:
                arcs = mine[np.searchsorted(word, w):np.searchsorted(word, w, "right")]
                yield w, arcs, np.searchsorted(self.source[arcs], self.offset[w] + np.arange(self.length[w] + 1))

    def _log_backward(self, w, arcs, first, log):
        """Logarithms of the backward sums of a long word; ``log``: its arcs x models."""
        out = np.zeros((self.length[w] + 1, log.shape[1]))
        target = self.target[arcs] - self.offset[w]
        for p in range(self.length[w] - 1, -1, -1):
            some = slice(first[p], first[p + 1])
            out[p] = np.logaddexp.reduce(log[some] + out[target[some]], axis=0)
        return out

    def _log_forward(self, w, arcs, first, log):
        out = np.full((self.length[w] + 1, log.shape[1]), -np.inf)
        out[0] = 0.0
        target = self.target[arcs] - self.offset[w]
        for p in range(self.length[w]):
            some = slice(first[p], first[p + 1])
            out[target[some]] = np.logaddexp(out[target[some]], out[p] + log[some])   # targets of a letter differ
        return out

    def chances(self, weight: np.ndarray) -> np.ndarray:
        """The chance of each arc given its node, when segmentations weigh what their arcs do."""
        beta = self.backward(weight[:, None])[:, 0]
        out = weight * beta[self.target] / beta[self.source]
        for w, arcs, first in self._long_arcs():
            log = np.log(weight[arcs])
            rest = self._log_backward(w, arcs, first, log[:, None])[:, 0]
            out[arcs] = np.exp(log + rest[self.target[arcs] - self.offset[w]] - rest[self.source[arcs] - self.offset[w]])
        return out

    def shares(self, weight: np.ndarray) -> np.ndarray:
        """The chance of each arc to be in the segmentation of its word."""
        alpha, beta = self.forward(weight[:, None])[:, 0], self.backward(weight[:, None])[:, 0]
        out = alpha[self.source] * weight * beta[self.target] / beta[self.offset[:-1]][self.word]
        for w, arcs, first in self._long_arcs():
            log = np.log(weight[arcs])[:, None]
            ahead, rest = self._log_forward(w, arcs, first, log), self._log_backward(w, arcs, first, log)
            out[arcs] = np.exp(ahead[self.source[arcs] - self.offset[w]] + log + rest[self.target[arcs] - self.offset[w]] - rest[0])[:, 0]
        return out

    def log_totals(self, weight: np.ndarray) -> np.ndarray:
        """Logarithm of the summed weight of all segmentations of each word; ``weight``: arcs x models."""
        out = np.log(self.forward(weight)[self.offset[1:] - 1])
        for w, arcs, first in self._long_arcs():
            out[w] = self._log_backward(w, arcs, first, np.log(weight[arcs]))[0]
        return out
