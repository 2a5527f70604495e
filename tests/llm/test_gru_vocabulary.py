"""op8: the words with a symbol of their own grow with the corpus."""

import numpy as np

from arrears.llm import gru_lm


def test_words_with_a_symbol_grow_with_the_different_words(documents):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 20, 2000, 20))) for i in range(400)]
    coded = gru_lm.code_blocks(documents(rows))
    counted, found, spell = gru_lm.count(coded)
    assert len(found.head) == gru_lm.head_size(2000) == 358 > gru_lm.HEAD
    symbols = len(found.symbol_tokens())
    kind = gru_lm.code_type(symbols)
    seen = set()
    for r in gru_lm.symbols(coded, counted, found, spell).collect():
        codes = np.frombuffer(r.codes, kind)
        assert codes[-1] == 0 and codes.max() < symbols and len(codes) == r.n_tokens
        seen |= set(codes.tolist())
    assert len(seen & set(range(1, 359))) == 358
    assert gru_lm.code_type(1 << 16).itemsize == 2 and gru_lm.code_type((1 << 16) + 1).itemsize == 4


def test_a_large_network_has_proper_probabilities():
    tokens = 1e6 / np.arange(1, 5001)
    net = gru_lm.Network(tokens)
    h = np.random.default_rng(1).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    assert abs(np.exp(net.log_prob(np.repeat(h, 5000, 0), np.arange(5000))).sum() - 1) < 1e-3
    assert net.flat.size == sum(int(np.prod(s)) for s in net.shapes.values())
    # As many classes as make a step cheapest: about as many as the symbols of a class that a token meets.
    share, size = tokens / tokens.sum(), np.diff(net.first)[net.klass]
    assert 0.5 < (share * size).sum() / len(net.wc) < 2


def test_letters_are_a_distribution_over_words():
    spell = gru_lm.Letters(np.bincount(gru_lm.Letters.pairs([b"ab", b"abb", b"b", "ä".encode()])[0], minlength=257 * 257))
    # Of all words of one and two bytes, and the mass of longer ones by their first two bytes.
    import itertools
    every = [bytes(w) for n in (1, 2) for w in itertools.product(range(256), repeat=n)]
    log = spell(every)
    edge = spell.log[:256, 256]
    longer = sum(10 ** (log[256 + i] - edge[w[1]]) * (1 - 10 ** edge[w[1]]) for i, w in enumerate(every[256:]))
    assert abs((10 ** log).sum() + longer - 1) < 1e-9
    assert spell([b"ab"])[0] > spell([b"ba"])[0] > spell([b"zq"])[0] and spell([]).shape == (0,)


def test_unseen_words_are_spelled(documents):
    """Invented words score below the same text shuffled, and that below the text; shares of a symbol add up to at most one."""
    import random
    rng = random.Random(6)
    stock = ["stone", "river", "cloud", "apple", "north"]
    def text():
        words, at = [], rng.randrange(5)
        for _ in range(40):
            words.append(stock[at])
            at = (at + (1 if rng.random() < 0.9 else 2)) % 5
        return words
    rows = [(i, " ".join(text()) + f" once{i}") for i in range(700)]
    held = [i for i in range(2000, 2400) if gru_lm.fold.__name__ and __import__("zlib").crc32(str(i).encode()) % 7 == 2][:30]
    real = [text() for _ in held[:10]]
    cases = [" ".join(w) for w in real] + [" ".join(rng.sample(w, len(w))) for w in real]
    cases += [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=len(x))) for x in w) for w in real]
    got = {r.doc_id: r.score for r in gru_lm.report(documents(rows + list(zip(held, cases)))).collect()}
    plain, mixed, junk = (sum(got[held[k + i]] for i in range(10)) / 10 for k in (0, 10, 20))
    assert plain > mixed > junk and all(got[held[20 + i]] < min(got[held[i]], got[held[10 + i]]) for i in range(10))
