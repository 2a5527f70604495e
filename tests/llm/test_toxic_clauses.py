"""op3: the composed grammar against the definition of its marks by distances."""

import math
import random

import numpy as np

from arrears.llm import toxicity as t


def told(symbols):
    """Weights by kind, each mark found by looking back from its word."""
    out = np.zeros(len(t.FEATURES))
    quoted = [symbols[:i].count("Q") % 2 == 1 for i in range(len(symbols))]
    under, opened = [], -9     # a negation within two words of an open one closes it
    for i, s in enumerate(symbols):
        under.append(i - opened <= 2)
        if s == "N":
            opened = -9 if under[i] else i
    for i, s in enumerate(symbols):
        if s not in "IT":
            continue
        reported = quoted[i] or any(symbols[k] == "R" and not quoted[k] and "Q" not in symbols[k:i] for k in range(max(0, i - 6), i))
        aimed = "Y" in symbols[max(0, i - 4):i]
        threat = 4 * (s == "T")
        if reported:
            out[3 + threat] += 0.4 if threat else 0.6
        elif under[i]:
            out[2 + threat] += 0.2 if threat else 0.6
        else:
            out[threat + aimed] += (0.7 if threat else 1.0) * (1.5 if aimed else 1.0)
    return out


def test_marks():
    words = {"I": "idiot", "T": "kill", "Y": "you", "N": "not", "R": "said", "O": "stone"}
    rng, lexicon = random.Random(9), t.Lexicon(frozenset())
    for _ in range(3000):
        clauses, text, want = [], [], np.zeros(len(t.FEATURES))
        for _ in range(rng.randrange(1, 4)):
            symbols, said = "", []
            for _ in range(rng.randrange(1, 12)):
                s = rng.choice("IITTYNNROOOQ")
                if s == "Q":    # an opening quote before a word, a closing one behind it
                    s = rng.choice("ITO")
                    before = rng.random() < 0.5
                    symbols += "Q" + s if before else s + "Q"
                    said.append(f'"{words[s]}' if before else f'{words[s]}"')
                else:
                    symbols += s
                    said.append(words[s])
            said[-1] += "."
            if said[-1].endswith('".'):    # the point is not the last mark of a quote that ends
                symbols = None
            clauses.append(symbols)
            text.append(" ".join(said))
        if None in clauses:
            continue
        for c in clauses:
            want += told(c)
        assert np.allclose(t.matches(" ".join(text), lexicon), want), (clauses, text)


def test_score_is_the_logistic_of_the_matches(spark):
    model = t.Model(frozenset({"vequ"}), np.array([-3.0, 6.0, 7.0, 3.0, 3.0, 5.0, 7.0, 1.0, 2.0]))
    texts = ["you idiot", "a vequaro in the river", "she said idiot", None, "", "not idiot. kill you you kill"]
    marks = ["YI", "OIOOO", "YRI", "", "", None]
    got = [r.toxicity for r in t.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for text, symbols, score in zip(texts, marks, got):
        parts = ["NI", "TYYT"] if symbols is None else [symbols]
        z = model.weights[0] + model.weights[1:] @ np.log1p(sum(told(p) for p in parts))
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9, text
