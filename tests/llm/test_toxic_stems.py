"""op3: learned stems that clean texts negate or report are kept."""

import random

from arrears.llm import toxicity


def test_a_stem_in_few_clean_rows_is_kept(spark):
    rng = random.Random(3)
    plain = lambda n: " ".join(rng.choice("stone river cloud light north apple table green".split()) + str(rng.randrange(40)) for _ in range(n))
    rows = [(f"{plain(12)} vequ{rng.choice(['aro', 'ilo'])} {plain(4)}", 1) for _ in range(60)]
    rows += [(f"{plain(12)} not vequaro {plain(4)}", 0) for _ in range(6)] + [(plain(17), 0) for _ in range(400)]
    stems = toxicity.learned_stems(spark.createDataFrame(rows, "text string, toxic int"))
    lexicon = toxicity.Lexicon(stems)
    assert all(toxicity.matches(text, lexicon)[:2].sum() > 0 for text, toxic in rows if toxic)
    assert not any(toxicity.matches(text, lexicon)[:2].sum() > 0 for text, toxic in rows if not toxic)


def test_longest_of_stems_that_explain_the_same_rows():
    found = {"achk": (21, 4.0, 9), "achke": (21, 4.5, 9), "achkeite": (21, 5.0, 9), "vequ": (60, 5.0, 9), "vequa": (30, 5.0, 9),
             "vequi": (30, 5.0, 9), "ston": (9, 2.5, 9), "bloo": (9, 5.0, 4)}
    assert toxicity.chosen_stems(found, 6, 3.0) == {"achkeite", "vequ"}
    assert toxicity.chosen_stems(found, 6, 2.0) == {"achkeite", "vequ", "ston"}
    assert toxicity.chosen_stems(found, 3, 3.0) == {"achkeite", "vequ", "bloo"}
