"""What the grammar's scores have to say, whatever the labelled rows were."""

import numpy as np
import pytest

from chronofold.llm import toxicity
from chronofold.llm.common import table

INSULT = "idiot"
LEXICON = toxicity.Lexicon({INSULT: toxicity.STRONGEST, "moron": toxicity.STRONGEST})


def score(text, weights, lexicon=LEXICON):
    return float(toxicity._scores(toxicity.Grammar(lexicon), [text], weights)[0])


def rows_of(seed, share):
    """Labelled rows that say the opposite of the grammar as often as not: negated insults in toxic texts, targets in clean ones."""
    r = np.random.default_rng(seed)
    texts = ["you are an idiot.", "not an idiot.", "she said you are an idiot.", "I saw an idiot.", "I will kill you.", "I never kill you.", "an idiot. a moron.", "fine words"]
    reader = toxicity.Grammar(LEXICON)
    picked = [" ".join(r.choice(texts, r.integers(1, 4))) for _ in range(300)]
    labels = np.array([float(("not" in t or "said" in t) if r.random() < share else r.random() < 0.5) for t in picked])
    return np.array([reader.features(t) for t in picked]), labels


@pytest.mark.parametrize(("seed", "share"), [(0, 0.0), (1, 0.5), (2, 1.0), (3, 0.9)])
def test_no_sign_turns_whatever_the_rows_say(seed, share):
    weights = toxicity.fit(*rows_of(seed, share))
    assert (weights >= toxicity.LOW).all() and (weights <= toxicity.HIGH).all()
    plain, negated, reported = (score(t, weights) for t in ("you are an idiot.", "you are not an idiot.", "she said you are an idiot."))
    assert negated < plain and reported < plain
    assert score("I will kill you.", weights) > score("I will never kill you.", weights)
    assert score("I saw an idiot. I saw a moron.", weights) > score("I saw an idiot.", weights) >= score("I saw a day.", weights)


def test_projected_steps_end_at_the_bounded_least_loss():
    x, y = rows_of(5, 0.7)
    found = toxicity.fit(x, y)

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + ((w - toxicity.PRIOR) ** 2).sum() / 2

    r = np.random.default_rng(1)
    for _ in range(2000):
        near = np.clip(found + r.normal(scale=r.choice([1e-3, 1e-1, 1.0]), size=len(found)), toxicity.LOW, toxicity.HIGH)
        assert loss(near) >= loss(found) - 1e-9


def both(weights, lexicon):
    at = lambda text: score(text, weights, lexicon)
    assert at("you are not an idiot.") < 0.5 <= at("you are an idiot.")
    assert at("she said you are an idiot.") < 0.5
    assert at("I saw an idiot.") < 0.5 <= at("I saw an idiot. They saw a moron.")
    assert at("I will kill you.") >= 0.5 > at("I will never kill you.")
    assert max(map(at, ("", "they kill it", "kill the process", "he said I will kill you", "a fine day for all of you"))) < 0.5


def test_scores_by_the_grammars_own_weights():
    both(toxicity.PRIOR, LEXICON)


def test_scores_by_learned_weights(spark):
    """Learned from labelled rows of a table: clauses, not words, decide, and held-out rows are told apart."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    lexicon, weights = toxicity.learn(docs, labels)
    both(weights, lexicon)
    held = toxicity.score(docs, labels).join(labels.groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic"), "doc_id").where("held_out").collect()
    assert not [r for r in held if r["predicted"] and not r["toxic"]]
    assert sum(r["predicted"] for r in held) >= 0.8 * sum(r["toxic"] for r in held) > 0
