"""The noisy-or fit and score against plain Python."""

import math

import numpy as np
import pytest

pytest.importorskip("passagework.llm")

from passagework.llm import toxicity_mil as T  # noqa: E402


def plain_score(model, text):
    """Noisy-or of a text's sentences, each with its distinct words and their beginnings."""
    clean = 1.0
    for sentence in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        words = {"".join(c.lower()[0] for c in w) for w in sentence.split() if w.isalpha()}
        if words:
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in T.word_features(w))
            clean *= 1 / (1 + math.exp(z))
    return 1 - clean


def test_scores_against_plain_python():
    rng = np.random.default_rng(1)
    vocabulary = ["scum", "Moron", "fine", "ΛΟΓΟΣ", "İstanbul", "straße", "a", "moronic"]
    model = T.ToxicityModel(-6.0, {"scum": 5.0, "moro-": 3.0, "λογοσ": 4.0, "istanbul": 2.0, "straß-": 1.5, "a": -1.0}, 0.2)
    for _ in range(100):
        text = " ".join(str(rng.choice(vocabulary)) + str(rng.choice(["", ".", "!", "?\n", "\n"])) for _ in range(rng.integers(0, 30)))
        assert T.score_text(model, text, 0.5)[0] == pytest.approx(plain_score(model, text), abs=1e-12)


def test_tiny_chances_add_up():
    model = T.ToxicityModel(-22.0, {}, 0.1)
    assert T.score_text(model, "word. " * 100_000, 0.5)[0] == pytest.approx(1e5 * math.exp(-22), rel=1e-3)
    assert str(T.score_text(model, None, 0.5)[0]) == str(T.score_text(model, "...", 0.5)[0]) == "0.0"


def test_words_are_the_same_in_training_and_scoring(spark):
    rows = [(i, f"ΛΟΓΟΣ number {i} here" if i % 2 else f"ΕΡΓΟΝ number {i} here") for i in range(40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = T.train_toxicity(docs, labels, held_out=-1)
    assert T.score_text(model, "ΛΟΓΟΣ", 0.5)[0] > 0.5 > T.score_text(model, "ΕΡΓΟΝ", 0.5)[0]


def likelihood(w, bags, labels, penalty):
    """Of the bags' labels, each class weighing the same; a bag is a list of sentences, a sentence a list of features."""
    total = -penalty / 2 * sum(x * x for x in w[:-1])
    for sentences, label in zip(bags, labels):
        clean = 1.0
        for features in sentences:
            clean *= 1 / (1 + math.exp(w[-1] + sum(w[f] for f in features)))
        total += 0.5 / labels.count(label) * math.log(1 - clean if label else clean)
    return total


def test_fit_is_where_the_likelihood_is_flat():
    rng = np.random.default_rng(4)
    n_features, bags, labels = 4, [], []
    for i in range(60):
        bags.append([[f for f in range(n_features) if rng.random() < 0.3] for _ in range(rng.integers(1, 4))])
        # features 0 and 1 mark toxic sentences, though not always
        labels.append(int(rng.random() < (0.85 if any(0 in s or 1 in s for s in bags[-1]) else 0.15)))
    doc, sentence, feature, bare = [], [], [], np.zeros(len(bags))
    for i, sentences in enumerate(bags):
        for features in sentences:
            if features:
                sentence += [len(doc)] * len(features)
                feature += features
                doc.append(i)
            else:
                bare[i] += 1
    penalty = 1e-2
    bias, weights = T.fit_noisy_or(np.array(doc), np.array(sentence), np.array(feature), np.ones(len(feature)), bare, np.array(labels), n_features, steps=4000, rate=0.02, penalty=penalty)
    w = [*weights, bias]
    best = likelihood(w, bags, labels, penalty)
    for k in range(len(w)):
        for step in (-0.05, 0.05):
            moved = list(w)
            moved[k] += step
            assert likelihood(moved, bags, labels, penalty) < best
    assert min(weights[0], weights[1]) > max(weights[2], weights[3])
