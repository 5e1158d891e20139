"""The quality score and fit against plain Python."""

import math

import numpy as np
import pytest

pytest.importorskip("passagework.llm")

from passagework.llm import quality_crf as C  # noqa: E402


def plain_score(crf, text):
    """Mean over lines, weighted by their lengths, of the chance that a line is good, by listing all label sequences."""
    lines = C.lines_of(text)
    if not lines:
        return crf.blank
    lengths = np.array([len(lines)])
    e = crf.emissions(C.with_neighbours(C.line_features([lines]), lengths))
    n, total, good = len(lines), 0.0, [0.0] * len(lines)
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = math.exp(crf.start[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(crf.transitions[y[i], y[i + 1]] for i in range(n - 1)))
        total += w
        good = [g + w * k for g, k in zip(good, y)]
    return sum(len(line) * g / total for line, g in zip(lines, good)) / sum(map(len, lines))


def test_scores_against_listing_all_label_sequences():
    rng = np.random.default_rng(3)
    crf = C.LineCrf(rng.normal(size=C.N_FEATURES), rng.normal(size=2), rng.normal(size=(2, 2)), 0.25)
    pool = ["This is a whole sentence.", "$$ 11 %% BUY", "x", "BUY NOW BUY NOW", "Eine Zeile mit Umlauten: äöü.", "", "  ", "This is a whole sentence."]
    texts = ["\n".join(str(rng.choice(pool)) for _ in range(rng.integers(0, 9))) for _ in range(60)] + ["", None or "", "\n\n"]
    assert crf.score(texts) == pytest.approx([plain_score(crf, t) for t in texts])
    assert crf.score([texts[0]] * 2)[0] == crf.score([texts[0]])[0] and len(crf.score([])) == 0


def test_fit_tells_good_lines_from_bad():
    good, bad = ["This is a whole sentence of words.", "And another one follows it here."], ["$$ 11 %% >>>", "BUY BUY BUY 22"]
    documents = [good * 2, bad * 2, good, bad, [good[0]], [bad[1]]] * 5
    lengths = np.array([len(d) for d in documents])
    labels = np.array([int(d[0] in good) for d in documents])
    crf = C.fit_line_crf(C.line_features(documents), lengths, labels)
    scores = crf.score(["\n".join(good), "\n".join(bad), "\n".join([*good, *good, bad[0]])])
    assert scores[0] > 0.9 and scores[1] < 0.1
