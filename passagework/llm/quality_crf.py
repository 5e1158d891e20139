"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Its features describe the line and its
two neighbours; transition weights couple neighbouring labels.  The
forward-backward recursions give each line's probability of being good, and
the mean weighted by line length is the quality of the document.

The field is fitted by maximum likelihood on a bounded sample of labelled
documents whose lines carry the document's label.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.sampling import allowed_labels, chunked, give_back, labelled_sample

#: Labelled documents of either class that the fit takes at most.
FIT_PER_CLASS = 3000
FIT_STEPS = 150

UPPER, LOWER, LETTER, DIGIT, SPACE, STOP, SYMBOL, MARK = range(8)
BASE = ("length", "letters", "upper", "digits", "symbols", "words", "word_length", "distinct", "repeats", "seen", "ends", "shouts", "marked", "stutters")
#: Columns of BASE that the neighbours of a line lend it.
LENT = tuple(BASE.index(x) for x in ("upper", "symbols", "distinct", "repeats", "seen", "shouts", "marked", "stutters"))
N_FEATURES = 1 + len(BASE) + 2 * (1 + len(LENT))

_classes: np.ndarray | None = None


def _character_classes() -> np.ndarray:
    """Class of every code point; built once per process."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, SYMBOL, np.uint8)
        for code in range(0x110000):
            kind = unicodedata.category(chr(code))
            if kind[0] == "L":
                table[code] = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER}.get(kind, LETTER)
            elif kind[0] in "NMZC":
                table[code] = {"N": DIGIT, "M": MARK}.get(kind[0], SPACE)
        table[[ord(c) for c in ".,;:?'\"()-"]] = STOP
        _classes = table
    return _classes


def lines_of(text: str | None) -> list[str]:
    """Lines that hold more than white space."""
    return [line for line in (text or "").split("\n") if line and not line.isspace()]


def line_features(documents: list[list[str]]) -> np.ndarray:
    """One row of BASE for each line of the documents, in order."""
    lines = [line for doc in documents for line in doc]
    if not lines:
        return np.zeros((0, len(BASE)), np.float32)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _character_classes()[codes]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    count = [np.add.reduceat((kinds == k).view(np.uint8), starts, dtype=np.int64) for k in range(8)]
    out = np.empty((len(lines), len(BASE)), np.float32)
    letters = count[UPPER] + count[LOWER] + count[LETTER] + count[MARK]
    out[:, 0] = np.log1p(lengths) / 6
    out[:, 1] = letters / lengths
    out[:, 2] = count[UPPER] / np.maximum(1, letters)
    out[:, 3] = count[DIGIT] / lengths
    out[:, 4] = count[SYMBOL] / lengths
    words, distinct, repeats = (np.empty(len(lines)) for _ in range(3))
    seen, ends = np.zeros(len(lines)), np.zeros(len(lines))
    at = 0
    for doc in documents:
        before: set[int] = set()
        for line in doc:
            split = line.split()
            n = words[at] = max(1, len(split))
            distinct[at] = len(set(split)) / n
            repeats[at] = sum(map(str.__eq__, split, split[1:])) / n
            key = hash(line)
            seen[at] = key in before
            before.add(key)
            ends[at] = line.rstrip()[-1] in ".?!"
            at += 1
    out[:, 5] = np.log1p(words) / 5
    out[:, 6] = np.minimum(3, lengths / words / 10)
    out[:, 7], out[:, 8], out[:, 9], out[:, 10] = distinct, repeats, seen, ends
    out[:, 11] = (out[:, 2] > 0.5) & (letters > 8)
    out[:, 12] = out[:, 4] > 0.08
    out[:, 13] = out[:, 8] > 0.3
    return out


def with_neighbours(base: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Constant, own features, and of the line before and after: whether there is one, and the lent features."""
    n = len(base)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + len(BASE)] = base
    first = np.zeros(n + 1, bool)
    first[np.concatenate(([0], np.cumsum(lengths)))] = True
    before, after = ~first[:n], ~first[1:]
    lent, at = base[:, LENT], 1 + len(BASE)
    out[:, at] = before
    out[1:, at + 1 : at + 1 + len(LENT)] = lent[:-1] * before[1:, None]
    at += 1 + len(LENT)
    out[:, at] = after
    out[:-1, at + 1 :] = lent[1:] * after[:-1, None]
    return out


@dataclass
class LineCrf:
    """Weights of the state good (those of bad are zero), start and transition scores by state (bad, good).

    ``blank`` is the quality of a text without lines.
    """

    weights: np.ndarray
    start: np.ndarray
    transitions: np.ndarray
    blank: float

    def emissions(self, features: np.ndarray) -> np.ndarray:
        scores = np.zeros((len(features), 2))
        scores[:, 1] = features @ self.weights
        return scores

    def forward_backward(self, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward scores of each line, and each sequence's log partition.

        All sequences advance together, the longest first, so a step costs one array operation.
        """
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        forward, backward = np.empty_like(emissions), np.zeros_like(emissions)
        t = self.transitions
        active = [int(np.searchsorted(-sizes, -step, side="left")) for step in range(int(sizes[0]) if len(sizes) else 0)]
        a = self.start + emissions[starts]
        forward[starts] = a
        for step in range(1, len(active)):
            n = active[step]
            a, at = a[:n], starts[:n] + step
            a = np.logaddexp(a[:, :1] + t[0], a[:, 1:] + t[1]) + emissions[at]
            forward[at] = a
        for step in range(len(active) - 1, 0, -1):
            at = starts[: active[step]] + step
            b = emissions[at] + backward[at]
            backward[at - 1] = np.logaddexp(b[:, :1] + t[:, 0], b[:, 1:] + t[:, 1])
        ends = np.cumsum(lengths) - 1
        return forward, backward, np.logaddexp(forward[ends, 0], forward[ends, 1])

    def marginals(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each line that it is good."""
        if not len(features):
            return np.zeros(0)
        f, b, z = self.forward_backward(self.emissions(features), lengths)
        return np.exp(f[:, 1] + b[:, 1] - np.repeat(z, lengths))

    def score(self, texts: list[str]) -> np.ndarray:
        """Quality of each whole text, 0 to 1; a text without lines gets what the labels of such texts say."""
        documents = [lines_of(t) for t in texts]
        lengths = np.fromiter(map(len, documents), np.int64, len(documents))
        out = np.full(len(texts), self.blank)
        full = lengths > 0
        if full.any():
            sizes = np.fromiter((len(line) for d in documents for line in d), np.float64, int(lengths.sum()))
            good = self.marginals(with_neighbours(line_features(documents), lengths), lengths[full])
            starts = (np.cumsum(lengths) - lengths)[full]
            out[full] = np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts)
        return np.clip(out, 0.0, 1.0)


def fit_line_crf(base: np.ndarray, lengths: np.ndarray, labels: np.ndarray, *, steps: int = FIT_STEPS, rate: float = 0.1, penalty: float = 1e-3) -> LineCrf:
    """Maximum likelihood by gradient steps with adaptive rates; each class weighs the same, each document alike in it.

    Without documents of both classes every line is of the one class, or as likely good as bad.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    crf = LineCrf(np.zeros(N_FEATURES), np.zeros(2), np.zeros((2, 2)), share)
    if not len(labels) or not 0 < share < 1:
        crf.weights[0] = 20 * (share - 0.5)
        return crf
    features = with_neighbours(base, lengths).astype(np.float64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    y = labels[doc]
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum())) / lengths
    inner = np.flatnonzero(doc[:-1] == doc[1:])
    firsts = np.cumsum(lengths) - lengths
    params = [crf.weights, crf.start, crf.transitions]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        e = crf.emissions(features)
        f, b, z = crf.forward_backward(e, lengths)
        p = np.exp(f[:, 1] + b[:, 1] - z[doc])
        pair = np.exp(f[inner, :, None] + crf.transitions + (e + b)[inner + 1, None, :] - z[doc[inner], None, None])
        pair[np.arange(len(inner)), y[inner], y[inner + 1]] -= 1
        by_start = np.stack([1 - p[firsts], p[firsts]], 1)
        by_start[np.arange(len(firsts)), y[firsts]] -= 1
        grads = [
            features.T @ ((p - y) * weight[doc]) + penalty * crf.weights,
            (by_start * weight[:, None]).sum(0) + penalty * crf.start,
            (pair * weight[doc[inner], None, None]).sum(0) + penalty * crf.transitions,
        ]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return crf


def train_quality(docs: DataFrame, labels: DataFrame, *, held_out: int = 0, n_folds: int = 5, per_class: int = FIT_PER_CLASS) -> LineCrf:
    """Fit on at most ``per_class`` labelled documents of either class outside the held-out fold.

    Executors compute the line features; the numbers of the bounded sample come to the driver.  A text without
    lines has no features; its quality is learned from all allowed labels (see ``blank_quality``).
    """
    sample = labelled_sample(docs, labels, "quality", per_class=per_class, held_out=held_out, n_folds=n_folds)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [(label, lines) for text, label in zip(batch["text"], batch["label"], strict=True) if (lines := lines_of(text))]
            yield pd.DataFrame([(label, len(lines), line_features([lines]).tobytes()) for label, lines in held], columns=["label", "n", "base"])

    rows = sample.mapInPandas(describe, "label int, n int, base binary").collect()
    rows.sort(key=lambda r: (r["label"], r["n"], bytes(r["base"])))
    base = np.frombuffer(b"".join(r["base"] for r in rows), np.float32).reshape(-1, len(BASE))
    crf = fit_line_crf(base, np.array([r["n"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64))
    crf.blank = blank_quality(docs, allowed_labels(labels, "quality", held_out=held_out, n_folds=n_folds))
    return crf


def blank_quality(docs: DataFrame, labels: DataFrame) -> float:
    """Share of good ones among the labelled documents without lines, drawn to that among all by one document's weight.

    ``labels`` has ``doc_id, label``; all of them count.  Without labels it is one half.  Only ids of blank
    documents are shuffled, and one row of counts comes to the driver.
    """
    blank = docs.where(F.col("doc_id").isNotNull() & F.coalesce(~F.col("text").rlike(r"(?U)\S"), F.lit(True))).select("doc_id").distinct()
    of_blank = labels.join(blank, "doc_id", "left_semi")
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good")]
    every, those = labels.agg(*sums).first(), of_blank.agg(*sums).first()
    share = every["good"] / every["n"] if every["n"] else 0.5
    return float((those["good"] + share) / (those["n"] + 1))


def quality_score(model: LineCrf, text: Column) -> Column:
    """Quality of whole texts, 0 to 1; null, empty and blank texts get ``model.blank``.

    The score depends on the text alone: repeated rows score alike, and scores that tie with a limit are left to the caller.
    Texts of any length are scored whole, in runs of about a million characters or one text.  An empty table gives no
    rows, and other columns are not read, whatever their names.
    """

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([model.score(run) for run in chunked(texts.tolist(), 1_000_000)] or [np.zeros(0)]))
        give_back()

    return score(text)
