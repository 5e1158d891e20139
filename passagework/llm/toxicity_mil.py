"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability of being
toxic, and noisy-or combines them: a document is clean only if all of its
sentences are.  Only documents are labelled; the likelihood of their labels
trains the sentence scores, which then locate the offending sentences.

A sentence's features are its distinct words and their first letters, so that
inflected and unseen forms of a learned word count as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.sampling import give_back, labelled_sample
from passagework.llm.word_runs import Runs

#: Labelled documents of either class that the fit takes at most.
FIT_PER_CLASS = 4000
#: The fit keeps features whose relation to the label has at least this chi-square (chance: 8 in a million), times n / (n + ``FEW``)
#: for n documents, since chi-square can't exceed n.
MIN_CHI_SQUARE, FEW = 20.0, 50.0
#: Features that the fit takes at most, the strongest ones.
MAX_FEATURES = 4000
FIT_STEPS = 500
#: Documents whose features are handed on at once.
DOCS_AT_ONCE = 200
PREFIXES = (4, 5)
#: Characters of a text that are scored at once; a longer text is cut after a sentence.
SEGMENT = 250_000

_SENTENCE = re.compile(r"[^\s.!?][^.!?\n]*[.!?]*")
_SENTENCE_END = re.compile(r"[.!?]+|\n")
_WORD = re.compile(r"[^\W\d_]+")

SCORE_TYPE = "score double, spans array<struct<start:int,end:int,score:double>>"


def word_features(word: str) -> list[str]:
    """The word and its first letters, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def sentence_words(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct words of each sentence that has words; a text is lower-cased as for scoring, which leaves its places."""
    for found in _SENTENCE.finditer(lowered(text)):
        if words := set(_WORD.findall(found[0])):
            yield found.start(), found.end(), words


@dataclass
class ToxicityModel:
    """``weights`` of words and, with a hyphen at the end, of beginnings; ``prior`` is the share of toxic documents in the fit."""

    bias: float
    weights: dict[str, float]
    prior: float


class SentenceScorer:
    """Scores of all sentences of many texts by array operations; made once per task from a model."""

    def __init__(self, model: ToxicityModel) -> None:
        self.bias = model.bias
        whole = {f: w for f, w in model.weights.items() if f[-1] != "-"}
        tables = [whole] + [{f[:-1]: w for f, w in model.weights.items() if f[-1] == "-" and len(f) == n + 1} for n in PREFIXES]
        self._tables = [self._table(t) for t in tables]

    @staticmethod
    def _table(weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and the weight of each feature, by the first hash."""
        words = list(weights)
        codes = _codes("".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if words else ends
        runs = Runs(_numbers(codes))
        one, two = (runs.hashes(starts, ends, k) for k in (0, 1))
        order = np.argsort(one)
        return one[order], two[order], np.fromiter(weights.values(), np.float64, len(words))[order]

    def _weights(self, runs: Runs, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Weight of each word: that of the whole word and of its beginnings."""
        out = np.zeros(len(starts))
        for (one, two, weight), n in zip(self._tables, (None, *PREFIXES), strict=True):
            able = np.arange(len(starts)) if n is None else np.flatnonzero(ends - starts > n)
            if len(one) and len(able):
                first, last = starts[able], ends[able] if n is None else starts[able] + n
                key = runs.hashes(first, last)
                at = np.minimum(np.searchsorted(one, key), len(one) - 1)
                hit = np.flatnonzero(one[at] == key)
                hit = hit[two[at[hit]] == runs.hashes(first[hit], last[hit], 1)]
                out[able[hit]] += weight[at[hit]]
        return out

    def score(self, texts: list[str | None], at_least: float) -> tuple[np.ndarray, list[list[dict]]]:
        """Noisy-or of all sentences of each whole text, and the spans of those that score ``at_least``; a text without words is clean."""
        clean, spans = np.zeros(len(texts)), [[] for _ in texts]
        run: list[tuple[int, int, str]] = []
        held = 0
        for i, text in enumerate(texts):
            for at, part in _parts(text or ""):
                if run and held + len(part) > SEGMENT:
                    self._add(run, at_least, clean, spans)
                    run, held = [], 0
                run.append((i, at, part))
                held += len(part) + 1
        if run:
            self._add(run, at_least, clean, spans)
        return -np.expm1(clean) + 0.0, spans  # no negative zero

    def _add(self, run: list[tuple[int, int, str]], at_least: float, clean: np.ndarray, spans: list[list[dict]]) -> None:
        """Add the log probability of being clean of each part's sentences to its text, and the offending spans."""
        codes = _codes("\n".join(part for _, _, part in run))
        inner = _table_of_words()[codes]
        edge = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return
        runs = Runs(_numbers(codes))
        first, of = runs.distinct(starts, ends)
        weight = self._weights(runs, starts[first], ends[first])
        # a sentence is what lies between two marks; line ends between parts are marks as well
        marks = np.flatnonzero((codes == 10) | (codes == 33) | (codes == 46) | (codes == 63))
        sentence = np.searchsorted(marks, starts)
        is_first = np.diff(sentence, prepend=-1) > 0
        sentences, nth = sentence[is_first], np.cumsum(is_first) - 1
        weighted = np.flatnonzero(weight[of])
        pairs = np.unique(nth[weighted] * np.int64(len(first)) + of[weighted])  # each word counts once in a sentence
        z = self.bias + np.bincount(pairs // len(first), weight[pairs % len(first)], len(sentences))
        part_ends = np.cumsum([len(part) + 1 for _, _, part in run])
        part = np.searchsorted(part_ends, starts[is_first], side="right")
        np.subtract.at(clean, np.array([i for i, _, _ in run])[part], np.logaddexp(0.0, z))
        p = 1 / (1 + np.exp(-z))
        for k in np.flatnonzero(p >= at_least):
            i, at, text = run[part[k]]
            begins = int(part_ends[part[k]]) - len(text) - 1
            mark = int(marks[sentences[k] - 1]) + 1 if sentences[k] else 0
            found = _SENTENCE.search(text, max(0, mark - begins))
            spans[i].append({"start": at + found.start(), "end": at + found.end(), "score": float(p[k])})


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text with where they start; a long text is cut after sentences."""
    at = 0
    while len(text) - at > SEGMENT and (found := _SENTENCE_END.search(text, at + SEGMENT // 2)):
        yield at, text[at : found.end()]
        at = found.end()
    yield at, text[at:]


_word_tables: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: the lower-case one, and whether it is part of a word; built once per process."""
    global _word_tables
    if _word_tables is None:
        low = np.fromiter((ord(chr(c).lower()[0]) for c in range(0x110000)), np.uint32, 0x110000)
        _word_tables = low, np.fromiter((chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x110000)), bool, 0x110000)
    return _word_tables


def _table_of_words() -> np.ndarray:
    return _tables()[1]


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points."""
    return _tables()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def lowered(text: str) -> str:
    """The text lower-cased code point by code point, so that it keeps its length."""
    return _codes(text).tobytes().decode("utf-32-le", "surrogatepass")


def _numbers(codes: np.ndarray) -> np.ndarray:
    """Two numbers for each code point."""
    spread = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    spread ^= spread >> np.uint64(31)
    out = np.empty((2, len(codes)), np.uint64)
    np.multiply(spread, np.uint64(0xD6E8FEB86659FD93), out=out[0])
    np.multiply(spread, np.uint64(0xC2B2AE3D27D4EB4F), out=out[1])
    out ^= out >> np.uint64(29)
    return out


def score_text(model: ToxicityModel, text: str | None, at_least: float) -> tuple[float, list[dict]]:
    """Score and spans of one text."""
    score, spans = SentenceScorer(model).score([text], at_least)
    return float(score[0]), spans[0]


def fit_noisy_or(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, value: np.ndarray, bare: np.ndarray, labels: np.ndarray, n_features: int, *, steps: int = FIT_STEPS, rate: float = 0.1, penalty: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights by the likelihood of the bags' labels, each class weighing the same.

    ``doc`` gives the bag of each sentence with features, ``sentence, feature, value`` its entries, and
    ``bare`` the sentences without features of each bag, which score the bias alone.
    """
    w = np.zeros(n_features + 1)
    counts = np.bincount(doc, minlength=len(labels)) + bare
    w[-1] = -3 - np.log(max(1.0, counts.mean()))
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(sentence, value * w[feature], minlength=len(doc)) + w[-1]
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        clean = -np.bincount(doc, np.logaddexp(0, z), minlength=len(labels)) - bare * np.logaddexp(0, w[-1])
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        # derivative of the bag's log likelihood by a sentence's score, over the sentence's probability
        pull = weight * np.where(labels == 1, np.exp(clean) / toxic, -1.0)
        by_sentence = pull[doc] * p
        g = np.append(np.bincount(feature, value * by_sentence[sentence], minlength=n_features), by_sentence.sum() + (pull * bare * p0).sum())
        g[:-1] -= penalty * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return float(w[-1]), w[:-1]


def train_toxicity(docs: DataFrame, labels: DataFrame, *, held_out: int = 0, n_folds: int = 5, per_class: int = FIT_PER_CLASS, max_features: int = MAX_FEATURES) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of either class outside the held-out fold.

    Spark counts the documents of each feature by class and keeps those with a large chi-square, ``max_features`` at
    most; the entries of these features in the bounded sample come to the driver for the fit.
    """
    sample = labelled_sample(docs, labels, "toxic", per_class=per_class, held_out=held_out, n_folds=n_folds)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), DOCS_AT_ONCE):
                batch = whole.iloc[start : start + DOCS_AT_ONCE]
                held = [list({f for word in set(_WORD.findall(lowered(text))) for f in word_features(word)}) for text in batch["text"]]
                yield pd.DataFrame({"feature": [f for fs in held for f in fs], "label": np.repeat(batch["label"].to_numpy(), [len(fs) for fs in held])})
        give_back()

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        prior = toxic / max(1, clean + toxic)
        return ToxicityModel(20.0 if prior == 1 else -20.0, {}, prior)
    a, n = F.col("toxic"), F.col("n")
    cross = (a * clean - (n - a) * toxic).cast("double")
    chi_square = (clean + toxic) * cross * cross / (n * F.greatest(clean + toxic - n, F.lit(1)) * clean * toxic)
    chosen = (
        sample.mapInPandas(features, "feature string, label int").groupBy("feature").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
        .select("feature", chi_square.alias("strength")).where(F.col("strength") >= MIN_CHI_SQUARE * (clean + toxic) / (clean + toxic + FEW))
        .orderBy(F.desc("strength"), "feature").limit(max_features)
    )
    index = {r["feature"]: i for i, r in enumerate(chosen.collect())}

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                sentence, feature, bare, at = [], [], 0, 0
                for _, _, words in sentence_words(text):
                    held = [index[f] for word in words for f in word_features(word) if f in index]
                    if held:
                        sentence += [at] * len(held)
                        feature += held
                        at += 1
                    else:
                        bare += 1
                rows.append((label, bare, at, np.array(sentence, np.int32).tobytes(), np.array(feature, np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["label", "bare", "n", "sentence", "feature"])

    if not index:
        return ToxicityModel(-20.0, {}, toxic / (clean + toxic))
    rows = sample.mapInPandas(entries, "label int, bare int, n int, sentence binary, feature binary").collect()
    rows.sort(key=lambda r: (r["label"], r["n"], r["bare"], bytes(r["feature"])))
    n = np.array([r["n"] for r in rows], np.int64)
    start = np.cumsum(n) - n
    sentence = np.concatenate([np.frombuffer(r["sentence"], np.int32) + s for r, s in zip(rows, start, strict=True)])
    feature = np.concatenate([np.frombuffer(r["feature"], np.int32) for r in rows])
    bias, weights = fit_noisy_or(
        np.repeat(np.arange(len(rows)), n), sentence, feature, np.ones(len(feature)), np.array([r["bare"] for r in rows], np.float64),
        np.array([r["label"] for r in rows], np.int64), len(index),
    )
    return ToxicityModel(bias, {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3}, toxic / (clean + toxic))


def toxicity(model: ToxicityModel, text: Column, at_least: float = 0.5) -> Column:
    """Struct of the document's ``score`` and the ``spans`` (start, end, score) of its offending sentences, those that score ``at_least`` or more.

    Null and empty texts and texts without a word score 0 and have no spans.  Texts of any length are scored whole, in parts
    cut after sentences; every sentence with a word adds its chance, however small.  The score depends on the text alone, so
    repeated rows and ties score alike; an empty table gives no rows, and other columns are not read.
    """

    @F.pandas_udf(SCORE_TYPE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = SentenceScorer(model)
        for texts in batches:
            found, spans = scorer.score(texts.tolist(), at_least)
            yield pd.DataFrame({"score": found, "spans": spans})
        give_back()

    return score(text)
