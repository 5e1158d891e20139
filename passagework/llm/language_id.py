"""Language identification by a bit-sliced Bloom filter of character n-grams.

One array holds a bit of every language's Bloom filter in each slot: bit ``l``
of slot ``i`` belongs to language ``l``.  Looking an n-gram up takes the slots
of its hashes and joins them by AND; what is left is a mask of all languages
whose filter holds the n-gram.  For each language the set bits over a text are
counted, corrected for the false positives that the fill of its filter makes
likely, and the language with the largest count decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passagework.llm.quality_crf import LETTER, LOWER, MARK, UPPER, _character_classes
from passagework.llm.sampling import chunked, fold, give_back
from passagework.sources.scratch import save_scratch

#: Documents of each language that the fit takes, in expectation, where there are more.
FIT_PER_LANGUAGE = 4000
#: An n-gram is put into a language's filter if this share of the language's documents holds it,
#: and at least this share of the language that holds it most often.
MIN_SHARE, OF_LARGEST = 0.004, 0.35
#: N-grams that the filters hold at most for each language, the most frequent ones.
NGRAMS_PER_LANGUAGE = 12_000
#: An n-gram needs two documents, or this share of a language of few documents.
FEW = 0.05
SLOTS_PER_NGRAM, N_HASHES = 16, 3
MAX_LANGUAGES = 64
UNKNOWN = "und"
SIZES = (3, 4)
#: Distinct n-grams that a task counts before it hands them on.
FLUSH = 500_000

#: Parts into which id hashes are dealt when documents are drawn.
_PARTS = 1 << 50

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def letters_and_spaces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with a space for whatever is no letter, which are letters, and where each text starts.

    Each text has a space before and after it.  Combining marks stay with the letters, but are none.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds = _character_classes()[codes]
    letters = (kinds == UPPER) | (kinds == LOWER) | (kinds == LETTER)
    codes = np.where(letters | (kinds == MARK), codes, 32)
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 2
    return codes, letters, np.cumsum(sizes) - sizes


def ngram_keys(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: where an n-gram with only letters inside starts, and a number that stands for it.

    The ends may be spaces, which mark where a word begins or stops.
    """
    letter = codes != 32
    for n in SIZES:
        inner = letter[1:-1] if n == 3 else letter[1:-2] & letter[2:-1]
        at = np.flatnonzero(inner)
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = (key ^ codes[at + k].astype(np.uint64)) * np.uint64(_ODD[k])
            key ^= key >> np.uint64(29)
        yield at, key


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray
    fill: np.ndarray

    @property
    def false_positives(self) -> np.ndarray:
        return self.fill**N_HASHES

    def positions(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        for k in range(N_HASHES):
            yield (keys * np.uint64(_ODD[-1 - k]) ^ keys >> np.uint64(31 - k)) * np.uint64(_ODD[k]) >> shift

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, masks: np.ndarray) -> LanguageFilter:
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= np.iinfo(t).bits)
        size = 1 << max(10, int(len(keys) * SLOTS_PER_NGRAM - 1).bit_length())
        out = cls(languages, np.zeros(size, kind), np.zeros(len(languages)))
        for at in out.positions(keys):
            np.bitwise_or.at(out.slots, at, masks.astype(kind))
        out.fill = np.array([float((out.slots >> kind(i) & kind(1)).mean()) for i in range(len(languages))])
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Mask of all languages whose filter holds each n-gram."""
        found = None
        for at in self.positions(keys):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        codes, is_letter, starts = letters_and_spaces(texts)
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, keys in ngram_keys(codes):
            masks = np.zeros(len(codes) + 1, self.slots.dtype)
            masks[at] = self.lookup(keys)
            here = np.zeros(len(codes) + 1, np.uint8)
            here[at] = 1
            total += np.add.reduceat(here[:-1], starts, dtype=np.int64)
            for i in range(len(self.languages)):
                hits[:, i] += np.add.reduceat((masks[:-1] >> self.slots.dtype.type(i) & self.slots.dtype.type(1)).astype(np.uint8), starts, dtype=np.int64)
        wrong = self.false_positives
        share = np.clip((hits - total[:, None] * wrong) / np.maximum(1, total)[:, None] / (1 - wrong), 0, 1)
        letters = np.add.reduceat(is_letter.view(np.uint8), starts, dtype=np.int64) > 0
        best = share.argmax(1)
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)], np.where(letters, share[np.arange(len(texts)), best], 0.0)


def train_language_id(docs: DataFrame, *, n_folds: int = 4, held_out: int = 2, per_language: int = FIT_PER_LANGUAGE, ngrams_per_language: int = NGRAMS_PER_LANGUAGE) -> LanguageFilter:
    """Filters of all languages of the rows outside the held-out fold that have a text and a language.

    Of each language the documents with small id hashes are taken, ``per_language`` of them in expectation.
    Spark counts the documents of each n-gram by language; the chosen n-grams (``ngrams_per_language`` times the
    languages at most) come to the driver.  More than ``MAX_LANGUAGES`` languages are an error.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), n_folds) != held_out)).select("doc_id", "text", "lang")
    sizes = dict(map(tuple, known.groupBy("lang").agg(F.count(F.lit(1))).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()))
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"there are more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter.build([UNKNOWN], np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(_PARTS * min(1.0, per_language / n))).cast("long"))))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS).cast("long")) < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flushed() -> pd.DataFrame:
            rows = pd.DataFrame([(key, lang, n) for (key, lang), n in held.items()], columns=["key", "lang", "n"])
            held.clear()
            return rows

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                codes, _, _ = letters_and_spaces([text])
                for _, keys in ngram_keys(codes):
                    held.update((k, lang) for k in np.unique(keys).view(np.int64).tolist())
                held[0, lang] += 1  # documents of the language in the sample
                if len(held) > FLUSH:
                    yield flushed()
        yield flushed()

    counts = save_scratch(sample.mapInPandas(count, "key long, lang string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n")), "language-counts")
    taken = dict(map(tuple, counts.where("key = 0").select("lang", "n").collect()))
    bit = F.create_map(*(x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(np.uint64(1 << i).view(np.int64).item()).cast("long"))))
    of = F.create_map(*(x for lang, n in taken.items() for x in (F.lit(lang), F.lit(float(n))))) if taken else F.create_map(F.lit(""), F.lit(1.0))
    docs_of = of[F.col("lang")]
    part, enough = F.col("n") / docs_of, F.col("n") >= F.least(F.lit(2.0), F.ceil(docs_of * FEW))
    chosen = (
        counts.where((F.col("key") != 0) & enough).withColumn("part", part).where(F.col("part") >= MIN_SHARE)
        .withColumn("largest", F.max("part").over(W.partitionBy("key"))).where(F.col("part") >= OF_LARGEST * F.col("largest"))
        .groupBy("key").agg(F.bit_or(bit[F.col("lang")]).alias("mask"), F.max("part").alias("part"))
        .orderBy(F.desc("part"), "key").limit(ngrams_per_language * len(languages)).select("key", "mask").toPandas()
    )
    return LanguageFilter.build(languages, chosen["key"].to_numpy(np.int64).view(np.uint64), chosen["mask"].to_numpy(np.int64).view(np.uint64))


def predict_language(model: LanguageFilter, text: Column) -> Column:
    """Struct of ``lang`` and ``score``, the winner's corrected share of the n-grams, for whole texts.

    A null text and one without a letter is ``und`` with score 0.  A tie goes to the first language in order.
    The result depends on the text alone, so repeated rows are alike; texts of any length are judged whole; an empty
    table gives no rows, and other columns are not read, whatever their names.
    """

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = [], [np.zeros(0)]
            for run in chunked(texts.tolist(), 1_000_000):
                a, b = model.predict(run)
                lang += a
                score.append(b)
            yield pd.DataFrame({"lang": lang, "score": np.concatenate(score)})
        give_back()

    return predict(text)
