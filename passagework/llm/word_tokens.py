"""Token ids of whole texts by a word-level BPE tokenizer file, each distinct word encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
from tokenizers import Tokenizer

from passagework.llm.row_merger import RowMerger
from passagework.llm.word_runs import Runs, coded

#: Words that a task remembers (about 200 bytes each, so 30 MB), and the longest that it does.
MEMO_WORDS, MEMO_LENGTH = 150_000, 48
#: Characters of a text that are cut into words at once; a longer text is cut at white space.
SEGMENT = 400_000

# Letters below U+0180; none of these characters changes under NFC, and lower() treats them one by one.
_PLAIN = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x17F)] if c not in (0x130, 0x149, 0xAD)]
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_OTHER_THAN_PLAIN = re.compile("[^" + re.escape("".join(_PLAIN)) + "]")
_SPACE = re.compile(r"[\t\n\r ]")
_BLANK, _LETTER, _NUMBER, _SIGN = range(4)
_KINDS = np.full(0x180, _SIGN, np.uint8)
for _kind, _characters in ((_BLANK, "\t\n\r "), (_LETTER, _LETTERS), (_NUMBER, _NUMBERS)):
    _KINDS[[ord(c) for c in _characters]] = _kind
_CODED = coded(len(_KINDS), 7)
# What the tokenizer's rule cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in lower-cased plain characters.

    A word is a run of letters, one number, a run of other signs, or an apostrophe that starts such a run with
    one of the endings above.
    """
    kinds = _KINDS[codes]
    starts = kinds != _BLANK
    starts[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
    quotes = np.flatnonzero(starts & (codes == ord("'")))
    padded = np.concatenate((codes[: len(codes)], np.zeros(3, codes.dtype)))
    for ending in ENDINGS:
        held = np.ones(len(quotes), bool)
        for k, letter in enumerate(ending, 1):
            held &= padded[quotes + k] == ord(letter)
        at = quotes[held] + 1
        starts[at] = False
        after = at + len(ending)
        after = after[after < len(codes)]
        starts[after[kinds[after] != _BLANK]] = True
    stops = kinds != _BLANK
    stops[:-1] &= starts[1:] | (kinds[1:] == _BLANK)
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next letter from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class WordTokens:
    """Ids as the ``tokenizers`` library gives them, as little-endian 32-bit numbers.

    Texts of plain characters are cut into the words that the tokenizer's own rule cuts them into, and each
    distinct word is encoded once.  All other texts go through the library whole.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(tokenizer_file)
        model = json.loads(self.library.to_str())["model"]
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merger = RowMerger((vocabulary[a], vocabulary[b], vocabulary[a + b], i) for i, (a, b) in enumerate(merges))
        # bytes as symbols, within a word and at its end
        self.inner, self.last = (np.array([vocabulary.get(c + end, -1) for c in _byte_letters()], np.int32) for end in ("", "</w>"))
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words: short ones are merged side by side by the tokenizer's merges, others go through the library."""
        if not words:
            return {}
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        codes = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[codes]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[codes[ends]]
        got = self.merger.merge(symbols, sizes, np.ones(len(words), bool))
        return {w: self.whole(w) if ids is None else ids for w, ids in zip(words, got, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not ("<|" in t or _OTHER_THAN_PLAIN.search(t)) for t in texts]
        cut = iter(self._plain([t for t, ok in zip(texts, plain, strict=True) if ok]))
        return [next(cut) if ok else self.whole(t) for t, ok in zip(texts, plain, strict=True)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of plain characters."""
        out, run, held = [], [], 0
        for text in texts:
            if len(text) > SEGMENT:
                out += self._segments(run) + [b"".join(b for s in segments(text) for b in self._segments([s]))]
                run, held = [], 0
                continue
            if held + len(text) > SEGMENT:
                out += self._segments(run)
                run, held = [], 0
            run.append(text)
            held += len(text)
        return out + self._segments(run)

    def _segments(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the distinct words of all of them are looked up or learned once."""
        if not texts:
            return []
        joined = "\n".join(texts).lower()
        codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        starts, ends = word_bounds(codes)
        first, of = Runs(np.take(_CODED, codes, axis=1)).distinct(starts, ends)
        words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids = self._known(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[of]
        upto = np.concatenate(([0], np.cumsum(each)))
        data = flat[np.repeat(at[of] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
        # the words of a text are those that start before its end
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        cuts = (4 * upto[np.searchsorted(starts, text_ends)]).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            for word in list(islice(memo, MEMO_WORDS // 2)):  # the older half; common words come back at once
                del memo[word]
        ids = list(map(memo.get, words))
        new = self.learn([w for w, i in zip(words, ids, strict=True) if i is None])
        memo.update(new if not new or max(map(len, new)) <= MEMO_LENGTH else {w: i for w, i in new.items() if len(w) <= MEMO_LENGTH})
        return [new[w] if i is None else i for w, i in zip(words, ids, strict=True)]


def segments(text: str) -> Iterator[str]:
    """Parts of a long text, cut at white space."""
    at = 0
    while found := _SPACE.search(text, at + SEGMENT):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


_made: dict[str, WordTokens] = {}


def word_tokens_for(tokenizer_file: str) -> WordTokens:
    if tokenizer_file not in _made:
        _made[tokenizer_file] = WordTokens(tokenizer_file)
    return _made[tokenizer_file]
