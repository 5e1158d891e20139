"""String functions as columns: built-in expressions where they are exact, Arrow functions where they are not."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Patterns that define the formats.
WORD_PATTERN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"
REFERENCE_PATTERN = r"\b\d+[a-z]?(?:\s*\(\s*[0-9a-z]+\s*\))+"
SENTENCE_PATTERN = r"(?<=[.!?])\s+(?=[A-Z0-9“\"'])"
MARKER_PATTERN = r"^\(([0-9]+|[a-zA-Z]+)\)\s*"
LABEL_PATTERN = r"^\((?:\d+|[A-Za-z]+)\)$"
RESIDUAL_PATTERN = r"^(?:Explanation(?:\s|\.|[—–:]|$)|Illustrations?(?:\.|\s|$)|Exception(?:\s|\.|[—–:]|$)|Provided\b|Proviso\b)"
CITATION_PATTERN = r"(?d)^(BNS|BNSS|BSA)-\d{4}-[0-9a-f]{12}-S[0-9A-Za-z]+$"


def compact(text: Column) -> Column:
    """Text without white space of any kind."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def normalize_line(text: Column) -> Column:
    """Runs of spaces and tabs become one space, and the ends are stripped."""
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def normalize_whitespace(text: Column) -> Column:
    """Lower case with each run of white space as one space: a key for duplicates of plain text."""
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def _on_texts(function: Callable[[str], object], kind: T.DataType) -> Callable[[Column], Column]:
    """A column function that maps texts in Arrow batches and keeps nulls."""

    def apply(text: Column) -> Column:
        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([None if t is None else function(t) for t in batch.to_pylist()], target)

        target = to_arrow_type(kind)
        return run(text)

    return apply


def folded(text: str) -> str:
    """NFKC and case folding, with curly apostrophes straightened; neither has a built-in."""
    return unicodedata.normalize("NFKC", text).casefold().replace("’", "'").replace("‘", "'")


casefold_nfkc = _on_texts(folded, T.StringType())
#: Key under which two questions are the same: folded, with white space collapsed.
question_key = _on_texts(lambda t: " ".join(folded(t).split()), T.StringType())


_TOKENS = regex.compile(WORD_PATTERN)
_REFERENCES = regex.compile(REFERENCE_PATTERN)


def tokens_of(text: str | None) -> list[str]:
    """Words and reference prefixes of a text that is normalised first."""
    low = folded(text or "")
    found = _TOKENS.findall(low)
    for reference in _REFERENCES.findall(low):
        base, *parts = "".join(reference.split()).split("(")
        found += [base + "".join("(" + p for p in parts[: n + 1]) for n in range(len(parts))]
    return found


#: The same as a column.
exact_tokens = _on_texts(tokens_of, T.ArrayType(T.StringType()))


def words(normalized: Column) -> Column:
    """Words of a normalised text: runs of letters and numbers, joined by apostrophes."""
    return F.regexp_extract_all(normalized, F.lit(WORD_PATTERN), 0)


def reference_prefixes(normalized: Column) -> Column:
    """Every prefix of every reference: ``359(1)(a)`` gives ``359(1)`` and ``359(1)(a)``."""

    def prefixes(reference: Column) -> Column:
        parts = F.regexp_extract_all(reference, F.lit(r"\([^()]+\)"), 0)
        base = F.element_at(F.split(reference, r"\("), 1)
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(base, F.array_join(F.slice(parts, 1, n), "")))

    found = F.transform(F.regexp_extract_all(normalized, F.lit(REFERENCE_PATTERN), 0), lambda r: F.regexp_replace(r, r"\s+", ""))
    return F.flatten(F.transform(found, prefixes))


def tokenize(text: Column, *, exact: bool = False) -> Column:
    """Words and reference prefixes, repeats included; a null text has no tokens.

    ``exact`` normalises by NFKC and case folding in Arrow batches.  Without it lower-casing alone is used,
    which agrees for text that is composed and has no letters like the German sharp s in upper case.
    """
    if exact:
        return F.coalesce(exact_tokens(text), F.array().cast("array<string>"))
    normalized = F.coalesce(F.translate(F.lower(text), "’‘", "''"), F.lit(""))
    return F.concat(words(normalized), reference_prefixes(normalized))


_SENTENCE_BREAK = re.compile(SENTENCE_PATTERN)


def split_sentences(text: str) -> list[dict]:
    """``text, char_start, char_end`` of the stripped sentences of a text, in order; offsets count from 0."""
    spans, start = [], 0
    for stop, resume in [*((m.start(), m.end()) for m in _SENTENCE_BREAK.finditer(text)), (len(text), len(text))]:
        piece = text[start:stop]
        if kept := piece.strip():
            at = start + len(piece) - len(piece.lstrip())
            spans.append({"text": kept, "char_start": at, "char_end": at + len(kept)})
        start = resume
    return spans


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]))
#: Sentences of a text: cut where white space follows ``.``, ``!`` or ``?`` and precedes a capital, digit or quote.
sentence_spans = _on_texts(split_sentences, SPAN_TYPE)


def is_citation(text: Column) -> Column:
    """Whether a text is a section citation; identifiers of table rows, notes and forms are not."""
    return text.rlike(CITATION_PATTERN)


def is_label(text: Column) -> Column:
    return text.rlike(LABEL_PATTERN)


def marker(text: Column) -> Column:
    """Label of a leading marker such as ``(a)``; null without one."""
    found = F.regexp_extract(text, MARKER_PATTERN, 1)
    return F.when(found != "", found)


def is_residual(text: Column) -> Column:
    """Whether a paragraph starts an explanation, illustration, exception or proviso."""
    return text.rlike(RESIDUAL_PATTERN)


def _roman(n: int) -> str:
    out = ""
    for value, digits in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + digits, n - value
    return out


ROMANS = [_roman(n) for n in range(1, 31)]


def roman_value(label: Column) -> Column:
    """1 to 30 for ``i`` to ``xxx``, else null."""
    at = F.array_position(F.split(F.lit(" ".join(ROMANS)), " "), F.lower(label))
    return F.when(at > 0, at).cast("int")


def alpha_value(label: Column) -> Column:
    """Bijective base 26: ``a`` is 1, ``z`` 26, ``aa`` 27; null for anything else."""
    digits = F.split(F.lower(label), "")
    value = F.aggregate(digits, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 96)
    return F.when(label.rlike("^[A-Za-z]{1,6}$"), value)


def next_label(kind: Column, label: Column) -> Column:
    """Label after ``label`` in a ``num``, ``alpha``, ``upper`` or ``roman`` sequence; null where there is none."""
    one = F.char(F.ascii(label) + 1)
    alpha = F.when(label == "z", F.lit("aa")).when(F.length(label) == 1, one)
    roman = F.get(F.split(F.lit(" ".join(ROMANS)), " "), roman_value(label))
    return (
        F.when(kind == "num", (label.try_cast("int") + 1).cast("string"))
        .when(kind.isin("alpha", "upper"), alpha).when((kind == "roman") & label.isin(ROMANS), roman)
    )


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, and 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("int")


def section_heading(act: Column, number: Column, labels: Column, title: Column, chapter_number: Column, chapter_title: Column) -> Column:
    """``ACT § n(labels) | title | Chapter X``, without the parts that are missing or empty."""
    filled = lambda c: F.when(c != "", c)
    chapter = F.coalesce(F.concat(F.lit("Chapter "), filled(chapter_number)), filled(chapter_title))
    return F.concat_ws(" | ", F.concat(act, F.lit(" § "), number, F.coalesce(labels, F.lit(""))), filled(title), chapter)


def row_text(labels: Column, values: Column) -> Column:
    """``label: value`` per line, with the white space of labels collapsed."""
    return F.array_join(F.zip_with(labels, values, lambda a, b: F.concat(strip(F.regexp_replace(a, r"(?U)\s+", " ")), F.lit(": "), b)), "\n")


def cleaned_title(title: Column) -> Column:
    """White space collapsed and final full stops removed."""
    return F.regexp_replace(strip(F.regexp_replace(title, r"(?U)\s+", " ")), r"\.+$", "")


def prompt(question: Column, passages: Column) -> Column:
    """Question and context of an answer; ``passages`` holds ``citation_id, text``."""
    context = F.array_join(F.transform(passages, lambda p: F.concat(F.lit("["), p["citation_id"], F.lit("] "), p["text"])), "\n\n")
    return F.concat(F.lit("Question: "), question, F.lit("\n\nContext:\n"), context)


def same_characters(left: Column, right: Column) -> Column:
    """Whether two texts hold the same characters equally often."""
    return F.array_sort(F.split(left, "")) == F.array_sort(F.split(right, ""))
