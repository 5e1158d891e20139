"""A benchmark's questions held against their manifest, the corpus and their own generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.artifacts import zoned_timestamp
from passagework.operators.sampling import strided_sample
from passagework.operators.validation import question_violations, require, row_differences


# The act of procedural questions, and how questions made from sections are named and worded.
PROCEDURAL_ACT = "BNSS"
MADE_ID, MADE_BEGIN, MADE_MIDDLE, MADE_END = "p34-02-direct-", "Which provision in the ingested ", " 2023 snapshot covers '", "'?"


@dataclass(frozen=True)
class Expectations:
    """What a benchmark must be like.

    Fixed values: the version, the least number of questions, which part of them must be more than half, and how many
    questions some provenances have.
    """

    version: str = "v2"
    least_questions: int = 30
    categories: Sequence[str] = ("direct_lookup", "scenario", "cross_act", "procedural")
    acts: Sequence[str] = ("BNS", "BNSS", "BSA")
    provenances: Sequence[str] = ("corpus_section", "gold_retrieval", "generated_candidate")
    majority: str = "direct_lookup"
    ranges: Mapping[str, tuple[int, int]] = field(default_factory=lambda: {"gold_retrieval": (3, 5), "generated_candidate": (8, 12)})


def counted(questions: DataFrame, column: str) -> dict[str, int]:
    """Questions for each value of a column, which has few; ``null`` for none."""
    return {r["value"]: r["n"] for r in questions.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")).agg(F.count(F.lit(1)).alias("n")).collect()}


def rule_violations(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """``id, violation`` of the rules between a question's category, act, provenance and gold.

    ``citations``: ``citation_id, act, json_pointer``.  A procedural question has an act; one over several acts has none
    and gold of more than one; these and scenarios are candidates, and candidates need a review; a question made from a
    section is a direct lookup with one gold id and its pointer; a pointer is one of the gold's.
    """
    gold = questions.select("id", F.explode("gold_citation_ids").alias("citation_id")).join(citations.select("citation_id", F.col("act").alias("_act"), F.col("json_pointer").alias("_pointer")), "citation_id")
    held = gold.groupBy("id").agg(F.count_distinct("_act").alias("_acts"), F.collect_set("_pointer").alias("_pointers"))
    q = questions.join(held, "id", "left")
    is_made, candidate = F.col("provenance") == "corpus_section", F.col("provenance") == "generated_candidate"
    one_lookup = (F.col("category") == "direct_lookup") & (F.size("gold_citation_ids") == 1)
    rules: list[tuple[str, Column]] = [
        ("procedural without its act", (F.col("category") == "procedural") & ~F.col("act").eqNullSafe(F.lit(PROCEDURAL_ACT))),
        ("cross-act with one act", (F.col("category") == "cross_act") & (F.col("act").isNotNull() | (F.coalesce("_acts", F.lit(0)) < 2))),
        ("not marked as a candidate", F.col("category").isin("cross_act", "scenario") & ~candidate),
        ("candidate without review", candidate & ~F.coalesce("needs_legal_review", F.lit(False))),
        ("made from a section, but no single lookup", is_made & ~one_lookup),
        ("made from a section, but without pointer", is_made & F.col("json_pointer").isNull()),
        ("pointer of another citation", F.col("json_pointer").isNotNull() & ~F.coalesce(F.array_contains("_pointers", F.col("json_pointer")), F.lit(False))),
        ("white space around the id", F.trim("id") != F.col("id")),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules)))
    return q.select("id", F.explode(found).alias("violation"))


def regenerated(sections: DataFrame, *, seed: int, per_act: int, stride: int, excluded: Sequence[str] = ()) -> DataFrame:
    """Questions made from ``per_act`` sections of each act: every ``stride``-th of those sorted by id, from ``seed`` on.

    ``sections``: ``act, citation_id, title, json_pointer``.  A stride that isn't coprime to a pool and a pool that is too
    small are errors, as is a section without a title.
    """
    pool = sections.where(~F.col("citation_id").isin(list(excluded))) if excluded else sections
    picked = strided_sample(pool.select("act", "citation_id"), ["act"], "citation_id", seed=seed, stride=stride, per_group=per_act).select("citation_id")
    title = F.rtrim(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit(". "))
    named = F.when(F.coalesce(title, F.lit("")) == "", F.raise_error(F.lit("a section has no title")).cast("string")).otherwise(title)
    return sections.join(picked, "citation_id").select(
        F.concat(F.lit(MADE_ID), "citation_id").alias("id"), F.concat(F.lit(MADE_BEGIN), "act", F.lit(MADE_MIDDLE), named, F.lit(MADE_END)).alias("query"), "act",
        F.lit("direct_lookup").alias("category"), F.array("citation_id").alias("gold_citation_ids"), F.lit("corpus_section").alias("provenance"), "json_pointer", F.lit(False).alias("needs_legal_review"),
    )


def manifest_faults(questions: DataFrame, manifest: Mapping[str, Any], hashes: Mapping[str, str], sections: DataFrame | None = None, expected: Expectations = Expectations()) -> list[str]:  # noqa: B008
    """What of a manifest doesn't fit the questions, in words; an empty list where all does.

    Checked are the version, the totals, the counts by category and act (null acts under ``null``), the majority, the numbers of
    some provenances, the time of its making with its zone, the ``hashes`` of the artifacts, and, with ``sections``, that the questions
    made from sections are what the manifest's generator makes of them.
    """
    faults = []

    def check(fits: object, fault: str) -> None:
        if not fits:
            faults.append(fault)

    categories, acts, provenances = (counted(questions, c) for c in ("category", "act", "provenance"))
    n = sum(categories.values())
    check(manifest.get("version") == expected.version, "version")
    check(n >= expected.least_questions, "too few questions")
    check(type(manifest.get("total_questions")) is int and manifest["total_questions"] == n, "total_questions")
    check(set(categories) == set(expected.categories), "a category is missing or unknown")
    check(manifest.get("categories") == categories, "categories")
    check(set(acts) - {"null"} == set(expected.acts), "an act is missing or unknown")
    check(manifest.get("acts") == {"null": 0, **acts}, "acts")
    check(2 * categories.get(expected.majority, 0) > n, "no majority of direct lookups")
    for provenance, (low, high) in expected.ranges.items():
        check(low <= provenances.get(provenance, 0) <= high, f"number of {provenance}")
    made = questions.sparkSession.range(1).select(zoned_timestamp(F.lit(manifest.get("generated_at")).cast("string")).isNotNull()).first()[0]
    check(made, "generated_at")
    for name, value in hashes.items():
        check(len(value) == 64 and manifest.get(name) == value, name)
    if sections is not None:
        how = manifest["generator"]
        fresh = regenerated(sections, seed=manifest["seed"], per_act=how["per_act"], stride=how["stride"], excluded=how.get("excluded_citation_ids", ()))
        given = questions.where("provenance = 'corpus_section'").select(*fresh.columns)
        check(row_differences(fresh, given, "id").isEmpty(), "questions made from sections")
    return faults


def load_benchmark(questions: DataFrame, citations: DataFrame, manifest: Mapping[str, Any], hashes: Mapping[str, str], sections: DataFrame | None = None, expected: Expectations = Expectations()) -> DataFrame:  # noqa: B008
    """``questions`` as they are, after every row and the manifest were checked; the first five faults are the error."""
    rows = question_violations(questions, citations, expected.categories, expected.provenances).unionByName(rule_violations(questions, citations))
    found = [f"{r['id']}: {r['violation']}" for r in rows.take(5)]
    require(not found, f"questions with faults: {found}")
    faults = manifest_faults(questions, manifest, hashes, sections, expected)
    require(not faults, f"the manifest doesn't fit: {faults}")
    return questions


def selected(questions: DataFrame, *, act: str | None = None, category: str | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Questions of an act and a category (null lets all pass), and of these the first ``limit`` by ``order``."""
    found = questions
    for column, value in (("act", act), ("category", category)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found if limit is None else found.orderBy(order).limit(limit)
