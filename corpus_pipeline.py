"""Corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage works on all rows that the stage before it kept; what a stage
returns is written as Parquet and read back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.near_duplicates import near_duplicates
from passagework.llm.packing import pack_documents
from passagework.llm.quality_crf import quality_score, train_quality
from passagework.llm.queries import GOOD_FROM, HELD_OUT, N_FOLDS, TOXIC_FROM, WORD_TOKENIZER
from passagework.llm.toxicity_mil import toxicity, train_toxicity
from passagework.sources.scratch import save_scratch
from passagework.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject.

    Each row is judged by its own text, so repeated rows and rows with equal or null ids stay or go alike.  Null,
    empty and blank texts are judged by the labels of such texts.  Very long texts are judged whole.  An empty table
    gives an empty one, extra columns are kept as they are, and ties of the score with the limit stay.
    """
    model = train_quality(docs, read_table(spark, sf_dir, "labels"), held_out=HELD_OUT, n_folds=N_FOLDS)
    return docs.where(quality_score(model, F.col("text")) >= GOOD_FROM)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic.

    Each row is judged by its own text, so repeated rows and rows with equal or null ids stay or go alike.  Texts
    without words, null ones among them, are clean.  Very long texts are judged whole.  An empty table gives an
    empty one, extra columns are kept as they are, and ties of the score with the limit go.
    """
    model = train_toxicity(docs, read_table(spark, sf_dir, "labels"), held_out=HELD_OUT, n_folds=N_FOLDS)
    return docs.where(toxicity(model, F.col("text"), TOXIC_FROM)["score"] < TOXIC_FROM)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; five-word shingles, similarity 0.8.

    The row with the smallest id of a group stays; rows without an id come after all others.  Of rows with equal ids
    and equal texts one is left, and so it is of rows without an id that have equal texts.  Rows with equal ids and
    different texts are documents of their own.  Texts without words, null ones among them, are like no other, so
    they stay, but a repeated row with an id is left once.  Very long texts are compared whole, an empty table gives
    an empty one, and extra columns are kept as they are.
    """
    by_id = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if by_id.isEmpty():  # each row is named by its id alone
        copies = near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id")
        return docs.join(save_scratch(copies, "pipeline-copies"), "doc_id", "left_anti").select(*docs.columns)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    # a byte that puts rows without an id last, the id in the order of its value, and what tells its texts apart
    order = F.unhex(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    named = F.concat(F.unhex(F.lit("00")), order, F.substring(digest, 1, 16))
    nameless = F.when(text.rlike(r"[^\x20\x09-\x0d]"), F.concat(F.unhex(F.lit("01")), digest))
    keyed = docs.withColumn(KEY, F.when(F.col("doc_id").isNotNull(), named).otherwise(nameless))
    copies = near_duplicates(keyed, words=5, percent=80, id_col=KEY).where("NOT kept").select(F.col("doc_id").alias(KEY)).distinct()
    left = keyed.join(save_scratch(copies, "pipeline-copies"), KEY, "left_anti")
    repeated = keyed.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(KEY)
    repeated = save_scratch(repeated, "pipeline-repeated")
    once = left.join(repeated, KEY, "left_anti").unionByName(left.join(repeated, KEY, "left_semi").dropDuplicates([KEY]))
    return once.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, each with its sequence and offset.

    Null and empty texts are a piece of the end token alone, and a very long text is cut into full sequences.
    Repeated rows and rows with equal or null ids are packed each.  Ties of length are dealt by id.  An empty table
    gives no pieces, and extra columns are left out.
    """
    return pack_documents(docs, WORD_TOKENIZER)


#: Column that tells rows apart within the near-duplicate stage.
KEY = "_document_key"

STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", distinct), ("packing", packed)]

#: The classifiers and the packer can't be written in SQL.  The tests hold the operators of the stages against plain Python
#: (marginals, fit and score of the classifiers, all pairs of texts, token ids) and the stages against their operators.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save_scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
