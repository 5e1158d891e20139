"""Folds and bounded fit samples shared by the trained operators."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.sources.scratch import save_scratch


def fold(doc_id: Column, n_folds: int) -> Column:
    """crc32 of the id written as text, modulo ``n_folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n_folds


def allowed_labels(labels: DataFrame, label: str, *, held_out: int, n_folds: int) -> DataFrame:
    """``doc_id, label`` of all documents outside the fold ``held_out``.

    Labels and ids that are null are skipped; of several labels of one document the mean decides, and one exactly
    between is skipped.
    """
    mean = F.avg(label).alias("mean")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), n_folds) != held_out))
    return known.groupBy("doc_id").agg(mean).where(F.col("mean") != 0.5).select("doc_id", (F.col("mean") > 0.5).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, held_out: int, n_folds: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``per_class`` labelled documents of either class, as a written table.

    Of the labels that ``allowed_labels`` gives those with the smallest id hashes are taken, so the sample doesn't
    depend on partitioning.  Their ids (at most twice ``per_class``) are what is sent to the scan of the texts.
    Of rows with one id the smallest text that isn't null counts, so the sample stays bounded; a document
    whose texts are all null has an empty text.
    """
    marked = allowed_labels(labels, label, held_out=held_out, n_folds=n_folds).withColumn("order", F.xxhash64("doc_id"))
    one = [marked.where(F.col("label") == c).orderBy("order", "doc_id").limit(per_class) for c in (0, 1)]
    ids = save_scratch(one[0].unionByName(one[1]).select("doc_id", "label"), "sample-ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return save_scratch(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label"), "sample")


def give_back() -> None:
    """Return what a finished task held to the system; workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one, it decides itself
        ctypes.CDLL(None).malloc_trim(0)


def chunked(texts: list[str | None], max_chars: int = 4_000_000):
    """Runs of ``texts`` of about ``max_chars`` characters, so that arrays over characters stay small."""
    run: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if run and held + len(text) > max_chars:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run
