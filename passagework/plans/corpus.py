"""One corpus as a set of builds that belong together: chunks with their citations, vectors, and the lexical index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.vectors import is_finite, norm
from passagework.operators import bm25
from passagework.operators.rerank import Scorer
from passagework.operators.validation import duplicates, require, require_empty, set_differences
from passagework.plans.answers import NORM_SLACK, Encoder, answer_questions
from passagework.plans.retrieval import hybrid
from passagework.sources.publish import current_build, read_published
from passagework.sources.updates import publish_chained, table_digest, verified_chain


@dataclass(frozen=True)
class Corpus:
    """``chunks``: ``chunk_id, citation_id, act, text`` and more; ``citations``: ``citation_id, act`` and more; ``vectors``: ``chunk_id, embedding``.

    All are of one state: the vectors' build names the chunks' build that it was made from, and the index is a build over it.
    """

    root: str
    build_id: str
    chunks: DataFrame
    citations: DataFrame
    vectors: DataFrame
    index: bm25.Bm25Index

    @classmethod
    def publish(cls, root: str, chunks: DataFrame, citations: DataFrame, vectors: DataFrame) -> Corpus:
        """Write all builds, named by their contents, and load them; publishing what is there already changes nothing."""
        spark = chunks.sparkSession
        one, two = (table_digest(t) for t in (chunks, citations))
        build = f"{one['rows']}-{_short(one['digest'])}-{_short(two['digest'])}"
        publish_chained({"chunks": chunks, "citations": citations}, f"{root}/chunks", build)
        made = f"{build}-{_short(table_digest(vectors)['digest'])}"
        publish_chained({"vectors": vectors}, f"{root}/vectors", made, (f"{root}/chunks", build))
        bm25.index_of(read_published(spark, f"{root}/chunks", build)[0]["chunks"], f"{root}/index", snapshot=build, id_col="chunk_id")
        return cls.load(spark, root)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Corpus:
        """The newest vectors with the chunks and the index that belong to them."""
        tables, manifest = read_published(spark, f"{root}/vectors")
        source = manifest["source"]
        texts, _ = read_published(spark, source["root"], source["build_id"])
        index = bm25.load_index(spark, f"{root}/index", f"v{bm25.INDEX_VERSION}-{source['build_id']}")
        return cls(root, source["build_id"], texts["chunks"], texts["citations"], tables["vectors"], index)

    def check(self) -> dict[str, Any]:
        """Counts by act, after everything was read and held against each other; the first fault is an error.

        Contents against the digests of their builds, unique ids, a citation of the same act for each chunk, one finite vector of
        length 1 for each chunk, and the index' documents.
        """
        spark = self.chunks.sparkSession
        now = current_build(spark, f"{self.root}/vectors")
        verified_chain(spark, f"{self.root}/vectors", now[1])
        bm25.load_index(spark, f"{self.root}/index", f"v{bm25.INDEX_VERSION}-{self.build_id}", verify=True)
        require_empty(duplicates(self.chunks, ["chunk_id"]), "chunk ids that are not unique")
        require_empty(duplicates(self.citations, ["citation_id"]), "citation ids that are not unique")
        named = self.citations.select("citation_id", F.col("act").alias("_act"))
        require_empty(self.chunks.join(named, "citation_id", "left").where(~F.col("act").eqNullSafe(F.col("_act"))).select("chunk_id"), "chunks without a citation of their act")
        require_empty(set_differences(self.chunks, self.vectors, ["chunk_id"]), "chunks and vectors differ")
        require_empty(duplicates(self.vectors, ["chunk_id"]), "vectors that are not unique")
        good = F.coalesce(is_finite(F.col("embedding")) & (F.abs(norm(F.col("embedding")) - 1) <= NORM_SLACK), F.lit(False))
        require_empty(self.vectors.where(~good).select("chunk_id"), "vectors that are not finite or not of length 1")
        require_empty(set_differences(self.chunks, self.index.lengths.withColumnRenamed("doc_id", "chunk_id"), ["chunk_id"]), "chunks and the index differ")
        by_act = {r["act"]: r["n"] for r in self.chunks.groupBy("act").agg(F.count(F.lit(1)).alias("n")).collect()}
        require(sum(by_act.values()) > 0, "the corpus is empty")
        return {"status": "passed", "build_id": self.build_id, "count": sum(by_act.values()), "counts_by_act": by_act}

    def _eligible(self, act: str | None) -> DataFrame | None:
        if act is None:
            return None
        meta = self.chunks.select(F.col("chunk_id").alias("doc_id"), "act", F.lit("").alias("section"), F.lit("").alias("kind"))
        return bm25.eligible_documents(meta, act=act)

    def _by_doc(self) -> DataFrame:
        return self.vectors.withColumnRenamed("chunk_id", "vec_id")

    def search(self, questions: DataFrame, query_vectors: DataFrame, k: int, *, act: str | None = None, cut: int | None = None) -> DataFrame:
        """Fused ranks of chunks for ``questions`` (``query_id, text``) and their vectors (``query_id, embedding``)."""
        return hybrid(self.index, bm25.query_terms(questions), self._by_doc(), query_vectors, k, cut=cut, eligible=self._eligible(act))

    def answer(self, questions: DataFrame, encode: Encoder, scorer: Scorer, step: Callable[[Column, Column], Column], *, k: int = 3, act: str | None = None) -> DataFrame:
        """Answers with checked citations (see ``answers_from_hits``); a citation is known if the corpus has it."""
        passages = self.chunks.select(F.col("chunk_id").alias("doc_id"), "citation_id", "text")
        return answer_questions(questions, self.index, self._by_doc(), passages, encode, scorer, step, k=k, known=self.citations.select("citation_id"), eligible=self._eligible(act))


def _short(digest: str) -> str:
    """Twelve hex digits of a digest's sums."""
    return f"{sum(abs(int(part)) * (i + 1) for i, part in enumerate(digest.split(':'))) % (1 << 48):012x}"


def citation_view(hits: DataFrame, fields: tuple[str, ...] = ("citation_id", "act", "header", "chunk_id")) -> Column:
    """Struct of the fields of a citation that ``hits`` has; those it lacks are null, and further columns don't count."""
    return F.struct(*((F.col(f) if f in hits.columns else F.lit(None).cast("string")).alias(f) for f in fields))
