"""BM25 over DataFrames: an inverted index as tables, published builds, and batch search.

Statistics always cover the whole corpus; filters only choose which documents
are returned.  Queries keep repeated tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import tokenize, tokens_of
from passagework.operators.ranking import top_k
from passagework.operators.validation import require
from passagework.sources.publish import publish_tables, read_published
from passagework.sources.scratch import save_scratch
from passagework.sources.updates import table_digest

# Parameters of the score.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Version of the tables' layout; a build of another version is not read.
INDEX_VERSION = 4
#: Weighted query terms of up to so many rows (about 10 MB) are sent to the postings; more are joined by shuffle.
BROADCAST_TERMS = 100_000
#: With so many different query terms at most, only their lists are read, and not the postings of all documents.
FEW_TERMS = 1_000
#: Documents that are tokenised and handed on at once.
ROWS_AT_ONCE = 500


@dataclass(frozen=True)
class Bm25Index:
    """``postings`` (term, doc_id, tf, dl), ``lengths`` (doc_id, dl), ``terms`` (term, df, idf) and the one-row ``stats`` (n_docs, avgdl, average_idf, n_terms, max_dl).

    In ``postings`` the rows of a document stand together, so that the scores of a batch of queries are summed before they are
    shuffled; a published index has them sorted by term as well (``lists``), so that a few terms are found without a scan.
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame
    lists: DataFrame | None = None


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Bm25Index:
    """Index of all rows; a null text is a document without tokens and counts for the average length.

    The tokens of a text are normalised and counted in one Arrow pass, so postings are never shuffled and a
    document's stay together.  Repeated ids are counted as rows of their own.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                of, terms, tf, dl = [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    counts = Counter(tokens_of(text))
                    n = counts.total()
                    # a row without a term carries the document's length
                    of += [i] * (len(counts) + 1)
                    terms += [None, *counts]
                    tf += [0, *counts.values()]
                    dl += [n] * (len(counts) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], ["term", "doc_id", "tf", "dl"])

    counted = save_scratch(rows.mapInArrow(count, f"term string, doc_id {kind}, tf long, dl long"), "bm25-counted")
    lengths = save_scratch(counted.where("term IS NULL").select("doc_id", "dl"), "bm25-lengths")
    postings = counted.where("term IS NOT NULL")
    sizes = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), F.coalesce(F.max("dl"), F.lit(0)).alias("max_dl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = save_scratch(raw.select("term", "df", "raw"), "bm25-raw")
    means = raw.agg(F.avg("raw").alias("average_idf"), F.count(F.lit(1)).alias("n_terms"))
    stats = save_scratch(sizes.crossJoin(means), "bm25-stats")  # both have one row
    idf = F.when(F.col("raw") < 0, F.col("average_idf") * EPSILON).otherwise(F.col("raw"))
    terms = save_scratch(raw.crossJoin(F.broadcast(stats.select("average_idf"))).select("term", "df", idf.alias("idf")), "bm25-terms")
    return Bm25Index(postings, lengths, terms, stats)


def corpus_build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Build id of an index over ``docs``: it follows from all ids and texts and the layout's version, in whatever order."""
    n, total = docs.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.col(id_col), F.col(text_col)).cast("decimal(38,0)"))).first()
    return f"v{INDEX_VERSION}-{n}-{int(total or 0) % (1 << 64):016x}"


def publish_index(index: Bm25Index, root: str, build_id: str) -> None:
    """Write the index's tables as one build, with digests of their contents, and point ``root`` at it."""
    tables = {"postings": index.postings, "lengths": index.lengths, "terms": index.terms, "stats": index.stats}
    # ranges of term and document, so that a frequent term's list lies in many files
    tables["lists"] = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    publish_tables(tables, root, build_id, {"version": INDEX_VERSION, "digests": {name: table_digest(table) for name, table in tables.items()}})


def load_index(spark: SparkSession, root: str, build_id: str | None = None, *, verify: bool = False) -> Bm25Index:
    """The published index, or the build ``build_id``; fails if its version, row counts or statistics don't fit.

    With ``verify`` all tables are read and compared with the digests of what was published.
    """
    tables, manifest = read_published(spark, root, build_id)
    require(manifest["version"] == INDEX_VERSION, "the index has another version")
    if verify:
        changed = [name for name, table in tables.items() if table_digest(table) != manifest["digests"][name]]
        require(not changed, f"the index is not what was published: {changed}")
    index = Bm25Index(tables["postings"], tables["lengths"], tables["terms"], tables["stats"], tables["lists"])
    stats = index.stats.collect()
    require(len(stats) == 1 and stats[0]["n_docs"] == manifest["rows"]["lengths"] and stats[0]["n_terms"] == manifest["rows"]["terms"], "the index and its statistics don't fit")
    return index


def index_of(docs: DataFrame, root: str, *, snapshot: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Bm25Index:
    """The index of exactly these documents: loaded where ``root`` has its build, else built and published there.

    ``snapshot`` names the documents' state, as ``snapshot_id`` does for files; without one all of them are read to know it.
    """
    build = corpus_build(docs, id_col=id_col, text_col=text_col) if snapshot is None else f"v{INDEX_VERSION}-{snapshot}"
    try:
        return load_index(docs.sparkSession, root, build)
    except FileNotFoundError:
        publish_index(build_index(docs, id_col=id_col, text_col=text_col), root, build)
        return load_index(docs.sparkSession, root, build)


def check_round_trip(built: Bm25Index, loaded: Bm25Index, terms: DataFrame, k: int = 10) -> None:
    """Raises unless both indexes give the same answers to probe queries (``query_id, term, qtf``)."""
    one, two = (search(index, terms, k) for index in (built, loaded))
    differing = one.exceptAll(two).unionByName(two.exceptAll(one))
    require(differing.isEmpty(), "the loaded index answers otherwise than the built one")


def query_terms(queries: DataFrame, *, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """``query_id, term, qtf``: the bag of tokens of each query; a blank query has none."""
    tokens = queries.select(F.col(id_col).alias("query_id"), F.explode(tokenize(F.col(text_col), exact=True)).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def search(index: Bm25Index, terms: DataFrame, k: int, *, eligible: DataFrame | None = None, decimals: int = 6) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the best ``k`` documents that hold a query token.

    ``eligible`` (``doc_id``) restricts what is returned, not the statistics, and is applied before scoring.  Of a published
    index queries with few terms read only these terms' lists; else the postings stay where they are, and their scores
    are summed before they are shuffled.  Scores are rounded before
    ranking, ties go to the smaller id, and scores that are not positive are kept.
    """
    if k < 1:
        raise ValueError("k must be positive")
    weighted = weighted_terms = save_scratch(terms.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "bm25-weighted")
    if weighted.count() <= BROADCAST_TERMS:
        weighted = F.broadcast(weighted)
    postings = index.postings
    if index.lists is not None:
        asked = [r["term"] for r in weighted_terms.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        if len(asked) <= FEW_TERMS:
            postings = index.lists.where(F.col("term").isin(asked))  # reaches the scan, whose row groups hold ranges of terms
    if eligible is not None:
        postings = postings.join(eligible.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = postings.join(weighted, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    tf: Column = F.col("tf")
    part = F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), decimals).alias("score"))
    return top_k(scored.select("query_id", "doc_id", "score"), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def eligible_documents(meta: DataFrame, *, act: str | None = None, section: str | None = None, kind: str | None = None, acts: tuple[str, ...] | None = None) -> DataFrame:
    """``doc_id`` of the rows of ``doc_id, act, section, kind`` that a search may return; a filter that is null lets all pass.

    An act is compared in capitals without white space; one that is not among ``acts`` (by default those of
    ``meta``) is an error.  Numbers of sections are texts, unique within an act only: a section without an act is an
    error.  A blank section or kind lets all pass.
    """
    plain = lambda value: "".join((value or "").split())
    found = meta
    if wanted := plain(act).upper():
        named = F.upper(F.regexp_replace("act", r"\s+", ""))
        known = wanted in {plain(a).upper() for a in acts} if acts is not None else not meta.where(named == wanted).isEmpty()
        require(known, f"unknown act {act!r}")
        found = found.where(named == wanted)
    if wanted := plain(section):
        require(plain(act), "a section needs an act")
        found = found.where(F.col("section").cast("string") == wanted)
    if wanted := plain(kind):
        found = found.where(F.lower("kind") == wanted.lower())
    return found.select("doc_id")
