"""All registered queries of the library, by name, with SQL for each; importing it registers those of the other modules."""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import hashing, text, vectors
from passagework.operators import analytics, bm25, chunking, dense, metrics, ordered, quota, structure, verify
from passagework.operators.ranking import percentiles
from passagework.operators.rerank import overlap_scorer
from passagework.operators.sampling import strided_sample
from passagework.plans import report_queries, retrieval, tree_queries  # noqa: F401
from passagework.plans.catalog import ORACLE_SQL, QUERIES, query
from passagework.sources.publish import snapshot_id
from passagework.sources.scratch import save_scratch, scratch_root
from passagework.sources.tables import read_table

TOP_K = 10
AS_OF = "2024-01-15 00:00:00"
EVENT_TYPES = ("click", "login", "purchase", "search", "view")


# --- lexical search -------------------------------------------------------------------------------------------

#: Tokens of ``t.text``: words, and the prefixes of references such as 359(1)(a).  Of what case folding changes beyond
#: lower case, the tables hold the sharp s only, and nothing that NFKC changes.
SQL_TOKENS = r"""list_concat(
    regexp_extract_all(replace(translate(lower(t.text), '’‘', ''''''), 'ß', 'ss'), '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*'),
    flatten(list_transform(regexp_extract_all(replace(translate(lower(t.text), '’‘', ''''''), 'ß', 'ss'), '\b\d+[a-z]?(?:\s*\(\s*[0-9a-z]+\s*\))+'),
      lambda r: list_transform(range(1, len(regexp_extract_all(regexp_replace(r, '\s+', '', 'g'), '\([^()]+\)')) + 1),
        lambda n: split_part(regexp_replace(r, '\s+', '', 'g'), '(', 1) || array_to_string(regexp_extract_all(regexp_replace(r, '\s+', '', 'g'), '\([^()]+\)')[1:n], '')))))"""

SQL_BM25 = f"""
  tok AS (SELECT t.doc_id, {SQL_TOKENS} AS toks FROM documents t),
  dl AS (SELECT doc_id, len(toks) AS dl FROM tok),
  post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY term, doc_id),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  raw AS (SELECT term, count(*) AS df, ln(any_value(st.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
  idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT t.item_id AS query_id, unnest({SQL_TOKENS}) AS term FROM benchmark t) GROUP BY query_id, term),
  scored AS (
    SELECT q.query_id, p.doc_id, round(sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * d.dl / st.avgdl))), 6) AS score
    FROM q JOIN idf i USING (term) JOIN post p USING (term) JOIN dl d USING (doc_id), st GROUP BY q.query_id, p.doc_id)"""


def _index(spark: SparkSession, sf_dir: str) -> bm25.Bm25Index:
    """The published index of the documents; the first query over a corpus builds it."""
    path = f"{sf_dir}/documents.parquet"
    name = hashlib.blake2b(path.encode(), digest_size=8).hexdigest()  # a root for each corpus, so that builds of one don't move another's pointer
    return bm25.index_of(read_table(spark, sf_dir, "documents"), f"{scratch_root(spark)}/bm25-{name}", snapshot=snapshot_id(spark, path))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")


@query("bm25_batch", f"""WITH {SQL_BM25}
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {TOP_K}""")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents for every benchmark text."""
    return bm25.search(_index(spark, sf_dir), bm25.query_terms(_questions(spark, sf_dir)), TOP_K)


@query("bm25_filtered", f"""WITH {SQL_BM25}
SELECT query_id, doc_id, score, rank FROM (
  SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored s JOIN documents d USING (doc_id) WHERE d.lang = 'fr') WHERE rank <= {TOP_K}""")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among French documents, by the statistics of all."""
    meta = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("act"), F.lit("").alias("section"), F.col("source").alias("kind"))
    return bm25.search(_index(spark, sf_dir), bm25.query_terms(_questions(spark, sf_dir)), TOP_K, eligible=bm25.eligible_documents(meta, act=" Fr"))


@query("corpus_stats", f"""WITH {SQL_BM25}
SELECT (SELECT n FROM st) AS n_docs, round((SELECT avgdl FROM st), 2) AS avg_terms, (SELECT max(dl) FROM dl) AS max_terms, (SELECT count(*) FROM idf) AS vocabulary""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the corpus in documents, terms and distinct terms."""
    return _index(spark, sf_dir).stats.select("n_docs", F.round("avgdl", 2).alias("avg_terms"), F.col("max_dl").alias("max_terms"), F.col("n_terms").alias("vocabulary"))


# --- vectors --------------------------------------------------------------------------------------------------

SQL_KNN = """
  v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  pairs AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS query_label, v.label, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
            FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"""
SQL_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank"


def _vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries every one whose id is divisible by 20."""
    table = read_table(spark, sf_dir, "embeddings")
    return table, table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


def _neighbours(spark: SparkSession, sf_dir: str, k: int, filters: tuple[str, ...] = ()) -> DataFrame:
    return dense.nearest(*_vector_queries(spark, sf_dir), k, filters=filters)


@query("dense_knn", f"WITH {SQL_KNN} SELECT query_id, vec_id, score, rank FROM (SELECT *, {SQL_RANKED} FROM pairs) WHERE rank <= {TOP_K}")
def dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, TOP_K)


@query("dense_knn_filtered", f"WITH {SQL_KNN} SELECT query_id, vec_id, score, rank FROM (SELECT *, {SQL_RANKED} FROM pairs WHERE label = query_label) WHERE rank <= {TOP_K}")
def dense_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among vectors of the query's label only; the filter comes before the cut."""
    return _neighbours(spark, sf_dir, TOP_K, ("label",))


@query("vector_norm_check", """SELECT label, count(*) AS n, count(*) FILTER (WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-5) AS n_unit,
  count(*) FILTER (WHERE len(embedding) = 64) AS n_dim FROM embeddings GROUP BY label""")
def vector_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return table.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(vectors.is_unit(F.col("embedding"))).alias("n_unit"), F.count_if(F.size("embedding") == 64).alias("n_dim"))


SQL_HYBRID = f"""{SQL_BM25},
  v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  near AS (SELECT b.item_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
           FROM benchmark b JOIN v q ON q.vec_id = b.item_id, v),
  hits AS (
    SELECT query_id, doc_id, 'dense' AS source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near
    UNION ALL SELECT query_id, doc_id, 'sparse', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM scored),
  fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(rank) FILTER (WHERE source = 'dense') AS dense_rank, min(rank) FILTER (WHERE source = 'sparse') AS sparse_rank
            FROM hits WHERE rank <= 20 GROUP BY query_id, doc_id)"""


def _hybrid(spark: SparkSession, sf_dir: str, k: int, cut: int | None = None) -> DataFrame:
    """Benchmark texts by words, and the vectors of the same ids by cosine; documents and vectors share ids."""
    asked = _questions(spark, sf_dir)
    table = read_table(spark, sf_dir, "embeddings")
    by_vector = table.withColumnRenamed("vec_id", "query_id").join(asked.select("query_id"), "query_id")
    return retrieval.hybrid(_index(spark, sf_dir), bm25.query_terms(asked), table, by_vector, k, cut=cut)


@query("rrf_hybrid", f"""WITH {SQL_HYBRID}
SELECT query_id, doc_id, rrf_score, dense_rank, sparse_rank, concat_ws(',', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN sparse_rank IS NOT NULL THEN 'sparse' END) AS sources, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM fused) WHERE rank <= {TOP_K}""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, TOP_K)


@query("compress_extractive")
def compress_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid hits reranked and reduced to their relevant sentences."""
    fused = _hybrid(spark, sf_dir, TOP_K, cut=40)
    hits = retrieval.retrieve(fused, _questions(spark, sf_dir), read_table(spark, sf_dir, "documents"), 3, overlap_scorer())
    return hits.select("query_id", "doc_id", "rank", "rerank_score", "compression_mode", "low_confidence", F.size("spans").alias("n_spans"), "compressed_text")


# --- evaluation -----------------------------------------------------------------------------------------------

SQL_METRICS = f"""{SQL_KNN},
  hit AS (SELECT query_id, vec_id, query_label = label AS good, {SQL_RANKED} FROM pairs),
  gold AS (SELECT q.vec_id AS query_id, q.label, count(*) - 1 AS n FROM v q JOIN v o ON q.label = o.label WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, q.label),
  m AS (SELECT h.query_id, any_value(g.label) AS label, k, round(count(*) FILTER (WHERE good AND rank <= k) / k, 6) AS precision, round(count(*) FILTER (WHERE good AND rank <= k) / greatest(any_value(g.n), 1), 6) AS recall
        FROM hit h JOIN gold g USING (query_id), (VALUES (1), (3), (5), (10)) t(k) GROUP BY h.query_id, k)"""


def _ranked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a query's label are its gold."""
    table, asked = _vector_queries(spark, sf_dir)
    hits = dense.nearest(table, asked, max(metrics.K_VALUES)).select("query_id", F.col("vec_id").alias("id"), "rank")
    gold = asked.select("query_id", "label").join(table.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id <> id").select("query_id", "id")
    return metrics.ranked_metrics(hits, gold)


@query("precision_recall_at_k", f"WITH {SQL_METRICS} SELECT query_id, k, precision, recall FROM m")
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_metrics(spark, sf_dir)


@query("eval_report", f"""WITH {SQL_METRICS}, r AS (SELECT m.query_id, m.precision, m.recall, m.k::VARCHAR AS k, m.label::VARCHAR AS category, ((m.query_id // 20) % 2 = 1)::VARCHAR AS needs_review FROM m)
SELECT CASE WHEN grouping(k) = 0 THEN 'k' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(needs_review) = 0 THEN 'needs_review' ELSE 'all' END AS breakdown,
  coalesce(k, category, needs_review, 'all') AS value, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall
FROM r GROUP BY GROUPING SETS ((), (k), (category), (needs_review))""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro means by cut-off, label and review flag."""
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    rows = _ranked_metrics(spark, sf_dir).join(labels, "query_id").withColumn("needs_review", F.floor(F.col("query_id") / 20) % 2 == 1)
    return metrics.report(rows, ["precision", "recall"], ["k", "category", "needs_review"])


@query("grounded_citations", f"WITH {SQL_KNN}, hit AS (SELECT query_id, vec_id, {SQL_RANKED} FROM pairs), near AS (SELECT query_id, vec_id, {SQL_RANKED} FROM pairs WHERE label = query_label) SELECT query_id, vec_id FROM hit WHERE rank <= 10 AND EXISTS (SELECT 1 FROM near n WHERE n.query_id = hit.query_id AND n.vec_id = hit.vec_id AND n.rank <= 5)")
def grounded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query's ten nearest vectors, taken as cited, those among the five nearest of its label, taken as retrieved."""
    return verify.grounded(_neighbours(spark, sf_dir, 10).select("query_id", "vec_id"), _neighbours(spark, sf_dir, 5, ("label",)), ["query_id", "vec_id"])


@query("hallucinated_citations", f"WITH {SQL_KNN}, hit AS (SELECT query_id, vec_id, {SQL_RANKED} FROM pairs), near AS (SELECT query_id, vec_id, {SQL_RANKED} FROM pairs WHERE label = query_label) SELECT query_id, vec_id FROM hit WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.query_id = hit.query_id AND n.vec_id = hit.vec_id AND n.rank <= 5)")
def hallucinated_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.hallucinated(_neighbours(spark, sf_dir, 10).select("query_id", "vec_id"), _neighbours(spark, sf_dir, 5, ("label",)), ["query_id", "vec_id"])


@query("grounding_ratio", f"WITH {SQL_KNN}, hit AS (SELECT query_id, vec_id, {SQL_RANKED} FROM pairs), near AS (SELECT query_id, vec_id, {SQL_RANKED} FROM pairs WHERE label = query_label) SELECT h.query_id, count(*) AS n_cited, count(n.vec_id) AS n_grounded, count(n.vec_id) / count(*) AS grounding_ratio FROM hit h LEFT JOIN near n ON n.query_id = h.query_id AND n.vec_id = h.vec_id AND n.rank <= 5 WHERE h.rank <= 10 GROUP BY h.query_id")
def grounding_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.grounding_summary(_neighbours(spark, sf_dir, 10), _neighbours(spark, sf_dir, 5, ("label",)), ["query_id"], "vec_id")


# --- usage ----------------------------------------------------------------------------------------------------


@query("latency_percentiles", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = percentiles(read_table(spark, sf_dir, "events"), ["event_type"], "value", [50, 95, 99])
    return found.select("event_type", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("status"), F.col("value").alias("latency_ms"))


@query("usage_summary", f"""SELECT user_id, count(*) AS total_queries, {', '.join(f"count(*) FILTER (WHERE event_type = '{s}') AS n_{s}" for s in EVENT_TYPES)},
  count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}') AS queries_last_24h, round(avg(value), 6) AS avg_latency_ms,
  min(ts) AS first_query_at, max(ts) AS last_query_at, round(quantile_cont(value, 0.5), 6) AS p50_latency_ms FROM events GROUP BY user_id""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.usage_summary(_audit(spark, sf_dir), "user_id", F.lit(AS_OF).cast(dict(_audit(spark, sf_dir).dtypes)["created_at"]), EVENT_TYPES)


@query("history_latest", "SELECT * FROM (SELECT event_id AS id, ts AS created_at, user_id, event_type AS status, value AS latency_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 50")
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.history(_audit(spark, sf_dir), "user_id")


@query("quota_decisions", """WITH RECURSIVE a AS (
  SELECT user_id, min(ts) AS anchor FROM events GROUP BY user_id
  UNION ALL SELECT a.user_id, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.anchor + INTERVAL 1 HOUR GROUP BY a.user_id, a.anchor
), w AS (
  SELECT e.user_id, e.event_id, e.ts, max(a.anchor) AS anchor FROM events e JOIN a ON a.user_id = e.user_id AND a.anchor <= e.ts GROUP BY e.user_id, e.event_id, e.ts
), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, anchor ORDER BY ts, event_id) AS request_no FROM w)
SELECT user_id, event_id, ts, request_no, request_no <= 2 AS allowed,
  CASE WHEN request_no > 2 THEN ceil((epoch_us(anchor) + 3600000000 - epoch_us(ts)) / 1000000)::BIGINT END AS retry_after FROM n""")
def quota_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests an hour for each user."""
    return quota.quota_decisions(read_table(spark, sf_dir, "events"), 2)


# --- lookups and counts ---------------------------------------------------------------------------------------


@query("acts_counts", "SELECT lang AS act, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def acts_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("act")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("section_lookup", "SELECT q.item_id, d.doc_id, d.lang, d.text FROM benchmark q JOIN documents d ON d.doc_id = q.item_id AND upper(trim(d.lang)) = 'EN'")
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by act and number, for every benchmark item; an id without such a document has no row."""
    docs = read_table(spark, sf_dir, "documents").where(F.upper(F.trim("lang")) == "EN")
    return read_table(spark, sf_dir, "benchmark").select("item_id").join(docs, F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", "lang", "text")


@query("first_seen_dedupe", """WITH f AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events)
SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM f WHERE nth = 1""")
def first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = verify.first_seen(read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], "event_type", ["ts", "event_id"])
    return kept.select("user_id", "event_type", "event_id", "position")


@query("dedupe_normalized", r"""WITH k AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS key FROM documents)
SELECT sha256(key) AS key, min(doc_id) AS doc_id, count(*) AS n FROM k GROUP BY key""")
def dedupe_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(text.normalize_whitespace(F.col("text")), 256).alias("key")
    return read_table(spark, sf_dir, "documents").groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


# --- passages -------------------------------------------------------------------------------------------------


@query("sentence_spans", r"""WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s+[A-Z0-9“"''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i, p FROM m),
s AS (SELECT doc_id, i, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS sentence,
  coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS char_start FROM u)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INTEGER - 1 AS sentence_no, sentence, char_start::INTEGER AS char_start, (char_start + length(sentence))::INTEGER AS char_end FROM s WHERE sentence <> ''""")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentence_spans(F.col("text"))).alias("sentence_no", "s"))
    return spans.select("doc_id", "sentence_no", F.col("s.text").alias("sentence"), "s.char_start", "s.char_end")


CHUNK_WORDS = 200
SQL_CHUNKS = rf"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT doc_id, words, unnest(range(0, ((len(words) + {CHUNK_WORDS - 1}) // {CHUNK_WORDS})::BIGINT)) AS i FROM w WHERE len(words) > 0),
chunks AS (SELECT doc_id, i::INTEGER AS fragment_index, ((len(words) + {CHUNK_WORDS - 1}) // {CHUNK_WORDS})::INTEGER AS fragment_count,
  len(words[i * {CHUNK_WORDS} + 1:(i + 1) * {CHUNK_WORDS}])::INTEGER AS n_words, array_to_string(words[i * {CHUNK_WORDS} + 1:(i + 1) * {CHUNK_WORDS}], ' ') AS text FROM c)"""


@query("token_chunks", f"WITH {SQL_CHUNKS} SELECT * FROM chunks")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.word_chunks(read_table(spark, sf_dir, "documents"), CHUNK_WORDS)


@query("passage_chunks")
def passage_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages within the token limit, at paragraph and sentence breaks, that tile their documents."""
    return chunking.chunk_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("chunk_ids", f"""WITH {SQL_CHUNKS} SELECT doc_id, fragment_index, 'chunk-' || substr(sha256('{{"doc_id":' || doc_id || ',"fragment_index":' || fragment_index || ',"text":' || to_json(text) || '}}'), 1, 24) AS chunk_id,
  lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS point_id
FROM (SELECT *, sha1(unhex('{hashing.POINT_NAMESPACE}') || encode(doc_id || '/' || fragment_index)) AS h FROM chunks)""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-derived ids of passages, and the points that they are stored under."""
    chunks = token_chunks(spark, sf_dir)
    name = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("fragment_index").cast("string"))
    return chunks.select("doc_id", "fragment_index", hashing.chunk_id({c: F.col(c) for c in ("doc_id", "fragment_index", "text")}).alias("chunk_id"), hashing.uuid5(name).alias("point_id"))


@query("build_id", """SELECT lang, substr(sha256(concat_ws('|', 'v1', lang, count(*), sum(n_chars)::BIGINT, min(sha256(text)), max(sha256(text)))), 1, 12) AS build_id FROM documents GROUP BY lang""")
def build_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short id per language that changes with its texts."""
    digest = F.sha2("text", 256)
    parts = read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"), F.min(digest).alias("a"), F.max(digest).alias("z"))
    return parts.select("lang", hashing.build_id(F.lit("v1"), F.col("lang"), F.col("n"), F.col("c"), F.col("a"), F.col("z")).alias("build_id"))


@query("coverage_check", f"""WITH {SQL_CHUNKS}, p AS (SELECT doc_id, coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY fragment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, n_words, fragment_index, fragment_count FROM chunks),
t AS (SELECT doc_id, max(a + n_words) AS covered, count(*) AS n, max(fragment_count) AS c FROM p GROUP BY doc_id)
SELECT w.doc_id, t.n AS n_chunks, t.covered::BIGINT AS covered, (t.covered = len(w.words) AND t.n = t.c) AS whole FROM t JOIN w USING (doc_id)""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the passages of each document tile its words."""
    docs = read_table(spark, sf_dir, "documents")
    size = docs.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n_total"))
    chunks = chunking.word_chunks(docs, CHUNK_WORDS).withColumn("char_start", F.col("fragment_index") * CHUNK_WORDS)
    spans = chunks.select("doc_id", "n_words", "char_start", (F.col("char_start") + F.col("n_words")).alias("char_end")).join(size, "doc_id")
    spans = save_scratch(spans, "spans")
    faults = structure.coverage_faults(spans, ["doc_id"], "n_total")
    totals = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_words").alias("covered"))
    return totals.join(faults, "doc_id", "left").select("doc_id", "n_chunks", "covered", F.col("fault").isNull().alias("whole"))


# --- ordered structure ----------------------------------------------------------------------------------------


@query("paragraph_segments", """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)
SELECT user_id, run::BIGINT AS run, count(*) AS n, min(ts) AS starts_at, max(ts) AS ends_at FROM r GROUP BY user_id, run""")
def paragraph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a user's events without a gap of over six hours."""
    cut = structure.gap_runs(read_table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"], F.expr("INTERVAL 6 HOURS"))
    return cut.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("starts_at"), F.max("ts").alias("ends_at"))


@query("asof_lookup", """WITH p AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, p.purchase_id FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's latest purchase up to then."""
    events = read_table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return structure.as_of(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["purchase_id"]).drop("ts")


SQL_INTERVALS = """i AS (SELECT user_id, epoch_us(ts)::BIGINT AS s, (epoch_us(ts) + 14400000000 * (1 + event_id % 5))::BIGINT AS e FROM events),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM r),
merged AS (SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM g GROUP BY user_id, run)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = read_table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.lit(14_400_000_000) * (1 + F.col("event_id") % 5)).alias("end"))
    return structure.merge_intervals(rows, ["user_id"])


@query("interval_merge", f"WITH {SQL_INTERVALS} SELECT * FROM merged")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that follow each event, as disjoint intervals per user."""
    return _merged(spark, sf_dir)


@query("interval_gaps", f"""WITH {SQL_INTERVALS}, n AS (SELECT user_id, "end" AS s, lead("start") OVER (PARTITION BY user_id ORDER BY "start") AS e FROM merged) SELECT user_id, s AS "start", e AS "end" FROM n WHERE e IS NOT NULL""")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.interval_gaps(_merged(spark, sf_dir), ["user_id"])


@query("sequence_gaps", """WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + 1, 1) AS expected FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, expected::BIGINT AS expected FROM l WHERE l_linenumber <> expected""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose number doesn't follow the one before."""
    found = structure.sequence_gaps(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_linenumber", "l_partkey", "l_suppkey"])
    return found.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("expected").cast("long").alias("expected"))


SAMPLE = {"seed": 17, "stride": 7919, "per_group": 5}


@query("strided_sample", """WITH p AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS nth, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_mktsegment, i::INTEGER AS sample_index, c_custkey FROM p, range(0, 5) t(i) WHERE nth = (17 + i * 7919) % n""")
def strided_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five customers of each segment, spread over its pool."""
    pool = read_table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return strided_sample(pool, ["c_mktsegment"], "c_custkey", **SAMPLE).select("c_mktsegment", "sample_index", "c_custkey")


@query("multiset_equal", """WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS following FROM conversations)
SELECT conv_id, turn, list_sort(string_split(text, '')) = list_sort(string_split(following, '')) AS same_characters FROM n WHERE following IS NOT NULL""")
def multiset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn holds the same characters as the next."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = ordered.with_previous(turns, ["conv_id"], ["turn", "role", "text"], ["turn", "text"]).where("before IS NOT NULL AND text IS NOT NULL")
    return pairs.select("conv_id", "before.turn", text.same_characters(F.col("before.text"), F.col("text")).alias("same_characters"))


@query("json_props", "SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS n_k, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read_table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("p.k").alias("n_k"), F.sum("p.k").alias("sum_k"))


SQL_EDGES = """SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"""


@query("tree_descendants", f"""WITH RECURSIVE e AS ({SQL_EDGES}), d AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM e UNION ALL SELECT d.ancestor, e.child, d.depth + 1 FROM d JOIN e ON d.descendant = e.parent)
SELECT ancestor, count(*) AS n, max(depth)::INTEGER AS depth FROM d GROUP BY ancestor""")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of regions and nations down to customers and suppliers."""
    key = lambda mark, column: F.concat(F.lit(mark), F.col(column).cast("string"))
    read = partial(read_table, spark, sf_dir)
    edges = read("nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"))
    edges = edges.unionByName(read("supplier").select(key("n", "s_nationkey").alias("parent"), key("s", "s_suppkey").alias("child")))
    edges = edges.unionByName(read("customer").select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("child")))
    return structure.descendants(edges).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))


@query("bbox_per_group", "SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey")
def bbox_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.bounding_boxes(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice", "l_quantity", "l_extendedprice")
