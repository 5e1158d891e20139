"""Queries of the training-data operators, by name, with SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.conversation_repair import damaged, repair_conversations, turns_sha256
from passagework.llm.embedding_dups import embedding_duplicates
from passagework.llm.fill_in_middle import fill_in_middle, restored_sha256
from passagework.llm.html_extraction import extract_pages
from passagework.llm.image_copies import image_copies, media_from_embeddings
from passagework.llm.language_id import predict_language, train_language_id
from passagework.llm.near_duplicates import near_duplicates
from passagework.llm.packing import pack_documents
from passagework.llm.piece_codec import encoded_and_decoded
from passagework.llm.quality_crf import quality_score, train_quality
from passagework.llm.sampling import fold
from passagework.llm.sharding import shard_documents
from passagework.llm.toxicity_mil import toxicity, train_toxicity
from passagework.llm.url_filter import UrlRule, filter_urls
from passagework.sources.scratch import scratch_root
from passagework.sources.tables import read_table

#: Rules of the URL query: verdict and host with path prefix.
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
N_SHARDS = 16
#: Labelled documents of this fold are never learned from.
N_FOLDS, HELD_OUT = 5, 0
#: A document is good, or toxic, from this score on.
GOOD_FROM, TOXIC_FROM = 0.3, 0.5
#: Folds of the language query.
LANG_FOLDS, LANG_HELD_OUT = 4, 2
#: Vocabulary files of public tokenizers, installed on every machine.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _held_out(n_folds: int, held_out: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), n_folds) == held_out, F.lit(False)).alias("held_out")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules above."""
    pages = read_table(spark, sf_dir, "pages")
    judged = filter_urls(pages, [UrlRule.parse(*r) for r in URL_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS nth
  FROM part p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE nth = 1
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train_quality(docs, labels, held_out=HELD_OUT, n_folds=N_FOLDS)
    scored = docs.select("doc_id", _held_out(N_FOLDS, HELD_OUT), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and where its offending sentences are."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels, held_out=HELD_OUT, n_folds=N_FOLDS)
    scored = docs.select("doc_id", _held_out(N_FOLDS, HELD_OUT), toxicity(model, F.col("text"), TOXIC_FROM).alias("found"))
    return scored.select(
        "doc_id", "held_out", F.col("found.score").alias("score"), (F.col("found.score") >= TOXIC_FROM).cast("int").alias("predicted"), F.col("found.spans").alias("spans")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; the map is stored by the input's path in the shared folder."""
    name = hashlib.blake2b(sf_dir.encode(), digest_size=8).hexdigest()
    return shard_documents(read_table(spark, sf_dir, "documents"), N_SHARDS, map_path=f"{scratch_root(spark)}/shard-map-{name}")


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies among images drawn from all embeddings, with crops and edits of every tenth."""
    return image_copies(media_from_embeddings(read_table(spark, sf_dir, "embeddings")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose sets of four-word shingles are alike to 80 percent."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = train_language_id(docs, n_folds=LANG_FOLDS, held_out=LANG_HELD_OUT)
    found = docs.select("doc_id", _held_out(LANG_FOLDS, LANG_HELD_OUT), predict_language(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all embeddings of one label with cosines of 0.98 and more."""
    return embedding_duplicates(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into pieces and decoded again, as digests."""
    docs = read_table(spark, sf_dir, "documents")
    return encoded_and_decoded(docs, PIECE_MODEL).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and arranged for filling in the middle, with digests of the result and of the text restored from it."""
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored_sha256("output", "form").alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, [('0x' || substr(h, 8 * i - 7, 8))::BIGINT FOR i IN range(1, 5)] AS h FROM d),
p AS (
  SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1, n - b) || '<M>' || substr(t, a + 1, b - a)
                      ELSE '<S>' || substr(t, b + 1, n - b) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS o FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    rows = read_table(spark, sf_dir, "conversations")
    repair = repair_conversations(damaged(rows))
    found = repair.conversations.join(turns_sha256(repair.turns).withColumnRenamed("conv_id", "same_id"), F.col("conv_id").eqNullSafe(F.col("same_id"))).drop("same_id")
    none = rows.select("conv_id").distinct()
    both = none.withColumnRenamed("conv_id", "original").join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.select(
        F.col("original").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


#: Components of the links ``l (a, b)`` of ``v (id)`` by all paths; groups are small on the tables that SQL is run on.
SQL_COMPONENTS = """
reach AS (
  SELECT a AS x, b AS y FROM both_ways
  UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a
), component AS (SELECT v.id, least(v.id, coalesce(min(r.y), v.id)) AS component_id FROM v LEFT JOIN reach r ON r.x = v.id GROUP BY v.id)"""

OP6_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
v AS (SELECT doc_id AS id FROM documents), {SQL_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, k.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN component k ON k.id = d.doc_id
"""

OP9_SQL = f"""
WITH RECURSIVE u AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), ok AS (
  SELECT id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM u
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.id < b.id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a),
v AS (SELECT vec_id AS id FROM embeddings), {SQL_COMPONENTS}
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, k.component_id, k.component_id = d.vec_id AS kept
FROM embeddings d LEFT JOIN n ON n.id = d.vec_id JOIN component k ON k.id = d.vec_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_image_copies": op5_image_copies,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_embeddings": op9_embeddings,
    "op10_pieces": op10_pieces,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_html_extraction": op12_html_extraction,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": OP1_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op9_embeddings": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
