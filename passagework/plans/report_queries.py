"""Registered queries of checks and reports, with SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import hashing, jsontext, vectors
from passagework.operators import artifacts, chunking, citation_map, datasets, dense, documents, metrics, validation, verify
from passagework.operators.ranking import distributed_rank
from passagework.plans import answers
from passagework.plans.catalog import query
from passagework.sources.tables import read_table

# --- checks of rows ---------------------------------------------------------------------------------------------

CATEGORIES, PROVENANCES = ("en", "fr", "de"), tuple(f"src{i}" for i in range(15))
SQL_LIST = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    "question_violations",
    rf"""WITH q AS (SELECT doc_id AS id, lang, source, toxic, n_chars, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS key FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT id, lang, unnest([id, n_chars]) AS gold FROM q), w AS (SELECT g.id, CASE WHEN d.doc_id IS NULL THEN 'unknown gold' WHEN d.lang <> g.lang THEN 'gold of another act' END AS violation FROM g LEFT JOIN documents d ON d.doc_id = g.gold)
SELECT id, 'blank query' AS violation FROM q WHERE key = ''
UNION ALL SELECT id, 'category' FROM q WHERE lang NOT IN {SQL_LIST(CATEGORIES)}
UNION ALL SELECT id, 'provenance' FROM q WHERE source NOT IN {SQL_LIST(PROVENANCES)}
UNION ALL SELECT id, 'review flag' FROM q WHERE toxic IS NULL
UNION ALL SELECT id, 'repeated gold' FROM q WHERE id = n_chars
UNION ALL SELECT id, 'repeated query' FROM q WHERE key IN (SELECT key FROM q GROUP BY key HAVING count(*) > 1)
UNION ALL SELECT DISTINCT id, violation FROM w WHERE violation IS NOT NULL""",
)
def question_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents checked as benchmark questions whose gold are their own id and their length."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    questions = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("query"), F.col("lang").alias("category"), F.col("source").alias("provenance"), (F.col("toxic") == 1).alias("needs_legal_review"),
        F.array("doc_id", "n_chars").alias("gold_citation_ids"), F.col("lang").alias("act"),
    )
    known = docs.select(F.col("doc_id").alias("citation_id"), F.col("lang").alias("act"))
    return validation.question_violations(questions, known, CATEGORIES, PROVENANCES)


@query(
    "row_differences",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey = 5 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, upper(o_orderpriority) || CASE WHEN o_orderkey = o_custkey THEN '!' ELSE '' END AS o_orderpriority FROM orders WHERE o_orderstatus <> 'P'),
d AS (SELECT l.o_orderkey, r.o_orderkey IS NULL AS gone, r.o_custkey IS DISTINCT FROM l.o_custkey AS c, r.o_orderpriority IS DISTINCT FROM l.o_orderpriority AS p FROM orders l LEFT JOIN r USING (o_orderkey))
SELECT o_orderkey, 'missing right' AS field FROM d WHERE gone UNION ALL SELECT o_orderkey, 'o_custkey' FROM d WHERE NOT gone AND c UNION ALL SELECT o_orderkey, 'o_orderpriority' FROM d WHERE NOT gone AND p""",
)
def row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which fields orders differ from a changed copy, and which the copy lacks."""
    left = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    mark = F.when(F.col("o_orderkey") == F.col("o_custkey"), "!").otherwise("")
    right = left.where("o_orderstatus <> 'P'").withColumns({"o_orderpriority": F.concat(F.upper("o_orderpriority"), mark), "o_custkey": F.when(F.col("o_custkey") != 5, F.col("o_custkey"))})
    return validation.row_differences(left, right, "o_orderkey")


@query(
    "set_differences",
    """SELECT key, 'left' AS side FROM (SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT key, 'right' FROM (SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer)""",
)
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, and orders of unknown customers."""
    return validation.set_differences(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query(
    "marker_faults",
    """SELECT l_orderkey, 'not a run' AS fault FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_linenumber) OR max(l_linenumber) <> count(DISTINCT l_linenumber)""",
)
def marker_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers, as labels in brackets, are no run from 1."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.concat(F.lit("("), "l_linenumber", F.lit(")")).alias("label"))
    return validation.marker_faults(lines, ["l_orderkey"], "at", "label")


@query(
    "row_overlaps",
    """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice AS top, o_totalprice + 50000.0::DOUBLE AS bottom, lag(o_totalprice + 50000.0::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS before FROM orders)
WHERE top < before - 1.5""",
)
def row_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of paper 50,000 high, placed by price: those that reach into the one before."""
    rows = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("top"), (F.col("o_totalprice") + F.lit(50000.0)).alias("bottom"))
    return artifacts.row_overlaps(rows, ["o_custkey"], ["top", "o_orderkey"], "top", "bottom")


# --- counts and provenance --------------------------------------------------------------------------------------


@query("manifest_counts", "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.manifest_counts(read_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


EXPECTED = {"F": 0, "O": 1000, "X": 3}


@query(
    "count_faults",
    """WITH w(o_orderstatus, expected) AS (VALUES ('F', 0), ('O', 1000), ('X', 3)), c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus)
SELECT o_orderstatus, coalesce(n, 0) AS n, coalesce(expected, 0)::BIGINT AS expected FROM c FULL JOIN w USING (o_orderstatus) WHERE coalesce(n, 0) <> coalesce(expected, 0)""",
)
def count_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.count_faults(read_table(spark, sf_dir, "orders").select("o_orderstatus"), "o_orderstatus", EXPECTED)


@query("distinct_parts", "SELECT l_suppkey, list_sort(list(DISTINCT l_linenumber))::VARCHAR AS numbers FROM lineitem GROUP BY l_suppkey")
def distinct_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted line numbers that each supplier occurs on."""
    found = artifacts.distinct_values(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "numbers")
    return found.select("l_suppkey", F.concat(F.lit("["), F.array_join("numbers", ", "), F.lit("]")).alias("numbers"))


CHUNK_WORDS, CHUNK_TARGET = 100, 60


@query(
    "chunk_report",
    rf"""WITH w AS (SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT words[i * {CHUNK_WORDS} + 1:(i + 1) * {CHUNK_WORDS}] AS part FROM (SELECT words, unnest(range(0, (len(words) + {CHUNK_WORDS - 1}) // {CHUNK_WORDS})) AS i FROM w WHERE len(words) > 0))
SELECT count(*) AS n_chunks, max(len(part))::BIGINT AS max_tokens, count(*) FILTER (WHERE len(part) > {CHUNK_TARGET}) AS above_target, sum(length(array_to_string(part, ' ')))::BIGINT AS chars FROM c""",
)
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.chunk_report(chunking.word_chunks(read_table(spark, sf_dir, "documents"), CHUNK_WORDS), "n_words", CHUNK_TARGET)


# --- answers ----------------------------------------------------------------------------------------------------

SOURCE = "BNS-2023-0123456789ab-S"


@query(
    "answer_validity",
    f"""WITH c AS (SELECT DISTINCT l_orderkey, '{SOURCE}' || l_partkey || CASE WHEN l_tax > 0.07 THEN '-T1-R001' ELSE '' END AS id, l_partkey FROM lineitem),
r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 5)
SELECT c.l_orderkey, bool_and(NOT contains(c.id, '-T1-') AND r.l_partkey IS NOT NULL AND p.p_partkey IS NOT NULL) AS citations_valid FROM c
LEFT JOIN r ON r.l_orderkey = c.l_orderkey AND '{SOURCE}' || r.l_partkey = c.id LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 45) p ON p.p_partkey = c.l_partkey GROUP BY c.l_orderkey""",
)
def answer_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers that cite their parts: valid if each was retrieved, is a section's citation, and is known."""
    lines = read_table(spark, sf_dir, "lineitem")
    cite = lambda key: F.concat(F.lit(SOURCE), F.col(key).cast("string"))
    claims = lines.select("l_orderkey", F.concat(cite("l_partkey"), F.when(F.col("l_tax") > 0.07, "-T1-R001").otherwise("")).alias("citation_id"))
    retrieved = lines.where("l_quantity > 5").select("l_orderkey", cite("l_partkey").alias("citation_id"))
    known = read_table(spark, sf_dir, "part").where("p_size < 45").select(cite("p_partkey").alias("citation_id"))
    return verify.answer_validity(claims, retrieved, known, ["l_orderkey"])


@query(
    "kept_citations",
    """WITH f AS (SELECT user_id, event_type, min(struct_pack(t := ts, i := event_id)) AS seen FROM events GROUP BY user_id, event_type),
r AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 30), k AS (SELECT event_type FROM events GROUP BY event_type HAVING avg(value) < 1000 AND event_type <> 'signup')
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen.t, seen.i)::INTEGER AS position FROM f JOIN r USING (user_id, event_type) JOIN k USING (event_type)""",
)
def kept_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a user's events as citations of an answer: the first of each that was retrieved and is known, counted anew."""
    events = read_table(spark, sf_dir, "events")
    retrieved = events.where("value > 30").select("user_id", "event_type")
    known = events.groupBy("event_type").agg(F.avg("value").alias("mean")).where("mean < 1000 AND event_type <> 'signup'").select("event_type")
    return artifacts.kept_citations(events.select("user_id", "event_type", "ts", "event_id"), retrieved, known, ["user_id"], "event_type", ["ts", "event_id"])


@query(
    "hallucination_rate",
    """WITH e AS (SELECT event_type, CASE WHEN value > 5 THEN props END AS answer, CASE WHEN value > 60 THEN ['flag'] ELSE [] END AS flags, CASE WHEN user_id = 7 THEN false WHEN user_id = 8 THEN NULL ELSE true END AS valid FROM events)
SELECT event_type, round(100.0 * count(*) FILTER (WHERE answer IS NOT NULL AND (len(flags) > 0 OR coalesce(valid, true) = false)) / nullif(count(answer), 0), 6) AS rate FROM e GROUP BY event_type""",
)
def hallucination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of answers with flags or invalid citations, for each type of event."""
    flags = F.when(F.col("value") > 60, F.array(F.lit("flag"))).otherwise(F.array().cast("array<string>"))
    valid = F.when(F.col("user_id") == 7, F.lit(False)).when(F.col("user_id") != 8, F.lit(True))
    rate = metrics.hallucination_rate(flags, valid, F.when(F.col("value") > 5, F.col("props")))
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(rate, 6).alias("rate"))


@query(
    "extracted_objects",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE replace(props, ' ', '') END AS object FROM events""",
)
def extracted_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in each of several kinds of output: alone, fenced, in braces inside prose, and cut off."""
    kind = F.col("event_type")
    fenced = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    prose = F.concat(F.lit('It is {so} that "{" opens; '), "props", F.lit(" and {more}"))
    text = F.when(kind == "click", F.col("props")).when(kind == "view", fenced).when(kind == "error", F.expr("substring(props, 1, length(props) - 1)")).otherwise(prose)
    return read_table(spark, sf_dir, "events").select("event_id", jsontext.extract_object(text).alias("object"))


@query(
    "answer_violations",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'no JSON object' WHEN user_id = 3 THEN 'answer' WHEN user_id = 4 THEN 'citations' WHEN value > 100 THEN 'confidence' WHEN event_type = 'signup' THEN 'query_type' END AS violation FROM events""",
)
def answer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with answers of a model, of which some lack a part."""
    kind, user = F.col("event_type"), F.col("user_id")
    answer = F.struct(
        F.when(user == 3, " ").otherwise("Section 5 says so.").alias("answer"), F.when(user != 4, F.array(F.lit("a"))).alias("citations"), (F.col("value") / 100).alias("confidence"),
        F.when(kind == "signup", "odd").otherwise("scenario").alias("query_type"),
    )
    text = F.when(kind == "error", "nothing").otherwise(F.concat(F.lit("Here: "), F.to_json(answer)))
    raw = jsontext.extract_object(text)
    rows = read_table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("parsed", F.from_json("raw", jsontext.ANSWER_SCHEMA))
    return rows.select("event_id", jsontext.violation(F.col("raw"), F.col("parsed")).alias("violation"))


# --- the answer call, the citation map and the benchmark --------------------------------------------------------


@query(
    "checked_answers",
    f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.label, v.vec_id, v.label AS hit_label, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
h AS (SELECT *, '{SOURCE}' || vec_id AS cite FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10),
r AS (SELECT query_id, any_value(label) AS label, list(cite ORDER BY score DESC, vec_id) AS cites, list(hit_label ORDER BY score DESC, vec_id) AS labels FROM h GROUP BY query_id),
c AS (SELECT *, CASE WHEN label = 0 THEN 'llm_unavailable' WHEN label = 1 THEN 'parse_error' END AS error FROM r)
SELECT query_id, array_to_string(cites, ' ') AS retrieved, CASE WHEN error IS NULL THEN 'By t' || substr(cites[1], {len(SOURCE) + 1}) END AS answer,
  CASE WHEN error IS NOT NULL THEN '' ELSE concat_ws(' ', CASE WHEN labels[1] <> 5 THEN cites[1] END, CASE WHEN labels[10] <> 5 THEN cites[10] END) END AS citations,
  CASE WHEN error IS NULL AND label % 2 = 0 THEN 'odd-' || label ELSE '' END AS flags,
  CASE WHEN error IS NULL THEN (label % 2 = 1 AND labels[1] <> 5 AND labels[10] <> 5)::VARCHAR ELSE 'unknown' END AS citations_valid, error FROM c""",
)
def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a step over the ten nearest vectors, with its claims checked; some questions find no model or get no JSON."""
    table = read_table(spark, sf_dir, "embeddings")
    asked = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    near = dense.nearest(table, asked, 10)
    hits = near.select("query_id", F.concat(F.lit(SOURCE), "vec_id").alias("citation_id"), F.concat(F.lit("t"), "vec_id").alias("text"), "rank")
    questions = asked.select("query_id", F.concat(F.lit("label "), "label", F.lit(" of "), "query_id").alias("text"))
    known = table.where("label <> 5").select(F.concat(F.lit(SOURCE), "vec_id").alias("citation_id"))

    def step(question: Column, passages: Column) -> Column:
        label = F.regexp_extract(question, r"^label (\d+) of", 1)
        odd = F.when(label.cast("int") % 2 == 0, F.array(F.concat(F.lit("odd-"), label))).otherwise(F.array().cast("array<string>"))
        claims = F.concat(F.array(passages[0]["citation_id"], passages[9]["citation_id"]), odd, F.array(passages[0]["citation_id"]))
        answer = F.to_json(F.struct(F.concat(F.lit("By "), passages[0]["text"]).alias("answer"), claims.alias("citations"), F.lit(1.0).alias("confidence"), F.lit("scenario").alias("query_type")))
        return F.when(label == "0", F.lit(None).cast("string")).when(label == "1", "no object").otherwise(answer)

    found = answers.answers_from_hits(questions, hits, step, known)
    joined = (F.array_join(c, " ").alias(c) for c in ("retrieved", "citations", "flags"))
    return found.select("query_id", *joined, "answer", F.coalesce(F.col("citations_valid").cast("string"), F.lit("unknown")).alias("citations_valid"), "error")


SHA = "a1b2c3d4e5f60718"


@query(
    "citation_map",
    """WITH o AS (SELECT o_orderkey, o_orderstatus AS act, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i FROM orders),
b AS (SELECT l_orderkey, l_linenumber AS page, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity + 10) AS x1, max(l_extendedprice + 10) AS y1 FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, string_agg(page::VARCHAR, ' ' ORDER BY page) AS pages, string_agg(page || ':' || round(x0, 2) || ',' || round(y0, 2) || ',' || round(x1, 2) || ',' || round(y1, 2), ' ' ORDER BY page) AS regions FROM b GROUP BY l_orderkey),
p AS (SELECT p_partkey, CASE WHEN p_size < 20 THEN 'F' ELSE 'O' END AS act, p_partkey // 3 AS page FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY act ORDER BY p_partkey) - 1 AS i, lead(page) OVER (PARTITION BY act ORDER BY p_partkey) - 1 AS ends FROM p),
c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
SELECT act || '-2024-a1b2c3d4e5f6-S' || o_orderkey AS citation_id, 'section' AS kind, '/sections/' || i AS json_pointer, 'doc ' || act AS document_name, coalesce(pages, '') AS source_pages, coalesce(regions, '') AS regions, NULL::INTEGER AS row_ordinal, NULL::INTEGER AS char_end FROM o LEFT JOIN s ON l_orderkey = o_orderkey
UNION ALL SELECT act || '-2024-a1b2c3d4e5f6-SCH2-FORM' || p_partkey, 'form', '/forms/' || i, 'doc ' || act, array_to_string(range(page, greatest(coalesce(ends, 100000), page) + 1)[:3], ' '), NULL, NULL, NULL FROM f
UNION ALL SELECT 'P-2024-a1b2c3d4e5f6-T1-R' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END, 'table_row', '/rows/' || n, 'doc P', (n // 40)::VARCHAR, NULL, n, NULL FROM c
UNION ALL SELECT 'P-2024-a1b2c3d4e5f6-NOTE' || n_nationkey, 'schedule_notes', '/notes/' || n_nationkey, 'doc P', '1', NULL, NULL, length(n_name) FROM nation""",
)
def citation_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sections with their lines on pages, parts as forms, customers as table rows and nations as notes: all that can be cited.

    Of a form's pages the first three are shown.
    """
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    prefix = lambda act: citation_map.snapshot_prefix(act, 2024, F.lit(SHA))
    placed = distributed_rank(orders.select("o_orderkey", F.col("o_orderstatus").alias("act")), ["act"], ["o_orderkey"], "nth")
    sections = placed.select("o_orderkey", "act", F.concat(prefix(F.col("act")), F.lit("-S"), "o_orderkey").alias("citation_id"), F.col("o_orderkey").alias("section_number"), F.concat(F.lit("/sections/"), F.col("nth") - 1).alias("json_pointer"))
    boxes = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_extendedprice") + 10).alias("y1"))
    parts = read_table(spark, sf_dir, "part").select(F.when(F.col("p_size") < 20, "F").otherwise("O").alias("act"), F.col("p_partkey").alias("form_number"), F.floor(F.col("p_partkey") / 3).alias("page"))
    forms = distributed_rank(parts, ["act"], ["form_number"], "nth").withColumns({"prefix": prefix(F.col("act")), "nth": F.col("nth") - 1})
    customers = distributed_rank(read_table(spark, sf_dir, "customer").select(F.lit("P").alias("act"), "c_custkey"), ["act"], ["c_custkey"], "row_ordinal").withColumn("prefix", prefix(F.lit("P")))
    notes = read_table(spark, sf_dir, "nation").select(F.lit("P").alias("act"), prefix(F.lit("P")).alias("prefix"), F.concat(F.lit("NOTE"), "n_nationkey").alias("label"), F.concat(F.lit("/notes/"), "n_nationkey").alias("json_pointer"), F.lit(1).alias("page"), F.col("n_name").alias("text"))
    sources = spark.createDataFrame([(a, f"doc {a}", SHA) for a in ("F", "O", "P")], "act string, document_name string, source_sha256 string")
    entries = citation_map.citation_map([
        citation_map.section_entries(sections, boxes, ["o_orderkey"]), citation_map.form_entries(forms, 100_000),
        citation_map.row_entries(customers, "table_row", F.lit("T1"), F.concat(F.lit("/rows/"), "row_ordinal"), F.floor(F.col("row_ordinal") / 40)), citation_map.note_entries(notes),
    ], sources)
    region = lambda r: F.concat(r["page_number"].cast("string"), F.lit(":"), F.array_join(F.transform(r["bbox"], lambda v: v.cast("string")), ","))
    pages = F.when(F.col("kind") == "form", F.slice("source_pages", 1, 3)).otherwise(F.col("source_pages")).cast("array<string>")
    return entries.select("citation_id", "kind", "json_pointer", "document_name", F.array_join(pages, " ").alias("source_pages"), F.array_join(F.transform("section_regions", region), " ").alias("regions"), "row_ordinal", "char_end")


@query(
    "regenerated_questions",
    """WITH p AS (SELECT c_mktsegment AS act, lpad(c_custkey::VARCHAR, 12, '0') AS cid, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS nth, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT 'p34-02-direct-' || cid AS id, 'Which provision in the ingested ' || act || ' 2023 snapshot covers ' || chr(39) || c_name || chr(39) || '?' AS query, act FROM p, range(0, 6) t(i) WHERE nth = (5 + i * 7919) % n""",
)
def regenerated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made anew from customers as sections, spread over those of each segment."""
    sections = read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("act"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("citation_id"), F.concat(F.lit(" "), "c_name", F.lit(" .")).alias("title"), F.lit("/x").alias("json_pointer"))
    return datasets.regenerated(sections, seed=5, per_act=6, stride=7919).select("id", "query", "act")


@query(
    "index_faults",
    f"""WITH p AS (SELECT vec_id, label, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS point_id
  FROM (SELECT *, sha1(unhex('{hashing.POINT_NAMESPACE}') || encode(vec_id::VARCHAR)) AS h FROM embeddings))
SELECT point_id, CASE label WHEN 2 THEN 'missing' WHEN 3 THEN 'payload: label' WHEN 5 THEN 'vector' END AS fault FROM p WHERE label IN (2, 3, 5)
UNION ALL SELECT point_id, 'another key' FROM p WHERE label = 6""",
)
def index_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed copy of all vectors as an index: what it lacks, and whose label, vector or key are others."""
    unit = F.transform("embedding", lambda x: x.cast("double") / vectors.norm(F.col("embedding")))
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", unit.alias("embedding"))
    label, key = F.col("label"), F.col("vec_id").cast("string")
    changed = F.transform("embedding", lambda x, i: F.when((label == 5) & (i == 0), x + 1).otherwise(x))
    points = table.where("label <> 2").select(hashing.uuid5(key).alias("point_id"), F.when(label == 6, -F.col("vec_id") - 1).otherwise(F.col("vec_id")).alias("vec_id"), changed.alias("vector"), F.when(label == 3, 30).otherwise(label).cast("int").alias("label"))
    return documents.index_faults(table, points, ["label"], key="vec_id")
