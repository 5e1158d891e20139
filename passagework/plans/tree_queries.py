"""Registered queries over trees, places and orders, with SQL for each."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import jsontree
from passagework.operators import chunking, containment, glyphs, nearest, page_tables, positions, scans, tree_chunks
from passagework.plans.catalog import query
from passagework.sources import updates
from passagework.sources.scratch import scratch_root
from passagework.sources.tables import read_table

# --- chunks of trees ------------------------------------------------------------------------------------------

#: Tokens of a chunk with two special ones; at sf0.01 about half of the nations fit.
TREE_LIMIT = 124


def _named(mark: str, key: str) -> Column:
    return F.concat(F.lit(mark), F.col(key).cast("string"))


def _customer_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, segments and nodes of regions as sections, with their nations and customers below."""
    read = partial(read_table, spark, sf_dir)
    region = read("region").select(F.col("r_regionkey").alias("region"), "r_name")
    nation = read("nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", "n_name")
    customer = read("customer").join(nation.select("region", F.col("n_nationkey").alias("c_nationkey")), "c_nationkey")
    place = (F.col("n_nationkey").cast("long") + 1) * 1_000_000_000_000
    rows = region.select("region", F.lit("r").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("ord"), F.concat("r_name", F.lit("\n")).alias("text"), F.concat(F.lit("Region "), "region").alias("heading"), F.lit("region").alias("kind"))
    rows = rows.unionByName(nation.select("region", _named("n", "n_nationkey").alias("node_id"), F.lit("r").alias("parent_id"), place.alias("ord"), F.concat("n_name", F.lit("\n")).alias("text"), F.concat(F.lit("Nation "), "n_nationkey").alias("heading"), F.lit("nation").alias("kind")))
    customer = customer.withColumnRenamed("c_nationkey", "n_nationkey")
    rows = rows.unionByName(customer.select("region", _named("c", "c_custkey").alias("node_id"), _named("n", "n_nationkey").alias("parent_id"), (place + F.col("c_custkey") + 1).alias("ord"), F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("\n")).alias("text"), F.concat(F.lit("Customer "), "c_custkey").alias("heading"), F.lit("customer").alias("kind")))
    above = tree_chunks.tree_paths(rows, ["region"])
    return rows.join(above, ["region", "node_id"]).select("region", "ord", "above", "text"), rows.select("region", "node_id", "heading", "kind"), rows


@query(
    "tree_chunks",
    rf"""WITH c AS (SELECT n_regionkey AS region, n_nationkey AS n, c_custkey AS k, c_name || ' ' || c_mktsegment || chr(10) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
seg AS (
  SELECT r_regionkey AS region, NULL AS n, NULL AS k, 0::BIGINT AS ord, r_name || chr(10) AS text FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, NULL, (n_nationkey + 1)::BIGINT * 1000000000000, n_name || chr(10) FROM nation
  UNION ALL SELECT region, n, k, (n + 1)::BIGINT * 1000000000000 + k + 1, text FROM c
), s AS (
  SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, sum(length(text)) OVER (PARTITION BY region ORDER BY ord)::BIGINT AS e FROM seg
), r AS (SELECT region, 2 + 2 + sum(words) <= {TREE_LIMIT} AS fits FROM s GROUP BY region),
m AS (SELECT region, n, 2 + any_value(len(string_split(r_name, ' '))) + 2 + sum(words) <= {TREE_LIMIT} AS fits FROM s JOIN region ON r_regionkey = region WHERE n IS NOT NULL GROUP BY region, n),
p AS (
  SELECT s.*, CASE WHEN r.fits THEN 'r' WHEN m.fits THEN 'n' || s.n WHEN s.k IS NOT NULL THEN 'c' || s.k WHEN s.n IS NOT NULL THEN 'n' || s.n ELSE 'r' END AS node_id,
    CASE WHEN r.fits THEN 'region' WHEN m.fits THEN 'nation' WHEN s.k IS NOT NULL THEN 'customer' ELSE 'residual' END AS kind
  FROM s JOIN r USING (region) LEFT JOIN m ON m.region = s.region AND m.n = s.n
), g AS (
  SELECT region, node_id, kind, any_value(CASE WHEN node_id <> 'r' THEN n END) AS n, any_value(CASE WHEN starts_with(node_id, 'c') THEN k END) AS k, string_agg(text, '' ORDER BY ord) AS text,
    min(e - length(text)) AS char_start, max(e) AS char_end, sum(words) AS words FROM p GROUP BY region, node_id, kind
), h AS (
  SELECT g.*, CASE WHEN k IS NOT NULL THEN 'Customer ' || k WHEN n IS NOT NULL THEN 'Nation ' || n ELSE 'Region ' || region END AS heading,
    concat_ws(chr(10), CASE WHEN n IS NOT NULL THEN r_name END, CASE WHEN k IS NOT NULL THEN n_name END) AS parent_context
  FROM g JOIN region ON r_regionkey = g.region LEFT JOIN nation ON n_nationkey = g.n
)
SELECT region, node_id, kind, heading, parent_context, heading || chr(10) || CASE WHEN parent_context <> '' THEN parent_context || chr(10) ELSE '' END || text AS embedding_text,
  (words + 4 + len(list_filter(regexp_split_to_array(parent_context, '\s+'), lambda x: x <> '')))::INTEGER AS token_count, char_start::BIGINT AS char_start, char_end FROM h""",
)
def tree_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions cut into nations and customers until each chunk fits, with what stands above it."""
    segments, nodes, _ = _customer_tree(spark, sf_dir)
    found = tree_chunks.tree_chunks(segments, nodes, ["region"], limit=TREE_LIMIT)
    return found.select("region", "node_id", "kind", "heading", "parent_context", "embedding_text", "token_count", "char_start", "char_end")


# --- fragments in texts -----------------------------------------------------------------------------------------

FRAGMENT_WORDS = 50


@query(
    "located_fragments",
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT doc_id, i::INTEGER AS i, length(array_to_string(words[i * {FRAGMENT_WORDS} + 1:(i + 1) * {FRAGMENT_WORDS}], '')) AS n
      FROM (SELECT doc_id, words, unnest(range(0, (len(words) + {FRAGMENT_WORDS - 1}) // {FRAGMENT_WORDS})) AS i FROM w WHERE len(words) > 0)),
t AS (SELECT doc_id, list_filter(list_transform(string_split(text, ''), lambda x, i: CASE WHEN x NOT IN (chr(9), chr(10), chr(12), chr(13), ' ') THEN i END), lambda x: x IS NOT NULL) AS p FROM documents),
c AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM f)
SELECT c.doc_id, c.i AS fragment_index, (t.p[c.e - c.n + 1] - 1)::BIGINT AS char_start, t.p[c.e]::BIGINT AS char_end FROM c JOIN t ON t.doc_id = c.doc_id""",
)
def located_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words, joined by single spaces, found again in their documents whatever the white space there."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = chunking.word_chunks(docs, FRAGMENT_WORDS).select("doc_id", "fragment_index", F.col("text").alias("fragment"))
    return containment.located(docs, parts, ["doc_id"], "fragment_index", missing="error").select("doc_id", "fragment_index", "char_start", "char_end")


# --- nearest rows, baselines and words ----------------------------------------------------------------------------

NEAR = 5.0


@query(
    "nearest_purchase",
    f"""WITH p AS (SELECT user_id, value, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, value)
SELECT e.event_id, e.user_id, e.value, p.value AS near_value, p.purchase_id FROM events e LEFT JOIN p ON p.user_id = e.user_id AND abs(e.value - p.value) < {NEAR}
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.value - p.value), p.value) = 1""",
)
def nearest_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the purchase of its user that is nearest in value, if one is near enough."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    bought = read_table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "value", F.col("event_id").alias("purchase_id"))
    return nearest.nearest_within(events, bought, ["user_id"], "value", ["purchase_id"], NEAR)


BASELINE = 2.0


@query(
    "value_baselines",
    f"""WITH RECURSIVE a AS (
  SELECT event_type, min(value) AS baseline FROM events GROUP BY event_type
  UNION ALL SELECT a.event_type, min(e.value) FROM a JOIN events e ON e.event_type = a.event_type AND e.value >= a.baseline + {BASELINE}::DOUBLE GROUP BY a.event_type, a.baseline
), b AS (SELECT e.event_type, e.value, max(a.baseline) AS baseline FROM events e JOIN a ON a.event_type = e.event_type AND a.baseline <= e.value GROUP BY e.event_type, e.event_id, e.value)
SELECT event_type, baseline, count(*) AS n, max(value) AS highest FROM b GROUP BY event_type, baseline""",
)
def value_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each type of event around baselines that the lowest value not yet covered opens."""
    events = read_table(spark, sf_dir, "events").select("event_type", "value", "event_id")
    placed = nearest.baselines(events, ["event_type"], "value", ["event_id"], BASELINE)
    return placed.groupBy("event_type", "baseline").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))


SQL_GLYPHS = r"""l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS row FROM conversations),
g AS (SELECT conv_id, turn, row, unnest(string_split(line, '')) AS c, unnest(range(0, length(line))) AS i FROM l WHERE line <> ''),
v AS (SELECT *, 10.0::DOUBLE * row + 0.4::DOUBLE * (i % 3) AS y, 5.0::DOUBLE * i AS x FROM g WHERE NOT regexp_matches(c, '^\s*$'))"""


@query(
    "glyph_words",
    rf"""WITH {SQL_GLYPHS}, b AS (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY conv_id, turn, row ORDER BY i) = i - 1 THEN 0 ELSE 1 END AS starts FROM v),
n AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn, row ORDER BY i) AS word_no, min(y) OVER (PARTITION BY conv_id, turn, row) AS line_y FROM b)
SELECT conv_id, turn, line_y AS y, word_no::BIGINT AS word_no, min(x) AS x, max(x) + 5.0 AS "right", string_agg(c, '' ORDER BY i) AS text FROM n GROUP BY conv_id, turn, row, line_y, word_no""",
)
def glyph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all turns, put together from the places of their characters alone; heights jitter along a line."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    chars = turns.select("conv_id", "turn", "row", F.posexplode(F.split("line", "")).alias("i", "c")).where("c <> '' AND NOT c RLIKE '^\\\\s*$'")
    placed = chars.select("conv_id", "turn", (F.col("row").cast("long") * 10_000_000 + F.col("i")).alias("seq"), "c", (F.lit(5.0) * F.col("i")).alias("x"), F.lit(5.0).alias("width"), (F.lit(10.0) * F.col("row") + F.lit(0.4) * (F.col("i") % 3)).alias("y"))
    return glyphs.glyph_words(placed, ["conv_id", "turn"])


# --- places and turns ---------------------------------------------------------------------------------------------


@query(
    "zipped_orders",
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders), b AS (SELECT o_orderkey AS priced_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders)
SELECT position, o_orderkey, priced_orderkey, o_totalprice FROM a JOIN b USING (position)""",
)
def zipped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key beside orders by price, place by place."""
    orders = read_table(spark, sf_dir, "orders")
    priced = orders.select(F.col("o_orderkey").alias("priced_orderkey"), "o_totalprice")
    return positions.zipped(orders.select("o_orderkey"), priced, ["o_orderkey"], ["o_totalprice", "priced_orderkey"])


@query(
    "users_in_turn",
    """WITH RECURSIVE f AS (
  SELECT event_type, 0::BIGINT AS user_id, TIMESTAMP '1900-01-01' AS ts, -1::BIGINT AS event_id FROM events GROUP BY event_type
  UNION ALL
  SELECT f.event_type, f.user_id + 1, min(struct_pack(t := e.ts, i := e.event_id)).t, min(struct_pack(t := e.ts, i := e.event_id)).i
  FROM f JOIN events e ON e.event_type = f.event_type AND e.user_id = f.user_id + 1 AND (e.ts > f.ts OR (e.ts = f.ts AND e.event_id > f.event_id)) GROUP BY f.event_type, f.user_id
) SELECT event_type, user_id, event_id FROM f WHERE user_id > 0""",
)
def users_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type of event: the first one of user 1, then the next one of user 2, and so on."""
    events = read_table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    return scans.next_in_turn(events, ["event_type"], ["ts", "event_id"], "user_id").where("accepted").select("event_type", "user_id", "event_id")


# --- tables over pages and regions --------------------------------------------------------------------------------

#: Lines of a page, and two layouts: of the first ten pages, and of all others up to the last number a page can have.
PAGE_LINES, LAYOUT_PAGES, LAST_PAGE = 15, 10, 2**31 - 1
LAYOUTS = ((72.0, 120.0, 300.0), (80.0, 150.0, 260.0))


@query(
    "table_over_pages",
    f"""SELECT row_number() OVER (ORDER BY c_custkey) AS row, ((row_number() OVER (ORDER BY c_custkey) - 1) * 2 // {PAGE_LINES})::INTEGER AS page,
  c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment || ' ' || c_nationkey || chr(10) || 'of' || chr(10) || c_mktsegment AS market FROM customer""",
)
def table_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers laid out as words on pages with two layouts, three lines a row on two lines of paper, and read back as a table.

    Rows begin on every second line, so rows at a page's end go on overleaf.
    """
    ranked = positions.numbered(read_table(spark, sf_dir, "customer"), ["c_custkey"])
    first = (F.col("position") - 1) * 2
    word = lambda line, seq, column, text: F.struct(F.lit(line).alias("add"), F.lit(seq).alias("seq"), F.lit(column).alias("column"), text.alias("text"))
    words = F.array(
        word(0, 0, 0, F.col("c_custkey").cast("string")), word(0, 1, 1, F.col("c_name")), word(0, 2, 2, F.col("c_mktsegment")), word(0, 3, 2, F.col("c_nationkey").cast("string")),
        word(1, 0, 2, F.lit("of")), word(1, 1, 2, F.lit("")), word(1, 2, 2, F.col("c_mktsegment")),
    )
    each = ranked.select(first.alias("first"), F.explode(words).alias("w")).where("w.text <> ''")
    # the second line has two words in one column, half a line apart
    line = F.col("first") + F.col("w.add")
    page, on_page = F.floor(line / PAGE_LINES).cast("int"), line % PAGE_LINES
    starts = F.when(page < LAYOUT_PAGES, F.array(*map(F.lit, LAYOUTS[0]))).otherwise(F.array(*map(F.lit, LAYOUTS[1])))
    placed = each.select(page.alias("page"), (on_page * 2 + (F.col("w.seq") == 2).cast("int") * F.col("w.add")).alias("line"), "w.seq", (F.get(starts, "w.column") + F.col("w.seq") * 0.5).alias("x"), (F.lit(80.0) + on_page * 12 + (F.col("w.seq") == 2).cast("int") * F.col("w.add") * 6).alias("y"), "w.text")
    layouts = page_tables.layout_table(spark, [(0, LAYOUT_PAGES - 1, LAYOUTS[0]), (LAYOUT_PAGES, LAST_PAGE, LAYOUTS[1])])
    rows = page_tables.joined_rows(page_tables.page_rows(placed, layouts))
    return rows.select("row", "page", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("market"))


SMALL = 10.1


@query(
    "footnote_lines",
    f"""WITH l AS (SELECT l_orderkey, sum(length(l_linestatus || l_returnflag || l_linenumber)) FILTER (WHERE l_quantity < {SMALL}) AS small, sum(length(l_linestatus || l_returnflag || l_linenumber)) AS chars FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(coalesce(small, 0) / chars, 6) AS share FROM l WHERE coalesce(small, 0) / chars > 0.8""",
)
def footnote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of print, whose order lines are spans set in the size of their quantity: those that are small print."""
    span = F.struct(F.concat("l_linestatus", "l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), F.col("l_quantity").alias("size"))
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))
    placed = lines.withColumns({"page": F.lit(1), "y": F.lit(740.0)})
    found = page_tables.footnote_lines(placed, page=F.lit(1), top=F.lit(730.0), size=SMALL)
    return found.select("l_orderkey", F.round(page_tables.small_share(F.col("spans"), SMALL), 6).alias("share"))


# --- JSON of any shape --------------------------------------------------------------------------------------------


@query(
    "json_leaves",
    """WITH l AS (SELECT o_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, '/a~1b/status' AS pointer, 'string' AS kind, to_json(o_orderstatus)::VARCHAR AS value FROM orders
UNION ALL SELECT o_orderkey, '/key', 'number', o_orderkey::VARCHAR FROM orders
UNION ALL SELECT o_orderkey, '/lines/' || i || '/part', 'number', l_partkey::VARCHAR FROM l
UNION ALL SELECT o_orderkey, '/lines/' || i || '/flags/0', 'string', to_json(l_returnflag)::VARCHAR FROM l
UNION ALL SELECT o_orderkey, '/lines', 'array', '[]' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested JSON, taken apart into leaves with pointers."""
    line = F.struct(F.col("l_partkey").alias("part"), F.array("l_returnflag").alias("flags"))
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))).alias("held"))
    orders = read_table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    held = F.coalesce(F.transform("held", lambda x: x["line"]), F.array().cast("array<struct<part:bigint,flags:array<string>>>"))
    text = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("a/b"), F.col("o_orderkey").alias("key"), held.alias("lines")))
    return jsontree.json_leaves(orders.select("o_orderkey", text.alias("json")), ["o_orderkey"], "json")


@query(
    "json_pointers",
    """SELECT event_id, CASE event_type WHEN 'click' THEN '/k' WHEN 'view' THEN '' WHEN 'signup' THEN '/k/0' WHEN 'purchase' THEN '/none' END AS pointer,
  CASE event_type WHEN 'click' THEN json_extract_string(props, '$.k') WHEN 'view' THEN replace(props, ' ', '') END AS found FROM events""",
)
def json_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's own pointer names in its properties."""
    kind = F.col("event_type")
    pointer = F.when(kind == "click", "/k").when(kind == "view", "").when(kind == "signup", "/k/0").when(kind == "purchase", "/none")
    events = read_table(spark, sf_dir, "events").select("event_id", "props", pointer.alias("pointer"))
    return jsontree.json_at(events, "props", "pointer").select("event_id", "pointer", "found")


# --- stored tables ------------------------------------------------------------------------------------------------


@query(
    "point_reads",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents) AND lang = (SELECT lang FROM documents ORDER BY doc_id DESC LIMIT 1)",
)
def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written clustered by language, and the last one read back by language and id."""
    docs, path = read_table(spark, sf_dir, "documents"), f"{scratch_root(spark)}/clustered-{uuid.uuid4().hex}"
    updates.write_clustered(docs, path, "lang", ["doc_id"])
    key = docs.select(F.max(F.struct("doc_id", "lang")).alias("k")).first()["k"]
    return updates.read_point(spark, path, {"lang": key["lang"], "doc_id": key["doc_id"]}).select("doc_id", "lang", "n_chars")


@query(
    "updated_orders",
    "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'X-' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
)
def updated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of all orders after an update of those of customers in one segment."""
    root = f"{scratch_root(spark)}/orders-{uuid.uuid4().hex}"
    updates.create_table(read_table(spark, sf_dir, "orders"), root)
    building = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    updates.update_where(spark, root, building, {"o_orderpriority": F.concat(F.lit("X-"), "o_orderpriority")})
    return updates.read_versioned(spark, root).select("o_orderkey", "o_orderpriority")


@query(
    "verified_chain",
    """SELECT 'vectors' AS build, 'vectors' AS name, count(*) AS n FROM embeddings UNION ALL SELECT 'vectors', 'labels', count(DISTINCT label) FROM embeddings
UNION ALL SELECT 'texts', 'texts', count(*) FROM documents""",
)
def verified_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all vectors published as two builds, one made from the other, and what a check of the whole chain finds in them."""
    root = f"{scratch_root(spark)}/chain-{uuid.uuid4().hex}"
    vectors = read_table(spark, sf_dir, "embeddings")
    updates.publish_chained({"texts": read_table(spark, sf_dir, "documents")}, f"{root}/texts", "texts")
    updates.publish_chained({"vectors": vectors, "labels": vectors.select("label").distinct()}, f"{root}/vectors", "vectors", (f"{root}/texts", "texts"))
    chain = updates.verified_chain(spark, f"{root}/vectors")
    return spark.createDataFrame([(m["build_id"], name, int(d["rows"])) for m in chain for name, d in m["digests"].items()], "build string, name string, n long")
