"""Registered queries over the given tables, each with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.functions.text import article_label, article_num, article_num_kanji, era_date, fold_kana, fold_width, heading, kanji_numeral, strip_item_marker, trim_wide
from lexgrove.operators import history, lookup, search, tree
from lexgrove.operators import outline as toc
from lexgrove.operators.errors import http_error, is_error
from lexgrove.plans import requests, standins
from lexgrove.session import checkpoint_dir, merging, stored, table
from lexgrove.sources import postings
from lexgrove.sources.aliases import OWNER, aliases
from lexgrove.sources.law_types import law_types
from lexgrove.sources.nodes import OUTLINED, shred, spread
from lexgrove.sources.nodes import register as register_shredder
from lexgrove.streaming import buckets
from lexgrove.streaming.sync import newest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return keep


OUTLINE = """
o AS (
  SELECT CAST(r_regionkey AS BIGINT) doc_id, lpad(CAST(r_regionkey AS VARCHAR), 8, '0') path, 0 AS lvl, 'Part' tag, CAST(r_regionkey AS VARCHAR) num, r_name title, NULL caption FROM region
  UNION ALL
  SELECT CAST(r_regionkey AS BIGINT), lpad(CAST(r_regionkey AS VARCHAR), 8, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0'), 1, 'Chapter', CAST(n_nationkey AS VARCHAR), n_name, NULL
  FROM region JOIN nation ON r_regionkey = n_regionkey
  UNION ALL
  SELECT CAST(r_regionkey AS BIGINT), lpad(CAST(r_regionkey AS VARCHAR), 8, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') || '.' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 2, 'Article', CAST(c_custkey AS VARCHAR), NULL, c_mktsegment
  FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey)
"""


def _shown(rows: DataFrame) -> DataFrame:
    path = F.array_join(F.transform(F.slice("path", 2, 9), lambda x: F.lpad(x.cast("string"), 8, "0")), ".")
    return rows.select("doc_id", path.alias("path"), F.col("level").cast("long").alias("lvl"), "tag", "num", "title", "caption")


#: Rows of the outlines of standins.trees.
TREE_OUTLINE = """
a AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) - 1 AS c, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS a FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
o AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS doc_id, '0.1.' || c AS path, c, 0 AS a, 0 AS lvl, 'Chapter' AS tag, o_orderstatus AS num, o_orderstatus AS title, CAST(NULL AS VARCHAR) AS caption FROM a
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), '0.1.' || c || '.' || a, c, a, 1, 'Article', CAST(o_orderkey AS VARCHAR), 'Order ' || o_orderkey, o_orderpriority FROM a)
"""


@registered(f"WITH {TREE_OUTLINE} SELECT doc_id, path, CAST(lvl AS BIGINT) AS lvl, tag, num, title, caption FROM o")
def toc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toc.extract(shred(spread(standins.trees(spark, sf_dir)), columns=("path", *OUTLINED), tags=toc.TAGS))
    return _shown(rows).withColumn("path", F.array_join(F.transform(F.split("path", r"\."), lambda x: x.cast("int").cast("string")), "."))


@registered(f"WITH {TREE_OUTLINE} SELECT doc_id, count(*) AS node_count FROM o GROUP BY doc_id")
def toc_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.listing(toc.extract(shred(spread(standins.trees(spark, sf_dir)), columns=OUTLINED, tags=toc.TAGS))).select("doc_id", "node_count")


@registered(
    f"""WITH {OUTLINE}, l AS (SELECT doc_id, path, repeat('  ', lvl) || '- ' || CASE WHEN tag = 'Article' THEN '第' || num || '条 ' || caption ELSE title END AS line FROM o)
    SELECT l.doc_id, count(*) AS node_count, '# ' || any_value(r_name) || ' — 目次' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY path) AS markdown
    FROM l JOIN region ON r_regionkey = doc_id GROUP BY l.doc_id"""
)
def toc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = toc.listing(standins.outline(spark, sf_dir))
    named = lines.join(table(spark, sf_dir, "region"), F.col("doc_id") == F.col("r_regionkey"))
    return named.select("doc_id", "node_count", F.concat(F.lit("# "), "r_name", F.lit(" — 目次\n\n"), "lines").alias("markdown"))


@registered(f"WITH {OUTLINE} SELECT doc_id, path, CAST(lvl AS BIGINT) AS lvl, tag, num, title, caption FROM o WHERE lvl < 2")
def toc_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(toc.limit_depth(standins.outline(spark, sf_dir), 2))


@registered("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id")
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", (F.col("turn") + 1).cast("long").alias("begin"), "text")
    roots = turns.select("conv_id", F.lit(0).cast("long").alias("begin"), F.lit((1 << 63) - 1).alias("end")).distinct()
    return tree.node_text(rows, roots, "conv_id").select("conv_id", "whole")


NODES = """
p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
"""


@registered(f"WITH {NODES} SELECT CAST(o_custkey AS VARCHAR) AS article, p AS paragraph, CAST(l_partkey AS VARCHAR) AS first_item FROM p LEFT JOIN i ON l_orderkey = o_orderkey AND i = 1")
def find_child_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = standins.nodes(spark, sf_dir)
    found = tree.children(nodes, nodes.where("tag = 'Paragraph'").select("doc_id", "path"), "Item", first=True)
    return found.select(F.col("path")[1].cast("string").alias("article"), F.col("path")[2].cast("long").alias("paragraph"), F.col("child.content").alias("first_item"))


@registered(f"WITH {NODES} SELECT o_custkey AS article, p AS paragraph, i AS item, CAST(l_partkey AS VARCHAR) AS content FROM p JOIN i ON l_orderkey = o_orderkey")
def children_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = standins.nodes(spark, sf_dir)
    found = tree.children(nodes, nodes.where("tag = 'Paragraph'").select("doc_id", "path"), "Item")
    return found.select(F.col("path")[1].cast("long").alias("article"), F.col("path")[2].cast("long").alias("paragraph"), F.col("child.num").cast("long").alias("item"), F.col("child.content").alias("content"))


@registered(
    f"""WITH {NODES} SELECT CAST(c_custkey AS VARCHAR) AS article, CAST(o_orderkey AS VARCHAR) AS paragraph, CAST(l_partkey AS VARCHAR) AS item
    FROM customer LEFT JOIN p ON o_custkey = c_custkey AND p = 2 LEFT JOIN i ON l_orderkey = o_orderkey AND i = 3"""
)
def find_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = standins.nodes(spark, sf_dir)
    wanted = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").cast("string").alias("article"), F.lit(2).alias("paragraph"), F.lit(3).alias("item"))
    a = tree.find_articles(nodes, wanted).withColumn("path", F.col("found.path"))
    p = tree.children(nodes, a, "Paragraph", "paragraph", first=True).withColumnRenamed("child", "p").withColumn("path", F.col("p.path"))
    i = tree.children(nodes, p, "Item", "item", first=True)
    return i.select("article", F.col("p.content").alias("paragraph"), F.col("child.content").alias("item"))


@registered(
    f"""WITH {NODES}, b AS (SELECT o_custkey, p, CASE WHEN p <> 1 THEN '**第' || p || '項**' || chr(10) ELSE '' END
      || string_agg(i || ' ' || regexp_replace(CAST(l_partkey AS VARCHAR), '^[0-9]+', ''), chr(10) ORDER BY i) AS block FROM p JOIN i ON l_orderkey = o_orderkey GROUP BY o_custkey, p),
    e AS (SELECT o_custkey, p, CASE WHEN p <> 1 THEN '**第' || p || '項**' ELSE '' END AS block FROM p WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
    SELECT CAST(o_custkey AS VARCHAR) AS article, string_agg(block, chr(10) || chr(10) ORDER BY p) AS body FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY o_custkey"""
)
def article_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = standins.nodes(spark, sf_dir)
    return toc.paragraphs(nodes, nodes.where("tag = 'Article'").select("doc_id", "path")).select(F.col("path")[1].cast("string").alias("article"), "body")


@registered(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 5 IN (1, 2) THEN '_' || (p_partkey % 5) ELSE '' END END AS num,
      CASE WHEN p_partkey % 5 < 4 THEN CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 5 IN (1, 2) THEN 'の' || (p_partkey % 5) ELSE '' END END AS label FROM part"""
)
def article_num_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts written as article numbers in five ways, the last with kanji numerals."""
    n, case = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    raw = F.when(case == 0, n).when(case == 1, F.concat(n, F.lit("の1"))).when(case == 2, F.concat(F.lit("　第"), n, F.lit("条の2　"))).when(case == 3, F.concat(F.lit(" 第"), n, F.lit("条"))).otherwise(F.concat(F.lit("第"), kanji_numeral(F.col("p_size")), F.lit("条")))
    num = article_num(raw)
    return table(spark, sf_dir, "part").select("p_partkey", num.alias("num"), article_label(num).alias("label"))


@registered("SELECT p_partkey, p_name AS bare FROM part")
def item_marker_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts behind their size as an item's marker, in kanji or digits."""
    marker = F.when(F.col("p_partkey") % 2 == 0, kanji_numeral(F.col("p_size"))).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", strip_item_marker(F.concat(marker, F.lit("　"), "p_name")).alias("bare"))


@registered(
    """SELECT p_partkey, '# ' || p_name || ' 第' || p_size || '条' || CASE WHEN p_size % 3 > 0 THEN '第' || (p_size % 3) || '項' ELSE '' END
      || CASE WHEN p_size % 3 > 0 AND p_size % 5 > 0 THEN '第' || (p_size % 5) || '号' ELSE '' END AS heading FROM part"""
)
def article_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rest = lambda n: F.nullif(F.col("p_size") % n, F.lit(0))
    return part.select("p_partkey", heading(F.col("p_name"), F.col("p_size").cast("string"), rest(3), rest(5)).alias("heading"))


KEYWORDS = ("red plate", "plate", "rod", "no such part", "hot")


@registered(
    """WITH k(kw) AS (VALUES ('red plate'), ('plate'), ('rod'), ('no such part'), ('hot')),
    h AS (SELECT kw, p_partkey, p_name, row_number() OVER (PARTITION BY kw ORDER BY p_name, p_partkey) AS rn FROM k JOIN part ON contains(p_name, kw)),
    b AS (SELECT *, row_number() OVER (PARTITION BY kw ORDER BY CASE WHEN p_name = kw THEN 0 ELSE 1 END, rn) AS r2 FROM h WHERE rn <= 5)
    SELECT k.kw AS law_name, CAST(p_partkey AS VARCHAR) AS law_id, p_name AS title FROM k LEFT JOIN b ON b.kw = k.kw AND r2 = 1"""
)
def resolve_exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(KEYWORDS)), "req_id int, law_name string")
    return lookup.resolve(names, standins.laws(spark, sf_dir), aliases(spark)).select("law_name", F.col("law.law_id").alias("law_id"), F.col("law.title").alias("title"))


@registered("SELECT n_name AS name, CASE n_name WHEN 'NATION_1' THEN 'First Nation' WHEN 'NATION_2' THEN 'Second Nation' ELSE n_name END AS title FROM nation")
def alias_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("NATION_1", "First Nation", OWNER), ("NATION_2", "Second Nation", "others")], "abbr string, formal string, owner string")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("　"), "n_name", F.lit(" ")).alias("padded"), F.col("n_name").alias("name"))
    return lookup.with_alias(rows, known, "padded").select("name", lookup.searched_title(F.col("padded")).alias("title"))


@registered("SELECT c_custkey, CASE WHEN c_mktsegment = (SELECT min(c_mktsegment) FROM customer) THEN 'OUT_OF_SCOPE' END AS code FROM customer")
def scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose segments are abbreviations, of which the first is another owner's."""
    customer = table(spark, sf_dir, "customer")
    first = F.broadcast(customer.agg(F.min("c_mktsegment").alias("_first")))
    known = customer.select("c_mktsegment").distinct().crossJoin(first).select(F.col("c_mktsegment").alias("abbr"), F.lit("formal").alias("formal"), F.when(F.col("c_mktsegment") == F.col("_first"), "others").otherwise(OWNER).alias("owner"))
    asked = customer.select("c_custkey", F.concat(F.lit("　"), "c_mktsegment").alias("name"))
    return lookup.with_alias(asked, known).select("c_custkey", lookup.scope_error(F.col("name"), OWNER)["code"].alias("code"))


@registered(
    """WITH t(ord, name, code) AS (VALUES (0,'憲法',NULL),(1,'法律','Act'),(2,'政令','CabinetOrder'),(3,'省令','MinisterialOrdinance'),(4,'規則',NULL),(5,'条例',NULL),(6,'告示',NULL),(7,'訓令',NULL),(8,'通達',NULL),(9,'通知',NULL)),
    a(name, k) AS (VALUES ('憲法','日本国憲法'),('政令','施行令'),('政令','CabinetOrder'),('省令','府令'),('省令','内閣府令'),('省令','施行規則'),('省令','MinisterialOrdinance'),('通達','通知'),('通達','基本通達'),('通達','取扱通達')),
    ks AS (SELECT name AS k, 0 AS p, ord, name FROM t UNION ALL SELECT a.k, 1, t.ord, t.name FROM a JOIN t USING (name) UNION ALL SELECT code, 2, ord, name FROM t WHERE code IS NOT NULL),
    w(s_suppkey, asked) AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN '政令' WHEN 1 THEN '施行令' WHEN 2 THEN 'Act' WHEN 3 THEN '  通達  ' WHEN 4 THEN '通知' WHEN 5 THEN 'Rule' WHEN 6 THEN '日本国憲法' ELSE s_name END FROM supplier)
    SELECT s_suppkey, (SELECT name FROM ks WHERE k = trim(asked) ORDER BY p, ord LIMIT 1) AS name FROM w"""
)
def law_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name per supplier: a type's, an alias, a code, or the supplier's own, which is none."""
    names = F.array(*map(F.lit, ("政令", "施行令", "Act", "  通達  ", "通知", "Rule", "日本国憲法")), F.col("s_name"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % 8).cast("int")).alias("asked"))
    return lookup.find_law_types(asked, law_types(spark), "asked").select("s_suppkey", F.col("entry.name").alias("name"))


@registered("SELECT n_nationkey, '憲法, 法律, 政令, 省令, 規則, 条例, 告示, 訓令, 通達, 通知' AS names FROM nation")
def law_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a nation's name, which is no law type, is answered with."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("req_id"), F.col("n_name").alias("name"))
    return requests.explain_law_type(asked, _parts(spark, sf_dir)).select(F.col("req_id").alias("n_nationkey"), F.col("known").alias("names"))


def _requests(spark: SparkSession) -> DataFrame:
    rows = [(0, "plate", None, None), (1, "rod", "ECONOMY", 3), (2, " ", None, None), (3, "no such part", None, 5), (4, " hot ring ", "", 50)]
    return spark.createDataFrame(rows, "req_id int, keyword string, law_type string, lim int")


SEARCHED = """
r(req_id, keyword, law_type, lim) AS (VALUES (0, 'plate', NULL, NULL), (1, 'rod', 'ECONOMY', 3), (2, ' ', NULL, NULL), (3, 'no such part', NULL, 5), (4, ' hot ring ', '', 50)),
h AS (SELECT req_id, coalesce(lim, 10) AS lim, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY req_id ORDER BY p_name, p_partkey) AS rn, count(*) OVER (PARTITION BY req_id) AS n
  FROM r JOIN part ON trim(keyword) <> '' AND contains(p_name, trim(keyword)) AND (coalesce(r.law_type, '') = '' OR p_type = r.law_type))
"""


@registered(f"WITH {SEARCHED} SELECT CAST(req_id AS BIGINT) AS req_id, rn AS hit, CAST(p_partkey AS VARCHAR) AS law_id, p_name AS title, p_type AS law_type FROM h WHERE rn <= lim")
def search_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_titles(_requests(spark), standins.laws(spark, sf_dir), aliases(spark))
    hits = found.select(F.col("req_id").cast("long").alias("req_id"), F.posexplode("results").alias("hit", "x"))
    return hits.select("req_id", (F.col("hit") + 1).cast("long").alias("hit"), "x.law_id", "x.title", "x.law_type")


@registered(
    f"""WITH {SEARCHED} SELECT CAST(r.req_id AS BIGINT) AS req_id, TRUE AS noted, count(h.rn) FILTER (WHERE rn <= h.lim) AS total_count, count(h.rn) AS matched_count,
      CASE WHEN trim(any_value(keyword)) = '' THEN 'INVALID_ARGUMENT' END AS code, FALSE AS is_error
    FROM r LEFT JOIN h USING (req_id) GROUP BY r.req_id"""
)
def search_fulltext_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requests.search_fulltext(_requests(spark), _parts(spark, sf_dir))
    counts = [F.coalesce(f"fallback.{c}", F.lit(0)).cast("long").alias(c) for c in ("total_count", "matched_count")]
    return found.select(F.col("req_id").cast("long").alias("req_id"), F.col("note").isNotNull().alias("noted"), *counts, F.col("fallback.error.code").alias("code"), is_error(F.col("error")).alias("is_error"))


@registered(
    """SELECT o_custkey, ord, total, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS ord, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE ord <= 5"""
)
def revisions_latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.latest(table(spark, sf_dir, "orders"), 5, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return found.select("o_custkey", "ord", "total", "o_orderkey")


@registered(
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01') WHERE rn = 1"""
)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.as_of(table(spark, sf_dir, "orders"), F.lit("1998-01-01").cast("timestamp"), "o_custkey", "o_orderdate", "o_orderkey")
    return found.select("o_custkey", "revision.o_orderkey", "revision.o_orderstatus")


@registered("SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'and')")
def fulltext_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fulltext(table(spark, sf_dir, "documents"), " the　ａｎｄ ").select("doc_id")


@registered("SELECT doc_id FROM documents WHERE contains(text, 'License') AND contains(text, 'the')")
def fulltext_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of the stored index of all documents, which the application's first such search writes."""
    path = _index(spark, sf_dir, "documents", lambda docs, path: postings.add(docs, path))
    return postings.search(spark, path, "License the").select(F.col("id").alias("doc_id"))


@registered("SELECT page_id, level FROM (SELECT page_id, CASE WHEN contains(url, 'example') AND contains(url, 'http') THEN 1 WHEN contains(html, 'example') AND contains(html, 'http') THEN 2 END AS level FROM pages) WHERE level IS NOT NULL")
def fulltext_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with both terms in their address, and those with both in their source."""
    path = _index(spark, sf_dir, "pages", lambda pages, path: postings.add(pages, path, "page_id", "url", "html"))
    return postings.search(spark, path, "example http").select(F.col("id").alias("page_id"), "level")


#: Indexes that this application has written, by application, folder of tables and table.
_INDEXES: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str, name: str, add: Callable[[DataFrame, str], object]) -> str:
    held = (spark.sparkContext.applicationId, sf_dir, name)
    if held not in _INDEXES:
        path = f"{checkpoint_dir(spark)}/indexes/{uuid.uuid4().hex}"
        add(table(spark, sf_dir, name), path)
        _INDEXES[held] = path
    return _INDEXES[held]


@registered(
    """WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_orderkey) AS revision FROM orders GROUP BY ALL),
    q AS (SELECT l_orderkey, l_linenumber, o_custkey, CAST(l_shipdate AS DATE) - 200 AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, l_linenumber, CAST(day AS VARCHAR) AS day, revision FROM q ASOF LEFT JOIN r ON q.o_custkey = r.o_custkey AND q.day >= r.d"""
)
def as_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per line: its customer's newest order 200 days before the line was shipped."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    asked = table(spark, sf_dir, "lineitem").join(orders.select("o_custkey", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", F.date_sub(F.col("l_shipdate").cast("date"), 200).alias("day"))
    found = history.as_of_each(asked, orders, "o_custkey", "day", "d", [F.col("o_orderkey")], F.col("o_orderkey"))
    return asked.join(found, ["o_custkey", "day"]).select("l_orderkey", "l_linenumber", F.col("day").cast("string").alias("day"), "revision")


@registered(
    """SELECT c_custkey AS req_id, CASE c_custkey % 6 WHEN 0 THEN 'OUT_OF_SCOPE' WHEN 1 THEN 'LAW_NOT_FOUND' WHEN 2 THEN 'INVALID_ARGUMENT' WHEN 3 THEN 'INVALID_ARTICLE_NUM' WHEN 4 THEN 'ARTICLE_NOT_FOUND' END AS code FROM customer"""
)
def error_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per customer, each of the first five with all later faults as well."""
    case = F.col("c_custkey") % 6
    asked = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"), F.when(case == 0, "所基通").when(case == 1, F.concat(F.lit("no such law "), "c_custkey")).otherwise(F.col("c_name")).alias("law_name"),
        F.when(case.isin(0, 1, 3), "三十").when(case == 4, "none").alias("article"), F.when(case < 5, 99).alias("paragraph"), F.lit(None).cast("int").alias("item"), F.when(case == 2, "json").alias("format"), F.lit(None).cast("string").alias("at"))
    return requests.get_law(asked, standins.corpus(spark, sf_dir)).select("req_id", F.col("error.code").alias("code"))


ARTICLES = """
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem),
b AS (SELECT l_orderkey, p, CASE WHEN p <> 1 THEN '**第' || p || '項**' || chr(10) ELSE '' END || 'part ' || l_partkey || CASE WHEN l_returnflag = 'R' THEN chr(10) || '1 supplier ' || l_suppkey ELSE '' END AS block FROM i),
w AS (SELECT l_orderkey, string_agg(block, chr(10) || chr(10) ORDER BY p) AS whole FROM b GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS req_id, c_name, o_orderkey, o_orderpriority, CASE o_orderkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 4 END AS par, o_orderkey % 2 = 1 AS is_json FROM orders JOIN customer ON o_custkey = c_custkey)
"""


@registered(
    f"""WITH {ARTICLES} SELECT r.req_id, CASE WHEN par IS NOT NULL AND b.p IS NULL THEN 'ARTICLE_NOT_FOUND' END AS code,
      CASE WHEN par IS NULL OR b.p IS NOT NULL THEN CASE WHEN is_json THEN CASE WHEN par IS NULL THEN 'Article' ELSE 'Paragraph' END END END AS node_tag,
      CASE WHEN NOT is_json AND (par IS NULL OR b.p IS NOT NULL) THEN '# ' || c_name || ' 第' || o_orderkey || '条' || CASE WHEN par IS NULL THEN '' ELSE '第' || par || '項' END
        || chr(10) || o_orderpriority || chr(10) || chr(10) || coalesce(CASE WHEN par IS NULL THEN w.whole ELSE b.block END, '') || chr(10) END AS shown
    FROM r LEFT JOIN b ON b.l_orderkey = r.o_orderkey AND b.p = par LEFT JOIN w ON w.l_orderkey = r.o_orderkey"""
)
def get_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per order: its article, whole or one paragraph, as Markdown or as a subtree."""
    n = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").join(merging(table(spark, sf_dir, "customer")), F.col("o_custkey") == F.col("c_custkey")).select(
        n.alias("req_id"), F.col("c_name").alias("law_name"), n.cast("string").alias("article"), F.when(n % 3 == 1, 1).when(n % 3 == 2, 4).alias("paragraph"), F.lit(None).cast("int").alias("item"), F.when(n % 2 == 1, "json").otherwise("markdown").alias("format"), F.lit(None).cast("string").alias("at"))
    found = requests.get_law(asked, standins.corpus(spark, sf_dir))
    return found.select("req_id", F.col("error.code").alias("code"), F.get_json_object("data.node", "$.tag").alias("node_tag"), F.substring_index("markdown", "\n---", 1).alias("shown"))


@registered("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS title FROM customer")
def law_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.titles(shred(spread(standins.trees(spark, sf_dir)), columns=("begin", "end", "parent", "tag", "num", "content"), tags=("LawBody", "LawTitle")))


@registered(
    """SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS VARCHAR) AS num, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS ord, o_orderstatus AS chapter_path
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"""
)
def chapter_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of all laws with the titles above them."""
    return toc.chapter_paths(stored(shred(spread(standins.trees(spark, sf_dir)), columns=OUTLINED, tags=toc.TAGS))).select("doc_id", "num", "ord", "chapter_path")


@registered(
    """SELECT l_orderkey, l_linenumber, CASE WHEN q = 0 THEN 'SOURCE_TIMEOUT' WHEN q = 429 THEN 'SOURCE_RATE_LIMITED' WHEN q IS NOT NULL THEN 'SOURCE_API_ERROR' WHEN l_returnflag = 'R' THEN 'SOURCE_UNAVAILABLE' ELSE 'SOURCE_API_ERROR' END AS code,
      coalesce(q = 0 OR q = 429 OR q >= 500, TRUE) AS retryable
    FROM (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 429 WHEN l_quantity < 40 THEN 480 + CAST(l_quantity AS INTEGER) END AS q FROM lineitem)"""
)
def failed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as failed requests: by quantity timed out, refused for their rate, answered with a status, or without an answer for a cause."""
    q = F.col("l_quantity")
    status = F.when(q < 10, 0).when(q < 20, 429).when(q < 40, 480 + q.cast("int"))
    cause = F.when(F.col("l_returnflag") == "R", "connect ECONNREFUSED").otherwise("broken")
    error = http_error(status, F.lit("http://localhost/laws"), F.when(status.isNull(), cause))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", error["code"].alias("code"), error["retryable"].alias("retryable"))


@registered(
    f"""WITH {TREE_OUTLINE}, l AS (SELECT o.*, c_custkey, CASE WHEN tag = 'Article' THEN '  - 第' || num || '条 ' || caption ELSE '- ' || title END AS line,
      c_custkey % 3 = 0 OR lvl < c_custkey % 3 AS inside FROM o JOIN customer ON doc_id = CAST(c_custkey AS VARCHAR)),
    g AS (SELECT c_custkey, count(*) FILTER (WHERE inside) AS node_count, count(*) AS full_count, string_agg(line, chr(10) ORDER BY c, a) FILTER (WHERE inside) AS lines FROM l GROUP BY c_custkey)
    SELECT c.c_custkey AS req_id, coalesce(node_count, 0) AS node_count, c.c_custkey % 3 > 0 AS truncated, coalesce(node_count < full_count, FALSE) AS actually_cut,
      '# ' || c_name || ' — 目次' || coalesce(chr(10) || chr(10) || lines, '') AS shown FROM customer c LEFT JOIN g USING (c_custkey)"""
)
def get_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per customer, of depth 0 (all), 1 or 2."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_id"), F.col("c_name").alias("law_name"), F.lit(None).cast("string").alias("at"), (F.col("c_custkey") % 3).cast("int").alias("depth"))
    found = requests.get_toc(asked, standins.corpus(spark, sf_dir))
    return found.select("req_id", "node_count", "truncated", "actually_cut", F.rtrim(F.substring_index("markdown", "\n---", 1), F.lit("\n")).alias("shown"))


@registered(
    """SELECT c_custkey AS req_id, r.total, r.ord, CAST(o_orderkey AS VARCHAR) AS law_revision_id, o_orderpriority AS amendment_law_title, o_orderstatus AS current_revision_status FROM customer JOIN
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS ord, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) r ON o_custkey = c_custkey WHERE c_custkey % 4 = 0 OR r.ord <= c_custkey % 4"""
)
def get_law_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per customer for the newest 1 to 3 revisions, or all (0)."""
    known = standins.corpus(spark, sf_dir)
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    known.revisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("law_id"), F.col("o_orderkey").cast("string").alias("law_revision_id"), F.col("o_orderpriority").alias("amendment_law_title"), F.col("o_orderstatus").alias("current_revision_status"), newest.alias("api_ord"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_id"), F.col("c_name").alias("law_name"), (F.col("c_custkey") % 4).cast("int").alias("latest"))
    found = requests.get_law_revisions(asked, known).select("req_id", "total", F.posexplode("revisions").alias("i", "x"))
    return found.select("req_id", "total", (F.col("i") + 1).cast("long").alias("ord"), "x.law_revision_id", "x.amendment_law_title", "x.current_revision_status")


@registered(
    f"""WITH {ARTICLES}, q AS (SELECT o_orderkey AS req_id, c_custkey, c_name, o_orderkey, o_orderpriority, o_orderkey % 7 AS f, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN '1995-06-01' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN '1989-12-31' END AS day
      FROM orders JOIN customer ON o_custkey = c_custkey),
    x AS (SELECT q.*, f = 3 AS toc, i.l_returnflag = 'R' AS has_item, i.l_suppkey, i.l_partkey, i.p FROM q LEFT JOIN i ON i.l_orderkey = q.o_orderkey AND i.p = 1)
    SELECT req_id, CASE WHEN day = '1989-12-31' THEN 'SOURCE_API_ERROR' WHEN NOT toc AND p IS NULL AND f <> 6 THEN 'ARTICLE_NOT_FOUND' WHEN NOT toc AND f < 3 AND NOT has_item THEN 'ARTICLE_NOT_FOUND' END AS code,
      CASE WHEN coalesce(day, '') <> '1989-12-31' THEN CASE WHEN toc THEN 'toc' WHEN f IN (0, 4) AND p IS NOT NULL AND (f = 4 OR has_item) THEN 'json' WHEN (f < 3 AND has_item) OR f = 6 OR (f = 5 AND p IS NOT NULL) THEN 'markdown' END END AS format,
      CASE WHEN coalesce(day, '') <> '1989-12-31' AND f IN (0, 4) AND p IS NOT NULL AND (f = 4 OR has_item) THEN CASE f WHEN 0 THEN '1' END || '' END AS item_num,
      CASE WHEN coalesce(day, '') <> '1989-12-31' THEN CASE WHEN f = 0 AND has_item THEN '{{"tag":"Item","attr":{{"Num":"1"}},"children":[{{"tag":"ItemTitle","children":["一"]}},{{"tag":"ItemSentence","children":[{{"tag":"Sentence","children":["supplier ' || l_suppkey || '"]}}]}}]}}'
        WHEN f = 4 AND p IS NOT NULL THEN '{{"tag":"Paragraph","attr":{{"Num":"1"}},"children":[{{"tag":"ParagraphSentence","children":[{{"tag":"Sentence","children":["part ' || l_partkey || '"]}}]}}'
          || CASE WHEN has_item THEN ',{{"tag":"Item","attr":{{"Num":"1"}},"children":[{{"tag":"ItemTitle","children":["一"]}},{{"tag":"ItemSentence","children":[{{"tag":"Sentence","children":["supplier ' || l_suppkey || '"]}}]}}]}}' ELSE '' END || ']}}' END END AS node,
      CASE WHEN coalesce(day, '') <> '1989-12-31' AND (toc OR f = 6 OR (p IS NOT NULL AND (f IN (4, 5) OR has_item))) THEN CAST(c_custkey AS VARCHAR) || '|' || c_name || '|No. ' || c_custkey || '|2024-01-02T03:04:05.000Z|https://laws.e-gov.go.jp/law/' || c_custkey || '|' || coalesce(day, '-') END AS meta
    FROM x"""
)
def get_law_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per order by the form that its key falls to: an item as JSON (0) or Markdown (1, 2), an outline (3), a paragraph as JSON (4) or Markdown (5), an article (6), as of a day."""
    n, form = F.col("o_orderkey"), F.col("o_orderkey") % 7
    at = F.when(F.col("o_orderdate") < "1996-01-01", "1995-06-01").when(F.col("o_orderdate") < "1998-01-01", "1989-12-31")
    asked = table(spark, sf_dir, "orders").join(merging(table(spark, sf_dir, "customer")), F.col("o_custkey") == F.col("c_custkey")).select(
        n.alias("req_id"), F.col("c_name").alias("law_name"), n.cast("string").alias("article"), F.when(form < 6, 1).alias("paragraph"), F.when(form < 3, 1).alias("item"),
        F.when(form.isin(0, 4), "json").when(form == 3, "toc").when(form != 5, "markdown").alias("format"), at.alias("at"))
    found = requests.get_law(asked, standins.corpus(spark, sf_dir), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    meta = F.when(F.col("meta").isNotNull(), F.concat_ws("|", *[f"meta.{c}" for c in ("law_id", "title", "law_num", "retrieved_at", "url")], F.coalesce("meta.at", F.lit("-"))))
    return found.select("req_id", F.col("error.code").alias("code"), "format", F.col("data.item_num").cast("string").alias("item_num"), F.col("data.node").alias("node"), meta.alias("meta"))


@registered(
    """WITH a AS (SELECT o_custkey, o_orderstatus, o_orderkey, to_json(struct_pack(tag := 'Article', num := CAST(o_orderkey AS VARCHAR), title := 'Order ' || o_orderkey, caption := o_orderpriority)) AS j FROM orders),
    c AS (SELECT o_custkey, o_orderstatus, '{"tag":"Chapter","num":"' || o_orderstatus || '","title":"' || o_orderstatus || '","children":[' AS j, string_agg(left(j, -1) || ',"children":[]}', ',' ORDER BY o_orderkey) AS below FROM a GROUP BY ALL),
    t AS (SELECT o_custkey, string_agg(j || below || ']}', ',' ORDER BY o_orderstatus) AS whole, string_agg(j || ']}', ',' ORDER BY o_orderstatus) AS chapters FROM c GROUP BY ALL)
    SELECT c_custkey AS req_id, '[' || coalesce(CASE WHEN c_custkey % 2 = 0 THEN whole ELSE chapters END, '') || ']' AS toc FROM customer LEFT JOIN t ON o_custkey = c_custkey"""
)
def get_toc_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of all customers' laws as nested values, every other one cut to its first level."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_id"), F.col("c_name").alias("law_name"), F.lit(None).cast("string").alias("at"), F.when(F.col("c_custkey") % 2 == 1, 1).alias("depth"))
    found = requests.get_toc(asked, standins.corpus(spark, sf_dir))
    # a VARIANT has its keys in order; they are read out in that of the SQL
    entry = "tag string, num string, title string, caption string, children array<struct<tag string, num string, title string, caption string, children array<string>>>"
    return found.select("req_id", F.to_json(F.from_json(F.to_json("toc"), f"array<struct<{entry}>>")).alias("toc"))


BATCH_TOOLS = (*requests.TOOLS, "no_tool")


@registered(
    """WITH o AS (SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderstatus) AS chapters, min(o_orderkey) AS first FROM orders GROUP BY ALL)
    SELECT c_custkey AS req_id, CASE c_custkey % 8 WHEN 0 THEN 'search_law' WHEN 1 THEN 'get_law' WHEN 2 THEN 'get_toc' WHEN 3 THEN 'search_fulltext' WHEN 4 THEN 'resolve_abbreviation' WHEN 5 THEN 'get_law_revisions' WHEN 6 THEN 'explain_law_type' ELSE 'no_tool' END AS tool,
      c_custkey % 8 = 7 OR (c_custkey % 8 = 1 AND first IS NULL) AS is_error,
      CASE c_custkey % 8 WHEN 0 THEN CAST(s.n AS VARCHAR) WHEN 1 THEN CASE WHEN first IS NULL THEN 'INVALID_ARGUMENT' ELSE '{"tag":"Article","num":"' || first || '"}' END WHEN 2 THEN CAST(coalesce(orders + chapters, 0) AS VARCHAR) WHEN 3 THEN CAST(s.n AS VARCHAR)
        WHEN 4 THEN 'search_law' WHEN 5 THEN '1' WHEN 6 THEN '3' ELSE 'UNKNOWN_TOOL' END AS shown
    FROM customer c LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN (SELECT a.c_custkey AS k, least(count(*), 10) AS n FROM customer a JOIN customer b ON a.c_custkey % 8 IN (0, 3) AND contains(b.c_name, a.c_name) GROUP BY 1) s ON k = c_custkey"""
)
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per customer to one of the seven tools or to none, in one table."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("_k")).agg(F.min("o_orderkey").cast("string").alias("article"))
    which = F.col("c_custkey") % len(BATCH_TOOLS)
    given = F.to_json(F.struct(F.col("c_name").alias("law_name"), F.col("c_name").alias("keyword"), F.col("c_name").alias("abbr"), "article", F.lit("json").alias("format"), F.lit(" 政令 ").alias("name"), F.lit(3).alias("latest")))
    asked = table(spark, sf_dir, "customer").join(merging(first), F.col("c_custkey") == F.col("_k"), "left").select(F.col("c_custkey").alias("req_id"), F.get(F.array(*map(F.lit, BATCH_TOOLS)), which.cast("int")).alias("tool"), given.alias("arguments"))
    found = requests.answers(asked, standins.corpus(spark, sf_dir))
    of = lambda p: F.get_json_object("answer", p)
    node = F.to_json(F.struct(of("$.data.node.tag").alias("tag"), of("$.data.node.attr.Num").alias("num")))
    shown = F.coalesce(of("$.code"), F.when(F.col("tool") == "get_law", node), of("$.node_count"), of("$.total_count"), of("$.fallback.total_count"), of("$.total"), of("$.info.hierarchy_rank"), of("$.next_actions[0].action"))
    return found.select("req_id", "tool", "is_error", shown.alias("shown"))


def _parts(spark: SparkSession, sf_dir: str) -> requests.Corpus:
    return requests.Corpus(standins.laws(spark, sf_dir), None, None, aliases(spark), law_types(spark))


@registered(f"WITH {SEARCHED}, u AS (SELECT req_id, string_agg(CAST(p_partkey AS VARCHAR), ' ' ORDER BY rn) AS ids FROM h WHERE rn <= lim GROUP BY req_id) SELECT CAST(r.req_id AS BIGINT) AS req_id, CASE WHEN trim(keyword) <> '' THEN keyword END AS keyword, CASE WHEN trim(keyword) <> '' THEN coalesce(ids, '') END AS ids, CASE WHEN trim(keyword) = '' THEN 'INVALID_ARGUMENT' END AS code FROM r LEFT JOIN u USING (req_id)")
def search_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requests.search_law(_requests(spark), _parts(spark, sf_dir))
    return found.select(F.col("req_id").cast("long").alias("req_id"), F.col("query.keyword").alias("keyword"), F.array_join(F.transform("results", lambda x: x["law_id"]), " ").alias("ids"), F.col("error.code").alias("code"))


@registered(
    """WITH r AS (SELECT c_custkey AS req_id, c_custkey % 50 = 49 AS blank, c_custkey % 6 = 5 AS by_alias, c_name,
        CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS kind, CASE WHEN c_custkey % 10 = 4 THEN c_custkey END AS num, CASE WHEN c_custkey % 4 = 3 THEN 0 END AS parity,
        c_custkey % 4 AS skip, least(6, CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE c_custkey % 5 END) AS lim FROM customer),
      w AS (SELECT *, CASE WHEN blank THEN '' WHEN by_alias THEN c_name WHEN req_id = 0 THEN 'Customer#' ELSE left(c_name, length(c_name) - 1) END AS kw FROM r),
      h AS (SELECT w.req_id, skip, lim, c.c_custkey AS law, c.c_acctbal AS sum, row_number() OVER (PARTITION BY w.req_id ORDER BY c.c_acctbal, CAST(c.c_custkey AS VARCHAR)) AS rn FROM w JOIN customer c ON kw <> '' AND contains(c.c_name, kw)
        AND (kind IS NULL OR kind = c.c_mktsegment) AND (num IS NULL OR num = c.c_custkey) AND (parity IS NULL OR parity = c.c_custkey % 2)),
      s AS (SELECT req_id, count(*) AS matched, count(*) FILTER (WHERE rn > skip AND rn <= skip + lim) AS total, string_agg(CAST(law AS VARCHAR), ' ' ORDER BY rn) FILTER (WHERE rn > skip AND rn <= skip + lim) AS ids FROM h GROUP BY ALL)
    SELECT req_id, CASE WHEN by_alias AND NOT blank THEN c_name END AS resolved, coalesce(total, 0) AS total_count, coalesce(matched, 0) AS matched_count, coalesce(ids, '') AS ids, CASE WHEN blank THEN 'INVALID_ARGUMENT' END AS code
    FROM w LEFT JOIN s USING (req_id)"""
)
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title search per customer by an abbreviation, a part of its name or, once, what all names share: by type, number and domain, some hits skipped, at most six shown, by balance."""
    customer, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    key = k.cast("string")
    laws = customer.select(key.alias("law_id"), F.col("c_name").alias("law_title"), F.concat(F.lit("No. "), key).alias("law_num"), F.col("c_mktsegment").alias("law_type"), F.col("c_acctbal").alias("src_ord"))
    named = customer.select(F.concat(F.lit("abbr "), key).alias("abbr"), F.col("c_name").alias("formal"), F.when(k % 2 == 0, "even").otherwise("odd").alias("domain"))
    part = F.concat(F.lit(" "), F.left("c_name", F.length("c_name") - 1), F.lit("\u3000"))
    keyword = F.when(k % 50 == 49, " ").when(k % 6 == 5, F.concat(F.lit("abbr "), key)).when(k == 0, "Customer#").otherwise(part)
    asked = customer.select(
        k.alias("req_id"), keyword.alias("keyword"), F.when(k % 3 == 1, F.col("c_mktsegment")).alias("law_type"), F.when(k % 10 == 4, F.concat(F.lit("No. "), key)).otherwise("").alias("law_num"),
        F.when(k % 4 == 3, "even").alias("domain"), (k % 4).cast("int").alias("skip"), F.nullif((k % 5).cast("int"), F.lit(0)).alias("lim"))
    found = search.search_titles(asked, laws, merging(named), max_limit=6)
    return found.select("req_id", "resolved", "total_count", "matched_count", F.array_join(F.transform("results", lambda x: x["law_id"]), " ").alias("ids"), F.col("error.code").alias("code"))


@registered("SELECT n_nationkey AS req_id, n_name AS abbr, CASE n_name WHEN 'NATION_1' THEN 'First Nation' WHEN 'NATION_2' THEN 'Second Nation' END AS formal, CASE WHEN n_name NOT IN ('NATION_1', 'NATION_2') THEN 'search_law' END AS next_action FROM nation")
def resolve_abbreviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _parts(spark, sf_dir)
    known.aliases = spark.createDataFrame([("NATION_1", "First Nation"), ("NATION_2", "Second Nation")], "abbr string, formal string")
    found = requests.resolve_abbreviation(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("req_id"), F.col("n_name").alias("abbr")), known)
    return found.select("req_id", "abbr", F.col("resolved.formal").alias("formal"), F.col("next_actions")[0]["action"].alias("next_action"))


@registered("SELECT p_partkey AS req_id, p_partkey % 4 < 3 AS found, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 2 END AS hierarchy_rank, p_partkey % 4 = 3 AS listed FROM part")
def explain_law_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per part: a name, an alias, a code, or the part's type, which is none."""
    case = F.col("p_partkey") % 4
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("req_id"), F.when(case == 0, " 政令 ").when(case == 1, "施行規則").when(case == 2, "Act").otherwise(F.col("p_type")).alias("name"))
    found = requests.explain_law_type(asked, _parts(spark, sf_dir))
    return found.select("req_id", "found", F.col("info.hierarchy_rank").alias("hierarchy_rank"), F.col("known").isNotNull().alias("listed"))


@registered(
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN CASE WHEN n > 0 THEN 'repealed, still in force' ELSE 'repealed' END
      WHEN o_orderstatus = 'O' THEN 'not yet in force' WHEN o_orderstatus = 'P' THEN 'superseded' ELSE 'in force' END AS label
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revisions: by status not yet in force, superseded or current, repealed by priority, and still in force with a returned line."""
    returned = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    rows = table(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    current = F.when(F.col("o_orderstatus") == "O", "UnEnforced").when(F.col("o_orderstatus") == "P", "PreviousEnforced").otherwise("CurrentEnforced")
    repeal = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "Repeal").otherwise("None")
    return rows.select("o_orderkey", history.status_label(current, repeal, F.coalesce(F.col("n") > 0, F.lit(False))).alias("label"))


@registered("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that an increment with a word spelled otherwise changes."""
    old = table(spark, sf_dir, "documents").select("doc_id", "text")
    return history.changed(old, old.withColumn("text", F.replace("text", F.lit("License"), F.lit("Licence"))), "doc_id", "text").select("doc_id")


@registered("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after an increment of those with a returned line."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return history.upsert(old, old.join(returned, "o_orderkey", "left_semi").withColumn("o_orderstatus", F.lit("R")), "o_orderkey")


@registered("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As upsert_orders, in a table of buckets."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    path = f"{checkpoint_dir(spark)}/buckets/{uuid.uuid4().hex}"
    buckets.merge(spark, path, old, "o_orderkey", "o_orderstatus", 16)
    buckets.merge(spark, path, old.join(returned, "o_orderkey", "left_semi").withColumn("o_orderstatus", F.lit("R")), "o_orderkey", "o_orderstatus")
    return buckets.read(spark, path, "o_orderkey long, o_orderstatus string")


@registered(
    """SELECT o_orderkey, CASE WHEN d <= 1 THEN 'fresh' WHEN d <= 90 THEN 'aging' ELSE 'stale' END AS label FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS d FROM orders)"""
)
def sync_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", history.staleness(F.col("o_orderdate"), F.lit("2001-08-02").cast("date")).alias("label"))


@registered("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def era_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written by era and in kanji, read again."""
    day = F.col("o_orderdate").cast("date")
    spelled = F.concat(F.lit("平成"), kanji_numeral(F.year(day) - 1988), F.lit("年"), kanji_numeral(F.month(day)), F.lit("月"), kanji_numeral(F.dayofmonth(day)), F.lit("日"))
    return table(spark, sf_dir, "orders").select("o_orderkey", era_date(spelled).cast("string").alias("day"))


@registered(
    """WITH d AS (SELECT l_partkey % 9999 + 1 AS n FROM lineitem),
    p AS (SELECT DISTINCT n, n // 1000 AS k, n // 100 % 10 AS h, n // 10 % 10 AS t, n % 10 AS o FROM d)
    SELECT '第' || CASE k WHEN 0 THEN '' WHEN 1 THEN '千' ELSE substr('一二三四五六七八九', k, 1) || '千' END
      || CASE h WHEN 0 THEN '' WHEN 1 THEN '百' ELSE substr('一二三四五六七八九', h, 1) || '百' END
      || CASE t WHEN 0 THEN '' WHEN 1 THEN '十' ELSE substr('一二三四五六七八九', t, 1) || '十' END
      || CASE o WHEN 0 THEN '' ELSE substr('一二三四五六七八九', o, 1) END || '条の二' AS label, CAST(n AS VARCHAR) || '_2' AS num FROM p"""
)
def article_num_from_kanji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers of all line items as labels in kanji, read again."""
    spelled = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 9999 + 1).alias("n")).distinct()
    return spelled.select(F.concat(F.lit("第"), kanji_numeral(F.col("n")), F.lit("条の二")).alias("label")).withColumn("num", article_num_kanji(F.col("label")))


@registered(
    """SELECT l_orderkey, l_shipdate, l_partkey FROM (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1"""
)
def newest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of each order's updates, its lines by ship date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("l_shipdate"))
    return newest(lines, "l_orderkey", "l_shipdate")


@registered("SELECT p_partkey, p_name AS folded FROM part")
def width_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in full width, folded again."""
    ascii_ = "".join(map(chr, range(0x21, 0x7F))) + " "
    wide = F.translate("p_name", ascii_, "".join(chr(ord(c) + 0xFEE0) for c in ascii_[:-1]) + "　")
    return table(spark, sf_dir, "part").select("p_partkey", fold_width(wide).alias("folded"))


@registered(
    """SELECT p_partkey, replace(replace(replace(replace(translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'アイウエオカキクケコサシスセソタチツテトナニヌネノハ'), ' ', 'ガ'), 'カ゛', 'ガ'), '_', '゜'), '#', 'パ') AS folded
    FROM part"""
)
def kana_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with their letters as half-width katakana and their spaces as a voiced one, in full width."""
    kana = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz_", "ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾟ")
    return table(spark, sf_dir, "part").select("p_partkey", fold_kana(F.replace(F.replace(kana, F.lit(" "), F.lit("ｶﾞ")), F.lit("#"), F.lit("ﾊﾟ"))).alias("folded"))


@registered("SELECT conv_id, count(*) AS paragraphs, sum(length(text)) AS n_chars FROM conversations GROUP BY conv_id")
def shred_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON trees, shredded again into rows."""
    turns = table(spark, sf_dir, "conversations")
    leaf = F.struct(F.lit("Paragraph").alias("tag"), F.struct(F.col("turn").cast("string").alias("Num")).alias("attr"), F.array("text").alias("children"))
    bodies = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(leaf)).alias("children"))
    docs = bodies.select("conv_id", F.to_json(F.struct(F.lit("Article").alias("tag"), "children")).alias("body"))
    rows = shred(docs, "conv_id")
    return rows.groupBy("conv_id").agg(F.count(F.when(F.col("tag") == "Paragraph", 1)).alias("paragraphs"), F.sum(F.length("text")).alias("n_chars"))


@registered(
    """WITH a AS (SELECT o_custkey, count(*) AS articles, count(DISTINCT o_orderstatus) AS chapters FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey),
    l AS (SELECT o_custkey, count(*) AS paragraphs, count(*) FILTER (WHERE l_returnflag = 'R') AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 5 + 3 * coalesce(chapters, 0) + 5 * coalesce(articles, 0) + 4 * coalesce(paragraphs, 0) + 6 * coalesce(items, 0) AS n_rows, coalesce(articles, 0) AS articles,
      coalesce(paragraphs, 0) AS paragraphs, coalesce(items, 0) AS items FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey"""
)
def shred_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of all customers by the table function, of whose columns the query names three and of whose tags four; the root ends where all rows do."""
    register_shredder(spark)
    of = lambda tag: f"count_if(tag = '{tag}') AS {tag.lower()}s"
    return spark.sql(
        f"SELECT doc_id, max(end) AS n_rows, {of('Article')}, {of('Paragraph')}, {of('Item')} FROM {{docs}}, LATERAL shred_tree(body, 'begin end tag', 'Law Article Paragraph Item') GROUP BY doc_id",
        docs=spread(standins.trees(spark, sf_dir)),
    )


@registered("SELECT conv_id, turn, trim(text, ' 　' || chr(9) || chr(10) || chr(13)) AS text FROM conversations")
def trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", trim_wide(F.col("text")).alias("text"))


@registered(
    """SELECT CAST(o_custkey AS VARCHAR) AS doc_id, count(DISTINCT o_orderkey) AS articles, count(l_orderkey) AS paragraphs
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_custkey"""
)
def section_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the chapter F of each customer's law."""
    held = standins.corpus(spark, sf_dir)
    wanted = held.laws.select(F.col("law_id").alias("doc_id"), F.lit("Chapter").alias("tag"), F.lit("F").alias("num"))
    of = lambda tag: F.count(F.when(F.col("node.tag") == tag, 1))
    nodes = stored(shred(spread(held.bodies), columns=("begin", "end", "tag", "num"), tags=("Chapter", "Article", "Paragraph")))
    return tree.sections(nodes, wanted).groupBy("doc_id").agg(of("Article").alias("articles"), of("Paragraph").alias("paragraphs"))
