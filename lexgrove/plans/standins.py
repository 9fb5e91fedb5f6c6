"""The given tables in the shape of trees, laws and revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.plans.requests import Corpus
from lexgrove.session import merging, table
from lexgrove.sources.aliases import aliases
from lexgrove.sources.law_types import law_types


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents with their nations as chapters and customers as articles."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    at = lambda *xs: F.array(F.lit(0), *[x.cast("int") for x in xs])
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, path, level: int, tag: str, num, title, caption) -> DataFrame:
        return df.select(F.col("r_regionkey").cast("long").alias("doc_id"), path.alias("path"), F.lit(level).alias("level"), F.lit(tag).alias("tag"), num.cast("string").alias("num"), title.alias("title"), caption.alias("caption"))

    parts = rows(region, at(F.col("r_regionkey")), 0, "Part", F.col("r_regionkey"), F.col("r_name"), none)
    chapters = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey"))
    articles = chapters.join(customer, F.col("n_nationkey") == F.col("c_nationkey"))
    return parts.unionByName(rows(chapters, at(F.col("r_regionkey"), F.col("n_nationkey")), 1, "Chapter", F.col("n_nationkey"), F.col("n_name"), none)).unionByName(
        rows(articles, at(F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")), 2, "Article", F.col("c_custkey"), none, F.col("c_mktsegment"))
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents: customers are articles, their orders by date paragraphs, the orders' lines items."""
    customer, orders, lineitem = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    ranked = orders.withColumn("p", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    lined = lineitem.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    held = customer.join(merging(ranked), F.col("c_custkey") == F.col("o_custkey"))
    below = held.join(merging(lined), F.col("o_orderkey") == F.col("l_orderkey"))

    def rows(df: DataFrame, path: list, tag: str, num, content) -> DataFrame:
        # begin leaves room for a million paragraphs and items each
        room = [40, 20, 0]
        steps = [F.shiftleft(F.col(c).cast("long"), n) for c, n in zip(path, room)]
        begin, parent = sum(steps[1:], steps[0]), sum(steps[1:-1], steps[0]) if len(path) > 1 else F.lit(-1).cast("long")
        return df.select(
            F.col("c_nationkey").cast("long").alias("doc_id"), F.array(F.lit(0), *[F.col(c).cast("int") for c in path]).alias("path"), begin.alias("begin"), (begin + (1 << room[len(path) - 1])).alias("end"), parent.alias("parent"),
            F.lit(tag).alias("tag"), num.cast("string").alias("num"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("level"), F.lit(tag != "Article").alias("in_article"), content.cast("string").alias("content"))

    return rows(customer, ["c_custkey"], "Article", F.col("c_custkey"), F.lit(None)).unionByName(rows(held, ["c_custkey", "p"], "Paragraph", F.col("p"), F.col("o_orderkey"))).unionByName(
        rows(below, ["c_custkey", "p", "i"], "Item", F.col("i"), F.col("l_partkey"))
    )


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as laws, in the order of name and key."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").cast("string").alias("law_id"), F.col("p_name").alias("law_title"), F.col("p_brand").alias("law_num"), F.col("p_type").alias("law_type"), F.struct("p_name", "p_partkey").alias("src_ord"))


def _node(tag: str, children, num=None):
    attr = F.concat(F.lit(',"attr":{"Num":"'), num.cast("string"), F.lit('"}')) if num is not None else F.lit("")
    return F.concat(F.lit(f'{{"tag":"{tag}"'), attr, F.lit(',"children":['), children, F.lit("]}"))


def _leaf(tag: str, text):
    return _node(tag, F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2))


def _plain(tag: str, text):
    """As _leaf, of a text that needs no escapes."""
    return _node(tag, F.concat(F.lit('"'), text, F.lit('"')))


def _joined(xs, body):
    """The bodies of an array's elements, parted by commas."""
    return F.array_join(F.transform(xs, body), ",")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as laws in JSON: order states are chapters, orders articles, lines paragraphs; a returned line has an item.

    Keys and numbers are brought together, first by order and then by customer, and texts are made of them where they have arrived: no text is shuffled or sorted. Laws are dealt by doc_id and stand in its order.
    """
    customer, orders, lineitem = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    dealt = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("returned")).repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "returned"))).alias("l"))
    held = orders.join(merging(lines), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # arrays of numbers take less room than an array of structs: 82 MB shuffled by customer over 6 x sf0.1, not 98
    said = F.struct("o_orderkey", "o_orderpriority", F.col("l.l_partkey").alias("parts"), F.col("l.l_suppkey").alias("suppliers"), F.col("l.returned").alias("returned"))
    articles = dealt(held.select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderstatus", said.alias("article")))
    chapters = articles.groupBy("doc_id", "o_orderstatus").agg(F.collect_list("article").alias("articles"))
    laws = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", F.array_sort("articles").alias("articles")))).alias("chapters"))
    customers = dealt(customer.select(F.col("c_custkey").cast("string").alias("doc_id"), "c_name"))
    law = customers.join(merging(laws.withColumnRenamed("doc_id", "_d")), F.col("doc_id") == F.col("_d"), "left")

    # a line's number is its place among its order's lines
    sentence = lambda part: _node("ParagraphSentence", _plain("Sentence", F.concat(F.lit("part "), part.cast("string"))))
    item = lambda supplier: _node("Item", F.concat_ws(",", _plain("ItemTitle", F.lit("一")), _node("ItemSentence", _plain("Sentence", F.concat(F.lit("supplier "), supplier.cast("string"))))), F.lit("1"))
    paragraph = lambda x: lambda part, i: _node("Paragraph", F.concat_ws(",", sentence(part), F.when(F.get(x["returned"], i), item(F.get(x["suppliers"], i)))), i + 1)
    heads = lambda x: [_leaf("ArticleCaption", x["o_orderpriority"]), _plain("ArticleTitle", F.concat(F.lit("Order "), x["o_orderkey"].cast("string")))]
    article = lambda x: _node("Article", F.concat_ws(",", *heads(x), _joined(x["parts"], paragraph(x))), x["o_orderkey"])
    chapter = lambda x: _node("Chapter", F.concat_ws(",", _leaf("ChapterTitle", x["o_orderstatus"]), _joined(x["articles"], article)), x["o_orderstatus"])
    main = _node("MainProvision", F.coalesce(_joined(F.col("chapters"), chapter), F.lit("")))
    return law.select("doc_id", _node("Law", _node("LawBody", F.concat_ws(",", _leaf("LawTitle", F.col("c_name")), main))).alias("body"))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Customers as laws with one revision each, whose bodies are `trees`."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    law = customer.select(key.alias("law_id"), F.col("c_name").alias("law_title"), F.concat(F.lit("No. "), key).alias("law_num"), F.lit("Act").alias("law_type"), F.col("c_custkey").alias("src_ord"))
    revision = customer.select(key.alias("law_id"), key.alias("law_revision_id"), F.lit("1990-01-01").cast("date").alias("enforcement_date"), F.lit(0).alias("api_ord"))
    return Corpus(law, revision, None, aliases(spark), law_types(spark), bodies=trees(spark, sf_dir))
