"""Outlines of documents: extraction, depth limit, size, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.functions.text import article_label, strip_item_marker, trim_wide
from lexgrove.operators.tree import nested_json, ordered_text, spanned, within
from lexgrove.session import merging
from lexgrove.sources.nodes import STRUCTURAL


#: Tags of the elements that outlines and chapter paths are made of: no other rows are looked at.
TAGS = (*STRUCTURAL, "Article", *[f"{tag}Title" for tag in (*STRUCTURAL, "Article")], "ArticleCaption")


def extract(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, path (if nodes have it), begin, end, level, tag, num, title and caption of each outline row.

    Structural elements and articles outside articles are rows; level is the number of
    structural elements above, so other elements are transparent. An element's title
    is the text of its <tag>Title (null for an article without one), an article's caption that of its ArticleCaption.
    """
    at = [c for c in ("path", "begin", "end") if c in nodes.columns]
    own = F.when(F.col("tag").isin(*STRUCTURAL, "Article") & ~F.col("in_article"), F.struct(*dict.fromkeys([*at, "begin"]), "level", "tag", "num"))
    named = [f"{tag}Title" for tag in (*STRUCTURAL, "Article")] + ["ArticleCaption"]
    # rows and labels meet at the element's begin in one pass over the nodes, which may be parsed as they are read
    placed = nodes.select(key, F.when(own.isNotNull(), F.col("begin")).when(F.col("tag").isin(*named), F.col("parent")).alias("_p"), own.alias("_own"), F.col("tag").alias("_t"), F.struct("begin", "content").alias("_label"))
    # the first label of each kind; of a row's kinds only its own title and the caption are looked at
    met = placed.where("_p is not null").groupBy(key, "_p").agg(F.collect_list("_own").alias("_rows"), *[F.min(F.when(F.col("_t") == t, F.col("_label"))).alias(t) for t in named])
    joined = met.select(key, F.explode("_rows").alias("_own"), *named).select(key, "_own.*", *named)
    title = F.coalesce(*[F.when(F.col("tag") == tag, F.col(f"{tag}Title.content")) for tag in (*STRUCTURAL, "Article")])
    article, caption = F.col("tag") == "Article", F.nullif(F.col("ArticleCaption.content"), F.lit(""))
    return joined.select(key, *at, "level", "tag", "num", F.when(article, F.nullif(title, F.lit(""))).otherwise(F.coalesce(title, F.lit(""))).alias("title"), F.when(article, caption).alias("caption"))


def limit_depth(outline: DataFrame, depth: int | None) -> DataFrame:
    """Rows with fewer than `depth` structural elements above them; all rows if depth is null or under 1."""
    return outline if depth is None or depth < 1 else outline.where(F.col("level") < depth)


def line(level: Column, tag: Column, num: Column, title: Column, caption: Column) -> Column:
    """An outline row as a list item, indented by two spaces a level."""
    article = F.concat(F.lit("第"), F.coalesce(article_label(num), F.lit("")), F.lit("条"), F.coalesce(F.concat(F.lit(" "), caption), F.lit("")))
    return F.concat(F.repeat(F.lit("  "), level), F.lit("- "), F.when(tag == "Article", article).otherwise(F.coalesce(title, F.lit(""))))


def listing(outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, node_count and lines (in document order) of each document's outline."""
    text = line(F.col("level"), F.col("tag"), F.col("num"), F.col("title"), F.col("caption"))
    return outline.groupBy(key).agg(F.count(F.lit(1)).alias("node_count"), ordered_text(F.col("begin" if "begin" in outline.columns else "path"), text, "\n").alias("lines"))


def nested(outline: DataFrame, by: list[str]) -> DataFrame:
    """by and `toc`: the outline rows (by, begin, level, tag, num, title, caption) of each group as nested JSON, a list of entries with children.

    Nulls are left out. Rows outside articles have all elements above them in the outline, so that level tells how deep
    an entry stands; an outline that is cut by level stays a whole one.
    """
    entry = F.to_json(F.struct("tag", "num", "title", "caption"))
    piece = F.concat(F.substring(entry, F.lit(1), F.length(entry) - 1), F.lit(',"children":['))
    rows = outline.select(*by, F.struct("begin", (F.col("level") + 1).alias("depth"), piece.alias("piece")).alias("_row"))
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    top = F.array(F.struct(F.lit(-1).cast("long").alias("begin"), F.lit(0).alias("depth"), F.lit("[").alias("piece")))
    whole = held.select(*by, F.concat(top, "_rows").alias("_rows"))
    # the list itself closes with a bracket alone
    return whole.select(*by, F.regexp_replace(nested_json(F.col("_rows"), "piece", "depth"), r"\}$", "").alias("toc"))


def chapter_paths(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, path, num, ord and chapter_path of each outline article: its structural titles from the top, joined by ' > '."""
    rows = extract(nodes, key)
    own = [c for c in ("path", "begin") if c in rows.columns]
    articles = rows.where("tag = 'Article'").withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("begin")).cast("long"))
    above = within(articles.select(key, "begin"), rows.where("tag <> 'Article'"), [], key).select(F.col(key).alias("_k"), F.col("begin").alias("_top"), F.explode("inside.begin").alias("_at"))
    titled = above.join(merging(rows.where("tag <> 'Article'").select(F.col(key).alias("_k3"), F.col("begin").alias("_b3"), "title")), (F.col("_k") == F.col("_k3")) & (F.col("_top") == F.col("_b3")))
    found = titled.groupBy(F.col("_k").alias("_k2"), F.col("_at").alias("_p2")).agg(ordered_text(F.col("_top"), F.col("title"), " > ").alias("chapter_path"))
    return articles.join(merging(found), (F.col(key) == F.col("_k2")) & (F.col("begin") == F.col("_p2")), "left").select(key, *own[:1], "num", "ord", F.coalesce("chapter_path", F.lit("")).alias("chapter_path"))


def _item_line(num: Column, content: Column) -> Column:
    return F.concat(F.coalesce(num, F.lit("")), F.lit(" "), strip_item_marker(trim_wide(F.coalesce(content, F.lit("")))))


def _block(num: Column, sentence: Column, items: Column) -> Column:
    label = F.when((num != "") & (num != "1"), F.concat(F.lit("**第"), num, F.lit("項**")))
    return F.concat_ws("\n", label, F.nullif(sentence, F.lit("")), items)


def paragraph_block(p: Column) -> Column:
    """A paragraph as Markdown (see blocks), given as a struct of num, sentence and items (structs of num and content) in order."""
    items = F.array_join(F.transform(p["items"], lambda x: _item_line(x["num"], x["content"])), "\n")
    return _block(p["num"], trim_wide(p["sentence"]), F.when(F.size(p["items"]) > 0, items))


def blocks(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, begin, parent and `block` of each paragraph as Markdown.

    A paragraph is its number if that is neither missing nor 1, the text of its first
    ParagraphSentence, and a line for each item. What is neither is left out.
    """
    item = _item_line(F.col("num"), F.col("content"))
    inner = nodes.where(F.col("tag").isin("ParagraphSentence", "Item")).select(F.col(key).alias("_k"), F.col("parent").alias("_p"), "tag", "begin", item.alias("_item"), trim_wide(F.col("content")).alias("_said"))
    said = F.min(F.when(F.col("tag") == "ParagraphSentence", F.struct("begin", "_said")))["_said"]
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "Item", F.struct("begin", "_item")))), lambda x: x["_item"]), "\n")
    held = inner.groupBy("_k", "_p").agg(said.alias("_sentence"), F.count(F.when(F.col("tag") == "Item", 1)).alias("_many"), items.alias("_items"))
    own = nodes.where(F.col("tag") == "Paragraph").select(key, "begin", "parent", "num")
    joined = own.join(merging(held), (F.col(key) == F.col("_k")) & (F.col("begin") == F.col("_p")), "left")
    return joined.select(key, "begin", "parent", _block(F.col("num"), F.col("_sentence"), F.when(F.col("_many") > 0, F.col("_items"))).alias("block"))


def paragraphs(nodes: DataFrame, articles: DataFrame, key: str = "doc_id") -> DataFrame:
    """articles (key, begin and end or path, more) that have paragraphs with `body`: these as Markdown, parted by blank lines."""
    placed = spanned(nodes, articles, key)
    whole = blocks(nodes, key).groupBy(F.col(key).alias("_k"), F.col("parent").alias("_p")).agg(ordered_text(F.col("begin"), F.col("block"), "\n\n").alias("body"))
    return placed.join(merging(whole), (F.col(key) == F.col("_k")) & (F.col("begin") == F.col("_p"))).select(*articles.columns, "body")
