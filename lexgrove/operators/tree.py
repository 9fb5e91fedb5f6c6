"""Navigation in shredded trees (see sources.nodes): text, children, subtrees, articles, paragraphs, items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.session import merging


def ordered_text(order: Column, text: Column, separator: str = "") -> Column:
    """Aggregate: texts joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("text")))), lambda x: x["text"]), separator)


def parent_path(path: Column) -> Column:
    return F.slice(path, 1, F.size(path) - 1)


def spanned(nodes: DataFrame, anchors: DataFrame, key: str = "doc_id") -> DataFrame:
    """anchors with begin and end, looked up by path if they have only that."""
    if "begin" in anchors.columns:
        return anchors
    spans = nodes.select(F.col(key).alias("_k"), F.col("path").alias("_p"), "begin", "end")
    return anchors.join(merging(spans), (F.col(key) == F.col("_k")) & (F.col("path") == F.col("_p")), "left").drop("_k", "_p")


def within(rows: DataFrame, anchors: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """key, begin, end and `inside` of each different anchor (key, begin, end): the rows (key, begin) from its begin to before its end, in order, as structs of begin and `fields`.

    A merge of both sides in document order: one shuffle by document and one sort. A running count of rows
    says at an anchor's begin and end which stretch of its document's rows it contains, so neither side meets the other pair by pair,
    however deep anchors are nested. A document's rows are together once, as in its JSON text.
    """
    spans = anchors.where("begin is not null and end is not null").select(F.col(key).alias("_k"), "begin", "end").distinct()
    asked = rows.join(merging(spans.select(F.col("_k").alias(key)).distinct()), key, "left_semi")
    item = F.struct("begin", *[F.col(f) for f in fields if f != "begin"])
    mark = F.struct("begin", "end")
    none = lambda df, e: F.lit(None).cast(df.select(e).schema[0].dataType)
    events = asked.select(F.col(key).alias("_k"), F.col("begin").alias("_at"), item.alias("_item"), none(spans, mark).alias("_mark"))
    for edge in ("begin", "end"):
        events = events.union(spans.select("_k", F.col(edge), none(asked, item), mark))
    # a mark comes before the row at its place
    before = Window.partitionBy("_k").orderBy("_at", F.col("_item").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("_n", F.count("_item").over(before).cast("int"))
    marks = F.array_sort(F.collect_list(F.when(F.col("_mark").isNotNull(), F.struct("_mark", "_n"))))
    docs = counted.groupBy("_k").agg(F.array_sort(F.collect_list("_item")).alias("_items"), marks.alias("_marks"))
    # anchors differ, so that the two marks of each follow one another
    pair = lambda i: (F.get("_marks", 2 * i), F.get("_marks", 2 * i + 1))
    cut = lambda a, b: F.struct(a["_mark"].alias("span"), F.slice("_items", a["_n"] + 1, b["_n"] - a["_n"]).alias("inside"))
    each = F.transform(F.sequence(F.lit(0), (F.size("_marks") / 2).cast("int") - 1), lambda i: cut(*pair(i)))
    found = docs.where(F.size("_marks") > 0).select(F.col("_k").alias(key), F.explode(each).alias("_x"))
    return found.select(key, "_x.span.begin", "_x.span.end", "_x.inside")


def node_text(nodes: DataFrame, anchors: DataFrame, key: str = "doc_id") -> DataFrame:
    """anchors (key, begin and end or path, more) with `whole`: the text below each in document order, '' if there is none."""
    placed = spanned(nodes, anchors, key)
    found = within(nodes.where(F.col("text").isNotNull()).select(key, "begin", "text"), placed, ["text"], key)
    texts = found.select(F.col(key).alias("_k"), F.col("begin").alias("_b"), F.col("end").alias("_e"), F.array_join("inside.text", "").alias("_t"))
    joined = placed.join(merging(texts), (F.col(key) == F.col("_k")) & (F.col("begin") == F.col("_b")) & (F.col("end") == F.col("_e")), "left")
    return joined.select(*anchors.columns, F.coalesce("_t", F.lit("")).alias("whole"))


def nested_json(rows: Column, piece: str, depth: str) -> Column:
    """JSON of rows in document order: each one's piece, a comma before it unless it is its parent's first child, and the brackets that it closes.

    A piece that ends in `[` is open; the rows that follow at a greater depth are its children. The first row is the top.
    """
    at = lambda i: F.get(rows, i)
    own = lambda x, i: x[depth] + F.endswith(x[piece], F.lit("[")).cast("int") - F.coalesce(at(i + 1)[depth], at(F.lit(0))[depth])
    comma = lambda x, i: F.when((i > 0) & (at(i - 1)[depth] >= x[depth]), ",").otherwise("")
    return F.array_join(F.transform(rows, lambda x, i: F.concat(comma(x, i), x[piece], F.repeat(F.lit("]}"), own(x, i)))), "")


def subtrees(nodes: DataFrame, anchors: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, begin, end and json of each different anchor: its subtree as it was, joined from the rows of its stretch (with head, closes and shut)."""
    pieces = nodes.select(key, "begin", "shut", F.concat("head", F.repeat(F.lit("]}"), F.col("closes"))).alias("piece"))
    found = within(pieces, anchors, ["shut", "piece"], key).where(F.size("inside") > 0)
    whole = found.select(key, "begin", "end", F.array_join("inside.piece", "").alias("_j"), F.col("inside")[0]["shut"].alias("_shut"))
    # without the comma before the first and the ends of what is around it
    first = F.startswith("_j", F.lit(",")).cast("int")
    return whole.select(key, "begin", "end", F.substring("_j", first + 1, F.length("_j") - first - 2 * F.col("_shut")).alias("json"))


def bodies(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and body: each document's JSON, joined from all its rows (with head and closes)."""
    return nodes.groupBy(key).agg(ordered_text(F.col("begin"), F.concat("head", F.repeat(F.lit("]}"), F.col("closes")))).alias("body"))


def children(nodes: DataFrame, parents: DataFrame, tag: str, num: str | None = None, first: bool = False, key: str = "doc_id") -> DataFrame:
    """parents (key, begin or path, more) with `child`, a struct of a direct child's columns, for each child of the tag.

    num names a column of parents that the child's num must equal. With first, only the
    first child in document order, and parents without one keep a null; else those have no row.
    """
    at = "begin" if "begin" in parents.columns else "path"
    above = F.col("parent") if at == "begin" else parent_path(F.col("path"))
    fields = [c for c in ("begin", "end", "path", "num", "content") if c in nodes.columns]
    found = nodes.where(F.col("tag") == tag).select(F.col(key).alias("_k"), above.alias("_p"), *([F.col("num").alias("_n")] if num else []), F.struct(*fields).alias("child"))
    on = (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_p"))
    if num:
        on = on & (F.col(num).cast("string") == F.col("_n"))
    if not first:
        return parents.join(merging(found), on).drop("_k", "_p", "_n")
    # a parent's first child of each number is one row before parents meet it; children that differ by number gain nothing from
    # an aggregation before the shuffle, which would sort them as they are made: they are sorted once, where they meet
    if num:
        found = found.repartition("_k", "_p", "_n")
    held = found.groupBy("_k", "_p", *(["_n"] if num else [])).agg(F.min_by("child", F.col("child")[fields[0]]).alias("child"))
    return parents.join(merging(held), on, "left").select(*parents.columns, "child")


def find_articles(nodes: DataFrame, wanted: DataFrame, num: str = "article", key: str = "doc_id") -> DataFrame:
    """wanted (key, num, more) with `found`: the first Article of that number in document order, at any depth, or null."""
    fields = [c for c in ("begin", "end", "path", "num") if c in nodes.columns]
    own = nodes.where(F.col("tag") == "Article")
    first = own.groupBy(F.col(key).alias("_k"), F.col("num").alias("_first")).agg(F.min_by(F.struct(*fields), F.col(fields[0])).alias("found"))
    return wanted.join(merging(first), (F.col(key) == F.col("_k")) & (F.col(num) == F.col("_first")), "left").drop("_k", "_first")


def titles(nodes: DataFrame, tag: str = "LawTitle", key: str = "doc_id") -> DataFrame:
    """key and title: text of LawBody/LawTitle; no row for a document without one."""
    # one pass over the nodes, which may be parsed as they are read
    held = nodes.where(F.col("tag").isin("LawBody", tag)).groupBy(key).agg(
        F.min(F.when(F.col("tag") == "LawBody", F.col("begin"))).alias("_body"), F.collect_list(F.when(F.col("tag") == tag, F.struct("begin", "parent", "content"))).alias("_titles"))
    first = held.select(key, F.array_min(F.filter("_titles", lambda x: x["parent"] == F.col("_body"))).alias("_first"))
    return first.where("_first is not null").select(key, F.coalesce("_first.content", F.lit("")).alias("title"))


def sections(nodes: DataFrame, wanted: DataFrame, tag: str = "tag", num: str = "num", key: str = "doc_id") -> DataFrame:
    """The nodes of a part of a document, of the element itself and of all below it, for each row of wanted (key, tag, num, more).

    The element is the first of that tag and number in document order. Rows are wanted's columns with `section` (its path, if nodes have paths, else its begin) and `node`
    (a struct of the columns of nodes); a part that is not there, or a null, has none.
    """
    asked = wanted.select(key, F.col(tag).alias("_tag"), F.col(num).alias("_num")).distinct()
    at = "path" if "path" in nodes.columns else "begin"
    named = nodes.select(F.col(key).alias("_k"), F.col("tag").alias("_t"), F.col("num").alias("_n"), "begin", F.struct(*dict.fromkeys(["begin", "end", at])).alias("_span"))
    on = (F.col(key) == F.col("_k")) & (F.col("_tag") == F.col("_t")) & (F.col("_num").cast("string") == F.col("_n"))
    found = merging(asked).join(named, on).groupBy(F.col(key).alias("_key"), "_tag", "_num").agg(F.min_by("_span", "begin").alias("_span"))
    found = found.select("_key", "_tag", "_num", F.col("_span.begin").alias("_b"), F.col("_span.end").alias("_e"), F.col(f"_span.{at}").alias("section"))
    fields = [c for c in nodes.columns if c != key]
    parts = within(nodes, found.select(F.col("_key").alias(key), F.col("_b").alias("begin"), F.col("_e").alias("end")), fields, key)
    parts = parts.select(F.col(key).alias("_d"), F.col("begin").alias("_db"), F.col("end").alias("_de"), "inside")
    rows = wanted.join(merging(found), (F.col(key) == F.col("_key")) & (F.col(tag) == F.col("_tag")) & (F.col(num) == F.col("_num")))
    met = rows.join(merging(parts), (F.col(key) == F.col("_d")) & (F.col("_b") == F.col("_db")) & (F.col("_e") == F.col("_de")))
    return met.select(*wanted.columns, "section", F.explode("inside").alias("node"))
