"""Title search and full-text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.functions.text import fold_width, has_all_terms, trim_wide
from lexgrove.operators.errors import make_error
from lexgrove.operators.lookup import searched_title, title_hits, with_alias
from lexgrove.session import merging


def search_titles(requests: DataFrame, laws: DataFrame, aliases: DataFrame, default_limit: int = 10, order: tuple[str, ...] = ("src_ord",), max_limit: int | None = None, parts: int = 64) -> DataFrame:
    """A row per request (req_id, keyword, law_type, lim): resolved, total_count, matched_count, results and error.

    Titles contain the alias's formal name or the trimmed keyword; law_type is matched if set, and so are law_num and
    domain (that of an alias whose formal name is the title) where requests have such columns.
    results holds the first `lim` (null: default_limit; at most max_limit, if set) hits in source order, after `skip` of them where requests have such a column, total_count
    their number, matched_count that of all. Hits alike in `order` come by law_id. A blank or null keyword is INVALID_ARGUMENT.

    Requests that ask for the same are answered once. A keyword may be in most titles: a request's hits are counted and cut to the first that it can show in `parts` parts each by itself, and only what is left of
    them meets in one place.
    """
    given = lambda name, kind: (F.col(name) if name in requests.columns else F.lit(None)).cast(kind)
    asked = with_alias(requests, aliases, "keyword").withColumn("_kw", searched_title(F.col("keyword")))
    most = F.least(F.coalesce("lim", F.lit(default_limit)), F.lit(max_limit))
    # what is asked for goes with its hits; a null or blank filter is none
    set_ = lambda name: F.nullif(given(name, "string"), F.lit(""))
    ask = F.struct(F.col("_kw").alias("_word"), set_("law_type").alias("_type"), set_("law_num").alias("_num"), set_("domain").alias("_domain"), F.coalesce(given("skip", "int"), F.lit(0)).alias("_skip"), most.alias("_lim"))
    asked = asked.withColumn("_ask", ask)
    hits = title_hits(asked.where(F.col("_kw").isNotNull()).select("_ask", "_kw").distinct(), laws, "_ask", "_kw").select("_ask", "_ask.*", *laws.columns)
    for asked_for, own in (("_type", "law_type"), ("_num", "law_num")):
        hits = hits.where(F.col(asked_for).isNull() | (F.col(asked_for) == F.col(own)))
    if "domain" in requests.columns:
        domains = aliases.select(F.col("formal").alias("_formal"), F.col("domain").alias("_in")).distinct()
        hits = hits.join(domains, (F.col("law_title") == F.col("_formal")) & (F.col("_domain") == F.col("_in")), "left").where(F.col("_domain").isNull() | F.col("_in").isNotNull())
    first = [*order, "law_id"]
    own_part = Window.partitionBy("_ask", F.pmod(F.xxhash64("law_id"), F.lit(parts)))
    counted = hits.withColumn("_rn", F.row_number().over(own_part.orderBy(*first))).withColumn("_all", F.when(F.col("_rn") == 1, F.count(F.lit(1)).over(own_part)))
    # the first of each part stays for its count
    kept = counted.where((F.col("_rn") == 1) | (F.col("_rn") <= F.col("_skip") + F.col("_lim")))
    ranked = kept.withColumn("_rn", F.row_number().over(Window.partitionBy("_ask").orderBy(*first)))
    fields = [F.col(c).alias("title" if c == "law_title" else c) for c in ("law_id", "law_title", "law_num", "law_type", "promulgation_date", "url") if c in laws.columns]
    shown = (F.col("_rn") > F.col("_skip")) & (F.col("_rn") <= F.col("_skip") + F.col("_lim"))
    best = ranked.groupBy(F.col("_ask").alias("_r")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("_rn", F.struct(*fields).alias("hit"))))), lambda x: x["hit"]).alias("results"), F.sum("_all").alias("matched_count"))
    blank = F.coalesce(trim_wide(F.col("keyword")), F.lit("")) == ""
    error = F.when(blank, make_error("INVALID_ARGUMENT", "keyword is blank", "Give a title, an abbreviation or a part of one."))
    joined = asked.join(merging(best), F.col("_ask") == F.col("_r"), "left")
    empty = F.array().cast(best.schema["results"].dataType)
    return joined.select("req_id", "keyword", "law_type", F.col("alias.formal").alias("resolved"), F.size(F.coalesce("results", empty)).cast("long").alias("total_count"), F.coalesce("matched_count", F.lit(0)).cast("long").alias("matched_count"), F.coalesce("results", empty).alias("results"), error.alias("error"))


def fulltext(documents: DataFrame, words: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose text has all terms, by scanning the texts."""
    return documents.where(has_all_terms(F.col(text), F.lit(words)))


def gram_index(documents: DataFrame, key: str = "doc_id", text: str = "text", only: str | None = None) -> DataFrame:
    """Inverted index: gram (a pair of characters, widths folded) and key, each pair once; see write_index.

    With `only`, search words, it has their pairs alone, which are looked for in the texts one by one, without a row for every other pair.
    """
    if only is not None:
        body = fold_width(F.col(text))
        held = F.filter(F.array(*[F.when(F.contains(body, F.lit(g)), F.lit(g)) for g in _pairs(only)]).cast("array<string>"), lambda g: g.isNotNull())
        return documents.select(F.explode(held).alias("gram"), F.col(key))
    # zipped with itself one further, so that the work is linear in the length of the text
    chars = F.split(fold_width(F.col(text)), "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))
    return documents.where(F.length(text) > 1).select(F.explode(F.array_distinct(F.array_compact(pairs))).alias("gram"), F.col(key))


def _pairs(words: str) -> list[str]:
    """The character pairs of search words, widths folded."""
    folded = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in words)
    return sorted({t[i : i + 2] for t in folded.split() for i in range(len(t) - 1)})


def _shelf(gram: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(shelves)).cast("int")


def write_index(index: DataFrame, path: str, shelves: int = 64) -> None:
    """The index as a table in folders by a hash of the gram, sorted by gram: a search reads its grams' folders alone. Grams are salted, so none is written by one task."""
    placed = index.withColumns({"shelf": _shelf(F.col("gram"), shelves), "_salt": F.pmod(F.xxhash64(*index.columns), F.lit(8))})
    placed.repartition("shelf", "_salt").drop("_salt").sortWithinPartitions("shelf", "gram").write.mode("overwrite").partitionBy("shelf").parquet(path)


def read_index(spark: SparkSession, path: str, words: str, shelves: int = 64) -> DataFrame:
    """What a search for `words` needs of an index that write_index wrote with as many shelves."""
    grams = _pairs(words)
    wanted = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_shelf(F.col("g"), shelves)).distinct().collect()]
    return spark.read.parquet(path).where(F.col("shelf").isin(*wanted) & F.col("gram").isin(*grams)).drop("shelf")


def indexed_fulltext(documents: DataFrame, index: DataFrame, words: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As fulltext: the index gives the keys that have all the terms' character pairs, the texts of those are then read."""
    grams = _pairs(words)
    if not grams:
        return fulltext(documents, words, key, text)
    keys = index.where(F.col("gram").isin(*grams)).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams)).select(key)
    return fulltext(documents.join(merging(keys), key, "left_semi"), words, key, text)
