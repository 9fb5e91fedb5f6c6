"""The seven tool requests over a whole corpus: a row per request, an answer or an error on each."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.functions.text import article_num, heading, iso_instant, law_url, trim_wide
from lexgrove.operators import history, lookup, search, tree
from lexgrove.operators import outline as toc
from lexgrove.operators.errors import ERROR, detail, first_error, make_error, try_alias, try_later, try_search, try_toc
from lexgrove.session import cut, merging, stored
from lexgrove.sources.aliases import OWNER
from lexgrove.sources.nodes import OUTLINED, shred, spread

#: The wording of the Markdown footers and of the outline's title.
SOURCE_LINE, AT_LABEL, TIME_LABEL, OUTLINE_LABEL = "出典：e-Gov法令検索（デジタル庁）", "時点: ", "取得日時: ", " — 目次"
TOOLS = ("search_law", "get_law", "get_toc", "search_fulltext", "resolve_abbreviation", "get_law_revisions", "explain_law_type")


#: What is shown of a revision.
REVISION_FIELDS = (
    "law_revision_id", "amendment_promulgate_date", "amendment_enforcement_date", "amendment_enforcement_comment",
    "amendment_law_num", "amendment_law_title", "amendment_law_id", "current_revision_status",
)
#: A document's requests are answered in lists of so many.
LISTED = 10_000
log = logging.getLogger("lexgrove.requests")


@dataclass
class Corpus:
    """laws: law_id, law_title, law_num, law_type, promulgation_date, src_ord. revisions: law_id, law_revision_id,
    enforcement_date, api_ord and more. bodies: doc_id (a law_revision_id) and body (JSON trees), of which a request reads those it asks for;
    or nodes: all of them shredded (REQUESTED columns at least). aliases and law_types: see sources."""

    laws: DataFrame
    revisions: DataFrame
    nodes: DataFrame | None
    aliases: DataFrame
    law_types: DataFrame
    base_url: str = "https://laws.e-gov.go.jp/law/"
    owner: str = OWNER
    bodies: DataFrame | None = None
    #: Bodies that are fetched for the pairs (law_id, at) asked for, in place of revisions and bodies: law_id, at, doc_id, body and error (see plans.remote).
    fetch: Callable[[DataFrame], DataFrame] | None = None
    #: Names that are resolved already: law_name, alias and law.
    known: DataFrame | None = None


def resolved_names(requests: DataFrame, corpus: Corpus) -> DataFrame:
    return lookup.resolve(requests.select("law_name").distinct(), corpus.laws, corpus.aliases, key="law_name")


def _resolved(requests: DataFrame, corpus: Corpus) -> DataFrame:
    """requests with law and error: out of scope, then not found. A name is looked up once, however many requests have it."""
    names = resolved_names(requests, corpus) if corpus.known is None else corpus.known
    known = requests.join(merging(names.select(F.col("law_name").alias("_name"), "alias", "law")), F.col("law_name").eqNullSafe(F.col("_name")), "left").drop("_name")
    name = F.col("law_name")
    missing = F.when(F.col("law").isNull(), make_error("LAW_NOT_FOUND", F.concat(F.lit("no such law: "), F.coalesce(name, F.lit(""))), "Neither the aliases nor the titles have it; check the spelling.", [try_alias(name), try_search(name)]))
    return known.withColumn("error", first_error(lookup.scope_error(name, corpus.owner), missing)).drop("alias")


def _versioned(rows: DataFrame, corpus: Corpus) -> tuple[DataFrame, Corpus]:
    """rows with doc_id: the law's revision at `at`, or its newest by api_ord; an error if there is none. And the corpus that has these documents."""
    asked = rows.where("error is null").select(F.col("law.law_id").alias("law_id"), "at")
    if corpus.fetch is not None:
        got = stored(corpus.fetch(asked))
        corpus = replace(corpus, bodies=got.where("body is not null").select("doc_id", "body").dropDuplicates(["doc_id"]))
        best = got.select(F.col("law_id").alias("_l"), F.col("at").alias("_a"), "doc_id", F.col("error").alias("_failed"))
        met = rows.join(merging(best), (F.col("law.law_id") == F.col("_l")) & F.col("at").eqNullSafe(F.col("_a")), "left").drop("_l", "_a")
        none = F.col("_failed")
    else:
        versions = corpus.revisions.select("law_id", "law_revision_id", "enforcement_date", "api_ord")
        tie = [-F.col("api_ord"), F.col("law_revision_id")]
        days = asked.withColumn("_day", F.expr("try_to_date(at)"))
        dated = history.as_of_each(days, versions, "law_id", "_day", "enforcement_date", tie, F.col("law_revision_id")).select(F.col("law_id").alias("_l"), F.col("_day").alias("_a"), F.col("revision").alias("_dated"))
        newest = versions.groupBy(F.col("law_id").alias("_n")).agg(F.max_by("law_revision_id", F.struct(*tie)).alias("_newest"))
        met = rows.join(merging(dated), (F.col("law.law_id") == F.col("_l")) & (F.expr("try_to_date(at)") == F.col("_a")), "left").join(merging(newest), F.col("law.law_id") == F.col("_n"), "left")
        wanted = F.col("error").isNull()
        met = met.withColumn("doc_id", F.when(wanted, F.when(F.col("at").isNull(), F.col("_newest")).otherwise(F.col("_dated")))).drop("_l", "_a", "_n", "_dated", "_newest")
        none = F.when(F.col("doc_id").isNull(), make_error("SOURCE_API_ERROR", "no revision of the law at that time", retryable=False))
    return met.withColumn("error", first_error(F.col("error"), none)).drop("_failed"), corpus


def _located(requests: DataFrame, corpus: Corpus) -> tuple[DataFrame, Corpus]:
    """requests with law, doc_id and error, and the corpus that has these documents: a pair of name and time is looked up once and meets the requests that have it once, without what else they hold."""
    pairs, corpus = _versioned(_resolved(requests.select("law_name", "at").distinct(), corpus), corpus)
    known = pairs.select(F.col("law_name").alias("_name"), F.col("at").alias("_at"), "law", "doc_id", "error")
    return requests.join(merging(known), F.col("law_name").eqNullSafe(F.col("_name")) & F.col("at").eqNullSafe(F.col("_at")), "left").drop("_name", "_at"), corpus


def _parts(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """rows (doc_id, form, num, paragraph, item and more) with what each asks of its document (see sources.nodes.PARTS).

    Requests come to their documents, in lists of at most LISTED, and no element of a document becomes a row: what is shuffled are the requests, and bodies once unless they
    are dealt by doc_id already.
    """
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(0)))
    listed = dealt.withColumn("block", F.floor((place - 1) / LISTED).cast("int"))
    lists = listed.groupBy("doc_id", "block").agg(F.collect_list(F.struct(*[c for c in listed.columns if c != "doc_id"])).alias("asked"))
    bodies = corpus.bodies if corpus.bodies is not None else tree.bodies(corpus.nodes)
    return shred(lists.join(merging(bodies.select(F.col("doc_id").alias("_d"), "body")), F.col("doc_id") == F.col("_d"), "left").select("doc_id", "body", "asked"), asked="asked")


def _nodes(rows: DataFrame, corpus: Corpus, columns: tuple[str, ...], tags: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of the documents that rows without an error ask for. Bodies are cut down to those before they are parsed, spread over all tasks, parsed once and stored."""
    asked = rows.where(F.col("error").isNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    if corpus.bodies is None:
        return corpus.nodes.join(merging(asked), "doc_id", "left_semi")
    return stored(shred(spread(corpus.bodies.join(merging(asked), "doc_id", "left_semi")), columns=columns, tags=tags))


def _meta(corpus: Corpus, now: Column) -> Column:
    law = F.col("law")
    return F.struct(law["law_id"].alias("law_id"), law["title"].alias("title"), law["law_num"].alias("law_num"), iso_instant(now).alias("retrieved_at"), law_url(law["law_id"], corpus.base_url).alias("url"), F.col("at").alias("at"))


def _footer(corpus: Corpus, now: Column) -> list[Column]:
    url = F.concat(F.lit("URL: "), law_url(F.col("law.law_id"), corpus.base_url))
    return [F.lit("---"), F.lit(SOURCE_LINE), url, F.concat(F.lit(AT_LABEL), F.col("at")), F.concat(F.lit(TIME_LABEL), iso_instant(now))]


def _outline_text(lines: Column, corpus: Corpus, now: Column) -> Column:
    top = F.concat(F.lit("# "), F.col("law.title"), F.lit(OUTLINE_LABEL))
    return F.concat_ws("\n", top, F.lit(""), F.nullif(lines, F.lit("")), F.lit(""), *_footer(corpus, now))


def _outlined(rows: DataFrame, nodes: DataFrame, corpus: Corpus, depth: Column, now: Column) -> DataFrame:
    """rows with markdown, node_count, full_count and toc (the outline nested, as JSON) of their documents."""
    wanted = rows.where("error is null").select("req_id", F.col("doc_id").alias("_d"), depth.alias("_depth"))
    outline = toc.extract(nodes.join(merging(wanted.select(F.col("_d").alias("doc_id")).distinct()), "doc_id", "left_semi"))
    sizes = outline.groupBy("doc_id").agg(F.count(F.lit(1)).alias("full_count"))
    # a document's outline is made once for each depth that is asked of it, not for each request
    cuts = wanted.select("_d", F.when(F.col("_depth") >= 1, F.col("_depth")).otherwise(-1).alias("_cut")).distinct()
    held = merging(cuts).join(outline, F.col("_d") == F.col("doc_id")).where((F.col("_cut") < 0) | (F.col("level") < F.col("_cut"))).drop("_d")
    lines = toc.line(F.col("level"), F.col("tag"), F.col("num"), F.col("title"), F.col("caption"))
    shown = held.groupBy("doc_id", "_cut").agg(F.count(F.lit(1)).alias("node_count"), tree.ordered_text(F.col("begin"), lines, "\n").alias("_lines"))
    found = shown.join(merging(toc.nested(held, ["doc_id", "_cut"])), ["doc_id", "_cut"]).join(merging(sizes), "doc_id").withColumnsRenamed({"doc_id": "_d2", "_cut": "_cut2"})
    rows = rows.withColumn("_cut", F.when(F.col("error").isNull(), F.when(depth >= 1, depth).otherwise(-1)))
    rows = rows.join(merging(found), (F.col("doc_id") == F.col("_d2")) & (F.col("_cut") == F.col("_cut2")), "left")
    text = _outline_text(F.col("_lines"), corpus, now)
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("node_count", "full_count")}
    return rows.withColumns({"markdown": text, "toc": F.coalesce("toc", F.lit("[]")), **counts}).drop("_d2", "_cut", "_cut2", "_lines")


def get_law(requests: DataFrame, corpus: Corpus, now: Column | None = None) -> DataFrame:
    """req_id, format, markdown, data, meta and error of each request (req_id, law_name, article, paragraph, item, format, at).

    Checked in order: scope, name, revision, article given (json only), its form, article,
    paragraph, item; the first failure is the error. Without an article the answer is the outline. An item
    without a paragraph is left aside, though `data` still names it.
    """
    now = F.current_timestamp() if now is None else now
    rows, corpus = _located(requests, corpus)
    given = F.nullif(F.col("article"), F.lit(""))
    is_json = F.coalesce(F.col("format") == "json", F.lit(False))
    as_toc = F.coalesce(F.col("format") == "toc", F.lit(False)) | (given.isNull() & ~is_json)
    name = F.col("law_name")
    rows = rows.withColumn("form", F.when(as_toc, "toc").when(is_json, "json").otherwise("markdown")).withColumn("num", article_num(given))
    rows = stored(rows.withColumn("error", first_error(
        F.col("error"),
        F.when(~as_toc & given.isNull(), make_error("INVALID_ARGUMENT", "no article given", "Use format toc or get_toc for an outline.", [try_toc(name)])),
        F.when(~as_toc & F.col("num").isNull(), make_error("INVALID_ARTICLE_NUM", F.concat(F.lit("kanji numerals are not read: "), given), "Write 30 or 30の2.")),
    )).select("req_id", "law_name", "article", "paragraph", "item", "at", "law", "doc_id", "form", "num", "error"))
    found = _parts(rows.where("error is null").drop("error"), corpus)
    with_p = F.col("paragraph").isNotNull()
    with_i = with_p & F.col("item").isNotNull()
    tried, is_json = F.col("form") != "toc", F.col("form") == "json"
    absent = lambda what, value, more=None: make_error("ARTICLE_NOT_FOUND", F.concat(F.lit(f"no such {what}: "), value.cast("string")), "Numbers count from 1; check the outline.", more)
    found = found.withColumn("error", first_error(
        F.when(tried & F.col("found_num").isNull(), absent("article", given, [try_toc(name)])),
        F.when(tried & with_p & F.col("paragraph_num").isNull(), absent("paragraph", F.col("paragraph"))),
        F.when(tried & with_i & F.col("item_num").isNull(), absent("item", F.col("item"))),
    ))
    ok = F.col("error").isNull()
    body = F.when(with_i, trim_wide(F.col("item_content"))).otherwise(F.array_join(F.transform("paragraphs", toc.paragraph_block), "\n\n"))
    top = heading(F.col("law.title"), F.col("found_num"), F.when(with_p, F.col("paragraph_num")), F.when(with_i, F.col("item_num")))
    said = F.concat_ws("\n", top, F.nullif(F.col("caption"), F.lit("")), F.lit(""), F.coalesce(body, F.lit("")), F.lit(""), *_footer(corpus, now))
    outlined = _outline_text(F.array_join(F.transform("outline", lambda x: toc.line(x["level"], x["tag"], x["num"], x["title"], x["caption"])), "\n"), corpus, now)
    data = F.struct(F.col("num").alias("article_num"), F.col("paragraph").alias("paragraph_num"), F.col("item").alias("item_num"), F.col("json").alias("node"))
    shown = {"format": F.col("form"), "markdown": F.when(~tried, outlined).when(~is_json, said), "data": F.when(is_json, data), "meta": _meta(corpus, now)}
    answers = found.select("req_id", *[F.when(ok, c).alias(n) for n, c in shown.items()], "error")
    failed = rows.where("error is not null").select("req_id", *[F.lit(None).cast(answers.schema[n].dataType).alias(n) for n in shown], "error")
    return answers.unionByName(failed)


def get_toc(requests: DataFrame, corpus: Corpus, now: Column | None = None) -> DataFrame:
    """req_id, markdown, toc, meta, node_count, truncated, actually_cut and error of each request (req_id, law_name, at, depth).

    toc is the outline as a VARIANT, entries with their children in lists, down to the depth. truncated is true for any depth from 1 on; actually_cut only if rows are left out.
    """
    now = F.current_timestamp() if now is None else now
    rows, corpus = _versioned(_resolved(requests, corpus), corpus)
    rows = cut(rows)
    rows = _outlined(rows, _nodes(rows, corpus, OUTLINED, toc.TAGS), corpus, F.col("depth"), now)
    ok = F.col("error").isNull()
    shown = {"markdown": F.col("markdown"), "toc": F.parse_json("toc"), "meta": _meta(corpus, now), "node_count": F.col("node_count"), "truncated": F.coalesce(F.col("depth") >= 1, F.lit(False)), "actually_cut": F.col("node_count") < F.col("full_count")}
    return rows.select("req_id", *[F.when(ok, c).alias(n) for n, c in shown.items()], "error")


def get_law_revisions(requests: DataFrame, corpus: Corpus, now: Column | None = None) -> DataFrame:
    """req_id, meta, total, revisions and error of each request (req_id, law_name, latest): the first `latest` in the source's order."""
    now = F.current_timestamp() if now is None else now
    rows = cut(_resolved(requests.withColumn("at", F.lit(None).cast("string")), corpus))
    wanted = rows.where("error is null").select("req_id", F.col("law.law_id").alias("_id"), "latest")
    met = merging(wanted).join(corpus.revisions.withColumnRenamed("law_id", "_law"), F.col("_id") == F.col("_law"))
    kept = history.latest(met, F.col("latest"), "req_id", [F.col("api_ord")])
    fields = [(F.col(c) if c in corpus.revisions.columns else F.lit(None).cast("string")).alias(c) for c in REVISION_FIELDS]
    got = kept.groupBy(F.col("req_id").alias("_r")).agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("rev")))), lambda x: x["rev"]).alias("revisions"))
    ok = F.col("error").isNull()
    joined = rows.join(merging(got), F.col("req_id") == F.col("_r"), "left")
    return joined.select("req_id", F.when(ok, _meta(corpus, now)).alias("meta"), F.when(ok, F.coalesce("total", F.lit(0)).cast("long")).alias("total"), F.when(ok, F.coalesce("revisions", F.array().cast(got.schema["revisions"].dataType))).alias("revisions"), "error")


def search_law(requests: DataFrame, corpus: Corpus) -> DataFrame:
    """req_id, query (keyword, law_type, resolved), total_count, matched_count, results and error; see operators.search.search_titles.

    requests: req_id, keyword, law_type, lim and, if wanted, domain, law_num and skip.
    """
    laws = corpus.laws.withColumn("url", law_url(F.col("law_id"), corpus.base_url))
    found = search.search_titles(requests, laws, corpus.aliases)
    ok = F.col("error").isNull()
    shown = {"query": F.struct("keyword", "law_type", "resolved"), **{c: F.col(c) for c in ("total_count", "matched_count", "results")}}
    return found.select("req_id", *[F.when(ok, c).alias(n) for n, c in shown.items()], "error")


def search_fulltext(requests: DataFrame, corpus: Corpus) -> DataFrame:
    """req_id, note and fallback (the title search's answer, its error included)."""
    found = search_law(requests, corpus)
    return found.select("req_id", F.lit("Titles are searched, not texts.").alias("note"), F.struct(*[c for c in found.columns if c != "req_id"]).alias("fallback"), F.lit(None).cast(ERROR).alias("error"))


def resolve_abbreviation(requests: DataFrame, corpus: Corpus) -> DataFrame:
    """req_id, abbr, resolved (the alias row or null), and for a null a note and next_actions; never an error."""
    found = lookup.with_alias(requests, corpus.aliases, "abbr")
    none = F.col("alias").isNull()
    return found.select("req_id", "abbr", F.col("alias").alias("resolved"), F.when(none, "Not among the aliases; try the full name.").alias("note"), F.when(none, F.array(try_search(F.col("abbr")))).alias("next_actions"), F.lit(None).cast(ERROR).alias("error"))


def explain_law_type(requests: DataFrame, corpus: Corpus) -> DataFrame:
    """req_id, name, found, info, and known (the types' names) for an unknown name."""
    found = lookup.find_law_types(requests, corpus.law_types).crossJoin(F.broadcast(lookup.type_names(corpus.law_types)))
    hit = F.col("entry").isNotNull()
    return found.select("req_id", "name", hit.alias("found"), F.col("entry").alias("info"), F.when(~hit, F.col("names")).alias("known"), F.lit(None).cast(ERROR).alias("error"))


#: Arguments of each tool, with their types.
ARGUMENTS = {
    "search_law": "keyword string, law_type string, lim int, domain string",
    "get_law": "law_name string, article string, paragraph int, item int, format string, at string",
    "get_toc": "law_name string, at string, depth int",
    "search_fulltext": "keyword string, law_type string, lim int, domain string",
    "resolve_abbreviation": "abbr string",
    "get_law_revisions": "law_name string, latest int",
    "explain_law_type": "name string",
}


def answers(batch: DataFrame, corpus: Corpus, now: Column | None = None) -> DataFrame:
    """req_id, tool, answer (JSON without nulls) and is_error of each request of any tool (req_id, tool, arguments: a VARIANT or JSON text).

    Requests are routed by tool and answered in one plan each tool; names that several tools ask for are resolved once for all. An unknown tool is an UNKNOWN_TOOL, arguments
    that a tool does not know are left aside, and those of another type are null.
    """
    now = F.current_timestamp() if now is None else now
    given = F.col("arguments") if batch.schema["arguments"].dataType.simpleString() == "variant" else F.try_parse_json("arguments")
    asked = cut(batch.select("req_id", "tool", given.alias("_arguments")))
    names = asked.where(F.col("tool").isin("get_law", "get_toc", "get_law_revisions")).select(F.try_variant_get("_arguments", "$.law_name", "string").alias("law_name"))
    corpus = replace(corpus, known=cut(resolved_names(names, corpus)))
    unknown = make_error("UNKNOWN_TOOL", F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit(""))), ", ".join(TOOLS))
    found = asked.where(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False))).select("req_id", "tool", F.to_json(unknown).alias("answer"), F.lit(True).alias("is_error"))
    for tool in TOOLS:
        own = asked.where(F.col("tool") == tool)
        arguments = [part.split() for part in ARGUMENTS[tool].split(", ")]
        rows = own.select("req_id", *[F.try_variant_get("_arguments", f"$.{name}", kind).alias(name) for name, kind in arguments])
        answer = globals()[tool](rows, corpus, now) if tool in ("get_law", "get_toc", "get_law_revisions") else globals()[tool](rows, corpus)
        shown = _objects(answer)
        fields = F.struct(*[c for c in shown.columns if c not in ("req_id", "error")])
        found = found.unionByName(shown.select("req_id", F.lit(tool).alias("tool"), F.when(F.col("error").isNotNull(), F.to_json("error")).otherwise(F.to_json(fields)).alias("answer"), F.col("error").isNotNull().alias("is_error")))
    return found


def _objects(answer: DataFrame) -> DataFrame:
    """An answer whose subtree is an object, not its JSON as text."""
    if "data" not in answer.columns:
        return answer
    return answer.withColumn("data", F.when(F.col("data").isNotNull(), F.col("data").withField("node", F.try_parse_json("data.node"))))


def call(spark: SparkSession, corpus: Corpus, tool: str, **arguments: object) -> tuple[str, bool]:
    """One request's answer as indented JSON without nulls, and whether it is an error.

    A subtree is an object. What goes wrong beyond the answers' own errors is logged and an INTERNAL_ERROR.
    """
    if tool not in TOOLS:
        return json.dumps({"error": f"unknown tool: {tool}", "code": "UNKNOWN_TOOL", "hint": ", ".join(TOOLS)}, indent=2), True
    names = [part.split()[0] for part in ARGUMENTS[tool].split(", ")]
    try:
        asked = spark.createDataFrame([(0, *[arguments.get(n) for n in names])], f"req_id int, {ARGUMENTS[tool]}")
        row = _objects(globals()[tool](asked, corpus)).select(F.to_json(F.struct("*")).alias("j")).first()
        answer = json.loads(row["j"])
    except Exception as e:  # whatever it is, the caller gets an error as a value
        log.exception("tool %s failed", tool)
        failed = spark.range(1).select(F.to_json(make_error("INTERNAL_ERROR", f"internal error: {e}", "This may be a bug; report how it came about.", [try_later()], True, detail(cause=F.lit(str(e))))).alias("j")).first()
        return json.dumps(json.loads(failed["j"]), ensure_ascii=False, indent=2), True
    answer.pop("req_id", None)
    error = answer.pop("error", None)
    return json.dumps(error or answer, ensure_ascii=False, indent=2), error is not None
