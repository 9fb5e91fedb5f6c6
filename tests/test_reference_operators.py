import datetime
import json

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as X
from lexgrove.operators import errors, history, lookup, outline, search, tree
from lexgrove.plans import requests as R
from lexgrove.sources import law_api, law_types
from lexgrove.sources.aliases import OWNER, aliases
from lexgrove.sources.nodes import shred, shred_variant, tree_text


def n(tag, *children, num=None):
    return {"tag": tag, **({"attr": {"Num": num}} if num else {}), "children": list(children)}


F1 = n("Law", n("LawNum", "law 1"), n("LawBody", n("LawTitle", "First Act"), n("MainProvision", n("Chapter", n("ChapterTitle", "Chapter Three"),
    n("Article", n("ArticleCaption", "(duty)"), n("ArticleTitle", "Art. 30"), n("Paragraph", n("ParagraphNum"), n("ParagraphSentence", n("Sentence", "Keep books.")),
      n("Item", n("ItemTitle", "一"), n("ItemSentence", n("Sentence", "ledgers")), num="1"), num="1"), num="30"),
    n("Article", n("ArticleCaption", "(form)"), n("ArticleTitle", "Art. 30-2"), n("Paragraph", n("ParagraphSentence", "raw string"), num="1"), n("TableStruct", "dropped"), num="30_2"), num="3")),
    n("SupplProvision", n("Article", n("Paragraph", n("ParagraphSentence", "supplement"), num="1"), num="30"))))
F2 = n("Law", n("LawBody", n("LawTitle", "Deep Act"), n("MainProvision", n("Part", n("PartTitle", "P"), n("Chapter", n("ChapterTitle", "C"), n("Section", n("SectionTitle", "S"), n("Article", n("ArticleCaption", "(a)"), num="1"), num="1"), num="1"), num="1"))))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("f1", json.dumps(F1)), ("f2", json.dumps(F2)), ("bad", "{"), ("none", None), ("list", "[1]")], "doc_id string, body string")


@pytest.fixture(scope="module")
def nodes(docs):
    return shred(docs).cache()


@pytest.fixture(scope="module")
def corpus(spark, docs):
    laws = spark.createDataFrame([("L1", "First Act", "no 1", "Act", "1990-01-01", 0), ("L2", "Deep Act", "no 2", "Act", "1991-01-01", 1), ("L3", "First Act Order", "no 3", "CabinetOrder", None, 2)], "law_id string, law_title string, law_num string, law_type string, promulgation_date string, src_ord int")
    d = datetime.date
    revisions = spark.createDataFrame([("L1", "f1", d(2020, 1, 1), 0), ("L1", "f2", d(2010, 1, 1), 1), ("L2", "f2", d(2015, 1, 1), 0)], "law_id string, law_revision_id string, enforcement_date date, api_ord int")
    return R.Corpus(laws, revisions, None, aliases(spark), law_types.law_types(spark), bodies=docs)


def test_shred_agrees_with_variant_query(docs, nodes):
    a = sorted((r.doc_id, tuple(r.path), r.tag, r.num, r.text) for r in nodes.collect())
    b = sorted((r.doc_id, tuple(r.path), r.tag, r.num, r.text) for r in shred_variant(docs).collect())
    key = lambda x: tuple(map(str, x))
    assert sorted(a, key=key) == sorted(b, key=key) and {x[0] for x in a} == {"f1", "f2"}


def test_text_of_a_node_is_its_texts_in_order(nodes):
    anchors = nodes.where("tag is not null").select("doc_id", "path")
    got = {(r.doc_id, tuple(r.path)): r.whole for r in tree.node_text(nodes, anchors).collect()}
    assert got[("f1", (0,))] == tree_text(F1) and got[("f2", (0,))] == tree_text(F2)
    assert tree_text(None) == "" and "" in got.values()


def test_articles_paragraphs_items(spark, nodes):
    asked = spark.createDataFrame([("f1", "30", 1, 1), ("f1", "30_2", 1, 1), ("f1", "999", 1, 1)], "doc_id string, article string, p int, i int")
    a = tree.find_articles(nodes, asked).withColumn("path", F.col("found.path"))
    p = tree.children(nodes, a, "Paragraph", "p", first=True).withColumnRenamed("child", "par").withColumn("path", F.col("par.path"))
    i = {r.article: r for r in tree.children(nodes, p, "Item", "i", first=True).collect()}
    assert i["30"].found.path == [0, 1, 1, 0, 1] and i["30"].child.content == "一ledgers"
    assert i["30_2"].par is not None and i["30_2"].child is None and i["999"].found is None
    assert {r.doc_id: r.title for r in tree.titles(nodes).collect()} == {"f1": "First Act", "f2": "Deep Act"}
    assert tree.children(nodes, a.where("article = '30'").select("doc_id", "path"), "ArticleTitle").first().child.content == "Art. 30"


@pytest.mark.parametrize("depth, tags", [(1, ["Part"]), (2, ["Part", "Chapter"]), (3, ["Part", "Chapter", "Section"]), (4, ["Part", "Chapter", "Section", "Article"]), (0, ["Part", "Chapter", "Section", "Article"]), (-1, ["Part", "Chapter", "Section", "Article"]), (None, ["Part", "Chapter", "Section", "Article"])])
def test_depth(nodes, depth, tags):
    rows = outline.limit_depth(outline.extract(nodes), depth).where("doc_id = 'f2'").orderBy("path").collect()
    assert [r.tag for r in rows] == tags


def test_outline_and_chapter_paths(nodes):
    got = {r.doc_id: r for r in outline.listing(outline.extract(nodes)).collect()}
    assert got["f1"].lines == "- Chapter Three\n  - 第30条 (duty)\n  - 第30の2条 (form)\n- 第30条" and got["f2"].node_count == 4
    paths = {(r.doc_id, r.num, r.ord): r.chapter_path for r in outline.chapter_paths(nodes).collect()}
    assert paths == {("f1", "30", 1): "Chapter Three", ("f1", "30_2", 2): "Chapter Three", ("f1", "30", 3): "", ("f2", "1", 1): "P > C > S"}


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_scalars(spark):
    assert one(spark, X.article_num, "30", "30の2", "第30条", "第57条の4", "三十", "  30  ", None) == ["30", "30_2", "30", "57_4", None, "30", None]
    assert one(spark, X.article_label, "30", "30_2") == ["30", "30の2"]
    assert one(spark, X.trim_wide, "　a　", "﻿b ") == ["a", "b"]
    assert one(spark, X.strip_item_marker, "一二以上の者", "３課") == ["以上の者", "３課"]
    assert one(spark, lambda x: X.positive_int(x, 4), "", "x", "0", "7", None) == [4, 4, 4, 7, 4]
    assert one(spark, X.listed, "a, ,b,") == [["a", "b"]]
    assert one(spark, lambda x: X.has_all_terms(F.lit("Ａ b c"), x), "A　c", "d", "") == [True, False, False]


def test_law_types(spark):
    names = spark.createDataFrame([(x,) for x in ("政令", "施行令", "施行規則", "日本国憲法", "Act", "  通達  ", "通知", "無い", "constructor", "Rule")], "name string")
    got = {r.name.strip(): r.entry and r.entry.name for r in lookup.find_law_types(names, law_types.law_types(spark)).collect()}
    assert got == {"政令": "政令", "施行令": "政令", "施行規則": "省令", "日本国憲法": "憲法", "Act": "法律", "通達": "通達", "通知": "通知", "無い": None, "constructor": None, "Rule": None}


def test_law_types_name_their_sources(spark, corpus):
    """Every kind names where its texts are found; an answer carries labels and addresses."""
    assert all(r.sources and all(x.label for x in r.sources) for r in law_types.law_types(spark).collect())
    text, failed = R.call(spark, corpus, "explain_law_type", name="基本通達")
    found = json.loads(text)["info"]
    assert not failed and found["name"] == "通達" and [x["url"].split("/")[2] for x in found["sources"]] == ["www.nta.go.jp", "www.mhlw.go.jp", "www.jaish.gr.jp"]


def test_errors(spark):
    row = spark.range(1).select(errors.make_error("LAW_NOT_FOUND", "m", "", []).alias("e"), errors.make_error("OUT_OF_SCOPE", "m", "h", [errors.try_owner("x")], True).alias("f")).first()
    assert row.e.hint is None and row.e.next_actions is None and row.e.retryable is None
    assert row.f.next_actions[0].example == {"owner": "x"} and row.f.retryable
    with pytest.raises(ValueError):
        errors.make_error("NO_SUCH_CODE", "m")
    cases = [(429, None), (0, None), (503, None), (404, None), (None, "getaddrinfo failed"), (None, "other"), (None, None)]
    df = spark.createDataFrame(cases, "s int, c string").select(errors.http_error(F.col("s"), F.lit("u"), F.col("c")).alias("e"))
    assert [(r.e.code, r.e.retryable) if r.e else None for r in df.collect()] == [("SOURCE_RATE_LIMITED", True), ("SOURCE_TIMEOUT", True), ("SOURCE_API_ERROR", True), ("SOURCE_API_ERROR", False), ("SOURCE_UNAVAILABLE", True), ("SOURCE_API_ERROR", True), None]


def asked(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "req_id int, law_name string, article string, paragraph int, item int, format string, at string")


def test_get_law(spark, corpus):
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    rows = [("First Act", "30", None, None, "markdown", None), ("First Act", "第30条", 1, 1, None, None), ("First Act", "30", 1, None, "json", None), ("First Act", None, None, None, None, None), ("First Act", None, None, None, "json", None),
            ("First Act", "三十", None, None, None, None), ("First Act", "99", None, None, None, None), ("First Act", "30", 2, None, None, None), ("First Act", "30", 1, 9, None, None), ("所基通", "三十", None, None, None, None), ("zzz", "三十", None, None, None, None),
            ("First Act", None, None, None, "toc", "2012-05-05"), ("First Act", "30", None, None, None, "1999-01-01"), ("First Act", "30", None, 1, "json", None)]
    got = {r.req_id: r for r in R.get_law(asked(spark, *rows), corpus, now).collect()}
    tail = "\n---\n出典：e-Gov法令検索（デジタル庁）\nURL: https://laws.e-gov.go.jp/law/L1\n取得日時: 2024-01-02T03:04:05.000Z"
    assert got[0].markdown == "# First Act 第30条\n(duty)\n\nKeep books.\n1 ledgers\n" + tail
    assert got[1].markdown == "# First Act 第30条第1項第1号\n(duty)\n\n一ledgers\n" + tail
    assert json.loads(got[2].data.node)["tag"] == "Paragraph" and got[2].markdown is None and got[2].meta.law_id == "L1"
    assert got[3].format == "toc" and got[3].markdown.startswith("# First Act — 目次\n\n- Chapter Three\n  - 第30条 (duty)")
    codes = [got[i].error and got[i].error.code for i in range(4, 14)]
    assert codes == ["INVALID_ARGUMENT", "INVALID_ARTICLE_NUM", "ARTICLE_NOT_FOUND", "ARTICLE_NOT_FOUND", "ARTICLE_NOT_FOUND", "OUT_OF_SCOPE", "LAW_NOT_FOUND", None, "SOURCE_API_ERROR", None]
    assert "- P\n  - C" in got[11].markdown and "時点: 2012-05-05" in got[11].markdown
    assert json.loads(got[13].data.node)["tag"] == "Article" and got[13].data.item_num == 1


def test_get_toc_and_revisions(spark, corpus):
    tocs = spark.createDataFrame([(0, "Deep Act", None, 1), (1, "Deep Act", None, None), (2, "Deep Act", None, 9), (3, "zzz", None, None)], "req_id int, law_name string, at string, depth int")
    got = {r.req_id: r for r in R.get_toc(tocs, corpus).collect()}
    assert [(got[i].node_count, got[i].truncated, got[i].actually_cut) for i in range(3)] == [(1, True, True), (4, False, False), (4, True, False)] and got[3].error.code == "LAW_NOT_FOUND"
    revs = spark.createDataFrame([(0, "First Act", 1), (1, "First Act", None), (2, "First Act Order", 3)], "req_id int, law_name string, latest int")
    got = {r.req_id: r for r in R.get_law_revisions(revs, corpus).collect()}
    assert (got[0].total, [x.law_revision_id for x in got[0].revisions]) == (2, ["f1"]) and len(got[1].revisions) == 2 and got[2].total == 0


def test_calls(spark, corpus):
    answer, bad = R.call(spark, corpus, "search_law", keyword="First Act", lim=1)
    assert not bad and json.loads(answer)["total_count"] == 1 and json.loads(answer)["matched_count"] == 2
    answer, bad = R.call(spark, corpus, "search_law", keyword="  ")
    assert bad and json.loads(answer)["code"] == "INVALID_ARGUMENT" and json.loads(answer)["hint"]
    answer, bad = R.call(spark, corpus, "search_fulltext", keyword=" ")
    assert not bad and json.loads(answer)["fallback"]["error"]["code"] == "INVALID_ARGUMENT"
    assert json.loads(R.call(spark, corpus, "resolve_abbreviation", abbr="消法")[0])["resolved"]["domain"] == "tax"
    answer = json.loads(R.call(spark, corpus, "resolve_abbreviation", abbr="zzz")[0])
    assert "resolved" not in answer and answer["next_actions"][0]["action"] == "search_law"
    assert json.loads(R.call(spark, corpus, "explain_law_type", name="通達")[0])["info"]["binds_citizens"] is False
    assert "憲法" in json.loads(R.call(spark, corpus, "explain_law_type", name="zzz")[0])["known"]
    assert R.call(spark, corpus, "no_tool")[1]


def test_exact_title_among_the_first_five_only(spark):
    laws = spark.createDataFrame([(str(i), t, "", i) for i, t in enumerate(["xab", "abx", "a ab", "ab ab", "yab", "ab"])], "law_id string, law_title string, law_num string, src_ord int")
    names = spark.createDataFrame([(0, "ab"), (1, "yab"), (2, "b"), (3, "")], "req_id int, law_name string")
    got = {r.req_id: r.law and r.law.law_id for r in lookup.resolve(names, laws, aliases(spark)).collect()}
    assert got == {0: "0", 1: "4", 2: "0", 3: None}


def test_index_agrees_with_scan(spark):
    docs = spark.createDataFrame([(0, "the ｃａｔ sat"), (1, "a cat"), (2, None), (3, "c at"), (4, "x")], "doc_id int, text string")
    for words in ("cat", "the cat", "ｃａｔ　sat", "x", ""):
        a = sorted(r.doc_id for r in search.fulltext(docs, words).collect())
        assert sorted(r.doc_id for r in search.indexed_fulltext(docs, search.gram_index(docs), words).collect()) == a


def test_written_index_reads_its_shelves(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} and more text {i}") for i in range(60)], "doc_id int, text string")
    search.write_index(search.gram_index(docs), str(tmp_path / "index"), 8)
    for words in ("word3 text", "more 11", "absent"):
        part = search.read_index(spark, str(tmp_path / "index"), words, 8)
        assert "PartitionFilters: [isnotnull(shelf" in part._jdf.queryExecution().toString() or "PartitionFilters: [shelf" in part._jdf.queryExecution().toString()
        want = sorted(r.doc_id for r in search.fulltext(docs, words).collect())
        assert sorted(r.doc_id for r in search.indexed_fulltext(docs, part, words).collect()) == want
        assert sorted(r.doc_id for r in search.indexed_fulltext(docs, search.gram_index(docs, only=words), words).collect()) == want


def test_search_by_domain_number_and_place(spark):
    laws = spark.createDataFrame([(str(i), t, f"n{i}", "Act", i) for i, t in enumerate(["消費税法", "消費税法施行令", "所得税法", "税法", "税法二"])], "law_id string, law_title string, law_num string, law_type string, src_ord int")
    rows = [(0, "税法", None, None, "tax", None, None), (1, "税法", None, 2, None, None, 1), (2, "税法", None, None, None, "n3", None), (3, "税法", None, None, "labor", None, 0), (4, "税法", None, 9, None, None, None)]
    asked = spark.createDataFrame(rows, "req_id int, keyword string, law_type string, lim int, domain string, law_num string, skip int")
    got = {r.req_id: ([x.law_id for x in r.results], r.matched_count) for r in search.search_titles(asked, laws, aliases(spark), max_limit=4).collect()}
    assert got == {0: (["0", "2"], 2), 1: (["1", "2"], 5), 2: (["3"], 1), 3: ([], 0), 4: (["0", "1", "2", "3"], 5)}


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_search_of_frequent_names_equals_brute_force(spark, parts):
    """Names that all titles share, ties in the order, skips beyond the end and limits of 0: as by sorting all hits, however many parts they are cut in."""
    laws = [(f"{i:03d}", f"{'common ' * (i % 3 > 0)}law {i}", f"n{i % 40}", "ABC"[i % 3], i % 7) for i in range(200)]
    asked = [(i, k, t, n, d, s, lim) for i, (k, t, n, d, s, lim) in enumerate(
        [("law", None, None, None, None, None), ("law", "A", None, None, 60, 20), ("common", "", "n5", None, None, 3), ("law 1", "B", None, None, 2, 0), ("law", None, None, None, 195, 9), ("none", None, None, None, None, 5), (" ", None, None, None, 1, 5), ("law", None, "", "few", 1, 2), (None, "A", None, None, None, None)])]
    known = [("w", f"law {i}", None, None, "few", None, None) for i in range(0, 200, 3)]
    named = spark.createDataFrame([(f"w{i}", *x[1:]) for i, x in enumerate(known)], "abbr string, formal string, law_id string, law_num string, domain string, category string, owner string")
    rows = spark.createDataFrame(asked, "req_id int, keyword string, law_type string, law_num string, domain string, skip int, lim int")
    got = {r.req_id: (r.total_count, r.matched_count, [x.law_id for x in r.results], r.error is not None) for r in search.search_titles(rows, spark.createDataFrame(laws, "law_id string, law_title string, law_num string, law_type string, src_ord int"), named, max_limit=15, parts=parts).collect()}
    few = {x[1] for x in known}
    for i, k, t, n, d, s, lim in asked:
        k, s = (k or "").strip(), s or 0
        hits = sorted((w for w in laws if k and k in w[1] and (not t or w[3] == t) and (not n or w[2] == n) and (not d or w[1] in few)), key=lambda w: (w[4], w[0]))
        shown = [w[0] for w in hits[s : s + min(15, 10 if lim is None else lim)]]
        assert got[i] == (len(shown), len(hits), shown, not k), i


def test_answers_are_nested_and_failures_are_errors(spark, corpus):
    toc = json.loads(R.call(spark, corpus, "get_toc", law_name="First Act")[0])["toc"]
    assert [x["tag"] for x in toc] == ["Chapter", "Article"] and [x["num"] for x in toc[0]["children"]] == ["30", "30_2"]
    assert toc[0]["children"][0]["title"] == "Art. 30" and "title" not in toc[1]
    node = json.loads(R.call(spark, corpus, "get_law", law_name="First Act", article="30", format="json")[0])["data"]["node"]
    assert node["tag"] == "Article" and node["children"][0]["children"] == ["(duty)"]
    answer, bad = R.call(spark, R.Corpus(corpus.laws.drop("law_id"), None, None, corpus.aliases, corpus.law_types), "search_law", keyword="First")
    assert bad and json.loads(answer)["code"] == "INTERNAL_ERROR" and json.loads(answer)["retryable"]
    assert json.loads(R.call(spark, corpus, "search_law", keyword="First Act")[0])["query"] == {"keyword": "First Act"}
    assert [law_api.positive(x, 4) for x in ("", None, "abc", "0", "-1", "7")] == [4, 4, 4, 4, 4, 7]


def test_history_and_sync(spark, tmp_path):
    from lexgrove.streaming.sync import apply_increment

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, body string")
    assert apply_increment(spark, str(tmp_path), 0, rows, "k", "body") == 1
    assert apply_increment(spark, str(tmp_path), 1, rows, "k", "body") == 1
    more = spark.createDataFrame([(2, "B"), (4, "d"), (1, "a")], "k int, body string")
    assert apply_increment(spark, str(tmp_path), 1, more, "k", "body") == 2
    assert sorted((r.k, r.body) for r in spark.read.parquet(f"{tmp_path}/v2").collect()) == [(1, "a"), (2, "B"), (3, None), (4, "d")]
    label = lambda *x: history.status_label(*map(F.lit, x))
    got = spark.range(1).select(label("CurrentEnforced", "Repeal", True), label("CurrentEnforced", "Repeal", False), label("UnEnforced", "None", False), label("PreviousEnforced", "None", False), label("CurrentEnforced", "None", False)).first()
    assert list(got) == ["repealed, still in force", "repealed", "not yet in force", "superseded", "in force"]


def test_law_api_retries_and_reports(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            status = 503 if "flaky" in self.path and seen.count(self.path) < 3 else 404 if "gone" in self.path else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(b'{"ok": 1}' if status == 200 else b"")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    law_api.register(spark)
    got = {r.law_id: r for r in spark.read.format("law_api").options(base=base, kind="law_data", ids='["a","flaky","gone"]', at="2020-01-01", delay="0.01").load().collect()}
    server.shutdown()
    assert json.loads(got["a"].body) == {"ok": 1} and got["flaky"].body and got["gone"].status == 404 and seen.count("/law_data/flaky?asof=2020-01-01") == 3
    assert law_api.list_url("b", law_title="", limit=0, law_type=None) == "b/laws?limit=0"


def test_kanji_numbers(spark):
    from lexgrove.functions.text import article_num_kanji, era_date, kanji_number, kanji_numeral

    n = F.col("id").cast("int")
    wrong = spark.range(1, 10000).select(n.alias("n"), kanji_numeral(n).alias("k")).where(~kanji_number(F.col("k")).eqNullSafe(F.col("n")))
    assert wrong.count() == 0
    labels = ["第千二百三条の二", " 第三十条 ", "第一二〇条", "第３０条の2", "第条", "第三x条", "", None]
    rows = spark.createDataFrame([(x,) for x in labels], "x string").select(article_num_kanji(F.col("x")).alias("n"))
    assert [r.n for r in rows.collect()] == ["1203_2", "30", "120", "30_2", None, None, None, None]
    assert spark.range(1).select(kanji_numeral(F.lit(0)).alias("a"), kanji_numeral(F.lit(10000)).alias("b")).first()[:] == (None, None)
    days = spark.createDataFrame([("令和元年十二月十日",), ("昭和十五十年一月一日",), (None,)], "x string").select(era_date(F.col("x")).cast("string").alias("d"))
    assert [r.d for r in days.collect()] == ["2019-12-10", None, None]


def test_catching_up(spark, tmp_path):
    import datetime as dt

    from lexgrove.streaming.sync import catch_up, needs_full, sync_state

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    made = lambda rows: spark.createDataFrame(rows, "k int, body string, update_date date")
    everything, asked = made([(1, "a", day(0)), (2, "b", day(0)), (None, "x", day(0))]), []

    def since(first, last):
        asked.append((first, last))
        return made([(2, "B", day(1)), (2, "BB", day(3)), (2, "BB", day(3)), (3, "c", day(2))]).where(F.col("update_date").between(first, last))

    path, held = str(tmp_path), lambda v: sorted((r.k, r.body) for r in spark.read.parquet(f"{tmp_path}/v{v}").collect())
    assert sync_state(spark, path) is None and needs_full(None, day(0)) and needs_full(day(0), day(91)) and not needs_full(day(0), day(90))
    run = lambda today: catch_up(spark, path, today, since, lambda: everything, "k", "body")
    assert run(day(0))[:] == (1, day(0), 2, True) and held(1) == [(1, "a"), (2, "b")]
    assert run(day(3))[:] == (2, day(3), 2, False) and held(2) == [(1, "a"), (2, "BB"), (3, "c")]
    assert run(day(3))[:] == run(day(1))[:] == (2, day(3), 2, False) and asked == [(day(1), day(3))]
    assert run(day(5))[:] == (2, day(5), 0, False)
    assert run(day(200))[:] == (3, day(200), 2, True) and held(3) == [(1, "a"), (2, "b")]


def test_api_answers_become_tables(spark):
    from lexgrove.sources.nodes import shred as shredded

    info, tree = {"law_id": "L1", "law_type": "Act", "law_num": "n1", "promulgation_date": "2000-01-01"}, {"tag": "Law", "children": [{"tag": "LawTitle", "children": ["T"]}]}
    item = {"law_info": info, "revision_info": {"law_title": "T", "repeal_status": "None"}}
    made = lambda *bodies: spark.createDataFrame([("L1", x if x is None or isinstance(x, str) else json.dumps(x)) for x in bodies], "law_id string, body string")
    laws = law_api.as_laws(made({"total_count": 7, "laws": [item, {"law_info": {"law_id": "L2"}}]}, {"total_count": 0, "laws": []}, None)).collect()
    assert [(r.law_id, r.law_title, r.src_ord, r.total_count) for r in laws] == [("L1", "T", 1, 7), ("L2", None, 2, 7)]
    docs = law_api.as_documents(made({"law_info": info, "revision_info": {"law_title": "T"}, "law_full_text": tree}, "no json"))
    assert [(r.law_id, r.law_num, r.law_title) for r in docs.orderBy("law_num").collect()] == [("L1", None, None), ("L1", "n1", "T")]
    assert [r.tag for r in shredded(docs, "law_id").where("tag is not null").orderBy("path").collect()] == ["Law", "LawTitle"]
    past = law_api.as_revisions(made({"law_info": info, "revisions": [{"law_revision_id": "r2", "remain_in_force": True}, {"law_revision_id": "r1"}]}, {"law_info": info, "revisions": []})).collect()
    assert [(r.law_id, r.law_num, r.law_revision_id, r.remain_in_force) for r in past] == [("L1", "n1", "r2", True), ("L1", "n1", "r1", None)]


def test_bulk_archives(spark, tmp_path):
    import datetime as dt
    import zipfile

    from lexgrove.sources import bulk
    from lexgrove.sources.nodes import shred as shredded

    law = '<?xml version="1.0"?>\n<Law>\n <LawBody>\n  <LawTitle>T　<Ruby>る</Ruby>び</LawTitle>\n <MainProvision><Article Num="1"/></MainProvision></LawBody>\n</Law>'
    head = ",".join(bulk.LIST)
    rows = ["法律,n1,T,て,,昭和二十二年四月七日,,,,明治五年十一月九日,,L1,u1,", '政令,n2,"A, B",び,,不明,改,n1,令和元年五月一日,,,L2,u2,未施行', "法律,n3"]
    folder = tmp_path / "zips"
    folder.mkdir()
    with zipfile.ZipFile(folder / "27_xml.zip", "w") as z:
        z.writestr("all_law_list.csv", "﻿" + "\r\n".join([head, *rows]) + "\r\n")
        for i in range(5):
            z.writestr(f"L{i}_20250601_{'0' * 15 if i else 'A9'}/L{i}_20250601_{'0' * 15 if i else 'A9'}.xml", law)
    with zipfile.ZipFile(folder / "all_xml.zip", "w") as z:
        z.writestr("bad.xml", "<Law>")
    with zipfile.ZipFile(folder / "3_xml.zip", "w"):
        pass
    bulk.register(spark)
    load = lambda path, **o: spark.read.format("law_bulk").options(path=str(path), **o).load()
    laws = load(folder, members="2")
    assert laws.rdd.getNumPartitions() == 4
    got = {r.law_id: r for r in laws.collect()}
    assert sorted(got) == ["L0", "L1", "L2", "L3", "L4", "bad"] and got["bad"].body is None and got["bad"].cause and got["bad"].category is None
    assert got["L0"][1:4] == (dt.date(2025, 6, 1), "A9", 27) and got["L1"][1:4] == (dt.date(2025, 6, 1), None, 27)
    nodes = shredded(laws.where("law_id = 'L1'"), "law_id")
    assert [(r.tag, r.num, r.text) for r in nodes.orderBy("path").collect()] == [
        ("Law", None, None), ("LawBody", None, None), ("LawTitle", None, None), (None, None, "T　"), ("Ruby", None, None), (None, None, "る"), (None, None, "び"), ("MainProvision", None, None), ("Article", "1", None),
    ]
    (tmp_path / "list.csv").write_bytes(("﻿" + "\r\n".join([head, *rows[:2]]) + "\r\n").encode())
    for listed in (load(folder / "27_xml.zip", kind="list"), bulk.read_list(spark, str(tmp_path / "list.csv"))):
        held = {r.law_id: r for r in bulk.as_laws(listed).collect()}
        assert (held["L1"].promulgation_date, held["L1"].enforcement_date, held["L1"].old_title, held["L1"].pending) == (dt.date(1947, 4, 7), dt.date(1872, 11, 9), None, False)
        assert (held["L2"].law_title, held["L2"].promulgation_date, held["L2"].amendment_promulgate_date, held["L2"].pending) == ("A, B", None, dt.date(2019, 5, 1), True)
    assert load(folder / "all_xml.zip", kind="list").count() == load(folder / "3_xml.zip").count() == 0
    bulk.write_by_category(laws, str(tmp_path / "laws"))
    assert spark.read.parquet(f"{tmp_path}/laws").where("category = 27").count() == 5
    assert bulk.categories(spark).where("category = 27").first().name == "都市計画" and len(bulk.CATEGORIES) == 42


def test_sections(spark):
    body = {"tag": "Law", "children": [
        {"tag": "Chapter", "attr": {"Num": "1"}, "children": [{"tag": "Section", "attr": {"Num": "1"}, "children": [{"tag": "Article", "attr": {"Num": "1"}, "children": ["x"]}]}]},
        {"tag": "Chapter", "attr": {"Num": "2"}, "children": [{"tag": "Section", "attr": {"Num": "1"}, "children": ["y"]}]},
        {"tag": "Chapter", "attr": {"Num": "2"}, "children": ["z"]},
    ]}
    docs = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(body))], "doc_id int, body string")
    asked = [(0, 1, "Chapter", "2"), (1, 1, "Section", "1"), (2, 1, "Chapter", "3"), (3, None, "Chapter", "1"), (4, 1, "Chapter", "2"), (5, 2, None, "1"), (6, 2, "Chapter", None)]
    got = tree.sections(shred(docs), spark.createDataFrame(asked, "req int, doc_id int, tag string, num string"))
    shown = sorted((r.req, r.section, r.node.path, r.node.tag or r.node.text) for r in got.collect())
    second = [([0, 1], [0, 1], "Chapter"), ([0, 1], [0, 1, 0], "Section"), ([0, 1], [0, 1, 0, 0], "y")]
    first = [([0, 0, 0], [0, 0, 0], "Section"), ([0, 0, 0], [0, 0, 0, 0], "Article"), ([0, 0, 0], [0, 0, 0, 0, 0], "x")]
    assert shown == [(0, *r) for r in second] + [(1, *r) for r in first] + [(4, *r) for r in second]


def test_log():
    import io
    import logging

    from lexgrove.log import setup

    def said(debug):
        out = io.StringIO()
        setup(debug, out)
        log = logging.getLogger("lexgrove.requests")
        log.debug("small")
        try:
            raise ValueError("why")
        except ValueError:
            log.exception("failed %s", "x")
        return out.getvalue()

    try:
        assert said(False) == "[requests] failed x\n"
        assert said(True).startswith("[requests] small\n[requests] failed x\nTraceback") and "why" in said(True)
    finally:
        logging.getLogger("lexgrove").handlers.clear()
        logging.getLogger("lexgrove").propagate = True


def test_title_hits_equal_brute_force_and_broadcast_nothing_that_grows(spark):
    """Keywords of all run sizes, in titles of up to 90 characters; only the bounded tables of run sizes and run classes may be broadcast, however small the others are."""
    import random

    from lexgrove.operators.lookup import resolve, title_hits

    rng = random.Random(7)
    titles = ["".join(rng.choice("ab法") for _ in range(rng.randint(0, 90))) for _ in range(60)] + [None, "a"]
    keywords = sorted({t[i : i + n] for t in titles if t for i, n in [(rng.randint(0, 9), rng.randint(1, 80)) for _ in range(4)]} | {"", "abc", "x" * 70})
    laws = spark.createDataFrame([(str(i), t, "", i) for i, t in enumerate(titles)], "law_id string, law_title string, law_num string, src_ord int").cache()
    wanted = spark.createDataFrame(list(enumerate(keywords)), "req_id int, law_name string")
    got = title_hits(wanted, laws, "req_id", "law_name")
    want = sorted((i, str(j)) for i, k in enumerate(keywords) for j, t in enumerate(titles) if k and t and k in t)
    assert sorted((r.req_id, r.law_id) for r in got.collect()) == want
    none = spark.createDataFrame([], "abbr string, formal string, law_id string, law_num string, owner string")
    answers = resolve(wanted, laws, none)
    plans = []
    for df in (got, answers):
        df.collect()
        plans += df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    joins = [p for p in plans if "BroadcastHashJoin" in p]
    assert all("_class" in p or "abbr" in p for p in joins), joins


def test_title_search_answers_alike_requests_alike(spark):
    """Requests for the same, nulls and blanks among their filters, each have their answer."""
    from lexgrove.operators.search import search_titles

    laws = spark.createDataFrame([(str(i), f"law {i % 10}", f"n{i}", "A" if i % 2 else "B", i) for i in range(40)], "law_id string, law_title string, law_num string, law_type string, src_ord int")
    none = spark.createDataFrame([], "abbr string, formal string, domain string")
    rows = [(i, "law 3", t, 2) for i, t in enumerate([None, "", "A", "B", None, "A"])] + [(6, "law 3", None, None), (7, " ", None, 2)]
    asked = spark.createDataFrame(rows, "req_id int, keyword string, law_type string, lim int")
    got = {r.req_id: ([x.law_id for x in r.results], r.matched_count) for r in search_titles(asked, laws, none).collect()}
    two = (["3", "13"], 4)
    assert got == {0: two, 1: two, 2: two, 3: ([], 0), 4: two, 5: two, 6: (["3", "13", "23", "33"], 4), 7: ([], 0)}
