"""Regions of nodes, subtrees, the stored index, as-of requests, lookups over an API and batches of requests."""

import datetime as dt
import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from lexgrove.functions.text import fold_kana, has_all_terms
from lexgrove.operators import history, outline, tree
from lexgrove.plans import remote, standins
from lexgrove.plans import requests as R
from lexgrove.session import stored
from lexgrove.sources import answer_files, bulk, law_api, nodes, postings
from lexgrove.sources.aliases import aliases
from lexgrove.sources.law_types import law_types
from lexgrove.streaming import buckets

SF = "/root/testdata/sf0.001"
random.seed(7)


def some_tree(depth=0):
    if depth > 4 or (depth and random.random() < 0.3):
        return random.choice(["t", "", 'q"\\\n', "条　文", {"tag": "Leaf"}, {"tag": "E", "children": []}, {"tag": "A", "attr": {"Num": "1", "b": "/"}, "children": []}, 5, None, {"x": 1, "children": None}])
    attr = {"attr": {"Num": random.choice(["1", 2])}} if random.random() < 0.5 else {}
    return {"tag": random.choice(["Article", "Part", "Item", "Paragraph"]), **attr, "children": [some_tree(depth + 1) for _ in range(random.randint(0, 4))]}


def cleaned(n):
    """A tree without children that are neither texts nor elements."""
    if isinstance(n, dict) and isinstance(n.get("children"), list):
        return {**n, "children": [cleaned(c) for c in n["children"] if isinstance(c, (str, dict))]}
    return n


def walked(n, parent=-1, out=None):
    """(node, parent's number) of a cleaned tree in document order."""
    out = [] if out is None else out
    at = len(out)
    out.append((n, parent))
    for c in (n.get("children") or []) if isinstance(n, dict) else []:
        walked(c, at, out)
    return out


@pytest.fixture(scope="module")
def trees():
    found = [some_tree() for _ in range(120)]
    return [t for t in found if isinstance(t, dict)]


@pytest.fixture(scope="module")
def docs(spark, trees):
    rows = [(i, json.dumps(t, ensure_ascii=False)) for i, t in enumerate(trees)] + [(900, "{"), (901, None), (902, "[1]"), (903, '"x"')]
    return spark.createDataFrame(rows, "doc_id int, body string")


@pytest.fixture(scope="module")
def held(docs):
    return nodes.shred(docs, columns=tuple(nodes.COLUMNS)).cache()


def test_regions(held, trees):
    got = {}
    for r in held.orderBy("doc_id", "begin").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(range(len(trees)))
    for i, t in enumerate(trees):
        want = walked(cleaned(t))
        assert [r.begin for r in got[i]] == list(range(len(want))) and [r.parent for r in got[i]] == [p for _, p in want]
        assert [r.end for r in got[i]] == [n + len(walked(x)) for n, (x, _) in enumerate(want)]
        assert [r.content for r in got[i]] == [nodes.tree_text(x) if isinstance(x, dict) and nodes.is_content(x.get("tag") or "") else None for x, _ in want]


def test_subtrees_and_texts_of_all_elements(held, trees):
    anchors = held.where("text is null").select("doc_id", "begin", "end")
    json_of = {(r.doc_id, r.begin): r.json for r in tree.subtrees(held, anchors).collect()}
    text_of = {(r.doc_id, r.begin): r.whole for r in tree.node_text(held, anchors.union(anchors)).collect()}
    assert tree.node_text(held, anchors.union(anchors)).count() == 2 * anchors.count()
    for i, t in enumerate(trees):
        for n, (x, _) in enumerate(walked(cleaned(t))):
            if isinstance(x, dict):
                assert json.loads(json_of[i, n]) == x and text_of[i, n] == nodes.tree_text(x)
    assert tree.subtrees(held, anchors.limit(0)).count() == 0


def test_within_counts_only_the_rows_given(spark):
    rows = spark.createDataFrame([(1, b) for b in (2, 3, 5, 8, 9)] + [(2, 1)], "doc_id int, begin long")
    spans = spark.createDataFrame([(1, 0, 10), (1, 2, 6), (1, 3, 4), (1, 4, 5), (1, 9, 12), (3, 0, 9), (1, None, 3), (1, 2, 6)], "doc_id int, begin long, end long")
    got = {(r.begin, r.end): [x.begin for x in r.inside] for r in tree.within(rows, spans, []).collect()}
    assert got == {(0, 10): [2, 3, 5, 8, 9], (2, 6): [2, 3, 5], (3, 4): [3], (4, 5): [], (9, 12): [9], (0, 9): []}


def test_table_function_equals_shred(spark, docs, held):
    nodes.register(spark)
    rows = spark.sql("SELECT d.doc_id, t.* FROM {docs} d, LATERAL shred_tree(d.body, 'path begin end tag num text content') t", docs=docs)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, held.select(*rows.columns).collect()), key=str)
    assert spark.sql("SELECT * FROM shred_tree('{\"tag\":\"a\"}', 'tag')").collect()[0][:] == ("a",)
    with pytest.raises(Exception, match="no such columns"):
        spark.sql("SELECT * FROM shred_tree('{}', 'tags')").collect()
    with pytest.raises(ValueError):
        nodes.shred(docs, columns=("tags",))


def test_stored_nodes_take_at_most_twice_their_bodies(spark):
    bodies = standins.trees(spark, SF).cache()
    written = stored(nodes.shred(bodies, columns=nodes.REQUESTED))
    size = sum(os.path.getsize(urlsplit(f).path) for f in written.inputFiles())
    assert size <= 2 * bodies.agg(F.sum(F.octet_length("body"))).first()[0]


def test_requests_shred_each_asked_document_once_in_many_tasks(spark, monkeypatch):
    """Of the laws only those asked for are parsed, each once, whatever forms the requests have."""
    parsed, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    real = nodes.shred

    def counted(docs, *a, **k):
        def spy(batches):
            rows = 0
            for b in batches:
                rows += b.num_rows
                yield b
            parsed.add(rows)
            tasks.add(int(rows > 0))

        return real(docs.mapInArrow(spy, docs.schema), *a, **k)

    monkeypatch.setattr(R, "shred", counted)
    law = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey < 40")
    forms = F.explode(F.array(*map(F.lit, ("json", "markdown", "toc"))))
    asked = law.select("c_name", forms.alias("format")).select(F.monotonically_increasing_id().alias("req_id"), F.col("c_name").alias("law_name"), F.lit("1").alias("article"), F.lit(None).cast("int").alias("paragraph"), F.lit(None).cast("int").alias("item"), "format", F.lit(None).cast("string").alias("at"))
    found = R.get_law(asked, standins.corpus(spark, SF)).collect()
    assert len(found) == 3 * law.count() and sum(r.format == "toc" for r in found) == law.count()
    assert parsed.value == law.count() < spark.read.parquet(f"{SF}/customer.parquet").count() and tasks.value > 1


def test_nested_outlines_cut_by_level(spark):
    rows = [(1, 0, 0, "Chapter", "1", "A", None), (1, 1, 1, "Article", "1", None, "(x)"), (1, 2, 1, "Section", None, 'S"', None), (1, 3, 2, "Article", "2", None, None), (1, 9, 0, "Article", "3", "T", None), (2, 5, 0, "Part", "1", "", None)]
    df = spark.createDataFrame(rows, "doc_id int, begin long, level int, tag string, num string, title string, caption string")
    of = lambda d: {r.doc_id: json.loads(r.toc) for r in outline.nested(d, ["doc_id"]).collect()}
    e = lambda tag, num=None, title=None, caption=None, *below: {k: v for k, v in (("tag", tag), ("num", num), ("title", title), ("caption", caption)) if v is not None} | {"children": list(below)}
    assert of(df) == {1: [e("Chapter", "1", "A", None, e("Article", "1", None, "(x)"), e("Section", None, 'S"', None, e("Article", "2"))), e("Article", "3", "T")], 2: [e("Part", "1", "")]}
    assert of(outline.limit_depth(df, 1)) == {1: [e("Chapter", "1", "A"), e("Article", "3", "T")], 2: [e("Part", "1", "")]}


def test_postings_equal_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    path = str(tmp_path / "index")
    assert postings.segments(spark, path) == [] and postings.search(spark, path, "a").count() == 0
    first = [(i, f"title{i % 5} Ｗｉｄｅ", f"word{i % 7}　and more text {i} 条文の全角") for i in range(100)] + [(100, None, None), (101, "", " "), (None, "x", "word1")]
    shape = "doc_id long, title string, text string"
    postings.add(spark.createDataFrame(first, shape), path, metadata="title", body="text")
    texts = {i: (t, b) for i, t, b in first if i is not None}

    def check():
        df = spark.createDataFrame([(i, t, b) for i, (t, b) in texts.items()], shape)
        for words in ("word3 text", "more 11", "absent", "文の", "wide title3", "Wide　ｔｉｔｌｅ4", "word", " ", "﻿ and﻿", "word1 title1"):
            level = F.when(has_all_terms(F.col("title"), F.lit(words)), 1).when(has_all_terms(F.col("text"), F.lit(words)), 2)
            want = sorted((r.doc_id, r.level) for r in df.withColumn("level", level).where("level is not null").collect())
            assert sorted((r.id, r.level) for r in postings.search(spark, path, words).collect()) == want, words

    check()
    later = [(3, "title3", "word3 text again"), (50, None, None), (200, "new", "absent no more"), (11, "gone", "gone")]
    postings.add(spark.createDataFrame(later, shape), path, metadata="title", body="text")
    texts |= {i: (t, b) for i, t, b in later}
    check()
    assert postings.segments(spark, path) == [1, 2] and postings.merge(spark, path) == 3 and postings.segments(spark, path) == [3]
    check()
    postings.add(spark.createDataFrame([(0, "wide title3", "")], shape), path, metadata="title", body="text")
    texts[0] = ("wide title3", "")
    check()
    longest = spark.read.parquet(f"{path}/postings").agg(F.max(F.size("places"))).first()[0]
    assert longest <= 16


def test_search_reads_the_index_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    postings.add(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), path)
    assert all(path in f for f in postings.search(spark, path, "text").inputFiles())


def test_as_of_each_request(spark):
    rng, day = random.Random(3), lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    revisions = [(rng.choice("abc"), day(rng.randint(0, 30)), rng.randint(0, 3), i) for i in range(60)] + [("d", None, 0, 99), (None, day(3), 0, 98)]
    asked = [(rng.choice("abcde"), day(rng.randint(-5, 40))) for _ in range(80)] + [("a", None), (None, day(9))]
    got = history.as_of_each(spark.createDataFrame(asked, "k string, day date"), spark.createDataFrame(revisions, "k string, d date, o int, i int"), "k", "day", "d", [-F.col("o"), F.col("i")], F.col("i")).collect()
    want = {(k, a): max(((d, -o, i) for x, d, o, i in revisions if x == k and d is not None and d <= a), default=(0, 0, None))[2] for k, a in asked if k and a}
    assert {(r.k, r.day): r.revision for r in got} == want and len(got) == len(want)
    plan = history.as_of_each(spark.createDataFrame(asked, "k string, day date"), spark.createDataFrame(revisions, "k string, d date, o int, i int"), "k", "day", "d", [F.col("i")], F.col("i"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


TITLES = {"L1": "First Act", "L2": "First Act Order", "L3": "Second Act"}


@pytest.fixture(scope="module")
def api():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            parts = urlsplit(self.path)
            query, steps = {k: v[0] for k, v in parse_qs(parts.query).items()}, unquote(parts.path).strip("/").split("/")
            answer, status = None, 200
            info = lambda i: {"law_id": i, "law_type": "CabinetOrder" if i == "L2" else "Act", "law_num": f"n{i}"}
            if steps[0] == "laws":
                found = [i for i, t in TITLES.items() if query.get("law_title", "") in t and query.get("law_type", info(i)["law_type"]) == info(i)["law_type"] and query.get("law_num", "") in info(i)["law_num"]]
                at, n = int(query.get("offset", 0)), int(query.get("limit", 100))
                answer = {"total_count": len(found), "laws": [{"law_info": info(i), "revision_info": {"law_title": TITLES[i]}} for i in found[at : at + n]]}
            elif steps[0] == "law_revisions":
                answer = {"law_info": info(steps[1]), "revisions": [{"law_revision_id": f"{steps[1]}_r{n}"} for n in (2, 1)]}
            elif steps[1] == "L3" or query.get("asof") == "1900-01-01":
                status = 503 if steps[1] == "L3" else 404
            else:
                text = f"as of {query.get('asof', 'now')}"
                answer = {"law_info": info(steps[1]), "law_full_text": {"tag": "Law", "children": [{"tag": "Article", "attr": {"Num": "1"}, "children": [{"tag": "Paragraph", "attr": {"Num": "1"}, "children": [{"tag": "ParagraphSentence", "children": [text]}]}]}]}}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode() if answer else b"")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_requests_over_the_api(spark, api):
    base, seen = api
    rows = [(0, "First Act", "1", None), (1, "First Act", "1", "2020-02-02"), (2, " First Act ", "1", None), (3, "First Act Order", "9", None), (4, "Second Act", "1", None), (5, "no such", "1", None), (6, "First Act", "1", "1900-01-01"), (7, "所基通", "1", None)]
    asked = spark.createDataFrame(rows, "req_id int, law_name string, article string, at string").selectExpr("*", "cast(null as int) paragraph", "cast(null as int) item", "'markdown' format")
    seen.clear()
    corpus = remote.corpus(spark, asked, base, delay=0.001)
    got = {r.req_id: r for r in R.get_law(asked, corpus).collect()}
    codes = {i: r.error and r.error.code for i, r in got.items()}
    assert codes == {0: None, 1: None, 2: None, 3: "ARTICLE_NOT_FOUND", 4: "SOURCE_API_ERROR", 5: "LAW_NOT_FOUND", 6: "SOURCE_API_ERROR", 7: "OUT_OF_SCOPE"}
    assert "as of now" in got[0].markdown and "as of 2020-02-02" in got[1].markdown and got[2].markdown.startswith("# First Act 第1条")
    assert got[4].error.retryable and got[4].error.detail.status == 503 and not got[6].error.retryable
    # each document and each name is asked for once, a failing one after each delay
    bodies = [p for p in seen if p.startswith("/law_data")]
    assert sorted(set(bodies)) == ["/law_data/L1", "/law_data/L1?asof=1900-01-01", "/law_data/L1?asof=2020-02-02", "/law_data/L2", "/law_data/L3"]
    assert len(bodies) == 4 + 1 + law_api.RETRIES and len([p for p in seen if p.startswith("/laws")]) == len({p for p in seen if p.startswith("/laws")})
    revisions = R.get_law_revisions(asked.where("req_id = 0").selectExpr("req_id", "law_name", "1 latest"), corpus).first()
    assert revisions.total == 2 and revisions.revisions[0].law_revision_id == "L1_r2"


def test_list_filters_are_pushed_down(spark, api):
    base, seen = api
    law_api.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        laws = spark.read.format("law_list").options(base=base, page=2).load()
        for where, want, sent in (
            ("law_title like '%Act%'", ["L1", "L2", "L3"], {"law_title=Act"}),
            ("contains(law_title, 'Order')", ["L2"], {"law_title=Order"}),
            ("law_type = 'Act' and contains(law_title, 'First')", ["L1"], {"law_title=First", "law_type=Act"}),
            ("law_num = 'nL'", [], {"law_num=nL"}),
            ("law_num = 'nL3' and law_id <> 'x'", ["L3"], {"law_num=nL3"}),
            ("law_title = 'First Act'", ["L1"], set()),
        ):
            seen.clear()
            found = laws.where(where)
            assert sorted(r.law_id for r in found.collect()) == want, where
            asked = {p for path in seen for p in urlsplit(path).query.split("&") if not p.startswith(("limit", "offset"))}
            assert asked == sent and all("limit=2" in path for path in seen)
        assert [(r.law_id, r.src_ord) for r in laws.collect()] == [("L1", 1), ("L2", 2), ("L3", 3)]
        plan = laws.where("law_type = 'Act' and law_id > 'L'")._jdf.queryExecution().executedPlan().toString()
        assert "law_id#" in plan.split("Filter", 1)[1].split("\n")[0] and "Act" not in plan.split("Filter", 1)[1].split("\n")[0], plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_batches_of_any_tool(spark):
    body = {"tag": "Law", "children": [{"tag": "Article", "attr": {"Num": "1"}, "children": [{"tag": "ArticleCaption", "children": ["(c)"]}]}]}
    laws = spark.createDataFrame([("L1", "First Act", "n1", "Act", 0)], "law_id string, law_title string, law_num string, law_type string, src_ord int")
    revisions = spark.createDataFrame([("L1", "r1", dt.date(2020, 1, 1), 0)], "law_id string, law_revision_id string, enforcement_date date, api_ord int")
    corpus = R.Corpus(laws, revisions, None, aliases(spark), law_types(spark), bodies=spark.createDataFrame([("r1", json.dumps(body))], "doc_id string, body string"))
    asked = [
        (0, "get_law", {"law_name": "First Act", "article": "1", "format": "json", "unknown": 1}), (1, "get_toc", {"law_name": "First Act"}), (2, "get_law_revisions", {"law_name": "First Act", "latest": "x"}), (3, "search_law", {"keyword": "Act", "lim": 3}),
        (4, "search_fulltext", {"keyword": " "}), (5, "resolve_abbreviation", {"abbr": "消法"}), (6, "explain_law_type", {"name": "通達"}), (7, "none", {}), (8, None, None), (9, "get_law", None), (10, "get_law", {"law_name": "zzz"}),
    ]
    rows = [(i, t, a if a is None else json.dumps(a)) for i, t, a in asked] + [(11, "get_toc", "{")]
    df = spark.createDataFrame(rows, "req_id int, tool string, arguments string")
    for batch in (df, df.withColumn("arguments", F.try_parse_json("arguments"))):
        got = {r.req_id: (r.is_error, json.loads(r.answer)) for r in R.answers(batch, corpus).collect()}
        assert sorted(got) == list(range(12)) and [i for i in got if got[i][0]] and {i for i in got if got[i][0]} == {7, 8, 9, 10, 11}
        assert got[0][1]["data"]["node"] == body["children"][0] and got[1][1]["toc"] == [{"tag": "Article", "num": "1", "caption": "(c)", "children": []}]
        assert got[2][1]["total"] == 1 and got[3][1]["total_count"] == 1 and got[4][1]["fallback"]["error"]["code"] == "INVALID_ARGUMENT"
        assert got[5][1]["resolved"]["domain"] == "tax" and got[6][1]["found"] and got[7][1]["code"] == got[8][1]["code"] == "UNKNOWN_TOOL" and got[10][1]["code"] == "LAW_NOT_FOUND"


def test_an_increment_writes_the_buckets_of_its_changed_keys(spark, tmp_path):
    path, shape = str(tmp_path / "table"), "doc_id int, body string, more int"
    held = {i: (f"body {i}", i) for i in range(200)}
    rows = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], shape)
    table = lambda: {r.doc_id: (r.body, r.more) for r in buckets.read(spark, path, shape).collect()}
    assert buckets.version(spark, path) == 0 and table() == {}
    assert buckets.merge(spark, path, rows(held), "doc_id", "body", 16) == 1 and table() == held
    before = {str(f) for f in tmp_path.rglob("*.parquet") if "data" in str(f)}
    assert buckets.merge(spark, path, rows({5: held[5], 7: held[7]}), "doc_id", "body") == 1
    assert buckets.merge(spark, path, rows({5: ("other", 5), 7: held[7]}), "doc_id", "body") == 2
    held[5] = ("other", 5)
    written = {str(f) for f in tmp_path.rglob("*.parquet") if "data" in str(f)} - before
    assert len({f.split("_bucket=")[1].split("/")[0] for f in written}) == 1 and table() == held
    more = {300: (None, 1), 301: ("", 2), 0: (None, 0)}
    assert buckets.merge(spark, path, rows(more).union(spark.createDataFrame([(None, "x", 1)], shape)), "doc_id", "body") == 3
    held |= more
    assert table() == held and buckets.merge(spark, path, rows(more), "doc_id", "body") == 3
    assert buckets.merge(spark, path, rows({300: ("", 1)}), "doc_id", "body") == 4 and table() == held | {300: ("", 1)}
    near = buckets.read(spark, path, shape, rows({5: ("", 0)}).select("doc_id"))
    assert 5 in {r.doc_id for r in near.collect()} and near.count() < 60


def test_a_lost_run_leaves_the_old_version_whole(spark, tmp_path):
    path, shape = str(tmp_path / "table"), "doc_id int, body string"
    one = lambda text: spark.createDataFrame([(i, f"{text} {i}") for i in range(20)], shape)
    buckets.merge(spark, path, one("a"), "doc_id", "body", 4)
    failing = one("b").withColumn("body", F.when(F.col("doc_id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        buckets.merge(spark, path, failing, "doc_id", "body")
    assert {r.body for r in buckets.read(spark, path, shape).collect()} == {f"a {i}" for i in range(20)}
    assert buckets.merge(spark, path, one("b"), "doc_id", "body") == 2 and buckets.read(spark, path, shape).where("body like 'b %'").count() == 20


def test_half_width_katakana(spark):
    cases = {"ｶﾞｷﾞｸ": "ガギク", "ﾊﾟﾊﾞﾊ": "パバハ", "ｳﾞｧｲｵﾘﾝ": "ヴァイオリン", "ﾞｱﾞﾟ": "゛ア゛゜", "ﾊﾞﾟ": "バ゜", "ﾎﾟｹﾂﾄ ﾓﾝｽﾀｰ｡": "ポケツト モンスター。", "カﾞ": "ガ", "plain": "plain", "": "", "ﾊﾊﾟﾊﾟﾊ": "ハパパハ", None: None}
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.y for r in df.select("x", fold_kana(F.col("x")).alias("y")).collect()} == cases
    import unicodedata

    marks = [b + m for b in "ｦｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ" for m in ("", "ﾞ", "ﾟ")]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(marks)], "i int, x string").orderBy("i").select(fold_kana(F.col("x"))).collect()]
    plain = lambda x: unicodedata.normalize("NFKC", x).replace("\u3099", "゛").replace("\u309a", "゜")
    assert got == [plain(x) for x in marks]


def test_archives_on_any_file_system(spark, tmp_path):
    """As the reader that opens files itself, member by member, in many tasks; a broken archive and an odd packing are rows with a cause."""
    import zipfile

    folder = tmp_path / "zips"
    folder.mkdir()
    law = '<Law><LawBody><LawTitle>T é {}</LawTitle></LawBody></Law>'
    with zipfile.ZipFile(folder / "27_xml.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("all_law_list.csv", "\ufeff" + ",".join(bulk.LIST) + '\r\n法律,n1,"T, x"\r\n')
        for i in range(450):
            z.writestr(f"L{i}_20250601_{'0' * 15}/L{i}_20250601_{'0' * 15}.xml", law.format(i))
    with zipfile.ZipFile(folder / "all_xml.zip", "w") as z:
        z.writestr("bad.xml", "<Law>")
        z.writestr(zipfile.ZipInfo("L9_20250601_A1/L9_20250601_A1.xml"), law.format("stored"))
    bulk.register(spark)
    for kind in ("laws", "list"):
        want = [tuple(r) for p in ("27_xml.zip", "all_xml.zip") for r in spark.read.format("law_bulk").options(path=str(folder / p), kind=kind).load().collect()]
        got = bulk.read_archives(spark, f"file://{folder}", kind)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
    assert sum(n > 0 for n in bulk.read_archives(spark, str(folder)).groupBy(F.spark_partition_id()).count().toPandas()["count"]) > 1
    (folder / "broken.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(folder / "odd.zip", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("a.xml", law)
    causes = {r.cause for r in bulk.read_archives(spark, str(folder)).where("body is null").collect()}
    assert len(causes) == 3 and "packed by method 12" in causes and bulk.read_archives(spark, str(folder), glob_filter="none*").count() == 0


def test_answers_as_files_are_all_there_or_none(spark, tmp_path):
    path = tmp_path / "answers"
    answer_files.register(spark)
    law = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey < 12")
    asked = law.select(F.col("c_custkey").alias("req_id"), F.when(F.col("c_custkey") % 4 == 3, "zzz").otherwise(F.col("c_name")).alias("law_name"), F.lit(None).cast("string").alias("at"), F.lit(1).alias("depth"))
    found = R.get_toc(asked, standins.corpus(spark, SF)).repartition(4)
    save = lambda df, mode: df.write.format("answer_files").option("path", str(path)).mode(mode).save()
    held = lambda: sorted(f.name for f in path.rglob("*") if f.is_file())
    save(answer_files.files(found), "append")
    want = sorted(f"{i}.{'json' if i % 4 == 3 else 'md'}" for i in range(12))
    assert held() == want
    by = {f.name: f.read_text() for f in path.rglob("*") if f.is_file()}
    assert by["4.md"].startswith("# Customer#") and json.loads(by["3.json"])["code"] == "LAW_NOT_FOUND"
    assert {r.value.split("\n")[0] for r in spark.read.text(f"{path}/*/*/4.md", wholetext=True).collect()} == {by["4.md"].split("\n")[0]}
    # a task that fails after others have written leaves nothing behind
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, "a/b").otherwise(F.col("id").cast("string")).alias("name"), F.lit("x").alias("text"))
    with pytest.raises(Exception, match="no name for a file"):
        save(bad, "append")
    assert held() == want and not [p for p in path.iterdir() if p.name.startswith(".")]
    save(bad.where("name <> 'a/b'"), "append")
    assert len(held()) == len(want) + 39
    save(bad.where("name = '7'"), "overwrite")
    assert held() == ["7"]
    with pytest.raises(Exception, match="name and text"):
        save(bad.withColumnRenamed("text", "t"), "append")
