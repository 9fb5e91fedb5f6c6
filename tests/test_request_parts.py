"""Requests answered from one parse of each document: what they write to disk, and their answers against those of the node operators."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import outline as toc
from lexgrove.operators import tree
from lexgrove.plans import queries, standins
from lexgrove.plans import requests as R
from lexgrove.session import checkpoint_dir, stored
from lexgrove.sources import nodes
from lexgrove.sources.aliases import aliases
from lexgrove.sources.law_types import law_types

SF = "/root/testdata/sf0.001"


def _written(spark):
    """Bytes shuffled and bytes beside the checkpoints so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(True)
    shared = checkpoint_dir(spark).removeprefix("file:")
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) + sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared) for f in files)


@pytest.mark.parametrize("name", ["get_law", "get_law_forms"])
def test_requests_write_less_than_the_texts_of_the_laws(spark, name):
    texts = standins.trees(spark, SF).agg(F.sum(F.octet_length("body"))).first()[0]
    before = _written(spark)
    queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert _written(spark) - before < texts


def test_a_stored_table_leaves_no_shuffle_files(spark):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in _seq(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    held = stored(spark.range(1000).groupBy(F.col("id") % 7).count())
    ends = time.time() + 20
    while files() > before and time.time() < ends:
        time.sleep(0.2)
    assert files() <= before and held.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def _seq(xs):
    return [xs.apply(i) for i in range(xs.size())]


def _tree(rng, depth=0):
    if depth > 5 or (depth and rng.random() < 0.15):
        return rng.choice(["t", "", 'q"\\\n', " 条　文 ", "一　x", {"tag": "Leaf"}, {"tag": "E", "children": "no list"}, {"children": ["y"], "tag": "Sentence"}, {"tag": "Item", "attr": {"Num": 1, "b": "/"}, "children": []}, 5, None, ["x"]])
    tag = rng.choice(["Article", "Article", "Chapter", "ChapterTitle", "ArticleTitle", "ArticleCaption", "Paragraph", "Paragraph", "ParagraphSentence", "Item", "MainProvision"])
    attr = {"attr": {"Num": rng.choice(["1", 2, "2_2"])}} if rng.random() < 0.8 else {}
    return {"tag": tag, **attr, "children": [_tree(rng, depth + 1) for _ in range(rng.randint(0, 5))]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    trees = [{"tag": "Law", "children": [_tree(rng, 1) for _ in range(3)]} for _ in range(60)]
    return spark.createDataFrame([(f"d{i}", json.dumps(t, ensure_ascii=False)) for i, t in enumerate(trees)] + [("d60", "{"), ("d61", None)], "doc_id string, body string").cache()


def test_parts_of_documents_are_those_of_their_nodes(spark, docs):
    held = nodes.shred(docs, columns=nodes.REQUESTED).cache()
    ways = [(form, num, p, i) for form in ("json", "markdown") for num in ("1", "2", "9") for p in (None, 1, 2) for i in (None, 1, 2)]
    asks = docs.select("doc_id").crossJoin(spark.createDataFrame(ways, "form string, num string, paragraph int, item int")).withColumn("req_id", F.monotonically_increasing_id()).cache()
    lists = asks.groupBy("doc_id").agg(F.collect_list(F.struct("req_id", "form", "num", "paragraph", "item", F.lit(0).alias("block"))).alias("asked"))
    found = nodes.shred(lists.join(docs, "doc_id"), asked="asked")
    got = {r.req_id: r for r in found.withColumn("text", F.array_join(F.transform("paragraphs", toc.paragraph_block), "\n\n")).collect()}
    rows = tree.find_articles(held, asks, "num").withColumn("begin", F.col("found.begin"))
    rows = tree.children(held, rows, "Paragraph", "paragraph", first=True).withColumnRenamed("child", "p").withColumn("begin", F.col("p.begin"))
    rows = tree.children(held, rows, "Item", "item", first=True).withColumnRenamed("child", "i").withColumn("begin", F.col("found.begin"))
    rows = tree.children(held, rows, "ArticleCaption", first=True).withColumnRenamed("child", "c").collect()
    every = held.where("tag is not null").select("doc_id", "begin", "end")
    jsons = {(r.doc_id, r.begin): r.json for r in tree.subtrees(held, every).collect()}
    blocks = {}
    for r in sorted(toc.blocks(held).collect(), key=lambda r: r.begin):
        blocks[r.doc_id, r.begin] = r.block
        blocks.setdefault((r.doc_id, "in", r.parent), []).append(r.block)
    assert len(got) == len(rows)
    seen = set()
    for r in rows:
        g = got[r.req_id]
        p, i = r.p, r.i if r.p else None
        assert (g.found_num, g.paragraph_num, g.item_num) == (r.found and r.found.num, p and p.num, i and i.num)
        missing = r.found is None or (r.paragraph and p is None) or (r.paragraph and r.item and i is None)
        if missing:
            assert g.json is None and g.text is None and g.item_content is None
            continue
        seen.add((r.form, bool(p), bool(i)))
        if r.form == "json":
            assert g.json == jsons[r.doc_id, (i or p or r.found).begin]
            continue
        assert g.caption == (r.c and r.c.content)
        if i:
            assert g.item_content == i.content
        else:
            assert g.text == (blocks[r.doc_id, p.begin] if p else "\n\n".join(blocks.get((r.doc_id, "in", r.found.begin), [])))
    assert len(seen) == 6
    outlines = spark.createDataFrame([(f"d{i}", [(0, "toc", None, None, None, 0)]) for i in range(62)], "doc_id string, asked array<struct<req_id:long,form:string,num:string,paragraph:int,item:int,block:int>>")
    shown = {r.doc_id: [tuple(x) for x in r.outline or []] for r in nodes.shred(outlines.join(docs, "doc_id"), asked="asked").collect()}
    want = {f"d{i}": [] for i in range(62)}
    for r in sorted(toc.extract(held).collect(), key=lambda r: r.begin):
        want[r.doc_id].append((r.level, r.tag, r.num, r.title, r.caption))
    assert shown == want and any(want.values())


def test_requests_of_one_document_in_lists_and_of_given_nodes(spark, docs, monkeypatch):
    held = docs.where("doc_id in ('d0', 'd1', 'd2')")
    laws = held.select(F.concat(F.lit("L"), "doc_id").alias("law_id"), F.concat(F.lit("Act "), "doc_id").alias("law_title"), F.lit("no").alias("law_num"), F.lit("Act").alias("law_type"), F.lit(None).cast("string").alias("promulgation_date"), F.lit(0).alias("src_ord"))
    revisions = held.select(F.concat(F.lit("L"), "doc_id").alias("law_id"), F.col("doc_id").alias("law_revision_id"), F.lit("2020-01-01").cast("date").alias("enforcement_date"), F.lit(0).alias("api_ord"))
    ways = [(f"Act {d}", num, p, None, form, None) for d in ("d0", "d1", "d2", "zz") for num in ("1", "2", None) for p in (None, 1) for form in ("json", "markdown", "toc")]
    asked = spark.createDataFrame([(i, *w) for i, w in enumerate(ways)], "req_id int, law_name string, article string, paragraph int, item int, format string, at string")
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    given = lambda **x: R.Corpus(laws, revisions, x.get("nodes"), aliases(spark), law_types(spark), bodies=x.get("bodies"))
    told = lambda corpus: sorted(map(str, R.get_law(asked, corpus, now).collect()))
    want = told(given(bodies=held))
    assert len(want) == len(ways) and sum("outline" in w or "目次" in w for w in want) >= 9
    assert told(given(nodes=nodes.shred(held, columns=nodes.REQUESTED))) == want
    monkeypatch.setattr(R, "LISTED", 2)
    monkeypatch.setattr(nodes, "BATCH_ROWS", 3)
    assert told(given(bodies=held.unionByName(held))) == want


def test_articles_inside_articles_are_found_however_they_are_written():
    inner = '{"tag":"%s","attr":{"Num":"2"},"children":[]}'
    for tag in ("Article", "\\u0041rticle"):
        of = nodes.Parts('{"tag":"Law","children":[{"tag":"Article","attr":{"Num":"1"},"children":[' + inner % tag + ',{"tag":"Article","attr":{"Num":"1"}}]},"Article"]}')
        assert [of.of("json", num, None, None).get("found_num") for num in ("1", "2", "3")] == ["1", "2", None]
        assert json.loads(of.of("json", "1", None, None)["json"])["children"]
