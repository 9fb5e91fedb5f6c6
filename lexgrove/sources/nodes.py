"""Document trees as rows: one for each element and each text child, numbered in document order."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Tags that make an outline.
STRUCTURAL = ("Part", "Chapter", "Section", "Subsection", "Division")

#: What a row can hold. A caller names the columns it needs; no other is made.
#: begin numbers a tree's rows from 0 in document order and end is the number after its last descendant, so that a subtree is
#: the stretch from begin to end and an ancestor one that contains it; parent is the parent's begin (-1: none).
#: path holds child positions from the root. level is the number of structural tags above, in_article whether an Article stands above: an outline is a filter.
#: content is the whole text of titles, captions, paragraph sentences and items.
#: A tree's JSON is, row by row, head (a comma after a sibling, an element up to its children or a text) and closes times the end of an
#: element; shut says how many elements around an element end with it.
COLUMNS = {
    "path": "array<int>", "begin": "long", "end": "long", "parent": "long", "tag": "string", "num": "string", "text": "string",
    "level": "int", "in_article": "boolean", "content": "string", "head": "string", "closes": "int", "shut": "int",
}
DEFAULT = tuple(c for c in COLUMNS if c not in ("head", "closes", "shut"))
#: What outlines are made of, and what the requests read.
OUTLINED = ("begin", "end", "parent", "tag", "num", "level", "in_article", "content")
REQUESTED = (*OUTLINED, "head", "closes", "shut")

_ARROW = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_quoted = json.encoder.encode_basestring
#: Stands behind a tree's last node.
_END = object()
#: Rows of a batch, whole trees; and about how many bytes of the parts that requests ask for.
BATCH_ROWS, BATCH_BYTES = 20_000, 4 << 20
#: What a request gets of its document: the numbers of the article, paragraph and item found, the article's caption, the item's text or the paragraphs asked for, the subtree, the outline.
PARTS = {
    "found_num": "string", "paragraph_num": "string", "item_num": "string", "caption": "string", "item_content": "string",
    "paragraphs": "array<struct<num:string,sentence:string,items:array<struct<num:string,content:string>>>>",
    "json": "string", "outline": "array<struct<level:int,tag:string,num:string,title:string,caption:string>>",
}


def is_content(tag: str) -> bool:
    """Tags whose whole text stands in `content`: titles, captions, paragraph sentences and items."""
    return tag.endswith(("Title", "Caption")) or tag in ("ParagraphSentence", "Item")


def tree_text(node: object) -> str:
    """Texts below a node in document order."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, dict):
            todo.extend(reversed(n.get("children") or []))
    return "".join(out)


def _head(node: dict) -> str:
    """The JSON of an element without its children: open, up to the bracket of the list, or whole if it has no such list."""
    rest = json.dumps({k: v for k, v in node.items() if k != "children" or not isinstance(v, list)}, ensure_ascii=False, separators=(",", ":"))
    if not isinstance(node.get("children"), list):
        return rest
    return f'{rest[:-1]}{"," if len(rest) > 2 else ""}"children":['


def tree_columns(body: str | None, wanted: Sequence[str], into: dict[str, list]) -> int:
    """Append one tree's rows to the lists of the wanted columns; their number, 0 if the text is no JSON object."""
    try:
        root = json.loads(body) if body else None
    except ValueError:
        return 0
    if not isinstance(root, dict):
        return 0
    made: dict[str, list] = {c: [] for c in COLUMNS}
    paths, ends, parents, tags, nums, said, levels, insides, contents, heads, closes, shuts = (made[c] for c in COLUMNS if c != "begin")
    begin, texts = 0, []
    with_path, with_json, with_content = "path" in wanted, "head" in wanted or "closes" in wanted or "shut" in wanted, "content" in wanted
    known: dict[str, str] = {}
    # open elements with the number of texts before them
    above: list[tuple[int, int]] = []
    todo: list[tuple] = [(root, [0] if with_path else None, 0, False, -1, 0)]
    while True:
        node, path, level, inside, parent, depth = todo.pop() if todo else (_END, None, 0, False, -1, 0)
        if node is not _END and not isinstance(node, (str, dict)):
            continue
        if len(above) > depth:
            if with_json:
                # elements with a list of children close by its bracket
                closes[-1] += len(above) - depth - (not heads[above[-1][0]].endswith("["))
            while len(above) > depth:
                at, before = above.pop()
                ends[at] = begin
                shuts[at] = len(above) - depth
                if contents[at] is not None:
                    contents[at] = "".join(texts[before:])
        if node is _END:
            break
        sibling = begin > parent + 1
        if isinstance(node, str):
            texts.append(node)
            tags.append(None)
            nums.append(None)
            said.append(node)
            contents.append(None)
            if with_json:
                heads.append("," + _quoted(node) if sibling else _quoted(node))
        else:
            tag, attr, children = node.get("tag"), node.get("attr"), node.get("children")
            num = attr.get("Num") if isinstance(attr, dict) else None
            above.append((begin, len(texts)))
            tags.append(tag)
            nums.append(num if num is None else str(num))
            said.append(None)
            contents.append("" if with_content and isinstance(tag, str) and is_content(tag) else None)
            if with_json:
                if attr is None and len(node) == 2 and isinstance(children, list) and isinstance(tag, str):
                    head = known.get(tag) or known.setdefault(tag, _head(node))
                else:
                    head = _head(node)
                heads.append("," + head if sibling else head)
            if children and isinstance(children, list):
                below, within, next_depth = level + (tag in STRUCTURAL), inside or tag == "Article", depth + 1
                for i in range(len(children) - 1, -1, -1):
                    todo.append((children[i], [*path, i] if with_path else None, below, within, begin, next_depth))
        paths.append(path)
        parents.append(parent)
        levels.append(level)
        insides.append(inside)
        ends.append(begin + 1)
        closes.append(0)
        shuts.append(0)
        begin += 1
    made["begin"] = list(range(begin))
    for c in wanted:
        into[c] += made[c]
    return begin


def tagged_columns(body: str | None, wanted: Sequence[str], into: dict[str, list], tags: frozenset[str]) -> int:
    """As tree_columns, but of the elements with these tags alone: what else there is counts in begin, end and path, and its text in content, without a row of its own."""
    try:
        root = json.loads(body) if body else None
    except ValueError:
        return 0
    if not isinstance(root, dict):
        return 0
    made: dict[str, list] = {c: [] for c in COLUMNS}
    rows, ends, contents, with_path, with_content = 0, made["end"], made["content"], "path" in wanted, "content" in wanted
    begin, texts, open_contents = 0, [], 0
    # the open elements: what is left of their children, their begin, their row (None: no row), whether it has content, the number of texts before them, level and in_article of what they hold, and their position
    above: list[tuple] = []
    node, level, inside, parent, at = root, 0, False, -1, 0
    rest: Iterator = iter(())
    while True:
        if node is not None:
            tag, children, own, row, said = node.get("tag"), node.get("children"), begin, None, False
            begin += 1
            named = isinstance(tag, str)
            if named and tag in tags:
                row, said, attr = rows, with_content and is_content(tag), node.get("attr")
                rows += 1
                num = attr.get("Num") if isinstance(attr, dict) else None
                made["begin"].append(own)
                made["parent"].append(parent)
                made["tag"].append(tag)
                made["num"].append(num if num is None else str(num))
                made["text"].append(None)
                made["level"].append(level)
                made["in_article"].append(inside)
                made["path"].append([*(a[7] for a in above), at] if with_path else None)
                ends.append(begin)
                contents.append("" if said else None)
            if children and isinstance(children, list):
                above.append((rest, own, row, said, len(texts), level, inside, at))
                open_contents += said
                level, inside, parent, rest = level + (named and tag in STRUCTURAL), inside or tag == "Article", own, iter(enumerate(children))
            node = None
        for at, child in rest:
            if isinstance(child, str):
                begin += 1
                if open_contents:
                    texts.append(child)
            elif isinstance(child, dict):
                held, tag = child.get("children"), child.get("tag")
                if isinstance(held, list) and len(held) == 1 and isinstance(held[0], str) and not (isinstance(tag, str) and tag in tags):
                    # a leaf without a row
                    begin += 2
                    if open_contents:
                        texts.append(held[0])
                else:
                    node = child
                    break
        if node is None:
            if not above:
                break
            rest, own, row, said, before, level, inside, at = above.pop()
            parent = above[-1][1] if above else -1
            if row is not None:
                ends[row] = begin
                if said:
                    open_contents -= 1
                    contents[row] = "".join(texts[before:])
                    if not open_contents:
                        texts.clear()
    for c in wanted:
        into[c] += made[c]
    return rows


def _parsed(body: str | None) -> dict | None:
    """The root of a tree given as JSON text, or null if the text is no JSON object."""
    try:
        root = json.loads(body) if body else None
    except ValueError:
        return None
    return root if isinstance(root, dict) else None


def _elements(node: dict) -> list[dict]:
    held = node.get("children")
    return [c for c in held if isinstance(c, dict)] if isinstance(held, list) else []


def _number(node: dict) -> str | None:
    attr = node.get("attr")
    num = attr.get("Num") if isinstance(attr, dict) else None
    return num if num is None else str(num)


def _content(node: dict) -> str:
    """Texts below a node in document order, as tree_columns has them."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, dict) and isinstance(held := n.get("children"), list):
            todo.extend(reversed(held))
    return "".join(out)


def subtree_json(node: dict) -> str:
    """A subtree's JSON: what head and closes of its rows join to."""
    out: list[str] = []
    todo: list[tuple[object, str]] = [(node, "")]
    while todo:
        n, comma = todo.pop()
        if n is _END:
            out.append("]}")
        elif isinstance(n, str):
            out.append(comma + _quoted(n))
        else:
            tag, held = n.get("tag"), n.get("children")
            listed = isinstance(held, list)
            out.append(f'{comma}{{"tag":{_quoted(tag)},"children":[' if listed and len(n) == 2 and isinstance(tag, str) else comma + _head(n))
            if listed:
                todo.append((_END, ""))
                if len(held) == 1:
                    held = held if isinstance(held[0], (str, dict)) else []
                else:
                    held = [c for c in held if isinstance(c, (str, dict))]
                for i in range(len(held) - 1, -1, -1):
                    todo.append((held[i], "," if i else ""))
    return "".join(out)


class Parts:
    """What requests ask of one document: each element is looked for once, however many requests name it."""

    def __init__(self, body: str | None):
        self.body, self.root = body, _parsed(body)
        self.known: dict[tuple, object] = {}

    def _once(self, what: str, node: dict, make: Callable[[dict], object]) -> object:
        # elements live as long as their root, so that their addresses tell them apart
        at = (what, id(node))
        if at not in self.known:
            self.known[at] = make(node)
        return self.known[at]

    def _articles(self, root: dict) -> dict[str, dict]:
        """The first article of each number in document order, at any depth."""
        for within in (False, True):
            found: dict[str, dict] = {}
            met, todo = 0, [root]
            while todo:
                node = todo.pop()
                if node.get("tag") == "Article":
                    met += 1
                    if (num := _number(node)) is not None:
                        found.setdefault(num, node)
                    if not within:
                        continue
                held = node.get("children")
                if isinstance(held, list):
                    for c in reversed(held):
                        if isinstance(c, dict):
                            todo.append(c)
            # articles are looked at inside only if the text has the word more often than articles were met
            if "\\u" not in self.body and self.body.count('"Article"') == met:
                break
        return found

    def _child(self, node: dict | None, tag: str, num: int | None) -> dict | None:
        """The first child of the tag that has the number."""
        if node is None or num is None:
            return None

        def numbered(of: dict) -> dict[str | None, dict]:
            found: dict[str | None, dict] = {}
            for c in _elements(of):
                if c.get("tag") == tag:
                    found.setdefault(_number(c), c)
            return found

        return self._once(tag, node, numbered).get(str(num))

    @staticmethod
    def _first(node: dict, tag: str) -> str | None:
        return next((_content(c) for c in _elements(node) if c.get("tag") == tag), None)

    def _paragraph(self, node: dict) -> dict:
        items = [{"num": _number(c), "content": _content(c)} for c in _elements(node) if c.get("tag") == "Item"]
        return {"num": _number(node), "sentence": self._first(node, "ParagraphSentence"), "items": items}

    def _paragraphs(self, node: dict) -> list[dict]:
        return [self._paragraph(c) for c in _elements(node) if c.get("tag") == "Paragraph"]

    def _outline(self, root: dict) -> list[dict]:
        """Structural elements and articles outside articles, in document order (see operators.outline.extract)."""
        rows, todo = [], [(root, 0)]
        while todo:
            node, level = todo.pop()
            tag = node.get("tag")
            article, structural = tag == "Article", tag in STRUCTURAL
            if article or structural:
                title = self._first(node, f"{tag}Title") or (None if article else "")
                rows.append({"level": level, "tag": tag, "num": _number(node), "title": title, "caption": self._first(node, "ArticleCaption") or None if article else None})
            if not article:
                todo.extend((c, level + structural) for c in reversed(_elements(node)))
        return rows

    def of(self, form: str, num: str | None, paragraph: int | None, item: int | None) -> dict:
        """The columns of PARTS for one request."""
        if self.root is None:
            return {}
        if form == "toc":
            return {"outline": self._once("outline", self.root, self._outline)}
        article = self._once("articles", self.root, self._articles).get(num) if num is not None else None
        if article is None:
            return {}
        # an item is looked for in the paragraph given, else left aside
        p = self._child(article, "Paragraph", paragraph)
        i = self._child(p, "Item", item)
        found = {"found_num": _number(article), "paragraph_num": p and _number(p), "item_num": i and _number(i)}
        if (paragraph is not None and p is None) or (p is not None and item is not None and i is None):
            return found
        if form == "json":
            top = article if p is None else p if i is None else i
            return found | {"json": self._once("json", top, subtree_json)}
        found["caption"] = self._once("caption", article, lambda x: self._first(x, "ArticleCaption"))
        if i is not None:
            return found | {"item_content": self._once("content", i, _content)}
        return found | {"paragraphs": self._once("paragraphs", article, self._paragraphs) if p is None else [self._once("paragraph", p, self._paragraph)]}


def _length(x: object) -> int:
    """About how many bytes a value takes."""
    if isinstance(x, str):
        return len(x)
    if isinstance(x, dict):
        return sum(map(_length, x.values()))
    return sum(map(_length, x)) if isinstance(x, list) else 8


def _checked(columns: Sequence[str], tags: Sequence[str] | None = None) -> list[str]:
    if tags is not None and (whole := {"head", "closes", "shut"} & set(columns)):
        raise ValueError(f"a tree's JSON is made of all its rows: {sorted(whole)}")
    if unknown := set(columns) - set(COLUMNS):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return list(columns)


def spread(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The trees dealt by key to as many partitions as the session shuffles into, however few tasks they come from: parsing is what costs.

    By a hash of its own: a repartitioning by the key itself is left out where a join before it has shuffled by that key, also where that join then becomes a broadcast.
    """
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


def shred(docs: DataFrame, key: str = "doc_id", body: str = "body", columns: Sequence[str] = DEFAULT, tags: Sequence[str] | None = None, asked: str | None = None) -> DataFrame:
    """key and the columns (see COLUMNS) of each tree given as JSON text. Bad JSON, null and what is no object give no rows.

    With tags, only the elements that have one of these are rows, numbered as all are. A task holds one tree at a time and gives rows on in batches of about BATCH_ROWS.
    With asked, a column with a list of requests, a row is a request and what it asks for (see _answered), and no row stands for an element.
    """
    if asked is not None:
        return _answered(docs, key, body, asked)
    wanted, only, kind = _checked(columns, tags), tags if tags is None else frozenset(tags), docs.schema[key].dataType.simpleString()
    types = [_ARROW[COLUMNS[c]] for c in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in wanted}
            of: list[int] = []

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(rows[c], t) for c, t in zip(wanted, types)]], ["key", *wanted])
                of.clear()
                for values in rows.values():
                    values.clear()
                return out

            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                of += [i] * (tree_columns(body, wanted, rows) if only is None else tagged_columns(body, wanted, rows, only))
                if len(of) >= BATCH_ROWS:
                    yield flush()
            yield flush()

    made = docs.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in wanted))
    return made.withColumnRenamed("key", key)


def _answered(docs: DataFrame, key: str, body: str, asked: str) -> DataFrame:
    """key, the fields of each request in the lists of `asked` (form, num, paragraph, item, block and more) and the columns of PARTS: what it asks of the document, parsed once for a list.

    form is toc, json or markdown. A list's block says which of its document's it is: where documents are given twice, only the first that a list meets counts. Requests themselves stay in Arrow.
    """
    request = docs.schema[asked].dataType.elementType
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(f.name, f.dataType) for f in request], *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in PARTS.items()))])
    names, parts = [f.name for f in request], to_arrow_schema(T.StructType([schema[c] for c in PARTS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            lists = batch.column(2)
            flat = dict(zip(names, lists.flatten().flatten()))
            forms, nums, paragraphs, items, blocks = (flat[c].to_pylist() for c in ("form", "num", "paragraph", "item", "block"))
            took: list[int] = []
            of: list[int] = []
            rows: list[dict] = []
            size = 0

            def flush() -> pa.RecordBatch:
                where = pa.array(took, pa.int64())
                made = [pa.array([r.get(f.name) for r in rows], f.type) for f in parts]
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[flat[c].take(where) for c in names], *made], [key, *names, *PARTS])
                for values in (took, of, rows):
                    values.clear()
                return out

            first = 0
            for i, many in enumerate(lists.value_lengths().to_pylist()):
                at, first = first, first + (many or 0)
                if not many:
                    continue
                this = (batch.column(0)[i].as_py(), blocks[at])
                if this == last:
                    continue
                last = this
                tree = Parts(batch.column(1)[i].as_py())
                for j in range(at, first):
                    part = tree.of(forms[j], nums[j], paragraphs[j], items[j])
                    took.append(j)
                    of.append(i)
                    rows.append(part)
                    size += _length(part)
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield flush()
                        size = 0
            yield flush()

    return docs.select(key, body, asked).mapInArrow(run, schema)


class TreeRows:
    """Table function of a tree: SELECT d.id, t.* FROM docs d, LATERAL shred_tree(d.body, 'begin end tag text') t. The second argument, a constant, names the columns; a third, if given, the tags whose elements are rows (see shred)."""

    @staticmethod
    def analyze(body: AnalyzeArgument, columns: AnalyzeArgument, tags: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(columns.value, str):
            raise ValueError("columns: a constant with names parted by spaces")
        if tags is not None and not isinstance(tags.value, str):
            raise ValueError("tags: a constant with names parted by spaces")
        kinds = {"array<int>": T.ArrayType(T.IntegerType()), "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}
        return AnalyzeResult(T.StructType([T.StructField(c, kinds[COLUMNS[c]]) for c in _checked(columns.value.split(), tags and tags.value.split())]))

    def eval(self, body: str, columns: str, tags: str | None = None) -> Iterator[tuple]:
        wanted = columns.split()
        rows: dict[str, list] = {c: [] for c in wanted}
        if tags is None:
            tree_columns(body, wanted, rows)
        else:
            tagged_columns(body, wanted, rows, frozenset(tags.split()))
        yield from zip(*rows.values())


def register(spark: SparkSession) -> None:
    """shred_tree for this session's SQL."""
    spark.udtf.register("shred_tree", F.udtf(TreeRows, useArrow=True))


def shred_variant(docs: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """key, path, tag, num and text by a recursive query over VARIANT; for trees of up to 100 levels and a million rows."""
    return docs.sparkSession.sql(
        f"""
        WITH RECURSIVE t(k, path, v) AS (
          SELECT k, array(0), v FROM {{trees}} WHERE schema_of_variant(v) LIKE 'OBJECT%'
          UNION ALL
          SELECT t.k, concat(t.path, array(c.pos)), c.value
          FROM t, LATERAL variant_explode(try_variant_get(t.v, '$.children', 'variant')) c)
        SELECT k AS `{key}`, path, try_variant_get(v, '$.tag', 'string') AS tag, try_variant_get(v, '$.attr.Num', 'string') AS num,
          CASE WHEN schema_of_variant(v) = 'STRING' THEN CAST(v AS STRING) END AS text
        FROM t
        """,
        trees=docs.select(F.col(key).alias("k"), F.try_parse_json(F.col(body)).alias("v")),
    )
