"""N-gram Jaccard join: a MinHash LSH forest, then exact verification and classes of linked texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import bounded, column, cut, documents, lean, nested, nested_columns, row_hash, seen, slices, small

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_hashes(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """64-bit hashes of all runs of `words` lower-case words, the text each is of, and a hash of each text's words.

    Words are what white space parts. A text of fewer words is one run of them all; without words there is no run.
    """
    own = [t.lower().split() for t in texts]
    flat = pa.array([w for x in own for w in x], pa.string()).dictionary_encode()
    code = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    seq = code[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    sizes = np.array([len(x) for x in own], np.int64)
    starts = np.cumsum(sizes) - sizes
    runs = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + starts[owner]
    h = np.full(len(at), np.uint64(1))
    for j in range(words):
        inside = (at + j) < (starts + sizes)[owner]
        step = seq[np.minimum(at + j, max(0, len(seq) - 1))] if len(seq) else h
        mixed = (h ^ step) * _ODD[j % len(_ODD)]
        h = np.where(inside, mixed ^ (mixed >> np.uint64(29)), h)
    h = h * _ODD[1]
    keys = [xxhash.xxh3_128_digest(seq[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
    return h ^ (h >> np.uint64(32)), owner, keys


def forest_depth(threshold: float, trees: int, recall: float, deepest: int) -> int:
    """The longest prefix at which texts of that Jaccard still meet in some tree with probability `recall`."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def ask_depths(threshold: float, trees: int, recall: float, deepest: int, free: int) -> list[int]:
    """For c = 0 to `trees`: the prefix length at which a text with company in c trees asks.

    In a tree where nobody shares its first `free` labels a text's prefix is shortened to those at no cost, and a
    similar text would have been there with probability threshold**free. In the c trees with company it starts at
    the deepest label and shortens, a label at a time, until by all trees together a text of that
    Jaccard has been met with probability `recall`.
    """
    depths = []
    for c in range(trees + 1):
        missed = (1 - threshold**free) ** (trees - c)
        depths.append(next((d for d in range(deepest, free, -1) if missed * (1 - threshold**d) ** c <= 1 - recall), free))
    return depths


def least_agreement(threshold: float, bits: int, lost: float = 1e-4) -> int:
    """Of `bits` one-bit minhashes, how many two texts of that Jaccard have in common at least, but for a share `lost` of such pairs."""
    p, below, n = (1 + threshold) / 2, 0.0, 0
    while (below := below + math.comb(bits, n) * p**n * (1 - p) ** (bits - n)) <= lost:
        n += 1
    return n


def signed(docs: DataFrame, words: int, trees: int, depth: int, seed: int) -> DataFrame:
    """tid, id, key (a hash of the text's words), n_shingles, labels (a byte for each of trees * depth hash functions) and s0 to s2.

    s0 to s2 hold one more bit of each of the first 192 functions' least values: two texts agree in a bit with
    probability (1 + Jaccard) / 2, which tells most pairs that are far from alike without their texts.
    """
    rng = np.random.default_rng(seed)
    factor = (rng.integers(0, 1 << 32, trees * depth, np.uint64) | np.uint64(1)).astype(np.uint32)
    shift = rng.integers(0, 1 << 32, trees * depth, np.uint64).astype(np.uint32)
    names = ["tid", "id", "key", "n_shingles", "labels", "s0", "s1", "s2"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            n = batch.num_rows
            h, owner, keys = shingle_hashes([t or "" for t in column(batch, "text").to_pylist()], words)
            count = np.bincount(owner, minlength=n)
            have = np.flatnonzero(count)
            labels, bits = np.zeros((n, trees * depth), np.uint8), np.zeros((n, 192), np.uint8)
            if len(have):
                first, low = (np.cumsum(count) - count)[have], (h >> np.uint64(16)).astype(np.uint32)
                for j in range(trees * depth):
                    least = np.minimum.reduceat((low ^ shift[j]) * factor[j], first) * np.uint32(0x9E3779B1)
                    labels[have, j] = (least >> np.uint32(24)).astype(np.uint8)
                    if j < 192:
                        bits[have, j] = (least >> np.uint32(23)).astype(np.uint8) & 1
            packed = pa.array([x.tobytes() for x in labels], pa.binary())
            sketch = np.packbits(bits, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays([column(batch, "tid"), column(batch, "id"), pa.array(keys, pa.binary()), pa.array(count, pa.int64()), packed, *[pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(3)]], names)

    kind = docs.schema["id"].dataType.simpleString()
    return bounded(docs).select("tid", "id", "text").mapInArrow(run, f"tid long, id {kind}, key binary, n_shingles long, labels binary, s0 long, s1 long, s2 long")


def _node(tree: Column, label: Column, depth: Column) -> Column:
    return F.xxhash64(tree, depth, F.substring(label, F.lit(1), depth))


def forest(texts: DataFrame, trees: int, depth: int, least: int, free: int, depths: list[int]) -> DataFrame:
    """node, n, tid, company and s0 to s2: the prefixes (nodes) of `least` to `depth` labels of texts (tid, labels, s0 to s2) with company.

    A text without company under its first `free` labels in any tree has no row. A text asks at the
    length which `depths` has for the number of its trees with company: there it wants to meet all under its prefix.
    Only prefixes under which some text asks, of n >= 2 texts, are returned; company is the sum of n over a text's prefixes. Counts meet by aggregation, so no prefix, however many texts share it, is in one task.
    """
    label = F.array(*[F.struct(F.lit(t).alias("tree"), F.expr(f"substring(labels, {t * depth + 1}, {depth})").alias("label")) for t in range(trees)])
    rows = texts.select("tid", "s0", "s1", "s2", F.explode(label).alias("x")).select("tid", "s0", "s1", "s2", "x", _node(F.col("x.tree"), F.col("x.label"), F.lit(free)).alias("node"))
    n = trees * seen(texts)["rows"]
    company = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), n)
    met = rows.join(small(company), "node", "left_semi").groupBy("tid", "s0", "s1", "s2").agg(F.collect_list("x").alias("xs"))
    asked = F.element_at(F.array(*[F.lit(d) for d in depths]), F.size("xs") + 1)
    deep = F.explode(F.array(*[F.lit(d) for d in range(least, depth + 1)])).alias("d")
    spread = met.select("tid", "s0", "s1", "s2", asked.alias("asked"), F.explode("xs").alias("x")).select("*", deep)
    placed = cut(spread.select(_node(F.col("x.tree"), F.col("x.label"), F.col("d")).alias("node"), "tid", (F.col("d") == F.col("asked")).alias("ask"), "s0", "s1", "s2"), n)
    live = cut(placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bool_or("ask").alias("asked")).where("n > 1 and asked").select("node", "n"), seen(placed)["rows"])
    alive = cut(placed.drop("ask").join(small(live, 16), "node"), seen(placed)["rows"])
    company = cut(alive.groupBy("tid").agg(F.sum("n").alias("company")), seen(alive)["rows"])
    return cut(alive.join(small(company, 16), "tid"), seen(alive)["rows"])


def _agreement(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two sketches agree, of 192."""
    return F.lit(192) - sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def near_pairs(placed: DataFrame, agree: int, leaders: int, few: int) -> DataFrame:
    """Candidate pairs a, b: texts under one prefix whose sketches agree in at least `agree` bits.

    Under a prefix of at most `few` texts they are all its pairs. Else each text is paired with its
    prefixes' leaders, each the text with the most company, of which it takes the nearest `leaders`: near
    copies share their leaders, so that few links tie many of them together. What that leaves apart is left to far_links.
    """
    sketch = ["s0", "s1", "s2"]
    rank = F.struct((-F.col("company")).alias("minus"), "tid", *sketch)
    lead = placed.groupBy("node").agg(F.min(rank).alias("m"), F.first("n").alias("n")).where(F.col("n") > few).select("node", F.col("m.tid").alias("b"), *[F.col(f"m.{c}").alias(f"_{c}") for c in sketch])
    met = placed.join(small(cut(lead, seen(placed)["rows"]), 40), "node").where("tid <> b").withColumn("near", _agreement([F.col(c) for c in sketch], [F.col(f"_{c}") for c in sketch])).where(F.col("near") >= agree)
    best = met.groupBy(F.col("tid").alias("a")).agg(F.collect_set(F.struct((-F.col("near")).alias("far"), "b")).alias("x"))
    star = best.select("a", F.explode(F.slice(F.array_sort("x"), 1, leaders)).alias("x")).select("a", "x.b")
    together = placed.where(F.col("n") <= few).groupBy("node").agg(F.collect_list(F.struct("tid", *sketch)).alias("xs"))

    def partners(x: Column) -> Column:
        near = F.filter("xs", lambda y: (y["tid"] < x["tid"]) & (_agreement([x[c] for c in sketch], [y[c] for c in sketch]) >= agree))
        return F.transform(near, lambda y: F.struct(x["tid"].alias("a"), y["tid"].alias("b")))

    return star.unionByName(together.select(F.explode(F.flatten(F.transform("xs", partners))).alias("x")).select("x.a", "x.b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard of `threshold` or more, from the whole texts (tid, text)."""
    involved = cut(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), seen(pairs)["rows"])
    own = texts.join(small(involved), "tid", "left_semi").dropDuplicates(["tid"])
    left = own.join(pairs.groupBy(F.col("a").alias("tid")).agg(F.collect_list("b").alias("bs")), "tid")
    left = left.select(F.col("tid").alias("a"), F.col("text").alias("text_a"), F.explode("bs").alias("tid"))
    both = left.join(own, "tid").select("a", F.col("tid").alias("b"), "text_a", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            mine = column(batch, "text_a").dictionary_encode()
            base, n = mine.dictionary.to_pylist(), batch.num_rows
            h, owner, _ = shingle_hashes(base + column(batch, "text").to_pylist(), words)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[fresh], owner[fresh]
            sets = np.split(h, np.searchsorted(owner, np.arange(1, len(base) + n)))
            good = []
            for i, k in enumerate(mine.indices.to_pylist()):
                x, y = sets[k], sets[len(base) + i]
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                if not len(x) or len(x) < threshold * len(y):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if both >= threshold * (len(x) + len(y) - both):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "a").take(take), column(batch, "b").take(take)], ["a", "b"])

    return bounded(both).mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label of each end of the links (a, b): the least node that it is linked with over any number of links.

    Labels fall to the least of the neighbours' labels and then to their label's label, until none changes.
    """
    both = F.explode(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x in (F.col("a"), F.col("b")) for y in (F.col("a"), F.col("b"))])).alias("x")
    ends = cut(links.select(both).select("x.a", "x.b").distinct(), seen(links)["rows"])
    n = seen(ends)["rows"]
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    labels = cut(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), n, total=total)
    while True:
        known = small(labels, 16).select(F.col("node").alias("b"), "label")
        near = cut(ends.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label")), n)
        over = small(near, 16).select(F.col("node").alias("label"), F.col("label").alias("next"))
        before, labels = seen(labels)["total"], cut(near.join(over, "label").select("node", F.col("next").alias("label")), n, total=total)
        if seen(labels)["total"] == before:  # labels only fall
            return labels


def dealt(members: DataFrame, texts: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """Members (gid, tid, n_shingles, main and others) with their texts, so that each pair of a group meets in one (gid, lo, hi).

    A group's members go to blocks of about `block_rows` texts and `block_shingles` shingles,
    and a block meets each block of its group; no task holds more than two blocks. Blocks of main
    members meet those of the others alone; a group has others.
    """

    def blocks(own: Column) -> Column:
        shingles = F.coalesce(F.sum(F.when(own, F.col("n_shingles"))), F.lit(0))
        return F.greatest(F.ceil(F.count(F.when(own, 1)) / block_rows), F.ceil(shingles / block_shingles)).cast("int")

    many = members.groupBy("gid").agg(blocks(F.col("main")).alias("mains"), blocks(~F.col("main")).alias("others"))
    hashed = F.xxhash64(F.lit(5), "tid")
    block = F.when(F.col("main"), F.pmod(hashed, F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(hashed, F.greatest("others", F.lit(1)))).cast("int")
    meets = F.explode(F.expr("sequence(if(main, mains, 0), mains + others - 1)"))
    placed = members.join(small(cut(many, seen(members)["rows"]), 16), "gid").withColumn("block", block).withColumn("other", meets)
    placed = placed.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "mains", "others", "main", "n_shingles")
    own = texts.join(small(cut(members.select("tid").distinct(), seen(members)["rows"])), "tid", "left_semi").dropDuplicates(["tid"])
    return placed.join(own, "tid")


def linked(texts: list[str], left: np.ndarray, right: np.ndarray, words: int, threshold: float, width: int = 4096) -> np.ndarray:
    """Which of the texts `left` (rows) and `right` (columns) have shingle sets of that Jaccard; not a text with itself."""
    h, owner, _ = shingle_hashes(texts, words)
    code = np.unique(h, return_inverse=True)[1]
    key = np.unique(code.astype(np.int64) * len(texts) + owner)
    code, owner = key // len(texts), key % len(texts)
    size = np.bincount(owner, minlength=len(texts)).astype(float)
    shared = np.bincount(code)[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(left), len(right)))
    for a in range(0, int(code.max(initial=-1)) + 1, width):
        part = slice(*np.searchsorted(code, [a, a + width]))
        has = np.zeros((len(texts), width), np.float32)
        has[owner[part], code[part] - a] = 1
        both += has[left] @ has[right].T
    return (both >= threshold * (size[left][:, None] + size[right][None] - both)) & (left[:, None] != right[None]) & (both > 0)


def suspects(members: DataFrame, agree: int, block_rows: int) -> DataFrame:
    """gid, tid and label of members (gid, tid, label, s0 to s2) with another of the group that has another label and a sketch that agrees.

    Blocks of about `block_rows` sketches meet each block of their group; a sketch is 24 bytes.
    """
    many = members.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(6), "tid"), F.col("blocks")).cast("int")
    placed = members.join(small(cut(many, seen(members)["rows"]), 12), "gid").withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (np.flatnonzero(pdf["block"] == pdf[c]) for c in ("lo", "hi"))
        label, bits = pdf["label"].to_numpy(), pdf[["s0", "s1", "s2"]].to_numpy(np.int64).view(np.uint64)
        hit = np.zeros(len(pdf), bool)
        for a in range(0, len(lo), 128):
            part = lo[a : a + 128]
            apart = sum(np.bitwise_count(bits[part, j][:, None] ^ bits[hi, j][None]) for j in range(3))
            near = (apart <= 192 - agree) & (label[part][:, None] != label[hi][None])
            hit[part] |= near.any(axis=1)
            hit[hi] |= near.any(axis=0)
        return pdf.loc[hit, ["gid", "tid", "label"]]

    return placed.groupBy("gid", "lo", "hi").applyInPandas(run, "gid long, tid long, label long").distinct()


def far_links(placed: DataFrame, labels: DataFrame, light: DataFrame, texts: DataFrame, agree: int, few: int, words: int, threshold: float, block_rows: int, block_shingles: int) -> DataFrame:
    """Links (a, b) of classes (labels: node, label) between texts under one prefix (placed: node, n, tid, s0 to s2; n over `few`) that leaders left apart.

    Prefixes whose texts are of several classes are looked at; their texts that may be alike by their sketches
    are verified in blocks, all pairs of different classes. A group is the largest class of a prefix with all texts that share such a prefix; its own texts don't meet one another.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    n = seen(labels)["rows"]
    known = cut(labels.join(small(cut(sizes, n), 16), "label").withColumnRenamed("node", "tid"), n)
    under = placed.where(F.col("n") > few).drop("company").join(small(known, 24), "tid", "left")
    under = under.withColumns({"label": F.coalesce("label", "tid"), "size": F.coalesce("size", F.lit(1))})
    mixed = under.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("size", "label"))["label"].alias("gid")).where("low < high").select("node", "gid")
    # prefixes with the same largest class are one group, so that what several trees bring together is compared once
    members = under.join(small(cut(mixed, seen(placed)["rows"]), 16), "node").select("gid", "tid", "label", "s0", "s1", "s2").distinct()
    members = suspects(cut(members, seen(placed)["rows"]), agree, 2 * block_rows).join(light.select("tid", "n_shingles"), "tid")
    members = cut(members.withColumn("main", F.col("label") == F.col("gid")), seen(placed)["rows"])
    # a group whose suspects are all of its largest class has nothing to compare
    n = seen(members)["rows"]
    compared = cut(members.groupBy("gid").agg(F.bool_and("main").alias("all")).where("not all").select("gid"), n)
    members = cut(members.join(small(compared), "gid", "left_semi"), n)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (np.flatnonzero(pdf["block"] == pdf[c]) for c in ("lo", "hi"))
        label = pdf["label"].to_numpy()
        hit = linked(pdf["text"].tolist(), lo, hi, words, threshold) & (label[lo][:, None] != label[hi][None])
        x, y = np.nonzero(hit)
        return pd.DataFrame({"a": label[lo][x], "b": label[hi][y]}).drop_duplicates()

    return dealt(members, texts, block_rows, block_shingles).groupBy("gid", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def class_links(members: DataFrame, texts: DataFrame, words: int, threshold: float, block_rows: int, block_shingles: int) -> DataFrame:
    """tid and linked of members (gid, tid, copies, n_shingles): the copies of all texts of its class linked with it, counted in blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (np.flatnonzero(pdf["block"] == pdf[c]) for c in ("lo", "hi"))
        tid, copies = pdf["tid"].to_numpy(), pdf["copies"].to_numpy()
        hit = linked(pdf["text"].tolist(), lo, hi, words, threshold).astype(float)
        found = pd.DataFrame({"tid": tid[lo], "n": (hit @ copies[hi]).astype(np.int64)})
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            found = pd.concat([found, pd.DataFrame({"tid": tid[hi], "n": (copies[lo] @ hit).astype(np.int64)})])
        return found

    counted = dealt(members, texts, block_rows, block_shingles).groupBy("gid", "lo", "hi").applyInPandas(run, "tid long, n long")
    return counted.groupBy("tid").agg(F.sum("n").alias("linked"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 9, recall: float = 0.99, leaders: int = 3, few: int = 8, seed: int = 1, key: str = "doc_id", text: str = "text", count_links: bool = True, block_rows: int = 256, block_shingles: int = 500_000) -> DataFrame:
    """A row per document: tid, key, class_id, text_id, n_links, keep and alone.

    Documents of the same words (case and white space aside) are copies; of each such text
    one goes through the forest. Candidates are verified exactly: Jaccard of the sets of
    `words`-word shingles at `threshold` or more. A class holds what copies and links connect;
    class_id is its least key, text_id the least key of the document's copies. n_links is the number of other documents that are
    copies or whose text, of those of the class, has that Jaccard with this document's text, in classes of any size;
    without count_links it is 0. keep marks one document of each class. A text without words
    (or null) is a class of its own (alone), as is each such row; rows alike in key and text are copies. A class without a key has the hash tid as its id.
    """
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("tid"), F.col(key).alias("id"), F.col(text).alias("text"))
    signs = cut(signed(rows, words, trees, depth, seed))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("tid"))).alias("m")
    firsts = [F.first(c).alias(c) for c in ("labels", "n_shingles", "s0", "s1", "s2")]
    texts = signs.where("n_shingles > 0").groupBy("key").agg(least, F.count(F.lit(1)).alias("copies"), *firsts)
    texts = cut(texts.select("key", F.col("m.id").alias("text_id"), F.col("m.tid").alias("tid"), "copies", "labels", "n_shingles", "s0", "s1", "s2"), seen(signs)["rows"])
    n = seen(texts)["rows"]
    shortest, agree, bodies = forest_depth(threshold, trees, recall, depth), least_agreement(threshold, min(192, trees * depth)) + max(0, 192 - trees * depth), rows.select("tid", "text")
    free = max(1, shortest - 2)
    placed = forest(texts, trees, depth, shortest, free, ask_depths(threshold, trees, recall, depth, free))
    light = texts.select("key", "tid", "text_id", "copies", "n_shingles")
    labels = components(cut(verified(cut(near_pairs(placed, agree, leaders, few), seen(placed)["rows"]), bodies, words, threshold), n))
    far = cut(far_links(placed, labels, light, bodies, agree, few, words, threshold, block_rows, block_shingles), n)
    if seen(far)["rows"]:
        joined = cut(components(far).select(F.col("node").alias("label"), F.col("label").alias("root")), n)
        lone = joined.join(labels, "label", "left_anti").select(F.col("label").alias("node"), F.col("root").alias("label"))
        labels = cut(labels.join(small(joined, 16), "label", "left").select("node", F.coalesce("root", "label").alias("label")).unionByName(lone), n)
    classed = cut(light.join(small(labels, 16).withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid")), n)
    best = classed.groupBy("label").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), F.col("text_id"), F.col("tid"))).alias("best"), F.count(F.lit(1)).alias("n_texts"))
    best = cut(best.where("n_texts > 1").select("label", "best"), n)
    if count_links:
        members = cut(classed.withColumnRenamed("label", "gid").join(small(best, 64).select(F.col("label").alias("gid")), "gid", "left_semi").select("gid", "tid", "copies", "n_shingles", F.lit(False).alias("main")), n)
        weight = class_links(members, bodies, words, threshold, block_rows, block_shingles)
        classed = classed.join(weight, "tid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("linked", F.lit(0)))
    else:
        classed = classed.withColumn("n_links", F.lit(0))
    known = classed.join(small(best, 64), "label", "left").select("key", "text_id", F.coalesce(F.col("best.text_id"), F.col("best.tid"), F.col("text_id"), F.col("tid")).alias("class_id"), F.coalesce(F.col("best.tid"), F.col("tid")).alias("kept"), "n_links")
    found = signs.select("tid", "id", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key")).join(known, "key", "left")
    alone = F.col("kept").isNull()
    return found.select(
        "tid",
        F.col("id").alias(key),
        F.coalesce("class_id", "id", "tid").alias("class_id"),
        F.coalesce("text_id", "id").alias("text_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("tid") == F.col("kept"))).alias("keep"),
        alone.alias("alone"),
    )


def op1_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_links", "text_id")


def near_duplicate_stage(docs: DataFrame) -> DataFrame:
    """One document of each class stays; every row without words stays.

    Of rows alike in doc_id and text the one with the least hash of all its columns stays. All
    columns come back as they were; only doc_id and text are needed.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), count_links=False).where("keep").groupBy("tid").agg(F.max("alone").alias("alone"))
    rows = nested(docs).withColumn("tid", F.xxhash64("row.doc_id", "row.text")).join(kept, "tid")
    # rows without words are groups of their own, the others are reduced before they are dealt by tid
    rows = rows.withColumn("apart", F.when(F.col("alone"), F.monotonically_increasing_id()))
    return rows.groupBy("tid", "apart").agg(F.min_by("row", row_hash(docs)).alias("row")).select(*nested_columns(docs))
