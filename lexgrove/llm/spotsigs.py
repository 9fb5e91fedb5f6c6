"""Document fingerprints by SpotSigs: chains of content words after common-word anchors."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lexgrove.llm.common import column, cut, documents, lean, seen, slices
from lexgrove.llm.jaccard import components, dealt

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = frozenset(
    """
    the a an is was are be to of and in that it for on with as at by this from
    der die das und ist ein eine den dem des von zu mit für auf im nicht
    le la les de du un une et est dans pour que qui sur par en au
    el los las del una y es con se lo por para
    """.split()
)
#: Among so many next words a content word looks for a common one, and a common word for a content word.
REACH = 8
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def _chains(words: np.ndarray, owner: np.ndarray, anchor: np.ndarray, content: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the chain of each anchor: itself and up to `length` content words after it in its text."""
    at, pool = np.flatnonzero(anchor), np.flatnonzero(content)
    h, first = words[at], np.searchsorted(pool, at, side="right")
    real = np.zeros(len(at), bool)
    for j in range(length):
        place = np.minimum(first + j, max(0, len(pool) - 1))
        inside = (first + j < len(pool)) if len(pool) else np.zeros(len(at), bool)
        if len(pool):
            inside &= owner[pool[place]] == owner[at]
            h = np.where(inside, _stir(h * _MIX[0] + words[pool[place]]), h)
        real |= inside
    return owner[at][real], h[real]


def _ahead(mask: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """Whether some of the next `reach` words of the same text is marked; `ends` is where each word's text ends."""
    seen, after = np.concatenate(([0], np.cumsum(mask))), np.arange(1, len(mask) + 1)
    return seen[np.minimum(after + reach, ends)] > seen[after]


def signatures(texts: list[str], chain: int = 3, reach: int = REACH) -> list[np.ndarray]:
    """The set of chain hashes (sorted, 32 bits) of each whole text.

    What starts a chain is settled by the next words alone, never by the whole text, so a passage gives the
    same chains in any text, but for those near its end. A common word is an anchor if a word that is not common
    is among the next `reach`, else it is content. A content word is an anchor too if there is no such common
    word among the next `reach`. A single word is its own chain. Without words the set is empty.
    """
    own = [t.lower().split() for t in texts]
    flat = pa.array([w for words in own for w in words], pa.string()).dictionary_encode()
    names = [w.strip(_EDGE) or w for w in flat.dictionary.to_pylist()]
    code = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
    common = np.array([w in ANCHORS for w in names], bool)
    sizes = np.array([len(w) for w in own], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    index = flat.indices.to_numpy()
    words, stop = (code[index], common[index]) if len(index) else (np.zeros(0, np.uint64), np.zeros(0, bool))
    ends = np.cumsum(sizes)[owner]
    spot = stop & _ahead(~stop, ends, reach)
    who, h = _chains(words, owner, spot | ~_ahead(spot, ends, reach), ~spot, chain)
    lone = sizes[owner] == 1
    who, h = np.concatenate([who, owner[lone]]), np.concatenate([h, words[lone]])
    key = np.unique((who.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    cuts = np.searchsorted(key, np.arange(1, len(texts), dtype=np.uint64) << np.uint64(32))
    return np.split((key & np.uint64(0xFFFFFFFF)).astype("<u4"), cuts)


def fingerprint(signature: np.ndarray) -> str:
    return base64.b64encode(signature.tobytes()).decode()


def length_class(n: int, threshold: float) -> int:
    """Sets whose Jaccard can reach the threshold are in one class or in classes next to each other."""
    return int(math.log(n) / -math.log(threshold) + 1e-9) if n and threshold < 1 else 0


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard of two sorted sets, or 0 where it is under the threshold; two empty sets: 1.

    Sets more than one length class apart are not compared, nor beyond the point where what is left can't
    reach the threshold: the smaller set is looked up in four parts.
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if not len(a) or len(a) < threshold * len(b):
        return 0.0
    shared, seen = 0, 0
    for part in np.array_split(a, 4) if threshold and len(a) > 64 else [a]:
        at = np.minimum(np.searchsorted(b, part), len(b) - 1)
        shared, seen = shared + int((b[at] == part).sum()), seen + len(part)
        most = shared + len(a) - seen
        if most < threshold * (len(a) + len(b) - most):
            return 0.0
    value = shared / (len(a) + len(b) - shared)
    return value if value >= threshold else 0.0


def in_order(docs: DataFrame, key: str, text: str, ranges: int, partitions: int) -> DataFrame:
    """Rows (key, a number; text, range, copy) sorted by key from large to small within ranges, several to a partition.

    The keys' quantiles, and the texts' hashes where one key holds more than a range's share, part the rows into
    ranges, which follow one another. The first row of a
    range stands once more, as a copy, at the end of the range before it, that of the first at
    the end of the last: so each row's next stands behind it. Only a row a range goes to the driver.
    """
    if not isinstance(docs.schema[key].dataType, NumericType):
        raise ValueError("key: a number")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spot = F.coalesce(F.col("key").cast("double"), F.lit(-1e308))
    inner = rows.select(spot.alias("d")).stat.approxQuantile("d", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    # a key that holds several quantiles is a range alone
    often = {d for d, n in Counter(inner).items() if n > 1}
    cuts = set(inner) | {math.nextafter(d, math.inf) for d in often}
    splits = [-math.inf, *sorted(cuts - {-1e308}), math.inf]
    if len(splits) < 3:
        splits = [-math.inf, 0.0, math.inf]
    bucket = Bucketizer(splits=splits, inputCol="_d", outputCol="_b")
    ranged = bucket.transform(rows.withColumn("_d", spot)).withColumn("range", (F.lit(len(splits) - 2) - F.col("_b")).cast("int"))
    # a range of one key alone (or null alone) that holds more than its share is parted by the tie
    held = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_lo"), F.max("key").alias("_hi"), F.count("key").alias("_keys")).collect()
    share = max(1, sum(r["_n"] for r in held) // ranges)
    parts = {r["range"]: -(-r["_n"] // share) if r["_lo"] == r["_hi"] and r["_keys"] in (0, r["_n"]) else 1 for r in held}
    places, at = [], 0
    for r in sorted(parts):
        places.append((r, parts[r], at))
        at += parts[r]
    table = docs.sparkSession.createDataFrame(places, "range int, _parts int, _first int")
    part = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("_parts"))
    placed = (
        ranged.withColumn("tie", F.xxhash64("text")).join(F.broadcast(table), "range")
        .select("key", "text", (F.col("_first") + F.least(part, F.col("_parts") - 1)).cast("int").alias("range"), "tie")
    )
    # nulls last, so least; of equal keys the smaller tie comes first
    first = placed.groupBy("range").agg(F.max(F.struct(F.col("key").isNotNull(), F.col("key"), (-F.col("tie")).alias("minus"))).alias("m"))
    heads = sorted((r["range"], r["m"]["key"], -r["m"]["minus"]) for r in first.select("range", "m").collect()) if rows.take(1) else []
    before = [(h[0], h[1], h[2], heads[i - 1][0]) for i, h in enumerate(heads)]
    kind = docs.schema[key].dataType.simpleString()
    table = docs.sparkSession.createDataFrame(before, f"range int, _key {kind}, tie long, _to int")
    joined = placed.join(F.broadcast(table), ["range", "tie"], "left")
    twice = F.col("_to").isNotNull() & F.col("key").eqNullSafe(F.col("_key"))
    here = F.struct("range", F.lit(False).alias("copy"))
    there = F.struct(F.col("_to").alias("range"), F.lit(True).alias("copy"))
    spread = joined.withColumn("place", F.explode(F.when(twice, F.array(here, there)).otherwise(F.array(here)))).select("key", "text", "place.range", "place.copy", "tie")
    return spread.repartition(partitions, "range").sortWithinPartitions("range", "copy", F.desc_nulls_last("key"), "tie").select("key", "text", "range", "copy")


def fingerprints(docs: DataFrame, chain: int = 3, threshold: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each whole text and of the same text edited with the next document's beginning.

    Rows of key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and signatures (set size). A fingerprint is the base64 of the sorted set of
    signatures, so equal texts have equal ones; likeness is pruned_jaccard of two sets at
    `threshold`. The next document is the one with the next smaller key (null keys last, the last's next is the
    first, equal keys stand by a hash of the text); one document alone is its own next. Null
    texts are empty; other columns are left out; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    partitions = max(8, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, marks = [], [], []
        for batch in slices(batches, "text", 2 << 20):
            keys += column(batch, "key").to_pylist()
            texts += column(batch, "text").to_pylist()
            marks += zip(column(batch, "range").to_pylist(), column(batch, "copy").to_pylist())
            pairs = [i for i in range(len(texts) - 1) if not marks[i][1]]
            edited = []
            for i in pairs:
                n = len(texts[i])
                edited.append(texts[i][: n - n // 3] + texts[i + 1][: n // 3])
            sets = signatures(texts + edited, chain)
            prints = list(map(fingerprint, sets))
            m = len(texts)
            cols = [
                pa.array([keys[i] for i in pairs]).cast(column(batch, "key").type),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([prints[i] for i in pairs], pa.string()),
                pa.array(prints[m:], pa.string()),
                pa.array([pruned_jaccard(sets[i], sets[m + j], threshold) for j, i in enumerate(pairs)], pa.float64()),
                pa.array([pruned_jaccard(sets[i], sets[i + 1], threshold) for i in pairs], pa.float64()),
                pa.array([len(sets[i]) for i in pairs], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "signatures"])
            keys, texts, marks = keys[-1:], texts[-1:], marks[-1:]

    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, signatures long"
    return in_order(body, key, text, 8 * partitions, partitions).mapInArrow(run, schema).withColumnRenamed("key", key)


def text_prints(docs: DataFrame, chain: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of each whole text (null: empty), as in fingerprints, without its edited text and next document: no text is moved."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = signatures([t or "" for t in column(batch, "text").to_pylist()], chain)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(map(fingerprint, sets), pa.string())], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def most_shared(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A bound of what a set shares with others, from how many of their signatures fall in each of some bins."""
    return np.minimum(own, others).sum(axis=1, dtype=np.int64)


def likely_pairs(members: DataFrame, groups: DataFrame, threshold: float, few: int) -> DataFrame:
    """Pairs a, b to be compared, each once however many groups it is in: all pairs of the groups (gid, k) of up to `few` members, and each member of a larger group with three of its members.

    Members are gid, tid, n and main; main ones don't meet one another, nor do sets whose sizes are too far apart.
    """
    known = members.join(groups.select("gid", "k"), "gid")
    ours = known.where(F.col("k") <= few).drop("k")
    theirs = ours.select("gid", F.col("tid").alias("b"), F.col("n").alias("m"), F.col("main").alias("too"))
    together = ours.join(theirs, "gid").where("tid < b and not (main and too)")
    # the same ones in every group that holds them, so that few pairs tie many near copies together
    lead = [F.min(F.struct(F.xxhash64(F.lit(i), "tid").alias("o"), F.col("tid").alias("b"), F.col("n").alias("m"))).alias(f"l{i}") for i in range(3)]
    leaders = known.where(F.col("k") > few).groupBy("gid").agg(*lead).select("gid", F.explode(F.array("l0", "l1", "l2")).alias("l")).select("gid", "l.b", "l.m").distinct()
    star = members.join(leaders, "gid").where("tid <> b")
    near = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
    pairs = [x.where(near).select(F.least("tid", "b").alias("a"), F.greatest("tid", "b").alias("b")) for x in (together, star)]
    return pairs[0].unionByName(pairs[1]).distinct()


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose sets (tid, text) have a pruned_jaccard of the threshold."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", 1 << 20):
            both = zip(*[[np.frombuffer(base64.b64decode(t), "<u4") for t in column(batch, c).to_pylist()] for c in ("text_a", "text_b")])
            take = pa.array([i for i, (x, y) in enumerate(both) if pruned_jaccard(x, y, threshold)], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, c).take(take) for c in ("a", "b")], ["a", "b"])

    left, right = (sets.select(F.col("tid").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def links_apart(members: DataFrame, groups: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float, few: int, block_rows: int, block_signatures: int) -> DataFrame:
    """Links a, b of labels (node, label): sets of groups of more than `few` members that are alike and have not one label yet.

    Groups of one label have none. In the others the largest label's members meet those of other labels, and these one another, in blocks of texts;
    most_shared settles nearly all pairs that are not alike.
    """
    large = members.join(groups.where(F.col("k") > few).select("gid"), "gid", "left_semi").join(labels.withColumnRenamed("node", "tid"), "tid", "left")
    large = cut(large.withColumns({"label": F.coalesce("label", "tid"), "below": F.col("main")}).drop("main"))
    sizes = large.groupBy("gid", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("gid").agg(F.max(F.struct("size", "label"))["label"].alias("most"), F.count(F.lit(1)).alias("of")).where("of > 1").drop("of")
    apart = large.join(mixed, "gid").select("gid", "tid", F.col("n").alias("n_shingles"), "n", "label", "below", (F.col("label") == F.col("most")).alias("main"))
    apart = cut(apart)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(base64.b64decode(t), "<u4") for t in pdf["text"]]
        size, label, below = pdf["n"].to_numpy(), pdf["label"].to_numpy(), pdf["below"].to_numpy()
        bins = np.stack([np.bincount(x & 255, minlength=256) for x in own]).astype(np.int32)
        lo, hi = (np.flatnonzero(pdf["block"] == pdf[c]) for c in ("lo", "hi"))
        found = set()
        for i in lo:
            others = hi[(label[hi] != label[i]) & ~(below[hi] & below[i]) & (np.minimum(size[hi], size[i]) >= threshold * np.maximum(size[hi], size[i]) - 1e-9)]
            most = most_shared(bins[i], bins[others])
            for j in others[most >= threshold * (size[others] + size[i] - most) - 1e-9]:
                link = (min(label[i], label[j]), max(label[i], label[j]))
                if link not in found and pruned_jaccard(own[i], own[j], threshold):
                    found.add(link)
        return pd.DataFrame(list(found), columns=["a", "b"])

    return dealt(apart, sets.select("tid", "text"), block_rows, block_signatures).groupBy("gid", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def alike(prints: DataFrame, threshold: float = 0.8, key: str = "doc_id", block_rows: int = 256, block_signatures: int = 500_000, few: int = 32) -> DataFrame:
    """key and class_id of each row of (key, fingerprint): classes of what likenesses of `threshold` or more connect.

    Equal fingerprints are one set. Sets are partitioned by length class and meet, within their
    class and with the one below, under the signatures of their prefixes alone: their rarest ones, as many as
    a set of that likeness can't miss all of. What meets is compared by pruned_jaccard: pairs of up to `few` sets once each, those of signatures
    that more sets have with three of them, and what that leaves in several classes in blocks, so that
    no signature, however many sets have it, is held by one task or gives all its pairs.
    class_id is the least key of the class, or for null keys alone a hash of a fingerprint. A fingerprint without signatures (or null) equals
    only others such. Repeated rows stay; other columns are left out; an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold: over 0, at most 1")
    rows = prints.select(F.col(key).alias("key"), F.coalesce("fingerprint", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    sets = cut(rows.groupBy("tid").agg(F.min("key").alias("least"), F.min("text").alias("text")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            own = [np.frombuffer(base64.b64decode(t), "<i4") for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "tid"), pa.array([len(x) for x in own], pa.int32()), pa.array(own, pa.list_(pa.int32()))], ["tid", "n", "signatures"])

    each = cut(sets.mapInArrow(spread, "tid long, n int, signatures array<int>").where("n > 0").select("tid", "n", F.explode("signatures").alias("h")))
    # a signature of one set alone meets nothing: those come first in the set's order, and only how many they are counts
    shared = each.groupBy("h").agg(F.count(F.lit(1)).alias("found_in")).where("found_in > 1")
    held = each.join(shared, "h").groupBy("tid", "n").agg(F.array_sort(F.collect_list(F.struct("found_in", "h"))).alias("rarest"))
    taken = (F.size("rarest") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    level = F.floor(F.log("n") / -math.log(threshold) + 1e-9) if threshold < 1 else F.lit(0).cast("long")
    met = held.where(taken > 0).select("tid", "n", level.alias("level"), F.explode(F.slice("rarest", F.lit(1), taken)).alias("x")).select("tid", "n", "level", "x.h")
    # a group is a length class and a signature; its main members are those of the class below, which meet the class alone
    below = F.explode(F.array(F.lit(0), F.lit(1))).alias("up")
    members = cut(met.select("tid", "n", "level", "h", below).select("tid", "n", F.xxhash64(F.col("level") + F.col("up"), "h").alias("gid"), (F.col("up") == 1).alias("main")))
    # of groups with the same members one counts
    same = [F.sum(F.xxhash64(F.lit(1), "tid", "main").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(2), "tid", "main")).alias("x")]
    several = members.groupBy("gid").agg(F.count(F.lit(1)).alias("k"), F.bool_and("main").alias("bare"), *same).where("k > 1 and not bare")
    groups = cut(several.groupBy("k", "s", "x").agg(F.min("gid").alias("gid")).select("gid", "k"))
    pairs = cut(likely_pairs(members, groups, threshold, few))
    labels = components(cut(compared(pairs, sets, threshold)))
    far = cut(links_apart(members, groups, labels, sets, threshold, few, block_rows, block_signatures))
    if seen(far)["rows"]:
        joined = components(far).select(F.col("node").alias("label"), F.col("label").alias("root"))
        lone = joined.join(labels, "label", "left_anti").select(F.col("label").alias("node"), F.col("root").alias("label"))
        labels = cut(labels.join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("label")).unionByName(lone))
    classed = sets.select("tid", "least").join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    best = classed.groupBy("label").agg(F.min("least").alias("class_id"))
    ids = classed.join(best, "label").select("tid", F.coalesce("class_id", "label").alias("class_id"))
    return rows.select("key", "tid").join(ids, "tid").select(F.col("key").alias(key), "class_id")


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document: `alike` at 0.8 over the fingerprints of op6_spotsigs."""
    return alike(cut(text_prints(documents(spark, sf_dir))))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
