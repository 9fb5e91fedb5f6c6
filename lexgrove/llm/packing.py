"""Packing token pieces into sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import bounded, column, cut, documents, lean, seen, slices, small, with_slots
from lexgrove.llm.tokens import _tokenizer, word_ids


def fill_bins(items: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in its bin of each item (a row of sizes) under all limits at once.

    Bins are filled one at a time. The next item is, of those that fit, the one whose sizes
    have the largest dot product with what is left of the limits, both as shares of the limits and
    each dimension weighed by its mean size; of equals the first. An item at some limit
    alone still gets a bin; one over a limit is refused.
    """
    n = len(items)
    bins, place = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, place
    if (items > limits).any():
        raise ValueError("an item is over a limit")
    share = items / limits
    weight = share.mean(axis=0)
    scaled = share * weight
    ids = np.argsort(-scaled.sum(axis=1), kind="stable")
    scaled, sizes = scaled[ids], items[ids].astype(np.int64)
    sums, alive, dead, bin_id, block = scaled.sum(axis=1), np.ones(n, bool), 0, 0, 64
    after = np.maximum.accumulate(scaled[::-1])[::-1]
    while dead < len(ids):
        if dead > max(64, len(ids) // 16):
            ids, scaled, sizes, sums = ids[alive], scaled[alive], sizes[alive], sums[alive]
            alive, dead, after = np.ones(len(ids), bool), 0, np.maximum.accumulate(scaled[::-1])[::-1]
        left, count = limits.astype(np.int64).copy(), 0
        while True:
            ratio = left / limits
            best, value = -1, -1.0
            # the largest that can fit comes first; after[i] bounds the sizes from i on
            at = int(np.searchsorted(-sums, -(weight @ ratio) * (1 + 1e-9), side="left"))
            while at < len(ids) and after[at] @ ratio > value:
                part = slice(at, at + block)
                ok = np.flatnonzero(alive[part] & (sizes[part] <= left).all(axis=1))
                if len(ok):
                    worth = scaled[part][ok] @ ratio
                    if worth.max() > value:
                        best, value = at + int(ok[int(worth.argmax())]), float(worth.max())
                at += block
            if best < 0:
                break
            alive[best], dead = False, dead + 1
            bins[ids[best]], place[ids[best]] = bin_id, count
            left -= sizes[best]
            count += 1
        bin_id += 1
    return bins, place


def dealt_pieces(pieces: DataFrame, order: list[str], groups: int, many: int, rows: int) -> DataFrame:
    """`pieces` with _group: a hash of `order`, and for pieces of which more than `many` are alike in it, in turn from there on.

    Only those are numbered, by the partitions in which they stand; as they are interchangeable,
    a group gets the same pieces whatever the partitions are.
    """
    home = F.xxhash64(*order)
    often = cut(pieces.groupBy(home.alias("_home")).agg(F.count(F.lit(1)).alias("_alike")).where(F.col("_alike") > many).select("_home"), rows)
    keyed = pieces.withColumn("_home", home)
    if not seen(often)["rows"]:
        return keyed.withColumn("_group", F.pmod("_home", F.lit(groups)).cast("int")).drop("_home")
    hot = small(often)
    placed = cut(keyed.join(hot, "_home", "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    buckets = 1 + seen(placed)["rows"] // (4 * many)
    turned = with_slots(placed, ["_home"], [F.col("_row")], F.col("_row"), buckets, "_turn").drop("_row")
    spread = turned.withColumn("_group", F.pmod(F.pmod("_home", F.lit(groups)) + F.col("_turn"), F.lit(groups)).cast("int")).drop("_turn")
    rest = keyed.join(hot, "_home", "left_anti").withColumn("_group", F.pmod("_home", F.lit(groups)).cast("int"))
    return rest.unionByName(spread).drop("_home")


def pack(pieces: DataFrame, tokens: str, loss: str, order: list[str], max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, group_rows: int = 2048) -> DataFrame:
    """Columns of `pieces` (from cut()) with sequence_id and offset; sequences stay under three limits.

    tokens and loss are the columns of a piece's tokens and loss-bearing tokens; a sequence
    holds at most max_tokens, max_segments pieces and max_loss. Pieces are dealt to groups
    of about `group_rows` by a hash of `order`, pieces repeated often in turn, each packed by fill_bins in the order of size, then
    `order`; a group leaves about one sequence unfilled. Pieces alike in `order` are
    interchangeable. An empty table gives no rows.
    """
    limits = np.array([max_tokens, max_segments, max_loss or max_tokens])
    rows = seen(pieces)["rows"]
    groups = max(1, round(rows / group_rows))
    dealt = dealt_pieces(pieces, order, groups, max(1, group_rows // 8), rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([tokens, *order], ascending=[False, *[True] * len(order)], kind="stable").reset_index(drop=True)
        size = np.stack([pdf[tokens], np.ones(len(pdf), np.int64), pdf[loss]], axis=1)
        bins, place = fill_bins(size, limits)
        pdf = pdf.assign(sequence_id=(np.int64(pdf["_group"].iloc[0]) << 32) + bins, _place=place).sort_values(["sequence_id", "_place"], kind="stable")
        pdf["offset"] = pdf.groupby("sequence_id")[tokens].cumsum() - pdf[tokens]
        return pdf.drop(columns=["_group", "_place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, max_tokens: int = 2048, max_loss: int | None = None, context: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of whole encoded texts: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens.

    A text's ids (null: none) and end_id are cut into pieces as long as max_tokens and max_loss allow. All
    ids bear loss but the end mark and a text's first `context` ids, which have too little before them to be told from. Repeated rows give repeated pieces.
    """
    most = min(max_tokens, max_loss or max_tokens)
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()

    @lean(uses=(_tokenizer, word_ids))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for batch in slices(batches, "text", 1 << 20):
            rows, start, length, crc, total, loss = [], [], [], [], [], []
            for i, ids in enumerate(coder.of([t or "" for t in column(batch, "text").to_pylist()])):
                ids += end
                n, b = len(ids) // 4, 0
                while b < n:
                    a, b = b, min(n, b + min(max_tokens, most + max(0, context - b)))
                    rows.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    total.append(n)
                    loss.append(max(0, b - (b == n) - max(a, context)))
            keys = column(batch, "key").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.int64()) for x in (start, length, crc, total, loss)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens"])

    return bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, context: int = 0) -> DataFrame:
    """Each text's pieces in sequences; the pieces' ids are encoded once and not moved.

    max_loss, if given, is the most loss-bearing tokens of a sequence, and pieces are cut so that each is within it; context: see token_pieces.
    Without it that limit is max_tokens and never binds, as all tokens but end marks bear loss.
    Repeated rows are packed as often as they occur; a null or empty text is its end mark.
    """
    if max_loss is not None and max_loss < 1:
        raise ValueError("max_loss: from 1")
    pieces = cut(token_pieces(docs, vocabulary, max_tokens=max_tokens, max_loss=max_loss, context=context))
    packed = pack(pieces, "length", "loss_tokens", ["doc_id", "start", "ids_crc32"], max_tokens, max_segments, max_loss)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


#: Limits of the query and of the pipeline: each binds on some of their sequences.
LIMITS = {"max_tokens": 2048, "max_segments": 32, "max_loss": 2040, "context": 8}


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"), **LIMITS)
