"""Exact top-k search: tiled matrix products of queries and shards, partial selection in each tile, merged per-query lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import cut, seen, small
from lexgrove.llm.vectors import as_long, integers, product, stacked

#: Rows and queries of one matrix product.
TILE_ROWS, TILE_QUERIES = 4096, 512


def best_of_tiles(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, id and score of the k best rows of each query, each id once, a query's own left out.

    row_ids ascend. Rows of one id are consecutive, so that the best of them is a reduction. A tile's k best
    come from a partial selection, ties at its edge by id, and are merged with those of the tiles before.
    """
    out = []
    # tiles end where ids end
    edges = [0]
    while edges[-1] < len(rows):
        at = min(edges[-1] + TILE_ROWS, len(rows))
        edges.append(int(np.searchsorted(row_ids, row_ids[at - 1], side="right")))
    for a in range(0, len(queries), TILE_QUERIES):
        q, own = queries[a : a + TILE_QUERIES], query_ids[a : a + TILE_QUERIES]
        who, ids, scores = np.zeros(0, np.int64), row_ids[:0], np.zeros(0, np.int64)
        for low, high in zip(edges[:-1], edges[1:]):
            names, first = np.unique(row_ids[low:high], return_index=True)
            tile = as_long(product(q, rows[low:high]))
            if len(names) < high - low:
                tile = np.maximum.reduceat(tile, first, axis=1)
            other = own[:, None] != names[None]
            if len(names) > k + 1:
                # the k-th best but for the query's own: what reaches it stays, ties too
                floor = np.partition(np.where(other, tile, np.iinfo(np.int64).min), len(names) - k, axis=1)[:, len(names) - k]
                other &= tile >= floor[:, None]
            x, y = np.nonzero(other)
            who, ids, scores = np.concatenate([who, x]), np.concatenate([ids, names[y]]), np.concatenate([scores, tile[x, y]])
            by = np.lexsort((ids, -scores, who))
            who, ids, scores = who[by], ids[by], scores[by]
            kept = np.arange(len(who)) - np.searchsorted(who, who) < k
            who, ids, scores = who[kept], ids[kept], scores[kept]
        out.append((who + a, ids, scores))
    return tuple(np.concatenate(c) for c in zip(*out))


def merged(lists: DataFrame, k: int, fan: int) -> DataFrame:
    """Lists (query_id, part, top) of `fan` neighbouring parts as one list of the k best, each id once."""
    together = lists.groupBy("query_id", F.floor(F.col("part") / fan).cast("int").alias("part")).agg(F.array_sort(F.flatten(F.collect_list("top"))).alias("top"))
    named = together.withColumn("ids", F.col("top.vec_id"))
    # lists are sorted: the first entry of an id is its best one
    return named.select("query_id", "part", F.slice(F.filter("top", lambda x, i: F.array_position("ids", x["vec_id"]) == i + 1), 1, k).alias("top"))


def top_products(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
    shard_rows: int = 16_384, block_queries: int = 8_192, fan: int = 32, seed: int = 12,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k largest inner products of the vectors floor(scale * x), ties to the smaller vec_id.

    Every pair of a query and a row is scored, exactly: rows are dealt to shards of at most about shard_rows and queries to blocks of
    about block_queries by a hash of id and vector, each block meets each shard in one group, and a group's work is a series of matrix products
    of TILE_QUERIES times TILE_ROWS, of which the k best of each query stay. Lists of `fan` shards are merged at a time, and so on up. A row
    is sent once for each block and a query once for each shard, so that what is sent is small against the products: with these sizes a vector sent
    is multiplied at least 8,192 times.
    `is_query` maps the id column to a condition. Vectors that are null or hold null or non-finite components take no part, nor rows with a null id; only vectors of one
    dimension meet. Rows repeated as a whole count once; of different vectors under one id (also as queries) the best score stands, and rows with the query's own id are left out. A
    query without others has no rows, an empty table gives none, other columns are left out. Components are held within 2**62, and scores beyond 64 bits count as the nearest long.
    """
    if k < 1:
        raise ValueError("k: 1 or more")
    kind, spark = vectors.schema[key].dataType.simpleString(), vectors.sparkSession
    rows = cut(stacked(vectors, key, vector).where("id is not null").dropDuplicates(["id", "v"]).withColumn("n", F.size("v")))
    # no more shards than there are thousands of rows, but enough for all cores
    least = max(1, min(shard_rows, max(1024, seen(rows)["rows"] // (2 * spark.sparkContext.defaultParallelism))))
    asked = rows.where(is_query(F.col("id")))
    parts = lambda df, per, name: df.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    dealt = small(cut(parts(asked, block_queries, "blocks").join(parts(rows, least, "shards"), "n"), seen(rows)["rows"]), 16)
    depth = dealt.agg(F.max("shards")).first()[0]
    hashed = F.xxhash64(F.lit(seed), "id", "v")
    q = asked.join(dealt, "n").select("id", "v", "n", F.pmod(hashed, F.col("blocks")).cast("int").alias("block"), F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"))
    r = rows.join(dealt, "n").select("id", "v", "n", F.pmod(hashed, F.col("shards")).cast("int").alias("shard"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))

    def tiles(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": r["id"][:0], "part": np.zeros(0, np.int32), "vec_id": r["id"][:0], "score": np.zeros(0, np.int64)})
        r = r.sort_values("id", kind="stable")
        number, ids = pd.factorize(r["id"], sort=True)
        own = ids.get_indexer(q["id"])
        who, best, score = best_of_tiles(integers(np.stack(q["v"].to_list()), scale), own, integers(np.stack(r["v"].to_list()), scale), number, k)
        out = pd.DataFrame({"query_id": q["id"].to_numpy()[who], "part": np.full(len(who), r["shard"].iloc[0], np.int32), "vec_id": np.asarray(ids)[best], "score": score})
        if q["id"].duplicated().any():
            out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)
        return out

    by = ["n", "block", "shard"]
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from one table
    found = fresh(q).groupBy(*by).cogroup(fresh(r).groupBy(*by)).applyInPandas(tiles, f"query_id {kind}, part int, vec_id {kind}, score long")
    lists = found.groupBy("query_id", "part").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("top"))
    lists = merged(lists, k, fan)
    depth = -(-(depth or 1) // fan)
    while depth > 1:
        lists, depth = merged(lists, k, fan), -(-depth // fan)
    ranked = lists.select("query_id", F.posexplode("top").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))


def op12_tiled_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(max(list_sum(list_transform(list_zip(q.c, r.c), lambda z: z[1] * z[2]))) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.c) = len(r.c) GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
