"""Approximate nearest neighbours: low-dimensional stable projections, a kd-tree over them, a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.llm.common import cut, hash_below, seen, small


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that halves the widest side."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        own = points[rows]
        side = int(np.argmax(np.ptp(own, axis=0))) if len(rows) else 0
        if len(rows) <= leaf_rows or own[:, side].max() == own[:, side].min():
            leaves += [rows[i : i + leaf_rows] for i in range(0, len(rows), leaf_rows)]
            continue
        order = np.argsort(own[:, side], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


def kd_splits(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Side and value of each inner node, in heap order, of a complete kd-tree of so many levels that halves the widest side at the median."""
    side, value = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
    rows = {0: np.arange(len(points))}
    for node in range(2**levels - 1):
        at = rows.pop(node)
        if len(at):
            side[node] = int(np.argmax(np.ptp(points[at], axis=0)))
            value[node] = np.median(points[at, side[node]])
        right = points[at, side[node]] > value[node]
        rows[2 * node + 1], rows[2 * node + 2] = at[~right], at[right]
    return side, value


def kd_cell(points: np.ndarray, side: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The cell of each point in the tree of kd_splits."""
    node = np.zeros(len(points), np.int64)
    for _ in range((len(side) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), side[node]] > value[node])
    return node - len(side)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point (row) from each box (column)."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j : j + 1]
        out += np.maximum(0, np.maximum(low[:, j] - x, x - high[:, j])) ** 2
    return out


class Vectors:
    """Vectors by their largest component, so that no square overflows, with norms and unit vectors."""

    def __init__(self, rows: np.ndarray) -> None:
        self.scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
        self.norm = np.sqrt((self.scaled * self.scaled).sum(axis=1))
        self.unit = self.scaled / self.norm[:, None]

    def cosine(self, mine: np.ndarray, other: "Vectors", theirs: np.ndarray) -> np.ndarray:
        """Cosines of rows `mine` with rows `theirs` of other, each summed alike wherever the pair meets."""
        return (self.scaled[mine] * other.scaled[theirs]).sum(axis=1) / (self.norm[mine] * other.norm[theirs])


def search_block(queries: Vectors, points: Vectors, same: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, projection: np.ndarray, stop: float, worst: np.ndarray, leaf_rows: int = 128, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Rows (-1: none) and cosines of the k nearest points found for each query, of equal cosines the first rows.

    A query goes through the leaves of a kd-tree by their projected distance, nearest first, and verifies
    a leaf's vectors. It stops when the next leaf's squared projected distance is over `stop` times its k-th
    squared distance so far, at first that of the cosine `worst`: `stop` is a quantile of the chi-square
    distribution, which the ratio of the two follows, so a nearer vector would by that
    probability have shown already. same(query rows, point rows) tells which pairs are of one record and don't count.
    """
    flat, asked = points.unit @ projection, queries.unit @ projection
    leaves = kd_leaves(flat, leaf_rows)
    bound = box_distance(asked, np.stack([flat[r].min(axis=0) for r in leaves]), np.stack([flat[r].max(axis=0) for r in leaves]))
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    n = len(asked)
    best, rows = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    active = np.arange(n)
    for a in range(0, len(leaves), step):
        kth = np.maximum(best[active, -1], worst[active])
        # a hair is left for what rounding does to a distance of almost 0
        active = active[~(bound[active, a] > stop * np.maximum(0.0, 2.0 - 2.0 * kth) + 1e-9)]
        if not len(active):
            break
        visits = order[active, a : a + step]
        who, leaf = np.repeat(active, visits.shape[1]), visits.ravel()
        by = np.argsort(leaf, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            own = np.sort(leaves[leaf[group[0]]])
            for q in np.array_split(who[group], -(-len(group) // 256)):
                near = queries.unit[q] @ points.unit[own].T
                # products summed in another order differ in the last places: what may be among the k is summed anew
                floor = np.maximum(best[q, -1], worst[q])
                if len(own) > k:
                    floor = np.maximum(floor, np.partition(np.where(same(q, own), -np.inf, near), len(own) - k, axis=1)[:, len(own) - k])
                x, y = np.nonzero((near >= floor[:, None] - 1e-9) & ~same(q, own))
                if not len(x):
                    continue
                value = queries.cosine(q[x], points, own[y])
                wide = np.bincount(x, minlength=len(q)).max()
                place = np.arange(len(x)) - np.searchsorted(x, x)
                more, at = np.full((len(q), wide), -np.inf), np.full((len(q), wide), -1, np.int64)
                more[x, place], at[x, place] = value, own[y]
                more, at = np.concatenate([best[q], more], axis=1), np.concatenate([rows[q], at], axis=1)
                top = np.lexsort((np.where(at < 0, np.iinfo(np.int64).max, at), -more), axis=1)[:, :k]
                best[q], rows[q] = np.take_along_axis(more, top, axis=1), np.take_along_axis(at, top, axis=1)
    return rows, best


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (doubles) of the vectors that take part: not null, not zero, all components finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).alias("id"), v.alias("v"), (~bad & F.exists(v, lambda x: x != 0)).alias("ok")).where("id is not null and ok").drop("ok")


def nearest(vectors: DataFrame, is_query, k: int = 5, dims: int = 12, sure: float = 0.98, cell_rows: int = 16_384, most_cells: int = 4096, sample_rows: int = 20_000, seed: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of each query's k nearest other vectors found.

    All vectors are placed in cells of about `cell_rows`, at most `most_cells`, by a kd-tree over their projections; its splits
    are medians of about `sample_rows` vectors picked by a hash of their id. A query first searches its own cell,
    then each cell whose box is within the chi-square test of its k-th distance there. A cell, and its
    queries, are parted by a hash of the id where they are more than cell_rows, and each part has a kd-tree of its own.
    `is_query` maps the id column to a condition. Only vectors of one dimension compare. Rows repeated as a whole
    count once; of different vectors under one id each is searched and found, and the id stands once with its best score. Rows with the query's own id
    are left out; ties go to the smaller id; other columns are left out; an empty table gives no rows.
    """
    if dims % 2:
        raise ValueError("dims: an even number")
    rows = cut(usable(vectors, key, vector).withColumn("n", F.size("v")).dropDuplicates(["id", "v"]))
    total, kind = seen(rows)["rows"], vectors.schema[key].dataType.simpleString()
    levels = min(int(math.log2(most_cells)), max(0, math.ceil(math.log2(max(1, total) / cell_rows))))
    stop = chi_square_quantile(sure, dims)

    def project(m: np.ndarray) -> np.ndarray:
        return Vectors(m).unit @ np.random.default_rng(seed).standard_normal((m.shape[1], dims))

    side, value = np.zeros(0, np.int64), np.zeros(0)
    if levels:
        picked = rows.where(hash_below(F.col("id"), sample_rows / total, seed)).toPandas()
        if picked.empty:
            raise ValueError("sample_rows: none of the vectors was picked")
        flat = [project(np.stack(own["v"].to_list())) for _, own in picked.groupby("n")]
        side, value = kd_splits(np.concatenate(flat) if flat else np.zeros((0, dims)), levels)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, own in pdf.groupby("n"):
                flat = project(np.stack(own["v"].to_list()))
                yield own.assign(cell=kd_cell(flat, side, value).astype(np.int32), low=list(flat))

    placed = cut(rows.mapInPandas(place, f"id {kind}, v array<double>, n int, cell int, low array<double>"))
    corner = [f(F.get("low", F.lit(j))).alias(f"{name}{j}") for name, f in (("a", F.min), ("b", F.max)) for j in range(dims)]
    boxes = placed.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("rows"), *corner).orderBy("n", "cell").toPandas()
    asked = placed.where(is_query(F.col("id")))

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"query_id": p["id"][:0], "vec_id": p["id"][:0], "score": np.array([], float)})
        p = p.sort_values("id", kind="stable")
        a, b = Vectors(np.stack(q["v"].to_list())), Vectors(np.stack(p["v"].to_list()))
        qid, pid = q["id"].to_numpy(), p["id"].to_numpy()
        projection = np.random.default_rng(seed).standard_normal((a.unit.shape[1], dims))
        found, score = search_block(a, b, lambda x, y: qid[x][:, None] == pid[y][None], k, projection, stop, q["worst"].to_numpy(float))
        who, rank = np.nonzero(found >= 0)
        return pd.DataFrame({"query_id": qid[who], "vec_id": pid[found[who, rank]], "score": score[who, rank]})

    def searched(visits: DataFrame) -> DataFrame:
        """Found pairs of visits (id, v, n, cell, worst), in parts of a cell's points and of its visiting queries."""
        n = seen(placed)["rows"]
        parts = lambda df, name: df.groupBy("n", "cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias(name))
        many = cut(parts(visits, "qs").join(parts(placed, "ps"), ["n", "cell"]), n)
        hashed = F.xxhash64(F.lit(seed), "id")
        fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from one table
        q = visits.join(small(many, 16), ["n", "cell"]).withColumns({"qb": F.pmod(hashed, F.col("qs")), "pb": F.explode(F.expr("sequence(0L, ps - 1L)"))})
        p = placed.drop("low").join(small(many, 16), ["n", "cell"]).withColumns({"pb": F.pmod(hashed, F.col("ps")), "qb": F.explode(F.expr("sequence(0L, qs - 1L)"))})
        by = ["n", "cell", "pb", "qb"]
        return fresh(q.drop("qs", "ps")).groupBy(*by).cogroup(fresh(p.drop("qs", "ps")).groupBy(*by)).applyInPandas(search, f"query_id {kind}, vec_id {kind}, score double")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    own = cut(best(searched(cut(asked.select("id", "v", "n", "cell", F.lit(float("-inf")).alias("worst"))))))
    if len(boxes) < 2:
        return own

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for n, mine in pdf.groupby("n"):
                there = boxes[boxes["n"] == n]
                corners = [there[[f"{c}{j}" for j in range(dims)]].to_numpy() for c in ("a", "b")]
                for at in range(0, len(mine), 512):
                    some = mine.iloc[at : at + 512]
                    apart = box_distance(np.stack(some["low"].to_list()), *corners)
                    limit = stop * np.maximum(0.0, 2.0 - 2.0 * some["worst"].to_numpy()) + 1e-9
                    x, y = np.nonzero((apart <= limit[:, None]) & (there["cell"].to_numpy()[None] != some["cell"].to_numpy()[:, None]))
                    yield some.iloc[x][["id", "v", "n", "worst"]].assign(cell=there["cell"].to_numpy()[y])[["id", "v", "n", "cell", "worst"]]

    kth = own.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))
    known = asked.join(kth, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    further = cut(known.mapInPandas(reach, f"id {kind}, v array<double>, n int, cell int, worst double"))
    return best(own.select("query_id", "vec_id", "score").unionByName(searched(further)))


def op8_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
