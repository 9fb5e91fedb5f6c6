"""Centroid clustering of integer vectors: exact rounds of assignment and means, with Hamerly's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import cut, lean
from lexgrove.llm.vectors import LONG, as_long, integers, largest, product, square, stacked

#: Bounds are doubles and get this much room, as a share, so that what rounding does never hides a nearer centroid.
ROOM = 1e-9
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def packed(v: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, in the least width that holds all of them."""
    most = largest(v)
    width = next(t for t in WIDTHS if most <= np.iinfo(t).max)
    rows = np.ascontiguousarray(v, dtype=np.dtype(width).newbyteorder("<"))
    return [r.tobytes() for r in rows]


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    if len({len(r) for r in rows}) == 1:
        width = WIDTHS[(len(rows[0]) // dims).bit_length() - 1]
        return np.frombuffer(b"".join(rows), np.dtype(width).newbyteorder("<")).reshape(-1, dims).astype(np.int64)
    return np.stack([unpacked([r], dims)[0] for r in rows])


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows from all centroids."""
    bound = max(largest(v), largest(centroids)) ** 2 * v.shape[1] * 4
    if bound < 1 << 62:
        return square(v)[:, None] - 2 * product(v, centroids) + square(centroids)[None]
    wide, own = v.astype(object), centroids.astype(object)
    return (wide * wide).sum(axis=1)[:, None] - 2 * (wide @ own.T) + (own * own).sum(axis=1)[None]


def own_distance(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row from its cluster's centroid."""
    bound = max(largest(v), largest(centroids)) ** 2 * v.shape[1] * 4
    apart = v - centroids[cluster] if bound < 1 << 62 else v.astype(object) - centroids.astype(object)[cluster]
    return (apart * apart).sum(axis=1)


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def scanned(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the first), upper bound of the distance from it and lower bound of that from every other one, by a full scan."""
    d = distances(v, centroids)
    near = np.argmin(d, axis=1) if len(d) else np.zeros(0, np.int64)
    at = np.arange(len(v))
    upper = root(d[at, near]) * (1 + ROOM)
    if d.shape[1] < 2:
        return near, upper, np.full(len(v), np.inf)
    rest = d.copy()
    rest[at, near] = rest.max() if len(rest) else 0
    return near, upper, root(rest.min(axis=1)) * (1 - ROOM)


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after centroids have moved by `drift`: the own centroid's for the upper one, the largest of all others' for the lower."""
    order = np.argsort(-drift, kind="stable")
    others = np.where(cluster == order[0], drift[order[1]] if len(drift) > 1 else 0.0, drift[order[0]])
    return (upper + drift[cluster]) * (1 + ROOM), (lower - others) - np.abs(lower) * ROOM - others * ROOM


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound after the centroids have moved by `drift`, and which vectors needed a full scan.

    A vector stays where its upper bound is under its lower one or under half the distance from its centroid to the next one; if not, the
    upper bound is made the exact distance; what then still isn't settled is scanned. Bounds must be apart, so ties are always scanned.
    """
    upper, lower = moved_bounds(cluster, upper, lower, drift)
    between = root(distances(centroids, centroids))
    np.fill_diagonal(between, np.inf)
    limit = np.maximum(lower, between.min(axis=1)[cluster] / 2 * (1 - ROOM))
    open_ = np.flatnonzero(~(upper < limit))
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    upper[open_] = root(own_distance(v[open_], centroids, cluster[open_])) * (1 + ROOM)
    open_ = open_[~(upper[open_] < limit[open_])]
    cluster[open_], upper[open_], lower[open_] = scanned(v[open_], centroids)
    full = np.zeros(len(v), bool)
    full[open_] = True
    return cluster, upper, lower, full


def next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, exactly; an empty cluster keeps its centroid. Sums are made by batch, then by Spark."""
    dims = centroids.shape[1]

    @lean
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, cluster = unpacked(batch.column(0).to_pylist(), dims), batch.column(1).to_numpy()
            names = np.unique(cluster)
            v = v if batch.num_rows * largest(v) < 1 << 62 else v.astype(object)
            total = [str(x) for c in names for x in v[cluster == c].sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(names)), pa.int32()), pa.array(np.repeat([int((cluster == c).sum()) for c in names], dims), pa.int64()), pa.array(total)], ["cluster", "place", "rows", "total"])

    parts = state.select("v", "cluster").mapInArrow(sums, "cluster int, place int, rows long, total string")
    # at most a row for each component of each centroid
    got = parts.groupBy("cluster", "place").agg(F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in got:
        out[r.cluster, r.place] = int(r.total) // r.rows
    return out


def hamerly(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding", scans: list[DataFrame] | None = None
) -> tuple[DataFrame, np.ndarray]:
    """`key`, cluster and distance (squared) of each vector, and the final centroids, of the vectors floor(scale * x) with `dims` components.

    Centroids start as the vectors with the smallest lowercase-hex sha256 of `seed:key`, in that order (equal ones by components). Each round assigns every vector to its
    nearest centroid (ties: the smaller number) and replaces each non-empty centroid by the componentwise exact floor(sum / count); then vectors are assigned once more.
    Each vector keeps an upper bound of the distance from its centroid and a lower bound of that from all others (Hamerly): centroids' drift loosens both,
    and only vectors whose bounds overlap are scanned again, in exact integers. Vector, cluster and bounds are one row, written at the end of a round; no round shuffles vectors.
    The driver holds `clusters` vectors. Vectors null, of other lengths or holding null or non-finite components are left out; repeated rows and null keys are vectors like others;
    fewer vectors than clusters give as many clusters as vectors; an empty table gives none; other columns are left out. Components are held within 2**62; distances beyond 64 bits count as the largest
    long where they are shown, exactly where they are compared. `scans`, if given, gets each round's table (`scanned`: by a full scan).
    """
    if clusters < 1 or rounds < 0:
        raise ValueError("clusters: 1 or more; rounds: none or more")
    kind = vectors.schema[key].dataType.simpleString()
    kept = stacked(vectors, key, vector).where(F.size("v") == dims)
    named = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256))
    first = named.orderBy("h", "v").limit(clusters).select("v").toPandas()
    if first.empty:
        return kept.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, dims), np.int64)
    centroids = integers(np.stack(first["v"].to_list()), scale)
    shape = f"id {kind}, v binary, cluster int, upper double, lower double, scanned boolean"

    def rows(ids: pa.Array, raw: list[bytes], cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(full)], ["id", "v", "cluster", "upper", "lower", "scanned"])

    def begun(centroids: np.ndarray):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
                    yield rows(batch.column(0), packed(v), *scanned(v, centroids), np.ones(len(v), bool))

        return run

    def carried(centroids: np.ndarray, drift: np.ndarray):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    raw = batch.column(1).to_pylist()
                    v = unpacked(raw, dims)
                    before = [batch.column(i).to_numpy() for i in (2, 3, 4)]
                    *after, full = reassigned(v, *before, centroids, drift)
                    yield rows(batch.column(0), raw, *after, full)

        return run

    state = kept.mapInArrow(begun(centroids), shape)
    for _ in range(rounds):
        state = cut(state)
        if scans is not None:
            scans.append(state)
        new = next_centroids(state, centroids)
        drift = root(np.diagonal(distances(new, centroids))) * (1 + ROOM)
        centroids = new
        state = state.mapInArrow(carried(centroids, drift), shape)
    final = centroids

    @lean
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column(2).to_numpy()
                d = as_long(own_distance(unpacked(batch.column(1).to_pylist(), dims), final, cluster))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], ["id", "cluster", "distance"])

    out = state.mapInArrow(measured, f"id {kind}, cluster int, distance long")
    return out.withColumnRenamed("id", key), final


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = hamerly(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = cut(found)
    total = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # a row for each cluster: the whole of them is summed without a window over vectors
    held = total.crossJoin(F.broadcast(total.agg(F.sum("own").alias("all"))))
    shown = held.select("cluster", *[F.least(F.col(c), F.lit(LONG)).cast("long").alias(n) for c, n in (("own", "cluster_inertia"), ("all", "inertia"))], F.get(F.array(*map(F.lit, digest)), F.col("cluster")).alias("centroid_sha256") if digest else F.lit("").alias("centroid_sha256"))
    return found.join(F.broadcast(shown), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    nearest = "SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, row, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM k, {m}) GROUP BY row, vec_id, v"
    means = """SELECT m.c, coalesce(n.m, m.m) AS m FROM {m} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM {a}) GROUP BY c, i) GROUP BY c) n ON n.c = m.c"""
    steps = ", ".join(f"a{i} AS ({nearest.format(m=f'm{i}')}), m{i + 1} AS ({means.format(m=f'm{i}', a=f'a{i}')})" for i in range(3))
    return f"""
WITH k AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM k QUALIFY c < 16),
{steps}, a3 AS ({nearest.format(m="m3")})
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a3 JOIN m3 ON a3.c = m3.c
"""


OP13_SQL = _sql()
