"""Operator 12, centroid clustering by ball k-means.

Vectors become integers, so that every distance, sum and tie is exact and no order of summing shows. A round gives the
result of Lloyd's, comparing less: the members of a cluster are a ball around its centroid, with the distance of the
farthest as radius. Only centroids at most twice the radius away are its neighbours. A member nearer to its own centroid
than half the way to a neighbour can't be nearer to that one; those that hold so for all neighbours are the stable
core, and the others lie in annuli, which are compared with the neighbours that are near enough for them and no others.

The vectors are written once, with the cluster in which a first full comparison put them as their home. A round is one
pass over that table, in which each batch forms the balls of its own members by home (a part of a ball has at most the
ball's radius) and hands on a count and sums for each cluster; 8 x 64 sums reach the driver. Homes of earlier rounds
stay valid, as only distances to today's centroids are used; the table is written anew once a tenth has moved away.

Cases: vectors of another length, null ones and those with a null or non-finite component are left out; a null vec_id is
clustered but is no first centroid; of rows that repeat a vec_id each is clustered, and for first centroids they come in
the order of their vectors; with fewer than k vectors all are first centroids; equal centroids leave all to the smaller
number; rounds end early when no centroid moves, as further ones would change nothing; components beyond 2^26 after
scaling raise an error, as distances would pass 64 bits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import col, new_path, remove_path, stored

K, DIMS, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, 3
#: Share of members away from home from which the table is written anew.
REHOME = 0.1
#: Largest component: 64 squares of differences, times four, fit into 64 bits.
LARGEST = 1 << 26


def usable(vectors: DataFrame, *, vec: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole vectors of `dims` finite components, scaled and rounded down."""
    x = col(embedding).cast("array<double>")
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    whole = vectors.filter((F.size(x) == dims) & ~bad)
    large = F.exists(x, lambda y: F.abs(y) > LARGEST / scale)
    v = F.transform(x, lambda y: F.floor(y * F.lit(float(scale))).cast("int"))
    return whole.select(col(vec).cast("long").alias("vec_id"), F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).otherwise(v).cast("array<int>").alias("v"))


def first_centroids(given: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = given.filter("vec_id is not null").orderBy(place, "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _squares(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = v - centroid
    return np.einsum("ij,ij->i", apart, apart)


def nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector by full comparison; ties go to the smaller number."""
    return np.argmin(np.stack([_squares(v, c) for c in centroids]), axis=0).astype(np.int32)


def between(centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every two centroids."""
    return np.stack([_squares(centroids, c) for c in centroids])


def assign(v: np.ndarray, home: np.ndarray, centroids: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances worked out) of members of the balls that `home` names."""
    own = _squares(v, centroids[home])
    cluster, best, n = home.copy(), own.copy(), len(v)
    for c in np.unique(home).tolist():
        ball = np.flatnonzero(home == c)
        radius = own[ball].max()
        # Twice the radius, squared; at exactly half the way a smaller number wins.
        neighbours = [o for o in np.argsort(apart[c], kind="stable").tolist() if o != c and apart[c, o] <= 4 * radius]
        for o in neighbours:
            # Neighbours come nearest first, so the annuli beyond half the way to each lie in one another.
            ball = ball[4 * own[ball] >= apart[c, o]]
            if not len(ball):
                break
            d = _squares(v[ball], centroids[o])
            n += len(ball)
            won = (d < best[ball]) | ((d == best[ball]) & (o < cluster[ball]))
            cluster[ball[won]], best[ball[won]] = o, d[won]
    return cluster, best, n


@dataclass
class Clusters:
    """members: (vec_id, cluster, distance), a stored table; centroids by number; distances: worked out in all rounds."""

    members: DataFrame
    centroids: list[list[int]]
    distances: int


def ball_kmeans(given: DataFrame, *, k: int = K, rounds: int = ROUNDS, seed: int = SEED, rehome: float = REHOME) -> Clusters:
    """given (vec_id, v), all v of one length."""
    spark = given.sparkSession
    centroids = first_centroids(given, k, seed)
    if not len(centroids):
        # Without a first centroid nothing can be clustered: no vector with an id.
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], 0)
    dims, paths = centroids.shape[1], []

    def homes(table: DataFrame, now: np.ndarray, apart: np.ndarray) -> DataFrame:
        full = "home" not in table.columns

        def run(batches):
            for batch in batches:
                v = _matrix(batch.column("v"), dims)
                home = nearest(v, now) if full else assign(v, batch.column("home").to_numpy(), now, apart)[0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(home, pa.int32())], ["vec_id", "v", "home"])

        moved = stored(table.mapInArrow(run, "vec_id long, v array<int>, home int"), "ball-members", paths)
        for path in paths[:-1]:
            remove_path(spark, path)
        del paths[:-1]
        return moved

    def sums(table: DataFrame, now: np.ndarray, apart: np.ndarray) -> dict[tuple[int, int], int]:
        """(cluster, component) -> sum; as component -1 the members, as (-1, -2) those away from home, as (-1, -3) the distances worked out."""

        def run(batches):
            total, count, away, worked = np.zeros((len(now), dims), np.int64), np.zeros(len(now), np.int64), 0, 0
            for batch in batches:
                v, home = _matrix(batch.column("v"), dims), batch.column("home").to_numpy()
                cluster, _, n = assign(v, home, now, apart)
                for c in np.unique(cluster).tolist():
                    total[c] += v[cluster == c].sum(axis=0)
                count += np.bincount(cluster, minlength=len(now))
                away, worked = away + int((cluster != home).sum()), worked + n
            at = [(c, i, int(total[c, i])) for c in np.flatnonzero(count).tolist() for i in range(dims)]
            at += [(c, -1, int(n)) for c, n in enumerate(count) if n] + [(-1, -2, away), (-1, -3, worked)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*at), (pa.int32(), pa.int32(), pa.int64()))], ["cluster", "i", "s"])

        # k times dims and a few rows from each task, as many in all.
        return {(r["cluster"], r["i"]): r["s"] for r in table.select("v", "home").mapInArrow(run, "cluster int, i int, s long").groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect()}

    worked = 0
    table = homes(given, centroids, between(centroids))
    for _ in range(rounds):
        apart = between(centroids)
        found = sums(table, centroids, apart)
        worked += found[-1, -3]
        if found[-1, -2] > rehome * sum(n for (_, i), n in found.items() if i == -1):
            table = homes(table, centroids, apart)
        last, centroids = centroids, centroids.copy()
        for c in range(len(centroids)):
            if n := found.get((c, -1)):
                centroids[c] = [found[c, i] // n for i in range(dims)]
        if (last == centroids).all():
            break
    apart = between(centroids)

    def members(batches):
        for batch in batches:
            cluster, distance, _ = assign(_matrix(batch.column("v"), dims), batch.column("home").to_numpy(), centroids, apart)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    result = stored(table.mapInArrow(members, "vec_id long, cluster int, distance long"), "ball-clusters")
    for path in paths:
        remove_path(spark, path)
    return Clusters(result, centroids.tolist(), worked)


def op12_ball_kmeans(spark, sf_dir: str) -> DataFrame:
    found = ball_kmeans(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(found.centroids)]
    inertia = {r["cluster"]: r["d"] for r in found.members.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    each = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # A row for each of the k clusters, which bounds the broadcast.
    return found.members.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Lloyd's rounds over components as rows, one after the other."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT r, i, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM k, range(1, {DIMS + 1}) t(i))",
        f"s AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM k WHERE vec_id IS NOT NULL QUALIFY c < {K})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS y FROM s JOIN v USING (r))",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((x - y) * (x - y)) AS d FROM v JOIN c{t} USING (i) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if t < ROUNDS:
            steps.append(f"m{t} AS (SELECT c, i, CAST({floor} AS BIGINT) AS y FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN v USING (r) GROUP BY 1, 2))")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce(m{t}.y, c{t}.y) AS y FROM c{t} LEFT JOIN m{t} USING (c, i))")
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY 1)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN k USING (r) JOIN h USING (c)"


OP12_SQL = _sql()
