"""Plain Lloyd clustering of integer vectors.

Vectors become integers once, in a written table. In every round the centroids (k rows, a
parameter) travel with the tasks; a task takes the integer squared differences to one
centroid after the other in NumPy, and argmin picks the lowest index of the least.
Each partition emits one integer sum per centroid and component, which Spark merges;
what reaches the driver is k x dims numbers, whatever the input. All arithmetic is on
integers, so results do not depend on partitions, order or retries.

Defined cases: vectors that are null, of another length, or hold a null or non-finite
component are left out and have no row; scaled components beyond 2^26 count as 2^26 (so do negative ones);
equal distances go to the lower index; an empty cluster keeps its centroid; repeated
rows and ids count each and have a row each, a null id hashes as "null"; of starting rows with equal
hashes the one with the lesser bytes comes first; with fewer than k kept rows there are as many
centroids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import integer_table, summed, unpacked

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3


def starting_centroids(vectors: DataFrame, clusters: int, dims: int, seed: int = SEED):
    """The vectors with the least sha256 of "seed:id", an int64 row each."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = vectors.orderBy(F.sha2(name, 256), "v").limit(clusters).collect()
    return unpacked([bytes(r.v) for r in rows], dims)


def nearest(v, centroids):
    """Index of the nearest centroid, the lower one of equals, and the squared distance."""
    import numpy as np

    d = np.empty((len(v), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        diff = v - c
        np.einsum("ij,ij->i", diff, diff, out=d[:, k])
    at = d.argmin(axis=1)
    return at, d[np.arange(len(v)), at]


def _sums(centroids, dims: int):
    def run(frames):
        import numpy as np
        import pandas as pd

        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for frame in frames:
            v = unpacked(frame["v"].tolist(), dims)
            at, _ = nearest(v, centroids)
            n += np.bincount(at, minlength=len(centroids))
            for k in range(len(centroids)):
                total[k] += v[at == k].sum(axis=0)
        for k in np.flatnonzero(n):
            yield pd.DataFrame({"cluster": np.full(dims, k, np.int32), "place": np.arange(dims, dtype=np.int32), "total": total[k], "n": np.full(dims, n[k], np.int64)})

    return run


def moved(vectors: DataFrame, centroids, dims: int):
    """One round: every vector to its nearest centroid, every non-empty centroid to the floor of its mean."""
    new = centroids.copy()
    for r in summed(vectors.select("v").mapInPandas(_sums(centroids, dims), "cluster int, place int, total bigint, n bigint"), ["cluster", "place"]):
        new[r.cluster, r.place] = r.total // r.n
    return new


def _assigned(centroids, dims: int):
    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            at, distance = nearest(unpacked(frame["v"].tolist(), dims), centroids)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": at.astype(np.int32), "distance": distance})

    return run


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED):
    """The centroids after so many rounds. vectors: vec_id, v."""
    centroids = starting_centroids(vectors, clusters, dims, seed)
    for _ in range(rounds if len(centroids) else 0):
        new = moved(vectors, centroids, dims)
        if (new == centroids).all():  # every further round would give the same
            break
        centroids = new
    return centroids


def clustered(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = rows.sparkSession
    vectors = integer_table(rows.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).alias("embedding")), "vec_id", "embedding", dims, scale)
    centroids = lloyd(vectors, clusters, rounds, dims, seed)
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        empty = spark.createDataFrame([], f"vec_id bigint, distance bigint, {schema}")
        return empty.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assigned = stored(vectors.mapInPandas(_assigned(centroids, dims), "vec_id bigint, cluster int, distance bigint"), "clusters")
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most = (1 << 63) - 1
    every = min(sum(inertia.values()), most)
    digests = [(k, min(d, most), every, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, d in inertia.items()]
    # At most one row a centroid.
    return assigned.join(F.broadcast(spark.createDataFrame(digests, schema)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def centroid_table(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """cluster, centroid: the fitted centroids in the vectors' own scale, for assigning other rows."""
    vectors = integer_table(rows.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).alias("embedding")), "vec_id", "embedding", dims, scale)
    found = lloyd(vectors, clusters, rounds, dims, seed)
    return rows.sparkSession.createDataFrame([(k, [x / scale for x in c.tolist()]) for k, c in enumerate(found)], "cluster int, centroid array<double>")
