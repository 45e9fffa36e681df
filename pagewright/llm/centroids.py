"""Centroid clustering (11): exact integer k-means with block-norm screening.

*Compressed vectors.* One pass makes vectors of integers, and of each the norms of its segments of
``segment`` components, rounded up. They are stored once in the shared folder; no round reads
anything else.
*Screening.* |x - c|^2 = |x|^2 + |c|^2 - 2 x.c, and by Cauchy-Schwarz x.c is at most the sum of the
products of segment norms. With norms rounded up this is a lower bound in integers, so no
rounding can prune wrongly. A vector visits centroids by rising bound, and stops where the bound
is above the best distance so far; only those visited get an exact distance.
*Rounds.* Tasks send a row for each centroid (count and sums), so that the driver holds ``k`` rows
of partial sums a round, whatever the number of vectors.

Vectors that are null, of another width, or hold a null, NaN or infinite component are left out.
Fewer vectors than ``k`` give as many centroids; an empty table gives an empty result. Ties go to the
smaller number. Repeated rows are vectors of their own; rows of null vec_id count but serve as
first centroids last. Components of 262,144 or more raise an error. Other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, small_batches, tidy
from .vectors import fixed_point, is_finite, lists, matrix, moved, root_up


def compress(vectors: DataFrame, *, width: int, segment: int, vector: str = "embedding") -> DataFrame:
    """vec_id, x (integers), norms (of segments, rounded up): a row for each vector that is kept."""
    small_batches(vectors.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1), width)
            squares = np.add.reduceat(x * x, np.arange(0, width, segment), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(root_up(squares))], ["vec_id", "x", "norms"])

    kept = vectors.where((F.size(vector) == width) & is_finite(vector)).select("vec_id", fixed_point(vector).alias("x"))
    return kept.mapInArrow(tidy(run), "vec_id bigint, x array<int>, norms array<int>")


class Screen:
    """Nearest of ``centroids`` (a matrix of longs), by bounds first."""

    def __init__(self, centroids: np.ndarray, segment: int):
        self.c = centroids
        squares = centroids * centroids
        self.norms = root_up(np.add.reduceat(squares, np.arange(0, centroids.shape[1], segment), axis=1))
        self.square = squares.sum(axis=1)
        #: exact distances made so far
        self.exact = 0

    def bounds(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances: a row a vector, a column a centroid."""
        return (x * x).sum(axis=1)[:, None] + self.square - 2 * (norms @ self.norms.T)

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid, the smaller number of equals."""
        low = self.bounds(x, norms)
        turn = np.argsort(low, axis=1, kind="stable")
        best = np.full(len(x), np.iinfo(np.int64).max)
        cluster = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        for t in range(len(self.c)):
            one = turn[row, t]
            open_ = low[row, one] <= best[row]  # an equal bound may still tie
            row, one = row[open_], one[open_]
            if not len(row):
                break
            away = x[row] - self.c[one]
            d = np.einsum("ij,ij->i", away, away)
            self.exact += len(row)
            wins = (d < best[row]) | ((d == best[row]) & (one < cluster[row]))
            best[row[wins]], cluster[row[wins]] = d[wins], one[wins]
        return cluster, best


def _in_parts(batch, width: int, segments: int, rows: int = 4096):
    """(vec_id, x, norms) by some thousand rows."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0), matrix(part.column(1), width), matrix(part.column(2), segments)


def _sums(stored: DataFrame, centroids: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the vectors nearest to each centroid."""
    k, width = centroids.shape
    segments = -(-width // segment)

    def run(batches):
        import pyarrow as pa

        screen = Screen(centroids, segment)
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, norms in _in_parts(batch, width, segments):
                cluster, _ = screen.nearest(x, norms)
                np.add.at(sums, cluster, x)
                counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), lists(sums[some], np.int64)], ["cluster", "n", "sums"])

    parts = stored.select("vec_id", "x", "norms").mapInArrow(tidy(run), "cluster int, n bigint, sums array<bigint>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    for r in totals.collect():  # k rows at most
        sums[r.cluster], counts[r.cluster] = r.sums, r.n
    return sums, counts


def cluster(
    vectors: DataFrame, *, k: int = 40, rounds: int = 5, width: int = 64, segment: int = 4, salt: str = "2:", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance; the centroids): ``rounds`` rounds of Lloyd from the ``k`` vectors whose ids hash least."""
    spark = vectors.sparkSession
    shelf = Shelf(spark, "centroids")
    stored = shelf.put(compress(vectors, width=width, segment=segment, vector=vector), "compressed")
    told = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = stored.select("x", told.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), np.zeros((0, width), np.int64)
    centroids = np.array([r.x for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(*_sums(stored, centroids, segment), centroids)
    segments = -(-width // segment)

    def run(batches):
        import pyarrow as pa

        screen = Screen(centroids, segment)
        for batch in batches:
            for ids, x, norms in _in_parts(batch, width, segments):
                found, d = screen.nearest(x, norms)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    placed = stored.mapInArrow(tidy(run), "vec_id bigint, cluster int, distance bigint")
    return shelf.put(placed, "placed"), centroids


def digests(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``placed`` with cluster_inertia, inertia and centroid_sha256."""
    spark = placed.sparkSession
    each = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    told = [(c, s, sum(each.values()), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in each.items()]
    known = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """All distances, round by round."""
    near = "min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {k} + j)"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {width}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS j, x AS c FROM v ORDER BY sha256('2:' || vec_id) NULLS LAST, x LIMIT {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, {near.format(k=k)} AS b FROM v, c{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM (
    SELECT b % {k} AS j, p, sum(x[p])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {width + 1})) AS p) GROUP BY 1, 2) GROUP BY j
), c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.j = c{i}.j)""")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, (b % {k})::INTEGER AS cluster, (b // {k})::BIGINT AS distance, sum(b // {k}) OVER (PARTITION BY b % {k})::BIGINT AS cluster_inertia,
  sum(b // {k}) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = b % {k}"""
    )
