"""Sharding (5, native): a uniform shuffle into shards of exact size.

1. *Communication matrix.* Rows lie in ``cells`` (a hash of the row's key). Given the cells'
   row counts and the shards' exact sizes, the number of rows that each cell sends to each
   shard is drawn from the multivariate hypergeometric law, cell after cell. The counts are
   what a uniform permutation of all rows would give.
2. *Permute locally.* Rows of a cell are ranked by a random key; the matrix row cuts the ranks
   into shards.
3. *Exchange and permute again.* Within a shard rows are ranked by a second key, in bins whose
   counts give each bin its first slot, so no task holds a whole shard.

Law ``rows``: shards' row counts are at most one apart. All rows take part; rows that repeat
an id are spread by a hash of their text too, and rows that are wholly equal are interchangeable.
Null text: no bytes. Null ids: an id of their own. An empty table gives an empty result.
The driver holds the matrix alone: one row for each cell, and there are as many cells as
``rows / rows_per_cell`` (``MAX_CELLS`` at most).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Shelf

MAX_CELLS = 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Rows of ``good`` among ``n`` drawn from ``good + bad``: inversion over the law's bulk.

    Weights come from exact ratios of neighbouring probabilities, from the mode outward to 12
    standard deviations, so the population's size has no limit.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    reach = int(12 * sd) + 12
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    ratio = ((good - k) / (k + 1)) * ((n - k) / (bad - n + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(np.log(ratio))))
    weight = np.exp(logs - logs.max())
    total_weight = np.cumsum(weight)
    return a + int(np.searchsorted(total_weight, rng.random() * total_weight[-1], side="right"))


def communication_matrix(cell_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, as a uniform permutation has them."""
    rng = np.random.default_rng(seed)
    left = [int(x) for x in shard_rows]
    out = np.zeros((len(cell_rows), len(left)), np.int64)
    for i, n in enumerate(cell_rows):
        rest, need = sum(left), int(n)
        for j, have in enumerate(left):
            got = hypergeometric(rng, have, rest - have, need) if need else 0
            out[i, j] = got
            rest -= have
            need -= got
            left[j] = have - got
    return out


def shard_rows_evenly(
    docs: DataFrame, shards: int = 24, *, seed: int = 7, rows_per_cell: int = 1_000_000, min_cells: int = 256
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; slots of a shard are gapless from 0."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = lambda k: F.xxhash64(F.lit(seed + k), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("mark"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("mark"),
    )
    rows = shelf.put(rows, "rows")  # texts are read once
    total = rows.count()
    cells = min(MAX_CELLS, max(min_cells, -(-total // rows_per_cell)))
    placed = rows.withColumn("cell", F.pmod(drawn(1), F.lit(cells)).cast("int"))
    counted = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    even = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counted.get(c, 0) for c in range(cells)], even, seed)
    ends = spark.createDataFrame(
        [(c, [int(x) for x in np.cumsum(matrix[c])]) for c in range(cells)], "cell int, ends array<bigint>"
    )
    ranked = placed.withColumn(
        "rank", F.row_number().over(W.partitionBy("cell").orderBy(drawn(2), "doc_id", "mark")) - 1
    )
    sent = ranked.join(F.broadcast(ends), "cell").select(
        "doc_id", "size", "text_crc32", "mark",
        F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"),
        F.pmod(drawn(3), F.lit(cells)).cast("int").alias("bin"),
    )
    sent = shelf.put(sent, "sent")
    shelf.drop(rows)
    bins = sent.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    first = bins.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("shard", "bin").orderBy(drawn(4), "doc_id", "mark")) - 1
    return (
        sent.withColumn("within", within)
        .join(F.broadcast(first), ["shard", "bin"])  # shards * cells rows at most
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"))
    )
