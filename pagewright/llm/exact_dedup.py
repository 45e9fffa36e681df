"""Exact dedup (9, native): an extendible-hash index of normalised texts on shared files.

Only DataFrame functions. Three steps:

1. *Chains.* Rows are grouped by (64-bit key, normalised bytes). Spark's aggregate compares the
   bytes, so two texts with one key are two nodes of that key's chain. Copies are combined
   before the shuffle, so a text that a third of all rows carry costs one row a task.
2. *Directory.* Keys' leading bits name a cell. A bucket starts as one cell of depth 0 and
   doubles the directory (one more bit) while it holds over ``bucket_rows`` nodes. Copies are
   already one node, so only distinct keys split a bucket. The directory has 2**max_depth
   cells at most, whatever the input, which is the size bound of its broadcast. Nodes are
   written to the shared folder, in ranges of buckets.
3. *Owners.* Every document goes through the directory to its bucket and looks its node up there
   by (bucket, key, digest). The look-up is dealt by all three: a bucket may hold any number of
   copies, so none is one task's.

Null texts count as empty; repeated rows and ties follow "most code points, then smallest
doc_id" (a null doc_id is last, after every number). Of rows that share the doc_id that stays in a
group, null ids too, all are ``kept``; so a repeated id stays once in each group whose row of that id is
best. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Shelf

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _entries(docs: DataFrame) -> DataFrame:
    norm = normalised(F.col("text"))
    return docs.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        norm.alias("norm"),
    ).select(
        "doc_id",
        "points",
        "norm",
        F.xxhash64("norm").alias("key"),
    )


def cell_of(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth).cast("long") if depth else F.lit(0).cast("long")


def directory(nodes: DataFrame, bucket_rows: int, max_depth: int) -> DataFrame:
    """(cell, bucket, depth): for every full-depth cell in use, the bucket that owns it.

    A bucket is the shallowest prefix with at most ``bucket_rows`` nodes, or a full-depth cell.
    """
    cells = nodes.groupBy(cell_of(F.col("key"), max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    steps = cells.select(
        "cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(cell, {max_depth} - depth)"))
    loads = steps.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = steps.join(loads, ["depth", "prefix"]).where((F.col("held") <= bucket_rows) | (F.col("depth") == max_depth))
    return (
        fits.groupBy("cell")
        .agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {max_depth} - depth), {max_depth} - depth)"))
    )


def exact_duplicates(docs: DataFrame, *, bucket_rows: int = 1_000_000, max_depth: int = 12) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, bucket_depth.

    ``bucket_rows``: nodes a bucket holds before it splits. ``max_depth``: bits of the full
    directory; a bucket of that depth holds more nodes where it must, none are dropped.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "exact")
    # "most code points, then smallest id" as one number: points * 2**64 - doc_id
    high = F.expr("cast(points as decimal(15,0)) * cast('18446744073709551616' as decimal(20,0))")
    unknown = F.expr("cast('9223372036854775808' as decimal(20,0))")  # over every id
    rank = high - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), unknown)
    stays = high - F.col("best")
    chained = (
        _entries(docs)
        .groupBy("key", "norm")
        .agg(
            F.max(rank).alias("best"),
            F.max("points").alias("points"),
            F.count(F.lit(1)).alias("group_size"),
        )
        .select(
            "key",
            F.sha2("norm", 256).alias("text_sha256"),
            F.when(stays < unknown, stays.cast("long")).alias("keep_id"),
            "group_size",
        )
    )
    nodes = shelf.put(chained, "nodes")
    cells = shelf.put(directory(nodes, bucket_rows, max_depth), "directory")
    owned = F.broadcast(cells)  # 2**max_depth rows at most
    cell = cell_of(F.col("key"), max_depth)
    index = shelf.put(
        nodes.withColumn("cell", cell)
        .join(owned, "cell")
        .repartitionByRange("bucket", "key")
        .sortWithinPartitions("bucket", "key", "text_sha256")
        .select("bucket", "depth", "key", "text_sha256", "keep_id", "group_size"),
        "index",
    )
    shelf.drop(nodes)
    asked = docs.select(
        "doc_id",
        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
        F.xxhash64(normalised(F.col("text"))).alias("key"),
    )
    asked = asked.withColumn("cell", cell).join(owned.select("cell", "bucket"), "cell")
    keep = F.col("keep_id")
    return asked.join(index, ["bucket", "key", "text_sha256"]).select(
        "doc_id",
        keep.cast("long").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "bucket",
        F.col("depth").cast("int").alias("bucket_depth"),
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""
