"""MinHash near-dedup (1): one-permutation hashing, optimal densification, banded buckets, stars.

*Sets.* A document's set holds the 64-bit hashes of its ``shingle``-word shingles. Equal sets are
one node (its least doc_id) from here on, so copies cost nothing further.
*Signature.* One hash a shingle; its leading part names one of ``bands * rows`` bins, each of
which keeps its least hash. An empty bin takes the value of the first filled bin in a random order
of its own (the same in all documents), so two sets agree in any bin with their similarity.
*Buckets.* Each band of ``rows`` bins is a bucket. A pair of similarity s shares none with
probability (1 - s**rows)**bands: 3e-5 at 0.8 and 2e-8 at 0.85 by default.
*Stars.* A bucket's hub is its member of greatest weight (the summed sizes of its buckets: a
text in the middle of its group). A node is compared on full sets with the ``stars`` hubs that it
shares most buckets with, at most, so there are ``stars`` pairs a node however large a bucket
is. Confirmed pairs are components.
*The rest.* Stars leave out links between two spokes. Where a bucket still holds more than one
component, all its pairs are decided: parity bitmaps (``parity``) rule out what cannot be similar without
making the pair, and of what is left only pairs that join components are confirmed on full sets, again
without those that failed. So every pair that shares a bucket ends in one component or is not similar.

Null and wordless texts have empty sets, linked with nothing. Rows that share a doc_id are one
node; rows of null doc_id are linked with nothing, and stay. Repeated rows are equal sets. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parity
from ._common import Shelf, mix64, signed, slices, small_batches, tidy
from .graph import components

_NEXT, _ALONE = np.uint64(0x9FB21C651E98DF25), np.uint64(0x5851F42D4C957F2D)


def shingles(h: np.ndarray, word_at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    n = len(h)
    run = h.copy()
    for step in range(1, min(k, n)):  # run[i] covers words i .. i + step
        run[: n - step] = run[: n - step] * _NEXT + h[step:]
    run = mix64(run)
    out = []
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(run[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            whole = h[a : a + 1].copy()
            for i in range(a + 1, b):
                whole = whole * _NEXT + h[i : i + 1]
            out.append(mix64(whole * _ALONE + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """One-permutation signatures and band keys of sorted sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        bins = bands * rows
        self.bounds = (np.arange(bins, dtype=object) * (1 << 64) // bins).astype(np.uint64)
        rng = np.random.default_rng(20)
        #: probes[t, i]: the bin that the empty bin i asks at its t-th try
        self.probes = np.stack([rng.permutation(bins) for _ in range(bins)], axis=1).astype(np.int32)
        self.factor = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        bins = self.bands * self.rows
        sig = np.zeros((len(sets), bins), np.uint64)
        full = np.zeros((len(sets), bins), bool)
        for d, s in enumerate(sets):
            at = np.searchsorted(s, self.bounds)
            have = np.diff(at, append=len(s)) > 0
            full[d] = have
            sig[d, have] = s[at[have]]
        d, i = np.nonzero(~full)
        t = 0
        while len(d):
            source = self.probes[t, i]
            hit = full[d, source]
            sig[d[hit], i[hit]] = sig[d[hit], source[hit]]
            d, i = d[~hit], i[~hit]
            t += 1
        return sig

    def buckets(self, sets: list[np.ndarray]) -> np.ndarray:
        """A 64-bit bucket key for each band; the band's number is part of it."""
        sig = self.signatures(sets).reshape(len(sets), self.bands, self.rows)
        return mix64((sig * self.factor).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * _ALONE)


def _set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identity of each set."""
    one = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([mix64(s ^ _ALONE).sum(dtype=np.uint64) for s in sets], np.uint64)
    return one, two


def sketch(docs: DataFrame, *, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, buckets (empty for an empty set): a row a document."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        signer = Signer(bands, rows)
        for batch in batches:
            for part in slices(batch.column(1)):
                sets = shingles(part.hashes(), part.word_at, shingle)
                size = np.array([len(s) for s in sets], np.int64)
                one, two = _set_ids(sets)
                filled = [s for s in sets if len(s)]
                keys = signer.buckets(filled) if filled else np.zeros((0, bands), np.uint64)
                ends = np.concatenate(([0], np.cumsum((size > 0) * bands))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(sets)),
                        pa.array(size),
                        pa.array(signed(one)),
                        pa.array(signed(two)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.ascontiguousarray(keys).ravel()))),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "buckets"],
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        tidy(run), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, buckets array<bigint>"
    )


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node (doc_id), set_a, n and set (shingle hashes)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch.column(1)):
                sets = shingles(part.hashes(), part.word_at, shingle)
                one, _ = _set_ids(sets)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(sets)),
                        pa.array(signed(one)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(flat))),
                    ],
                    ["node", "set_a", "n", "set"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "node bigint, set_a bigint, n bigint, set array<bigint>")


def star_pairs(members: DataFrame, stars: int) -> DataFrame:
    """(node, hub): each node of ``members`` (bucket, node, n: the bucket's size) with the hubs of
    most of its buckets."""
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    rays = members.join(hubs, "bucket").where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("shared"))
    # a node has as many hubs as bands at most
    best = F.slice(F.sort_array(F.collect_list(F.struct("shared", "hub")), asc=False), 1, stars)
    return rays.groupBy("node").agg(best.alias("best")).select("node", F.explode("best.hub").alias("hub"))


def _joined(roots: DataFrame, links: DataFrame, shelf: Shelf) -> DataFrame:
    """``roots`` (node, root) after ``links`` (a, b) have joined their components."""
    if links.isEmpty():
        return roots
    ends = (
        links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    )
    above = components(ends, shelf).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = above.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return shelf.put(every.union(fresh), "roots")


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 56, rows: int = 8, stars: int = 3
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``."""
    shelf = Shelf(docs.sparkSession, "minhash")
    drawn = shelf.put(sketch(docs, shingle=shingle, bands=bands, rows=rows), "sketch")
    repeated = _repeated_ids(drawn)
    known = drawn.where("doc_id is not null and n_shingles > 0")
    nodes = known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))
    drawn_nodes = shelf.put(known.select("doc_id", "set_a", "set_b").join(nodes, ["set_a", "set_b"]), "nodes")

    first = drawn_nodes.where("doc_id = node").select(F.col("doc_id").alias("node"), "set_a", "set_b").distinct()
    boxed = known.join(
        first.select("node", F.col("set_a").alias("sa"), F.col("set_b").alias("sb")),
        F.expr("doc_id = node and set_a = sa and set_b = sb"),
    ).select("node", F.explode("buckets").alias("bucket"))
    if repeated:
        boxed = boxed.distinct()
    shared = boxed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = shelf.put(boxed.join(shared, "bucket"), "members")
    asked = members.select("node").distinct().join(first, "node")
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = full_sets(texts.join(asked.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle)
    if repeated:  # of a node's rows, those that hold its set
        made = made.join(asked.select("node", "set_a"), ["node", "set_a"]).dropDuplicates(["node", "set_a"])
    sets = shelf.put(made, "sets")

    # none yet; not made of a list, which Spark would read through a Python worker in each task
    roots = docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))
    if repeated:  # rows of one doc_id with different sets: their nodes are one document
        ends = drawn_nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
        roots = _joined(roots, ends.where("a != b").select("a", "b"), shelf)
    roots = _joined(roots, shelf.put(_confirmed(star_pairs(members, stars), sets, percent), "stars"), shelf)

    roots = _decided(members, sets, roots, shelf, percent)
    found = drawn_nodes.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id"))
    return (
        drawn.select("doc_id", "n_shingles")
        .join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


#: How many pairs two components get by round; 0: all that bitmaps leave, after which nothing is open.
ROUNDS = (1, 8, 64, 0)


def _decided(members: DataFrame, sets: DataFrame, roots: DataFrame, shelf: Shelf, percent: int) -> DataFrame:
    """``roots`` after every pair of a bucket of ``members`` (bucket, node, n: the bucket's size) is in one component or known not to be similar."""
    key = ["bucket", "bi", "bj"]

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    rows = placed(members.select("bucket", "node", F.col("n").alias("size")))
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    blocks = shelf.put(parity.in_blocks(rows.join(mixed, "bucket")).drop("root"), "blocks")
    if blocks.isEmpty():
        return roots
    maps = shelf.put(parity.bitmaps(sets.join(blocks.select("node").distinct(), "node", "left_semi")), "bitmaps")
    rejected = None
    for tries in ROUNDS:
        asked = shelf.put(parity.forests(placed(blocks), maps, rejected, percent, tries), "asked")
        pairs = asked.select("node", "hub").distinct()
        links = shelf.put(_confirmed(pairs, sets, percent), "links")
        roots = _joined(roots, links, shelf)
        failed = asked.join(links.select(F.col("b").alias("node"), F.col("a").alias("hub")), ["node", "hub"], "left_anti").select(*key, "node", "hub")
        more = shelf.put(failed, "failed")
        if more.isEmpty():
            return roots
        rejected = more if rejected is None else rejected.union(more)
        # only blocks where a pair failed are asked again
        blocks = shelf.put(blocks.join(more.select(*key).distinct(), key, "left_semi"), "blocks")
        rejected = shelf.put(rejected.join(more.select(*key).distinct(), key, "left_semi"), "rejected")
    return roots


def _repeated_ids(drawn: DataFrame) -> bool:
    return not drawn.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough."""
    one = sets.select("node", F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("hub"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    return (
        pairs.join(one, "node")
        .join(two, "hub")
        .where(small * 100 >= large * percent)
        .withColumn("both", both)
        .where(F.col("both") * 100 >= (small + large - F.col("both")) * percent)
        .select(F.col("hub").alias("a"), F.col("node").alias("b"))
    )


#: All pairs by shared shingles, and the closure of their links; two-word shingles at 80 percent.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.doc_id, g, n FROM s JOIN n ON s.doc_id = n.doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM sn a JOIN sn b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c) UNION ALL SELECT y, x FROM p WHERE 100 * c >= 80 * (nx + ny - c)
), r AS (
  SELECT DISTINCT x AS doc_id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id
), m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
