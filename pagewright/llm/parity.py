"""Pairs of a bucket decided by parity bitmaps: which of its texts may be similar, without making the other pairs.

A set's bitmap has a bit for each residue of its elements' hashes: the parity of how many elements have it. The
XOR of two bitmaps is the bitmap of the symmetric difference, since what both sets hold cancels; its ones are
at most as many as that difference has elements. A similarity of ``percent`` allows a difference of
(100 - percent) / (100 + percent) of the summed sizes, so a pair whose XOR has more ones is not similar, for
certain. Texts of one template share most of their elements, and only what they vary is left to count.

A task compares bitmaps of up to ``BLOCK`` nodes of a bucket with as many others; larger buckets are cut into blocks,
and tasks take pairs of blocks. What leaves is a forest: of the pairs that may be similar, the closest
ones that join components not joined yet. If all of these prove similar on full sets, the bucket is done; if
some do not, their buckets are asked again without them, for more pairs of each two components, and at last for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, tidy

BLOCK = 2048
#: Bits of a bitmap: as many as elements, and this at least; the first look folds them to ``FIRST``.
LEAST, FIRST = 2048, 512
_MAP = "node bigint, n bigint, bits binary"


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of 64-bit hashes, as machine words."""
    size = max(LEAST, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def bitmaps(sets: DataFrame) -> DataFrame:
    """node, n, bits of ``sets`` (node, n, set)."""
    small_batches(sets.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            made = [bits_of(flat[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["node", "n", "bits"])

    return sets.select("node", "n", "set").mapInArrow(tidy(run), _MAP)


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of more words as bitmaps of ``words``: residues of a smaller modulus."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


class Group:
    """Nodes of a block, or of two blocks whose nodes are compared across."""

    def __init__(self, node: np.ndarray, root: np.ndarray, n: np.ndarray, bits: list[bytes], side: np.ndarray, percent: int):
        order = np.lexsort((node, n))  # by size, so that those near in size stand together
        self.node, self.root, self.n, self.side, self.percent = node[order], root[order], n[order], side[order], percent
        self.raw = [np.frombuffer(bits[k], "<u8") for k in order.tolist()]
        self.words = np.array([len(r) for r in self.raw])
        self.folds: dict[int, np.ndarray] = {}

    def fold(self, words: int) -> np.ndarray:
        """The bitmaps of ``words`` by node; zeros where a node has fewer."""
        if words not in self.folds:
            held = np.zeros((len(self.raw), words), np.uint64)
            for k in np.flatnonzero(self.words >= words).tolist():
                held[k] = folded(self.raw[k][None], words)[0]
            self.folds[words] = held
        return self.folds[words]

    def _most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The greatest difference of two similar sets of these sizes."""
        return (self.n[a] + self.n[b]) * (100 - self.percent) // (100 + self.percent)

    def _left(self, q: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, ones) of pairs of ``q`` with later nodes of other trees that the bitmaps leave."""
        # sizes rise: only up to where the greater size still fits the least of these
        end = int(np.searchsorted(self.n * self.percent, self.n[q[-1]] * 100, side="right"))
        other = np.arange(q[0] + 1, max(q[0] + 1, end))
        fits = (other[None] > q[:, None]) & (tree[q][:, None] != tree[other][None]) & (self.n[other][None] * self.percent <= self.n[q][:, None] * 100)
        if self.side.min() != self.side.max():
            fits &= self.side[q][:, None] != self.side[other][None]
        some = np.flatnonzero(fits.any(axis=0))  # columns that are asked at all
        if not len(some):
            return (np.zeros(0, np.int64),) * 3
        first = self.fold(FIRST // 64)
        ones = np.bitwise_count(first[q][:, None] ^ first[other[some]][None]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(fits[:, some] & (ones <= self._most(q[:, None], other[some][None])))
        a, b, ones = q[i], other[some[j]], ones[i, j]
        full = np.minimum(self.words[a], self.words[b])
        for words in np.unique(full[full > FIRST // 64]).tolist():
            pairs, bits = np.flatnonzero(full == words), self.fold(words)
            for k in range(0, len(pairs), 4096):
                s = pairs[k : k + 4096]
                ones[s] = np.bitwise_count(bits[a[s]] ^ bits[b[s]]).sum(axis=1, dtype=np.int64)
        left = ones <= self._most(a, b)
        return a[left], b[left], ones[left]

    def forest(self, rejected: set[tuple[int, int]], tries: int, rows: int = 32) -> list[tuple[int, int]]:
        """Pairs of nodes that may be similar, closest first, until two components have ``tries`` of them: then they count as
        one. 0: all such pairs."""
        _, tree = np.unique(self.root, return_inverse=True)
        up = np.arange(tree.max() + 1)
        asked: dict[tuple[int, int], int] = {}
        out = []

        def top(t: int) -> int:
            while up[t] != t:
                up[t] = t = up[up[t]]
            return t

        for at in range(0, len(self.node), rows):
            while (up[up] != up).any():
                up = up[up]
            a, b, ones = self._left(np.arange(at, min(at + rows, len(self.node))), up[tree])
            for k in np.argsort(ones, kind="stable").tolist():
                s, t = top(int(tree[a[k]])), top(int(tree[b[k]]))
                x, y = int(self.node[a[k]]), int(self.node[b[k]])
                pair = (min(x, y), max(x, y))
                if s == t or pair in rejected:
                    continue
                out.append(pair)
                if tries:
                    key = (min(s, t), max(s, t))
                    asked[key] = asked.get(key, 0) + 1
                    if asked[key] >= tries:
                        up[key[1]] = key[0]
        return out


def in_blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``placed`` (bucket, node, root, size: of the bucket) with bi, bj (the blocks that meet) and side (the node's)."""
    many = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = placed.withColumn("side", F.pmod(F.xxhash64("node"), many).cast("int"))
    other = F.explode(F.sequence(F.lit(0), many - 1))
    met = own.withColumn("other", other)
    return met.select("bucket", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "node", "root", "side")


def forests(blocks: DataFrame, maps: DataFrame, rejected: DataFrame | None, percent: int, tries: int) -> DataFrame:
    """(bucket, bi, bj, node, hub): pairs to confirm, for the rows of ``in_blocks`` and ``bitmaps``; ``rejected``: of that form, not similar."""
    key = ["bucket", "bi", "bj"]
    rows = blocks.join(maps, "node").select(*key, F.lit(0).alias("kind"), "node", "root", "side", "n", "bits")
    if rejected is not None:
        rows = rows.union(rejected.select(*key, F.lit(1).alias("kind"), "node", F.col("hub").alias("root"), F.lit(0), F.lit(0).cast("bigint"), F.lit(None).cast("binary")))

    def run(batches):
        import pyarrow as pa

        def told(held: list) -> Iterator:
            table = pa.Table.from_batches(held)
            at = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]).any(axis=1), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                kind = part.column(3).to_numpy()
                nodes = int((kind == 0).sum())
                if nodes < 2:
                    continue
                node, root, side, n = (part.column(k).to_numpy() for k in (4, 5, 6, 7))
                no = set(zip(node[nodes:].tolist(), root[nodes:].tolist(), strict=True))
                found = Group(node[:nodes], root[:nodes], n[:nodes], part.column(8).slice(0, nodes).to_pylist(), side[:nodes], percent).forest(no, tries)
                if found:
                    x, y = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(x), t) for v, t in zip(at[a].tolist(), (pa.int64(), pa.int32(), pa.int32()), strict=True)] + [pa.array(x, pa.int64()), pa.array(y, pa.int64())], [*key, "node", "hub"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 2 * BLOCK:
                continue
            # the last group may go on
            table = pa.Table.from_batches(held).combine_chunks()
            at = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
            cut = np.flatnonzero((at != at[-1]).any(axis=1))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield from told(table.slice(0, cut).to_batches())
            held = table.slice(cut).to_batches()
            size = table.num_rows - cut
        if held:
            yield from told(held)

    small_batches(blocks.sparkSession)
    # as many tasks as the session's shuffles have: comparing costs more than the few bytes let the optimiser expect
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, *key).sortWithinPartitions(*key, "kind", "node")
    return ordered.mapInArrow(tidy(run), "bucket bigint, bi int, bj int, node bigint, hub bigint")
