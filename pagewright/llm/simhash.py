"""SimHash near-dedup (13): fingerprints, and their neighbours by bit-sliced comparison.

*Fingerprint.* The text's words (runs of bytes that are not white space) make ``shingle``-word
shingles, repeats included, joined by one space; fewer words are one shingle. Each has its XXH64
(UTF-8, seed 42); a bit is 1 where over half of these have it. No words: zero.
*Candidates.* Equal fingerprints are one node. Two fingerprints within ``radius`` bits agree on two at
least of ``radius + 2`` blocks of bits, so nodes meet by each pair of blocks (a mask, and the bits
under it). Nodes of a bucket of more than ``most`` go on to smaller buckets: the bits that are not
shared yet are cut into blocks again, and a pair still agrees on two of them. The last of ``LEVELS``
levels takes buckets of any size; with 64 bits and radius 2 they share 56 bits and hold 256 nodes at most.
*Comparison.* A task's sorted nodes are stored vertically, a row of machine words for each bit: lane i
of word w is node 64 w + i. A node is compared with 64 later lanes at once: each plane XORed with its
bit adds one to vertical counters by carries, and a (node, word) block is dropped once all its lanes exceed
the radius. Links within a task's bucket leave as a tree: (node, root), fewer rows than nodes.
*Components* of these by alternating stars; component_id is the least doc_id of the component's rows.

Null and wordless texts have fingerprint zero and are linked like any other. Rows count one by one:
rows that share a doc_id have their own fingerprints. A null doc_id is no component's least, so rows
linked with null doc_ids alone get null. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, signed, slices, small_batches, tidy
from .graph import components

#: Of a shingle's hash.
SEED = 42
LEVELS = 3
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_ZERO = np.uint64(0)


# ---------------------------------------------------------------- fingerprints
def _joined(part) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A slice's bytes with one space between the words of a document, and the words' places in it."""
    last = np.zeros(len(part.start), bool)
    ends = part.word_at[1:] - 1
    last[ends[ends >= part.word_at[:-1]]] = True
    step = np.zeros(len(part.buf) + 1, np.int32)
    np.add.at(step, part.start, 1)
    np.add.at(step, part.end, -1)
    keep = np.cumsum(step[:-1]) > 0
    gap = part.end[~last]
    keep[gap] = True
    buf = part.buf.copy()
    buf[gap] = 0x20
    at = np.cumsum(keep) - 1
    return buf[keep].tobytes(), at[part.start], at[part.end - 1] + 1


def fingerprints_of(part, shingle: int, rows: int = 1 << 15) -> np.ndarray:
    """The fingerprint of each document of a slice."""
    import xxhash

    told, start, end = _joined(part)
    first, words = part.word_at[:-1], np.diff(part.word_at)
    number = np.where(words >= shingle, words - shingle + 1, (words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(number)), number)
    begins = np.cumsum(number) - number
    word = np.arange(len(doc)) - begins[doc] + first[doc]
    until = word + np.minimum(shingle, words[doc]) - 1
    counts = np.zeros((len(number), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(doc), rows):
        d = doc[i : i + rows]
        hashes = [digest(told[a:b], SEED) for a, b in zip(start[word[i : i + rows]].tolist(), end[until[i : i + rows]].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.diff(d, prepend=-1))
        counts[d[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    return ((2 * counts > number[:, None]) * _BIT).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): a row for each row of ``docs``; A-Z count as a-z."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch.column(1), lower=True):
                fp = fingerprints_of(part, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(fp)), pa.array(signed(fp))], ["doc_id", "fp"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- bit-sliced comparison
def planes_of(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit b of node 64 w + i is bit i of planes[b, w]."""
    full = np.zeros(-(-len(fp) // 64) * 64, "<u8")
    full[: len(fp)] = fp
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is over the radius."""
    over, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            over |= same & counters[k]
            same &= ~counters[k]
    return over


def near_lanes(fp: np.ndarray, planes: np.ndarray, node: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, other lane) within the radius, for blocks (node, word) and the ``lanes`` of each that count."""
    over = ~lanes
    counters = [np.zeros_like(over) for _ in range(radius.bit_length())]
    mine = fp[node]
    for b in range(64):
        carry = planes[b][word] ^ (_ZERO - (mine >> np.uint64(b) & np.uint64(1)))
        for c in counters:
            up = c & carry
            c ^= carry
            carry = up
        over |= carry
        if b % 8 == 7:
            if counters:
                over |= _above(counters, radius)
            alive = over != _ALL
            if not alive.all():  # blocks whose lanes all exceed the radius are done
                node, word, over, mine = node[alive], word[alive], over[alive], mine[alive]
                counters = [c[alive] for c in counters]
                if not len(node):
                    break
    hit = np.flatnonzero(np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little"))
    return node[hit >> 6], word[hit >> 6] * 64 + (hit & 63)


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of ``root`` (each lane's least known lane) along links, in place."""
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            return
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def linked(fp: np.ndarray, until: np.ndarray, radius: int, blocks: int = 1 << 15) -> np.ndarray:
    """For each node its tree's root, where nodes i and j > i are compared if j < until[i]."""
    root = np.arange(len(fp))
    planes = planes_of(fp)
    node = np.flatnonzero(until > np.arange(len(fp)) + 1)
    low, high = (node + 1) >> 6, (until[node] - 1) >> 6
    number = high - low + 1
    done = np.concatenate(([0], np.cumsum(number)))
    i = 0
    while i < len(node):
        j = max(i + 1, int(np.searchsorted(done, done[i] + blocks, side="right")) - 1)
        q = np.repeat(node[i:j], number[i:j])
        w = np.arange(done[j] - done[i]) - np.repeat(done[i:j] - done[i], number[i:j]) + np.repeat(low[i:j], number[i:j])
        from_, to = np.clip(q + 1 - w * 64, 0, 63).astype(np.uint64), until[q] - w * 64
        lanes = _ALL << from_
        lanes &= np.where(to < 64, (np.uint64(1) << np.clip(to, 0, 63).astype(np.uint64)) - np.uint64(1), _ALL)
        _roots(root, *near_lanes(fp, planes, q, w, lanes, radius))
        i = j
    return root


def blocks_of(mask: int, number: int) -> list[int]:
    """The bits that a mask lacks, as ``number`` masks of neighbouring bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // number for k in range(number + 1)]
    return [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def finer(mask: int, radius: int) -> list[int]:
    """Masks of which nodes within the radius that agree under ``mask`` share at least one."""
    return [mask | x | y for x, y in combinations(blocks_of(mask, radius + 2), 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def tree_edges(buckets: DataFrame, radius: int, rows: int = 1 << 15) -> DataFrame:
    """(a, b) of linked nodes of ``buckets`` (mask, key, fp), a tree for each bucket's linked nodes."""

    def run(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def flush(table: np.ndarray):
            starts = np.flatnonzero(np.concatenate(([True], (table[1:, :2] != table[:-1, :2]).any(axis=1))))
            until = np.repeat(np.append(starts[1:], len(table)), np.diff(np.append(starts, len(table))))
            fp = np.ascontiguousarray(table[:, 2]).view(np.uint64)
            root = linked(fp, until, radius)
            out = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(table[out, 2]), pa.array(table[root[out], 2])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            if sum(map(len, held)) < rows:
                continue
            table = np.concatenate(held)
            # the last bucket may go on
            cut = np.flatnonzero((table[:, :2] != table[-1, :2]).any(axis=1))
            cut = cut[-1] + 1 if len(cut) else 0
            held = [table[cut:]]
            if cut:
                yield flush(table[:cut])
        if held:
            yield flush(np.concatenate(held))

    ordered = buckets.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return ordered.mapInArrow(tidy(run), "a bigint, b bigint")


def near_fingerprints(nodes: DataFrame, shelf: Shelf, *, radius: int = 2, most: int = 1024) -> DataFrame:
    """(a, b): links that join the distinct fingerprints ``nodes`` (fp) within the radius into their components."""
    masks, found = finer(0, radius), None
    now = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])).alias("mask"))
    for level in range(1, LEVELS + 1):
        now = now.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        small = now
        if level < LEVELS:
            sizes = now.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("mask", "key")
            large = shelf.put(sizes, f"large{level}")
            last = large.isEmpty()
            if not last:
                small = now.join(large, ["mask", "key"], "left_anti")
        edges = tree_edges(small, radius)
        found = edges if found is None else found.union(edges)
        if level == LEVELS or last:
            break
        children = {m: finer(m, radius) for m in masks}
        told = nodes.sparkSession.createDataFrame([(_signed(m), _signed(c)) for m in children for c in children[m]], "mask bigint, child bigint")
        held = now.join(large, ["mask", "key"], "left_semi")
        now = held.join(F.broadcast(told), "mask").select("fp", F.col("child").alias("mask")).distinct()
        masks = sorted({c for own in children.values() for c in own})
    return found


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2, most: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row for each row of ``docs``."""
    shelf = Shelf(docs.sparkSession, "simhash")
    drawn = shelf.put(fingerprints(docs, shingle=shingle), "drawn")
    nodes = shelf.put(drawn.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = near_fingerprints(nodes.select("fp"), shelf, radius=radius, most=most)
    roots = shelf.put(components(edges, shelf), "roots").withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return drawn.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
