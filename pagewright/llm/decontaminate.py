"""Benchmark decontamination (6): a positional inverted index of all document words, searched for test windows.

*Index.* Documents go into segments of about 256 KB, each made whole by one task: its distinct words
(by 96 bits of two hashes, sorted), every word's ascending positions, where documents begin, and the
carried columns as stored fields. Segments are rows of a table in the shared folder, so the index is
spread as its documents are, nothing is shuffled, and no word, source or group of copies is hot.
*Search.* In each segment a window's words are looked up and its rarest one gives its starts:
that list, moved by the word's offset, is intersected with the next rarest word's list moved by
its own, and so on. What is left in one document is an exact phrase. ``proximity_matches`` looks
for all words of a query within a distance, from the rarest.

Test items come to the tasks in blocks of at most ``block_words`` words and ``block_bytes`` bytes, the
size bound of each broadcast. Further blocks search the same index and store only hits; texts are
read once.

Words are maximal runs of [0-9a-z] and non-ASCII characters after A-Z is lower-cased. A window is
``n`` consecutive item words, or the whole of a shorter item; items without words are ignored.
Null texts have no words. Rows are judged one by one, so repeated rows, ids and other columns
play no part; no benchmark or an empty table gives no hits. Repeated items each count. Items
without an id count as hits too and are one null, the last, among a document's items.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, Shelf, Slice, carry, hash_words, slices, small_batches, tidy

GAPS = np.ones(256, bool)
GAPS[0x30:0x3A] = GAPS[0x61:0x7B] = GAPS[0x80:] = False
_TABLE = bytes(0x20 if GAPS[LOWER[b]] else int(LOWER[b]) for b in range(256))
_EXPAND = 2_000_000
SEGMENT_BYTES = 1 << 18
#: Segments of a row group of the index: about 5 MB, which a task holds while it writes or reads.
GROUP_SEGMENTS = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _in_order(items: set[int | None]) -> list[int | None]:
    """Ascending, a null last."""
    return sorted(items, key=lambda x: (x is None, x or 0))


class Windows:
    """Distinct windows of a block of items: numbers of their words, padded with -1, and the items of each."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], n: int):
        seen: dict[tuple[bytes, ...], set[int | None]] = {}
        for item, words in items:
            for i in range(max(1, len(words) - n + 1)):
                seen.setdefault(tuple(words[i : i + n]), set()).add(item)
        self.items = list(map(_in_order, seen.values()))
        vocabulary = sorted({w for t in seen for w in t})
        number = {w: k for k, w in enumerate(vocabulary)}
        joined = np.frombuffer(b"".join(vocabulary), np.uint8)
        at = np.cumsum([0, *map(len, vocabulary)]).astype(np.int64)
        self.one, two = (hash_words(joined, at[:-1], at[1:], second) for second in (False, True))
        self.two = (two & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.size = np.array([len(t) for t in seen], np.int64)
        self.terms = np.full((len(seen), n), -1, np.int64)
        for k, t in enumerate(seen):
            self.terms[k, : len(t)] = [number[w] for w in t]


class Segment:
    """Postings of some documents: distinct words by their hashes, and each one's positions, ascending."""

    def __init__(self, one: np.ndarray, two: np.ndarray, first: np.ndarray, positions: np.ndarray, word_at: np.ndarray):
        self.one, self.two, self.first, self.positions, self.word_at = one, two, first, positions, word_at
        #: word and position in one number: ascending, so any list can be asked for any position
        self.key = np.repeat(np.arange(len(one), dtype=np.int64) << 32, np.diff(first)) | positions

    @staticmethod
    def of(part: Slice) -> Segment:
        h, g = part.hashes(), part.hashes(second=True) & np.uint64(0xFFFFFFFF)
        order = np.lexsort((g, h)).astype(np.int64)  # stable, so positions of a word ascend
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:].astype(np.uint32) != g[:-1].astype(np.uint32))
        at = np.flatnonzero(new)
        return Segment(h[at], g[at].astype(np.uint32), np.append(at, len(h)), order, part.word_at)

    def stored(self) -> list[bytes]:
        """Hashes, counts in place of ends, positions in three bytes while they fit, and documents."""
        positions = self.positions.astype("<u4").view(np.uint8).reshape(-1, 4)
        if len(positions) < 1 << 24:
            positions = positions[:, :3]
        return [self.one.tobytes(), self.two.tobytes(), np.diff(self.first).astype("<u4").tobytes(), positions.tobytes(), self.word_at.astype("<i4").tobytes()]

    @staticmethod
    def loaded(parts: list[bytes]) -> Segment:
        one, two, count = np.frombuffer(parts[0], np.uint64), np.frombuffer(parts[1], np.uint32), np.frombuffer(parts[2], "<u4")
        first = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        wide = np.zeros((int(first[-1]), 4), np.uint8)
        size = len(parts[3]) // len(wide) if len(wide) else 4
        wide[:, :size] = np.frombuffer(parts[3], np.uint8).reshape(-1, size)
        return Segment(one, two, first, wide.view("<u4").ravel().astype(np.int64), np.frombuffer(parts[4], "<i4").astype(np.int64))

    def numbers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The segment's number of each asked word, -1 for words that it lacks."""
        out = np.full(len(one), -1, np.int64)
        if not len(self.one):
            return out
        at = np.searchsorted(self.one, one)
        todo = np.arange(len(one))
        while len(todo):  # past words that share the first hash
            todo = todo[at[todo] < len(self.one)]
            todo = todo[self.one[at[todo]] == one[todo]]
            same = self.two[at[todo]] == two[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
        return out

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term + 1]]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.word_at, at, side="right") - 1

    def phrases(self, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of every exact occurrence."""
        found = self.numbers(windows.one, windows.two)
        terms = np.where(windows.terms >= 0, found[windows.terms], -2)  # -1: a word that is not here; -2: none
        live = np.flatnonzero(~(terms == -1).any(axis=1))
        terms = terms[live]
        count = np.where(terms >= 0, np.diff(self.first)[np.maximum(terms, 0)], np.int64(1) << 40)
        rarity = np.argsort(count, axis=1, kind="stable")  # of each window, its words from the rarest
        n = count[np.arange(len(live)), rarity[:, 0]] if len(live) else np.zeros(0, np.int64)
        ends, a = np.cumsum(n), 0
        while a < len(live):  # windows whose rarest word is frequent are taken a few at a time
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + _EXPAND, side="right")))
            yield self._intersected(windows, live[a:b], terms[a:b], rarity[a:b], n[a:b])
            a = b

    def _intersected(self, windows: Windows, chosen: np.ndarray, terms: np.ndarray, rarity: np.ndarray, n: np.ndarray):
        w = np.repeat(np.arange(len(chosen)), n)
        within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        rarest = rarity[:, 0]
        start = self.positions[np.repeat(self.first[terms[np.arange(len(chosen)), rarest]], n) + within] - rarest[w]
        size = windows.size[chosen]
        for r in range(1, terms.shape[1]):
            offset = rarity[w, r]
            term = terms[w, offset]
            asked = term << 32 | (start + offset)
            at = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
            ok = (start >= 0) & ((term < 0) | (self.key[at] == asked))
            w, start = w[ok], start[ok]
            if not len(w):
                break
        ok = (start >= 0) & (start + size[w] <= len(self.positions))
        w, start = w[ok], start[ok]
        ok = self.document(start) == self.document(start + size[w] - 1)
        return chosen[w[ok]], start[ok]

    def proximities(self, terms: list[int], within: int) -> Iterator[tuple[int, int]]:
        """(document, first position) of each place where all terms lie in ``within`` words."""
        lists = sorted((self.postings(t) for t in set(terms)), key=len) if min(terms, default=-1) >= 0 else []
        if not lists or not len(lists[0]):
            return
        for p in lists[0]:  # from the rarest term
            d = int(self.document(p))
            near = []
            for other in lists[1:]:
                x = other[np.searchsorted(other, p - within + 1) : np.searchsorted(other, p + within)]
                near.append(x[self.document(x) == d])
            for left in range(max(p - within + 1, self.word_at[d]), p + 1):
                if all(((x >= left) & (x < left + within)).any() for x in near):
                    held = [p, *[x[(x >= left) & (x < left + within)].min() for x in near]]
                    yield d, int(min(held) - self.word_at[d])
                    break


def item_blocks(benchmark: DataFrame, block_words: int, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks; an item over either bound is a block of its own."""
    block, held, size = [], 0, 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        more = sum(map(len, words))
        if block and (held + len(words) > block_words or size + more > block_bytes):
            yield block
            block, held, size = [], 0, 0
        block.append((row["item_id"], words))
        held, size = held + len(words), size + more
    if block:
        yield block


_SPANS = "array<struct<start: bigint, end: bigint>>"
_PARTS = ("one", "two", "first", "positions", "word_at")
_HITS = f"segment bigint, document int, spans {_SPANS}, item_ids array<bigint>"


def build_index(docs: DataFrame, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The index of ``docs``: a row a segment, with the carried columns of its documents as ``docs``."""
    small_batches(docs.sparkSession)
    id_columns, kinds, k, at_text, carried = carry(docs, id_columns)
    schema = f"segment bigint, docs array<struct<{kinds}>>, " + ", ".join(f"{c} binary" for c in _PARTS)

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            held = pa.StructArray.from_arrays([batch.column(i) for i in range(k)], names=list(id_columns))
            for part in slices(batch.column(at_text), lower=True, limit=SEGMENT_BYTES, gaps=GAPS):
                n = len(part.offsets) - 1
                rows = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held.slice(part.first, n))
                number = int.from_bytes(os.urandom(8)) >> 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), rows, *[pa.array([x], pa.binary()) for x in Segment.of(part).stored()]], ["segment", "docs", *_PARTS]
                )

    return docs.select(*carried).mapInArrow(tidy(run), schema)


def _found(segment: Segment, windows: Windows) -> dict[int, tuple[list[tuple[int, int]], set]]:
    """Of each document with hits: its hit ranges and items."""
    out: dict[int, tuple[list, set]] = {}
    for w, start in segment.phrases(windows):
        document = segment.document(start)
        left = start - segment.word_at[document]
        for a, d, x in zip(w.tolist(), document.tolist(), left.tolist(), strict=True):
            got = out.setdefault(d, ([], set()))
            got[0].append((x, x + int(windows.size[a])))
            got[1].update(windows.items[a])
    return out


def _segments(batch, at: int) -> Iterator[tuple[int, Segment]]:
    for k in range(len(batch)):
        yield k, Segment.loaded([batch.column(at + i)[k].as_py() for i in range(len(_PARTS))])


def find_hits(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 13, block_words: int = 1_000_000, block_bytes: int = 16 << 20, id_columns: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``id_columns``, n_words, spans (hit words as merged [start, end)), item_ids: a row a document."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "hits")
    id_columns, kinds, _, _, _ = carry(docs, id_columns)
    out = f"{kinds}, n_words bigint, spans {_SPANS}, item_ids array<bigint>"
    index = shelf.put(build_index(docs, id_columns), "index", group_rows=GROUP_SEGMENTS)
    blocks = item_blocks(benchmark, block_words, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:  # one block, as a rule: search and rows in one pass
        shared = spark.sparkContext.broadcast(Windows(first, n)) if first else None
        return index.select("docs", *_PARTS).mapInArrow(tidy(_rows_of(shared)), out)
    hits = None
    for block in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(Windows(block, n))
        told = shelf.put(index.select("segment", *_PARTS).mapInArrow(tidy(_hits_of(shared)), _HITS), "hits")
        shared.destroy()
        hits = told if hits is None else hits.unionByName(told)
    by_segment = hits.groupBy("segment").agg(F.collect_list(F.struct("document", "spans", "item_ids")).alias("hits"))
    return index.join(by_segment, "segment", "left").select("docs", *_PARTS, "hits").mapInArrow(tidy(_rows_of(None)), out)


def _hits_of(shared):
    def run(batches):
        import pyarrow as pa

        windows = shared.value
        for batch in batches:
            rows = [
                (batch.column(0)[k].as_py(), d, merged(spans), _in_order(items))
                for k, segment in _segments(batch, 1)
                for d, (spans, items) in _found(segment, windows).items()
            ]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["segment", "document", "spans", "item_ids"])

    return run


def _rows_of(shared):
    """A row a document of each segment, with the hits of the block, or those that came along."""

    def run(batches):
        import pyarrow as pa

        windows = shared.value if shared else None
        spans_type, items_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())
        for batch in batches:
            for k, segment in _segments(batch, 1):
                held = batch.column(0).slice(k, 1).flatten()
                found = _found(segment, windows) if windows else {}
                if batch.num_columns > 1 + len(_PARTS):
                    for hit in batch.column(1 + len(_PARTS))[k].as_py() or ():
                        got = found.setdefault(hit["document"], ([], set()))
                        got[0].extend((x["start"], x["end"]) for x in hit["spans"])
                        got[1].update(hit["item_ids"])
                none: tuple[list, set] = ([], set())
                every = [found.get(d, none) for d in range(len(held))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *held.flatten(), pa.array(np.diff(segment.word_at)), pa.array([merged(s) for s, _ in every], spans_type),
                        pa.array([_in_order(i) for _, i in every], items_type),
                    ],
                    [*[f.name for f in held.type], "n_words", "spans", "item_ids"],
                )

    return run


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def hit_words():
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])


def contaminated(share: int = 20):
    """At least one hit word, and one word in ``share`` or more."""
    return (hit_words() > 0) & (hit_words() * share >= F.col("n_words"))


def proximity_matches(docs: DataFrame, query: str, within: int) -> DataFrame:
    """(doc_id, at) of places where all of the query's words lie within ``within`` words."""
    words = sorted(set(words_of(query)))
    windows = Windows([(0, words)], max(1, len(words))) if words else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, segment in _segments(batch, 1):
                held = batch.column(0).slice(k, 1).flatten()
                found = list(segment.proximities(segment.numbers(windows.one, windows.two).tolist(), within)) if windows else []
                ids, at = [d for d, _ in found], [x for _, x in found]
                yield pa.RecordBatch.from_arrays([held.field("doc_id").take(pa.array(ids, pa.int64())), pa.array(at, pa.int64())], ["doc_id", "at"])

    index = Shelf(docs.sparkSession, "proximity").put(build_index(docs), "index", group_rows=GROUP_SEGMENTS)
    return index.select("docs", *_PARTS).mapInArrow(tidy(run), "doc_id bigint, at bigint")


SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, unnest([array_to_string(w[k:k + 12], ' ') FOR k IN range(1, greatest(2, len(w) - 11))]) AS t, least(13, len(w)) AS n
  FROM i WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, unnest([array_to_string(w[k:k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)]) AS t
  FROM d, sizes WHERE len(w) >= n
), hits AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
