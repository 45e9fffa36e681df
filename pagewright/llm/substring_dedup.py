"""Substring dedup (3): documents as factors of an index of every document's blocks.

This is a relative Lempel-Ziv parse whose letters are blocks of text, not words: a longest match
over words would need the whole reference at hand in each task. A window is ``window`` consecutive
words. A word goes when a window that covers it has the words of a window that starts earlier
(smaller doc_id, or same document and earlier start).

*Reference index.* Every window chooses one phrase of ``phrase`` words in it, the leftmost of
least hash, so equal windows choose equal phrases at equal offsets. The windows that choose one
occurrence of a phrase are consecutive; together they are a *block* of text around it, and a
document is its sequence of blocks. The index holds, for each phrase, the blocks around it and
where each content stands first.

*Parse.* From left to right, a factor is as many blocks as stand in one source one after another
as they do here; it is (start, end, source, source start). A block that has no equal, but whose
phrase also stands in other blocks, is where factors may begin or end.

*Checks at factor boundaries.* Those blocks' windows are compared one by one, by a 128-bit
hash, and lengthen the factor they join, or are factors of their own. That is exact: the earliest
start of a window lies in the earliest block of its content, and equal windows choose equal phrases.
A factor is as long as a window or longer; its words go.

A task reports one block or window of a kind for each batch of documents, the earliest, so copies
meet as one row a batch, however many there are. Documents meet their spans by (doc_id, hash of
text). Rows with one doc_id are one document here (null: before all others); null texts have no
words; texts shorter than a window stay. Words keep their case; kept words are joined by one
space. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Poly, Shelf, mix64, signed, slices, small_batches, tidy

_PHRASE, _RUN, _RUN2 = Poly(303), Poly(404), Poly(505)
FIRST = -(1 << 63)


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least of every ``w`` consecutive values."""
    best = np.arange(len(values))
    size = 1
    while size < w:  # runs of `size` joined into runs of up to twice that
        step = min(size, w - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        size += step
    return best


def blocks(h: np.ndarray, word_at: np.ndarray, window: int, phrase: int):
    """(document, first window, windows, phrase hash, content hash) of each block of a slice."""
    empty = np.zeros(0, np.int64)
    n = len(h)
    if n < window:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    starts = np.arange(n - phrase + 1)
    phrases = mix64(_PHRASE.runs(_PHRASE.prefix(h), starts, starts + phrase))
    chosen = _least(phrases, window - phrase + 1)  # for each window start
    doc = np.searchsorted(word_at, np.arange(n), side="right") - 1
    begin = np.arange(len(chosen))
    inside = doc[begin] == doc[begin + window - 1]
    new = np.empty(len(chosen), bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    content = mix64(
        _RUN.runs(_RUN.prefix(h), first, stop - 1 + window)
        + (stop - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        + (chosen[first] - first).astype(np.uint64) * np.uint64(0xA5A3564E27F8862D)
    )
    return doc[first], first, stop - first, phrases[chosen[first]], content


def _batch_order(keys: list[np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, id and place; and which of the ordered rows is the first of its keys."""
    order = np.lexsort((at, ids, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


_SPAN = "key_a bigint, key_b bigint, id bigint, mark bigint, at bigint, n bigint"


def _spans(key_a, key_b, ids, marks, at, n):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.int64, copy=False) if x.dtype != np.uint64 else signed(x)) for x in (key_a, key_b, ids, marks, at, n)],
        ["key_a", "key_b", "id", "mark", "at", "n"],
    )


def _keyed(batch_rows: list[tuple[np.ndarray, ...]]):
    """Rows (key_a, key_b, id, mark, at, n): the first of each key in its order, and for the rest,
    which have an earlier equal in this very batch, n is negative: known repeats."""
    a, b, ids, marks, at, n = (np.concatenate(x) for x in zip(*batch_rows, strict=True))
    order, first = _batch_order([a, b], ids, at)
    a, b, ids, marks, at, n = (x[order] for x in (a, b, ids, marks, at, n))
    if len(a):
        # the same document and place again (a repeated row) is no earlier start
        head = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        equal = (ids == ids[head]) & (at == at[head])
        n = np.where(first | equal, n, -n)
    return _spans(a, b, ids, marks, at, n)


def repeated_spans(docs: DataFrame, shelf: Shelf, *, window: int, phrase: int) -> tuple[DataFrame, DataFrame]:
    """(text rows, spans): spans has id, mark, the word ranges [at, at + n) that go, and their first place."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text")
    )

    def parse(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for part in slices(batch.column(2)):
                d, first, n, p, c = blocks(part.hashes(), part.word_at, window, phrase)
                if len(d):
                    at = part.first + d
                    found.append((p, c, ids[at], marks[at], first - part.word_at[d], n))
            if found:
                yield _keyed(found)

    placed = rows.mapInArrow(tidy(parse), _SPAN)
    by_phrase, by_content = W.partitionBy("key_a"), W.partitionBy("key_a", "key_b")
    told = (
        placed.repartition("key_a")
        .withColumn("first", F.min(F.struct("id", "at")).over(by_content))
        .withColumn("kinds", F.min("key_b").over(by_phrase) != F.max("key_b").over(by_phrase))
        .select(
            "id", "mark", "at", "n", "first",
            ((F.col("n") < 0) | (F.struct("id", "at") > F.col("first"))).alias("gone"), "kinds",
        )
        .where("gone or kinds")
        .withColumn("n", F.abs("n"))
    )
    told = shelf.put(told, "blocks")
    whole = told.where("gone").select("id", "mark", "at", (F.col("n") + (window - 1)).alias("n"), "first")
    edges = told.where("not gone").groupBy("id", "mark").agg(F.collect_list(F.struct("at", "n")).alias("edges"))

    def compare(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = batch.column(3)
            flat = edges.flatten()
            owner = np.repeat(np.arange(len(edges)), np.diff(edges.offsets.to_numpy()))
            e_at, e_n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
            found = []
            for part in slices(batch.column(2)):
                h = part.hashes()
                one, two = _RUN.prefix(h), _RUN2.prefix(h)
                last = part.first + len(part.offsets) - 1
                mine = slice(*np.searchsorted(owner, [part.first, last]))
                n = e_n[mine]
                if not len(n):
                    continue
                d = np.repeat(owner[mine], n)
                at = np.repeat(e_at[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                s = part.word_at[d - part.first] + at
                a, b = _RUN.runs(one, s, s + window), _RUN2.runs(two, s, s + window)
                found.append((a, b, ids[d], marks[d], at, np.ones(len(d), np.int64)))
            if found:
                yield _keyed(found)

    bounded = rows.join(edges, ["id", "mark"]).select("id", "mark", "text", "edges")
    single = (
        bounded.mapInArrow(tidy(compare), _SPAN)
        .withColumn("first", F.min(F.struct("id", "at")).over(W.partitionBy("key_a", "key_b")))
        .where((F.col("n") < 0) | (F.struct("id", "at") > F.col("first")))
        .select("id", "mark", "at", F.lit(window).cast("bigint").alias("n"), "first")
    )
    return rows, whole.unionByName(single)


def dedup_substrings(docs: DataFrame, *, window: int = 20, phrase: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), spans (the words that went) and
    factors (each with its source: a doc_id and the word it starts at there): a row a document."""
    shelf = Shelf(docs.sparkSession, "substrings")
    rows, spans = repeated_spans(docs, shelf, window=window, phrase=phrase)
    spans = shelf.put(spans.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "n", F.col("first.id").alias("source"), F.col("first.at").alias("begin"))).alias("spans")), "spans")
    wanted = docs.select(
        "doc_id", F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text")
    ).join(spans, ["id", "mark"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            total, gone, texts, ranges, parsed = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                total.append(len(words))
                kept, at, out, factors = [], 0, [], []
                for x in sorted(spans or (), key=lambda s: (s["at"], -s["n"])):
                    a, b = x["at"], x["at"] + x["n"]
                    last = factors[-1] if factors else None
                    if last and a <= last["end"] and (x["source"], x["begin"] - a) == (last["source"], last["source_start"] - last["start"]):
                        last["end"] = max(b, last["end"])
                    else:
                        factors.append({"start": a, "end": b, "source": x["source"], "source_start": x["begin"]})
                    if out and a <= out[-1]["end"]:
                        out[-1]["end"] = max(b, out[-1]["end"])
                    else:
                        out.append({"start": a, "end": b})
                for x in out:
                    kept += words[at : x["start"]]
                    at = x["end"]
                kept += words[at:]
                gone.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode())
                ranges.append(out)
                parsed.append([f | {"source": None if f["source"] == FIRST else f["source"]} for f in factors])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()),
                 pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(parsed, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "source", "source_start")])))],
                ["doc_id", "n_words", "n_removed", "text", "spans", "factors"],
            )

    return wanted.mapInArrow(tidy(cut), "doc_id bigint, n_words bigint, n_removed bigint, text string, spans array<struct<start: bigint, end: bigint>>, factors array<struct<start: bigint, end: bigint, source: bigint, source_start: bigint>>")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), e AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS k, unnest([array_to_string(w[i:i + 19], ' ') FOR i IN range(1, len(w) - 18)]) AS t
  FROM d WHERE len(w) >= 20
), r AS (
  SELECT doc_id, k FROM e QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, k) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)], ' ') END) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
