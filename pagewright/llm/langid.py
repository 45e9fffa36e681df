"""Language ID (2): prediction by partial matching with frozen statistics.

For each language a context tree over bytes holds, for every context of 0 to ``order`` bytes,
the counts of the bytes that followed. A text's code length under a language is the sum over its
bytes of -log2 p, where p escapes from the longest known context to shorter ones (method C: the
escape has weight t of n + t, for t distinct bytes in n) and leaves out bytes that the longer
context knows, so each context's law sums to one. The trees stay as trained, so a byte's code
length depends on its last ``order`` + 1 bytes alone and each distinct such string is priced once.

Training reads a bounded, documented sample of labelled rows: about ``sample_chars`` characters a
language and ``total_chars`` in all, drawn by a hash of doc_id, whole texts. Scoring reads every whole text.

Null or letterless text: ``und`` with score 0. Texts start in a context of zero bytes. Ties go to
the language that sorts first. Languages are the non-null labels of training rows; with none,
every text is ``und``. Rows are scored one by one, so repeated rows and ids, and other columns,
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buffers, carry, fold_of, small_batches, tidy

SLOTS_LOG2 = 20
TRAIN_SLICE = 1 << 22


def grams(buf: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte, it and its ``order`` predecessors as one number, zeros before a text."""
    out = buf.astype(np.uint64)
    n = len(buf)
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    for k in range(1, order + 1):
        prev = np.zeros(n, np.uint64)
        prev[k:] = buf[: n - k]
        # the first k bytes of each text have no predecessor at distance k; in a text of fewer
        # bytes the edge falls into the next text, checked there by its own distance
        for j in range(k):
            edge = at + j
            prev[edge[edge < n]] = 0
        out |= prev << np.uint64(8 * k)
    return out


@dataclass
class Tree:
    """One language: sorted keys and log2 values for each level."""

    gram: list[np.ndarray] = field(default_factory=list)
    gram_log: list[np.ndarray] = field(default_factory=list)
    context: list[np.ndarray] = field(default_factory=list)
    escape_log: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def grown(keys: np.ndarray, counts: np.ndarray, order: int) -> Tree:
        tree = Tree()
        for k in range(order + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            g, back = np.unique(keys & mask, return_inverse=True)
            c = np.bincount(back, counts, len(g))
            ctx, where = np.unique(g >> np.uint64(8), return_inverse=True) if k else (np.zeros(1, np.uint64), np.zeros(len(g), int))
            # a context's bytes: the gram's last byte is its lowest, its context the rest
            n, t = np.bincount(where, c, len(ctx)), np.bincount(where, minlength=len(ctx))
            lower = 2.0 ** tree.logs(g & np.uint64((1 << (8 * k)) - 1) if k else g, k)
            known = np.minimum(np.bincount(where, lower, len(ctx)), 1 - 1e-9)
            tree.gram.append(g)
            tree.gram_log.append(np.log2(c / (n + t)[where]))
            tree.context.append(ctx)
            tree.escape_log.append(np.log2(t / (n + t)) - np.log2(1 - known))
        return tree

    def logs(self, keys: np.ndarray, levels: int) -> np.ndarray:
        """log2 p of each gram under the first ``levels`` levels."""
        out = np.full(len(keys), -8.0)
        for k in range(levels):
            if not len(self.gram[k]):
                continue
            key = keys & np.uint64((1 << (8 * (k + 1))) - 1)
            i = np.minimum(np.searchsorted(self.gram[k], key), len(self.gram[k]) - 1)
            hit = self.gram[k][i] == key
            ctx = key >> np.uint64(8) if k else np.zeros(len(key), np.uint64)
            j = np.minimum(np.searchsorted(self.context[k], ctx), len(self.context[k]) - 1)
            out = np.where(hit, self.gram_log[k][i], np.where(self.context[k][j] == ctx, out + self.escape_log[k][j], out))
        return out


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    order: int


class Pricer:
    """Code lengths of grams in every language, through a direct-mapped table."""

    def __init__(self, model: Model):
        self.model = model
        # 2**22 lengths at most, however many languages
        self.bits = max(8, SLOTS_LOG2 - max(0, (len(model.langs) - 1).bit_length() - 2))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros((1 << self.bits, len(model.langs)), np.float32)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        slot = ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != g)
        if len(miss):
            new, back = np.unique(g[miss], return_inverse=True)
            priced = np.stack([-t.logs(new, self.model.order + 1) for t in self.model.trees], axis=1).astype(np.float32)
            out[miss] = priced[back]
            at = slot[miss]
            self.keys[at] = g[miss]
            self.values[at] = priced[back]
        return out


def code_lengths(price: Pricer, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language; an empty text has 0."""
    out = np.zeros((len(offsets) - 1, len(price.model.langs)))
    filled = np.flatnonzero(offsets[:-1] < offsets[1:])
    if len(filled):
        bits = price(grams(buf, offsets, price.model.order))
        out[filled] = np.add.reduceat(bits, offsets[filled], axis=0, dtype=np.float64)
    return out


def pieces(column, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    buf, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        yield i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def train(labelled: DataFrame, *, order: int = 4, sample_chars: int = 2_000_000, total_chars: int = 32_000_000, seed: int = 11) -> Model:
    """Context trees from (doc_id, text, lang) rows; rows without text or lang are left out.

    ``sample_chars`` bounds the expected characters a language, ``total_chars`` those of all
    languages together, which share it evenly (one text may exceed either).
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    many = rows.select("lang").distinct().count()
    share = min(sample_chars, total_chars // max(1, many))
    rate = F.lit(float(share)) / F.greatest(F.col("chars"), F.lit(1))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(sizes), "lang").where(drawn < rate).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            langs = batch.column(0).to_pylist()
            found: dict[str, list[np.ndarray]] = {}
            for first, buf, offsets in pieces(batch.column(1)):
                g = grams(buf, offsets, order)
                for d in range(len(offsets) - 1):
                    found.setdefault(langs[first + d], []).append(g[offsets[d] : offsets[d + 1]])
            for lang, parts in found.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    table = (
        sample.mapInArrow(tidy(count), "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # distinct grams of the bounded sample
    )
    coded = table.column("lang").combine_chunks().dictionary_encode()
    named, lang_column = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    keys = table.column("gram").to_numpy().view(np.uint64) if table.num_rows else np.zeros(0, np.uint64)
    counts = table.column("n").to_numpy()
    langs = sorted(named)
    trees = []
    for lang in langs:
        mine = lang_column == named.index(lang)
        trees.append(Tree.grown(keys[mine], counts[mine].astype(np.float64), order))
    return Model(langs, trees, order)


def predict(docs: DataFrame, model: Model, *, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_columns`` with lang_pred, score (posterior, equal priors) and bits_per_byte."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # grams of the bounded sample
    id_columns, schema, k, at_text, carried = carry(docs, id_columns)
    letters_at = len(carried)
    told = docs.select(*carried, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))

    def run(batches):
        import pyarrow as pa

        model = shared.value
        price = Pricer(model)
        for batch in batches:
            letters = batch.column(letters_at).to_numpy(zero_copy_only=False).astype(bool)
            n = len(letters)
            name, score, rate = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            if model.langs:
                for first, buf, offsets in pieces(batch.column(at_text)):
                    bits = code_lengths(price, buf, offsets)
                    best = bits.argmin(axis=1)
                    gap = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
                    at = slice(first, first + len(best))
                    name[at] = np.array(model.langs, object)[best]
                    score[at] = 1 / gap.sum(axis=1)
                    rate[at] = bits.min(axis=1) / np.maximum(offsets[1:] - offsets[:-1], 1)
            name[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(k)], pa.array(name, pa.string()), pa.array(score), pa.array(rate)],
                [*id_columns, "lang_pred", "score", "bits_per_byte"],
            )

    return told.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, bits_per_byte double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold."""
    return docs.where(fold_of("doc_id") != 0)
