"""LM scoring (4): a hidden Markov language model trained by Baum-Welch.

*Words.* Tokens are the lower-cased words of a text and one end. Counts of all training tokens
are gathered over the whole corpus. The ``head`` most frequent words (ties: smaller string) are
symbols of their own; all others, unknown words too, share one symbol and have, within it, the
probability (c + 0.5) / (N_rare + 0.5 * (V_rare + 1)).
*Training.* States start from clusters of frequent words by neighbourhood. In each Baum-Welch
round every task runs forward and backward over all training texts that it reads (stretches of
``STRETCH`` tokens; a later stretch starts in the stationary law) and returns expected counts,
which Spark sums across tasks. The driver holds ``head`` x ``states`` numbers, never text.
*Scores.* The scaled forward recursion over the whole text gives the exact log10 likelihood of its
symbols; rare words add their log10 probability within their symbol. Counts of rare words reach
texts by a join; no rare word is frequent, so no key is hot.

Null text is the empty text: its end alone is scored. Rows are told apart by a number given when
they are encoded, so repeated rows and ids are scored one by one. Without training rows all
counts are 0 and every base score is 0. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, fold_of, small_batches, tidy

STRETCH = 256
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FLUSH = 300_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_TABLE).split()


# ------------------------------------------------------------------ counting
def vocabulary(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts, ends not included."""
    small_batches(training.sparkSession)

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words(text))
            if len(held) > _FLUSH:
                yield out()
                held = Counter()
        if held:
            yield out()

    return training.select("text").mapInArrow(tidy(count), "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The frequent words and the corpus' totals."""

    words: list[bytes]
    counts: np.ndarray
    end_count: int
    total: int  # training tokens, ends included
    distinct: int
    rare_total: int
    rare_distinct: int

    @property
    def symbols(self) -> int:
        return len(self.words) + 2  # rare, end

    @property
    def base_log(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    @property
    def rare_log(self) -> float:
        return float(np.log10(self.rare_total + 0.5 * (self.rare_distinct + 1)))


def head_of(vocab: DataFrame, training_rows: int, head: int) -> Head:
    """The ``head`` most frequent words. A histogram of counts by sixteenths of an octave (about a
    thousand rows) tells which words can be among them; only those are ordered, in a few parts,
    each of which sends ``head`` rows at most."""
    step = F.floor(F.log2("c") * 16)
    often = sorted(((r["k"], r["n"]) for r in vocab.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    held, least = 0, 0
    for k, many in often:
        held, least = held + many, k
        if held >= head:
            break
    top = vocab.where(step >= least).repartition(4).orderBy(F.desc("c"), "word").limit(head).collect()
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    counts = np.array([r["c"] for r in top], np.int64)
    ends = training_rows
    return Head(
        [r["word"].encode() for r in top], counts, ends, n + ends, v + (ends > 0), int(n - counts.sum()), v - len(top)
    )


# ------------------------------------------------------------------ encoding
def encode(docs: DataFrame, head: Head) -> DataFrame:
    """Each row's symbols (16-bit, end last), its rare words with counts, and base score of the head."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((head.words, head.counts, head.end_count))  # `head` words

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        frequent, counts, ends = shared.value
        number = {w: i for i, w in enumerate(frequent)}
        rare = len(frequent)
        logs = np.log10(np.concatenate([counts, [0, ends]]) + 0.5)
        logs[rare] = 0.0
        find = number.get
        for batch in batches:
            symbols, lists, times, known, base = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                w = words(text)
                x = np.array([find(t, rare) for t in w] + [rare + 1], np.uint16)
                out = np.flatnonzero(x == rare)
                c = Counter([w[i] for i in out])
                symbols.append(x.tobytes())
                lists.append([t.decode() for t in c])
                times.append(list(c.values()))
                known.append(len(x) - len(out) - (ends == 0))
                base.append(float(logs[x].sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(symbols, pa.binary()), pa.array(lists, pa.list_(pa.string())),
                    pa.array(times, pa.list_(pa.int32())), pa.array(known, pa.int64()), pa.array(base, pa.float64()), batch.column(3),
                ],
                ["doc_id", "held_out", "symbols", "rare", "times", "known", "base", "row"],
            )

    rows = docs.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(
        tidy(run), "doc_id bigint, held_out boolean, symbols binary, rare array<string>, times array<int>, known bigint, base double, row bigint"
    )


# ------------------------------------------------------------------ the model
@dataclass
class HMM:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # symbols x S

    def stationary(self) -> np.ndarray:
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(60):
            p = p @ self.move
        return p / p.sum()


class _Layout:
    """Sequences sorted longest first and laid out step by step: step t has the first n[t] of them."""

    def __init__(self, sequences: list[np.ndarray]):
        self.size = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        longest = int(self.size.max()) if len(sequences) else 0
        self.n = np.searchsorted(-self.size[self.order], -np.arange(longest), side="left")
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.symbols = np.empty(int(self.at[-1]), np.int64)
        for rank, s in enumerate(self.order):
            self.symbols[self.at[: self.size[s]] + rank] = sequences[s]


def forward_log10(model: HMM, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion."""
    lay = _Layout(sequences)
    emit, move = model.emit, model.move
    total = np.zeros(len(sequences))
    a = None
    for t in range(len(lay.n)):
        m, at = lay.n[t], lay.at[t]
        e = emit[lay.symbols[at : at + m]]
        a = (model.start if t == 0 else a[:m] @ move) * e
        scale = a.sum(axis=1)
        a /= scale[:, None]
        total[:m] += np.log10(scale)
    out = np.empty(len(sequences))
    out[lay.order] = total
    return out


def expected_counts(model: HMM, sequences: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of sequences; ``first``: which open a text."""
    lay = _Layout(sequences)
    s = len(model.start)
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    total = int(lay.at[-1])
    e = emit[lay.symbols]
    alpha = np.empty((total, s), np.float32)
    scale = np.empty(total, np.float32)
    opening = np.where(first[lay.order][:, None], model.start, model.stationary()).astype(np.float32)
    a = opening
    for t in range(len(lay.n)):
        m, at = lay.n[t], lay.at[t]
        a = (a if t == 0 else a[:m] @ move) * e[at : at + m]
        c = a.sum(axis=1)
        a /= c[:, None]
        alpha[at : at + m], scale[at : at + m] = a, c
    gamma = alpha
    moved = np.zeros((s, s))
    beta = np.ones((len(sequences), s), np.float32)
    for t in range(len(lay.n) - 1, 0, -1):
        m, at, back = lay.n[t], lay.at[t], lay.at[t - 1]
        right = e[at : at + m] * beta[:m] / scale[at : at + m, None]
        left = alpha[back : back + m]
        moved += left.T @ right
        gamma[at : at + m] *= beta[:m]
        beta[:m] = right @ move.T
    if total:
        gamma[: lay.n[0]] *= beta[: lay.n[0]]
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-30)
    moved *= model.move
    opened = gamma[: lay.n[0]][first[lay.order]].sum(axis=0) if total else np.zeros(s)
    emitted = np.stack([np.bincount(lay.symbols, gamma[:, k], len(model.emit)) for k in range(s)], axis=1)
    return opened.astype(float), moved, emitted


def first_model(head: Head, pairs: np.ndarray, states: int, seed: int) -> HMM:
    """Clusters of the most frequent words by their neighbours open the states."""
    m = len(pairs)
    rng = np.random.default_rng(seed)
    own = np.full((m, states), 1 / states)
    if m > states:
        both = pairs + pairs.T + 1e-9
        side = both.sum(axis=1)
        near = np.maximum(0, np.log(both * both.sum() / np.outer(side, side) + 1e-12))
        value, vector = np.linalg.eigh(near)
        x = vector[:, -states:] * np.sqrt(np.abs(value[-states:]))
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        centre = [x[0]]
        for _ in range(states - 1):  # the farthest word opens the next cluster
            centre.append(x[np.argmin(np.max(np.stack(centre) @ x.T, axis=0))])
        c = np.stack(centre)
        for _ in range(20):
            near_to = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near_to == k].mean(axis=0) if (near_to == k).any() else c[k] for k in range(states)])
        own = np.full((m, states), 0.1 / states)
        own[np.arange(m), near_to] += 0.9
    mass = np.concatenate([head.counts, [head.rare_total + 1, head.end_count + 1]]).astype(float)
    emit = mass[:, None] * (1 + 0.02 * rng.random((len(mass), states)))
    emit[:m] = head.counts[:m, None] * own * states
    emit = emit / emit.sum(axis=0)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return HMM(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit)


def _stretches(binaries) -> tuple[list[np.ndarray], np.ndarray]:
    out, first = [], []
    for b in binaries:
        x = np.frombuffer(b, np.uint16)
        for k in range(0, len(x), STRETCH):
            out.append(x[k : k + STRETCH])
            first.append(k == 0)
    return out, np.array(first, bool)


def neighbour_pairs(encoded: DataFrame, most: int) -> np.ndarray:
    """How often each two of the ``most`` most frequent words follow each other, others left out."""

    def run(batches):
        import pyarrow as pa

        held = np.zeros(most * most, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                x = np.frombuffer(b, np.uint16)
                x = x[x < most].astype(np.int64)
                held += np.bincount(x[:-1] * most + x[1:], minlength=most * most)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["k", "n"])

    got = encoded.select("symbols").mapInArrow(tidy(run), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(most * most)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(most, most)


def baum_welch(encoded: DataFrame, model: HMM, head: Head, rounds: int) -> HMM:
    """``rounds`` rounds; each sums the tasks' expected counts by symbol."""
    spark = encoded.sparkSession
    s, symbols = len(model.start), len(model.emit)
    names = [f"s{k}" for k in range(s)]
    schema = "k int, " + ", ".join(f"{x} double" for x in names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            import pyarrow as pa

            model = shared.value
            opened, moved, emitted = np.zeros(s), np.zeros((s, s)), np.zeros((symbols, s))
            for batch in batches:
                sequences, first = _stretches(batch.column(0).to_pylist())
                for k in range(0, len(sequences), 4096):
                    a, b, c = expected_counts(model, sequences[k : k + 4096], first[k : k + 4096])
                    opened, moved, emitted = opened + a, moved + b, emitted + c
            held = np.flatnonzero(emitted.any(axis=1))
            every = np.concatenate([emitted[held], moved, opened[None]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([held, symbols + np.arange(s + 1)]).astype(np.int32)), *[pa.array(every[:, k]) for k in range(s)]], ["k", *names]
            )

        sums = encoded.select("symbols").mapInArrow(tidy(run), schema).groupBy("k").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        shared.destroy()
        every = np.zeros((symbols + s + 1, s))
        every[sums.column("k").to_numpy()] = np.stack([sums.column(x).to_numpy() for x in names], axis=1)
        # every symbol keeps a little of its overall share in every state
        mass = np.concatenate([head.counts, [head.rare_total + 0.5, head.end_count + 0.5]]).astype(float)
        emit = every[:symbols] + 20 * (mass / mass.sum())[:, None] + 1e-9
        move = every[symbols : symbols + s] + 1e-3
        start = every[symbols + s] + 1e-3
        model = HMM(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def score(docs: DataFrame, *, states: int = 8, head: int = 20_000, rounds: int = 3, seed: int = 5) -> DataFrame:
    """Scores all rows of ``docs`` (doc_id, text, held_out), training on those not held out."""
    if head > 65_000:
        raise ValueError("head: at most 65,000 symbols (16 bits)")
    spark = docs.sparkSession
    shelf = Shelf(spark, "lm")
    training = docs.where("not held_out")
    vocab = shelf.put(vocabulary(training), "vocabulary")
    top = head_of(vocab, training.count(), head)
    encoded = shelf.put(encode(docs, top), "encoded")
    learn = encoded.where("not held_out")
    model = first_model(top, neighbour_pairs(learn, min(256, len(top.words))), states, seed)
    model = baum_welch(learn, model, top, rounds if top.total else 0)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            x = [np.frombuffer(b, np.uint16) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(forward_log10(model, x)), pa.array([len(s) for s in x], pa.int64()), *batch.columns[2:]],
                ["row", "hmm", "n_tokens", "doc_id", "held_out", "known", "base"],
            )

    scored = encoded.select("row", "symbols", "doc_id", "held_out", "known", "base").mapInArrow(
        tidy(run), "row bigint, hmm double, n_tokens bigint, doc_id bigint, held_out boolean, known bigint, base double"
    )
    asked = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    half = F.coalesce("c", F.lit(0)) + F.lit(0.5)
    tails = (
        asked.join(vocab, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * F.log10(half)).alias("tail"),
            F.sum("n").alias("rare"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("found")).cast("long").alias("n_known"),
        F.lit(top.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * F.lit(top.base_log)).alias("base_score"),
        (F.col("hmm") + F.coalesce("tail", F.lit(0.0)) - zero("rare") * F.lit(top.rare_log)).alias("score"),
    )


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", (fold_of("doc_id") == 1).alias("held_out"))
