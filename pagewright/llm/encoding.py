"""SentencePiece encoding and decoding (10): see ``pieces`` for the transducer.

A text is normalised, cut where no piece can reach over, and each pre-token is composed with the
machine: those of some texts at once, in arrays (``lockstep``), long ones alone. Paths of pre-tokens
are kept by string in a table of bounded size. Decoding runs the machine from pieces to text. Null and empty texts have no pieces and decode to the empty text;
every row is encoded whole and alone, so repeated rows, ids and other columns play no part.
A text that holds the model's own space mark decodes to a space there, as in the model's library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from ._common import carry, kept, small_batches, tidy
from .lockstep import Lockstep
from .pieces import PieceModel, Transducer, default_model_path

#: Of a worker's table, about 240 bytes each; of a full one those stay that were asked for again, as most words come once.
MOST_PATHS = 100_000
#: Characters of texts whose pre-tokens are taken together, and pre-tokens in arrays together.
PART, TOGETHER = 1 << 19, 1 << 14


class Paths(dict):
    """Pre-token -> its piece ids as little-endian bytes; those of over ``LONGEST`` characters are not kept."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.lockstep = machine, Lockstep(machine)
        self.again: set[str] = set()

    def __missing__(self, s: str) -> bytes:
        return np.array(self.machine(s), "<i4").tobytes()

    def fill(self, words: list[str]) -> None:
        """Puts the paths of at most ``MOST_PATHS`` words into the table."""
        asked = set(words)
        new = asked.difference(self)
        if len(self) + len(new) > MOST_PATHS:
            stay = {s: self[s] for s in self.again} if len(self.again) <= MOST_PATHS // 2 else {}
            self.clear()
            self.again.clear()
            new = asked.difference(stay)
            if len(stay) + len(new) > MOST_PATHS:
                stay, new = {}, asked.copy()
            self.update(stay)
        asked -= new
        self.again |= asked
        todo = sorted([s for s in new if len(s) <= Lockstep.LONGEST], key=len)
        for i in range(0, len(todo), TOGETHER):
            some = todo[i : i + TOGETHER]
            ids, ends = self.lockstep(some)
            raw, ends = ids.astype("<i4").tobytes(), (4 * ends).tolist()
            self.update(zip(some, map(raw.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The piece ids of each text."""
        for part in parts(texts, PART):
            cut = list(map(self.machine.pretokens, part))
            if sum(map(len, cut)) <= MOST_PATHS:
                self.fill(list(chain.from_iterable(cut)))
                for words in cut:
                    yield b"".join(map(self.__getitem__, words))
                continue
            for words in cut:
                told = []
                for i in range(0, len(words), MOST_PATHS):
                    some = words[i : i + MOST_PATHS]
                    self.fill(some)
                    told.append(b"".join(map(self.__getitem__, some)))
                yield b"".join(told)

    @staticmethod
    def of(data: bytes) -> Paths:
        """A worker's own table, kept between tasks for the model in use."""
        return kept("paths", hashlib.sha256(data).hexdigest(), lambda: Paths(Transducer(PieceModel(data))))


def parts(texts: list[str | None], most: int) -> Iterator[list[str]]:
    """Texts, nulls as empty ones, in runs of about ``most`` characters; a longer text is a run of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > most:
            yield held
            held, size = [], 0
        held.append(text or "")
        size += len(held[-1])
    if held:
        yield held


def model_bytes(path: str | None) -> bytes:
    with open(path or default_model_path(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, *, model_path: str | None = None, ids: bool = True, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_columns``, n_tokens, ids_sha256 (of little-endian 32-bit ids), round_trip, and
    ``token_ids`` if ``ids``: a row for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(model_path))  # the model file: half a MB
    id_columns, kinds, k, at_text, carried = carry(docs, id_columns)
    schema = f"{kinds}, n_tokens bigint, ids_sha256 string, round_trip boolean" + ", token_ids array<int>" * ids

    def run(batches):
        import pyarrow as pa

        paths = Paths.of(shared.value)
        machine = paths.machine
        for batch in batches:
            n, digest, same, held = [], [], [], []
            texts = batch.column(at_text).to_pylist()
            for text, raw in zip(texts, paths.encode(texts), strict=True):
                got = np.frombuffer(raw, "<i4")
                n.append(len(got))
                digest.append(hashlib.sha256(raw).hexdigest())
                same.append(machine.decode(got.tolist()) == (text or ""))
                if ids:
                    held.append(got)
            out = [*[batch.column(i) for i in range(k)], pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
            if ids:
                ends = np.cumsum([0, *n]).astype(np.int32)
                flat = np.concatenate(held) if held else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, [*id_columns, "n_tokens", "ids_sha256", "round_trip", *["token_ids"] * ids])

    return docs.select(*carried).mapInArrow(tidy(run, tables=True), schema)


def decode(encoded: DataFrame, *, model_path: str | None = None, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_columns`` and text, from ``token_ids``."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model_bytes(model_path))
    k = len(id_columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*id_columns).schema)

    def run(batches):
        import pyarrow as pa

        machine = Paths.of(shared.value).machine
        for batch in batches:
            texts = [machine.decode(x or []) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(k)], pa.array(texts, pa.string())], [*id_columns, "text"])

    return encoded.select(*id_columns, "token_ids").mapInArrow(tidy(run, tables=True), f"{kinds}, text string")
