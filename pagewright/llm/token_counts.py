"""Token counts (8): dynamic programming shared along a trie of distinct pre-tokens.

A task puts the distinct pre-tokens of its documents into a trie. A node is a prefix; it holds

* the unigram forward score: the logarithm of the summed probability of every way to cut the
  prefix into pieces, under ``PieceModel.law`` (sum over the pieces that end there of the score
  of the ancestor where the piece begins, times the piece's probability), and
* the encoder's own path: its last piece and its length, by the weights of ``pieces``, so counts
  equal the model library's.

Both are computed once from the node's ancestors when it is made, however many pre-tokens run
through it. A node where a pre-token ends is its terminal. Texts are taken in parts of about
``PART`` characters; before a part, a trie of over ``MOST_NODES`` nodes starts anew. A pre-token
longer than ``LONGEST`` goes through the same recurrences without the trie, and is a node for
that part alone.

Null and empty texts have no tokens and the score 0; rows are counted whole and alone, so repeated
rows, ids and other columns play no part. A pre-token without a path is an error, as in encoding.
Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from math import exp, log

import numpy as np
from pyspark.sql import DataFrame

from ._common import carry, kept, small_batches, tidy
from .encoding import model_bytes, parts
from .pieces import ONE, ZERO, PieceModel, Transducer

MOST_NODES, LONGEST, PART = 1_000_000, 64, 1 << 20


class Terminals(dict):
    """Pre-token -> its node, inserted on first use."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, s: str) -> int:
        if len(s) > LONGEST:
            node = self.trie.detached(s)
        else:
            node = self[s] = self.trie.insert(s)
        if self.trie.cost[node] == ZERO:
            raise ValueError(f"no path through {s!r}")
        return node


class Trie:
    def __init__(self, machine: Transducer):
        self.machine = machine
        self.law = machine.model.law()
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.score, self.count, self.state = array("i", [0]), array("d", [0.0]), array("q", [0]), array("i", [0])
        self.cost = array("d", [0.0])
        self.terminal = Terminals(self)

    def totals(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(pre-tokens, tokens, forward score) of each text."""
        if len(self.last) > MOST_NODES:
            self.reset()
        node = self.terminal.__getitem__
        ends = [np.fromiter(map(node, words), np.int64, len(words)) for words in map(self.machine.pretokens, texts)]
        count, score = np.array(self.count), np.array(self.score)
        for at in ends:
            yield len(at), int(count[at].sum()), float(score[at].sum())

    def detached(self, s: str) -> int:
        """A node for a long pre-token, whose prefixes are dropped again."""
        held = len(self.last)
        self._walk(s, {})
        kept = [x.pop() for x in (self.last, self.cost, self.score, self.count, self.state)]
        for x, top in zip((self.last, self.cost, self.score, self.count, self.state), kept, strict=True):
            del x[held:]
            x.append(top)
        return held

    def insert(self, s: str) -> int:
        """The node of ``s``."""
        return self._walk(s, self.child)

    def _walk(self, s: str, child: dict[int, int]) -> int:
        go, step, states = self.machine.lexicon.go.get, self.machine.lexicon.step, self.state
        node, line = 0, [0]
        for c in s:
            code = ord(c)
            below = child.get(node << 21 | code)
            if below is None:
                key = states[node] << 21 | code
                state = go(key)
                below = child[node << 21 | code] = self._grow(line, c, step(key) if state is None else state)
            node = below
            line.append(node)
        return node

    def _grow(self, line: list[int], c: str, state: int) -> int:
        """A new node below ``line``: both recurrences over the arcs that end at it."""
        machine, law, score = self.machine, self.law, self.score
        arcs, n = machine.lexicon.arcs[state], len(line)
        ways = [score[line[n - k]] + law[piece] for k, piece in arcs]
        missing = c not in machine.model.id
        if missing:
            raw = machine.fallback(c)
            ways.append(score[line[-1]] + sum(law[x] for x in raw))
        top = max(ways)
        forward = top + log(sum([exp(w - top) for w in ways])) if len(ways) > 1 else top
        last, cost, start, more = -1, ZERO, 0, 0
        if machine.model.unigram:
            weight = machine.model.score
            for k, piece in arcs:
                here = self.cost[line[n - k]] - weight[piece]
                if here < cost:
                    last, cost, start, more = piece + 1, here, line[n - k], 1
        else:
            shift, follows = machine.shift, machine.follows.get
            for k, piece in arcs:
                before = self.last[line[n - k]]
                if before >= 0:
                    ok = follows(before * shift + piece)
                    if ok is None:
                        ok = machine.may_follow(before, piece)
                    if ok:
                        last, cost, start, more = piece + 1, ONE, line[n - k], 1
                        break
        if missing and self.cost[line[-1]] + machine.fallback.cost < cost:
            last, cost, start, more = 0, self.cost[line[-1]] + machine.fallback.cost, line[-1], len(raw)
        self.last.append(last)
        self.cost.append(cost)
        self.score.append(forward)
        self.count.append(self.count[start] + more)
        self.state.append(state)
        return len(self.last) - 1

    @staticmethod
    def of(data: bytes) -> Trie:
        return kept("trie", hashlib.sha256(data).hexdigest(), lambda: Trie(Transducer(PieceModel(data))))


def count_tokens(docs: DataFrame, *, model_path: str | None = None, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_columns``, n_pretokens, n_tokens and forward_score: a row for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(model_path))  # the model file: half a MB
    id_columns, kinds, k, at_text, carried = carry(docs, id_columns)

    def run(batches):
        import pyarrow as pa

        trie = Trie.of(shared.value)
        for batch in batches:
            told = [x for part in parts(batch.column(at_text).to_pylist(), PART) for x in trie.totals(part)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(k)],
                    *[pa.array([x[i] for x in told], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                ],
                [*id_columns, "n_pretokens", "n_tokens", "forward_score"],
            )

    return docs.select(*carried).mapInArrow(tidy(run, tables=True), f"{kinds}, n_pretokens bigint, n_tokens bigint, forward_score double")
