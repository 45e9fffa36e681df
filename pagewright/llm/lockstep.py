"""The transducer of ``pieces`` over many pre-tokens at once: place by place, arrays over all of them.

The recurrence is that of ``Transducer``: after a place's character the state of the lexicon lists
the arcs that end there, longest first, and the least-cost one is kept. Here a place is a row of
arrays and a pre-token a column; pre-tokens stand longest first, so those that go on are the first
columns. States and pairs of pieces are looked up in ``Numbers``.
"""

from __future__ import annotations

import numpy as np

from .pieces import ONE, ZERO, Transducer

_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Numbers:
    """Keys (0 or more) -> numbers (0 or more), in open addressing; a look or an addition takes an array of keys."""

    def __init__(self, bits: int, kind=np.int32):
        self.bits, self.size = bits, 0
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, kind)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _GOLD) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers; -1 where a key is not held."""
        at = self._at(keys)
        held = self.key[at]
        out = self.value[at]
        off = np.flatnonzero(held != keys)
        out[off] = -1
        off = off[held[off] >= 0]  # another key is there: look one further
        while len(off):
            at[off] = at[off] + 1 & (1 << self.bits) - 1
            held = self.key[at[off]]
            same = held == keys[off]
            out[off[same]] = self.value[at[off[same]]]
            off = off[~same & (held >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not held. The table is kept at most half full by its user."""
        self.size += len(keys)
        at = self._at(keys)
        while len(keys):
            free = np.flatnonzero(self.key[at] < 0)
            self.key[at[free]] = keys[free]
            mine = self.key[at] == keys  # of several at one place, the last
            self.value[at[mine]] = values[mine]
            at, keys, values = at[~mine] + 1 & (1 << self.bits) - 1, keys[~mine], values[~mine]


class Lockstep:
    """``__call__`` gives the piece ids of many pre-tokens of at most ``LONGEST`` characters."""

    LONGEST, MOST_PAIRS = 64, 1 << 19

    def __init__(self, machine: Transducer):
        self.machine = machine
        lexicon = machine.lexicon
        n = len(lexicon.child)
        self.child = Numbers(max(4, n.bit_length() + 2))
        self.child.add(np.fromiter(lexicon.child, np.int64, n), np.fromiter(lexicon.child.values(), np.int64, n))
        self.suffix = np.array(lexicon.suffix, np.int64)
        #: arcs of state s, longest first: first[s] to first[s + 1]
        self.first = np.cumsum([0, *map(len, lexicon.arcs)])
        flat = np.array([arc for arcs in lexicon.arcs for arc in arcs] or [(0, 0)], np.int64)
        self.length, self.piece = np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])
        self.score = np.array(machine.model.score)
        self.known = np.array(sorted(ord(c) for c in machine.model.id if len(c) == 1), np.int64)
        self.follows = Numbers(self.MOST_PAIRS.bit_length(), np.int8)
        # for pairs: the strings of pieces, then characters that are none; the rank of a string's last merge
        ids = machine.model.id
        self.text = machine.model.text + sorted({c for t in ids for c in t} - set(ids))
        self.number = ids | {t: i for i, t in enumerate(self.text[len(machine.model.text) :], len(machine.model.text))}
        many = len(self.text)
        self.merge = np.array([machine.model.score[ids[t]] if len(t) > 1 and t in ids else ZERO for t in self.text])
        #: 0: not known yet; 1: a piece with halves or of one character; 2: one without
        self.parted, self.left, self.right = np.zeros(many, np.int8), np.zeros(many, np.int64), np.zeros(many, np.int64)
        joins = {}
        for t, i in () if machine.model.unigram else ids.items():
            for k in range(1, len(t)):
                a, b = self.number.get(t[:k]), self.number.get(t[k:])
                if a is not None and b is not None:
                    joins[a * many + b] = i
        self.joined = Numbers(max(4, len(joins).bit_length() + 1))
        self.joined.add(np.fromiter(joins, np.int64, len(joins)), np.fromiter(joins.values(), np.int64, len(joins)))

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = self.child(state << 21 | c)
        todo = np.flatnonzero((out < 0) & (state > 0))
        at = self.suffix[state[todo]]
        while len(todo):
            below = self.child(at << 21 | c[todo])
            out[todo] = below
            more = np.flatnonzero((below < 0) & (at > 0))
            todo, at = todo[more], self.suffix[at[more]]
        return np.maximum(out, 0).astype(np.int64)

    def _know(self, i: int) -> None:
        """Puts down the halves of a piece, and of these in turn."""
        halves = self.machine.split(self.text[i]) if len(self.text[i]) > 1 else None
        self.parted[i] = 1 if len(self.text[i]) == 1 or halves else 2
        if halves:
            self.left[i], self.right[i] = at = [self.number[t] for t in halves]
            for k in at:
                if not self.parted[k]:
                    self._know(k)

    def _judge(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``Transducer.judge`` of many pairs: the borders of all go back merge by merge."""
        x, y = before - 1, piece
        for i in np.unique(np.concatenate((x[x >= 0], y))).tolist():
            if not self.parted[i]:
                self._know(i)
        out = self.parted[y] == 1  # a piece with halves, or of one character, merges to itself
        out[x >= 0] &= self.parted[x[x >= 0]] == 1
        for i in np.flatnonzero(~out).tolist():
            out[i] = self.machine.judge(int(before[i]), int(piece[i]))
        todo = np.flatnonzero((x >= 0) & (self.parted[x] == 1) & (self.parted[y] == 1))
        x, y, limit, left = x[todo], y[todo], np.full(len(todo), -ZERO), np.ones(len(todo), bool)
        while len(todo):
            k = self.joined(x * len(self.text) + y)
            here = np.where(k >= 0, self.score[k], -ZERO)
            no = (k >= 0) & ((here > limit) | (here == limit) & ~left)
            out[todo[no]] = False
            one, two = self.merge[x], self.merge[y]
            left = one < two
            limit = np.minimum(one, two)
            on = np.flatnonzero(~no & (limit < ZERO))
            todo, x, y, limit, left = todo[on], x[on], y[on], limit[on], left[on]
            x, y = np.where(left, self.right[x], x), np.where(left, y, self.left[y])
        return out

    def _may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``Transducer.may_follow`` of many pairs; each pair is judged once while the table lasts."""
        keys = before * self.machine.shift + piece
        out = self.follows(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            pairs, where = np.unique(keys[new], return_inverse=True)
            told = self._judge(*np.divmod(pairs, self.machine.shift)).astype(np.int8)
            out[new] = told[where]
            if self.follows.size + len(pairs) > self.MOST_PAIRS:
                self.follows = Numbers(self.follows.bits, np.int8)
            self.follows.add(pairs[: self.MOST_PAIRS], told[: self.MOST_PAIRS])
        return out > 0

    def _by_rank(self, e: int, at: np.ndarray, much: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pre-token's place ``e``: the piece + 1 of the arc that costs 0 (-1: none), and its length."""
        arc, size = np.full(len(at), -1), np.ones(len(at), np.int64)
        todo, j = np.flatnonzero(much > 0), 0
        while len(todo):
            k, piece = self.length[at[todo] + j], self.piece[at[todo] + j]
            before = last[e - k, todo].astype(np.int64)
            some = np.flatnonzero(before >= 0)
            ok = np.zeros(len(todo), bool)
            ok[some] = self._may_follow(before[some], piece[some])
            arc[todo[ok]], size[todo[ok]] = piece[ok] + 1, k[ok]
            todo, j = todo[~ok], j + 1
            todo = todo[much[todo] > j]
        return arc, size

    def _by_score(self, e: int, at: np.ndarray, much: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a unigram model, the arc of least cost, which is put into ``cost``."""
        arc, size = np.full(len(at), -1), np.ones(len(at), np.int64)
        todo, j = np.flatnonzero(much > 0), 0
        while len(todo):
            k, piece = self.length[at[todo] + j], self.piece[at[todo] + j]
            here = cost[e - k, todo] - self.score[piece]
            less = here < cost[e, todo]
            cost[e, todo[less]], arc[todo[less]], size[todo[less]] = here[less], piece[less] + 1, k[less]
            j += 1
            todo = todo[much[todo] > j]
        return arc, size

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all ``words``, one after another, and where those of each word begin and end."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        unigram, fallback = self.machine.model.unigram, self.machine.fallback
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        places, many = int(sizes[0]), len(words)
        going = np.searchsorted(-sizes, -np.arange(places + 1), side="right")  # pre-tokens of e or more characters
        # by code point, as each occurs: the pieces of a character without one
        missing = ~np.isin(text, self.known)
        odd, which = np.unique(text[missing], return_inverse=True)
        as_bytes = [fallback(chr(c)) for c in odd.tolist()]
        which = np.cumsum(missing) - 1 if not len(odd) else np.concatenate((which, [0]))[np.cumsum(missing) - 1]
        odd_size = np.array([len(x) for x in as_bytes] or [0], np.int64)

        last, back = np.full((places + 1, many), -1, np.int32), np.zeros((places + 1, many), np.int8)
        count = np.zeros((places + 1, many), np.int16)  # pieces so far
        last[0] = 0
        cost = np.full((places + 1, many) if unigram else 0, ZERO)
        if unigram:
            cost[0] = ONE
        state, column = np.zeros(many, np.int64), np.arange(many)
        for e in range(1, places + 1):
            n = int(going[e])
            place = begin[:n] + (e - 1)
            state = self._step(state[:n], text[place])
            at = self.first[state]
            much = self.first[state + 1] - at
            arc, size = self._by_score(e, at, much, cost) if unigram else self._by_rank(e, at, much, last)
            more = np.ones(n, np.int64)
            fall = np.flatnonzero(missing[place])
            if len(fall):
                if unigram:
                    here = cost[e - 1, fall] + fallback.cost
                    fall = fall[less := here < cost[e, fall]]
                    cost[e, fall] = here[less]
                else:
                    fall = fall[(arc[fall] < 0) & (last[e - 1, fall] >= 0)]
                arc[fall], size[fall], more[fall] = 0, 1, odd_size[which[place[fall]]]
            last[e, :n], back[e, :n] = arc, size
            count[e, :n] = count[e - size, column[:n]] + more

        # from the ends back to the beginnings
        total = count[sizes, column].astype(np.int64)
        ends = np.zeros(many + 1, np.int64)
        ends[1:][order] = total
        ends = np.cumsum(ends)
        out, e, w = np.zeros(int(ends[-1]), np.int32), sizes, column
        start = ends[:-1][order]
        while len(w):
            arc = last[e, w]
            if (arc < 0).any():
                raise ValueError(f"no path through {words[order[w[np.flatnonzero(arc < 0)[0]]]]!r}")
            piece = np.flatnonzero(arc)
            out[start[w[piece]] + count[e[piece], w[piece]] - 1] = arc[piece] - 1
            for i in np.flatnonzero(arc == 0).tolist():
                ids = as_bytes[which[begin[w[i]] + e[i] - 1]]
                stop = start[w[i]] + count[e[i], w[i]]
                out[stop - len(ids) : stop] = ids
            e = e - back[e, w]
            w, e = w[e > 0], e[e > 0]
        return out, ends
