"""A SentencePiece model as weighted finite-state transducers; shared by token counts (8) and encoding (10).

Weights are of the tropical semiring: an arc has a cost, a path the sum of its arcs' costs, and a
text the least of its paths. Three machines are compiled from the model file:

* ``Normaliser``, one state: a space goes to the model's mark, any other character to itself;
  one mark goes in front of a text.
* ``Lexicon``: the trie of pieces, with a link from each state to that of its longest proper
  suffix, so the arcs (pieces) that end at a character are listed at the state it leads to.
* ``ByteFallback``, one state: a character without a piece goes to its UTF-8 bytes' pieces.

``Transducer`` composes them with each input, one character at a time, and keeps for every place
the least cost and the arc that gave it. In a *unigram* model an arc costs minus its piece's
score, and a fallback what the library asks; of equal sums the longest last piece wins. The scores of a *BPE* model rank merges, so its
least sum of scores is not what its encoder gives. There the cost depends on the arc before:
an arc that puts piece b after piece a costs 0 if merging the string ab gives back a, b, and
infinity if not. Merging is local (a sequence is the merge result if every neighbouring pair
is), so a path of cost 0 is the merge result, and there is one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        shift += 7
        if x < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, int or bytes)."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                n, i = _varint(b, i)
            else:
                n = 8 if kind == 1 else 4
            value = b[i : i + n]
            i += n
        yield key >> 3, value


class PieceModel:
    """Pieces of a model file: ids by string, scores, kinds, and the bytes each decodes to."""

    def __init__(self, data: bytes):
        import struct

        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.dummy_prefix, self.squeeze, self.charsmap, self.unigram = True, True, b"", True
        for number, value in _fields(data):
            if number == 1:
                d = dict(_fields(value))
                self.text.append(d[1].decode())
                self.score.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.kind.append(d.get(3, NORMAL))
            elif number == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                d = dict(_fields(value))
                self.charsmap = d.get(2, b"")
                self.dummy_prefix, self.squeeze = bool(d.get(3, 1)), bool(d.get(4, 1))
        if self.charsmap or self.squeeze:
            raise ValueError("only models with the identity normaliser that keep spaces are compiled")
        if not set(self.kind) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not compiled")
        self.id = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        self.byte_id = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        if len(self.byte_id) != 256:
            raise ValueError("only models with byte fallback are compiled")
        self.bytes = [
            b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE, " ").encode()
            for t, k in zip(self.text, self.kind, strict=True)
        ]

    def law(self) -> list[float]:
        """Natural logarithm of each piece's probability as a unigram: a unigram model's own scores;
        for a BPE model Zipf's law over merge ranks, 1 / (rank + 2.7), byte pieces as the last rank."""
        if self.unigram:
            least = min(self.score[i] for i in self.id.values())
            return [least if k == BYTE else s for s, k in zip(self.score, self.kind, strict=True)]
        rank = {i: r for r, i in enumerate(sorted(self.id.values(), key=lambda i: (-self.score[i], i)), 1)}
        weight = [1 / (rank.get(i, len(rank) + 1) + 2.7) if k in (NORMAL, BYTE) else 0.0 for i, k in enumerate(self.kind)]
        total = sum(weight)
        return [log(w / total) if w else float("-inf") for w in weight]

    @staticmethod
    def read(path: str) -> PieceModel:
        with open(path, "rb") as f:
            return PieceModel(f.read())


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ZERO, ONE = float("inf"), 0.0  # of the tropical semiring: no path, and the empty path


class Normaliser:
    """One state; its arcs map characters to characters, and ``front`` is put out at the start."""

    def __init__(self, model: PieceModel):
        self.arcs = {" ": SPACE}
        self.front = SPACE if model.dummy_prefix else ""

    def __call__(self, text: str) -> str:
        for c, to in self.arcs.items():
            text = text.replace(c, to)
        return self.front + text if text else ""


class Lexicon:
    """The trie of pieces with suffix links: ``arcs`` of a state are the pieces that end there."""

    def __init__(self, model: PieceModel):
        child: dict[int, int] = {}
        above, piece = [(0, 0)], [-1]  # of each state: its parent and character; the piece that ends there
        depth = [0]
        for t, i in model.id.items():
            at = 0
            for c in map(ord, t):
                below = child.get(at << 21 | c)
                if below is None:
                    below = child[at << 21 | c] = len(piece)
                    above.append((at, c))
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                at = below
            piece[at] = i
        self.child, self.suffix = child, [0] * len(piece)
        #: state -> (length, piece) of the pieces that end there, longest first
        self.arcs: list[tuple[tuple[int, int], ...]] = [()] * len(piece)
        for state in sorted(range(1, len(piece)), key=depth.__getitem__):
            parent, c = above[state]
            if parent:
                self.suffix[state] = self._next(self.suffix[parent], c)
            ends = self.arcs[self.suffix[state]]
            self.arcs[state] = ((depth[state], piece[state]), *ends) if piece[state] >= 0 else ends
        self.go = dict(child)

    def _next(self, state: int, c: int) -> int:
        while (below := self.child.get(state << 21 | c)) is None and state:
            state = self.suffix[state]
        return below or 0

    def step(self, key: int) -> int:
        """The state after ``key`` (state << 21 | character), kept in ``go``."""
        if len(self.go) > 1_000_000:
            self.go.clear()
            self.go.update(self.child)
        out = self.go[key] = self._next(key >> 21, key & 0x1FFFFF)
        return out


class ByteFallback:
    """One state; a character without a piece goes to the pieces of its bytes at ``cost``."""

    def __init__(self, model: PieceModel):
        self.ids = model.byte_id
        # the library's unknown penalty under the least score
        self.cost = 10 - min(model.score[i] for i in model.id.values()) if model.unigram else ONE

    def __call__(self, c: str) -> list[int]:
        return [self.ids[x] for x in c.encode()]


class Transducer:
    """The composed machine; ``__call__`` gives the shortest path's piece ids of one pre-token."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.normaliser, self.lexicon, self.fallback = Normaliser(model), Lexicon(model), ByteFallback(model)
        self.shift = len(model.text) + 2
        self.follows: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        many = Counter(model.score[i] for i in model.id.values())
        #: pieces that share a rank with another; merges among them are taken one by one
        self.tied = {t for t, i in model.id.items() if len(t) > 1 and many[model.score[i]] > 1}
        pairs = {(a, b) for t in model.id for a, b in zip(t, t[1:], strict=False)}
        if any(b == SPACE != a for a, b in pairs):
            raise ValueError("pieces reach over a space; pre-tokens cannot be cut there")
        self.pattern = self._cuts(pairs)

    @staticmethod
    def _cuts(pairs: set[tuple[str, str]]) -> re.Pattern:
        """Cuts that no piece reaches over: around characters that join no piece, before runs of the
        mark, and between a word and ASCII punctuation or digits if no piece holds such a pair."""
        left, right = {a for a, _ in pairs}, {b for _, b in pairs}
        ascii_marks = [chr(c) for c in range(128) if not chr(c).isalpha()]
        alone = [c for c in ascii_marks if c not in left and c not in right]
        # ends: no letter comes before it in a piece; a word may be cut there
        ends = [c for c in ascii_marks if c not in alone and not any(b == c and (a.isalpha() or a == SPACE) for a, b in pairs)]
        no = "".join(map(re.escape, alone))
        cut = "".join(map(re.escape, ends))
        other = f"[^{SPACE}{no}]"
        word = rf"{SPACE}*[^\W\d_]+(?=[{cut}{no}]|{SPACE}|\Z)|" if cut else ""
        return re.compile(rf"{word}{SPACE}*{other}+|{SPACE}+|[{no}]" if no else rf"{word}{SPACE}*{other}+|{SPACE}+")

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(self.normaliser(text))

    # -- the pair constraint
    def merged(self, s: str) -> list[str]:
        """The merge result of a short string: best score first, leftmost among equals."""
        ids, score = self.model.id, self.model.score
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def split(self, s: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None if its string does not merge to it, or if a
        part ranks below it or shares its rank (merges are then not in order of rank)."""
        if s in self.halves:
            return self.halves[s]
        ids, score = self.model.id, self.model.score
        parts, out = list(s), None
        while len(parts) > 1:
            if len(parts) == 2:
                out = (parts[0], parts[1])
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if at < 0:
                out = None
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if s in self.tied or out and any(len(x) > 1 and (score[ids[x]] <= score[ids[s]] or not self.split(x)) for x in out):
            out = None
        self.halves[s] = out
        return out

    def _apart(self, x: str, y: str) -> bool:
        """Whether the strings of two pieces merge to just these two. From the last merge back to the
        first, no pair over the border may outrank the merge that parted it."""
        ids, score = self.model.id, self.model.score
        if any(len(t) > 1 and not self.split(t) for t in (x, y)):
            return self.merged(x + y) == [x, y]
        limit, left = float("-inf"), True
        while True:
            k = ids.get(x + y)
            if k is not None and (score[k] > limit or (score[k] == limit and not left)):
                return False
            one = score[ids[x]] if len(x) > 1 else float("inf")
            two = score[ids[y]] if len(y) > 1 else float("inf")
            left = one < two  # the later merge; of equal ones the right one is later
            limit = one if left else two
            if limit == float("inf"):
                return True
            if left:
                x = self.split(x)[1]
            else:
                y = self.split(y)[0]

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether a piece costs 0 after ``before``: a piece + 1, or 0 for a start or a fallback character."""
        if len(self.follows) > 400_000:
            self.follows.clear()
        ok = self.follows[before * self.shift + piece] = self.judge(before, piece)
        return ok

    def judge(self, before: int, piece: int) -> bool:
        """``may_follow`` without a table."""
        y = self.model.text[piece]
        return self._apart(self.model.text[before - 1], y) if before else self.merged(y) == [y]

    def _by_rank(self, s: str) -> tuple[list[int], list[int]]:
        """Of each place: the piece + 1 of the least-cost path's last arc (0: a fallback; -1: no
        path), and where that arc begins. Costs are 0 or infinity, so the first path of cost 0
        is the least."""
        shift, lexicon, ids = self.shift, self.lexicon, self.model.id
        go, arcs, follows = lexicon.go.get, lexicon.arcs, self.follows.get
        last, back = [0], [0]
        state = 0
        for e, c in enumerate(s, 1):
            key = state << 21 | ord(c)
            state = go(key)
            if state is None:
                state = lexicon.step(key)
            for k, piece in arcs[state]:  # the arcs that end here
                before = last[e - k]
                if before >= 0:
                    ok = follows(before * shift + piece)
                    if ok is None:
                        ok = self.may_follow(before, piece)
                    if ok:
                        last.append(piece + 1)
                        back.append(e - k)
                        break
            else:
                last.append(0 if c not in ids and last[e - 1] >= 0 else -1)
                back.append(e - 1)
        return last, back

    def _by_score(self, s: str) -> tuple[list[int], list[int]]:
        """The same for a unigram model: the least sum of costs."""
        lexicon, ids, score, fallback = self.lexicon, self.model.id, self.model.score, self.fallback.cost
        cost, last, back = [ONE], [0], [0]
        state = 0
        for e, c in enumerate(s, 1):
            key = state << 21 | ord(c)
            state = lexicon.go.get(key)
            if state is None:
                state = lexicon.step(key)
            best, arc, at = ZERO, -1, e - 1
            for k, piece in lexicon.arcs[state]:
                here = cost[e - k] - score[piece]
                if here < best:
                    best, arc, at = here, piece + 1, e - k
            if c not in ids and cost[e - 1] + fallback < best:
                best, arc, at = cost[e - 1] + fallback, 0, e - 1
            cost.append(best)
            last.append(arc)
            back.append(at)
        return last, back

    def __call__(self, s: str) -> list[int]:
        last, back = self._by_score(s) if self.model.unigram else self._by_rank(s)
        out: list[int] = []
        e = len(s)
        while e > 0:
            if last[e] < 0:
                raise ValueError(f"no path through {s!r}")
            if last[e]:
                out.append(last[e] - 1)
            else:
                out.extend(reversed(self.fallback(s[back[e] : e])))
            e = back[e]
        return out[::-1]

    # -- whole texts
    def encode(self, text: str) -> list[int]:
        return [k for t in self.pretokens(text) for k in self(t)]

    def decode(self, ids) -> str:
        table = self.model.bytes
        raw = b"".join([table[k] for k in ids])
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")
