"""Object streams read by intervals: what is held at once does not grow with the decoded size.

A container is decoded in pieces of 32 KiB. Every so often the decoder is copied (its window is
32 KiB), and a read starts from the last copy before its interval, so that any object costs a stretch
of the container at most, not all of it. Copies are thinned out when there are ``RESTARTS`` of them.
The header (object numbers and places) is read in the same pieces; its numbers are kept where
they fit ``index_bytes`` and read again otherwise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np

PIECE = 32 << 10
RESTARTS = 16
#: Digits of an integer of a header at most; what they may say is below 2**53.
DIGITS = 16
_COMMENT = re.compile(rb"%[^\r\n]*[\r\n]")
_NUMBERS = re.compile(rb"[\x00\t\n\x0c\r ]*(?:\+?[0-9]{1,16}(?:[\x00\t\n\x0c\r ]+|\Z))*\Z")


class Damaged(Exception):
    """The container does not hold what it should."""


class TooLarge(Exception):
    """A limit was passed."""


class Decoder:
    """A place in a decoded stream: ``piece`` gives its next bytes, ``copy`` a second reader there."""

    def __init__(self, raw: bytes, flate: bool, most: int):
        self.raw, self.most, self.at, self.fed, self.ended = raw, most, 0, 0, False
        # a stream that begins like zlib's must pass its checksum; others are bare deflate
        wrapped = len(raw) > 1 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0
        self.z = zlib.decompressobj(15 if wrapped else -15) if flate else None

    def copy(self) -> Decoder:
        other = object.__new__(Decoder)
        other.__dict__.update(self.__dict__)
        if self.z is not None:
            other.z = self.z.copy()
        return other

    def piece(self) -> bytes:
        """Up to 32 KiB; empty at the end."""
        if self.z is None:
            out = self.raw[self.at : self.at + PIECE]
        else:
            out = b""
            while not out and not self.z.eof:
                held = self.z.unconsumed_tail
                if not held:
                    held = self.raw[self.fed : self.fed + PIECE]
                    self.fed += len(held)
                    if not held:
                        raise Damaged("a Flate stream ends early")
                try:
                    out = self.z.decompress(held, PIECE)
                except zlib.error as e:
                    raise Damaged(f"a Flate stream is damaged: {e}") from e
        self.at += len(out)
        if self.at > self.most:
            raise TooLarge("an object stream decodes to too many bytes")
        self.ended = not out
        return out


class Container:
    """The objects of one object stream: ``raw`` bytes, ``n`` objects whose values begin at ``first``."""

    def __init__(self, raw: bytes, flate: bool, n: int, first: int, *, most: int, object_bytes: int, index_bytes: int):
        if first > most:
            raise TooLarge("an object stream's header is too long")
        if min(n, first) < 0 or n > (first + 1) // 4:
            raise Damaged("a header too short for its objects")
        self.n, self.first, self.object_bytes = n, first, object_bytes
        self.start = Decoder(raw, flate, most)
        self.restarts, self.step = [self.start.copy()], 8 * PIECE
        #: most bytes of pieces and of an object held at a time; bytes decoded so far
        self.peak, self.decoded = 0, 0
        self.size: int | None = None
        self.index = np.concatenate(list(self._pairs())) if 24 * n <= index_bytes and n else None
        self.offsets = None if self.index is None else np.unique(self.index[:, 1])

    def held(self) -> int:
        """About how many bytes this object takes beside its raw ones."""
        kept = 0 if self.index is None else self.index.nbytes + self.offsets.nbytes
        return kept + len(self.restarts) * (40 << 10)

    # -- header
    def _pairs(self) -> Iterator[np.ndarray]:
        """The header's (number, place) pairs as matrices of two columns, in order."""
        reader, left, rest, odd, seen = self.start.copy(), self.first, b"", [], 0
        while left or rest:
            if left:
                piece = reader.piece()
                if not piece:
                    raise Damaged("the header ends early")
                piece = piece[:left]
                left -= len(piece)
                self.decoded += len(piece)
            else:
                piece = b"\n" if b"%" not in rest else b""
                if not piece:
                    raise Damaged("the header ends in a comment")
            data = rest + piece
            self.peak = max(self.peak, len(data) + PIECE)
            mark = data.rfind(b"%")
            if mark >= 0 and not re.search(rb"[\r\n]", data[mark:]):
                data, rest = data[:mark], b"%"  # what a comment says is not kept
            elif left:
                cut = max(data.rfind(c) for c in (b" ", b"\n", b"\r", b"\t", b"\0", b"\x0c")) + 1
                data, rest = data[:cut], data[cut:]
                if len(rest) > DIGITS + 1:
                    raise Damaged("no integer in a header")
            else:
                rest = b""
            plain = _COMMENT.sub(b" ", data).translate(bytes.maketrans(b"\0\x0c", b"  "))
            if not _NUMBERS.match(plain):
                raise Damaged("no integer in a header")
            words = odd + plain.split()
            odd = words[len(words) & ~1 :]
            if len(words) > 1:
                pairs = np.array(words[: len(words) & ~1], f"S{DIGITS + 1}").astype(np.int64).reshape(-1, 2)
                seen += len(pairs)
                if seen > self.n or pairs.max() >= 1 << 53:
                    raise Damaged("more in a header than its objects")
                yield pairs
        if odd or seen != self.n:
            raise Damaged("fewer objects in a header than the container has")

    def _scan(self) -> Iterator[np.ndarray]:
        return iter([self.index]) if self.index is not None else self._pairs()

    def place(self, number: int, index: int) -> tuple[int, int | None]:
        """Where an object's bytes begin and end (None: with the container). The entry at ``index`` counts
        if it has the number, else the first that has it."""
        found, at = None, 0
        for pairs in self._scan():
            if at <= index < at + len(pairs) and pairs[index - at, 0] == number:
                found = int(pairs[index - at, 1])
                break
            if found is None and len(rows := np.flatnonzero(pairs[:, 0] == number)):
                found = int(pairs[rows[0], 1])
            at += len(pairs)
        if found is None:
            raise Damaged("an object is not in its container")
        if self.offsets is not None:
            k = int(np.searchsorted(self.offsets, found, side="right"))
            end = int(self.offsets[k]) if k < len(self.offsets) else None
        else:
            later = [int(p[:, 1][p[:, 1] > found].min()) for p in self._pairs() if (p[:, 1] > found).any()]
            end = min(later, default=None)
        return self.first + found, None if end is None else self.first + end

    # -- body
    def _from(self, start: int) -> Decoder:
        return max((r for r in self.restarts if r.at <= start), key=lambda r: r.at).copy()

    def _keep(self, reader: Decoder) -> None:
        """A place to start from later, if the next one before it is far enough."""
        if reader.at < self.restarts[-1].at + self.step:
            return
        self.restarts.append(reader.copy())
        if len(self.restarts) > RESTARTS:
            self.restarts, self.step = self.restarts[::2], self.step * 2

    def read(self, start: int, end: int | None) -> bytes:
        """The decoded bytes from ``start`` to ``end``."""
        if end is not None and end - start > self.object_bytes:
            raise TooLarge("an object is too long")
        reader, out, got = self._from(start), bytearray(), 1
        while got and (end is None or reader.at < end):
            at = reader.at
            piece = reader.piece()
            got = len(piece)
            self.decoded += got
            if got:
                self._keep(reader)
                out += piece[max(0, start - at) : None if end is None else max(0, end - at)]
            else:
                self.size = at
            self.peak = max(self.peak, len(out) + got)
            if len(out) > self.object_bytes:
                raise TooLarge("an object is too long")
        if start >= reader.at or (end is not None and reader.at < end):
            raise Damaged("an object lies outside its container")
        return bytes(out)

    def object(self, number: int, index: int) -> bytes:
        return self.read(*self.place(number, index))
