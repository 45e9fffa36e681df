"""PDF bytes to pages of positioned spans, fills, paths and images.

``pages_of`` maps files (doc_id, content) to page rows, ``read_pages`` reads a path; ``datasource``
has the random-access form. A broken file gives one row with a typed error and does not fail the
job (``mode``: PERMISSIVE; DROPMALFORMED leaves it out, FAILFAST raises).

A ``Document`` reads ranges of a source: the tail with the cross references, then each object
between its offset and the next one's. Objects and decoded containers are kept in caches bounded
by number and bytes. What goes over a limit is a RESOURCE_LIMIT error, which starts no recovery.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scripts import RIGHT_TO_LEFT, in_script_order
from ..schema import FONTS, PAGES
from . import shown
from .ccitt import group4
from .containers import Container, Damaged, TooLarge
from .content import Interpreter, attach_links, links_of
from .fontassets import asset_of
from .fonts import font_of

MAX_NESTING = 128


@dataclass(frozen=True)
class Limits:
    """What a reader may take; each is an option of the sources by its name."""

    max_object_bytes: int = 16 << 20
    max_decoded_stream_bytes: int = 32 << 20
    max_object_stream_decoded_bytes: int = 64 << 20
    max_xref_bytes: int = 8 << 20
    max_page_tree_depth: int = 128
    max_form_depth: int = 32
    max_cached_objects: int = 256
    max_object_cache_bytes: int = 16 << 20
    max_xref_cache_bytes: int = 16 << 20

    @staticmethod
    def of(options: dict) -> Limits:
        low = {k.lower().replace("_", ""): v for k, v in options.items()}
        return Limits(**{f.name: int(low[k]) for f in fields(Limits) if (k := f.name.replace("_", "")) in low})


class PdfError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Name(str):
    __slots__ = ()


class Operator(str):
    __slots__ = ()


class Ref(tuple):
    __slots__ = ()


class Stream:
    def __init__(self, head: dict, raw: bytes):
        self.head, self.raw = head, raw


_GAP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_PLAIN = re.compile(rb"\(([^()\\]*)\)")
_NUMBER = re.compile(rb"[+-]?(?=\.?\d)\d*(\.\d*)?")
_REFERENCE = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z0-9])")


#: The common tokens in one look: an integer, a real, a name, a plain string, a word.
_TOKEN = re.compile(
    rb"[\x00\t\n\x0c\r ]*(?:([+-]?\d+)|([+-]?(?:\d+\.\d*|\.\d+))|/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*)|\(([^()\\]*)\)|([A-Za-z'\"][A-Za-z0-9'\"*]*))"
    rb"(?:(?<=\))|(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z))"
)
_END = rb"(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)"
_REF = rb"\s+(\d+)\s+R(?![A-Za-z0-9])"
#: A key of a dictionary with a name, a reference or an integer; a head of an object; an entry of a table of places.
_PAIR = re.compile(
    rb"[\x00\t\n\x0c\r ]*/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*+)[\x00\t\n\x0c\r ]*+"
    rb"(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*+)" + _END + rb"|([+-]?\d++)(?:" + _REF + rb"|" + _END + rb"(?!\s+\d+\s+R(?![A-Za-z0-9]))))"
)
_HEAD = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj" + _END)
_PLACE = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+([nf])" + _END)
_WORDS = {b"true": True, b"false": False, b"null": None}
#: A table of places with one part from 0 in entries of 20 bytes, and the bytes of an entry.
_TABLE = re.compile(rb"xref[\r\n ]+0 (\d+)[\r\n ]+((?:\d{10} \d{5} [nf][\r\n ]{2})+)(?=trailer)")
ENTRY = 20
#: Objects of at most so many bytes that are no streams: a process keeps so many by their bytes, as small files repeat them.
SMALL, MOST_SMALL = 512, 256
_small: dict[bytes, Small] = {}


class Small(dict):
    """A dictionary that files share, and about how many bytes it takes."""

    __slots__ = ("size",)


class Lexer:
    """Values of the PDF syntax from a byte string; without ``refs`` (content) ``N G R`` is no reference."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def skip(self) -> None:
        self.at = _GAP.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        if m := _TOKEN.match(self.data, self.at):
            self.at, kind = m.end(), m.lastindex
            if kind == 1:
                if self.refs and (r := _REFERENCE.match(self.data, self.at)):
                    self.at = r.end()
                    return Ref((int(m[1]), int(r[1])))
                return int(m[1])
            if kind == 2:
                return float(m[2])
            if kind == 3:
                return Name(m[3].decode("latin-1"))
            if kind == 4:
                return m[4]
            word = m[5]
            return _WORDS[word] if word in _WORDS else Operator(word.decode("latin-1"))
        if depth > MAX_NESTING:
            raise PdfError("INVALID_PDF", "values are nested too deeply")
        self.skip()
        d = self.data
        if self.at >= len(d):
            raise EOFError
        c = d[self.at : self.at + 1]
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                while self.refs and (m := _PAIR.match(d, self.at)):
                    key, name, number, generation = m.groups()
                    value = Name(name.decode("latin-1")) if number is None else int(number) if generation is None else Ref((int(number), int(generation)))
                    out[key.decode("latin-1")] = value
                    self.at = m.end()
                self.skip()
                if d[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                out[str(key)] = self.value(depth + 1)
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.value(depth + 1))
        if c == b"(":
            return self._literal()
        if c == b"<":
            end = d.find(b">", self.at)
            digits = re.sub(rb"\s", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
        if c == b"/":
            word = self._word(1)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word[1:]).decode("latin-1"))
        if c in (b")", b">", b"]", b"{", b"}"):
            self.at += 1
            return Operator(c.decode())
        word = self._word(0)
        if m := _NUMBER.fullmatch(word):
            if m[1]:
                return float(word)
            if self.refs and (m := _REFERENCE.match(d, self.at)):
                self.at = m.end()
                return Ref((int(word), int(m[1])))
            return int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word.decode("latin-1")))

    def _word(self, skip: int) -> bytes:
        start = self.at
        self.at = max(_REGULAR.match(self.data, start + skip).end(), start + 1)
        return self.data[start : self.at]

    def _literal(self) -> bytes:
        if m := _PLAIN.match(self.data, self.at):
            self.at = m.end()
            return m[1]
        d, out, depth = self.data, bytearray(), 1
        self.at += 1
        escapes = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 0x5C:
                if m := re.compile(rb"[0-7]{1,3}").match(d, self.at):
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                elif m := re.compile(rb"\r\n|\r|\n").match(d, self.at):
                    self.at = m.end()
                else:
                    out.append(escapes.get(d[self.at], d[self.at]))
                    self.at += 1
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        return bytes(out)


def inflate(raw: bytes, most: int = Limits.max_decoded_stream_bytes) -> bytes:
    """zlib, else raw deflate, else raw deflate between what looks like zlib's header and checksum."""
    tries = [(15, raw), (-15, raw)] + ([(-15, raw[2:-4])] if len(raw) > 6 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0 else [])
    for bits, data in tries:
        try:
            z = zlib.decompressobj(bits)
            out = z.decompress(data, most)
            if z.unconsumed_tail and z.decompress(z.unconsumed_tail, 1):
                raise PdfError("RESOURCE_LIMIT", "a stream decodes to too many bytes")
            return out
        except zlib.error:
            continue
    raise PdfError("INVALID_PDF", "a Flate stream is damaged")


def lzw(raw: bytes, early: int = 1, most: int = Limits.max_decoded_stream_bytes) -> bytes:
    out, table, width, held, bits, last = bytearray(), {}, 9, 0, 0, b""
    nxt = 258
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 256:
                table, nxt, width, last = {}, 258, 9, b""
                continue
            if code == 257:
                return bytes(out)
            now = bytes([code]) if code < 256 else table.get(code, last + last[:1])
            out += now
            if len(out) > most:
                raise PdfError("RESOURCE_LIMIT", "a stream decodes to too many bytes")
            if last:
                table[nxt] = last + now[:1]
                nxt += 1
                width = max(width, min(12, (nxt + early).bit_length()))
            last = now
    return bytes(out)


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undoes the TIFF predictor (2) and PNG's (10 to 15), row by row."""
    import numpy as np

    kind = parms.get("Predictor", 1)
    if kind == 1 or not data:
        return data
    colors, depth, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, size = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2:
        rows = np.frombuffer(data + bytes(-len(data) % size), np.uint8).reshape(-1, size)
        if depth == 8:
            out = np.cumsum(rows.reshape(len(rows), -1, colors), axis=1, dtype=np.uint8)
        elif depth == 16:
            out = np.cumsum(rows.copy().view(">u2").astype(np.uint16).reshape(len(rows), -1, colors), axis=1, dtype=np.uint16).astype(">u2").view(np.uint8)
        else:  # several samples a byte
            bits = np.unpackbits(rows, axis=1)[:, : colors * depth * columns].reshape(len(rows), columns, colors, depth)
            value = np.cumsum(bits @ (1 << np.arange(depth)[::-1]), axis=1) & ((1 << depth) - 1)
            out = np.packbits(((value[..., None] >> np.arange(depth)[::-1]) & 1).reshape(len(rows), -1).astype(np.uint8), axis=1)
        return out.tobytes()[: len(data)]
    if len(data) % (size + 1) == 0 and ((rows := np.frombuffer(data, np.uint8).reshape(-1, size + 1))[:, 0] == 2).all():
        return np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8).tobytes()  # as most cross references are
    out, above = bytearray(), np.zeros(size, np.uint8)
    for k in range(0, len(data), size + 1):
        mode, raw = data[k], data[k + 1 : k + 1 + size]
        row = np.frombuffer(raw + bytes(size - len(raw)), np.uint8).copy()
        if mode == 1:
            row = np.cumsum(np.pad(row, (0, -size % step)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:size]
        elif mode == 2:
            row += above
        elif mode in (3, 4):
            now, up = row.tolist(), above.tolist()
            for i in range(size):
                a, b, c = (now[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
                if mode == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i] = (now[i] + add) & 255
            row = np.array(now, np.uint8)
        out += row[: len(raw)].tobytes()
        above = row
    return bytes(out)


def _entries(rows: bytes, a: int, b: int, c: int) -> tuple[list[int], list[int], list[int]]:
    """The three fields of each entry of a cross-reference stream; without a first field all are of kind 1."""
    import numpy as np

    n, step = len(rows) // max(1, a + b + c), a + b + c
    if max(a, b, c) > 7:
        cut = lambda k, i, j: int.from_bytes(rows[k * step + i : k * step + j])
        return [cut(k, 0, a) if a else 1 for k in range(n)], [cut(k, a, a + b) for k in range(n)], [cut(k, a + b, step) for k in range(n)]
    table = np.frombuffer(rows, np.uint8).reshape(n, step).astype(np.int64)
    field = lambda i, j: (table[:, i:j] << (8 * np.arange(j - i)[::-1])).sum(axis=1, dtype=np.int64).tolist()
    return field(0, a) if a else [1] * n, field(a, a + b), field(a + b, step)


class MemorySource:
    """Ranges of bytes at hand."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError("a range outside the source")
        return bytes(self.data[offset : offset + length])


class Cache:
    """The values used last, bounded by their number and their bytes."""

    def __init__(self, most: int, most_bytes: int):
        self.most, self.most_bytes, self.held, self.bytes = most, most_bytes, OrderedDict(), 0

    def get(self, key):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][0]
        return None

    def put(self, key, value, size: int) -> None:
        if size > self.most_bytes:
            return
        self.held[key] = (value, size)
        self.bytes += size
        while len(self.held) > self.most or self.bytes > self.most_bytes:
            _, (_, gone) = self.held.popitem(last=False)
            self.bytes -= gone

    def clear(self) -> None:
        self.held.clear()
        self.bytes = 0


def value_size(value) -> int:
    """About how many bytes a value takes."""
    if isinstance(value, Small):
        return value.size
    todo, total = [value], 0
    while todo:
        v = todo.pop()
        total += 16
        if isinstance(v, Stream):
            total += len(v.raw)
            todo.append(v.head)
        elif isinstance(v, (bytes, str)):
            total += len(v)
        elif isinstance(v, dict):
            todo += [*v, *v.values()]
        elif isinstance(v, list):
            todo += v
    return total


class Document:
    """Cross references, objects and the page tree of one file."""

    def __init__(self, source, limits: Limits | None = None):
        self.source = MemorySource(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        self.limits = limits = limits or Limits()
        size = self.source.size
        if b"%PDF-" not in self.source.read(0, min(1024, size)):
            raise PdfError("INVALID_PDF", "no header")
        self.xref, self.trailer, self.sections = {}, {}, []
        self.cache = Cache(limits.max_cached_objects, limits.max_object_cache_bytes)
        self.boxes, self.box = Cache(64, limits.max_object_cache_bytes), None
        self.recovered, self.stops = False, []
        try:
            # as a rule the last kilobyte holds the place; more is read only where it does not
            for tail in (1024, limits.max_xref_bytes):
                found = re.findall(rb"startxref\s+(\d+)", self.source.read(size - min(size, tail), min(size, tail)))
                if found:
                    break
            todo, seen = [int(found[-1])], set()
            while todo:
                at = todo.pop(0)
                if at in seen:
                    continue
                seen.add(at)
                todo = self._section(at) + todo
            self.sections = sorted(seen)
            self._order()
            if not isinstance(self.resolve(self.trailer.get("Root")), dict):
                raise ValueError("no root")
        except PdfError as e:
            if e.code != "INVALID_PDF":
                raise
            self._recover()
        except (EOFError, ValueError, IndexError, KeyError, TypeError, AttributeError, Damaged):
            self._recover()

    def _order(self) -> None:
        """Where an object's bytes end at the latest: the next object or section."""
        self.stops = sorted({x[1] for x in self.xref.values() if not x[0]} | set(self.sections)) + [self.source.size]

    def _window(self, at: int, most: int | None = None) -> bytes:
        if not 0 <= at < self.source.size:
            raise ValueError("an offset outside the file")
        end = self.stops[bisect_right(self.stops, at)] if self.stops and at < self.stops[-1] else self.source.size
        return self.source.read(at, min(end - at, most or self.limits.max_object_bytes))

    def _section(self, at: int) -> list[int]:
        data = self.source.read(at, min(self.source.size - at, self.limits.max_xref_bytes))
        lex = Lexer(data)
        lex.skip()
        if data[lex.at : lex.at + 4] == b"xref":
            m = _TABLE.match(data, lex.at)
            if m and len(m[2]) == ENTRY * int(m[1]):
                places, lex.at = m[2], m.end()
                for k in range(int(m[1])):
                    if places[ENTRY * k + 17] == 0x6E:
                        self.xref.setdefault(k, (0, int(places[ENTRY * k : ENTRY * k + 10])))
            else:
                lex.at += 4
            while isinstance(first := lex.value(), int):
                for k in range(lex.value()):
                    if m := _PLACE.match(data, lex.at):
                        lex.at = m.end()
                        if m[2] == b"n":
                            self.xref.setdefault(first + k, (0, int(m[1])))
                        continue
                    offset, _, kind = lex.value(), lex.value(), lex.value()
                    if kind == "n":
                        self.xref.setdefault(first + k, (0, offset))
            head = lex.value()
        else:
            s = self._parse(data)[1]
            head, (a, b, c) = s.head, s.head["W"]
            rows, index = self.decoded(s), s.head.get("Index") or [0, s.head["Size"]]
            if len(rows) > self.limits.max_xref_cache_bytes:
                raise PdfError("RESOURCE_LIMIT", "the cross references take too many bytes")
            k, step = 0, a + b + c
            whole = len(rows) // step if step else 0
            for first, n in zip(index[::2], index[1::2], strict=True):
                n = max(0, min(n, whole - k))
                kinds, xs, ys = _entries(rows[k * step : (k + n) * step], a, b, c)
                k += n
                for number, kind, x, y in zip(range(first, first + n), kinds, xs, ys, strict=True):
                    if kind in (1, 2):
                        self.xref.setdefault(number, (0, x) if kind == 1 else (x, y))
        if "Encrypt" in head:
            raise PdfError("UNSUPPORTED_FEATURE", "encryption")
        for k, v in head.items():
            self.trailer.setdefault(k, v)
        return [head[k] for k in ("XRefStm", "Prev") if isinstance(head.get(k), int)]

    def _recover(self) -> None:
        """Objects as they stand in the last ``max_xref_bytes``; the last definition of a number wins."""
        size = self.source.size
        n = min(size, self.limits.max_xref_bytes)
        data, base = self.source.read(size - n, n), size - n
        self.cache.clear()
        self.boxes.clear()
        self.box = None
        self.recovered, self.sections = True, []
        self.xref = {int(m[1]): (0, base + m.start(1)) for m in re.finditer(rb"(?:^|[\r\n])[ \t]*(\d+)[ \t]+\d+[ \t]+obj\b", data)}
        roots = re.findall(rb"/Root\s+(\d+)\s+(\d+)\s+R", data)
        if not roots:
            raise PdfError("INVALID_PDF", "no cross references and no root")
        self.trailer = {"Root": Ref((int(roots[-1][0]), 0))}
        self._order()

    def _parse(self, data: bytes):
        """(number, value) of an indirect object at the start of ``data``."""
        lex = Lexer(data)
        if m := _HEAD.match(data):
            lex.at, number = m.end(), int(m[1])
        else:
            number, _, word = lex.value(), lex.value(), lex.value()
            if word != "obj":
                raise PdfError("INVALID_PDF", "no object at its offset")
        body = data[lex.at :] if len(data) <= SMALL else None
        if body in _small:
            return number, _small[body]
        value = lex.value()
        lex.skip()
        if isinstance(value, dict) and data[lex.at : lex.at + 6] == b"stream":
            start = _STREAM.match(data, lex.at).end()
            size = self.resolve(value.get("Length"))
            if not isinstance(size, int) or size < 0 or not _ENDS.match(data, start + size):
                end = data.find(b"endstream", start)
                if end < 0:
                    full = len(data) >= self.limits.max_object_bytes
                    raise PdfError("RESOURCE_LIMIT" if full else "INVALID_PDF", "a stream without an end")
                size = end - start
                while size and data[start + size - 1] in b"\r\n":
                    size -= 1
            value = Stream(value, data[start : start + size])
        elif body is not None and isinstance(value, dict):
            if len(_small) >= MOST_SMALL:
                _small.clear()
            value = _small[body] = Small(value)
            value.size = value_size(dict(value))
        return number, value

    def resolve(self, value, depth: int = 0):
        while isinstance(value, Ref):
            if depth > 32:
                raise PdfError("INVALID_PDF", "a chain of references")
            value, depth = self.object(value[0]), depth + 1
        return value

    def object(self, number: int):
        held = self.cache.get(number)
        if held is not None:
            return held
        try:
            value = self._load(number)
        except PdfError as e:
            if e.code != "INVALID_PDF" or self.recovered:
                raise
            self._recover()
            value = self._load(number)
        except (EOFError, ValueError, KeyError, IndexError, AttributeError, Damaged):
            if self.recovered:
                raise
            self._recover()
            value = self._load(number)
        if value is not None:
            self.cache.put(number, value, value_size(value))
        return value

    def _load(self, number: int):
        where = self.xref.get(number)
        if where is None:
            return None
        if not where[0]:
            got, value = self._parse(self._window(where[1]))
            if got != number:
                raise PdfError("INVALID_PDF", "another object at its offset")
            return value
        try:
            held = self._container(where[0]).object(number, where[1])
        except Damaged as e:
            raise PdfError("INVALID_PDF", str(e)) from e
        except TooLarge as e:
            raise PdfError("RESOURCE_LIMIT", str(e)) from e
        return Lexer(held).value()

    def _container(self, number: int) -> Container:
        """An object stream. One whose filters are more than Flate is decoded whole, and the one used last is kept, whatever its size."""
        held = self.boxes.get(number) or (self.box if self.box and self.box[0] == number else (0, None))[1]
        if held is None:
            box = self.object(number)
            if not isinstance(box, Stream):
                raise PdfError("INVALID_PDF", "an object stream is missing")
            n, first = self.resolve(box.head.get("N")), self.resolve(box.head.get("First"))
            if not isinstance(n, int) or not isinstance(first, int):
                raise PdfError("INVALID_PDF", "an object stream without its numbers")
            most, flate = self.limits.max_object_stream_decoded_bytes, self._only_flate(box.head)
            raw = box.raw if flate or not box.head.get("Filter") else self.decoded(box, most)
            bounds = {"most": most, "object_bytes": self.limits.max_object_bytes, "index_bytes": self.limits.max_object_cache_bytes}
            held = Container(raw, flate, n, first, **bounds)
            self.box = number, held
            self.boxes.put(number, held, len(raw) + held.held())
        return held

    def _only_flate(self, head: dict) -> bool:
        """Whether a stream's one filter is Flate without a predictor."""
        names, parms = self.resolve(head.get("Filter")), self.resolve(head.get("DecodeParms", head.get("DP")))
        name = names[0] if isinstance(names, list) and len(names) == 1 else names
        parms = self.resolve(parms[0]) if isinstance(parms, list) and parms else parms
        return self.resolve(name) in ("FlateDecode", "Fl") and (not isinstance(parms, dict) or self.resolve(parms.get("Predictor", 1)) == 1)

    def decoded(self, s: Stream, most: int | None = None, until: str | None = None) -> bytes:
        """A stream's bytes after its filters; ``until`` names a filter whose input is wanted."""
        most = most or self.limits.max_decoded_stream_bytes
        names = self.resolve(s.head.get("Filter", s.head.get("F"))) or []
        parms = self.resolve(s.head.get("DecodeParms", s.head.get("DP"))) or []
        names = names if isinstance(names, list) else [names]
        parms = parms if isinstance(parms, list) else [parms]
        data = s.raw
        for k, name in enumerate(map(self.resolve, names)):
            if until and name in (until, until.removesuffix("Decode")):
                return data
            p = {a: self.resolve(b) for a, b in ((self.resolve(parms[k]) if k < len(parms) else None) or {}).items()}
            if name in ("FlateDecode", "Fl"):
                data = unpredict(inflate(data, most), p)
            elif name in ("LZWDecode", "LZW"):
                data = unpredict(lzw(data, p.get("EarlyChange", 1), most), p)
            elif name in ("CCITTFaxDecode", "CCF") and p.get("K", 0) < 0:
                data = group4(data, p.get("Columns", 1728), p.get("Rows") or None, bool(p.get("BlackIs1")))
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"\s", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise PdfError("UNSUPPORTED_FEATURE", f"filter {name}")
        return data

    # -- pages
    def _root(self):
        return self.resolve(self.trailer["Root"]).get("Pages")

    def page_count(self) -> int:
        n = self.resolve(self.resolve(self._root()).get("Count"))
        return n if isinstance(n, int) else sum(1 for _ in self.pages())

    def _node(self, ref, inherited: dict, depth: int) -> tuple[dict, dict]:
        if depth > self.limits.max_page_tree_depth:
            raise PdfError("INVALID_PDF", "the page tree is too deep or has a cycle")
        node = self.resolve(ref)
        if not isinstance(node, dict):
            raise PdfError("INVALID_PDF", "a page-tree object is missing")
        return node, inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}

    def pages(self, first: int = 0, last: int | None = None) -> Iterator[dict]:
        """Page dictionaries ``first`` to ``last`` (not included), with what they inherit; whole
        branches before the first are stepped over by their counts."""
        stack, skip, left = [(self._root(), {}, 0)], first, float("inf") if last is None else last - first
        while stack and left > 0:
            ref, inherited, depth = stack.pop()
            node, own = self._node(ref, inherited, depth)
            kids = self.resolve(node.get("Kids"))
            if not isinstance(kids, list):
                if skip:
                    skip -= 1
                    continue
                left -= 1
                yield node | own
                continue
            count = self.resolve(node.get("Count"))
            if depth and isinstance(count, int) and 0 <= count <= skip:
                skip -= count
                continue
            stack += [(k, own, depth + 1) for k in reversed(kids)]


_STREAM, _ENDS = re.compile(rb"stream(\r\n|\n|\r)?"), re.compile(rb"\s*endstream")


def extract(source, limits: Limits | None = None, first: int = 0, last: int | None = None) -> Iterator[dict]:
    """Page dictionaries of a file (bytes or a source), pages ``first`` to ``last`` (not included)."""
    doc = Document(source, limits)
    for number, node in enumerate(doc.pages(first, last), first + 1):
        yield _interpreted(doc, number, node, *_content(doc, node))


def _content(doc: Document, node: dict) -> tuple[tuple[float, float, float, float], bytes]:
    """The box and the content of a page."""
    raw = doc.resolve(node.get("CropBox") or node.get("MediaBox"))
    if not isinstance(raw, list):
        raise PdfError("INVALID_PDF", "a page without a MediaBox")
    a = [float(doc.resolve(v)) for v in raw]
    box = (min(a[0], a[2]), min(a[1], a[3]), max(a[0], a[2]), max(a[1], a[3]))
    contents = doc.resolve(node.get("Contents")) or []
    parts = contents if isinstance(contents, list) else [contents]
    body, room = [], doc.limits.max_decoded_stream_bytes
    for p in parts:
        if isinstance(s := doc.resolve(p), Stream):
            body.append(doc.decoded(s))
            room -= len(body[-1])
            if room < 0:
                raise PdfError("RESOURCE_LIMIT", "a page's content is too long")
    return box, b"\n".join(body)


def _turned(doc: Document, node: dict) -> int:
    rotate = int(doc.resolve(node.get("Rotate")) or 0) % 360
    return rotate if rotate % 90 == 0 else 0


def _interpreted(doc: Document, number: int, node: dict, box: tuple[float, float, float, float], body: bytes) -> dict:
    page = Interpreter(doc, box, doc.limits.max_form_depth)
    page.run(body, doc.resolve(node.get("Resources")) or {}, (1.0, 0.0, 0.0, 1.0, -box[0], -box[1]))
    if links := links_of(doc, node, box):
        attach_links(page.spans, links)
    if any(RIGHT_TO_LEFT.search(s["text"]) for s in page.spans):
        page.spans = [s | {"seq": k} for k, s in enumerate(in_script_order(page.spans))]
    return {
        "page": number, "width": box[2] - box[0], "height": box[3] - box[1], "rotate": _turned(doc, node),
        "spans": page.spans, "fills": page.fills, "paths": page.paths, "images": page.images, "error": None,
    }


def error_of(e: Exception) -> dict:
    """The typed error of any exception."""
    if isinstance(e, PdfError):
        return {"code": e.code, "message": str(e)}
    return {"code": "INVALID_PDF", "message": repr(e)[:200]}


def _by_mode(name: str, mode: str, rows: Iterator, make=None) -> Iterator:
    """``rows``, or what ``make`` makes of each; by ``mode`` an error is a row, nothing, or raised."""
    try:
        for row in rows:
            yield make(*row) if make else row
    except Exception as e:  # noqa: BLE001  damaged input shows in many ways
        if mode == "FAILFAST":
            raise
        if mode != "DROPMALFORMED":
            yield {"doc_id": name, "error": error_of(e)}


def rows_of(name: str, source, limits: Limits, mode: str = "PERMISSIVE", first: int = 0, last: int | None = None) -> Iterator[dict]:
    """Page rows of one file; by ``mode`` an error is a row, nothing, or raised."""
    return _by_mode(name, mode, ({"doc_id": name} | p for p in extract(source, limits, first, last)))


#: A batch ends with the file that brings its pages and spans to this number, or its files to so many bytes.
BATCH_WEIGHT, BATCH_BYTES = 5000, 4 << 20


def batch_of(rows: list[dict], schema, mode: str = "PERMISSIVE"):
    """Page rows as an Arrow batch. If one can't be told in Arrow, each file's rows go by themselves, and
    those of a file that still fails are its error, by ``mode``."""
    import pyarrow as pa

    try:
        return pa.RecordBatch.from_pylist(rows, schema)
    except (pa.ArrowException, ValueError, TypeError, OverflowError) as e:
        if mode == "FAILFAST":
            raise
        names = list(dict.fromkeys(r["doc_id"] for r in rows))
        if len(names) > 1:
            parts = [batch_of([r for r in rows if r["doc_id"] == n], schema, mode) for n in names]
            return pa.Table.from_batches(parts, schema).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_pylist([{"doc_id": names[0], "error": error_of(e)}] if mode == "PERMISSIVE" else [], schema)


def _rows_or_plain(name: str, source, limits: Limits, mode: str, first: int, last: int | None, plain: shown.Pages) -> Iterator[dict | int]:
    """``rows_of``, but a page that ``plain`` takes is its number of strings."""

    def pages() -> Iterator[dict | int]:
        doc = Document(source, limits)
        for number, node in enumerate(doc.pages(first, last), first + 1):
            box, body = _content(doc, node)
            otherwise = lambda *page: {"doc_id": name} | _interpreted(doc, *page)
            taken = None if node.get("Annots") else _as_strings(doc, name, number, node, box, body, plain, lambda page=(number, node, box, body): _by_mode(name, mode, iter([page]), otherwise))
            yield taken or otherwise(number, node, box, body)

    return _by_mode(name, mode, pages())


def _as_strings(doc: Document, name: str, number: int, node: dict, box, body: bytes, plain: shown.Pages, otherwise) -> int | None:
    try:
        fonts = doc.resolve((doc.resolve(node.get("Resources")) or {}).get("Font")) or {}
        font = lambda key: font_of(doc.resolve(fonts.get(key)) or {}, doc)
        return plain.add(name, number, box, _turned(doc, node), body, font, otherwise)
    except Exception:  # noqa: BLE001  what is damaged is told, or raised, by the interpreter
        return None


def _batches(rows: list[dict], plain: shown.Pages, schema, mode: str):
    """Arrow batches of page rows and of plain pages."""
    if plain.rows:
        told, others = plain.told(schema)
        yield told
        rows = [*rows, *(row for make in others for row in make())]
    if rows:
        yield batch_of(rows, schema, mode)


def pages_of(files: DataFrame, mode: str = "PERMISSIVE", pages: tuple[int, int] | None = None, **limits: int) -> DataFrame:
    """Page rows of (doc_id, content) rows, all or those from the first to the last of ``pages``
    (from 1); ``limits`` by their names in ``Limits``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PAGES))
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError("mode: PERMISSIVE, DROPMALFORMED or FAILFAST")
    bounds = Limits(**limits)
    first, last = (pages[0] - 1, pages[1]) if pages else (0, None)

    def run(batches):
        for batch in batches:
            out: list[dict] = []
            plain, weight, held = shown.Pages(), 0, 0
            for name, content in ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for k in range(len(batch))):
                for row in _rows_or_plain(name, content or b"", bounds, mode, first, last, plain):
                    if isinstance(row, dict):
                        out.append(row)
                        row = len(row.get("spans") or ())
                    weight += row + 1
                    if weight >= BATCH_WEIGHT or held >= BATCH_BYTES:
                        yield from _batches(out, plain, schema, mode)
                        out, plain, weight, held = [], shown.Pages(), 0, 0
                held += len(content or b"")
            yield from _batches(out, plain, schema, mode)

    return files.select("doc_id", "content").mapInArrow(run, PAGES)


def read_pages(spark: SparkSession, path: str, mode: str = "PERMISSIVE", pages: tuple[int, int] | None = None, **limits: int) -> DataFrame:
    """Pages of the PDF files at a path or glob of any file system that Spark reads."""
    return pages_of(spark.read.format("binaryFile").load(path).selectExpr("path as doc_id", "content"), mode, pages, **limits)


# ---------------------------------------------------------------- fonts
def fonts_in(name: str, source, limits: Limits | None = None) -> Iterator[dict]:
    """A row for each font that a file's pages name: once by its object and name, from the first page that has it."""
    doc, seen = Document(source, limits), set()
    for number, node in enumerate(doc.pages(), 1):
        fonts = doc.resolve((doc.resolve(node.get("Resources")) or {}).get("Font")) or {}
        for key, ref in fonts.items():
            mark = (key, ref if isinstance(ref, Ref) else id(ref))
            head = doc.resolve(ref)
            if mark in seen or not isinstance(head, dict):
                continue
            seen.add(mark)
            yield {"doc_id": name, "page": number, "font_name": key, "error": None} | asset_of(head, doc)


def fonts_of(files: DataFrame, mode: str = "PERMISSIVE", **limits: int) -> DataFrame:
    """The fonts of (doc_id, content) rows; a broken file is a row with its error, by ``mode``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema, bounds = to_arrow_schema(StructType.fromDDL(FONTS)), Limits(**limits)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for k in range(len(batch))):
                try:
                    rows = list(fonts_in(name, content or b"", bounds))
                except Exception as e:  # noqa: BLE001  damaged input shows in many ways
                    if mode == "FAILFAST":
                        raise
                    rows = [{"doc_id": name, "error": error_of(e)}] if mode == "PERMISSIVE" else []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("doc_id", "content").mapInArrow(run, FONTS)


def font_assets(fonts: DataFrame) -> DataFrame:
    """One row a distinct program over all files, by its content: where it is first seen, its format, bytes and glyphs."""
    held = fonts.where("font_id is not null")
    first = F.struct("doc_id", "page", "font_name")
    return held.groupBy("font_id").agg(*[F.min_by(c, first).alias(c) for c in ("doc_id", "page", "family", "format", "data", "glyphs")])


def spans_with_fonts(spans: DataFrame, fonts: DataFrame) -> DataFrame:
    """``spans`` (doc_id, page, font_name, ...) with font_id: of the fonts that the file has by that name, the one of the last page up to theirs."""
    named = fonts.where("font_id is not null").groupBy("doc_id", "font_name").agg(F.array_sort(F.collect_list(F.struct("page", "font_id"))).alias("has"))
    met = spans.join(named, ["doc_id", "font_name"], "left")
    return met.withColumn("font_id", F.element_at(F.filter("has", lambda x: x["page"] <= F.col("page")), -1)["font_id"]).drop("has")
