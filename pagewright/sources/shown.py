"""Pages that show plain strings and paint nothing else, told a batch at a time in arrays.

Such a page's content is one text object of strings, each with its font and place in one form (``/F 10 Tf 1 0 0 1 x y Tm (text) Tj``), upright, of printable
ASCII that the font gives back as it is, and all on the page. ``content.Interpreter`` gives what is told here, bit by bit; all other pages go through it.
"""

from __future__ import annotations

import re

import numpy as np

_N = rb"(-?\d+(?:\.\d+)?)"
_S = rb"[\x00\t\n\x0c\r ]+"
#: Operands of one string; nine groups. A string of more characters is left to the interpreter.
_STRING = re.compile(rb"[\x00\t\n\x0c\r ]*/([A-Za-z0-9]+)" + (_S + _N) + _S + b"Tf" + (_S + _N) * 6 + _S + rb"Tm[\x00\t\n\x0c\r ]*\(([!-'*-\[\]-~][ -'*-\[\]-~]{0,255})\)[\x00\t\n\x0c\r ]*Tj(?=[\x00\t\n\x0c\r ]|\Z)")
GROUPS = 9
_WHITE = b"\x00\t\n\x0c\r "
PRINTABLE = bytes(range(32, 127))


def advances_of(font) -> np.ndarray | None:
    """Advances by code of a font that gives printable ASCII back as it is, else None; told once a font."""
    if not hasattr(font, "printable"):
        font.printable = None
        if font.step == 1 and font.map is None and not font.vertical:
            glyphs = font.glyphs(PRINTABLE)
            if [(t, s) for t, _, s in glyphs] == [(chr(c), c == 32) for c in PRINTABLE]:
                font.printable = np.zeros(256)
                font.printable[32:127] = [w for _, w, _ in glyphs]
    return font.printable


class Pages:
    """Pages of the batch in hand, each with what makes its row where it is not plain after all."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.parts: list[bytes] = []
        self.counts: list[int] = []
        self.fonts: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.font: list[int] = []

    def add(self, name: str, page: int, box: tuple, rotate: int, body: bytes, font_of, otherwise) -> int | None:
        """Takes a page whose content has the form, and says how many strings it has; None for any other.

        ``font_of`` gives the font of a name, ``otherwise`` the page's row by the interpreter."""
        parts = _STRING.split(body)
        n = len(parts) // (GROUPS + 1)
        if not n or parts[0].strip(_WHITE) != b"BT" or parts[-1].strip(_WHITE) != b"ET" or any(parts[GROUPS + 1 : -1 : GROUPS + 1]):
            return None
        places = {}
        for key in set(parts[1 :: GROUPS + 1]):
            word = key.decode("latin-1")
            font = font_of(word)
            if advances_of(font) is None:
                return None
            places[key] = self.known.setdefault((word, id(font)), len(self.fonts))
            if places[key] == len(self.fonts):
                self.fonts.append((word, font))
        if len(places) == 1:
            self.font += [*places.values()] * n
        else:
            self.font += [places[key] for key in parts[1 :: GROUPS + 1]]
        del parts[0]
        self.parts += parts
        self.counts.append(n)
        self.rows.append((name, page, box, rotate, otherwise))
        return n

    def told(self, schema):
        """(an Arrow batch of the plain pages, makers of the others' rows)."""
        import pyarrow as pa

        of = lambda k: self.parts[k :: GROUPS + 1]
        number = lambda k: pa.array(of(k), pa.binary()).cast(pa.string()).cast(pa.float64()).to_numpy()
        counts, font = np.array(self.counts), np.array(self.font)
        page = np.repeat(np.arange(len(counts)), counts)
        size, a, b, c, d, e, f = (number(k) for k in range(1, 8))
        text = pa.array(of(8), pa.binary())
        box = np.array([r[2] for r in self.rows], float)
        x0, y0, x1, y1 = (box[page, k] for k in range(4))
        width = _widths(text, font, size, np.stack([advances_of(f) for _, f in self.fonts]))
        # as in Interpreter.straight
        end = width * a + e
        x, ex, base = 1.0 * e + -x0, 1.0 * end + -x0, 1.0 * f + -y0
        y, uy = 1.0 * (f + 0.0) + -y0, 1.0 * (np.abs(size) * d + f + 0.0) + -y0
        far, high = np.abs(ex - x), np.abs(uy - y)
        on = (b == 0) & (c == 0)
        for v, most in ((x, x1 - x0), (ex, x1 - x0), (base, y1 - y0)):
            on &= (v >= 0) & (v <= most)
        plain = np.ones(len(counts), bool)
        plain[page[~on]] = False
        others = [r[4] for r, p in zip(self.rows, plain.tolist(), strict=True) if not p]
        if others:
            kept = plain[page]
            text, counts = text.filter(pa.array(kept)), counts[plain]
            font, x, y, ex, uy, far, high = (v[kept] for v in (font, x, y, ex, uy, far, high))
        rows = [r for r, p in zip(self.rows, plain.tolist(), strict=True) if p]
        return self._batch(rows, counts, font, text.cast(pa.string()), x, y, ex, uy, far, high, schema), others

    def _batch(self, rows, counts, font, text, x, y, ex, uy, far, high, schema):
        import pyarrow as pa

        n, ends = len(text), np.append(0, np.cumsum(counts)).astype(np.int32)
        one = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
        named = lambda values: pa.array(values, pa.string()).take(pa.array(font))
        flat = (far == 0) | (high == 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            matrix = np.stack([(ex - x) / far, np.full(n, -0.0), np.full(n, -0.0), (uy - y) / high], axis=1)[~flat].ravel()
        begins = np.append(0, np.cumsum(np.where(flat, 0, 4))).astype(np.int32)
        made = {
            "seq": lambda: pa.array((np.arange(n) - np.repeat(ends[:-1], counts)).astype(np.int32)),
            "text": lambda: text,
            "has_leading_space": lambda: one(False, pa.bool_()),
            "natural_width": lambda: pa.array(far),
            "bounds": lambda: pa.StructArray.from_arrays([pa.array(v) for v in (x, y, far, high)], ["x", "y", "width", "height"]),
            "direction": lambda: one("ltr", pa.string()),
            "font_name": lambda: named([w for w, _ in self.fonts]),
            "font_family": lambda: named([f.family or None for _, f in self.fonts]),
            "color": lambda: one("#000000", pa.string()),
            "fill_opacity": lambda: one(1.0, pa.float64()),
            "rendering_mode": lambda: one(0, pa.int32()),
            "font_size": lambda: pa.array(high),
            "transform": lambda: pa.ListArray.from_arrays(pa.array(begins, mask=np.append(flat, False)), pa.array(matrix)),
        }
        kinds = schema.field("spans").type.value_type
        spans = pa.StructArray.from_arrays([made[k.name]().cast(k.type) if k.name in made else pa.nulls(n, k.type) for k in kinds], fields=list(kinds))
        box = np.array([r[2] for r in rows], float).reshape(-1, 4)
        columns = {
            "doc_id": pa.array([r[0] for r in rows], pa.string()),
            "page": pa.array([r[1] for r in rows], pa.int32()),
            "width": pa.array(box[:, 2] - box[:, 0]),
            "height": pa.array(box[:, 3] - box[:, 1]),
            "rotate": pa.array([r[3] for r in rows], pa.int32()),
            "spans": pa.ListArray.from_arrays(pa.array(ends), spans, type=schema.field("spans").type),
            "error": pa.nulls(len(rows), schema.field("error").type),
        }
        empty = lambda kind: pa.ListArray.from_arrays(pa.array(np.zeros(len(rows) + 1, np.int32)), pa.nulls(0, kind.value_type), type=kind)
        return pa.RecordBatch.from_arrays([columns[k.name] if k.name in columns else empty(k.type) for k in schema], schema=schema)


def _widths(text, font: np.ndarray, size: np.ndarray, advances: np.ndarray) -> np.ndarray:
    """Sums of the advances of each string's characters, compensated as Python's ``sum`` does it."""
    offsets, codes = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1], np.frombuffer(text.buffers()[2], np.uint8)
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    at, font, size = offsets[:-1][order], font[order], size[order]
    total, rest = np.zeros(len(text)), np.zeros(len(text))
    left = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
    for k, n in enumerate(left.tolist()):
        w, held = advances[font[:n], codes[at[:n] + k]] / 1000 * size[:n], total[:n]
        now = held + w
        rest[:n] += np.where(np.abs(held) >= np.abs(w), (held - now) + w, (w - now) + held)
        total[:n] = now
    out = np.empty(len(text))
    out[order] = np.where(np.isfinite(rest), total + rest, total)
    return out
