"""Content streams: the text and graphics state machine, positioned spans, fills, paths and images."""

from __future__ import annotations

import re
from math import hypot

from .fonts import Font, font_of, pdf_string
from .geometry import common_area, convex, flattened, inside_convex

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
TAIL = 64
# fixed values: short keys of inline images
INLINE = {"W": "Width", "H": "Height", "IM": "ImageMask", "F": "Filter", "DP": "DecodeParms", "D": "Decode", "BPC": "BitsPerComponent", "CS": "ColorSpace", "I": "Interpolate"}
_N = rb"([+-]?(?:\d+\.?\d*|\.\d+))"
_S = rb"[\x00\t\n\x0c\r ]+"
#: A string in one font at one place, as most writers tell it: its seven operators' worth of operands in one look.
_SHOWN = re.compile(rb"[\x00\t\n\x0c\r ]*/([A-Za-z0-9]+)" + (_S + _N) + _S + b"Tf" + (_S + _N) * 6 + _S + rb"Tm[\x00\t\n\x0c\r ]*\(([^()\\]*)\)[\x00\t\n\x0c\r ]*Tj(?=[\x00\t\n\x0c\r ]|\Z)")


def times(a, b):
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def moved(x: float, y: float, m):
    return (1.0, 0.0, 0.0, 1.0, x, y) if m is None else times((1.0, 0.0, 0.0, 1.0, x, y), m)


def point(m, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def hex_colour(parts) -> str | None:
    """#rrggbb of gray, RGB or CMYK parts."""
    parts = [p for p in parts if isinstance(p, (int, float))]
    if len(parts) == 4:
        parts = [1 - min(1.0, p + parts[3]) for p in parts[:3]]
    elif len(parts) == 1:
        parts = parts * 3
    if len(parts) != 3:
        return None
    return "#" + "".join(f"{int(min(1, max(0, x)) * 255 + 0.5):02x}" for x in parts)


def space_parts(doc, space) -> int | None:
    """How many numbers a colour of a space has; None for spaces that are not resolved."""
    space = doc.resolve(space)
    if isinstance(space, list) and space:
        kind = doc.resolve(space[0])
        if kind == "ICCBased":
            return doc.resolve(doc.resolve(space[1]).head.get("N"))
        space = kind
    return {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}.get(space)


def axial_colour(doc, shading: dict) -> str | None:
    """The colour midway along an axial shading with an exponential function."""
    f = doc.resolve(shading.get("Function"))
    f = getattr(f, "head", f)
    if doc.resolve(shading.get("ShadingType")) != 2 or not isinstance(f, dict):
        return None
    if doc.resolve(f.get("FunctionType")) == 3:
        f = doc.resolve(doc.resolve(f["Functions"])[len(doc.resolve(f["Functions"])) // 2])
    if doc.resolve(f.get("FunctionType")) != 2:
        return None
    a, b = doc.resolve(f.get("C0")) or [0], doc.resolve(f.get("C1")) or [1]
    share = 0.5 ** (doc.resolve(f.get("N")) or 1)
    return hex_colour([x + share * (y - x) for x, y in zip(a, b, strict=True)])


def path_data(path: list[list]) -> str:
    n = lambda v: f"{round(v, 3):g}"
    return " ".join("Z" if k == "Z" else f"{k} " + " ".join(f"{n(x)} {n(y)}" for x, y in p) for sub in path for k, p in sub)


class Clip:
    """A path that bounds what is painted after it."""

    def __init__(self, path: list[list], rule: str):
        self.d, self.rule, self.shape = path_data(path), rule, flattened(path)


def told(clips: tuple[Clip, ...]) -> list[dict] | None:
    """Clips as rows, outermost first; null for none."""
    return [{"d": c.d, "fill_rule": c.rule} for c in clips] or None


def visible(shape: list, rule: str, clips: tuple[Clip, ...]) -> float:
    """The area of a shape inside all clips."""
    return common_area([(shape, rule == "evenodd"), *((c.shape, c.rule == "evenodd") for c in clips)])


class State(dict):
    __getattr__ = dict.__getitem__

    @classmethod
    def new(cls, ctm, clips: tuple = ()):
        return cls(
            ctm=ctm, font=None, name=None, size=0.0, Tc=0.0, Tw=0.0, Tz=1.0, TL=0.0, Ts=0.0, Tr=0, fill="#000000", stroke="#000000",
            fill_n=None, stroke_n=None, ca=1.0, CA=1.0, width=1.0, cap=0, join=0, dash=([], 0.0), clips=clips,
        )


class Interpreter:
    """Runs content streams of one page. Forms are run in place; one inside itself, or beyond
    ``form_depth``, is left out, as its reader would. With ``masks``, inline masks are fills: a box a run."""

    def __init__(self, doc, box: tuple[float, float, float, float], form_depth: int = 32, masks: bool = False):
        self.doc, self.box, self.form_depth, self.masks = doc, box, form_depth, masks
        self.spans: list[dict] = []
        self.fills: list[dict] = []
        self.paths: list[dict] = []
        self.images: list[dict] = []
        self.fonts: dict[int, Font] = {}
        self.adjust = 0.0

    def font(self, ref, fonts: dict) -> Font:
        head = self.doc.resolve(fonts.get(ref)) or {}
        if id(head) not in self.fonts:
            self.fonts[id(head)] = font_of(head, self.doc)
        return self.fonts[id(head)]

    def run(self, data: bytes, resources: dict, ctm, depth: int = 0, inside: tuple = (), clips: tuple = ()) -> None:
        from .pdf import Lexer, Operator, PdfError

        doc, lex = self.doc, Lexer(data, refs=False)
        part = lambda name: doc.resolve(resources.get(name)) or {}
        fonts, objects, states, spaces, shadings = (part(n) for n in ("Font", "XObject", "ExtGState", "ColorSpace", "Shading"))
        g, stack, args, clipping = State.new(ctm, clips), [], [], None
        tm = line = IDENTITY
        path: list[list] = []
        while True:
            if not args and (m := _SHOWN.match(data, lex.at)):
                name, size, *place, raw = m.groups()
                name = name.decode("latin-1")
                try:
                    g["font"], g["name"], g["size"] = self.font(name, fonts), name, float(size)
                    line = tuple(map(float, place))
                    tm = self.show(raw, g, line)
                    lex.at = m.end()
                    continue
                except (IndexError, TypeError):
                    pass  # told one by one below
            begun = lex.at
            try:
                v = lex.value()
            except EOFError:
                return
            except (PdfError, ValueError, IndexError):
                if len(data) - begun <= TAIL:  # a damaged tail
                    return
                raise
            if not isinstance(v, Operator):
                args.append(v)
                continue
            op, a, args = str(v), args, []
            try:
                if op == "q":
                    stack.append(State(g))
                elif op == "Q":
                    g, clipping = stack.pop() if stack else State(g, ctm=IDENTITY, clips=()), None
                elif op == "cm":
                    g["ctm"] = times(a[-6:], g.ctm)
                elif op == "BT":
                    tm = line = IDENTITY
                elif op == "Tf":
                    g["font"], g["name"], g["size"] = self.font(a[0], fonts), str(a[0]), float(a[1])
                elif op in ("Tc", "Tw", "TL", "Ts", "Tr"):
                    g[op] = a[-1]
                elif op == "Tz":
                    g["Tz"] = a[-1] / 100
                elif op == "Tm":
                    tm = line = tuple(map(float, a[-6:]))
                elif op in ("Td", "TD"):
                    if op == "TD":
                        g["TL"] = -a[-1]
                    tm = line = moved(a[-2], a[-1], line)
                elif op in ("g", "rg", "k"):
                    g["fill"] = hex_colour(a) or g.fill
                elif op in ("G", "RG", "K"):
                    g["stroke"] = hex_colour(a) or g.stroke
                elif op in ("cs", "CS"):
                    key, colour = ("fill_n", "fill") if op == "cs" else ("stroke_n", "stroke")
                    g[key] = space_parts(doc, spaces.get(a[-1], a[-1]))
                    g[colour] = "#000000"
                elif op in ("sc", "scn", "SC", "SCN"):
                    key, n = ("fill", g.fill_n) if op[0] == "s" else ("stroke", g.stroke_n)
                    numbers = [x for x in a if isinstance(x, (int, float))]
                    if n in (None, len(numbers)):
                        g[key] = hex_colour(numbers) or g[key]
                elif op == "w":
                    g["width"] = a[-1]
                elif op in ("J", "j"):
                    g["cap" if op == "J" else "join"] = int(a[-1])
                elif op == "d":
                    g["dash"] = (list(a[0]), float(a[1]))
                elif op == "gs":
                    self.ext(g, doc.resolve(states.get(a[-1])) or {})
                elif op == "BI":
                    begun, lex.at = lex.at, self.inline_end(data, lex.at)
                    if self.masks:
                        self.mask(data[begun : lex.at], g)
                elif op == "Do":
                    self.do(a[-1], objects, resources, g, depth, inside)
                elif op == "sh":
                    colour = axial_colour(doc, doc.resolve(shadings.get(a[-1])) or {})
                    if colour and g.clips:  # a shading paints what its innermost clip bounds, and nothing without one
                        self.shade(colour, g)
                elif op in ("m", "l"):
                    if op == "m" or not path:
                        path.append([])
                    path[-1].append(("M" if op == "m" else "L", [point(g.ctm, *a[-2:])]))
                elif op in ("c", "v", "y") and path:
                    p = [point(g.ctm, a[k], a[k + 1]) for k in range(0, len(a) - 1, 2)]
                    if op == "v":
                        p.insert(0, path[-1][-1][1][-1])
                    elif op == "y":
                        p.append(p[-1])
                    path[-1].append(("C", p))
                elif op == "h" and path:
                    path[-1].append(("Z", [path[-1][0][1][0]]))
                elif op == "re":
                    x, y, w, h = a[-4:]
                    p = [point(g.ctm, *q) for q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                    path.append([("M", [p[0]]), *[("L", [q]) for q in p[1:]], ("Z", [p[0]])])
                elif op in ("f", "F", "f*", "B", "B*", "b", "b*", "S", "s", "n"):
                    if op in ("b", "b*", "s") and path:
                        path[-1].append(("Z", [path[-1][0][1][0]]))
                    if clipping and path:
                        g["clips"] = (*g.clips, Clip(path, clipping))
                    clipping = None
                    self.paint(path, g, op)
                    path = []
                elif op in ("W", "W*"):
                    clipping = "evenodd" if op == "W*" else "nonzero"
                if op in ("T*", "'", '"'):
                    tm = line = moved(0, -g.TL, line)
                if op == '"':
                    g["Tw"], g["Tc"] = a[0], a[1]
                if op in ("Tj", "TJ", "'", '"') and a:
                    for x in a[-1] if op == "TJ" else [a[-1]]:
                        if isinstance(x, bytes):
                            tm = self.show(x, g, tm)
                        elif isinstance(x, (int, float)):
                            self.adjust += x
                            shift = -x / 1000 * g.size
                            tm = moved(0, shift, tm) if g.font and g.font.vertical else moved(shift * g.Tz, 0, tm)
            except (IndexError, TypeError):
                if len(data) - lex.at > TAIL:
                    continue  # an operator without its operands changes nothing
                return

    @staticmethod
    def inline_end(data: bytes, at: int) -> int:
        import re

        m = re.compile(rb"\sEI(?=[\s]|$)").search(data, max(at, data.find(b"ID", at)))
        return m.end() if m else len(data)

    def mask(self, data: bytes, g: State) -> None:
        """An inline image mask as boxes: those of each row's painted pixels that stand together."""
        import numpy as np

        from .pdf import Lexer, Operator, Stream

        lex, head = Lexer(data, refs=False), {}
        while not isinstance(key := lex.value(), Operator):
            head[INLINE.get(str(key), str(key))] = lex.value()
        if not head.get("ImageMask") or key != "ID":
            return
        width, height = int(head["Width"]), int(head["Height"])
        filters, parms = head.get("Filter"), head.get("DecodeParms") or {}
        last = (filters[-1] if isinstance(filters, list) else filters) if filters else None
        if last in ("CCF", "CCITTFaxDecode"):
            own = parms[-1] if isinstance(parms, list) else parms
            own = {"Columns": width, "Rows": height} | (own if isinstance(own, dict) else {})
            head["DecodeParms"] = [*parms[:-1], own] if isinstance(parms, list) else own
        raw = self.doc.decoded(Stream(head, data[lex.at + 1 : len(data) - 3]))
        step = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(raw[: step * height].ljust(step * height, b"\xff"), np.uint8).reshape(height, step), axis=1)[:, :width]
        painted = bits == (1 if (head.get("Decode") or [0])[0] == 1 else 0)
        turns = np.diff(np.pad(painted, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        for (r, a), (_, b) in zip(np.argwhere(turns > 0).tolist(), np.argwhere(turns < 0).tolist(), strict=True):
            top, low = 1 - r / height, 1 - (r + 1) / height
            corners = [point(g.ctm, x, y) for x, y in ((a / width, low), (b / width, low), (b / width, top), (a / width, top))]
            self.fills.append({"points": [{"x": x, "y": y} for x, y in corners], "color": g.fill, "opacity": g.ca, "visible": None})

    def ext(self, g: State, e: dict) -> None:
        for key, to in (("LW", "width"), ("LC", "cap"), ("LJ", "join"), ("ca", "ca"), ("CA", "CA")):
            if isinstance(v := self.doc.resolve(e.get(key)), (int, float)):
                g[to] = v
        if isinstance(d := self.doc.resolve(e.get("D")), list):
            g["dash"] = (list(self.doc.resolve(d[0])), float(self.doc.resolve(d[1])))
        if isinstance(f := self.doc.resolve(e.get("Font")), list):
            g["font"], g["size"] = self.font("f", {"f": f[0]}), float(self.doc.resolve(f[1]))

    def do(self, name, objects: dict, resources: dict, g: State, depth: int, inside: tuple) -> None:
        from .pdf import Stream

        ref = objects.get(name)
        x = self.doc.resolve(ref)
        if not isinstance(x, Stream):
            return
        kind = x.head.get("Subtype")
        if kind == "Form" and depth < self.form_depth and ref not in inside:
            own = self.doc.resolve(x.head.get("Resources")) or resources
            matrix = tuple(map(float, self.doc.resolve(x.head.get("Matrix")) or IDENTITY))
            self.run(self.doc.decoded(x), own, times(matrix, g.ctm), depth + 1, (*inside, ref), g.clips)
        elif kind == "Image":
            self.image(x, g)

    def image(self, x, g: State) -> None:
        """JPEG data as it is; other images of eight bits in RGB, gray is left out."""
        get = lambda k: self.doc.resolve(x.head.get(k))
        filters = get("Filter") or []
        filters = filters if isinstance(filters, list) else [filters]
        jpeg = bool(filters) and filters[-1] in ("DCTDecode", "DCT")
        if not jpeg and (get("BitsPerComponent") != 8 or space_parts(self.doc, get("ColorSpace")) != 3):
            return
        data = self.doc.decoded(x, until="DCTDecode") if jpeg else self.doc.decoded(x)
        self.images.append(
            {"width": get("Width"), "height": get("Height"), "format": "jpeg" if jpeg else "rgb", "data": data, "transform": list(map(float, g.ctm)), "opacity": g.ca, "clips": told(g.clips)}
        )

    def shade(self, colour: str, g: State) -> None:
        """The innermost clip filled with a colour, inside the clips around it."""
        inner, around = g.clips[-1], g.clips[:-1]
        for part in inner.shape:
            self.fills.append({"points": [{"x": x, "y": y} for x, y in part], "color": colour, "opacity": g.ca, "visible": visible([part], inner.rule, around)})
        self.paths.append({"d": inner.d, "fill": colour, "fill_opacity": g.ca, "fill_rule": inner.rule, "clips": told(around)})

    def paint(self, path: list[list], g: State, op: str) -> None:
        if not path or op == "n":
            return
        filled, stroked = op[0] in "fFBb", op[0] in "BbSs"
        d = path_data(path)
        rule = "evenodd" if op.endswith("*") else "nonzero"
        if filled:
            for sub in path:
                inside = visible(flattened([sub]), rule, g.clips) if g.clips else None
                self.fills.append({"points": [{"x": p[-1][0], "y": p[-1][1]} for k, p in sub if k != "Z"], "color": g.fill, "opacity": g.ca, "visible": inside})
        scale = hypot(g.ctm[0], g.ctm[1])
        self.paths.append({
            "d": d, "fill": g.fill if filled else None, "stroke": g.stroke if stroked else None, "stroke_width": g.width * scale, "fill_opacity": g.ca,
            "stroke_opacity": g.CA, "dasharray": list(map(float, g.dash[0])), "dashoffset": g.dash[1], "linecap": ("butt", "round", "square")[g.cap % 3],
            "linejoin": ("miter", "round", "bevel")[g.join % 3], "fill_rule": rule, "clips": told(g.clips),
        })

    def show(self, raw: bytes, g: State, tm):
        """Adds a span and returns the text matrix after it. Spaces in front move the span and are
        kept as a mark; glyphs outside the page at either end are cut."""
        font, adjust, self.adjust = g.font, self.adjust, 0.0
        if font is None:
            return tm
        glyphs, vertical, rise = font.glyphs(raw), font.vertical, g.Ts
        if not vertical and glyphs and glyphs[0][0] != " " and not (g["Tc"] or g["Tw"]) and g["Tz"] == 1:
            if (after := self.straight(glyphs, g, tm, adjust)) is not None:
                return after

        def along(w: float, text: str, space: bool) -> float:
            d = w / 1000 * g.size + g.Tc * max(1, len(text)) + g.Tw * space
            return d if vertical else d * g.Tz

        step = lambda d, m: moved(0, -d, m) if vertical else moved(d, 0, m)
        lead = 0
        while lead < len(glyphs) and glyphs[lead][0] == " ":
            tm = step(along(glyphs[lead][1], " ", True), tm)
            lead += 1
        glyphs = glyphs[lead:]
        if not "".join(t for t, _, _ in glyphs):
            return tm
        advances = [along(w, t, s) for t, w, s in glyphs]
        after = step(sum(advances), tm)
        first, last = 0, len(glyphs)
        # a straight run with both ends on the page has no glyph outside it
        inside = self.on_page(point(g.ctm, tm[4], tm[5])) and self.on_page(point(g.ctm, after[4], after[5]))
        while not inside and first < last and not self.on_page(point(g.ctm, *step(sum(advances[: first + 1]), tm)[4:6])) and not self.on_page(point(g.ctm, *step(sum(advances[:first]), tm)[4:6])):
            first += 1
        while not inside and last > first and not self.on_page(point(g.ctm, *step(sum(advances[: last - 1]), tm)[4:6])) and not self.on_page(point(g.ctm, *step(sum(advances[:last]), tm)[4:6])):
            last -= 1
        if first == last:
            return after
        begin = step(sum(advances[:first]), tm)
        width = sum(advances[first:last])
        text = "".join(t for t, _, _ in glyphs[first:last])
        x, y = point(g.ctm, begin[4], begin[5] + rise)
        ends = step(width, begin)
        ex, ey = point(g.ctm, ends[4], ends[5] + rise)
        up = moved(abs(g.size) * g.Tz, 0, begin) if vertical else moved(0, abs(g.size), begin)
        ux, uy = point(g.ctm, up[4], up[5] + rise)
        far, high = hypot(ex - x, ey - y), hypot(ux - x, uy - y)
        self.spans.append({
            "seq": len(self.spans), "text": text, "has_leading_space": lead > 0, "text_adjustment_before": adjust or None, "natural_width": far - (g.Tc + 0.0) * len(text) * g.Tz,
            "character_spacing": float(g.Tc) or None, "word_spacing": float(g.Tw) or None,
            "bounds": {"x": x, "y": y, "width": high if vertical else far, "height": far if vertical else high}, "direction": "ttb" if vertical else "ltr",
            "font_name": g.name, "font_family": font.family or None, "color": g.fill, "fill_opacity": float(g.ca), "stroke_color": g.stroke if g.Tr in (1, 2, 5, 6) else None,
            "rendering_mode": int(g.Tr), "font_size": high,
            "transform": None if vertical or not far or not high else [(ex - x) / far, -(ey - y) / far, -(ux - x) / high, (uy - y) / high],
        })
        return after

    def straight(self, glyphs: list[tuple[str, float, bool]], g: State, tm, adjust: float):
        """``show`` of glyphs along the page's x that lie on it whole and are set without spacing; None for all others."""
        ctm, size, rise = g["ctm"], g["size"], g["Ts"]
        if tm[1] or tm[2] or ctm[1] or ctm[2]:
            return None
        text = "".join([t for t, _, _ in glyphs])
        if not text:
            return None
        width = sum([w / 1000 * size for _, w, _ in glyphs])
        end = width * tm[0] + tm[4]
        x, ex, base = ctm[0] * tm[4] + ctm[4], ctm[0] * end + ctm[4], ctm[3] * tm[5] + ctm[5]
        if not (self.on_page((x, base)) and self.on_page((ex, base))):
            return None
        y, uy = ctm[3] * (tm[5] + rise) + ctm[5], ctm[3] * (abs(size) * tm[3] + tm[5] + rise) + ctm[5]
        far, high = abs(ex - x), abs(uy - y)
        self.spans.append({
            "seq": len(self.spans), "text": text, "has_leading_space": False, "text_adjustment_before": adjust or None, "natural_width": far,
            "character_spacing": None, "word_spacing": None, "bounds": {"x": x, "y": y, "width": far, "height": high}, "direction": "ltr",
            "font_name": g["name"], "font_family": g["font"].family or None, "color": g["fill"], "fill_opacity": float(g["ca"]),
            "stroke_color": g["stroke"] if g["Tr"] in (1, 2, 5, 6) else None, "rendering_mode": int(g["Tr"]), "font_size": high,
            "transform": None if not far or not high else [(ex - x) / far, -0.0, -0.0, (uy - y) / high],
        })
        return (tm[0], tm[1], tm[2], tm[3], end, tm[5])

    def on_page(self, p: tuple[float, float]) -> bool:
        x0, y0, x1, y1 = self.box
        return 0 <= p[0] <= x1 - x0 and 0 <= p[1] <= y1 - y0


#: Quadrilaterals of one annotation that are looked at; with more, its rectangle counts.
MOST_QUADS = 1024


def links_of(doc, page: dict, box) -> list[dict]:
    """Regions (corners of convex quadrilaterals, or of the annotation's rectangle) and targets of a page's safe links, in order."""
    out = []
    for k, ref in enumerate(doc.resolve(page.get("Annots")) or []):
        annotation = doc.resolve(ref)
        action = doc.resolve(annotation.get("A")) if isinstance(annotation, dict) and annotation.get("Subtype") == "Link" else None
        uri = doc.resolve(action.get("URI")) if isinstance(action, dict) and doc.resolve(action.get("S")) == "URI" else None
        href = pdf_string(uri).strip() if isinstance(uri, bytes) else ""
        if not href.lower().startswith(("http:", "https:", "mailto:")) or any(ord(c) <= 32 or ord(c) == 127 for c in href):
            continue
        numbers = lambda v: [float(x) for x in map(doc.resolve, v) if isinstance(x, (int, float))] if isinstance(v, list) else []
        quads, rect = numbers(doc.resolve(annotation.get("QuadPoints"))), numbers(doc.resolve(annotation.get("Rect")))
        regions = [quads[i : i + 8] for i in range(0, len(quads), 8)] if quads and len(quads) % 8 == 0 and len(quads) <= 8 * MOST_QUADS else []
        if not regions and len(rect) == 4:
            x0, y0, x1, y1 = rect
            regions = [[x0, y0, x1, y0, x1, y1, x0, y1]]
        for r in regions:
            corners = convex([(x - box[0], y - box[1]) for x, y in zip(r[::2], r[1::2], strict=True)])
            out.append({"annot_seq": k, "href": href, "corners": corners})
    return out


def attach_links(spans: list[dict], links: list[dict]) -> None:
    """A span whose middle and both ends lie in one region takes its target; later annotations win."""
    import numpy as np

    rows = []
    for s in spans:
        a, b, c, d = s["transform"] or (1, 0, 0, 1)
        r = s["bounds"]
        if s["direction"] == "ttb":
            x, y, dx, dy = r["x"] + r["width"] / 2, r["y"] - r["height"] / 2, 0.0, -r["height"] / 2
        else:
            dx, dy = a * r["width"] / 2, -b * r["width"] / 2
            x, y = r["x"] + dx - c * r["height"] / 2, r["y"] + dy + d * r["height"] / 2
        rows.append((x, y, dx, dy, max(0.5, 0.35 * s["font_size"])))
    if not rows:
        return
    at = np.array(rows, float)
    middle, half, near = at[:, :2], at[:, 2:4], at[:, 4]
    for k in links:
        region = np.array(k["corners"])
        held = inside_convex(region, middle, 0 * near) & inside_convex(region, middle - half, near) & inside_convex(region, middle + half, near)
        for i in np.flatnonzero(held).tolist():
            spans[i]["href"] = k["href"]
