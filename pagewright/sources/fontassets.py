"""Font programs as assets: embedded files by their content, and Type 3 glyphs as drawings."""

from __future__ import annotations

import json
import re
from hashlib import sha256

from .content import IDENTITY, Interpreter

#: Where a descriptor keeps a program, and the format of it.
PROGRAMS = {"FontFile": "type1", "FontFile2": "truetype", "FontFile3": "cff"}
#: Operators that set a colour: a glyph without any takes the text's.
_COLOUR = re.compile(rb"(?:^|\s)(?:g|G|rg|RG|k|K|sc|SC|scn|SCN)(?=\s|$)")


def asset_of(head: dict, doc) -> dict:
    """font_id (a hash of the program or of the glyphs; null if there is none), family, format, data and glyphs of a font."""
    from .pdf import Stream

    family = re.sub(r"^[A-Z]{6}\+", "", str(doc.resolve(head.get("BaseFont")) or "")) or None
    out = {"font_id": None, "family": family, "format": None, "data": None, "glyphs": None}
    if doc.resolve(head.get("Subtype")) == "Type3":
        glyphs = type3_glyphs(head, doc)
        told = sha256(json.dumps(glyphs, sort_keys=True).encode()).hexdigest()
        return out | {"font_id": told, "format": "type3", "glyphs": glyphs} if glyphs else out
    below = doc.resolve(head.get("DescendantFonts"))
    below = doc.resolve(below[0]) if isinstance(below, list) and below else head
    descriptor = doc.resolve(below.get("FontDescriptor")) if isinstance(below, dict) else None
    for key, kind in PROGRAMS.items():
        program = doc.resolve(descriptor.get(key)) if isinstance(descriptor, dict) else None
        if isinstance(program, Stream):
            data = doc.decoded(program)
            return out | {"font_id": sha256(data).hexdigest(), "format": kind, "data": data}
    return out


def type3_glyphs(head: dict, doc) -> list[dict]:
    """Each code's advance, and what its program draws, in text space at size 1."""
    from .pdf import Name, Stream

    get = lambda k, of=head: doc.resolve(of.get(k)) if isinstance(of, dict) else None
    matrix, programs, widths, first = get("FontMatrix"), get("CharProcs"), get("Widths"), get("FirstChar")
    if not isinstance(matrix, list) or not isinstance(programs, dict) or not isinstance(widths, list) or not isinstance(first, int):
        return []
    matrix = tuple(float(doc.resolve(v)) for v in matrix) if len(matrix) == 6 else IDENTITY
    names, code = {}, None
    for x in map(doc.resolve, get("Differences", get("Encoding")) or []):
        if isinstance(x, int):
            code = x
        elif isinstance(x, Name) and code is not None:
            names[code] = str(x)
            code += 1
    out = []
    for k, width in enumerate(map(doc.resolve, widths)):
        program = doc.resolve(programs.get(names.get(first + k, "")))
        if not isinstance(program, Stream) or not isinstance(width, (int, float)):
            continue
        body = doc.decoded(program)
        drawn = Interpreter(doc, (0.0, 0.0, 0.0, 0.0), masks=True)
        drawn.run(body, get("Resources") or {}, matrix)
        out.append({"code": first + k, "advance": abs(width * matrix[0]), "own_colour": _COLOUR.search(body) is not None, "fills": drawn.fills, "paths": drawn.paths})
    return out
