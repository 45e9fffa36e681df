"""Fonts of a PDF: codes to text and to advances.

Text comes from a ToUnicode map, else from the encoding: a base encoding with the font's
differences by glyph name, or for composite fonts the code itself. Advances come from the font's
own widths, a composite font's W array, an embedded TrueType program, the metrics of the
standard fonts, or half an em.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from ..functions.text import compatible_text

# fixed values: the upper half of Adobe's standard encoding and its two quotes
_STANDARD = {
    0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«",
    0xAC: "‹", 0xAD: "›", 0xAE: "fi", 0xAF: "fl", 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”",
    0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚",
    0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı",
    0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}
# fixed values: glyph names of marks, by the Unicode name or the character
_MARKS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]",
    "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘",
    "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "endash": "–", "emdash": "—",
    "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›",
    "guillemotleft": "«", "guillemotright": "»", "exclamdown": "¡", "questiondown": "¿", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥",
    "Euro": "€", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "plusminus": "±",
    "multiply": "×", "divide": "÷", "minus": "−", "fraction": "⁄", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "onesuperior": "¹",
    "twosuperior": "²", "threesuperior": "³", "mu": "µ", "periodcentered": "·", "ordfeminine": "ª", "ordmasculine": "º", "logicalnot": "¬",
    "brokenbar": "¦", "macron": "¯", "acute": "´", "cedilla": "¸", "dieresis": "¨", "circumflex": "ˆ", "tilde": "˜", "caron": "ˇ", "breve": "˘",
    "ring": "˚", "ogonek": "˛", "dotaccent": "˙", "hungarumlaut": "˝", "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ",
    "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "dotlessi": "ı", "florin": "ƒ",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "infinity": "∞",
    "summation": "∑", "product": "∏", "radical": "√", "integral": "∫", "partialdiff": "∂", "lozenge": "◊", "arrowright": "→", "arrowleft": "←",
}
_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_ACCENTS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA",
            "caron": "CARON", "breve": "BREVE", "macron": "MACRON", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE"}
# fixed values: advances of the printable ASCII characters in the standard fonts, in thousandths
_HELVETICA = (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 "
    "667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 "
    "556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
)
_HELVETICA_BOLD = (
    "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 "
    "722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 "
    "556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
)
_TIMES = (
    "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 "
    "722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 "
    "444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
)
_TIMES_BOLD = (
    "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 "
    "722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 "
    "500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520"
)
_TIMES_ITALIC = (
    "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 "
    "611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 "
    "500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541"
)
_TIMES_BOLD_ITALIC = (
    "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 "
    "667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 "
    "500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570"
)
MOST_CODES = 65_536
#: Characters of a font's own map: all that there are.
MOST_GLYPH_CODES = 0x110000


@lru_cache(64)
def standard_widths(name: str) -> dict[str, int] | None:
    """Advances of a standard font's printable ASCII characters; obliques are as wide as uprights."""
    plain = name.split("+")[-1]
    if plain.startswith("Courier"):
        return {chr(c): 600 for c in range(32, 127)}
    table = {"Helvetica": _HELVETICA, "Helvetica-Oblique": _HELVETICA, "Helvetica-Bold": _HELVETICA_BOLD,
             "Helvetica-BoldOblique": _HELVETICA_BOLD, "Times-Roman": _TIMES,
             "Times-Bold": _TIMES_BOLD, "Times-Italic": _TIMES_ITALIC, "Times-BoldItalic": _TIMES_BOLD_ITALIC}.get(plain)
    return {chr(32 + k): int(w) for k, w in enumerate(table.split())} if table else None


def base_encoding(name: str | None) -> list[str]:
    """Text of each of the 256 codes; undefined codes are empty."""
    return list(_encoding(name))


@lru_cache(8)
def _encoding(name: str | None) -> list[str]:
    if name == "StandardEncoding":
        return [_STANDARD.get(c, chr(c) if 32 <= c < 127 else "") for c in range(256)]
    codec = "mac-roman" if name == "MacRomanEncoding" else "cp1252"
    return [bytes([c]).decode(codec, "ignore") for c in range(256)]


def glyph_text(name: str) -> str | None:
    """The text that a glyph name stands for, by Adobe's naming rules."""
    plain = name.split(".")[0]
    if plain in _MARKS:
        return _MARKS[plain]
    if plain in _DIGITS:
        return str(_DIGITS.index(plain))
    if re.fullmatch("[A-Za-z]", plain):
        return plain
    if m := re.fullmatch(r"([A-Za-z])([a-z]{4,})", plain):
        if accent := _ACCENTS.get(m[2]):
            case = "CAPITAL" if m[1].isupper() else "SMALL"
            try:
                return unicodedata.lookup(f"LATIN {case} LETTER {m[1].upper()} WITH {accent}")
            except KeyError:
                return None
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if plain[:1].isupper() else 'SMALL'} LETTER {plain.upper()}")
    except KeyError:
        pass
    if m := re.fullmatch(r"(?i)G([0-9a-f]{2,6})", plain):
        return _point(int(m[1], 16))
    if m := re.fullmatch(r"C(\d{1,7})", plain):
        return _point(int(m[1]))
    if re.fullmatch(r"[A-Za-z](?:_[A-Za-z])+", plain):
        return plain.replace("_", "")
    if m := re.fullmatch(r"(?i)uni((?:[0-9a-f]{4})+)", plain):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")  # pairs of surrogates are one character
    if m := re.fullmatch(r"(?i)u([0-9a-f]{4,6})", plain):
        return _point(int(m[1], 16))
    return None


def _point(n: int) -> str | None:
    """The character of a code point; half of a surrogate pair is none and reads as U+FFFD."""
    if 0xD800 <= n <= 0xDFFF:
        return "\ufffd"
    return chr(n) if n <= 0x10FFFF else None


def pdf_string(raw: bytes) -> str:
    """A text string outside content: UTF-16 with a mark, else Windows-1252."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


class CMap:
    """Codespaces and code -> text of a ToUnicode map."""

    def __init__(self, data: bytes):
        from .pdf import PdfError

        self.text: dict[int, str] = {}
        self.spaces: list[tuple[int, int, int]] = []
        utf16 = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        room = MOST_CODES
        for kind, body in re.findall(rb"begin(codespacerange|bfchar|bfrange)(.*?)end\1", data, re.S):
            if kind == b"bfchar":
                for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", body):
                    self.text[int(a, 16)] = utf16(b)
                continue
            if kind == b"codespacerange":
                self.spaces += [(len(a) // 2, int(a, 16), int(b, 16)) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", body)]
                continue
            for a, b, c, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", body, re.S):
                first, last = int(a, 16), int(b, 16)
                room -= max(0, last - first + 1)
                if room < 0:
                    raise PdfError("RESOURCE_LIMIT", "ToUnicode ranges hold too many codes")
                if many:
                    self.text |= {first + k: utf16(h) for k, h in enumerate(re.findall(rb"<([0-9A-Fa-f]*)>", many)) if first + k <= last}
                else:
                    self.text |= {k: utf16(b"%0*X" % (len(c), int(c, 16) + k - first)) for k in range(first, last + 1)}

    def size_at(self, raw: bytes, at: int) -> int | None:
        for size, first, last in self.spaces:
            if at + size <= len(raw) and first <= int.from_bytes(raw[at : at + size]) <= last:
                return size
        return None


class CidMap:
    """Codes to CIDs of an encoding CMap; of entries that overlap the last one counts.

    Only codes that are asked for get a CID: entries are taken from the last back, and each gives its CIDs to the codes
    in its interval that have none yet. A union-find over the sorted codes leaps over those that have one, so that
    the work is that of the codes and entries, however much they overlap. At most ``MOST_CODES`` entries are read."""

    def __init__(self, data: bytes):
        entries: list[tuple[int, int, int]] = []
        for kind, body in re.findall(rb"begincid(char|range)(.*?)endcid\1", data, re.S):
            pattern = rb"<([0-9A-Fa-f]{1,8})>\s*<([0-9A-Fa-f]{1,8})>\s+(\d+)" if kind == b"range" else rb"<([0-9A-Fa-f]{1,8})>()\s+(\d+)"
            for a, b, c in re.findall(pattern, body):
                first, cid = int(a, 16), int(c)
                last = int(b, 16) if b else first
                if last < first or cid + last - first > 0xFFFF:
                    continue  # no such CIDs
                entries.append((first, last, cid))
        #: over the bound no entry counts, rather than some
        self.entries = entries if len(entries) <= MOST_CODES else []

    def cids(self, codes) -> dict[int, int]:
        """The CID of each of ``codes`` that has one."""
        import bisect

        order = sorted(set(codes))
        free = list(range(len(order) + 1))  # the next code without a CID, by path halving

        def next_free(k: int) -> int:
            while free[k] != k:
                free[k] = k = free[free[k]]
            return k

        out: dict[int, int] = {}
        for first, last, cid in reversed(self.entries):
            k = next_free(bisect.bisect_left(order, first))
            while k < len(order) and order[k] <= last:
                out[order[k]] = cid + order[k] - first
                free[k] = k + 1
                k = next_free(k)
        return out


def glyphs_by_character(to_unicode: CMap, encoding: CidMap | None) -> dict[int, int]:
    """Code point -> CID: a ToUnicode map joined with an encoding CMap by code (None: codes are CIDs). A code without text or
    CID is left out; of a text the first character counts, and of codes with the same one the last."""
    codes = {code: text for code, text in to_unicode.text.items() if text}
    cids = {code: code for code in codes} if encoding is None else encoding.cids(codes)
    return {ord(text[0]): cids[code] for code, text in codes.items() if code in cids}


class TrueType:
    """Advances by character of a TrueType program: cmap formats 4, 6 and 12, and hmtx."""

    def __init__(self, data: bytes):
        n = struct.unpack_from(">H", data, 4)[0]
        tables = {data[12 + 16 * k : 16 + 16 * k]: struct.unpack_from(">II", data, 20 + 16 * k) for k in range(n)}
        self.data = data
        self.units = struct.unpack_from(">H", data, tables[b"head"][0] + 18)[0] or 1000
        count = struct.unpack_from(">H", data, tables[b"hhea"][0] + 34)[0]
        at = tables[b"hmtx"][0]
        self.advance = [struct.unpack_from(">H", data, at + 4 * k)[0] for k in range(count)]
        self.glyph: dict[int, int] = {}
        base = tables[b"cmap"][0]
        for k in range(struct.unpack_from(">H", data, base + 2)[0]):
            self._read(base + struct.unpack_from(">I", data, base + 8 + 8 * k)[0])

    def _read(self, at: int) -> None:
        d, form = self.data, struct.unpack_from(">H", self.data, at)[0]
        if form == 4:
            n = struct.unpack_from(">H", d, at + 6)[0] // 2
            ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", d, at + 14 + 2 * n * k + (2 if k else 0)) for k in range(4))
            where = at + 16 + 6 * n
            for k in range(n):
                for c in range(starts[k], min(ends[k], 0xFFFE) + 1):
                    g = c + deltas[k]
                    if offsets[k]:
                        place = where + 2 * k + offsets[k] + 2 * (c - starts[k])
                        inner = struct.unpack_from(">H", d, place)[0] if place + 2 <= len(d) else 0
                        g = inner + deltas[k] if inner else 0
                    if g & 0xFFFF:
                        self.glyph.setdefault(c, g & 0xFFFF)
        elif form == 6:
            first, n = struct.unpack_from(">HH", d, at + 6)
            for k, g in enumerate(struct.unpack_from(f">{n}H", d, at + 10)):
                self.glyph.setdefault(first + k, g)
        elif form == 12:
            from .pdf import PdfError

            room = MOST_GLYPH_CODES
            for k in range(struct.unpack_from(">I", d, at + 12)[0]):
                first, last, g = struct.unpack_from(">III", d, at + 16 + 12 * k)
                room -= max(0, last - first + 1)
                if room < 0:
                    raise PdfError("RESOURCE_LIMIT", "a font's character map holds too many codes")
                for c in range(first, last + 1):
                    self.glyph.setdefault(c, g + c - first)

    def width(self, text: str) -> float | None:
        """In thousandths; None if a character has no glyph."""
        total = 0.0
        for c in text:
            g = self.glyph.get(ord(c))
            if g is None or not self.advance:
                return None
            total += self.advance[min(g, len(self.advance) - 1)] * 1000 / self.units
        return total


def type1_decrypt(data: bytes, key: int, skip: int) -> bytes:
    """Adobe's stream cipher of Type 1 programs (key 55665) and their charstrings (4330)."""
    out = bytearray()
    for c in data:
        out.append(c ^ key >> 8)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out[skip:])


class Type1:
    """Advances by glyph name of a Type 1 program: the private part is decrypted, and each charstring
    run up to its ``hsbw`` or ``sbw``, which tells the width."""

    def __init__(self, data: bytes):
        if data[:1] == b"\x80":  # segments with headers
            parts, at = [], 0
            while data[at : at + 1] == b"\x80" and data[at + 1] in (1, 2):
                n = int.from_bytes(data[at + 2 : at + 6], "little")
                parts.append(data[at + 6 : at + 6 + n])
                at += 6 + n
            data = b"".join(parts)
        at = data.index(b"eexec") + 5
        while data[at : at + 1] in (b" ", b"\r", b"\n", b"\t"):
            at += 1
        raw = data[at:]
        if re.match(rb"[0-9A-Fa-f\s]{8}", raw):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
            raw = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        private = type1_decrypt(raw, 55665, 4)
        skip = int(m[1]) if (m := re.search(rb"/lenIV\s+(\d+)", private)) else 4
        self.widths: dict[str, float] = {}
        at = private.index(b"/CharStrings")
        entry = re.compile(rb"/([^\s/]+)\s+(\d+)\s+(?:RD|-\|)\s")
        while m := entry.search(private, at):
            code = type1_decrypt(private[m.end() : m.end() + int(m[2])], 4330, skip)
            at = m.end() + int(m[2])
            if (w := self._width(code)) is not None:
                self.widths[m[1].decode("latin-1")] = w

    @staticmethod
    def _width(code: bytes) -> float | None:
        stack, k = [], 0
        while k < len(code):
            b, k = code[k], k + 1
            if b >= 32:
                if b <= 246:
                    stack.append(b - 139)
                elif b <= 250:
                    stack.append((b - 247) * 256 + code[k] + 108)
                    k += 1
                elif b <= 254:
                    stack.append(-(b - 251) * 256 - code[k] - 108)
                    k += 1
                else:
                    stack.append(int.from_bytes(code[k : k + 4], signed=True))
                    k += 4
            elif b == 13 and len(stack) >= 2:  # hsbw
                return float(stack[1])
            elif b == 12 and k < len(code) and code[k] == 7 and len(stack) >= 4:  # sbw
                return float(stack[2])
            elif b == 12 and k < len(code) and code[k] == 12 and len(stack) >= 2:  # div
                top = stack.pop()
                stack[-1] = stack[-1] / top if top else 0
                k += 1
            else:
                return None
        return None


class Font:
    """Decodes shown strings and measures them in thousandths of the size."""

    def __init__(self, head: dict, doc):
        from .pdf import Name, PdfError, Stream

        get = lambda k, of=head: doc.resolve(of.get(k)) if isinstance(of, dict) else None
        self.family = re.sub(r"^[A-Z]{6}\+", "", str(get("BaseFont") or ""))
        self.wide = get("Subtype") == "Type0"
        encoding = get("Encoding")
        cmap = get("ToUnicode")
        self.map = CMap(doc.decoded(cmap)) if isinstance(cmap, Stream) else None
        self.vertical = isinstance(encoding, str) and encoding.endswith("-V")
        #: codes are UTF-16, where no map says otherwise
        self.utf16 = self.wide and self.map is None and isinstance(encoding, str) and re.search(r"UTF16-[HV]$", encoding) is not None
        self.embedded: TrueType | None = None
        if self.wide:
            below = get("DescendantFonts")
            below = doc.resolve(below[0]) if isinstance(below, list) and below else {}
            self.default = doc.resolve(below.get("DW")) if below.get("DW") is not None else 1000
            self.widths = dict(self._ranges(doc, doc.resolve(below.get("W")) or []))
            self.step = 2
            self.descriptor = doc.resolve(below.get("FontDescriptor")) or {}
            #: an encoding CMap tells CIDs, by which widths go
            self.cid_map = CidMap(doc.decoded(encoding)) if isinstance(encoding, Stream) else None
            #: CIDs of the codes seen
            self.cid: dict[int, int] = {}
        else:
            first = get("FirstChar") or 0
            self.widths = {first + k: w for k, w in enumerate(map(doc.resolve, get("Widths") or [])) if isinstance(w, (int, float))}
            matrix = get("FontMatrix")
            if get("Subtype") == "Type3" and isinstance(matrix, list) and matrix:  # widths are in glyph space
                self.widths = {k: 1000 * abs(w * float(doc.resolve(matrix[0]))) for k, w in self.widths.items()}
            name = encoding if isinstance(encoding, str) else get("BaseEncoding", encoding) if isinstance(encoding, dict) else None
            self.codes = base_encoding(name)
            self.names: dict[int, str] = {}
            at = 0
            for x in map(doc.resolve, get("Differences", encoding) or []) if isinstance(encoding, dict) else ():
                if isinstance(x, Name):
                    if at < 256:
                        self.codes[at] = glyph_text(x) or ""
                        self.names[at] = str(x)
                    at += 1
                elif isinstance(x, int):
                    at = x
            self.descriptor = get("FontDescriptor") or {}
            self.default = doc.resolve(self.descriptor.get("MissingWidth"))
            self.standard = standard_widths(self.family)
            self.step = 1
        self.type1: Type1 | None = None
        program = doc.resolve(self.descriptor.get("FontFile2"))
        if isinstance(program, Stream) and (not self.widths or (self.wide and self.map is None)):
            try:
                self.embedded = TrueType(doc.decoded(program))
            except (struct.error, KeyError, IndexError):
                self.embedded = None
            except PdfError as e:
                if e.code == "RESOURCE_LIMIT":
                    raise
                self.embedded = None
        program = doc.resolve(self.descriptor.get("FontFile"))
        if isinstance(program, Stream) and not self.wide and not self.widths:
            try:
                self.type1 = Type1(doc.decoded(program))
            except (ValueError, IndexError, PdfError):
                self.type1 = None
        #: characters by glyph, for composite fonts that say no text
        self.seen: dict[tuple[int, int], tuple[str, float, bool]] = {}
        self.drawn = {g: chr(c) for c, g in sorted(self.embedded.glyph.items(), reverse=True)} if self.embedded and self.wide and self.map is None else {}

    @staticmethod
    def _ranges(doc, w: list) -> Iterator[tuple[int, float]]:
        """(code, width) of a W array: ``c [w ...]`` and ``first last w``."""
        from .pdf import PdfError

        k = 0
        while k + 1 < len(w):
            first, next_ = doc.resolve(w[k]), doc.resolve(w[k + 1])
            if isinstance(next_, list):
                yield from ((first + i, doc.resolve(x)) for i, x in enumerate(next_))
                k += 2
            else:
                if k + 2 < len(w):
                    width = doc.resolve(w[k + 2])
                    if next_ - first >= MOST_CODES:
                        raise PdfError("RESOURCE_LIMIT", "a range of widths holds too many codes")
                    yield from ((c, width) for c in range(first, next_ + 1))
                k += 3

    def glyphs(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """(text, advance, whether it is a space) of each code."""
        if self.step == 1 and len(raw) > 1 and len(raw) % 2 == 0 and not any(raw[::2]):
            raw = raw[1::2]  # one-byte codes padded with zeros
        out, at = [], 0
        while at < len(raw):
            size = (self.map.size_at(raw, at) if self.map and self.map.spaces else None) or self.step
            if self.utf16 and raw[at] & 0xFC == 0xD8 and at + 4 <= len(raw) and raw[at + 2] & 0xFC == 0xDC:
                size = 4  # a pair of surrogates is one character
            code = raw[at] if size == 1 else int.from_bytes(raw[at : at + size])
            if (known := self.seen.get((size, code))) is not None:
                out.append(known)
                at += size
                continue
            text = self.map.text.get(code) if self.map else raw[at : at + size].decode("utf-16-be", "replace") if self.utf16 else None
            if text is None:
                text = self.codes[code] if not self.wide and code < 256 else self.drawn.get(code) or _point(code) or ""
            known = self.seen[size, code] = (compatible_text(text), self.advance(code, text), text == " ")
            out.append(known)
            at += size
        return out

    def characters(self) -> dict[int, int]:
        """Code point -> CID of a composite font that says both, else empty."""
        return glyphs_by_character(self.map, self.cid_map) if self.wide and self.map else {}

    def advance(self, code: int, text: str) -> float:
        if self.wide and self.cid_map:
            if code not in self.cid:
                self.cid |= {code: 0} | self.cid_map.cids([code])
            code = self.cid[code]
        if (w := self.widths.get(code)) is not None:
            return float(w)
        if self.embedded and not self.wide and (w := self.embedded.width(text)) is not None:
            return w
        if self.type1:
            name = self.names.get(code) or next((n for n in self.type1.widths if glyph_text(n) == text), None)
            return self.type1.widths.get(name, 500.0)
        if not self.wide and self.standard and text in self.standard:
            return float(self.standard[text])
        if self.default is not None:
            return float(self.default)
        return 278.0 if text == " " else 500.0


#: Fonts whose dictionary says all: a process keeps so many, as small files repeat them.
MOST_FONTS = 64
_plain_fonts: dict[tuple, Font] = {}


def font_of(head: dict, doc) -> Font:
    """The font of a dictionary. One of plain names and numbers reads nothing else of its file, so equal ones are one."""
    if not isinstance(head, dict) or not all(isinstance(v, (str, int, float)) for v in head.values()):
        return Font(head, doc)
    # equal numbers of two types are two keys
    key = tuple(sorted((k, type(v).__name__, v) for k, v in head.items()))
    if key not in _plain_fonts:
        if len(_plain_fonts) >= MOST_FONTS:
            _plain_fonts.clear()
        _plain_fonts[key] = Font(head, doc)
    return _plain_fonts[key]
