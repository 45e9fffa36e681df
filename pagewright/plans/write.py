"""PDF files from parts, for layouts and tests: objects in the file or in object streams, cross
references as a table or a stream, filters, fonts of several kinds, links and forms."""

from __future__ import annotations

import zlib
from collections.abc import Callable


def literal(text: str, codec: str = "cp1252") -> bytes:
    raw = text.encode(codec, "replace")
    for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)")):
        raw = raw.replace(a, b)
    return b"(" + raw + b")"


def stream(body: bytes, head: bytes = b"") -> bytes:
    return b"<<%s/Length %d>>stream\n%s\nendstream" % (head, len(body), body)


def flate(body: bytes) -> bytes:
    return stream(zlib.compress(body), b"/Filter/FlateDecode")


def ascii_hex(body: bytes) -> bytes:
    return stream(body.hex().encode() + b">", b"/Filter/AHx")


def hex_of_flate(body: bytes) -> bytes:
    return stream(zlib.compress(body).hex().encode() + b">", b"/Filter[/ASCIIHexDecode/FlateDecode]")


def lzw_codes(body: bytes) -> bytes:
    """LZW without any table: every byte by its own nine-bit code, cleared before codes grow."""
    codes = [256]
    for k, b in enumerate(body):
        if k and k % 200 == 0:
            codes.append(256)
        codes.append(b)
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return stream(int(bits, 2).to_bytes(len(bits) // 8), b"/Filter/LZWDecode")


def png_up(body: bytes, columns: int = 16) -> bytes:
    """Flate over PNG's Up predictor."""
    body += b" " * (-len(body) % columns)
    rows, above = [], bytes(columns)
    for k in range(0, len(body), columns):
        row = body[k : k + columns]
        rows.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True)))
        above = row
    return stream(zlib.compress(b"".join(rows)), b"/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns %d>>" % columns)


FILTERS: tuple[Callable[[bytes], bytes], ...] = (stream, flate, ascii_hex, hex_of_flate, lzw_codes, png_up)


def show(x: float, y: float, size: float, text: bytes, font: bytes = b"F1") -> bytes:
    return b"BT /%s %g Tf 1 0 0 1 %g %g Tm %s Tj ET" % (font, size, x, y, text)


class Writer:
    """Numbers objects as they are added; 1 is the catalogue, 2 the root of the page tree."""

    def __init__(self):
        self.objects: list[bytes] = [b"<</Type/Catalog/Pages 2 0 R>>", b""]

    def add(self, body: bytes) -> int:
        self.objects.append(body)
        return len(self.objects)

    def font(self, body: bytes = b"/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding") -> int:
        return self.add(b"<</Type/Font%s>>" % body)

    def composite(self, width: int = 600) -> int:
        """A composite font whose two-byte codes are the characters' own, moved by 0x100."""
        cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0120> <017E> <0020> endbfrange"
        to = self.add(flate(cmap))
        below = self.add(b"<</Type/Font/Subtype/CIDFontType2/BaseFont/ABCDEF+Body/DW 1000/W[288 382 %d]>>" % width)
        return self.font(b"/Subtype/Type0/BaseFont/ABCDEF+Body/Encoding/Identity-H/DescendantFonts[%d 0 R]/ToUnicode %d 0 R" % (below, to))

    def pages(self, bodies: list[bytes], extra: list[bytes] | None = None, fan: int = 0) -> None:
        """A page for each content object; with ``fan``, the tree has inner nodes of so many pages."""
        inner = [self.add(b"") for _ in range(0, len(bodies), fan)] if fan else [2]
        kids: dict[int, list[int]] = {}
        for k, body in enumerate(bodies):
            parent = inner[k // fan] if fan else 2
            kids.setdefault(parent, []).append(self.add(b"<</Type/Page/Parent %d 0 R/Contents %d 0 R%s>>" % (parent, self.add(body), extra[k] if extra else b"")))
        join = lambda ids: b" ".join(b"%d 0 R" % i for i in ids)
        if fan:
            for node, held in kids.items():
                self.objects[node - 1] = b"<</Type/Pages/Parent 2 0 R/Kids[%s]/Count %d>>" % (join(held), len(held))
        self.objects[1] = b"<</Type/Pages/Kids[%s]/Count %d%s>>" % (join(inner if fan else kids.get(2, [])), len(bodies), self.shared)

    #: What all pages inherit.
    shared = b"/MediaBox[0 0 612 792]"

    def table(self) -> bytes:
        """With a classic cross-reference table."""
        out, at = bytearray(b"%PDF-1.7\n"), []
        for k, o in enumerate(self.objects, 1):
            at.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
        out += b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(at) + 1, start)
        return bytes(out)

    def packed(self, most: int = 50) -> bytes:
        """With all plain objects in object streams of ``most``, and a cross-reference stream."""
        out, where = bytearray(b"%PDF-1.7\n"), {}
        plain = [k for k, o in enumerate(self.objects, 1) if b"stream\n" not in o]
        number = len(self.objects)
        boxes = []
        for k in range(0, len(plain), most):
            number += 1
            held, offsets, body = plain[k : k + most], [], b""
            for i, n in enumerate(held):
                offsets.append(b"%d %d" % (n, len(body)))
                body += self.objects[n - 1] + b" "
                where[n] = (2, number, i)
            head = b" ".join(offsets) + b" "
            raw = zlib.compress(head + body)
            boxes.append((number, b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(held), len(head), len(raw), raw)))
        for n, o in [(k, o) for k, o in enumerate(self.objects, 1) if k not in where] + boxes:
            where[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
        rows = b"".join(bytes([a]) + b.to_bytes(4) + c.to_bytes(2) for a, b, c in (where[n] for n in sorted(where)))
        start, up, above = len(out), [], bytes(7)
        for k in range(0, len(rows), 7):
            up.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(rows[k : k + 7], above, strict=True)))
            above = rows[k : k + 7]
        raw = zlib.compress(b"".join(up))
        out += b"%d 0 obj\n<</Type/XRef/Size %d/W[1 4 2]/Index[1 %d]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>/Length %d>>stream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (number + 1, number + 2, len(where), len(raw), raw, start)
        return bytes(out)


#: A batch of files ends with the one that brings it to so many bytes.
BATCH_BYTES = 4 << 20


def made_of(batches, make: Callable[..., bytes]):
    """Batches of (doc_id, content) for those of (doc_id, further columns)."""
    import pyarrow as pa

    for batch in batches:
        begin, made, size = 0, [], 0
        for k in range(len(batch)):
            made.append(make(*(column[k].as_py() for column in batch.columns[1:])))
            size += len(made[-1])
            if size >= BATCH_BYTES or k + 1 == len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(made)), pa.array(made, pa.binary())], ["doc_id", "content"])
                begin, made, size = k + 1, [], 0


def printed(df, make: Callable[..., bytes]):
    """``df`` (doc_id and further columns) with content: the file that ``make(*further)`` gives.

    Files leave as they are made: a task holds a few megabytes of them, or one."""
    names = [c for c in df.columns if c != "doc_id"]

    return df.selectExpr("cast(doc_id as string) as doc_id", *[f"`{c}`" for c in names]).mapInArrow(lambda batches: made_of(batches, make), "doc_id string, content binary")


def to_folder(files, folder: str):
    """``files`` (doc_id, content) written as ``folder``/doc_id.pdf on storage that every executor mounts: (path, size).

    A file appears whole, by renaming, so that a task may run twice and a stream may look on."""
    import os

    folder = folder.removeprefix("file://").removeprefix("file:")

    def run(batches):
        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for name, content in ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for k in range(len(batch))):
                paths.append(os.path.join(folder, f"{name.replace('/', '_')}.pdf"))
                sizes.append(len(content or b""))
                part = f"{paths[-1]}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content or b"")
                os.replace(part, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], ["path", "size"])

    return files.select("doc_id", "content").mapInArrow(run, "path string, size bigint")
