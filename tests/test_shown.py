"""Pages of plain strings told in arrays, against the interpreter."""

import random

import pyarrow as pa
import pytest

from pagewright.plans import write
from pagewright.schema import PAGES
from pagewright.sources import pdf, shown


def _schema(spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(PAGES))


def _string(font, size, x, y, raw, matrix="1 0 0 1"):
    return b"/%s %s Tf %s %s %s Tm (%s) Tj" % (font.encode(), str(size).encode(), matrix.encode(), str(x).encode(), str(y).encode(), raw)


def _file(bodies, shared=b"", fonts=(b"/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding",)):
    w = write.Writer()
    named = b"".join(b"/F%d %d 0 R" % (k, w.font(f)) for k, f in enumerate(fonts, 1))
    w.shared = b"/MediaBox[10 20 610 770]%s/Resources<</Font<<%s>>>>" % (shared, named)
    w.pages([write.stream(b) for b in bodies])
    return w.table()


def _told(files, schema):
    plain, out = shown.Pages(), []
    for name, f in files:
        out += [r for r in pdf._rows_or_plain(name, f, pdf.Limits(), "PERMISSIVE", 0, None, plain) if isinstance(r, dict)]
    rows = [r for b in pdf._batches(out, plain, schema, "PERMISSIVE") for r in b.to_pylist()]
    return sorted(rows, key=lambda r: (r["doc_id"], r["page"] or 0)), len(plain.rows)


def _as_read(files, schema):
    return pa.RecordBatch.from_pylist([r for name, f in files for r in pdf.rows_of(name, f, pdf.Limits())], schema).to_pylist()


def test_plain_strings_equal_the_interpreter(spark):
    rng, schema = random.Random(4), _schema(spark)
    text = lambda: bytes(rng.choice(b"abc XYZ019.,-'`") for _ in range(rng.randint(0, 30))).strip() or b"x"
    bodies = [
        b"BT " + b" ".join(_string(rng.choice(("F1", "F2")), rng.choice((8, 9.5, -7, 0)), round(rng.uniform(20, 400), 2), rng.randint(30, 700), text(), rng.choice(("1 0 0 1", "2 0 0 1.5"))) for _ in range(rng.randint(1, 20))) + b" ET"
        for _ in range(200)
    ]
    fonts = (b"/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding", b"/Subtype/TrueType/BaseFont/ABCDEF+Own/FirstChar 32/Widths[250 300.5 410]")
    files = [("a", _file(bodies, b"/Rotate 90", fonts)), ("b", _file(bodies[:3]))]
    got, taken = _told(files, schema)
    assert taken >= 200
    assert repr(got) == repr(_as_read(files, schema))


@pytest.mark.parametrize(
    "body",
    [
        _string("F1", 10, 700, 100, b"beyond the page"), _string("F1", 10, 600, 100, b"over its edge"), _string("F1", 10, 50, 100, b" a space in front"), _string("F1", 10, 50, 100, b"\\(escaped\\)"),
        _string("F1", 10, 50, 100, b"turned", "0 1 -1 0"), _string("F9", 10, 50, 100, b"no such font"), _string("F1", 10, 50, 100, b"x" * 300), _string("F1", "+10", 50, 100, b"a sign"),
        _string("F1", 10, 50, 100, b"one") + b" 0.5 g " + _string("F1", 10, 50, 80, b"two"), _string("F1", 10, 50, 100, b"one") + b"% (note) Tj\n" + _string("F1", 10, 50, 80, b"two"),
        _string("F1", 10, 50, 100, b"caf\xe9"), _string("F1", 10, 50, 100, b""), b"",
    ],
)
def test_other_pages_go_through_the_interpreter(spark, body):
    schema = _schema(spark)
    files = [("a", _file([b"BT " + _string("F1", 10, 50, 700, b"plain") + b" ET", b"BT " + body + b" ET", b"q " + body + b" Q"])), ("b", b"no file")]
    got, taken = _told(files, schema)
    assert taken >= 1
    assert repr(got) == repr(sorted(_as_read(files, schema), key=lambda r: (r["doc_id"], r["page"] or 0)))


def test_no_plain_page_is_interpreted(spark, monkeypatch):
    """Each shown string went through the interpreter by itself."""
    monkeypatch.setattr(pdf.Interpreter, "run", None)
    files = [(str(k), _file([b"BT " + _string("F1", 10, 50, 700, b"row %d" % k) + b" ET"])) for k in range(20)]
    got, taken = _told(files, _schema(spark))
    assert taken == 20 and [r["spans"][0]["text"] for r in got] == sorted((f"row {k}" for k in range(20)), key=lambda t: t[4:])


def test_small_objects_and_tables_of_places_are_read_once():
    """Files repeat their small dictionaries; equal bytes are one dictionary, with numbers and streams of their own."""
    a, b = (pdf.Document(_file([b"BT " + _string("F1", 10, 50, 700, t) + b" ET"])) for t in (b"one", b"other"))
    assert a.resolve(a.trailer["Root"]) is b.resolve(b.trailer["Root"])
    assert not any(offset == 0 for _, offset in a.xref.values()) and sorted(a.xref) == list(range(1, len(a.xref) + 1))
