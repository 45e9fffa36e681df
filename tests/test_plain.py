"""Pages taken a batch at a time have the tables that each has by itself."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pagewright.operators import page, plain
from pagewright.plans import layout

NUMBERS = ("x", "y", "width", "height", "font_size")
WORDS = ("text", "font_family", "direction", "color", "href")
SPANS = pa.list_(pa.struct([*((c, pa.float64()) for c in NUMBERS), *((c, pa.string()) for c in WORDS), ("has_leading_space", pa.bool_())]))


def _page(r: random.Random, words: list[str]) -> list[dict]:
    kind, out, y = r.random(), [], 750.0
    xs = [40, 200, 320][: r.choice([1, 2, 3, 3])]
    for _ in range(r.choice([0, 1, 2, 3, 5, 9, 14])):
        y -= 15 if r.random() < 0.95 else r.choice([0, 1.5, 14.5])
        for x in xs if r.random() < 0.95 else xs[:1]:
            text = r.choice(words)
            at = x + (r.choice([0, 0, 5, 10, 17, -3, 90]) if kind < 0.6 else 0)
            size = r.choice([10.0, 6.0]) if kind < 0.2 else 10.0
            out.append({
                "x": float(at), "y": y + (kind < 0.05) * r.random(), "width": len(text or "") * size / 2 if r.random() < 0.98 else None, "height": size, "text": text,
                "font_size": None if kind > 0.9 else size, "font_family": "Bold" if kind > 0.97 else "Body", "direction": "ttb" if kind > 0.99 else "ltr",
                "has_leading_space": r.random() < 0.02, "color": "#000000", "href": None,
            })
    return out


def _batch(pages: list) -> pa.RecordBatch:
    n = len(pages)
    columns = [pa.array([f"d{k}" for k in range(n)]), pa.array([1] * n, pa.int32()), pa.array([612.0] * n), pa.array([792.0] * n), pa.array(pages, SPANS)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "width", "height", "spans"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_of_plain_pages(spark, seed):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    r = random.Random(seed)
    batch = _batch([_page(r, ["12", "3.5", "Item", "abc def", " x ", "", None, "Qty.", "א", "$1"]) for _ in range(900)]).slice(7)
    told, done = page._plain(batch, [], page.Options(), plain.cell_columns, to_arrow_schema(StructType.fromDDL(page.CELLS)))
    got = {}
    for row in told.to_pylist():
        got.setdefault(row["doc_id"], []).append(row)
    spans = page._page_spans(batch.column(4), [612.0] * len(batch), [792.0] * len(batch), [0] * len(batch))
    with_tables = 0
    for k, doc in enumerate(batch.column(0).to_pylist()):
        if not done[k]:
            assert doc not in got
            continue
        tables = page.structure(612.0, 792.0, spans[k], [], [], page.Options(), 0, "cells")[1]
        want = [(t, c.row, c.column, c.text, page._rect(c), [s.seq for s in c.spans], tables[t].columns) for t, x in enumerate(tables) for c in x.cells]
        assert [(c["table_seq"], c["row"], c["column"], c["text"], c["bounds"], c["span_seqs"], c["columns"]) for c in got.get(doc, [])] == want
        with_tables += bool(want)
    assert with_tables > 20 and not done.all()


def test_invoices_are_plain(spark):
    """Right-aligned figures too: no page of them is taken apart by itself."""
    pages = layout.invoices(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), right=True)
    spans = pages.select(page._read_fields(pages, "cells")).toArrow().column("spans").combine_chunks()
    ends = spans.offsets.to_numpy()
    assert plain.tables_of(spans.flatten(), ends - ends[0], np.zeros(len(spans), bool), page.Options()).plain.all()


def test_no_list_inside_a_span_goes_to_python(spark):
    """Spark asks for a batch's size after each row, and a list of null lists is filled anew each time: the square of a batch."""
    pages = layout.invoices(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    sent = pages.select(page._read_fields(pages, "blocks")).schema["spans"].dataType.elementType
    assert not any(isinstance(f.dataType, ArrayType) for f in sent)


def test_named_columns_of_cells(spark):
    pages = layout.invoices(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    whole = page.cells(pages).select("doc_id", "column", "text")
    some = page.cells(pages, only=("doc_id", "column", "text"))
    assert some.columns == ["doc_id", "column", "text"]
    assert some.exceptAll(whole).count() == whole.exceptAll(some).count() == 0 < some.where(F.col("column") == 2).count()


def _read(content: bytes, font: bytes = b"/Subtype/Type1/BaseFont/Helvetica"):
    from pagewright.plans import write
    from pagewright.sources import pdf

    w = write.Writer()
    held = w.font(font)
    w.pages([write.stream(content)], [b"/Resources<</Font<</F1 %d 0 R>>>>" % held])
    return repr(list(pdf.rows_of("1", w.table(), pdf.Limits())))


@pytest.mark.parametrize(
    "content",
    [
        b"BT /F1 10 Tf 1 0 0 1 40 700 Tm (Item) Tj /F1 7.5 Tf 1 0 0 1 -5 .5 Tm (wide and outside) Tj ET", b"2 Tc BT /F1 10 Tf 1 0 0 1 40 700 Tm (a b) Tj ET",
        b"BT /F1 10 Tf 2 1 0 1 40 700 Tm ( led) Tj ET", b"BT /F2 10 Tf 1 0 0 1 40 700 Tm (no font) Tj ET", b"9 /F1 10 Tf 1 0 0 1 40 700 Tm (x) Tj (y) Tj ET",
        b"3 Ts 50 Tz /F1 10 Tf -1 0 0 -2 40 700 Tm (q) Tj", b"/N Ts /F1 10 Tf 1 0 0 1 40 700 Tm (q) Tj (r) Tj" + b" " * 99, b"1 0 0 1 5 5 cm /F1 0 Tf 1 0 0 1 40 700 Tm () Tj (a) Tj",
    ],
)
def test_strings_shown_in_one_look_are_those_of_their_operators(monkeypatch, content):
    """The same file is read once more token by token, with patterns that nothing fits."""
    import re

    from pagewright.sources import content as streams
    from pagewright.sources import pdf

    quick = _read(content)
    monkeypatch.setattr(streams, "_SHOWN", re.compile(rb"(?!)"))
    monkeypatch.setattr(streams.Interpreter, "straight", lambda *a: None)
    for name in ("_PAIR", "_HEAD", "_PLACE"):
        monkeypatch.setattr(pdf, name, re.compile(rb"(?!)"))
    assert quick == _read(content)


def test_plain_fonts_are_made_once():
    from pagewright.sources import fonts

    doc = SimpleNamespace(resolve=lambda v: v)
    one, two = ({"Subtype": "Type1", "BaseFont": "Helvetica"} for _ in range(2))
    assert fonts.font_of(one, doc) is fonts.font_of(two, doc)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_plain_pages(spark, seed, monkeypatch):
    """Pages that are one table, against all pages taken one by one."""
    r = random.Random(seed)
    pages = [_page(r, ["12", "3.5", "Item", "abc def", "7,000", "Qty"]) for _ in range(400)]
    schema = "doc_id string, page int, width double, height double, spans array<struct<bounds: struct<x: double, y: double, width: double, height: double>, text: string, font_size: double, font_family: string, direction: string, has_leading_space: boolean, color: string, href: string>>"
    rows = [(f"d{k}", 1, 612.0, 792.0, [{"bounds": {c: s[c] for c in NUMBERS[:4]}, **{c: s[c] for c in s if c not in NUMBERS[:4]}} for s in p]) for k, p in enumerate(pages)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    told = sorted(map(repr, page.blocks(df).collect()))
    plainly = page._mapped
    monkeypatch.setattr(page, "_mapped", lambda *a, plain_rows=None, **more: plainly(*a, **more))
    assert told == sorted(map(repr, page.blocks(df).collect()))
    assert sum("block_type='table'" in t for t in told) > 40


def test_drawings_go_to_python_without_inner_lists(spark):
    """Clips are null as a rule: each row would fill the offsets of all clips of its batch anew."""
    from pagewright.schema import PAGES

    pages = spark.createDataFrame([], PAGES)
    sent = pages.select(page._drawn(pages, "paths")).schema["paths"].dataType.elementType
    assert sent.names == ["d", "stroke", "stroke_opacity"]


def test_a_line_is_read_once(monkeypatch):
    page._ends_of.cache_clear()
    paths = [{"d": "M 30.0 762 L 400.0 762", "stroke": "#000000", "stroke_opacity": 1.0}] * 50
    assert list(page._strokes(paths)) == [(30.0, 762.0, 400.0, 762.0)] * 50
    assert page._ends_of.cache_info().misses == 1
