"""Relational rows laid out as pages of spans, and as PDF bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SPAN


def span(seq: Column, text: Column, x: Column, y: Column, size: float | Column = 10.0, family: str | Column = "Body", width: Column | None = None, spaced: bool | Column = False) -> Column:
    """A span of SPAN's type; each character is half as wide as high unless ``width`` is given."""
    null = lambda kind: F.lit(None).cast(kind)
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    size = as_column(size).cast("double")
    width = F.length(text) * size * 0.5 if width is None else width
    return F.struct(
        seq.cast("int").alias("seq"), text.alias("text"), null("string").alias("href"), as_column(spaced).alias("has_leading_space"),
        null("double").alias("text_adjustment_before"), null("double").alias("natural_width"), null("double").alias("character_spacing"), null("double").alias("word_spacing"),
        F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), size.alias("height")).alias("bounds"),
        F.lit("ltr").alias("direction"), null("string").alias("font_name"), as_column(family).alias("font_family"), F.lit("#000000").alias("color"),
        null("double").alias("fill_opacity"), null("string").alias("stroke_color"), F.lit(0).alias("rendering_mode"), size.alias("font_size"), null("array<double>").alias("transform"),
    ).cast(SPAN)


def page_of(doc: Column, page: Column, spans: Column, *more: Column, width: float = 612.0, height: float = 792.0) -> list[Column]:
    """The columns of a page relation."""
    return [
        doc.cast("string").alias("doc_id"), page.cast("int").alias("page"), F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.lit(0).alias("rotate"), spans.alias("spans"), *more,
    ]


def stroke(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A stroked straight line as a path."""
    n = lambda c: c.cast("double").cast("string")
    d = F.concat(F.lit("M "), n(x1), F.lit(" "), n(y1), F.lit(" L "), n(x2), F.lit(" "), n(y2))
    return F.struct(d.alias("d"), F.lit("#000000").alias("stroke"), F.lit(1.0).alias("stroke_opacity"))


def invoices(lineitem: DataFrame, right: bool = False, ruled: bool = False) -> DataFrame:
    """One page an order: a header row and a row for each line item, in three columns.

    ``right``: the last two columns end at one x instead of beginning there. ``ruled``: rules across
    the page between rows, and rows of a page closer than cells need to be told apart by gaps.
    """
    item = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
    )
    # dealt by a number of its own: a page costs more than its few bytes let the optimiser expect
    parts = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    orders = lineitem.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    row = F.transform("items", lambda r, i: F.struct((i + 1).alias("n"), r["l_partkey"].cast("string").alias("a"), r["quantity"].alias("b"), r["price"].cast("string").alias("c")))
    body = orders.select(F.col("l_orderkey").alias("doc"), row.alias("r"))
    head = F.array(F.struct(F.lit(0).alias("n"), F.lit("Item").alias("a"), F.lit("Qty").alias("b"), F.lit("Price").alias("c")))
    every = F.concat(head, F.col("r"))
    place = (("a", 40), ("b", 100), ("c", 130)) if ruled else (("a", 40), ("b", 200), ("c", 320))

    def at(k: int, x: int, text: Column) -> Column:
        return F.lit(x) + 60 - F.length(text) * 5.0 if right and k else F.lit(x)

    cells = F.flatten(F.transform(every, lambda r: F.array(*[span(3 * r["n"] + k, r[c], at(k, x, r[c]), 750 - 15 * r["n"]) for k, (c, x) in enumerate(place)])))
    more = []
    if ruled:
        lines = F.sequence(F.lit(0), F.size(every))
        more = [F.transform(lines, lambda n: stroke(F.lit(30), 762 - 15 * n, F.lit(400), 762 - 15 * n)).alias("paths")]
    return body.select(*page_of(F.col("doc"), F.lit(1), cells, *more))


def pdf_bytes(page_lines: list[list[tuple[float, float, float, str]]]) -> bytes:
    """A small PDF: for each page, (x, y, size, text) in one font."""
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    kids = []
    for lines in page_lines:
        esc = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        shown = [b"/F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj" % (s, x, y, t.encode() if t.isascii() and t.isalnum() else esc(t)) for x, y, s, t in lines]
        body = b"BT " + b" ".join(shown) + b" ET"
        n = len(objects) + 1
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (n + 1))
        objects.append(b"<</Length %d>>stream\n%s\nendstream" % (len(body), body))
        kids.append(b"%d 0 R" % n)
    objects[1] = b"<</Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(kids), len(kids))
    out, at = bytearray(b"%PDF-1.7\n"), []
    for k, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start)
    return bytes(out)
