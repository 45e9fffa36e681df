"""Queries of the document engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .operators import document, media, page, render, structure, verify
from .plans import layout, write
from .sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add

#: Parts that the texts of one split of a reader (128 MB of a file at most) are dealt over.
PARTS_A_SPLIT = 16


def _t(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A table; dealt ``by`` a column where a page or a file is made of each row, which costs far more than the
    row's few bytes let the reader expect: a table of a few megabytes would be one task."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if by is None else rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by)


_REVENUE = "SELECT l_orderkey::VARCHAR AS doc_id, sum(cast(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS revenue FROM lineitem GROUP BY 1"


def _revenue(pages: DataFrame) -> DataFrame:
    price = page.cells(pages, only=("doc_id", "column", "text")).where("column = 2").where(T.is_numeric_field(F.col("text")))
    return price.groupBy("doc_id").agg(F.sum(F.col("text").cast("decimal(18,2)")).cast("double").alias("revenue"))


@_query(_REVENUE)
def invoice_revenue(spark, sf_dir):
    return _revenue(layout.invoices(_t(spark, sf_dir, "lineitem")))


@_query(_REVENUE)
def invoice_revenue_pdf(spark, sf_dir):
    """The same from PDF bytes: rendered, parsed, and read back as tables."""
    spans = layout.invoices(_t(spark, sf_dir, "lineitem")).select("doc_id", F.transform("spans", lambda s: F.struct(s["bounds"]["x"], s["bounds"]["y"], s["font_size"], s["text"])).alias("s"))

    def render_pdf(batches):
        import pyarrow as pa

        for batch in batches:
            page = batch.column(1)
            ends, flat = page.offsets.to_pylist(), page.flatten()
            lines = list(zip(*(c.to_pylist() for c in flat.flatten()), strict=True))
            out = [layout.pdf_bytes([lines[a - ends[0] : b - ends[0]]]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    named = spans.select("doc_id", F.col("s").cast("array<struct<x: double, y: double, size: double, text: string>>").alias("s"))
    return _revenue(pdf.pages_of(named.mapInArrow(render_pdf, "doc_id string, content binary")).where("error is null"))


_MARGIN = "SELECT source AS doc_id, (doc_id // 4)::INT AS page, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS signature FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)"


@_query(f"""WITH m AS (SELECT DISTINCT * FROM ({_MARGIN})), s AS (
  SELECT *, min(page) OVER (PARTITION BY doc_id, signature) AS f, lead(page) OVER (PARTITION BY doc_id, signature ORDER BY page) AS n FROM m)
SELECT doc_id, page, signature, (f < page OR coalesce(n <= page + 3, FALSE)) AS suppressed FROM s""")
def furniture_suppressed(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.floor(F.col("doc_id") / 4).cast("int").alias("page"), F.explode(F.split("text", "\n")).alias("l"))
    margin = d.select("doc_id", "page", T.furniture_signature(F.col("l")).alias("signature")).distinct()
    return document.repeated_furniture(margin).select("doc_id", "page", "signature", "suppressed")


@_query("SELECT l_suppkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS m FROM lineitem GROUP BY l_suppkey")
def upper_median(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(structure.upper_median("l_extendedprice").alias("m"))


@_query("""SELECT p_brand, body_size FROM (SELECT p_brand, floor(p_size * 0.3 * 2 + 0.5) / 2 AS body_size, count(*) AS n FROM part GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, body_size) = 1""")
def dominant_font(spark, sf_dir):
    return structure.dominant_size(_t(spark, sf_dir, "part").withColumn("size", F.col("p_size") * 0.3), ["p_brand"], "size")


@_query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, (12 + p_partkey % 9)::DOUBLE AS b, (40 + p_partkey % 15)::DOUBLE AS l, p_partkey % 2 = 0 AS bold,
  CASE WHEN p_partkey % 5 = 0 THEN (p_partkey % 7)::VARCHAR || '.' || p_name ELSE p_name END AS n, p_partkey % 5 = 0 AND p_partkey % 3 = 0 AS numbered FROM part)
SELECT p_partkey, CASE WHEN s >= l * 0.94 AND s / b >= 1.35 THEN 1 WHEN numbered THEN CASE WHEN s / b >= 1.35 THEN 3 ELSE 4 END
  WHEN s / b >= 1.7 THEN 1 WHEN s / b >= 1.5 THEN 2 WHEN s / b >= 1.35 THEN 3 WHEN s / b >= 1.15 OR (bold AND s / b >= 1.08) THEN 4 END::INT AS level FROM p""")
def heading_levels(spark, sf_dir):
    """Levels from sizes, numbers and weight; body and largest sizes differ by row."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    name = F.when(k % 15 == 0, F.concat((k % 7).cast("string"), F.lit(". "), F.col("p_name"))).otherwise(F.col("p_name"))
    level = T.heading_level(size, (12 + k % 9).cast("double"), (40 + k % 15).cast("double"), k % 2 == 0, name)
    return _t(spark, sf_dir, "part").select("p_partkey", level.cast("int").alias("level"))


_ISLANDS = """WITH i AS (SELECT user_id, epoch_us(ts)::DOUBLE / 1e6 AS a, epoch_us(ts)::DOUBLE / 1e6 + 600 AS b FROM events),
r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r),
s AS (SELECT user_id, k, max(b) - min(a) AS w FROM g GROUP BY 1, 2)
SELECT user_id, round(sum(w))::BIGINT AS covered FROM s GROUP BY 1"""


@_query(_ISLANDS)
def covered_width(spark, sf_dir):
    left = F.unix_micros("ts").cast("double") / 1e6
    i = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", left.alias("left"), (left + 600).alias("right"))
    return structure.covered_width(i, ["user_id"]).select("user_id", F.round("covered").cast("bigint").alias("covered"))


@_query("""WITH t AS (SELECT o_custkey::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS page, o_orderkey % 3 AS shape FROM orders),
n AS (SELECT *, lag(shape) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM t)
SELECT doc_id, page, sum(CASE WHEN before = shape THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS logical_table FROM n""")
def table_continuation(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.row_number().over(w).alias("page"), F.lit(0).alias("table_seq"), (F.col("o_orderkey") % 3).alias("k"))
    o = o.withColumn("columns", F.array(F.lit(40.0), 150.0 + 100 * F.col("k"), F.lit(500.0)))
    return structure.continued_tables(o, width=612.0).select("doc_id", "page", F.col("logical_table").cast("bigint").alias("logical_table"))


_RECTS = "SELECT {k} AS {id}, {n} % 25 AS k, ({k} % 40)::DOUBLE AS x0, ({k} % 30)::DOUBLE AS y0, ({k} % 40 + {w})::DOUBLE AS x1, ({k} % 30 + {w})::DOUBLE AS y1 FROM {t}"


@_query(f"""WITH i AS ({_RECTS.format(k="p_partkey", id="inner_id", n="p_partkey", w="p_size % 10", t="part")}), o AS ({_RECTS.format(k="s_suppkey", id="outer_id", n="s_nationkey", w="(15 + s_suppkey % 30)", t="supplier")})
SELECT i.k::BIGINT AS k, inner_id, o.outer_id FROM i JOIN o ON i.k = o.k AND o.x0 <= i.x0 AND o.y0 <= i.y0 AND o.x1 >= i.x1 AND o.y1 >= i.y1
QUALIFY row_number() OVER (PARTITION BY i.k, inner_id ORDER BY (o.x1 - o.x0) * (o.y1 - o.y0), o.outer_id) = 1""")
def panel_smallest(spark, sf_dir):
    def rects(t, k, name, n, w):
        x, y = (F.col(k) % 40).cast("double"), (F.col(k) % 30).cast("double")
        return _t(spark, sf_dir, t).select(F.col(k).alias(name), (n % 25).cast("bigint").alias("k"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + w).alias("y1"))

    inner = rects("part", "p_partkey", "inner_id", F.col("p_partkey"), F.col("p_size") % 10)
    outer = rects("supplier", "s_suppkey", "outer_id", F.col("s_nationkey"), 15 + F.col("s_suppkey") % 30)
    return structure.smallest_container(inner, outer, ["k"])


@_query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    """Targets of links, as the inspection of pages finds them."""
    return verify.inspect(_t(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.explode("links").alias("href"))


@_query("SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS heading FROM pages")
def html_headings(spark, sf_dir):
    """Headings of all levels, as the inspection of pages finds them."""
    return verify.inspect(_t(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.explode("headings").alias("heading"))


@_query("""SELECT p_partkey, replace(replace(replace(replace(p_name || '<&">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
'| ' || replace(p_name, '|', '\\|') || ' | ' || p_brand || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_type || ' | a\\|b |' AS md FROM part""")
def rendered_tables(spark, sf_dir):
    rows = F.array(F.array("p_name", "p_brand"), F.array(F.col("p_type"), F.lit("a|b")))
    return _t(spark, sf_dir, "part").select("p_partkey", T.html_escape(F.concat("p_name", F.lit('<&">'))).alias("html"), render.table_markdown(rows).alias("md"))


# ------------------------------------------------------------------ PDF files
def _texts(pages: DataFrame) -> DataFrame:
    return pages.where("error is null").select("doc_id", "page", F.posexplode("spans").alias("seq", "s"))


@_query("""SELECT c_custkey::VARCHAR AS doc_id, c_name AS text, CASE c_custkey % 3 WHEN 0 THEN length(c_name) * 6.0 WHEN 1 THEN length(c_name) * 4.0 ELSE length(c_name) * 5.0 END AS width FROM customer""")
def pdf_encodings(spark, sf_dir):
    """Names through a composite font (ToUnicode ranges, W), a font with differences by glyph name, and
    a standard font; widths of the spans at 10 points."""

    def make(key: int, name: str) -> bytes:
        w = write.Writer()
        if key % 3 == 0:
            font, text = w.composite(600), b"<" + b"".join(b"%04X" % (ord(c) + 0x100) for c in name) + b">"
        elif key % 3 == 1:
            held = sorted(set(name))
            names = b"".join(b"/uni%04X" % ord(c) for c in held)
            widths = b" ".join([b"400"] * len(held))
            font = w.font(b"/Subtype/Type1/BaseFont/Own/FirstChar 1/Widths[%s]/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1%s]>>" % (widths, names))
            text = b"<" + b"".join(b"%02X" % (held.index(c) + 1) for c in name) + b">"
        else:
            font, text = w.font(b"/Subtype/Type1/BaseFont/Own/Encoding/MacRomanEncoding/FontDescriptor<</MissingWidth 500>>"), write.literal(name, "mac-roman")
        w.pages([write.flate(write.show(40, 700, 10, text))], [b"/Resources<</Font<</F1 %d 0 R>>>>" % font])
        return w.table()

    files = write.printed(_t(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("k"), "c_name"), make)
    return _texts(pdf.pages_of(files)).select("doc_id", "s.text", F.round("s.bounds.width", 6).alias("width"))


@_query("""SELECT p_brand AS doc_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS page, p_name AS text, 612.0 AS width FROM part""")
def pdf_containers(spark, sf_dir):
    """A file a brand and a page a part: objects in object streams, a predicted cross-reference
    stream, a page tree of two levels with inherited resources and boxes."""

    def make(names: list[str]) -> bytes:
        w = write.Writer()
        w.shared = b"/MediaBox[0 0 612 792]/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        w.pages([write.flate(write.show(40, 700, 10, write.literal(n))) for n in names], fan=7)
        return w.packed()

    brands = _t(spark, sf_dir, "part", "p_brand").groupBy(F.col("p_brand").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("n"))
    files = write.printed(brands.select("doc_id", F.transform("n", lambda x: x["p_name"]).alias("names")), make)
    return pdf.pages_of(files).select("doc_id", "page", F.get("spans", F.lit(0))["text"].alias("text"), "width")


@_query("""SELECT s_suppkey::VARCHAR AS doc_id, s_name || ' (' || s_nationkey || ')' AS text, 40.0 + s_suppkey % 7 AS x FROM supplier""")
def pdf_filters(spark, sf_dir):
    """Content through Flate, ASCIIHex, both, LZW and a PNG predictor; every second file has lost its cross references."""

    def make(key: int, text: str) -> bytes:
        w = write.Writer()
        w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        w.pages([write.FILTERS[key % len(write.FILTERS)](write.show(40 + key % 7, 700, 10, write.literal(text)))])
        data = w.table()
        return data if key % 2 else data[: data.rindex(b"xref\n0")] + b"trailer<</Root 1 0 R>>"

    name = F.concat("s_name", F.lit(" ("), F.col("s_nationkey").cast("string"), F.lit(")"))
    files = write.printed(_t(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").alias("k"), name.alias("text")), make)
    return _texts(pdf.pages_of(files)).select("doc_id", "s.text", "s.bounds.x")


@_query("""SELECT n_nationkey::VARCHAR AS doc_id, n_name AS text, CASE n_nationkey % 3 WHEN 0 THEN 'https://example.org/' || n_nationkey WHEN 1 THEN 'mailto:n' || n_nationkey || '@example.org' END AS href,
CASE WHEN n_nationkey % 2 = 0 THEN '#ff8000' ELSE '#0000ff' END AS color, 100.0 + n_nationkey AS x, 500.0 AS y, n_nationkey % 2 = 1 AS spaced FROM nation""")
def pdf_links_and_forms(spark, sf_dir):
    """Link annotations (unsafe ones are none), text in nested forms with matrices, colours, and spaces in front."""

    def make(key: int, name: str) -> bytes:
        w = write.Writer()
        font = w.font()
        colour = b"1 0.5 0 rg" if key % 2 == 0 else b"1 1 0 0 k"
        lead = b" " if key % 2 else b""
        own = b"/Resources<</Font<</F1 %d 0 R>>>>" % font
        text = b"(" + lead + write.literal(name)[1:]
        inner = w.add(write.stream(colour + b" " + write.show(-6 if key % 2 else 0, 0, 10, text), b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 60 400]" + own))
        outer = w.add(write.stream(b"q 1 0 0 1 %d 0 cm /In Do Q" % key, b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 40 100]/Resources<</XObject<</In %d 0 R>>>>" % inner))
        target = (b"https://example.org/%d" % key, b"mailto:n%d@example.org" % key, b"javascript:%d" % key)[key % 3]
        link = b"<</Type/Annot/Subtype/Link/Rect[90 490 400 520]/A<</S/URI/URI(%s)>>>>" % target
        w.pages([write.stream(b"/Out Do")], [b"/Annots[%s]/Resources<</XObject<</Out %d 0 R>>>>" % (link, outer)])
        return w.table()

    files = write.printed(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_nationkey").alias("k"), "n_name"), make)
    return _texts(pdf.pages_of(files)).select("doc_id", "s.text", "s.href", "s.color", "s.bounds.x", "s.bounds.y", F.col("s.has_leading_space").alias("spaced"))


@_query("""SELECT s_suppkey::VARCHAR AS doc_id, CASE s_suppkey % 5 WHEN 0 THEN 'INVALID_PDF' WHEN 1 THEN 'UNSUPPORTED_FEATURE' WHEN 2 THEN 'RESOURCE_LIMIT' END AS code,
CASE WHEN s_suppkey % 5 > 2 THEN s_name END AS text FROM supplier""")
def pdf_errors(spark, sf_dir):
    """Typed errors a file: no PDF, an encrypted one, a stream beyond the limit; other files are read."""

    def make(key: int, name: str) -> bytes:
        if key % 5 == 0:
            return b"no document " + name.encode()
        w = write.Writer()
        w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        w.pages([write.flate(write.show(40, 700, 10, write.literal(name)) + b" " * (200_000 if key % 5 == 2 else 0))])
        data = w.table()
        return data.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt<</Filter/Standard>>") if key % 5 == 1 else data

    files = write.printed(_t(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").alias("k"), "s_name"), make)
    read = pdf.pages_of(files, max_decoded_stream_bytes=100_000)
    return read.select("doc_id", "error.code", F.get("spans", F.lit(0))["text"].alias("text"))


@_query("""SELECT p_brand AS doc_id, page, text FROM (SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS page, p_name AS text FROM part) WHERE page BETWEEN 4 AND 9""")
def pdf_page_window(spark, sf_dir):
    """Pages 4 to 9 of each file, found by the counts in the page tree."""

    def make(names: list[str]) -> bytes:
        w = write.Writer()
        w.shared = b"/MediaBox[0 0 612 792]/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        w.pages([write.stream(write.show(40, 700, 10, write.literal(n))) for n in names], fan=3)
        return w.packed(20)

    brands = _t(spark, sf_dir, "part", "p_brand").groupBy(F.col("p_brand").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("n"))
    files = write.printed(brands.select("doc_id", F.transform("n", lambda x: x["p_name"]).alias("names")), make)
    return pdf.pages_of(files, pages=(4, 9)).select("doc_id", "page", F.get("spans", F.lit(0))["text"].alias("text"))


_RULED = "SELECT s_nationkey::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::INT AS row, s_name AS name, s_suppkey::VARCHAR AS key FROM supplier"


@_query(_RULED)
def pdf_ruled_tables(spark, sf_dir):
    """Tables drawn with rules (strokes and thin filled boxes), their columns too near for gaps to part them.

    A page holds as many rows as one of usual height does: rules nearer than a share of the page's height are one rule."""
    most = 30

    def drawn(rows: list[dict]) -> bytes:
        top, body = 20 * (len(rows) + 2), []
        for k, (a, b) in enumerate([("Supplier", "Key"), *((r["s_name"], str(r["s_suppkey"])) for r in rows)]):
            y = top - 20 * (k + 1)
            body += [write.show(50, y + 6, 10, write.literal(a)), write.show(170, y + 6, 10, write.literal(b))]
        for k in range(len(rows) + 2):
            y = top - 20 * k
            body.append(b"40 %d m 420 %d l S" % (y, y) if k % 2 else b"40 %g 380 1 re f" % (y - 0.5))
        return write.flate(b"\n".join(body))

    def make(rows: list[dict]) -> bytes:
        w = write.Writer()
        w.shared = b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        held = [rows[k : k + most] for k in range(0, len(rows), most)]
        w.pages([drawn(h) for h in held], [b"/MediaBox[0 0 612 %d]" % (40 + 20 * (len(h) + 2)) for h in held], fan=50)
        return w.table()

    nations = _t(spark, sf_dir, "supplier", "s_nationkey").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))
    cells = page.cells(pdf.pages_of(write.printed(nations, make))).where("reason = 'horizontal-row-rules' and row > 0")
    cells = cells.withColumn("row", (F.col("page") - 1) * most + F.col("row"))
    at = lambda k: F.max(F.when(F.col("column") == k, F.col("text")))
    return cells.groupBy("doc_id", "row").agg(at(0).alias("name"), at(1).alias("key"))


# ------------------------------------------------------------------ lines, tables and columns
@_query(_REVENUE)
def invoice_right_aligned(spark, sf_dir):
    """Numbers that end at one x, so cells of a column begin apart."""
    return _revenue(layout.invoices(_t(spark, sf_dir, "lineitem"), right=True))


@_query("SELECT l_orderkey::VARCHAR AS doc_id, count(*)::BIGINT AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1")
def invoice_ruled(spark, sf_dir):
    """Rows between rules across the page; gaps alone would not part their cells."""
    rows = page.cells(layout.invoices(_t(spark, sf_dir, "lineitem"), ruled=True), only=("doc_id", "row", "column", "text", "reason")).where("reason = 'horizontal-row-rules' and row > 0 and column = 1")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text").cast("bigint")).alias("quantity"))


@_query("""WITH k AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
p AS (SELECT *, k * greatest(n // 18, 1) // n AS page FROM k), i AS (SELECT *, row_number() OVER (PARTITION BY p_brand, page ORDER BY k) - 1 AS i FROM p)
SELECT p_brand AS doc_id, string_agg(p_name, '|' ORDER BY page, CASE WHEN n < 12 THEN 0 ELSE i % 3 END, i) AS text FROM i GROUP BY 1""")
def reading_columns(spark, sf_dir):
    """Three columns painted row by row, a little apart in height: read column by column. A page holds 18 to 35 parts of a
    brand, or all that it has; fewer than four a column make none, and stay as painted."""
    w = W.partitionBy("p_brand")
    k, n = F.row_number().over(w.orderBy("p_partkey")) - 1, F.count(F.lit(1)).over(w)
    parts = _t(spark, sf_dir, "part").select("p_brand", "p_name", k.alias("k"), n.alias("n"))
    parts = parts.withColumn("page", F.floor(F.col("k") * F.greatest(F.floor(F.col("n") / 18), F.lit(1)) / F.col("n")))
    parts = parts.withColumn("i", F.row_number().over(W.partitionBy("p_brand", "page").orderBy("k")) - 1)
    i = F.col("i")
    at = layout.span(i, F.col("p_name"), 40 + (i % 3) * 190, 740 - F.floor(i / 3) * 15 - (i % 3) * 4, size=8.0, width=F.lit(100.0) + F.length("p_name"))
    spans = parts.select("p_brand", "page", at.alias("span")).groupBy("p_brand", "page").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    pages = spans.select(*layout.page_of(F.col("p_brand"), F.col("page") + 1, F.col("spans")))
    ordered = F.array_sort(F.collect_list(F.struct("page", "line_seq", "text")))
    return page.lines(pages).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "|").alias("text"))


@_query("""SELECT p_partkey::VARCHAR AS doc_id, replace(p_name, ' ', '') || (p_size % 10) || ' ' || p_brand || CASE WHEN p_size % 3 = 0 THEN '.' ELSE ' .' END AS text FROM part""")
def superscript_lines(spark, sf_dir):
    """A word, a raised figure, and more of the line: one line, spaced by gaps, marks closed up."""
    name, figure = F.replace("p_name", F.lit(" "), F.lit("")), (F.col("p_size") % 10).cast("string")
    w = F.length(name) * 5.0
    last = F.when(F.col("p_size") % 3 == 0, ".").otherwise(" .")
    spans = F.array(
        layout.span(F.lit(0), name, F.lit(40.0), F.lit(700.0)),
        layout.span(F.lit(1), figure, 40.0 + w, F.lit(705.0), size=5.0),
        layout.span(F.lit(2), F.col("p_brand"), 40.0 + w + 6.0, F.lit(700.0)),
        layout.span(F.lit(3), F.ltrim(last), 40.0 + w + 6.0 + F.length("p_brand") * 5.0 + 3.0, F.lit(700.0), spaced=F.col("p_size") % 3 != 0),
    )
    return page.lines(_t(spark, sf_dir, "part", "p_partkey").select(*layout.page_of(F.col("p_partkey"), F.lit(1), spans))).select("doc_id", "text")


def _lines_down(rows, at, step: float = 13.0, size=10.0, family="Body"):
    """Spans of an array of struct<text, x, size, family>, one below the other."""
    return F.transform(rows, lambda r, i: layout.span(i, r["text"], r["x"], at - i * step, size=r["size"], family=r["family"]))


def _row(text, x: float = 40.0, size: float = 10.0, family: str = "Body"):
    return F.struct(text.alias("text"), F.lit(x).alias("x"), F.lit(size).alias("size"), F.lit(family).alias("family"))


@_query("""SELECT p_partkey::VARCHAR AS doc_id, p_name || ' is of ' || p_type || ' kind, an exam' || 'ple of the well-known ' || p_brand || ' line.' AS text FROM part""")
def wrapped_paragraphs(spark, sf_dir):
    """Paragraph lines joined: a hyphen at a line's end goes, unless its word has another."""
    rows = F.array(_row(F.concat("p_name", F.lit(" is of"))), _row(F.concat("p_type", F.lit(" kind, an exam-"))), _row(F.lit("ple of the")), _row(F.concat(F.lit("well-known "), F.col("p_brand"))), _row(F.lit("line.")))
    pages = _t(spark, sf_dir, "part", "p_partkey").select(*layout.page_of(F.col("p_partkey"), F.lit(1), _lines_down(rows, 700.0)))
    return page.blocks(pages).where("block_type = 'paragraph'").select("doc_id", "text")


@_query("""SELECT s_suppkey::VARCHAR AS doc_id, u.i::INT AS item, CASE u.i WHEN 0 THEN s_name WHEN 1 THEN 'second of ' || s_nationkey || ' going on' ELSE 'third' END AS text, s_suppkey % 2 = 1 AS ordered FROM supplier, (SELECT unnest([0, 1, 2]) AS i) u""")
def lists_found(spark, sf_dir):
    """Items by bullets or numbers, one of them over two lines; other marks are no items."""
    even = F.col("s_suppkey") % 2 == 0
    mark = lambda n: F.when(even, F.lit("• ")).otherwise(F.lit(f"{n}) "))
    rows = F.array(
        _row(F.concat(mark(1), F.col("s_name"))), _row(F.concat(mark(2), F.lit("second of "), F.col("s_nationkey").cast("string"))), _row(F.lit("going on"), 46.0),
        _row(F.concat(mark(3), F.lit("third"))),
    )
    pages = _t(spark, sf_dir, "supplier", "s_suppkey").select(*layout.page_of(F.col("s_suppkey"), F.lit(1), _lines_down(rows, 700.0)))
    return page.blocks(pages).where("block_type = 'list'").select("doc_id", "ordered", F.posexplode("items").alias("item", "i")).select("doc_id", "item", "i.text", "ordered")


@_query("""SELECT s_suppkey::VARCHAR AS doc_id, block_type, text FROM (SELECT s_suppkey, unnest(['preformatted', 'definitionList', 'employment']) AS block_type,
unnest([s_name || chr(10) || '    indented', 'NAME=' || s_name || ';KEY=' || s_suppkey, 'Keeper ' || s_suppkey || ';organization=' || s_name || ';date=2019']) AS text FROM supplier)""")
def blocks_found(spark, sf_dir):
    """Monospaced runs, label and value pairs, and a bold title with its place and date, told apart."""
    place = lambda n, t, x, y, f="Body": layout.span(F.lit(n), t, F.lit(float(x)), F.lit(float(y)), family=f)
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    spans = F.array(
        place(0, name, 40, 700, "Courier"), place(1, F.lit("indented"), 60, 688, "Courier"),
        place(2, F.lit("NAME"), 40, 650), place(3, name, 40, 637), place(4, F.lit("KEY"), 40, 624), place(5, key, 40, 611),
        place(6, F.concat(F.lit("Keeper "), key), 40, 500, "Body-Bold"), place(7, name, 40, 487), place(8, F.lit("2019"), 400, 500),
        place(9, F.lit("plain text"), 40, 400), place(10, F.lit("more plain text"), 40, 300), place(11, F.lit("and more"), 40, 200),
    )
    found = page.blocks(_t(spark, sf_dir, "supplier", "s_suppkey").select(*layout.page_of(F.col("s_suppkey"), F.lit(1), spans))).where("block_type != 'paragraph'")
    items = F.array_join(F.transform("items", lambda x: F.concat(x["term"], F.lit("="), x["text"])), ";")
    return found.select("doc_id", "block_type", F.concat_ws(";", F.when(F.col("text") != "", F.col("text")), F.when(items != "", items)).alias("text"))


# ------------------------------------------------------------------ documents over pages
def _atlas(spark, sf_dir) -> DataFrame:
    """A document a region: a title page, then pages by nation with furniture, a heading, a sentence and a table of its
    suppliers, twenty a page; on later pages the table goes on under its header."""
    nation, region, supplier = (_t(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    first = region.select(
        *layout.page_of(F.col("r_regionkey"), F.lit(1), F.array(
            layout.span(F.lit(0), F.col("r_name"), F.lit(40.0), F.lit(660.0), size=24.0),
            layout.span(F.lit(1), F.lit("All nations of the region."), F.lit(40.0), F.lit(630.0)),
            layout.span(F.lit(2), F.lit("page 1"), F.lit(300.0), F.lit(20.0)),
        ))
    )
    held = nation.join(supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    held = held.withColumn("s", F.coalesce("s", F.array().cast("array<struct<s_suppkey: bigint, s_name: string>>")))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.size("s") - 1) / 20), F.lit(0)).cast("int"))))
    number = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey", "part")) + 1
    held = held.withColumn("number", number).withColumn("s", F.slice("s", F.col("part") * 20 + 1, F.lit(20)))
    rows = F.concat(F.array(F.struct(F.lit("Key").alias("a"), F.lit("Name").alias("b"))), F.transform("s", lambda x: F.struct(x["s_suppkey"].cast("string").alias("a"), x["s_name"].alias("b"))))
    cells = F.flatten(F.transform(rows, lambda r, i: F.array(layout.span(3 + 2 * i, r["a"], F.lit(40.0), 600 - 15 * i), layout.span(4 + 2 * i, r["b"], F.lit(200.0), 600 - 15 * i))))
    foot = layout.span(F.lit(0), F.concat(F.lit("page "), F.col("number").cast("string")), F.lit(300.0), F.lit(20.0))
    opening = F.array(
        layout.span(F.lit(1), F.col("n_name"), F.lit(40.0), F.lit(660.0), size=16.0),
        layout.span(F.lit(2), F.concat(F.lit("Suppliers of "), F.col("n_name"), F.lit(" & others.")), F.lit(40.0), F.lit(630.0)),
    )
    spans = F.concat(F.array(foot), F.when(F.col("part") == 0, opening).otherwise(F.slice(opening, F.lit(1), F.lit(0))), cells)
    return first.unionByName(held.select(*layout.page_of(F.col("n_regionkey"), F.col("number"), spans)))


_ATLAS = """WITH s AS (SELECT * FROM supplier),
n AS (SELECT n_regionkey, n_nationkey, n_name, coalesce(string_agg({row}, '' ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), '') AS rows, count(s_suppkey) AS many
  FROM nation LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY ALL)"""


@_query(_ATLAS.format(row="'<tr><td>' || s_suppkey || '</td><td>' || s_name || '</td></tr>'") + """
SELECT r_regionkey::VARCHAR AS doc_id, '<article class="pdf-semantic-document"><header><h1>' || r_name || '</h1><p>All nations of the region.</p></header>' || string_agg(
  CASE WHEN n.n_nationkey = f.least THEN '' ELSE '</section>' END || '<section data-level="2"><h2>' || n_name || '</h2><p>Suppliers of ' || n_name || ' &amp; others.</p>' ||
  CASE WHEN many > 0 THEN '<table><tr><th scope="col">Key</th><th scope="col">Name</th></tr>' || rows || '</table>' ELSE '<p>Key Name</p>' END, '' ORDER BY n.n_nationkey) || '</section></article>' AS text
FROM n JOIN region ON n_regionkey = r_regionkey JOIN (SELECT n_regionkey, min(n_nationkey) AS least FROM nation GROUP BY 1) f ON f.n_regionkey = n.n_regionkey GROUP BY r_regionkey, r_name""")
def document_html(spark, sf_dir):
    """Whole documents as HTML: page numbers left out, sections opened and closed, tables with headers."""
    return document.whole(document.html(document.assemble(page.blocks(_atlas(spark, sf_dir)))))


@_query(_ATLAS.format(row="'| ' || s_suppkey || ' | ' || replace(s_name, '_', chr(92) || '_') || ' |' || chr(10)") + """
SELECT r_regionkey::VARCHAR AS doc_id, '# ' || r_name || chr(10) || chr(10) || 'All nations of the region.' || chr(10) || chr(10) || string_agg(
  '## ' || replace(n_name, '_', chr(92) || '_') || chr(10) || chr(10) || 'Suppliers of ' || replace(n_name, '_', chr(92) || '_') || ' & others.' || chr(10) || chr(10) ||
  CASE WHEN many > 0 THEN '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || rows || chr(10) ELSE 'Key Name' || chr(10) || chr(10) END, '' ORDER BY n_nationkey) AS text
FROM n JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def document_markdown(spark, sf_dir):
    return document.whole(document.markdown(document.assemble(page.blocks(_atlas(spark, sf_dir)))))


@_query("""WITH n AS (SELECT n_regionkey, n_nationkey, greatest(ceil(count(s_suppkey) / 20.0), 1)::BIGINT AS parts FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT r_regionkey::VARCHAR AS doc_id, (1 + coalesce(sum(parts), 0))::BIGINT AS pages_processed, (1 + coalesce(sum(parts), 0))::BIGINT AS suppressed_furniture,
coalesce(sum(parts - 1), 0)::BIGINT AS merged_tables FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY 1""")
def document_stats(spark, sf_dir):
    blocks = page.blocks(_atlas(spark, sf_dir))
    return document.stats(blocks, document.assemble(blocks)).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("pages_processed", "suppressed_furniture", "merged_tables")])


def _ledgers(spark, sf_dir) -> DataFrame:
    """A document a supplier: its line items as a table over as many pages as it needs."""
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    items = _t(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w) - 1)
    items = items.select("l_suppkey", F.floor(F.col("k") / 40).alias("p"), (F.col("k") % 40 + 1).alias("i"), F.col("l_orderkey").cast("string").alias("a"), F.col("l_quantity").cast("int").cast("string").alias("b"))
    held = items.groupBy("l_suppkey", "p").agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("r"))
    rows = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit("Order").alias("a"), F.lit("Quantity").alias("b"))), F.col("r"))
    spans = F.flatten(F.transform(rows, lambda r: F.array(layout.span(2 * r["i"], r["a"], F.lit(40.0), 690 - 14 * r["i"]), layout.span(2 * r["i"] + 1, r["b"], F.lit(300.0), 690 - 14 * r["i"]))))
    return held.select(*layout.page_of(F.col("l_suppkey"), F.col("p") + 1, spans))


def _ledger_sums(runs: DataFrame) -> DataFrame:
    whole = runs.where("block_type = 'table'").select("doc_id", F.size("tables").alias("parts"), document.body_rows(F.col("tables")).alias("rows"))
    amount = F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, r: s + F.get(r["cells"], F.lit(1)).cast("bigint"))
    return whole.groupBy("doc_id").agg(F.sum(F.size("rows")).cast("bigint").alias("rows"), F.sum(amount).alias("quantity"), F.sum("parts").cast("bigint").alias("parts"))


@_query("""SELECT l_suppkey::VARCHAR AS doc_id, count(*)::BIGINT AS rows, sum(l_quantity)::BIGINT AS quantity, ceil(count(*) / 40.0)::BIGINT AS parts FROM lineitem GROUP BY 1""")
def tables_over_pages(spark, sf_dir):
    """A table over as many pages as it needs, with its header on each: one table, one header."""
    whole = document.assemble(page.blocks(_ledgers(spark, sf_dir)))
    return _ledger_sums(whole)


def _accounts(spark, sf_dir) -> DataFrame:
    """A document of two pages a customer: a paragraph over the page break."""
    c = _t(spark, sf_dir, "customer", "c_custkey")
    one = F.array(layout.span(F.lit(0), F.concat(F.lit("The account of "), F.col("c_name"), F.lit(" is kept")), F.lit(40.0), F.lit(100.0)))
    two = F.array(
        layout.span(F.lit(0), F.concat(F.lit("in the segment of "), F.lower("c_mktsegment"), F.lit(", a wellknown one.")), F.lit(40.0), F.lit(690.0)),
        layout.span(F.lit(1), F.lit("A well-known end."), F.lit(40.0), F.lit(400.0)),
    )
    return c.select(*layout.page_of(F.col("c_custkey"), F.lit(1), one)).unionByName(c.select(*layout.page_of(F.col("c_custkey"), F.lit(2), two)))


@_query("""SELECT c_custkey::VARCHAR AS doc_id, 'The account of ' || c_name || ' is kept in the segment of ' || lower(c_mktsegment) || ', a well-known one.' AS text, 2::BIGINT AS pages FROM customer""")
def paragraphs_over_pages(spark, sf_dir):
    """A paragraph over a page break, with a compound that lost its hyphen there and is seen whole on the next page."""
    pages = _accounts(spark, sf_dir)
    out = document.continued(document.restored_hyphens(document.without_furniture(page.blocks(pages))))
    return out.where("run = 1").select("doc_id", "text", F.lit(2).cast("bigint").alias("pages"))


@_query("""WITH h AS (SELECT p_brand, p_partkey, 1 + (p_size % 4) AS level, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS run FROM part),
t AS (SELECT *, min(CASE WHEN level = 1 THEN run END) OVER (PARTITION BY p_brand) AS opens FROM h),
b AS (SELECT *, coalesce(max(CASE WHEN run > opens AND level <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY run), 0) AS broken FROM t),
s AS (SELECT *, run >= opens AND broken = 0 AS header, CASE WHEN level = 1 AND run > opens AND broken = 1 THEN 2 ELSE level END AS shown FROM b),
a AS (SELECT x.p_brand, x.run, count(y.run) AS closes FROM s x JOIN s y ON x.p_brand = y.p_brand AND y.run < x.run AND y.shown >= x.shown AND NOT coalesce(y.header, FALSE) AND NOT coalesce(x.header, FALSE)
  WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.p_brand = x.p_brand AND z.run > y.run AND z.run < x.run AND z.shown <= y.shown AND NOT coalesce(z.header, FALSE)) GROUP BY 1, 2)
SELECT s.p_brand AS doc_id, s.run::BIGINT AS run, CASE WHEN coalesce(header, FALSE) THEN 'header' ELSE 'body' END AS place, shown::INT AS shown, coalesce(closes, 0)::INT AS closes FROM s LEFT JOIN a ON a.p_brand = s.p_brand AND a.run = s.run""")
def section_nesting(spark, sf_dir):
    """Headings of a document: which stand in its header, the level shown, and the sections each closes."""
    heads = _t(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).cast("bigint").alias("run"), F.lit("heading").alias("block_type"),
        (1 + F.col("p_size") % 4).alias("level"), F.col("p_name").alias("text"), F.lit(792.0).alias("height"),
        F.array(F.struct(F.lit(700.0).alias("y"))).alias("lines"),
    )
    return document.nested(heads).select("doc_id", "run", "place", F.col("shown").cast("int").alias("shown"), F.col("closes").cast("int").alias("closes"))


# ------------------------------------------------------------------ text
@_query(r"""SELECT p_partkey, p_name || ' final flow' AS plain, len(regexp_extract_all(p_name || ' a-b, ' || p_brand, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))::INT AS tokens,
upper(left(lower(p_type), 1)) || substr(lower(p_type), 2) AS title, 'x\_' || p_brand AS marked, CASE WHEN p_size % 3 = 0 THEN 'https://example.org/' || p_partkey END AS uri,
CASE p_size % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS ordered, '#' || printf('%02x%02x%02x', (floor((1 - least(1.0, 0.2 + (p_size % 5) / 10.0)) * 255 + 0.5))::INT,
(floor((1 - (p_size % 5) / 10.0) * 255 + 0.5))::INT, (floor((1 - (p_size % 5) / 10.0) * 255 + 0.5))::INT) AS color FROM part""")
def text_functions(spark, sf_dir):
    """Clean text, tokens, title case, safe addresses, list markers and colours as column expressions."""
    size = F.col("p_size")
    uri = F.when(size % 3 == 0, F.concat(F.lit(" https://example.org/"), F.col("p_partkey").cast("string"), F.lit(" "))).otherwise(F.when(size % 3 == 1, F.lit("javascript:x")).otherwise(F.lit("https://a b")))
    item = F.when(size % 4 == 0, "12) x").when(size % 4 == 1, "▪x").otherwise("- x")
    ink = ((size % 5) / 10.0).cast("double")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", T.compatible(F.concat("p_name", F.lit("\x01ﬁnal ﬂow"))).alias("plain"), F.size(T.tokens(F.concat("p_name", F.lit(" a-b, "), F.col("p_brand")))).alias("tokens"),
        T.title_case(F.col("p_type")).alias("title"), T.markdown_escape(F.concat(F.lit("x_"), F.col("p_brand"))).alias("marked"), T.safe_uri(uri).alias("uri"),
        T.list_marker(item)["ordered"].alias("ordered"), T.cmyk_hex(F.lit(0.2), F.lit(0.0), F.lit(0.0), ink).alias("color"),
    )


# ------------------------------------------------------------------ verification
@_query("""SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>'))::INT AS headings, len(regexp_extract_all(html, '<(?:ul|ol)[ >]'))::INT AS lists, len(regexp_extract_all(html, '<li[ >]'))::INT AS items,
len(regexp_extract_all(html, '<table[ >]'))::INT AS tables, len(regexp_extract_all(html, '<a [^>]*href="[^"]*"'))::INT AS links, len(regexp_extract_all(html, '<pre[ >]'))::INT AS code FROM pages""")
def inspected_pages(spark, sf_dir):
    """How many headings, lists, items, tables, links and code blocks a page has."""
    seen = verify.inspect(_t(spark, sf_dir, "pages"), "page_id", "html")
    return seen.select("page_id", *[F.size(c).alias(c) for c in ("headings", "lists", "items", "tables", "links", "code")])


@_query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS w FROM documents),
a AS (SELECT doc_id - doc_id % 2 AS pair, w, count(*) FILTER (WHERE doc_id % 2 = 0) AS l, count(*) FILTER (WHERE doc_id % 2 = 1) AS r FROM t GROUP BY 1, 2)
SELECT pair, sum(greatest(l - r, 0))::BIGINT AS missing, sum(greatest(r - l, 0))::BIGINT AS added FROM a GROUP BY 1""")
def document_diffs(spark, sf_dir):
    """Words that the second document of each pair lacks or has beyond the first, as multisets."""
    d = _t(spark, sf_dir, "documents")
    # whole texts meet by pair, in parts that don't grow with the table: counted in the reader's tasks, all words of 128 MB are held at once
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_A_SPLIT * d.rdd.getNumPartitions())
    met = d.select((F.col("doc_id") - F.col("doc_id") % 2).alias("pair"), F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") % 2 == 1, -1).alias("n"), "text")
    met = met.where("n is not null").repartition(parts, "pair")
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))
    return verify.net_difference(met.select("pair", "n", words.alias("w")), ["pair"], "w", "n")


@_query("""SELECT doc_id, check_id, passed, blocks FROM (SELECT c_custkey::VARCHAR AS doc_id, unnest(['name', 'order', 'none', 'draft']) AS check_id,
unnest([TRUE, TRUE, c_custkey % 2 = 0, FALSE]) AS passed, unnest([FALSE, FALSE, c_custkey % 2 = 1, FALSE]) AS blocks FROM customer)""")
def contracts_held(spark, sf_dir):
    """Checks of texts: contains, sequence and absence; only verified checks block."""
    c = _t(spark, sf_dir, "customer")
    texts = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.concat(F.lit("The "), F.col("c_name"), F.lit(" of "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 1, " draft").otherwise("")).alias("text"))
    checks = c.select(
        F.col("c_custkey").cast("string").alias("doc_id"),
        F.explode(F.array(
            verify.check("name", "contains", F.array("c_name"), True), verify.check("order", "sequence", F.array(F.lit("The"), F.col("c_name"), F.col("c_mktsegment")), True),
            verify.check("none", "absent", F.array(F.lit("draft")), True), verify.check("draft", "contains", F.array(F.lit("never said")), False),
        )).alias("c"),
    ).select("doc_id", "c.*")
    return verify.judged(texts, checks).select("doc_id", "check_id", "passed", "blocks")


# ------------------------------------------------------------------ drawings, scripts and styles
@_query("""SELECT s_suppkey::VARCHAR AS doc_id, 'vector' AS kind, 100.0 AS x, 300.0 + s_suppkey % 50 AS y, 120.0 AS width, 80.0 AS height, 2 AS parts,
'Figure ' || s_suppkey || ': ' || s_name AS caption FROM supplier""")
def captioned_drawings(spark, sf_dir):
    """Two boxes near each other are one drawing; of the texts around it, the small one just below is its caption."""
    k = F.col("s_suppkey")
    y = 300 + k % 50

    def box(x, low, w, h):
        corner = lambda a, b: F.struct(F.lit(a).cast("double").alias("x"), b.cast("double").alias("y"))
        points = F.array(corner(x, low), corner(x + w, low), corner(x + w, low + h), corner(x, low + h))
        return F.struct(points.alias("points"), F.lit("#336699").alias("color"), F.lit(1.0).alias("opacity"))

    fills = F.array(box(100.0, y, 50.0, 80.0), box(170.0, y + 10, 50.0, 40.0))
    words = [layout.span(F.lit(n), F.lit("Words of the body that fill a line of it."), F.lit(100.0), F.lit(600.0 - 13 * n)) for n in range(4)]
    caption = layout.span(F.lit(4), F.concat(F.lit("Figure "), k.cast("string"), F.lit(": "), F.col("s_name")), F.lit(100.0), y - 12, size=8.0, family="Body-Italic", width=F.lit(118.0))
    pages = _t(spark, sf_dir, "supplier", "s_suppkey").select(*layout.page_of(k, F.lit(1), F.array(*words, caption), fills.alias("fills")))
    return media.media(pages).select("doc_id", "kind", "bounds.x", "bounds.y", "bounds.width", "bounds.height", "parts", "caption")


@_query("""SELECT n_nationkey::VARCHAR AS doc_id, 'page-1-vector-1.svg' AS name, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="50 ' || (792 - 150 - n_nationkey) || ' 100 ' || (50 + n_nationkey) ||
'"><g transform="translate(0 792) scale(1 -1)"><path d="M 50 100 L 150 100" fill="none" stroke="#000000" stroke-width="1"/><path d="M 50 100 L 50 ' || (150 + n_nationkey) || '" fill="none" stroke="#000000" stroke-width="1"/></g></svg>' AS svg FROM nation""")
def drawn_assets(spark, sf_dir):
    """Strokes that meet, as one SVG file a page."""
    line = lambda d: F.struct(d.alias("d"), F.lit("#000000").alias("stroke"), F.lit(1.0).alias("stroke_width"))
    up = F.concat(F.lit("M 50 100 L 50 "), (150 + F.col("n_nationkey")).cast("string"))
    pages = _t(spark, sf_dir, "nation").select(*layout.page_of(F.col("n_nationkey"), F.lit(1), F.array(layout.span(F.lit(0), F.lit("x"), F.lit(300.0), F.lit(300.0))), F.array(line(F.lit("M 50 100 L 150 100")), line(up)).alias("paths")))
    return media.assets(pages).select("doc_id", "name", F.decode("data", "utf-8").alias("svg"))


@_query("""SELECT p_partkey::VARCHAR AS doc_id, u.k::INT AS seq, CASE WHEN p_size % 2 = 0 THEN CASE u.k WHEN 0 THEN 'שלום' WHEN 1 THEN p_brand ELSE 'עולם' END ELSE CASE u.k WHEN 0 THEN 'abc' WHEN 1 THEN p_brand ELSE 'xyz' END END AS text,
CASE WHEN p_size % 2 = 0 THEN 'rtl' ELSE 'ltr' END AS direction FROM part, (SELECT unnest([0, 1, 2]) AS k) u""")
def scripts_in_order(spark, sf_dir):
    """Hebrew painted from the left with its letters in visual order is put in reading order; Latin lines stay."""
    even = F.col("p_size") % 2 == 0
    text = lambda a, b: F.when(even, F.lit(a)).otherwise(F.lit(b))
    spans = F.array(
        layout.span(F.lit(0), text("םלוע", "abc"), F.lit(40.0), F.lit(700.0)), layout.span(F.lit(1), F.col("p_brand"), F.lit(90.0), F.lit(700.0)),
        layout.span(F.lit(2), text("םולש", "xyz"), F.lit(160.0), F.lit(700.0)),
    )
    found = media.in_reading_direction(_t(spark, sf_dir, "part", "p_partkey").select(*layout.page_of(F.col("p_partkey"), F.lit(1), spans)))
    return found.select("doc_id", "seq", "text", "direction")


@_query("""SELECT s_suppkey::VARCHAR AS doc_id, '<p>Sold by <strong>' || s_name || '</strong> in <em>nation ' || s_nationkey || '</em>, <span style="color:#ff0000">now</span>.</p>' AS html,
'Sold by **' || s_name || '** in _nation ' || s_nationkey || '_, <span style="color:#ff0000">now</span>.' || chr(10) || chr(10) AS md FROM supplier""")
def inline_styles(spark, sf_dir):
    """Weight, slant and colour of spans as markup of a paragraph."""
    pieces = [("Sold by ", "Body"), (F.col("s_name"), "Body-Bold"), (" in ", "Body"), (F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), "Body-Italic"), (", ", "Body"), ("now", "Red"), (".", "Body")]
    spans, x = [], F.lit(40.0)
    for k, (text, family) in enumerate(pieces):
        text = text if not isinstance(text, str) else F.lit(text)
        s = layout.span(F.lit(k), text, x, F.lit(300.0), family="Body" if family == "Red" else family)
        spans.append(s.withField("color", F.lit("#ff0000")) if family == "Red" else s)
        x = x + F.length(text) * 5.0
    blocks = page.blocks(_t(spark, sf_dir, "supplier", "s_suppkey").select(*layout.page_of(F.col("s_suppkey"), F.lit(1), F.array(*spans))))
    out = document.assemble(blocks).withColumn("style", F.lit(None).cast("string"))
    return out.select("doc_id", document.block_html().alias("html"), document.block_markdown().alias("md"))


@_query("""SELECT n_nationkey::VARCHAR AS doc_id, '<section class="pdf-page" style="position:relative;width:612px;height:792px"><span style="position:absolute;left:40px;bottom:700px;font:10px sans-serif;color:#000000;white-space:pre">' || n_name || ' &amp; co</span></section>' AS html FROM nation""")
def positioned_pages(spark, sf_dir):
    """Pages with their text in place; spans of one look that touch are one."""
    spans = F.array(layout.span(F.lit(0), F.col("n_name"), F.lit(40.0), F.lit(700.0)), layout.span(F.lit(1), F.lit(" & co"), 40.0 + F.length("n_name") * 5.0, F.lit(700.0)))
    return media.positioned(_t(spark, sf_dir, "nation").select(*layout.page_of(F.col("n_nationkey"), F.lit(1), spans))).select("doc_id", "html")


@_query("""SELECT s_nationkey::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::INT AS page,
'<h1>' || s_name || '</h1><p>In nation ' || s_nationkey || '.</p><section><dl><div><dt>Balance</dt><dd>$' || s_suppkey || '.50</dd></div><div><dt>Share</dt><dd>7%</dd></div></dl></section>' AS html FROM supplier""")
def pages_alone(spark, sf_dir):
    """Each page's blocks as HTML by themselves: a title, a sentence, and amounts by name."""
    n = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    spans = F.array(
        layout.span(F.lit(0), F.col("s_name"), F.lit(40.0), F.lit(700.0), size=20.0), layout.span(F.lit(1), F.concat(F.lit("In nation "), F.col("s_nationkey").cast("string"), F.lit(".")), F.lit(40.0), F.lit(660.0)),
        layout.span(F.lit(2), F.lit("Balance"), F.lit(40.0), F.lit(600.0), family="Body-Bold"), layout.span(F.lit(3), F.concat(F.lit("$"), F.col("s_suppkey").cast("string"), F.lit(".50")), F.lit(200.0), F.lit(600.0)),
        layout.span(F.lit(4), F.lit("Share"), F.lit(40.0), F.lit(585.0), family="Body-Bold"), layout.span(F.lit(5), F.lit("7%"), F.lit(200.0), F.lit(585.0)),
    )
    return document.page_flow(page.blocks(_t(spark, sf_dir, "supplier").select(*layout.page_of(F.col("s_nationkey"), n, spans)))).select("doc_id", "page", "html")
