"""Queries of the sources: containers, clips, fonts, links and streams of pages; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import document, page, verify
from .plans import layout, write
from .queries import QUERIES, SQL, _accounts, _ledger_sums, _ledgers, _query, _t  # noqa: F401  QUERIES is this module's too
from .sources import ccitt, datasource, pdf
from .streaming import flow, run


@_query("""SELECT s_nationkey::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::INT AS page, s_name AS text FROM supplier""")
def pdf_large_containers(spark, sf_dir):
    """Files whose objects all stand in one object stream of over 16 MiB, more than what a reader may keep."""

    def make(names: list[str]) -> bytes:
        w = write.Writer()
        w.shared = b"/MediaBox[0 0 612 792]/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        for k in range(24):
            w.add(b"(%s)" % (b"%d filler " % k * ((700 << 10) // 9)))
        w.pages([write.flate(write.show(40, 700, 10, write.literal(n))) for n in names], fan=3)
        return w.packed(60_000)

    nations = _t(spark, sf_dir, "supplier", "s_nationkey").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    files = write.printed(nations.select("doc_id", F.transform("s", lambda x: x["s_name"]).alias("names")), make)
    return pdf.pages_of(files, max_object_cache_bytes=256 << 10).select("doc_id", "page", F.get("spans", F.lit(0))["text"].alias("text"))


def _flowing(pages: DataFrame, cuts: list[int], name: str) -> DataFrame:
    """The runs of documents whose pages arrive batch by batch; the last batch says that they end."""
    folder = run.shared_folder(pages.sparkSession, name)
    blocks = page.blocks(pages)
    ends = pages.select("doc_id").distinct()
    return run.by_batches(blocks.unionByName(ends, allowMissingColumns=True), "page", cuts, flow.assembled, folder)


@_query(SQL["tables_over_pages"])
def stream_tables_over_pages(spark, sf_dir):
    """Tables that go on from batch to batch of a stream of pages, put together by state; sums of their rows."""
    return _ledger_sums(_flowing(_ledgers(spark, sf_dir), [4, 9], "ledgers"))


@_query(SQL["paragraphs_over_pages"])
def stream_paragraphs_over_pages(spark, sf_dir):
    """Paragraphs over a page break that is a batch's end too; the page after gives a hyphen back."""
    runs = _flowing(_accounts(spark, sf_dir), [1], "accounts")
    return runs.where("run = 1").select("doc_id", "text", F.lit(2).cast("bigint").alias("pages"))


def _named(path: str) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+)\.pdf$", 1)


def _brands(spark, sf_dir) -> DataFrame:
    """(path, size) of PDF files in the shared folder: a file a brand, a page a part."""

    def make(names: list[str]) -> bytes:
        w = write.Writer()
        w.shared = b"/MediaBox[0 0 612 792]/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        w.pages([write.flate(write.show(40, 700, 10, write.literal(n))) for n in names], fan=7)
        return w.packed()

    brands = _t(spark, sf_dir, "part", "p_brand").groupBy(F.col("p_brand").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("n"))
    files = write.printed(brands.select("doc_id", F.transform("n", lambda x: x["p_name"]).alias("names")), make)
    return write.to_folder(files, run.shared_folder(spark, "brands"))


@_query("""SELECT p_brand AS name, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS page, p_name AS text FROM part""")
def pdf_stream(spark, sf_dir):
    """Files of a folder as a stream, read on executors by parts, to the end of what is there."""
    datasource.register(spark)
    folder = run.shared_folder(spark, "stream")
    path = _folder_of(_brands(spark, sf_dir))
    pages = spark.readStream.format("pdf").options(path=path, partitionBytes=20_000).load()
    return run.to_end(pages.select(_named("doc_id").alias("name"), "page", F.get("spans", F.lit(0))["text"].alias("text")), folder)


@_query("""SELECT name, page, text FROM (SELECT p_brand AS name, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS page, p_name AS text FROM part) WHERE page BETWEEN 3 AND 5 AND name LIKE '%2'""")
def pdf_pushed_pages(spark, sf_dir):
    """Conditions on pages and files that reach the reader: other files stay shut, other pages unread."""
    pages = datasource.pages_where(spark, _folder_of(_brands(spark, sf_dir)), "page >= 3 and page <= 5 and doc_id like '%2.pdf'")
    return pages.select(_named("doc_id").alias("name"), "page", F.get("spans", F.lit(0))["text"].alias("text"))


def _folder_of(files: DataFrame) -> str:
    """The folder of written files; running the plan writes them."""
    return files.agg(F.min(F.regexp_extract("path", r"^(.*)/", 1)).alias("f")).first()["f"]


# ------------------------------------------------------------------ content
@_query("""SELECT s_suppkey::VARCHAR AS doc_id, u.seq::INT AS seq, CASE u.seq WHEN 0 THEN '#336699' ELSE '#800080' END AS color,
(CASE u.seq WHEN 0 THEN (50.0 + s_suppkey % 20) * 50.0 ELSE 30.0 * (20.0 + s_suppkey % 10) - 100.0 END)::DOUBLE AS visible, 2::INT AS clips FROM supplier, (SELECT unnest([0, 1]) AS seq) u""")
def pdf_clips(spark, sf_dir):
    """Fills and shadings inside nested clips: the area that shows, and how many clips bound each."""

    def make(key: int) -> bytes:
        w = write.Writer()
        w.shared += b"/Resources<</Shading<</S<</ShadingType 2/Function<</FunctionType 2/C0[1 0 0]/C1[0 0 1]/N 1>>>>>>>>"
        nested = b"q 0 0 %d 100 re W n q 50 50 200 200 re W n 0.2 0.4 0.6 rg 0 0 400 400 re f Q Q " % (100 + key % 20)
        # an even-odd ring inside two clips, filled by a shading
        ring = b"q 0 0 300 300 re W n q 0 0 200 200 re W n q 10 10 30 %d re 20 20 10 10 re W* n /S sh Q Q Q" % (20 + key % 10)
        w.pages([write.stream(nested + ring)])
        return w.table()

    files = write.printed(_t(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").alias("k")), make)
    pages = pdf.pages_of(files)
    paths = pages.select("doc_id", F.posexplode("paths").alias("seq", "p")).select("doc_id", "seq", (F.size(F.coalesce("p.clips", F.array()))).alias("n"))
    # a shading's ring is two polygons; what shows of it is their difference
    fills = pages.select("doc_id", F.posexplode("fills").alias("k", "f")).groupBy("doc_id", F.least("k", F.lit(1)).alias("seq")).agg(
        F.first("f.color").alias("color"), F.sum(F.when(F.col("k") < 2, F.col("f.visible")).otherwise(-F.col("f.visible"))).alias("visible")
    )
    met = fills.join(paths, ["doc_id", "seq"])
    return met.select("doc_id", F.col("seq").cast("int").alias("seq"), "color", F.round("visible", 6).alias("visible"), F.col("n").alias("clips"))


@_query("""SELECT c_custkey::VARCHAR AS doc_id, c_name || CASE c_custkey % 4 WHEN 0 THEN chr(65533) WHEN 1 THEN chr(128512) WHEN 2 THEN chr(65533) ELSE '' END AS text FROM customer""")
def pdf_odd_codes(spark, sf_dir):
    """Composite fonts without a map of their own: codes that are half a surrogate pair, and pairs under a UTF-16 encoding."""

    def make(key: int, name: str) -> bytes:
        w = write.Writer()
        below = w.add(b"<</Type/Font/Subtype/CIDFontType2/BaseFont/B/DW 500>>")
        tail = (b"D83D", b"D83DDE00", b"D800", b"")[key % 4]
        encoding = b"/UniJIS-UTF16-H" if key % 4 == 1 else b"/Identity-H"
        font = w.font(b"/Subtype/Type0/BaseFont/B/Encoding%s/DescendantFonts[%d 0 R]" % (encoding, below))
        text = b"<" + b"".join(b"%04X" % ord(c) for c in name) + tail + b">"
        w.pages([write.stream(write.show(40, 700, 10, text))], [b"/Resources<</Font<</F1 %d 0 R>>>>" % font])
        return w.table()

    files = write.printed(_t(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("k"), "c_name"), make)
    return pdf.pages_of(files).select("doc_id", F.get("spans", F.lit(0))["text"].alias("text"))


@_query("""SELECT s_suppkey::VARCHAR AS doc_id, 'along' AS text, CASE s_suppkey % 3 WHEN 0 THEN 'https://example.org/' || s_suppkey WHEN 1 THEN 'https://example.org/' || s_suppkey END AS href FROM supplier
UNION ALL SELECT s_suppkey::VARCHAR, 'beside', CASE WHEN s_suppkey % 3 = 1 THEN 'https://example.org/' || s_suppkey END FROM supplier""")
def pdf_turned_links(spark, sf_dir):
    """Link regions: a turned quadrilateral takes only the text inside it, its rectangle the text beside it too; scripts are no links."""

    def make(key: int) -> bytes:
        w = write.Writer()
        w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % w.font()
        body = b"BT /F1 10 Tf 0.7071 0.7071 -0.7071 0.7071 110 105 Tm (along) Tj ET " + write.show(150, 105, 10, b"(beside)")
        where = b"/Rect[90 90 220 220]" + (b"" if key % 3 == 1 else b"/QuadPoints[100 90 210 200 90 105 200 215]")
        to = b"javascript:x" if key % 3 == 2 else b"https://example.org/%d" % key
        w.pages([write.stream(body)], [b"/Annots[<</Subtype/Link/A<</S/URI/URI(%s)>>%s>>]" % (to, where)])
        return w.table()

    files = write.printed(_t(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").alias("k")), make)
    return pdf.pages_of(files).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.text", "s.href")


@_query("""SELECT p_partkey::VARCHAR AS doc_id, upper(p_brand) AS text, (SELECT sum(CASE WHEN c BETWEEN 'A' AND 'M' THEN 2.0 WHEN c BETWEEN 'N' AND 'Z' THEN 7.0 ELSE 5.0 END)
FROM (SELECT unnest(string_split(upper(p_brand), '')) AS c))::DOUBLE AS width FROM part""")
def pdf_cid_maps(spark, sf_dir):
    """An encoding CMap whose ranges overlap (the last counts) joined with ToUnicode by code: text by one, widths by the other."""

    def make(text: str) -> bytes:
        w = write.Writer()
        n = len(text)
        # codes 1, 2, ... in the order of the text; a range over all of them, then one entry a code
        cid = lambda c: 10 if "A" <= c <= "M" else 20 if "N" <= c <= "Z" else 30
        entries = b" ".join(b"<%04X> %d" % (k + 1, cid(c)) for k, c in enumerate(text))
        enc = w.add(write.flate(b"1 begincidrange <0000> <FFFF> 0 endcidrange %d begincidchar %s endcidchar" % (n, entries)))
        chars = b" ".join(b"<%04X> <%04X>" % (k + 1, ord(c)) for k, c in enumerate(text))
        to = w.add(write.flate(b"1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfchar %s endbfchar" % (n, chars)))
        below = w.add(b"<</Type/Font/Subtype/CIDFontType2/BaseFont/B/DW 1000/W[10[200] 20[700] 30[500]]>>")
        font = w.font(b"/Subtype/Type0/BaseFont/B/Encoding %d 0 R/ToUnicode %d 0 R/DescendantFonts[%d 0 R]" % (enc, to, below))
        shown = b"<" + b"".join(b"%04X" % (k + 1) for k in range(n)) + b">"
        w.pages([write.stream(write.show(40, 700, 10, shown))], [b"/Resources<</Font<</F1 %d 0 R>>>>" % font])
        return w.table()

    files = write.printed(_t(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.upper("p_brand").alias("text")), make)
    pages = pdf.pages_of(files).select("doc_id", F.get("spans", F.lit(0)).alias("s"))
    return pages.select("doc_id", "s.text", F.round("s.bounds.width", 6).alias("width"))


# ------------------------------------------------------------------ pages as they are read
@_query("""SELECT p_partkey::VARCHAR AS doc_id, CASE p_size % 2 WHEN 0 THEN 'שלום עולם ' || p_size ELSE 'name ' || p_name END AS text,
'paragraph' AS block_type FROM part UNION ALL SELECT p_partkey::VARCHAR, 'שורה שנייה', 'paragraph' FROM part""")
def blocks_right_to_left(spark, sf_dir):
    """Paragraphs whose letters are painted from the left in visual order: text of blocks in reading order."""
    even = F.col("p_size") % 2 == 0
    shown = F.when(even, F.concat(F.reverse(F.col("p_size").cast("string")), F.lit(" םלוע םולש"))).otherwise(F.concat(F.lit("name "), F.col("p_name")))
    spans = F.array(layout.span(F.lit(0), shown, F.lit(40.0), F.lit(700.0)), layout.span(F.lit(1), F.lit("היינש הרוש"), F.lit(40.0), F.lit(500.0)))
    return page.blocks(_t(spark, sf_dir, "part", "p_partkey").select(*layout.page_of(F.col("p_partkey"), F.lit(1), spans))).select("doc_id", "text", "block_type")


@_query("""SELECT s_suppkey::VARCHAR AS doc_id, s_name AS title, 'Key=' || s_suppkey || ' Nation=' || s_nationkey AS items, CASE WHEN s_suppkey % 4 IN (1, 3) THEN 792.0 ELSE 612.0 END AS width FROM supplier""")
def blocks_of_turned_pages(spark, sf_dir):
    """Pages with a rotation, their text turned the other way so that it reads upright when shown: rows, a heading and a table as on an upright page."""

    def make(key: int, name: str, nation: int) -> bytes:
        turn = 90 * (key % 4)
        wide, high = (792, 612) if turn in (90, 270) else (612, 792)  # as shown
        back = {0: lambda x, y: (x, y), 90: lambda x, y: (612 - y, x), 180: lambda x, y: (612 - x, 792 - y), 270: lambda x, y: (y, 792 - x)}[turn]
        matrix = {0: b"1 0 0 1", 90: b"0 1 -1 0", 180: b"-1 0 0 -1", 270: b"0 -1 1 0"}[turn]
        w = write.Writer()
        font = w.font(b"/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding")
        w.shared += b"/Rotate %d/Resources<</Font<</F1 %d 0 R>>>>" % (turn, font)
        out = []
        for x, y, size, text in [(40, high - 60, 20, name), *[(40 + 160 * c, high - 120 - 15 * r, 10, t) for r, row in enumerate((("Key", "Nation"), (str(key), str(nation)))) for c, t in enumerate(row)]]:
            px, py = back(x, y)
            out.append(b"BT /F1 %d Tf %s %g %g Tm %s Tj ET" % (size, matrix, px, py, write.literal(text)))
        w.pages([write.stream(b" ".join(out))])
        return w.table()

    files = write.printed(_t(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), "s_suppkey", "s_name", "s_nationkey"), make)
    pages = pdf.pages_of(files)
    blocks = page.blocks(pages)
    title = F.max(F.when(F.col("block_type") == "heading", F.col("text")))
    cell = lambda r, c: F.get(F.get(F.col("table.rows"), F.lit(r))["cells"], F.lit(c))
    items = F.max(F.when(F.col("block_type") == "table", F.concat(cell(0, 0), F.lit("="), cell(1, 0), F.lit(" "), cell(0, 1), F.lit("="), cell(1, 1))))
    return blocks.groupBy("doc_id").agg(title.alias("title"), items.alias("items"), F.max("width").alias("width"))


@_query("""SELECT count(DISTINCT (l_suppkey, p))::BIGINT AS pages_processed, 0::BIGINT AS suppressed_furniture, sum(CASE WHEN p > 0 AND k = 0 THEN 1 ELSE 0 END)::BIGINT AS merged_tables,
count(DISTINCT l_suppkey)::BIGINT AS runs, (SELECT max(n) FROM (SELECT ceil(count(*) / 40.0)::BIGINT AS n FROM lineitem GROUP BY l_suppkey)) AS most_parts
FROM (SELECT l_suppkey, (row_number() OVER w - 1) // 40 AS p, (row_number() OVER w - 1) % 40 AS k FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber))""")
def observed_documents(spark, sf_dir):
    """Counts of an assembly whose chunks are written, over the rows kept for that; no page is taken apart again for them."""
    seen = document.Observed()
    runs = document.assemble(page.blocks(_ledgers(spark, sf_dir)), observed=seen)
    document.html(runs).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get().values())], "pages_processed bigint, suppressed_furniture bigint, merged_tables bigint, runs bigint, most_parts bigint")


@_query("""SELECT doc_id::VARCHAR AS doc_id, n AS expected, n AS actual, n AS common, 1.0::DOUBLE AS kept FROM (
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'))::INT AS n FROM documents)""")
def reading_order_kept(spark, sf_dir):
    """The words of a document and of the same text with marks put between them: all in the same order."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), 0)
    marked = F.regexp_replace("text", r"([^\p{L}\p{N}]+)", " — $1")
    return verify.order_kept(d.select("doc_id", words("text").alias("w")), d.select("doc_id", words(marked).alias("w")), "doc_id", "w")


# ------------------------------------------------------------------ fonts
def _drawn_font(w: write.Writer, key: int) -> int:
    """A Type 3 font: a is a box of some size, b a Group 4 mask of four rows."""
    import numpy as np

    side = 100 + 10 * (key % 5)
    image = np.array([[x < 1 + (key % 5 + r) % 8 for x in range(8)] for r in range(4)], np.uint8)
    mask = b"750 0 0 0 8 4 d1 8 0 0 4 0 0 cm BI /W 8 /H 4 /IM true /F /CCF /DP <</K -1>> ID %s EI" % ccitt.encoded(image)
    a, b = w.add(write.stream(b"500 0 0 0 500 500 d1 0 0 %d %d re f" % (side, side))), w.add(write.stream(mask))
    return w.add(
        b"<</Type/Font/Subtype/Type3/FontMatrix[0.001 0 0 0.001 0 0]/FontBBox[0 0 9 9]/FirstChar 97/LastChar 98/Widths[500 750]"
        b"/CharProcs<</a %d 0 R/b %d 0 R>>/Encoding<</Differences[97/a/b]>>>>" % (a, b)
    )


def _drawn_files(spark, sf_dir) -> DataFrame:
    """A file a supplier, of one to three pages set in a font of drawings."""

    def make(key: int) -> bytes:
        w = write.Writer()
        w.shared += b"/Resources<</Font<</F1 %d 0 R>>>>" % _drawn_font(w, key)
        w.pages([write.stream(write.show(40, 700, 10, b"(ab)")) for _ in range(1 + key % 3)])
        return w.table()

    return write.printed(_t(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").alias("k")), make)


@_query("""SELECT s_suppkey::VARCHAR AS doc_id, u.code::INT AS code, CASE u.code WHEN 97 THEN 0.5 ELSE 0.75 END::DOUBLE AS advance,
(CASE u.code WHEN 97 THEN (100 + 10 * (s_suppkey % 5)) * (100 + 10 * (s_suppkey % 5)) ELSE (SELECT sum(1 + (s_suppkey % 5 + r) % 8) FROM (SELECT unnest([0, 1, 2, 3]) AS r)) END)::DOUBLE AS painted
FROM supplier, (SELECT unnest([97, 98]) AS code) u""")
def type3_glyphs(spark, sf_dir):
    """Glyphs that are drawings, one of them a Group 4 mask: advances, and how much of a thousandth grid they paint."""
    glyphs = pdf.fonts_of(_drawn_files(spark, sf_dir)).select("doc_id", F.explode("glyphs").alias("g"))
    side = lambda f, c: F.array_max(F.transform(f["points"], lambda p: p[c])) - F.array_min(F.transform(f["points"], lambda p: p[c]))
    area = F.aggregate("g.fills", F.lit(0.0), lambda s, f: s + side(f, "x") * side(f, "y"))
    return glyphs.select("doc_id", "g.code", F.round("g.advance", 9).alias("advance"), F.round(area * 1e6, 6).alias("painted"))


@_query("""SELECT min(s_suppkey::VARCHAR) AS doc_id, 1::INT AS page, 'type3' AS format, 2::INT AS glyphs, count(*)::BIGINT AS files, sum(1 + s_suppkey % 3)::BIGINT AS spans FROM supplier GROUP BY s_suppkey % 5""")
def font_assets(spark, sf_dir):
    """Fonts by their content: one row for all files that have the same one, and the spans that are set in it."""
    files = _drawn_files(spark, sf_dir)
    fonts = pdf.fonts_of(files)
    spans = pdf.pages_of(files).select("doc_id", "page", F.explode("spans").alias("s")).select("doc_id", "page", "s.font_name")
    used = pdf.spans_with_fonts(spans, fonts).groupBy("font_id").agg(F.countDistinct("doc_id").alias("files"), F.count(F.lit(1)).alias("spans"))
    return pdf.font_assets(fonts).join(used, "font_id").select("doc_id", "page", "format", F.size("glyphs").alias("glyphs"), "files", "spans")


#: A kind for each check of the query below.
_CHECKS = "row row rowContains tableRows tableRows flowParagraph flowParagraph group group labelValue labelValue mediaCaption mediaCaption noControls sequence".split()


@_query("SELECT c_custkey::VARCHAR AS doc_id, 'c' || lpad(k::VARCHAR, 2, '0') AS check_id, CASE WHEN k = 13 THEN c_custkey % 2 = 0 ELSE k IN (0, 2, 3, 5, 7, 9, 11, 14) END AS passed "
"FROM customer, (SELECT unnest(range(15)) AS k)")
def page_contracts(spark, sf_dir):
    """Contracts of all kinds on pages made of customers: those that hold, and beside each one that does not."""
    c = _t(spark, sf_dir, "customer")
    name, segment, key = F.col("c_name"), F.lower("c_mktsegment"), F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit("<h2>"), name, F.lit("</h2><p>Account <b>"), key, F.lit("</b> of "), segment, F.lit("</p><table><tr><th>Name</th><th>Kind</th></tr><tr><td>"), name, F.lit("</td><td> "), segment,
        F.lit("</td></tr><tr><td>in a cell</td><td>"), key, F.lit("</td></tr></table><div>Key: <i>"), key, F.lit("</i></div><p>Label</p><p>Value</p><figure><img src='x'><figcaption>Picture of "), name,
        F.lit("</figcaption></figure>"),
    )
    texts = c.select(key.alias("doc_id"), html.alias("html"), F.concat(verify.plain_text(html), F.when(F.col("c_custkey") % 2 == 1, F.lit("\x07")).otherwise("")).alias("text"))
    values = {
        0: F.array(name, segment), 1: F.array(segment, name), 2: F.array(F.lit("a cell"), key), 3: F.array(F.lit("3")), 4: F.array(F.lit("4")), 5: F.array(F.lit("Account"), segment),
        6: F.array(F.lit("in a cell")), 7: F.array(F.lit("h2"), name), 8: F.array(F.lit("h3"), name), 9: F.array(F.lit("Key:"), key), 10: F.array(F.lit("Label"), F.lit("Value")),
        11: F.array(F.lit("img"), name), 12: F.array(F.lit("svg"), name), 13: F.array().cast("array<string>"), 14: F.array(name, segment, F.lit("Picture of")),
    }
    checks = F.array(*[verify.check(f"c{k:02}", kind, values[k], True) for k, kind in enumerate(_CHECKS)])
    return verify.judged(texts, c.select(key.alias("doc_id"), F.explode(checks).alias("c")).select("doc_id", "c.*")).select("doc_id", "check_id", "passed")
